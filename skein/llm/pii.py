"""Personal data by weak supervision, in DataFrame functions only.

Wide patterns propose candidate spans.  Three labelers vote on each candidate (1, -1, or 0 for
no opinion): a strict form check, a gazetteer and the words in front of it.  The votes are
counted by kind and pattern - a table whose size does not depend on the corpus - and
expectation-maximisation over these counts estimates how reliable each labeler is for each
kind.  The posteriors then train a logistic span classifier over span features, again from
counts, whose weights go back into one column expression.

Spans of the four base kinds that pass their form check are always reported; the classifier
decides about the further kinds.

Positions come from splitting a text at a pattern and interleaving the gaps with the matches;
they are code points.  Patterns use possessive quantifiers, so that Java's matcher neither
recurses nor rescans on long runs.

Defined results: a null text counts as empty; empty texts and tables give no spans; repeated
rows are scanned one by one; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from skein.llm.common import materialise, sha256_hex

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "iban", "ssn", "tel")

# Forms of the kinds.
PATTERNS = {
    # An address starts where a run of its characters starts, or right behind the last match.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20\p{Lu}\p{L}{1,30}+(?:\x20\p{Lu}\p{L}{1,30}+){0,2}+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+\b",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
# Gazetteers and context words.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91", "351", "353", "358", "420")
GIVEN_NAMES = ("james", "mary", "john", "linda", "anna", "maria", "peter", "paul", "hans", "julia", "pierre", "marie", "jean", "carlos", "jose", "lucia", "david", "sarah", "thomas", "laura", "michael", "emma")
IBAN_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
CONTEXT = {
    "email": (("mail", "contact", "write", "reach", "@"), ("example", "version")),
    "ip": (("ip", "addr", "host", "server", "from", "login"), ("version", "section", "release", "v.")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "payment"), ("isbn", "order", "tracking", "invoice")),
    "phone": (("phone", "call", "tel", "mobile", "fax", "dial"), ("isbn", "order")),
    "name": (("name", "patient", "dear", "signed", "by "), ("street", "avenue")),
    "iban": (("iban", "account", "bank", "konto", "compte"), ("serial", "license")),
    "ssn": (("ssn", "social security", "social-security"), ("order", "part", "serial")),
    "tel": (("phone", "call", "tel", "mobile", "fax", "dial"), ("isbn", "order", "part")),
}
CONTEXT_CHARS = 40
SPAN_TYPE = "array<struct<kind:int,start:int,end:int,form:int,gazetteer:int,context:int,size:int,digits:int,edge:int,case:int>>"
#: The first three are the votes; the classifier alone sees the others: length, share of digits, what stands around a span, its letters.
FEATURES = ("form", "gazetteer", "context", "size", "digits", "edge", "case")
#: Matches whose lengths are summed at once.
BLOCK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _form(kind: str, v: Column) -> Column:
    """Whether the strict form of a kind holds."""
    n = F.length(_digits(v))
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit(3)).try_cast("int"), F.lit(999)) <= 255)
        return F.forall(F.split(v, r"\."), small)
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "ssn":
        return ~(F.left(v, F.lit(3)).isin("000", "666") | (F.left(v, F.lit(1)) == "9") | (F.substring(v, 5, 2) == "00") | (F.right(v, F.lit(4)) == "0000"))
    if kind == "iban":
        tight = F.replace(v, F.lit(" "))
        moved = F.concat(F.substring(tight, 5, 40), F.left(tight, F.lit(4)))
        value = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise((s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))
        return rest == 1
    return F.lit(True)


def _gazetteer(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.substring_index(v, ".", -1)).isin(*TOP_LEVEL), 1).otherwise(0)
    if kind == "ip":
        return F.when(F.substring_index(v, ".", 1).isin("0", "127", "255"), -1).otherwise(0)
    if kind == "card":
        return F.when(F.left(v, F.lit(1)).isin("3", "4", "5", "6"), 1).otherwise(-1)
    if kind == "phone":
        code = _digits(v)
        return F.when(reduce(lambda a, b: a | b, (F.left(code, F.lit(k)).isin(*[c for c in CALLING_CODES if len(c) == k]) for k in (1, 2, 3))), 1).otherwise(-1)
    if kind == "name":
        return F.when(F.exists(F.split(F.lower(v), " "), lambda w: w.isin(*GIVEN_NAMES)), 1).otherwise(0)
    if kind == "iban":
        return F.when(F.left(v, F.lit(2)).isin(*IBAN_COUNTRIES), 1).otherwise(-1)
    return F.lit(0)


def _guard(kind: str, text: Column, has_digit: Column) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "name":
        return text.rlike(r"\b(?:M[rs]s?|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame)\.?\x20\p{Lu}")
    return has_digit & (F.contains(text, F.lit("+")) if kind == "phone" else F.lit(True))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_of(sizes: Column) -> Column:
    """The sum of the sizes in front of each, by blocks, so that the work does not grow with their square."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    of_blocks = lambda all_: F.transform(F.sequence(F.lit(0), block(F.size(all_))), lambda b: total(F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
    before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
    place = lambda all_, front: F.transform(all_, lambda _, i: F.get(front, block(i)) + total(F.slice(all_, block(i) * BLOCK + 1, i % BLOCK)))
    return _let(sizes, lambda all_: _let(of_blocks(all_), lambda sums: _let(before(sums), lambda front: place(all_, front))))


def candidates(kind: str, text: Column, has_digit: Column) -> Column:
    """All candidate spans of one kind with the labelers' votes and the features, by start."""
    gaps = F.split(text, PATTERNS[kind], -1)
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    around = lambda g, h: F.zip_with(
        F.zip_with(F.slice(g, 1, F.size(h)), F.slice(g, F.lit(2), F.size(h)), lambda x, y: F.struct(F.length(x).alias("gap"), F.lower(F.right(x, F.lit(CONTEXT_CHARS))).alias("before"), F.left(y, F.lit(1)).alias("after"))),
        h, lambda x, v: F.struct(x["gap"].alias("gap"), x["before"].alias("before"), x["after"].alias("after"), v.alias("hit")),
    )
    good, bad = CONTEXT[kind]

    def span(start: Column, p: Column) -> Column:
        v, n = p["hit"], F.length(p["hit"])
        share = F.length(_digits(v)) * 4 / n
        blank = lambda c: (F.trim(F.translate(c, "\n\t\r", "   ")) == "").cast("int")
        upper, lower = v.rlike("[A-Z]").cast("int"), v.rlike("[a-z]").cast("int")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + n).alias("end"),
            F.when(_form(kind, v), 1).otherwise(-1).alias("form"), _gazetteer(kind, v).alias("gazetteer"),
            F.when(_any_of(p["before"], good), 1).when(_any_of(p["before"], bad), -1).otherwise(0).alias("context"),
            F.least(F.lit(7), F.floor(F.log2(n.cast("double"))).cast("int")).alias("size"), F.floor(share).cast("int").alias("digits"),
            (2 * blank(F.right(p["before"], F.lit(1))) + F.greatest(blank(p["after"]), p["after"].isin(".", ",", ";", ")").cast("int"))).alias("edge"), (2 * upper + lower).alias("case"),
        )

    none = F.array().cast(SPAN_TYPE)
    sizes = lambda ps: F.transform(ps, lambda p: p["gap"] + F.length(p["hit"]))
    spans = lambda ps: F.zip_with(starts_of(sizes(ps)), ps, lambda at, p: span(at + p["gap"], p)).cast(SPAN_TYPE)
    found = _let(hits, lambda h: F.when(F.size(h) > 0, _let(around(gaps, h), spans)).otherwise(none))
    return F.when(_guard(kind, text, has_digit), found).otherwise(none)


def estimate(counts: list[tuple], rounds: int = 30) -> dict[tuple[int, int, int, int], float]:
    """Posterior of (kind, form, gazetteer, context) votes by expectation-maximisation.

    ``counts`` has rows (kind, form, gazetteer, context, n).  For each kind, a candidate is
    personal data with an unknown prior, and each labeler's vote depends on that alone.
    """
    posterior: dict[tuple, float] = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [(c[1:4], c[4]) for c in counts if c[0] == kind]
        belief = [min(0.95, max(0.05, 0.5 + 0.2 * sum(votes))) for votes, _ in rows]
        for _ in range(rounds):
            mass = {y: sum(n * (b if y else 1 - b) for (_, n), b in zip(rows, belief, strict=True)) + 1.0 for y in (0, 1)}
            prior = {y: mass[y] / (mass[0] + mass[1]) for y in (0, 1)}
            # A weak prior holds the meaning of the classes: votes agree with them more often than not.
            rate = {
                (j, v, y): (sum(n * (b if y else 1 - b) for (votes, n), b in zip(rows, belief, strict=True) if votes[j] == v) + (4.0 if v == (1 if y else -1) else 1.0)) / (mass[y] + 5.0)
                for j in range(3) for v in (-1, 0, 1) for y in (0, 1)
            }
            belief = []
            for votes, _ in rows:
                odds = math.log(prior[1] / prior[0]) + sum(math.log(rate[j, v, 1] / rate[j, v, 0]) for j, v in enumerate(votes))
                belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        posterior |= {(kind, *votes): b for (votes, _), b in zip(rows, belief, strict=True)}
    return posterior


def _active(kind: int, features: dict[str, int]) -> list[tuple]:
    return [("bias",), ("kind", kind), *((name, features[name]) for name in FEATURES), *(("kind", kind, name, features[name]) for name in ("form", "context"))]


def train(rows: list[Row], posterior: dict[tuple, float], rounds: int = 60, rate: float = 0.5) -> dict[tuple, float]:
    """Logistic weights of indicator features, from counted feature rows with soft labels."""
    data = [(_active(r["kind"], r.asDict()), posterior[r["kind"], r["form"], r["gazetteer"], r["context"]], math.log1p(r["n"])) for r in rows]
    weights: dict[tuple, float] = {}
    total = sum(n for *_, n in data) or 1.0
    for _ in range(rounds):
        slope: dict[tuple, float] = {}
        for active, label, n in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(a, 0.0) for a in active)))))
            for a in active:
                slope[a] = slope.get(a, 0.0) + n * (label - p)
        for a, g in slope.items():
            weights[a] = weights.get(a, 0.0) * 0.999 + rate * g / total * 4
    return weights


def _odds(span: Column, weights: dict[tuple, float]) -> Column:
    out = F.lit(weights.get(("bias",), 0.0))
    for feature, weight in weights.items():
        if feature == ("bias",):
            continue
        test = reduce(lambda a, b: a & b, (span[feature[i]] == feature[i + 1] for i in range(0, len(feature), 2)))
        out = out + F.when(test, weight).otherwise(0.0)
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its id, counts of all kinds, a digest of base spans, all spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("d", F.col("t").rlike("[0-9]"))
    scanned = materialise(scanned.select("id", F.concat(*(candidates(k, F.col("t"), F.col("d")) for k in KINDS)).alias("spans")))
    counted = scanned.select(F.explode("spans").alias("s")).select("s.*").groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded: kinds x votes x bins
    votes: dict[tuple, int] = {}
    for r in counted:
        key = (r["kind"], r["form"], r["gazetteer"], r["context"])
        votes[key] = votes.get(key, 0) + r["n"]
    weights = train(counted, estimate([(*k, n) for k, n in sorted(votes.items())])) if counted else {}
    last = len(BASE_KINDS)
    kept = F.filter("spans", lambda s: (s["form"] == 1) & ((s["kind"] < last) | (_odds(s, weights) >= math.log(threshold / (1 - threshold)))))
    names = F.array(*(F.lit(k) for k in KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("kept", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned.select("id", kept.alias("kept")).select(
        F.col("id").alias(id_col), *(of(k) for k in BASE_KINDS),
        sha256_hex(told(F.filter("kept", lambda s: s["kind"] < last))).alias("base_sha256"), told(F.col("kept")).alias("spans"),
        *(of(k) for k in KINDS[last:]),
    )
