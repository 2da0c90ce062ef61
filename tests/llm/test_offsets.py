"""Offsets of many matches, and further kinds of personal data against a plain version."""

import random
import re

from pyspark.sql import functions as F
from test_brute import of

from skein.llm import pii


def test_starts(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 129, 5000)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<int>")
    for r in df.select("i", pii.starts_of(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(rows[r["i"]][:k]) for k in range(len(rows[r["i"]]))] if len(rows[r["i"]]) < 200 else r["s"][-1] == sum(rows[r["i"]][:-1])


def test_many_matches(spark):
    text = "call 10.1.2.3 or a@b.com " * 20_000
    r = pii.find_pii(of(spark, [text])).first()
    assert (r["n_ip"], r["n_email"]) == (20_000, 20_000)
    assert r["spans"].split(",")[20_000 - 1] == f"email:{25 * 19_999 + 17}:{25 * 19_999 + 24}"


def plain(text):
    """Spans of the further kinds whose strict forms hold."""
    found = []
    for m in re.finditer(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", text):
        if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000":
            found.append(("ssn", *m.span()))
    for m in re.finditer(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", text):
        tight = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in tight[4:] + tight[:4])) % 97 == 1:
            found.append(("iban", *m.span()))
    for m in re.finditer(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", text):
        found.append(("tel", *m.span()))
    for m in re.finditer(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+){0,2}", text):
        found.append(("name", *m.span()))
    return sorted(found)


def test_further_kinds(spark):
    rng = random.Random(3)
    good = [
        lambda: f"SSN {rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", lambda: "IBAN DE89 3704 0044 0532 0130 00", lambda: f"phone 555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        lambda: f"dear Dr. {rng.choice(['Anna', 'Peter', 'Maria'])} {rng.choice(['Meyer', 'Stone'])}",
    ]
    bad = [lambda: "000-12-3456", lambda: "order 666-11-2222", lambda: "serial DE89 3704 0044 0532 0130 01", lambda: "word", lambda: "part 12-34", lambda: "doctor Anna"]
    texts = ["; ".join(rng.choice(good if rng.random() < 0.4 else bad)() for _ in range(rng.randint(1, 9))) + "." for _ in range(400)]
    want = {i: plain(t) for i, t in enumerate(texts)}
    got = {}
    for r in pii.find_pii(of(spark, texts)).collect():
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        got[r["doc_id"]] = sorted((k, int(a), int(b)) for k, a, b in spans if k not in pii.BASE_KINDS)
    total = sum(map(len, want.values()))
    true = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert total > 300 and true >= 0.95 * total
    assert sum(map(len, got.values())) - true <= 0.05 * total
