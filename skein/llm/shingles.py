"""N-gram Jaccard join: exact links between sets of word shingles, and their components.

Equal sets form a class, and classes are joined.  Two sets of sizes m <= n link when their
overlap is at least ``need(m, n)``, the least integer that makes the Jaccard index reach the
threshold.  The join is size-aware:

* *Light* pairs, both sets of at most ``bound`` shingles: every set enumerates its subsets of
  ``need(m, n)`` shingles for each size it may link with.  Sets that meet in a subset of the
  right sizes link; nothing is left to verify.
* *Heavy* pairs: every set goes into the inverted lists of its first shingles, enough of them
  that linked sets must share one.  Shingles are taken rarest first, by a fixed-size table of
  rough frequencies that all tasks share.  (Any common order keeps the join exact; this one
  keeps common passages out of the lists.)  Lists
  are scanned twice: every class is compared with its list's leader, which connects dense groups
  without all their pairs; then every pair of a list whose ends are still in different
  components is taken, so that no link between components is lost.  A pair counts in a list
  only if the shared shingle can be the first one that it shares, which bounds what may differ.

The boundary between light and heavy is the size at which enumerating subsets costs more than
scanning lists.  Candidate pairs that small sketches of their sets do not rule out are verified on the full
sets, recomputed from the texts of the documents that need it.

A class is known by 128 bits of its set's digest and numbered; shingles have 64-bit hashes.  The
class's document with the smallest id stands for it: only such documents send their sets.

Nothing grows with a hot shingle or a large group: shingles that the frequency table calls hot
are dealt to tasks by class instead of by shingle, subsets are reduced by Spark's aggregation,
and sets are dealt out by their bytes, a class with many partners in slices.

Defined results: a text of one to four words is one shingle, its whole sequence; null texts and
texts without words have no shingles and link with nothing; repeated rows and ids link like
copies; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import BATCH_BYTES, bounded_batches, delete, forget, give_back, materialise, tidied, written
from skein.llm.components import components

WORDS = 5
PERCENT = 75
#: The frequency table has 2 ** bits bytes, by the number of shingles; tasks report shingles that they see this often.
TABLE_BITS, MOST_TABLE_BITS, LOCAL_LEAST = 21, 25, 2
#: A bucket of the table with this count, and several times the mean, is hot.
HOT_LEAST = 20_000
#: Largest set that subsets may be enumerated for.
MAX_BOUND = 16
#: Bits, as a power of 2, of the filter that tells which documents are asked for their sets.
FILTER_BITS, MOST_FILTER_BITS = 20, 26
#: Shingles of all sets, and bytes of sets, per task that lists or sets are dealt to.
SHINGLES_PER_PART, SET_BYTES_PER_PART = 4_000_000, 12_000_000
#: Shingles or list entries that a task holds before it passes them on.
HELD = 1_000_000
#: Counts of a sketch, as a power of 2.
LEAST_SKETCH, MOST_SKETCH = 5, 12

_U = np.uint64


def need(m: int, n: int, percent: int = PERCENT) -> int:
    """Least overlap with which sets of sizes m and n link."""
    return -(-percent * (m + n) // (100 + percent))


def partner_sizes(n: int, percent: int = PERCENT) -> range:
    """Sizes that a set of size n may link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, _U)
    for i in range(k):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : len(words) - k + 1 + i])
    return np.unique(out)


def class_key(shingles: np.ndarray) -> bytes | None:
    """The digest of a set; none for the empty set."""
    return xxhash.xxh3_128_digest(shingles.tobytes(), len(shingles)) if len(shingles) else None


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of a set's shingles by their upper bits, about two to a byte.

    The sum of the smaller counts of two sets bounds their overlap from above.  Without a bound
    (a count beyond a byte) the sketch is empty.
    """
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, int(len(shingles)).bit_length() - 1))
    counts = np.bincount((shingles >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 255 else b""


def overlap_bound(x: bytes, y: bytes) -> int | None:
    if not x or not y:
        return None
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(k, -1).sum(axis=1), b.reshape(k, -1).sum(axis=1)).sum())


_PROFILE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_PROFILE_SQL = "id long, n long, key binary, sketch binary, buckets array<int>, counts array<long>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, key, sketch) of every document, and rows (buckets, counts) of locally frequent shingles."""
    seen: list[np.ndarray] = []
    held = 0

    def frequent() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        often = counts >= LOCAL_LEAST
        buckets, where = np.unique((values[often] >> _U(64 - MOST_TABLE_BITS)).astype(np.int32), return_inverse=True)
        most = np.zeros(len(buckets), np.int64)
        np.maximum.at(most, where, counts[often])
        return pa.RecordBatch.from_pydict({"id": [None], "n": [None], "key": [None], "sketch": [None], "buckets": [buckets], "counts": [most]}, _PROFILE)

    for batch in batches:
        n, keys, sketches = [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(text.as_py())
            n.append(len(shingles))
            keys.append(class_key(shingles))
            sketches.append(sketch(shingles))
            seen.append(shingles)
            held += len(shingles)
            if held > 2 * HELD:
                yield frequent()
                seen, held = [], 0
        none = pa.nulls(len(n))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), none.cast(_PROFILE.field(4).type), none.cast(_PROFILE.field(5).type)], schema=_PROFILE)
    if seen:
        yield frequent()


def subsets_of(n: int, percent: int = PERCENT, bound: int = MAX_BOUND) -> int:
    """How many subsets a light set of size n enumerates."""
    return sum(math.comb(n, need(m, n, percent)) for m in partner_sizes(n, percent) if m <= bound)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of size n linked sets must share one of."""
    return n - min(need(m, n, percent) for m in (partner_sizes(n, percent)[0], n)) + 1


def choose_bound(sizes: dict[int, int], list_cost: float = 4.0) -> int:
    """The largest size whose subsets cost no more than its inverted lists would.

    ``sizes`` counts classes by size, up to MAX_BOUND; ``list_cost`` is the work per list entry
    (sorting it, scanning and verifying what it meets) relative to that of a subset.
    """
    best, saved, most = 0, 0.0, 0.0
    for x in range(1, MAX_BOUND + 1):
        saved += sizes.get(x, 0) * list_cost * prefix_size(x)
        spent = sum(sizes.get(n, 0) * subsets_of(n, bound=x) for n in range(1, x + 1))
        if saved - spent >= most:
            best, most = x, saved - spent
    return best


def _light_keys(shingles: np.ndarray, bound: int) -> list[tuple[bytes, int]]:
    """Keys of the subsets of a light set, each for two sizes, and which of them is this set's.

    The side is 0 for the smaller, 1 for the larger, 2 where both are equal.
    """
    n, out = len(shingles), []
    values = shingles.tolist()
    for m in partner_sizes(n):
        if m > bound or m == n and need(m, n) == n:
            continue
        small, large = min(m, n), max(m, n)
        for subset in combinations(values, need(m, n)):
            key = xxhash.xxh3_128_digest(np.array(subset, _U).tobytes(), small * 1000 + large)
            out.append((key, 2 if small == large else int(n == large)))
    return out


_ENTRIES = pa.schema([("part", pa.int32()), ("hot", pa.bool_()), *((c, pa.binary()) for c in ("tokens", "places", "keys", "sizes", "counts")), ("subsets", pa.list_(pa.struct([("subset", pa.binary()), ("key", pa.binary()), ("side", pa.int8())])))])
_ENTRIES_SQL = "part int, hot boolean, tokens binary, places binary, keys binary, sizes binary, counts binary, subsets array<struct<subset:binary,key:binary,side:tinyint>>"


def _entries(shared, bits: int, hot_rank: int, bound: int, parts: int):
    """A mapper from texts to inverted-list entries, packed by part, and the subsets of light sets.

    Entries of a hot shingle go to the part of their class, others to that of their shingle.  In
    a row they follow each other by class, with a key, a size and a count for each class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        tokens: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        places: list[np.ndarray] = []
        warm: list[np.ndarray] = []
        keys: list[bytes] = []
        sizes: list[int] = []
        subsets: list[dict] = []
        known: set[bytes] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: dict[str, list] = {c: [] for c in _ENTRIES.names}
            if tokens:
                t, o, p, w = (np.concatenate(x) for x in (tokens, owners, places, warm))
                raw, size_of = np.frombuffer(b"".join(keys), "V16"), np.array(sizes, np.int32)
                by_class = np.frombuffer(raw.tobytes(), np.uint32)[::4].astype(np.int64) % parts
                part = np.where(w, by_class[o] + parts, (t % _U(parts)).astype(np.int64))
                order = np.argsort(part, kind="stable")
                t, o, p, part = t[order], o[order], p[order], part[order]
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    own, count = np.unique(o[a:b], return_counts=True)  # the order is stable, so owners rise
                    k, narrow = int(part[a]), p[a:b].max() < 1 << 16
                    values = (k % parts, k >= parts, t[a:b].tobytes(), p[a:b].astype(np.uint16 if narrow else np.uint32).tobytes(), raw[own].tobytes(), size_of[own].tobytes(), count.astype(np.int32).tobytes(), None)
                    for c, v in zip(_ENTRIES.names, values, strict=True):
                        rows[c].append(v)
                    if sum(map(len, rows["tokens"][-64:])) > 4_000_000:
                        yield pa.RecordBatch.from_pydict(rows, _ENTRIES)
                        rows = {c: [] for c in _ENTRIES.names}
            if rows["part"]:
                yield pa.RecordBatch.from_pydict(rows, _ENTRIES)
            if subsets:
                yield pa.RecordBatch.from_pydict({c: [subsets if c == "subsets" else None] for c in _ENTRIES.names}, _ENTRIES)

        for batch in batches:
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py())
                n = len(shingles)
                key = class_key(shingles)
                if key is None or key in known:  # copies within the task
                    continue
                known.add(key)
                if n <= bound:
                    subsets += [{"subset": k, "key": key, "side": side} for k, side in _light_keys(shingles, bound)]
                    held = max(held, len(subsets) * 20)
                if partner_sizes(n)[-1] > bound:
                    rank = table[(shingles >> _U(64 - bits)).astype(np.int64)]
                    rare_first = np.lexsort((shingles, rank))[: prefix_size(n)]
                    tokens.append(shingles[rare_first])
                    owners.append(np.full(len(rare_first), len(keys), np.int32))
                    places.append(np.arange(len(rare_first), dtype=np.int32))
                    warm.append(rank[rare_first] >= hot_rank)
                    keys.append(key)
                    sizes.append(n)
                    held += len(rare_first)
                if held >= HELD or len(known) >= 200_000:
                    yield from flush()
                    for x in (tokens, owners, places, warm, keys, sizes, subsets):
                        x.clear()
                    known.clear()
                    held = 0
        yield from flush()

    return run


def _scan(part: pd.DataFrame) -> pd.DataFrame:
    """Rows of the lists of one part, copies from different tasks once.

    Of cold shingles all entries are here, and only those that more than one class has go on.
    """
    t, key, size, place, hot = [np.zeros(0, _U)], [np.zeros(0, "V16")], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, bool)]
    for row in part.itertuples():
        count = np.frombuffer(row.counts, np.int32)
        t.append(np.frombuffer(row.tokens, _U))
        key.append(np.repeat(np.frombuffer(row.keys, "V16"), count))
        size.append(np.repeat(np.frombuffer(row.sizes, np.int32), count))
        place.append(np.frombuffer(row.places, np.uint16 if len(row.places) == len(row.tokens) // 4 else np.uint32).astype(np.int32))
        hot.append(np.full(len(t[-1]), row.hot))
    t, key, size, place, hot = map(np.concatenate, (t, key, size, place, hot))
    half = key.view(_U).reshape(-1, 2)
    order = np.lexsort((half[:, 1], half[:, 0], t))
    t, half, hot = t[order], half[order], hot[order]
    same = t[1:] == t[:-1]
    fresh = np.ones(len(t), bool)
    fresh[1:] = ~same | (half[1:] != half[:-1]).any(axis=1)
    t, hot, order = t[fresh], hot[fresh], order[fresh]
    keep = hot.copy()
    same = t[1:] == t[:-1]
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    return pd.DataFrame({"token": t[keep].view(np.int64), "key": [k.tobytes() for k in key[order]], "n": size[order], "place": place[order]})


def _may_link(m: Column, n: Column, pm: Column, pn: Column, bound: int, percent: int = PERCENT) -> Column:
    """Whether two entries of a list can be the first shingle that a linked pair shares.

    The sizes allow a link, the pair is heavy, and enough shingles are left from either place on.
    """
    least = F.ceil((m + n) * percent / F.lit(100 + percent))
    return (F.least(m, n) * 100 >= F.greatest(m, n) * percent) & (F.greatest(m, n) > bound) & (m - pm >= least) & (n - pn >= least)


def hopeful(classes, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, a_n, b_n) of the pairs whose sketches do not rule a link out; no linked pair is lost.

    ``classes`` gives one row (node, n, sketch) per class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c) for c in ("a_n", "b_n", "a_sketch", "b_sketch")), strict=True):
                bound = overlap_bound(x.as_py(), y.as_py())
                keep.append(bound is None or bound >= need(m.as_py(), n.as_py(), percent))
            yield batch.select(["a", "b", "a_n", "b_n"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes().select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(tidied(run), "a long, b long, a_n long, b_n long")


def _id_filter(reps: DataFrame, bits: int) -> np.ndarray:
    """A bit for the hash of every id; at most 2 ** (bits - 6) rows come to the driver."""
    place = F.pmod(F.xxhash64("least"), F.lit(1 << bits))
    words = reps.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy().astype(np.int64)] = words["bits"].to_numpy()
    return out.view(_U)


def verify(texts: DataFrame, classes, pairs: DataFrame, percent: int = PERCENT) -> str:
    """Write the pairs (a, b) of classes that really link, by the full sets of both; gives the path.

    ``texts`` has (id, text), ``classes`` gives (node, key, least).  The documents that stand for
    the classes are found by a bit filter over their ids, or by a semi-join where the filter
    would be full.  Pairs are dealt to parts by the bytes of their sets, and the pairs of one
    class in slices, so that neither many partners nor long texts fill a task.
    """
    spark = texts.sparkSession
    type_ = "a long, b long, a_n long, b_n long"
    path = written(pairs.select("a", "b", "a_n", "b_n"))
    read = lambda: spark.read.schema(type_).parquet(path)
    total = read().agg(F.sum(F.col("a_n") + F.col("b_n")).alias("t")).first()["t"]
    if not total:
        return path
    parts = max(16, total * 8 // SET_BYTES_PER_PART + 1)
    slices = read().groupBy("b").agg(F.ceil(F.sum("a_n") * 8 / SET_BYTES_PER_PART).alias("slices"))
    dealt = read().join(slices, "b").select("a", "b", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("slices"))), F.lit(parts)).cast("int").alias("part"))
    dealt_path = written(dealt)
    dealt = lambda: spark.read.schema("a long, b long, part int").parquet(dealt_path)
    ends = dealt().select(F.explode(F.array("a", "b")).alias("node"), "part").distinct()
    wanted_path = written(ends.join(classes().select("node", "key", "least"), "node"))
    wanted = lambda: spark.read.schema("node long, part int, key binary, least long").parquet(wanted_path)

    n_wanted = wanted().select("node").distinct().count()
    bits = min(MOST_FILTER_BITS, max(FILTER_BITS, int(n_wanted * 16).bit_length()))
    if n_wanted > 1 << (bits - 2):
        texts = texts.join(wanted().select(F.col("least").alias("__id")).distinct(), F.col("id").eqNullSafe(F.col("__id")), "left_semi")
        shared = None
    else:
        shared = spark.sparkContext.broadcast(_id_filter(wanted().select("least"), bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            keys, blobs, held = [], [], 0
            at = batch.column("at").to_numpy()
            asked = np.arange(len(at)) if shared is None else np.flatnonzero(shared.value[at >> 6] >> (at & 63).astype(_U) & _U(1))
            for i in asked.tolist():
                shingles = shingle_set(batch.column("text")[i].as_py())
                key = class_key(shingles)
                if key is not None and key not in sent:
                    sent.add(key)
                    keys.append(key)
                    blobs.append(shingles.tobytes())
                    held += len(blobs[-1])
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["key", "blob"])
                        keys, blobs, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], ["key", "blob"])
            if len(sent) > 200_000:
                sent.clear()

    asked = texts.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("at"), "text").mapInArrow(tidied(sets), "key binary, blob binary")
    sent = asked.join(wanted().select("part", "node", "key"), "key").select("part", "node", "blob")

    def compare(key: tuple, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        of = {k: np.frombuffer(b, _U) for k, b in zip(sets["node"], sets["blob"], strict=True)}
        good = []
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
            x, y = of[a], of[b]
            both = len(x) + len(y) - len(np.union1d(x, y))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        del of, sets
        give_back()
        return pairs.loc[good, ["a", "b"]]

    done = written(dealt().groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(compare, "a long, b long"))
    delete(spark, (path, dealt_path, wanted_path))
    return done


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``; ids are whole numbers."""
    if percent != PERCENT:
        raise ValueError("prefixes and subsets are laid out for one threshold")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profiled = written(texts.mapInArrow(tidied(_profile), _PROFILE_SQL))
    profile = lambda: spark.read.schema(_PROFILE_SQL).parquet(profiled)
    meta = profile().where("n IS NOT NULL").select("id", "n", "key")
    numbered = profile().where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    class_type = "node long, key binary, least long, n long, sketch binary"
    class_path = written(numbered.select(F.monotonically_increasing_id().alias("node"), "key", "least", "n", "sketch"))
    classes = lambda: spark.read.schema(class_type).parquet(class_path)

    total = meta.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_TABLE_BITS, max(TABLE_BITS, int(total // 64).bit_length()))
    counted = profile().where("buckets IS NOT NULL").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    counted = counted.groupBy(F.shiftright("x.buckets", MOST_TABLE_BITS - bits).alias("bucket")).agg(F.sum("x.counts").alias("n"))
    rank = lambda n: F.least(F.lit(127), F.floor(F.log2(n.cast("double")) * 3) + 1).cast("tinyint")
    often = counted.select("bucket", rank(F.col("n")).alias("rank")).toArrow()  # at most 2 ** bits rows of five bytes
    table = np.zeros(1 << bits, np.uint8)
    table[often["bucket"].to_numpy()] = often["rank"].to_numpy()
    del often
    mean = float((2.0 ** (np.maximum(table, 1).astype(np.float64) / 3)).mean())
    hot_rank = math.floor(math.log2(max(HOT_LEAST, 8 * mean)) * 3) + 1

    small = {r["n"]: r["c"] for r in classes().where(F.col("n") <= MAX_BOUND).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most MAX_BOUND rows
    bound = choose_bound(small)
    parts = max(16, total // SHINGLES_PER_PART + 1)

    shared = spark.sparkContext.broadcast(table)
    entered = written(texts.select("text").mapInArrow(tidied(_entries(shared, bits, hot_rank, bound, parts)), _ENTRIES_SQL))
    entries = lambda: spark.read.schema(_ENTRIES_SQL).parquet(entered)
    node_of = classes().select("node", "key")
    scanned = entries().where("part IS NOT NULL").drop("subsets").groupBy("part", "hot").applyInPandas(_scan, "token long, key binary, n int, place int")
    row_type = "token long, node long, n int, place int"
    list_path = written(scanned.join(node_of, "key").select("token", "node", "n", "place"))
    lists = lambda: spark.read.schema(row_type).parquet(list_path)

    # Sets of equal sizes that share a subset link with each other; else smaller ones with larger ones.
    light_path = written(entries().where("subsets IS NOT NULL").select(F.explode("subsets").alias("x")).select("x.*").distinct().join(node_of, "key").select("subset", "side", "node"))
    light = lambda: spark.read.schema("subset binary, side tinyint, node long").parquet(light_path)
    met = light().groupBy("subset").agg(F.min("side").alias("low"), F.max("side").alias("high"), F.min("node").alias("first")).where("low = 2 OR low < high")
    links = written(light().join(met, "subset").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())  # need no verification
    edges = lambda *paths: spark.read.schema("a long, b long").parquet(*paths)
    delete(spark, (entered, light_path))

    # Each list's leader is the class with the fewest rarer shingles.
    lead = lists().groupBy("token").agg(F.min(F.struct("place", "node", "n")).alias("l"))
    led = lists().join(lead, "token").where((F.col("node") != F.col("l.node")) & _may_link(F.col("n"), F.col("l.n"), F.col("place"), F.col("l.place"), bound))
    tried = written(led.select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct())
    first = verify(texts, classes, hopeful(classes, edges(tried)))

    # Then all pairs of a list that are still apart.
    roots = materialise(components(edges(links, first)).withColumnRenamed("node", "of"))
    label = F.coalesce("component", "node").alias("label")
    labelled = "token long, node long, n int, place int, label long"
    marked_path = written(lists().join(roots, F.col("node") == F.col("of"), "left").select("token", "node", "n", "place", label))
    marked = lambda: spark.read.schema(labelled).parquet(marked_path)
    delete(spark, [list_path])
    apart = marked().groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    left = marked().join(apart, "token").select("token", *(F.col(c).alias(f"l_{c}") for c in ("node", "n", "place", "label")))
    right = marked().select("token", *(F.col(c).alias(f"r_{c}") for c in ("node", "n", "place", "label")))
    fits = _may_link(F.col("l_n"), F.col("r_n"), F.col("l_place"), F.col("r_place"), bound)
    crossed = left.join(right, "token").where((F.col("l_label") < F.col("r_label")) & fits).select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()
    known = edges(tried).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    new_path = written(crossed.join(known, ["a", "b"], "left_anti"))
    second = verify(texts, classes, hopeful(classes, edges(new_path)))

    final = materialise(components(edges(links, first, second)).withColumnRenamed("node", "of"))
    # A component is named by its smallest document.
    rooted = materialise(classes().select("node", "key", "least").join(final, F.col("node") == F.col("of"), "left").select("key", "least", F.coalesce("component", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(least, "root").select(F.col("key").alias("__key"), "component_id"))
    forget(rooted)
    forget(final)
    forget(roots)
    delete(spark, (links, tried, first, marked_path, new_path, second, class_path))
    out = meta.join(named, F.col("key") == F.col("__key"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
