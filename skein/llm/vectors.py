"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are padded with zeros, rotated by one random orthogonal matrix and kept as sign
bits, with a stored correction factor per vector: the inner product of the vector and its code.
Another vector asks with its rotation, rounded at random to four bit planes, so that the inner
product with a code is a sum of popcounts.  Divided by the factor it estimates the true inner
product without bias; factor and rounding give a confidence bound.  Codes, factors and planes
are made once and only they travel; vectors are fetched for pairs whose upper bound reaches the
threshold, which are recomputed exactly, in double precision.

Vectors meet only within a label, and there in cells around centroids, as many as the square
root of the largest label's rows, fitted on a bounded sample.  Every vector is stored in its
nearest cell and asks its ``probes`` nearest cells, but none so far off that no link can be in
it.  A cell is cut into blocks, and tasks hold a block of each side, so no task grows with a
cell.  Equal vectors are stored once with their multiplicity; 128 bits of hashes tell them.

Defined results: a null id or label, or a vector that is null, empty, zero or holds a null or
non-finite component, links with nothing; vectors of different lengths link with nothing;
vectors with equal components are copies and link with each other; repeated rows of one id are
vectors of their own, with a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from skein.llm.common import bounded_batches, delete, forget, materialise, written
from skein.llm.components import components, local_roots

#: Bytes of the sample that centroids are fitted on, rows of it per centroid, most centroids.
SAMPLE_BYTES, ROWS_PER_CELL, MOST_CELLS = 64_000_000, 16, 16_384
#: Least bits of a code.
CODE_BITS = 128
#: Bit planes of a rotation that asks.
PLANES = 4
#: Standard errors that the confidence bound spans.
ERRORS = 3.0
BLOCK = 2048
#: Rows that meet, and bytes of fetched vectors, per task.
MET_PER_PART, FETCHED_PER_PART = 60_000, 16_000_000

_U = np.uint64


@cache
def rotation(width: int, seed: int = 7) -> np.ndarray:
    """The columns of a random orthogonal matrix that vectors of ``width`` components, padded, meet."""
    bits = max(CODE_BITS, -(-width // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, width)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated rows as words of 64, and their correction factors."""
    turned = unit @ turn.T
    return _packed(turned > 0), np.abs(turned).sum(axis=1) / math.sqrt(len(turn))


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(_U)


def planes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotated rows rounded to bit planes (row, plane, word), and (least value, step, sum of the rounded) of each."""
    turned = unit @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
    chance = np.abs(turned) * 2.0**30 % 1  # its last digits round a value up in proportion to what is left of it
    level = np.minimum(np.floor((turned - low) / step + chance), 2**PLANES - 1).astype(np.uint8)
    packed = np.stack([_packed((level >> j) & 1) for j in range(PLANES)], axis=1)
    return packed, np.concatenate([low, step, level.sum(axis=1, keepdims=True, dtype=np.float64)], axis=1)


def estimate(asks: np.ndarray, scale: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rows that ask with coded ones, and their error bounds."""
    bits = codes.shape[1] * 64
    met = np.zeros((len(asks), len(codes)), np.int32)
    for w in range(codes.shape[1]):
        for j in range(PLANES):
            met += np.bitwise_count(asks[:, j, w, None] & codes[None, :, w]).astype(np.int32) << j
    low, step, total = scale[:, 0, None], scale[:, 1, None], scale[:, 2, None]
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)[None, :]
    guess = (low * (2 * ones - bits) + step * (2 * met - total)) / math.sqrt(bits) / factor[None, :]
    spread = np.maximum(0, 1 - factor**2)[None, :] / max(1, bits - 1) + step**2 / 4
    return guess, ERRORS * np.sqrt(spread) / factor[None, :]


def unit_rows(rows, width: int) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, lest their squares leave the range."""
    x = np.stack([np.asarray(r, np.float64) for r in rows]).reshape(len(rows), width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, seed: int = 11, rounds: int = 6) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def nearest(unit: np.ndarray, centres: np.ndarray, probes: int, least: float) -> np.ndarray:
    """The cells that each row asks, nearest first; -1 where fewer are worth it.

    Two linked vectors are ``a`` apart at most, so the stored one is no farther from its cell's
    centroid than the one that asks is from its own, and ``a``: a cell by ``2 a`` farther off
    than the nearest holds no link.
    """
    most = max(1, 4_000_000 // len(centres))
    if len(unit) > most:
        return np.concatenate([nearest(unit[a : a + most], centres, probes, least) for a in range(0, len(unit), most)])
    inner = np.clip(unit @ centres.T, -1, 1)
    some = min(probes, len(centres))
    near = np.argpartition(-inner, some - 1, axis=1)[:, :some]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(inner, near, 1), axis=1, kind="stable"), 1)
    angle = np.arccos(np.take_along_axis(inner, near, 1))
    near[angle > angle[:, :1] + 2 * math.acos(least) + 1e-9] = -1
    return near.astype(np.int32)


_CODED = "label string, width int, cls long, n long, code binary, factor double, asks binary, scale binary, near array<int>"
_KEYS = ["label", "width", "cell", "block", "part"]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, cells: int | None = None, probes: int = 6) -> DataFrame:
    """One row per vector: its id, links, component and whether it is the component's first.

    ``cells`` is the number of centroids, by default the square root of the rows of the largest label.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    type_ = "array<float>" if single else "array<double>"
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(type_).alias("v"))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    tidy = F.transform("v", lambda x: x + F.lit(0.0).cast("float" if single else "double"))  # -0.0 and 0.0 are equal
    hashes = lambda: {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(97), "v")}
    good = raw.where(usable).withColumn("v", tidy).withColumns(hashes()).withColumn("width", F.size("v"))
    # One row for all copies of a vector; n of them link with each other.
    once = good.groupBy("label", "width", "h", "g").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    class_type = f"cls long, label string, width int, h long, g long, node long, n long, v {type_}"
    class_path = written(once.select(F.monotonically_increasing_id().alias("cls"), *once.columns))
    classes = lambda: spark.read.schema(class_type).parquet(class_path)
    links = materialise(_links(spark, classes, least, cells, probes))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("of")).agg(F.sum("b").alias("found"))
    roots = components(links.where("kind = 1").select("a", "b")).withColumnRenamed("node", "root_of")
    told = classes().drop("v").join(counts, F.col("cls") == F.col("of"), "left").join(roots, F.col("cls") == F.col("root_of"), "left")
    told = materialise(told.select("label", "width", "h", "g", "node", (F.col("n") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("root")))
    first = told.groupBy("root").agg(F.min("node").alias("component_id"))
    named = materialise(told.join(first, "root").select(F.col("label").alias("__label"), F.col("width").alias("__width"), F.col("h").alias("__h"), F.col("g").alias("__g"), "n_links", "component_id"))
    for df in (links, told):
        forget(df)
    delete(spark, [class_path])
    rows = raw.withColumn("ok", usable).withColumn("v", F.when(F.col("ok"), tidy)).withColumns(hashes())
    rows = rows.select("id", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.size("v")).alias("width"), "h", "g")
    joined = rows.join(named, (F.col("label") == F.col("__label")) & (F.col("width") == F.col("__width")) & (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")), "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("component_id", "id").eqNullSafe(F.col("id")).alias("kept"),
    )


def fitted(classes, cells: int | None) -> dict[int, np.ndarray]:
    """Centroids for every length of vectors, from a bounded sample of rows."""
    sizes = classes().groupBy("label", "width").agg(F.count(F.lit(1)).alias("n")).groupBy("width").agg(F.max("n").alias("n")).collect()  # a row per length of vectors
    found = {}
    for r in sizes:
        k = cells or min(MOST_CELLS, max(1, SAMPLE_BYTES // (8 * r["width"] * ROWS_PER_CELL)), math.isqrt(r["n"] - 1) + 1)
        rows = classes().where(F.col("width") == r["width"]).select("cls", "v").orderBy(F.xxhash64("cls"), "cls").limit(max(1, k * ROWS_PER_CELL)).toPandas()
        found[r["width"]] = centroids(unit_rows(rows["v"], r["width"]), k)
    return found


def _links(spark, classes, least: float, cells: int | None, probes: int) -> DataFrame:
    """kind 0: (class, links); kind 1: (class, class) edges that connect what is linked."""
    shared = spark.sparkContext.broadcast(fitted(classes, cells))  # at most SAMPLE_BYTES / ROWS_PER_CELL for each length

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w, part in batch.groupby("width"):
                unit = unit_rows(part["v"], int(w))
                turn = rotation(int(w))
                codes, factor = encode(unit, turn)
                asks, scale = planes(unit, turn)
                near = nearest(unit, shared.value[int(w)], probes, least)
                yield pd.DataFrame({
                    "label": part["label"], "width": part["width"], "cls": part["cls"], "n": part["n"], "code": [c.tobytes() for c in codes], "factor": factor,
                    "asks": [a.tobytes() for a in asks], "scale": [s.tobytes() for s in scale], "near": list(near),
                })

    path = written(classes().select("label", "width", "cls", "n", "v").mapInPandas(code, _CODED))
    coded = lambda: spark.read.schema(_CODED).parquet(path)
    home = F.col("near")[0]
    sizes = materialise(coded().groupBy("label", "width", home.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    # Every block that asks of a cell meets every stored block of it.
    stored = coded().select("label", "width", "cls", "n", "code", "factor", "near", home.alias("cell")).join(sizes, ["label", "width", "cell"])
    stored = stored.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asked = coded().select("label", "width", "cls", "n", "asks", "scale", home.alias("home"), F.explode(F.array_remove("near", -1)).alias("cell")).join(sizes, ["label", "width", "cell"])
    asked = asked.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    parts = max(12, (asked.count() + stored.count()) // MET_PER_PART + 1)
    task = F.pmod(F.xxhash64(*_KEYS), F.lit(parts)).cast("int")

    def meet(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = []
        by_unit = dict(iter(held.groupby(_KEYS)))
        for unit, left in asking.groupby(_KEYS):
            right = by_unit.get(unit)
            if right is None:
                continue
            words = len(right["code"].iloc[0]) // 8
            codes = np.frombuffer(b"".join(right["code"]), _U).reshape(-1, words)
            factor = right["factor"].to_numpy()
            asks = np.frombuffer(b"".join(left["asks"]), _U).reshape(-1, PLANES, words)
            scale = np.frombuffer(b"".join(left["scale"]), np.float64).reshape(-1, 3)
            hopeful = np.zeros((len(left), len(right)), bool)
            for at in range(0, len(left), 256):
                guess, bound = estimate(asks[at : at + 256], scale[at : at + 256], codes, factor)
                hopeful[at : at + 256] = guess + bound >= least
            a, b = left["cls"].to_numpy(), right["cls"].to_numpy()
            hopeful &= a[:, None] != b[None, :]
            i, j = np.flatnonzero(hopeful.any(axis=1)), np.flatnonzero(hopeful.any(axis=0))
            if not len(i):
                continue
            # A pair is found from both sides if each asks the other's cell; else this task counts both.
            back = np.stack(right["near"].to_numpy()[j])
            alone = ~(back[None, :, :] == left["home"].to_numpy()[i][:, None, None]).any(axis=2)
            pair = hopeful[np.ix_(i, j)]
            rows.append((a[i], left["n"].to_numpy()[i], b[j], right["n"].to_numpy()[j], np.packbits(pair).tobytes(), np.packbits(alone & pair).tobytes()))
        return pd.DataFrame(rows, columns=["a", "an", "b", "bn", "pairs", "alone"])

    met_type = "a array<long>, an array<long>, b array<long>, bn array<long>, pairs binary, alone binary"
    met = asked.withColumn("task", task).groupBy("task").cogroup(stored.withColumn("task", task).groupBy("task")).applyInPandas(meet, met_type)
    met_path = written(met.withColumn("unit", F.monotonically_increasing_id()))
    units = lambda: spark.read.schema(met_type + ", unit long").parquet(met_path)
    wanted = units().select("unit", F.explode(F.array_union("a", "b")).alias("cls"))
    fetched_bytes = wanted.join(classes().select("cls", "width"), "cls").agg(F.sum("width")).first()[0] or 0
    pools = max(12, fetched_bytes * 8 // FETCHED_PER_PART + 1)
    pool = F.pmod(F.xxhash64("unit"), F.lit(pools)).cast("int")
    fetched = wanted.join(classes().select("cls", "v"), "cls").withColumn("pool", pool)

    def exact(key: tuple, units: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": pd.Series(dtype="int32"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        by_unit = dict(iter(fetched.groupby("unit")))
        for row in units.itertuples():
            own = by_unit[row.unit]
            unit = unit_rows(own["v"], len(own["v"].iloc[0]))
            at = {c: k for k, c in enumerate(own["cls"])}
            a, b = np.asarray(row.a), np.asarray(row.b)
            shape = (len(a), len(b))
            pair, alone = (np.unpackbits(np.frombuffer(x, np.uint8), count=len(a) * len(b)).reshape(shape).astype(bool) for x in (row.pairs, row.alone))
            i, j = np.nonzero(pair)
            x, y = np.array([at[c] for c in a]), np.array([at[c] for c in b])
            some = max(1, 1_000_000 // unit.shape[1])
            close = np.concatenate([np.einsum("ij,ij->i", unit[x[i[s : s + some]]], unit[y[j[s : s + some]]]) >= least for s in range(0, len(i), some)])
            i, j = i[close], j[close]
            if not len(i):
                continue
            once = alone[i, j]
            total_a = np.bincount(i, np.asarray(row.bn)[j], len(a)).astype(np.int64)
            total_b = np.bincount(j[once], np.asarray(row.an)[i[once]], len(b)).astype(np.int64)
            nodes, index = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
            root = nodes[local_roots(index[: len(i)], index[len(i) :], len(nodes))]
            moved = root != nodes
            out.append(pd.DataFrame({"kind": 0, "a": np.concatenate([a[total_a > 0], b[total_b > 0]]), "b": np.concatenate([total_a[total_a > 0], total_b[total_b > 0]])}))
            out.append(pd.DataFrame({"kind": 1, "a": nodes[moved], "b": root[moved]}))
        return pd.concat(out)

    return units().withColumn("pool", pool).groupBy("pool").cogroup(fetched.groupBy("pool")).applyInPandas(exact, "kind int, a long, b long")
