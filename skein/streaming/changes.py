"""Change feeds: what a graph's tables gained, lost and changed between two snapshots.

A feed is a folder of Parquet files with rows (txn, seq, op, kind, id, old, new), framed by one
Begin and one Commit row per transaction; ``old`` and ``new`` are JSON images.  Structured
Streaming reads it as an ordinary file source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.graph import Graph
from skein.sources.storage import materialise

SCHEMA = "txn long, seq long, op string, kind string, id long, old string, new string"


def touched(before: Graph, after: Graph, kind: str, types: set[str] | None = None) -> DataFrame | None:
    """Distinct ids that writers between two snapshots named; None where they are not known.

    With ``types``, only relationships that may be of these types count.
    """
    tail = after.touched[len(before.touched) :]
    if len(after.touched) < len(before.touched) or any(k == "all" for k, _, _ in tail):
        return None
    out = after.spark.createDataFrame([], "id long")
    for k, ids, type_ in tail:
        if k == kind and (not types or type_ is None or type_ in types):
            out = out.unionAll(ids)
    return out.distinct()


def _images(tables: dict, kind: str, ids: DataFrame | None) -> DataFrame | None:
    out = None
    for t in tables.values():
        df = t.df if ids is None else t.df.join(ids.withColumnRenamed("id", "__touched"), F.col("id") == F.col("__touched"), "left_semi")
        if kind == "node":
            labels, skip = t.label_column(), ("id", "labels")
            head = [F.sort_array(labels).alias("labels")]
        else:
            head, skip = [F.lit(t.type).alias("type"), F.col("source"), F.col("target")], ("id", "source", "target")
        props = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in skip]
        one = df.select("id", F.to_json(F.struct(*head, *([F.struct(*props).alias("properties")] if props else []))).alias("image"))
        out = one if out is None else out.unionAll(one)
    return out


def changes(before: Graph, after: Graph) -> DataFrame:
    """(op, kind, id, old, new) of every element that differs, among those that writers touched."""
    spark, out = after.spark, None
    for kind in ("node", "edge"):
        # Tables that both snapshots share are the same object and cannot differ.
        old_tables, new_tables = (before.nodes, after.nodes) if kind == "node" else (before.edges, after.edges)
        same = {n for n in old_tables if n in new_tables and old_tables[n] is new_tables[n]}
        ids = touched(before, after, kind)
        ids = None if ids is None else materialise(ids)
        pick = lambda tables: _images({n: t for n, t in tables.items() if n not in same}, kind, ids)  # noqa: E731, B023
        empty = spark.createDataFrame([], "id long, image string")
        a, b = pick(old_tables) or empty, pick(new_tables) or empty
        a, b = a.select(F.col("id").alias("a"), F.col("image").alias("old")), b.select(F.col("id").alias("b"), F.col("image").alias("new"))
        both = a.join(b, F.col("a") == F.col("b"), "full").where(~F.col("old").eqNullSafe(F.col("new")))
        name = kind.capitalize()
        op = F.when(F.col("a").isNull(), f"{name}Insert").when(F.col("b").isNull(), f"{name}Delete").otherwise(f"{name}Update")
        one = both.select(op.alias("op"), F.lit(kind).alias("kind"), F.coalesce("a", "b").alias("id"), "old", "new")
        out = one if out is None else out.unionAll(one)
    return out


class ChangeFeed:
    """Appends one framed transaction per commit of a graph."""

    def __init__(self, graph: Graph, path: str) -> None:
        self.graph, self.path, self.txn = graph, path, 0
        graph.listeners.append(self.record)

    def record(self, before: Graph, after: Graph) -> None:
        self.txn += 1
        frame = lambda op, seq: self.graph.spark.range(1).select(F.lit(op).alias("op"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(seq).cast("long").alias("seq"))
        reset = not after.nodes and not after.edges and (before.nodes or before.edges)
        body = frame("GraphReset", 1) if reset else changes(before, after).withColumn("seq", F.monotonically_increasing_id() + 1)
        rows = frame("Begin", 0).unionByName(body).unionByName(frame("Commit", 2**62))
        rows.select(F.lit(self.txn).cast("long").alias("txn"), "seq", "op", "kind", "id", "old", "new").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.graph.spark.read.schema(SCHEMA).parquet(self.path)

    def stream(self) -> DataFrame:
        return read_stream(self.graph.spark, self.path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)
