"""The sample tables as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sources.graph import Graph
from skein.sources.storage import paired

#: Lines that one order may have, at most, in a relationship's key.
LINES = 1 << 12
#: Keys of suppliers, at most, in a relationship's key between two of them.
SUPPLIERS = (1 << 20) - 1


def _pair_key(high: Column, low: Column, most: int, step: int, what: str) -> Column:
    """``high * step + low``; raises where ``low`` is not from 0 to ``most``, beyond which two pairs could share a key."""
    return F.when((low >= 0) & (low <= most), high * step + low).otherwise(F.raise_error(F.concat(F.lit(f"a relationship's key has room for {most} {what}, not for "), low.cast("string"))))


def _props(df: DataFrame, prefix: str) -> dict[str, str]:
    return {c.removeprefix(prefix): c for c in df.columns}


def sample_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Labels Region, Nation, Customer, Supplier, Part, Order, Event, User; their foreign keys as relationships."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = Graph(spark)
    tables = {"Region": ("region", "r_"), "Nation": ("nation", "n_"), "Customer": ("customer", "c_"), "Supplier": ("supplier", "s_"), "Part": ("part", "p_"), "Order": ("orders", "o_")}
    frames = {}
    for label, (name, prefix) in tables.items():
        df = frames[label] = _local(read(name))
        key = {"Region": "r_regionkey", "Nation": "n_nationkey", "Customer": "c_custkey", "Supplier": "s_suppkey", "Part": "p_partkey", "Order": "o_orderkey"}[label]
        g.add_nodes(label, df, key, _props(df, prefix))
    events = _local(read("events"))
    g.add_nodes("Event", events, "event_id", {c: c for c in events.columns})
    g.add_nodes("User", events.select("user_id").distinct(), "user_id", {"user_id": "user_id"})
    g.add_edges("IN_REGION", frames["Nation"], F.col("n_nationkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    g.add_edges("IN_NATION/Customer", frames["Customer"], F.col("c_custkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), type="IN_NATION")
    g.add_edges("IN_NATION/Supplier", frames["Supplier"], F.col("s_suppkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), type="IN_NATION")
    g.add_edges("PLACED", frames["Order"], F.col("o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), {"date": "o_orderdate"})
    items = _local(read("lineitem"))
    # No columns of a line are a key: lines are numbered within their order, which needs no
    # global sort, and the numbering is pruned where no query asks for relationship ids.
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*items.columns))
    items = items.withColumn("__line", line)
    key = _pair_key(F.col("l_orderkey"), F.col("__line"), LINES, LINES, "lines of an order")  # lines count from 1
    g.add_edges("CONTAINS", items, key, ("Order", "l_orderkey"), ("Part", "l_partkey"), {c.removeprefix("l_"): c for c in items.columns if c not in ("l_orderkey", "l_partkey", "__line")})
    g.add_edges("SUPPLIED_BY", items, key, ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), {"quantity": "l_quantity"})
    g.add_edges("BY", events, F.col("event_id"), ("Event", "event_id"), ("User", "user_id"))
    after = events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_id"), F.col("value")).where("next_id IS NOT NULL")
    g.add_edges("NEXT", after, F.col("event_id"), ("Event", "event_id"), ("Event", "next_id"), {"value": "value"})
    s = frames["Supplier"].select("s_suppkey", "s_nationkey")
    same = paired(s, s.select(F.col("s_suppkey").alias("other"), "s_nationkey"), "s_nationkey", "s_suppkey").where("s_suppkey < other")
    g.add_edges("SAME_NATION", same, _pair_key(F.col("s_suppkey"), F.col("other"), SUPPLIERS, SUPPLIERS + 1, "suppliers"), ("Supplier", "s_suppkey"), ("Supplier", "other"))
    return g


def _local(df: DataFrame) -> DataFrame:
    """Timestamps as local date-times, which do not depend on the session's zone."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema))
