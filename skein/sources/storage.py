"""Places for intermediate tables and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that each group of the left side is dealt into where groups are paired.
DEALS = 8


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where none is set and all runs in one process, as in tests, the warehouse stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> str:
    """Write ``df`` to a fresh shared folder and tell its path."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it again."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def paired(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """``left`` and ``right`` joined on ``key``, which few groups share.

    The pairs are many more than the rows, so sizes of the rows must not merge the tasks: the number of
    tasks is fixed, and each group's left rows are dealt by their value ``by``, to meet a copy of the right ones.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("__deal", F.pmod(F.xxhash64(by), F.lit(DEALS).cast("long"))).repartition(n, key, "__deal")
    copies = right.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long")))).repartition(n, key, "__deal")
    return dealt.join(copies, [key, "__deal"]).drop("__deal")
