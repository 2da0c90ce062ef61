"""A hot site of equal pages is spread over the salts."""

from pyspark.sql import functions as F

from skein.llm import boilerplate


def test_equal_pages_spread_over_salts(spark):
    pages = spark.range(3200).select(F.col("id").alias("page_id"), F.lit("h").alias("host"), F.lit("Menu\nsame text").alias("text"))
    counts = [r["count"] for r in pages.groupBy(boilerplate.row_salt(pages).alias("salt")).count().collect()]
    assert len(counts) == boilerplate.SALTS and max(counts) < 2 * 3200 / boilerplate.SALTS
    empty = pages.withColumn("text", F.lit(None).cast("string"))
    assert empty.groupBy(boilerplate.row_salt(empty).alias("salt")).count().count() == boilerplate.SALTS
    out = boilerplate.drop_boilerplate(pages, F.col("host"), counts=("n_lines", "n_dropped")).groupBy("text", "n_lines", "n_dropped").count().collect()
    assert [tuple(r) for r in out] == [("", 2, 2, 3200)]
