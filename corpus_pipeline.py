"""A corpus pipeline of five operators, each stage written as Parquet and read again.

1. ``quality``: documents that the quality classifier scores below the threshold go.
2. ``line_dedup``: lines on a large share of a source's documents are taken out.  A document of
   nothing else keeps its text, for the next stage to judge it as a copy.  Then lines of 50 words
   and more that five documents of any source share stay in one of them only.
3. ``jaccard``: of every group of linked documents, the one with the smallest id stays.  Rows
   that share an id are one document, which goes if any of them is a copy of another's.
4. ``decontamination``: documents that a benchmark window hits go.
5. ``sentencepiece``: the others become token ids.

All stages but the last return the columns of ``documents``.  Null texts count as empty ones and
stay as they are; rows without an id are never taken for copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import boilerplate, decontaminate, pieces, quality, shingles
from skein.llm.common import forget, materialise, table
from skein.llm.queries import PIECE_DROPOUT, PIECE_MODEL, PIECE_SEED, QUALITY_LEAST, tokenizer_path

LINE_RATIO, LINE_PAGES = 0.1, 5
#: Words from which a line is a passage, for which the share of a source does not matter.
PASSAGE_WORDS = 50


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.filter_quality(docs, model, QUALITY_LEAST)


def _sized(done: DataFrame, docs: DataFrame) -> DataFrame:
    """``done`` with the columns of ``docs`` and the lengths of its texts."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n_chars)).select(*(F.col(f"`{c}`") for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = boilerplate.drop_boilerplate(docs, F.col("source"), ratio=LINE_RATIO, min_pages=LINE_PAGES, keep_whole=True)
    return _sized(done, docs)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The second stage: boilerplate of a source, then passages shared across sources."""
    lines = materialise(dedup_lines(spark, docs, sf_dir))
    return _sized(boilerplate.drop_passages(lines, LINE_PAGES, PASSAGE_WORDS), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = shingles.jaccard_components(docs)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, tokenizer_path(PIECE_MODEL), PIECE_DROPOUT, PIECE_SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", dedup_passages),
    ("jaccard", dedup_documents),
    ("decontamination", decontaminated),
    ("sentencepiece", tokenised),
]

#: No stage but the second can be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            forget(former)
            former = docs
    return docs
