"""Nulls in every column, empty tables, repeated rows, very long texts and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from skein.llm import boilerplate, chat, decontaminate, pieces, pii, quality, secrets, shingles, tokencount, vectors
from skein.llm.queries import PIECE_MODEL, tokenizer_path

LARGE = 2**60 + 1
ROWS = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "x@y.zz token=abcdefghi", None, None, None), (LARGE, None, None, "s", None), (3, "", "en", None, 0), (4, "word 1.2.3.4 " * 3_000, "en", "s", 1), (5, "q" * 300_000, "en", "s", 1)]


@pytest.fixture
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {"id": 1, "key": 2, "n": 3, "part": 4, "t": 5, "d": 6, "x": 7, "token": 8, "spans": 9, "score": 0, "component_id": 1, "keys": 1, "site": 1, "drop": 1, "salt": 1, "a.b": 1}
    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


ID_COUNTS = {1: 2, None: 1, LARGE: 1, 3: 1, 4: 1, 5: 1}


def ids(df, column="doc_id"):
    out = {}
    for r in df.select(column).collect():
        out[r[0]] = out.get(r[0], 0) + 1
    return out


def operators(spark):
    labels = spark.createDataFrame([(1, 1, None), (4, 0, 0), (None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, "a b c"), (2, None)], "item_id long, text string")
    return {
        "secrets": secrets.scan_secrets,
        "tokens": lambda d: tokencount.count_tokens(d, tokenizer_path("byte_bpe_50k.json")),
        "pii": pii.find_pii,
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "quality": lambda d: quality.score_quality(d, quality.train_quality(d, labels)),
        "jaccard": shingles.jaccard_components,
        "lines": lambda d: boilerplate.drop_boilerplate(d, F.col("source"), min_pages=1),
        "pieces": lambda d: pieces.encode_texts(d, tokenizer_path(PIECE_MODEL)),
    }


@pytest.mark.parametrize("name", ["secrets", "tokens", "pii", "decontaminate", "quality", "jaccard", "lines", "pieces"])
def test_operator(spark, docs, name):
    run = operators(spark)[name]
    assert ids(run(docs)) == ID_COUNTS
    assert run(docs.limit(0)).count() == 0


def test_results(spark, docs):
    run = operators(spark)
    assert {r["doc_id"]: r["component_id"] for r in run["jaccard"](docs).collect()} == {i: i for i in ID_COUNTS}
    hits = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in run["decontaminate"](docs).collect()}
    assert hits[1] == (3, 1) and hits[LARGE] == (0, 0)
    assert all(r["lossless"] for r in run["pieces"](docs).collect())
    found = {r["doc_id"]: r for r in run["pii"](docs).collect()}
    assert found[4]["n_ip"] == 3_000 and found[None]["spans"] == "email:0:6"


def test_chat(spark):
    rows = [(None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"c": F.lit(1), "t": F.lit(2), "ts": F.lit(3)}).withColumn("parts", chat.text_parts(F.col("text")))
    out = {r["conv_id"]: r["turns"] for r in chat.format_chat(turns).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in out[1]] == [("assistant", "first"), ("user", "x"), ("user", "x")] and [tuple(t) for t in out[None]] == [("", "")]
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_vectors(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (2, v, None), (3, None, 1), (4, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "node": F.lit(2), "cell": F.lit(3)})
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 1, False)], key=str)


def test_pipeline_keeps_extra_columns(spark, docs):
    for stage in (P.keep_quality, P.dedup_lines, P.dedup_documents, P.decontaminated):
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    assert ids(P.dedup_documents(spark, docs, "/root/testdata/sf0.001")) == ID_COUNTS
