"""The pipeline's stages against plain versions of their decisions."""

from collections import defaultdict

from pyspark.sql import functions as F
from test_brute import ODD, documents, of, plain_components, plain_decontaminate, word_shingles

import corpus_pipeline as P
from skein.llm import quality
from skein.llm.common import materialise

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = materialise(P.keep_quality(spark, docs, SF))
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()}
    first = rows_of(good)
    assert first.keys() == {i for i, s in scores.items() if s >= 0.3} and good.schema == docs.schema
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(clean & first.keys()) >= 0.99 * len(clean)

    lines = materialise(P.dedup_lines(spark, good, SF))
    second = rows_of(lines)
    pages, seen = defaultdict(int), defaultdict(int)
    for r in first.values():
        pages[r["source"]] += 1
        for x in {x for x in r["text"].split("\n") if x.strip()}:
            seen[r["source"], x] += 1
    for i, r in first.items():
        kept = [x for x in r["text"].split("\n") if not (x.strip() and seen[r["source"], x] >= 5 and seen[r["source"], x] > 0.1 * pages[r["source"]])]
        want = "\n".join(kept) if any(x.strip() for x in kept) else r["text"]
        assert second[i]["text"] == want and second[i]["n_chars"] == len(want)

    single = materialise(P.dedup_documents(spark, lines, SF))
    third = rows_of(single)
    groups = plain_components({i: word_shingles(r["text"]) for i, r in second.items()})
    assert third.keys() == {i for i, g in groups.items() if i == g}

    pure = materialise(P.decontaminated(spark, single, SF))
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fourth = rows_of(pure)
    some = [i for i in third if i % 10 == 0 or i not in fourth]
    assert all((i in fourth) == (not plain_decontaminate(third[i]["text"], items)[4]) for i in some)

    last = rows_of(P.tokenised(spark, pure, SF))
    assert last.keys() == fourth.keys() and all(r["lossless"] and len(r["ids"]) == r["n_tokens"] for r in last.values())


def test_odd_rows(spark):
    odd = of(spark, ODD).union(of(spark, ODD).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("source", F.lit(None).cast("string"))
    lines = P.dedup_lines(spark, odd, SF)
    assert sorted(map(str, (r["text"] for r in lines.collect()))) == sorted(map(str, ODD * 2))
    left = P.dedup_documents(spark, odd, SF)
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(None) == len(ODD) and sorted(i for i in ids if i is not None) == list(range(len(ODD) - 1))
    assert P.decontaminated(spark, odd, SF).count() == 2 * len(ODD)
    assert P.tokenised(spark, odd.limit(0), SF).count() == 0
    for stage in (P.keep_quality, P.dedup_lines, P.dedup_documents, P.decontaminated):
        assert stage(spark, documents(spark).limit(0), SF).count() == 0
