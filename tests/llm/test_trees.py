"""Boosted trees against plain versions: every split tried, every row walked down by itself."""

import numpy as np
from pyspark.sql import functions as F
from test_brute import ODD, of

import corpus_pipeline as P
from skein.llm import quality


def data(n=400, width=4, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, width)), 1)
    return x, ((x[:, 1] > 0.3) ^ (x[:, 2] + 0.3 * rng.standard_normal(n) > 0)).astype(float)


def plain_score(model, row):
    total = model.base
    for t in range(len(model.leaf)):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if row[model.feature[t][node]] > model.threshold[t][node] else 1)
        total += model.leaf[t][node - (2**model.depth - 1)]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal():
    x, y = data()
    for depth, trees in ((1, 3), (3, 12), (5, 4)):
        model = quality.fit(x, y, trees=trees, depth=depth)
        assert np.allclose(model.score(x), [plain_score(model, r) for r in x])
        assert ((model.score(x) > 0.5) == y).mean() > 0.55


def plain_gain(x, gradient, weight, rows, f, cut):
    side = lambda m: gradient[m].sum() ** 2 / (weight[m].sum() + 1.0)
    left = rows & (x[:, f] <= cut)
    right = rows & (x[:, f] > cut)
    if min(weight[left].sum(), weight[right].sum()) < 5.0 / 4:
        return 0.0
    return side(left) + side(right) - side(rows)


def test_histograms_find_the_best_split():
    for seed in range(4):
        x, y = data(seed=seed)
        model = quality.fit(x, y, trees=1, depth=2, bins=1000)
        p = y.mean()
        gradient, weight = p - y, np.full(len(y), p * (1 - p))
        cuts = lambda f: np.unique(np.quantile(x[:, f], np.linspace(0, 1, 1001)[1:-1]))
        node = np.zeros(len(y), int)
        for k in range(3):
            rows = node == k
            best = max(plain_gain(x, gradient, weight, rows, f, c) for f in range(4) for c in cuts(f))
            f, c = model.feature[0, k], model.threshold[0, k]
            assert np.isclose(plain_gain(x, gradient, weight, rows, f, c), best)
            node = np.where(rows, 2 * node + 1 + (x[:, f] > c), node)
        for leaf in range(4):
            rows = node == 3 + leaf
            assert np.isclose(model.leaf[0, leaf], -0.12 * gradient[rows].sum() / (weight[rows].sum() + 1.0))


def test_ids(spark):
    ids = spark.createDataFrame([(None,), (1,), (2,), (3,)], "i long").select("i", quality.held_out(F.col("i")).alias("h")).collect()
    import zlib

    assert {r["i"]: r["h"] for r in ids} == {None: False} | {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3)}
    docs = of(spark, ["good words here"] * 3).withColumn("doc_id", F.lit(1).cast("long")).union(of(spark, ["other"]).withColumn("doc_id", F.lit(1).cast("long")))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert 0 < quality.score_quality(docs, quality.train_quality(docs, labels)).first()["score"] < 1


def test_last_stage_with_clashing_columns(spark):
    docs = of(spark, ODD).withColumns({c: F.lit(1) for c in ("id", "key", "n_tokens", "ids", "lossless", "t")})
    out = P.tokenised(spark, docs, "/root/testdata/sf0.001").collect()
    assert len(out) == len(ODD) and all(r["lossless"] for r in out)
