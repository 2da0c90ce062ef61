"""Binary codes against plain inner products, and near-duplicates against all pairs."""

import numpy as np
from test_brute import plain_vectors

from skein.llm import vectors


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    for width in (3, 64, 200):
        x = unit(rng.standard_normal((400, width)))
        x[200:] = unit(x[:200] + 0.3 * unit(rng.standard_normal((200, width))))
        turn = vectors.rotation(width)
        assert np.allclose(turn.T @ turn, np.eye(width)) and len(turn) % 64 == 0
        codes, factor = vectors.encode(x, turn)
        guess, bound = vectors.estimate(*vectors.planes(x, turn), codes, factor)
        error = guess - x @ x.T
        assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).mean() > 0.99
        # The popcounts are the inner product with the rounded rotation.
        asks, scale = vectors.planes(x[:5], turn)
        level = sum((np.unpackbits(asks[:, j].view(np.uint8), axis=1, bitorder="little").astype(float) * 2**j for j in range(vectors.PLANES)))
        signs = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little") * 2.0 - 1
        plain = (scale[:, :1] + scale[:, 1:2] * level) @ signs.T / np.sqrt(len(turn)) / factor
        assert np.allclose(plain, vectors.estimate(asks, scale, codes, factor)[0])
        assert np.abs(scale[:, :1] + scale[:, 1:2] * level - x[:5] @ turn.T).max() <= scale[:, 1].max() * 1.01


def planted(rng, n, groups, size, width=64):
    """Random vectors, and groups of copies with cosines of 0.9 to 1 with each other."""
    rows = [rng.standard_normal(width) for _ in range(n)]
    for _ in range(groups):
        base = rng.standard_normal(width)
        rows += [base + rng.uniform(0.05, 0.33) * np.linalg.norm(base) * unit(rng.standard_normal((1, width)))[0] for _ in range(int(rng.integers(2, size)))]
    return rows


def test_defaults_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = planted(rng, 3000, 150, 8) + planted(rng, 0, 1, 500)
    order = rng.permutation(len(rows))
    rows = [(i, np.float32(rows[k]).tolist(), int(k) % 2 if k < 3000 else 3) for i, k in enumerate(order.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = plain_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    total = sum(n for n, _ in exact.values())
    found = sum(n for n, _, _ in out.values())
    assert total > 2000 and all(out[i][0] <= n for i, (n, _) in exact.items()) and found >= 0.9 * total
    assert sum(out[i][1] == c for i, (_, c) in exact.items()) >= 0.97 * len(exact)
    moved = [i for i, (_, c) in exact.items() if c != i]
    assert sum(out[i][1] == exact[i][1] for i in moved) >= 0.9 * len(moved)
    assert all(kept == (c == i) for i, (_, c, kept) in out.items())


def test_extreme_sizes_link(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e200, 2.001e200], 1), (3, [1e-200, 2e-200], 1), (4, [1e-200, 2.001e-200], 1), (5, [0.0, -0.0], 1), (6, [-1e200, -2e200], 1), (7, [5e-324, 1e-323], 1), (8, [1.7e308, -1.7e308], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert out == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 5: (0, 5), 6: (0, 6), 7: (4, 1), 8: (0, 8)}


def test_blocks_and_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "MET_PER_PART", 50)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(planted(rng, 20, 4, 30, 900))] + [(10_000 + i, v.tolist(), 1) for i, v in enumerate(planted(rng, 5, 1, 30, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, cells=3, probes=3).collect()}
    assert out == plain_vectors([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
