"""Whitening against NumPy on whole matrices, and deviations against Python's integers."""

import numpy as np
import pytest

from tessera.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, part int, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], schema)


def slow(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    z = x - 1_000_000.0 - [s / n - 1_000_000 if n < 0 else (s - 1_000_000 * n) / n for s in sums]
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return deviation, z @ u / np.sqrt(e), e / np.trace(cov)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(70, 70)) * np.linspace(3, 0.05, 70)
    vectors = [[float(v) for v in r] for r in (rng.normal(size=(900, 70)) @ mix + rng.normal(size=70) * 40).astype(np.float32)]
    vectors[5] = vectors[6] = vectors[7]
    bad = [(2000, None), (2001, []), (2002, [None] + [1.0] * 69), (2003, [float("nan")] * 70), (2004, [float("inf")] * 70)]
    frame(spark, [*enumerate(vectors), *bad]).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_whitening"](spark, str(tmp_path)).toPandas()
    deviation, white, explained = slow(vectors)
    assert len(got) == 900 * 32 and set(got.n) == {900} and set(got.component) == set(range(1, 33)) and got.vec_id.max() == 899
    got = got.sort_values(["vec_id", "component"])
    assert got.deviation.to_numpy().reshape(900, 32)[:, 0].tolist() == deviation
    w = got.whitened.to_numpy().reshape(900, 32)
    sign = np.sign((w * white).sum(0))
    assert np.abs(w - white * sign).max() < 1e-6
    assert np.allclose(got.explained.to_numpy().reshape(900, 32), explained, rtol=1e-9)
    assert len(set(got.identity_error)) == 1 and 0 <= got.identity_error.iloc[0] < 1e-9
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9


def test_tiles_and_row_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [[float(v) for v in r] for r in rng.normal(size=(300, 11)) * 5]
    df = spark.createDataFrame([(v,) for v in vectors], "v array<double>").repartition(3)
    x = whitening.whole_numbers(np.array(vectors))
    want = np.cov(x.T.astype(float), bias=True)
    ((n, sums),) = whitening._sums(df).values()
    assert (n, sums) == (300, x.sum(0).tolist())
    for tile, rows in ((2, 40), (3, 8192), (11, 7)):
        monkeypatch.setattr(whitening, "TILE", tile)
        monkeypatch.setattr(whitening, "ROWS", rows)
        assert np.allclose(whitening.covariance(df, 11, n, sums), want, rtol=1e-12)


def test_flat_directions_lengths_and_empties(spark):
    assert whitening.learn(frame(spark, [])) == {}
    df = frame(spark, [(1, [1.0, 2.0, 2.0]), (2, [3.0, 4.0, 4.0]), (2, [3.0, 4.0, 4.0]), (3, [5.0]), (None, [1.0, 2.0, 2.0]), (9, None)])
    fits = whitening.learn(df)
    out = whitening.whiten(df, fits).collect()
    assert sorted((r.vec_id or 0, r.n, len(r.whitened)) for r in out) == [(0, 4, 3), (1, 4, 3), (2, 4, 3), (2, 4, 3), (3, 1, 1)]
    for r in out:
        assert r.identity_error < 1e-12 and all(np.isfinite(r.whitened)) and all(r.whitened[k] == 0 for k in range(1 if r.n > 1 else 0, len(r.whitened)))
        assert r.deviation == (0 if r.n == 1 else 3 * 256**2)
        assert r.explained == pytest.approx([1.0, 0, 0] if r.n > 1 else [0.0])


def test_large_numbers():
    centre = whitening.Centre(3, [30, 10])
    assert centre.deviations(np.array([[5, 4], [2_000_000_000, 1]])) == [(15 - 30) ** 2 + (12 - 10) ** 2, None]
    assert centre.deviations(np.array([[1_000_000_000, 1]])) == [(3_000_000_000 - 30) ** 2 + 49]
    x = whitening.whole_numbers(np.array([1e300, -1e300, 3e38, 0.99, -0.01]))
    assert x[0] == x[2] > 0 > x[1] and x[3:].tolist() == [1_000_063, 999_999]
