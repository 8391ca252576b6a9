"""Whitening against a dense eigensolver: spectra, odd rows, and the query."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm.queries import all_queries
from assetloom.llm.whitening import fit_whitening, top_components, whiten

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>"


def dense(rows, k=4, scale=256):
    """Plain version: usable rows as integers, n, sums, values, components, trace."""
    sizes = {}
    for _, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            sizes[len(v)] = sizes.get(len(v), 0) + 1
    dim = max(sizes, key=lambda d: (sizes[d], d))
    ok = [v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v) for _, v in rows]
    used = [
        (i, [math.floor(float(np.float32(c)) * scale) for c in v]) for (i, v), good in zip(rows, ok, strict=True) if good
    ]
    fit = np.array(sorted({tuple(x) for _, x in used}), dtype=float)
    cov = np.cov(fit.T, bias=True).reshape(dim, dim)
    values, vectors = np.linalg.eigh(cov)
    return used, len(fit), fit.sum(axis=0), values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


def compare_with_dense(got, rows, k=4):
    used, n, sums, values, vectors, trace = dense(rows, k)
    white = (np.array([x for _, x in used]) - sums / n) @ vectors / np.sqrt(values)
    order = {}
    for r in got:
        order.setdefault(r["vec_id"], []).append(r)
    assert sorted(order) == sorted({i for i, _ in used})
    signs = {}
    for (i, x), w in zip(used, white, strict=True):
        for r in order[i]:
            c = r["component"] - 1
            assert r["n"] == n
            assert r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
            sign = signs.setdefault(c, 1 if r["whitened"] * w[c] >= 0 else -1)
            assert r["whitened"] * sign == pytest.approx(w[c], abs=1e-7)
            assert r["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    got = all_queries()["op13_embedding_whitening"](spark, SF_DIR).collect()
    assert len(got) == 4 * len(dense(rows)[0])
    compare_with_dense(got, rows)


@pytest.mark.parametrize(
    "values",
    [
        np.r_[5.0, 4, 3, 2, np.linspace(1, 0.1, 60)],
        10.0 ** -np.arange(64.0),
        np.r_[1e6, 1e3, 3, 2.5, np.linspace(2, 1, 60)],
        np.r_[10, 9.9999, 9.999, 9.9, np.linspace(9.89, 9.8, 60)],
        np.r_[7.0, 5, np.zeros(62)],
        np.zeros(64),
        np.r_[4.0, 3, 2],
        np.ones(1),
    ],
    ids=["falling", "steep", "outliers", "near", "two", "none", "small", "single"],
)
def test_spectra(values):
    dim = len(values)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((dim, dim)))[0]
    matrix = (basis * values) @ basis.T
    found, vectors = top_components(lambda b: matrix @ b, dim, 4)
    wanted = min(4, int(np.sum(values > 0)))
    assert len(found) == wanted
    np.testing.assert_allclose(found, values[:wanted], rtol=1e-6)
    for i in range(wanted):
        assert abs(basis[:, i] @ vectors[:, i]) > 1 - 1e-9


def test_equal_values_span_their_space():
    values = np.r_[np.full(30, 7.0), np.ones(70)]
    basis = np.linalg.qr(np.random.default_rng(2).standard_normal((100, 100)))[0]
    matrix = (basis * values) @ basis.T
    found, vectors = top_components(lambda b: matrix @ b, 100, 4)
    np.testing.assert_allclose(found, 7)
    np.testing.assert_allclose(np.linalg.norm(basis[:, :30].T @ vectors, axis=0), 1, atol=1e-9)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, [3, 2, 1.5, 1, 0.5, 0.1])]) for i in range(200)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # one vector holds most rows
    rows += [(5, rows[5][1]), (2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [None, *rows[0][1][1:]])]
    rows += [(2004, [float("nan")] * 6), (2005, [float("inf")] * 6), (2006, [-0.0, 0.0, -1e-9, 1e-9, 0.0, 0.0])]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    vectors = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("mine")).withColumn("whitened", F.lit("old"))
    model = fit_whitening(vectors)
    out = whiten(vectors, model)
    assert out.columns == ["vec_id", "embedding", "x", "deviation", "whitened"]
    assert {r["x"] for r in out.collect()} == {"mine"}
    got = [
        {"vec_id": r["vec_id"], "component": c + 1, "n": model.n, "deviation": r["deviation"], "whitened": w,
         "explained": model.values[c] / model.trace, "identity_error": model.identity_error}
        for r in out.collect() for c, w in enumerate(r["whitened"])
    ]
    compare_with_dense(got, rows)


def test_without_variance_and_empty(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)
    model = fit_whitening(same)
    assert model.n == 1 and len(model.values) == 0
    assert [(r["deviation"], r["whitened"]) for r in whiten(same, model).collect()] == [(0, [])] * 3
    none = same.where("vec_id > 5")
    assert fit_whitening(none) is None
    assert whiten(none, None).count() == 0 and whiten(same, None).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [0.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = {r["vec_id"]: r["deviation"] for r in whiten(vectors, fit_whitening(vectors)).collect()}
    assert out == {1: None, 2: None, 3: (3 * 0 - 0) ** 2 + (3 * 768 - 1024) ** 2}
