"""Embedding whitening (operator 11) against a covariance formed and solved directly."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from latentcf.llm import bidiagonal, whitening
from latentcf.llm.common import table
from tests.conftest import SF0001

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("x", T.StringType()), T.StructField("row", T.StringType())])


def slow(rows):
    """vec_id -> (n, deviation, x - S/n, eigenvalues, vectors, trace) with Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({tuple(x) for _, x in kept})
    n, d = len(listed), len(listed[0])
    sums = [sum(x[j] for x in listed) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for x in listed])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = [(i, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), np.array([(n * x[j] - sums[j]) / n for j in range(d)])) for i, x in kept]
    return n, out, values[::-1], vectors[:, ::-1].T, float(values.sum())


def compare(got, rows, tol=1e-6):
    n, expected, values, vectors, trace = slow(rows)
    k = min(4, len(values))
    assert len(got) == k * len(expected)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9 and abs(r.explained - values[r.component - 1] / trace) < 1e-9
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for c in range(1, k + 1):
        a = np.array([v for i, dev, _ in expected for v in [by[(i, dev)][c][0]]])
        b = np.array([x @ vectors[c - 1] / math.sqrt(values[c - 1]) for _, _, x in expected])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tol, c
    assert {(i, dev) for i, dev, _ in expected} == set(by)


def test_op11_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF0001, "embeddings").collect()]
    compare(whitening.op11_whitening(spark, SF0001).collect(), rows)


def test_nulls_non_finite_repeated_and_clashing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # several levels of folds
    rng = random.Random(2)
    spread = [8, 5, 3, 2, 1, 0.5]
    rows = [(i, [rng.gauss(0, s) for s in spread]) for i in range(200)]
    rows += [(i % 7, rows[3][1]) for i in range(100)]  # one vector, many times, ids repeated
    rows += [(None, rows[5][1]), (900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [float("nan")] * 6), (903, [0, 0, float("-inf"), 0, 0, 0]),
             (904, [-0.0] * 6)]
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", "b") for i, v in rows], SCHEMA)
    df.repartition(9).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats
    compare(whitening.op11_whitening(spark, str(tmp_path)).collect(), rows)
    assert {"x", "row"} <= set(whitening.whiten(df).schema["row"].dataType.names)


def test_vectors_of_another_length_are_dropped(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], "", "") for i in range(20)] + [(99, [1.0], "", ""), (98, [], "", "")], SCHEMA)
    assert sorted(r[0] for r in whitening.whiten(df).select("row.vec_id").collect()) == list(range(20))


def test_no_rows_no_variance_and_few_vectors(spark, tmp_path):
    for name, rows in {"none": [], "null": [(1, None)], "empty": [(1, []), (2, [])]}.items():
        spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert whitening.op11_whitening(spark, f"{tmp_path}/{name}").collect() == []
    same = spark.createDataFrame([(i, [1.5] * 5, "", "") for i in range(3)], SCHEMA)
    same.write.parquet(f"{tmp_path}/same/embeddings.parquet")
    got = whitening.op11_whitening(spark, f"{tmp_path}/same").collect()
    assert len(got) == 12 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in got)
    two = spark.createDataFrame([(1, [0.0] * 5, "", ""), (2, [4.0] * 5, "", "")], SCHEMA)
    two.write.parquet(f"{tmp_path}/two/embeddings.parquet")
    got = {(r.vec_id, r.component): r for r in whitening.op11_whitening(spark, f"{tmp_path}/two").collect()}
    assert abs(abs(got[1, 1].whitened) - 1) < 1e-12 and got[1, 1].whitened == -got[2, 1].whitened
    assert abs(got[1, 1].explained - 1) < 1e-12 and got[1, 2].whitened is None and got[1, 2].explained == 0
    assert got[1, 1].deviation == 5 * 1024**2 and got[1, 1].identity_error < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0**40 * i), float((-1) ** i * 3 * 2.0**38), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = {r.vec_id: r for r in whitening.whiten(df).select("row.vec_id", "deviation", "n").collect()}
    n, expected, *_ = slow(rows)
    assert {i: int(got[i].deviation) for i in got} == {i: dev for i, dev, _ in expected}


def _check(x, k=4):
    d = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    values, vectors = bidiagonal.top_right_vectors(r, k)
    expected = np.concatenate([np.linalg.svd(x, compute_uv=False) ** 2, np.zeros(d)])[:d]
    top = max(expected[0], 1e-300)
    assert np.abs(values - expected).max() <= 1e-12 * top
    some = [i for i in range(len(vectors)) if vectors[i].any()]
    assert len(some) == min(k, int((expected > (1e-12 * math.sqrt(top)) ** 2).sum()))
    for i in some:
        assert np.linalg.norm(r.T @ (r @ vectors[i]) - values[i] * vectors[i]) <= 1e-12 * top
    v = vectors[some]
    assert not some or np.abs(v @ v.T - np.eye(len(some))).max() < 1e-13


@pytest.mark.parametrize("spectrum", [
    [5, 4, 3, 2, 1], [5, 5, 5, 1], [5, 5 + 1e-9, 5 - 1e-10, 3], [5, 5 + 1e-13, 5, 5 - 1e-13, 5, 1], [1, 1e-4, 1e-8], [1], [2, 0, 0], [0, 0]])
def test_solver_on_planted_spectra(spectrum):
    rng = np.random.default_rng(len(spectrum))
    for d in (len(spectrum), len(spectrum) + 30):
        values = np.concatenate([spectrum, 0.1 * min(spectrum) * rng.random(d - len(spectrum))])
        left, right = np.linalg.qr(rng.normal(size=(d + 20, d)))[0], np.linalg.qr(rng.normal(size=(d, d)))[0]
        _check(left * values @ right)
        _check(left * values)


def test_solver_on_glued_wilkinson_and_random():
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 3.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    glued = np.kron(np.eye(3), wilkinson)
    for i in (20, 41):
        glued[i, i + 1] = glued[i + 1, i] = 1e-9
    _check(np.linalg.cholesky(glued).T, 6)
    rng = np.random.default_rng(1)
    for shape in ((3, 20), (500, 64), (2000, 2), (40, 1)):
        _check(rng.normal(size=shape))


def test_small_singular_values_are_accurate():
    diagonal, above = np.array([1.0, 1e-5, 1e-11, 1e-3]), np.array([1e-2, 1e-9, 1e-12])
    got = bidiagonal.squared_singular_values(diagonal, above)
    # B'B by whole fractions: its determinant is the product of the squares, to full relative accuracy
    assert math.isclose(math.prod(got), float(np.prod(diagonal)) ** 2, rel_tol=1e-12)
