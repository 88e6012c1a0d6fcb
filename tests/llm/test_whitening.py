"""Whitening against the covariance formed in numpy."""

import math

import numpy as np
import pytest

from spanloom.llm import whitening
from spanloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, row string, x int, n long, w string"


def brute(vectors):
    """x, n, exact deviations, falling eigenvalues, covariance."""
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    c = (n * x - sums) / n
    cov = c.T @ c / n
    return c, deviations, np.linalg.eigvalsh(cov)[::-1], cov


def check(rows, vectors, by_id, wanted=8):
    c, deviations, values, cov = brute(vectors)
    n, size = len(vectors), min(wanted, len(vectors[0]))
    assert len(rows) == n * size
    w = {(r.vec_id, r.component): r for r in rows}
    place = {v: i for i, v in enumerate(by_id)}
    whitened = np.zeros((n, size))
    for (v, k), r in w.items():
        assert r.n == n and r.deviation == deviations[place[v]] and r.deviation_text == str(r.deviation)
        assert math.isclose(r.explained, values[k - 1] / np.trace(cov), rel_tol=1e-9) and r.identity_error < 1e-9
        whitened[place[v], k - 1] = r.whitened
    assert np.abs(whitened.T @ whitened / n - np.eye(size)).max() < 1e-9
    # components are eigenvectors: the covariance of row and score is e * q
    for k in range(size):
        q = c.T @ whitened[:, k] / n / math.sqrt(values[k])
        assert abs(np.linalg.norm(q) - 1) < 1e-9
        assert np.linalg.norm(cov @ q - values[k] * q) < 1e-9 * values[0]


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = QUERIES["op13_embedding_whitening"](spark, sf).collect()
    check(rows, [r.embedding for r in table], [r.vec_id for r in table])


def test_iteration_needs_no_whole_covariance():
    """A block smaller than the matrix: close eigenvalues, a large first one, repeated ones, none at all."""
    draw = np.random.default_rng(5)
    turn, _ = np.linalg.qr(draw.standard_normal((60, 60)))
    for values in (
        np.linspace(2, 1, 60),
        np.r_[1e9, np.linspace(2, 1, 59)],
        np.r_[1e6, 1e3, 5.0, 5.0, 5.0, np.linspace(4, 1, 55)],
        np.r_[np.ones(20) * 3, np.ones(40)],
        np.r_[5.0, 4.0, np.zeros(58)],
        np.ones(60),
        np.zeros(60),
    ):
        v = (turn * values) @ turn.T
        found = whitening.leading_pairs(lambda q, v=v: v @ q, 60, 8, guards=8)
        assert np.allclose(found.values, values[:8], rtol=1e-9, atol=1e-9 * max(values[0], 1e-300))
        assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-12
        assert np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() <= 1e-10 * max(values[0], 1e-300)


def test_odd_rows(spark):
    draw = np.random.default_rng(3).standard_normal((40, 5)).astype(np.float32).tolist()
    good = [(i if i != 7 else None, v) for i, v in enumerate(draw)]
    good += [(100, draw[3]), (100, draw[3])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame([(i, v, "r", 1, 2, "w") for i, v in good + bad], SCHEMA).repartition(3)
    got = whitening.whiten(rows, keep=["vec_id"]).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text").collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and len(got) == 42 * 5
    _, deviations, values, _ = brute([v for _, v in good])
    want = sorted((-1 if i is None else i, d) for (i, _), d in zip(good, deviations, strict=True))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in got if r.component == 1) == want
    assert all(math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9) for r in got)
    whole = whitening.whiten(rows)
    assert whole.select("row.*").columns == rows.columns and whole.count() == 42 * 5

    short = rows.limit(0).unionByName(spark.createDataFrame([(1, [], "", 0, 0, ""), (2, [1.0], "", 0, 0, ""), (3, [1.0, -2.0], "", 0, 0, "")], SCHEMA))
    _, deviations, _, _ = brute([[0, 0], [1, 0], [1, -2]])
    got = whitening.whiten(short, keep=["vec_id"]).collect()
    assert sorted((r.row.vec_id, r.deviation) for r in got if r.component == 1) == list(zip([1, 2, 3], deviations, strict=True))

    same = rows.where("vec_id = 3").unionByName(rows.where("vec_id = 3"))
    got = whitening.whiten(same).collect()
    assert len(got) == 10 and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in got)
    for none in (rows.where("false"), rows.where("vec_id >= 200")):
        assert whitening.whiten(none).collect() == []


def test_deviation_beyond_a_long():
    x = np.array([[100_000, 100_001], [0, 2**31]])
    n, sums = 10**9, [10**14 + 3, 10**14 + 5]
    whole, rest = whitening.Moments(n, sums).centre()
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    assert whitening._deviations(x, n, whole, rest) == want and want[1] > 2**63


def test_lengths_that_differ_between_partitions(spark):
    rows = [(i, [float(i)] * (1 + i % 4)) for i in range(23)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    found = whitening.moments(whitening.whole_numbers(table))
    padded = np.array([v + [0.0] * (4 - len(v)) for _, v in rows])
    assert found.n == 23 and found.sums == (np.floor(1024 * padded).astype(int) + 100_000).sum(axis=0).tolist()


@pytest.mark.parametrize("parts", [1, 5])
def test_partitioning_changes_nothing(spark, sf, parts):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(parts)
    model = whitening.fit(whitening.whole_numbers(table), 8)
    _, _, values, _ = brute([r.embedding for r in table.collect()])
    assert np.allclose(model.basis.values, values[:8], rtol=1e-12) and model.basis.block < model.about.dims
