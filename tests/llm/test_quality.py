import zlib

import numpy as np
import pytest

from cohortlens.llm import quality
from cohortlens.llm.setsketch import ShingleHasher
from tests.llm.helpers import SF, auc, labels_for, odd


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert auc([r["score"] for r, _ in held], [y for _, y in held]) > 0.97
    assert np.mean([r["predicted"] == y for r, y in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got.values())


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20, len(quality.STATS)))
    m = quality.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), None, (np.zeros(1), np.zeros(1)))
    z = m.features(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    exact = np.exp(-d / (2 * quality.SIGMA**2 * x.shape[1]))
    assert np.abs(z @ z.T - exact).max() < 0.25 and np.abs(z @ z.T - exact).mean() < 0.06


def test_partition_sums_equal_one_solve(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((200, len(quality.STATS))), rng.integers(0, 2, 200)
    rows = [(i, x[i].tolist()) for i in range(200)]
    stats = spark.createDataFrame(rows, "doc_id bigint, stats array<double>").repartition(7)
    labels = labels_for(spark, [(i, int(y[i]), 0) for i in range(200)])
    model = quality.train_on(stats, labels)
    part = np.array([zlib.crc32(str(i).encode()) % 4 for i in range(200)])
    fit = part < 2
    z = model.features(x[fit])
    w = np.linalg.solve(z.T @ z + quality.RIDGE * fit.sum() / quality.FEATURES * np.eye(z.shape[1]), z.T @ y[fit])
    assert np.allclose(w, model.weight, atol=1e-6)
    again = quality.train_on(stats.repartition(3), labels)
    assert np.allclose(again.scores(x), model.scores(x), atol=1e-6)


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    v = np.sort(rng.uniform(size=40))
    t = rng.integers(1, 9, 40).astype(float)
    g = np.minimum(t, np.floor(t * v + rng.uniform(size=40)))
    at, p = quality.isotonic(v, g, t)
    assert (np.diff(p) > -1e-9).all() and (np.diff(at) > 0).all()
    # min-max formula of the isotonic fit
    best = [max(min(g[i:j + 1].sum() / t[i:j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(p, 9), atol=2e-3)


def test_statistics_of_odd_texts():
    h = ShingleHasher(3)
    for t in (None, "", " \n\t", "x", "é" * 10, "a b " * 50_000):
        s = quality.statistics(t, h)
        assert s.shape == (len(quality.STATS),) and np.isfinite(s).all()
    assert (quality.statistics(" \n", h) == 0).all()


def test_odd_rows_no_labels_and_filter(spark):
    df = odd(spark)
    none = quality.quality(df, labels_for(spark, [])).collect()
    assert len(none) == 13 and {r["score"] for r in none} == {0.5}
    labels = labels_for(spark, [(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 1), (2, None, 1), (4, 1, 0), (4, 0, 0)])
    got = quality.quality(df, labels).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(round(r["score"], 9))
    assert len(by[1]) == 1 and by[3] == by[4] == by[5]
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.quality(odd(spark, []), labels).count() == 0
