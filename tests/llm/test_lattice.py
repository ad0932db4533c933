import itertools

import numpy as np
import pytest

from cohortlens.llm import lattice


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_point_against_neighbours():
    rng = np.random.default_rng(0)
    assert len(np.unique(lattice.ROOTS, axis=0)) == 240
    x = rng.uniform(-3, 3, (500, 8))
    p = lattice.nearest_e8(x)
    doubled = np.rint(p * 2)
    assert np.allclose(doubled, p * 2) and ((doubled % 2).std(1) == 0).all() and (np.rint(p.sum(1)) % 2 == 0).all()
    d = ((x - p) ** 2).sum(1)
    for r in lattice.ROOTS:  # no neighbour is nearer
        assert (((x - p - r) ** 2).sum(1) >= d - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x, z = unit(rng.standard_normal((3000, 64))), rng.standard_normal((3000, 64))
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    h, n = lattice.cells(np.concatenate([x, 0.9 * x + np.sqrt(0.19) * z]))
    a, b = slice(0, 3000), slice(3000, None)
    met = (h[a] == h[b]) | (n[a] == h[b][:, :, None]).any(2) | (n[b] == h[a][:, :, None]).any(2)
    assert met.any(1).mean() > 0.99


def test_cells_do_not_depend_on_the_batch():
    x = unit(np.random.default_rng(1).standard_normal((50, 64)))
    h, n = lattice.cells(x)
    for i in (0, 17, 49):
        hi, ni = lattice.cells(x[i:i + 1])
        assert (hi[0] == h[i]).all() and (ni[0] == n[i]).all()


def brute(rows):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, links[i], low.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("kind,block", [("float", 1024), ("double", 8)])
def test_links_against_brute_force(spark, kind, block, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(9)
    centre = unit(rng.standard_normal((6, 64)))
    close = np.concatenate([unit(c + 0.03 * rng.standard_normal((12, 64))) for c in centre])
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(np.concatenate([close, unit(rng.standard_normal((60, 64)))]))]
    rows += [(500 + i, rows[3][1]) for i in range(4)]  # copies
    rows += [(600, None), (601, []), (602, [0.0] * 64), (603, [None] + [1.0] * 63), (604, [float("nan")] + [1.0] * 63),
             (605, [1.0] * 8), (606, [2.0] * 8), (None, rows[0][1]), (None, [0.5, -0.5] * 32), (607, [1e30] * 64)]
    rows.append(rows[5])  # a repeated row
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows], f"vec_id bigint, embedding array<{kind}>, cell string, size string")
    got = lattice.near_vectors(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_table(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
