import random

import numpy as np
import pytest

from cohortlens.llm import setsketch as ss
from tests.llm.helpers import odd, words


def brute(rows, k, percent):
    """{position: component} by comparing all pairs of rows; rows that share a doc_id are one."""
    sets = [words(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            union = len(sets[i] | sets[j])
            if inter and 100 * inter >= percent * union or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    group = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            group[find(i)] = min(group.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), group.get(find(i))) for i, r in enumerate(rows)]


def check(spark, rows, k, percent):
    got = ss.near_duplicates(odd(spark, rows), k, percent).collect()
    expect = brute(rows, k, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(expect, key=str)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def variants(seed=1, families=12):
    rnd = random.Random(seed)
    rows, doc = [], 100
    for f in range(families):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([20, 60, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            text = " ".join(w)
            rows.append((doc, text if rnd.random() < 0.5 else text.upper(), "en", "s", len(text)))
            doc += rnd.randrange(1, 4)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent, monkeypatch):
    check(spark, variants() + [(1, "", "en", "s", 0), (2, None, "en", "s", 0), (3, "a b", "en", "s", 3), (4, "A B", "en", "s", 3)],
          k, percent)


def test_odd_rows(spark):
    check(spark, [tuple(r)[:5] for r in odd(spark, extra=False).collect()], 3, 85)


def test_empty_table(spark):
    assert ss.near_duplicates(odd(spark, []), 5, 80).count() == 0


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ss, "BLOCK_DOCS", 4)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(40):
        w = list(base)
        for _ in range(rnd.randrange(1, 6)):
            w[rnd.randrange(80)] = f"x{rnd.randrange(10**6)}"
        rows.append((d, " ".join(w), "en", "s", 1))
    check(spark, rows, 3, 85)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    rx, ry = (ss.registers(v, np.array([0]))[0] for v in (x, y))
    both = ss.registers(np.unique(np.concatenate([x, y])), np.array([0]))[0]
    assert (ss.merge_registers(rx, ry) == both).all()
    est = ss.likelihood_jaccard(np.array([(rx > ry).sum()]), np.array([(rx < ry).sum()]), ss.REGISTERS,
                                np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(est - 0.8) < 0.15


def test_intersections_against_sets():
    rng = np.random.default_rng(2)
    left = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(9)]
    right = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(5)]
    got = ss.intersections(left, right, cells=600)
    assert [[len(set(a) & set(b)) for b in right] for a in left] == got.astype(int).tolist()


def test_a_bucket_of_many_families_is_compared_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(ss, "MIXED_DOCS", 20)
    # one bucket of 200 single families and one of a large family with 30 others
    rows = [(1, i, i) for i in range(200)] + [(2, 1000 + i, 1000 if i < 70 else 1000 + i) for i in range(100)]
    work = ss._mixed_work(spark.createDataFrame(rows, "key bigint, cid bigint, label bigint")).collect()
    held, met = {}, set()
    for r in work:
        held.setdefault((r["key"], r["bi"], r["bj"]), ([], []))[r["ask"]].append((r["cid"], r["label"]))
    assert max(len(own) for own, _ in held.values()) <= 2 * 20 and max(len(ask) for _, ask in held.values()) <= 2 * 20
    for (key, _, _), (own, ask) in held.items():
        met |= {(key, a, b) for a, f in ask for b, g in own if f != g}
    major = {1: 199, 2: 1000}  # the largest family; of equal ones the largest label
    assert met == {(k, a, b) for k, a, f in rows for j, b, g in rows if k == j and f != g and f != major[k]}


def test_families_across_blocks_are_linked(spark, monkeypatch):
    monkeypatch.setattr(ss, "MIXED_DOCS", 3)
    check(spark, variants(seed=7, families=20), 3, 85)
