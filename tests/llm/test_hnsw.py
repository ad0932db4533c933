import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hnsw
from tests.llm.helpers import SF

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, kind="<f4", step=100, k=10):
    """(query_id, rank) -> (vec_id, score) over all (vec_id, embedding) rows, one row per query id."""
    ok = {(i, hnsw._vector(v, kind)) for i, v in rows if i is not None and hnsw._vector(v, kind) is not None}
    ids = np.array([i for i, _ in ok])
    vecs = [np.frombuffer(b, kind).astype(float) for _, b in ok]
    out = {}
    for q, x in zip(ids.tolist(), vecs, strict=True):
        if q % step == 0:
            found = sorted((float(np.sqrt(((x - y) ** 2).sum())), int(j)) for j, y in zip(ids, vecs, strict=True)
                           if j != q and len(y) == len(x))
            out |= {(q, r): (j, s) for r, (s, j) in enumerate(found[:k], 1)}
    return out


def as_rows(df):
    rows = df.collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows}
    assert len(got) == len(rows)
    return got


def check(got, want):
    """Scores are exact, ranks are in order; the share of right rows."""
    assert got.keys() == want.keys()
    by = {}
    for (q, r), (i, s) in sorted(got.items()):
        by.setdefault(q, []).append((s, i))
    assert all(x == sorted(x) and len({i for _, i in x}) == len(x) for x in by.values())
    return np.mean([got[k][1] <= want[k][1] + 1e-12 for k in want]), np.mean([got[k][0] == want[k][0] for k in want])


def test_a_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = hnsw.op11(spark, SF)
    assert df.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    by_score, same = check(as_rows(df), brute(rows))
    assert by_score >= 0.99 and same >= 0.99


def _groups(n=1500, dim=12, seed=1):
    """A third in one tight group, a third equal vectors, the rest spread."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[:n // 3] = x[0] + 0.01 * rng.standard_normal((n // 3, dim)).astype(np.float32)
    x[n // 3:2 * n // 3] = x[n // 3]
    order = rng.permutation(n)
    return [(int(i), x[j].tolist()) for i, j in enumerate(order)]


@pytest.mark.parametrize("shard", [200, 8192])
def test_recall_with_a_tight_group_and_equal_vectors(spark, shard):
    rows = _groups()
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_rows(hnsw.nearest(df, step=25, shard=shard))
    by_score, same = check(got, brute(rows, step=25))
    assert by_score >= 0.97 and same >= 0.95
    again = as_rows(hnsw.nearest(df.repartition(7), step=25, shard=shard))
    assert again == got


def test_queries_in_chunks_and_narrow_beams(spark):
    rows = _groups(600, 8, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    named = df.mapInArrow(lambda it: hnsw._named(it, "<f4"), "vec_id bigint, digest binary, dim int, vec binary")
    graphs, shards = hnsw.index(named, "<f4", shard=150)
    assert shards == graphs.count() > 1
    queries = named.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("digest").alias("query"), "dim", "vec")
    one = as_rows(hnsw.search(graphs, shards, queries, "<f4"))
    assert as_rows(hnsw.search(graphs, shards, queries, "<f4", chunk=7)) == one


def test_every_vector_is_a_node_and_lists_are_flat():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 6))
    levels = hnsw.node_levels([bytes([i % 256, i // 256]) for i in range(700)])
    assert levels.max() >= 1 and 0 < (levels > 0).mean() < 0.15
    g = hnsw.build(x, levels)
    assert g.ground.shape == (700, hnsw.CAPACITY) and g.above.shape == (levels.sum(), hnsw.LINKS)
    reached, todo = {g.entry}, [g.entry]
    while todo:
        near = [j for j in g.ground[todo.pop()].tolist() if j >= 0 and j not in reached]
        reached.update(near)
        todo += near
    assert len(reached) == 700
    for i in range(700):
        own = [j for j in g.ground[i].tolist() if j >= 0]
        assert i not in own and len(set(own)) == len(own)
        for level in range(1, levels[i] + 1):
            assert all(levels[j] >= level for j in g._lists_of(i, level).tolist() if j >= 0)


ODD = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (100, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []),
       (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.1]), (200, [1.0, 2.0, 3.0]),
       (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (300, [3.0, 4.0]), (11, [3.0e38, 3.0e38])]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for clash in ("shard", "place", "dim", "rank", "query", "members", "score"):
        df = df.withColumn(clash, F.lit("x"))
    rows = hnsw.nearest(df).collect()
    usable = {(0, "a"), (0, "b"), 100, 9, 10, 300, 11}
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(by[100]) == len(usable) - 1 and len(by[300]) == len(usable) - 1 and 200 not in by
    assert sorted(by[100])[0][1:] == (0, 0.0) and sorted(by[100])[1][1:] == (9, 2**0.5)
    assert len(by[0]) == 2 * 5 and all(v != 0 for _, v, _ in by[0])
    assert sorted(by[300])[0][1:] == (0, 13**0.5)


def test_doubles_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 1e-9]), (1, [1.0, 2e-9]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = as_rows(hnsw.nearest(df))
    assert [got[0, r][0] for r in (1, 2)] == [1, 2] and len(got) == 2 and abs(got[0, 1][1] - 1e-9) < 1e-18
    assert hnsw.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hnsw.nearest(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0
