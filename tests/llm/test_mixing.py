import collections

import numpy as np

from cohortlens.llm import mixing
from cohortlens.llm.common import splitmix
from tests.llm.helpers import SF, odd, words  # noqa: F401


def test_targets_share_the_excess():
    got = mixing.targets(np.array([1000, 10, 1000, 0]), np.array([1.0, 5.0, 2.0, 5.0]))
    assert np.allclose(got, [(2010 - 30) / 3, 30, 2 * (2010 - 30) / 3, 0])
    assert mixing.targets(np.array([0, 0]), np.array([1.0, 1.0])).sum() == 0


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 1000, 1025):
        key = splitmix(np.full(n, 7, np.uint64))
        got = mixing.permute(np.arange(n), np.full(n, n), key)
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.full(1000, 1000), splitmix(np.full(1000, 8, np.uint64))).tolist() != list(range(1000))


def test_shard_counts_deal_every_slot():
    got = mixing.shard_counts(np.array([100, 0, 7, 900]), 16)
    assert got.sum(0).tolist() == [100, 0, 7, 900] and got.sum(1).max() - got.sum(1).min() <= 1 and (got >= 0).all()
    assert (got == mixing.shard_counts(np.array([100, 0, 7, 900]), 16)).all()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_mix_of_a_table_comes_near_its_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    one = mixing.Mix(docs).taken()
    rows = one.collect()
    by = collections.defaultdict(lambda: [0, 0, 0, 0.0])
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        b = by[r["source"]]
        b[0] += r["size"]
        b[1] += r["taken"]
        b[2:] = [r["source_size"], r["target"]]
    for size, taken, total, target in by.values():
        assert size == total and abs(taken - target) <= 0.03 * target + 64
    assert abs(sum(b[3] for b in by.values()) - sum(b[0] for b in by.values())) < 1e-6 * sum(b[0] for b in by.values())
    again = mixing.Mix(docs.repartition(7)).taken()
    assert _rows(again) == sorted((tuple(r) for r in rows), key=str)


def test_slots_take_every_block_once_a_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    mix = mixing.Mix(docs, shards=8)
    slots = mix.slots.collect()
    assert len({(s["shard"], s["place"]) for s in slots}) == len(slots)
    assert len({(s["sid"], s["pass"], s["block"]) for s in slots}) == len(slots)
    last = {}
    for s in slots:
        last[s["sid"]] = max(last.get(s["sid"], 0), s["pass"])
    assert max(last.values()) <= 2
    blocks = {r["sid"]: -(-r["source_size"] // mixing.BLOCK) for r in mix.sources.collect()}
    full = collections.Counter((s["sid"], s["pass"]) for s in slots)
    assert all(n == blocks[sid] for (sid, p), n in full.items() if p < last[sid])


def test_odd_rows(spark):
    rows = mixing.Mix(odd(spark)).taken().collect()
    assert len(rows) == 13
    assert {r["doc_id"]: r["size"] for r in rows}[3] == 0 and {r["doc_id"]: r["taken"] for r in rows}[5] == 0
    assert sum(r["size"] == 10 and r["doc_id"] == 1 for r in rows) == 2
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    order = {r["source"]: r["target"] for r in rows}
    assert set(order) == {"s1", "s2", "s3", "é", None} and order[None] == 0


def test_empty_tables(spark):
    assert mixing.Mix(odd(spark, [])).taken().count() == 0
    none = mixing.Mix(odd(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])).taken().collect()
    assert [r["taken"] for r in none] == [0, 0] and {r["target"] for r in none} == {0.0}


def test_small_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        for _ in range(rng.integers(1, 3)):
            n = int(rng.integers(20, 90))
            rows.append((len(rows), " ".join(f"w{j}" for j in range(n)), "en", f"s{i:02}", n))
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.Mix(odd(spark, rows)).taken().collect():
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert len(by) == 60 and all(abs(t - want) <= 0.05 * want + 1 for t, want in by.values())


def test_taken_equals_a_recount_from_slots_and_words_under_any_settings(spark):
    """Streams, blocks and slots rebuilt row by row; shuffle settings change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = docs.collect()
    mix = mixing.Mix(docs)
    got = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = mixing.Mix(docs)
            assert {r["doc_id"]: r["taken"] for r in again.taken().collect()} == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sources = {r["sid"]: r for r in mix.sources.collect()}
    placed = mix.docs.collect()
    stream = {sid: [None] * r["source_size"] for sid, r in sources.items()}
    for r in placed:
        for k in range(r["start"], r["start"] + r["size"]):
            assert stream[r["sid"]][k] is None
            stream[r["sid"]][k] = r["doc_id"]
    assert all(d is not None for s in stream.values() for d in s)
    want = collections.Counter()
    for s in mix.slots.collect():
        size = sources[s["sid"]]["block_words"]
        want.update(stream[s["sid"]][s["block"] * size:(s["block"] + 1) * size])
    assert got == {r["doc_id"]: want[r["doc_id"]] for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    weight = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    share = mixing.targets(np.array([sizes[n] for n in names]), np.array(weight))
    assert {r["source"]: round(r["target"], 6) for r in sources.values()} == {
        n: round(float(t), 6) for n, t in zip(names, share, strict=True)}
