import random

import pytest

import corpus_pipeline as cp
from cohortlens.llm import catalog
from cohortlens.llm.common import materialize
from tests.llm.helpers import SF, odd
from tests.llm.test_packing import check
from tests.llm.test_setsketch import brute


def test_queries_are_registered():
    import __spark_entry__ as E

    names = set(E.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(E.oracle_sql()) <= names and set(catalog.oracle_sql()) <= set(E.oracle_sql())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]


def test_all_stages_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in cp.STAGES[:3]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0.5 * before < docs.count() <= before
        before = docs.count()
    rows = [tuple(r) for r in docs.collect()]
    assert all(k == c for k, _, c in brute(rows, 5, 80)), "near copies are left"
    mixed = materialize(cp.mix_sources(spark, docs, SF), "mixed")
    whole = {r[0]: r[1] for r in rows}
    for r in mixed.collect():
        source = iter(whole[r["doc_id"]].split())
        assert all(w in source for w in r["text"].split()) and r["n_chars"] == len(r["text"])  # in order
    packed = materialize(cp.pack_sequences(spark, mixed, SF), "packed")
    check(packed.collect(), [(r["doc_id"], r["text"]) for r in mixed.collect()])


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_odd_rows_and_empty_table(spark, stage):
    df = odd(spark)
    got = stage(spark, df, SF)
    if stage is not cp.pack_sequences:
        assert got.columns == df.columns
    got.collect()
    assert stage(spark, odd(spark, []), SF).count() == 0


def test_one_of_each_on_odd_rows(spark):
    got = cp.one_of_each(spark, odd(spark), SF).collect()
    ids = [r["doc_id"] for r in got]
    # 1 stands for its copies, with or without id; 3, 4, 5 are empty; 8 for the near copy 9
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 10]
    assert [r["text"] for r in got if r["doc_id"] is None] == ["no id and nothing like it"]


def test_one_of_each_keeps_one_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:50] + [f"x{rnd.random()}"] + base[51:]), "en", "s", 1) for i in range(1, 8)]
    rows.append((50, " ".join(f"z{i}" for i in range(40)), "en", "s", 1))
    assert sorted(r["doc_id"] for r in cp.one_of_each(spark, odd(spark, rows), SF).collect()) == [1, 50]


def test_runs_of_taken_words_keep_their_white_space():
    raw = b" a  b\n\nc d\te f "
    assert cp._runs_of_words(raw, [(0, 2), (2, 4)]) == [raw]
    assert cp._runs_of_words(raw, [(0, 3), (5, 1)]) == [b"a  b\n\nc", b"f"]
    assert cp._runs_of_words(raw, [(1, 2), (2, 3)]) == [b"b\n\nc d\te"]


def test_mixed_rows_are_runs_of_the_text(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(f"w{i}x{j}" + rnd.choice([" ", "\n", "\t"]) for j in range(700)), "en", f"s{i % 3}", 1)
            for i in range(120)]
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in cp.mix_sources(spark, odd(spark, rows), SF).collect()]
    assert all(t in rows[k][1] and n == len(t) for k, t, n in got)
    # a weight-1 source keeps about a third: of one or two runs of a document, not of a dozen pieces
    part = [t for k, t, _ in got if k % 3 == 2]
    assert sum(len(t.split()) for t in part) / len(part) > 300


def test_one_of_each_keeps_different_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " tail"), (7, c), (5, c + " tail"), (7, c), (9, a), (None, None), (None, None), (None, c)]
    got = cp.one_of_each(spark, odd(spark, [(i, t, "en", "s", 1) for i, t in rows]), SF).collect()
    # 1 is the smallest id of the copies of a and of b, 5 of those of c; empty texts are linked with nothing
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(
        [(1, a), (1, b), (5, c + " tail"), (None, None), (None, None)], key=str)
