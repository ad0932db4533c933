import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import packing
from tests.llm.helpers import SF, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(texts):
    tok = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


def test_ids_equal_the_tokenizers_library_over_a_whole_table(spark, encoder):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() + [0] for t in texts] == reference_ids(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'sabé1<|endoftext|>東 　")), st.characters(codec="utf-8")), max_size=60))
def test_ids_of_any_text(text):
    global _ENC
    _ENC = globals().get("_ENC") or packing.Encoder(PATH)
    assert np.frombuffer(_ENC.encode(text), "<u4").tolist() + [0] == reference_ids([text])[0]


def test_pieces():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(2049) == [(0, 1), (1, 2048)] and packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def check(rows, texts):
    """Every id of every document once, no overlap, no gap, within capacity."""
    ids = {k: collections.Counter() for k in {d for d, _ in texts}}
    for (d, _), x in zip(texts, reference_ids([t for _, t in texts]), strict=True):
        ids[d][tuple(x)] += 1
    expect = collections.Counter()
    for d, many in ids.items():
        for x, n in many.items():
            for k, (s, m) in enumerate(packing.cut(len(x))):
                expect[d, k, s, m, zlib.crc32(np.array(x[s:s + m], "<u4").tobytes())] += n
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expect
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for got in bins.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= 2048
    return len(bins), sum(r["length"] for r in rows)


def test_pack_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bins, total = check(packing.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_odd_rows(spark, rule):
    df = odd(spark)
    check(packing.pack(df, PATH, rule).collect(), [(r["doc_id"], r["text"]) for r in df.collect()])
    assert packing.pack(odd(spark, []), PATH, rule).count() == 0


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    check(packing.pack(docs, PATH).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 70, 500)
    where, offset = packing.best_fit(n, capacity=(100, 3, 6000), weights=(1, 1, 1), rule=rule)
    for b in np.unique(where):
        x = n[where == b]
        assert x.sum() <= 100 and len(x) <= 3 and (x**2).sum() <= 6000
        o = np.sort(offset[where == b])
        assert o[0] == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), capacity=(100, 3, 60000))


def test_capacities_of_documents_and_attention_reach_the_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    cap = (1000, 3, 250_100)  # pieces of 500 tokens at most
    bins = collections.defaultdict(list)
    for r in packing.pack(docs, PATH, capacity=cap, weights=(1, 1, 1)).collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for got in bins.values():
        n = np.array([x for _, x in sorted(got)])
        assert n.sum() <= 1000 and len(n) <= 3 and (n**2).sum() <= 250_100
        assert [o for o, _ in sorted(got)] == (np.cumsum(n) - n).tolist()
    assert sum(x for got in bins.values() for _, x in got) == sum(
        len(x) for x in reference_ids([r["text"] for r in docs.collect()]))
    assert max(len(got) for got in bins.values()) == 3


def test_part_filled_sequences_of_groups_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    rows = [(i, " ".join(f"w{j}" for j in range(3 + i % 4)), "en", "s", 1) for i in range(6000)]
    bins, total = check(packing.pack(odd(spark, rows), PATH).collect(), [r[:2] for r in rows])
    assert bins <= 1.1 * total / 2048 + 2
