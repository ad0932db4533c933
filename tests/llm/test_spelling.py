import collections
import re
import zlib

import numpy as np
import pytest

from cohortlens.llm import spelling
from tests.llm.helpers import SF, odd

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {i: i + 32 for i in range(65, 91)}


def plain_words(rows):
    out = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def plain_near(vocabulary):
    """Near words by deleting every code point of every word."""
    by = collections.defaultdict(set)
    for w in vocabulary:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].add(w)
    out = {w: set() for w in vocabulary}
    for some in by.values():
        for a in some:
            for b in some:
                if a != b and distance_one(a, b):
                    out[a].add(b)
    return out


def distance_one(a, b):
    """Edit distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] == 1


def plain_variants(vocabulary):
    near, form = plain_near(vocabulary), {}
    for w, n in vocabulary.items():
        best = min(((-vocabulary[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = {}
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], vocabulary.get(form[w]), root)
    return out


def as_rows(df):
    rows = df.collect()
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_plain_programming_on_a_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got, want = as_rows(spelling.op13(spark, SF)), plain_variants(plain_words(rows))
    assert got == want and any(v[2] for v in want.values())


def _toy(seed=1, n=700):
    """Words of few letters, so that near words, shared bigrams and repeated bigrams abound."""
    rng = np.random.default_rng(seed)
    out = {}
    for _ in range(n):
        w = "".join("abé"[j] for j in rng.integers(0, 3, rng.integers(7, 11)))
        out[w] = int(10 ** rng.integers(0, 5)) * int(rng.integers(2, 9))
    return out


@pytest.mark.parametrize("block", [3, 40, 4096])
def test_hot_buckets_lose_no_pair(spark, block):
    vocabulary = _toy()
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n bigint")
    assert as_rows(spelling.variants(df, block)) == plain_variants(vocabulary)


def test_hot_sides_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FEW", 0)
    vocabulary = _toy(2, 300)
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n bigint")
    assert as_rows(spelling.variants(df, 20)) == plain_variants(vocabulary)


def test_pivots_are_two_disjoint_rare_bigrams():
    rng = np.random.default_rng(3)
    for length in (7, 8, 20):
        count = rng.integers(1, 50, (200, length - 1))
        rank = count * 1000 + rng.integers(0, 5, count.shape)
        mask, last, pivots = spelling.prefix_and_pivots(rank, count)
        for i in range(200):
            assert last[i] == sorted(rank[i])[2] and (mask[i] == (rank[i] <= last[i])).all()
            a, b = pivots[i]
            pairs = [(x, y) for x in np.flatnonzero(mask[i]) for y in np.flatnonzero(mask[i]) if y >= x + 2]
            assert (a, b) in pairs
            assert count[i, a] + count[i, b] == min(count[i, x] + count[i, y] for x, y in pairs)


def test_near_and_halves():
    rng = np.random.default_rng(4)
    ws = ["".join("ab"[j] for j in rng.integers(0, 2, n)) for n in rng.integers(7, 10, 150)]
    for r in ws:
        for s in ws[:40]:
            assert spelling.near(r, s) == distance_one(r, s)
            if spelling.near(r, s):
                (h, t), (h2, t2) = spelling._halves(r, len(s)), spelling._halves(s, len(r))
                assert h == h2 or t == t2


def test_letters_of_utf8_words():
    import pyarrow as pa

    ws = ["abcdefg", "éÀÿ×÷zz", "", "naïveté", "ÃÂÃÂ"]
    flat, at = spelling._letters(pa.array(["xx", *ws])[1:])
    assert [bytes(flat[a:b]).decode("latin-1") for a, b in zip(at, at[1:], strict=False)] == ws


@pytest.mark.parametrize("chunk,pairs,wide", [(5, 3, 64), (50, 1, 9), (10**6, 10**6, 64), (300, 40, 8)])
def test_chunks_slices_and_long_words_give_the_same_pairs(spark, monkeypatch, chunk, pairs, wide):
    import pyarrow as pa

    rng = np.random.default_rng(chunk)
    words = sorted({"".join("aé"[j] for j in rng.integers(0, 2, rng.integers(7, 11))) for _ in range(250)})
    n, last = rng.integers(2, 99, len(words)), rng.integers(0, 3, len(words))
    rows = []
    for key in range(40):
        other = int(rng.integers(7, 11))
        for i in rng.integers(0, len(words), 40):
            if len(words[i]) == other:
                rows.append((key, 0, 0, False, other, words[i], int(n[i]), int(last[i])))
            elif abs(len(words[i]) - other) == 1 or rng.integers(0, 2):
                rows.append((key, 0, 0, True, other, words[i], int(n[i]), int(last[i])))
    rows = [r for r in rows if abs(len(r[5]) - r[4]) <= 1]
    want = set()
    for p in rows:
        for s in rows:
            if p[0] == s[0] and p[3] and not s[3] and (p[7], p[5]) < (s[7], s[5]) and distance_one(p[5], s[5]):
                want |= {(p[5], s[5], s[6]), (s[5], p[5], p[6])}
    names = ["key", "bi", "bj", "probe", "other", "word", "n", "last"]
    table = pa.table({c: list(v) for c, v in zip(names, zip(*rows, strict=True), strict=True)})
    for name, value in (("CHUNK", chunk), ("PAIRS", pairs), ("WIDE", wide)):
        monkeypatch.setattr(spelling, name, value)
    got = [tuple(r.values()) for b in spelling._links(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert set(got) == want and len(want) > 10


def test_chains_of_forms_reach_their_root(spark):
    chain = ["rootword"]
    for i in range(17):
        w = list(chain[-1])
        w[i % 8] = "abcdefghij"[(i * 3) % 10] if w[i % 8] != "abcdefghij"[(i * 3) % 10] else "z"
        chain.append("".join(w))
    vocabulary = {w: 10 ** (18 - i) for i, w in enumerate(chain)}
    forms = spark.createDataFrame(list(zip(chain[1:], chain, strict=False)), "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"rootword"}
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n bigint")
    assert as_rows(spelling.variants(df)) == plain_variants(vocabulary)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    long = "x" * 3000
    rows = [(1, f"Letters letters LETTERS lettars élégance Élégance {long} {long}y, {long}", "en", "s", 1),
            (1, f"Letters letters LETTERS lettars élégance Élégance {long} {long}y, {long}", "en", "s", 1),
            (2, None, None, None, None), (3, "", "en", "s", 0), (None, "letters naïveté×naïveté 東京letters", None, None, None),
            (4, "naïveté×naïveté lett3rs short words only", "fr", "s", 9)]
    odd(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    want = plain_variants(plain_words([r[:2] for r in rows]))
    assert as_rows(spelling.op13(spark, f"{tmp_path}/a")) == want and len(want) >= 4
    odd(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert spelling.op13(spark, f"{tmp_path}/b").count() == 0
