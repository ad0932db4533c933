import collections
import hashlib
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortlens.llm import fingerprints as fp
from tests.llm.helpers import SF, odd


def _of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r["k"]: r["fingerprint"] for r in fp.fingerprints(rows, ["k"]).collect()}


def test_paragraph_order_does_not_matter_and_content_does(spark):
    got = _of(spark, ["a b c\nd e f\ng", "g\na b c\nd e f", "a b c\nd e f", "a b c\nd e f\ng\ng", None, ""])
    assert got[0] == got[1]
    assert len({got[0], got[2], got[3], got[4]}) == 4
    assert got[4] == got[5]
    assert all(len(x) == fp.HEX for x in got.values())


def test_insert_and_delete_paragraphs(spark):
    got = _of(spark, ["first line. here\nsecond one", "third, line", "first line. here\nsecond one\nthird, line"])
    row = spark.createDataFrame([(got[0], got[1], got[2])], "a string, b string, c string").select(
        fp.add(F.col("a"), F.col("b")).alias("sum"), fp.subtract(F.col("c"), F.col("b")).alias("less")).first()
    assert row["sum"] == got[2] and row["less"] == got[0]


def test_likeness_follows_shared_pieces(spark):
    base = [f"sentence number {i} has words in it." for i in range(200)]
    got = _of(spark, ["\n".join(base), "\n".join(base[:100] + ["something else entirely, %d." % i for i in range(100)]),
                      "\n".join(f"quite other text {i * 31} here." for i in range(200))])
    r = spark.createDataFrame([tuple(got[i] for i in range(3))], "a string, b string, c string").select(
        fp.likeness(F.col("a"), F.col("a")).alias("same"), fp.likeness(F.col("a"), F.col("b")).alias("half"),
        fp.likeness(F.col("a"), F.col("c")).alias("other")).first()
    assert r["same"] == 1.0 and 0.25 < r["half"] < 0.8 and r["other"] < r["half"] - 0.1


def _edited(rows):
    """Brute force: (doc_id, n_chars, sha256 of the edited text) by falling doc_id, ties by text, null ids last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, r in enumerate(order):
        text, follower = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        new = text[:len(text) - k] + follower[:k]
        out.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_against_brute_force_on_odd_rows(spark):
    df = odd(spark)
    got = fp.edited(df).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == _edited(df.collect())
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] != r["edited_fingerprint"]) or r["near_edited"] == 1.0
    long = {r["doc_id"]: r for r in got}[8]
    assert 0.4 < long["near_edited"] <= 1


def test_many_ranges_single_row_and_empty_table(spark):
    rows = [(i * 3, f"text {i} of many. words, {i % 5}", "en", "s", 1) for i in range(300)]
    df = odd(spark, rows).repartition(5)
    got = fp.edited(df)
    assert sorted(((r[0], r[1], r[2]) for r in got.collect()), key=str) == _edited(rows)
    one = fp.edited(odd(spark, rows[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fp.edited(odd(spark, []).limit(0)).count() == 0


def test_plan_has_one_shuffle_and_no_python(spark):
    plan = fp.edited(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def _pieces(text):
    """Pieces by a walk over the text."""
    out, at, i, moved = [], 0, 0, True
    while i < len(text):
        if moved and text[i] == "\n" or moved and text[i] == " " and i and text[i - 1] in "dnrtднртй.,;:!?|":
            out.append(text[at:i])
            at = i + 1
            i, moved = i + 1, True
            continue
        if moved and i > at and (text[i - 1] in "。、，！？；：" or i - at == fp.PIECE):
            out.append(text[at:i])
            at, moved = i, False  # an empty match: the next one starts a character later
            continue
        i, moved = i + 1, True
    return [p for p in [*out, text[at:]] if p]


def _hash(data, seed=42):
    return xxhash.xxh64_intdigest(data, seed=seed)


def _brute(text):
    """(fingerprint, signed lanes) without Spark."""
    strict = [0] * fp.STRICT
    for line in text.split("\n"):
        root = _hash(hashlib.sha256(line.encode()).hexdigest().encode())
        for k in range(fp.STRICT):
            strict[k] = (strict[k] + xxhash.xxh64_intdigest(struct.pack("<i", k), seed=root)) % fp.STRICT_MOD
    lanes = np.zeros(fp.LANES, np.int64)
    for p in _pieces(text):
        a = _hash(p.encode())
        b = _hash(b"again", seed=a)
        bits = [x >> (i + 32 * high) & 1 for x in (a, b) for i in range(32) for high in (0, 1)]
        lanes += 2 * np.array(bits) - 1
    return "".join(f"{x:08x}" for x in strict) + "".join(f"{int(x) % fp.LANE_MOD:04x}" for x in lanes), lanes


def _like(a, b):
    """What the lanes estimate: 1 less the share of the squared differences of the pieces' numbers."""
    a, b = collections.Counter(_pieces(a)), collections.Counter(_pieces(b))
    n = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
    return 1 - sum((a[k] - b[k]) ** 2 for k in a.keys() | b.keys()) / n if n else 1.0


RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по своему " * 4
CHINESE = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜" * 6
PLAIN = "we all go to sea a while we eat ice as he lies on ice " * 5


def test_fingerprints_equal_brute_force_in_any_script(spark):
    texts = [RUSSIAN, CHINESE, PLAIN, "", "a", "x" * 100, "one。two，three", "naïve 東京\n\n tail ", "ab. " * 9, "。" * 20,
             "123456789012345 89", "1234567890123456\nx", "1234567890123. 456"]
    got = _of(spark, texts)
    assert [got[i] for i in range(len(texts))] == [_brute(t)[0] for t in texts]


def test_likeness_of_a_whole_table_and_of_other_scripts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(10**9 + i, t[30 * i:]) for i, t in enumerate((RUSSIAN, CHINESE, PLAIN, RUSSIAN, CHINESE))]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (-r[0], r[1].encode()))
    got = {r["doc_id"]: r for r in fp.edited(docs).collect()}
    off = []
    for i, (doc_id, text) in enumerate(rows):
        follower, k = rows[(i + 1) % len(rows)][1], len(text) // 3
        new = text[:len(text) - k] + follower[:k]
        r = got[doc_id]
        off.append([r["near_edited"] - _like(text, new), r["near_next"] - _like(text, follower)])
        if doc_id >= 10**9:
            assert r["near_edited"] > 0.45
    off = np.array(off)
    low = sum(got[d]["near_edited"] < 0.3 for d, _ in rows)
    print(f"STD below 0.3: {low}, error std {off.std(0)}, max {np.abs(off).max(0)}, above 0.15: {(np.abs(off) > 0.15).mean(0)}")
    # the error of a likeness is about 1 / sqrt(LANES) = 0.09
    assert off.std(0).max() < 0.09 and (np.abs(off) > 0.2).mean() < 0.02 and low <= 30
    for doc_id, text in rows[:60]:
        assert got[doc_id]["fingerprint"] == _brute(text)[0]
