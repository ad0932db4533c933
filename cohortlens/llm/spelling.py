"""Spelling variant grouping by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other.

1. All bigrams are ranked by the number of words that hold them, rarest first.  A word's
   *prefix* is all its bigram occurrences up to the rank of its third rarest one.  Three
   occurrences always hold two that do not overlap: a dynamic program over the positions picks
   the two disjoint ones with the least total frequency, the word's *pivots*.
2. One edit spoils at most one of two disjoint bigrams.  So of two near words r and s, r's
   prefix ending no later than s's in the ranking, s holds a pivot of r, and it lies in s's
   prefix.  It has moved by nothing or by the difference of the lengths.
3. Prefix occurrences are index rows, pivots are probe rows; they meet in a bucket for each
   (bigram, position, length).  A bucket of over ``BLOCK`` rows is dealt anew by the half of the
   word that an edit has left alone (one half always is), and what is still larger is met in
   blocks, so that a task holds two bounded blocks, whatever the bucket.
4. Inside a bucket words that agree in a half are verified letter by letter.  Only near pairs
   leave; a word has at most about 180 near words per code point, so they grow with the words.
5. A word's form is its most frequent near word, if that is ``RATIO`` times as frequent.  Roots
   follow forms by pointer doubling: n grows tenfold with each step, so 19 steps end every chain.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, mix2, non_empty, splitmix, table

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST = 7  # code points of a word
TWICE = 2  # occurrences of a word
RATIO = 10
SPOILT = 31
BLOCK = 1 << 15
CHUNK = 1 << 16  # rows of whole groups that a task matches at a time
PAIRS = 1 << 18  # candidate pairs verified at a time
WIDE = 64  # letters of the words that are matched in matrices; longer ones are met one by one
FEW = 100_000  # rows of a side that is broadcast
STEPS = 5  # doublings that reach the end of 2^5 > 19 steps
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELD = (1 << 25) - 1


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): see ``op13`` for the words.

    A null doc_id counts as empty text in the checksum.
    """
    long_run = LETTERS + "{" + str(LEAST) + ",}"  # shorter runs give no word, spoilt or not
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all("text", F.lit(long_run), F.lit(0))).alias("run"))
    found = found.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    found = found.select("run", h.alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % SPOILT == 0, cut).otherwise(F.col("run"))
    return (found.select(word.alias("word")).where(F.length("word") >= LEAST)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TWICE))


def bigram_ranks(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank (rarest first) and number of words of every bigram, by the code c1 * 256 + c2.

    The alphabet has 116 letters, so at most 13,456 rows reach the driver.
    """
    starts = F.sequence(F.lit(1), F.length("word") - 1)
    held = vocabulary.select(F.explode(F.array_distinct(F.transform(
        starts, lambda i: F.substring("word", i, F.lit(2))))).alias("gram"))
    rows = sorted((r["k"], r["gram"]) for r in held.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).collect())
    rank, count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for i, (k, gram) in enumerate(rows):
        code = ord(gram[0]) * 256 + ord(gram[1])
        rank[code], count[code] = i, k
    return rank, count


def prefix_and_pivots(rank: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length (words x positions of bigrams): prefix mask, last prefix rank, pivots (words x 2).

    The best second pivot from each position on is a suffix minimum; the first pivot adds its own
    frequency to that of the best one that starts two positions later.  Ties: leftmost.
    """
    last = np.partition(rank, 2, axis=1)[:, 2]
    mask = rank <= last[:, None]
    far = np.int64(1) << 60
    cost = np.where(mask, count, far)
    rest = np.minimum.accumulate(cost[:, ::-1], axis=1)[:, ::-1]
    first = (cost[:, :-2] + rest[:, 2:]).argmin(1)
    later = np.where(np.arange(cost.shape[1]) >= first[:, None] + 2, cost, far)
    return mask, last, np.stack([first, later.argmin(1)], 1)


def _entries(batches: Iterator[pa.RecordBatch], rank: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n) -> index and probe rows: key, probe, other, word, n, last.

    ``other``: length of the bucket's index words.
    """
    for b in non_empty(batches):
        held = b.column("word").to_pylist()
        size = np.array([len(w) for w in held])
        for length in np.unique(size).tolist():
            some = np.flatnonzero(size == length)
            letters = np.array([held[i] for i in some], f"<U{length}").view(np.uint32).reshape(len(some), length)
            gram = (letters[:, :-1].astype(np.int64) << 8) + letters[:, 1:]
            mask, last, pivots = prefix_and_pivots(rank[gram], count[gram])
            row, at = np.nonzero(mask)
            parts = [(row, rank[gram[row, at]], at, np.full(len(row), length), np.zeros(len(row), bool))]
            row = np.arange(len(some))
            for pivot in pivots.T:
                own = rank[gram[row, pivot]]
                for more in (-1, 0, 1):
                    if length + more < LEAST:
                        continue
                    for move in {0, more}:
                        ok = np.flatnonzero(pivot + move >= 0)
                        parts.append((ok, own[ok], pivot[ok] + move, np.full(len(ok), length + more),
                                      np.ones(len(ok), bool)))
            row, own, at, other, probe = (np.concatenate(x) for x in zip(*parts, strict=True))
            key = (own << 50) | ((at & _FIELD) << 25) | (other & _FIELD)
            place = pa.array(some[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(probe), pa.array(other.astype(np.int32)), b.column("word").take(place),
                 b.column("n").take(place), pa.array(last[row].astype(np.int32))],
                names=["key", "probe", "other", "word", "n", "last"])


def _halves(word: str, other: int) -> tuple[str, str]:
    """Head and tail, one of which an edit between ``word`` and a word of length ``other`` leaves alone."""
    m = min(len(word), other)
    return word[:m // 2], word[len(word) - m + m // 2:]


def near(r: str, s: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point turns r into s."""
    if len(r) > len(s):
        r, s = s, r
    if len(s) - len(r) > 1:
        return False
    k, m = 0, len(r)
    while k < m and r[k] == s[k]:
        k += 1
    return r[k:] == s[k + 1:] if m < len(s) else k < m and r[k + 1:] == s[k + 1:]


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points end to end, first one of each word and the end) of words without letters above U+00FF.

    In UTF-8 such a letter is one byte below 0x80, or 0xC3 and the code point less 0x40.
    """
    column = column.cast(pa.string())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
    lead = raw == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    return np.where(raw >= 0x80, raw + np.uint8(0x40), raw)[~lead], at - at[0] - before[at - at[0]]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal (key, bi, bj), about ``rows`` at a time."""
    held, n = [], 0
    for b in non_empty(batches):
        held.append(b)
        n += b.num_rows
        if n >= rows:
            both = pa.Table.from_batches(held)
            keys = [both.column(c).to_numpy() for c in ("key", "bi", "bj")]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield both.slice(0, cut)
            held, n = both.slice(cut).to_batches(), both.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)


class _Words:
    """Rows of a chunk: letters as a padded matrix and hashes of all prefixes, for words of up to ``WIDE`` letters."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, part: pa.Table):
        flat, at = _letters(part.column("word").combine_chunks())
        self.size = np.diff(at)
        width = int(min(self.size.max(), WIDE)) + 1
        place = at[:-1, None] + np.arange(width)
        inside = np.arange(width) < self.size[:, None]
        self.letter = np.where(inside, flat[np.minimum(place, len(flat) - 1)], 0).astype(np.uint8)
        self.prefix = np.zeros((width + 1, len(self.size)), np.uint64)
        self.power = np.ones(width + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                self.prefix[k + 1] = self.prefix[k] * self.BASE + self.letter[:, k]
                self.power[k + 1] = self.power[k] * self.BASE

    def halves(self, rows: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
        """Hashes of the head and the tail (see ``_halves``)."""
        m = np.minimum(self.size[rows], other)
        head, end = m // 2, self.size[rows]
        with np.errstate(over="ignore"):
            tail = self.prefix[end, rows] - self.prefix[end - m + head, rows] * self.power[m - head]
        return [self.prefix[head, rows], tail]

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a come before words b in code-point order."""
        x, y = self.letter[a], self.letter[b]
        first = (x != y).argmax(1)[:, None]
        return np.take_along_axis(x, first, 1)[:, 0] < np.take_along_axis(y, first, 1)[:, 0]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exactly one edit parts the words, for lengths that differ by one at most."""
        out = np.zeros(len(a), bool)
        same = self.size[a] == self.size[b]
        out[same] = (self.letter[a[same]] != self.letter[b[same]]).sum(1) == 1
        i = np.flatnonzero(~same)
        swap = self.size[a[i]] > self.size[b[i]]
        short, long = np.where(swap, b[i], a[i]), np.where(swap, a[i], b[i])
        x, y = self.letter[short], self.letter[long]
        # equal up to some place, and from there on when the longer word skips a letter
        up_to = np.concatenate([np.ones((len(i), 1), bool), np.logical_and.accumulate(x[:, :-1] == y[:, :-1], axis=1)], 1)
        rest = np.logical_and.accumulate((x[:, :-1] == y[:, 1:])[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([rest, np.ones((len(i), 1), bool)], 1)
        out[i] = (up_to & rest).any(1)
        return out


def _meet(w: _Words, group: np.ndarray, probe: np.ndarray, other: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
    """Near pairs (probe rows, index rows) within the groups of a chunk, in slices."""
    def keys(rows, more, partner):
        """Of both halves: group, probe's length less the index row's, side and the half's hash in one number."""
        place = group[rows] * 6 + (more + 1) * 2
        return [mix2(half, splitmix((place + side).astype(np.uint64))) for side, half in enumerate(w.halves(rows, partner))]

    ok = np.minimum(w.size, other) <= WIDE - 1
    asks, held = np.flatnonzero(probe & ok), np.flatnonzero(~probe & ok)
    if not len(asks) or not len(held):
        return
    of_probe = np.concatenate(keys(asks, w.size[asks] - other[asks], other[asks]))
    of_index = np.concatenate([k for more in (-1, 0, 1) for k in keys(held, more, w.size[held] + more)])
    order = np.argsort(of_index, kind="stable")
    sorted_ = of_index[order]
    lo, hi = np.searchsorted(sorted_, of_probe, "left"), np.searchsorted(sorted_, of_probe, "right")
    met = np.flatnonzero(hi > lo)
    count = (hi - lo)[met]
    ends = np.cumsum(count)
    at = 0
    while at < len(met):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some, n = met[at:stop], count[at:stop]
        a = np.repeat(asks[some % len(asks)], n)
        place = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        b = held[order[place] % len(held)]
        at = stop
        earlier = last[a] < last[b]
        tie = np.flatnonzero(last[a] == last[b])
        earlier[tie] = w.less(a[tie], b[tie])
        a, b = a[earlier], b[earlier]
        good = w.near(a, b)
        yield a[good], b[good]


def _meet_long(part: pa.Table, group: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """The same for groups of words beyond ``WIDE`` letters, one by one."""
    kept = part.take(pa.array(rows)).select(["probe", "last", "word"]).to_pylist()
    by: dict[int, tuple[list, list]] = {}
    for i, r in zip(rows.tolist(), kept, strict=True):
        by.setdefault(int(group[i]), ([], []))[r["probe"]].append((r["last"], r["word"], i))
    for index, probes in by.values():
        heads: dict[tuple, list] = {}
        for s in index:
            for length in (len(s[1]) - 1, len(s[1]), len(s[1]) + 1):
                for side, half in enumerate(_halves(s[1], length)):
                    heads.setdefault((len(s[1]), length, side, half), []).append(s)
        sizes = {len(s[1]) for s in index}
        for p in probes:
            for k in sizes & {len(p[1]) - 1, len(p[1]), len(p[1]) + 1}:
                for side, half in enumerate(_halves(p[1], k)):
                    for s in heads.get((k, len(p[1]), side, half), ()):
                        if p[:2] < s[:2] and near(p[1], s[1]):
                            yield p[2], s[2]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, bi, bj) -> word, near, near_n of every near pair, both ways."""
    for part in _chunks(batches, CHUNK):
        part = part.combine_chunks()
        keys = [part.column(c).to_numpy() for c in ("key", "bi", "bj")]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        group = np.concatenate([[0], np.cumsum(new)])
        probe, other, last = (part.column(c).to_numpy() for c in ("probe", "other", "last"))
        # groups without index rows or without probes give nothing
        both = (np.bincount(group, probe) > 0) & (np.bincount(group, ~probe) > 0)
        live = both[group]
        part, group, probe, other, last = part.filter(pa.array(live)), group[live], probe[live], other[live], last[live]
        if not part.num_rows:
            continue
        w = _Words(part)
        pairs = list(_meet(w, group, probe, other, last))
        wide = np.flatnonzero(other > WIDE - 1)
        if len(wide):
            wide = np.flatnonzero(np.isin(group, group[wide]))
            found = list(_meet_long(part, group, wide))
            pairs.append((np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)))
        if not pairs:
            continue
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        left, right = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        word, n = part.column("word").combine_chunks(), part.column("n").combine_chunks()
        yield pa.RecordBatch.from_arrays([word.take(left), word.take(right), n.take(right)], names=["word", "near", "near_n"])


def _hinted(df: DataFrame) -> DataFrame:
    """``df`` (written before) as a broadcast side, if it has at most ``FEW`` rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _dealt(entries: DataFrame, block: int) -> DataFrame:
    """Rows of bounded groups (key, bi, bj): large buckets by halves, then in pairs of blocks."""
    def large(df, key):
        return materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block)
                           .select(F.col(key).alias("hot"), "rows"), "hot_buckets")

    rows = ["probe", "other", "word", "n", "last"]
    hot = _hinted(large(entries, "key"))
    marked = entries.join(hot, F.col("key") == F.col("hot"), "left")
    plain = marked.where("hot is null").select("key", *rows)
    # index rows wait for probes of three lengths
    size = F.length("word")
    asked = F.when(F.col("probe"), F.array(size)).otherwise(F.array(size - 1, size, size + 1))
    halved = marked.where("hot is not null").withColumn("asks", F.explode(asked))
    m = F.least("asks", "other")
    half = F.floor(m / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("text")),
                    F.struct(F.lit(1).alias("side"), F.substring("word", size - m + half + 1, size).alias("text")))
    halved = halved.withColumn("half", F.explode(sides)).select(
        F.xxhash64("key", "asks", "half.side", "half.text").alias("key"), *rows)
    halved = materialize(halved, "halves")
    hotter = _hinted(large(halved, "key"))
    marked = halved.join(hotter, F.col("key") == F.col("hot"), "left")
    blocks = F.coalesce(F.ceil(F.col("rows") / block), F.lit(1).cast("bigint"))
    marked = (marked.withColumn("own", F.pmod(F.xxhash64("word"), blocks))
              .withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))))
    bi, bj = F.when(F.col("probe"), F.col("met")).otherwise(F.col("own")), F.when(F.col("probe"), F.col("own")).otherwise(F.col("met"))
    zero = F.lit(0).cast("bigint")
    return plain.select("key", zero.alias("bi"), zero.alias("bj"), *rows).unionByName(
        marked.select("key", bi.alias("bi"), bj.alias("bj"), *rows))


def near_words(vocabulary: DataFrame, block: int | None = None) -> DataFrame:
    """(word, near, near_n) of every near pair of ``vocabulary`` (word, n; distinct words), both ways.

    Words need at least ``LEAST`` code points, none above U+00FF.
    """
    rank, count = bigram_ranks(vocabulary)
    entries = materialize(vocabulary.select("word", "n").mapInArrow(
        functools.partial(_entries, rank=rank, count=count),
        "key bigint, probe boolean, other int, word string, n bigint, last int"), "gram_rows")
    keys = ["key", "bi", "bj"]
    dealt = _dealt(entries, block or BLOCK).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_links, "word string, near string, near_n bigint").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), following forms to the last."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(STEPS):
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        moved = now.join(ahead, F.col("root") == F.col("at"), "left")
        now = materialize(moved.select("word", F.coalesce("ahead", "root").alias("root"),
                                       F.col("ahead").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            break
        now = now.select("word", "root")
    return now.select("word", "root")


def variants(vocabulary: DataFrame, block: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of ``vocabulary`` (word, n).  No words give no rows."""
    vocabulary = materialize(vocabulary.select("word", "n"), "vocabulary")
    pairs = near_words(vocabulary, block)
    none = F.lit(None)
    rows = vocabulary.select("word", "n", none.cast("string").alias("near"), none.cast("bigint").alias("near_n")).unionByName(
        pairs.select("word", none.cast("bigint").alias("n"), "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    is_form = F.expr(f"-best.less div {RATIO}") >= F.col("n")  # the product could overflow
    found = materialize(found.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"),
                                     F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(found.where("form is not null")).select(F.col("word").alias("at"), "root")
    return found.join(last, F.col("word") == F.col("at"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13(spark, sf_dir: str) -> DataFrame:
    """Words of all ``documents`` texts with their near words, forms and roots.

    Words: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased; a run whose
    crc32 with its doc_id is divisible by 31 loses one code point; at least 7 code points and 2
    occurrences.  Null and empty texts give none; repeated rows count each.
    """
    return variants(words(table(spark, sf_dir, "documents")))
