"""Mixing sources to target weights by permuted fixed-length blocks.

1. The words of a source's documents form one stream (documents in hashed order), cut into
   blocks of ``BLOCK`` words, of fewer in a source that would have or be given under
   ``LEAST`` of them; a source's last block may be shorter.  Positions come from
   sums per (source, chunk of documents), so a source with a third of all rows is spread
   over up to ``CHUNKS`` tasks.
2. Targets share all words by weight, at most ``MOST`` times a source's size; the excess is
   shared again until no source is above.  A target becomes a number of block slots.
3. Each of ``shards`` output shards draws multinomial source counts from the slots that are
   still to be dealt, so the shards together hold exactly every source's slots.
4. The k-th slot of a source is the (k mod blocks)-th entry of a keyed pseudorandom
   permutation of its block indexes, one permutation per pass (k div blocks): a pass takes
   every block once before any block comes again.
5. Slots and the documents' block segments are joined by (source, block index).

Only one row per source and the shards x sources counts are ever on the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, mix2, non_empty, partitions, splitmix, table

BLOCK = 64
LEAST = 32  # blocks that make up the smaller of a source's size and target, as far as it has words
SHARDS = 64
CHUNKS = 1 << 12  # parts of a source whose sizes are summed; part of a mix's identity, whatever the session's settings
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 20240229
MANY = 100_000  # rows of a side that is broadcast


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in non_empty(batches):
        n = [len(t.as_py().encode("utf-8", "surrogatepass").split()) if t.is_valid else 0 for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("copy"), pa.array(n, pa.int64())],
                                         names=["doc_id", "source", "copy", "size"])


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Shares of ``sizes.sum()`` by weight, none above ``most`` times its size."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), sizes.sum()
    while free.any() and left > 0:
        share = np.where(free, left * weights / weights[free].sum(), 0)
        over = free & (share > most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def block_words(sizes: np.ndarray, target: np.ndarray, block: int) -> np.ndarray:
    """Words of a block in each source: rounding to whole blocks stays a small share of its target."""
    fine = np.ceil(np.minimum(sizes, target) / LEAST).astype(np.int64)
    return np.clip(fine, 1, block)


def shard_counts(slots: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards x sources) counts: multinomial draws from what is left, all slots dealt in the end."""
    rng = np.random.default_rng(seed)
    left = np.asarray(slots, np.int64).copy()
    out = np.zeros((shards, len(left)), np.int64)
    for h in range(shards):
        want = -(-int(left.sum()) // (shards - h))
        while want > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[h] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed permutation of range(size), element by element: a Feistel network, cycle-walked."""
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.arange(len(index))
    limit = size.astype(np.uint64)
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo]
        left, right = x[todo] >> b, x[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix2(right + np.uint64(r << 56), k) & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= limit[todo]]
    return x.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, counts: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """Slot numbers -> (shard, place, sid, block, times is one row per slot)."""
    per_shard = counts.sum(1)
    shard_start = np.cumsum(per_shard) - per_shard
    flat = counts.ravel()
    cell_start = np.cumsum(flat) - flat
    before = np.cumsum(counts, axis=0) - counts  # slots of each source dealt to earlier shards
    for b in non_empty(batches):
        slot = b.column("id").to_numpy()
        cell = np.searchsorted(cell_start + flat, slot, side="right")
        shard, sid = cell // counts.shape[1], cell % counts.shape[1]
        k = slot - cell_start[cell] + before[shard, sid]
        n = blocks[sid]
        key = mix2(splitmix(sid.astype(np.uint64) + np.uint64(seed)), (k // n).astype(np.uint64))
        block = permute(k % n, n, key)
        place = permute(slot - shard_start[shard], per_shard[shard],
                        splitmix(shard.astype(np.uint64) + np.uint64(seed ^ 0x5EED)))
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(place, pa.int64()),
                                          pa.array(sid, pa.int32()), pa.array(k // n, pa.int32()),
                                          pa.array(block, pa.int64())],
                                         names=["shard", "place", "sid", "pass", "block"])


class Mix:
    """A planned mix of ``docs`` (doc_id, text, source).

    ``docs``: one row per input row: doc_id, copy, size, sid, block_words, start (first word's position in
    the source's stream).  ``sources``: sid, source, source_size, target, weight, block_words,
    one row per source in code point order, null last.  ``slots``: shard, place, sid, pass, block.
    ``segments``: the words of each document that lie in each block.

    Null texts have size 0.  Repeated rows are separate documents.  Rows without doc_id take
    part like others.  A source without words gets target 0.  An empty table gives no rows.
    Equal inputs give equal mixes, however they are partitioned.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, weights=WEIGHTS, seed: int = SEED,
                 copy: str | None = None):
        """``copy`` names a column that tells rows with one doc_id apart."""
        spark = docs.sparkSession
        rows = docs.select("doc_id", "source", "text", (F.col(copy) if copy else F.lit(0)).alias("copy"))
        kind = dict(rows.dtypes)
        sized = materialize(rows.mapInArrow(
            _sizes, f"doc_id {kind['doc_id']}, source string, copy {kind['copy']}, size bigint"), "sizes")
        total = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row per source
        total = sorted(total, key=lambda r: (r["source"] is None, r["source"] or ""))
        size = np.array([r["size"] for r in total], np.int64)
        weight = np.array([weights[i % len(weights)] for i in range(len(total))])
        target = targets(size, weight)
        length = block_words(size, target, block)
        blocks = -(-size // length)
        # slots of average length make up the target; never more passes than allowed
        slots = np.rint(np.divide(target * blocks, size, out=np.zeros(len(size)), where=size > 0)).astype(np.int64)
        slots = np.minimum(slots, MOST * blocks)
        self.sources = spark.createDataFrame(
            [(i, r["source"], int(n), float(t), float(w), int(m)) for i, (r, n, t, w, m) in
             enumerate(zip(total, size, target, weight, length, strict=True))],
            "sid int, source string, source_size bigint, target double, weight double, block_words bigint")
        self.few = len(total) <= MANY
        placed = sized.join(self._hinted(self.sources.select("sid", F.col("source").alias("name"), "block_words")),
                            F.col("source").eqNullSafe(F.col("name")))
        placed = placed.select("doc_id", "copy", "size", "sid", "block_words",
                               F.pmod(F.xxhash64("doc_id", "copy"), F.lit(CHUNKS)).alias("chunk"))
        sums = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        within = (Window.partitionBy("sid", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), "copy", "size")
                  .rowsBetween(Window.unboundedPreceding, -1))
        self.docs = materialize(
            placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(F.broadcast(sums) if len(total) * CHUNKS <= MANY else sums, ["sid", "chunk"])
            .select("doc_id", "copy", "size", "sid", "block_words", (F.col("base") + F.col("inner")).alias("start")), "placed")
        self.slots = None
        if slots.sum():
            counts = shard_counts(slots, shards, seed)
            self.slots = spark.range(0, int(slots.sum()), 1, partitions(spark)).mapInArrow(
                functools.partial(_slots, blocks=blocks, counts=counts, seed=seed),
                "shard int, place bigint, sid int, pass int, block bigint")
        last = F.col("start") + F.col("size") - 1
        b = F.col("block_words")
        first_word = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
        end_word = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start"))
        self.segments = (self.docs.where("size > 0")
                         .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor(last / b))))
                         .select("doc_id", "copy", "size", "sid", "start", "block", first_word.alias("from_word"),
                                 (end_word - first_word).alias("words")))

    def _hinted(self, sources: DataFrame) -> DataFrame:
        """``sources`` as a broadcast side while there are at most ``MANY``."""
        return F.broadcast(sources) if self.few else sources

    def joined(self) -> DataFrame | None:
        """Every slot with the document segments that its block holds."""
        return None if self.slots is None else self.slots.join(self.segments, ["sid", "block"])

    def taken(self) -> DataFrame:
        """doc_id, copy, size, source, source_size, target, taken."""
        rows = self.docs.drop("block_words").withColumn("taken", F.lit(0).cast("bigint"))
        got = self.joined()
        if got is not None:
            keys = ["sid", "start", "doc_id", "copy", "size"]
            # one partial row per document keeps those that no slot took
            rows = (got.select(*keys, F.col("words").alias("taken"))
                    .unionByName(self.docs.select(*keys, F.lit(0).cast("bigint").alias("taken")))
                    .groupBy(*keys, (F.col("size") == 0).alias("none")).agg(F.sum("taken").alias("taken"), F.count_if(
                        F.col("taken") == 0).alias("rows")))
            # documents without words share positions: give back every one of them
            rows = rows.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
        return rows.join(self._hinted(self.sources), "sid").select(
            "doc_id", "copy", "size", "source", "source_size", "target", "taken")


def op9(spark, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")
