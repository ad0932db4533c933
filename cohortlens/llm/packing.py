"""Best-fit packing of tokenized documents into fixed-length sequences.

1. Each task tokenizes whole texts and emits only what packing needs: piece lengths and
   checksums.  A document longer than a sequence is cut into full pieces; its first piece
   takes the remainder.
2. Full pieces are sequences already.  The others are dealt to groups that fill about
   ``GROUP`` sequences by a hash, so no task or driver ever holds them all, and every group
   sees the same mix of lengths.
3. Within a group, vector best fit in order of falling length: a piece goes to the open
   sequence that can take it under every capacity (tokens, documents, attention cost) and
   for which the weighted norm of what would remain is smallest (``rule="norm"``), or whose
   residual has the smallest weighted dot product with the piece (``rule="dot"``).
4. Each group's last sequence, and those at most half full, are packed once more, together
   with those of other groups and again in groups.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, runs, small, table

LENGTH = 2048
GROUP = 1024  # sequences that the pieces of a group need at least
CAPACITY = (LENGTH, LENGTH, LENGTH * LENGTH)  # tokens, documents, attention cost (sum of squared lengths)
WEIGHTS = (1.0, 0.01, 0.05)
END = 0  # id after every document


# Fixed value: how the byte-level pre-tokenizer of such files splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary is in merge order, so its ids are the merge ranks, and ``tiktoken``
    gives the same ids several times faster (the tests compare the two over whole tables).
    A text that holds the string of an added token goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ...
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in own} | {
            chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in self.added}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """Packed little-endian uint32 ids; null and empty texts have none."""
        if not text:
            return b""
        if any(s in text for s in self.added):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, dtype="<u4").tobytes()


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, copy int"


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than ``length``."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    enc = Encoder(path)
    end = np.array([END], dtype="<u4").tobytes()
    for part in small(batches):
        rows = []
        for d, t in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
            ids = enc.encode(t.as_py()) + end
            for k, (s, n) in enumerate(cut(len(ids) // 4, length)):
                rows.append((d, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]],
            pa.array(np.arange(len(rows)), pa.int32())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])


def best_fit(lengths: np.ndarray, capacity=CAPACITY, weights=WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, by vector best fit in order of falling length."""
    if rule not in ("norm", "dot"):
        raise ValueError(rule)
    cap, w = np.array(capacity, float), np.array(weights, float)
    n = len(lengths)
    if n and (lengths.max() > cap[0] or lengths.max() ** 2 > cap[2] or cap[1] < 1):
        raise ValueError("a piece exceeds a capacity")
    need = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1)
    left = np.empty((max(n, 1), 3))
    names = np.empty(max(n, 1), np.int64)
    used = made = 0
    where, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    shortest = lengths.min() if n else 0
    for i in order:
        d = need[i]
        room = left[:used]
        ok = np.flatnonzero((room[:, 0] >= d[0]) & (room[:, 1] >= 1) & (room[:, 2] >= d[2]))
        if len(ok):
            if rule == "norm":
                score = (((room[ok] - d) / cap) ** 2) @ w
            else:
                score = (room[ok] / cap) @ (w * d / cap)
            j = ok[score.argmin()]
        else:
            j, names[used], left[used] = used, made, cap
            used, made = used + 1, made + 1
        where[i], offset[i] = names[j], cap[0] - left[j, 0]
        left[j] -= d
        if left[j, 0] < shortest or left[j, 1] < 1:  # nothing fits any more: close it
            used -= 1
            left[j], names[j] = left[used], names[used]
    return where, offset


COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _unfilled(lengths: np.ndarray, where: np.ndarray, capacity) -> np.ndarray:
    """Whether each piece lies in the last sequence or in one at most half full in every capacity."""
    need = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1)
    used = np.stack([np.bincount(where, need[:, j]) for j in range(3)], 1)
    part = (2 * used <= np.array(capacity, float)).all(1)
    part[-1] = True
    return part[where]


def _pack(batches: Iterator[pa.RecordBatch], rule: str, capacity, weights) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["slot"]):
        slot = t.column("slot")[0].as_py()
        lengths = t.column("length").to_numpy()
        where, offset = best_fit(lengths, capacity, weights, rule)
        # sequence numbers: the group in the high bits; full pieces use negative numbers
        yield pa.RecordBatch.from_arrays(
            [t.column(c).combine_chunks() for c in COLUMNS]
            + [pa.array(where + (slot << 32), pa.int64()), pa.array(offset, pa.int64()),
               pa.array(_unfilled(lengths, where, capacity))],
            names=[*COLUMNS, "sequence_id", "offset", "unfilled"])


OUT = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def _groups(pieces: DataFrame, capacity) -> int:
    """Groups of pieces that need about ``GROUP`` sequences each, by the capacity that they use most."""
    square = F.col("length").cast("double") * F.col("length")
    need = pieces.agg(F.sum("length"), F.count(F.lit(1)), F.sum(square)).first()
    return max(1, math.ceil(max((n or 0) / c for n, c in zip(need, capacity, strict=True)) / GROUP))


def pack(docs: DataFrame, path: str, rule: str = "norm", capacity=CAPACITY, weights=WEIGHTS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and then id 0; null and empty texts are the one id 0.
    Repeated rows are packed each.  Rows without doc_id are packed like others.  Columns
    other than doc_id and text are ignored; an empty table gives no rows.  Sequence ids are
    unique, not dense: a group's number in the high bits, negative ones for full pieces.
    ``capacity``: tokens, documents and attention cost of a sequence (each 1 or more), with
    their ``weights`` in the rule.  A piece is as long as the first and third allow.
    """
    if min(capacity) < 1:
        raise ValueError("a capacity is below 1")
    tokens, documents, cost = (int(c) for c in capacity)
    length = min(tokens, math.isqrt(cost))
    pieces = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                         .mapInArrow(functools.partial(_pieces, path=path, length=length), PIECES), "pieces")
    # nothing fits beside a full piece
    is_full = F.lit(documents == 1) | ((F.col("length") == length) & F.lit(length == tokens or length ** 2 == cost))
    full = pieces.where(is_full).select(
        *COLUMNS, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    open_ = pieces.where(~is_full)
    groups = _groups(open_, capacity)

    def packed(rows: DataFrame, slot) -> DataFrame:
        dealt = (rows.select(*COLUMNS, slot.alias("slot")).repartition("slot")
                 .sortWithinPartitions("slot", "length", "doc_id", "piece", "ids_crc32"))
        return dealt.mapInArrow(functools.partial(_pack, rule=rule, capacity=capacity, weights=weights),
                                OUT + ", unfilled boolean")

    key = F.xxhash64("doc_id", "piece", "copy", "ids_crc32")
    first = packed(open_, F.pmod(key, F.lit(groups)))
    if groups == 1:
        return first.drop("unfilled").unionByName(full)
    first = materialize(first, "packed")
    rest = first.where("unfilled")
    again = packed(rest, groups + F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(_groups(rest, capacity))))
    return first.where("not unfilled").unionByName(again).drop("unfilled").unionByName(full)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
