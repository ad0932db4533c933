"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import materialize

__all__ = ["materialize", "table", "fold", "splitmix", "mix2", "partitions", "non_empty", "runs", "small",
           "session_settings"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fold(doc_id, k: int):
    """crc32 of the id as text, modulo ``k`` (the fixed label folds)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def splitmix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 values (public constants)."""
    with np.errstate(over="ignore"):
        z = x + _GOLD
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def mix2(a: np.ndarray, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(a * np.uint64(0xD6E8FEB86659FD93) + np.asarray(b, dtype=np.uint64))


@contextlib.contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """Runtime SQL settings for one block; the session's own values come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def non_empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: what a task holds stays small, whatever Arrow sends."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table per run.

    The input must be clustered by the keys (``sortWithinPartitions``).  Only one run is
    held at a time, so memory follows the largest run, not the partition.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in non_empty(batches):
        cols = [b.column(k).to_pylist() for k in keys]
        ks = list(zip(*cols, strict=True))
        cuts = [0, *[i for i in range(1, len(ks)) if ks[i] != ks[i - 1]], len(ks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and ks[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = ks[lo]
    if held:
        yield pa.Table.from_batches(held)
