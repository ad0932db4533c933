"""Skew-safe ordered windows per key: ``row_number`` and RANGE running sums.

``Window.partitionBy(user)`` sends every row of one user to one task, so a user holding a
third of the ledger becomes a straggler.  Here the rows are range-partitioned on
(key, order...), which splits a hot key over many partitions and keeps rows with equal
order values together; the partition number is written with the rows, once, under the
checkpoint folder.  Then

1. Spark windows over (partition, key) number or sum within a partition;
2. only the first key of a partition can inherit, and only from partitions that end with that
   key.  So each partition gives its first and last key and the last key's total, one row a
   partition, and a running sum over these few rows gives the offsets, which are broadcast.

All of it stays in the JVM with the input's own types: ids keep 64 bits, decimals stay
decimals.  NULLs sort last and a sum over NULLs only is NULL, as in SQL.  A single
(key, order value) with very many rows is one partition's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import materialize

_PID = "_scan_pid"
SCAN_PARTITIONS_CONF = "spark.cohortlens.scan.partitions"


def _forced_partitions(df: DataFrame) -> int | None:
    """Partition count set by ``spark.cohortlens.scan.partitions`` (tests), else None."""
    v = df.sparkSession.conf.get(SCAN_PARTITIONS_CONF, None)
    return int(v) if v else None


def _plus(a, b):
    """Sum of two partial sums, either of which may be over nothing but NULLs."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _offsets(rows: DataFrame, key: str, total) -> DataFrame:
    """(_p, _k, _off): what the first key of a partition inherits from earlier ones.

    Per partition one row with its first and last key and the last key's total, all combined
    map-side; the running sum over a key's partitions runs on these rows alone.
    """
    place = F.struct(F.col(key).isNull().alias("_none"), F.col(key).alias("_key"))  # NULLs last, as the ranges are
    ends = rows.groupBy(F.col(_PID).alias("_p")).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    of_last = rows.join(F.broadcast(ends.select("_p", F.col("_last._key").alias("_l"))),  # a row a partition
                        (F.col(_PID) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_l")))
    totals = of_last.groupBy("_p").agg(total.alias("_t"))
    last = ends.join(F.broadcast(totals), "_p").select("_p", F.col("_last").alias("_k"), "_t", F.lit(False).alias("_asks"))
    first = ends.select("_p", F.col("_first").alias("_k"), F.lit(None).alias("_t"), F.lit(True).alias("_asks"))
    earlier = Window.partitionBy("_k").orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    both = last.unionByName(first).withColumns({"_off": F.sum("_t").over(earlier), "_seen": F.count_if(~F.col("_asks")).over(earlier)})
    return both.where("_asks and _seen > 0").select("_p", F.col("_k._key").alias("_k"), "_off")


def keyed_scan(df: DataFrame, key: str, order: list[str], out: str, mode: str = "row_number",
               value: str | None = None, num_partitions: int | None = None, ordered_by: list[str] | None = None) -> DataFrame:
    """Add ``out``: row_number() or sum(value) (default RANGE frame) over (partition by key order by order).

    For ``row_number`` the order must be total (add a unique tie-breaker); for ``range``
    equal order values share one running total, as SQL's default frame does.  With
    ``ordered_by`` (further columns, may be empty) the result is sorted by key, order and those,
    NULLs last: the written ranges stay the partitions, so nothing is range-partitioned again.
    """
    if mode not in ("row_number", "range"):
        raise ValueError(mode)
    n = num_partitions or _forced_partitions(df)
    by = [F.col(c).asc_nulls_last() for c in [key, *order]]
    # without an explicit count AQE merges adjacent ranges to its advisory size
    ranged = df.repartitionByRange(n, *by) if n else df.repartitionByRange(*by)
    rows = materialize(ranged.withColumn(_PID, F.spark_partition_id()), "scan")

    local = Window.partitionBy(_PID, key).orderBy(*by[1:])
    if mode == "row_number":
        inner, total = F.row_number().over(local).cast("bigint"), F.count(F.lit(1))
    else:
        inner, total = F.sum(value).over(local), F.sum(value)
    offsets = _offsets(rows, key, total)
    if ordered_by is not None:
        ranges = (rows.agg(F.max(_PID)).first()[0] or 0) + 1
        rows = rows.repartitionById(ranges, _PID)
    numbered = rows.withColumn("_in", inner)
    joined = numbered.join(F.broadcast(offsets),
                           (F.col(_PID) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    result = joined.select(*df.columns, _plus(F.col("_in"), F.col("_off")).alias(out))
    if ordered_by is not None:
        result = result.sortWithinPartitions(*by, *[F.col(c).asc_nulls_last() for c in ordered_by])
    return result
