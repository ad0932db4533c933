"""Exact distinct counts from mergeable bitmaps (G1, G2) and exact membership filters.

A set of integer ids is a number of rows (bucket, 4 KB of bits), one for each run of 32,768 ids
that has a member.  Such *partials* of a (cohort, week) are small next to the facts, any number
of them merge by OR, and counting bits gives ``count(distinct ...)`` exactly.  So a window of
weeks of any length is counted from the weekly partials without going back to the facts, and
several distinct counts of one fact come from a single aggregation without ``Expand``.

They suit surrogate keys, which lie close together in a cohort or a week.  Ids scattered over a
huge range take 4 KB each; for those ``cumulative.weekly_distinct`` is the better operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import in_spine, spine_weeks_col
from cohortlens.session import materialize

KEYS = ("cohort_week", "activity_week")
FILTER_BITS = 1 << 27  # of a membership filter: 16 MB, whatever the size of the set
_BUCKET_BITS = 1 << 15


def partials(events: DataFrame, week_col: str, ids: dict[str, str]) -> DataFrame:
    """cohort_week, activity_week, metric, bucket, bits of ``ids`` (metric -> integer column).  NULL ids do not count."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("bigint").alias("id")) for m, c in ids.items()])
    rows = events.select("cohort_week", F.col(week_col).alias("activity_week"), F.explode(each).alias("_e")).where("_e.id is not null")
    return rows.groupBy(*KEYS, F.col("_e.metric").alias("metric"), F.bitmap_bucket_number("_e.id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_e.id")).alias("bits"))


def merged(parts: DataFrame) -> DataFrame:
    """Partials with equal keys as one: of several batches, or after their weeks were mapped to windows."""
    return parts.groupBy(*KEYS, "metric", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counts(parts: DataFrame, metrics: list[str]) -> DataFrame:
    """Distinct ids per (cohort, week), one column a metric; ``parts``: merged partials."""
    bits = F.bitmap_count("bits")
    return parts.groupBy(*KEYS).agg(*[
        F.coalesce(F.sum(F.when(F.col("metric") == m, bits)), F.lit(0)).cast("bigint").alias(m) for m in metrics])


def on_grid(parts: DataFrame, cfg: ReportConfig) -> DataFrame:
    """The weeks of the spine from the cohort's on."""
    week = F.col("activity_week")
    return parts.where(in_spine(week, cfg.spine_start, cfg.last_week) & (week >= F.col("cohort_week")))


def so_far(parts: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Partials of all weeks up to each spine week from the cohort's on; earlier weeks count, as in the reference.

    Rows exist from a cohort's first counted week on.
    """
    start = F.greatest("activity_week", "cohort_week", F.lit(cfg.spine_start))
    spread = parts.where(F.col("activity_week").isNotNull()).select(
        "cohort_week", F.explode(spine_weeks_col(start, cfg.last_week)).alias("activity_week"), "metric", "bucket", "bits")
    return merged(spread)


def over(parts: DataFrame, weeks: int, cfg: ReportConfig) -> DataFrame:
    """Partials of the window of ``weeks`` weeks that ends with each spine week (e.g. 4: the last four weeks)."""
    if weeks < 1:
        raise ValueError("a window has at least one week")
    last = F.date_add("activity_week", 7 * (weeks - 1))
    ends = F.sequence(F.col("activity_week"), last, F.expr("interval 1 week"))
    spread = parts.where(F.col("activity_week").isNotNull()).select(
        "cohort_week", F.explode(ends).alias("activity_week"), "metric", "bucket", "bits")
    return on_grid(merged(spread), cfg)


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def member_filter(members: DataFrame, member: str) -> DataFrame:
    """A written Bloom filter of an id column: one hash, ``FILTER_BITS`` bits, at most 4,096 rows of 4 KB.

    At ten million members 7 % of all other ids pass it.
    """
    at = _place(F.col(member))
    held = members.where(F.col(member).isNotNull()).groupBy(F.floor(at / _BUCKET_BITS).alias("_bucket")).agg(
        F.bitmap_construct_agg(at % _BUCKET_BITS).alias("_bits"))
    return materialize(held, "member_filter")


def likely_members(rows: DataFrame, column: str, held: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be among the members of a filter: all that are, and few others.

    The filter is broadcast (16 MB, whatever the number of members), so ``rows`` are cut before
    they are shuffled.  NULLs are not members.
    """
    asked = rows.where(F.col(column).isNotNull()).withColumn("_at", _place(F.col(column)))
    found = asked.join(F.broadcast(held), F.floor(F.col("_at") / _BUCKET_BITS) == F.col("_bucket"))
    return found.where(_bit(F.col("_bits"), F.col("_at") % _BUCKET_BITS) == 1).select(*rows.columns)
