"""Cohort entry: which employers form each weekly registration cohort (M1-M5)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig, SegmentRules
from cohortlens.functions.predicates import like_all_not, organic_group
from cohortlens.functions.weeks import week_of
from cohortlens.operators.bitmaps import likely_members, member_filter
from cohortlens.plans.joins import broadcast_if_small, fits_broadcast
from cohortlens.session import materialize
from cohortlens.sources.fixtures import Sources

EMPLOYER_COLS = ("employer_id", "registration_date", "cohort_week")
SUBSCRIPTION_COLS = ("subscription_id", "name", "created", "test_id")


@dataclass
class Segment:
    """A segment as two DataFrames.

    ``rows`` keeps the reference grain (one row per subscription event
    for the premium arm, one per employer otherwise); ``employers`` is
    one row per employer and is what every metric joins against.
    """

    rows: DataFrame
    employers: DataFrame
    cfg: ReportConfig
    _filter: DataFrame | None = None

    def facts(self, fact: DataFrame, column: str = "employer_id") -> DataFrame:
        """The rows of a fact that may belong to the segment (J1), for the join with it.

        A segment within the broadcast bound is broadcast to the fact, which is returned as it
        is.  Beyond it both sides are shuffled, so a filter of the segment's ids cuts the fact
        first: what moves grows with the segment's share of the facts, and a hot employer's rows
        are still split by AQE, which a layout bucketed by employer would prevent.
        """
        if fits_broadcast(self.employers):
            return fact
        if self._filter is None:
            self._filter = member_filter(self.employers, "employer_id")
        return likely_members(fact, column, self._filter)


def small_side(df: DataFrame, name: str) -> DataFrame:
    """Write a filtered employer set once; hint a broadcast if its written size is within bound.

    Catalyst estimates a filtered dimension at its full size; once written,
    the estimate is the size of its files, so fact tables are joined to it
    by broadcast (no shuffle of the fact) whenever it is small.
    """
    return broadcast_if_small(materialize(df, name))


def cohort_bounds(cfg: ReportConfig):
    """Cohort window as a bound on the raw registration date.

    ``trunc(d, 'week') >= monday``  <=>  ``d >= monday`` and
    ``trunc(d, 'week') <= monday``  <=>  ``d < monday + 7 days``, so the
    filter is written on the raw column, which Parquet can push down.
    """
    pred = F.col("registration_date") >= F.lit(cfg.cohort_from)
    if cfg.cohort_to is not None:
        pred = pred & (F.col("registration_date") < F.lit(cfg.cohort_to + dt.timedelta(days=7)))
    return pred


def employer_filter(rules: SegmentRules):
    pred = F.col("country").like(rules.country)
    if rules.city is not None:
        pred = pred & F.col("city").like(rules.city)
    if rules.organic_only:
        pred = pred & organic_group(rules.organic_channels, rules.organic_sub_channel)
    if rules.channel_not_like is not None:
        pred = pred & ~F.col("acquisition_channel").like(rules.channel_not_like)
    if rules.platform is not None:
        pred = pred & F.col("registration_sub_channel").like(rules.platform)
    if rules.good_employer:
        pred = pred & (F.col("good_employer") == 1)
    return pred & like_all_not("email", rules.internal_emails)


def exclude_holders(df: DataFrame, holders: DataFrame, key: str = "employer_id",
                    only: tuple[str, DataFrame] | None = None) -> DataFrame:
    """``key NOT IN (SELECT user_id FROM holders)`` with SQL NULL semantics.

    Spark plans a literal NOT IN as a null-aware anti join, which can
    only broadcast the holder list.  Here the candidates ``df`` are
    written first, so their size is known; while it is within the
    broadcast bound the (large) holder table streams past them unshuffled
    and only its matches are written, which the candidates are then
    anti-joined with.  Beyond the bound a filter of the candidates' ids, 16 MB at any
    size, is broadcast instead, and only the holders that pass it are shuffled.  The NULL rules are two scalar subqueries: a NULL
    holder id empties the result; a NULL key is kept only when the holder
    list is empty.

    ``only`` = (column of ``holders``, table with that column) makes the list a join of two
    tables: a holder row counts if its column is in the table.  The second table meets only
    the rows that the candidates (or the NULL rule) have left of the first.
    """
    column, listed = only or (None, None)
    ids = holders.select(F.col("user_id").alias("_holder_id"), *([column] if only else []))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.join(listed, column, "left_semi") if only else rows

    df = materialize(df, "candidates")
    cand = df.select(F.col(key).alias("_holder_id"))
    # written, because Catalyst would move the semi join below the filter's join
    near = ids if fits_broadcast(cand) else materialize(
        likely_members(ids, "_holder_id", member_filter(cand, "_holder_id")), "likely_holders")
    matched = counted(near.join(broadcast_if_small(cand), "_holder_id", "left_semi")).select("_holder_id")
    matched = broadcast_if_small(materialize(matched, "matched_holders"))
    kept = df.join(matched, F.col(key) == F.col("_holder_id"), "left_anti")
    null_probe = counted(ids.where(F.col("_holder_id").isNull())).select(F.lit(1).alias("_n")).limit(1)
    any_probe = counted(ids).select(F.lit(1).alias("_a")).limit(1)
    return kept.where(null_probe.scalar().isNull()
                      & (F.col(key).isNotNull() | any_probe.scalar().isNull()))


def exclude_device_types(df: DataFrame, src: Sources, types: tuple[int, ...]) -> DataFrame:
    """Employers NOT IN the users linked to a device of one of ``types``, with SQL NULL semantics.

    The devices of those types are written once and broadcast to the links if they are small.
    A link without a device in ``devices`` does not count.
    """
    if src.device_links is None or src.devices is None:
        raise ValueError("excluded_device_types needs the tables refs_devices_users and devices")
    listed = small_side(src.devices.where(F.col("type").isin(list(types))).select(F.col("id").alias("device_id")), "devices")
    return exclude_holders(df, src.device_links, only=("device_id", listed))


def build_segment(src: Sources, cfg: ReportConfig, materialized: bool = True) -> Segment:
    """Segment rows and employers.

    ``materialized`` writes the (small, filtered) segment once under the
    checkpoint folder.  Besides computing it once for every metric, this
    gives Catalyst its size: joins of the large fact tables
    (chats, jobs, payments, ledger) against the segment are then planned
    as broadcast joins from the start, instead of shuffling the fact by
    employer id before AQE sees that the segment is small.  The broadcast
    is hinted only when the written size is within the bound of
    ``broadcast_if_small``; beyond it AQE picks the join.
    """
    rules = cfg.segment
    emp = (src.employers.where(employer_filter(rules) & cohort_bounds(cfg))
           .select("employer_id", "registration_date"))
    # inner joins, as written: a second holder or user row repeats the employer
    repeats = rules.holders == "require" or rules.require_user_row
    if rules.holders == "require":
        emp = emp.join(src.holders.select(F.col("user_id").alias("employer_id")), "employer_id")
    if rules.require_user_row:
        emp = emp.join(src.users.select(F.col("id").alias("employer_id")), "employer_id")
    if rules.holders == "exclude":
        emp = exclude_holders(emp, src.holders)
    if rules.excluded_device_types:
        emp = exclude_device_types(emp, src, rules.excluded_device_types)
    emp = emp.withColumn("cohort_week", week_of("registration_date")).select(*EMPLOYER_COLS)
    if repeats:  # written once, with the number of rows of each employer
        emp = emp.groupBy(*EMPLOYER_COLS).agg(F.count(F.lit(1)).alias("_times"))
    if materialized:
        emp = small_side(emp, "segment")
    once = emp.select(*EMPLOYER_COLS)
    if repeats:
        emp = emp.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).select(*EMPLOYER_COLS)

    if not rules.subscriptions:
        return Segment(rows=emp, employers=once, cfg=cfg)

    subs = src.subscriptions.where(~F.col("name").like(rules.excluded_tier))
    if rules.arms:
        subs = subs.where(F.col("test_id").isin(list(rules.arms)))
    rows = subs.withColumnRenamed("user_id", "employer_id").join(emp, "employer_id", "inner")
    rows = rows.select(*EMPLOYER_COLS, *SUBSCRIPTION_COLS)
    if materialized:
        rows = materialize(rows, "segment_rows")
    # one row per employer that has a qualifying subscription event
    employers = once.join(rows.select("employer_id"), "employer_id", "left_semi")
    if materialized:
        employers = small_side(employers, "segment_employers")
    return Segment(rows=rows, employers=employers, cfg=cfg)
