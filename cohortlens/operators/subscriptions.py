"""Subscription tiers of the premium arm.

The premium segment has one row per subscription event; events of the
paid tiers are numbered per user by (created, subscription_id).  Metrics
that need order number 1 take the first event with a per-user ``min``;
"order number > 1 in week w" is decided from per-(user, week) event
counts and the user's first week.  Only ``sub_ranked`` numbers rows, with
the skew-safe scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import week_of
from cohortlens.operators.cumulative import cumulative_distinct, first_event_weeks, weekly_distinct
from cohortlens.operators.orders import _pattern_columns, _sum_columns, nulls_last, repeat_weeks
from cohortlens.operators.orders import repeat_event_weeks as _repeat_event_weeks
from cohortlens.operators.scan import keyed_scan
from cohortlens.operators.segments import Segment

def paid_tier_events(seg: Segment) -> DataFrame:
    """Segment rows of the paid tiers, with the event week."""
    return (seg.rows.where(F.col("name").isin(list(seg.cfg.tiers)))
            .select("employer_id", "cohort_week", "subscription_id", "name", "created",
                    week_of("created").alias("sub_week")))


def first_events(ev: DataFrame) -> DataFrame:
    """Order number 1 of every employer (one row each, map-side-combined ``min``)."""
    m = F.min(F.struct(*nulls_last("created", "subscription_id"), "name", "sub_week", "cohort_week")).alias("_m")
    return ev.groupBy("employer_id").agg(m).select(
        "employer_id", *[F.col(f"_m.{c}").alias(c) for c in ("created", "subscription_id", "name", "sub_week",
                                                                "cohort_week")])


def repeat_event_weeks(ev: DataFrame) -> DataFrame:
    """(cohort, employer, week) where the employer has a paid-tier event with order number > 1."""
    return _repeat_event_weeks(ev, "employer_id", "sub_week")


def sub_ranked(seg: Segment) -> DataFrame:
    """Paid-tier events numbered per user by creation time."""
    ev = seg.rows.where(F.col("name").isin(list(seg.cfg.tiers))).select(
        F.col("employer_id").alias("user_id"), "subscription_id", "name", "created", "cohort_week")
    return keyed_scan(ev, "user_id", ["created", "subscription_id"], "subscription_order")


def _weekly(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    wk = F.col("sub_week")
    return ev.where(wk.between(F.lit(cfg.spine_start), F.lit(cfg.last_week))
                    & (wk >= F.col("cohort_week"))).withColumnRenamed("sub_week", "activity_week")


def sub_totals(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Subscribing employers and subscriptions per cohort and week."""
    return weekly_distinct(ev, "sub_week", "employer_id", cfg, "purchasing_eps",
                           extra={"total_orders": F.count_distinct("subscription_id").cast("bigint")})


def sub_order_raw(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Subscriptions per tier, grouped by tier name, de-duplicated."""
    counts = _weekly(ev, cfg).groupBy("cohort_week", "activity_week", "name").agg(
        F.count_distinct("subscription_id").alias("_n"))
    return _pattern_columns(counts, "name", cfg.tiers, cfg.tier_names)


def sub_order_pivot(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """M36."""
    return _sum_columns(sub_order_raw(ev, cfg), cfg.tier_names)


def sub_first_purchasers(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Employers whose first paid subscription falls in the week."""
    return weekly_distinct(first_events(ev), "sub_week", "employer_id", cfg, "unique_purchasing_eps")


def sub_cum_purchasers(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Employers with a first paid subscription in a week <= the activity week
    (the first event's week is the employer's earliest event week)."""
    return cumulative_distinct(first_event_weeks(ev, "sub_week", "employer_id"), cfg,
                               "cum_unique_purchasing_eps")


def sub_repeat_purchasers(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Employers with a repeat subscription event in the week."""
    return weekly_distinct(repeat_event_weeks(ev), "sub_week", "employer_id", cfg, "repeat_purchasing_eps")


def sub_first_orders_raw(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """First subscriptions per tier, de-duplicated.

    The reference groups by (tier, order number): order-1 groups give the
    tier counts; every (cohort, week) with an order > 1 event adds one
    all-NULL row after the DISTINCT.
    """
    counts = _weekly(first_events(ev), cfg).groupBy("cohort_week", "activity_week", "name").agg(
        F.count_distinct("subscription_id").alias("_n"))
    firsts = _pattern_columns(counts, "name", cfg.tiers, cfg.first_tier_names)
    nulls = _weekly(repeat_event_weeks(ev), cfg).select("cohort_week", "activity_week").distinct()
    return firsts.unionByName(nulls, allowMissingColumns=True).distinct()


def sub_first_orders_pivot(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """M41."""
    return _sum_columns(sub_first_orders_raw(ev, cfg), cfg.first_tier_names)


def sub_cum_repeat_purchasers(ev: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Employers with a repeat subscription event in a week <= the activity week."""
    return cumulative_distinct(repeat_weeks(ev, "employer_id", "sub_week"), cfg, "cum_unique_rep_purchasers")
