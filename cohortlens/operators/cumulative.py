"""Weekly and cumulative distinct counts on the (cohort, activity week) grid.

The reference computes a cumulative metric as a theta join
``event_week <= activity_week`` against the spine followed by
``count(distinct ...)``; every event is multiplied by up to W weeks.
Here each entity is reduced to the week it is first counted, the counts
are aggregated per (cohort, week) and only those few aggregate rows are
expanded along the spine.  Work is O(events) + O(cohorts x weeks^2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import in_spine, spine_weeks_col


def weekly_distinct(events: DataFrame, week_col: str, entity: str, cfg: ReportConfig,
                    out: str, extra: dict | None = None) -> DataFrame:
    """count(distinct entity) per (cohort, event week) for weeks on the spine, >= cohort.

    ``extra`` adds further aggregates over the same rows, name -> Column.
    """
    wk = F.col(week_col)
    aggs = [F.count_distinct(entity).cast("bigint").alias(out)]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    return (events.where(in_spine(wk, cfg.spine_start, cfg.last_week) & (wk >= F.col("cohort_week")))
            .groupBy("cohort_week", wk.alias("activity_week")).agg(*aggs))


def first_event_weeks(events: DataFrame, week_col: str, entity: str) -> DataFrame:
    """One row per (cohort, entity) with the earliest event week (map-side combined)."""
    return events.groupBy("cohort_week", entity).agg(F.min(week_col).alias("first_week"))


def cumulative_distinct(first: DataFrame, cfg: ReportConfig, out: str) -> DataFrame:
    """Entities with an event in a week <= activity week, per cohort and spine week >= cohort.

    ``first`` holds (cohort_week, first_week), one row per entity.  An
    entity is counted from greatest(first_week, cohort_week, spine start):
    events before the spine still count (the reference's ``<=`` has no
    lower bound), weeks before the cohort never appear.  Rows exist only
    from the first counted week on, so earlier weeks stay NULL after the
    report's outer join, as in the reference.
    """
    start = F.greatest(F.col("first_week"), F.col("cohort_week"), F.lit(cfg.spine_start))
    # an entity without a week is never counted (NULL <= week is not true)
    per_week = (first.where(F.col("first_week").isNotNull()).select("cohort_week", start.alias("_from"))
                .where(F.col("_from") <= F.lit(cfg.last_week))
                .groupBy("cohort_week", "_from").agg(F.count(F.lit(1)).alias("_n")))
    return (per_week.select("cohort_week", "_n",
                            F.explode(spine_weeks_col(F.col("_from"), cfg.last_week)).alias("activity_week"))
            .groupBy("cohort_week", "activity_week").agg(F.sum("_n").cast("bigint").alias(out)))
