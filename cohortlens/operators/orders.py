"""Credit-pack orders of the paid-chat arm.

Ranking rules (Q5): market A numbers a user's payments by payment week
(ties inside a week broken by payment id); market B by creation time
(ties broken by id).  Metrics that only need order number 1 or "order
number > 1" take them from aggregates (a per-user ``min``; per-(user,
week) counts), so no window over a hot user and no join of the payment
rows is needed.  The row-level rankings use the skew-safe keyed scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import week_of
from cohortlens.operators.cumulative import cumulative_distinct, first_event_weeks, weekly_distinct
from cohortlens.operators.scan import keyed_scan
from cohortlens.operators.segments import Segment
from cohortlens.plans.joins import broadcast_if_small
from cohortlens.sources.fixtures import Sources

PAYMENT_COLS = ("id", "user_id", "purchase_id", "created", "sku", "cohort_week", "pay_week")


def family_catalogue(src: Sources, cfg: ReportConfig) -> DataFrame:
    """SKUs of the credit family (``purchases.purchase_id`` is called ``sku`` here)."""
    cat = src.purchases.where(F.col("sku").like(cfg.sku_family)).select(
        F.col("id").alias("purchase_id"), "sku")
    return broadcast_if_small(cat)


def family_payments(src: Sources, seg: Segment, employers: DataFrame | None = None) -> DataFrame:
    """Payments of segment employers for SKUs of the family, with cohort and payment week.

    Week mode de-duplicates before it ranks.  Timestamp mode ranks the
    joined rows as they are, so an employer that the segment repeats has
    every payment once per repetition.
    """
    distinct = seg.cfg.rank_mode == "week"
    emp = employers if employers is not None else seg.employers if distinct else seg.rows
    pay = src.payments.select("id", "user_id", "purchase_id", "created")
    pay = seg.facts(pay.join(family_catalogue(src, seg.cfg), "purchase_id"), "user_id")
    pay = pay.join(emp.select(F.col("employer_id").alias("user_id"), "cohort_week"), "user_id")
    pay = pay.withColumn("pay_week", week_of("created")).select(*PAYMENT_COLS)
    return pay.distinct() if distinct else pay


def _order_key(cfg: ReportConfig) -> list[str]:
    return ["pay_week", "id"] if cfg.rank_mode == "week" else ["created", "id"]


def nulls_last(*cols: str) -> list:
    """Struct fields that order as ``ORDER BY cols`` does, NULLs last."""
    return [x for c in cols for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]


def first_payments(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Order number 1 of every user: one row per user, by a map-side-combined ``min``."""
    k = _order_key(cfg)
    m = F.min(F.struct(*nulls_last(*k), *[c for c in ("id", "sku", "pay_week", "cohort_week") if c not in k])).alias("_m")
    return pay.groupBy("user_id").agg(m).select(
        "user_id", *[F.col(f"_m.{c}").alias(c) for c in ("id", "sku", "pay_week", "cohort_week")])


def repeat_weeks(pay: DataFrame, entity: str = "user_id", week: str = "pay_week", count=None) -> DataFrame:
    """Week of each user's first repeat payment (order number 2), without ranking rows.

    Under both ranking rules order number 1 lies in the user's earliest
    payment week w1, so the earliest week among the other payments is w1
    when w1 holds two or more payments, else the user's second distinct
    week.  Computed from per-(user, week) counts, whose size per user is
    bounded by the number of calendar weeks, not by the payment volume.
    ``count``: number of payments of a group of ``pay``'s rows (default: the rows).
    """
    per_week = pay.groupBy("cohort_week", entity, week).agg((F.count(F.lit(1)) if count is None else count).alias("_n"))
    per_user = per_week.groupBy("cohort_week", entity).agg(
        F.min(week).alias("_w1"),
        F.min_by("_n", week).alias("_n1"),
        F.array_sort(F.collect_list(week)).alias("_weeks"))
    rep = F.when(F.col("_n1") >= 2, F.col("_w1")).otherwise(F.try_element_at("_weeks", F.lit(2)))
    return per_user.select("cohort_week", entity, rep.alias("first_week")).where(F.col("first_week").isNotNull())


def repeat_event_weeks(events: DataFrame, entity: str = "user_id", week: str = "pay_week") -> DataFrame:
    """(cohort, entity, week) where the entity has an event with order number > 1.

    Order number 1 lies in the entity's earliest week w1, so week w holds a
    repeat when it has 2+ events, or 1+ events and w != w1.  Built from
    per-(entity, week) counts (at most one row per calendar week per
    entity) and their per-entity minimum.
    """
    per_week = events.groupBy("cohort_week", entity, week).agg(F.count(F.lit(1)).alias("_n"))
    w1 = per_week.groupBy(entity).agg(F.min(week).alias("_w1"))
    return (per_week.join(w1, entity).where((F.col("_n") >= 2) | (F.col(week) != F.col("_w1")))
            .select("cohort_week", entity, week))


def ranked_payments(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """M20 (week mode) / M21 (timestamp mode): every payment with its order number."""
    base = pay.select("user_id", F.col("cohort_week").alias("registration_week"),
                      F.col("pay_week").alias("created_week"), "purchase_id", "id", "created")
    order = ["created_week", "id"] if cfg.rank_mode == "week" else ["created", "id"]
    ranked = keyed_scan(base, "user_id", order, "pur_order")
    return ranked.select("user_id", "registration_week", "created_week", "purchase_id", "id", "pur_order")


def orders_weekly(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Purchasing employers and orders per cohort and week."""
    return weekly_distinct(pay, "pay_week", "user_id", cfg, "purchasing_eps",
                           extra={"total_orders": F.count_distinct("id").cast("bigint")})


def _pattern_columns(counts: DataFrame, key_col: str, patterns, names, gate=None) -> DataFrame:
    """CASE WHEN <key LIKE pattern [AND gate]> THEN n END per pattern; drop the key; DISTINCT.

    The reference groups by the hidden key and then de-duplicates the
    visible columns, so two keys of one pattern with equal counts become
    one row (Q3).  The order agg -> drop key -> distinct is kept.
    """
    cols = []
    for p, name in zip(patterns, names, strict=True):
        cond = F.col(key_col).like(p)
        if gate is not None:
            cond = cond & gate
        cols.append(F.when(cond, F.col("_n")).alias(name))
    return counts.select("cohort_week", "activity_week", *cols).distinct()


def _sum_columns(raw: DataFrame, names) -> DataFrame:
    return raw.groupBy("cohort_week", "activity_week").agg(
        *[F.sum(n).cast("bigint").alias(n) for n in names])


def _weekly(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    wk = F.col("pay_week")
    return pay.where(wk.between(F.lit(cfg.spine_start), F.lit(cfg.last_week))
                     & (wk >= F.col("cohort_week"))).withColumnRenamed("pay_week", "activity_week")


def pack_orders_raw(pay: DataFrame, cfg: ReportConfig, count=None) -> DataFrame:
    """Orders per pack, grouped by the hidden SKU, then de-duplicated.

    ``count``: number of orders of a group of ``pay``'s rows (default: distinct ids).
    """
    counts = _weekly(pay, cfg).groupBy("cohort_week", "activity_week", "sku").agg(
        (F.count_distinct("id") if count is None else count).alias("_n"))
    return _pattern_columns(counts, "sku", cfg.packs, cfg.pack_names)


def pack_orders_pivot(pay: DataFrame, cfg: ReportConfig, count=None) -> DataFrame:
    """Sum of M18 per cohort and week."""
    return _sum_columns(pack_orders_raw(pay, cfg, count), cfg.pack_names)


def first_purchasers(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Users whose first payment falls in the activity week."""
    return weekly_distinct(first_payments(pay, cfg), "pay_week", "user_id", cfg, "unique_purchasing_eps")


def cum_purchasers(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Users with a payment in a week <= the activity week."""
    return cumulative_distinct(first_event_weeks(pay, "pay_week", "user_id"), cfg, "cum_unique_purchasing_eps")


def first_orders_raw(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """First orders per pack, grouped by hidden SKU and order number, de-duplicated.

    Order-1 groups are the first payments grouped by SKU; every group with
    order number > 1 yields an all-NULL row, and the DISTINCT keeps one per
    (cohort, week) that has a repeat payment.
    """
    counts = _weekly(first_payments(pay, cfg), cfg).groupBy("cohort_week", "activity_week", "sku").agg(
        F.count_distinct("id").alias("_n"))
    firsts = _pattern_columns(counts, "sku", cfg.packs, cfg.first_names)
    nulls = _weekly(repeat_event_weeks(pay), cfg).select("cohort_week", "activity_week").distinct()
    return firsts.unionByName(nulls, allowMissingColumns=True).distinct()


def first_orders_pivot(pay: DataFrame, cfg: ReportConfig, first: DataFrame | None = None) -> DataFrame:
    """Sum of M24.

    Only first payments carry values (grouped by hidden SKU, then
    de-duplicated); every other (cohort, week) with a payment keeps its
    row with NULL sums, as the grouping over all payments does.
    ``first``: the users' first payments, if known.
    """
    first = first_payments(pay, cfg) if first is None else first
    counts = _weekly(first, cfg).groupBy("cohort_week", "activity_week", "sku").agg(
        F.count_distinct("id").alias("_n"))
    weeks = _weekly(pay, cfg).select("cohort_week", "activity_week").distinct()
    raw = _pattern_columns(counts, "sku", cfg.packs, cfg.first_names).unionByName(weeks, allowMissingColumns=True)
    return _sum_columns(raw, cfg.first_names)


def repeat_orders_pivot(ranked_pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Repeat orders per pack (order number > 1).

    Here the grouping by the exact order number matters (equal counts of
    order 2 and order 3 collapse), so the full ranking is used.
    """
    counts = _weekly(ranked_pay, cfg).groupBy("cohort_week", "activity_week", "sku", "pur_order").agg(
        F.count_distinct("id").alias("_n"))
    raw = _pattern_columns(counts, "sku", cfg.packs, cfg.repeat_names, gate=F.col("pur_order") > 1)
    return _sum_columns(raw, cfg.repeat_names)


def ranked_family_payments(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Family payments with their order number (skew-safe scan)."""
    order = _order_key(cfg)
    return keyed_scan(pay, "user_id", order, "pur_order")


def cum_repeat_purchasers(pay: DataFrame, cfg: ReportConfig, count=None) -> DataFrame:
    """Users with a repeat payment (order number > 1) in a week <= the activity week."""
    return cumulative_distinct(repeat_weeks(pay, count=count), cfg, "cum_unique_rep_purchasers")
