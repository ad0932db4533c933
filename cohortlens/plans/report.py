"""Report assembly.

The reference joins 6-15 metric tables to segment x spine at *employer*
grain and de-duplicates with a GROUP BY over every column.  Every output
column is a function of (cohort week, activity week), so the report is
built on the (cohort, week) grid instead: the metric tables - each at
most cohorts x weeks rows - are stacked with ``unionByName`` and folded
with one ``groupBy``, then ``weeks_after`` is joined, which can add a
second row for a cohort straddling New Year (Q1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import spine_weeks_col
from cohortlens.operators.cumulative import weekly_distinct
from cohortlens.operators import balance, funnel, orders, subscriptions
from cohortlens.operators.segments import Segment, build_segment
from cohortlens.session import build_concurrently, materialize
from cohortlens.sources.fixtures import Sources

KEYS = ("cohort_week", "activity_week")


def cohort_grid(regs: DataFrame, cfg: ReportConfig) -> DataFrame:
    """(cohort, spine week >= cohort) for every cohort, with its registrations."""
    start = F.greatest(F.col("cohort_week"), F.lit(cfg.spine_start))
    return regs.where(F.col("cohort_week") <= F.lit(cfg.last_week)).select(
        "cohort_week", "registrations", F.explode(spine_weeks_col(start, cfg.last_week)).alias("activity_week"))


def assemble(seg: Segment, metrics: list[DataFrame], columns: list[tuple[str, str]],
             order: tuple[str, ...] = KEYS) -> DataFrame:
    """Fold metric tables onto the grid; ``columns`` is (output name, metric column)."""
    regs = funnel.registrations(seg)
    grid = cohort_grid(regs, seg.cfg).withColumn("_grid", F.lit(True))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [grid] + metrics)
    value_cols = [c for c in stacked.columns if c not in KEYS]
    folded = (stacked.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in value_cols])
              .where(F.col("_grid")))
    out = folded.join(funnel.weeks_after_table(seg), list(KEYS), "left")
    sel = [F.col(src).alias(name) for name, src in columns]
    # the report has at most cohorts x weeks (x2, Q1) rows, a bound fixed by
    # the configuration: one sorted partition, no range-sampling job
    return out.select("cohort_week", "activity_week", "weeks_after", *sel).repartition(1).sortWithinPartitions(*order)


def _keep(df: DataFrame, name: str, reuse: bool) -> DataFrame:
    """Write a shared intermediate once (``reuse``), or leave it inlined in every branch."""
    return materialize(df, name) if reuse else df


def shared_segment(src: Sources, cfg: ReportConfig, reuse: bool = True) -> Segment:
    """The segment, written once (``reuse``): every metric of a report joins against it."""
    return build_segment(src, cfg, materialized=reuse)


def _chat_pairs(src: Sources, seg: Segment, reuse: bool, jobs: DataFrame) -> DataFrame:
    # the chat fact is the largest input: reduce it to pair-weeks once and
    # derive sessions, messages and (cumulative) chatting employers from that
    return _keep(funnel.chat_pair_weeks(funnel.chat_events(src, seg, funnel.gated_employers(src, seg, jobs))), "chat_pairs", reuse)


def _good_jobs(src: Sources, seg: Segment, reuse: bool) -> DataFrame:
    # published listings and the chat gate both read the segment's good listings
    return _keep(funnel.good_jobs(src, seg), "good_jobs", reuse)


def _funnel_metrics(src: Sources, seg: Segment, cumulative: bool, pairs: DataFrame, jobs: DataFrame):
    cfg = seg.cfg
    # M12, M14 and M15 restricted to the grid, in one aggregation
    weekly = weekly_distinct(pairs, "chat_week", "employer_id", cfg, "publ_ep_who_chat", extra={
        "ep_chat_sessions": F.count(F.lit(1)).cast("bigint"), "ep_chats_sent": F.sum("_msgs").cast("bigint")})
    out = [funnel.published(src, seg, jobs), weekly]
    if cumulative:
        out.append(funnel.cum_publ_who_chat(pairs, cfg))
    return out


def free_columns(sent_name: str) -> list[tuple[str, str]]:
    return [("registrations", "registrations"), ("published_eps", "published_ep"), ("listings", "listings"),
            ("publ_eps_who_chat", "publ_ep_who_chat"), ("ep_chat_sessions", "ep_chat_sessions"),
            (sent_name, "ep_chats_sent")]


def paid_columns(cfg: ReportConfig, orders_name: str) -> list[tuple[str, str]]:
    cols = [("registrations", "registrations"), ("published_ep", "published_ep"), ("listings", "listings"),
            ("publ_ep_who_chat", "publ_ep_who_chat"), ("cum_publ_ep_who_chat", "cum_publ_ep_who_chat"),
            ("ep_chat_sessions", "ep_chat_sessions"), ("ep_chat_messages_sent", "ep_chats_sent"),
            ("cum_eps_who_reached_0_credits", "cum_eps_who_reached_0_credits"),
            ("purchasing_eps", "purchasing_eps"), ("unique_purchasing_eps", "unique_purchasing_eps"),
            (orders_name, "total_orders")]
    return cols + [(n, n) for n in cfg.pack_names + cfg.first_names] + [
        ("cum_unique_rep_purchasers", "cum_unique_rep_purchasers")]


def premium_columns(cfg: ReportConfig) -> list[tuple[str, str]]:
    cols = [("registrations", "registrations"), ("published_ep", "published_ep"), ("listings", "listings"),
            ("publ_ep_who_chat", "publ_ep_who_chat"), ("ep_chat_sessions", "ep_chat_sessions"),
            ("ep_chat_messages_sent", "ep_chats_sent"), ("purchasing_eps", "purchasing_eps"),
            ("unique_purchasing_eps", "unique_purchasing_eps"), ("orders", "total_orders")]
    return cols + [(n, n) for n in cfg.tier_names + cfg.first_tier_names] + [
        ("cum_unique_rep_purchasers", "cum_unique_rep_purchasers")]


def subscription_metrics(seg: Segment, reuse: bool = True, ev: DataFrame | None = None) -> list[DataFrame]:
    ev = ev if ev is not None else _keep(subscriptions.paid_tier_events(seg), "subscriptions", reuse)
    return [subscriptions.sub_totals(ev, seg.cfg), subscriptions.sub_first_purchasers(ev, seg.cfg),
            subscriptions.sub_order_pivot(ev, seg.cfg), subscriptions.sub_first_orders_pivot(ev, seg.cfg),
            subscriptions.sub_cum_repeat_purchasers(ev, seg.cfg)]


def report_free(src: Sources, cfg: ReportConfig, sent_name: str = "ep_chats_sent",
                reuse: bool = True) -> DataFrame:
    """Free-user report (9 columns)."""
    seg = shared_segment(src, cfg, reuse)
    jobs = _good_jobs(src, seg, reuse)
    pairs = _chat_pairs(src, seg, reuse, jobs)
    return assemble(seg, _funnel_metrics(src, seg, cumulative=False, pairs=pairs, jobs=jobs),
                    free_columns(sent_name))


def report_paid(src: Sources, cfg: ReportConfig, orders_name: str = "orders", reuse: bool = True) -> DataFrame:
    """Paid-chat report (21 columns)."""
    seg = shared_segment(src, cfg, reuse)
    jobs = _good_jobs(src, seg, reuse)
    # independent intermediates of the segment: written side by side
    built = build_concurrently({
        "pairs": lambda: _chat_pairs(src, seg, reuse, jobs),
        "pay": lambda: _keep(orders.family_payments(src, seg), "payments", reuse),
        "zero": lambda: _keep(balance.zero_credit_rows(src, seg), "zero_credit", reuse)})
    pay, zero = built["pay"], built["zero"]
    metrics = _funnel_metrics(src, seg, cumulative=True, pairs=built["pairs"], jobs=jobs) + [
        balance.cum_zero_credit(zero, cfg),
        orders.orders_weekly(pay, cfg),
        orders.first_purchasers(pay, cfg),
        orders.pack_orders_pivot(pay, cfg),
        orders.first_orders_pivot(pay, cfg),
        orders.cum_repeat_purchasers(pay, cfg),
    ]
    return assemble(seg, metrics, paid_columns(cfg, orders_name), order=("cohort_week", "activity_week", "weeks_after"))


def report_premium(src: Sources, cfg: ReportConfig, reuse: bool = True) -> DataFrame:
    """Premium report (19 columns)."""
    seg = shared_segment(src, cfg, reuse)
    jobs = _good_jobs(src, seg, reuse)
    built = build_concurrently({
        "pairs": lambda: _chat_pairs(src, seg, reuse, jobs),
        "ev": lambda: _keep(subscriptions.paid_tier_events(seg), "subscriptions", reuse)})
    metrics = _funnel_metrics(src, seg, cumulative=False, pairs=built["pairs"], jobs=jobs) + subscription_metrics(
        seg, ev=built["ev"])
    return assemble(seg, metrics, premium_columns(cfg), order=("cohort_week", "activity_week", "weeks_after", "published_ep"))
