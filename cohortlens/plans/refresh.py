"""Weekly refresh of the reports: new facts are read once, old weeks never again.

``WeeklyState`` keeps what the reports need of the listing, chat and payment facts, per
(week, employer) and for *all* employers:

* ``jobs``: the good listings of a week (employer, listing);
* ``chats``: chat sessions and distinct-count message total of an employer's week;
* ``payments``: of a (user, week, purchasable item) the numbers of rows, distinct rows and ids
  and the first payment under both ranking rules;

and a ``BalanceState`` for the ledger.  Nothing in them depends on a segment, so employers that
enter a segment later, registered late or changed their attributes are reported as a full run
would: the dimension tables (employers, holders, users, purchases, subscriptions, devices) are
read anew for each report, joined to the per-employer weeks and folded by the same operators.

``refresh`` reads the facts of the named weeks alone (the bounds are on the raw date columns and
reach the scan) and replaces those weeks; naming an old week again re-opens it for late rows.
Ledger rows are named by the caller, because a running balance has no closed weeks.  Each refresh
is one committed batch, and repeating its name has no effect.

Assumed: a listing or payment id belongs to one employer.  Rows without a date are in no report
and are not kept.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import week_of
from cohortlens.operators import balance, funnel, orders
from cohortlens.operators.segments import Segment, small_side
from cohortlens.operators.snapshots import BalanceState
from cohortlens.plans import report
from cohortlens.session import materialize
from cohortlens.sources.fixtures import Sources
from cohortlens.sources.store import Store


def in_weeks(column: str, weeks: list[dt.date]):
    """Rows dated in one of the weeks, as ranges of the raw column (adjacent weeks are one range)."""
    ranges: list[list[dt.date]] = []
    for w in sorted(set(weeks)):
        if w.weekday() != 0:
            raise ValueError(f"a week is named by its Monday, got {w}")
        if ranges and ranges[-1][1] == w:
            ranges[-1][1] = w + dt.timedelta(days=7)
        else:
            ranges.append([w, w + dt.timedelta(days=7)])
    parts = [(F.col(column) >= F.lit(a)) & (F.col(column) < F.lit(b)) for a, b in ranges]
    return reduce(lambda x, y: x | y, parts, F.lit(False))


def week_listings(jobs: DataFrame) -> DataFrame:
    """Good listings: week, employer_id, job_id."""
    return (jobs.where(F.col("good_job") == 1)
            .select(week_of("job_posted_date").alias("week"), "employer_id", "job_id").distinct())


def week_chats(chats: DataFrame) -> DataFrame:
    """week, employer_id, sessions, messages: distinct pairs of the week and the sum of their distinct daily counts."""
    pairs = (chats.where(F.col("employer_messages") > 0)
             .groupBy(week_of("message_date").alias("week"), "employer_id", "jobseeker_id")
             .agg(F.sum_distinct("employer_messages").alias("_msgs")))
    return pairs.groupBy("week", "employer_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("_msgs").cast("bigint").alias("messages"))


def week_payments(payments: DataFrame) -> DataFrame:
    """week, user_id, purchase_id, n_rows, n_distinct, n_ids, first_id, first_time (created, id)."""
    keys = ["week", "user_id", "purchase_id"]
    once = payments.groupBy(week_of("created").alias("week"), "user_id", "purchase_id", "id", "created").agg(
        F.count(F.lit(1)).alias("_n"))
    return once.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("first_id"), F.min(F.struct("created", "id")).alias("first_time"))


class WeeklyState:
    """Per-week partials of the facts under ``root`` and the reports made of them."""

    TABLES = {"jobs": (week_listings, "job_posted_date"), "chats": (week_chats, "message_date"),
              "payments": (week_payments, "created")}

    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, f"{root.rstrip('/')}/weeks")
        self.balances = BalanceState(spark, f"{root.rstrip('/')}/balances")

    def refresh(self, src: Sources, batch: str, weeks: list[dt.date] | None = None, ledger: DataFrame | None = None) -> bool:
        """Read the facts of ``weeks`` (None: of all weeks) and replace what is kept of them.

        ``ledger``: the new ledger rows; rows of earlier batches among them, by user and id, are
        not added again.  Returns whether anything was written.
        """
        wrote = self.balances.apply(ledger, batch, skip_known=True) if ledger is not None else False
        if self.store.has(batch):
            return wrote
        held = []
        for name, (reduced, column) in self.TABLES.items():
            fact = getattr(src, name)
            rows = reduced(fact.where(in_weeks(column, weeks) if weeks is not None else F.col(column).isNotNull()))
            # one shuffle partition a week and a few employers' shares; the batch is a folder a week
            part = self.store.write(name, batch, rows, by=("week",))
            if weeks is None:
                held += [r["week"] for r in part.select("week").distinct().collect()]  # calendar weeks
        self.store.commit(batch, sorted(set(held)) if weeks is None else weeks)
        return True

    def _live(self) -> dict[str, list[str]]:
        """Batch -> the weeks that it holds last."""
        owner = {w: c.batch for c in self.store.commits() for w in c.weeks}
        out: dict[str, list[str]] = {}
        for w, b in owner.items():
            out.setdefault(b, []).append(w)
        return out

    def rows(self, name: str, schema: T.StructType) -> DataFrame:
        """The live rows of a table: dead weeks are pruned as partitions."""
        live = self._live()
        found = self.store.read(name, schema, sorted(live))
        ok = [(F.col("batch") == b) & F.col("week").isin([dt.date.fromisoformat(w) for w in ws]) for b, ws in live.items()]
        return found.where(reduce(lambda x, y: x | y, ok, F.lit(False))).drop("batch")

    def _table(self, src: Sources, name: str) -> DataFrame:
        return self.rows(name, self.TABLES[name][0](getattr(src, name).limit(0)).schema)

    def good_jobs(self, src: Sources, seg: Segment) -> DataFrame:
        """The segment's good listings, dated by their week."""
        jobs = self._table(src, "jobs").select("job_id", F.col("week").alias("job_posted_date"), "employer_id")
        return jobs.join(seg.employers.select("employer_id", "cohort_week"), "employer_id")

    def chats(self, src: Sources, gated: DataFrame) -> DataFrame:
        """Chat weeks of gated employers: cohort_week, chat_week, employer_id, sessions, messages."""
        rows = self._table(src, "chats").select("employer_id", F.col("week").alias("chat_week"), "sessions", "messages")
        return rows.join(gated, "employer_id")

    def payments(self, src: Sources, seg: Segment) -> DataFrame:
        """Payment weeks of segment employers for the family's SKUs, with cohort and multiplicity.

        Week mode de-duplicates before it counts; timestamp mode counts the joined rows as they are.
        """
        distinct = seg.cfg.rank_mode == "week"
        emp = seg.employers if distinct else seg.rows
        catalogue = orders.family_catalogue(src, seg.cfg)
        rows = self._table(src, "payments").join(catalogue.distinct() if distinct else catalogue, "purchase_id")
        rows = rows.join(emp.select(F.col("employer_id").alias("user_id"), "cohort_week"), "user_id")
        return rows.withColumnRenamed("week", "pay_week").withColumn(
            "counted", F.col("n_distinct") if distinct else F.col("n_rows"))

    # ---- reports

    def _funnel(self, src: Sources, seg: Segment, cumulative: bool) -> list[DataFrame]:
        jobs = materialize(self.good_jobs(src, seg), "good_jobs")
        chats = materialize(self.chats(src, funnel.gated_employers(src, seg, jobs)), "chat_weeks")
        weekly = report.weekly_distinct(chats, "chat_week", "employer_id", seg.cfg, "publ_ep_who_chat", extra={
            "ep_chat_sessions": F.sum("sessions").cast("bigint"), "ep_chats_sent": F.sum("messages").cast("bigint")})
        out = [funnel.published(src, seg, jobs), weekly]
        return out + [funnel.cum_publ_who_chat(chats, seg.cfg)] if cumulative else out

    def report_free(self, src: Sources, cfg: ReportConfig, sent_name: str = "ep_chats_sent") -> DataFrame:
        """R1 / R2 from the state."""
        seg = report.shared_segment(src, cfg)
        return report.assemble(seg, self._funnel(src, seg, cumulative=False), report.free_columns(sent_name))

    def report_premium(self, src: Sources, cfg: ReportConfig) -> DataFrame:
        """R5 from the state; the subscription history is a dimension of the segment and read whole."""
        seg = report.shared_segment(src, cfg)
        metrics = self._funnel(src, seg, cumulative=False) + report.subscription_metrics(seg)
        return report.assemble(seg, metrics, report.premium_columns(cfg),
                               order=("cohort_week", "activity_week", "weeks_after", "published_ep"))

    def report_paid(self, src: Sources, cfg: ReportConfig, orders_name: str = "orders") -> DataFrame:
        """R3 / R4 from the state."""
        seg = report.shared_segment(src, cfg)
        pay = materialize(self.payments(src, seg), "payment_weeks")
        once = pay.dropDuplicates(["user_id", "cohort_week", "pay_week", "purchase_id", "sku"])  # a repeated segment row
        first = self._first_payments(once, cfg)
        emp = small_side(seg.employers.select(F.col("employer_id").alias("user_id"), "cohort_week"), "segment_users")
        zero = self.balances.zero_weeks().join(emp, "user_id").select(
            F.col("user_id").alias("employer_id"), "cohort_week", F.col("week").alias("created"))
        metrics = self._funnel(src, seg, cumulative=True) + [
            balance.cum_zero_credit(zero, cfg),
            report.weekly_distinct(once, "pay_week", "user_id", cfg, "purchasing_eps",
                                   extra={"total_orders": F.sum("n_ids").cast("bigint")}),
            report.weekly_distinct(first, "pay_week", "user_id", cfg, "unique_purchasing_eps"),
            orders.pack_orders_pivot(once, cfg, count=F.sum("n_ids")),
            orders.first_orders_pivot(once, cfg, first=first),
            orders.cum_repeat_purchasers(pay, cfg, count=F.sum("counted")),
        ]
        return report.assemble(seg, metrics, report.paid_columns(cfg, orders_name),
                               order=("cohort_week", "activity_week", "weeks_after"))

    @staticmethod
    def _first_payments(pay: DataFrame, cfg: ReportConfig) -> DataFrame:
        """Order number 1 of every user from the first payments of its weeks."""
        order = ([F.col("pay_week").alias("_1"), F.col("first_id").alias("_2")] if cfg.rank_mode == "week"
                 else [F.col("first_time.created").alias("_1"), F.col("first_time.id").alias("_2")])
        first = F.min(F.struct(*order, "sku", "pay_week", "cohort_week")).alias("_m")
        return pay.groupBy("user_id").agg(first).select(
            "user_id", F.col("_m._2").alias("id"), *[F.col(f"_m.{c}").alias(c) for c in ("sku", "pay_week", "cohort_week")])
