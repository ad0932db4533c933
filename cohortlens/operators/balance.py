"""Chat-credit balance of the paid-chat arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import week_of
from cohortlens.operators.cumulative import cumulative_distinct
from cohortlens.operators.orders import family_payments
from cohortlens.operators.scan import keyed_scan
from cohortlens.operators.segments import Segment
from cohortlens.sources.fixtures import Sources

LEDGER_COLS = ("id", "user_id", "balance_change", "created")


def running_balance(ledger: DataFrame, ordered_by: list[str] | None = None) -> DataFrame:
    """``sum(balance_change) over (partition by user_id order by created)``.

    The default RANGE frame: ledger rows of one user with the same
    ``created`` share one balance (Q7); amounts keep their type, and a sum
    over NULLs only is NULL.  Computed with the skew-safe scan; ``ordered_by``: see there.
    """
    return keyed_scan(ledger.select(*LEDGER_COLS), "user_id", ["created"], "balance",
                      mode="range", value="balance_change", ordered_by=ordered_by)


def zero_credit_rows(src: Sources, seg: Segment) -> DataFrame:
    """Ledger rows of segment employers where the running balance is 0.

    The ledger is cut to segment users before the scan; the balance is
    per user, so the result is the same as scanning the whole ledger.
    """
    emp = seg.employers.select(F.col("employer_id").alias("user_id"), "cohort_week")
    ledger = seg.facts(src.ledger.select(*LEDGER_COLS), "user_id").join(emp.select("user_id"), "user_id", "left_semi")
    bal = running_balance(ledger).where(F.col("balance") == 0)
    rows = seg.rows.select(F.col("employer_id").alias("user_id"), "cohort_week")
    return bal.join(rows, "user_id").select(
        F.col("user_id").alias("employer_id"), "cohort_week", "id", "created", "balance")


def cum_zero_credit(zero: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Employers who reached 0 credits in a week <= the activity week."""
    first = zero.groupBy("cohort_week", "employer_id").agg(F.min(week_of("created")).alias("first_week"))
    return cumulative_distinct(first, cfg, "cum_eps_who_reached_0_credits")


def zero_credit_payments(src: Sources, seg: Segment, zero: DataFrame) -> DataFrame:
    """Family payments of employers that reached 0 credits, numbered per user.

    The reference numbers these rows with no ORDER BY, over a join that
    repeats each payment once per zero-balance ledger row.  We number each
    payment once, by (created, id): the order is deterministic and the
    pairwise fan-out (payments x zero rows per user) is never built.
    """
    zero_emp = zero.select("employer_id").distinct()
    emp = seg.employers.join(zero_emp, "employer_id", "left_semi")
    pay = family_payments(src, seg, employers=emp)
    ranked = keyed_scan(pay, "user_id", ["created", "id"], "pur_order")
    return ranked.select("user_id", F.col("cohort_week").alias("registration_week"),
                         F.col("pay_week").alias("created_week"), "purchase_id", "id", "pur_order")


def cum_zero_credit_purchasers(src: Sources, seg: Segment, zero: DataFrame) -> DataFrame:
    """Employers counted from the latest of cohort, first-payment week and first zero week.

    Order number 1 is the earliest payment, so its week is the minimum
    payment week; any zero row with week <= activity week qualifies, so
    the earliest zero week is the bound.
    """
    cfg = seg.cfg
    zfirst = zero.groupBy("employer_id", "cohort_week").agg(F.min(week_of("created")).alias("_zw"))
    pay = family_payments(src, seg, employers=seg.employers.join(zfirst.select("employer_id"),
                                                                  "employer_id", "left_semi"))
    pfirst = pay.groupBy(F.col("user_id").alias("employer_id")).agg(F.min("pay_week").alias("_pw"))
    first = zfirst.join(pfirst, "employer_id").where("_zw is not null and _pw is not null").select(
        "cohort_week", F.greatest("_zw", "_pw").alias("first_week"))
    return cumulative_distinct(first, cfg, "cum_purchasing_eps_who_reached_0_credits")
