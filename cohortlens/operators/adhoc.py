"""Reconciliation queries (T1-T6) and the experiment-arm lookup.

The reference runs these by hand for one literal week; here the week is
a parameter and ``None`` reports every week, so the same query covers
all cohorts in one distributed pass.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import config as C
from cohortlens.functions.predicates import like_all_not, like_any, organic_group
from cohortlens.functions.weeks import week_of
from cohortlens.operators.balance import running_balance
from cohortlens.operators.scan import keyed_scan
from cohortlens.operators.segments import exclude_holders, small_side
from cohortlens.plans.joins import broadcast_if_small
from cohortlens.sources.fixtures import Sources


def experiment_arms(src: Sources) -> DataFrame:
    """Subscription events and subscribers per experiment arm (product, test_id).

    Events of unmapped arms are not reported.
    """
    arms = broadcast_if_small(src.arms.select("product", "test_id"))
    return (src.subscriptions.join(arms, "test_id")
            .groupBy("product", "test_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("subscription_events"),
                 F.count_distinct("user_id").cast("bigint").alias("subscribers")))


def cohort_size(src: Sources, cohort_week: dt.date | None = None) -> DataFrame:
    """Distinct premium employers per cohort week (no e-mail or arm filter)."""
    emp = src.employers.where(
        F.col("country").like(C.COUNTRY_A) & F.col("city").like(C.CITY_A)
        & organic_group(C.ORGANIC_CHANNELS, C.ORGANIC_SUB_CHANNEL)
        & F.col("registration_sub_channel").like(C.PLATFORM) & (F.col("good_employer") == 1))
    if cohort_week is not None:
        emp = emp.where((F.col("registration_date") >= F.lit(cohort_week))
                        & (F.col("registration_date") < F.lit(cohort_week + dt.timedelta(days=7))))
    emp = small_side(exclude_holders(emp.select("employer_id", "registration_date"), src.holders), "t1")
    subs = src.subscriptions.where(~F.col("name").like(C.FREE_TIER)).select(
        F.col("user_id").alias("employer_id"))
    seg = subs.join(emp, "employer_id")
    return seg.groupBy(week_of("registration_date").alias("cohort_week")).agg(
        F.count_distinct("employer_id").cast("bigint").alias("cohort_size"))


def internal_accounts(src: Sources, registered_from: dt.date, cohort_until: dt.date) -> DataFrame:
    """Credit holders with an internal e-mail (first internal pattern)."""
    emp = src.employers.where(
        F.col("country").like(C.COUNTRY_A) & F.col("registration_sub_channel").like(C.PLATFORM)
        & (F.col("registration_date") >= F.lit(registered_from))
        & (F.col("registration_date") < F.lit(cohort_until + dt.timedelta(days=7)))
        & F.col("email").like(C.INTERNAL_EMAIL_PATTERNS[0]))
    held = emp.join(src.holders, F.col("employer_id") == F.col("user_id"))
    return held.select(*src.employers.columns, "user_id", week_of("registration_date").alias("cohort_week"))


def internal_payments(src: Sources) -> DataFrame:
    """Credit payments of internal accounts, numbered per user by (created, id)."""
    cat = broadcast_if_small(src.purchases.where(F.col("sku").like(C.SKU_FAMILY)).select(
        F.col("id").alias("purchase_id"), "sku"))
    emp = small_side(src.employers.where(F.col("email").like(C.INTERNAL_EMAIL_PATTERNS[0])), "t3")
    pay = src.payments.select("id", "user_id", "purchase_id", "created").join(cat, "purchase_id")
    pay = pay.join(emp, F.col("user_id") == F.col("employer_id"))
    return keyed_scan(pay, "user_id", ["created", "id"], "pur_order")


def chat_ratio(src: Sources, week: dt.date | None = None) -> DataFrame:
    """T4: per week, employers who registered and posted a good listing that week,
    and how many of them sent messages that same week."""
    emp = src.employers.where(
        F.col("country").like(C.COUNTRY_A) & (F.col("good_employer") == 1)
        & F.col("city").like(C.CITY_A) & F.col("registration_sub_channel").like(C.PLATFORM)
        & F.col("acquisition_channel").isin(list(C.ORGANIC_CHANNELS)))
    if week is not None:
        emp = emp.where((F.col("registration_date") >= F.lit(week))
                        & (F.col("registration_date") < F.lit(week + dt.timedelta(days=7))))
    emp = emp.select("employer_id", week_of("registration_date").alias("week"))
    jobs = src.jobs.where(F.col("good_job") == 1).select(
        F.col("employer_id").alias("_je"), week_of("job_posted_date").alias("_jw"))
    pub = small_side(emp.join(jobs, (emp["employer_id"] == jobs["_je"]) & (emp["week"] == jobs["_jw"]),
                              "left_semi"), "t4")
    # the chat fact joins the small published set by broadcast, then de-duplicates
    chats = src.chats.where(F.col("employer_messages") > 0).select(
        "employer_id", week_of("message_date").alias("week"))
    chatting = chats.join(pub, ["employer_id", "week"]).select("employer_id", "week").distinct()
    flagged = pub.join(chatting.withColumn("_chat", F.lit(True)), ["employer_id", "week"], "left")
    return flagged.groupBy("week").agg(
        F.count_distinct("employer_id").cast("bigint").alias("published_eps"),
        F.count_distinct(F.when(F.col("_chat"), F.col("employer_id"))).cast("bigint").alias("chatting_eps"))


def balance_ledger(src: Sources) -> DataFrame:
    """T5: the running balance, sorted by user, time and id (NULLs last) in the ranges that the scan has made."""
    return running_balance(src.ledger, ordered_by=["id"])


def pack_buyers(src: Sources, cohort_from: dt.date) -> DataFrame:
    """Market-B credit holders who bought a family SKU containing '3' or '2'."""
    emp = src.employers.where(
        F.col("country").like(C.COUNTRY_B) & like_all_not("email", C.INTERNAL_EMAIL_PATTERNS)
        & (F.col("registration_date") >= F.lit(cohort_from))).select("employer_id")
    emp = small_side(emp.join(src.holders.select(F.col("user_id").alias("employer_id")), "employer_id",
                              "left_semi"), "t6")
    cat = broadcast_if_small(src.purchases.where(
        F.col("sku").like(C.SKU_FAMILY) & like_any("sku", C.ADHOC_PACK_DIGITS)).select(
        F.col("id").alias("purchase_id"), "sku"))
    pay = src.payments.select(F.col("user_id").alias("employer_id"), "purchase_id").join(cat, "purchase_id")
    return pay.join(emp, "employer_id").select("employer_id", "sku").distinct()
