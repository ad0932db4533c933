"""Registration funnel: weeks_after, registrations, publishing and chat metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.config import ReportConfig
from cohortlens.functions.weeks import spine_weeks_col, week_of, weeks_after
from cohortlens.operators.cumulative import cumulative_distinct, first_event_weeks, weekly_distinct
from cohortlens.operators.segments import Segment, small_side
from cohortlens.plans.joins import fits_broadcast
from cohortlens.sources.fixtures import Sources


def weeks_after_table(seg: Segment) -> DataFrame:
    """M7: distinct (cohort_week, activity_week, weeks_after) over segment x spine.

    The formula reads the raw registration date, so it is computed from
    the distinct (cohort, calendar year, ISO week) triples of the
    segment - a few per cohort - and the spine is generated per triple
    instead of cross-joining every employer with every week.
    """
    cfg = seg.cfg
    triples = seg.employers.select(
        "cohort_week", F.year("registration_date").alias("_y"),
        F.weekofyear("registration_date").alias("_w")).distinct()
    grid = triples.select("cohort_week", "_y", "_w",
                          F.explode(spine_weeks_col(cfg.spine_start, cfg.last_week)).alias("activity_week"))
    wa = weeks_after(F.col("activity_week"), F.col("_y"), F.col("_w"))
    return grid.select("cohort_week", "activity_week", wa.alias("weeks_after")).distinct()


def registrations(seg: Segment) -> DataFrame:
    """M8: distinct employers per cohort week."""
    return seg.employers.groupBy("cohort_week").agg(
        F.count_distinct("employer_id").cast("bigint").alias("registrations"))


def good_jobs(src: Sources, seg: Segment, at_segment_grain: bool = False) -> DataFrame:
    """M9: good listings of segment employers, with the employer's cohort.

    ``at_segment_grain`` joins the segment rows as they are (the premium
    segment repeats an employer once per subscription event, as the
    reference does); metrics use one row per employer.
    """
    jobs = src.jobs.where(F.col("good_job") == 1).select("job_id", "job_posted_date", "employer_id")
    side = seg.rows if at_segment_grain else seg.employers
    return seg.facts(jobs).join(side.select("employer_id", "cohort_week"), "employer_id")


def published(src: Sources, seg: Segment, jobs: DataFrame | None = None) -> DataFrame:
    """Employers publishing and listings posted, per cohort and spine week >= cohort."""
    jobs = jobs if jobs is not None else good_jobs(src, seg)
    ev = jobs.withColumn("_wk", week_of("job_posted_date"))
    return weekly_distinct(ev, "_wk", "employer_id", seg.cfg, "published_ep",
                           extra={"listings": F.count_distinct("job_id").cast("bigint")})


def gated_employers(src: Sources, seg: Segment, jobs: DataFrame | None = None) -> DataFrame:
    """Employers with a good listing posted in their registration week.

    The reference joins every listing with every chat row of the employer
    and de-duplicates afterwards; only existence matters.  The listings
    join the segment (broadcast) on employer and week, the few distinct
    employers left are written, and the chat fact can join them by
    broadcast.  ``jobs``: the segment's good listings, if written already.
    """
    jobs = jobs if jobs is not None else good_jobs(src, seg)
    gated = (jobs.where(week_of("job_posted_date") == F.col("cohort_week"))
             .select("employer_id", "cohort_week").distinct())
    return small_side(gated, "gated")


def chat_events(src: Sources, seg: Segment, gated: DataFrame | None = None) -> DataFrame:
    """Chat rows with messages of gated employers: cohort, week, employer, jobseeker, messages."""
    gated = gated if gated is not None else gated_employers(src, seg)
    chats = src.chats.where(F.col("employer_messages") > 0).select(
        "employer_id", "jobseeker_id", week_of("message_date").alias("chat_week"), "employer_messages")
    chats = chats if fits_broadcast(gated) else seg.facts(chats)
    return chats.join(gated, "employer_id")


def chat_pairs(events: DataFrame) -> DataFrame:
    """Distinct (cohort, chat week, employer, jobseeker)."""
    return events.select("cohort_week", "chat_week", "employer_id", "jobseeker_id").distinct()


def chat_sessions(events: DataFrame) -> DataFrame:
    """Chat sessions = distinct pairs per cohort and chat week."""
    return chat_pairs(events).groupBy("cohort_week", "chat_week").agg(
        F.count(F.lit(1)).cast("bigint").alias("ep_chat_sessions"))


def chat_message_rows(events: DataFrame) -> DataFrame:
    """Distinct (cohort, week, employer, jobseeker, messages): equal daily counts collapse."""
    return events.select("cohort_week", "chat_week", "employer_id", "jobseeker_id",
                         "employer_messages").distinct()


def chat_messages(events: DataFrame) -> DataFrame:
    """Sum of M13 per cohort and chat week."""
    return chat_message_rows(events).groupBy("cohort_week", "chat_week").agg(
        F.sum("employer_messages").cast("bigint").alias("ep_chats_sent"))


def chat_pair_weeks(events: DataFrame) -> DataFrame:
    """One row per (cohort, employer, jobseeker, chat week) with the M13 message total.

    Summing the distinct daily counts of a pair-week reproduces the
    reference's DISTINCT-then-sum (Q4).  Every chat metric of a report is
    derived from this table, so the chat fact is scanned once.
    """
    return events.groupBy("cohort_week", "chat_week", "employer_id", "jobseeker_id").agg(
        F.sum_distinct("employer_messages").alias("_msgs"))


def publ_who_chat(events: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Gated employers who sent messages in the activity week."""
    return weekly_distinct(events, "chat_week", "employer_id", cfg, "publ_ep_who_chat")


def cum_publ_who_chat(events: DataFrame, cfg: ReportConfig) -> DataFrame:
    """Gated employers who sent messages in any week <= the activity week."""
    return cumulative_distinct(first_event_weeks(events, "chat_week", "employer_id"), cfg,
                               "cum_publ_ep_who_chat")
