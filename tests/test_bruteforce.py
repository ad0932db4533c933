"""Rewrites checked against brute force on random inputs (no SQL engine involved)."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from cohortlens import config as C
from cohortlens.functions.weeks import weeks_after
from cohortlens.operators.cumulative import cumulative_distinct, weekly_distinct

MON = dt.date(2016, 11, 28)


def _week(d: dt.date) -> dt.date:
    return d - dt.timedelta(days=d.weekday())


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_cumulative_matches_theta_join(spark, seed):
    rnd = random.Random(seed)
    cfg = C.PAID_A.with_(spine_start=MON + dt.timedelta(weeks=2), spine_end=MON + dt.timedelta(weeks=9, days=3),
                         cohort_from=MON)
    events = []
    for entity in range(300):
        cohort = MON + dt.timedelta(weeks=rnd.randrange(0, 12))
        for _ in range(rnd.randrange(1, 4)):
            events.append((cohort, entity, _week(cohort + dt.timedelta(days=rnd.randrange(-21, 90)))))
    df = spark.createDataFrame(events, "cohort_week date, entity bigint, ev_week date")
    first = df.groupBy("cohort_week", "entity").agg({"ev_week": "min"}).withColumnRenamed("min(ev_week)", "first_week")
    got = {(r.cohort_week, r.activity_week): r.n for r in cumulative_distinct(first, cfg, "n").collect()}
    spine = [cfg.spine_start + dt.timedelta(weeks=i) for i in range(cfg.n_weeks)]
    exp = {}
    for aw in spine:  # the reference's theta join: event week <= activity week, activity week >= cohort
        hits = {}
        for cohort, entity, wk in events:
            if wk <= aw and aw >= cohort:
                hits.setdefault(cohort, set()).add(entity)
        for cohort, ents in hits.items():
            exp[(cohort, aw)] = len(ents)
    assert got == exp and len(got) > 10


def test_weekly_distinct_matches_brute_force(spark):
    rnd = random.Random(7)
    cfg = C.PAID_A.with_(spine_start=MON + dt.timedelta(weeks=1), spine_end=MON + dt.timedelta(weeks=8),
                         cohort_from=MON)
    rows = [(MON + dt.timedelta(weeks=rnd.randrange(0, 10)), rnd.randrange(0, 50),
             MON + dt.timedelta(weeks=rnd.randrange(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "cohort_week date, entity bigint, wk date")
    got = {(r.cohort_week, r.activity_week): r.n for r in weekly_distinct(df, "wk", "entity", cfg, "n").collect()}
    exp = {}
    for cohort, entity, wk in rows:
        if cfg.spine_start <= wk <= cfg.last_week and wk >= cohort:
            exp.setdefault((cohort, wk), set()).add(entity)
    assert got == {k: len(v) for k, v in exp.items()}


def test_weeks_after_matches_python_calendar(spark):
    rnd = random.Random(11)
    base = dt.date(2014, 1, 1)
    pairs = [(base + dt.timedelta(days=rnd.randrange(0, 4000)), base + dt.timedelta(days=rnd.randrange(0, 4000)))
             for _ in range(5000)]
    df = spark.createDataFrame(pairs, "r date, a date")
    got = [row.w for row in df.select(weeks_after(F.col("a"), F.year("r"), F.weekofyear("r")).alias("w")).collect()]
    exp = [(a.year - r.year) * 52 + a.isocalendar()[1] - r.isocalendar()[1] for r, a in pairs]
    assert got == exp
