"""Distinct counts and membership filters from bitmaps are exact."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import config as C
from cohortlens.operators import bitmaps, segments
from cohortlens.operators.cumulative import cumulative_distinct, first_event_weeks, weekly_distinct
from cohortlens.plans import joins
from tests.helpers import D

CFG = C.PAID_A


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(5)
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, 2**40, -(2**40), *range(100, 130)]
    rows = []
    for _ in range(600):
        cohort = D(2016, 12, 5) + dt.timedelta(days=7 * int(rng.integers(0, 4)))
        week = None if rng.integers(0, 25) == 0 else D(2016, 11, 21) + dt.timedelta(days=7 * int(rng.integers(0, 14)))
        rows.append((cohort, week, None if rng.integers(0, 20) == 0 else ids[rng.integers(0, len(ids))], int(rng.integers(0, 90))))
    return spark.createDataFrame(rows, "cohort_week date, wk date, a bigint, b int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_weekly_counts_equal_count_distinct_without_expand(events):
    parts = bitmaps.partials(events, "wk", {"x": "a", "y": "b"})
    got = bitmaps.counts(bitmaps.on_grid(parts, CFG), ["x", "y"])
    want = weekly_distinct(events, "wk", "a", CFG, "x", extra={"y": F.count_distinct("b").cast("bigint")})
    assert rows(got) == rows(want)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in want._jdf.queryExecution().executedPlan().toString()


def test_folded_weeks_equal_cumulative_counts(events):
    parts = bitmaps.partials(events.where("a is not null"), "wk", {"x": "a"})
    # in two batches, as a weekly refresh would leave them
    some = F.pmod(F.col("b"), F.lit(2)) == 0
    two = [bitmaps.partials(events.where("a is not null").where(c), "wk", {"x": "a"}) for c in (some, ~some)]
    want = cumulative_distinct(first_event_weeks(events.where("a is not null"), "wk", "a"), CFG, "x")
    assert rows(bitmaps.counts(bitmaps.so_far(parts, CFG), ["x"])) == rows(want)
    assert rows(bitmaps.counts(bitmaps.so_far(bitmaps.merged(two[0].unionByName(two[1])), CFG), ["x"])) == rows(want)


@pytest.mark.parametrize("weeks", [1, 4])
def test_windows_of_weeks(events, weeks):
    parts = bitmaps.partials(events, "wk", {"x": "a"})
    got = {(r[0], r[1]): r[2] for r in rows(bitmaps.counts(bitmaps.over(parts, weeks, CFG), ["x"]))}
    seen = {}
    for cohort, week, a, _ in events.collect():
        for i in range(weeks if week and a is not None else 0):
            end = week + dt.timedelta(days=7 * i)
            if CFG.spine_start <= end <= CFG.last_week and end >= cohort:
                seen.setdefault((cohort, end), set()).add(a)
    assert got == {k: len(v) for k, v in seen.items()}
    with pytest.raises(ValueError):
        bitmaps.over(parts, 0, CFG)


def test_filter_passes_every_member_and_few_others(spark, monkeypatch):
    members = spark.range(0, 3000).select((F.col("id") * 7 - 900).alias("m")).unionByName(spark.createDataFrame([(None,)], "m bigint"))
    asked = spark.range(-1000, 30000).withColumn("x", F.lit(1)).unionByName(spark.createDataFrame([(None, 1)], "id bigint, x int"))
    for bits, most in ((1 << 27, 40), (1 << 17, 1500)):
        monkeypatch.setattr(bitmaps, "FILTER_BITS", bits)
        got = {r["id"] for r in bitmaps.likely_members(asked, "id", bitmaps.member_filter(members, "m")).collect()}
        true = {i * 7 - 900 for i in range(3000)}
        assert true <= got and len(got - true) <= most and None not in got


def test_not_in_beyond_the_broadcast_bound_shuffles_few_holders(spark, monkeypatch):
    """With the bound at 0 the holders are cut by the candidates' filter before the shuffle."""
    seen = []
    real = segments.materialize

    def spy(df, name="stage"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(segments, "materialize", spy)
    left = spark.createDataFrame([(1,), (2,), (3,), (None,)], "employer_id bigint")
    holders = spark.range(0, 5000).selectExpr("id * 2 as user_id")
    want = [r[0] for r in segments.exclude_holders(left, holders).collect()]
    seen.clear()
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [r[0] for r in segments.exclude_holders(left, holders).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == sorted(want) == [1, 3]
    plans = dict(seen)
    assert "_bits" in plans["likely_holders"] and "hashpartitioning" not in plans["likely_holders"]
    assert "SortMergeJoin" in plans["matched_holders"] and "Range (0, 5000" not in plans["matched_holders"]


@pytest.mark.parametrize("key", ["published", "chat_pairs", "orders_weekly", "cum_zero_credit"])
def test_facts_are_cut_before_the_shuffle_beyond_the_bound(spark, monkeypatch, key):
    """A segment too large to broadcast: the same result, and the fact passes its filter below any exchange."""
    from cohortlens.operators import scan
    from cohortlens.plans import catalog
    from tests.conftest import SF0001

    want = rows(catalog.queries()[key](spark, SF0001))
    plans = []
    for module in (segments, scan):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, name="stage", real=real: plans.append(
            df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()[key](spark, SF0001)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        got = rows(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and got
    cut = [p for p in plans if "_bits" in p and "SortMergeJoin" in p]
    assert cut and all(p.index("Exchange") < p.index("_bits") for p in cut)
