"""Reports and balances kept up to date: equal to full runs, without reading old weeks again."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import config as C
from cohortlens.operators import balance
from cohortlens.operators.snapshots import BalanceState
from cohortlens.plans import report
from cohortlens.plans.refresh import WeeklyState, in_weeks
from cohortlens.sources.fixtures import load_sources
from cohortlens.sources.store import Store
from tests.conftest import SF0001
from tests.helpers import D, employer, make_sources

WEEK = dt.timedelta(days=7)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ledger_of(spark, rows_, kind="int"):
    return spark.createDataFrame(rows_, f"id bigint, user_id bigint, balance_change {kind}, created date")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_balances_equal_a_full_scan_under_random_late_rows(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    all_, state = [], BalanceState(spark, f"{tmp_path}/b")
    for batch in range(4):
        start = D(2017, 1, 2) + dt.timedelta(days=10 * batch)
        new = []
        for _ in range(60):
            user = None if rng.integers(0, 15) == 0 else int(rng.integers(0, 9))
            day = start + dt.timedelta(days=int(rng.integers(0, 10)))
            if rng.integers(0, 6) == 0:  # late, tied with what is there, or undated
                day = None if rng.integers(0, 4) == 0 else start - dt.timedelta(days=int(rng.integers(0, 12)))
            change = None if rng.integers(0, 12) == 0 else int(rng.integers(-3, 4))
            new.append((len(all_) + len(new), user, change, day))
        new += new[:2]  # repeated rows
        all_ += new
        assert state.apply(ledger_of(spark, new), f"b{batch}")
        full = balance.running_balance(ledger_of(spark, all_))
        assert rows(state.balances()) == rows(full.select(*state.balances().columns))
        zero = full.where("balance = 0 and created is not null")
        want = zero.select("user_id", F.trunc("created", "week").alias("week")).distinct()
        assert rows(state.zero_weeks()) == rows(want)


def test_a_batch_is_applied_once_and_a_broken_one_again(spark, tmp_path):
    state = BalanceState(spark, f"{tmp_path}/b")
    one = ledger_of(spark, [(1, 1, 5, D(2017, 1, 2))])
    assert state.apply(one, "a") and not state.apply(one, "a")
    # a batch that wrote its tables but no commit record does not count, and is written over
    for table in ("ledger", "closing", "zeros"):
        (spark.read.parquet(f"{state.store.root}/{table}/batch=a").write.parquet(f"{state.store.root}/{table}/batch=b"))
    assert rows(state.balances()) == [(1, 1, 5, D(2017, 1, 2), 5)]
    assert state.apply(ledger_of(spark, [(2, 1, 2, D(2017, 1, 3))]), "b")
    assert [r[-1] for r in rows(state.balances())] == [5, 7]


def test_rows_of_earlier_batches_are_not_added_again(spark, tmp_path):
    state = BalanceState(spark, f"{tmp_path}/b")
    one = [(1, 1, 5, D(2017, 1, 2)), (2, 1, -5, D(2017, 1, 9)), (3, None, 1, D(2017, 1, 9)), (4, 2, 1, None)]
    state.apply(ledger_of(spark, one), "a")
    late = [(5, 1, 2, D(2017, 1, 3)), (6, 9, 1, D(2017, 1, 9)), (6, 9, 1, D(2017, 1, 9))]
    state.apply(ledger_of(spark, [*one[1:], *late]), "b", skip_known=True)
    assert rows(state.balances()) == rows(balance.running_balance(ledger_of(spark, one + late)).select(*state.balances().columns))


def test_new_rows_do_not_read_the_old_ledger(spark, tmp_path, monkeypatch):
    state = BalanceState(spark, f"{tmp_path}/b")
    state.apply(ledger_of(spark, [(i, i % 3, 1, D(2017, 1, 2)) for i in range(9)]), "a")
    read = []
    whole = Store.read
    monkeypatch.setattr(Store, "read", lambda self, table, *a: read.append(table) or whole(self, table, *a))
    state.apply(ledger_of(spark, [(20, 1, -3, D(2017, 1, 9)), (21, 7, 1, D(2016, 1, 1))]), "newer")
    assert "ledger" not in read
    state.apply(ledger_of(spark, [(30, 1, 1, D(2017, 1, 9))]), "tie")
    assert "ledger" in read
    assert {r["id"]: r["balance"] for r in state.balances().where("user_id = 1").collect()} == {
        1: 3, 4: 3, 7: 3, 20: 1, 30: 1}


def test_decimals_keep_their_type(spark, tmp_path):
    from decimal import Decimal

    state = BalanceState(spark, f"{tmp_path}/b")
    for i in range(4):
        state.apply(ledger_of(spark, [(i, 1, Decimal("0.10"), D(2017, 1, 2 + i))], "decimal(10,2)"), f"b{i}")
    full = balance.running_balance(ledger_of(spark, [(i, 1, Decimal("0.10"), D(2017, 1, 2 + i)) for i in range(4)], "decimal(10,2)"))
    assert rows(state.balances()) == rows(full) and state.balances().schema["balance"].dataType == full.schema["balance"].dataType


REPORTS = {"free": (report.report_free, C.FREE_A), "paid_a": (report.report_paid, C.PAID_A), "paid_b": (report.report_paid, C.PAID_B),
           "premium": (report.report_premium, C.PREMIUM)}


def _from_state(state, src, name):
    _, cfg = REPORTS[name]
    return (state.report_free if name == "free" else state.report_premium if name == "premium" else state.report_paid)(src, cfg)


def _only(src, lo, hi):
    """The sources with the facts of [lo, hi) alone."""
    cut = {"jobs": "job_posted_date", "chats": "message_date", "payments": "created"}
    return replace(src, **{k: getattr(src, k).where((F.col(c) >= F.lit(lo)) & (F.col(c) < F.lit(hi))) for k, c in cut.items()})


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """A state that never saw more than one fortnight at a time."""
    src = load_sources(spark, SF0001)
    state = WeeklyState(spark, str(tmp_path_factory.mktemp("state")))
    cut = D(2017, 1, 16)
    state.refresh(_only(src, D(2016, 1, 1), cut), "history", ledger=src.ledger.where(F.col("created") < F.lit(cut)))
    for i in range(3):
        week = cut + 2 * i * WEEK
        weeks = [week, week + WEEK]
        state.refresh(_only(src, week, week + 2 * WEEK), f"b{i}", weeks, src.ledger.where(in_weeks("created", weeks)))
    return state, src


@pytest.mark.parametrize("name", list(REPORTS))
def test_refreshed_reports_equal_full_runs(kept, name):
    state, src = kept
    full, cfg = REPORTS[name]
    assert rows(_from_state(state, src, name)) == rows(full(src, cfg))


def test_a_week_named_again_is_replaced_and_dimensions_are_live(spark, tmp_path):
    emps = [employer(1, D(2016, 12, 5)), employer(2, D(2016, 12, 6))]
    jobs = [(100, 1, D(2016, 12, 6), 1), (101, 2, D(2016, 12, 7), 1), (101, 2, D(2016, 12, 8), 1)]
    chats = [(1, 55, D(2016, 12, 13), 3), (1, 55, D(2016, 12, 14), 3), (2, 56, D(2016, 12, 13), 2), (1, None, None, 4)]
    pays = [(10, 1, 0, D(2016, 12, 13)), (11, 1, 1, D(2016, 12, 14)), (11, 1, 1, D(2016, 12, 14)), (12, 2, 2, D(2016, 12, 20))]
    ledger = [(1, 1, 1, D(2016, 12, 13)), (2, 1, -1, D(2016, 12, 20))]
    tables = dict(employers_dim=emps, user_balance=[(1,)], jobs_dim=jobs, chats_activity=chats, payment=pays,
                  user_balance_history=ledger)
    state = WeeklyState(spark, str(tmp_path))
    first = make_sources(spark, **{**tables, "chats_activity": chats[:1], "payment": pays[:1]})
    state.refresh(first, "a", ledger=first.ledger)
    src = make_sources(spark, **tables)
    # late rows of the second week, a new third week; naming a batch again changes nothing
    assert state.refresh(src, "b", [D(2016, 12, 12), D(2016, 12, 19)])
    assert not state.refresh(first, "b", [D(2016, 12, 12)])
    for cfg in (C.PAID_A, C.PAID_A.with_(rank_mode="timestamp")):
        assert rows(state.report_paid(src, cfg)) == rows(report.report_paid(src, cfg))
        # employer 2 enters the segment later, with holder rows that repeat it: its old weeks are there
        wider = make_sources(spark, **{**tables, "user_balance": [(1,), (2,), (2,)]})
        assert rows(state.report_paid(wider, cfg)) == rows(report.report_paid(wider, cfg))


def test_facts_are_read_by_pushed_week_bounds(spark, tmp_path):
    src = make_sources(spark, chats_activity=[(1, 2, D(2017, 1, 2), 1)])
    src.chats.write.parquet(f"{tmp_path}/chats")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        chats = spark.read.parquet(f"{tmp_path}/chats").where(in_weeks("message_date", [D(2017, 1, 2), D(2017, 1, 9)]))
        plan = chats._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(message_date,2017-01-02)" in pushed and "LessThan(message_date,2017-01-16)" in pushed
    with pytest.raises(ValueError, match="Monday"):
        in_weeks("message_date", [D(2017, 1, 3)])


def test_an_empty_state_gives_empty_reports(spark, tmp_path):
    src = make_sources(spark, employers_dim=[employer(1, D(2016, 12, 5))])
    got = WeeklyState(spark, str(tmp_path)).report_free(src, C.FREE_A)
    assert rows(got) == rows(report.report_free(src, C.FREE_A))
