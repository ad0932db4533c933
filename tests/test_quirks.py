"""Literal semantics of the reference that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens import config as C
from cohortlens.operators import balance, funnel, orders
from cohortlens.operators.segments import build_segment
from cohortlens.plans import report
from tests.helpers import D, employer, make_sources

CFG = C.PAID_A


def test_null_holder_empties_not_in(spark):
    emps = [employer(1, D(2016, 12, 6), country="ES", channel="Organic"),
            employer(2, D(2016, 12, 7), country="ES", channel="Organic")]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,), (None,)])
    assert build_segment(src, C.FREE_B).employers.count() == 0
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,)])
    assert [r.employer_id for r in build_segment(src, C.FREE_B).employers.collect()] == [2]
    src = make_sources(spark, employers_dim=emps, user_balance=[])
    assert build_segment(src, C.FREE_B).employers.count() == 2


def test_not_like_drops_null_channel(spark):
    emps = [employer(1, D(2016, 12, 6), country="ES", channel=None),
            employer(2, D(2016, 12, 7), country="ES", channel="Sales"),
            employer(3, D(2016, 12, 7), country="ES", channel="Paid")]
    src = make_sources(spark, employers_dim=emps)
    assert [r.employer_id for r in build_segment(src, C.FREE_B).employers.collect()] == [3]


def test_range_frame_ties_hide_zero(spark):
    ledger = [(1, 7, 5, D(2017, 1, 2)), (2, 7, -5, D(2017, 1, 3)), (3, 7, 7, D(2017, 1, 3))]
    src = make_sources(spark, user_balance_history=ledger)
    got = {r.id: r.balance for r in balance.running_balance(src.ledger).collect()}
    assert got == {1: 5, 2: 7, 3: 7}


@pytest.mark.parametrize("reg,activity,expected", [
    (D(2016, 12, 31), D(2017, 1, 2), 1),      # calendar 2016, ISO week 52
    (D(2017, 1, 1), D(2017, 1, 2), -51),      # calendar 2017, ISO week 52 of 2016
    (D(2020, 12, 28), D(2021, 1, 4), 0),      # after a 53-week year
    (D(2024, 12, 23), D(2024, 12, 30), -51),  # ISO year 2025 inside calendar 2024
])
def test_weeks_after_is_literal(spark, reg, activity, expected):
    from cohortlens.functions.weeks import weeks_after
    row = spark.createDataFrame([(reg, activity)], "r date, a date").select(
        weeks_after(F.col("a"), F.year("r"), F.weekofyear("r")).alias("w")).first()
    assert row.w == expected


def test_year_straddling_cohort_gets_two_rows(spark):
    emps = [employer(1, D(2016, 12, 31)), employer(2, D(2017, 1, 1))]
    cfg = C.FREE_A.with_(spine_start=D(2016, 12, 26), spine_end=D(2017, 1, 9), cohort_from=D(2016, 12, 26),
                         cohort_to=D(2016, 12, 26))
    src = make_sources(spark, employers_dim=emps)
    rep = report.report_free(src, cfg).collect()
    per_week = {}
    for r in rep:
        per_week.setdefault(r.activity_week, set()).add(r.weeks_after)
    assert per_week[D(2017, 1, 2)] == {1, -51}
    assert len(rep) == 6  # 3 weeks x 2 weeks_after values
    assert all(r.registrations == 2 for r in rep)


def test_equal_counts_of_one_pack_collapse(spark):
    emps = [employer(1, D(2016, 12, 5)), employer(2, D(2016, 12, 5))]
    pays = [(10, 1, 0, D(2016, 12, 13)), (11, 2, 1, D(2016, 12, 14))]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,), (2,)], payment=pays)
    seg = build_segment(src, CFG)
    pay = orders.family_payments(src, seg)
    raw = orders.pack_orders_raw(pay, CFG).collect()
    assert len(raw) == 1 and raw[0].pack_1_orders == 1
    assert orders.pack_orders_pivot(pay, CFG).first().pack_1_orders == 1
    assert orders.orders_weekly(pay, CFG).first().total_orders == 2


def test_equal_daily_message_counts_collapse(spark):
    emps = [employer(1, D(2016, 12, 5))]
    jobs = [(100, 1, D(2016, 12, 6), 1)]
    chats = [(1, 55, D(2016, 12, 12), 3), (1, 55, D(2016, 12, 13), 3), (1, 56, D(2016, 12, 13), 0)]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,)], jobs_dim=jobs, chats_activity=chats)
    seg = build_segment(src, CFG)
    ev = funnel.chat_events(src, seg)
    assert funnel.chat_messages(ev).first().ep_chats_sent == 3
    assert funnel.chat_sessions(ev).first().ep_chat_sessions == 1
    pair = funnel.chat_pair_weeks(ev).collect()
    assert [r._msgs for r in pair] == [3]


def test_chat_gate_needs_listing_in_registration_week(spark):
    emps = [employer(1, D(2016, 12, 5)), employer(2, D(2016, 12, 5))]
    jobs = [(100, 1, D(2016, 12, 6), 1), (101, 2, D(2016, 12, 14), 1)]
    chats = [(1, 55, D(2017, 1, 3), 2), (2, 56, D(2016, 12, 20), 4)]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,), (2,)], jobs_dim=jobs, chats_activity=chats)
    seg = build_segment(src, CFG)
    assert [r.employer_id for r in funnel.gated_employers(src, seg).collect()] == [1]


def test_no_activity_row_is_present_with_nulls(spark):
    emps = [employer(1, D(2016, 12, 5))]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,)])
    rep = report.report_paid(src, CFG).collect()
    assert len(rep) == CFG.n_weeks
    r = rep[0]
    assert r.registrations == 1
    assert all(getattr(r, c) is None for c in rep[0].asDict() if c not in
               ("cohort_week", "activity_week", "weeks_after", "registrations"))


def test_cumulative_counts_events_before_spine_and_nulls_before_first(spark):
    emps = [employer(1, D(2016, 11, 28)), employer(2, D(2016, 12, 5))]
    cfg = CFG.with_(cohort_from=D(2016, 11, 28))
    jobs = [(100, 1, D(2016, 11, 29), 1), (101, 2, D(2016, 12, 6), 1)]
    chats = [(1, 55, D(2016, 11, 30), 2), (2, 56, D(2016, 12, 20), 1)]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,), (2,)], jobs_dim=jobs, chats_activity=chats)
    seg = build_segment(src, cfg)
    cum = {(r.cohort_week, r.activity_week): r.cum_publ_ep_who_chat
           for r in funnel.cum_publ_who_chat(funnel.chat_events(src, seg), cfg).collect()}
    assert cum[(D(2016, 11, 28), D(2016, 12, 5))] == 1       # chat before the spine still counts
    assert (D(2016, 12, 5), D(2016, 12, 12)) not in cum      # NULL before the first chat
    assert cum[(D(2016, 12, 5), D(2016, 12, 19))] == 1
    assert cum[(D(2016, 12, 5), D(2017, 2, 13))] == 1


def test_spine_end_not_monday():
    cfg = C.PAID_A.with_(spine_start=D(2017, 2, 27), spine_end=D(2017, 4, 4), cohort_from=D(2017, 2, 27))
    assert cfg.last_week == D(2017, 4, 3)
    assert cfg.n_weeks == 6
    with pytest.raises(ValueError):
        C.PAID_A.with_(spine_start=D(2017, 2, 28))


def test_rank_modes_differ_within_a_week(spark):
    emps = [employer(1, D(2016, 12, 5))]
    # ids out of time order inside one week
    pays = [(20, 1, 0, D(2016, 12, 12)), (10, 1, 2, D(2016, 12, 14))]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,)], payment=pays)
    a = build_segment(src, C.PAID_A)
    week = {r.id: r.pur_order for r in orders.ranked_payments(orders.family_payments(src, a), C.PAID_A).collect()}
    assert week == {10: 1, 20: 2}
    ts_cfg = C.PAID_A.with_(rank_mode="timestamp")
    b = build_segment(src, ts_cfg)
    ts = {r.id: r.pur_order for r in orders.ranked_payments(orders.family_payments(src, b), ts_cfg).collect()}
    assert ts == {20: 1, 10: 2}
    assert [r.id for r in orders.first_payments(orders.family_payments(src, b), ts_cfg).collect()] == [20]
    assert [r.id for r in orders.first_payments(orders.family_payments(src, a), C.PAID_A).collect()] == [10]


def test_week_without_first_purchase_is_null_not_zero(spark):
    emps = [employer(1, D(2016, 12, 5))]
    pays = [(10, 1, 0, D(2016, 12, 6)), (11, 1, 2, D(2016, 12, 20))]
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,)], payment=pays)
    rows = {r.activity_week: r for r in report.report_paid(src, CFG).collect()}
    assert rows[D(2016, 12, 5)].unique_purchasing_eps == 1
    r = rows[D(2016, 12, 19)]
    assert (r.purchasing_eps, r.orders, r.unique_purchasing_eps) == (1, 1, None)
    assert r.cum_unique_rep_purchasers == 1 and r.pack_2_orders == 1 and r.pack_1_orders is None
    assert rows[D(2016, 12, 12)].purchasing_eps is None


def test_repeat_week_from_week_counts(spark):
    """First repeat payment week: the first week if it holds 2+ payments, else the second week."""
    emps = [employer(e, D(2016, 12, 5)) for e in (1, 2, 3)]
    pays = [(10, 1, 0, D(2016, 12, 6)), (11, 1, 2, D(2016, 12, 8)), (12, 1, 2, D(2017, 1, 3)),  # 2 in week 1
            (20, 2, 0, D(2016, 12, 6)), (21, 2, 4, D(2016, 12, 27)), (22, 2, 4, D(2017, 1, 10)),  # 1 in week 1
            (30, 3, 0, D(2016, 12, 7))]                                                          # no repeat
    src = make_sources(spark, employers_dim=emps, user_balance=[(1,), (2,), (3,)], payment=pays)
    seg = build_segment(src, CFG)
    got = {r.user_id: r.first_week for r in orders.repeat_weeks(orders.family_payments(src, seg)).collect()}
    assert got == {1: D(2016, 12, 5), 2: D(2016, 12, 26)}
    ranked = orders.ranked_family_payments(orders.family_payments(src, seg), CFG)
    exp = {}
    for r in ranked.where("pur_order > 1").collect():
        exp[r.user_id] = min(exp.get(r.user_id, r.pay_week), r.pay_week)
    assert got == exp


def _device_segment(spark, links, devices, emps=(1, 2, 3), types=(3,)):
    from dataclasses import replace

    cfg = C.FREE_A.with_(segment=replace(C.SEG_FREE_A, excluded_device_types=types))
    src = make_sources(spark, employers_dim=[employer(e, D(2016, 12, 6)) for e in emps],
                       refs_devices_users=links, devices=devices)
    return sorted((r.employer_id for r in build_segment(src, cfg).employers.collect()), key=str)


def test_device_exclusion_and_its_null_rules(spark):
    devices = [(10, 3), (11, 1), (12, 4), (13, None), (None, 3)]
    # 1 uses an excluded device, 2 another one, 3 one that is not in the table
    links = [(1, 10), (1, 11), (2, 11), (2, 13), (3, 99), (3, None)]
    assert _device_segment(spark, links, devices) == [2, 3]
    assert _device_segment(spark, links, devices, types=(1, 4)) == [3]
    # a NULL user of an excluded device empties the result; of another device it does not
    assert _device_segment(spark, [*links, (None, 10)], devices) == []
    assert _device_segment(spark, [*links, (None, 11)], devices) == [2, 3]
    # a NULL employer is kept only if the list is empty
    assert _device_segment(spark, links, devices, emps=(2, None)) == [2]
    assert _device_segment(spark, [(2, 11)], devices, emps=(2, None)) == [2, None]
    assert _device_segment(spark, [], [], emps=(1, 2)) == [1, 2]


def test_device_exclusion_needs_its_tables(spark):
    from dataclasses import replace

    src = replace(make_sources(spark, employers_dim=[employer(1, D(2016, 12, 6))]), devices=None)
    with pytest.raises(ValueError, match="refs_devices_users"):
        build_segment(src, C.PREMIUM_DEVICES)
