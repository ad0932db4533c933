"""Invariants of the reports on sf0.01 and the T1 reconciliation."""

import datetime as dt
from dataclasses import replace

import pytest

import __spark_entry__ as E
from cohortlens import config as C
from cohortlens.operators import funnel
from cohortlens.operators.segments import build_segment
from cohortlens.sources.fixtures import load_sources
from tests.conftest import SF001


@pytest.fixture(scope="module")
def paid(spark):
    return E.queries()["report_paid_uk"](spark, SF001).collect()


@pytest.fixture(scope="module")
def premium(spark):
    return E.queries()["report_premium_uk"](spark, SF001).collect()


def _series(rows, col):
    out = {}
    for r in rows:
        out.setdefault(r.cohort_week, []).append((r.activity_week, getattr(r, col)))
    return {k: [v for _, v in sorted(s)] for k, s in out.items()}


@pytest.mark.parametrize("col", ["cum_publ_ep_who_chat", "cum_eps_who_reached_0_credits", "cum_unique_rep_purchasers"])
def test_cumulative_non_decreasing(paid, col):
    for cohort, vals in _series(paid, col).items():
        seen = None
        for v in vals:
            if seen is not None:
                assert v is not None and v >= seen, (cohort, col, vals)
            if v is not None:
                seen = v


def test_first_purchasers_bounded_by_purchasers(paid):
    for r in paid:
        if r.unique_purchasing_eps is not None:
            assert r.purchasing_eps is not None and r.unique_purchasing_eps <= r.purchasing_eps
        if r.orders is not None:
            assert r.orders >= r.purchasing_eps


def test_sessions_at_least_chatting_employers(paid, premium):
    for r in paid + premium:
        if r.publ_ep_who_chat is not None:
            assert r.ep_chat_sessions >= r.publ_ep_who_chat
            assert r.ep_chat_messages_sent >= r.ep_chat_sessions


def test_grain(paid, premium):
    for rows, cfg in ((paid, C.PAID_A), (premium, C.PREMIUM)):
        assert all(r.activity_week >= r.cohort_week for r in rows)
        assert all(cfg.spine_start <= r.activity_week <= cfg.last_week for r in rows)
        keys = {(r.cohort_week, r.activity_week) for r in rows}
        assert len(rows) >= len(keys)


def test_cohort_size_reconciles_with_registrations(spark):
    """T1 equals M8 of a premium segment with the same filters (no e-mail or arm filter)."""
    src = load_sources(spark, SF001)
    size = {r.cohort_week: r.cohort_size for r in E.queries()["adhoc_cohort_size"](spark, SF001).collect()}
    rules = replace(C.SEG_PREMIUM, internal_emails=(), arms=())
    cfg = C.PREMIUM.with_(segment=rules, cohort_from=dt.date(2016, 11, 28))
    regs = {r.cohort_week: r.registrations for r in funnel.registrations(build_segment(src, cfg)).collect()}
    assert size == regs and len(size) > 0
