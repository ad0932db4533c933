"""Query catalog: key -> Spark callable (spark, sf_dir) and key -> oracle SQL.

Each Spark callable builds its inputs from the tables under ``sf_dir`` and
covers the whole tables.  Most of them write intermediates (the segment,
ranged rows) under the checkpoint folder while they build the DataFrame
that they return, so a call runs Spark jobs before its result is read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import config as C
from cohortlens.operators import adhoc, balance, bitmaps, funnel, orders, subscriptions
from cohortlens.operators.segments import build_segment
from cohortlens.operators.snapshots import BalanceState
from cohortlens.plans import oracle as O
from cohortlens.plans import refresh, report
from cohortlens.session import scratch_folder
from cohortlens.sources.fixtures import load_sources

# Parameters of the ad-hoc checks on the fixture calendar.
ADHOC_REGISTERED_FROM = dt.date(2016, 12, 5)
ADHOC_COHORT_UNTIL = dt.date(2017, 1, 9)
ADHOC_BUYERS_FROM = dt.date(2016, 12, 5)

Q = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Q] = {}
_ORACLE: dict[str, Callable[[], str]] = {}


def register(key: str, sql: Callable[[], str] | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_sources(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if sql is not None:
            _ORACLE[key] = sql
        return fn
    return deco


def queries() -> dict[str, Q]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: f() for k, f in _ORACLE.items()}


def _seg(src, cfg):
    return build_segment(src, cfg)


EMP = ("employer_id", "registration_date", "cohort_week")

# ---------------------------------------------------------------- A1 / B1
@register("spine_weeks", lambda: O.with_(C.PAID_A, "select s.cohort_week, w.activity_week, "
          "cast(count(distinct s.employer_id) as bigint) as registrations from seg s cross join spine w "
          "where w.activity_week >= s.cohort_week group by 1, 2"))
def _spine_weeks(src):
    """The activity-week spine laid over the segment's cohorts (the report grid)."""
    seg = _seg(src, C.PAID_A)
    return report.cohort_grid(funnel.registrations(seg), C.PAID_A).select(
        "cohort_week", "activity_week", "registrations")


@register("experiment_arms", lambda: O.with_(C.PAID_A, "select a.product, a.test_id, cast(count(*) as bigint) "
          "as subscription_events, cast(count(distinct h.user_id) as bigint) as subscribers from "
          "user_subscriptions_history h join experiment_arms a on h.test_id = a.test_id group by 1, 2"))
def _arms(src):
    return adhoc.experiment_arms(src)


for _key, _cfg in (("segment_uk_free", C.FREE_A), ("segment_es_free", C.FREE_B), ("segment_uk_paid", C.PAID_A),
                   ("segment_es_paid", C.PAID_B)):
    register(_key, (lambda c: lambda: O.with_(c, "select employer_id, registration_date, cohort_week from seg"))(_cfg))(
        (lambda c: lambda src: _seg(src, c).rows.select(*EMP))(_cfg))


@register("segment_uk_premium", lambda: O.with_(C.PREMIUM, "select employer_id, registration_date, cohort_week, "
          "subscription_id, name, created, test_id from seg"))
def _seg_premium(src):
    return _seg(src, C.PREMIUM).rows


@register("segment_uk_premium_devices", lambda: O.with_(C.PREMIUM_DEVICES, "select employer_id, registration_date, "
          "cohort_week, subscription_id, name, created, test_id from seg"))
def _seg_premium_devices(src):
    """The premium segment without users of the excluded device types."""
    return _seg(src, C.PREMIUM_DEVICES).rows


# ---------------------------------------------------------------- B2 funnel
@register("weeks_after", lambda: O.with_(C.FREE_A, O.weeks_after_sql()))
def _weeks_after(src):
    return funnel.weeks_after_table(_seg(src, C.FREE_A))


@register("registrations", lambda: O.with_(C.PAID_A, O.registrations_sql()))
def _registrations(src):
    return funnel.registrations(_seg(src, C.PAID_A))


@register("good_jobs", lambda: O.with_(C.PAID_A, "select job_id, job_posted_date, employer_id from good_jobs"))
def _good_jobs(src):
    return funnel.good_jobs(src, _seg(src, C.PAID_A), at_segment_grain=True).select(
        "job_id", "job_posted_date", "employer_id")


@register("published", lambda: O.with_(C.PAID_A, O.published_sql()))
def _published(src):
    return funnel.published(src, _seg(src, C.PAID_A))


def _events(src, cfg=C.PAID_A):
    return funnel.chat_events(src, _seg(src, cfg))


@register("chat_pairs", lambda: O.with_(C.PAID_A, "select distinct cohort_week, chat_week, employer_id, "
          "jobseeker_id from chat_rows"))
def _chat_pairs(src):
    return funnel.chat_pairs(_events(src))


@register("chat_sessions", lambda: O.with_(C.PAID_A, O.chat_sessions_sql()))
def _chat_sessions(src):
    return funnel.chat_sessions(_events(src))


@register("chat_message_rows", lambda: O.with_(C.PAID_A, "select distinct cohort_week, chat_week, employer_id, "
          "jobseeker_id, employer_messages from chat_rows"))
def _chat_message_rows(src):
    return funnel.chat_message_rows(_events(src))


@register("chat_messages", lambda: O.with_(C.PAID_A, O.chat_messages_sql()))
def _chat_messages(src):
    return funnel.chat_messages(_events(src))


@register("publ_who_chat", lambda: O.with_(C.PAID_A, O.weekly("chat_rows", "chat_week", "employer_id",
                                                                "publ_ep_who_chat")))
def _publ_who_chat(src):
    return funnel.publ_who_chat(_events(src), C.PAID_A)


@register("cum_publ_who_chat", lambda: O.with_(C.PAID_A, O.cumulative("chat_rows", "chat_week", "employer_id",
                                                                        "cum_publ_ep_who_chat")))
def _cum_publ_who_chat(src):
    return funnel.cum_publ_who_chat(_events(src), C.PAID_A)


# ---------------------------------------------------------------- B3 orders
def _pay(src, cfg=C.PAID_A):
    return orders.family_payments(src, _seg(src, cfg))


@register("orders_weekly", lambda: O.with_(C.PAID_A, O.weekly("pay_rows", "pay_week", "user_id", "purchasing_eps",
          extra=", cast(count(distinct x.id) as bigint) as total_orders")))
def _orders_weekly(src):
    return orders.orders_weekly(_pay(src), C.PAID_A)


@register("pack_orders_raw", lambda: O.with_(C.PAID_B, O.PACKS_RAW(C.PAID_B)))
def _pack_orders_raw(src):
    return orders.pack_orders_raw(_pay(src, C.PAID_B), C.PAID_B)


@register("pack_orders_pivot", lambda: O.with_(C.PAID_B, O.summed(O.PACKS_RAW(C.PAID_B), C.PAID_B.pack_names)))
def _pack_orders_pivot(src):
    return orders.pack_orders_pivot(_pay(src, C.PAID_B), C.PAID_B)


_RANKED_SQL = ("select user_id, cohort_week as registration_week, pay_week as created_week, purchase_id, id, "
               "cast(pur_order as bigint) as pur_order from ranked_pay")


@register("ranked_payments_week", lambda: O.with_(C.PAID_A, _RANKED_SQL))
def _ranked_week(src):
    return orders.ranked_payments(_pay(src), C.PAID_A)


@register("ranked_payments_ts", lambda: O.with_(C.PAID_B, _RANKED_SQL))
def _ranked_ts(src):
    return orders.ranked_payments(_pay(src, C.PAID_B), C.PAID_B)


@register("first_purchasers", lambda: O.with_(C.PAID_A, O.weekly("ranked_pay", "pay_week", "user_id",
          "unique_purchasing_eps", where="x.pur_order = 1")))
def _first_purchasers(src):
    return orders.first_purchasers(_pay(src), C.PAID_A)


@register("cum_purchasers", lambda: O.with_(C.PAID_A, O.cumulative("pay_rows", "pay_week", "user_id",
                                                                     "cum_unique_purchasing_eps")))
def _cum_purchasers(src):
    return orders.cum_purchasers(_pay(src), C.PAID_A)


@register("first_orders_raw", lambda: O.with_(C.PAID_B, O.FIRST_RAW(C.PAID_B)))
def _first_orders_raw(src):
    return orders.first_orders_raw(_pay(src, C.PAID_B), C.PAID_B)


@register("first_orders_pivot", lambda: O.with_(C.PAID_A, O.summed(O.FIRST_RAW(C.PAID_A), C.PAID_A.first_names)))
def _first_orders_pivot(src):
    return orders.first_orders_pivot(_pay(src), C.PAID_A)


@register("repeat_orders_pivot", lambda: O.with_(C.PAID_A, O.summed(O.REPEAT_RAW(C.PAID_A), C.PAID_A.repeat_names)))
def _repeat_orders_pivot(src):
    return orders.repeat_orders_pivot(orders.ranked_family_payments(_pay(src), C.PAID_A), C.PAID_A)


@register("cum_repeat_purchasers", lambda: O.with_(C.PAID_A, O.cumulative("ranked_pay", "pay_week", "user_id",
          "cum_unique_rep_purchasers", where="x.pur_order > 1")))
def _cum_repeat(src):
    return orders.cum_repeat_purchasers(_pay(src), C.PAID_A)


# ---------------------------------------------------------------- B4 balance
@register("running_balance", lambda: O.with_(C.PAID_A, "select id, user_id, balance_change, created, "
          "cast(balance as bigint) as balance from balance"))
def _running_balance(src):
    return balance.running_balance(src.ledger)


@register("zero_credit_employers", lambda: O.with_(C.PAID_A, "select employer_id, cohort_week, id, created, "
          "cast(balance as bigint) as balance from zero"))
def _zero(src):
    return balance.zero_credit_rows(src, _seg(src, C.PAID_A))


@register("cum_zero_credit", lambda: O.with_(C.PAID_A, "select z.cohort_week, w.activity_week, "
          "cast(count(distinct z.employer_id) as bigint) as cum_eps_who_reached_0_credits from zero z cross join "
          f"spine w where w.activity_week >= z.cohort_week and w.activity_week >= {O.wk('z.created')} group by 1, 2"))
def _cum_zero(src):
    seg = _seg(src, C.PAID_A)
    return balance.cum_zero_credit(balance.zero_credit_rows(src, seg), C.PAID_A)


@register("zero_credit_payments", lambda: O.with_(C.PAID_A, O.zero_payments_sql()))
def _zero_payments(src):
    seg = _seg(src, C.PAID_A)
    return balance.zero_credit_payments(src, seg, balance.zero_credit_rows(src, seg))


@register("cum_zero_credit_purchasers", lambda: O.with_(C.PAID_A, O.cum_zero_purchasers_sql()))
def _cum_zero_purchasers(src):
    seg = _seg(src, C.PAID_A)
    return balance.cum_zero_credit_purchasers(src, seg, balance.zero_credit_rows(src, seg))


# ---------------------------------------------------------------- B5 subscriptions
def _subs(src):
    return subscriptions.paid_tier_events(_seg(src, C.PREMIUM))


@register("sub_ranked", lambda: O.with_(C.PREMIUM, "select employer_id as user_id, subscription_id, name, created, "
          "cohort_week, cast(subscription_order as bigint) as subscription_order from subs"))
def _sub_ranked(src):
    return subscriptions.sub_ranked(_seg(src, C.PREMIUM))


@register("sub_totals", lambda: O.with_(C.PREMIUM, O.weekly("subs", "sub_week", "employer_id", "purchasing_eps",
          extra=", cast(count(distinct x.subscription_id) as bigint) as total_orders")))
def _sub_totals(src):
    return subscriptions.sub_totals(_subs(src), C.PREMIUM)


@register("sub_order_raw", lambda: O.with_(C.PREMIUM, O.TIER_RAW(C.PREMIUM)))
def _sub_order_raw(src):
    return subscriptions.sub_order_raw(_subs(src), C.PREMIUM)


@register("sub_order_pivot", lambda: O.with_(C.PREMIUM, O.summed(O.TIER_RAW(C.PREMIUM), C.PREMIUM.tier_names)))
def _sub_order_pivot(src):
    return subscriptions.sub_order_pivot(_subs(src), C.PREMIUM)


@register("sub_first_purchasers", lambda: O.with_(C.PREMIUM, O.weekly("subs", "sub_week", "employer_id",
          "unique_purchasing_eps", where="x.subscription_order = 1")))
def _sub_first(src):
    return subscriptions.sub_first_purchasers(_subs(src), C.PREMIUM)


@register("sub_cum_purchasers", lambda: O.with_(C.PREMIUM, O.cumulative("subs", "sub_week", "employer_id",
          "cum_unique_purchasing_eps", where="x.subscription_order = 1")))
def _sub_cum(src):
    return subscriptions.sub_cum_purchasers(_subs(src), C.PREMIUM)


@register("sub_repeat_purchasers", lambda: O.with_(C.PREMIUM, O.weekly("subs", "sub_week", "employer_id",
          "repeat_purchasing_eps", where="x.subscription_order > 1")))
def _sub_repeat(src):
    return subscriptions.sub_repeat_purchasers(_subs(src), C.PREMIUM)


@register("sub_first_orders_raw", lambda: O.with_(C.PREMIUM, O.TIER_FIRST_RAW(C.PREMIUM)))
def _sub_first_raw(src):
    return subscriptions.sub_first_orders_raw(_subs(src), C.PREMIUM)


@register("sub_first_orders_pivot", lambda: O.with_(C.PREMIUM, O.summed(O.TIER_FIRST_RAW(C.PREMIUM),
                                                                          C.PREMIUM.first_tier_names)))
def _sub_first_pivot(src):
    return subscriptions.sub_first_orders_pivot(_subs(src), C.PREMIUM)


@register("sub_cum_repeat_purchasers", lambda: O.with_(C.PREMIUM, O.cumulative("subs", "sub_week", "employer_id",
          "cum_unique_rep_purchasers", where="x.subscription_order > 1")))
def _sub_cum_repeat(src):
    return subscriptions.sub_cum_repeat_purchasers(_subs(src), C.PREMIUM)


# ---------------------------------------------------------------- B6 reports
@register("report_free_uk", lambda: O.report_sql(C.FREE_A, "free", {"published": "published_eps",
          "pwc": "publ_eps_who_chat", "sent": "ep_chats_sent"}))
def _report_free_uk(src):
    return report.report_free(src, C.FREE_A, sent_name="ep_chats_sent")


@register("report_free_es", lambda: O.report_sql(C.FREE_B, "free", {"published": "published_eps",
          "pwc": "publ_eps_who_chat", "sent": "ep_chat_messages_sent"}))
def _report_free_es(src):
    return report.report_free(src, C.FREE_B, sent_name="ep_chat_messages_sent")


@register("report_paid_uk", lambda: O.report_sql(C.PAID_A, "paid", {"published": "published_ep",
          "pwc": "publ_ep_who_chat", "orders": "orders"}))
def _report_paid_uk(src):
    return report.report_paid(src, C.PAID_A, orders_name="orders")


@register("report_paid_es", lambda: O.report_sql(C.PAID_B, "paid", {"published": "published_ep",
          "pwc": "publ_ep_who_chat", "orders": "total_orders"}))
def _report_paid_es(src):
    return report.report_paid(src, C.PAID_B, orders_name="total_orders")


@register("report_premium_uk", lambda: O.report_sql(C.PREMIUM, "premium", {"published": "published_ep",
          "pwc": "publ_ep_who_chat"}))
def _report_premium_uk(src):
    return report.report_premium(src, C.PREMIUM)


@register("report_premium_uk_devices", lambda: O.report_sql(C.PREMIUM_DEVICES, "premium", {
          "published": "published_ep", "pwc": "publ_ep_who_chat"}))
def _report_premium_uk_devices(src):
    """R5 with the device rule of J9."""
    return report.report_premium(src, C.PREMIUM_DEVICES)


# ---------------------------------------------------------------- kept up to date week by week
# Where the fixture calendar is cut into a history and weekly batches.
HISTORY_UNTIL = dt.date(2017, 1, 23)
REFRESH_BATCHES = ((dt.date(2017, 1, 23), dt.date(2017, 1, 30), dt.date(2017, 2, 6), dt.date(2017, 2, 13)),
                   (dt.date(2017, 1, 16),))  # the last one re-opens a week


def _weekly_state(src, ledger=False):
    """The state after a history and weekly batches, each reading its own weeks only."""
    spark = src.jobs.sparkSession
    state = refresh.WeeklyState(spark, scratch_folder(spark, "weekly_state"))
    past = {name: getattr(src, name).where(F.col(column) < F.lit(HISTORY_UNTIL))
            for name, (_, column) in state.TABLES.items()}
    old = src.ledger.where(F.col("created") < F.lit(HISTORY_UNTIL))
    state.refresh(replace(src, **past), "history", ledger=old if ledger else None)
    for i, weeks in enumerate(REFRESH_BATCHES):
        new = src.ledger.where(refresh.in_weeks("created", list(weeks)))
        state.refresh(src, f"batch{i}", list(weeks), new if ledger and weeks[0] >= HISTORY_UNTIL else None)
    return state


@register("report_free_uk_refreshed", lambda: O.report_sql(C.FREE_A, "free", {"published": "published_eps",
          "pwc": "publ_eps_who_chat", "sent": "ep_chats_sent"}))
def _report_free_uk_refreshed(src):
    """R1 from the weekly state."""
    return _weekly_state(src).report_free(src, C.FREE_A)


@register("report_paid_uk_refreshed", lambda: O.report_sql(C.PAID_A, "paid", {"published": "published_ep",
          "pwc": "publ_ep_who_chat", "orders": "orders"}))
def _report_paid_uk_refreshed(src):
    """R3 from the weekly state."""
    return _weekly_state(src, ledger=True).report_paid(src, C.PAID_A)


@register("report_paid_es_refreshed", lambda: O.report_sql(C.PAID_B, "paid", {"published": "published_ep",
          "pwc": "publ_ep_who_chat", "orders": "total_orders"}))
def _report_paid_es_refreshed(src):
    """R4 from the weekly state (payments ranked by time)."""
    return _weekly_state(src, ledger=True).report_paid(src, C.PAID_B, orders_name="total_orders")


@register("report_premium_uk_refreshed", lambda: O.report_sql(C.PREMIUM, "premium", {"published": "published_ep",
          "pwc": "publ_ep_who_chat"}))
def _report_premium_uk_refreshed(src):
    """R5 from the weekly state."""
    return _weekly_state(src).report_premium(src, C.PREMIUM)


@register("running_balance_refreshed", lambda: O.with_(C.PAID_A, "select id, user_id, balance_change, created, "
          "cast(balance as bigint) as balance from balance"))
def _running_balance_refreshed(src):
    """M28 kept up to date: a history, newer rows, and late rows that re-open users."""
    spark = src.ledger.sparkSession
    state = BalanceState(spark, scratch_folder(spark, "balance_state"))
    late, past = F.col("id") % 7 == 0, F.col("created") < F.lit(HISTORY_UNTIL)
    state.apply(src.ledger.where(past & ~late), "history")
    state.apply(src.ledger.where(~past & ~late), "newer")
    state.apply(src.ledger.where(late), "late")
    return state.balances()


# ---------------------------------------------------------------- distinct counts from bitmaps
@register("published_bitmaps", lambda: O.with_(C.PAID_A, O.published_sql()))
def _published_bitmaps(src):
    """M10 with both distinct counts from one aggregation of bitmaps."""
    jobs = funnel.good_jobs(src, _seg(src, C.PAID_A)).withColumn("week", F.trunc("job_posted_date", "week"))
    parts = bitmaps.partials(jobs, "week", {"published_ep": "employer_id", "listings": "job_id"})
    return bitmaps.counts(bitmaps.on_grid(parts, C.PAID_A), ["published_ep", "listings"])


@register("orders_weekly_bitmaps", lambda: O.with_(C.PAID_A, O.weekly("pay_rows", "pay_week", "user_id", "purchasing_eps",
          extra=", cast(count(distinct x.id) as bigint) as total_orders")))
def _orders_weekly_bitmaps(src):
    """M17 with both distinct counts from one aggregation of bitmaps."""
    parts = bitmaps.partials(_pay(src), "pay_week", {"purchasing_eps": "user_id", "total_orders": "id"})
    return bitmaps.counts(bitmaps.on_grid(parts, C.PAID_A), ["purchasing_eps", "total_orders"])


@register("cum_publ_who_chat_bitmaps", lambda: O.with_(C.PAID_A, O.cumulative("chat_rows", "chat_week", "employer_id",
                                                                              "cum_publ_ep_who_chat")))
def _cum_publ_who_chat_bitmaps(src):
    """M16 folded from the weekly partials of M15."""
    parts = bitmaps.partials(_events(src), "chat_week", {"cum_publ_ep_who_chat": "employer_id"})
    return bitmaps.counts(bitmaps.so_far(parts, C.PAID_A), ["cum_publ_ep_who_chat"])


# ---------------------------------------------------------------- B7 ad hoc
def _organic(alias="e"):
    ch = C.ORGANIC_CHANNELS
    return (f"({alias}.acquisition_channel like {O.q(ch[0])} or {alias}.acquisition_sub_channel like "
            f"{O.q(C.ORGANIC_SUB_CHANNEL)} or {alias}.acquisition_channel like {O.q(ch[1])})")


@register("adhoc_cohort_size", lambda: O.with_(C.PREMIUM, f"select {O.wk('e.registration_date')} as cohort_week, "
          "cast(count(distinct e.employer_id) as bigint) as cohort_size from employers_dim e join "
          "user_subscriptions_history h on e.employer_id = h.user_id where h.name not like "
          f"{O.q(C.FREE_TIER)} and e.country like {O.q(C.COUNTRY_A)} and e.city like {O.q(C.CITY_A)} and "
          f"{_organic()} and e.registration_sub_channel like {O.q(C.PLATFORM)} and e.good_employer = 1 and "
          "e.employer_id not in (select user_id from user_balance) group by 1"))
def _adhoc_cohort_size(src):
    """Premium cohort sizes (every cohort week)."""
    return adhoc.cohort_size(src)


@register("adhoc_internal_accounts", lambda: O.with_(C.PAID_A, "select e.*, ub.user_id, "
          f"{O.wk('e.registration_date')} as cohort_week from employers_dim e join user_balance ub on "
          f"e.employer_id = ub.user_id where e.country like {O.q(C.COUNTRY_A)} and e.registration_sub_channel like "
          f"{O.q(C.PLATFORM)} and e.registration_date >= {O.d(ADHOC_REGISTERED_FROM)} and "
          f"{O.wk('e.registration_date')} <= {O.d(ADHOC_COHORT_UNTIL)} and e.email like "
          f"{O.q(C.INTERNAL_EMAIL_PATTERNS[0])}"))
def _adhoc_internal_accounts(src):
    """T2."""
    return adhoc.internal_accounts(src, ADHOC_REGISTERED_FROM, ADHOC_COHORT_UNTIL)


@register("adhoc_internal_payments", lambda: O.with_(C.PAID_A, "select p.id, p.user_id, p.purchase_id, p.created, "
          "pu.sku, e.*, cast(row_number() over (partition by p.user_id order by p.created, p.id) as bigint) "
          "as pur_order from payment p join purchases pu on p.purchase_id = pu.id join employers_dim e on "
          f"e.employer_id = p.user_id where pu.sku like {O.q(C.SKU_FAMILY)} and e.email like "
          f"{O.q(C.INTERNAL_EMAIL_PATTERNS[0])}"))
def _adhoc_internal_payments(src):
    """T3."""
    return adhoc.internal_payments(src)


@register("adhoc_chat_ratio", lambda: O.with_(C.PAID_A, "select pe.week, cast(count(distinct pe.employer_id) as "
          "bigint) as published_eps, cast(count(distinct c.employer_id) as bigint) as chatting_eps from "
          f"(select distinct e.employer_id, {O.wk('e.registration_date')} as week from employers_dim e join jobs_dim j "
          f"on e.employer_id = j.employer_id where e.country like {O.q(C.COUNTRY_A)} and j.good_job = 1 and "
          f"e.good_employer = 1 and {O.wk('e.registration_date')} = {O.wk('j.job_posted_date')} and e.city like "
          f"{O.q(C.CITY_A)} and e.registration_sub_channel like {O.q(C.PLATFORM)} and e.acquisition_channel in "
          f"({O.q(C.ORGANIC_CHANNELS[0])}, {O.q(C.ORGANIC_CHANNELS[1])})) pe left join chats_activity c on "
          f"pe.employer_id = c.employer_id and {O.wk('c.message_date')} = pe.week and c.employer_messages > 0 "
          "group by 1"))
def _adhoc_chat_ratio(src):
    """T4: per registration week."""
    return adhoc.chat_ratio(src)


@register("adhoc_balance", lambda: O.with_(C.PAID_A, "select id, user_id, balance_change, created, "
          "cast(balance as bigint) as balance from balance order by user_id, created, id"))
def _adhoc_balance(src):
    """T5."""
    return adhoc.balance_ledger(src)


@register("adhoc_pack_buyers", lambda: O.with_(C.PAID_B, "select distinct e.employer_id, pu.sku from employers_dim e "
          "join user_balance ub on e.employer_id = ub.user_id join payment p on e.employer_id = p.user_id join "
          f"purchases pu on p.purchase_id = pu.id where e.country like {O.q(C.COUNTRY_B)} and e.email not like "
          f"{O.q(C.INTERNAL_EMAIL_PATTERNS[0])} and e.email not like {O.q(C.INTERNAL_EMAIL_PATTERNS[1])} and "
          f"{O.wk('e.registration_date')} >= {O.d(ADHOC_BUYERS_FROM)} and pu.sku like {O.q(C.SKU_FAMILY)} and "
          f"(pu.sku like {O.q(C.ADHOC_PACK_DIGITS[0])} or pu.sku like {O.q(C.ADHOC_PACK_DIGITS[1])})"))
def _adhoc_pack_buyers(src):
    """T6."""
    return adhoc.pack_buyers(src, ADHOC_BUYERS_FROM)
