"""Independent SQL formulations of every query, for DuckDB.

Written in the *naive* shape on purpose: theta joins against the spine,
fan-out joins followed by DISTINCT, employer-grain report assembly and
real window functions.  The Spark side uses the rewritten plans, so a
match checks the rewrites, not just the arithmetic.
"""

from __future__ import annotations

import datetime as dt

from cohortlens import config as C
from cohortlens.config import ReportConfig
from cohortlens.sources.fixtures import duckdb_prefix


def wk(expr: str) -> str:
    return f"cast(date_trunc('week', {expr}) as date)"


def d(x: dt.date) -> str:
    return f"date '{x.isoformat()}'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _seg(cfg: ReportConfig) -> str:
    r = cfg.segment
    joins, where, extra = [], [f"e.country like {q(r.country)}"], ""
    if r.holders == "require":
        joins.append("join user_balance ub on e.employer_id = ub.user_id")
    if r.require_user_row:
        joins.append("join users u on u.id = e.employer_id")
    if r.subscriptions:
        joins.append("join user_subscriptions_history sh on e.employer_id = sh.user_id")
        where.append(f"sh.name not like {q(r.excluded_tier)}")
        if r.arms:
            where.append("sh.test_id in (" + ", ".join(str(a) for a in r.arms) + ")")
        extra = ", sh.subscription_id, sh.name, sh.created, sh.test_id"
    if r.city:
        where.append(f"e.city like {q(r.city)}")
    if r.organic_only:
        ch = C.ORGANIC_CHANNELS
        where.append(f"(e.acquisition_channel like {q(ch[0])} or e.acquisition_sub_channel like "
                     f"{q(C.ORGANIC_SUB_CHANNEL)} or e.acquisition_channel like {q(ch[1])})")
    if r.channel_not_like:
        where.append(f"e.acquisition_channel not like {q(r.channel_not_like)}")
    if r.platform:
        where.append(f"e.registration_sub_channel like {q(r.platform)}")
    if r.good_employer:
        where.append("e.good_employer = 1")
    for p in r.internal_emails:
        where.append(f"e.email not like {q(p)}")
    if r.holders == "exclude":
        where.append("e.employer_id not in (select user_id from user_balance)")
    if r.excluded_device_types:
        types = ", ".join(str(t) for t in r.excluded_device_types)
        where.append("e.employer_id not in (select rdu.user_id from refs_devices_users rdu join devices dv "
                     f"on rdu.device_id = dv.id where dv.type in ({types}))")
    where.append(f"{wk('e.registration_date')} >= {d(cfg.cohort_from)}")
    if cfg.cohort_to:
        where.append(f"{wk('e.registration_date')} <= {d(cfg.cohort_to)}")
    return (f"seg as (select e.employer_id, e.registration_date, {wk('e.registration_date')} as cohort_week{extra}\n"
            f"  from employers_dim e {' '.join(joins)}\n  where " + "\n    and ".join(where) + ")")


def ctes(cfg: ReportConfig, wrap: dict[str, str] | None = None, fixture: bool = True) -> str:
    """Shared CTEs for one configuration (unreferenced ones cost nothing).

    ``fixture=False`` expects the marketplace tables (employers_dim, ...)
    to exist under their own names instead of deriving them.
    """
    fam = q(cfg.sku_family)
    # week mode ranks de-duplicated rows; timestamp mode ranks the join's rows and de-duplicates after
    cols = "id, user_id, purchase_id, created, sku, cohort_week, pay_week"
    rank = "row_number() over (partition by user_id order by {}) as pur_order"
    ranked = (f"select *, {rank.format('pay_week, id')} from (select distinct {cols} from pay_rows) x"
              if cfg.rank_mode == "week" else
              f"select distinct * from (select {cols}, {rank.format('created, id')} from pay_rows) x")
    tiers = ", ".join(q(t) for t in cfg.tiers)
    return ",\n".join([
        duckdb_prefix(wrap) if fixture else "with _none as (select 1)",
        f"spine as (select cast(generate_series as date) as activity_week from generate_series("
        f"cast({d(cfg.spine_start)} as timestamp), cast({d(cfg.spine_end)} as timestamp), interval 7 day))",
        _seg(cfg),
        "good_jobs as (select j.job_id, j.job_posted_date, j.employer_id from jobs_dim j "
        "join seg s on j.employer_id = s.employer_id where j.good_job = 1)",
        f"chat_rows as (select s.cohort_week, {wk('c.message_date')} as chat_week, c.employer_id, c.jobseeker_id, "
        f"c.employer_messages from chats_activity c join seg s on c.employer_id = s.employer_id "
        f"join good_jobs g on s.employer_id = g.employer_id where c.employer_messages > 0 "
        f"and s.cohort_week = {wk('g.job_posted_date')})",
        f"pay_rows as (select p.id, p.user_id, p.purchase_id, p.created, pu.sku, s.cohort_week, "
        f"{wk('p.created')} as pay_week from payment p join purchases pu on p.purchase_id = pu.id "
        f"join seg s on s.employer_id = p.user_id where pu.sku like {fam})",
        f"ranked_pay as ({ranked})",
        "balance as (select id, user_id, balance_change, created, sum(balance_change) over "
        "(partition by user_id order by created) as balance from user_balance_history)",
        "zero as (select s.employer_id, s.cohort_week, b.id, b.created, b.balance from seg s "
        "join balance b on s.employer_id = b.user_id where b.balance = 0)",
        f"subs as (select s.employer_id, s.cohort_week, s.subscription_id, s.name, s.created, {wk('s.created')} "
        f"as sub_week, row_number() over (partition by s.employer_id order by s.created, s.subscription_id) "
        f"as subscription_order from seg s where s.name in ({tiers}))",
    ])


def with_(cfg: ReportConfig, body: str, wrap: dict[str, str] | None = None) -> str:
    return ctes(cfg, wrap) + "\n" + body


# ---- metric bodies (each a SELECT over the shared CTEs) -------------------

def weekly(src: str, week: str, entity: str, out: str, extra: str = "", where: str = "true") -> str:
    return (f"select x.cohort_week, w.activity_week, cast(count(distinct x.{entity}) as bigint) as {out}{extra}\n"
            f"from {src} x cross join spine w\nwhere w.activity_week = x.{week} "
            f"and w.activity_week >= x.cohort_week and {where}\ngroup by 1, 2")


def cumulative(src: str, week: str, entity: str, out: str, where: str = "true") -> str:
    return (f"select x.cohort_week, w.activity_week, cast(count(distinct x.{entity}) as bigint) as {out}\n"
            f"from {src} x cross join spine w\nwhere x.{week} <= w.activity_week "
            f"and w.activity_week >= x.cohort_week and {where}\ngroup by 1, 2")


def hidden_key(src: str, key: str, patterns, names, count_col: str, gate: str = "true",
               extra_group: str = "") -> str:
    cases = ",\n  ".join(f"case when x.{key} like {q(p)} and {gate} then cast(count(distinct x.{count_col}) "
                         f"as bigint) end as {n}" for p, n in zip(patterns, names, strict=True))
    return (f"select distinct x.cohort_week, w.activity_week,\n  {cases}\n"
            f"from {src} x cross join spine w\nwhere w.activity_week = x.{ 'pay_week' if src != 'subs' else 'sub_week'} "
            f"and w.activity_week >= x.cohort_week\ngroup by x.cohort_week, w.activity_week, x.{key}{extra_group}")


def summed(raw: str, names) -> str:
    sums = ", ".join(f"cast(sum({n}) as bigint) as {n}" for n in names)
    return f"select cohort_week, activity_week, {sums} from ({raw}) r group by 1, 2"


def weeks_after_sql() -> str:
    return ("select distinct s.cohort_week, w.activity_week, cast((extract(year from w.activity_week) - "
            "extract(year from s.registration_date)) * 52 + extract(week from w.activity_week) - "
            "extract(week from s.registration_date) as bigint) as weeks_after from seg s cross join spine w")


def registrations_sql() -> str:
    return ("select cohort_week, cast(count(distinct employer_id) as bigint) as registrations "
            "from seg group by 1")


def published_sql() -> str:
    return ("select s.cohort_week, w.activity_week, cast(count(distinct g.employer_id) as bigint) as published_ep, "
            "cast(count(distinct g.job_id) as bigint) as listings\nfrom seg s join good_jobs g on "
            f"s.employer_id = g.employer_id cross join spine w\nwhere w.activity_week = {wk('g.job_posted_date')} "
            "and w.activity_week >= s.cohort_week group by 1, 2")


def chat_sessions_sql() -> str:
    return ("select cohort_week, chat_week, cast(count(*) as bigint) as ep_chat_sessions from "
            "(select distinct cohort_week, chat_week, employer_id, jobseeker_id from chat_rows) p group by 1, 2")


def chat_messages_sql() -> str:
    return ("select cohort_week, chat_week, cast(sum(employer_messages) as bigint) as ep_chats_sent from "
            "(select distinct cohort_week, chat_week, employer_id, jobseeker_id, employer_messages from chat_rows) m "
            "group by 1, 2")


PACKS_RAW = lambda cfg: hidden_key("pay_rows", "sku", cfg.packs, cfg.pack_names, "id")
FIRST_RAW = lambda cfg: hidden_key("ranked_pay", "sku", cfg.packs, cfg.first_names, "id", gate="x.pur_order = 1", extra_group=", x.pur_order")
REPEAT_RAW = lambda cfg: hidden_key("ranked_pay", "sku", cfg.packs, cfg.repeat_names, "id", gate="x.pur_order > 1", extra_group=", x.pur_order")
TIER_RAW = lambda cfg: hidden_key("subs", "name", cfg.tiers, cfg.tier_names, "subscription_id")
TIER_FIRST_RAW = lambda cfg: hidden_key("subs", "name", cfg.tiers, cfg.first_tier_names, "subscription_id", gate="x.subscription_order = 1", extra_group=", x.subscription_order")


def zero_payments_sql() -> str:
    return ("select user_id, cohort_week as registration_week, pay_week as created_week, purchase_id, id, "
            "cast(row_number() over (partition by user_id order by created, id) as bigint) as pur_order "
            "from (select distinct id, user_id, purchase_id, created, sku, cohort_week, pay_week from pay_rows) x "
            "where user_id in (select employer_id from zero)")


def cum_zero_purchasers_sql() -> str:
    return ("select z.cohort_week, w.activity_week, cast(count(distinct z.employer_id) as bigint) as "
            "cum_purchasing_eps_who_reached_0_credits\nfrom zero z join (select *, row_number() over "
            "(partition by user_id order by created, id) as o from pay_rows) p on z.employer_id = p.user_id "
            f"cross join spine w\nwhere p.o = 1 and w.activity_week >= z.cohort_week and w.activity_week >= p.pay_week "
            f"and w.activity_week >= {wk('z.created')} group by 1, 2")


# ---- reports: employer-grain assembly, as the reference does it -------------

def report_sql(cfg: ReportConfig, kind: str, names: dict, wrap: dict[str, str] | None = None,
               fixture: bool = True) -> str:
    m = {
        "wa": weeks_after_sql(),
        "regs": registrations_sql(),
        "pub": published_sql(),
        "pwc": weekly("chat_rows", "chat_week", "employer_id", "publ_ep_who_chat"),
        "cs": chat_sessions_sql(),
        "sent": chat_messages_sql(),
    }
    cols = ["p.weeks_after", "r.registrations", f"pub.published_ep as {names['published']}", "pub.listings",
            f"pwc.publ_ep_who_chat as {names['pwc']}"]
    joins = ["left join wa p on p.cohort_week = s.cohort_week and p.activity_week = w.activity_week",
             "left join regs r on r.cohort_week = s.cohort_week",
             "left join pub on pub.cohort_week = s.cohort_week and pub.activity_week = w.activity_week",
             "left join pwc on pwc.cohort_week = s.cohort_week and pwc.activity_week = w.activity_week",
             "left join cs on cs.cohort_week = s.cohort_week and cs.chat_week = w.activity_week",
             "left join sent on sent.cohort_week = s.cohort_week and sent.chat_week = w.activity_week"]
    if kind == "paid":
        m["cpwc"] = cumulative("chat_rows", "chat_week", "employer_id", "cum_publ_ep_who_chat")
        m["cz"] = (f"select z.cohort_week, w.activity_week, cast(count(distinct z.employer_id) as bigint) as "
                   f"cum_eps_who_reached_0_credits from zero z cross join spine w where w.activity_week >= z.cohort_week "
                   f"and w.activity_week >= {wk('z.created')} group by 1, 2")
        m["pe"] = weekly("pay_rows", "pay_week", "user_id", "purchasing_eps",
                         extra=", cast(count(distinct x.id) as bigint) as total_orders")
        m["upe"] = weekly("ranked_pay", "pay_week", "user_id", "unique_purchasing_eps", where="x.pur_order = 1")
        m["tot"] = summed(PACKS_RAW(cfg), cfg.pack_names)
        m["fo"] = summed(FIRST_RAW(cfg), cfg.first_names)
        m["curp"] = cumulative("ranked_pay", "pay_week", "user_id", "cum_unique_rep_purchasers", where="x.pur_order > 1")
        cols += ["cpwc.cum_publ_ep_who_chat", "cs.ep_chat_sessions", "sent.ep_chats_sent as ep_chat_messages_sent",
                 "cz.cum_eps_who_reached_0_credits", "pe.purchasing_eps", "upe.unique_purchasing_eps",
                 f"pe.total_orders as {names['orders']}", *[f"tot.{n}" for n in cfg.pack_names], *[f"fo.{n}" for n in cfg.first_names], "curp.cum_unique_rep_purchasers"]
        for k in ("cpwc", "cz", "pe", "upe", "tot", "fo", "curp"):
            joins.append(f"left join {k} on {k}.cohort_week = s.cohort_week and {k}.activity_week = w.activity_week")
    elif kind == "premium":
        m["tt"] = weekly("subs", "sub_week", "employer_id", "purchasing_eps",
                         extra=", cast(count(distinct x.subscription_id) as bigint) as total_orders")
        m["upe"] = weekly("subs", "sub_week", "employer_id", "unique_purchasing_eps", where="x.subscription_order = 1")
        m["tot"] = summed(TIER_RAW(cfg), cfg.tier_names)
        m["fo"] = summed(TIER_FIRST_RAW(cfg), cfg.first_tier_names)
        m["curp"] = cumulative("subs", "sub_week", "employer_id", "cum_unique_rep_purchasers",
                               where="x.subscription_order > 1")
        cols += ["cs.ep_chat_sessions", "sent.ep_chats_sent as ep_chat_messages_sent", "tt.purchasing_eps",
                 "upe.unique_purchasing_eps", "tt.total_orders as orders", *[f"tot.{n}" for n in cfg.tier_names],
                 *[f"fo.{n}" for n in cfg.first_tier_names], "curp.cum_unique_rep_purchasers"]
        for k in ("tt", "upe", "tot", "fo", "curp"):
            joins.append(f"left join {k} on {k}.cohort_week = s.cohort_week and {k}.activity_week = w.activity_week")
    else:
        cols += ["cs.ep_chat_sessions", f"sent.ep_chats_sent as {names['sent']}"]
    metric_ctes = ",\n".join(f"{k} as ({v})" for k, v in m.items())
    body = (f"select distinct s.cohort_week, w.activity_week, {', '.join(cols)}\nfrom seg s cross join spine w\n"
            + "\n".join(joins) + "\nwhere w.activity_week >= s.cohort_week")
    return ctes(cfg, wrap, fixture) + ",\n" + metric_ctes + "\n" + body
