"""Marketplace input tables derived from the driver's TPC-H-style tables.

The reference ships no data, so each input is a view over the driver
tables (FIXTURES.md).  One SQL text per view serves both engines: Spark
receives the base tables as DataFrame arguments of ``spark.sql``, DuckDB
receives the same text with bare table names as a CTE prefix for the
oracle queries.  A production deployment builds ``Sources`` from its own
warehouse tables instead (``Sources.from_tables``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.tables import read_table


# Fixture view definitions (FIXTURES.md "View text").
VIEW_SQL: dict[str, str] = {
    "employers_dim": """
  select c_custkey as employer_id,
         date'2016-11-28' + cast(c_custkey * 13 % 56 as int) as registration_date,
         case when n_regionkey <= 2 then 'UK' else 'ES' end as country,
         case when c_nationkey % 4 <> 0 then 'London' else 'Leeds' end as city,
         case c_mktsegment when 'AUTOMOBILE' then 'Organic' when 'BUILDING' then 'Not available'
              when 'FURNITURE' then 'Sales' when 'HOUSEHOLD' then 'Paid' end as acquisition_channel,
         case when c_custkey % 7 = 0 then 'Organic' else 'Other' end as acquisition_sub_channel,
         case when c_custkey % 5 = 0 then 'Android' else 'iOS' end as registration_sub_channel,
         concat(c_name, case when c_custkey % 29 = 0 then '@qa.example'
                             when c_custkey % 31 = 0 then '@staff.example.com'
                             else '@mail.example' end) as email,
         case when c_acctbal > 0 then 1 else 0 end as good_employer
  from {customer} join {nation} on c_nationkey = n_nationkey""",
    "jobs_dim": """
  select o_orderkey as job_id, o_custkey as employer_id,
         date'2016-11-28' + cast(dayofyear(o_orderdate) % 84 as int) as job_posted_date,
         case when o_orderstatus = 'P' then 0 else 1 end as good_job
  from {orders} where o_orderpriority in ('1-URGENT', '2-HIGH')""",
    "chats_activity": """
  select o_custkey as employer_id, l_suppkey as jobseeker_id,
         date'2016-11-28' + cast(dayofyear(l_shipdate) % 84 as int) as message_date,
         cast(l_quantity as int) % 6 as employer_messages
  from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "user_balance": """
  select c_custkey as user_id from {customer} where c_custkey % 3 = 0""",
    "users": """
  select c_custkey as id, 'London' as city from {customer} where c_custkey % 17 <> 0""",
    "user_balance_history": """
  select o_orderkey as id, o_custkey as user_id,
         case when o_orderkey % 2 = 0 then 1 else -1 end as balance_change,
         date'2016-11-28' + cast(dayofyear(o_orderdate) % 84 as int) as created
  from {orders} where o_orderpriority in ('4-NOT SPECIFIED', '5-LOW')""",
    "user_subscriptions_history": """
  select o_orderkey as subscription_id, o_custkey as user_id,
         case o_orderkey % 4 when 0 then 'FREE_PREMIUM' when 1 then 'MOBILE_PREMIUM_S'
              when 2 then 'MOBILE_PREMIUM_M' else 'MOBILE_PREMIUM_L' end as name,
         date'2016-11-28' + cast(dayofyear(o_orderdate) % 84 as int) as created,
         cast(o_custkey % 11 + 1 as int) as test_id
  from {orders} where o_orderpriority = '2-HIGH'""",
    "payment": """
  select o_orderkey as id, o_custkey as user_id, cast(o_orderkey % 7 as int) as purchase_id,
         date'2016-11-28' + cast(dayofyear(o_orderdate) % 84 as int) as created
  from {orders} where o_orderpriority = '3-MEDIUM'""",
    "purchases": """
  select * from (values (0, 'app.credits.pack1'), (1, 'app.credits.pack1.v2'),
                        (2, 'app.credits.pack2'), (3, 'app.credits.pack2.v2'),
                        (4, 'app.credits.pack3'), (5, 'app.credits.pack3.v2'),
                        (6, 'app.other')) as t(id, sku)""",
    "refs_devices_users": """
  select o_custkey as user_id, l_suppkey as device_id
  from {lineitem} join {orders} on l_orderkey = o_orderkey
  where l_linenumber = 1 and o_orderpriority = '1-URGENT'""",
    "devices": """
  select s_suppkey as id, cast(s_nationkey % 8 as int) as type from {supplier}""",
    "experiment_arms": """
  select * from (values ('premium', 1), ('premium', 2), ('premium', 5), ('sales', 4),
                        ('paid chats', 10), ('paid chats', 11), ('paid listing', 9)) as t(product, test_id)""",
}

_BASE_NAMES = ("customer", "nation", "orders", "lineitem", "supplier")


def duckdb_prefix(wrap: dict[str, str] | None = None) -> str:
    """The fixture views as a ``WITH`` list for DuckDB (bare base-table names).

    ``wrap`` optionally rewrites views: view name -> SQL over ``{src}`` (the
    original view), applied identically by ``load_sources``.
    """
    names = {n: n for n in _BASE_NAMES}
    parts = []
    for v, sql in VIEW_SQL.items():
        text = sql.format(**names)
        if wrap and v in wrap:
            text = wrap[v].format(src=f"({text}) as _orig")
        parts.append(f"{v} as ({text}\n)")
    return "with " + ",\n".join(parts)


@dataclass
class Sources:
    """The marketplace inputs as DataFrames (explicit columns, no nesting).

    The two device tables are needed only by segments that exclude device types.
    """

    employers: DataFrame      # employers_dim
    jobs: DataFrame           # jobs_dim
    chats: DataFrame          # chats_activity
    holders: DataFrame        # user_balance: users holding chat credits
    users: DataFrame          # users
    ledger: DataFrame         # user_balance_history
    subscriptions: DataFrame  # user_subscriptions_history
    payments: DataFrame       # payment
    purchases: DataFrame      # purchases (id, sku); the SKU column is renamed on load
    arms: DataFrame           # experiment arm map (product, test_id)
    device_links: DataFrame | None = None  # refs_devices_users: user_id, device_id
    devices: DataFrame | None = None       # devices: id, type

    @classmethod
    def from_tables(cls, spark: SparkSession, names: dict[str, str]) -> "Sources":
        """Bind to catalog tables, e.g. ``{"employers_dim": "dw.employers_dim", ...}``."""
        t = {k: spark.table(v) for k, v in names.items()}
        return cls._from_views(t)

    @classmethod
    def _from_views(cls, v: dict[str, DataFrame]) -> "Sources":
        return cls(**{f: v.get(view) if f in ("device_links", "devices") else v[view] for f, view in FIELD_VIEWS.items()})


FIELD_VIEWS = {"employers": "employers_dim", "jobs": "jobs_dim", "chats": "chats_activity", "holders": "user_balance",
               "users": "users", "ledger": "user_balance_history", "subscriptions": "user_subscriptions_history",
               "payments": "payment", "purchases": "purchases", "arms": "experiment_arms",
               "device_links": "refs_devices_users", "devices": "devices"}


class FixtureSources(Sources):
    """Sources whose views are made when they are first asked for, so that a query analyses its own inputs only."""

    def __init__(self, view: Callable[[str], DataFrame] | None = None, **given: DataFrame):
        self._view = view
        for field, df in given.items():  # dataclasses.replace gives all of them
            setattr(self, field, df)


def _lazily(field: str, view: str) -> None:
    made = cached_property(lambda self: self._view(view))
    made.__set_name__(FixtureSources, field)
    setattr(FixtureSources, field, made)


for _field, _name in FIELD_VIEWS.items():
    _lazily(_field, _name)


def load_sources(spark: SparkSession, sf_dir: str, wrap: dict[str, str] | None = None) -> Sources:
    """Fixture views over ``sf_dir`` (lazy: nothing runs until an action)."""
    base: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in base:
            base[name] = read_table(spark, sf_dir, name)
        return base[name]

    def view(name: str) -> DataFrame:
        sql = VIEW_SQL[name]
        df = spark.sql(sql, **{n: table(n) for n in _BASE_NAMES if "{" + n + "}" in sql})
        return spark.sql(wrap[name], src=df) if wrap and name in wrap else df

    return FixtureSources(view)
