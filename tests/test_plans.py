"""Plan shape: no nested-loop or cartesian joins, pushed-down cohort bound."""

import contextlib

import pytest

from cohortlens import config as C
from cohortlens.plans import catalog as E
from cohortlens.operators.segments import build_segment
from tests.conftest import SF0001
from tests.helpers import D, employer, make_sources

KEYS = sorted(E.queries())


@contextlib.contextmanager
def settings(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def written(monkeypatch):
    """(name, physical plan) of every intermediate that a query writes."""
    from cohortlens import session
    from cohortlens.operators import scan, segments
    from cohortlens.plans import report

    seen = []
    real = session.materialize

    def spy(df, name="stage"):
        seen.append((name, _plan(df)))
        return real(df, name)

    for module in (scan, segments, report):
        monkeypatch.setattr(module, "materialize", spy)
    return seen


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_nested_loop_or_cartesian(spark, key):
    plan = _plan(E.queries()[key](spark, SF0001))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("key", ["cum_publ_who_chat", "cum_purchasers", "cum_repeat_purchasers",
                                 "cum_zero_credit", "sub_cum_repeat_purchasers", "first_orders_raw",
                                 "running_balance", "report_paid_uk", "report_premium_uk"])
def test_no_window_over_users(spark, key):
    """Windows run inside a written range partition, or over its per-partition totals (``_k``)."""
    import re
    plan = _plan(E.queries()[key](spark, SF0001))
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert re.search(r"\[_k#\d+L?\]|\[_scan_pid#\d+, ", line), line


def test_cohort_bound_reaches_parquet(spark, tmp_path):
    emps = [employer(1, D(2016, 12, 6)), employer(2, D(2016, 11, 29))]
    src = make_sources(spark, employers_dim=emps)
    path = str(tmp_path / "employers")
    src.employers.write.parquet(path)
    src.employers = spark.read.parquet(path)
    seg = build_segment(src, C.FREE_A, materialized=False)
    plan = seg.employers.sparkSession._jvm.PythonSQLUtils.explainString(
        seg.employers._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(registration_date,2016-12-05)" in plan
    assert "LessThan(registration_date,2017-01-16)" in plan
    assert "EqualTo(country,UK)" in plan
    assert [r.employer_id for r in seg.employers.collect()] == [1]


@pytest.mark.parametrize("key", ["chat_messages", "chat_pairs", "published", "orders_weekly", "pack_orders_raw",
                                 "report_free_uk", "report_paid_uk", "report_premium_uk"])
def test_fact_joins_are_broadcast_against_the_segment(spark, key, written):
    """With automatic broadcasts off, the hinted (written, small) sides still keep every fact unshuffled.

    Looks at the plans of all written intermediates too, where the facts are scanned.
    """
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plans = [_plan(E.queries()[key](spark, SF0001))] + [p for _, p in written]
    facts = [p for p in plans if "lineitem" in p or "orders.parquet" in p]
    assert facts
    for plan in facts:
        assert "SortMergeJoin" not in plan or "fixture" in plan or _joins_fixture_only(plan), plan


def _joins_fixture_only(plan: str) -> bool:
    """The chat and employer fixture views are themselves joins of driver tables; only those may sort-merge."""
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    return all("l_orderkey" in line or "c_nationkey" in line for line in joins)


@pytest.mark.parametrize("key", ["report_paid_uk", "report_premium_uk"])
def test_facts_are_read_once_per_report(spark, key, written):
    top = _plan(E.queries()[key](spark, SF0001))
    scans = [(name, line) for name, p in [*written, ("report", top)] for line in p.splitlines() if "FileScan parquet" in line]

    def readers(column):
        return [name for name, line in scans if column in line]

    assert readers("l_shipdate#") == ["chat_pairs"]
    assert [n for n, line in scans if "IN (1-URGENT,2-HIGH)" in line] == ["good_jobs"]
    assert len([n for n, line in scans if "IN (4-NOT SPECIFIED,5-LOW)" in line]) == (key == "report_paid_uk")


def test_not_in_never_shuffles_the_holders(spark, written):
    from cohortlens.operators.segments import exclude_holders

    left = spark.createDataFrame([(1,), (2,), (None,)], "employer_id bigint")
    holders = spark.range(0, 5000).selectExpr("id * 2 as user_id")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        kept = exclude_holders(left, holders)
        plan = dict(written)["matched_holders"]
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert "Exchange hashpartitioning" not in _plan(kept)
    assert [r[0] for r in kept.collect()] == [1]


def test_no_duplicate_definitions():
    """A second top-level definition of a name silently replaces the first."""
    import ast
    import pathlib

    for path in pathlib.Path(__file__).parent.parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))
                 and n.name != "_"]
        twice = {n for n in names if names.count(n) > 1}
        assert not twice, (path, twice)


def test_report_reads_chat_fact_once(spark):
    """The report reduces the chat fact to pair-weeks once (materialized)."""
    from cohortlens.plans import report
    from cohortlens.sources.fixtures import load_sources
    df = report.report_paid(load_sources(spark, SF0001), C.PAID_A)
    assert "lineitem" not in _plan(df)


def test_sources_from_catalog_tables(spark):
    """Binding to catalog tables gives the same report as the fixture loader."""
    from cohortlens.plans import report
    from cohortlens.sources.fixtures import Sources, load_sources
    src = load_sources(spark, SF0001)
    names = {}
    for view, attr in (("employers_dim", "employers"), ("jobs_dim", "jobs"), ("chats_activity", "chats"),
                       ("user_balance", "holders"), ("users", "users"), ("user_balance_history", "ledger"),
                       ("user_subscriptions_history", "subscriptions"), ("payment", "payments"),
                       ("purchases", "purchases"), ("experiment_arms", "arms")):
        getattr(src, attr).createOrReplaceTempView(f"cl_test_{view}")
        names[view] = f"cl_test_{view}"
    bound = Sources.from_tables(spark, names)
    a = report.report_free(bound, C.FREE_B, sent_name="ep_chat_messages_sent")
    b = report.report_free(src, C.FREE_B, sent_name="ep_chat_messages_sent")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() > 0
