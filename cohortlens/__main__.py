"""Command line: run a registered query, or a report with its own windows and tables.

    python -m cohortlens list
    python -m cohortlens run report_paid_uk --sf-dir /root/testdata/sf0.1 --out /path/out [--format parquet|csv]
    python -m cohortlens run published --sf-dir /root/testdata/sf0.01 --show 20
    python -m cohortlens report paid_a --sf-dir DIR --spine-start 2016-12-05 --spine-end 2017-02-13 \\
        --cohort-from 2016-12-05 --cohort-to 2017-01-09
    python -m cohortlens report free_b --table employers_dim=dw.employers --table jobs_dim=dw.jobs ...
    python -m cohortlens refresh --state DIR --batch 2017-02-13 --week 2017-02-13 --sf-dir DIR
    python -m cohortlens report paid_a --state DIR --sf-dir DIR

``refresh`` reads the facts of the named weeks (all weeks, if none is named) into the weekly state;
``report --state`` makes the report of it, so that old facts are not read again.

The result is written by the executors (``--out``); ``--show`` prints the first rows only.
On a cluster ``--checkpoint-dir`` (or ``spark.checkpoint.dir``) names the shared folder for
intermediates, which are deleted at the end.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from dataclasses import replace


def _config(a):
    from cohortlens import config as C

    base = {c.name: c for c in (C.FREE_A, C.FREE_B, C.PAID_A, C.PAID_B, C.PREMIUM)}[a.name]
    given = {k: getattr(a, k) for k in ("spine_start", "spine_end", "cohort_from", "cohort_to") if getattr(a, k)}
    if a.pack:
        given["packs"] = tuple(a.pack)
    if a.tier:
        given["tiers"] = tuple(a.tier)
    rules = {}
    if a.internal_email:
        rules["internal_emails"] = tuple(a.internal_email)
    if a.exclude_device_type:
        rules["excluded_device_types"] = tuple(a.exclude_device_type)
    if rules:
        given["segment"] = replace(base.segment, **rules)
    return base.with_(**given)


def _sources(spark, a):
    from cohortlens.sources.fixtures import Sources, load_sources

    return Sources.from_tables(spark, dict(t.split("=", 1) for t in a.table)) if a.table else load_sources(spark, a.sf_dir)


def _refresh(spark, a) -> None:
    from cohortlens.plans.refresh import WeeklyState, in_weeks

    src = _sources(spark, a)
    ledger = src.ledger.where(in_weeks("created", a.week)) if a.week else src.ledger
    wrote = WeeklyState(spark, a.state).refresh(src, a.batch, a.week or None, ledger)
    print(f"batch {a.batch}: {'written' if wrote else 'was there already'}")


def _report(spark, a):
    from cohortlens.plans import report

    cfg = _config(a)
    src = _sources(spark, a)
    if a.state:
        from cohortlens.plans.refresh import WeeklyState

        report = WeeklyState(spark, a.state)
    if a.name.startswith("free"):
        return report.report_free(src, cfg, sent_name="ep_chats_sent" if a.name == "free_a" else "ep_chat_messages_sent")
    if a.name == "premium":
        return report.report_premium(src, cfg)
    return report.report_paid(src, cfg, orders_name="orders" if a.name == "paid_a" else "total_orders")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cohortlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list query keys")
    r = sub.add_parser("run", help="run one query")
    r.add_argument("key")
    t = sub.add_parser("report", help="run one report with its own windows, tables and rules")
    t.add_argument("name", choices=("free_a", "free_b", "paid_a", "paid_b", "premium"))
    for k in ("--spine-start", "--spine-end", "--cohort-from", "--cohort-to"):
        t.add_argument(k, type=dt.date.fromisoformat)
    t.add_argument("--table", action="append", default=[], metavar="INPUT=TABLE", help="bind an input to a catalog table")
    t.add_argument("--pack", action="append", default=[], help="SKU pattern of a pack (repeat; replaces the default)")
    t.add_argument("--tier", action="append", default=[], help="subscription tier (repeat; replaces the default)")
    t.add_argument("--internal-email", action="append", default=[], help="LIKE pattern of internal accounts (repeat)")
    t.add_argument("--exclude-device-type", action="append", type=int, default=[],
                   help="leave out users of devices of this type (repeat)")
    t.add_argument("--state", help="weekly state to report from (see refresh)")
    f = sub.add_parser("refresh", help="read the facts of some weeks into the weekly state")
    f.add_argument("--state", required=True, help="folder that driver and executors share")
    f.add_argument("--batch", required=True, help="name of the batch; a name that was applied before has no effect")
    f.add_argument("--week", action="append", type=dt.date.fromisoformat, default=[], help="Monday of a week (repeat)")
    f.add_argument("--table", action="append", default=[], metavar="INPUT=TABLE", help="bind an input to a catalog table")
    f.add_argument("--sf-dir")
    f.add_argument("--master", default="local[8]")
    f.add_argument("--checkpoint-dir", help="folder that driver and executors share")
    for x in (r, t):
        x.add_argument("--sf-dir", required=x is r, default=None)
        x.add_argument("--out")
        x.add_argument("--format", default="parquet", choices=("parquet", "csv"))
        x.add_argument("--show", type=int, default=0)
        x.add_argument("--master", default="local[8]")
        x.add_argument("--checkpoint-dir", help="folder that driver and executors share")
    return p


def main(argv=None) -> int:
    p = _parser()
    a = p.parse_args(argv)

    from cohortlens.plans import catalog
    if a.cmd == "list":
        for k in sorted(catalog.queries()):
            print(k)
        return 0
    if a.cmd in ("report", "refresh") and not (a.sf_dir or a.table):
        p.error(f"{a.cmd} needs --sf-dir or --table")

    from cohortlens.session import build_session, delete_intermediates
    extra = {"spark.checkpoint.dir": a.checkpoint_dir} if a.checkpoint_dir else None
    spark = build_session(a.master, extra=extra)
    try:
        if a.cmd == "refresh":
            _refresh(spark, a)
            return 0
        df = catalog.queries()[a.key](spark, a.sf_dir) if a.cmd == "run" else _report(spark, a)
        if a.out:
            w = df.write.mode("overwrite")
            (w.option("header", "true").csv(a.out) if a.format == "csv" else w.parquet(a.out))
        if a.show or not a.out:
            df.show(a.show or 20, truncate=False)
    finally:
        delete_intermediates(spark)
        if argv is None:
            spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
