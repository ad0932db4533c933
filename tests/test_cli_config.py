"""CLI listing and run-parameter validation (no Spark needed)."""

import datetime as dt

import pytest

from cohortlens import config as C
from cohortlens.__main__ import main


def test_cli_lists_every_key(capsys):
    assert main(["list"]) == 0
    keys = capsys.readouterr().out.split()
    assert len(keys) == 64 and "report_paid_uk" in keys and keys == sorted(keys)


@pytest.mark.parametrize("field", ["spine_start", "cohort_from", "cohort_to"])
def test_windows_must_start_on_monday(field):
    with pytest.raises(ValueError):
        C.FREE_A.with_(**{field: dt.date(2016, 12, 6)})


def test_spine_order_and_rank_mode():
    with pytest.raises(ValueError):
        C.PAID_A.with_(spine_end=dt.date(2016, 11, 1))
    with pytest.raises(ValueError):
        C.PAID_A.with_(rank_mode="random")
    assert C.PREMIUM.last_week == dt.date(2017, 2, 13) and C.PREMIUM.spine_end.weekday() == 1
    assert C.PAID_A.n_weeks == 11


# The five windows of the published scripts, as (report, arguments, cohort weeks on the spine).
WINDOWS = [
    ("free_a", ["--spine-start", "2016-12-05", "--spine-end", "2017-02-13", "--cohort-from", "2016-12-05", "--cohort-to", "2017-01-09"]),
    ("free_b", ["--spine-start", "2016-12-19", "--spine-end", "2017-01-02", "--cohort-from", "2016-12-12"]),
    ("paid_a", ["--spine-start", "2016-12-12", "--spine-end", "2017-01-16", "--cohort-from", "2016-12-12"]),
    ("paid_b", ["--spine-start", "2016-12-12", "--spine-end", "2017-01-02", "--cohort-from", "2016-12-19"]),
    ("premium", ["--spine-start", "2016-12-05", "--spine-end", "2017-01-10", "--cohort-from", "2016-12-05"]),
]


@pytest.mark.parametrize("name,window", WINDOWS, ids=[w[0] for w in WINDOWS])
def test_reports_with_windows_from_the_command_line(spark, tmp_path, name, window):
    out = str(tmp_path / "out")
    assert main(["report", name, *window, "--sf-dir", "/root/testdata/sf0.001", "--out", out]) == 0
    rows = spark.read.parquet(out).collect()
    a = dict(zip(window[::2], window[1::2], strict=True))
    assert rows and all(r.cohort_week >= dt.date.fromisoformat(a["--cohort-from"]) for r in rows)
    assert all(dt.date.fromisoformat(a["--spine-start"]) <= r.activity_week <= dt.date.fromisoformat(a["--spine-end"]) for r in rows)


def test_report_needs_an_input():
    with pytest.raises(SystemExit):
        main(["report", "free_a"])


def test_refresh_then_report_from_the_state(spark, tmp_path, capsys):
    from cohortlens import config as C
    from cohortlens.__main__ import main
    from cohortlens.plans import report
    from cohortlens.sources.fixtures import load_sources

    state, sf = str(tmp_path / "state"), "/root/testdata/sf0.001"
    assert main(["refresh", "--state", state, "--batch", "all", "--sf-dir", sf]) == 0
    assert main(["refresh", "--state", state, "--batch", "again", "--week", "2017-01-02", "--sf-dir", sf]) == 0
    assert main(["refresh", "--state", state, "--batch", "again", "--week", "2017-01-02", "--sf-dir", sf]) == 0
    assert "was there already" in capsys.readouterr().out
    assert main(["report", "paid_a", "--state", state, "--sf-dir", sf, "--out", str(tmp_path / "r")]) == 0
    got = spark.read.parquet(str(tmp_path / "r"))
    full = report.report_paid(load_sources(spark, sf), C.PAID_A)
    assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))
