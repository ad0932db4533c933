"""Measure a report's I/O with and without the shared intermediates.

    python tools/shuffle_bytes.py <sf_dir> <paid|free|premium> <reuse:1|0> <scratch_dir>

Runs the report once (after a warm-up in the same session) with Spark's
event log written to ``scratch_dir`` and prints one JSON line with the
totals of input bytes, shuffle bytes written and output bytes written,
the number of jobs and the wall time.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir, kind, reuse, scratch = sys.argv[1], sys.argv[2], sys.argv[3] == "1", sys.argv[4]
    from cohortlens import config as C
    from cohortlens.plans import report
    from cohortlens.session import build_session
    from cohortlens.sources.fixtures import load_sources

    spark = build_session("local[8]", 8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": scratch,
                                                         "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    src = load_sources(spark, sf_dir)
    build = {"paid": lambda: report.report_paid(src, C.PAID_A, reuse=reuse),
             "free": lambda: report.report_free(src, C.FREE_A, reuse=reuse),
             "premium": lambda: report.report_premium(src, C.PREMIUM, reuse=reuse)}[kind]
    build().write.format("noop").mode("overwrite").save()  # warm-up
    spark.sparkContext.setJobGroup("measure", "measure")
    t0 = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    wall = time.perf_counter() - t0
    app = spark.sparkContext.applicationId
    spark.stop()
    totals = {"input_bytes": 0, "shuffle_write_bytes": 0, "output_bytes": 0, "jobs": 0}
    measured_jobs = set()
    stage_job = {}
    events = []
    for path in glob.glob(os.path.join(scratch, f"{app}*")):
        with open(path) as fh:
            events += [json.loads(line) for line in fh]
    for e in events:
        if e["Event"] == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            if props.get("spark.jobGroup.id") == "measure":
                measured_jobs.add(e["Job ID"])
                for s in e.get("Stage IDs", []):
                    stage_job[s] = e["Job ID"]
    totals["jobs"] = len(measured_jobs)
    for e in events:
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Stage ID") in stage_job:
            m = e.get("Task Metrics") or {}
            totals["input_bytes"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
            totals["shuffle_write_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            totals["output_bytes"] += (m.get("Output Metrics") or {}).get("Bytes Written", 0)
    print(json.dumps({"report": kind, "reuse": reuse, "sf_dir": sf_dir, "wall_sec": round(wall, 3), **totals}))


if __name__ == "__main__":
    main()
