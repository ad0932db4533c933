"""Session defaults and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

# Settings a report job wants at any scale: AQE re-plans joins from
# runtime sizes (broadcast only what turned out small), splits skewed
# shuffle partitions and coalesces tiny ones.
SPARK_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "cohortlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (UI off, no ports beyond Spark's own)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in {**SPARK_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a folder that the driver and
    all executors share, and is used as is.  Only a local master may leave it
    unset; then a fresh local folder is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = _LOCAL_DIRS.setdefault(
            "dir", tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def delete_intermediates(spark: SparkSession) -> int:
    """Delete the folders that ``materialize`` wrote in this application; their number.

    For the end of a run: DataFrames that read those folders no longer work.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder; ``delete_intermediates`` removes what is written there."""
    path = os.path.join(ensure_checkpoint_dir(spark), "cohortlens", f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (the rows survive executor loss) and is computed once,
    unlike an RDD checkpoint of an unpersisted plan.  Used where one
    intermediate result feeds several branches: the segment and the chat,
    payment and ledger intermediates of a report, and the branches of the
    range-partitioned scan, which must see identical partitions.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def build_concurrently(builders: dict) -> dict:
    """Run independent builders (callables returning DataFrames) from separate threads.

    Each builder typically writes an intermediate (``materialize``); Spark
    accepts jobs from several driver threads and runs them side by side,
    so independent writes overlap instead of queueing one after another.
    """
    if len(builders) <= 1:
        return {k: f() for k, f in builders.items()}
    out: dict = {}
    failed: list[BaseException] = []

    def run(key, build):
        try:
            out[key] = build()
        except BaseException as e:  # noqa: BLE001  raised again below
            failed.append(e)

    # these threads inherit the caller's job group and other local properties
    threads = [InheritableThread(target=run, args=item) for item in builders.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return {k: out[k] for k in builders}
