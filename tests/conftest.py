import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from cohortlens.session import SPARK_DEFAULTS, ensure_checkpoint_dir

    b = (SparkSession.builder.master("local[4]").appName("cohortlens-tests")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "8"))
    for k, v in SPARK_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlens-test-ckpt-"))
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
