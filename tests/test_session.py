"""Where intermediates live, and that they can be deleted; fixture loading sees new files."""

import os
from types import SimpleNamespace

import pytest

from cohortlens import session
from cohortlens.sources.fixtures import load_sources
from tests.conftest import SF0001


def _fake(master):
    conf = SimpleNamespace(get=lambda k, d=None: d)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_fake(master))


def test_intermediates_can_be_deleted(spark):
    df = session.materialize(spark.range(10), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and df.count() == 10
    assert session.delete_intermediates(spark) >= 1
    assert not os.path.exists(os.path.dirname(path)) and session.delete_intermediates(spark) == 0


def test_concurrent_builders_keep_the_job_group_and_raise(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("cohortlens.mark", "here")
    got = session.build_concurrently({k: lambda: sc.getLocalProperty("cohortlens.mark") for k in "ab"})
    assert got == {"a": "here", "b": "here"}
    with pytest.raises(ZeroDivisionError):
        session.build_concurrently({"a": lambda: 1 / 0, "b": lambda: 1})


def test_a_file_added_later_is_read(spark, tmp_path):
    base = str(tmp_path)
    for t in ("customer", "nation", "orders", "lineitem"):
        spark.read.parquet(f"{SF0001}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    before = load_sources(spark, base).users.count()
    spark.read.parquet(f"{SF0001}/customer.parquet").write.mode("append").parquet(f"{base}/customer.parquet")
    assert load_sources(spark, base).users.count() == 2 * before
