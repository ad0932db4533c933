"""The skew-safe keyed scan equals Spark's Window functions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.scan import keyed_scan


@pytest.fixture
def data(spark):
    rows = []
    i = 0
    for day in range(40):
        for _ in range(5):  # many ties per (user, day)
            i += 1
            user = 7 if i % 3 == 0 else (None if i % 97 == 0 else i % 11)
            rows.append((i, user, day % 13, (-1) ** i * (i % 4)))
    return spark.createDataFrame(rows, "id bigint, user_id bigint, t int, v int")


@pytest.mark.parametrize("parts", [1, 5, 7])
def test_range_sum_matches_window(spark, data, parts):
    got = keyed_scan(data, "user_id", ["t"], "s", mode="range", value="v", num_partitions=parts)
    exp = data.withColumn("s", F.sum("v").over(Window.partitionBy("user_id").orderBy(F.col("t").asc_nulls_last())).cast("bigint"))
    a, b = got.select("id", "s"), exp.select("id", "s")
    assert got.count() == data.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("parts", [1, 6, 9])
def test_row_number_matches_window(spark, data, parts):
    got = keyed_scan(data, "user_id", ["t", "id"], "r", num_partitions=parts)
    exp = data.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("t").asc_nulls_last(), "id")).cast("bigint"))
    a, b = got.select("id", "r"), exp.select("id", "r")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_key_spreads_over_partitions(spark, data):
    """A user with a third of the rows is scanned by several tasks."""
    from cohortlens.operators import scan as S
    ranged = data.repartitionByRange(6, "user_id", "t", "id")
    per_part = (ranged.where(F.col("user_id") == 7).groupBy(F.spark_partition_id().alias("p")).count().count())
    assert per_part >= 2


def test_aqe_sized_partitions_match_window(spark, data):
    """No explicit count: AQE coalesces adjacent range partitions; results stay exact."""
    confs = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2kb",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        got = keyed_scan(data, "user_id", ["t", "id"], "r")
        exp = data.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("t").asc_nulls_last(), "id")).cast("bigint"))
        a, b = got.select("id", "r"), exp.select("id", "r")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        got = keyed_scan(data, "user_id", ["t"], "s", mode="range", value="v")
        exp = data.withColumn("s", F.sum("v").over(Window.partitionBy("user_id").orderBy(F.col("t").asc_nulls_last())).cast("bigint"))
        a, b = got.select("id", "s"), exp.select("id", "s")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


ROWS = [  # hot user 2**53 + 1 beside 2**53, NULL keys, times of day, NULL times and amounts, fractions
    (2**53 + i % 2 if i % 3 else None, None if i % 11 == 0 else f"2017-01-0{1 + i % 4} 0{i % 10}:00:00",
     None if i % 5 == 0 or i % 4 == 3 and i % 3 == 1 else f"{i % 7}.{i % 4}5", 2**53 + i) for i in range(200)]


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("mode", ["row_number", "range"])
def test_types_and_nulls_against_duckdb(spark, mode, parts):
    """64-bit ids, decimals, NULL keys, amounts and times, and timestamps with a time of day."""
    import duckdb

    df = spark.createDataFrame(ROWS, "user_id bigint, at string, amount string, id bigint").select(
        "user_id", F.to_timestamp("at").alias("created"), F.col("amount").cast("decimal(10,2)").alias("amount"), "id")
    got = keyed_scan(df, "user_id", ["created", "id"] if mode == "row_number" else ["created"], "o", mode=mode, value="amount",
                     num_partitions=parts)
    assert dict(got.dtypes)["user_id"] == "bigint" and dict(got.dtypes)["amount"] == "decimal(10,2)"
    con = duckdb.connect()
    con.execute("create table t(user_id bigint, created timestamp, amount decimal(10,2), id bigint)")
    con.executemany("insert into t values (?, ?, ?, ?)", ROWS)
    what = "row_number() over (partition by user_id order by created, id)" if mode == "row_number" else (
        "sum(amount) over (partition by user_id order by created)")
    expect = con.execute(f"select id, user_id, amount, {what} from t order by id").fetchall()
    rows = [(r["id"], r["user_id"], r["amount"], r["o"]) for r in got.orderBy("id").collect()]
    assert rows == expect


def test_null_amounts_only(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, 4), (1, 4, None)], "user_id bigint, t int, v int")
    got = keyed_scan(df, "user_id", ["t"], "s", mode="range", value="v", num_partitions=3).orderBy("t").collect()
    assert [r["s"] for r in got] == [None, None, 4, 4]


@pytest.mark.parametrize("parts", [1, 6, 11])
def test_kept_order_is_global_and_needs_one_range_exchange(spark, data, parts):
    got = keyed_scan(data, "user_id", ["t"], "s", mode="range", value="v", num_partitions=parts, ordered_by=["id"])
    rows = [(r["user_id"] is None, r["user_id"], r["t"], r["id"]) for r in got.collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2], r[3])) and len(rows) == data.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    plain = keyed_scan(data, "user_id", ["t"], "s", mode="range", value="v", num_partitions=parts)
    assert got.exceptAll(plain).count() == 0


def test_no_exchange_by_user_for_the_offsets(spark, data):
    """What is exchanged for the offsets are one row a partition; no exchange is on the user."""
    import re

    got = keyed_scan(data, "user_id", ["t"], "s", mode="range", value="v", num_partitions=6, ordered_by=[])
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*user_id", plan)


def test_a_key_over_many_partitions_and_keys_that_fill_one(spark):
    rows = [(1, i, 1) for i in range(50)] + [(2, i, 1) for i in range(3)] + [(None, i, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id bigint, t int, v int")
    for parts in (2, 9, 30):
        got = keyed_scan(df, "user_id", ["t"], "s", mode="range", value="v", num_partitions=parts)
        assert all(r["s"] == r["t"] + 1 for r in got.collect())
