"""Running balances that grow with new ledger rows only (M28 kept up to date).

``BalanceState`` keeps, per user, the closing balance and the last ``created`` seen.  New rows of a
user that all lie after it start from the closing balance: the old ledger is not read.  A row at or
before it *re-opens* the user (rows of one ``created`` share a balance, so a tie does too): the
user's rows are fetched from the state and the user is scanned again.

Kept under a folder, in committed batches (``sources.store``):

* ``ledger``: rows with their balance, in ``BUCKETS`` folders by a hash of the user, so that
  re-opened users are found without reading the others' folders;
* ``closing``: a whole snapshot a batch: user, closing balance, last created, whether a row has no
  ``created`` (those sort last), and the batch since which the user's rows count;
* ``zeros``: the (user, week) pairs in which the balance was 0.

A re-opened user's rows are written again in the new batch and older ones stop counting.  Balances
keep the ledger's type and NULL rules: a sum over NULLs only is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.weeks import week_of
from cohortlens.operators.scan import _plus, keyed_scan
from cohortlens.plans.joins import broadcast_if_small
from cohortlens.session import materialize
from cohortlens.sources.store import Store

BUCKETS = 64
LEDGER_COLS = ("id", "user_id", "balance_change", "created")


class BalanceState:
    def __init__(self, spark: SparkSession, root: str):
        self.store = Store(spark, root)

    def _bucket(self, user):
        return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")

    def _names(self) -> list[str]:
        return [c.batch for c in self.store.commits()]

    def _schemas(self, batch: str) -> dict[str, T.StructType]:
        """Types of the first batch's tables: amounts and times keep the ledger's own."""
        read = self.store.spark.read
        return {t: read.parquet(f"{self.store.root}/{t}/batch={batch}").schema for t in ("ledger", "closing", "zeros")}

    def _live(self, table: str, names: list[str]) -> DataFrame:
        """Rows of a table that count, i.e. not older than their user's last re-opening."""
        rows = self.store.read(table, self._schemas(names[0])[table], names)
        order = {b: i for i, b in enumerate(names)}
        number = F.create_map(*[x for b, i in order.items() for x in (F.lit(b), F.lit(i))])
        since = self._closing(names).select(F.col("user_id").alias("_user"), "since")
        rows = rows.withColumn("_n", number[F.col("batch")])
        return (rows.join(since, F.col("user_id").eqNullSafe(F.col("_user"))).where("_n >= since")
                .drop("_n", "_user", "since", "batch"))

    def _closing(self, names: list[str]) -> DataFrame:
        return self.store.read("closing", self._schemas(names[0])["closing"], names[-1:]).drop("batch")

    def apply(self, rows: DataFrame, batch: str, skip_known: bool = False) -> bool:
        """Add ledger rows (id, user_id, balance_change, created); False if the batch was applied before.

        Rows without user are one user, as in a window's partition.  Repeated rows each count,
        but with ``skip_known`` a row whose user and id an earlier batch held is not added again.
        (Such a row re-opens its user, whose rows are then at hand; no other is looked up.)
        """
        names = self._names()
        if batch in names:
            return False
        n, user = len(names), F.col("user_id")
        new = materialize(rows.select(*LEDGER_COLS), "new_ledger_rows")
        if not names:
            opened, opening, old = new, None, None
        else:
            old, kind = self._closing(names), self._schemas(names[0])
            touched = new.groupBy("user_id").agg(F.min("created").alias("_first"))
            late = (F.col("_first") <= F.col("last_created")) | F.col("undated")
            mine = old.withColumnRenamed("user_id", "_user")
            state = materialize(touched.join(mine, user.eqNullSafe(F.col("_user")))
                                .select("_user", "closing", F.coalesce(late, F.lit(False)).alias("late")), "touched_users")
            again = materialize(state.where("late").select("_user", self._bucket("_user").alias("_bucket")), "reopened_users")
            opening = state.where("not late").select("_user", "closing")
            # the re-opened users' own rows; folders of other buckets are not read
            buckets = [r["_bucket"] for r in again.select("_bucket").distinct().collect()]
            opened = new
            if buckets:
                before = self._live("ledger", names).where(F.col("bucket").isin(buckets)).join(
                    broadcast_if_small(again), user.eqNullSafe(F.col("_user")), "left_semi")
                if skip_known:
                    held = before.select(F.col("user_id").alias("_held"), F.col("id").alias("_id"))
                    opened = new.join(held, user.eqNullSafe(F.col("_held")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti")
                opened = opened.unionByName(before.select(*LEDGER_COLS))
        scanned = keyed_scan(opened.select(*LEDGER_COLS), "user_id", ["created"], "balance", mode="range",
                             value="balance_change")
        if opening is not None:
            scanned = (scanned.join(broadcast_if_small(opening), user.eqNullSafe(F.col("_user")), "left")
                       .withColumn("balance", _plus(F.col("balance"), F.col("closing")).cast(kind["ledger"]["balance"].dataType))
                       .drop("_user", "closing"))
        written = self.store.write("ledger", batch, scanned.withColumn("bucket", self._bucket("user_id")), by=("bucket",))
        ends = written.groupBy("user_id").agg(
            F.sum("balance_change").alias("_sum"), F.max("created").alias("last_created"),
            F.max(F.col("created").isNull()).alias("undated"))
        if opening is None:
            closing = ends.select("user_id", F.col("_sum").alias("closing"), "last_created", "undated", F.lit(n).alias("since"))
        else:
            # the rows of this batch replace a re-opened user's past and extend any other's
            prior = old.select(F.col("user_id").alias("_user"), F.col("closing").alias("_closing"),
                               F.col("last_created").alias("_last"), F.col("undated").alias("_undated"), F.col("since").alias("_since"))
            prior = prior.join(again.select(F.col("_user").alias("_again")), F.col("_user").eqNullSafe(F.col("_again")), "left_anti")
            # markers tell a null user from no match
            both = ends.withColumn("_new", F.lit(True)).join(
                prior.withColumn("_old", F.lit(True)), user.eqNullSafe(F.col("_user")), "full")
            closing = both.select(
                F.when(F.col("_new"), user).otherwise(F.col("_user")).alias("user_id"),
                _plus(F.col("_sum"), F.col("_closing")).cast(kind["closing"]["closing"].dataType).alias("closing"),
                F.greatest("last_created", "_last").alias("last_created"),
                (F.coalesce("undated", F.lit(False)) | F.coalesce("_undated", F.lit(False))).alias("undated"),
                F.coalesce("_since", F.lit(n)).alias("since"))
        self.store.write("closing", batch, closing)
        zeros = written.where("balance = 0 and created is not null").select("user_id", week_of("created").alias("week")).distinct()
        self.store.write("zeros", batch, zeros)
        self.store.commit(batch)
        return True

    def balances(self) -> DataFrame:
        """Every ledger row applied so far with its running balance."""
        return self._live("ledger", self._names()).select(*LEDGER_COLS, "balance")

    def zero_weeks(self) -> DataFrame:
        """(user_id, week) in which a running balance was 0."""
        return self._live("zeros", self._names()).select("user_id", "week")
