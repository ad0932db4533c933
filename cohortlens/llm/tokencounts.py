"""Token counts: rollups by source, language and tokenizer version, maintained by deltas.

A change batch holds rows (doc_id, version, op, source, lang, tokens, seq).  ``upsert`` sets a
document's count under a tokenizer version (an insert, or a revised count), ``delete`` takes
it away.  Applying a batch looks up the touched documents' latest state and appends

* signed deltas (documents, tokens) per group: minus the old count, plus the new one,
  pre-aggregated before they are shuffled, so a hot source is a few rows per task;
* the touched documents' new state, in folders by a hash of doc_id (``BUCKETS``), so that a
  small batch reads the folders of its own documents only.

Both are written under a folder of their own; the batch counts from the moment its one-row
commit record exists.  A failed attempt leaves nothing that a reader sees, and a batch that
is already committed is not applied again.  Totals are the sum of committed deltas.

A compaction is a commit too: the latest state of every document and the summed deltas.
Readers start at the last one, so what is read and listed does not grow with the number of
batches; ``apply`` compacts after ``compact_every`` batches.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, table
from cohortlens.session import ensure_checkpoint_dir

GROUP = ["source", "lang", "version"]
KEY = ["doc_id", "version"]
BUCKETS = 64
STATE = ("doc_id bigint, version string, source string, lang string, tokens bigint, live boolean, seq bigint, batch int, "
         "part string, bucket int")
DELTA = "source string, lang string, version string, documents bigint, tokens bigint, part string"
COMMIT = "batch_id string, number int, part string, base boolean"
SPACES, RUNS = "space-1", "runs-1"  # tokenizer versions


def _bucket(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int")


class Rollup:
    """Token totals under ``folder`` (shared by driver and executors), one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, compact_every: int = 32):
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every

    def _log(self) -> DataFrame:
        spark, path = self.spark, f"{self.folder}/commits"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], COMMIT)
        return spark.read.schema(COMMIT).parquet(path)

    def commits(self) -> list:
        """The last compaction and the batches after it: at most ``compact_every`` small records and one."""
        log = self._log()
        start = log.where("base").agg(F.coalesce(F.max("number"), F.lit(0)))
        return sorted(log.where(F.col("number") >= start.first()[0]).collect(), key=lambda r: r["number"])

    def _read(self, what: str, schema: str, commits: list) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], schema)
        root = f"{self.folder}/{what}"
        return (self.spark.read.schema(schema).option("basePath", root)
                .parquet(*[f"{root}/part={r['part']}" for r in commits]))

    def _write_state(self, state: DataFrame, part: str) -> None:
        (state.withColumn("bucket", _bucket(F.col("doc_id"))).hint("rebalance", "bucket")
         .write.partitionBy("bucket").parquet(f"{self.folder}/state/part={part}"))

    def _commit(self, batch_id: str | None, number: int, part: str, base: bool) -> None:
        (self.spark.createDataFrame([(batch_id, number, part, base)], COMMIT).coalesce(1)
         .write.mode("append").parquet(f"{self.folder}/commits"))

    def state(self, commits: list, buckets: list[int] | None = None) -> DataFrame:
        """State rows of these commits, several a document; of ``buckets`` only, if given."""
        rows = self._read("state", STATE, commits)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply and commit a batch; False (and no change) if it is committed already.

        Of several changes of a document and version the highest ``seq`` counts (ties: a
        delete, else the larger count; null is lowest).  A change with a lower ``seq`` than
        the one that the document's state comes from is stale, whichever batch brings it; at
        equal ``seq`` the later batch counts.  Rows without doc_id or version, with another
        op, or upserts without a count are no changes.  Deleting what is not there leaves the
        totals alone.  Null sources and languages are groups of their own.
        """
        if not self._log().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        done = self.commits()
        number = done[-1]["number"] + 1 if done else 1
        valid = changes.where("doc_id is not null and version is not null and "
                              "(op = 'delete' or (op = 'upsert' and tokens is not null))")
        last = materialize(
            valid.groupBy(*KEY).agg(F.max(F.struct(
                F.col("seq").cast("bigint").alias("seq"), (F.col("op") == "delete").alias("gone"), "tokens", "source",
                "lang")).alias("c")), "changes")
        touched = [r[0] for r in last.select(_bucket(F.col("doc_id"))).distinct().collect()]  # BUCKETS rows at most
        old = (self.state(done, touched).join(last.select(*KEY), KEY, "left_semi")
               .groupBy(*KEY).agg(F.max(F.struct("batch", "live", "tokens", "source", "lang", "seq")).alias("s")))
        stale = F.coalesce(F.col("s.seq") > F.col("c.seq"), F.col("s.seq").isNotNull() & F.col("c.seq").isNull())
        met = materialize(last.join(old, KEY, "left").where(~stale), "met")
        minus = met.where("s.live").select("s.source", "s.lang", "version", F.lit(-1).cast("bigint").alias("documents"),
                                           (-F.col("s.tokens")).alias("tokens"))
        plus = met.where("not c.gone").select("c.source", "c.lang", "version", F.lit(1).cast("bigint").alias("documents"),
                                              F.col("c.tokens").cast("bigint").alias("tokens"))
        part = uuid.uuid4().hex
        self._summed(minus.unionByName(plus)).write.parquet(f"{self.folder}/deltas/part={part}")
        self._write_state(met.select(*KEY, "c.source", "c.lang", F.col("c.tokens").cast("bigint").alias("tokens"),
                                     (~F.col("c.gone")).alias("live"), "c.seq", F.lit(number).alias("batch")), part)
        self._commit(batch_id, number, part, False)
        if len(done) >= self.compact_every:
            self.compact()
        return True

    def compact(self) -> bool:
        """Commit the latest state and the summed deltas as a new start; False if there is nothing to fold."""
        done = self.commits()
        if len(done) < 2:
            return False
        part, number = uuid.uuid4().hex, done[-1]["number"] + 1
        self._summed(self._read("deltas", DELTA, done)).write.parquet(f"{self.folder}/deltas/part={part}")
        latest = self.state(done).groupBy(*KEY).agg(
            F.max(F.struct("batch", "source", "lang", "tokens", "live", "seq")).alias("s"))
        self._write_state(latest.select(*KEY, "s.source", "s.lang", "s.tokens", "s.live", "s.seq", "s.batch"), part)
        self._commit(None, number, part, True)
        return True

    @staticmethod
    def _summed(deltas: DataFrame) -> DataFrame:
        """source, lang, version, documents, tokens; groups that come to nothing have no row."""
        return (deltas.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
                .where("documents <> 0 or tokens <> 0"))

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens; groups without documents have no row."""
        return self._summed(self._read("deltas", DELTA, self.commits()))


def space_tokens(text):
    """Runs of characters other than space, tab, LF, VT, FF, CR; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def run_tokens(text):
    """Runs of letters, runs of digits and single other non-space characters; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]")), F.lit(0)).cast("bigint")


def op5(spark, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them sent twice.

    1. every document's count under ``space-1``; 2. every count under ``runs-1``; 3. revised
    ``space-1`` counts, for all documents that hold punctuation standing alone (it no longer
    counts); 4. exact copies are deleted under both versions: of equal texts the smallest
    doc_id stays.  Batch 3 is sent again after batch 4 and changes nothing.

    A document is a doc_id: rows without one are no documents, and of rows that share one the
    row with the largest SHA-256 of its text counts (then the largest source, then lang; nulls
    are smallest).  Null texts have no tokens and are copies of nothing; null sources and
    languages are groups of their own.  Other columns are ignored; no rows give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    alone = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]+(?![^\x20\x09-\x0D])"
    counted = materialize(docs.select(
        "doc_id", "source", "lang", space_tokens(F.col("text")).alias("spaces"), run_tokens(F.col("text")).alias("runs"),
        F.coalesce(F.regexp_count("text", F.lit(alone)), F.lit(0)).cast("bigint").alias("alone"),
        F.sha2("text", 256).alias("digest")).where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.struct("digest", "source", "lang", "spaces", "runs", "alone")).alias("d")).select("doc_id", "d.*"), "counted")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = counted.where("digest is not null").join(first, "digest").where("doc_id <> first").select(
        "doc_id", F.explode(F.array(F.lit(SPACES), F.lit(RUNS))).alias("version"), "source", "lang")

    def upsert(rows, version, tokens):
        return rows.select("doc_id", F.lit(version).alias("version"), F.lit("upsert").alias("op"), "source", "lang",
                           tokens.alias("tokens"), F.lit(0).alias("seq"))

    rollup = Rollup(spark, os.path.join(ensure_checkpoint_dir(spark), "cohortlens", f"rollup-{uuid.uuid4().hex}"))
    revised = upsert(counted.where("alone > 0"), SPACES, F.col("spaces") - F.col("alone"))
    rollup.apply("insert", upsert(counted, SPACES, F.col("spaces")))
    rollup.apply("runs", upsert(counted, RUNS, F.col("runs")))
    rollup.apply("revise", revised)
    rollup.apply("copies", copies.select("doc_id", "version", F.lit("delete").alias("op"), "source", "lang",
                                         F.lit(None).cast("bigint").alias("tokens"), F.lit(0).alias("seq")))
    rollup.apply("revise", revised)
    return rollup.totals()


OP5_SQL = r"""
WITH single AS (
  SELECT doc_id, source, lang, text FROM documents WHERE doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sha256(text) DESC NULLS LAST,
    source DESC NULLS LAST, lang DESC NULLS LAST) = 1
), kept AS (
  SELECT source, lang, text FROM single
  QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
), words AS (
  SELECT source, lang, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM kept
), counts AS (
  SELECT source, lang, 'space-1' AS version,
         len([x for x in w if regexp_matches(x, '[\p{L}\p{N}]')]) AS tokens FROM words
  UNION ALL
  SELECT source, lang, 'runs-1',
         len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]')) FROM words
)
SELECT source, lang, version, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counts GROUP BY source, lang, version
"""
