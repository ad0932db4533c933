"""From raw documents to packed training sequences, one operator a stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.  ``run`` applies them to the table ``documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import mixing, packing, quality, setsketch, toxicity
from cohortlens.llm.common import materialize, small, table

ORACLE_SQL = None  # trained models, sketches and a tokenizer: tested against brute force instead


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (operator 6)."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject (operator 2)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 4, five words, 0.8).

    Every row gets a number of its own, written with it, so that no two rows can be mixed up
    and a lost task finds the same numbers again.  Of a group the row with the smallest
    doc_id stays (rows without doc_id come last), then the smallest MD5 of the text, then of
    the other columns.  Rows without words are linked with nothing, and all of them stay.
    """
    words = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    named = materialize(docs.where(words).withColumn("__id", F.monotonically_increasing_id()), "named")
    found = setsketch.near_duplicates(named.select(F.col("__id").alias("doc_id"), "text"), k=5, percent=80)
    group = found.select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__group"))
    rest = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
    order = named.select("__id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5("text").alias("text"),
                                          F.md5(rest).alias("rest"), "__id").alias("__order"))
    kept = order.join(group, "__id").groupBy("__group").agg(F.min("__order").alias("first")).select(
        F.col("first.__id").alias("__id"))
    return named.join(kept, "__id", "left_semi").select(docs.columns).unionByName(docs.where(~words))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources (operator 9), in blocks of a sequence's length in words.

    Every pass that takes words of a document gives a row for each run of consecutive words
    that it takes, with the white space between them; a whole document is unchanged.  A
    document of which nothing is taken has no row.  Identical rows each get what the mix
    takes from any of them.
    """
    keyed = docs.withColumn("__copy", F.xxhash64("text"))
    got = mixing.Mix(keyed, block=packing.LENGTH, copy="__copy").joined()
    if got is None:
        return docs.limit(0)
    takes = (got.groupBy("doc_id", "copy", "pass")
             .agg(F.array_sort(F.collect_set(F.struct(
                 F.col("from_word").cast("bigint").alias("a"), F.col("words").cast("bigint").alias("n")))).alias("__spans"))
             .select(F.col("doc_id").alias("__id"), F.col("copy").alias("__of"), "__spans"))
    rows = keyed.join(takes, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__copy") == F.col("__of")))
    return rows.select(*docs.columns, "__spans").mapInArrow(_taken_words, docs.schema)


def _runs_of_words(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """The text of each run of taken words; ``spans``: (first word, words), sorted."""
    ends = []
    for a, n in spans:
        if ends and a <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], a + n)
        else:
            ends.append([a, a + n])
    if ends == [[0, len(raw.split())]]:
        return [raw]
    at = [m.span() for m in re.finditer(rb"\S+", raw)]
    return [raw[at[a][0]:at[b - 1][1]] for a, b in ends]


def _taken_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        texts, place = [], []
        for i, (t, spans) in enumerate(zip(b.column("text"), b.column("__spans"), strict=True)):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            for run in _runs_of_words(raw, [(s["a"], s["n"]) for s in spans.as_py()]):
                texts.append(run.decode("utf-8", "surrogatepass"))
                place.append(i)
        own = {"text": pa.array(texts, b.schema.field("text").type)}
        if "n_chars" in b.schema.names:
            own["n_chars"] = pa.array([len(t) for t in texts], b.schema.field("n_chars").type)
        names, place = [n for n in b.schema.names if n != "__spans"], pa.array(place, pa.int64())
        yield pa.RecordBatch.from_arrays([own[n] if n in own else b.column(n).take(place) for n in names], names=names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 2048 tokens (operator 10)."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", keep_good),
    ("near_dedup", one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
