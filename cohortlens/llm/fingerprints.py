"""Document fingerprints: a homomorphic multiset hash over paragraphs, in SQL functions only.

Every paragraph (line) hashes to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two.  Equal multisets of paragraphs have
equal fingerprints in any order, and a paragraph is inserted or deleted by adding or
subtracting its own fingerprint (``add``, ``subtract``).

The vector has two parts:

* ``STRICT`` lanes modulo 2^32, hashed from the whole paragraph: equality.
* ``LANES`` lanes modulo 2^16.  The paragraph is cut into pieces of a few words at places
  that its own letters choose, at ``PIECE`` code points at the latest (scripts without spaces,
  or without these letters); every piece adds +1 or -1 to every lane, by its hash.  The
  squared length of a difference of two such vectors estimates the size of the symmetric
  difference of the two piece multisets (a piece that is m times more in one counts m^2), so
  ``likeness`` is 1 - |a - b|^2 / (|a|^2 + |b|^2), clipped to 0 .. 1.  Its error is about
  1 / sqrt(LANES).

Summing needs no Python: pieces are exploded, each contributes 64 masked shifts of its two
64-bit hashes (two lanes to a bigint), and a partial aggregate adds them up before any row
moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import partitions, table

STRICT = 16
LANES = 128
STRICT_MOD = 1 << 32
LANE_MOD = 1 << 16
HEX = STRICT * 8 + LANES * 4  # length of a fingerprint
PIECE = 16
# a piece ends at a line's end, at a space after one of some letters and marks, after a full-width mark,
# or PIECE code points after the last end
CUTS = r" (?<=[dnrtднртй.,;:!?|] )|\n|(?<=[。、，！？；：])|(?<=\G.{" + str(PIECE) + "})"
_PAIR = (1 << 32) | 1


def _strict_hex(text: Column) -> Column:
    """The strict lanes of a text, as lower-case hexadecimal digits."""
    roots = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.sha2(p, 256))
    mask = F.lit(STRICT_MOD - 1)

    def lane(k):
        return F.aggregate(roots, F.lit(0).cast("bigint"),
                           lambda acc, r: (acc + F.xxhash64(r, k).bitwiseAND(mask)).bitwiseAND(mask))

    lanes = F.transform(F.sequence(F.lit(0), F.lit(STRICT - 1)), lane)
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _sums(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, lanes (array<int>, modulo ``LANE_MOD``) summed over the pieces of ``text``."""
    pieces = rows.select(*keys, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), CUTS)).alias("__p"))
    real = F.col("__p") != ""
    hashed = pieces.select(*keys, real.cast("bigint").alias("__n"),
                           F.when(real, F.xxhash64("__p")).otherwise(F.lit(0).cast("bigint")).alias("__a"),
                           F.when(real, F.xxhash64("__p", F.lit("again"))).otherwise(F.lit(0).cast("bigint")).alias("__b"))
    pair = F.lit(_PAIR)
    sums = [F.sum(F.shiftrightunsigned(F.col(c), i).bitwiseAND(pair)).alias(f"{c}{i}") for c in ("__a", "__b")
            for i in range(32)]
    got = hashed.groupBy(*keys).agg(F.sum("__n").alias("__n"), *sums)
    both = F.array(*[F.col(f"{c}{i}") for c in ("__a", "__b") for i in range(32)])
    low, high = F.lit(0xFFFFFFFF), 32
    # bits set -> signed sum: 2 * set - pieces, modulo LANE_MOD
    ones = F.flatten(F.transform(both, lambda s: F.array(s.bitwiseAND(low), F.shiftrightunsigned(s, high))))
    lanes = F.transform(ones, lambda x: (x * 2 - F.col("__n")).bitwiseAND(F.lit(LANE_MOD - 1)).cast("int"))
    return got.select(*keys, lanes.alias("lanes"))


def _lanes_hex(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def _centred(x: Column) -> Column:
    half = LANE_MOD // 2
    return ((x + F.lit(half)).bitwiseAND(F.lit(LANE_MOD - 1)) - F.lit(half)).cast("double")


def _square(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + _centred(x) * _centred(x))


def likeness_of_lanes(a: Column, b: Column) -> Column:
    apart = _square(F.zip_with(a, b, lambda x, y: x - y))
    both = _square(a) + _square(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / both)))


def _decode(fp: Column, start: int, width: int, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(
        F.substring(fp, F.lit(start + 1) + i * width, F.lit(width)), 16, 10).cast("bigint"))


def lanes_of(fp: Column) -> Column:
    """The likeness lanes of a fingerprint."""
    return _decode(fp, STRICT * 8, 4, LANES)


def likeness(a: Column, b: Column) -> Column:
    """Estimated likeness of two fingerprints, 0 to 1; equal ones have 1, null gives null."""
    return F.when(a == b, F.lit(1.0)).otherwise(likeness_of_lanes(lanes_of(a), lanes_of(b)))


def _combine(a: Column, b: Column, sign: int) -> Column:
    def part(start, width, count, modulus):
        both = F.zip_with(_decode(a, start, width, count), _decode(b, start, width, count),
                          lambda x, y: (x + y * sign).bitwiseAND(F.lit(modulus - 1)))
        return F.lower(F.array_join(F.transform(both, lambda x: F.lpad(F.hex(x), width, "0")), ""))

    return F.concat(part(0, 8, STRICT, STRICT_MOD), part(STRICT * 8, 4, LANES, LANE_MOD))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of both multisets together."""
    return _combine(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of a without the paragraphs of b."""
    return _combine(a, b, -1)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fingerprint, lanes: one row per distinct ``keys`` (they must name a row).

    Null and empty texts are one empty paragraph and have equal fingerprints.  Rows with the
    same keys must have the same text.  Other columns are ignored; no rows give none.
    """
    strict = rows.select(*keys, F.col(text).alias("__text"), _strict_hex(F.col(text)).alias("__strict"))
    got = _sums(strict, [*keys, "__strict"], "__text")
    return got.select(*keys, F.concat("__strict", _lanes_hex(F.col("lanes"))).alias("fingerprint"), "lanes")


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, tail, doc_id, text, next_text): every row and its follower by falling doc_id.

    The rows are dealt by ranges of doc_id, so that one shuffle brings each row beside its
    follower.  The range bounds are quantiles (as many as shuffle partitions), and each
    range also gets a copy of the next range's first document (``tail``; the last range
    that of the very first), so nothing but those bounds passes the driver.  Ties are in
    order of their text; null ids come last, null texts count as empty.  Rows that share a
    doc_id share a range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(bounds or []), reverse=True)
    cut = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(
        F.size(F.filter(cut, lambda b: b > F.col("doc_id"))))
    firsts = rows.select(bucket.alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    firsts = sorted((r["bucket"], r["top"]) for r in firsts)
    follows = [(firsts[(i + 1) % len(firsts)][1], b) for i, (b, _) in enumerate(firsts)]
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("tail"))
    if follows:
        known = F.array(*[F.struct(F.lit(d).cast("bigint").alias("d"), F.lit(b).alias("bucket"), F.lit(1).alias("tail"))
                          for d, b in follows])
        copies = F.transform(F.filter(known, lambda k: k["d"].eqNullSafe(F.col("doc_id"))),
                             lambda k: F.struct(k["bucket"].alias("bucket"), k["tail"].alias("tail")))
        placed = rows.withColumn("at", F.explode(F.concat(F.array(own), copies)))
    else:
        placed = rows.withColumn("at", F.explode(F.array(own)))
    # one task a range: hashed range numbers would leave some tasks empty and give others several
    placed = placed.select("at.bucket", "at.tail", "doc_id", "text").repartitionById(len(bounds) + 1, "bucket")
    order = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").desc_nulls_last(), "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))


def edited(docs: DataFrame) -> DataFrame:
    """The contract's comparison of every text with its edited text and with the next text.

    Edited: the last floor(n_chars / 3) code points give way to the first as many (or all) of
    the next document's, in order of falling doc_id, the first document after the last.  A
    single row follows itself.  Repeated rows are compared each.
    """
    rows = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    new = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"),
                   F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    keys = ["bucket", "place", "tail", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select("bucket", "place", "tail", "doc_id", n.cast("bigint").alias("n_chars"),
                       F.sha2(new, 256).alias("edited_sha256"), "text", new.alias("new"))
    sides = both.select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
        F.struct(F.lit(1).alias("side"), F.col("new").alias("body")))))
    got = fingerprints(sides.where("side = 0 or tail = 0"), [*keys, "side"], "body")
    wide = got.groupBy(*keys).agg(*[F.first(F.when(F.col("side") == s, F.col(c)), True).alias(f"{c}{s}")
                                    for s in (0, 1) for c in ("fingerprint", "lanes")])
    order = Window.partitionBy("bucket").orderBy("place")
    out = wide.withColumn("follower", F.lead(F.struct("fingerprint0", "lanes0")).over(order)).where("tail = 0")

    def like(fa, fb, la, lb):
        return F.when(F.col(fa) == F.col(fb), F.lit(1.0)).otherwise(likeness_of_lanes(F.col(la), F.col(lb)))

    return out.select("doc_id", "n_chars", "edited_sha256", F.col("fingerprint0").alias("fingerprint"),
                      F.col("fingerprint1").alias("edited_fingerprint"),
                      like("fingerprint0", "fingerprint1", "lanes0", "lanes1").alias("near_edited"),
                      like("fingerprint0", "follower.fingerprint0", "lanes0", "follower.lanes0").alias("near_next"))


def op1(spark, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
