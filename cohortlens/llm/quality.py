"""Quality scores from document statistics: random Fourier features, ridge, isotonic map.

1. Every whole text becomes a fixed vector of statistics (``STATS``): lengths, shares of
   character kinds, repetition of words, lines and word triples, and so on.  Neither
   language nor source nor id nor label is among them.
2. ``FEATURES`` random Fourier features, cos(W x + b), approximate a Gaussian kernel over the
   standardised statistics.
3. Each partition sums its own normal equations over the fitting folds; the sums meet in
   ``MERGERS`` tasks, and only those few matrices reach the driver, whatever the input size.
4. The ridge score is calibrated by isotonic regression on a fold that took no part in the
   fit, over a fixed grid of score cells counted by Spark.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fold, materialize, non_empty, small, table
from cohortlens.llm.setsketch import ShingleHasher
from cohortlens.plans.joins import broadcast_if_small

FEATURES = 384
SIGMA = 2.0  # kernel width in units of sqrt(number of statistics)
RIDGE = 1e-2  # times the number of fitted rows
MERGERS = 8
CELLS = 4096
SEED = 11
THRESHOLD = 0.7
STATS = ("log_chars", "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "spaces",
         "punctuation", "ends", "bangs", "bars", "marks", "non_ascii", "line_ends", "log_line", "line_sd", "distinct_words",
         "top_word", "repeated_lines", "repeated_triples", "entropy", "upper_words", "ended_words")

_KIND = np.zeros((256, 6))
for _c in range(256):
    _KIND[_c] = [chr(_c).isalpha() and _c < 128, 65 <= _c < 91, 48 <= _c < 58, _c in b" \t\n\r\x0b\x0c",
                 33 <= _c < 127 and not chr(_c).isalnum(), _c >= 128]
_ENDS = [p + s for p in (b".", b",", b";", b":", b"!", b"?") for s in (b" ", b"\n")]


def statistics(text: str | None, hasher: ShingleHasher) -> np.ndarray:
    """The statistics of one whole text; null, empty and blank texts give zeros."""
    out = np.zeros(len(STATS))
    raw = (text or "").encode("utf-8", "surrogatepass")
    toks = raw.split()
    if not toks:
        return out
    n, words = len(raw), len(toks)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters, upper, digits, spaces, punct, high = count @ _KIND / n
    length = np.array(list(map(len, toks)))
    lines = [x for x in raw.split(b"\n") if x]
    per_line = np.array([len(x) for x in lines]) if lines else np.zeros(1)
    h = hasher.hashes(raw.lower().split())
    _, times = np.unique(h, return_counts=True)
    triples = hasher.sets(h)
    share = count[count > 0] / n
    out[:] = [
        math.log1p(n), math.log1p(words), length.mean(), length.std(), letters, upper, digits, spaces, punct,
        sum(map(raw.count, _ENDS)) / words, count[33] / n, count[124] / n, count[[35, 36, 37, 38, 42]].sum() / n, high,
        count[10] / n, math.log1p(per_line.mean()), per_line.std() / (1 + per_line.mean()), len(times) / words,
        times.max() / words, 1 - len(set(lines)) / max(1, len(lines)),
        1 - len(triples) / max(1, words - 2) if words > 2 else 0.0, -(share * np.log(share)).sum(),
        sum(map(bytes.isupper, toks)) / words, (raw.count(b". ") + raw.count(b".\n")) / words]
    return out


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = ShingleHasher(3)
    for b in small(batches):
        x = [statistics(t.as_py(), hasher) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))],
                                         names=["doc_id", "stats"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray | None  # ridge weights, the last one is the constant
    cells: tuple[np.ndarray, np.ndarray]  # raw score and calibrated score at the knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        rng = np.random.default_rng(SEED)
        w = rng.standard_normal((z.shape[1], FEATURES)) / (SIGMA * math.sqrt(z.shape[1]))
        phase = rng.uniform(0, 2 * math.pi, FEATURES)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weight is None else self.features(x) @ self.weight

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.cells)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("stats").flatten().to_numpy().reshape(b.num_rows, len(STATS))


def _normal(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """One row per partition: its sums of z z' and z y, and where they are to be merged."""
    from pyspark import TaskContext

    size = FEATURES + 1
    total = np.zeros((size, size + 1))
    for b in non_empty(batches):
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            z = model.features(_matrix(part))
            total += z.T @ np.hstack([z, part.column("y").to_numpy()[:, None]])
    if total.any():
        yield _sum_row(TaskContext.get().partitionId() % MERGERS, total)


def _sum_row(slot: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                      names=["slot", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in non_empty(batches):
        for s in b.column("sums"):
            x = np.frombuffer(s.as_py())
            total = x.copy() if total is None else total + x
    if total is not None:
        yield _sum_row(0, total)


def _raw(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in non_empty(batches):
        yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(b))), b.column("y")], names=["raw", "y"])


def isotonic(value: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over cells in order of ``value``; knots of a rising line."""
    blocks: list[list[float]] = []  # weighted value, good, total
    for v, g, t in zip(value, good, total, strict=True):
        blocks.append([v * t, g, t])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    at = np.array([b[0] / b[2] for b in blocks])
    return at, np.array([(b[1] + 1e-3) / (b[2] + 2e-3) for b in blocks])


def _training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may train: outside fold 2 of 4, not null."""
    return labels.where((fold(F.col("doc_id"), 4) != 2) & F.col("quality").isNotNull())


def train_on(stats: DataFrame, labels: DataFrame) -> Model:
    """Model from labels outside fold 2 of 4: folds 0 and 1 fit, fold 3 calibrates.

    ``stats``: doc_id, stats.  Null labels do not count; a document labelled twice has its
    lowest label.  No usable labels: every score is 0.5; one class or an empty fold: the
    share of label 1.
    """
    known = _training_labels(labels).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    rows = materialize(stats.join(known, "doc_id").select("stats", "y", (fold(F.col("doc_id"), 4) == 3).alias("calibrate")), "labelled")
    fit = rows.where(~F.col("calibrate"))
    i = range(len(STATS))
    got = fit.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
                  *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in i],
                  *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in i]).first()
    share = 0.5 if got["y"] is None else got["y"]
    flat = (np.array([0.0]), np.array([share]))
    if got["n"] == 0 or share in (0.0, 1.0):
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), None, flat)
    blank = Model(np.array([got[f"m{k}"] for k in i]), np.maximum([got[f"s{k}"] for k in i], 1e-6), None, flat)
    sums = (fit.mapInArrow(functools.partial(_normal, model=blank), "slot int, sums binary")
            .repartition(MERGERS, "slot").mapInArrow(_merge, "slot int, sums binary").collect())  # MERGERS rows at most
    size = FEATURES + 1
    total = sum(np.frombuffer(r["sums"]) for r in sums).reshape(size, size + 1)
    weight = np.linalg.solve(total[:, :size] + RIDGE * got["n"] / FEATURES * np.eye(size), total[:, size])
    model = Model(blank.mean, blank.scale, weight, flat)
    cell = F.least(F.greatest(F.floor((F.col("raw") + 0.5) / 2 * CELLS), F.lit(0)), F.lit(CELLS - 1))
    cells = (rows.where("calibrate").mapInArrow(functools.partial(_raw, model=model), "raw double, y double")
             .groupBy(cell.alias("cell")).agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("total"),
                                              F.avg("raw").alias("raw")).toPandas().sort_values("raw"))  # CELLS rows at most
    if not len(cells):
        return Model(model.mean, model.scale, None, flat)
    return Model(model.mean, model.scale, weight, isotonic(*(cells[c].to_numpy(float) for c in ("raw", "good", "total"))))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in non_empty(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(_matrix(b)))],
                                         names=["doc_id", "score"])


def _good(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    hasher = ShingleHasher(3)
    for b in small(batches):
        x = np.array([statistics(t.as_py(), hasher) for t in b.column("text")])
        yield b.filter(pa.array(model.scores(x) >= THRESHOLD))


def document_stats(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
                       .mapInArrow(_stats, "doc_id bigint, stats array<double>"), "stats")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, ...).

    Null, empty and blank texts have zero statistics and are scored as such.  Repeated rows
    are scored each; equal texts get equal scores.  Columns other than doc_id and text are
    ignored; an empty table gives no rows.
    """
    stats = document_stats(docs)
    model = train_on(stats, labels)
    scored = stats.mapInArrow(functools.partial(_score, model=model), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns.

    Statistics for training are computed for the documents with a training label only; the
    same model as over the statistics of all documents.
    """
    ids = broadcast_if_small(_training_labels(labels).select("doc_id"))
    model = train_on(document_stats(docs.join(ids, "doc_id", "left_semi")), labels)
    return docs.mapInArrow(functools.partial(_good, model=model), docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
