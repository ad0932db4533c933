"""Toxicity scores from subword-bag embeddings under a linear softmax.

A text is lower-cased, runs of white space become one space, and every byte window of 3, 4
or 5 that does not cross a word boundary is a subword (the boundary itself is part of it).
Subwords hash into ``BUCKETS`` embedding rows; a text is the average of its subwords'
embeddings, and a linear softmax over that average gives the two classes.  Embeddings and
softmax are trained jointly, with numpy, on a bounded sample of labelled rows.  A misspelling
that was never seen still shares most of its character n-grams with the words it imitates.

A text is scored by its highest window of ``WINDOW`` subwords (about eight words, overlapping
by half), so a few toxic words in a long text are not averaged away.  Training follows: the
first round averages whole texts of up to ``WHOLE`` characters (the average of a longer one
says nothing of a passage in it), the later ones average each sampled text's highest windows
under the model so far, toxic or not, so hard clean passages are learned too.  Texts kept
out of training then map the highest window's log-odds to a probability (a two-parameter
logistic fit, weighted to the share of toxic labels).

Every round is two Spark jobs: all tasks cut the sampled texts into bags (a text is read
piece by piece, whatever its length), and one task trains on the bags, of which there are at
most ``HARD`` a clean text and one a toxic text.  Only the model's row reaches the driver.

Because the classifier is linear in the average, one number per bucket is all that scoring
needs: the 1 MB table travels with the tasks and each text is scored whole, in one pass.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fold, materialize, non_empty, partitions, small, table

BUCKETS = 1 << 18
DIM = 8
SIZES = (3, 4, 5)
SAMPLE = (6_000, 2_500)  # bound of the labelled sample that training reads: clean, toxic
EPOCHS = 5
CALIBRATE = 4  # one sampled text in so many only calibrates the score
LEAST = 2  # a subword in fewer texts than this of either class keeps weight 0
ROUNDS = 4
HARD = 4  # highest windows that a clean text gives in a round
WHOLE = 200_000  # characters of a text whose average trains the first round; longer ones give windows only
WINDOW = 120
FIRST_SEED = 7
PIECE = 200_000  # characters scored at a time; longer texts are cut at white space, windows run across the cuts
SPACE = " \t\n\x0b\x0c\r"
THRESHOLD = 0.5

_P = [np.uint64(x) for x in (1, 0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_MIX = np.uint64(0xD6E8FEB86659FD93)


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword in reading order, number of subwords of each text)."""
    parts = [b" " + b" ".join((t or "").lower().encode("utf-8", "surrogatepass").split()) + b" " for t in texts]
    size = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts) + b" " * 8, dtype=np.uint8)
    n = len(raw) - 8
    space = raw == 32
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), size)
    wide = raw.astype(np.uint64)
    ends = np.repeat(np.cumsum(size), size)
    at = np.arange(n)
    h = np.zeros(n, dtype=np.uint64)
    inner = np.ones(n, dtype=bool)
    got_at, got = [], []
    with np.errstate(over="ignore"):
        for j in range(max(SIZES)):
            if j >= 2:
                inner &= ~space[j - 1:n + j - 1]
            h = h + (wide[j:n + j] + np.uint64(1)) * _P[j]
            if j + 1 in SIZES:
                ok = np.flatnonzero(inner & (at + j < ends))
                z = (h[ok] + np.uint64(j)) * _MIX
                got.append(((z ^ (z >> np.uint64(29))) * _MIX >> np.uint64(64 - 18)).astype(np.int32))
                got_at.append(ok)
    where = np.concatenate(got_at)
    order = np.argsort(where, kind="stable")
    bucket = np.concatenate(got)[order]
    return bucket, np.bincount(owner[where], minlength=len(parts))


def _windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of every window; texts lie end to end, short ones are one window."""
    half = WINDOW // 2
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // half) + 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    last = np.maximum(size[text] - WINDOW, 0)
    start = np.repeat(np.cumsum(size) - size, count) + np.minimum(k * half, last)
    return text, start, np.minimum(size[text], WINDOW)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of whole texts of about ``PIECE`` characters; a longer text comes in several parts.

    Parts end at white space, or inside a word of more than ``PIECE`` characters.
    """
    owner, part, held = [], [], 0
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while at < len(t):
            end = len(t) if len(t) - at <= PIECE else max(t.rfind(c, at + 1, at + PIECE) for c in SPACE)
            end = end if end > at else at + PIECE
            if held and held + end - at > PIECE:
                yield owner, part
                owner, part, held = [], [], 0
            owner.append(i)
            part.append(t[at:end])
            held += end - at
            at = end
    if part:
        yield owner, part


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per bucket: log-odds contribution of one subword
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def window_logits(self, bucket: np.ndarray, size: np.ndarray):
        total = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
        text, start, length = _windows(size)
        return text, start, length, self.bias + (total[start + length] - total[start]) / np.maximum(length, 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text; a text without subwords gets the score of the bias alone."""
        z = self.slope * self.highest(texts) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of each text's highest window."""
        best = np.full(len(texts), -np.inf)
        for ids, _, bucket, size in _parts(texts):
            text, _, _, z = self.window_logits(bucket, size)
            np.maximum.at(best, ids[text], z)
        best[np.isinf(best)] = self.bias
        return best


def _parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts' numbers, place in its text of the first subword of each, subwords end to end, how many each).

    A long text comes in several parts.  The windows of the parts are those of the whole text;
    the last window of a part comes again in the next one.
    """
    left = [len(t or "") for t in texts]  # characters still to come
    tail, base = np.empty(0, np.int32), 0  # subwords of an unfinished text from its last window on
    for owner, part in _pieces(texts):
        bucket, size = subwords(part)
        for i, p in zip(owner, part, strict=True):
            left[i] -= len(p)
        ids, place = np.unique(owner, return_inverse=True)
        size = np.bincount(place, size).astype(np.int64)
        bucket, size[0] = np.concatenate([tail, bucket]), size[0] + len(tail)
        first = np.zeros(len(ids), np.int64)
        first[0] = base
        tail, base = tail[:0], 0
        if left[ids[-1]]:
            # what lies beyond the last window that the whole text would have here waits
            n = int(size[-1])
            used = n - (n - WINDOW) % (WINDOW // 2) if n >= WINDOW else 0
            end, kept = len(bucket) - n + used, min(used, WINDOW)
            tail, base = bucket[end - kept:].copy(), int(first[-1]) + used - kept
            bucket, size[-1] = bucket[:end], used
        yield ids, first, bucket, size


def platt(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps, classes weighted to ``prior``."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    scale = max(1e-6, np.abs(z).std())
    x = np.stack([z / scale, np.ones_like(z)], 1)
    # the targets stay off 0 and 1, so that separable scores have a finite fit
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    beta = np.array([1.0, 0.0])

    def loss(b):
        m = x @ b
        return (w * (np.logaddexp(0, m) - t * m)).sum() + 1e-3 * (b @ b)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (w * (p - t)) + 2e-3 * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-6) / scale), float(beta[1])


def calibrated(texts: list[str], labels: np.ndarray, prior: float, rest: np.ndarray) -> Model:
    """Train on the texts outside ``rest`` and calibrate on ``rest``, in this process (see ``train_on``)."""
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or len(set(y[rest])) < 2 or len(set(y[~rest])) < 2:
        return fit(texts, y, prior)
    model = fit([t for t, r in zip(texts, rest, strict=True) if not r], y[~rest], prior)
    slope, shift = platt(model.highest([t for t, r in zip(texts, rest, strict=True) if r]), y[rest], prior)
    return replace(model, slope=slope, shift=shift)


def bags(texts: list[str], labels: list[int], model: Model | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text's number, buckets, counts) of every bag that the texts give under ``model``.

    Without a model a text of up to ``WHOLE`` characters gives all its subwords.  Otherwise a
    toxic text gives its highest window; every window of a clean text is clean, so it gives
    its ``HARD`` highest ones (ties to the earlier window).
    """
    if model is None:
        for i, t in enumerate(texts):
            if len(t) <= WHOLE:
                yield (i, *np.unique(subwords([t])[0], return_counts=True))
        return
    y = np.asarray(labels, dtype=np.int64)
    best: dict[int, dict] = {}
    for ids, first, bucket, size in _parts(texts):
        text, start, length, z = model.window_logits(bucket, size)
        order = np.lexsort((start, -z, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        begin = np.cumsum(size) - size
        for w in order[rank < np.where(y[ids[text[order]]] == 1, 1, HARD)]:
            at = int(first[text[w]] + start[w] - begin[text[w]])
            best.setdefault(int(ids[text[w]]), {})[at] = (-z[w], bucket[start[w]:start[w] + length[w]].copy())
    for i in sorted(best):
        ranked = sorted((z, at) for at, (z, _) in best[i].items())
        for _, at in ranked[:1 if y[i] == 1 else HARD]:
            yield (i, *np.unique(best[i][at][1], return_counts=True))


def fit(texts: list[str], labels: np.ndarray, prior: float) -> Model:
    """The rounds of ``train_on`` in this process."""
    y = np.asarray(labels, dtype=np.int64)
    model = None
    for r in range(ROUNDS):
        got = list(bags(texts, y, model))
        owners = [i for i, _, _ in got]
        model = train([u for _, u, _ in got], [c.astype(np.float32) for _, _, c in got], y[owners], prior, owners,
                      seed=FIRST_SEED + r)
    return model


def known_subwords(rows: list[np.ndarray], labels: np.ndarray, owners: list[int]) -> np.ndarray:
    """Whether each bucket is in ``LEAST`` texts of one class; the bags of a text (its owner) count once.

    A class's bound does not depend on the rows of the other class or on the bags a text gives.
    """
    texts = np.zeros((2, BUCKETS), np.int32)
    last = np.full(BUCKETS, -1, np.int64)
    for i in np.argsort(owners, kind="stable"):
        new = rows[i][last[rows[i]] != owners[i]]
        texts[labels[i], new] += 1
        last[new] = owners[i]
    return (texts >= LEAST).any(0)


def train(rows: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, prior: float, owners: list[int],
          epochs: int = EPOCHS, seed: int = 7, rate: float = 3.0, batch: int = 128) -> Model:
    """Joint Adagrad training of embeddings and softmax on subword bags (bucket ids and counts).

    ``prior`` is the share of label 1 among all labelled rows; the sample is balanced, so the
    bias is moved from the sample's odds to the prior's.  ``owners`` names the text of each
    bag.  No rows or one class only: a constant score equal to the prior.
    """
    y = np.asarray(labels, dtype=np.int64)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
    out = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, go, gb = np.full_like(emb, 1e-8), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    keep = [i for i in range(len(y)) if len(rows[i])]
    seen = known_subwords(rows, y, owners)
    for e in range(epochs):
        step = rate * (1 - e / epochs)
        order = rng.permutation(keep)
        for s in range(0, len(order), batch):
            ids = order[s:s + batch]
            n = np.array([len(rows[i]) for i in ids])
            idx = np.concatenate([rows[i] for i in ids])
            w = np.concatenate([counts[i] / counts[i].sum() for i in ids]).astype(np.float32)
            w *= seen[idx]
            first = np.cumsum(n) - n
            hidden = np.add.reduceat(emb[idx] * w[:, None], first, axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            d_hidden = p @ out.T
            d_out, d_bias = hidden.T @ p, p.sum(0)
            used, place = np.unique(idx, return_inverse=True)
            scaled = d_hidden[np.repeat(np.arange(len(ids)), n)] * w[:, None]
            d_emb = np.stack([np.bincount(place, scaled[:, j], len(used)) for j in range(DIM)], 1).astype(np.float32)
            ge[used] += d_emb**2
            emb[used] -= step * d_emb / np.sqrt(ge[used])
            go += d_out**2
            out -= 0.1 * step * d_out / np.sqrt(go)
            gb += d_bias**2
            bias -= 0.1 * step * d_bias / np.sqrt(gb)
    share = y.mean()
    moved = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    diff = out[:, 1] - out[:, 0]
    return Model(np.where(seen, emb @ diff, 0).astype(np.float32), float(bias[1] - bias[0] + moved))


def _bags(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) -> a row per bag: doc_id, toxic, bag, buckets, counts."""
    for b in small(batches, 64):
        got = list(bags(b.column("text").to_pylist(), b.column("toxic").to_pylist(), model))
        row = pa.array([i for i, _, _ in got], pa.int64())
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id").take(row), b.column("toxic").take(row), pa.array(range(len(got)), pa.int64()),
            pa.array([u.astype("<i4").tobytes() for _, u, _ in got], pa.binary()),
            pa.array([c.astype("<i4").tobytes() for _, _, c in got], pa.binary())],
            names=["doc_id", "toxic", "bag", "buckets", "counts"])


def _trained(batches: Iterator[pa.RecordBatch], prior: float, seed: int) -> Iterator[pa.RecordBatch]:
    """All bags of a round -> one row: weight, bias.  Bags are bounded by the sample, not by its texts."""
    rows, counts, order, y = [], [], [], []
    for b in non_empty(batches):
        rows += [np.frombuffer(x, "<i4").copy() for x in b.column("buckets").to_pylist()]
        counts += [np.frombuffer(x, "<i4").astype(np.float32) for x in b.column("counts").to_pylist()]
        order += zip(b.column("doc_id").to_pylist(), b.column("bag").to_pylist(), strict=True)
        y += b.column("toxic").to_pylist()
    # a document's bags come from one batch, so their order does not depend on the partitions
    by = sorted(range(len(order)), key=order.__getitem__)
    model = train([rows[i] for i in by], [counts[i] for i in by], np.array([y[i] for i in by], np.int64), prior,
                  [order[i][0] for i in by], seed=seed)
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()),
                                      pa.array([model.bias], pa.float64())], names=["weight", "bias"])


def _highest(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 64):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"),
                                          pa.array(model.highest(b.column("text").to_pylist()))],
                                         names=["doc_id", "toxic", "z"])


def _fit_rounds(texts: DataFrame, prior: float) -> Model:
    """Model of all rows of ``texts`` (doc_id, toxic, text)."""
    model = None
    for r in range(ROUNDS):
        got = materialize(texts.mapInArrow(
            functools.partial(_bags, model=model),
            "doc_id bigint, toxic int, bag bigint, buckets binary, counts binary"), "bags")
        row = got.coalesce(1).mapInArrow(
            functools.partial(_trained, prior=prior, seed=FIRST_SEED + r), "weight binary, bias double").first()
        model = Model(np.frombuffer(bytes(row["weight"]), "<f4").copy(), row["bias"])
    return model


def sample_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text, rest): labelled documents outside fold 0, at most ``SAMPLE`` of each class, in hash order.

    Null labels do not count; a document labelled twice is toxic if any label says so.  Only
    labels of documents with a text are drawn; of rows with one doc_id the smallest text
    counts.  ``rest``: the row only calibrates.
    """
    known = (labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    texts = docs.select("doc_id", "text").where("text is not null")
    usable = materialize(known.join(texts.select("doc_id"), "doc_id", "left_semi"), "usable_labels")
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = None
    for kind, bound in enumerate(SAMPLE):
        part = usable.where(F.col("toxic") == kind).orderBy(*order).limit(bound)
        sample = part if sample is None else sample.unionByName(part)
    rest = F.pmod(F.xxhash64("doc_id", F.lit("rest")), F.lit(CALIBRATE)) == 0
    found = (texts.join(F.broadcast(sample), "doc_id")  # at most sum(SAMPLE) ids
             .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("rest", rest))
    return materialize(found.repartition(partitions(docs.sparkSession), "doc_id"), "sampled_texts")


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``sample_texts``, calibrated on its rest (not at all, if one side has one class only).

    ``labels``: doc_id, toxic.
    """
    share = labels.where((fold(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = 0.1 if share is None else share
    texts = sample_texts(docs, labels)
    sides = {tuple(r) for r in texts.select("rest", "toxic").distinct().collect()}
    if len(sides) < 4:
        return _fit_rounds(texts.drop("rest"), prior)
    model = _fit_rounds(texts.where("not rest").drop("rest"), prior)
    held = texts.where("rest").drop("rest").mapInArrow(
        functools.partial(_highest, model=model), "doc_id bigint, toxic int, z double").orderBy("doc_id").collect()
    slope, shift = platt(np.array([r["z"] for r in held]), np.array([r["toxic"] for r in held]), prior)
    return replace(model, slope=slope, shift=shift)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        s = model.scores(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])


def _clean(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        yield b.filter(pa.array(model.scores(b.column("text").to_pylist()) < THRESHOLD))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no subwords and get the score of the bias alone.  Repeated
    rows are scored each; equal texts get equal scores.  Without usable labels every score
    is the share of toxic labels (0.1 if there is none).  Columns other than doc_id and text
    are ignored; an empty table gives no rows.
    """
    model = train_on(docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(
        functools.partial(_score, model=model), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = train_on(docs, labels)
    return docs.mapInArrow(functools.partial(_clean, model=model), docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
