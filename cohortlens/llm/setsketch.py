"""MinHash near-dedup with SetSketch registers.

Method
------
1. Every text becomes the set of its distinct word shingles, each a 64-bit hash.
2. A SetSketch of the set: register ``i`` keeps ``max(floor(1 - log_b h_i))`` over the
   set, where ``h_i`` is an exponential variate derived from the shingle and ``i``.
   Taking the minimum of ``h_i`` first and the floor of the logarithm once per register
   gives the same value, because the map is monotone.  Registers of two sets merge by
   ``max`` (``merge_registers``), so sketches can be built in parts.
3. Exact copies (equal sets) collapse into one class before anything is compared.
4. Bands of registers hash classes into buckets.  Each bucket compares its members with the
   bucket's smallest member only (a star, never all pairs).  The joint likelihood of the
   register comparison, given both set sizes, estimates the similarity; pairs above
   ``FAMILY`` (far below any link threshold) join a family.
5. Buckets that still hold several families compare the members outside their largest
   family with all members, blocks of registers meeting pairwise, and join families where
   the estimate allows a link.  So two linkable classes that share a bucket share a family.
6. Inside a family every link is decided on the full shingle sets: blocks of bounded size
   meet pairwise, the intersections come from one matrix product per block pair, and only
   a spanning forest of the confirmed links leaves a task.  No pair is ever a row.
7. Confirmed links give components; the smallest doc_id names each.

A pair at the threshold is missed only if no band agrees: (1 - J^5)^25, 4e-7 at 0.85 and
5e-5 at 0.8, and only if no third copy connects it.  Work inside a family is quadratic in
its distinct texts; exact copies never count.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize, mix2, non_empty, runs, session_settings, small, splitmix
from cohortlens.llm.components import components

REGISTERS = 125
BAND_ROWS = 5
BASE = 1.02
RATE = 20.0
LIMIT = 65534  # q: registers hold 0 .. q + 1
FAMILY = 0.55  # estimated similarity that puts two classes into one family
MARGIN = 0.17  # an estimate this far below the threshold rules a link out (over 4 sigma)
BLOCK_DOCS = 512
BLOCK_SHINGLES = 500_000
MIXED_DOCS = 1024  # rows of a bucket in one block, when its families are compared


class ShingleHasher:
    """Distinct word-shingle hashes of texts; words are cached up to a bound."""

    def __init__(self, k: int, cache: int = 100_000):
        self.k, self.cache, self.seen = k, cache, {}

    def hashes(self, toks: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.cache:
            seen.clear()
        h = xxhash.xxh3_64_intdigest
        out = []
        for t in toks:
            v = seen.get(t)
            if v is None:
                v = seen[t] = h(t)
            out.append(v)
        return np.array(out, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; fewer than ``k`` words: the sequence as one shingle."""
        if not text:
            return np.empty(0, np.uint64)
        return self.sets(self.hashes(text.encode("utf-8", "surrogatepass").lower().split()))

    def sets(self, w: np.ndarray) -> np.ndarray:
        """Sorted distinct shingle hashes of a sequence of word hashes."""
        if not len(w):
            return w
        span = min(self.k, len(w))
        acc = splitmix(np.full(len(w) - span + 1, span, dtype=np.uint64))
        for j in range(span):
            acc = mix2(acc, w[j:len(w) - span + 1 + j])
        return np.unique(acc)


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, m + 1, dtype=np.uint64)
    return splitmix(i) | np.uint64(1), splitmix(i + np.uint64(1 << 32))


def registers(values: np.ndarray, offsets: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (rows x m, uint16) of non-empty sets laid end to end."""
    mul, xor = _multipliers(m)
    out = np.empty((len(offsets), m), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(m):
            out[:, i] = np.minimum.reduceat((values ^ xor[i]) * mul[i], offsets)
    u = (out.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    k = np.floor(1.0 - np.log(h) / math.log(BASE))
    return np.clip(k + 1000, 0, LIMIT + 1).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def likelihood_jaccard(higher: np.ndarray, lower: np.ndarray, m: int, na: np.ndarray,
                       nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from register comparisons and the set sizes.

    ``higher`` counts registers with a > b, ``lower`` those with a < b.  With
    u = na / (na + nb), v = 1 - u: P(a > b) = p(u - v J), P(a < b) = p(v - u J),
    p(x) = -log_b(1 - x (b - 1) / b).  J is at most min(u / v, v / u).  The log
    likelihood is concave in J, so a ternary search over the interval finds it.
    """
    na, nb = na.astype(float), nb.astype(float)
    u = na / (na + nb)
    v = 1.0 - u
    q = (BASE - 1) / BASE

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * q) / math.log(BASE)

    same = m - higher - lower

    def ll(j):
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return higher * np.log(a) + lower * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = ll(x) < ll(y)
        lo, hi = np.where(left, x, lo), np.where(left, hi, y)
    return (lo + hi) / 2


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                    ("regs", pa.binary()), ("keys", pa.list_(pa.int64()))])


def sketch_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_shingles, digest, regs, band keys); empty sets: no sketch."""
    hasher = ShingleHasher(k)
    bands = REGISTERS // BAND_ROWS
    salt = splitmix(np.arange(bands, dtype=np.uint64))
    for b in small(batches):
        sets = [hasher.shingles(t.as_py()) for t in b.column("text")]
        full = [i for i, s in enumerate(sets) if len(s)]
        regs = np.zeros((0, REGISTERS), np.uint16)
        if full:
            size = np.array([len(sets[i]) for i in full])
            regs = registers(np.concatenate([sets[i] for i in full]), np.cumsum(size) - size)
        keys = np.broadcast_to(salt, (len(regs), bands)).copy()
        for j in range(BAND_ROWS):
            keys = mix2(keys, regs[:, j:bands * BAND_ROWS:BAND_ROWS])
        at = dict(zip(full, range(len(full)), strict=True))
        signed = keys.view(np.int64)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([regs[at[i]].tobytes() if i in at else None for i in range(len(sets))], pa.binary()),
            pa.array([signed[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
        ], schema=SKETCH)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _star_edges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, registers and set sizes of both) -> those whose estimate reaches ``least``."""
    for b in non_empty(batches):
        x, y = _matrix(b.column("ru")), _matrix(b.column("rv"))
        est = likelihood_jaccard((x > y).sum(1), (x < y).sum(1), REGISTERS,
                                 b.column("nu").to_numpy(), b.column("nv").to_numpy())
        keep = pa.array(est >= least)
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])


def _mixed_edges(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Block pairs of one bucket: a block of query rows against a block of rows, other families only.

    One edge per query and other family is enough, so output stays below queries x families.
    """
    for t in runs(batches, ["key", "bi", "bj"]):
        ids, fam, n, ask = (t.column(c).to_numpy() for c in ("cid", "label", "n", "ask"))
        regs = _matrix(t.column("regs"))
        rows = np.flatnonzero(~ask)
        u, v = [], []
        for i in np.flatnonzero(ask):
            other = rows[fam[rows] != fam[i]]
            if not len(other):
                continue
            est = likelihood_jaccard((regs[i] > regs[other]).sum(1), (regs[i] < regs[other]).sum(1), REGISTERS,
                                     np.full(len(other), n[i]), n[other])
            hit = other[est >= least]
            if len(hit):
                _, first = np.unique(fam[hit], return_index=True)
                u += [ids[i]] * len(first)
                v += ids[hit[first]].tolist()
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def intersections(left: list[np.ndarray], right: list[np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of distinct hashes."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    step = max(64, cells // max(1, len(left) + len(right)))

    def places(sets):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.searchsorted(common, values)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == values[ok]
        order = np.argsort(at[ok], kind="stable")
        return at[ok][order], rows[ok][order]

    (ca, ra), (cb, rb) = places(left), places(right)
    for lo in range(0, len(common), step):
        hi = min(lo + step, len(common))
        x, y = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
        s, e = np.searchsorted(ca, [lo, hi])
        x[ra[s:e], ca[s:e] - lo] = 1
        s, e = np.searchsorted(cb, [lo, hi])
        y[rb[s:e], cb[s:e] - lo] = 1
        out += x @ y.T
    return out


def _forest(n: int, hit: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links in a boolean matrix over n nodes."""
    free, out = np.ones(n, dtype=bool), []
    for s in range(n):
        if not free[s]:
            continue
        free[s] = False
        stack = [s]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(hit[i] & free):
                free[j] = False
                out.append((i, int(j)))
                stack.append(int(j))
    return out


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links within a block pair of a family, decided on full sets; a spanning forest of them."""
    hasher = ShingleHasher(k)
    for t in runs(batches, ["family", "bi", "bj"]):
        ids = t.column("cid").to_numpy()
        sets = [hasher.shingles(x.as_py()) for x in t.column("text")]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        side = t.column("block").to_numpy() == t.column("bi").to_numpy()
        same = t.column("bi")[0] == t.column("bj")[0]
        a = np.arange(len(ids)) if same else np.flatnonzero(side)
        b = a if same else np.flatnonzero(~side)
        if not len(a) or not len(b):
            continue
        inter = intersections([sets[i] for i in a], [sets[i] for i in b]).astype(np.float64)
        union = size[a][:, None] + size[b][None, :] - inter
        linked = (100 * inter >= percent * union) & (inter > 0)
        hit = np.zeros((len(ids), len(ids)), dtype=bool)
        hit[np.ix_(a, b)] = linked
        hit[np.ix_(b, a)] |= linked.T
        np.fill_diagonal(hit, False)
        if edges := _forest(len(ids), hit):
            u, v = zip(*edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[list(u)], pa.int64()), pa.array(ids[list(v)], pa.int64())],
                                             names=["u", "v"])


EDGE = "u bigint, v bigint"
# The texts of a few classes are joined to all documents: let Spark filter the documents by
# a Bloom filter of the ids (at most 8 MB, Spark's own bound) before it shuffles any text.
RUNTIME_FILTER = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
                  "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
                  "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB"}


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z), words are runs other than space, tab, LF, VT, FF, CR; a
    set holds the distinct ``k``-word shingles (the whole sequence for shorter texts) and
    two documents are linked if 100 * intersection >= ``percent`` * union.  Null, empty and
    blank texts have an empty set and are linked with nothing.  Rows that share a doc_id
    count as one document and share its component.  A row without doc_id takes the component
    of rows with an equal set; otherwise it is not compared, its component is null and it is kept.  Other columns are ignored.
    An empty table gives no rows.
    """
    texts = docs.select("doc_id", "text")
    sk = materialize(texts.mapInArrow(functools.partial(sketch_batches, k=k),
                                      "doc_id bigint, n_shingles bigint, digest binary, regs binary, keys array<bigint>"),
                     "sketch")
    full = sk.where("n_shingles > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("cid")), "classes")
    heads = materialize(full.join(classes, (full.digest == classes.digest) & (full.doc_id == classes.cid))
                        .select("cid", F.col("n_shingles").alias("n"), "regs", "keys").dropDuplicates(["cid", "regs"]),
                        "heads")
    family = _families(heads, FAMILY, percent / 100 - MARGIN)
    with session_settings(docs.sparkSession, RUNTIME_FILTER):
        links = materialize(_links(texts, heads, family, k, percent), "links")
    label = components(links)

    named = (classes.join(label, classes.cid == label.id, "left")
             .select("digest", F.coalesce("label", "cid").alias("component")))
    slim = sk.select("doc_id", "n_shingles", "digest")
    empty = slim.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    joined = (slim.where("n_shingles > 0").join(named, "digest").select("doc_id", "n_shingles", "component")
              .unionByName(empty))
    return joined.select("doc_id", "n_shingles", F.col("component").alias("component_id"),
                         F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def _families(heads: DataFrame, family: float, least: float) -> DataFrame:
    """(id, label): families of classes that share a band bucket and look alike."""
    bands = heads.select("cid", F.explode("keys").alias("key"))
    buckets = materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("head"))
                          .where("size > 1"), "buckets")
    members = materialize(bands.join(buckets, "key").select("key", "cid", "head", "size"), "members")
    regs = heads.select("cid", "n", "regs")
    stars = (members.where("cid <> head").select(F.col("head").alias("u"), F.col("cid").alias("v")).distinct()
             .join(regs.select(F.col("cid").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru")), "u")
             .join(regs.select(F.col("cid").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv")), "v"))
    first = materialize(stars.mapInArrow(functools.partial(_star_edges, least=family), EDGE), "stars")
    label = materialize(components(first), "family1")

    tagged = members.join(label, members.cid == label.id, "left").select(
        "key", "cid", F.coalesce("label", "cid").alias("label"))
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rows = materialize(tagged.join(mixed.select("key"), "key"), "mixed")
    work = _mixed_work(rows).join(regs, "cid").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    second = materialize(work.mapInArrow(functools.partial(_mixed_edges, least=least), EDGE), "mixed_edges")
    return components(first.unionByName(second))


def _mixed_work(rows: DataFrame) -> DataFrame:
    """(key, bi, bj, cid, label, ask): each block of askers (bi) meets each block of members (bj) of its bucket.

    ``rows``: key, cid, label.  The members outside a bucket's largest family ask.  A block
    pair holds two blocks of about ``MIXED_DOCS`` rows, however many members the bucket has.
    """
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    major = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size")).select(
        "key", F.col("top.label").alias("major"), F.ceil(F.col("size") / MIXED_DOCS).alias("blocks"),
        F.ceil((F.col("size") - F.col("top.c")) / MIXED_DOCS).alias("asking"))
    placed = rows.join(major, "key")
    every = {n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)) for n in ("blocks", "asking")}
    own = placed.select("key", every["asking"].alias("bi"), F.pmod(F.xxhash64("cid"), "blocks").alias("bj"),
                        "cid", "label", F.lit(False).alias("ask"))
    ask = placed.where("label <> major").select(
        "key", F.pmod(F.xxhash64("cid"), "asking").alias("bi"), every["blocks"].alias("bj"), "cid", "label",
        F.lit(True).alias("ask"))
    return own.unionByName(ask)


def _links(texts: DataFrame, heads: DataFrame, family: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): confirmed links that connect exactly what all confirmed links connect."""
    sizes = (heads.select("cid", "n").join(family, F.col("cid") == F.col("id"))
             .select("cid", "n", F.col("label").alias("family")))
    sizes = materialize(sizes, "family_rows")
    blocks = sizes.groupBy("family").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = sizes.join(blocks, "family").select(
        "cid", "family", "blocks", F.pmod(F.xxhash64("cid"), "blocks").alias("block"))
    placed = materialize(placed, "placed").where("blocks > 0")
    body = (texts.join(placed, F.col("doc_id") == F.col("cid"))
            .select("cid", "family", "blocks", "block", "text"))
    pairs = body.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cid",
        "text")
    keys = ["family", "bi", "bj"]
    work = pairs.repartition(*keys).sortWithinPartitions(*keys)
    return work.mapInArrow(functools.partial(_confirm, k=k, percent=percent), EDGE)


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: three-word shingles, similarity 0.85."""
    from cohortlens.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
