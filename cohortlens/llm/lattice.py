"""Embedding near-dedup by E8 lattice hashing.

1. Vectors are normalised in double precision; bitwise equal ones form one class, which is
   compared once and counts with its size.
2. In each of ``TABLES`` tables a random projection maps a class to 8 dimensions, scaled so
   that close vectors are often within one cell, and the nearest E8 lattice point names its
   home cell.  It also probes the ``PROBES`` neighbouring cells whose points come next.
3. In every cell the home rows meet each other and the probing rows, in blocks of bounded
   size: one matrix product per block pair gives all cosines.  Pairs never become rows: a
   block reports link counts per class and a spanning forest of its links.
4. A pair that meets in several cells counts at its first meeting only; whether there was an
   earlier one is computed from the two vectors themselves.
5. Components of the forests give the groups.

Two vectors at cosine 0.9 meet in a table with probability of about 0.48, so ten tables find
99.8 % of such pairs and more of closer ones; the tests measure it.  Counting links inside a
group of near copies is quadratic in its distinct vectors.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import materialize, mix2, non_empty, runs, splitmix, table
from cohortlens.llm.components import components

TABLES = 10
PROBES = 4
WIDTH = 1.4
LEAST = 0.9
BLOCK = 1024
SEED = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    rest = x - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(1)
    f[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the union of D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _cell_ids(points: np.ndarray, t: int) -> np.ndarray:
    """64-bit names of lattice points (doubled coordinates are integers) in table t."""
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = splitmix(np.full(points.shape[:-1], t + 1, dtype=np.uint64))
    for k in range(8):
        h = mix2(h, whole[..., k])
    return h.view(np.int64)


@functools.lru_cache(maxsize=16)
def _projection(dim: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables, 8)) / width, rng.uniform(-0.5, 0.5, (tables, 8))


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
          seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Home cell (n x tables) and probed cells (n x tables x probes) of unit vectors.

    The projection adds one dimension after the other, so a vector's cells do not depend on
    the batch that it comes in.
    """
    g, shift = _projection(unit.shape[1], tables, width, seed)
    y = np.broadcast_to(shift, (len(unit), tables, 8)).copy()
    for k in range(unit.shape[1]):
        y += unit[:, k, None, None] * g[k]
    home = np.empty((len(unit), tables), np.int64)
    near = np.empty((len(unit), tables, probes), np.int64)
    for t in range(tables):
        point = nearest_e8(y[:, t])
        home[:, t] = _cell_ids(point, t)
        if probes:
            # |y - p - r|^2 = |y - p|^2 - 2 (y - p) r + |r|^2 and all |r|^2 are 2
            rest = y[:, t] - point
            gain = np.zeros((len(unit), len(ROOTS)))
            for k in range(8):
                gain += rest[:, k, None] * ROOTS[:, k]
            best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            near[:, t] = _cell_ids(point[:, None, :] + ROOTS[best], t)
    return home, near


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(1, keepdims=True)
    x = raw / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(values, kind) -> bytes | None:
    """Bytes of a vector that can be compared, else None."""
    if values is None or not len(values):
        return None
    try:
        x = np.array(values, dtype=kind)
    except (TypeError, ValueError):
        return None
    x = x + np.zeros(1, kind)  # one zero, not two
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def _digests(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for b in non_empty(batches):
        raw = [_usable(v, kind) for v in b.column("embedding").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            b.column("vec_id").cast(pa.int64()), pa.array([r and xxhash.xxh3_128_digest(r) for r in raw], pa.binary()),
            pa.array(raw, pa.binary())], names=["vec_id", "digest", "vec"])


def _unpack(column, kind: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1).astype(np.float64)


def _place(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(cid, size, vec) -> a row per home and probed cell: cell, home, tbl, cid."""
    for b in non_empty(batches):
        lengths = np.array([len(v.as_py()) for v in b.column("vec")])
        for n in np.unique(lengths):
            part = b.filter(pa.array(lengths == n))
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                home, near = cells(unit_vectors(_unpack(some.column("vec"), kind)))
                both = np.concatenate([home[:, :, None], near], axis=2)  # rows x tables x (1 + probes)
                rows, tables, wide = both.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array(both.ravel() ^ np.int64(n)), pa.array(np.tile(np.arange(wide) == 0, rows * tables)),
                    pa.array(np.tile(np.repeat(np.arange(tables), wide), rows).astype(np.int32)),
                    some.column("cid").take(pa.array(np.repeat(np.arange(rows), tables * wide)))],
                    names=["cell", "home", "tbl", "cid"])


def _met_before(a, b, t, home, near) -> np.ndarray:
    """Whether pairs (a[k], b[k]) of vectors meet in a table before table t."""
    todo, met = np.arange(len(a)), np.zeros(len(a), bool)
    for s in range(t):
        x, y = a[todo], b[todo]
        hit = ((home[x, s] == home[y, s]) | (near[x, s] == home[y, s][:, None]).any(1)
               | (near[y, s] == home[x, s][:, None]).any(1))
        met[todo[hit]] = True
        todo = todo[~hit]
    return met


def _links(batches: Iterator[pa.RecordBatch], kind: str, least: float) -> Iterator[pa.RecordBatch]:
    """Block pairs of a cell -> (u, v, links): links of class u counted here (v null), forest edges (links null)."""
    for part in runs(batches, ["cell", "bi", "bj"]):
        is_home = part.column("home").to_numpy()
        if not is_home.any() or part.num_rows < 2:
            continue
        block, bi, bj = part.column("block").to_numpy(), part.column("bi")[0].as_py(), part.column("bj")[0].as_py()
        t = part.column("tbl")[0].as_py()
        cid, size = part.column("cid").to_numpy(), part.column("size").to_numpy()
        unit = unit_vectors(_unpack(part.column("vec"), kind))
        pairs = []
        for left, right in ((bi, bj), (bj, bi)):
            homes = np.flatnonzero(is_home & (block == right))
            for row_home in (True, False):
                if row_home and left > right:
                    continue
                rows = np.flatnonzero((is_home == row_home) & (block == left))
                for at in range(0, len(rows) if len(homes) else 0, 512):
                    some = rows[at:at + 512]
                    i, j = np.nonzero(unit[some] @ unit[homes].T >= least)
                    i, j = some[i], homes[j]
                    keep = i < j if row_home and left == right else cid[i] != cid[j]
                    pairs.append((i[keep], j[keep], np.full(keep.sum(), row_home)))
            if bi == bj:
                break
        i, j, direct = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(i):
            continue
        used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        home, near = cells(unit[used])
        a, b = place[:len(i)], place[len(i):]
        new = np.zeros(len(i), bool)
        for at in range(0, len(i), 50_000):
            s = slice(at, at + 50_000)
            # a probing row: if the other also probes this one's home, the smaller id's probe counts
            back = (near[b[s], t] == home[a[s], t][:, None]).any(1)
            first = direct[s] | ~back | (cid[i[s]] < cid[j[s]])
            new[s] = first & ~_met_before(a[s], b[s], t, home, near)
        i, j = i[new], j[new]
        if not len(i):
            continue
        count = np.bincount(i, size[j], len(cid)) + np.bincount(j, size[i], len(cid))
        got = np.flatnonzero(count)
        edges = _sparse_forest(cid[i], cid[j])
        u = np.concatenate([cid[got], edges[:, 0]])
        yield pa.RecordBatch.from_arrays([
            pa.array(u, pa.int64()), pa.array([None] * len(got) + edges[:, 1].tolist(), pa.int64()),
            pa.array(count[got].astype(np.int64).tolist() + [None] * len(edges), pa.int64())], names=["u", "v", "links"])


def _sparse_forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A spanning forest of the edges (u[k], v[k])."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(at[:len(u)].tolist(), at[len(u):].tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            out.append((ids[x], ids[y]))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per input row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of rows with cosine >= ``least`` in double precision.  Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths are not compared.  Rows that share a vec_id are rows of their own,
    named alike.  A row without vec_id counts as a copy of equal vectors and takes their
    component; otherwise it is not compared, its component is null and it is kept.  Other columns are ignored; no rows give none.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    raw = materialize(vectors.select("vec_id", "embedding").mapInArrow(
        functools.partial(_digests, kind=kind), "vec_id bigint, digest binary, vec binary"), "vectors")
    classes = raw.where("digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("size"))
    classes = materialize(classes, "classes")
    heads = materialize(raw.where("digest is not null").join(classes.where("cid is not null"), "digest")
                        .where("vec_id = cid").select("cid", "digest", "size", "vec").dropDuplicates(["cid", "digest"])
                        .drop("digest"), "heads")
    placed = materialize(heads.mapInArrow(functools.partial(_place, kind=kind),
                                          "cell bigint, home boolean, tbl int, cid bigint"), "cells")
    full = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("any_home")).where(
        "rows > 1 and any_home").select("cell", F.ceil(F.col("rows") / BLOCK).alias("blocks"))
    work = (placed.join(full, "cell").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
            .select("cell", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block",
                    "home", "tbl", "cid")
            .join(heads, "cid"))
    keys = ["cell", "bi", "bj"]
    work = work.repartition(*keys).sortWithinPartitions(*keys, "cid")
    got = materialize(work.mapInArrow(functools.partial(_links, kind=kind, least=least), "u bigint, v bigint, links bigint"),
                      "links")
    label = components(got.where("v is not null"))
    count = got.where("v is null").groupBy("u").agg(F.sum("links").alias("other"))
    named = (classes.join(label, F.col("cid") == F.col("id"), "left").join(count, F.col("cid") == F.col("u"), "left")
             .select("digest", F.coalesce("label", "cid").alias("component"),
                     (F.coalesce("other", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    slim = raw.select("vec_id", "digest")
    rows = (slim.where("digest is not null").join(named, "digest").select("vec_id", "n_links", "component")
            .unionByName(slim.where("digest is null").select(
                "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component"))))
    return rows.select("vec_id", "n_links", F.col("component").alias("component_id"),
                       F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
