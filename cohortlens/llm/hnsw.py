"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

1. Equal vectors form one class; of its row ids the ``k + 1`` smallest stay, because ties go to
   the smaller id and a query skips only its own.  Classes are dealt to shards of about
   ``SHARD`` by a hash of their bytes; each task builds the graph of one shard.
2. A graph is a row of flat arrays: vectors, ``CAPACITY`` neighbours a node on the ground level,
   ``LINKS`` a node and level above, levels, row ids.  Levels come from a hash of the vector, and
   nodes are added in order of their bytes, so an index does not depend on the partitions.
3. A node is linked to neighbours that are nearer to it than to each other (the rest fills up),
   so graphs of tight groups stay connected.  A full list is cut back to ``GROUND`` in the same way.
4. Queries meet every shard, in chunks of ``CHUNK``: a task holds one graph and streams the
   queries past it.  A search walks down the levels and keeps the ``BEAM`` nearest on the ground.
5. Shard results are exact distances in double precision; the ``k`` best of all shards remain.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import materialize, non_empty, runs, small, table

K = 10
SHARD = 8192  # classes of a shard, about
LINKS = 16  # neighbours on the levels above the ground
GROUND = 32  # neighbours on the ground level
CAPACITY = 48  # neighbours on the ground level before a list is cut back
BUILD = 80  # candidates of a new node's neighbours
BEAM = 128  # nodes that a search keeps
WIDE = 8  # nodes expanded at a time
CHUNK = 1 << 16  # queries that meet a copy of a graph
QUERY_STEP = 100  # rows whose id it divides are the queries


def _vector(values, kind: str) -> bytes | None:
    """Bytes of a usable vector, else None."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.array(values, dtype=kind) + np.zeros(1, kind)  # one zero, not two
    return x.tobytes() if np.isfinite(x).all() and x.any() else None


def _named(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> vec_id, digest, dim, vec of the usable vectors."""
    for b in small(batches, 2048):
        raw = [_vector(v, kind) for v in b.column("embedding").to_pylist()]
        ok = pa.array([i for i, r in enumerate(raw) if r is not None], pa.int64())
        held = [r for r in raw if r is not None]
        wide = np.dtype(kind).itemsize
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id").cast(pa.int64()).take(ok), pa.array([xxhash.xxh3_128_digest(r) for r in held], pa.binary()),
             pa.array([len(r) // wide for r in held], pa.int32()), pa.array(held, pa.binary())],
            names=["vec_id", "digest", "dim", "vec"])


def _squares(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.einsum("ij,ij->i", d, d)


def _diverse(d: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of distance ``d``: those nearer to the node than to one chosen before; the rest fills up."""
    free, chosen = np.ones(len(d), bool), []
    while len(chosen) < most:
        c = int(free.argmax())
        if not free[c]:
            break
        chosen.append(c)
        free &= between[c] > d
        free[c] = False
    if len(chosen) < min(most, len(d)):
        rest = np.setdiff1d(np.arange(len(d)), chosen)
        chosen += rest[:most - len(chosen)].tolist()
    return np.array(chosen, dtype=np.int64)


class Graph:
    """Flat arrays of one shard's graph.  Node i has ``levels[i]`` lists above the ground, from ``first[i]`` on."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, ground: np.ndarray | None = None, above: np.ndarray | None = None,
                 entry: int = 0):
        self.x, self.levels, self.entry = x, levels, entry
        self.first = np.cumsum(levels) - levels
        self.ground = np.full((len(x), CAPACITY), -1, np.int32) if ground is None else ground
        self.above = np.full((int(levels.sum()), LINKS), -1, np.int32) if above is None else above
        self.seen, self.mark = np.zeros(len(x), np.int64), 0

    def _lists(self, nodes: np.ndarray, level: int) -> np.ndarray:
        return self.ground[nodes] if level == 0 else self.above[self.first[nodes] + level - 1]

    def walk(self, q: np.ndarray, ids: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found on a level from ``ids`` on: (nodes, squared distances), nearest first."""
        self.mark += 1
        self.seen[ids] = self.mark
        d = _squares(self.x[ids], q)
        order = np.argsort(d, kind="stable")[:beam]
        ids, d, open_ = ids[order], d[order], np.ones(len(order), bool)
        while True:
            some = np.flatnonzero(open_)[:WIDE]
            if not len(some):
                return ids, d
            open_[some] = False
            near = self._lists(ids[some], level).ravel()
            near = near[near >= 0]
            near = np.unique(near[self.seen[near] != self.mark])
            if not len(near):
                continue
            self.seen[near] = self.mark
            far = _squares(self.x[near], q)
            if len(ids) >= beam:
                better = far < d[-1]
                near, far = near[better], far[better]
                if not len(near):
                    continue
            ids, d = np.concatenate([ids, near]), np.concatenate([d, far])
            open_ = np.concatenate([open_, np.ones(len(near), bool)])
            order = np.argsort(d, kind="stable")[:beam]
            ids, d, open_ = ids[order], d[order], open_[order]

    def descend(self, q: np.ndarray, stop: int) -> np.ndarray:
        """Entry on level ``stop``: the nearest node found on each level above, from the top down."""
        at = np.array([self.entry])
        for level in range(int(self.levels[self.entry]), stop, -1):
            at = self.walk(q, at, level, 1)[0]
        return at

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """About the ``beam`` nearest nodes; all of them in a graph of at most that many."""
        start = np.arange(len(self.x)) if len(self.x) <= beam else self.descend(q, 0)
        return self.walk(q, start, 0, beam)[0]

    def add(self, i: int):
        q, top = self.x[i], int(self.levels[self.entry])
        at = self.descend(q, int(self.levels[i]))
        for level in range(min(top, int(self.levels[i])), -1, -1):
            at, d = self.walk(q, at, level, BUILD)
            x = self.x[at]
            # squared distances between the candidates
            between = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0)
            chosen = at[_diverse(d, between, LINKS)]
            self._lists_of(i, level)[:len(chosen)] = chosen
            for j in chosen.tolist():
                self._link(j, i, level)
        if self.levels[i] > top:
            self.entry = i

    def _lists_of(self, i: int, level: int) -> np.ndarray:
        return self.ground[i] if level == 0 else self.above[self.first[i] + level - 1]

    def _link(self, j: int, i: int, level: int):
        row = self._lists_of(j, level)
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        all_ = np.append(row, np.int32(i))
        x = self.x[all_]
        d = _squares(x, self.x[j])
        order = np.argsort(d, kind="stable")
        all_, x, d = all_[order], x[order], d[order]
        between = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0)
        keep = all_[_diverse(d, between, GROUND if level == 0 else LINKS)]
        row[:len(keep)] = keep
        row[len(keep):] = -1


def build(x: np.ndarray, levels: np.ndarray) -> Graph:
    g = Graph(x, levels)
    for i in range(1, len(x)):
        g.add(i)
    return g


def node_levels(digests: list[bytes]) -> np.ndarray:
    """Levels above the ground: geometric, from a hash of the vector."""
    u = (np.array([xxhash.xxh64_intdigest(d, seed=11) for d in digests], dtype=np.float64) + 1) / 2.0**64
    return np.floor(-np.log(np.minimum(u, 1.0)) / math.log(LINKS)).astype(np.int32)


def _unpack(parts: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1).astype(np.float64)


def _build(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Classes sorted by (shard, dim, digest) -> one row of flat arrays a shard and dimension."""
    for part in runs(batches, ["shard", "dim"]):
        vec = part.column("vec").to_pylist()
        members = part.column("members").to_pylist()
        g = build(_unpack(vec, kind), node_levels(part.column("digest").to_pylist()))
        blobs = (b"".join(vec), g.levels.astype("<i4").tobytes(), g.ground.astype("<i4").tobytes(), g.above.astype("<i4").tobytes(),
                 np.array([len(m) for m in members], "<i4").tobytes(), np.array([x for m in members for x in m], "<i8").tobytes())
        one = part.slice(0, 1)
        yield pa.RecordBatch.from_arrays(
            [one.column("shard").combine_chunks(), one.column("dim").combine_chunks(), pa.array([g.entry], pa.int32()),
             *(pa.array([x], pa.binary()) for x in blobs)], names=["shard", "dim", "entry", *BLOBS])


BLOBS = ("vectors", "levels", "ground", "above", "sizes", "ids")
INDEX_SCHEMA = "shard int, dim int, entry int, " + ", ".join(f"{b} binary" for b in BLOBS)


class _Shard:
    """A graph read back from its row, and the row ids of its nodes."""

    def __init__(self, r: dict, kind: str):
        levels = np.frombuffer(r["levels"], "<i4")
        x = np.frombuffer(r["vectors"], kind).reshape(len(levels), -1).astype(np.float64)
        self.graph = Graph(x, levels, np.frombuffer(r["ground"], "<i4").reshape(len(levels), -1),
                           np.frombuffer(r["above"], "<i4").reshape(-1, LINKS), r["entry"])
        self.size = np.frombuffer(r["sizes"], "<i4").astype(np.int64)
        self.first, self.ids = np.cumsum(self.size) - self.size, np.frombuffer(r["ids"], "<i8")

    def nearest(self, q: np.ndarray, own: int, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        nodes = self.graph.search(q, beam)
        score = np.sqrt(((self.graph.x[nodes] - q) ** 2).sum(1))
        size = self.size[nodes]
        row = np.repeat(np.arange(len(nodes)), size)
        ids = self.ids[self.first[nodes][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
        row, ids = row[ids != own], ids[ids != own]
        order = np.lexsort((ids, score[row]))[:k]
        return ids[order], score[row[order]]


def _search(batches: Iterator[pa.RecordBatch], kind: str, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (place, dim, is_query): a graph, then its queries -> query_id, query, vec_id, score."""
    held, shard = None, None
    for b in small(batches, 512):
        ids, score, row = [], [], []
        for i, r in enumerate(b.to_pylist()):
            if not r["is_query"]:
                held, shard = (r["place"], r["dim"]), _Shard(r, kind)
            elif held == (r["place"], r["dim"]):
                found, dist = shard.nearest(np.frombuffer(r["vec"], kind).astype(np.float64), r["query_id"], k, beam)
                ids.append(found)
                score.append(dist)
                row += [i] * len(found)
        if row:
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("query_id").take(at), b.column("query").take(at), pa.array(np.concatenate(ids)),
                 pa.array(np.concatenate(score))], names=["query_id", "query", "vec_id", "score"])


def element_kind(vectors: DataFrame) -> str:
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def index(named: DataFrame, kind: str, k: int = K, shard: int | None = None) -> tuple[DataFrame, int]:
    """(graphs, number of shards) of ``named`` (vec_id, digest, dim, vec): every vector is a node of one graph."""
    rows = named.where("vec_id is not null").select("digest", "vec_id", "dim", "vec").distinct()
    first = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))  # limited per task before the shuffle
    classes = rows.withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("digest").agg(
        F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    classes = materialize(classes, "vector_classes")
    shards = max(1, -(-classes.count() // (shard or SHARD)))
    dealt = (classes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
             .repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "digest"))
    graphs = dealt.select("shard", "dim", "digest", "vec", "members").mapInArrow(
        functools.partial(_build, kind=kind), INDEX_SCHEMA)
    return materialize(graphs, "graphs"), shards


def search(graphs: DataFrame, shards: int, queries: DataFrame, kind: str, k: int = K, beam: int = BEAM,
           chunk: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found to each row of ``queries`` (query_id, query, dim, vec)."""
    chunks = max(1, -(-queries.count() // (chunk or CHUNK)))

    def spread(n):  # 0 .. n - 1
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = (queries.withColumn("shard", spread(shards))
             .withColumn("place", F.col("shard") * chunks + F.pmod(F.xxhash64("query_id", "query"), F.lit(chunks)).cast("int"))
             .select("place", "dim", F.lit(True).alias("is_query"), "query_id", "query", "vec"))
    held = (graphs.withColumn("chunk", spread(chunks)).withColumn("place", F.col("shard") * chunks + F.col("chunk"))
            .select("place", "dim", F.lit(False).alias("is_query"), "entry", *BLOBS))
    both = asked.unionByName(held, allowMissingColumns=True)
    both = both.repartitionById(shards * chunks, "place").sortWithinPartitions("place", "dim", "is_query")
    found = both.mapInArrow(functools.partial(_search, kind=kind, k=k, beam=beam),
                            "query_id bigint, query binary, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, shard: int | None = None, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest other rows found to every row whose vec_id ``step`` divides.

    ``vectors``: vec_id, embedding.  score: Euclidean distance in double precision; ties go to the
    smaller vec_id.  Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows without vec_id; vectors of different lengths are not compared.  Rows with
    the query's vec_id are its own; a vec_id with several vectors is several candidates, and as a
    query each of its vectors is ranked by itself.  Equal rows count once.  Fewer than ``k``
    candidates are all returned.  Other columns are ignored; an empty table gives no rows.
    """
    kind = element_kind(vectors)
    named = materialize(vectors.select("vec_id", "embedding").mapInArrow(
        functools.partial(_named, kind=kind), "vec_id bigint, digest binary, dim int, vec binary"), "named_vectors")
    graphs, shards = index(named, kind, k, shard)
    queries = named.where(F.col("vec_id") % step == 0).select(
        F.col("vec_id").alias("query_id"), F.col("digest").alias("query"), "dim", "vec").distinct()
    return search(graphs, shards, materialize(queries, "queries"), kind, k, beam)


def op11(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
