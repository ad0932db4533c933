"""Connected components by alternating large-star and small-star joins.

Every step is a grouped minimum (map-side combined) and a join on the node id; a hub with
very many neighbours is an ordinary skewed join that AQE splits.  Each round's edges are
written to the shared folder, which cuts the lineage and survives lost executors.
Nothing but one checksum row per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import materialize

MAX_ROUNDS = 60


def _checksum(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of ``edges(u, v)``; label is the smallest id reachable.

    Self loops, repeated edges and edges in both directions are allowed; edges with a null
    end are ignored; no edges give no rows.
    """
    e = materialize(edges.select("u", "v").where("u <> v")
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _checksum(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "edges")
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("u").alias("id"), F.col("v").alias("label"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()))
