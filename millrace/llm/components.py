"""Connected components over links, with every step distributed, and tiles for hot buckets.

``components`` alternates large-star and small-star rounds: each is a grouped
minimum (combined before the shuffle) and a join that Spark splits where a
vertex is hot; while few edges are left, the minima are broadcast.  Lineage is cut by ``checkpoint`` in the cluster's shared folder.
A round that changes nothing ends it: edges are compared by their number and two
sums of 64-bit hashes.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one bucket that meet in one task; larger buckets are cut into tiles of this size that meet in pairs.
TILE = 2_048
#: Large buckets or edges, of some 50 bytes each, up to which what stands for them is broadcast.
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; a folder of its own only on one machine, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    return tempfile.mkdtemp(prefix="shared-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(columns: list[str], stem: str) -> str:
    """``stem``, or the first of stem_2, stem_3 ... that is no column yet, whatever its case."""
    have, n, name = {c.lower() for c in columns}, 1, stem
    while name.lower() in have:
        n += 1
        name = f"{stem}_{n}"
    return name


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches; ``links`` has columns a and b."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    wide = [F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2)]
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), *wide).first())
    size = sums(edges)
    while size[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = F.broadcast if size[0] <= FEW else lambda x: x  # a row of 16 bytes a node, two nodes an edge
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(least), "u")
        after = cut_lineage(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        edges, before, size = after, size, sums(after)
        if size == before:
            break
    out = edges.groupBy("u").agg(F.min("v").alias("component"))
    return out.select(F.col("u").alias("node"), "component").unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def tiled(rows: DataFrame, bucket: list[str], id_column: str, tile: int = TILE) -> DataFrame:
    """Rows of each bucket with ``tile_a`` and ``tile_b``: tasks of at most some 2 * tile rows that cover all pairs.

    Small buckets keep (0, 0).  A large bucket's rows are dealt to tiles by
    id and repeated once for each tile they have to meet.  The list of large
    buckets is counted first; a short one is broadcast, so that rows don't move.
    """
    large = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    large = cut_lineage(large.select(*bucket, F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")))
    n = large.limit(FEW + 1).count()
    if not n:
        return rows.select("*", *[F.lit(0).alias(c) for c in ("_own", "tile_a", "tile_b")])
    met = rows.join(F.broadcast(large) if n <= FEW else large, bucket, "left")
    own = F.coalesce(F.pmod(F.xxhash64(id_column), F.col("_tiles")), F.lit(0)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_tiles"), F.lit(1)) - 1))
    met = met.withColumn("_own", own).withColumn("_other", other)
    return met.withColumns({"tile_a": F.least("_own", "_other"), "tile_b": F.greatest("_own", "_other")}).drop("_tiles", "_other")


def runs_of_pairs(key: np.ndarray):
    """All pairs i < j with equal keys of a sorted array, as index arrays of bounded size."""
    i = np.arange(max(0, len(key) - 1))
    d = 1
    while len(i):
        i = i[i + d < len(key)]
        i = i[key[i + d] == key[i]]
        if len(i):
            yield i, i + d
        d += 1


class Forest:
    """Smallest index that each index reaches, over pairs that come in pieces."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (np.not_equal(step := label[label], label)).any():
                label[:] = step


