"""Session helpers: the shared folder, cutting the lineage of loops, size-checked broadcasts, free column names."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of them as JSON, up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


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


def small_side(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows and bytes; else as it is, to be joined by a shuffle."""
    size = df.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= most and size["bytes"] <= most_bytes else df


def holds(condition: Column) -> Column:
    """A condition read with two values: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def fresh(stem: str, *frames: DataFrame) -> str:
    """``stem``, or the first of stem_2, stem_3 ... that no frame has as a column, whatever its case."""
    have, n, name = {c.lower() for f in frames for c in f.columns}, 1, stem
    while name.lower() in have:
        n += 1
        name = f"{stem}_{n}"
    return name


def first_of_each(rows: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window

    name = fresh("_nth", rows)
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) == 1).drop(name)


class Gathered:
    """A relation that a loop adds to: each round's rows are written once, and merged with others now and then."""

    def __init__(self, first: DataFrame, most: int = 8):
        self.parts, self.most = [first], most

    def rows(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [cut_lineage(self.rows())]
