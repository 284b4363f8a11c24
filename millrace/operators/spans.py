"""Joins over spans: containment, innermost scope, overlap, nearest ancestor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.session import fresh, holds


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (outer_end >= end)


#: Width of the finest bins of a containment join, how much wider each level's are, and the levels.
BIN, WIDER, LEVELS = 256, 16, 7


def containment_join(inner: DataFrame, outer: DataFrame, document: Sequence[str], bins: bool = True) -> DataFrame:
    """Spans of ``inner`` (start, end) with the spans of ``outer`` (o_start, o_end) of their document that hold them.

    An outer span goes to the bins that it reaches on the first level whose bins are
    as wide as it is, two at most (more above the last level); an inner span asks for
    its start's bin on every level.  So a document with many spans is shared out, and
    every pair is found once.  Without ``bins`` spans meet by document.
    """
    test = contains(F.col("o_start"), F.col("o_end"), F.col("start"), F.col("end"))
    if not bins:
        return inner.join(outer, [*document]).where(test)
    level, bin_ = fresh("_level", inner, outer), fresh("_bin", inner, outer)
    widths = [BIN * WIDER**k for k in range(LEVELS)]
    length = F.col("o_end") - F.col("o_start")
    own = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        own = F.when(length <= widths[k], k).otherwise(own)
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col(level) + 1)
    dealt = outer.withColumn(level, own).withColumn(bin_, F.explode(F.sequence(F.floor(F.col("o_start") / width), F.floor(F.greatest("o_start", "o_end") / width))))
    asked = F.array(*[F.struct(F.lit(k).alias(level), F.floor(F.col("start") / w).alias(bin_)) for k, w in enumerate(widths)])
    return inner.select("*", F.inline(asked)).join(dealt, [*document, level, bin_]).where(test).drop(level, bin_)


def holding_join(points: DataFrame, scopes: DataFrame, document: Sequence[str], at: str, start: Column, end: Column) -> DataFrame:
    """``points`` with the ``scopes`` of their document that hold them: start <= at < end.

    Dealt as in ``containment_join``, on levels up to the widest long, so that a scope
    without an end reaches few bins too.  Which levels have scopes is looked up
    first; a point asks on those only.
    """
    level, bin_, low, high = (fresh(stem, points, scopes) for stem in ("_level", "_bin", "_low", "_high"))
    widths = [float(BIN * WIDER**k) for k in range(16)]
    length = F.col(high).cast("double") - F.col(low).cast("double")
    own = F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), length / BIN))).cast("int")
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col(level) + 1)
    real = scopes.withColumn(low, start).withColumn(high, end).where(F.col(low) < F.col(high)).withColumn(level, own)
    levels = sorted(r[0] for r in real.select(level).distinct().collect()) or [0]  # 16 at most
    dealt = real.withColumn(bin_, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    asked = F.array(*[F.struct(F.lit(k).alias(level), F.floor(F.col(at) / widths[k]).alias(bin_)) for k in levels])
    test = (F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))
    return points.select("*", F.inline(asked)).join(dealt, [*document, level, bin_]).where(test).drop(level, bin_, low, high)


def innermost(joined: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of the scopes that hold each row, the smallest; of equal ones, the one that starts last."""
    order = Window.partitionBy(*key).orderBy((F.col("o_end") - F.col("o_start")).asc(), F.col("o_start").desc())
    return joined.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def overlaps(a_start: Column, a_length: Column, b_start: Column, b_length: Column) -> Column:
    """Strict overlap of two spans; an insertion also conflicts where it touches."""
    a_end, b_end = a_start + a_length, b_start + b_length
    touch = (a_start <= b_end) & (b_start <= a_end)
    return F.when((a_length == 0) | (b_length == 0), touch).otherwise((a_start < b_end) & (b_start < a_end))


def overlap_pairs(edits: DataFrame, file: str, key: str, width: int = 4_096) -> DataFrame:
    """(file, a, b): pairs of different edits of a file, a < b, that conflict.

    Edits meet in the bins of ``width`` that they reach, and each pair in the bin
    where the later one starts.
    """
    def side(name: str, of: str) -> DataFrame:
        rows = edits.select(F.col(file).alias(of), F.col(key).alias(name), F.col("start").alias(f"{name}_start"), F.col("length").alias(f"{name}_length"))
        reach = F.sequence(F.floor(F.col(f"{name}_start") / width), F.floor((F.col(f"{name}_start") + F.col(f"{name}_length")) / width))
        return rows.withColumn(f"_{name}_bin", F.explode(reach))

    test = (F.col(file) == F.col("_file")) & (F.col("_a_bin") == F.col("_b_bin")) & (F.col("a") < F.col("b"))
    once = F.col("_a_bin") == F.floor(F.greatest("a_start", "b_start") / width)
    hit = overlaps(F.col("a_start"), F.col("a_length"), F.col("b_start"), F.col("b_length"))
    return side("a", file).join(side("b", "_file"), test & once & hit).select(file, "a", "b")


def beside(rows: DataFrame, name: str, order: Window, first: Column, second: Column) -> DataFrame:
    """Adds what lies before each row in an order: ``name``_first, its greatest item, and ``name``_second, the greatest of another owner.

    Items are structs (at, owner) or null; a row gives two, ``second`` not above
    ``first``.  ``name``_own and ``name``_beaten are the row's part in both: their
    maxima over all rows are the two items of the whole.
    """
    def lesser(a: Column, b: Column) -> Column:
        return F.when(a["owner"] != b["owner"], F.least(a, b))

    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{name}_own", first).withColumn(f"{name}_first", F.max(f"{name}_own").over(before))
    top = F.greatest(f"{name}_first", f"{name}_own")
    beaten = F.greatest(lesser(F.col(f"{name}_first"), F.col(f"{name}_own")), lesser(top, second))
    return rows.withColumn(f"{name}_beaten", beaten).withColumn(f"{name}_second", F.max(f"{name}_beaten").over(before))


def overlapped(edits: DataFrame, file: str, owner: str, content: str, width: int = 4_096) -> DataFrame:
    """Owners with an edit that conflicts with one of another owner in its file; edits of the same place and content agree.

    A sweep instead of pairs: equal edits become one, and each is held against the
    farthest end before it and the nearest start behind it, twice, so that its own
    owner can be left out.  The sweep runs in bins of ``width`` and once over their
    sums.  Doubled places make an insertion a span from half a place before to half
    a place behind.
    """
    own = edits.select(F.col(file).alias("file"), F.col(owner).alias("owner"), "start", "length", F.col(content).alias("content")).where("file is not null and owner is not null and start is not null and length is not null")
    start, end, empty = F.col("start").cast("long") * 2, (F.col("start").cast("long") + F.col("length")) * 2, F.col("length") == 0
    one = own.groupBy("file", "start", "length", "content").agg(F.min("owner").alias("_least"), F.max("owner").alias("_most"))
    one = one.withColumn("_from", F.when(empty, start - 1).otherwise(start)).withColumn("_to", F.when(empty, start + 1).otherwise(end))
    one = one.withColumn("_at", F.least("_from", "_to")).withColumn("_bin", F.floor(F.col("_at") / width))

    def items(at: Column) -> list[Column]:
        return [F.when(at.isNotNull(), F.struct(at.alias("at"), F.col(name).alias("owner"))) for name in ("_most", "_least")]

    # a length below zero (both ends must lie within the other span) reaches none behind it, and comes before what starts at its lower end
    forward = ["_at", F.col("length") >= 0, "_from", "_to", "content"]
    backward = [F.col("_at").desc(), (F.col("length") >= 0).desc(), F.col("_from").desc(), F.col("_to").desc(), F.col("content").desc()]
    bins = Window.partitionBy("file", "_bin")
    one = beside(one, "_end", bins.orderBy(*forward), *items(F.when(F.col("length") >= 0, F.col("_to"))))
    one = beside(one, "_start", bins.orderBy(*backward), *items(-F.col("_from")))
    sums = one.groupBy("file", "_bin").agg(*[F.max(f"{n}_{part}").alias(f"{n}_{part}") for n in ("_end", "_start") for part in ("own", "beaten")])
    for n, order in (("_end", F.col("_bin")), ("_start", F.col("_bin").desc())):
        sums = beside(sums.withColumnRenamed(f"{n}_beaten", f"{n}_two"), f"{n}s", Window.partitionBy("file").orderBy(order), F.col(f"{n}_own"), F.col(f"{n}_two"))
    sums = sums.select("file", "_bin", *[f"{n}s_{part}" for n in ("_end", "_start") for part in ("first", "second")])

    def beyond(name: str, limit: Column) -> Column:
        first, second = F.col(f"{name}_first"), F.col(f"{name}_second")
        return holds(F.when(first["owner"] != F.col("owner"), first["at"] > limit).otherwise(second["at"] > limit))

    swept = one.join(sums, ["file", "_bin"]).withColumnsRenamed({"file": "_file", "start": "_start", "length": "_length", "content": "_content"})
    same = (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length")) & F.col("content").eqNullSafe(F.col("_content"))
    earlier = beyond("_end", F.col("_from")) | beyond("_ends", F.col("_from"))
    later = (F.col("length") >= 0) & (beyond("_start", -F.col("_to")) | beyond("_starts", -F.col("_to")))
    return own.join(swept, same).where(earlier | later).select(F.col("owner").alias(owner)).distinct()


def nearest_ancestor(rows: DataFrame, nodes: DataFrame, document: Sequence[str], key: Sequence[str], wanted: Column, stop: Column) -> DataFrame:
    """The nearest node around each row that is wanted, unless a stopping node lies nearer.

    ``nodes`` has o_start and o_end; wanted and stop are conditions on them.
    """
    marked = nodes.where(holds(wanted) | holds(stop)).withColumn("_wanted", holds(wanted))
    return innermost(containment_join(rows, marked, document), key).where("_wanted").drop("_wanted")
