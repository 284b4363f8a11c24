"""Grouping: constants, templates, duplicates, membership, sections, sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import utf16_order


def constant_groups(rows: DataFrame, key: Sequence[str], place: Sequence[str], least: int = 2) -> DataFrame:
    """Distinct occurrences (key, place) of the constants that have at least ``least`` of them, with their number ``n``.

    One row an occurrence: a constant that is everywhere fills no array.  Order by key and place to read them.
    """
    occurrences = rows.select(*dict.fromkeys((*key, *place))).distinct()
    sizes = occurrences.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return occurrences.join(sizes, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]).drop(*[f"_{k}" for k in key])


def template_groups(rows: DataFrame, key: Sequence[str], template: Column, place: Sequence[str], least: int = 2) -> DataFrame:
    """Distinct occurrences (key, template, place) of the one-hole templates that have at least ``least`` of them, with their number ``n``; texts without a template drop out."""
    marked = rows.withColumn("template", template).where("template is not null")
    return constant_groups(marked, [*key, "template"], place, least)


def in_group_order(groups: DataFrame, key: Sequence[str], path: str, start: str) -> DataFrame:
    """Occurrences by group, then path, then place."""
    return groups.orderBy(*key, utf16_order(F.col(path)), start)


def duplicates(rows: DataFrame, scope: Sequence[str], shape: Column, tokens: Column, least: int = 12) -> DataFrame:
    """All rows of at least ``least`` tokens whose shape repeats within their scope.

    Shapes are counted before they meet the rows, so that a shape with many rows
    is combined ahead of the shuffle and the join can split it.
    """
    marked = rows.withColumn("_shape", F.sha2(shape, 256)).where(tokens >= least)
    repeated = marked.groupBy(*scope, "_shape").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return marked.join(repeated, [*scope, "_shape"]).drop("_shape")


def with_groups(rows: DataFrame, members: DataFrame, key: str, group: str, name: str = "groups") -> DataFrame:
    """Each row with the sorted array of its groups; rows of no group keep an empty array."""
    found = members.groupBy(F.col(key).alias("_member")).agg(F.array_sort(F.collect_set(group)).alias(name))
    joined = rows.join(found, F.col(key) == F.col("_member"), "left").drop("_member")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def unique_group(groups: Column) -> Column:
    return F.when(F.size(groups) == 1, F.element_at(groups, 1))


def exactly_one(views: DataFrame, links: DataFrame, view: Sequence[str], owner: Sequence[str]) -> DataFrame:
    """Owners all of whose views have exactly one link; views without links count, owners without views don't."""
    counted = links.groupBy(*view).agg(F.count(F.lit(1)).alias("_n"))
    joined = views.select(*dict.fromkeys((*owner, *view))).distinct().join(counted, list(view), "left")
    return joined.groupBy(*owner).agg(F.bool_and(F.coalesce("_n", F.lit(0)) == 1).alias("_one")).where("_one").select(*owner)


def partition_greedily(rows: DataFrame, key: Sequence[str], order: Sequence[str], alike: Callable[[dict[str, np.ndarray], dict], np.ndarray], name: str = "part") -> DataFrame:
    """First-fit parts within each key: a row joins the first part whose first row is alike, else opens one.

    ``alike`` compares the first rows of all parts (arrays by column) with one row at once.
    """
    schema = rows.withColumn(name, F.lit(0)).schema
    kept = [f.name for f in rows.schema]

    def split(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in kept}
        heads = {c: np.empty(16, v.dtype) for c, v in columns.items()}
        n, parts = 0, np.empty(len(table), np.int32)
        for i in range(len(table)):
            row = {c: v[i] for c, v in columns.items()}
            fits = np.flatnonzero(alike({c: v[:n] for c, v in heads.items()}, row)) if n else ()
            if not len(fits):
                if n == len(heads[kept[0]]):
                    heads = {c: np.concatenate([v, np.empty_like(v)]) for c, v in heads.items()}
                for c, v in row.items():
                    heads[c][n] = v
                n += 1
            parts[i] = fits[0] if len(fits) else n - 1
        return table.append_column(name, pa.array(parts, pa.int32()))

    return rows.groupBy(*key).applyInArrow(split, schema)


def missing(expected: DataFrame, actual: DataFrame, key: str, fold: Callable[[Column], Column] = lambda c: c, order: str | None = None) -> DataFrame:
    """Distinct expected keys that ``actual`` lacks; null equals null.

    Of keys that fold alike the first spelling by ``order`` stays (without it, the smallest).
    """
    have = actual.select(fold(F.col(key)).alias("_other")).distinct()
    want = expected.groupBy(fold(F.col(key)).alias("_own")).agg((F.min(key) if order is None else F.min_by(key, order)).alias(key))
    return want.join(have, F.col("_own").eqNullSafe(F.col("_other")), "left_anti").select(key)


def unexpected(expected: DataFrame, actual: DataFrame, key: str, fold: Callable[[Column], Column] = lambda c: c, order: str | None = None) -> DataFrame:
    return missing(actual, expected, key, fold, order)


def are_equal(expected: DataFrame, actual: DataFrame, key: str, fold: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(are_equal, missing, unexpected): one row that compares two sets of keys."""
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    both = count(missing(expected, actual, key, fold), "missing").join(count(unexpected(expected, actual, key, fold), "unexpected"))  # a row each
    return both.select((F.col("missing") + F.col("unexpected") == 0).alias("are_equal"), "missing", "unexpected")


def blank_lines(lines: DataFrame, document: Sequence[str], text: str) -> DataFrame:
    """(document, blank, n_lines) of each document."""
    return lines.groupBy(*document).agg(F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("blank"), F.count(F.lit(1)).alias("n_lines"))


def sections(lines: DataFrame, document: Sequence[str], position: str, text: str) -> DataFrame:
    """Lines that are not blank, numbered by the runs that blank lines part."""
    order = Window.partitionBy(*document).orderBy(position)
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    before = F.sum(F.when(blank, 1).otherwise(0)).over(order)
    marked = lines.withColumn("_blank", blank).withColumn("_before", before)
    runs = Window.partitionBy(*document).orderBy("_before")
    return marked.where("not _blank").withColumn("section", F.dense_rank().over(runs)).drop("_blank", "_before")


def before_and_after(rows: DataFrame, chain: Sequence[str], position: str, value: str) -> DataFrame:
    """For each link of a chain: the values before it and after it in order, and whether it is first or last."""
    whole = Window.partitionBy(*chain).orderBy(position)
    before = F.collect_list(value).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    after = F.collect_list(value).over(whole.rowsBetween(1, Window.unboundedFollowing))
    first = F.row_number().over(whole) == 1
    last = F.lead(F.lit(1)).over(whole).isNull()
    return rows.select("*", before.alias("before"), after.alias("after"), first.alias("is_first"), last.alias("is_last"))

