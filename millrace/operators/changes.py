"""Change detection against an accepted state, and suppression by allowances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import length_prefixed, utf16_order
from millrace.operators.spans import containment_join, innermost
from millrace.plans.session import fresh


ADDED, MODIFIED, UNCHANGED = "Added", "Modified", "Unchanged"


def change_of(current: DataFrame, accepted: DataFrame, key: Sequence[str], content: Column, base_content: Column) -> DataFrame:
    """Rows of ``current`` with ``change``: Added, Unchanged or Modified. Deleted rows are not shown.

    A null content is a content like others.  Where a key was accepted several times, its
    last row by content stands, so that every current row is shown once.
    """
    here, key_of = fresh("_here", current), [fresh(f"_{c}", current) for c in key]
    hashed = lambda c: F.coalesce(F.sha2(c, 256), F.lit("none"))
    side = accepted.groupBy(*[F.col(c).alias(n) for c, n in zip(key, key_of, strict=True)]).agg(F.max(hashed(base_content)).alias(here))
    joined = current.join(side, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, key_of, strict=True)], "left")
    change = F.when(F.col(here).isNull(), ADDED).when(hashed(content) == F.col(here), UNCHANGED).otherwise(MODIFIED)
    return joined.withColumn("change", change).drop(here, *key_of)


def changed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("change") != UNCHANGED)


def project_key(path: Column, framework: Column, properties: Column) -> Column:
    """Key of a project in its evaluation: its path, framework and properties, these by name whatever their case."""
    named = F.array_sort(F.transform(F.map_entries(F.coalesce(properties, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.concat_ws("|", F.replace(path, F.lit("\\"), F.lit("/")), F.coalesce(framework, F.lit("")), F.array_join(F.transform(named, lambda e: length_prefixed(e["key"], F.coalesce(e["value"], F.lit("")))), "|"))


def joined_parts(parts: DataFrame, symbol: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """One text for each symbol: its parts in order, a newline between them."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, text)))
    return parts.groupBy(*symbol).agg(F.array_join(F.transform(ordered, lambda p: p[text]), "\n").alias(text))


class Baseline:
    """An accepted earlier state: files (project_key, path, text) and symbol parts (project_key, symbol, path, start, text, accessibility).

    A path that moved, and a symbol of another name, count as added.
    """

    def __init__(self, files: DataFrame, parts: DataFrame | None = None):
        slash = F.replace("path", F.lit("\\"), F.lit("/"))
        self.files, self.parts = files.withColumn("path", slash), parts

    def change_of_files(self, files: DataFrame) -> DataFrame:
        slash = F.replace("path", F.lit("\\"), F.lit("/"))
        return change_of(files.withColumn("path", slash), self.files, ["project_key", "path"], F.col("text"), F.col("text"))

    def changed_files(self, files: DataFrame) -> DataFrame:
        return changed(self.change_of_files(files))

    def change_of_symbols(self, parts: DataFrame) -> DataFrame:
        """(project_key, symbol, change): a symbol's text is that of its parts by path and place."""
        text = lambda p: joined_parts(p.where("symbol is not null").withColumn("_path", utf16_order(F.col("path"))), ["project_key", "symbol"], ["_path", "start"], "text")
        return change_of(text(parts), text(self.parts), ["project_key", "symbol"], F.col("text"), F.col("text")).drop("text")

    def previous_accessibility(self, symbols: DataFrame) -> DataFrame:
        """``symbols`` with ``previous``: the accessibility that each had, null where it wasn't captured."""
        side = self.parts.groupBy("project_key", "symbol").agg(F.min("accessibility").alias("previous"))
        return symbols.join(side, ["project_key", "symbol"], "left")


def suppress(findings: DataFrame, allowances: DataFrame, document: Sequence[str], key: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings that no allowance holds; the allowed ones with their innermost allowance; allowances that none used.

    ``allowances`` has (allowance_id, rule_id, o_start, o_end) and the document columns.
    """
    spans = findings.withColumn("end", F.col("start"))
    held = innermost(containment_join(spans, allowances, [*document, "rule_id"]), key)
    left = findings.join(held.select(*key), list(key), "left_anti")
    unused = allowances.join(held.select("allowance_id").distinct(), "allowance_id", "left_anti")
    return left, held.drop("end"), unused
