"""Three-valued evidence: merging ranges, measuring lines, requirements and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COVERED, UNCOVERED, UNKNOWN = "Covered", "Uncovered", "Unknown"


def merged_state(state: str) -> Column:
    """Covered if all are, Uncovered if all are, else Unknown."""
    return F.when(F.bool_and(F.col(state) == COVERED), COVERED).when(F.bool_and(F.col(state) == UNCOVERED), UNCOVERED).otherwise(UNKNOWN)


def merge_points(rows: DataFrame, key: Sequence[str], state: str = "state") -> DataFrame:
    return rows.groupBy(*key).agg(merged_state(state).alias(state))


def merge_ranges(rows: DataFrame, span: Sequence[str], function: str) -> DataFrame:
    """Merge the ranges of each function at a span, then the functions at it."""
    return merge_points(merge_points(rows, [*span, function]), span)


def measure_lines(ranges: DataFrame, document: Sequence[str], first: str = "first_line", last: str = "last_line", state: str = "state") -> DataFrame:
    """(document, covered, coverable, is_complete): a line counts as covered if all ranges over it are."""
    lines = ranges.withColumn("line", F.explode(F.sequence(F.col(first), F.greatest(F.col(first), F.col(last)))))
    each = lines.groupBy(*document, "line").agg(F.bool_and(F.col(state) == COVERED).alias("_covered"), F.bool_or(F.col(state) == UNKNOWN).alias("_unknown"))
    return each.groupBy(*document).agg(F.count_if("_covered").alias("covered"), F.count(F.lit(1)).alias("coverable"), (~F.bool_or("_unknown")).alias("is_complete"))


def end_line(start: Column, end: Column, line_at) -> Column:
    """Line of a range's last character."""
    return line_at(F.greatest(start, end - 1))


def at_least(covered: Column, coverable: Column, complete: Column, percent: float) -> Column:
    """Whether a complete measure of at least one line reaches a percentage."""
    return F.coalesce(complete & (coverable > 0) & (F.try_divide(covered * 100.0, coverable) >= percent), F.lit(False))


def line_state(covered: Column, coverable: Column, complete: Column) -> Column:
    return F.when(complete & (coverable > 0), F.when(covered == coverable, COVERED).otherwise(UNCOVERED)).otherwise(UNKNOWN)


#: Why evidence is not conclusive. Fixed values.
REASONS = (
    "EvidenceNotPrepared", "LooseSource", "NoApplicableTests", "MissingSymbols", "SymbolIdentityMismatch", "ModuleIdentityMismatch", "SourceIdentityMismatch",
    "MissingOrExcludedDocument", "MissingRange", "PartialRange", "UnsupportedExpressionMapping", "UnsupportedEnumerationMapping",
)


def inspect(occurrences: DataFrame, ranges: DataFrame, document: Sequence[str], key: Sequence[str], fixtures: DataFrame | None = None, precise: DataFrame | None = None, covered_documents: DataFrame | None = None) -> DataFrame:
    """State and reason of each occurrence (start, end) from the ranges (o_start, o_end, state) that hold it.

    What counts first: a fixture for the very span; a document without any evidence
    (where ``covered_documents`` lists those that have some, with ``reason`` null, or say
    why not); a precise statement for the very span; then the ranges.  ``fixtures`` and
    ``precise`` have the document columns, start, end, state and reason.
    """
    from millrace.operators.spans import containment_join

    own = containment_join(occurrences, ranges, document).groupBy(*key).agg(
        F.bool_and(F.col("state") == UNCOVERED).alias("_none"),
        F.bool_or(F.col("state") == UNKNOWN).alias("_some"),
        F.max(F.when((F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end")), F.col("state"))).alias("_exact"),
    )
    joined = occurrences.join(own, list(key), "left")
    state = F.when(F.col("_none").isNull(), UNKNOWN).when(F.col("_none"), UNCOVERED).when(F.col("_some"), UNKNOWN).when(F.col("_exact").isNotNull(), F.col("_exact")).otherwise(UNKNOWN)
    reason = F.when(F.col("_none").isNull(), "MissingRange").when(F.col("_none"), None).when(F.col("_some"), "PartialRange").when(F.col("_exact").isNull(), "UnsupportedExpressionMapping")
    at = [*document, "start", "end"]
    if precise is not None:
        joined = joined.join(precise.select(*at, F.col("state").alias("_p_state"), F.col("reason").alias("_p_reason")), at, "left")
        state, reason = F.coalesce("_p_state", state), F.when(F.col("_p_state").isNotNull(), F.col("_p_reason")).otherwise(reason)
    if covered_documents is not None:
        joined = joined.join(covered_documents.select(*document, F.lit(True).alias("_has"), F.col("reason").alias("_d_reason")), list(document), "left")
        absent = F.coalesce(F.col("_d_reason"), F.when(F.col("_has").isNull(), "EvidenceNotPrepared"))
        state, reason = F.when(absent.isNotNull(), UNKNOWN).otherwise(state), F.coalesce(absent, reason)
    if fixtures is not None:
        joined = joined.join(fixtures.select(*at, F.col("state").alias("_f_state"), F.col("reason").alias("_f_reason")), at, "left")
        state, reason = F.coalesce("_f_state", state), F.when(F.col("_f_state").isNotNull(), F.col("_f_reason")).otherwise(reason)
    return joined.withColumns({"evidence_state": state, "evidence_reason": reason}).drop("_none", "_some", "_exact", "_p_state", "_p_reason", "_has", "_d_reason", "_f_state", "_f_reason")


def executed(state: Column) -> Column:
    """Whether execution is established: what is unknown is not."""
    return F.coalesce(state == COVERED, F.lit(False))


def enumeration_started(loops: DataFrame, advances: DataFrame, ranges: DataFrame) -> DataFrame:
    """``loops`` (loop_id, document_id, start, is_resolved) with evidence that their first advance ran.

    ``advances`` has (document_id, start, function_id): the points where a loop moves
    on, one a compiled function; ``ranges`` (document_id, start, function_id, state).
    Every point needs a range of its function.
    """
    points = loops.where("is_resolved").select("loop_id", "document_id", "start").join(advances, ["document_id", "start"])
    held = points.join(ranges.select("document_id", "start", "function_id", "state"), ["document_id", "start", "function_id"], "left")
    own = held.groupBy("loop_id").agg(F.bool_or(F.col("state").isNull()).alias("_lacks"), merged_state("state").alias("_state"))
    joined = loops.join(own, "loop_id", "left")
    state = F.when(F.col("_lacks").isNull() | F.col("_lacks"), UNKNOWN).otherwise(F.col("_state"))
    reason = F.when(F.col("_lacks").isNull(), "UnsupportedEnumerationMapping").when(F.col("_lacks"), "MissingRange").when(F.col("_state") == UNKNOWN, "PartialRange")
    return joined.withColumns({"evidence_state": state, "evidence_reason": reason}).drop("_lacks", "_state")


def failure_message(state: Column, uncovered: str | Column, unknown: str | Column) -> Column:
    """What a requirement that is not met says: one message where it did not run, another where nobody knows."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(state == UNCOVERED, text(uncovered)).when(state == UNKNOWN, text(unknown))


def review_unknown(state: Column, reasons: Column, configured: Sequence[str]) -> Column:
    """Whether a failure is only for review: it is unknown, and every reason is one that may be reviewed."""
    allowed = F.array(*[F.lit(r) for r in configured]) if configured else F.array().cast("array<string>")
    return (state == UNKNOWN) & (F.size(reasons) > 0) & F.forall(reasons, lambda r: F.array_contains(allowed, r))


def combine_failures(failures: Column) -> Column:
    """(review, message) of the failed parts (struct review, message): review only if all are; messages once each."""
    return F.struct(F.forall(failures, lambda f: f["review"]).alias("review"), F.array_join(F.array_distinct(F.transform(failures, lambda f: f["message"])), "; ").alias("message"))
