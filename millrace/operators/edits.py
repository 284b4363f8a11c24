"""Edit plans: batches of edits that agree, don't conflict and are safe everywhere."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import length_prefixed
from millrace.operators.graph import connected
from millrace.operators.spans import overlap_pairs, overlapped


def batch_ids(edits: DataFrame) -> DataFrame:
    """(proposal, batch_id): SHA-256 over a proposal's edits in order, every part with its length before it."""
    one = F.struct("file_identity", "start", "length", length_prefixed(F.col("file_identity"), F.col("start").cast("string"), F.col("length").cast("string"), F.col("replacement")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(one)), lambda e: e["part"])
    return edits.groupBy("proposal").agg(F.upper(F.sha2(F.array_join(parts, ""), 256)).alias("batch_id"))


def safe_everywhere(edits: DataFrame, file_contexts: DataFrame, validations: DataFrame) -> DataFrame:
    """Batches with a safe validation in every context that contains one of their files."""
    needed = edits.select("batch_id", "file_identity").distinct().join(file_contexts, "file_identity").select("batch_id", "context_id").distinct()
    lacking = needed.join(validations.where("is_safe").select("batch_id", "context_id").distinct(), ["batch_id", "context_id"], "left_anti")
    return edits.select("batch_id").distinct().join(lacking.select("batch_id").distinct(), "batch_id", "left_anti")


def conflicting(edits: DataFrame) -> DataFrame:
    """(a, b): pairs of different batches with edits that conflict in a file; equal edits agree."""
    own = edits.select("file_identity", "batch_id", "start", "length", "replacement").distinct().withColumn("edit", F.struct("batch_id", "start", "length", "replacement"))
    pairs = overlap_pairs(own, "file_identity", "edit").where("a.batch_id <> b.batch_id")
    same = (F.col("a.start") == F.col("b.start")) & (F.col("a.length") == F.col("b.length")) & F.col("a.replacement").eqNullSafe(F.col("b.replacement"))
    return pairs.where(~same).select(F.least("a.batch_id", "b.batch_id").alias("a"), F.greatest("a.batch_id", "b.batch_id").alias("b")).distinct()


def without_conflicts(edits: DataFrame) -> DataFrame:
    """Edits of the batches that conflict with no other; both sides of a conflict are withheld."""
    return edits.join(overlapped(edits, "file_identity", "batch_id", "replacement"), "batch_id", "left_anti")


def agreed(findings: DataFrame, key: list[str], sets: DataFrame) -> DataFrame:
    """Locations whose contexts all propose batches with the same edits; ``sets`` has (batch_id, edit_set)."""
    joined = findings.join(sets, "batch_id", "left")
    grouped = joined.groupBy(*key).agg(F.count_distinct("edit_set").alias("_kinds"), F.bool_and(F.col("edit_set").isNotNull()).alias("_all"), F.min_by("batch_id", "context_id").alias("batch_id"))
    return grouped.where("_kinds = 1 and _all").drop("_kinds", "_all")


def conflict_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): batches that share contexts or reporting groups, by their smallest member."""
    return connected(links.select(F.col(a).alias("a"), F.col(b).alias("b")))


def sharing(batches: DataFrame, by: str) -> DataFrame:
    """(a, b): links between the batches that share a value of a column, a star for each value."""
    least = batches.groupBy(by).agg(F.min("batch_id").alias("a"))
    return batches.join(least, by).select("a", F.col("batch_id").alias("b")).distinct()


def combined(batches: DataFrame, is_safe: Callable[[list[str]], bool]) -> list[str]:
    """Batches that are safe together, on the driver: whole components, else one after the other in order.

    ``batches`` has (component, batch_id); ``is_safe`` proves a set of batches at once.
    """
    kept: list[str] = []
    for row in batches.groupBy("component").agg(F.array_sort(F.collect_set("batch_id")).alias("ids")).orderBy("component").toLocalIterator():
        if is_safe(row["ids"]):
            kept += row["ids"]
            continue
        held: list[str] = []
        for batch in row["ids"]:
            if is_safe([*held, batch]):
                held.append(batch)
        kept += held
    return kept


def proposals(edits: DataFrame, moves: DataFrame, validations: DataFrame, withheld: DataFrame) -> DataFrame:
    """(batch_id, n_edits, n_moves, is_proved, withheld): each proposed fix in one row.

    ``validations`` has (batch_id, context_id, is_safe), ``withheld`` (batch_id, reason): a
    fix that its producer gave up, which has no edits.
    """
    ids = edits.select("batch_id").unionByName(moves.select("batch_id")).unionByName(withheld.select("batch_id")).distinct()
    count = lambda rows, name: rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias(name))
    proved = validations.groupBy("batch_id").agg(F.bool_and("is_safe").alias("is_proved"))
    reasons = withheld.groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("withheld"))
    out = ids.join(count(edits, "n_edits"), "batch_id", "left").join(count(moves, "n_moves"), "batch_id", "left").join(proved, "batch_id", "left").join(reasons, "batch_id", "left")
    return out.select("batch_id", F.coalesce("n_edits", F.lit(0)).alias("n_edits"), F.coalesce("n_moves", F.lit(0)).alias("n_moves"), (F.coalesce("is_proved", F.lit(False)) & F.col("withheld").isNull()).alias("is_proved"), "withheld")


def replace_span(rows: DataFrame, batch_id: Column, replacement: Column) -> DataFrame:
    """Edits that replace each row's own span."""
    return rows.select(batch_id.alias("batch_id"), "file_identity", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), replacement.alias("replacement"))


def self_conflicting(edits: DataFrame) -> DataFrame:
    """Batches with edits of their own that conflict."""
    own = edits.select("file_identity", "batch_id", "start", "length", "replacement").distinct().withColumn("edit", F.struct("batch_id", "start", "length", "replacement"))
    return overlap_pairs(own, "file_identity", "edit").where("a.batch_id = b.batch_id").select(F.col("a.batch_id").alias("batch_id")).distinct()


#: Ends of file names that mark generated code, in lower case, and a beginning that does. Fixed values.
GENERATED_ENDS, GENERATED_BEGIN = (".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs"), "temporarygeneratedfile_"


def below(path: Column, folder: Column) -> Column:
    return F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


def move_problem(moves: DataFrame, documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """(batch_id, file_identity, destination, problem): why a move is not supported, null if it is.

    ``documents`` has (context_id, file_identity, path, is_generated, is_editable,
    is_default_compile_item), ``contexts`` (context_id, name, glob_directory: the folder
    whose files it compiles by default, null if it has no such rule).
    """
    name = F.element_at(F.split("destination", "/"), -1)
    ends = F.lit(False)
    for end in GENERATED_ENDS:
        ends = ends | F.endswith(F.lower(name), F.lit(end))
    odd = F.col("destination").rlike(r"(^|/)(\.\.?)?(/|$)") & ~F.col("destination").rlike(r"^/[^/]") | F.col("destination").rlike(r"//|\\|/\.\.?(/|$)|^\.\.?(/|$)|/$")
    invalid = F.when(odd, "the new path is not a normalized file path").when(~name.endswith(".cs") | (F.length(name) <= 3), "the new file name does not end in .cs").when(ends | F.startswith(F.lower(name), F.lit(GENERATED_BEGIN)), "the new file name marks generated code")
    own = documents.join(contexts.select("context_id", "glob_directory"), "context_id").join(moves.select("batch_id", "file_identity", "destination"), "file_identity")
    held = own.groupBy("batch_id", "file_identity", "destination").agg(
        F.bool_or(F.col("is_generated") | ~F.col("is_editable")).alias("_fixed"), F.bool_or(F.col("path") == F.col("destination")).alias("_same"),
        F.bool_or(F.col("glob_directory").isNull()).alias("_ruled"), F.bool_or(~F.col("is_default_compile_item")).alias("_linked"),
        F.bool_or(~below(F.col("destination"), F.col("glob_directory"))).alias("_outside"), F.collect_set("context_id").alias("_contexts"),
    )
    others = contexts.where("glob_directory is not null").select(F.col("context_id").alias("_context"), F.col("glob_directory").alias("_glob"))
    taken = held.join(others, below(F.col("destination"), F.col("_glob")) & ~F.array_contains("_contexts", F.col("_context"))).select("batch_id", "file_identity", F.lit(True).alias("_taken")).distinct()
    there = documents.select(F.lower("path").alias("_path"), F.col("file_identity").alias("_file")).distinct()
    collides = moves.join(there, (F.lower("destination") == F.col("_path")) & (F.col("file_identity") != F.col("_file"))).select("batch_id", "file_identity", F.lit(True).alias("_collides")).distinct()
    key = ["batch_id", "file_identity"]
    joined = moves.join(held.drop("destination"), key, "left").join(taken, key, "left").join(collides, key, "left")
    problem = (
        F.when(F.col("_contexts").isNull(), "the file is not part of a loaded project").when(F.col("_fixed"), "the file is generated or not editable")
        .when(F.col("_same"), "the file already has that path").when(invalid.isNotNull(), invalid)
        .when(F.col("_ruled"), "a project selects its sources by other rules than the default").when(F.col("_linked"), "a project compiles the file through a link")
        .when(F.col("_outside"), "a project would not compile the file at its new path").when(F.col("_taken"), "another project would also compile the file at its new path")
        .when(F.col("_collides"), "the new path collides with a loaded file")
    )
    return joined.select("batch_id", "file_identity", "destination", problem.alias("problem"))


def apply_to_text(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """A text with its edits (UTF-16 start, length, replacement) applied from the last to the first."""
    units = text.encode("utf-16-le", "surrogatepass")
    for start, length, replacement in sorted(edits, reverse=True):
        units = units[: 2 * start] + replacement.encode("utf-16-le", "surrogatepass") + units[2 * (start + length) :]
    return units.decode("utf-16-le", "surrogatepass")


def apply_plan(root: str, plan: Iterable[tuple[str, str, list[tuple[int, int, str]]]], moves: Iterable[tuple[str, str]] = ()) -> list[str]:
    """Apply (path, upper-case SHA-256 of the bytes, edits) below ``root`` on the driver, then the moves; paths written.

    Every file is checked before the first is written; each is replaced in one step.
    """
    ready = []
    for path, expected, edits in plan:
        full = os.path.join(root, path)
        with open(full, "rb") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest().upper() != expected:
            raise ValueError(f"{path} has changed since it was read")
        ready.append((full, apply_to_text(raw.decode("utf-8-sig" if raw[:3] == b"\xef\xbb\xbf" else "utf-8"), edits), raw[:3] == b"\xef\xbb\xbf"))
    moves = list(moves)
    for _, target in moves:
        if os.path.exists(os.path.join(root, target)):
            raise ValueError(f"{target} exists already")
    for full, text, marked in ready:
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(full))
        with os.fdopen(handle, "wb") as f:
            f.write((b"\xef\xbb\xbf" if marked else b"") + text.encode())
        os.replace(temporary, full)
    for source, target in moves:
        os.makedirs(os.path.dirname(os.path.join(root, target)), exist_ok=True)
        os.replace(os.path.join(root, source), os.path.join(root, target))
    return [full for full, _, _ in ready]
