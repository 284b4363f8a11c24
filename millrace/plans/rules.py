"""Rules over selections: clauses, findings, eligibility, aggregation, exit codes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import length_prefixed, matches_glob, utf16_order
from millrace.plans.conditions import Condition
from millrace.plans.session import holds

VIOLATION, REVIEW = "Violation", "Review"
#: Where a finding lies, and what it says.
PLACE = ("context_id", "document_id", "file_identity", "path", "start", "length")
FINDING = ("rule_id", *PLACE, "message", "disposition", "evidence", "fix_complexity", "batch_id", "ordinal")
#: What a report's scope reads, where the rows have it.
SCOPE = ("is_generated", "is_analysis_target", "project_name")
#: Rules about allowances themselves.
UNUSED_ALLOWANCE, INVALID_ALLOWANCE = "engine-unused-allowance", "engine-invalid-allowance"


@dataclass(frozen=True)
class Clause:
    """Candidates of a rule and how they become findings.

    ``rows`` has the PLACE columns, ``ordinal`` (query order) and whatever the
    conditions read.
    """

    rows: DataFrame
    message: str | Column
    disposition: str | Column = VIOLATION
    fix_complexity: str | None = None
    evidence: Column | None = None
    batch_id: Column | None = None
    place: dict[str, Column] = field(default_factory=dict)
    once_per: tuple[str, ...] = ()

    def forbid(self) -> Clause:
        """Report every row."""
        return self

    def require(self, condition: Condition | Column) -> Clause:
        """Report the rows that fail the condition; null fails."""
        test = condition.test if isinstance(condition, Condition) else condition
        return replace(self, rows=self.rows.where(~holds(test)))

    def except_when(self, condition: Condition | Column) -> Clause:
        test = condition.test if isinstance(condition, Condition) else condition
        return replace(self, rows=self.rows.where(~holds(test)))

    def report_at(self, **place: Column) -> Clause:
        """Findings at another place; a null keeps the row's own."""
        return replace(self, place=self.place | place)

    def report_once_per(self, *key: str) -> Clause:
        """One finding for each context and key: a violation before a review, then the first in source order."""
        return replace(self, once_per=key)

    def findings(self, rule_id: str) -> DataFrame:
        text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        columns = {
            "rule_id": F.lit(rule_id), "message": text(self.message), "disposition": text(self.disposition),
            "evidence": text(self.evidence), "fix_complexity": text(self.fix_complexity), "batch_id": text(self.batch_id),
        }
        moved = {c: F.coalesce(v, F.col(c)) for c, v in self.place.items()}
        keep = [F.col(k).alias(f"_{k}") for k in self.once_per]
        rows = self.rows.select(*[(columns | moved).get(c, F.col(c)).alias(c) for c in FINDING], *keep, *[F.col(c) for c in SCOPE if c in self.rows.columns])
        if self.once_per:
            order = Window.partitionBy("context_id", *[f"_{k}" for k in self.once_per]).orderBy(F.col("disposition") != VIOLATION, utf16_order(F.col("path")), "start", "ordinal")
            rows = rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", *[f"_{k}" for k in self.once_per])
        return rows

    def with_fix(self, batch_id: Column, complexity: str | None = None) -> Clause:
        """The clause with the batch that a producer of edits proposes for each row."""
        return replace(self, batch_id=batch_id, fix_complexity=complexity or self.fix_complexity)


class RuleCatalog:
    """Rules with unique ids, each with clauses; evaluates to findings."""

    def __init__(self, reserved: str = "engine-"):
        self.reserved = reserved
        self.clauses: dict[str, list[Clause]] = {}
        self.needs_evidence: set[str] = set()

    def rule(self, rule_id: str, *clauses: Clause, needs_evidence: bool = False) -> RuleCatalog:
        if not rule_id or "\n" in rule_id or "\r" in rule_id:
            raise ValueError("a rule id is one line")
        if rule_id.startswith(self.reserved):
            raise ValueError(f"rule ids that begin with {self.reserved} are reserved")
        if rule_id in self.clauses:
            raise ValueError(f"{rule_id} is there already")
        for c in clauses:
            if isinstance(c.message, str) and ("\n" in c.message or not c.message):
                raise ValueError("a message is one line")
        self.clauses[rule_id] = list(clauses)
        if needs_evidence:
            self.needs_evidence.add(rule_id)
        return self

    def selected(self, select: Sequence[str] = (), ignore: Sequence[str] = (), skip_evidence: bool = False) -> list[str]:
        """Ids of the rules to run: ignoring wins over selecting; an unknown id is an error."""
        for name in (*select, *ignore):
            if name not in self.clauses:
                raise ValueError(f"no rule is called {name}")
        ids = [r for r in self.clauses if (not select or r in select) and r not in ignore]
        return [r for r in ids if not (skip_evidence and r in self.needs_evidence)]

    def evaluate(self, select: Sequence[str] = (), ignore: Sequence[str] = (), exclude_projects: Sequence[str] = (), exclude_paths: Sequence[str] = (), skip_evidence: bool = False) -> DataFrame:
        """Findings of the selected rules.

        A finding counts where it is reported, not where its candidate lies:
        generated places, projects whose name and files whose path a glob excludes
        drop out afterwards.
        """
        frames = []
        for rule_id in self.selected(select, ignore, skip_evidence):
            if not self.clauses[rule_id]:
                raise ValueError(f"{rule_id} has no clause")
            for clause in self.clauses[rule_id]:
                rows = clause.findings(rule_id)
                if "is_generated" in rows.columns:
                    rows = rows.where(~holds(F.col("is_generated")))
                if "is_analysis_target" in rows.columns:
                    rows = rows.where(F.coalesce("is_analysis_target", F.lit(True)))
                if "project_name" in rows.columns:
                    for glob in exclude_projects:
                        rows = rows.where(~holds(matches_glob(F.col("project_name"), glob)))
                for glob in exclude_paths:
                    rows = rows.where(~holds(matches_glob(F.col("path"), glob)))
                frames.append(rows.select(*FINDING))
        if not frames:
            raise ValueError("no rule is selected")
        return reduce(DataFrame.unionByName, frames)


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule_id", utf16_order(F.col("path")), "start", "ordinal")


def edit_sets(edits: DataFrame) -> DataFrame:
    """(batch_id, edit_set): a name for what a batch changes, the same for batches with the same edits."""
    part = length_prefixed(F.col("file_identity"), F.col("start").cast("string"), F.col("length").cast("string"), F.col("replacement"))
    one = F.struct("file_identity", "start", "length", part.alias("part"))
    return edits.groupBy("batch_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(one)), lambda e: e["part"]), ""), 256).alias("edit_set"))


DIFFERENT = "the contexts that report this propose different fixes"
UNPROVED = "the fix was not validated in every context that has its files"


def aggregate_findings(findings: DataFrame, safe: DataFrame | None = None) -> DataFrame:
    """One row for each rule, file, span and message over all contexts.

    Review only if all are; evidence is distinct, sorted and joined; text and
    complexity are the first row's.  ``safe`` has (batch_id, edit_set) of the batches
    that may be applied: the first row's batch counts if all rows have one and all
    change the same; without ``safe``, batches agree by their ids.  ``fix_withheld``
    says why a proposed fix does not count; ``outcome_remediation`` joins what to do,
    where a row says so.
    """
    if safe is None:
        marked = findings.withColumn("_set", F.col("batch_id"))
    else:
        side = safe.select(F.col("batch_id").alias("_batch"), F.col("edit_set").alias("_set"))
        marked = findings.join(side, F.col("batch_id") == F.col("_batch"), "left").drop("_batch")
    order = F.struct("context_id", "ordinal")
    first = lambda c: F.min_by(c, order)
    agreed = F.bool_and(F.col("_set").isNotNull()) & (F.count_distinct("_set") == 1)
    withheld = F.array_sort(F.collect_set("fix_withheld")) if "fix_withheld" in findings.columns else F.array().cast("array<string>")
    reason = F.when(F.bool_or(F.col("batch_id").isNotNull()), F.when(F.bool_or(F.col("_set").isNull()), UNPROVED).otherwise(DIFFERENT))
    more = []
    if "outcome_remediation" in findings.columns:
        done = F.array_join(F.array_sort(F.collect_set(F.coalesce("outcome_remediation", "message"))), "; ")
        more = [F.when(F.bool_or(F.col("outcome_remediation").isNotNull()), done).alias("outcome_remediation")]
    return marked.groupBy("rule_id", "file_identity", "start", "length", "message").agg(
        F.when(F.bool_and(F.col("disposition") == REVIEW), REVIEW).otherwise(VIOLATION).alias("disposition"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("evidence")), "; "), F.lit("")).alias("evidence"),
        first(F.col("path")).alias("path"),
        first(F.col("fix_complexity")).alias("fix_complexity"),
        F.when(agreed, first(F.col("batch_id"))).alias("batch_id"),
        F.when(~agreed, F.nullif(F.array_join(F.array_compact(F.concat(withheld, F.array(reason))), "; "), F.lit(""))).alias("fix_withheld"),
        F.count_distinct("context_id").alias("contexts"),
        *more,
    )


def ordered_aggregates(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rule_id", utf16_order(F.col("path")), "start", "length")


def status(findings: DataFrame, contexts: DataFrame) -> DataFrame:
    """(project_path, fix_complexity, n): places with a violation in each project, by the first finding's complexity; none sorts last."""
    places = findings.where(F.col("disposition") == VIOLATION).join(contexts.select("context_id", "project_path"), "context_id")
    distinct = places.groupBy("project_path", "rule_id", "file_identity", "start", "length", "message").agg(F.min_by("fix_complexity", F.struct("context_id", "ordinal")).alias("fix_complexity"))
    return distinct.groupBy("project_path", "fix_complexity").agg(F.count(F.lit(1)).alias("n"))


def allowance_findings(allowances: DataFrame, used: DataFrame, selected: Sequence[str], skipped: Sequence[str] = ()) -> DataFrame:
    """Findings about allowances (PLACE columns, rules, problem, is_conditional): malformed ones, and rules that one names in vain.

    ``used`` has (file_identity, start, rule_id) of the allowances that any context
    used; a rule that isn't selected, or was skipped, is neither used nor unused.
    """
    judged = [r for r in selected if r not in skipped]
    invalid = allowances.where("problem is not null").select(*PLACE, F.lit(INVALID_ALLOWANCE).alias("rule_id"), F.col("problem").alias("evidence"))
    named = allowances.where("problem is null").select(*PLACE, "is_conditional", F.posexplode(F.array_distinct("rules")).alias("_at", "_rule")).where(F.col("_rule").isin(judged))
    side = used.select(F.col("file_identity").alias("_file"), F.col("start").alias("_start"), F.col("rule_id").alias("_used")).distinct()
    idle = named.join(side, (F.col("file_identity") == F.col("_file")) & (F.col("start") == F.col("_start")) & (F.col("_rule") == F.col("_used")), "left_anti")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_rule"))), lambda x: x["_rule"]), ", ")
    other = F.when(F.col("is_conditional"), F.lit("; another build configuration may use it")).otherwise(F.lit(""))
    unused = idle.groupBy(*PLACE, "is_conditional").agg(listed.alias("_listed")).select(*PLACE, F.lit(UNUSED_ALLOWANCE).alias("rule_id"), F.concat("_listed", other).alias("evidence"))
    return invalid.unionByName(unused)


def with_complexity(findings: DataFrame, *kinds: str) -> DataFrame:
    return findings.where(F.lower(F.coalesce("fix_complexity", F.lit("unspecified"))).isin([k.lower() for k in kinds]))


def problems(findings: DataFrame, contexts: DataFrame, documents: DataFrame, edits: DataFrame | None = None, reported: DataFrame | None = None) -> DataFrame:
    """(problem, rule_id, path): what is wrong with a response; empty if nothing is.

    ``reported`` has the context_id of every context that the response answers for.
    """
    say = lambda rows, text: rows.select(F.lit(text).alias("problem"), "rule_id", "path")
    bare = lambda rows, text: rows.select(F.lit(text).alias("problem"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("path"))
    sized = documents.select("document_id", (F.octet_length(F.encode("text", "UTF-16BE")) / 2).alias("_size"), F.col("context_id").alias("_context"))
    placed = findings.join(sized, "document_id", "left")
    out = [
        say(findings.join(contexts.select("context_id"), "context_id", "left_anti"), "unknown context"),
        say(placed.where("_size is null"), "unknown document"),
        say(placed.where("_context <> context_id"), "the document belongs to another context"),
        say(placed.where("start < 0 or length < 0 or start + length > _size"), "span outside the text"),
        say(findings.where(F.col("message").rlike("[\r\n]") | (F.trim("message") == "")), "a message is one line"),
        say(findings.where(F.col("evidence").rlike("[\r\n]")), "evidence is one line"),
        say(findings.where(F.col("rule_id").rlike("[\r\n]") | (F.trim("rule_id") == "")), "a rule id is one line"),
        say(findings.where(~F.col("disposition").isin(VIOLATION, REVIEW)), "unknown disposition"),
        say(findings.where(~F.lower("fix_complexity").isin("trivial", "local", "complex", "architectural")), "unknown complexity"),
    ]
    if reported is not None:
        out.append(bare(contexts.join(reported, "context_id", "left_anti"), "a context is missing from the response"))
        out.append(bare(reported.groupBy("context_id").count().where("count > 1"), "a context answers twice"))
    if edits is not None:
        batches = edits.select("batch_id").distinct()
        out.append(say(findings.where("batch_id is not null").join(batches, "batch_id", "left_anti"), "unknown batch"))
        files = documents.select("file_identity", (F.octet_length(F.encode("text", "UTF-16BE")) / 2).alias("_size")).distinct()
        wrong = edits.join(files, "file_identity", "left").where("_size is null or start < 0 or length < 0 or start + length > _size")
        out.append(bare(wrong, "an edit lies outside its file"))
    return reduce(DataFrame.unionByName, out)


def exit_code(aggregates: DataFrame) -> int:
    """1 if there is a violation, 0 if there are reviews only or nothing."""
    return int(not aggregates.where(F.col("disposition") == VIOLATION).isEmpty())


def rule_ids(text: str) -> list[str]:
    return [x for x in re.split(r"[,\s]+", text) if x]
