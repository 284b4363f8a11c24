"""Selections over fact tables: definitions, references, calls and arguments, inheritance, tests, routes.

Every table has ``context_id`` and the columns that a function names; keys of
types and members are strings that a producer made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import utf16_order
from millrace.operators.graph import closure
from millrace.operators.spans import holding_join
from millrace.plans.session import cut_lineage, first_of_each, holds, small_side


def distinct_definitions(parts: DataFrame, symbol: str = "symbol") -> DataFrame:
    """One row for each context and symbol: its first part by path, then source order."""
    return first_of_each(parts, ["context_id", symbol], [utf16_order(F.col("path")), "start"])


def within_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the chosen document memberships."""
    return rows.join(files.select("document_id").distinct(), "document_id", "left_semi")


def in_projects(rows: DataFrame, contexts: DataFrame, condition: Column) -> DataFrame:
    return rows.join(contexts.where(holds(condition)).select("context_id"), "context_id", "left_semi")


def with_type(contexts: DataFrame, available: DataFrame, type_key: str) -> DataFrame:
    """Contexts with ``type_state``: unique, ambiguous or missing."""
    n = available.where(F.col("type_key") == type_key).groupBy("context_id").agg(F.count(F.lit(1)).alias("_n"))
    state = F.when(F.col("_n") == 1, "unique").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return contexts.join(n, "context_id", "left").withColumn("type_state", state).drop("_n")


def references_to(references: DataFrame, declarations: DataFrame) -> DataFrame:
    """References to the chosen declarations, matched across contexts by file and span."""
    key = ["decl_file", "decl_start", "decl_length"]
    return references.join(declarations.select(F.col("file_identity").alias("decl_file"), F.col("start").alias("decl_start"), F.col("length").alias("decl_length")).distinct(), key, "left_semi")


def ancestors(bases: DataFrame) -> DataFrame:
    """(type, ancestor, depth) from direct bases (type, base), a type being its own ancestor at depth 0."""
    types = bases.select("type").unionByName(bases.select(F.col("base").alias("type"))).distinct()
    return closure(bases, "type", "base", nodes=types).toDF("type", "ancestor", "depth")


def derived_from(rows: DataFrame, lineage: DataFrame, base: str, strict: bool = True, column: str = "type") -> DataFrame:
    """Rows whose type derives from a base; strictly, or the base itself too."""
    chosen = lineage.where((F.col("ancestor") == base) & (F.col("depth") >= int(strict))).select(F.col("type").alias("_type")).distinct()
    return rows.join(chosen, F.col(column) == F.col("_type"), "left_semi")


def with_attribute(rows: DataFrame, attributes: DataFrame, lineage: DataFrame, markers: Sequence[str], symbol: str = "symbol") -> DataFrame:
    """Rows that carry one of the markers or an attribute class derived from one."""
    kinds = lineage.where(F.col("ancestor").isin(*markers)).select(F.col("type").alias("attribute_type")).distinct()
    carriers = attributes.join(small_side(kinds), "attribute_type", "left_semi").select("context_id", symbol).distinct()
    return rows.join(carriers, ["context_id", symbol], "left_semi")


def test_methods(methods: DataFrame, attributes: DataFrame, lineage: DataFrame, overrides: DataFrame, markers: DataFrame) -> DataFrame:
    """Methods with a test marker of their own, or inherited through overrides if the marker allows that.

    ``markers`` has (attribute_type, inherited); ``overrides`` (context_id, symbol, overridden), one step each.
    """
    kinds = lineage.join(markers.withColumnRenamed("attribute_type", "ancestor"), "ancestor").groupBy(F.col("type").alias("attribute_type")).agg(F.bool_or("inherited").alias("inherited"))
    marked = attributes.join(small_side(kinds), "attribute_type").groupBy("context_id", "symbol").agg(F.bool_or("inherited").alias("inherited"))
    pair = lambda c: F.struct("context_id", F.col(c).alias("symbol"))
    up = closure(overrides.select(pair("symbol").alias("src"), pair("overridden").alias("dst")))
    handed = up.select(F.col("start.context_id").alias("context_id"), F.col("start.symbol").alias("symbol"), F.col("node.symbol").alias("base"))
    through = handed.join(marked.where("inherited").select("context_id", F.col("symbol").alias("base")), ["context_id", "base"]).select("context_id", "symbol")
    return methods.join(marked.select("context_id", "symbol").unionByName(through).distinct(), ["context_id", "symbol"], "left_semi")


def test_classes(classes: DataFrame, tests: DataFrame, lineage: DataFrame, overrides: DataFrame, abstract: bool | None = None) -> DataFrame:
    """Classes that declare or inherit a test that no method of theirs or of a base between overrides away.

    With ``abstract`` only those that are (``is_abstract``), or that are not.
    """
    if abstract is not None:
        classes = classes.where(holds(F.col("is_abstract")) == F.lit(abstract))
    owners = tests.select("context_id", "symbol", F.col("owner").alias("ancestor"))
    reach = lineage.join(owners, "ancestor").select("context_id", F.col("type").alias("owner"), "symbol", "depth")
    gone = lineage.join(overrides.withColumnRenamed("owner", "ancestor"), "ancestor").select("context_id", F.col("type").alias("owner"), F.col("overridden").alias("symbol")).distinct()
    left = reach.join(gone, ["context_id", "owner", "symbol"], "left_anti")
    return classes.join(left.select("context_id", F.col("owner").alias("symbol")).distinct(), ["context_id", "symbol"], "left_semi")


def calls_to(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Resolved calls of any of the members (owner, name)."""
    return calls.where(holds(F.col("is_resolved"))).join(small_side(members.select("owner", "name").distinct()), ["owner", "name"], "left_semi")


def where_argument(calls: DataFrame, arguments: DataFrame, condition: Column, or_missing: str | None = None) -> DataFrame:
    """Calls with an argument that fits, each once; with ``or_missing`` also calls that leave that parameter out."""
    fitting = calls.join(arguments.where(holds(condition)).select("call_id").distinct(), "call_id", "left_semi")
    if or_missing is None:
        return fitting
    absent = calls.join(arguments.where(F.col("parameter") == or_missing).select("call_id").distinct(), "call_id", "left_anti")
    return fitting.unionByName(absent).dropDuplicates(["call_id"])


def arguments_for(calls: DataFrame, arguments: DataFrame, *parameters: str) -> DataFrame:
    """Arguments of the chosen parameters of resolved calls."""
    return arguments.where(F.col("parameter").isin(*parameters)).join(calls.where(holds(F.col("is_resolved"))).select("call_id"), "call_id", "left_semi")


def matches_signature(owner: str | None = None, name: str | None = None, parameters: Sequence[str] | None = None, result: str | None = None) -> Column:
    """A member test on the parts that are given."""
    out = F.lit(True)
    for column, value in (("owner", owner), ("name", name), ("result", result)):
        if value is not None:
            out = out & (F.col(column) == value)
    if parameters is not None:
        out = out & (F.col("parameters") == F.array(*[F.lit(p) for p in parameters]).cast("array<string>"))
    return out


def overloads_adding(methods: DataFrame, added: str) -> DataFrame:
    """(symbol, overload, position): overloads of a method that have exactly one more parameter, of the added type."""
    other = methods.select("context_id", "owner", "name", F.col("symbol").alias("overload"), F.col("parameters").alias("more"))
    pairs = methods.join(other, ["context_id", "owner", "name"]).where(F.size("more") == F.size("parameters") + 1)
    at = pairs.withColumn("position", F.explode(F.sequence(F.lit(0), F.size("parameters"))))
    rest = F.filter("more", lambda _, i: i != F.col("position"))
    hit = at.where((rest == F.col("parameters")) & (F.element_at("more", F.col("position") + 1) == added))
    return hit.groupBy("context_id", "symbol", "overload").agg(F.min("position").alias("position"))


def values_in_scope(uses: DataFrame, values: DataFrame, type_key: str | None = None) -> DataFrame:
    """For each use (document_id, use_id, at) the values whose scope holds it, the nearest scope first, as ``rank``."""
    declared = (values if type_key is None else values.where(F.col("type_key") == type_key)).where("declared_at is not null and scope_start is not null")
    held = holding_join(uses, declared, ["document_id"], "at", F.greatest("scope_start", "declared_at"), F.col("scope_end"))
    order = Window.partitionBy("use_id").orderBy((F.col("scope_end") - F.col("scope_start")).asc(), F.col("declared_at").desc(), "name")
    return held.withColumn("rank", F.row_number().over(order))


def implementation_views(views: DataFrame, implementations: DataFrame) -> DataFrame:
    """Views with their implementations; a view without one keeps a row with nulls."""
    return views.join(implementations, ["interface", "view_id"], "left")


def property_views(reached: DataFrame, properties: DataFrame, lineage: DataFrame) -> DataFrame:
    """Properties (context_id, project, path, start, owner, name) of the reached types (seed, type), one view each.

    The nearest declaration hides those further up; the seeds that reach a view are
    merged.  ``property_view_order`` sorts them.
    """
    wide = reached.join(lineage, "type").join(properties.withColumnRenamed("owner", "ancestor"), "ancestor")
    own = first_of_each(wide, ["seed", "type", "name"], ["depth", "ancestor"])
    return own.groupBy("path", "project", "start", F.col("ancestor").alias("owner"), "name", "type").agg(F.array_sort(F.collect_set("seed")).alias("reached_from"))


def property_view_order(views: DataFrame) -> DataFrame:
    return views.orderBy(utf16_order(F.col("path")), utf16_order(F.col("project")), "start", utf16_order(F.col("owner")), utf16_order(F.col("type")), "name")


def resolve_keys(keys: DataFrame, members: DataFrame) -> DataFrame:
    """Bound path of each key (key_id, type, segments); null where a segment is missing or ambiguous.

    ``members`` has (owner, name, member, result): each step follows the one member of that name.
    """
    one = members.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("member").alias("_member"), F.min("result").alias("_result")).where("_n = 1")
    longest = keys.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    state = keys.select("key_id", "segments", F.col("type").alias("at"), F.array().cast("array<string>").alias("path"), F.lit(True).alias("ok"))
    for i in range(longest):
        step = state.join(one, (F.col("at") == F.col("owner")) & (F.get("segments", F.lit(i)) == F.col("name")), "left")
        live = F.size("segments") > i
        state = step.select("key_id", "segments", F.when(live, F.col("_result")).otherwise(F.col("at")).alias("at"), F.when(live & F.col("_member").isNotNull(), F.concat("path", F.array("_member"))).otherwise(F.col("path")).alias("path"), (F.col("ok") & (~live | F.col("_member").isNotNull())).alias("ok"))
    return state.select("key_id", F.when(F.col("ok"), F.col("path")).alias("path"))


def follow_parents(rows: DataFrame, parents: DataFrame, skip: Column) -> DataFrame:
    """(id, outer): each node's nearest ancestor-or-self that is not skipped (conversions, parentheses); null if there is none.

    Links over skipped nodes double in length each round: a chain of any depth takes
    the logarithm of it.
    """
    links = cut_lineage(parents.select(F.col("id").alias("_id"), "parent", holds(skip).alias("_skip")))
    jump = cut_lineage(links.select("_id", F.when(F.col("_skip"), F.col("parent")).otherwise(F.col("_id")).alias("_to"), "_skip"))
    for _ in range(64):  # chains of up to 2**64 links
        ahead = jump.select(F.col("_id").alias("_mid"), F.col("_to").alias("_then"), F.col("_skip").alias("_more"))
        open_ = jump.join(ahead, jump["_to"] == ahead["_mid"], "left")
        moved = holds(F.col("_more")) & F.col("_skip") & (F.col("_to") != F.col("_id"))  # the goal is skipped too
        after = cut_lineage(open_.select("_id", F.when(moved, F.col("_then")).otherwise(F.col("_to")).alias("_to"), "_skip", moved.alias("_moved")))
        jump = after.drop("_moved")
        if after.where("_moved").isEmpty():
            break
    whole = links.where("not _skip").select(F.col("_id").alias("outer"))
    known = jump.join(whole, F.col("_to") == F.col("outer")).select("_id", "outer")
    return rows.select("id").join(known, F.col("id") == F.col("_id"), "left").select("id", "outer")


def routes(mappings: DataFrame, groups: DataFrame, hops: int = 10) -> DataFrame:
    """(route_id, route): constant templates behind the prefixes of their groups, over at most ``hops`` of them.

    ``groups`` has (group_id, parent_group, prefix); a prefix or template that is not constant makes the route null,
    and so does a longer chain: it can't be read.
    """
    side = groups.select(F.col("group_id").alias("_group"), F.col("parent_group").alias("_parent"), F.col("prefix").alias("_prefix"))
    state = mappings.select("route_id", F.col("group_id").alias("at"), F.col("template").alias("route"), F.col("template").isNotNull().alias("ok"))
    for _ in range(hops):
        step = state.join(side, state["at"] == side["_group"], "left")
        known = F.col("_group").isNotNull()
        state = step.select("route_id", F.when(known, F.col("_parent")).alias("at"), F.when(known, F.concat("_prefix", "route")).otherwise(F.col("route")).alias("route"), (F.col("ok") & (~known | F.col("_prefix").isNotNull()) & (known | F.col("at").isNull())).alias("ok"))
    return state.select("route_id", F.when(F.col("ok") & F.col("at").isNull(), F.col("route")).alias("route"))


def unwrap_task(type_key: Column, task: str = "Task", generic: str = "Task<") -> Column:
    """The result of a task type; null for a task without one; other types as they are."""
    return F.when(type_key == task, None).when(type_key.startswith(generic), F.substring(type_key, F.lit(len(generic) + 1), F.length(type_key) - len(generic) - 1)).otherwise(type_key)
