"""Filters and lookups over declarations, statements, handlers and their contexts.

Filters take rows and give rows; predicates are columns.  Types and members are keys
that a producer made; ``lineage`` is ``facts.ancestors``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import in_namespace, matches_glob, utf16_order
from millrace.operators.spans import containment_join
from millrace.plans.session import first_of_each, holds, small_side


def with_modifier(rows: DataFrame, modifier: str) -> DataFrame:
    """Declarations that write a modifier."""
    return rows.where(holds(F.array_contains("modifiers", modifier)))


def with_accessibility(rows: DataFrame, *kinds: str) -> DataFrame:
    """Declarations of an effective accessibility, written or not."""
    return rows.where(F.col("accessibility").isin(*kinds))


# Places: columns of rows that are joined with their context and document.


def is_in_project(glob: str, name: str = "project_name") -> Column:
    return matches_glob(F.col(name), glob)


def is_in_folder(folder: str, project_path: str = "project_path", path: str = "path") -> Column:
    """Whether a file lies below a folder of that name within its project, at any depth; a file outside of it doesn't."""
    slash = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    home = F.regexp_replace(slash(project_path), "[^/]*$", "")
    relative = F.when((home == "") | F.startswith(slash(path), home), F.substr(slash(path), F.length(home) + 1)).otherwise(F.lit(""))
    return matches_glob(relative, f"**/{folder.strip('/')}/**")


def is_in_namespace(pattern: str, namespace: str = "namespace") -> Column:
    return in_namespace(F.col(namespace), pattern)


def is_in_type(*types: str, column: str = "containing_type") -> Column:
    return holds(F.col(column).isin(*types))


def in_files_named(rows: DataFrame, glob: str, path: str = "path") -> DataFrame:
    """Rows of files whose own name fits a glob."""
    return rows.where(matches_glob(F.regexp_extract(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "[^/]*$", 0), glob))


def in_test_projects(rows: DataFrame, contexts: DataFrame, test: bool = True) -> DataFrame:
    return rows.join(contexts.where(holds(F.col("is_test_project")) == F.lit(test)).select("context_id"), "context_id", "left_semi")


def in_projects_with_type(rows: DataFrame, available: DataFrame, type_key: str) -> DataFrame:
    """Rows of contexts in which a type is known."""
    return rows.join(available.where(F.col("type_key") == type_key).select("context_id").distinct(), "context_id", "left_semi")


def references_package(contexts: DataFrame, packages: DataFrame, package: str) -> DataFrame:
    """Contexts that reference a package, whatever the case of its name."""
    return contexts.join(packages.where(F.lower("id") == package.lower()).select("context_id").distinct(), "context_id", "left_semi")


# Style


def top_level(variables: DataFrame) -> DataFrame:
    return variables.where(holds(F.col("is_top_level")))


def with_explicit_type(variables: DataFrame) -> DataFrame:
    return variables.where(holds(F.col("has_explicit_type")))


def with_initializer(variables: DataFrame) -> DataFrame:
    return variables.where(holds(F.col("has_initializer")))


def with_single_read(variables: DataFrame) -> DataFrame:
    return variables.where(F.col("reads") == 1)


def where_var_preserves_type(variables: DataFrame) -> DataFrame:
    return variables.where(holds(F.col("is_var_safe")))


def with_else(statements: DataFrame) -> DataFrame:
    return statements.where(holds(F.col("has_else")))


def branches(statements: DataFrame) -> DataFrame:
    """A row for each branch of an if statement, then before else; ``branch`` says which."""
    both = F.when(holds(F.col("has_else")), F.array(F.lit("then"), F.lit("else"))).otherwise(F.array(F.lit("then")))
    return statements.withColumn("branch", F.explode(both))


def without_braces(statements: DataFrame) -> DataFrame:
    return statements.where(~holds(F.col("has_braces")))


#: Shapes of a body.
MISSING, EMPTY, NON_EMPTY, EXPRESSION = "Missing", "EmptyBlock", "NonEmptyBlock", "Expression"


def body_shape(body_kind: Column, statements: Column) -> Column:
    """Missing, EmptyBlock, NonEmptyBlock or Expression, from how a body is written and how many statements it has."""
    return F.when(body_kind.isNull(), MISSING).when(body_kind == "expression", EXPRESSION).when(statements > 0, NON_EMPTY).otherwise(EMPTY)


def where_body(members: DataFrame, shape: str, body_kind: str = "body_kind", statements: str = "n_statements") -> DataFrame:
    return members.where(body_shape(F.col(body_kind), F.col(statements)) == shape)


def checks(conditions: DataFrame, patterns: DataFrame) -> DataFrame:
    """Conditions of bodies that one of the configured patterns recognises, with the pattern's columns."""
    return conditions.join(small_side(patterns), "pattern")


def containing_types(members: DataFrame) -> DataFrame:
    """(context_id, owner): the types that declare the members, each once in a context."""
    return members.where("owner is not null").select("context_id", "owner").distinct()


# Symbols


def has_attribute(rows: DataFrame, attributes: DataFrame, *markers: str) -> DataFrame:
    """Rows that carry one of the very attributes."""
    return rows.join(attributes.where(F.col("attribute_type").isin(*markers)).select("context_id", "symbol").distinct(), ["context_id", "symbol"], "left_semi")


def is_or_derives_from(rows: DataFrame, lineage: DataFrame, base: str, column: str = "type_key", strict: bool = False) -> DataFrame:
    """Rows whose type is a base or derives from it; strictly, only derives."""
    chosen = lineage.where((F.col("ancestor") == base) & (F.col("depth") >= int(strict))).select(F.col("type").alias("_type")).distinct()
    return rows.join(chosen, F.col(column) == F.col("_type"), "left_semi")


def implementing(rows: DataFrame, bases: DataFrame, lineage: DataFrame, interface: str, column: str = "type_key") -> DataFrame:
    """Rows whose type implements an interface: through a base, or an interface that extends it."""
    kinds = bases.where(holds(F.col("is_interface"))).select(F.col("base").alias("ancestor")).distinct()
    chosen = lineage.where((F.col("ancestor") == interface) & (F.col("depth") >= 1)).join(kinds, "ancestor", "left_semi").select(F.col("type").alias("_type")).distinct()
    return rows.join(chosen, F.col(column) == F.col("_type"), "left_semi")


def implements_or_overrides(rows: DataFrame, overrides: DataFrame, members: Sequence[str]) -> DataFrame:
    """Members that implement or override one of the given ones, over any distance."""
    chosen = overrides.where(F.col("overridden").isin(*members)).select("context_id", "symbol").distinct()
    return rows.join(chosen, ["context_id", "symbol"], "left_semi")


def declared_in_or_above(rows: DataFrame, containers: DataFrame, container: str, column: str = "symbol") -> DataFrame:
    """Rows declared in a container (symbol, ancestor), or in one that holds it."""
    chosen = containers.where(F.col("symbol") == container).select(F.col("ancestor").alias("_above"))
    return rows.join(chosen, F.col(column) == F.col("_above"), "left_semi")


def is_event_handler(parameters: Column, result: Column, arguments: str = "EventArgs") -> Column:
    """Whether a method takes a sender and event arguments and returns nothing."""
    return (result == "void") & (F.size(parameters) == 2) & (F.element_at(parameters, 1) == "object") & F.element_at(parameters, 2).endswith(arguments)


def overriding(members: DataFrame, overrides: DataFrame, direct: bool = False) -> DataFrame:
    """(context_id, symbol, overridden, distance): what each member overrides; only the nearest with ``direct``."""
    held = overrides.where("distance = 1") if direct else overrides
    return held.join(members.select("context_id", "symbol").distinct(), ["context_id", "symbol"], "left_semi")


def declared_in_project(reached: DataFrame, declarations: DataFrame, contexts: DataFrame, project: str) -> DataFrame:
    """Declarations (decl_file, decl_start) that were reached and lie in the project of that very name."""
    own = declarations.join(contexts.where(F.col("name") == project).select("context_id"), "context_id", "left_semi")
    return own.join(reached.select("decl_file", "decl_start").distinct(), ["decl_file", "decl_start"], "left_semi")


def files_of(symbols: DataFrame, parts: DataFrame) -> DataFrame:
    """(context_id, document_id): the files that declare parts of the symbols."""
    return parts.join(symbols.select("context_id", "symbol").distinct(), ["context_id", "symbol"], "left_semi").select("context_id", "document_id").distinct()


def callers_of(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(context_id, caller): functions with a resolved call of one of the members (target)."""
    return calls.where(holds(F.col("is_resolved"))).join(small_side(members.select("target").distinct()), "target", "left_semi").where("caller is not null").select("context_id", "caller").distinct()


def calls_from(calls: DataFrame, callers: DataFrame) -> DataFrame:
    return calls.join(callers.select("context_id", "caller").distinct(), ["context_id", "caller"], "left_semi")


# Handlers


def catches_any(catches: DataFrame) -> Column:
    """Whether a clause catches every exception; a filter is not looked at."""
    return ~holds(F.col("has_declaration")) | holds(F.col("exception_type").isin("System.Exception", "System.Object"))


def catching(catches: DataFrame, exception_type: str) -> DataFrame:
    """Clauses that declare the very exception type."""
    return catches.where(F.col("exception_type") == exception_type)


def handler_of(rows: DataFrame, regions: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` (document_id, start, end) with ``is_guarded`` and ``unguarded_handler`` (None, Catch or Finally).

    ``regions`` has (document_id, o_start, o_end, kind, catches_any): try blocks, catch and
    finally clauses, and functions.  The nearest function ends the search: a row is
    guarded if a try block nearer than that has a clause that catches any exception;
    it runs in an unguarded handler if a catch or finally clause comes nearer than both.
    """
    inside = containment_join(rows, regions.where("kind in ('function', 'catch', 'finally') or kind = 'try' and catches_any"), ["document_id"])
    size = F.col("o_end") - F.col("o_start")
    near = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), size))
    own = inside.groupBy(*key).agg(near("function").alias("_function"), near("try").alias("_try"), near("catch").alias("_catch"), near("finally").alias("_finally"))
    far = F.lit(1 << 62)
    a, b, c, d = (F.coalesce(F.col(n), far) for n in ("_function", "_try", "_catch", "_finally"))
    handler = F.when((c < a) & (c < b) & (c < d), "Catch").when((d < a) & (d < b), "Finally").otherwise("None")
    joined = rows.join(own, list(key), "left")
    return joined.withColumns({"is_guarded": b < a, "unguarded_handler": handler}).drop("_function", "_try", "_catch", "_finally")


# Scopes


def within_scopes(rows: DataFrame, scopes: DataFrame, identity: Sequence[str], nested: DataFrame | None = None, document: Sequence[str] = ("context_id", "document_id")) -> DataFrame:
    """Rows (start, length) that lie in one of the scopes (o_start, o_end), each once although scopes overlap.

    ``nested`` has the functions (o_start, o_end) within: rows of a function that a
    scope holds, and that isn't the scope itself, belong to it and not to the scope.
    """
    spans = rows.withColumn("end", F.col("start") + F.col("length"))
    found = containment_join(spans, scopes.select(*document, "o_start", "o_end"), document)
    if nested is not None:
        inner = nested.select(*document, F.col("o_start").alias("n_start"), F.col("o_end").alias("n_end"))
        between = containment_join(found.withColumnsRenamed({"o_start": "s_start", "o_end": "s_end"}), inner.withColumnsRenamed({"n_start": "o_start", "n_end": "o_end"}), document)
        lost = between.where("o_start >= s_start and o_end <= s_end and (o_start > s_start or o_end < s_end)").select(*identity, F.col("s_start").alias("o_start"), F.col("s_end").alias("o_end")).distinct()
        found = found.join(lost, [*identity, "o_start", "o_end"], "left_anti")
    return rows.join(found.select(*identity).distinct(), list(identity), "left_semi")


def explanatory_comments(rows: DataFrame, comments: DataFrame, document: Sequence[str] = ("document_id",), marker: str = "rule-allow") -> DataFrame:
    """``rows`` (line, owner_line) with ``explanation``: the ordinary comment on the line, else right above it, else right above its owner's first line.

    ``comments`` has (line, last_line, is_whole_line, kind, text, start); documentation and
    allowances don't explain.
    """
    plain = comments.where((F.col("kind") == "comment") & ~F.ltrim(F.regexp_replace("text", "^(//|/\\*)", "")).startswith(marker))
    on = plain.select(*document, F.explode(F.sequence("line", "last_line")).alias("_line"), F.struct("start", "text").alias("_on"))
    on = on.groupBy(*document, "_line").agg(F.min("_on").alias("_on"))
    above = plain.where("is_whole_line").select(*document, (F.col("last_line") + 1).alias("_line"), F.struct("start", "text").alias("_above")).groupBy(*document, "_line").agg(F.min("_above").alias("_above"))
    joined = rows.withColumn("_line", F.col("line")).join(on, [*document, "_line"], "left").join(above, [*document, "_line"], "left").drop("_line")
    higher = above.withColumnRenamed("_above", "_owner")
    joined = joined.withColumn("_line", F.when(F.col("owner_line") != F.col("line"), F.col("owner_line"))).join(higher, [*document, "_line"], "left").drop("_line")
    return joined.withColumn("explanation", F.coalesce("_on.text", "_above.text", "_owner.text")).drop("_on", "_above", "_owner")


def api_set(*members: tuple[str, str]) -> list[tuple[str, str]]:
    """Members (owner, name), each once, in order."""
    return list(dict.fromkeys(members))


def union_api(*sets: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return api_set(*(m for s in sets for m in s))


def first_parts(parts: DataFrame) -> DataFrame:
    """The first part of each symbol by path and place."""
    return first_of_each(parts, ["context_id", "symbol"], [utf16_order(F.col("path")), "start"])
