"""Filters over calls, arguments, creations, references and expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import matches_glob
from millrace.operators.spans import containment_join
from millrace.plans.session import holds, small_side

# Calls


def to_methods_named(calls: DataFrame, *names: str) -> DataFrame:
    return calls.where(F.col("name").isin(*names) & holds(F.col("is_resolved")))


def to_methods_matching(calls: DataFrame, glob: str) -> DataFrame:
    return calls.where(matches_glob(F.col("name"), glob) & holds(F.col("is_resolved")))


def to_methods_declared_on(calls: DataFrame, *types: str, lineage: DataFrame | None = None) -> DataFrame:
    """Resolved calls of methods that one of the types declares; with ``lineage`` also types derived from one."""
    resolved = calls.where(holds(F.col("is_resolved")))
    if lineage is None:
        return resolved.where(F.col("owner").isin(*types))
    owners = lineage.where(F.col("ancestor").isin(*types)).select(F.col("type").alias("owner")).distinct()
    return resolved.join(small_side(owners), "owner", "left_semi")


def on_receiver_of_type(calls: DataFrame, lineage: DataFrame, *types: str) -> DataFrame:
    """Calls whose receiver is of one of the types or of one derived from it."""
    kinds = lineage.where(F.col("ancestor").isin(*types)).select(F.col("type").alias("receiver_type")).distinct()
    return calls.join(small_side(kinds), "receiver_type", "left_semi")


def where_receiver(calls: DataFrame, expressions: DataFrame, condition: Column) -> DataFrame:
    """Calls whose receiver, an expression (call_id), fits."""
    return calls.join(expressions.where(holds(condition)).select("call_id").distinct(), "call_id", "left_semi")


def outside_expression_trees(calls: DataFrame) -> DataFrame:
    return calls.where(~holds(F.col("in_expression_tree")))


def outside_nameof(rows: DataFrame) -> DataFrame:
    return rows.where(~holds(F.col("in_nameof")))


def where_any_argument(calls: DataFrame, arguments: DataFrame, condition: Column) -> DataFrame:
    """Calls with at least one argument that fits, each once."""
    return calls.join(arguments.where(holds(condition)).select("call_id").distinct(), "call_id", "left_semi")


def arguments_of_types(calls: DataFrame, arguments: DataFrame, *types: str) -> DataFrame:
    """Arguments of resolved calls whose parameter has one of the types."""
    return arguments.where(F.col("parameter_type").isin(*types)).join(calls.where(holds(F.col("is_resolved"))).select("call_id"), "call_id", "left_semi")


def source_values(arguments: DataFrame) -> DataFrame:
    """Arguments that are written in the source, with their spans."""
    return arguments.where("value_start is not null")


def argument_expressions(calls: DataFrame, arguments: DataFrame, expressions: DataFrame) -> DataFrame:
    """The expressions that are the arguments of calls, with call_id, ordinal and parameter."""
    written = source_values(arguments).join(calls.select("call_id", "context_id", "document_id"), "call_id")
    spans = written.select("context_id", "document_id", F.col("value_start").alias("start"), F.col("value_length").alias("length"), "call_id", "ordinal", "parameter")
    return expressions.join(spans, ["context_id", "document_id", "start", "length"])


def passed_as(references: DataFrame, calls: DataFrame, arguments: DataFrame, *parameters: str) -> DataFrame:
    """References (outer_start, outer_length: their span without conversions) that are an argument of their own."""
    spans = source_values(arguments).where(F.col("parameter").isin(*parameters)).join(calls.select("call_id", "context_id", "document_id"), "call_id")
    keys = spans.select("context_id", "document_id", F.col("value_start").alias("outer_start"), F.col("value_length").alias("outer_length")).distinct()
    return references.join(keys, ["context_id", "document_id", "outer_start", "outer_length"], "left_semi")


def as_argument(references: DataFrame, calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """References with the call, ordinal and parameter that they are an argument of, null where they are none."""
    spans = source_values(arguments).join(calls.select("call_id", "context_id", "document_id"), "call_id")
    keys = spans.select("context_id", "document_id", F.col("value_start").alias("outer_start"), F.col("value_length").alias("outer_length"), "call_id", "ordinal", "parameter")
    return references.join(keys, ["context_id", "document_id", "outer_start", "outer_length"], "left")


def bodies_calling(bodies: DataFrame, calls: DataFrame, owner: str, name: str, condition: Column | None = None) -> DataFrame:
    """Bodies (body_id, context_id, document_id, o_start, o_end) with a resolved call of a member that fits."""
    fitting = calls.where(holds(F.col("is_resolved")) & (F.col("owner") == owner) & (F.col("name") == name))
    if condition is not None:
        fitting = fitting.where(holds(condition))
    spans = fitting.select("context_id", "document_id", "start", (F.col("start") + F.col("length")).alias("end"))
    held = containment_join(spans, bodies.select("context_id", "document_id", "body_id", "o_start", "o_end"), ["context_id", "document_id"])
    return bodies.join(held.select("body_id").distinct(), "body_id", "left_semi")


# Creations and references


def creations_of(creations: DataFrame, type_key: str, is_open: bool = False) -> DataFrame:
    """Creations of the very type; of an open generic type, of every construction of it."""
    return creations.where(F.col("definition" if is_open else "type_key") == type_key)


def with_collection_target(creations: DataFrame) -> DataFrame:
    return creations.where(holds(F.col("to_collection")))


def references_to_members(references: DataFrame, members: Sequence[tuple[str, str]]) -> DataFrame:
    """References of any of the members (owner, name); the names alone restrict the scan."""
    test = F.lit(False)
    for owner, name in members:
        test = test | ((F.col("owner") == owner) & (F.col("name") == name))
    return references.where(F.col("name").isin(*{name for _, name in members}) & test)


def null_checks_in(checks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Null checks that lie in one of the bodies, each once."""
    key = ["context_id", "document_id", "start", "length"]
    held = containment_join(checks.withColumn("end", F.col("start") + F.col("length")), bodies.select("context_id", "document_id", "o_start", "o_end"), ["context_id", "document_id"])
    return checks.join(held.select(*key).distinct(), key, "left_semi")


# Expressions


def refers_to(expressions: DataFrame, *members: str) -> DataFrame:
    return expressions.where(F.col("refers_to").isin(*members))


def type_is(expressions: DataFrame, *types: str, converted: bool = False) -> DataFrame:
    return expressions.where(F.col("converted_type" if converted else "type_key").isin(*types))


def type_is_assignable_to(expressions: DataFrame, lineage: DataFrame, base: str, column: str = "type_key") -> DataFrame:
    """Expressions whose type is a base, derives from it or implements it."""
    kinds = lineage.where(F.col("ancestor") == base).select(F.col("type").alias("_type")).distinct()
    return expressions.join(kinds, F.col(column) == F.col("_type"), "left_semi")


def is_constant(type_key: str | None = None) -> Column:
    """Whether an expression has a constant value, null too; of a type, if one is given."""
    known = holds(F.col("has_value"))
    return known if type_key is None else known & holds(F.col("constant_type") == type_key)


def is_value(type_key: str, value) -> Column:
    """Whether an expression is this very constant; a present null is a constant."""
    return is_constant(type_key) & F.col("value").eqNullSafe(F.lit(value).cast("string"))


def value_as(type_key: str, kind: str) -> Column:
    """The constant of a type as a Spark type, null where it is none."""
    return F.when(is_constant(type_key), F.col("value").try_cast(kind))


def is_omitted_or(argument_start: Column, type_key: str, value) -> Column:
    """Whether an argument is left out, or is this very constant."""
    return argument_start.isNull() | is_value(type_key, value)


def as_invocation(expressions: DataFrame, calls: DataFrame) -> DataFrame:
    """Expressions with the call that they are, by span."""
    return expressions.join(calls.select("context_id", "document_id", "start", "length", "call_id"), ["context_id", "document_id", "start", "length"])


def awaited_calls(expressions: DataFrame, calls: DataFrame) -> DataFrame:
    """Awaited expressions (operand_start, operand_length) with the call that they await."""
    own = calls.select("context_id", "document_id", F.col("start").alias("operand_start"), F.col("length").alias("operand_length"), "call_id")
    return expressions.where(holds(F.col("is_awaited"))).join(own, ["context_id", "document_id", "operand_start", "operand_length"])


def types_passed_as(calls: DataFrame, arguments: DataFrame, *parameters: str) -> DataFrame:
    """(seed): the types of what resolved calls pass as the parameters; one that can't be told is null."""
    return arguments.where(F.col("parameter").isin(*parameters)).join(calls.where(holds(F.col("is_resolved"))).select("call_id"), "call_id", "left_semi").select(F.col("type_key").alias("seed")).distinct()


def types_declared_by(members: DataFrame) -> DataFrame:
    """(seed): the types of declared members; one that can't be told is null."""
    return members.select(F.col("type_key").alias("seed")).distinct()


def evaluation_inputs(arguments: DataFrame) -> DataFrame:
    """(call_id, inputs): the values of each call in the order in which they are written."""
    written = F.struct("value_start", "parameter")
    return source_values(arguments).groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(written)), lambda a: a["parameter"]).alias("inputs"))


# Facts about framework calls. The names are the framework's: fixed values.

CULTURE_PREFIX = ("StartsWith", "EndsWith", "IndexOf", "LastIndexOf")
SORTING = ("Order", "OrderDescending", "OrderBy", "OrderByDescending", "ThenBy", "ThenByDescending")
COMPARISONS = ("System.StringComparison", "System.Globalization.CompareOptions", "System.Collections.Generic.IComparer<>", "System.Comparison<>")
PROVIDERS = ("System.IFormatProvider", "System.Globalization.CultureInfo")
FRACTIONS = ("double", "float", "decimal", "System.Half")
TIMES = ("System.DateTime", "System.DateTimeOffset", "System.DateOnly", "System.TimeOnly", "System.TimeSpan")


def any_parameter(parameters: Column, *types: str) -> Column:
    return F.exists(parameters, lambda p: F.regexp_replace(p, "<.*>", "<>").isin(*types))


def compares_with_culture(owner: str = "owner", name: str = "name", parameters: str = "parameters", key_type: str = "key_type") -> Column:
    """Whether a call compares, sorts or changes the case of text by the current culture: none is passed.

    ``key_type`` is what a sorting call sorts by.
    """
    own, named, given = F.col(owner), F.col(name), F.col(parameters)
    n, first = F.size(given), F.get(given, 0)
    text = F.when(named.isin(*CULTURE_PREFIX), first == "string").otherwise(named.isin("Compare", "CompareTo") | (named.isin("ToLower", "ToUpper") & (n == 0)))
    listed = (named == "Sort") & (n <= 1) & ((own == "System.Collections.Generic.List<string>") | ((own == "System.Array") & (first == "string[]")))
    found = (
        F.when(own == "string", text).when(own == "char", named.isin("ToLower", "ToUpper") & (n == 1))
        .when((own == "System.Linq.Enumerable") & named.isin(*SORTING), F.col(key_type) == "string").otherwise(listed)
    )
    return holds(~any_parameter(given, *COMPARISONS) & found)


def formats_with_culture(owner: str = "owner", name: str = "name", parameters: str = "parameters", has_overload: str = "has_provider_overload", fmt: str = "format") -> Column:
    """Whether a call formats or parses a number or a time by the current culture: no provider is passed.

    ``has_overload`` says whether the method has an overload that takes one, ``fmt`` is its constant format.
    """
    own, named, given = F.col(owner), F.col(name), F.col(parameters)
    cultural = own.isin(*FRACTIONS, *TIMES)
    invariant = own.isin(*TIMES) & F.col(fmt).isin("O", "o", "R", "r", "s", "u", "c")
    found = (
        F.when((named == "ToString") & (F.size(given) == 0), cultural).when((named == "ToString") & holds(invariant), False)
        .when(named.isin("ToString", "Parse", "TryParse", "ParseExact", "TryParseExact"), cultural & F.col(has_overload))
        .when((named == "Format") & (own == "string"), True).when((named == "AppendFormat") & (own == "System.Text.StringBuilder"), True)
        .otherwise((own == "System.Convert") & (F.size(given) == 1) & F.get(given, 0).isin("string", *FRACTIONS, *TIMES) & F.col(has_overload))
    )
    return holds(~any_parameter(given, *PROVIDERS) & found)


TIME_PROVIDER, TIME_SPAN, TASK = "System.TimeProvider", "System.TimeSpan", "System.Threading.Tasks.Task"
CANCELLATION = "System.Threading.CancellationTokenSource"


def waits_without_clock(owner: str = "owner", name: str = "name", parameters: str = "parameters", receiver_has_clock: str = "receiver_has_clock") -> Column:
    """Whether a call waits on the system's clock: none is passed, and its receiver wasn't made with one."""
    own, named, given = F.col(owner), F.col(name), F.col(parameters)
    found = (
        ((named == "Delay") & (own == TASK)) | ((named == "WaitAsync") & (F.split_part(own, F.lit("<"), F.lit(1)) == TASK) & any_parameter(given, TIME_SPAN))
        | ((named == "Sleep") & (own == "System.Threading.Thread")) | ((named == "CancelAfter") & (own == CANCELLATION) & ~holds(F.col(receiver_has_clock)))
    )
    return holds(~any_parameter(given, TIME_PROVIDER) & found)


def times_without_clock(type_key: str = "type_key", parameters: str = "parameters") -> Column:
    """Whether a creation starts a timer or a timeout on the system's clock."""
    own, given = F.col(type_key), F.col(parameters)
    timer = own.isin("System.Threading.PeriodicTimer", "System.Threading.Timer", "System.Timers.Timer")
    return holds(~any_parameter(given, TIME_PROVIDER) & (timer | ((own == CANCELLATION) & (F.size(given) > 0))))


def profile(rows: DataFrame, rule: str = "rule_id", took: str = "micros") -> DataFrame:
    """(rule, runs, total, longest): counters of what each rule took, the longest first."""
    return rows.groupBy(rule).agg(F.count(F.lit(1)).alias("runs"), F.sum(took).alias("total"), F.max(took).alias("longest")).withColumn("rank", F.rank().over(Window.orderBy(F.desc("total"), rule)))
