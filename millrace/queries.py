"""One registered query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import code_queries
from millrace.functions import allowances, text
from millrace.operators import catalogue, changes, edits, evidence, facts, graph, grouping, spans
from millrace.plans import rules
from millrace.plans.conditions import where
from millrace.plans.selection import Selection
from millrace.plans.session import small_side
from millrace.sources import lexer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f"q_{f.__name__}"] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Selection:
    return Selection(read(spark, sf_dir, "documents"), ("doc_id",))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    return rows


# Selections ------------------------------------------------------------------


@query
def select_where(spark, d):
    long = where(F.col("n_chars") >= 1000) & where(F.col("lang") == "en", names={"en"})
    return documents(spark, d).where(long).select("source", "n_chars").rows


@query
def select_many_lines(spark, d):
    chosen = documents(spark, d).select_many(F.split("text", "\n"), "line")
    return chosen.rows.select("doc_id", "position", "line")


@query
def except_when(spark, d):
    orders = Selection(read(spark, d, "orders"), ("o_orderkey",))
    dear = where(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")) < "3") | where(F.col("o_totalprice") > 200000)
    return orders.except_when(dear).select("o_custkey", "o_orderpriority").rows


@query
def concat(spark, d):
    customers = Selection(read(spark, d, "customer"), ("c_custkey",))
    both = customers.where(F.col("c_acctbal") > 0).concat(customers.where(F.col("c_mktsegment") == "BUILDING"))
    return both.select("c_mktsegment").rows


@query
def union_identity(spark, d):
    customers = Selection(read(spark, d, "customer"), ("c_custkey",))
    one = customers.where(F.col("c_acctbal") > 0).select("c_nationkey", F.lit("balance").alias("why"))
    two = customers.where(F.col("c_mktsegment") == "BUILDING").select("c_nationkey", F.lit("segment").alias("why"))
    return one.union(two).rows


@query
def join_equi(spark, d):
    orders = Selection(read(spark, d, "orders"), ("o_orderkey",)).where(F.col("o_orderstatus") == "F").select("o_custkey")
    customer, nation = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), read(spark, d, "nation")
    return orders.join(customer, "o_custkey", "c_custkey").join(small_side(nation), "c_nationkey", "n_nationkey").rows.select("o_orderkey", "c_name", "n_name")


@query
def join_folded_key(spark, d):
    kinds = spark.createDataFrame([("Economy", "cheap"), ("PROMO", "offer"), ("standard", "plain"), (None, "none")], "kind string, class string")
    parts = Selection(read(spark, d, "part"), ("p_partkey",)).select("p_type")
    return parts.join(kinds, "p_type", "kind", fold=F.lower).rows.select("p_partkey", "p_type", "class")


@query
def without_matching_key(spark, d):
    return documents(spark, d).select("source").without_matching(read(spark, d, "labels"), "doc_id", "doc_id").rows


@query
def without_matching_theta(spark, d):
    orders = read(spark, d, "orders")
    later = orders.select(F.col("o_custkey").alias("l_custkey"), F.col("o_orderdate").alias("l_date"), F.col("o_orderkey").alias("l_key"))
    newer = (F.col("l_date") > F.col("o_orderdate")) | ((F.col("l_date") == F.col("o_orderdate")) & (F.col("l_key") > F.col("o_orderkey")))
    return Selection(orders, ("o_orderkey",)).without(later, newer, [("o_custkey", "l_custkey")]).select("o_custkey").rows


@query
def set_missing(spark, d):
    ordered, shown = read(spark, d, "customer"), read(spark, d, "part")
    want = ordered.select(F.lower("c_mktsegment").alias("word"), F.col("c_custkey").alias("at")).unionByName(shown.select(F.initcap("p_type").alias("word"), F.col("p_partkey").alias("at")))
    have = shown.where("p_size > 10").select(F.upper("p_type").alias("word"))
    return grouping.missing(want, have, "word", F.lower, order="at")


@query
def sets_are_equal(spark, d):
    nations = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return grouping.are_equal(nations, read(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), "nation")


@query
def set_unexpected(spark, d):
    return grouping.unexpected(read(spark, d, "region").select(F.col("r_regionkey").alias("nation")), read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


@query
def place_filters(spark, d):
    host, path = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1), F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    pages = Selection(read(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path")), ("page_id",))
    return pages.where(where(text.in_folder(F.col("path"), "en")) | where(text.matches_glob(F.col("host"), "m.*.net"))).select("host").rows


# Grouping --------------------------------------------------------------------


@query
def constant_groups(spark, d):
    return grouping.constant_groups(read(spark, d, "part"), ["p_brand", "p_type"], ["p_partkey"], 2)


@query
def template_groups(spark, d):
    scheme = F.regexp_extract("url", "^[a-z]+", 0)
    path = F.regexp_replace("url", "[?#].*$", "")
    pages = read(spark, d, "pages").select("page_id", scheme.alias("scheme"), F.regexp_replace(path, "^[a-z]+://[^/]*", "").alias("path"))
    return grouping.template_groups(pages, ["scheme"], text.template_key(F.col("path")), ["page_id"], 2)


@query
def duplicates(spark, d):
    rows = read(spark, d, "documents")
    words = F.filter(F.split(F.lower("text"), "[ \n\t\r]+"), lambda w: w != "")
    return grouping.duplicates(rows, ["lang"], F.array_join(words, " "), F.size(words), 12).select("doc_id", "lang", "copies")


@query
def membership(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "lang", "source")
    members = rows.select(F.col("doc_id").alias("doc_id"), F.concat("lang", F.lit("/"), "source").alias("g")).unionByName(read(spark, d, "labels").select("doc_id", F.concat(F.lit("quality="), F.col("quality").cast("string")).alias("g")))
    found = grouping.with_groups(rows.select("doc_id"), members, "doc_id", "g")
    return found.select("doc_id", F.array_join("groups", ";").alias("groups"), F.size("groups").cast("long").alias("n"))


@query
def exactly_one(spark, d):
    turns = read(spark, d, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return grouping.exactly_one(user, answers, ["conv_id", "turn"], ["conv_id"])


@query
def greedy_parts(spark, d):
    rows = read(spark, d, "customer").select("c_nationkey", "c_custkey", F.floor("c_acctbal").cast("long").alias("balance"))
    return grouping.partition_greedily(rows, ["c_nationkey"], ["c_custkey"], lambda heads, row: np.abs(heads["balance"] - row["balance"]) <= 3000)


@query
def sections(spark, d):
    made = grouping.sections(lines(spark, d), ["doc_id"], "position", "line")
    return made.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"), F.min("position").alias("first_line"))


@query
def blank_lines(spark, d):
    return grouping.blank_lines(lines(spark, d), ["doc_id"], "line")


@query
def chain_before_after(spark, d):
    found = grouping.before_and_after(read(spark, d, "conversations"), ["conv_id"], "turn", "role")
    return found.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"), "is_first", "is_last")


# Spans -----------------------------------------------------------------------


def edit_spans(spark, d) -> DataFrame:
    """Two proposed edits for each document: its middle third, and an insertion or a cut at a place that its id gives."""
    rows = read(spark, d, "documents").select(F.col("source").alias("file_identity"), "doc_id", "n_chars")
    one = rows.select("file_identity", (F.col("doc_id") * 2).alias("edit_id"), F.floor(F.col("n_chars") / 3).alias("start"), F.floor(F.col("n_chars") / 50).alias("length"))
    two = rows.select("file_identity", (F.col("doc_id") * 2 + 1).alias("edit_id"), ((F.col("doc_id") * 37) % 5000).alias("start"), (F.col("doc_id") % 3).alias("length"))
    return one.unionByName(two)


@query
def overlap_conflicts(spark, d):
    return spans.overlap_pairs(edit_spans(spark, d), "file_identity", "edit_id")


def line_spans(spark, d) -> DataFrame:
    rows = lines(spark, d).withColumn("size", F.length("line") + 1)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", "position", before.alias("o_start"), (before + F.length("line")).alias("o_end"))


def long_lines(spark, d, least: int) -> DataFrame:
    """Lines above a length with their offsets; only those leave their document's row."""
    rows = read(spark, d, "documents").withColumn("lines", F.split("text", "\n"))
    sizes = rows.withColumn("sizes", F.transform("lines", lambda x: F.length(x))).drop("lines", "text")
    long = F.filter(F.transform("sizes", lambda n, i: F.struct(i.alias("position"), n.alias("size"))), lambda x: x["size"] > least)
    kept = sizes.withColumn("long", long).where(F.size("long") > 0)
    before = lambda x: F.aggregate(F.slice("sizes", F.lit(1), x["position"]), F.lit(0).cast("long"), lambda a, n: a + n + 1)
    spans_ = F.transform("long", lambda x: F.struct(x["position"].alias("position"), before(x).alias("o_start"), (before(x) + x["size"]).alias("o_end")))
    return kept.select("*", F.inline(spans_)).drop("sizes", "long")


def word_spans(spark, d) -> DataFrame:
    """First and last character of every place of a license word in each document."""
    pieces = F.split("text", "icense", -1)
    rows = read(spark, d, "documents").where(F.contains("text", F.lit("icense"))).select("doc_id", F.transform(pieces, lambda x: F.length(x).cast("long")).alias("sizes"))
    at = F.transform(F.sequence(F.lit(1), F.size("sizes") - 1), lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0).cast("long"), lambda a, n: a + n) + 6 * (k - 1))
    return rows.select("doc_id", F.explode(at).alias("start")).select("doc_id", "start", (F.col("start") + 6).alias("end"))


@query
def containment(spark, d):
    return spans.containment_join(word_spans(spark, d), line_spans(spark, d), ["doc_id"]).select("doc_id", "start", "position")


@query
def nearest_ancestor(spark, d):
    outer = line_spans(spark, d).select("doc_id", "o_start", "o_end", F.lit("line").alias("kind"))
    whole = read(spark, d, "documents").select("doc_id", F.lit(0).cast("long").alias("o_start"), F.length("text").cast("long").alias("o_end"), F.lit("document").alias("kind"))
    found = spans.nearest_ancestor(word_spans(spark, d), outer.unionByName(whole), ["doc_id"], ["doc_id", "start"], F.col("kind") == "line", F.col("kind") == "document")
    return found.select("doc_id", "start", "o_start", "o_end")


def scopes(spark, d) -> DataFrame:
    """Nested time scopes of each user, in seconds: all events, and the events of each type."""
    rows = read(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    whole = rows.groupBy("user_id").agg(F.min("at").alias("o_start"), F.max("at").alias("o_end")).withColumn("allowance_id", F.concat(F.lit("all/"), F.col("user_id").cast("string")))
    typed = rows.groupBy("user_id", "event_type").agg(F.min("at").alias("o_start"), F.max("at").alias("o_end"))
    typed = typed.select("user_id", "o_start", "o_end", F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("allowance_id"))
    return whole.unionByName(typed).withColumn("rule_id", F.lit("error"))


@query
def suppress_innermost(spark, d):
    errors = read(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.lit("error").alias("rule_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"))
    _, held, _ = changes.suppress(errors, scopes(spark, d), ["user_id"], ["event_id"])
    return held.select("event_id", "o_start", "o_end")


# Rules -----------------------------------------------------------------------


def candidates(rows: DataFrame, file: F.Column, start: F.Column, length: F.Column, context: F.Column, ordinal: F.Column) -> DataFrame:
    place = {"context_id": context, "document_id": file, "file_identity": file, "path": file, "start": start.cast("long"), "length": length.cast("long"), "ordinal": ordinal.cast("long")}
    return rows.select("*", *[v.alias(k) for k, v in place.items() if k not in rows.columns])


def catalog(spark, d) -> rules.RuleCatalog:
    """Three rules over documents: repeated texts, texts without a label, very long lines."""
    docs = read(spark, d, "documents")
    words = F.filter(F.split(F.lower("text"), "[ \n\t\r]+"), lambda w: w != "")
    file = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    at = lambda rows, start, length: candidates(rows, file, start, length, F.col("lang"), F.col("doc_id"))
    repeated = grouping.duplicates(docs, ["lang"], F.array_join(words, " "), F.size(words), 12)
    unlabelled = Selection(docs, ("doc_id",)).without_matching(read(spark, d, "labels"), "doc_id", "doc_id").rows
    wide = long_lines(spark, d, 400)
    return (
        rules.RuleCatalog()
        .rule("D1", rules.Clause(at(repeated, F.lit(0), F.col("n_chars")), "This text repeats", fix_complexity="Local", evidence=F.concat(F.lit("copies="), F.col("copies").cast("string"))))
        .rule("D2", rules.Clause(at(unlabelled, F.lit(0), F.col("n_chars")), "This text has no label", disposition=rules.REVIEW).forbid())
        .rule("D3", rules.Clause(at(wide, F.col("o_start"), F.col("o_end") - F.col("o_start")), "This line is long", fix_complexity="Trivial").report_once_per("doc_id"))
    )


@query
def findings(spark, d):
    found = catalog(spark, d).evaluate()
    return found.select("rule_id", "context_id", "path", "start", "length", "message", "disposition", "evidence", "fix_complexity")


@query
def aggregate_findings(spark, d):
    found = catalog(spark, d).evaluate()
    own = F.struct("context_id", "disposition", "evidence", F.col("fix_complexity"))
    second = F.struct(F.lit("second").alias("context_id"), F.lit(rules.REVIEW).alias("disposition"), F.lit("seen again").alias("evidence"), F.lit("Architectural").alias("fix_complexity"))
    everywhere = found.select(*[c for c in found.columns if c not in ("context_id", "disposition", "evidence", "fix_complexity")], F.inline(F.array(own, second)))
    merged = rules.aggregate_findings(everywhere)
    return merged.select("rule_id", "path", "start", "length", "message", "disposition", "evidence", "fix_complexity", "contexts")


@query
def status(spark, d):
    contexts = read(spark, d, "documents").select(F.col("lang").alias("context_id")).distinct().withColumn("project_path", F.concat(F.lit("corpus/"), F.col("context_id")))
    return rules.status(catalog(spark, d).evaluate(), contexts)


@query
def report_once(spark, d):
    events = read(spark, d, "events").where("event_type = 'error'")
    rows = candidates(events, F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1), F.lit("log"), F.col("event_id"))
    found = rules.RuleCatalog().rule("E1", rules.Clause(rows, "A user's first error").report_once_per("user_id")).evaluate()
    return found.select(F.col("path").alias("user"), F.col("ordinal").alias("event_id"))


@query
def baseline_diff(spark, d):
    orders = read(spark, d, "orders")
    content = F.concat_ws("|", "o_orderstatus", "o_orderpriority")
    accepted = orders.where("o_orderpriority <> '1-URGENT'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")))
    return changes.change_of(orders, accepted, ["o_orderkey"], content, content).select("o_orderkey", "change")


def symbol_parts(spark, d) -> DataFrame:
    """Order lines as parts of the symbols that orders are."""
    rows = read(spark, d, "lineitem")
    return rows.select(F.lit("p").alias("project_key"), F.col("l_orderkey").cast("string").alias("symbol"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"), F.col("l_partkey").alias("start"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("text"), F.when(F.col("l_tax") > 0.04, "public").otherwise("internal").alias("accessibility"), "l_shipdate")


@query
def changed_symbols(spark, d):
    parts = symbol_parts(spark, d)
    accepted = parts.where("l_shipdate < timestamp '2001-01-01'").withColumn("text", F.when(F.col("start") % 5 == 0, F.lit("N:F")).otherwise(F.col("text")))
    none = read(spark, d, "orders").select(F.lit("p").alias("project_key"), F.lit("a").alias("path"), F.lit("t").alias("text")).limit(0)
    return changes.Baseline(none, accepted).change_of_symbols(parts).select("symbol", "change")


@query
def previous_accessibility(spark, d):
    parts = symbol_parts(spark, d)
    none = parts.select("project_key", "path", "text").limit(0)
    return changes.Baseline(none, parts.where("l_shipdate < timestamp '2001-01-01'")).previous_accessibility(parts.select("project_key", "symbol").distinct()).select("symbol", "previous")


@query
def changed_files(spark, d):
    docs = read(spark, d, "documents")
    key = changes.project_key(F.col("lang"), F.col("source"), F.create_map(F.lit("b"), F.lit("1"), F.lit("A"), F.lit("2")))
    files = docs.select("doc_id", key.alias("project_key"), F.concat(F.lit("src\\"), F.col("doc_id").cast("string")).alias("path"), "text", "n_chars")
    accepted = files.where("n_chars % 3 <> 0").withColumn("path", F.replace("path", F.lit("\\"), F.lit("/"))).withColumn("text", F.when(F.col("n_chars") % 2 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return changes.Baseline(accepted).changed_files(files).select("doc_id", "path", "change")


# Evidence --------------------------------------------------------------------


def ranges(spark, d) -> DataFrame:
    """Events as ranges of states: clicks and purchases cover, errors don't, the rest is unknown."""
    state = F.when(F.col("event_type").isin("click", "purchase", "view"), evidence.COVERED).when(F.col("event_type") == "error", evidence.UNCOVERED).otherwise(evidence.UNKNOWN)
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, d, "events").select("user_id", "event_type", day.alias("day"), (F.hour("ts") * 4).alias("first_line"), (F.hour("ts") * 4 + F.col("event_id") % 7).cast("int").alias("last_line"), state.alias("state"))


@query
def merge_points(spark, d):
    return evidence.merge_points(ranges(spark, d), ["user_id", "day"])


@query
def merge_ranges(spark, d):
    return evidence.merge_ranges(ranges(spark, d), ["user_id", "first_line", "last_line"], "day")


@query
def line_measure(spark, d):
    measured = evidence.measure_lines(ranges(spark, d), ["user_id"])
    passed = evidence.at_least(F.col("covered"), F.col("coverable"), F.col("is_complete"), 50.0)
    state = evidence.line_state(F.col("covered"), F.col("coverable"), F.col("is_complete"))
    return measured.select("user_id", "covered", "coverable", "is_complete", passed.alias("passed"), state.alias("state"))


@query
def inspect_evidence(spark, d):
    held = line_spans(spark, d).select("doc_id", "o_start", "o_end", F.when(F.col("position") % 3 == 0, evidence.COVERED).when(F.col("position") % 3 == 1, evidence.UNCOVERED).otherwise(evidence.UNKNOWN).alias("state"))
    return evidence.inspect(word_spans(spark, d), held, ["doc_id"], ["doc_id", "start"]).select("doc_id", "start", "evidence_state", "evidence_reason")


@query
def planning_algebra(spark, d):
    events = read(spark, d, "events")
    known, unsure = where(F.col("event_type") == "click"), where(F.col("value") > 50).pending(F.lit(True), F.col("value") < 90)
    both, either, neither = known & unsure, known | unsure, ~(known | unsure)
    flags = [c for name, p in (("both", both), ("either", either), ("neither", neither)) for c in zip((f"{name}_can_true", f"{name}_can_false"), p.possible(), strict=True)]
    return events.select("event_id", *[c.alias(n) for n, c in flags], both.certain().alias("both_certain"))


# Graphs ----------------------------------------------------------------------


def tree(spark, d) -> DataFrame:
    """Edges region - nation - customer - order (src, dst, ordinal); nodes are named by a letter and a key."""
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    nation, customer, orders = (read(spark, d, t) for t in ("nation", "customer", "orders"))
    return (
        nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.col("n_nationkey").cast("int").alias("ordinal"))
        .unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), F.col("c_custkey").cast("int").alias("ordinal")))
        .unionByName(orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.col("o_orderkey").cast("int").alias("ordinal")))
    )


def ring(spark, d) -> DataFrame:
    """The same edges, and back from nations to their regions: a cycle."""
    back = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit(0).alias("ordinal"))
    return tree(spark, d).unionByName(back)


def regions(spark, d) -> DataFrame:
    return read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))


@query
def closure(spark, d):
    return graph.closure(tree(spark, d), nodes=regions(spark, d))


@query
def reaches(spark, d):
    customers = read(spark, d, "customer")
    starts = customers.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    targets = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.reaches(ring(spark, d), starts, targets)


@query
def path_to(spark, d):
    targets = read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.path_to(ring(spark, d), regions(spark, d), targets).select("start", "target", F.array_join("path", ">").alias("path"))


@query
def callees_boundary(spark, d):
    boundary = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.callees(ring(spark, d), regions(spark, d), boundary)


@query
def traverse_bounded(spark, d):
    nation = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("seed"))
    own = tree(spark, d).select("src", "dst")
    idle = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    ends = idle.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.lit(None).cast("string").alias("dst"))
    return graph.traverse(nation, own.unionByName(ends), most_depth=1, most_states=1 << 20)


@query
def conflict_groups(spark, d):
    links = read(spark, d, "nation").select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 5).alias("b")).where("b < 25")
    return edits.conflict_groups(links)


@query
def compatible_views(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_regionkey").alias("framework"), F.col("n_nationkey").alias("root"))
    a, b = nation.withColumnRenamed("root", "a"), nation.select(F.col("framework").alias("f"), F.col("root").alias("b"))
    pairs = a.join(b, (F.col("framework") == F.col("f")) & (F.col("a") < F.col("b")) & (F.abs(F.col("a") - F.col("b")) <= 10)).select("framework", "a", "b")
    found = graph.compatible_views(nation, pairs)
    return found.select("framework", "root", "view").groupBy("framework", "view").agg(F.array_join(F.array_sort(F.collect_set("root")), ",").alias("roots")).select("framework", "roots")


@query
def view_contexts(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_regionkey").alias("framework"), F.col("n_nationkey").alias("root"))
    a, b = nation.withColumnRenamed("root", "a"), nation.select(F.col("framework").alias("f"), F.col("root").alias("b"))
    pairs = a.join(b, (F.col("framework") == F.col("f")) & (F.col("a") < F.col("b"))).select("framework", "a", "b")
    edges = read(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.expr("n_nationkey div 2").alias("dst")).where("src <> dst")
    return graph.view_contexts(graph.compatible_views(nation, pairs), edges).select("framework", "context_id")


@query
def reaching_defs(spark, d):
    nation = read(spark, d, "nation")  # blocks in five rings, a line between them; customers and suppliers define
    block = F.col("n_nationkey").cast("int")
    flow = nation.select(block.alias("src"), (block + 5).alias("dst")).where("dst < 25").unionByName(nation.where("n_nationkey >= 20").select(block.alias("src"), (block - 20).alias("dst"))).unionByName(nation.where("n_nationkey < 4").select(block.alias("src"), (block + 1).alias("dst")))
    made = read(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("block"), F.concat(F.lit("v"), (F.col("s_suppkey") % 4).cast("string")).alias("variable"), F.col("s_suppkey").cast("int").alias("definition"))
    return graph.reaching_definitions(flow, made)


# Edits -----------------------------------------------------------------------


def proposals(spark, d) -> DataFrame:
    return edit_spans(spark, d).select("file_identity", F.col("edit_id").cast("string").alias("proposal"), "start", "length", F.lit("x").alias("replacement"))


@query
def batch_ids(spark, d):
    return edits.batch_ids(proposals(spark, d))


@query
def without_conflicts(spark, d):
    return edits.without_conflicts(proposals(spark, d).withColumnRenamed("proposal", "batch_id")).select("batch_id", "file_identity", "start", "length")


@query
def safe_everywhere(spark, d):
    docs = read(spark, d, "documents")
    batches = docs.select(F.concat("source", F.lit("!")).alias("batch_id"), F.col("source").alias("file_identity"))
    contexts = docs.select(F.col("source").alias("file_identity"), F.col("lang").alias("context_id")).distinct()
    safe = docs.groupBy(F.concat("source", F.lit("!")).alias("batch_id"), F.col("lang").alias("context_id")).agg((F.max("n_chars") < 20000).alias("is_safe"))
    return edits.safe_everywhere(batches, contexts, safe)


# Functions -------------------------------------------------------------------


@query
def glob(spark, d):
    path = F.regexp_replace("url", r"^[a-z]+://", "")
    return read(spark, d, "pages").where(text.matches_glob(path, "**/*1*") | text.matches_glob(path, "*/?*/**/*1")).select("page_id")


@query
def identifier_words(spark, d):
    names = read(spark, d, "customer").select("c_custkey", F.concat("c_name", F.initcap("c_mktsegment"), F.lit("HTTPKey"), F.col("c_nationkey").cast("string")).alias("name"))
    return names.select("c_custkey", F.array_join(text.identifier_words(F.regexp_replace("name", "#", "_")), " ").alias("words"))


@query
def namespace_match(spark, d):
    name = F.concat_ws(".", F.lit("corpus"), F.col("lang"), F.col("source"))
    return read(spark, d, "documents").where(text.in_namespace(name, "corpus.en.**") | text.in_namespace(name, "corpus.de.src1")).select("doc_id")


@query
def line_and_column(spark, d):
    rows = word_spans(spark, d).join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    found = rows.select("doc_id", "start", text.line_and_column(F.col("text"), F.col("start")).alias("p"))
    return found.select("doc_id", "start", F.col("p.line").cast("long").alias("line"), F.col("p.column").cast("long").alias("column"))


@query
def fingerprints(spark, d):
    return read(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), text.utf16_length(F.col("text")).cast("long").alias("units"))


@query
def allowance_parse(spark, d):
    comment = F.concat(F.lit("// rule-allow "), F.when(F.col("p_size") > 25, F.concat("p_brand", F.lit(", "), "p_type")).otherwise(F.lit("")), F.when(F.col("p_size") < 40, F.concat(F.lit(": "), F.col("p_name"))).otherwise(F.lit("")))
    parsed = read(spark, d, "part").select("p_partkey", allowances.parse_allowance(comment).alias("a"))
    return parsed.select("p_partkey", F.array_join("a.rules", "+").alias("rules"), F.col("a.reason").alias("reason"), F.col("a.problems").alias("problems"))


@query
def token_kinds(spark, d):
    docs = read(spark, d, "documents").select(F.lit("corpus").alias("context_id"), F.col("doc_id").cast("string").alias("document_id"), "text")
    return lexer.tokens(docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def classified_calls(spark, d):
    events = read(spark, d, "events")
    calls = events.select("event_id", F.when(F.col("value") > 5, F.when(F.col("user_id") % 2 == 0, "web").otherwise("app")).alias("owner"), F.col("event_type").alias("operation"), F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string")).alias("framework"))
    known = spark.createDataFrame([("web", "click", 7, "streams"), ("web", "view", 1, "streams")], "owner string, operation string, framework_bits int, capability string")
    return catalogue.classify_calls(calls, known, ["web"], {"v1": 1, "v2": 2, "v3": 4}).select("event_id", "standing", "capability")


# Facts -----------------------------------------------------------------------


@query
def distinct_definitions(spark, d):
    docs = read(spark, d, "documents")
    parts = docs.select(F.col("lang").alias("context_id"), F.col("source").alias("symbol"), F.concat(F.lit("f"), (F.col("n_chars") % 7).cast("string")).alias("path"), F.col("doc_id").alias("start"))
    return facts.distinct_definitions(parts)


@query
def derived_from(spark, d):
    lineage = facts.ancestors(tree(spark, d).select(F.col("dst").alias("type"), F.col("src").alias("base")))
    customers = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("type"))
    return facts.derived_from(customers, lineage, "r1").select("c_custkey")


@query
def where_argument(spark, d):
    calls = read(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), "o_custkey")
    arguments = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_returnflag").alias("parameter"), F.col("l_linestatus").alias("value"))
    return facts.where_argument(calls, arguments, (F.col("parameter") == "A") & (F.col("value") == "O"), or_missing="A")


@query
def references_to(spark, d):
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("decl_file"), F.lit(0).alias("decl_start"), F.lit(1).alias("decl_length"))
    parts = read(spark, d, "part").where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("file_identity"), F.lit(0).alias("start"), F.lit(1).alias("length"))
    return facts.references_to(items, parts).select("l_orderkey", "l_linenumber", F.col("decl_file").alias("l_partkey"))


@query
def routes(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    groups = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("group_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_group"), F.concat(F.lit("/"), F.col("n_name")).alias("prefix"))
    groups = groups.unionByName(region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("group_id"), F.lit(None).cast("string").alias("parent_group"), F.when(F.col("r_name") != "ASIA", F.concat(F.lit("/"), F.col("r_name"))).alias("prefix")))
    mappings = read(spark, d, "supplier").select(F.col("s_suppkey").alias("route_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("group_id"), F.concat(F.lit("/"), F.col("s_name")).alias("template"))
    return facts.routes(mappings, groups)


QUERIES |= code_queries.QUERIES
