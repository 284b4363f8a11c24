"""Queries over fact tables of code, made from the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import changes, edits, evidence, facts, graph
from millrace.operators import declarations as D
from millrace.operators import expressions as E
from millrace.plans import rules
from millrace.plans.conditions import where
from millrace.plans.selection import Selection
from millrace.sources.fact_tables import Facts, project_fact

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same tables in SQL.
CODE = """WITH RECURSIVE contexts AS (
  SELECT 'n' || n_nationkey AS context_id, n_name AS name, 'src/r' || (n_nationkey % 5) || '/' || n_name || '.proj' AS project_path, n_nationkey % 7 <> 0 AS is_analysis_target, n_nationkey % 4 = 0 AS is_test_project FROM nation
), docs AS (
  SELECT 'n' || s_nationkey AS context_id, 'd' || s_suppkey AS document_id, 'src/r' || (s_nationkey % 5) || ['/tests/', '/core/', '/core/deep/'][s_suppkey % 3 + 1] || 'S' || s_suppkey || '.cs' AS path,
         s_suppkey % 10 = 0 AS is_generated, 'f' || (s_suppkey % 40) AS file_identity FROM supplier
), shown AS (
  SELECT document_id, context_id FROM docs JOIN contexts USING (context_id) WHERE is_analysis_target AND NOT is_generated
), type_parts AS (
  SELECT context_id, document_id, p_partkey AS start, 't' || (p_partkey % 500) AS symbol, p_name AS name, 'Corpus.' || p_type AS namespace, CASE WHEN p_size % 4 = 0 THEN 'interface' ELSE 'class' END AS kind, path,
         CASE WHEN p_size > 25 THEN 'public' ELSE 'internal' END AS accessibility, CASE WHEN p_size % 2 = 0 THEN ['static', 'sealed'] WHEN p_size % 3 = 0 THEN ['sealed'] ELSE [] END AS modifiers
  FROM part JOIN docs ON document_id = 'd' || (p_partkey % 10)
), members AS (
  SELECT context_id, document_id, c_custkey AS start, 'm' || c_custkey AS symbol, 't' || (c_custkey % 500) AS owner, 'Get' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || (c_custkey % 9) AS name,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'method' WHEN 'MACHINERY' THEN 'field' WHEN 'HOUSEHOLD' THEN 'property' WHEN 'FURNITURE' THEN 'parameter' ELSE 'enum_member' END AS kind, 't' || (c_custkey % 7) AS type_key,
         CASE WHEN c_acctbal > 0 THEN 'public' ELSE 'private' END AS accessibility, [NULL, 'block', 'expression'][c_custkey % 3 + 1] AS body_kind, c_custkey % 5 AS n_statements
  FROM customer JOIN docs ON document_id = 'd' || (c_custkey % 10)
), calls AS (
  SELECT context_id, document_id, 'c' || o_orderkey AS call_id, o_orderkey * 100 AS start, 'm' || o_custkey AS caller, 't' || (o_orderkey % 9) AS owner, string_split(o_orderpriority, '-')[2] AS name, 'm' || (o_orderkey % 50) AS target,
         't' || (o_orderkey % 11) AS receiver_type, CASE WHEN o_orderkey % 4 <> 3 THEN 'c' || (o_orderkey + 1) END AS receiver_call, o_orderstatus <> 'P' AS is_resolved, o_orderkey % 8 = 0 AS in_expression_tree, o_orderkey % 9 = 0 AS in_nameof
  FROM orders JOIN docs ON document_id = 'd' || (o_orderkey % 10)
), arguments AS (
  SELECT 'c' || l_orderkey AS call_id, l_linenumber AS ordinal, l_returnflag AS parameter, 't' || (l_partkey % 5) AS parameter_type, CASE WHEN l_tax > 0 THEN l_orderkey * 100 + l_linenumber END AS value_start, l_discount > 0.05 AS has_value, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value FROM lineitem
), bases AS (
  SELECT 't' || k AS type, 't' || (k // 2) AS base, k // 2 % 3 = 0 AS is_interface FROM range(1, 500) r(k)
), lineage(type, ancestor, depth) AS (
  SELECT type, type, 0 FROM (SELECT type FROM bases UNION SELECT base FROM bases) UNION SELECT l.type, b.base, l.depth + 1 FROM lineage l JOIN bases b ON l.ancestor = b.type
)
"""


def code(spark: SparkSession, d: str) -> Facts:
    """Nations as contexts, suppliers as documents, parts as types, customers as members, orders as calls, order lines as arguments."""
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    key = lambda letter, column, n=None: F.concat(F.lit(letter), (F.col(column) if n is None else F.col(column) % n).cast("string"))
    nation, supplier, part, customer, orders, items = (read(t) for t in ("nation", "supplier", "part", "customer", "orders", "lineitem"))
    contexts = nation.select(key("n", "n_nationkey").alias("context_id"), F.col("n_name").alias("name"), F.concat(F.lit("src/r"), (F.col("n_nationkey") % 5).cast("string"), F.lit("/"), "n_name", F.lit(".proj")).alias("project_path"), (F.col("n_nationkey") % 7 != 0).alias("is_analysis_target"), (F.col("n_nationkey") % 4 == 0).alias("is_test_project"))
    folder = F.element_at(F.array(F.lit("/tests/"), F.lit("/core/"), F.lit("/core/deep/")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    documents = supplier.select(key("n", "s_nationkey").alias("context_id"), key("d", "s_suppkey").alias("document_id"), F.concat(key("src/r", "s_nationkey", 5), folder, key("S", "s_suppkey"), F.lit(".cs")).alias("path"), (F.col("s_suppkey") % 10 == 0).alias("is_generated"), key("f", "s_suppkey", 40).alias("file_identity"))
    place = F.broadcast(documents.where("document_id in ('d0', 'd1', 'd2', 'd3', 'd4', 'd5', 'd6', 'd7', 'd8', 'd9')").select("context_id", "document_id", "path"))  # ten rows
    words = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("static"), F.lit("sealed"))).when(F.col("p_size") % 3 == 0, F.array(F.lit("sealed"))).otherwise(F.array().cast("array<string>"))
    type_parts = part.withColumn("document_id", key("d", "p_partkey", 10)).join(place, "document_id").select(
        "context_id", "document_id", F.col("p_partkey").alias("start"), F.lit(10).alias("length"), key("t", "p_partkey", 500).alias("symbol"), F.col("p_name").alias("name"), F.concat(F.lit("Corpus."), "p_type").alias("namespace"),
        F.when(F.col("p_size") % 4 == 0, "interface").otherwise("class").alias("kind"), "path", F.when(F.col("p_size") > 25, "public").otherwise("internal").alias("accessibility"), words.alias("modifiers"))
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("BUILDING", "method", "MACHINERY", "field", "HOUSEHOLD", "property", "FURNITURE", "parameter", "AUTOMOBILE", "enum_member")]), F.col("c_mktsegment"))
    body = F.when(F.col("c_custkey") % 3 == 1, "block").when(F.col("c_custkey") % 3 == 2, "expression")
    members = customer.withColumn("document_id", key("d", "c_custkey", 10)).join(place, "document_id").select(
        "context_id", "document_id", F.col("c_custkey").alias("start"), F.lit(5).alias("length"), key("m", "c_custkey").alias("symbol"), key("t", "c_custkey", 500).alias("owner"), F.concat(F.lit("Get"), F.initcap("c_mktsegment"), (F.col("c_custkey") % 9).cast("string")).alias("name"), kind.alias("kind"),
        key("t", "c_custkey", 7).alias("type_key"), F.when(F.col("c_acctbal") > 0, "public").otherwise("private").alias("accessibility"), body.alias("body_kind"), (F.col("c_custkey") % 5).alias("n_statements"))
    calls = orders.withColumn("document_id", key("d", "o_orderkey", 10)).join(place, "document_id").select(
        "context_id", "document_id", (F.col("o_orderkey") * 100).alias("start"), F.lit(50).alias("length"), key("c", "o_orderkey").alias("call_id"), key("m", "o_custkey").alias("caller"), key("t", "o_orderkey", 9).alias("owner"), F.element_at(F.split("o_orderpriority", "-"), 2).alias("name"),
        key("m", "o_orderkey", 50).alias("target"), key("t", "o_orderkey", 11).alias("receiver_type"), F.when(F.col("o_orderkey") % 4 != 3, F.concat(F.lit("c"), (F.col("o_orderkey") + 1).cast("string"))).alias("receiver_call"), (F.col("o_orderstatus") != "P").alias("is_resolved"),
        (F.col("o_orderkey") % 8 == 0).alias("in_expression_tree"), (F.col("o_orderkey") % 9 == 0).alias("in_nameof"))
    arguments = items.select(key("c", "l_orderkey").alias("call_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("parameter"), key("t", "l_partkey", 5).alias("parameter_type"), F.when(F.col("l_tax") > 0, F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("value_start"), F.lit(1).alias("value_length"), (F.col("l_discount") > 0.05).alias("has_value"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    half = F.expr("id div 2")
    bases = spark.range(1, 500).select(key("t", "id").alias("type"), F.concat(F.lit("t"), half.cast("string")).alias("base"), (half % 3 == 0).alias("is_interface"))
    at = ["context_id", "document_id", "start", "length"]
    nth = lambda n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("start") % n + 1).cast("int"))
    sites = calls.withColumn("start", F.expr("start div 100"))
    return Facts({
        "contexts": contexts, "documents": documents, "type_parts": type_parts, "members": members, "calls": calls, "arguments": arguments, "bases": bases,
        "variables": sites.select(*at, nth(3, "local", "foreach", "out").alias("kind")), "statements": sites.select(*at, nth(4, "if", "embedded", "enumeration", "catch").alias("kind")),
        "nodes": sites.select(*at, nth(5, "Block", "Call", "Name", "Text", "Loop").alias("kind"), (F.lit(1).cast("int") * (F.col("start") % 8)).cast("int").alias("bits")), "operations": sites.select(*at, nth(2, "Binary", "Unary").alias("kind")),
        "null_checks": sites.where("start % 6 = 0").select(*at, nth(12, "is", "is", "is", "is", "is", "is", "==", "==", "==", "==", "==", "==").alias("form")),
        "member_refs": sites.select(*at, F.col("target").alias("member"), "owner", "name"), "type_refs": sites.select(*at, F.col("receiver_type").alias("type_key")),
    })


def pair(sql: str) -> Callable:
    """Register a query over the fact tables, and its SQL behind their SQL."""

    def register(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        QUERIES[f"q_{f.__name__}"] = lambda spark, d: f(code(spark, d))
        ORACLES[f"q_{f.__name__}"] = CODE + sql
        return f

    return register


def ancestors_of_types(c: Facts) -> DataFrame:
    return facts.ancestors(c.table("bases"))


def lineage(c: Facts) -> DataFrame:
    return c.fact(ancestors_of_types)


# Selections that rules start from ---------------------------------------------


@pair("SELECT document_id, path FROM docs JOIN contexts USING (context_id) WHERE is_analysis_target AND NOT is_generated")
def files(c):
    return c.files().rows.select("document_id", "path")


@pair("SELECT document_id, path FROM docs JOIN contexts USING (context_id) WHERE is_analysis_target")
def files_including_generated(c):
    return c.files(including_generated=True).rows.select("document_id", "path")


@pair("SELECT context_id, project_path FROM contexts WHERE is_analysis_target")
def projects(c):
    return c.projects().rows.select("context_id", "project_path")


@pair("SELECT document_id, start, symbol FROM type_parts JOIN shown USING (document_id, context_id)")
def type_declarations(c):
    return c.type_declarations().rows.select("document_id", "start", "symbol")


@pair("SELECT context_id, symbol, document_id, start FROM type_parts JOIN shown USING (document_id, context_id) QUALIFY row_number() OVER (PARTITION BY context_id, symbol ORDER BY path, start) = 1")
def types(c):
    return c.types().rows.select("context_id", "symbol", "document_id", "start")


@pair("SELECT context_id, symbol FROM (SELECT * FROM type_parts JOIN shown USING (document_id, context_id) QUALIFY row_number() OVER (PARTITION BY context_id, symbol ORDER BY path, start) = 1) WHERE kind = 'interface'")
def interfaces(c):
    return c.interfaces().rows.select("context_id", "symbol")


@pair("SELECT symbol, kind FROM members JOIN shown USING (document_id, context_id) WHERE kind IN ('method', 'field')")
def methods_and_fields(c):
    return c.members("method", "field").rows.select("symbol", "kind")


@pair("SELECT symbol, kind FROM members JOIN shown USING (document_id, context_id) WHERE kind IN ('property', 'parameter', 'enum_member')")
def properties_and_parameters(c):
    return c.members("property", "parameter", "enum_member").rows.select("symbol", "kind")


@pair("SELECT symbol, kind, start FROM type_parts JOIN shown USING (document_id, context_id) UNION ALL SELECT symbol, kind, start FROM members JOIN shown USING (document_id, context_id)")
def declarations(c):
    return c.declarations().select("symbol", "kind", "start")


@pair("SELECT call_id FROM calls JOIN shown USING (document_id, context_id) WHERE name IN ('URGENT', 'LOW')")
def calls_by_name(c):
    return c.calls("URGENT", "LOW").rows.select("call_id")


@pair("SELECT call_id FROM calls JOIN docs USING (document_id) WHERE path LIKE '%/tests/%'")
def within_files(c):
    return facts.within_files(c.table("calls"), c.table("documents").where(text.in_folder(F.col("path"), "tests"))).select("call_id")


@pair("SELECT context_id, count(*) AS parts, count(DISTINCT symbol) AS types FROM type_parts GROUP BY context_id")
def project_facts(c):
    return project_fact(c.table("type_parts"), {"parts": F.count(F.lit(1)), "types": F.count_distinct("symbol")})


SITES = ", sites AS (SELECT call_id, context_id, document_id, start // 100 AS start, target, receiver_type FROM calls JOIN shown USING (document_id, context_id))\n"


@pair(SITES + "SELECT start, ['local', 'foreach', 'out'][start % 3 + 1] AS kind FROM sites WHERE start % 3 <> 1")
def local_and_out_variables(c):
    return c.variables("local").concat(c.variables("out")).rows.select("start", "kind")


@pair(SITES + "SELECT start FROM sites WHERE start % 3 = 1")
def for_each_loops(c):
    return c.variables("foreach").rows.select("start")


@pair(SITES + "SELECT start, ['if', 'embedded', 'enumeration', 'catch'][start % 4 + 1] AS kind FROM sites WHERE start % 4 <> 1")
def statements_by_kind(c):
    return c.statements("if").concat(c.statements("enumeration")).concat(c.statements("catch")).rows.select("start", "kind")


@pair(SITES + "SELECT start FROM sites WHERE start % 4 = 1")
def embedded_statements(c):
    return c.statements("embedded").rows.select("start")


@pair(SITES + "SELECT start FROM sites WHERE start % 5 = 1 AND start % 8 & 3 = 2 UNION ALL SELECT start FROM sites WHERE start % 2 = 1")
def nodes_and_operations(c):
    marked = c.nodes("Call").where(F.col("bits").bitwiseAND(3) == 2).rows
    return marked.select("start").unionByName(c.operations("Unary").rows.select("start"))


@pair(SITES + "SELECT start, CASE WHEN start % 12 = 0 THEN 'is' ELSE '==' END AS form FROM sites WHERE start % 6 = 0")
def null_checks(c):
    return c.reported("null_checks").rows.select("start", "form")


@pair(SITES + "SELECT start, target AS member FROM sites WHERE target IN ('m1', 'm2')")
def member_references(c):
    return c.reported("member_refs").named("member", "m1", "m2").rows.select("start", "member")


@pair(SITES + "SELECT start, receiver_type AS type_key FROM sites WHERE receiver_type = 't3'")
def type_references(c):
    return c.reported("type_refs").named("type_key", "t3").rows.select("start", "type_key")


# Filters ------------------------------------------------------------------------


@pair("SELECT symbol FROM members WHERE name IN ('GetBuilding1', 'GetMachinery2')")
def named(c):
    return c.table("members").where(F.col("name").isin("GetBuilding1", "GetMachinery2")).select("symbol")


@pair(r"SELECT symbol FROM members JOIN shown USING (document_id, context_id) WHERE kind = 'method' AND name LIKE 'Get%7' OR kind = 'field' AND regexp_matches(name, 'y[13]$')")
def name_filters(c):
    glob = c.members("method").name_matching("name", "Get*7").rows
    return glob.unionByName(c.members("field").name_like("name", "y[13]$").rows).select("symbol")


@pair("SELECT symbol FROM members JOIN shown USING (document_id, context_id) WHERE kind IN ('method', 'field', 'property') AND (regexp_extract(name, '^Get([A-Z][a-z]+)', 1) = 'Building' OR regexp_extract(name, '[0-9]+$') = '4')")
def name_with_word(c):
    return c.members("method", "field", "property").name_with_word("name", "building", "4", fold=True).rows.select("symbol")


@pair("SELECT symbol FROM members WHERE name LIKE 'GetB%' AND name LIKE '%5'")
def name_starts_and_ends(c):
    return c.table("members").where(F.col("name").startswith("GetB") & F.col("name").endswith("5")).select("symbol")


@pair("SELECT DISTINCT start FROM type_parts WHERE list_contains(modifiers, 'static') AND accessibility = 'public'")
def modifier_and_accessibility(c):
    return D.with_accessibility(D.with_modifier(c.table("type_parts"), "static"), "public").select("start")


@pair("SELECT symbol FROM members JOIN contexts USING (context_id) WHERE is_test_project")
def in_test_projects(c):
    return D.in_test_projects(c.table("members"), c.table("contexts")).select("symbol")


@pair("SELECT symbol FROM members JOIN contexts USING (context_id) WHERE NOT is_test_project")
def in_non_test_projects(c):
    return D.in_test_projects(c.table("members"), c.table("contexts"), test=False).select("symbol")


@pair("SELECT symbol FROM members m JOIN contexts c USING (context_id) WHERE regexp_full_match(c.name, 'NATION_1[^/]*') OR c.name = 'NATION_7'")
def in_project(c):
    named_ = c.table("members").join(c.table("contexts").select("context_id", F.col("name").alias("project_name")), "context_id")
    return named_.where(D.is_in_project("NATION_1*") | D.is_in_project("NATION_7")).select("symbol")


@pair("SELECT document_id FROM docs JOIN contexts USING (context_id) WHERE path LIKE '%/deep/%'")
def in_folder(c):
    rows = c.table("documents").join(c.table("contexts").select("context_id", "project_path"), "context_id")
    return rows.where(D.is_in_folder("deep")).select("document_id")


@pair("SELECT document_id FROM docs WHERE regexp_full_match(string_split(path, '/')[-1], 'S[^/]*7\\.cs')")
def in_files_named(c):
    return D.in_files_named(c.table("documents"), "S*7.cs").select("document_id")


@pair("SELECT start FROM type_parts WHERE namespace IN ('Corpus.SMALL', 'Corpus.PROMO')")
def in_namespace_and_type(c):
    rows = c.table("type_parts")
    return rows.where(D.is_in_namespace("Corpus.SMALL.**") | D.is_in_type("Corpus.PROMO", column="namespace")).select("start")


@pair("SELECT symbol FROM members JOIN (SELECT context_id FROM type_parts WHERE symbol = 't17' GROUP BY context_id) USING (context_id)")
def in_projects_with_type(c):
    available = c.table("type_parts").select("context_id", F.col("symbol").alias("type_key"))
    return D.in_projects_with_type(c.table("members"), available, "t17").select("symbol")


@pair("SELECT context_id, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS type_state FROM (SELECT c.context_id, count(t.symbol) AS n FROM contexts c LEFT JOIN type_parts t ON t.context_id = c.context_id AND t.symbol = 't3' GROUP BY c.context_id)")
def inspect_type(c):
    available = c.table("type_parts").select("context_id", F.col("symbol").alias("type_key"))
    return facts.with_type(c.table("contexts"), available, "t3").select("context_id", "type_state")


@pair("SELECT context_id FROM contexts WHERE context_id IN (SELECT context_id FROM docs WHERE file_identity IN ('f3', 'f9'))")
def references_package(c):
    packages = c.table("documents").select("context_id", F.upper("file_identity").alias("id"))
    return D.references_package(c.table("contexts"), packages, "f3").select("context_id").unionByName(D.references_package(c.table("contexts"), packages, "F9").select("context_id")).distinct()


def variables(c: Facts) -> DataFrame:
    """Members as variables."""
    return c.table("members").select("symbol", "start", (F.col("start") % 2 == 0).alias("has_explicit_type"), (F.col("start") % 3 == 0).alias("has_initializer"), (F.col("start") % 4).alias("reads"), (F.col("start") % 5 == 0).alias("is_var_safe"), (F.col("start") % 7 == 0).alias("is_top_level"), (F.col("start") % 3 == 1).alias("has_else"), (F.col("start") % 2 == 1).alias("has_braces"))


@pair("SELECT symbol FROM members WHERE start % 6 = 0 AND start % 4 = 1 % 4 OR start % 35 = 0")
def style_of_variables(c):
    rows = variables(c)
    one = D.with_single_read(D.with_initializer(D.with_explicit_type(rows)))
    two = D.where_var_preserves_type(D.top_level(rows))
    return one.unionByName(two).select("symbol").distinct()


@pair("SELECT symbol, 'then' AS branch FROM members WHERE start % 2 = 0 UNION ALL SELECT symbol, 'else' FROM members WHERE start % 2 = 0 AND start % 3 = 1")
def branches_without_braces(c):
    return D.branches(D.without_braces(variables(c))).select("symbol", "branch")


@pair("SELECT symbol FROM members WHERE start % 3 = 1")
def with_else(c):
    return D.with_else(variables(c)).select("symbol")


@pair("SELECT symbol, CASE WHEN body_kind IS NULL THEN 'Missing' WHEN body_kind = 'expression' THEN 'Expression' WHEN n_statements = 0 THEN 'EmptyBlock' ELSE 'NonEmptyBlock' END AS shape FROM members WHERE shape IN ('Missing', 'EmptyBlock')")
def where_body(c):
    rows = c.table("members").withColumn("shape", D.body_shape(F.col("body_kind"), F.col("n_statements")))
    return D.where_body(rows, D.MISSING).unionByName(D.where_body(rows, D.EMPTY)).select("symbol", "shape")


@pair("SELECT symbol, CASE n_statements WHEN 1 THEN 'one' ELSE 'three' END AS message FROM members WHERE n_statements IN (1, 3)")
def checks(c):
    conditions = c.table("members").withColumn("pattern", F.concat(F.lit("p"), F.col("n_statements").cast("string")))
    patterns = conditions.sparkSession.createDataFrame([("p1", "one"), ("p3", "three")], "pattern string, message string")
    return D.checks(conditions, patterns).select("symbol", "message")


@pair("SELECT DISTINCT context_id, owner FROM members WHERE kind = 'method'")
def containing_types(c):
    return D.containing_types(c.table("members").where("kind = 'method'"))


# Symbols and relations ----------------------------------------------------------


@pair("SELECT symbol FROM members m JOIN lineage l ON l.type = m.type_key WHERE l.ancestor = 't1' AND depth >= 1")
def derives_from(c):
    return D.is_or_derives_from(c.table("members"), lineage(c), "t1", strict=True).select("symbol")


@pair("SELECT symbol FROM members m JOIN lineage l ON l.type = m.type_key WHERE l.ancestor = 't1'")
def is_or_derives_from(c):
    return D.is_or_derives_from(c.table("members"), lineage(c), "t1").select("symbol")


@pair("SELECT symbol FROM members m JOIN lineage l ON l.type = m.type_key WHERE l.ancestor = 't3' AND depth >= 1 AND l.ancestor IN (SELECT base FROM bases WHERE is_interface)")
def implementing_interface(c):
    return D.implementing(c.table("members"), c.table("bases"), lineage(c), "t3").select("symbol")


def attributes(c: Facts) -> DataFrame:
    """Every member carries the attribute that its type is."""
    return c.table("members").select("context_id", "symbol", F.col("type_key").alias("attribute_type"))


@pair("SELECT symbol FROM members m JOIN lineage l ON l.type = m.type_key WHERE l.ancestor IN ('t2')")
def with_attribute(c):
    return facts.with_attribute(c.table("members"), attributes(c), lineage(c), ["t2"]).select("symbol")


@pair("SELECT symbol FROM members WHERE type_key IN ('t2', 't5')")
def has_attribute(c):
    return D.has_attribute(c.table("members"), attributes(c), "t2", "t5").select("symbol")


def overrides(c: Facts) -> DataFrame:
    """Member k overrides k div 2 in its first context, step by step."""
    rows = c.table("members").where("start >= 1").select("context_id", "symbol", F.concat(F.lit("m"), F.expr("start div 2").cast("string")).alias("overridden"), F.lit(1).alias("distance"))
    two = rows.select("context_id", "symbol", F.concat(F.lit("m"), F.expr("cast(substr(overridden, 2) as bigint) div 2").cast("string")).alias("overridden"), F.lit(2).alias("distance")).where("symbol <> 'm1'")
    return rows.unionByName(two)


@pair("SELECT symbol FROM members WHERE start >= 1 AND start // 2 IN (3, 8) OR start >= 2 AND start // 2 // 2 IN (3, 8)")
def implements_or_overrides(c):
    return D.implements_or_overrides(c.table("members"), overrides(c), ["m3", "m8"]).select("symbol")


@pair("SELECT symbol, 'm' || (start // 2) AS overridden FROM members WHERE kind = 'method' AND start >= 1")
def directly_overriding(c):
    return D.overriding(c.table("members").where("kind = 'method'"), overrides(c), direct=True).select("symbol", "overridden")


@pair("SELECT t.ancestor AS symbol FROM lineage t WHERE t.type = 't77'")
def declared_in_or_above(c):
    containers = lineage(c).select(F.col("type").alias("symbol"), "ancestor")
    rows = lineage(c).select(F.col("type").alias("symbol")).distinct()
    return D.declared_in_or_above(rows, containers, "t77").select("symbol")


@pair("SELECT symbol FROM members WHERE n_statements = 2 AND type_key <> 't0'")
def event_handlers(c):
    rows = c.table("members").withColumns({"parameters": F.when(F.col("n_statements") == 2, F.array(F.lit("object"), F.lit("ClickEventArgs"))).otherwise(F.array(F.lit("object"))), "result": F.when(F.col("type_key") == "t0", "int").otherwise("void")})
    return rows.where(D.is_event_handler(F.col("parameters"), F.col("result"))).select("symbol")


@pair("SELECT DISTINCT context_id, document_id FROM type_parts WHERE symbol IN ('t1', 't2')")
def files_of(c):
    return D.files_of(c.table("type_parts").where("symbol in ('t1', 't2')"), c.table("type_parts"))


@pair("SELECT DISTINCT context_id, caller FROM calls WHERE is_resolved AND target IN ('m1', 'm7')")
def callers_of(c):
    return D.callers_of(c.table("calls"), c.table("calls").where("target in ('m1', 'm7')"))


@pair("SELECT call_id FROM calls JOIN (SELECT DISTINCT context_id, symbol AS caller FROM members WHERE kind = 'field') USING (context_id, caller)")
def calls_from(c):
    return D.calls_from(c.table("calls"), c.table("members").where("kind = 'field'").select("context_id", F.col("symbol").alias("caller"))).select("call_id")


@pair("SELECT m.symbol FROM members m JOIN contexts c USING (context_id) JOIN (SELECT DISTINCT document_id, start FROM type_parts) t ON t.document_id = m.document_id AND t.start = m.start WHERE c.name LIKE 'NATION_1%'")
def declared_in_project(c):
    rows = c.table("members").withColumnsRenamed({"document_id": "decl_file", "start": "decl_start"})
    reached = c.table("type_parts").select(F.col("document_id").alias("decl_file"), F.col("start").alias("decl_start"))
    found = None
    for name in [f"NATION_1{k}" for k in ("", *range(10))]:
        own = D.declared_in_project(reached, rows, c.table("contexts"), name).select("symbol")
        found = own if found is None else found.unionByName(own)
    return found


# Calls and expressions ------------------------------------------------------------


@pair("SELECT call_id FROM calls WHERE is_resolved AND name = 'HIGH' AND NOT in_expression_tree AND NOT in_nameof")
def call_filters(c):
    return E.outside_nameof(E.outside_expression_trees(E.to_methods_named(c.table("calls"), "HIGH"))).select("call_id")


@pair("SELECT call_id FROM calls WHERE is_resolved AND name LIKE '%IGH%'")
def to_methods_matching(c):
    return E.to_methods_matching(c.table("calls"), "*IGH*").select("call_id")


@pair("SELECT call_id FROM calls JOIN lineage ON owner = type WHERE is_resolved AND ancestor = 't2'")
def to_methods_declared_on_derived(c):
    return E.to_methods_declared_on(c.table("calls"), "t2", lineage=lineage(c)).select("call_id")


@pair("SELECT call_id FROM calls JOIN lineage ON receiver_type = type WHERE ancestor = 't2'")
def on_receiver_of_type(c):
    return E.on_receiver_of_type(c.table("calls"), lineage(c), "t2").select("call_id")


@pair("SELECT call_id FROM calls WHERE is_resolved AND (owner, name) IN (('t1', 'HIGH'), ('t2', 'LOW'))")
def calls_to(c):
    api = D.union_api([("t1", "HIGH")], [("t2", "LOW"), ("t1", "HIGH")])
    members = c.table("calls").sparkSession.createDataFrame(api, "owner string, name string")
    return facts.calls_to(c.table("calls"), members).select("call_id")


@pair("SELECT call_id FROM calls WHERE call_id IN (SELECT call_id FROM arguments WHERE parameter = 'A' AND value_start IS NULL)")
def where_any_argument(c):
    return E.where_any_argument(c.table("calls"), c.table("arguments"), (F.col("parameter") == "A") & F.col("value_start").isNull()).select("call_id")


@pair("SELECT call_id FROM calls WHERE call_id IN (SELECT call_id FROM arguments WHERE parameter = 'R' AND has_value)")
def where_receiver(c):
    return E.where_receiver(c.table("calls"), c.table("arguments"), (F.col("parameter") == "R") & F.col("has_value")).select("call_id")


@pair("SELECT call_id, ordinal, parameter FROM arguments JOIN calls USING (call_id) WHERE is_resolved AND parameter_type IN ('t1', 't3')")
def arguments_of_types(c):
    return E.arguments_of_types(c.table("calls"), c.table("arguments"), "t1", "t3").select("call_id", "ordinal", "parameter")


@pair("SELECT call_id, ordinal FROM arguments JOIN calls USING (call_id) WHERE is_resolved AND parameter IN ('A', 'N')")
def arguments_for(c):
    return facts.arguments_for(c.table("calls"), c.table("arguments"), "A", "N").select("call_id", "ordinal")


@pair("SELECT call_id, string_agg(parameter, ',' ORDER BY value_start, parameter) AS inputs FROM arguments WHERE value_start IS NOT NULL GROUP BY call_id")
def evaluation_inputs(c):
    return E.evaluation_inputs(c.table("arguments")).select("call_id", F.array_join("inputs", ",").alias("inputs"))


def references(c: Facts) -> DataFrame:
    """A reference at the second place of every call."""
    return c.table("calls").select("context_id", "document_id", F.col("call_id").alias("ref_id"), (F.col("start") + 2).alias("outer_start"), F.lit(1).alias("outer_length"), "owner", "name", F.col("target").alias("member"))


@pair("SELECT call_id AS ref_id FROM calls WHERE call_id IN (SELECT call_id FROM arguments WHERE ordinal = 2 AND value_start IS NOT NULL AND parameter = 'A')")
def passed_as(c):
    return E.passed_as(references(c), c.table("calls"), c.table("arguments"), "A").select("ref_id")


@pair("SELECT c.call_id AS ref_id, a.parameter FROM calls c LEFT JOIN (SELECT DISTINCT call_id, parameter FROM arguments WHERE ordinal = 2 AND value_start IS NOT NULL) a ON a.call_id = c.call_id")
def as_argument(c):
    return E.as_argument(references(c), c.table("calls"), c.table("arguments")).select("ref_id", "parameter").distinct()


@pair("SELECT call_id AS ref_id FROM calls WHERE owner = 't4' AND name = 'LOW' OR owner = 't5' AND name = 'HIGH'")
def references_to_members(c):
    return E.references_to_members(references(c), [("t4", "LOW"), ("t5", "HIGH")]).select("ref_id")


def creations(c: Facts) -> DataFrame:
    return c.table("arguments").select("call_id", "ordinal", F.concat("parameter_type", F.lit("<"), "parameter", F.lit(">")).alias("type_key"), F.col("parameter_type").alias("definition"), F.col("has_value").alias("to_collection"))


@pair("SELECT call_id, ordinal FROM arguments WHERE parameter_type = 't1' AND parameter = 'R' UNION ALL SELECT call_id, ordinal FROM arguments WHERE parameter_type = 't2' AND has_value")
def creations_of(c):
    rows = creations(c)
    return E.creations_of(rows, "t1<R>").unionByName(E.with_collection_target(E.creations_of(rows, "t2", is_open=True))).select("call_id", "ordinal")


def bodies(c: Facts) -> DataFrame:
    """A body over ten calls' places, and one over the five in its middle."""
    place = c.table("calls").where("start % 10000 = 0").select("context_id", "document_id", "start", F.col("call_id"))
    one = place.select("context_id", "document_id", F.concat(F.lit("b"), "call_id").alias("body_id"), F.col("start").alias("o_start"), (F.col("start") + 9_000).alias("o_end"))
    two = place.select("context_id", "document_id", F.concat(F.lit("i"), "call_id").alias("body_id"), (F.col("start") + 2_000).alias("o_start"), (F.col("start") + 7_000).alias("o_end"))
    return one.unionByName(two)


BODIES = """, bodies AS (
  SELECT context_id, document_id, 'b' || call_id AS body_id, start AS o_start, start + 9000 AS o_end FROM calls WHERE start % 10000 = 0
  UNION ALL SELECT context_id, document_id, 'i' || call_id, start + 2000, start + 7000 FROM calls WHERE start % 10000 = 0
)
"""


@pair(BODIES + "SELECT DISTINCT body_id FROM bodies b JOIN calls c USING (context_id, document_id) WHERE is_resolved AND owner = 't4' AND name = 'LOW' AND o_start <= start AND o_end >= start + 50")
def bodies_calling(c):
    return E.bodies_calling(bodies(c), c.table("calls"), "t4", "LOW").select("body_id")


@pair(BODIES + "SELECT DISTINCT call_id FROM bodies b JOIN calls c USING (context_id, document_id) WHERE o_start <= start AND o_end >= start + 50")
def calls_within_bodies(c):
    return D.within_scopes(c.table("calls"), bodies(c), ["call_id"]).select("call_id")


@pair(BODIES + """SELECT DISTINCT call_id FROM bodies b JOIN calls c USING (context_id, document_id) WHERE body_id LIKE 'b%' AND o_start <= start AND o_end >= start + 50
  AND NOT EXISTS (SELECT 1 FROM bodies i WHERE i.body_id LIKE 'i%' AND i.document_id = c.document_id AND i.o_start <= c.start AND i.o_end >= c.start + 50)""")
def calls_outside_nested_functions(c):
    whole = bodies(c)
    return D.within_scopes(c.table("calls"), whole.where("body_id like 'b%'"), ["call_id"], nested=whole.where("body_id like 'i%'")).select("call_id")


@pair(BODIES + "SELECT DISTINCT context_id, document_id, start FROM bodies b JOIN calls c USING (context_id, document_id) WHERE o_start <= start AND o_end >= start + 50")
def null_checks_in(c):
    return E.null_checks_in(c.table("calls").select("context_id", "document_id", "start", "length"), bodies(c)).select("context_id", "document_id", "start")


def as_expressions(c: Facts) -> DataFrame:
    return c.table("arguments").select("call_id", "ordinal", "value_start", F.col("parameter_type").alias("type_key"), F.lit("t1").alias("converted_type"), F.col("parameter").alias("refers_to"), "has_value", F.lit("int").alias("constant_type"), F.when(F.col("ordinal") != 3, F.col("value")).alias("value"))


@pair("SELECT call_id, ordinal FROM arguments WHERE parameter IN ('A', 'R') AND parameter_type IN ('t2', 't3')")
def expression_predicates(c):
    return E.type_is(E.type_is(E.refers_to(as_expressions(c), "A", "R"), "t2", "t3"), "t1", converted=True).select("call_id", "ordinal")


@pair("SELECT call_id, ordinal FROM arguments JOIN lineage ON parameter_type = type WHERE ancestor = 't1'")
def type_is_assignable_to(c):
    return E.type_is_assignable_to(as_expressions(c), lineage(c), "t1").select("call_id", "ordinal")


@pair("SELECT call_id, ordinal, CASE WHEN has_value AND ordinal <> 3 THEN CAST(value AS INTEGER) END AS number, has_value AND ordinal = 3 AS is_null, value_start IS NULL OR (has_value AND ordinal <> 3 AND value = '7') AS omitted_or_7 FROM arguments")
def typed_constants(c):
    rows = as_expressions(c)
    return rows.select("call_id", "ordinal", E.value_as("int", "int").alias("number"), E.is_value("int", None).alias("is_null"), E.is_omitted_or(F.col("value_start"), "int", 7).alias("omitted_or_7"))


@pair("SELECT call_id, ordinal, parameter FROM arguments JOIN calls USING (call_id) WHERE value_start IS NOT NULL")
def argument_expressions(c):
    written = c.table("arguments").join(c.table("calls").select("call_id", "context_id", "document_id"), "call_id").where("value_start is not null")
    spans = written.select("context_id", "document_id", F.col("value_start").alias("start"), F.col("value_length").alias("length")).distinct()
    return E.argument_expressions(c.table("calls"), c.table("arguments"), spans).select("call_id", "ordinal", "parameter")


@pair("SELECT call_id FROM calls WHERE is_resolved")
def awaited_calls(c):
    waits = c.table("calls").select("context_id", "document_id", F.col("start").alias("operand_start"), F.col("length").alias("operand_length"), F.col("is_resolved").alias("is_awaited"))
    return E.awaited_calls(waits, c.table("calls")).select("call_id")


@pair("SELECT call_id, owner FROM calls WHERE name = 'MEDIUM'")
def as_invocation(c):
    wanted = c.table("calls").where("name = 'MEDIUM'").select("context_id", "document_id", "start", "length", "owner")
    return E.as_invocation(wanted, c.table("calls")).select("call_id", "owner")


@pair("""SELECT chain, CAST(row_number() OVER (PARTITION BY chain ORDER BY k DESC) AS INTEGER) AS position, 'c' || k AS call FROM (
  SELECT 'c' || last AS chain, k FROM (SELECT CAST(substr(call_id, 2) AS BIGINT) AS k, CAST(substr(call_id, 2) AS BIGINT) // 4 * 4 AS last FROM calls))""")
def call_chains(c):
    return graph.call_chains(c.table("calls").select(F.col("call_id").alias("call"), "receiver_call").join(c.table("calls").select(F.col("call_id").alias("receiver_call"), F.lit(True).alias("there")), "receiver_call", "left").select("call", F.when(F.col("there"), F.col("receiver_call")).alias("receiver_call")))


# Handlers and comments --------------------------------------------------------------


def regions(c: Facts) -> DataFrame:
    """A function over each hundred places of a document, a try block in it, a catch clause behind that, a try block within the clause."""
    base = c.table("calls").select("document_id", (F.floor(F.col("start") / 10_000) * 10_000).alias("at")).distinct()
    made = [("function", 0, 9_900, False), ("try", 1_000, 4_900, True), ("catch", 5_000, 7_900, False), ("try", 6_000, 6_900, True), ("finally", 8_000, 8_900, False)]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(x).alias("catches_any")) for k, a, b, x in made])
    return base.select("document_id", "at", F.inline(kinds)).select("document_id", (F.col("at") + F.col("a")).alias("o_start"), (F.col("at") + F.col("b")).alias("o_end"), "kind", "catches_any")


@pair("""SELECT call_id, k BETWEEN 1000 AND 4850 OR k BETWEEN 6000 AND 6850 AS is_guarded,
  CASE WHEN k BETWEEN 6000 AND 6850 THEN 'None' WHEN k BETWEEN 5000 AND 7850 THEN 'Catch' WHEN k BETWEEN 8000 AND 8850 THEN 'Finally' ELSE 'None' END AS unguarded_handler FROM (SELECT call_id, start % 10000 AS k FROM calls)""")
def handler_of(c):
    spans = c.table("calls").select("call_id", "document_id", "start", (F.col("start") + 50).alias("end"))
    return D.handler_of(spans, regions(c), ["call_id"]).select("call_id", "is_guarded", "unguarded_handler")


@pair("SELECT symbol FROM members WHERE n_statements = 0 OR type_key = 't2' OR type_key IN ('t4')")
def catch_predicates(c):
    rows = c.table("members").select("symbol", (F.col("n_statements") != 0).alias("has_declaration"), F.when(F.col("type_key") == "t2", "System.Exception").when(F.col("type_key") == "t4", "Own").alias("exception_type"))
    return rows.where(D.catches_any(rows)).unionByName(D.catching(rows, "Own")).select("symbol").distinct()


@pair("""SELECT symbol, CASE WHEN n_statements IN (1, 2) THEN 'on' WHEN n_statements = 3 THEN 'above' WHEN n_statements = 4 AND start % 3 = 0 THEN 'owner' END AS explanation FROM members""")
def explanatory_comments(c):
    rows = c.table("members").select("symbol", F.col("symbol").alias("document_id"), F.lit(10).alias("line"), F.when(F.col("start") % 3 == 0, 5).otherwise(10).alias("owner_line"), "n_statements", "start")
    made = F.when(F.col("n_statements") == 1, F.struct(F.lit(10).alias("line"), F.lit(10).alias("last_line"), F.lit(False).alias("is_whole_line"), F.lit("on").alias("text"))).when(F.col("n_statements") == 2, F.struct(F.lit(8).alias("line"), F.lit(10).alias("last_line"), F.lit(True).alias("is_whole_line"), F.lit("on").alias("text")))
    made = made.when(F.col("n_statements") == 3, F.struct(F.lit(9).alias("line"), F.lit(9).alias("last_line"), F.lit(True).alias("is_whole_line"), F.lit("above").alias("text"))).when(F.col("n_statements") == 4, F.struct(F.lit(4).alias("line"), F.lit(4).alias("last_line"), F.lit(True).alias("is_whole_line"), F.lit("owner").alias("text")))
    comments = rows.select("document_id", F.lit("comment").alias("kind"), F.lit(0).alias("start"), made.alias("c")).where("c is not null").select("document_id", "kind", "start", "c.*")
    allowed = comments.withColumns({"text": F.lit("// rule-allow A: x"), "start": F.lit(-1)})
    return D.explanatory_comments(rows, comments.unionByName(allowed)).select("symbol", "explanation")


# Overloads, signatures, scopes, properties, keys --------------------------------------


def methods(c: Facts) -> DataFrame:
    """Ten overloads of each owner and segment: the first parameters of a list."""
    given = F.slice(F.array(*[F.lit(x) for x in ("int", "string", "Token", "int")]), F.lit(1), (F.col("start") % 4 + 1).cast("int"))
    return c.table("members").select(F.lit("x").alias("context_id"), F.lit("o").alias("owner"), F.col("type_key").alias("name"), "symbol", given.alias("parameters"), F.lit("void").alias("result"), "start")


@pair("""SELECT a.symbol, b.symbol AS overload, CAST(2 AS INTEGER) AS position FROM members a JOIN members b ON a.type_key = b.type_key WHERE a.start < 400 AND b.start < 400 AND a.start % 4 = 1 AND b.start % 4 = 2""")
def overloads_adding(c):
    return facts.overloads_adding(methods(c).where("start < 400"), "Token").select("symbol", "overload", "position")


@pair("SELECT symbol FROM members WHERE start % 4 = 1 AND type_key = 't3'")
def matches_signature(c):
    return methods(c).where(facts.matches_signature(owner="o", name="t3", parameters=["int", "string"])).select("symbol")


@pair("""SELECT call_id AS use_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY o_end - o_start, o_start DESC, body_id) AS INTEGER) AS rank, body_id AS name FROM """ + "(SELECT call_id, start, b.* FROM calls c JOIN (SELECT document_id, 'b' || call_id AS body_id, start AS o_start, start + 9000 AS o_end FROM calls WHERE start % 10000 = 0 UNION ALL SELECT document_id, 'i' || call_id, start + 2000, start + 7000 FROM calls WHERE start % 10000 = 0) b ON b.document_id = c.document_id AND o_start <= start AND start < o_end)")
def values_in_scope(c):
    uses = c.table("calls").select("document_id", F.col("call_id").alias("use_id"), F.col("start").alias("at"))
    values = bodies(c).select("document_id", F.col("body_id").alias("name"), F.col("o_start").alias("scope_start"), F.col("o_end").alias("scope_end"), F.col("o_start").alias("declared_at"))
    return facts.values_in_scope(uses, values).select("use_id", "rank", "name")


@pair("""SELECT type, owner, name, string_agg(DISTINCT seed, ',' ORDER BY seed) AS reached_from FROM (
  SELECT seed, l.type, l.ancestor AS owner, m.name, l.depth FROM (SELECT 't' || k AS type, 's' || (k % 2) AS seed FROM range(100, 140) r(k) UNION ALL SELECT 't120', 's9') s JOIN lineage l USING (type) JOIN (SELECT DISTINCT owner AS ancestor, name FROM members WHERE kind = 'property') m USING (ancestor)
  QUALIFY row_number() OVER (PARTITION BY seed, l.type, m.name ORDER BY l.depth, l.ancestor) = 1) GROUP BY type, owner, name""")
def property_views(c):
    spark = c.table("members").sparkSession
    reached = spark.range(100, 140).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("type"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("seed")).unionByName(spark.createDataFrame([("t120", "s9")], "type string, seed string"))
    properties = c.table("members").where("kind = 'property'").select("owner", "name").distinct().withColumns({"path": F.lit("p"), "project": F.lit("x"), "start": F.lit(0)})
    return facts.property_views(reached, properties, lineage(c)).select("type", "owner", "name", F.array_join("reached_from", ",").alias("reached_from"))


@pair("""SELECT k.call_id AS key_id, CASE WHEN n1 = 1 AND n2 = 1 THEN a.symbol || '.' || b.symbol END AS path
  FROM (SELECT call_id, 't' || (start // 100 % 300) AS type FROM calls) k
  LEFT JOIN (SELECT owner, count(*) AS n1, min(symbol) AS symbol, min(type_key) AS type_key FROM members WHERE kind = 'property' GROUP BY owner) a ON a.owner = k.type
  LEFT JOIN (SELECT owner, count(*) AS n2, min(symbol) AS symbol FROM members WHERE kind = 'property' GROUP BY owner) b ON b.owner = a.type_key AND n1 = 1""")
def resolve_keys(c):
    keys = c.table("calls").select(F.col("call_id").alias("key_id"), F.concat(F.lit("t"), (F.expr("start div 100") % 300).cast("string")).alias("type"), text.member_path(F.lit("P.P")).alias("segments"))
    members = c.table("members").where("kind = 'property'").select("owner", F.lit("P").alias("name"), F.col("symbol").alias("member"), F.col("type_key").alias("result"))
    return facts.resolve_keys(keys, members).select("key_id", F.array_join("path", ".").alias("path"))


@pair("SELECT symbol, 'm' || (start - start % 10) AS outer FROM members WHERE start - start % 10 IN (SELECT start FROM members)")
def without_conversions(c):
    parents = c.table("members").select(F.col("symbol").alias("id"), F.concat(F.lit("m"), (F.col("start") - 1).cast("string")).alias("parent"), (F.col("start") % 10 != 0).alias("skipped"))
    return facts.follow_parents(c.table("members").select(F.col("symbol").alias("id")), parents, F.col("skipped")).select(F.col("id").alias("symbol"), "outer").where("outer is not null")


@pair("SELECT symbol, CASE start % 3 WHEN 0 THEN type_key WHEN 1 THEN NULL ELSE 'int' END AS result FROM members")
def unwrap_task(c):
    own = F.when(F.col("start") % 3 == 0, F.concat(F.lit("Task<"), "type_key", F.lit(">"))).when(F.col("start") % 3 == 1, "Task").otherwise("int")
    return c.table("members").select("symbol", facts.unwrap_task(own).alias("result"))


@pair("SELECT symbol, CASE WHEN start % 5 = 0 THEN 'Unknown' WHEN start % 2 = 0 THEN 'Match' ELSE 'Different' END AS compared FROM members")
def compare_paths(c):
    left = text.member_path(F.lit("Items[0].Name"))
    right = text.member_path(F.when(F.col("start") % 2 == 0, "Items[0].Name").otherwise("Items[1].Name"))
    return c.table("members").select("symbol", text.compare_paths(left, right, F.col("start") % 5 != 0).alias("compared"))


@pair("SELECT type_key, count(DISTINCT start % 4 || CASE WHEN start % 3 = 0 THEN 'none' ELSE CAST(start % 2 AS VARCHAR) END) AS n FROM members GROUP BY type_key")
def constant_keys(c):
    value = F.when(F.col("start") % 3 != 0, (F.col("start") % 2).cast("string"))
    keyed = c.table("members").select("type_key", text.constant_key((F.col("start") % 4).cast("string"), F.lit(True), value).alias("k"))
    return keyed.distinct().groupBy("type_key").agg(F.count(F.lit(1)).alias("n"))


@pair("SELECT symbol FROM members WHERE start % 2 = 0")
def starts_with_text(c):
    segments = F.array(F.struct(F.lit("text").alias("kind"), F.lit("ab").alias("text")), F.struct(F.when(F.col("start") % 2 == 0, "text").otherwise("hole").alias("kind"), F.lit("c").alias("text")))
    return c.table("members").where(text.starts_with_text(segments, "abc")).select("symbol")


@pair("SELECT symbol, CASE WHEN n_statements = 1 THEN 'Oblivious' WHEN n_statements = 2 THEN 'Unknown' ELSE 'Aware' END AS origin FROM members")
def nullable_origins(c):
    made = F.when(F.col("n_statements") == 1, F.array(F.lit("Aware"), F.lit("Oblivious"), F.lit("Unknown"))).when(F.col("n_statements") == 2, F.array(F.lit("Aware"), F.lit("Unknown"))).otherwise(F.array(F.lit("Aware")))
    return c.table("members").select("symbol", graph.severity_of(made).alias("origin"))


@pair("SELECT symbol, start % 6 IN (0, 2) AS compares, start % 6 IN (1, 3) AS formats, start % 6 = 4 AS waits FROM members")
def framework_calls(c):
    none, text_ = F.array().cast("array<string>"), F.array(F.lit("string"))
    pick = lambda *xs: F.element_at(F.array(*xs), (F.col("start") % 6 + 1).cast("int"))
    lit = lambda *xs: pick(*[F.lit(x) for x in xs])
    rows = c.table("members").select(
        "symbol", lit("string", "double", "System.Linq.Enumerable", "System.DateTime", E.TASK, "System.DateTime").alias("owner"), lit("StartsWith", "Parse", "OrderBy", "ToString", "Delay", "ToString").alias("name"),
        pick(text_, text_, none, none, text_, text_).alias("parameters"), F.lit("string").alias("key_type"), F.lit(True).alias("has_provider_overload"), F.lit("o").alias("format"), F.lit(False).alias("receiver_has_clock"))
    return rows.select("symbol", E.compares_with_culture().alias("compares"), E.formats_with_culture().alias("formats"), E.waits_without_clock().alias("waits"))


@pair("SELECT symbol FROM members WHERE start % 3 = 0 OR start % 3 = 1 AND start % 2 = 0")
def times_without_clock(c):
    given = F.when(F.col("start") % 2 == 0, F.array(F.lit("int"))).otherwise(F.array().cast("array<string>"))
    made = F.when(F.col("start") % 3 == 0, "System.Threading.Timer").when(F.col("start") % 3 == 1, E.CANCELLATION).otherwise("Own")
    return c.table("members").select("symbol", made.alias("type_key"), given.alias("parameters")).where(E.times_without_clock()).select("symbol")


# Tests -------------------------------------------------------------------------------


@pair("""SELECT symbol FROM members m WHERE type_key = 't2' OR EXISTS (SELECT 1 FROM (
    WITH RECURSIVE up(context_id, symbol, base) AS (SELECT context_id, symbol, start // 2 FROM members WHERE start >= 1 UNION SELECT u.context_id, u.symbol, b.start // 2 FROM up u JOIN members b ON b.context_id = u.context_id AND b.start = u.base WHERE b.start >= 1)
    SELECT * FROM up) u JOIN members b ON b.context_id = u.context_id AND b.start = u.base WHERE u.symbol = m.symbol AND u.context_id = m.context_id AND b.type_key = 't2')""")
def test_methods(c):
    spark = c.table("members").sparkSession
    markers = spark.createDataFrame([("t2", True)], "attribute_type string, inherited boolean")
    own = facts.ancestors(spark.createDataFrame([("t2", "t1")], "type string, base string"))
    return facts.test_methods(c.table("members"), attributes(c), own, overrides(c).where("distance = 1").drop("distance"), markers).select("symbol")


@pair("""SELECT DISTINCT t.context_id, t.symbol FROM type_parts t JOIN lineage l ON l.type = t.symbol JOIN members m ON m.owner = l.ancestor AND m.context_id = t.context_id WHERE m.kind = 'method'""")
def test_classes(c):
    tests = c.table("members").where("kind = 'method'").select("context_id", "symbol", "owner")
    none = c.table("members").select("context_id", "owner", F.col("symbol").alias("overridden")).limit(0)
    classes = c.table("type_parts").select("context_id", "symbol").distinct()
    return facts.test_classes(classes, tests, lineage(c), none)


@pair("SELECT DISTINCT t.context_id, t.symbol FROM type_parts t JOIN lineage l ON l.type = t.symbol JOIN members m ON m.owner = l.ancestor AND m.context_id = t.context_id WHERE m.kind = 'method' AND t.start % 2 = 0")
def abstract_test_classes(c):
    tests = c.table("members").where("kind = 'method'").select("context_id", "symbol", "owner")
    none = c.table("members").select("context_id", "owner", F.col("symbol").alias("overridden")).limit(0)
    classes = c.table("type_parts").select("context_id", "symbol", (F.col("start") % 2 == 0).alias("is_abstract")).distinct()
    return facts.test_classes(classes, tests, lineage(c), none, abstract=True).select("context_id", "symbol")


@pair("SELECT view, interface, type FROM (SELECT DISTINCT context_id AS view, 'i' || (start % 3) AS interface FROM members) v LEFT JOIN (SELECT context_id AS view, 'i0' AS interface, symbol AS type FROM members WHERE kind = 'field') m USING (view, interface)")
def implementation_views(c):
    views = c.table("members").select(F.concat(F.lit("i"), (F.col("start") % 3).cast("string")).alias("interface"), F.col("context_id").alias("view_id")).distinct()
    made = c.table("members").where("kind = 'field'").select(F.lit("i0").alias("interface"), F.col("context_id").alias("view_id"), F.col("symbol").alias("type"))
    return facts.implementation_views(views, made).select(F.col("view_id").alias("view"), "interface", "type")


# Graphs -------------------------------------------------------------------------------


@pair("SELECT DISTINCT parameter_type AS seed FROM arguments JOIN calls USING (call_id) WHERE is_resolved AND parameter = 'A' AND name = 'HIGH' UNION SELECT type_key FROM members WHERE kind = 'enum_member' UNION SELECT NULL")
def type_seeds(c):
    passed = E.types_passed_as(c.table("calls").where("name = 'HIGH'"), c.table("arguments").withColumn("type_key", F.col("parameter_type")), "A")
    declared = E.types_declared_by(c.table("members").where("kind = 'enum_member'"))
    lost = c.table("members").select(F.lit(None).cast("string")).limit(1)
    return graph.seeds_of(passed, declared, lost)


def type_graph(c: Facts) -> DataFrame:
    """Edges from each type to its two halves below, in order."""
    return c.table("bases").select(F.col("base").alias("src"), F.col("type").alias("dst"), F.expr("cast(substr(type, 2) as int)").alias("ordinal"))


@pair("""SELECT seed, node, CAST(depth AS INTEGER) AS depth, CAST(4 AS INTEGER) AS status FROM (
  SELECT 't' || s AS seed, 't' || k AS node, CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) AS depth, k, s FROM range(1, 5) a(s) JOIN range(1, 500) b(k) ON k >> CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) = s AND k >= s
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY k) <= 10)""")
def traverse_state_limit(c):
    spark = c.table("bases").sparkSession
    seeds = spark.range(1, 5).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("seed"))
    return graph.traverse(seeds, type_graph(c), most_states=10)


@pair("""SELECT 't' || s AS seed, CAST(0 AS INTEGER) AS status, string_agg('t' || k, ',' ORDER BY floor(log2(k)), 't' || k) AS nodes FROM range(100, 110) a(s) LEFT JOIN range(1, 500) b(k) ON k >= s AND k >> CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) = s AND k % 2 = 0 GROUP BY s""")
def where_type(c):
    spark = c.table("bases").sparkSession
    seeds = graph.seeds_of(spark.range(100, 105).select(F.concat(F.lit("t"), F.col("id").cast("string"))), spark.range(103, 110).select(F.concat(F.lit("t"), F.col("id").cast("string"))))
    found = graph.where_type(graph.traverse(seeds, type_graph(c)), F.expr("cast(substr(node, 2) as int) % 2 = 0"))
    return found.select("seed", "status", F.nullif(F.array_join("nodes", ","), F.lit("")).alias("nodes"))


@pair("SELECT ancestor AS src, type AS dst FROM lineage WHERE depth >= 1 AND type NOT LIKE '%0' AND ancestor NOT LIKE '%0' QUALIFY row_number() OVER (PARTITION BY type ORDER BY depth) = 1")
def type_edges_skipping(c):
    hidden = c.table("bases").select("type").where("cast(substr(type, 2) as int) % 10 = 0")
    return graph.type_edges(type_graph(c).where("src <> 't0'"), skip=hidden).select("src", "dst").distinct()


@pair("SELECT 't' || (k // 2) AS src, CASE WHEN k % 5 = 0 THEN 'inner' ELSE 't' || k END AS dst FROM range(1, 500) r(k)")
def type_edges_unwrapping(c):
    wrapped = c.table("bases").select("type", F.lit("inner").alias("inner")).where("cast(substr(type, 2) as int) % 5 = 0")
    return graph.type_edges(type_graph(c), unwrap=wrapped).select("src", "dst", "ordinal").drop("ordinal")


@pair("SELECT 't' || s AS start, 't' || k AS value FROM range(50, 60) a(s) JOIN range(1, 500) b(k) ON k >= s AND k >> CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) = s WHERE k * 2 >= 500")
def result_values(c):
    starts = c.table("bases").sparkSession.range(50, 60).select(F.concat(F.lit("t"), F.col("id").cast("string")))
    return graph.result_values(starts, type_graph(c))


@pair("SELECT 't' || s AS start, 't' || k AS node, CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) AS depth, floor(log2(k)) - floor(log2(s)) = 3 AS is_boundary FROM range(50, 60) a(s) JOIN range(1, 500) b(k) ON k >= s AND k >> CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) = s WHERE floor(log2(k)) - floor(log2(s)) = 3 OR (k * 2 >= 500 AND floor(log2(k)) - floor(log2(s)) < 3)")
def traverse_inputs(c):
    starts = c.table("bases").sparkSession.range(50, 60).select(F.concat(F.lit("t"), F.col("id").cast("string")))
    return graph.traverse_inputs(starts, type_graph(c), most=2).select("start", "node", "depth", "is_boundary")


@pair("SELECT DISTINCT caller AS start, target AS node FROM calls")
def steps(c):
    edges = c.table("calls").select(F.col("caller").alias("src"), F.col("target").alias("dst"), (F.col("start") / 100).cast("int").alias("ordinal"))
    return graph.steps(edges, c.table("calls").select("caller")).select("start", "node")


@pair("SELECT 't' || s AS start, 't' || k AS node, CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) AS depth FROM range(3, 6) a(s) JOIN range(1, 500) b(k) ON k > s AND k >> CAST(floor(log2(k)) - floor(log2(s)) AS INTEGER) = s WHERE k < 100")
def callees_same_type(c):
    spark = c.table("bases").sparkSession
    owners = spark.range(0, 500).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("node"), F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("owner"))
    return graph.callees(type_graph(c), spark.range(3, 6).select(F.concat(F.lit("t"), F.col("id").cast("string"))), owners=owners)


@pair("SELECT caller AS src, target AS dst FROM calls WHERE NOT in_expression_tree UNION SELECT caller, 'impl' || (CAST(substr(target, 2) AS INT) % 5) FROM calls UNION SELECT 'x', 'y'")
def call_edges(c):
    sites = c.table("calls").select("caller", "target", F.col("target").alias("callee"), F.col("in_expression_tree").alias("deferred"), F.lit(0).alias("ordinal"))
    spark = sites.sparkSession
    dispatch = spark.range(50).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("target"), F.concat(F.lit("impl"), (F.col("id") % 5).cast("string")).alias("implementation"))
    return graph.call_edges(sites, dispatch=dispatch, configured=spark.createDataFrame([("x", "y")], "src string, dst string")).select("src", "dst").distinct()


# Evidence and rules ---------------------------------------------------------------------


@pair("""SELECT call_id, CASE WHEN k % 6 = 0 THEN 'Unknown' WHEN k % 4 = 0 THEN 'Unknown' WHEN is_resolved THEN 'Covered' ELSE 'Uncovered' END AS evidence_state,
  CASE WHEN k % 6 = 0 THEN 'UnsupportedEnumerationMapping' WHEN k % 4 = 0 THEN 'MissingRange' END AS evidence_reason FROM (SELECT call_id, is_resolved, start // 100 AS k FROM calls)""")
def enumeration_started(c):
    k = F.expr("start div 100")
    loops = c.table("calls").select(F.col("call_id").alias("loop_id"), "document_id", "start", (k % 6 != 0).alias("is_resolved"))
    advances = c.table("calls").select("document_id", "start", F.lit("f").alias("function_id"))
    held = c.table("calls").where(k % 4 != 0).select("document_id", "start", F.lit("f").alias("function_id"), F.when(F.col("is_resolved"), evidence.COVERED).otherwise(evidence.UNCOVERED).alias("state"))
    return evidence.enumeration_started(loops, advances, held).select(F.col("loop_id").alias("call_id"), "evidence_state", "evidence_reason")


@pair("""SELECT call_id, CASE WHEN k % 7 = 0 THEN 'Covered' WHEN k % 5 = 0 THEN 'Unknown' WHEN k % 3 = 0 THEN 'Uncovered' WHEN is_resolved THEN 'Covered' ELSE 'Uncovered' END AS evidence_state,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'LooseSource' END AS evidence_reason FROM (SELECT call_id, is_resolved, start // 100 AS k FROM calls)""")
def inspect_precedence(c):
    k = F.expr("start div 100")
    spans = c.table("calls").select("call_id", F.col("call_id").alias("document_id"), "start", (F.col("start") + 50).alias("end"), k.alias("k"), "is_resolved")
    held = spans.select("document_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.when(F.col("is_resolved"), evidence.COVERED).otherwise(evidence.UNCOVERED).alias("state"))
    say = lambda rows, state: rows.select("document_id", "start", "end", F.lit(state).alias("state"), F.lit(None).cast("string").alias("reason"))
    documents = spans.select("document_id", F.when(F.col("k") % 5 == 0, "LooseSource").alias("reason"))
    found = evidence.inspect(spans, held, ["document_id"], ["call_id"], fixtures=say(spans.where("k % 7 = 0"), evidence.COVERED), precise=say(spans.where("k % 3 = 0"), evidence.UNCOVERED), covered_documents=documents)
    return found.select("call_id", "evidence_state", "evidence_reason")


@pair("""SELECT call_id, k % 3 = 0 AS executed, CASE k % 3 WHEN 1 THEN 'never ran' WHEN 2 THEN 'nobody knows' END AS message, k % 3 = 2 AND k % 2 = 0 AS review FROM (SELECT call_id, start // 100 AS k FROM calls)""")
def requirement(c):
    k = F.expr("start div 100")
    state = F.when(k % 3 == 0, evidence.COVERED).when(k % 3 == 1, evidence.UNCOVERED).otherwise(evidence.UNKNOWN)
    reasons = F.when(k % 2 == 0, F.array(F.lit("MissingRange"))).otherwise(F.array(F.lit("MissingRange"), F.lit("LooseSource")))
    return c.table("calls").select("call_id", evidence.executed(state).alias("executed"), evidence.failure_message(state, "never ran", "nobody knows").alias("message"), evidence.review_unknown(state, reasons, ["MissingRange", "PartialRange"]).alias("review"))


@pair("SELECT call_id, k % 2 = 0 AS review, CASE WHEN k % 3 = 0 THEN 'one' ELSE 'one; two' END AS message FROM (SELECT call_id, start // 100 AS k FROM calls)")
def combine_failures(c):
    k = F.expr("start div 100")
    one = F.struct(F.lit(True).alias("review"), F.lit("one").alias("message"))
    two = F.struct((k % 2 == 0).alias("review"), F.when(k % 3 == 0, "one").otherwise("two").alias("message"))
    both = evidence.combine_failures(F.array(one, two))
    return c.table("calls").select("call_id", both["review"].alias("review"), both["message"].alias("message"))


@pair("SELECT call_id FROM calls WHERE caller NOT IN (SELECT symbol FROM members WHERE kind = 'field')")
def planning_in_anti_join(c):
    """Members may still turn out to be properties; only the certain ones take a call away."""
    sure = where(F.col("kind") == "field") | where(F.col("kind") == "property").pending(F.col("kind") == "property", F.lit(True))
    return Selection(c.table("calls"), ("call_id",)).without_certain(c.table("members").select("symbol", "kind"), sure, "caller", "symbol").rows.select("call_id")


def clause(c: Facts, **more) -> rules.Clause:
    """Calls as candidates of a rule."""
    rows = c.table("calls").join(c.table("documents").select("context_id", "document_id", "path", "file_identity", "is_generated"), ["context_id", "document_id"]).join(c.table("contexts").select("context_id", F.col("name").alias("project_name"), "project_path", "is_analysis_target"), "context_id")
    return rules.Clause(rows.withColumn("ordinal", F.col("start")), "A call", **more)


@pair("SELECT document_id, start FROM calls JOIN docs d USING (context_id, document_id) JOIN contexts c USING (context_id) WHERE is_analysis_target AND NOT is_generated AND NOT regexp_full_match(c.name, 'NATION_1[^/]*') AND NOT path LIKE 'src/r2/%'")
def eligibility(c):
    found = rules.RuleCatalog().rule("E1", clause(c)).evaluate(exclude_projects=["NATION_1*"], exclude_paths=["src/r2/**"])
    return found.select("document_id", "start")


@pair("SELECT 'B' AS rule_id, start FROM calls JOIN shown USING (document_id, context_id)")
def rule_selection(c):
    catalog = rules.RuleCatalog().rule("A", clause(c)).rule("B", clause(c)).rule("C", clause(c), needs_evidence=True)
    return catalog.evaluate(select=["A", "B", "C"], ignore=["A"], skip_evidence=True).select("rule_id", "start")


@pair("SELECT call_id, CASE WHEN start // 100 % 2 = 0 THEN start + 7 ELSE start END AS at FROM calls JOIN shown USING (document_id, context_id) WHERE NOT is_resolved")
def report_at(c):
    moved = clause(c).require(F.col("is_resolved")).report_at(start=F.when(F.expr("start div 100") % 2 == 0, F.col("start") + 7))
    found = rules.RuleCatalog().rule("R", moved).evaluate()
    return found.select(F.concat(F.lit("c"), F.expr("ordinal div 100").cast("string")).alias("call_id"), F.col("start").alias("at"))


@pair("SELECT call_id FROM calls JOIN shown USING (document_id, context_id) WHERE is_resolved AND start // 100 % 3 <> 0")
def complexity_filter(c):
    kind = F.when(F.expr("start div 100") % 3 == 0, "Complex").when(F.expr("start div 100") % 3 == 1, "Local")
    found = rules.RuleCatalog().rule("R", clause(c, fix_complexity=kind).except_when(~F.col("is_resolved"))).evaluate()
    return rules.with_complexity(found, "local", "unspecified").select(F.concat(F.lit("c"), F.expr("ordinal div 100").cast("string")).alias("call_id"))


@pair("""SELECT start, CASE WHEN k % 3 = 0 THEN 'b' || k END AS batch_id, CASE k % 3 WHEN 1 THEN 'the contexts that report this propose different fixes' WHEN 2 THEN 'the fix was not validated in every context that has its files' END AS fix_withheld
  FROM (SELECT start, start // 100 AS k FROM calls WHERE start < 100000)""")
def fix_agreement(c):
    """Two contexts propose batches: with the same edits, with others, one of them not safe."""
    k = F.expr("start div 100")
    base = c.table("calls").where("start < 100000").select(F.lit("R").alias("rule_id"), "document_id", F.col("document_id").alias("file_identity"), F.lit("p").alias("path"), "start", "length", F.lit("m").alias("message"), F.lit(rules.VIOLATION).alias("disposition"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("fix_complexity"), F.col("start").alias("ordinal"), k.alias("k"))
    both = base.withColumns({"context_id": F.lit("a"), "batch_id": F.concat(F.lit("b"), F.col("k").cast("string"))}).unionByName(base.withColumns({"context_id": F.lit("z"), "batch_id": F.concat(F.lit("o"), F.col("k").cast("string"))}))
    made = both.select("batch_id", F.col("document_id").alias("file_identity"), "start", "length", F.when((F.col("k") % 3 == 1) & (F.col("context_id") == "z"), "y").otherwise("x").alias("replacement"), "k", "context_id")
    safe = rules.edit_sets(made.where("k % 3 <> 2 or context_id = 'a'").drop("k", "context_id"))
    return rules.aggregate_findings(both.drop("k"), safe).select("start", "batch_id", "fix_withheld")


@pair("""SELECT start, CASE WHEN k % 4 = 0 THEN 'engine-invalid-allowance' ELSE 'engine-unused-allowance' END AS rule_id,
  CASE WHEN k % 4 = 0 THEN 'no reason is given' WHEN k % 4 = 1 THEN 'B, A' WHEN k % 4 = 2 THEN 'B; another build configuration may use it' END AS evidence FROM (SELECT start, start // 100 AS k FROM calls WHERE start < 100000) WHERE k % 4 <> 3""")
def allowance_findings(c):
    k = F.expr("start div 100")
    rows = c.table("calls").where("start < 100000").select("context_id", "document_id", F.col("document_id").alias("file_identity"), F.lit("p").alias("path"), "start", "length", F.array(F.lit("B"), F.lit("A"), F.lit("B"), F.lit("C")).alias("rules"), F.when(k % 4 == 0, "no reason is given").alias("problem"), (k % 4 == 2).alias("is_conditional"), k.alias("k"))
    used = rows.where("k % 4 >= 2").select("file_identity", "start", F.lit("A").alias("rule_id")).unionByName(rows.where("k % 4 = 3").select("file_identity", "start", F.lit("B").alias("rule_id")))
    return rules.allowance_findings(rows, used, ["A", "B", "C"], skipped=["C"]).select("start", "rule_id", "evidence")


@pair("""SELECT 'span outside the text' AS problem, count(*) AS n FROM calls WHERE start >= 100000 UNION ALL SELECT 'a message is one line', count(*) FROM calls WHERE start // 100 % 11 = 0
  UNION ALL SELECT 'unknown batch', count(*) FROM calls WHERE start // 100 % 13 = 0 UNION ALL SELECT 'a context is missing from the response', count(*) FROM contexts WHERE context_id NOT IN (SELECT context_id FROM docs WHERE document_id IN ('d0', 'd1', 'd2', 'd3', 'd4', 'd5', 'd6', 'd7', 'd8', 'd9'))""")
def response_problems(c):
    k = F.expr("start div 100")
    found = c.table("calls").select("context_id", "document_id", F.lit("p").alias("path"), "start", "length", F.lit("R").alias("rule_id"), F.when(k % 11 == 0, "a\nb").otherwise("a").alias("message"), F.lit(rules.REVIEW).alias("disposition"), F.lit(None).cast("string").alias("evidence"), F.lit("Local").alias("fix_complexity"), F.when(k % 13 == 0, "none").alias("batch_id"))
    documents = c.table("documents").select("context_id", "document_id", F.col("document_id").alias("file_identity"), F.repeat(F.lit("x"), 100_000).alias("text"))
    made = c.table("documents").select(F.lit("known").alias("batch_id"), F.col("document_id").alias("file_identity"), F.lit(0).alias("start"), F.lit(1).alias("length"), F.lit("").alias("replacement"))
    reported = found.select("context_id").distinct()
    return rules.problems(found, c.table("contexts"), documents, made, reported).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@pair("SELECT project_path, CAST(sum(CASE WHEN is_resolved THEN 1 ELSE 0 END) AS BIGINT) AS n FROM calls JOIN shown USING (document_id, context_id) JOIN contexts USING (context_id) WHERE is_resolved GROUP BY project_path")
def project_violations(c):
    found = rules.RuleCatalog().rule("R", clause(c).except_when(~F.col("is_resolved"))).evaluate()
    return rules.status(found, c.table("contexts")).select("project_path", "n")


@pair("SELECT name AS rule_id, count(*) AS runs, CAST(sum(start) AS BIGINT) AS total, CAST(max(start) AS BIGINT) AS longest FROM calls GROUP BY name")
def profile(c):
    return E.profile(c.table("calls").select(F.col("name").alias("rule_id"), F.col("start").alias("micros"))).drop("rank")


# Edits --------------------------------------------------------------------------------


@pair("""SELECT 'b' || k AS batch_id, CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS n_edits, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS n_moves, k % 5 <> 0 AND k % 2 = 0 AND k % 3 = 0 AS is_proved, CASE WHEN k % 5 = 0 THEN 'not now' END AS withheld
  FROM (SELECT start // 100 AS k FROM calls WHERE start < 100000)""")
def fix_proposals(c):
    k = F.expr("start div 100")
    rows = c.table("calls").where("start < 100000").withColumn("k", k).withColumn("batch_id", F.concat(F.lit("b"), F.col("k").cast("string"))).withColumn("file_identity", F.col("document_id"))
    made = edits.replace_span(rows.where("k % 5 <> 0"), F.col("batch_id"), F.lit("x"))
    moves = rows.where("k % 7 = 0").select("batch_id", "file_identity", F.lit("q").alias("destination"))
    proofs = rows.select("batch_id", F.lit("a").alias("context_id"), (F.col("k") % 2 == 0).alias("is_safe")).unionByName(rows.select("batch_id", F.lit("z").alias("context_id"), (F.col("k") % 3 == 0).alias("is_safe")))
    return edits.proposals(made, moves, proofs, rows.where("k % 5 = 0").select("batch_id", F.lit("not now").alias("reason"))).withColumns({"n_edits": F.col("n_edits").cast("int"), "n_moves": F.col("n_moves").cast("int")})


@pair("""SELECT document_id, CASE WHEN is_generated THEN 'the file is generated or not editable' WHEN k % 6 = 1 THEN 'the file already has that path' WHEN k % 6 = 2 THEN 'the new file name does not end in .cs' WHEN k % 6 = 3 THEN 'the new file name marks generated code'
  WHEN k % 6 = 4 THEN 'a project would not compile the file at its new path' WHEN k % 6 = 5 AND k <> 5 THEN 'the new path collides with a loaded file' END AS problem FROM (SELECT document_id, is_generated, CAST(substr(document_id, 2) AS INT) AS k FROM docs)""")
def move_problems(c):
    k = F.expr("cast(substr(document_id, 2) as int)")
    documents = c.table("documents").select("context_id", F.col("document_id").alias("file_identity"), F.concat(F.lit("/src/"), "document_id", F.lit(".cs")).alias("path"), "is_generated", F.lit(True).alias("is_editable"), F.lit(True).alias("is_default_compile_item"))
    contexts = c.table("contexts").select("context_id", "name", F.lit("/src").alias("glob_directory")).limit(0).unionByName(documents.select("context_id").distinct().select("context_id", F.col("context_id").alias("name"), F.lit("/src").alias("glob_directory")))
    goal = F.when(k % 6 == 1, F.concat(F.lit("/src/"), "document_id", F.lit(".cs"))).when(k % 6 == 2, "/src/x.txt").when(k % 6 == 3, "/src/x.G.cs").when(k % 6 == 4, "/lib/x.cs").when(k % 6 == 5, "/src/D5.cs").otherwise(F.concat(F.lit("/src/n"), "document_id", F.lit(".cs")))
    moves = c.table("documents").select(F.lit("b").alias("batch_id"), F.col("document_id").alias("file_identity"), goal.alias("destination"))
    one = documents.withColumn("context_id", F.lit("n0"))
    alone = contexts.limit(0).unionByName(contexts.sparkSession.createDataFrame([("n0", "n0", "/src")], "context_id string, name string, glob_directory string"))
    return edits.move_problem(moves, one, alone).select(F.col("file_identity").alias("document_id"), "problem")


@pair("SELECT batch_id, min(batch_id) OVER (PARTITION BY g) AS component FROM (SELECT DISTINCT 'b' || (start // 100) AS batch_id, start // 100 % 17 AS g FROM calls WHERE start < 100000)")
def fix_components(c):
    rows = c.table("calls").where("start < 100000").select(F.concat(F.lit("b"), F.expr("start div 100").cast("string")).alias("batch_id"), (F.expr("start div 100") % 17).alias("group"))
    return edits.conflict_groups(edits.sharing(rows, "group")).withColumnRenamed("node", "batch_id")
