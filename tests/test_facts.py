from pyspark.sql import functions as F

from millrace.operators import facts
from tests.conftest import rows, within


def test_definitions_references_and_types(spark):
    parts = spark.createDataFrame([("c", "T", "b.cs", 1), ("c", "T", "a.cs", 9), ("c", "T", "a.cs", 2), ("d", "T", "b.cs", 1)], "context_id string, symbol string, path string, start int")
    assert rows(facts.distinct_definitions(parts), "context_id", "path", "start") == [("c", "a.cs", 2), ("d", "b.cs", 1)]
    refs = spark.createDataFrame([(1, "f", 3, 4), (2, "f", 9, 4)], "id int, decl_file string, decl_start int, decl_length int")
    decl = spark.createDataFrame([("f", 3, 4)], "file_identity string, start int, length int")
    assert rows(facts.references_to(refs, decl), "id") == [(1,)]
    contexts, have = spark.createDataFrame([("a",), ("b",), ("c",)], "context_id string"), spark.createDataFrame([("a", "T"), ("b", "T"), ("b", "T"), ("c", "U")], "context_id string, type_key string")
    assert rows(facts.with_type(contexts, have, "T")) == [("a", "unique"), ("b", "ambiguous"), ("c", "missing")]


def test_inheritance_and_attributes(spark):
    lineage = facts.ancestors(spark.createDataFrame([("B", "A"), ("C", "B"), ("MyFact", "Fact")], "type string, base string"))
    types = spark.createDataFrame([("A",), ("B",), ("C",)], "type string")
    assert rows(facts.derived_from(types, lineage, "A")) == [("B",), ("C",)]
    assert rows(facts.derived_from(types, lineage, "B", strict=False)) == [("B",), ("C",)]
    methods = spark.createDataFrame([("c", "m1", "A"), ("c", "m2", "B"), ("c", "m3", "C"), ("c", "m4", "C")], "context_id string, symbol string, owner string")
    attributes = spark.createDataFrame([("c", "m1", "MyFact"), ("c", "m4", "Other")], "context_id string, symbol string, attribute_type string")
    assert rows(facts.with_attribute(methods, attributes, lineage, ["Fact"]), "symbol") == [("m1",)]
    overrides = spark.createDataFrame([("c", "m2", "m1", "B"), ("c", "m3", "m2", "C")], "context_id string, symbol string, overridden string, owner string")
    for inherited, want in ((True, ["m1", "m2", "m3"]), (False, ["m1"])):
        markers = spark.createDataFrame([("Fact", inherited)], "attribute_type string, inherited boolean")
        tests = facts.test_methods(methods, attributes, lineage, overrides, markers)
        assert [r[0] for r in rows(tests, "symbol")] == want
    classes = spark.createDataFrame([("c", "A"), ("c", "B"), ("c", "C"), ("c", "Fact")], "context_id string, symbol string")
    assert rows(facts.test_classes(classes, tests, lineage, overrides), "symbol") == [("A",)]


def test_calls_and_arguments(spark):
    calls = spark.createDataFrame([(1, "O", "f", True), (2, "O", "f", True), (3, "O", "f", False), (4, "P", "f", True)], "call_id int, owner string, name string, is_resolved boolean")
    args = spark.createDataFrame([(1, "x", "5"), (1, "x", "5"), (2, "y", "6"), (3, "x", "5")], "call_id int, parameter string, value string")
    chosen = facts.calls_to(calls, spark.createDataFrame([("O", "f")], "owner string, name string"))
    assert rows(chosen, "call_id") == [(1,), (2,)]
    assert rows(facts.where_argument(chosen, args, F.col("value") == "5"), "call_id") == [(1,)]
    assert rows(facts.where_argument(chosen, args, F.col("value") == "5", or_missing="x"), "call_id") == [(1,), (2,)]
    assert facts.arguments_for(calls, args, "x").count() == 2


def test_signatures_and_overloads(spark):
    m = spark.createDataFrame([("c", "O", "f", "f1", ["a", "b"], "r"), ("c", "O", "f", "f2", ["a", "T", "b"], "r"), ("c", "O", "f", "f3", ["T"], "r")], "context_id string, owner string, name string, symbol string, parameters array<string>, result string")
    assert rows(m.where(facts.matches_signature(name="f", parameters=["T"])), "symbol") == [("f3",)]
    assert rows(facts.overloads_adding(m, "T"), "symbol", "overload", "position") == [("f1", "f2", 1)]


def test_scopes_views_and_properties(spark):
    uses = spark.createDataFrame([("d", 1, 50)], "document_id string, use_id int, at int")
    values = spark.createDataFrame([("d", "wide", "T", 0, 100, 0), ("d", "near", "T", 40, 60, 45), ("d", "later", "T", 40, 60, 55), ("d", "other", "U", 40, 60, 45)], "document_id string, name string, type_key string, scope_start int, scope_end int, declared_at int")
    assert rows(facts.values_in_scope(uses, values, "T"), "rank", "name") == [(1, "near"), (2, "wide")]
    views = spark.createDataFrame([("I", 1), ("I", 2)], "interface string, view_id int")
    made = spark.createDataFrame([("I", 1, "X")], "interface string, view_id int, type string")
    assert rows(facts.implementation_views(views, made)) == [("I", 1, "X"), ("I", 2, None)]
    lineage = facts.ancestors(spark.createDataFrame([("B", "A")], "type string, base string"))
    props = spark.createDataFrame([("A", "p", "x", "f", 1), ("A", "q", "x", "f", 2), ("B", "p", "x", "f", 3)], "owner string, name string, project string, path string, start int")
    reached = spark.createDataFrame([("s1", "B"), ("s2", "B")], "seed string, type string")
    made = facts.property_views(reached, props, lineage)
    assert rows(made, "type", "owner", "name", "reached_from") == [("B", "A", "q", ["s1", "s2"]), ("B", "B", "p", ["s1", "s2"])]
    assert [r.start for r in facts.property_view_order(made).collect()] == [2, 3]


def test_values_in_scope_against_all_pairs(spark):
    import random

    r = random.Random(3)
    uses = [(r.choice(("d", "e", None)), i, r.choice((None, r.randrange(-500, 90_000), r.randrange(2_000)))) for i in range(300)] + [("d", 300, 2**63 - 2)]
    values = []
    for i in range(300):
        a = r.choice((None, r.randrange(-500, 90_000), r.randrange(2_000)))
        size = r.choice((-5, 0, 1, 255, 256, 257, 4_096, 5_000, 70_000, 2_000_000))
        values.append((r.choice(("d", "e", "other", None)), f"v{i}", a, None if a is None or i % 29 == 0 else a + size, None if a is None or i % 31 == 0 else a + r.choice((-3, 0, 0, 40))))
    values += [("d", "whole", 0, 2**63 - 1, 0), ("e", "all", -(2**61), 2**61, -(2**61))]
    want = []
    for d, use, at in uses:
        held = [(y - x, -z, name) for e, name, x, y, z in values if None not in (d, at, x, y, z) and d == e and x <= at < y and z <= at]
        want += [(use, rank + 1, name) for rank, (_, _, name) in enumerate(sorted(held))]
    u = spark.createDataFrame(uses, "document_id string, use_id int, at long")
    v = spark.createDataFrame(values, "document_id string, name string, scope_start long, scope_end long, declared_at long")
    found = facts.values_in_scope(u, v)
    assert found.columns == ["document_id", "use_id", "at", "name", "scope_start", "scope_end", "declared_at", "rank"]
    assert rows(found, "use_id", "rank", "name") == sorted(want, key=str) and len(want) > 800
    assert facts.values_in_scope(u, v.where("false")).isEmpty()


def test_values_in_scope_of_a_long_document(spark):
    n = 400_000  # 160 billion pairs of uses and values in one document
    uses = spark.range(n).select(F.lit("d").alias("document_id"), F.col("id").alias("use_id"), (F.col("id") * 100).alias("at"))
    values = spark.range(n).select(F.lit("d").alias("document_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), (F.col("id") * 100 - 100).alias("scope_start"), (F.col("id") * 100 + 100).alias("scope_end"), (F.col("id") * 100 - 100).alias("declared_at"))
    with within(spark, 60):
        found = facts.values_in_scope(uses, values)
        assert [tuple(x) for x in found.groupBy("rank").agg(F.count(F.lit(1)), F.min("use_id"), F.max("use_id")).orderBy("rank").collect()] == [(1, n, 0, n - 1), (2, n - 1, 0, n - 2)]


def test_paths_parents_and_routes(spark):
    keys = spark.createDataFrame([(1, "O", ["a", "b"]), (2, "O", ["a", "zz"]), (3, "O", ["twice"])], "key_id int, type string, segments array<string>")
    members = spark.createDataFrame([("O", "a", "O.a", "P"), ("P", "b", "P.b", "Q"), ("O", "twice", "m1", "P"), ("O", "twice", "m2", "P")], "owner string, name string, member string, result string")
    assert rows(facts.resolve_keys(keys, members)) == [(1, ["O.a", "P.b"]), (2, None), (3, None)]
    nodes = spark.createDataFrame([(1, 2, "cast"), (2, 3, "cast"), (3, 4, "call"), (4, None, "block")], "id int, parent int, kind string")
    assert rows(facts.follow_parents(nodes, nodes, F.col("kind") == "cast")) == [(1, 3), (2, 3), (3, 3), (4, 4)]
    mappings = spark.createDataFrame([(1, "g2", "/x"), (2, None, "/y"), (3, "g3", "/z"), (4, "g1", None)], "route_id int, group_id string, template string")
    groups = spark.createDataFrame([("g1", None, "/api"), ("g2", "g1", "/v1"), ("g3", "g1", None)], "group_id string, parent_group string, prefix string")
    assert rows(facts.routes(mappings, groups)) == [(1, "/api/v1/x"), (2, "/y"), (3, None), (4, None)]
    kinds = spark.createDataFrame([("Task",), ("Task<int>",), ("int",)], "t string")
    assert [r[0] for r in kinds.select(facts.unwrap_task(F.col("t"))).collect()] == [None, "int", "int"]


def test_fact_tables_are_checked_and_scoped(spark, tmp_path):
    import pytest

    from millrace.sources.fact_tables import TABLES, Facts

    contexts = spark.createDataFrame([("c", "P", "p.proj", "n9", True, False, None), ("r", "R", "r.proj", "n9", False, False, None)], TABLES["contexts"])
    documents = spark.createDataFrame([("c", "d1", "b.cs", "", False, "f1"), ("c", "d2", "a.cs", "", True, "f2"), ("r", "d3", "c.cs", "", False, "f3")], TABLES["documents"])
    checks = spark.createDataFrame([("c", "d1", 3, 2, "is", False), ("c", "d2", 3, 2, "is", False), ("r", "d3", 3, 2, "is", False)], TABLES["null_checks"])
    made = Facts({"contexts": contexts, "documents": documents, "null_checks": checks})
    made.write(str(tmp_path))
    back = Facts.read(spark, str(tmp_path), ("contexts", "documents", "null_checks"))
    assert rows(back.files().rows, "document_id") == [("d1",)] and rows(back.files(including_generated=True).rows, "document_id") == [("d1",), ("d2",)]
    assert rows(back.reported("null_checks").rows, "document_id") == [("d1",)] and rows(back.projects().rows, "context_id") == [("c",)]
    checks.drop("form").write.mode("overwrite").parquet(str(tmp_path / "null_checks"))
    with pytest.raises(ValueError, match="form"):
        Facts.read(spark, str(tmp_path), ("null_checks",))


def test_long_chains_of_conversions(spark):
    chain = spark.createDataFrame([(i, i + 1, i < 100) for i in range(101)] + [(500, None, True)], "id int, parent int, skip boolean")
    got = dict(rows(facts.follow_parents(chain.select("id"), chain, F.col("skip"))))
    assert got == {i: 100 for i in range(101)} | {500: None}
