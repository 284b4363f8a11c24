import pytest
from pyspark.sql import functions as F

from millrace.plans import rules
from millrace.plans.conditions import where
from millrace.plans.selection import Selection
from tests.conftest import rows


def named(spark, *names):
    return Selection(spark.createDataFrame(list(enumerate(names)), "id int, name string"), ("id",))


def test_folded_joins(spark):
    left, right = named(spark, "Json", "Xml"), spark.createDataFrame([("JSON",)], "other string")
    assert rows(left.without_matching(right, "name", "other", F.lower).rows, "name") == [("Xml",)]
    assert rows(left.join(right, "name", "other", F.lower).rows, "name", "other") == [("Json", "JSON")]


def test_null_keys_join_nothing_but_exclude_each_other(spark):
    left, right = named(spark, None, "a"), spark.createDataFrame([(None,), ("b",)], "other string")
    assert rows(left.join(right, "name", "other").rows) == []
    assert rows(left.without_matching(right, "name", "other").rows, "name") == [("a",)]


def test_union_takes_the_first_and_concat_all(spark):
    one, two = named(spark, "Empty"), named(spark, "empty")
    assert rows(one.union(two).rows, "name") == [("Empty",)]
    assert one.concat(two).rows.count() == 2


def test_except_when_reads_null_as_false(spark):
    assert rows(named(spark, "a", None).except_when(F.col("name") == "a").rows, "name") == [(None,)]


def test_theta_anti_join(spark):
    left = Selection(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, k string"), ("n",))
    other = spark.createDataFrame([(2, "x")], "m int, j string")
    assert rows(left.without(other, F.col("m") > F.col("n"), [("k", "j")]).rows, "n") == [(2,), (3,)]


def test_select_many_drops_empty_parents(spark):
    s = Selection(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, xs array<string>"), ("id",))
    assert rows(s.select_many(F.col("xs"), "x").rows, "id", "position", "x") == [(1, 0, "a"), (1, 1, "b")]


def test_planning(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "v boolean")
    known, unsure = where(F.col("v"), names={"a", "b"}), where(F.col("v"), names={"b"}).pending(F.lit(True), F.lit(True))
    assert (known & unsure).names == {"b"} and (known | where(F.col("v"))).names is None and (~known).names is None
    got = [tuple(r) for r in df.select(*(known & unsure).possible(), *(known | unsure).possible(), unsure.certain()).collect()]
    assert got == [(True, True, True, False, False), (False, True, True, True, False), (False, True, True, True, False)]


def place(spark, *found):
    """(context, file, start, group) rows as candidates."""
    df = spark.createDataFrame([(c, f, s, g, i) for i, (c, f, s, g) in enumerate(found)], "context_id string, path string, start long, g string, ordinal long")
    return df.select("*", F.col("path").alias("document_id"), F.col("path").alias("file_identity"), F.lit(1).cast("long").alias("length"))


def test_report_once_prefers_violations(spark):
    df = place(spark, ("c", "b", 5, "k"), ("c", "a", 9, "k"), ("d", "a", 1, "k"))
    kind = F.when(F.col("path") == "a", rules.REVIEW).otherwise(rules.VIOLATION)
    got = rules.RuleCatalog().rule("R", rules.Clause(df, "m", disposition=kind).report_once_per("g")).evaluate()
    assert rows(got, "context_id", "path", "start") == [("c", "b", 5), ("d", "a", 1)]


def test_aggregation_merges_contexts(spark):
    df = place(spark, ("c", "a", 1, "k"), ("d", "a", 1, "k"), ("c", "b", 1, "k"))
    kind = F.when(F.col("context_id") == "c", rules.REVIEW).otherwise(rules.VIOLATION)
    found = rules.RuleCatalog().rule("R", rules.Clause(df, "m", disposition=kind, evidence=F.col("context_id"))).evaluate()
    got = rules.aggregate_findings(found)
    assert rows(got, "path", "disposition", "evidence", "contexts") == [("a", "Violation", "c; d", 2), ("b", "Review", "c", 1)]
    assert rules.exit_code(got) == 1 and rules.exit_code(got.where("path = 'b'")) == 0


def test_eligibility_goes_by_the_reported_place(spark):
    df = place(spark, ("c", "a", 1, "k"), ("c", "b", 1, "k")).withColumn("is_generated", F.col("path") == "b")
    got = rules.RuleCatalog().rule("R", rules.Clause(df, "m").report_at(start=F.when(F.col("path") == "a", F.lit(7)))).evaluate()
    assert rows(got, "path", "start") == [("a", 7)]


def test_catalog_checks(spark):
    df = place(spark, ("c", "a", 1, "k"))
    catalog = rules.RuleCatalog().rule("A", rules.Clause(df, "m")).rule("B")
    for bad in (lambda: catalog.rule("A"), lambda: catalog.rule("engine-x"), lambda: catalog.rule("x\ny"), lambda: catalog.evaluate(select=["C"]), lambda: catalog.evaluate()):
        with pytest.raises(ValueError):
            bad()
    assert catalog.selected(["A", "B"], ["B"]) == ["A"]


def test_require_reports_what_fails_or_is_null(spark):
    df = place(spark, ("c", "a", 1, "k"), ("c", "b", 1, None), ("c", "d", 1, "z"))
    got = rules.RuleCatalog().rule("R", rules.Clause(df, "m").require(F.col("g") == "k")).evaluate()
    assert rows(got, "path") == [("b",), ("d",)]


def test_exclusions_match_project_names_and_paths(spark):
    df = place(spark, ("c", "src/a/x.cs", 1, "k"), ("c", "src/y.cs", 1, "k"), ("c", "lib/z.cs", 1, "k")).withColumn("project_name", F.when(F.col("path").startswith("lib"), "Lib.Tests").otherwise("App[1]"))
    catalog = rules.RuleCatalog().rule("R", rules.Clause(df, "m"))
    assert rows(catalog.evaluate(exclude_projects=["Lib*"]), "path") == [("src/a/x.cs",), ("src/y.cs",)]
    assert rows(catalog.evaluate(exclude_projects=["App[1]"]), "path") == [("lib/z.cs",)]
    assert rows(catalog.evaluate(exclude_paths=["src/*"]), "path") == [("lib/z.cs",), ("src/a/x.cs",)]


def test_the_first_finding_gives_complexity_and_contexts_agree_by_edits(spark):
    base = place(spark, ("c", "a", 1, "k"), ("d", "a", 1, "k"))
    found = rules.RuleCatalog().rule("R", rules.Clause(base, "m", fix_complexity=F.when(F.col("context_id") == "c", "Local").otherwise("Architectural")).with_fix(F.concat(F.lit("b-"), "context_id"))).evaluate()
    made = spark.createDataFrame([("b-c", "a", 1, 1, "x"), ("b-d", "a", 1, 1, "x")], "batch_id string, file_identity string, start int, length int, replacement string")
    got = rules.aggregate_findings(found, rules.edit_sets(made)).first()
    assert (got.fix_complexity, got.batch_id, got.fix_withheld) == ("Local", "b-c", None)
    assert rules.aggregate_findings(found, rules.edit_sets(made.where("batch_id = 'b-c'"))).first().fix_withheld == rules.UNPROVED
    other = made.withColumn("replacement", F.col("batch_id"))
    assert rules.aggregate_findings(found, rules.edit_sets(other)).first().fix_withheld == rules.DIFFERENT


def test_columns_with_the_engines_names_stay(spark):
    left = Selection(spark.createDataFrame([(1, "a", "x", "y", "z", 0)], "id int, name string, _own string, _key string, _nth string, _side int"), ("id",))
    right = spark.createDataFrame([("a", "r")], "other string, _key2 string")
    assert left.join(right, "name", "other").rows.first()["_own"] == "x" and left.without_matching(right, "name", "_key2").rows.columns == left.rows.columns
    assert left.union(left).rows.columns == left.rows.columns and left.union(left).rows.count() == 1


def test_a_reviewed_outcome_is_joined(spark):
    df = place(spark, ("c", "a", 1, "k"), ("d", "a", 1, "k"))
    found = rules.RuleCatalog().rule("R", rules.Clause(df, "m")).evaluate().withColumn("outcome_remediation", F.when(F.col("context_id") == "c", "do it"))
    assert rules.aggregate_findings(found).first().outcome_remediation == "do it; m"
