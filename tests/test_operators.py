import hashlib
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalogue, changes, edits, evidence, graph, grouping, spans
from millrace.sources import config, lexer, snapshots
from tests.conftest import rows, within


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, ordinal int")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "start string")


def test_closure_of_a_cycle(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert rows(graph.closure(e).where("start = 'a'"), "node", "depth") == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
    assert ("d", "d", 0) in rows(graph.closure(e, nodes=names(spark, "d")))
    assert graph.has_cycle(e) and not graph.has_cycle(edges(spark, ("a", "b")))


def test_boundaries_are_not_entered_but_callees_give_them(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "d"))
    b = names(spark, "b")
    assert rows(graph.reaches(e, names(spark, "a"), names(spark, "c"))) == [("a", True)]
    assert rows(graph.reaches(e, names(spark, "a"), names(spark, "c"), b)) == [("a", False)]
    assert rows(graph.reaches(e, names(spark, "a"), names(spark, "b"), b)) == [("a", False)]
    assert rows(graph.callees(e, names(spark, "a"), b), "node") == [("b",), ("d",)]


def test_a_match_needs_an_edge_and_a_cycle_gives_the_start(spark):
    assert rows(graph.reaches(edges(spark, ("a", "b")), names(spark, "a"), names(spark, "a"))) == [("a", False)]
    assert ("a",) in rows(graph.callees(edges(spark, ("a", "b"), ("b", "a")), names(spark, "a")), "node")


def test_shortest_path_by_source_order(spark):
    e = edges(spark, ("a", "x"), ("a", "y"), ("y", "z"), ("x", "z"), ("a", "q"), ("q", "r"), ("r", "z"))
    assert rows(graph.path_to(e, names(spark, "a"), names(spark, "z")), "path") == [(["a", "x", "z"],)]


def test_traversal_limits(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("z", None))
    flags = lambda df: {r.seed: r.status for r in df.collect()}
    assert flags(graph.traverse(names(spark, "a", "z", "q"), e)) == {"a": 0, "z": graph.UNRESOLVED, "q": 0}
    assert flags(graph.traverse(names(spark, "a"), e, most_depth=1)) == {"a": graph.DEPTH_LIMIT}
    assert flags(graph.traverse(names(spark, "a"), e, most_states=2)) == {"a": graph.STATE_LIMIT}
    assert rows(graph.traverse(names(spark, "a"), e, stop=names(spark, "b")), "node") == [("a",), ("b",)]


def test_a_traversal_ends_at_its_limit_in_the_order_of_the_queue(spark):
    edges = spark.createDataFrame([("a", "z", 0), ("a", "b", 1), ("a", None, 2), ("z", "y", 0)], "src string, dst string, ordinal int")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert rows(graph.traverse(seeds, edges, most_states=2), "node", "status") == [("a", graph.STATE_LIMIT), ("z", graph.STATE_LIMIT)]
    assert rows(graph.traverse(seeds, edges, most_states=3), "node", "status") == [(n, graph.UNRESOLVED | graph.STATE_LIMIT) for n in "abz"]
    assert rows(graph.traverse(seeds, edges, most_states=4), "node", "status") == [(n, graph.UNRESOLVED) for n in "abyz"]
    assert rows(graph.traverse(seeds, edges, most_depth=1), "node", "status") == [(n, graph.UNRESOLVED | graph.DEPTH_LIMIT) for n in "abz"]
    kept = graph.traverse(spark.createDataFrame([("a",), (None,)], "seed string"), edges, stop=spark.createDataFrame([("z",)], "node string"))
    assert rows(kept, "seed", "node", "status") == [("a", "a", 1), ("a", "b", 1), ("a", "z", 1), (None, None, 1)]


def test_components_and_cycles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)], "a int, b int")
    got = dict(rows(graph.connected(links)))
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50, 60: 60}
    line = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src int, dst int")
    assert not graph.has_cycle(line) and graph.has_cycle(line.union(spark.createDataFrame([(3, 1)], "src int, dst int")))
    assert graph.has_cycle(spark.createDataFrame([(9, 9)], "src int, dst int")) and not graph.has_cycle(line.limit(0))


def test_inputs_end_at_boundaries(spark):
    made = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("c", "d", 0)], "src string, dst string, ordinal int")
    start = spark.createDataFrame([("a",), ("x",)], "n string")
    got = graph.traverse_inputs(start, made)
    assert rows(got, "start", "path", "node", "is_boundary") == [("a", [0, 0], "a", True), ("a", [1, 0], "d", False), ("x", [], "x", False)]


def test_greedy_query_against_plain_python(spark):
    import pandas as pd

    from millrace import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    frame = pd.read_parquet(f"{data}/customer.parquet")
    want = {}
    for nation, group in frame.groupby("c_nationkey"):
        heads = []
        for row in group.sort_values("c_custkey").itertuples():
            balance = int(row.c_acctbal // 1)
            found = next((i for i, h in enumerate(heads) if abs(h - balance) <= 3000), None)
            if found is None:
                found = len(heads)
                heads.append(balance)
            want[nation, row.c_custkey] = found
    got = {(r.c_nationkey, r.c_custkey): r.part for r in queries.QUERIES["q_greedy_parts"](spark, data).collect()}
    assert got == want


def test_token_kinds_query_against_plain_python(spark):
    from collections import Counter

    import pandas as pd

    from millrace import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    want = Counter()
    for value in pd.read_parquet(f"{data}/documents.parquet")["text"]:
        want.update(kind for kind, *_ in lexer.lex(value or ""))
    assert dict(rows(queries.QUERIES["q_token_kinds"](spark, data), "kind", "n")) == dict(want)


def test_combined_fixes_keep_what_is_safe_together(spark):
    batches = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "x"), ("c2", "d")], "component string, batch_id string")
    assert edits.combined(batches, lambda ids: "x" not in ids or len(ids) == 1) == ["a", "b", "d"]


def test_targets(tmp_path):
    from millrace.sources import targets

    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csproj").write_text("")
    assert targets.resolve(str(tmp_path / "one")) == str(tmp_path / "one" / "a.csproj")
    (tmp_path / "one" / "b.csproj").write_text("")
    with pytest.raises(ValueError):
        targets.resolve(str(tmp_path / "one"))
    (tmp_path / "one" / "all.slnx").write_text("")
    assert targets.resolve(str(tmp_path / "one")).endswith("all.slnx")
    assert targets.expand(str(tmp_path), "**/*.csproj") == [str(tmp_path / "one" / "a.csproj"), str(tmp_path / "one" / "b.csproj")]
    with pytest.raises(ValueError):
        targets.expand(str(tmp_path), "*.nothing")


def test_accepted_sources_from_a_folder_and_a_revision(spark, tmp_path):
    import subprocess

    from millrace.sources import targets

    (tmp_path / "a.cs").write_text("class A {}")
    git = lambda *x: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *x], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.cs")
    git("commit", "-qm", "one")
    (tmp_path / "a.cs").write_text("class B {}")
    assert rows(targets.accepted_revision(spark, str(tmp_path), "HEAD", "**/*.cs"), "path", "text") == [("a.cs", "class A {}")]
    assert rows(targets.accepted_folder(spark, str(tmp_path), "**/*.cs"), "path", "text") == [("a.cs", "class B {}")]


def test_call_policies(spark):
    sites = spark.createDataFrame([("f", 0, "t", "g", False), ("f", 1, "u", "h", True), ("f", 2, "i", None, False)], "caller string, ordinal int, target string, callee string, deferred boolean")
    assert rows(graph.call_edges(sites), "dst") == [("g",)]
    assert rows(graph.call_edges(sites, delegates=True), "dst") == [("g",), ("h",)]
    dispatch = spark.createDataFrame([("i", "impl")], "target string, implementation string")
    assert rows(graph.call_edges(sites, dispatch=dispatch), "dst") == [("g",), ("impl",)]


def test_maximal_cliques():
    near = {1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}, 5: set()}
    assert sorted(map(sorted, graph.maximal_cliques(near))) == [[1, 2, 3], [3, 4], [5]]


def test_reaching_definitions_through_a_loop_and_a_handler(spark):
    flow = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src int, dst int")
    made = spark.createDataFrame([(0, "x", 1), (0, "x", 2), (1, "y", 3)], "block int, variable string, definition int")
    assert rows(graph.reaching_definitions(flow, made), "block", "definition") == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 2), (2, 3)]
    handled = graph.reaching_definitions(flow, made, spark.createDataFrame([(1,)], "block int"))
    assert (1, 1) in rows(handled, "block", "definition")


def test_groups_and_duplicates(spark):
    df = spark.createDataFrame([("A", None, 1), ("A", "null", 2), ("A", None, 3), ("B", None, 4), ("A", None, 3)], "owner string, value string, at int")
    assert rows(grouping.constant_groups(df, ["owner", "value"], ["at"])) == [("A", None, 1, 2), ("A", None, 3, 2)]
    texts = spark.createDataFrame([(1, "c", "x y"), (2, "c", "x y"), (3, "d", "x y"), (4, "c", "z")], "id int, ctx string, t string")
    assert rows(grouping.duplicates(texts, ["ctx"], F.col("t"), F.size(F.split("t", " ")), 2), "id", "copies") == [(1, 2), (2, 2)]


def test_sets_fold_and_match_nulls(spark):
    one = spark.createDataFrame([("json",), ("JSON",), ("xml",), (None,)], "k string")
    two = spark.createDataFrame([("Json",), ("csv",), (None,)], "k string")
    assert rows(grouping.missing(one, two, "k", F.lower)) == [("xml",)]
    assert rows(grouping.unexpected(one, two, "k", F.lower)) == [("csv",)]


def test_exactly_one_keeps_empty_views(spark):
    views = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "owner string, view int")
    links = spark.createDataFrame([("p", 1), ("q", 1)], "owner string, view int")
    assert rows(grouping.exactly_one(views, links, ["owner", "view"], ["owner"])) == [("q",)]


def test_membership_sections_and_chains(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    members = spark.createDataFrame([(1, "b"), (1, "a")], "id int, g string")
    assert rows(grouping.with_groups(df, members, "id", "g")) == [(1, ["a", "b"]), (2, [])]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", " ", "", "c", None])], "d int, n int, t string")
    assert rows(grouping.sections(lines, ["d"], "n", "t"), "t", "section") == [("a", 1), ("b", 1), ("c", 2)]
    chain = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "c int, n int, v string")
    assert rows(grouping.before_and_after(chain, ["c"], "n", "v"), "v", "before", "after", "is_last") == [("x", [], ["y"], False), ("y", ["x"], [], True)]


def test_greedy_parts_depend_on_order(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 2, 4, 1])], "k int, n int, v int")
    got = grouping.partition_greedily(df, ["k"], ["n"], lambda a, b: abs(a["v"] - b["v"]) <= 2)
    assert rows(got, "n", "part") == [(0, 0), (1, 0), (2, 1), (3, 0)]


def test_overlaps_and_containment(spark):
    e = spark.createDataFrame([("f", 1, 0, 5), ("f", 2, 5, 5), ("f", 3, 5, 0), ("f", 4, 9, 3), ("g", 5, 0, 9)], "file string, id int, start int, length int")
    assert rows(spans.overlap_pairs(e, "file", "id"), "a", "b") == [(1, 3), (2, 3), (2, 4)]
    inner = spark.createDataFrame([("d", 5, 6)], "doc string, start int, end int")
    outer = spark.createDataFrame([("d", 0, 10, "wide"), ("d", 4, 8, "near"), ("d", 3, 7, "early"), ("x", 5, 6, "other")], "doc string, o_start int, o_end int, name string")
    for bins in (False, True):
        joined = spans.containment_join(inner, outer, ["doc"], bins)
        assert rows(joined, "name") == [("early",), ("near",), ("wide",)]
        assert rows(spans.innermost(joined, ["doc", "start"]), "name") == [("near",)]


def test_suppression(spark):
    findings = spark.createDataFrame([(1, "f", "R", 5), (2, "f", "S", 5), (3, "f", "R", 50)], "id int, doc string, rule_id string, start int")
    allow = spark.createDataFrame([("a", "f", "R", 0, 10), ("b", "f", "R", 4, 6), ("c", "g", "R", 0, 9)], "allowance_id string, doc string, rule_id string, o_start int, o_end int")
    left, held, unused = changes.suppress(findings, allow, ["doc"], ["id"])
    assert rows(left, "id") == [(2,), (3,)] and rows(held, "id", "allowance_id") == [(1, "b")] and rows(unused, "allowance_id") == [("a",), ("c",)]


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, t string")
    before = spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "9")], "p string, t string")
    assert rows(changes.change_of(now, before, ["p"], F.col("t"), F.col("t")), "p", "change") == [("a", "Unchanged"), ("b", "Modified"), ("c", "Added")]


def test_a_null_content_was_there_and_a_key_is_shown_once(spark):
    now = spark.createDataFrame([("a", None), ("b", "2"), (None, "n")], "p string, t string")
    before = spark.createDataFrame([("a", None), ("b", "1"), ("b", "2"), (None, "n")], "p string, t string")
    got = changes.change_of(now, before, ["p"], F.col("t"), F.col("t"))
    assert got.count() == 3 and rows(got.where("p <> 'b'"), "p", "change") == [("a", "Unchanged")] and got.columns == ["p", "t", "change"]
    assert [r.change for r in got.where("p is null").collect()] == ["Unchanged"]


def test_baselines_normalise_paths_and_project_keys(spark):
    key = lambda props: changes.project_key(F.lit("a\\b.proj"), F.lit("n9"), props)
    one = F.create_map(F.lit("k"), F.lit("1"), F.lit("J"), F.lit("2"))
    two = F.create_map(F.lit("j"), F.lit("2"), F.lit("K"), F.lit("1"))
    got = spark.range(1).select(key(one).alias("x"), key(two).alias("y"), key(F.create_map(F.lit("j"), F.lit("21"))).alias("z")).first()
    assert got.x == got.y and got.x != got.z and got.x.startswith("a/b.proj|n9|")


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_overlaps_against_all_pairs(spark, n):
    import random

    r = random.Random(n)
    made = [("f" if r.random() < 0.8 else "g", i, r.randrange(400), r.choice((0, 0, 1, 5, 60, 300))) for i in range(n)]
    want = set()
    for f, i, a, x in made:
        for g, j, b, y in made:
            if f == g and i < j and ((a <= b + y and b <= a + x) if not x or not y else (a < b + y and b < a + x)):
                want.add((i, j))
    e = spark.createDataFrame(made, "file string, id int, start int, length int")
    found = spans.overlap_pairs(e, "file", "id", width=16)
    assert sorted((x.a, x.b) for x in found.collect()) == sorted(want)


def test_containment_on_every_level(spark):
    import random

    r = random.Random(7)
    outer = [("d", i, a, a + r.choice((0, 3, 255, 256, 257, 5_000, 70_000, 2_000_000, 900_000_000))) for i, a in enumerate(r.randrange(0, 1_000_000) for _ in range(200))]
    inner = [("d", i, a, a + r.choice((0, 2, 300))) for i, a in enumerate(r.randrange(0, 1_200_000) for _ in range(200))]
    want = {(i, j) for _, i, a, b in inner for _, j, c, e in outer if c <= a and b <= e}
    x = spark.createDataFrame(inner, "doc string, id int, start long, end long")
    y = spark.createDataFrame(outer, "doc string, of int, o_start long, o_end long")
    got = [(v.id, v.of) for v in spans.containment_join(x, y, ["doc"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_evidence(spark):
    df = spark.createDataFrame([("d", 1, 2, "Covered"), ("d", 2, 3, "Uncovered"), ("e", 1, 1, "Unknown")], "doc string, first_line int, last_line int, state string")
    assert rows(evidence.measure_lines(df, ["doc"])) == [("d", 1, 3, True), ("e", 0, 1, False)]
    none = spark.createDataFrame([(0, 0, True), (1, 2, True), (2, 2, False)], "a int, b int, c boolean")
    assert [r[0] for r in none.select(evidence.at_least(F.col("a"), F.col("b"), F.col("c"), 0)).collect()] == [False, True, False]
    review = spark.createDataFrame([("Unknown", ["A"]), ("Unknown", ["A", "B"]), ("Unknown", []), ("Covered", ["A"])], "s string, r array<string>")
    assert [r[0] for r in review.select(evidence.review_unknown(F.col("s"), F.col("r"), ["A"])).collect()] == [True, False, False, False]


def test_edit_plans(spark, tmp_path):
    e = spark.createDataFrame([("f", "p", 0, 2, "x"), ("f", "q", 1, 2, "y"), ("f", "r", 1, 2, "y"), ("g", "s", 0, 0, "z")], "file_identity string, batch_id string, start int, length int, replacement string")
    assert rows(edits.without_conflicts(e), "batch_id") == [("s",)]
    contexts = spark.createDataFrame([("f", "c1"), ("f", "c2"), ("g", "c1")], "file_identity string, context_id string")
    safe = spark.createDataFrame([("p", "c1", True), ("p", "c2", True), ("q", "c1", True), ("s", "c1", True), ("r", "c2", False)], "batch_id string, context_id string, is_safe boolean")
    assert rows(edits.safe_everywhere(e, contexts, safe)) == [("p",), ("s",)]
    assert edits.apply_to_text("a😀bc", [(0, 1, "A"), (3, 1, "B")]) == "A😀Bc"
    path = tmp_path / "x.txt"
    path.write_text("hello")
    digest = hashlib.sha256(b"hello").hexdigest().upper()
    with pytest.raises(ValueError):
        edits.apply_plan(str(tmp_path), [("x.txt", "0" * 64, [(0, 1, "J")])])
    edits.apply_plan(str(tmp_path), [("x.txt", digest, [(0, 1, "J")])], [("x.txt", "sub/y.txt")])
    assert (tmp_path / "sub" / "y.txt").read_text() == "Jello"


@pytest.mark.parametrize("width", [8, 64, 4_096])
def test_conflicting_batches_against_all_pairs(spark, width):
    import random

    r = random.Random(width)
    made, want = [], set()
    for trial in range(150):  # each in a file of its own
        some = [(f"{trial}:{r.randrange(1, 9)}", f"f{trial}", r.randrange(-40, 300), r.choice((0, 0, 1, 3, 30, -1, -4)), r.choice(("x", "x", "x", "y", None))) for _ in range(r.randrange(1, 14))]
        some += [(f"{trial}:{r.randrange(1, 9)}", *r.choice(some)[1:]) for _ in range(r.randrange(3))]  # equal edits
        for b, _, a, x, t in some:
            for c, _, e, y, u in some:
                if b != c and (a, x, t) != (e, y, u) and ((a <= e + y and e <= a + x) if not x or not y else (a < e + y and e < a + x)):
                    want |= {b, c}
        made += some
    made += [(None, "f1", 5, 200, "x"), ("nowhere", None, 5, 2, "x"), ("nowhere 2", None, 5, 2, "y"), ("no place", "f1", None, 4, "x"), ("no length", "f1", 5, None, "x")]
    e = spark.createDataFrame(made, "batch_id string, file_identity string, start int, length int, replacement string")
    assert {x[0] for x in spans.overlapped(e, "file_identity", "batch_id", "replacement", width).collect()} == want
    assert {x for pair in edits.conflicting(e).collect() for x in pair} == want
    assert rows(edits.without_conflicts(e), *e.columns) == sorted((m for m in made if m[0] not in want), key=str)
    assert 100 < len(want) < len({m[0] for m in made}) - 100


def test_conflicts_of_a_crowded_file(spark):
    n = 100_000  # five billion pairs of edits in one bin
    batch = F.concat(F.lit("b"), F.col("id").cast("string"))
    at = F.when(F.col("id") < n, F.col("id") % 50).otherwise(900)
    e = spark.range(n + 2).select(F.lit("f").alias("file_identity"), batch.alias("batch_id"), at.alias("start"), F.lit(5).alias("length"), F.lit("x").alias("replacement"))
    with within(spark, 60):
        assert rows(edits.without_conflicts(e), "batch_id") == [("b100000",), ("b100001",)]


def test_lexer(spark):
    source = 'var s = "// no"; // yes\n/* a\n b */ /// doc\nchar c = \'/\'; @"c:\\" 😀 1.5f'
    df = spark.createDataFrame([("c", "d", source), ("c", "e", None)], "context_id string, document_id string, text string")
    assert [r[0] for r in lexer.comments(df).orderBy("start").select("text").collect()] == ["// yes", "/* a\n b */", "/// doc"]
    last = lexer.tokens(df).orderBy(F.desc("start")).first()
    assert (last.text, last.start) == ("1.5f", len(source.encode("utf-16-le")) // 2 - 4)


def test_snapshots(spark, tmp_path):
    docs = spark.createDataFrame([("c1", "d1", "a.cs", "x", False, "f1", True, "F", "utf-8", False, True), ("c1", "d2", "b.cs", "y", True, "f2", True, "F", "utf-8", False, True)], f"context_id string, {snapshots.DOCUMENT}")
    contexts = spark.createDataFrame([("c1", "n", "n", "p.csproj", "net9", True, False, 1, 12, 2, ["A"], {"k": "v"})], "context_id string, name string, assembly_name string, project_path string, target_framework string, is_analysis_target boolean, is_test_project boolean, nullable_context int, language_version int, output_kind int, preprocessor_symbols array<string>, properties map<string,string>")
    edges_ = spark.createDataFrame([], "src string, dst string")
    packs = spark.createDataFrame([("c1", "P", "1.0")], "context_id string, id string, version string")
    path = str(tmp_path / "s")
    snapshots.write_snapshot(snapshots.Snapshot(contexts, edges_, packs, docs), path)
    back = snapshots.read_snapshot(spark, path)
    assert rows(back.files, "document_id") == [("d1",)] and rows(back.context_edges) == [] and rows(back.packages, "id") == [("P",)]
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, path, version=7)
    for n, wrong in enumerate(([("c1", "c0")], [("c1", "c1")])):
        bad = f"{path}{n}"
        snapshots.write_snapshot(snapshots.Snapshot(contexts, spark.createDataFrame(wrong, "src string, dst string"), packs, docs), bad)
        with pytest.raises(ValueError):
            snapshots.read_snapshot(spark, bad)


def test_status_and_response_documents(spark):
    import json

    found = spark.createDataFrame([("c", "R", "b", 2, 0, "x"), ("c", "R", "a", 9, 1, None)], "context_id string, rule_id string, path string, start int, ordinal int, batch_id string")
    contexts = spark.createDataFrame([("c",), ("d",)], "context_id string")
    made = spark.createDataFrame([("x", "f", 1, 0, "t")], "batch_id string, file_identity string, start int, length int, replacement string")
    got = {v["context_id"]: v for v in (json.loads(r.value) for r in snapshots.response_documents(found, contexts, made).collect())}
    assert [f["path"] for f in got["c"]["findings"]] == ["a", "b"] and got["c"]["batches"][0]["edits"][0]["replacement"] == "t" and got["d"]["version"] == 11
    assert list(snapshots.render_status(iter([{"project_path": "p", "fix_complexity": None, "n": 2}, {"project_path": "p", "fix_complexity": "Local", "n": 1}]))) == ["p: 3", "  Local: 1", "  unspecified: 2"]


def test_loose_files_and_config(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.cs").write_text("class A {}")
    (tmp_path / "b.txt").write_text("no")
    assert rows(snapshots.loose_files(spark, str(tmp_path), "**/*.cs"), "path", "text") == [("src/a.cs", "class A {}")]
    with pytest.raises(ValueError):
        snapshots.loose_files(spark, str(tmp_path), "**/*.py")
    (tmp_path / config.NAME).write_text('{"ignore": ["A"]}')
    assert config.load(str(tmp_path / "src")).ignore == ["A"] and config.load(str(tmp_path / "src"), ignore=["B"]).ignore == ["B"]


def test_rendering():
    found = [{"rule_id": "R", "message": "m", "path": "a b", "line": 3, "column": 1, "batch_id": "x", "disposition": "Violation"}, {"rule_id": "R", "message": "m", "path": ' "q"', "line": 4, "column": 2, "batch_id": None, "disposition": "Review"}]
    assert list(snapshots.render(iter(found))) == ["R: m", "  a b", "    3 +", '  " \\"q\\""', "    4:2 (review)"]


def test_calls_by_catalogue(spark):
    calls = spark.createDataFrame([(1, None, "a", "v1"), (2, "x", "a", "v1"), (3, "w", "a", "v9"), (4, "w", "b", "v1"), (5, "w", "a", "v2"), (6, "w", "a", "v1")], "id int, owner string, operation string, framework string")
    known = spark.createDataFrame([("w", "a", 1, "c")], "owner string, operation string, framework_bits int, capability string")
    got = dict(rows(catalogue.classify_calls(calls, known, ["w"], {"v1": 1, "v2": 2}), "id", "standing"))
    assert got == {1: "Unresolved", 2: "NotStandardSymbol", 3: "UnsupportedFramework", 4: "UnsupportedOperation", 5: "UnsupportedOperation", 6: "Supported"}


def test_streams_take_changed_documents_once(spark, tmp_path):
    from millrace.streaming import incremental

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "document_id string, text string").write.parquet(source)
    stream = spark.readStream.schema("document_id string, text string").parquet(source)
    query = incremental.evaluate_stream(incremental.changed_documents(stream), lambda df: df.select("document_id", "text"), out, str(tmp_path / "check"))
    query.awaitTermination()
    assert rows(spark.read.option("recursiveFileLookup", True).parquet(out), "text") == [("1",), ("2",)]
