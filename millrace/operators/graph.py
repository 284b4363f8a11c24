"""Graphs: closure, reachability, components, shortest paths, callees, bounded traversal, cliques, dataflow.

Loops hold frames on the cluster and counts on the driver.  Each round writes only
what is new to the shared folder; what was found before is read, not written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.session import Gathered, cut_lineage


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("e_src"), F.col(dst).alias("e_dst")).where("e_src is not null and e_dst is not null").distinct()


def _grow(e: DataFrame, first: DataFrame, step: int, depth: int | None = None) -> DataFrame:
    """(start, node, depth): what ``first`` reaches over edges ``e``, semi-naively; its own depth is step - 1."""
    front = cut_lineage(first.withColumn("depth", F.lit(step - 1)))
    seen = Gathered(front)
    while depth is None or step <= depth:
        new = front.join(e, front["node"] == e["e_src"]).select("start", F.col("e_dst").alias("node")).distinct()
        front = cut_lineage(new.join(seen.rows().select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(step)))
        if front.isEmpty():
            break
        seen.add(front)
        step += 1
    return seen.rows()


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(start, node, depth): the fewest steps from each start to each node.

    With ``nodes`` (one column) the closure is reflexive and starts there.
    """
    e = cut_lineage(_edges(edges, src, dst))
    if nodes is not None:
        return _grow(e, nodes.toDF("start").distinct().select("start", F.col("start").alias("node")), 1, depth)
    return _grow(e, e.toDF("start", "node").distinct(), 2, depth)


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links (a, b) reaches, either way.

    Large-star and small-star rounds: their number grows with the logarithm of a
    component, and no pairs of its nodes are made.
    """
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).where("node is not null").distinct()
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = cut_lineage(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")).distinct())
        done = edges.join(after, ["u", "v"], "left_anti").isEmpty() and edges.count() == after.count()
        edges = after
        if done:
            break
    root = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def call_edges(sites: DataFrame, delegates: bool = False, dispatch: DataFrame | None = None, configured: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, ordinal) of call sites under a policy: deferred sites, implementations and own edges are opt-in."""
    bound = sites.where(F.col("callee").isNotNull()).where(F.lit(delegates) | ~F.coalesce(F.col("deferred"), F.lit(False)))
    out = bound.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "ordinal")
    if dispatch is not None:  # (target, implementation)
        out = out.unionByName(sites.join(dispatch, "target").select(F.col("caller").alias("src"), F.col("implementation").alias("dst"), "ordinal"))
    if configured is not None:
        out = out.unionByName(configured.select("src", "dst", F.lit(1 << 30).alias("ordinal")))
    return out.distinct()


def steps(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, ordinal): one call from each start, in source order by ``ordinal``."""
    e = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), "ordinal")
    return e.join(starts.toDF("start").distinct(), "start", "left_semi").groupBy("start", "node").agg(F.min("ordinal").alias("ordinal"))


def reaches(edges: DataFrame, starts: DataFrame, targets: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(start, reaches): whether a path of at least one edge leads to a target; boundary nodes are never entered.

    The walk goes backwards from all targets at once: each node enters it once.
    """
    e = edges.select("src", "dst")
    if boundary is not None:
        e = e.join(boundary.toDF("dst"), "dst", "left_anti").select("src", "dst")
    e = cut_lineage(_edges(e, "src", "dst"))
    front = cut_lineage(e.join(targets.toDF("e_dst").distinct(), "e_dst", "left_semi").select(F.col("e_src").alias("node")).distinct())
    seen = Gathered(front)
    while not front.isEmpty():
        new = e.join(front, e["e_dst"] == front["node"], "left_semi").select(F.col("e_src").alias("node")).distinct()
        front = cut_lineage(new.join(seen.rows(), "node", "left_anti"))
        seen.add(front)
    hit = seen.rows().select(F.col("node").alias("start"), F.lit(True).alias("reaches"))
    return starts.toDF("start").distinct().join(hit, "start", "left").select("start", F.coalesce("reaches", F.lit(False)).alias("reaches"))


def paths_from(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, node, depth) over at least one edge: a start comes back only around a cycle."""
    e = cut_lineage(_edges(edges, "src", "dst"))
    first = starts.toDF("start").distinct().join(e, F.col("start") == e["e_src"]).select("start", F.col("e_dst").alias("node")).distinct()
    return _grow(e, first, 2, depth)


def callees(edges: DataFrame, starts: DataFrame, boundary: DataFrame | None = None, owners: DataFrame | None = None, transitive: bool = True) -> DataFrame:
    """(start, node, depth): everything called; a boundary node is given but not expanded, and a cycle gives the start.

    With ``owners`` (node, owner) only calls that stay in their caller's type are followed.
    """
    e = edges.select("src", "dst")
    if owners is not None:
        a, b = owners.select(F.col("node").alias("src"), F.col("owner").alias("_a")), owners.select(F.col("node").alias("dst"), F.col("owner").alias("_b"))
        e = e.join(a, "src").join(b, "dst").where("_a = _b").select("src", "dst")
    if boundary is not None:
        blocked = boundary.toDF("b").distinct().join(starts.toDF("b").distinct(), "b", "left_anti")
        e = e.join(blocked, e["src"] == blocked["b"], "left_anti")
    return paths_from(e, starts, None if transitive else 1)


def path_to(edges: DataFrame, starts: DataFrame, targets: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(start, target, path): a shortest path, by source order among equals; boundary nodes are never entered."""
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), "ordinal")
    if boundary is not None:
        e = e.join(boundary.toDF("e_dst"), "e_dst", "left_anti")
    e = cut_lineage(e.groupBy("e_src", "e_dst").agg(F.min("ordinal").alias("ordinal")))
    pick = Window.partitionBy("start", "node").orderBy("rank")

    def grow(front: DataFrame) -> DataFrame:
        step = front.join(e, front["node"] == e["e_src"]).select("start", F.col("e_dst").alias("node"), F.concat("path", F.array("e_dst")).alias("path"), F.concat("rank", F.array("ordinal")).alias("rank"))
        return step.withColumn("_nth", F.row_number().over(pick)).where("_nth = 1").drop("_nth")

    begin = starts.toDF("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<int>").alias("rank"))
    front = cut_lineage(grow(begin))
    seen = Gathered(front)
    while not front.isEmpty():
        front = cut_lineage(grow(front).join(seen.rows().select("start", "node"), ["start", "node"], "left_anti"))
        seen.add(front)
    goal = targets.toDF("node").distinct()
    return seen.rows().join(goal, "node", "left_semi").select("start", F.col("node").alias("target"), "path")


COMPLETE, UNRESOLVED, DEPTH_LIMIT, STATE_LIMIT = 0, 1, 2, 4


def traverse(seeds: DataFrame, edges: DataFrame, most_depth: int = 32, most_states: int = 1024, stop: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth, status): nodes reached from each seed within limits, and what cut the traversal short.

    Edges (src, dst, and ordinal or else by dst) with a null dst are unresolved ends.
    Nodes come in the order of a queue: by the place of the node before, then by
    ordinal.  At the limit of states a traversal ends on the spot, and what stands behind
    in the queue says nothing any more.  Nodes of ``stop`` are given, not expanded.  Status
    is a set of flags, the same on all rows of a seed; a null seed is unresolved and keeps
    a row without a node.
    """
    place = F.col("ordinal") if "ordinal" in edges.columns else F.lit(0)
    e = cut_lineage(edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), place.alias("e_ordinal")).distinct())
    halt = stop.toDF("node").distinct() if stop is not None else None
    named = seeds.toDF("seed").distinct()
    front = cut_lineage(named.where("seed is not null").select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(1).cast("long").alias("at"), F.lit(1).cast("long").alias("have")))
    seen, flags = Gathered(front.select("seed", "node", "depth")), Gathered(front.select("seed", F.lit(COMPLETE).alias("flag")))
    queue = Window.partitionBy("seed").orderBy("at", "e_ordinal", F.col("node").asc_nulls_last())
    for depth in range(1, most_depth + 2):
        open_ = front if halt is None else front.join(halt, "node", "left_anti")
        moved = open_.select("seed", "at", "have", F.col("node").alias("before"))
        entries = moved.join(e, F.col("before") == e["e_src"]).select("seed", "have", "at", "e_ordinal", F.col("e_dst").alias("node"))
        entries = cut_lineage(entries.withColumn("pos", F.row_number().over(queue)).select("seed", "have", "node", "pos"))
        if entries.isEmpty():
            break
        new = entries.where("node is not null").groupBy("seed", "node").agg(F.min("pos").alias("pos"), F.max("have").alias("have"))
        new = new.join(seen.rows().select("seed", "node"), ["seed", "node"], "left_anti")
        if depth > most_depth:
            found = new.select("seed", F.lit(DEPTH_LIMIT).alias("flag")).unionByName(entries.where("node is null").select("seed", F.lit(UNRESOLVED).alias("flag")))
            flags.add(cut_lineage(found.distinct()))
            break
        ranked = cut_lineage(new.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("pos")) + F.col("have")))
        full = ranked.where(F.col("rank") == most_states + 1).select("seed", F.col("pos").alias("end"))
        ends = entries.where("node is null").join(full, "seed", "left").where("end is null or pos < end").select("seed", F.lit(UNRESOLVED).alias("flag"))
        flags.add(cut_lineage(ends.unionByName(full.select("seed", F.lit(STATE_LIMIT).alias("flag"))).distinct()))
        kept = cut_lineage(ranked.where(F.col("rank") <= most_states).select("seed", "node", F.lit(depth).alias("depth"), F.col("pos").cast("long").alias("at"), "rank"))
        if kept.isEmpty():
            break
        seen.add(kept.select("seed", "node", "depth"))
        going = kept.join(full.select("seed"), "seed", "left_anti")
        have = going.groupBy("seed").agg(F.max("rank").cast("long").alias("have"))
        front = going.join(have, "seed").select("seed", "node", "depth", "at", "have")
    status = flags.rows().groupBy("seed").agg(F.bit_or("flag").alias("status"))
    lost = named.where("seed is null").select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(UNRESOLVED).alias("status"))
    return seen.rows().join(status, "seed").unionByName(lost)


def where_type(reached: DataFrame, condition: Column) -> DataFrame:
    """(seed, status, nodes): the nodes (node, depth) of each seed that fit, in order; a seed without one keeps its row."""
    fit = F.when(F.coalesce(condition, F.lit(False)), F.struct("depth", "node"))
    return reached.groupBy("seed").agg(F.max("status").alias("status"), F.transform(F.array_sort(F.array_compact(F.collect_list(fit))), lambda x: x["node"]).alias("nodes"))


def type_edges(properties: DataFrame, arguments: DataFrame | None = None, elements: DataFrame | None = None, unwrap: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """(src, dst, ordinal) that a traversal of types follows: its properties, generic arguments, array elements.

    ``properties``, ``arguments`` and ``elements`` have (src, dst, ordinal).  A type of
    ``unwrap`` (type, inner) is replaced by its inner type wherever it is a goal; a type
    of ``skip`` is hidden, and its own edges take its place.
    """
    out = properties.select("src", "dst", "ordinal")
    for more in (arguments, elements):
        if more is not None:
            out = out.unionByName(more.select("src", "dst", "ordinal"))
    if unwrap is not None:
        inner = unwrap.select(F.col("type").alias("_type"), F.col("inner").alias("_inner"))
        out = out.join(inner, F.col("dst") == F.col("_type"), "left").select("src", F.when(F.col("_type").isNotNull(), F.col("_inner")).otherwise(F.col("dst")).alias("dst"), "ordinal")
    if skip is not None:
        hidden = skip.toDF("_hidden").distinct()
        through = closure(out.join(hidden, F.col("dst") == F.col("_hidden"), "left_semi").select("src", "dst"))
        own = out.join(hidden, F.col("dst") == F.col("_hidden"), "left_anti").join(hidden, F.col("src") == F.col("_hidden"), "left_anti")
        behind = through.join(hidden, F.col("node") == F.col("_hidden"), "left_semi").join(hidden, F.col("start") == F.col("_hidden"), "left_anti").select(F.col("start").alias("_start"), "node")
        lifted = out.join(hidden, F.col("dst") == F.col("_hidden"), "left_anti").join(behind, F.col("src") == F.col("node")).select(F.col("_start").alias("src"), "dst", "ordinal")
        out = own.unionByName(lifted)
    return out.distinct()


def seeds_of(*selectors: DataFrame) -> DataFrame:
    """(seed): the types that several selectors name, each once; an unresolved one (null) is kept."""
    out = selectors[0].toDF("seed")
    for more in selectors[1:]:
        out = out.unionByName(more.toDF("seed"))
    return out.distinct()


def traverse_inputs(starts: DataFrame, inputs: DataFrame, most: int = 16) -> DataFrame:
    """(start, path, node, depth, is_boundary): what each expression is made of, along every path in source order.

    ``inputs`` has (src, dst, ordinal): the configured inputs of calls and locals.  A
    path ends at a node without inputs, at one that it holds already, or beyond
    ``most`` steps; the last two are boundaries.
    """
    e = cut_lineage(inputs.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), "ordinal").distinct())
    front = cut_lineage(starts.toDF("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), F.array().cast("array<int>").alias("path")))
    out = None
    for depth in range(most + 1):
        step = front.join(e, front["node"] == e["e_src"], "left")
        ends = step.where("e_src is null").select("start", "path", "node", F.lit(depth).alias("depth"), F.lit(False).alias("is_boundary"))
        grown = step.where("e_src is not null").select("start", F.col("e_dst").alias("node"), "nodes", F.concat("path", F.array(F.col("ordinal").cast("int"))).alias("path"))
        again = grown.where(F.col("node").isNull() | F.array_contains("nodes", F.col("node")))
        ends = ends.unionByName(again.select("start", "path", "node", F.lit(depth + 1).alias("depth"), F.lit(True).alias("is_boundary")))
        going = grown.where("node is not null").where(~F.array_contains("nodes", F.col("node")))
        if depth == most:
            ends = ends.unionByName(going.select("start", "path", "node", F.lit(depth + 1).alias("depth"), F.lit(True).alias("is_boundary")))
        ends = cut_lineage(ends)
        out = ends if out is None else out.unionByName(ends)
        front = cut_lineage(going.select("start", "node", F.concat("nodes", F.array("node")).alias("nodes"), "path"))
        if front.isEmpty():
            break
    return out


def result_values(starts: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(start, value): the expressions that each may result in: alternatives of choices, followed to those that have none."""
    reach = closure(alternatives, "src", "dst", nodes=starts)
    inner = alternatives.select(F.col("src").alias("node")).distinct()
    return reach.join(inner, "node", "left_anti").select("start", F.col("node").alias("value"))


def call_chains(calls: DataFrame) -> DataFrame:
    """(chain, position, call): calls linked by their receivers (call, receiver_call), the innermost receiver first.

    A chain is named by its last call; one that no call receives ends a chain.
    """
    last = calls.join(calls.select(F.col("receiver_call").alias("call")).where("call is not null").distinct(), "call", "left_anti").select("call")
    links = calls.where("receiver_call is not null")
    reach = closure(links, "call", "receiver_call", nodes=last)
    order = Window.partitionBy("start").orderBy(F.desc("depth"))
    return reach.select(F.col("start").alias("chain"), F.row_number().over(order).alias("position"), F.col("node").alias("call"))


def compatible_views(roots: DataFrame, compatible: DataFrame) -> DataFrame:
    """(framework, view, root): the maximal cliques of pairwise compatible roots of each framework.

    ``compatible`` has (framework, a, b).  One group is one framework's roots: the
    contexts of a solution, whose number does not grow with its text.
    """
    both = compatible.select("framework", "a", "b").unionByName(compatible.select("framework", F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = roots.select("framework", F.col("root").alias("a"), F.lit(None).cast(roots.schema["root"].dataType).alias("b")).unionByName(both)

    def views(group: pd.DataFrame) -> pd.DataFrame:
        near: dict = {a: set() for a in group["a"]}
        for a, b in group[["a", "b"]].dropna().itertuples(index=False):
            if a != b and a in near and b in near:
                near[a].add(b)
        found = sorted(tuple(sorted(c)) for c in maximal_cliques(near))
        rows = [(group["framework"].iloc[0], i, root) for i, c in enumerate(found) for root in c]
        return pd.DataFrame(rows, columns=["framework", "view", "root"])

    kinds = {f.name: f.dataType.simpleString() for f in roots.schema}
    return pairs.groupBy("framework").applyInPandas(views, f"framework {kinds['framework']}, view int, root {kinds['root']}")


def maximal_cliques(near: dict) -> Iterator[set]:
    """Every maximal clique of an undirected graph, without recursion: pivots cut the branches."""
    todo = [(set(), set(near), set())]
    while todo:
        clique, maybe, done = todo.pop()
        if not maybe and not done:
            yield clique
            continue
        pivot = max(sorted(maybe | done), key=lambda v: len(near[v] & maybe))
        for v in sorted(maybe - near[pivot]):
            todo.append((clique | {v}, maybe & near[v], done & near[v]))
            maybe = maybe - {v}
            done = done | {v}


def reaching_definitions(flow: DataFrame, definitions: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """(block, definition): definitions that reach the start of each block, to a fixpoint.

    ``flow`` has (src, dst) blocks, ``definitions`` (block, variable, definition); the last
    definition of a variable in a block kills the others.  A handler block receives
    every definition of the blocks before it.
    """
    made = cut_lineage(definitions.select("block", "variable", "definition"))
    last = made.groupBy("block", "variable").agg(F.max("definition").alias("definition"))
    kill = made.select("block", "variable").distinct()
    e = cut_lineage(_edges(flow, "src", "dst"))
    out = cut_lineage(last.select("block", "variable", "definition"))
    if handlers is not None:
        guarded = e.join(handlers.toDF("e_dst"), "e_dst", "left_semi")
        extra = made.join(guarded, made["block"] == guarded["e_src"]).select(F.col("e_dst").alias("block"), "variable", "definition")
    key = ["block", "variable", "definition"]
    arrive = out.join(e, out["block"] == e["e_src"]).select(F.col("e_dst").alias("block"), "variable", "definition")
    new = cut_lineage((arrive if handlers is None else arrive.unionByName(extra)).distinct())
    into, gone = Gathered(new), Gathered(out)
    while True:
        front = cut_lineage(new.join(kill, ["block", "variable"], "left_anti").join(gone.rows(), key, "left_anti"))
        if front.isEmpty():
            return into.rows()
        gone.add(front)
        arrive = front.join(e, front["block"] == e["e_src"]).select(F.col("e_dst").alias("block"), "variable", "definition").distinct()
        new = cut_lineage(arrive.join(into.rows(), key, "left_anti"))
        into.add(new)


def view_contexts(views: DataFrame, context_edges: DataFrame) -> DataFrame:
    """(framework, view, context_id): every context that a view's roots include, themselves among them."""
    reach = closure(context_edges, nodes=views.select("root").distinct())
    return views.join(reach, F.col("root") == F.col("start")).select("framework", "view", F.col("node").alias("context_id")).distinct()


def has_cycle(edges: DataFrame, src: str = "src", dst: str = "dst") -> bool:
    """Whether edges form a cycle: nodes without an edge into them go, again and again, until none is left or none goes."""
    e = cut_lineage(_edges(edges, src, dst))
    while not e.isEmpty():
        left = cut_lineage(e.join(e.select(F.col("e_dst").alias("e_src")).distinct(), "e_src", "left_semi"))
        if left.count() == e.count():
            return True
        e = left
    return False


def severity_of(origins: Column) -> Column:
    """Precedence of nullable origins: Oblivious over Unknown over Aware."""
    return F.when(F.array_contains(origins, "Oblivious"), "Oblivious").when(F.array_contains(origins, "Unknown"), "Unknown").otherwise("Aware")
