"""Graphs as edge tables; fixpoints as rounds that are written to the shared folder, until nothing changes.

Each round runs a job while the plan is made. Rounds end by themselves: every
one adds or removes at least one of finitely many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def undirected(rows: DataFrame, node: str, linked: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) edges from arrays of linked ids, each once with a < b; and the endpoints that don't exist."""
    pairs = rows.select(F.col(node).alias("x"), F.explode(linked).alias("y")).filter("x <> y")
    nodes = rows.select(F.col(node).alias("y")).distinct()
    missing = pairs.join(nodes, "y", "left_anti").select(F.col("x").alias("node"), F.col("y").alias("missing")).distinct()
    edges = pairs.join(nodes, "y", "left_semi").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return edges, missing


def tree_edges(rows: DataFrame, node: str, linked: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(a, b, kind) edges of a tree, and its warnings.

    Connections stand once, the smaller id first; a requirement goes from what
    is required to the node that asks for it. An end that is not in the tree
    gives a warning (code, a, b) in place of an edge.
    """
    edges, missing = undirected(rows, node, linked)
    asks = rows.select(F.explode(required).alias("a"), F.col(node).alias("b")).distinct()
    nodes = rows.select(F.col(node).alias("a")).distinct()
    out = edges.withColumn("kind", F.lit("connection")).unionByName(asks.join(nodes, "a", "left_semi").withColumn("kind", F.lit("requirement")))
    told = missing.select(F.lit("tree_edge_missing_target").alias("code"), F.col("node").alias("a"), F.col("missing").alias("b"))
    return out, told.unionByName(asks.join(nodes, "a", "left_anti").select(F.lit("tree_requirement_missing_source").alias("code"), "a", "b"))


def gate_edges(nodes: DataFrame, node: str, gates: dict[str, str]) -> DataFrame:
    """Edges from synthetic sources ``tab:ID:KIND:N`` for positive thresholds."""
    parts = [nodes.filter(F.col(c) > 0).select(F.concat_ws(":", F.lit("tab"), F.col("tab").cast("string"), F.lit(kind), F.col(c).cast("string")).alias("src"), F.col(node).alias("dst"), F.lit("gate").alias("kind")) for kind, c in gates.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_states(edges: DataFrame, selected: DataFrame, available: DataFrame) -> DataFrame:
    """Edges from a to b with their state.

    selected: both ends are; available: a is selected and b can be; gated: b is
    selected and a isn't; else inactive.
    """
    mark = lambda flags, end, name: flags.select(F.col("node").alias(end)).distinct().withColumn(name, F.lit(True))
    out = edges.join(mark(selected, "a", "_sa"), "a", "left").join(mark(selected, "b", "_sb"), "b", "left").join(mark(available, "b", "_vb"), "b", "left")
    s_a, s_b, v_b = (F.coalesce(F.col(c), F.lit(False)) for c in ("_sa", "_sb", "_vb"))
    state = F.when(s_a & s_b, "selected").when(s_a & v_b, "available").when(s_b & ~s_a, "gated").otherwise("inactive")
    return out.select(*edges.columns, state.alias("state"))


def reference_faults(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) edges to itself or to a node that doesn't exist."""
    own = edges.filter("src = dst").select("src", "dst", F.lit("self_reference").alias("fault"))
    lost = edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst", F.lit("dangling_reference").alias("fault"))
    return own.unionByName(lost)


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, distance) over directed (src, dst) edges from the roots; at most ``depth`` steps if given.

    Only the frontier is joined each round.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "reach-edges")
    seen = frontier = materialize(roots.select("node").distinct().withColumn("distance", F.lit(0)), "reach")
    step = 0
    while depth is None or step < depth:
        step += 1
        near = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(near.join(seen, "node", "left_anti").withColumn("distance", F.lit(step)), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if step % 8 == 0:
            seen = materialize(seen, "reach-seen")
    return seen


def dependency_closure(targets: DataFrame, needs: DataFrame, paid: DataFrame) -> DataFrame:
    """(node) targets with all that they need, transitively, of what has to be paid for.

    needs: node, required; paid: node. An unpaid or unknown prerequisite neither
    enters nor leads on to others.
    """
    edges = needs.join(paid.select(F.col("node").alias("required")).distinct(), "required", "left_semi")
    return reachable(edges.select(F.col("node").alias("src"), F.col("required").alias("dst")), targets).select("node")


def tab_reach(nodes: DataFrame, links: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (by, node) with whether each is a root, and whether the links lead to it from one.

    Links are undirected, and count, like prerequisites, only within one group
    ``by`` (a class and tab). Roots have no prerequisite there; the others that
    no root leads to are orphans.
    """
    inside = nodes.select(*by, "node").distinct()
    other = inside.withColumnRenamed("node", "dst")
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    key = F.struct(*by, "node")
    within = both.join(inside.withColumnRenamed("node", "src"), "src").join(other, [*by, "dst"])
    edges = within.select(F.struct(*by, F.col("src").alias("node")).alias("src"), F.struct(*by, F.col("dst").alias("node")).alias("dst"))
    held = needs.join(inside, "node").join(inside.withColumnRenamed("node", "required"), [*by, "required"]).select(*by, "node").distinct()
    roots = inside.join(held, [*by, "node"], "left_anti")
    seen = reachable(edges, roots.select(key.alias("node"))).select(F.col("node").alias("k"))
    marked = inside.join(roots.withColumn("root", F.lit(True)), [*by, "node"], "left").withColumn("k", key).join(seen.withColumn("reached", F.lit(True)), "k", "left").drop("k")
    return marked.withColumns({"root": F.coalesce("root", F.lit(False)), "reached": F.coalesce("reached", F.lit(False))})


def tab_faults(reach: DataFrame, by: list[str]) -> DataFrame:
    """Per group: a tab of several nodes without a root, and how many orphans there are."""
    one = reach.groupBy(*by).agg(F.count("*").alias("nodes"), F.count_if("root").alias("roots"), F.count_if(~F.col("reached")).alias("orphans"))
    fault = F.when((F.col("nodes") > 1) & (F.col("roots") == 0), "no_root").when(F.col("orphans") > 0, "orphan_nodes")
    return one.withColumn("fault", fault)


def in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle of prerequisites or behind one: what remains when nodes without open prerequisites are peeled off.

    (src, dst): dst needs src.
    """
    left = materialize(edges.select("src", "dst").distinct(), "peel")
    n = left.count()
    while True:
        held = left.select(F.col("dst").alias("src")).distinct()
        left = materialize(left.join(held, "src", "left_semi"), "peel")
        now = left.count()
        if now == n:
            return left.select(F.col("dst").alias("node")).distinct()
        n = now


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both something before and something after them, again and again."""
    left = materialize(edges.select("src", "dst").distinct(), "trim")
    n = left.count()
    while n:
        before, after = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = materialize(left.join(before, "src", "left_semi").join(after, "dst", "left_semi").select("src", "dst"), "trim")
        now = left.count()
        if now == n:
            break
        n = now
    return left


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of directed (src, dst) edges: nodes that a path leads back to, with the smallest node of their component.

    Peeling from both sides leaves the cycles and what lies between them. Then
    every node takes the smallest node that reaches it as its colour; from each
    colour's own node its component is found backwards within the colour.
    Components are taken out and the rest is peeled again, until none is left.
    Every pass is a join of the edges left; rounds end as each takes nodes away.
    """
    found = None
    left = _trimmed(edges)
    while not left.isEmpty():
        ends = left.select(F.col("src").alias("node")).union(left.select("dst"))
        colours = materialize(ends.distinct().withColumn("colour", F.col("node")), "colours")
        while True:
            told = left.join(colours, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("colour").alias("_c"))
            better = colours.join(told, F.col("node") == F.col("dst"), "left").select("node", "colour", F.least("colour", "_c").alias("_n"))
            better = materialize(better, "colours")
            changed = better.filter("_n < colour").limit(1).count()
            colours = better.select("node", F.col("_n").alias("colour"))
            if not changed:
                break
        source = colours.select(F.col("node").alias("src"), F.col("colour").alias("_s"))
        target = colours.select(F.col("node").alias("dst"), F.col("colour").alias("_t"))
        inside = materialize(left.join(source, "src").join(target, "dst").filter("_s = _t").select("src", "dst"), "one-colour")
        roots = colours.filter("node = colour").select("node")
        back = reachable(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots).select("node")
        taken = materialize(back.join(colours, "node"), "components")
        held = materialize(inside.join(taken.select(F.col("node").alias("src")), "src", "left_semi").join(taken.select(F.col("node").alias("dst")), "dst", "left_semi"), "component-edges")
        several = held.select(F.col("src").alias("node")).distinct()  # a component of one node has no edge, unless to itself
        members = taken.join(several, "node", "left_semi").select("node", F.col("colour").alias("cycle"))
        found = members if found is None else found.unionByName(members)
        out = taken.select("node")
        rest = left.join(out.withColumnRenamed("node", "src"), "src", "left_anti").join(out.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trimmed(rest)
    if found is None:
        node = edges.select(F.col("src").alias("node"))
        return node.limit(0).withColumn("cycle", F.col("node"))
    return found


def closure(free: DataFrame, needs: DataFrame, have: DataFrame) -> DataFrame:
    """Free nodes whose prerequisites are all met, transitively, for all builds at once.

    ``free`` (build, node); ``needs`` (node, required), only rows whose required
    node exists in scope; ``have`` (build, node). Result: (build, node).
    """
    wanted = materialize(free.select("build", "node").join(needs, "node", "left"), "closure-needs")
    out = materialize(wanted.filter("required IS NULL").select("build", "node").distinct(), "closure")
    open_needs = materialize(wanted.filter("required IS NOT NULL").join(have.select("build", F.col("node").alias("required")).distinct(), ["build", "required"], "left_anti"), "closure-open")
    blocked = open_needs.select("build", "node").distinct()
    met = wanted.filter("required IS NOT NULL").select("build", "node").distinct().join(blocked, ["build", "node"], "left_anti")
    fresh = materialize(out.unionByName(met).distinct(), "closure")
    out = fresh
    while True:
        open_needs = materialize(open_needs.join(fresh.select("build", F.col("node").alias("required")), ["build", "required"], "left_anti"), "closure-open")
        still = open_needs.select("build", "node").distinct()
        fresh = materialize(blocked.join(still, ["build", "node"], "left_anti"), "closure")
        blocked = still
        if fresh.isEmpty():
            return out
        out = materialize(out.unionByName(fresh), "closure-out")


def grid(nodes: DataFrame) -> DataFrame:
    """Tree kind, pixel place of a grid cell, and the size of its tree.

    The class tab and what costs ability essence is ``ability_essence``; what
    costs nothing and stands from column 10 on ``level_passives``; the rest
    ``talent_essence`` (costs: ae, te, 0 where absent). Sizes are one small
    aggregate that is joined back.
    """
    cost = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in nodes.columns else F.lit(0)
    kind = F.when((F.col("tab") == "Class") | (cost("ae") > 0), "ability_essence").when((cost("te") == 0) & (F.coalesce("col", F.lit(0)) >= 10), "level_passives").otherwise("talent_essence")
    placed = nodes.withColumns({"tree_kind": kind, "x": F.col("col") * 64 + 32, "y": F.col("row") * 64 + 32})
    sizes = placed.groupBy("tree_kind").agg((F.max("x") + 32).alias("width"), (F.max("y") + 32).alias("height"))
    return placed.join(sizes, "tree_kind")


def overlay_layout(grid_nodes: DataFrame, layout: DataFrame) -> DataFrame:
    """A captured layout (node, x, y) wins over the grid; nodes of one side only are kept with a warning."""
    g, c = grid_nodes.select("node", F.col("x").alias("gx"), F.col("y").alias("gy")), layout.select("node", F.col("x").alias("cx"), F.col("y").alias("cy"))
    both = g.join(c, "node", "full_outer")
    warning = F.when(F.col("gx").isNull(), "layout_node_unknown").when(F.col("cx").isNull(), "fallback_position")
    return both.select("node", F.coalesce("cx", "gx").alias("x"), F.coalesce("cy", "gy").alias("y"), warning.alias("warning"))
