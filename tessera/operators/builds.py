"""Builds: sets of (node, rank) under budgets and prerequisites, all builds at once.

nodes: node, tab, cls, ae, te, tab_ae_gate, tab_te_gate, level, max_rank
builds: build, cls, level, max_ae, max_te; selected: build, node, rank
needs: node, required
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def validate(builds: DataFrame, selected: DataFrame, nodes: DataFrame, needs: DataFrame, scope: DataFrame | None = None, free: DataFrame | None = None) -> DataFrame:
    """(build, code, node) issues; legality is that of the final set, whatever the order of choice.

    Of a node that is chosen twice the greatest rank counts. Each row has all
    its codes in one pass; only budgets and prerequisites need an aggregate and
    a join of their own. Runs a job: the rows are written once, being read by
    all three.
    """
    each = selected.groupBy("build", "node").agg(F.max("rank").alias("rank"), F.count("*").alias("_times"))
    rows = each.join(builds, "build").join(nodes.withColumnRenamed("cls", "node_cls").withColumnRenamed("level", "node_level").withColumn("_known", F.lit(True)), "node", "left")
    if scope is not None:
        rows = rows.join(scope.select("node").distinct().withColumn("_scoped", F.lit(True)), "node", "left")
    else:
        rows = rows.withColumn("_scoped", F.lit(True))
    known = F.coalesce("_known", F.lit(False))
    own = known & (F.col("node_cls") == F.col("cls"))
    valid = own & F.coalesce("_scoped", F.lit(False))
    paid = F.greatest("rank", F.lit(1))
    rows = rows.withColumns({"_own": own, "_valid": valid, "_ae": F.when(valid, F.col("ae") * paid), "_te": F.when(valid, F.col("te") * paid)})
    w = Window.partitionBy("build", "tab")
    rows = rows.withColumns({"_tab_ae": F.sum("_ae").over(w) - F.col("_ae"), "_tab_te": F.sum("_te").over(w) - F.col("_te")})
    rows = materialize(rows.select("build", "node", "cls", "rank", "max_rank", "node_level", "level", "max_ae", "max_te", "tab_ae_gate", "tab_te_gate", "_times", "_known", "_own", "_valid", "_ae", "_te", "_tab_ae", "_tab_te"), "build-rows")
    ok = F.col("_valid")
    tests = {
        "duplicate_node": F.col("_times") > 1,
        "unknown_node": F.col("_known").isNull(),
        "wrong_class": F.col("_known") & ~F.col("_own"),
        "node_not_in_scope": F.col("_own") & ~ok,
        "rank_below_minimum": ok & (F.col("rank") < 1),
        "rank_above_maximum": ok & (F.col("rank") > F.col("max_rank")),
        "level_required": ok & (F.col("node_level") > F.col("level")),
        "tab_ae_gate_unmet": ok & (F.col("_tab_ae") < F.col("tab_ae_gate")),
        "tab_te_gate_unmet": ok & (F.col("_tab_te") < F.col("tab_te_gate")),
    }
    out = rows.select("build", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in tests.items()]))).alias("code"), "node")
    sums = rows.filter(ok).groupBy("build").agg(F.sum("_ae").alias("_ae"), F.sum("_te").alias("_te"), F.max("max_ae").alias("max_ae"), F.max("max_te").alias("max_te"))
    over = F.array_compact(F.array(F.when(F.col("_ae") > F.col("max_ae"), "ae_budget_exceeded"), F.when(F.col("_te") > F.col("max_te"), "te_budget_exceeded")))
    out = out.unionByName(sums.select("build", F.explode(over).alias("code"), F.lit(None).cast(nodes.schema["node"].dataType).alias("node")))
    have = rows.select("build", F.col("node").alias("required"))
    if free is not None:
        have = have.unionByName(free.select("build", F.col("node").alias("required"))).distinct()
    exists = nodes.select(F.col("node").alias("required"), F.col("cls").alias("required_cls"))
    if scope is not None:
        exists = exists.join(scope.select(F.col("node").alias("required")).distinct(), "required", "left_semi")
    wanted = rows.filter(ok).select("build", "node", "cls").join(needs, "node").join(exists, "required").filter("required_cls = cls")
    missing = wanted.join(have, ["build", "required"], "left_anti")
    return out.unionByName(missing.select("build", F.lit("required_node_missing").alias("code"), "node"))


def legal_adds(states: DataFrame, candidates: DataFrame, needs: DataFrame, members: DataFrame) -> DataFrame:
    """(state, node) single additions within scope that keep the state legal.

    states: state, scope, level, ae_left, te_left; candidates: scope, node, ae,
    te, level, score; members: scope, state, node. Candidates are those of the state's
    scope, so this is an equi join, not a cross join.
    """
    pairs = states.withColumnRenamed("level", "state_level").join(candidates, "scope").filter("level <= state_level AND ae <= ae_left AND te <= te_left")
    pairs = pairs.join(members, ["scope", "state", "node"], "left_anti")
    unmet = pairs.select("scope", "state", "node").join(needs, "node").join(members.select("scope", "state", F.col("node").alias("required")), ["scope", "state", "required"], "left_anti")
    return pairs.join(unmet.select("scope", "state", "node").distinct(), ["scope", "state", "node"], "left_anti")


def grown_states(states: DataFrame, candidates: DataFrame, needs: DataFrame, branch: int) -> DataFrame:
    """The best additions to each state, equal sets once.

    states: state (sorted id array as string), scope, level, ae_left, te_left,
    nodes (array), spend.
    """
    members = states.select("scope", "state", F.explode("nodes").alias("node"))
    adds = legal_adds(states, candidates, needs, members)
    order = Window.partitionBy("scope", "state").orderBy(F.desc("score"), "node")
    some = adds.withColumn("_b", F.row_number().over(order)).filter(F.col("_b") <= branch)
    grown = F.array_sort(F.array_append("nodes", F.col("node")))
    return some.select(
        F.array_join(F.transform(grown, lambda x: x.cast("string")), ",").alias("state"),
        "scope",
        F.col("state_level").alias("level"),
        (F.col("ae_left") - F.col("ae")).alias("ae_left"),
        (F.col("te_left") - F.col("te")).alias("te_left"),
        grown.alias("nodes"),
        (F.col("spend") + F.col("ae") + F.col("te")).alias("spend"),
    ).dropDuplicates(["scope", "state"])


def _best(states: DataFrame, most: int, *first: Column) -> DataFrame:
    """The best states of each scope: by what they spend plus 0.01 a node, ties by their ids."""
    order = Window.partitionBy("scope").orderBy(*first, F.desc(F.col("spend") + 0.01 * F.size("nodes")), "state")
    return states.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def expand_frontier(states: DataFrame, candidates: DataFrame, needs: DataFrame, branch: int, beam: int) -> DataFrame:
    """One search round: best additions per state, equal sets once, best states per scope."""
    return _best(grown_states(states, candidates, needs, branch), beam)


def best_states(states: DataFrame, candidates: DataFrame, needs: DataFrame, rounds: int, branch: int = 10, beam: int = 5, least_fraction: float = 0.0, top: int = 1) -> DataFrame:
    """Bounded rounds for all scopes in parallel; the best ``top`` states of each scope over all rounds.

    All that a round grows is kept; the best of it grow on. With
    ``least_fraction`` only states count that spend that share of what their
    scope had at first; where none does, the best of all are kept, with the
    warning ``budget_floor_unreachable``. Runs a job each round.
    """
    every = frontier = materialize(states, "frontier")
    for _ in range(rounds):
        grown = materialize(grown_states(frontier, candidates, needs, branch), "grown")
        every, frontier = every.unionByName(grown), _best(grown, beam)
        if grown.isEmpty():
            break
    had = states.groupBy("scope").agg(F.max(F.col("ae_left") + F.col("te_left")).alias("_had"))
    every = every.join(had, "scope").withColumn("_met", F.col("spend") >= F.lit(least_fraction) * F.col("_had"))
    reached = every.groupBy("scope").agg(F.bool_or("_met").alias("_reached"))
    allowed = every.join(reached, "scope").filter("_met OR NOT _reached")
    return _best(allowed, top).withColumn("warning", F.when(~F.col("_reached"), "budget_floor_unreachable")).drop("_reached", "_met", "_had")


def search(states: DataFrame, candidates: DataFrame, needs: DataFrame, rounds: int, branch: int = 10, beam: int = 5, least_fraction: float = 0.0) -> DataFrame:
    """The best state of each scope; see ``best_states``."""
    return best_states(states, candidates, needs, rounds, branch, beam, least_fraction)


#: Issue codes and the state they give, the first that occurs.
ISSUE_STATES = {
    "level_required": "gated_level",
    "tab_ae_gate_unmet": "gated_tab_ae",
    "tab_te_gate_unmet": "gated_tab_te",
    "required_node_missing": "gated_required_node",
    "ae_budget_exceeded": "over_budget",
    "te_budget_exceeded": "over_budget",
}


def node_states(nodes: DataFrame, selected: DataFrame, free: DataFrame, available: DataFrame, issues: DataFrame, by: tuple[str, ...] = ("level", "node")) -> DataFrame:
    """``nodes`` with the state of each in its snapshot.

    Free comes first; then a selected node without issues; then what the issue
    codes say (a selected node with other issues is over budget); then available;
    everything else is inactive. All tables have the columns ``by``; ``issues``
    also ``code``.
    """
    keys, out = list(by), nodes
    for name, marked in (("_free", free), ("_selected", selected), ("_available", available)):
        out = out.join(marked.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    out = out.join(issues.groupBy(*keys).agg(F.collect_set("code").alias("_codes")), keys, "left")
    has = lambda name: F.coalesce(F.col(name), F.lit(False))
    told = F.coalesce(*[F.when(F.array_contains("_codes", code), F.lit(state)) for code, state in ISSUE_STATES.items()])
    state = (
        F.when(has("_free"), "free")
        .when(has("_selected"), F.when(F.col("_codes").isNull(), "selected").otherwise(F.coalesce(told, F.lit("over_budget"))))
        .when(has("_available"), "available")
        .otherwise(F.coalesce(told, F.lit("inactive")))
    )
    return out.withColumn("state", state).drop("_free", "_selected", "_available", "_codes")


# The levels that have an award by the rules.
FIRST_AWARD, LAST_AWARD = 10, 60


def award_schedule(levels: DataFrame, first: int | None = FIRST_AWARD, last: int | None = LAST_AWARD) -> DataFrame:
    """Awards alternate by the parity of the level, from ``first`` to ``last`` (None: no bound); other levels have none. Running sums are the budgets; a null level comes last."""
    w = Window.orderBy(F.col("level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    some = levels if first is None else levels.filter(F.col("level") >= first)
    some = some if last is None else some.filter(F.col("level") <= last)
    awards = some.withColumns({"ae_award": (F.col("level") % 2 == 0).cast("int"), "te_award": (F.col("level") % 2 == 1).cast("int")})
    return awards.withColumns({"ae_total": F.sum("ae_award").over(w), "te_total": F.sum("te_award").over(w)})


# What a place in the guide is worth, and the tags that fit a role.
SECTION_VALUES = {"core": 60.0, "priority": 40.0, "cooldown": 35.0, "role": 35.0}
ROLE_FIT = {
    "dps": ("damage", "melee", "ranged", "caster", "dot", "spender", "builder"),
    "tank": ("tank", "defensive", "mitigation"),
    "healer": ("heal", "healing"),
    "support": ("support", "utility", "aura", "buff"),
}
FIT_VALUE, UNMET_VALUE = 20.0, -10.0


def marginal_values(nodes: DataFrame, named: DataFrame, needs: DataFrame, selected: DataFrame) -> DataFrame:
    """``nodes`` (node, name, tags, level, role) with the ``value`` of taking each next.

    100, plus what its name is worth in each section of the guide (named:
    section, name), plus 20 if a tag fits the role, less 10 if a prerequisite
    (needs: node, required) is not selected yet, plus up to 10 for an early level.
    """
    worth = F.create_map(*[F.lit(x) for pair in SECTION_VALUES.items() for x in pair])
    guide = named.select("section", "name").distinct().groupBy("name").agg(F.sum(F.coalesce(F.try_element_at(worth, F.col("section")), F.lit(0.0))).alias("_guide"))
    unmet = needs.join(selected.select(F.col("node").alias("required")).distinct(), "required", "left_anti").select("node").distinct().withColumn("_unmet", F.lit(UNMET_VALUE))
    kind = F.when(F.endswith("role", F.lit("_dps")), "dps").otherwise(F.col("role"))
    tags = F.transform("tags", lambda t: F.lower(t))
    fits = F.lit(False)
    for role, fit in ROLE_FIT.items():
        fits = fits | ((kind == role) & F.arrays_overlap(tags, F.array(*[F.lit(t) for t in fit])))
    out = nodes.join(guide, "name", "left").join(unmet, "node", "left")
    zero = F.lit(0.0)
    value = F.lit(100.0) + F.coalesce("_guide", zero) + F.when(fits, FIT_VALUE).otherwise(0.0) + F.coalesce("_unmet", zero) + F.greatest(zero, 10.0 - F.col("level") / 10.0)
    return out.withColumn("value", F.round(value, 4)).drop("_guide", "_unmet")
