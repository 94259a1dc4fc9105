"""Queries over builds: an order is a build, its parts are the nodes, its customer the scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import engine_role
from tessera.operators import builds as bd
from tessera.operators import graph, mechanics, report, rules, score, similarity
from tessera.plans.common import table
from tessera.session import materialize

ROLES = ("melee_dps", "tank", "healer", "support", "caster_dps", "ranged_dps")
TEXTS = (
    "Deals {n} fire damage every 3 sec for 12 sec. Costs {n} Energy.",
    "Heals an ally for {n} over 8 sec. 30 sec cooldown. Costs 20 mana, Costs 5 Focus.",
    "Increases armor by 10% for 10 seconds. 2 charges.",
    "Summons a companion. 15% chance, once every 45 sec, on up to 3 enemies.",
    "A plain look at the shot of an archer",
)
TAGS = (("dot", "builder"), ("heal",), ("tank", "cooldown"), ("melee", "spender"), ("aura", "Crowd Control"), ())
CATEGORIES = ("builder", "spender", "maintenance", "cooldown", "defensive", "healing", "support", "filler")


def pick(values: tuple, at: Column) -> Column:
    made = [F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, tuple) else F.lit(v) for v in values]
    return F.get(F.array(*made), at.cast("int"))


def pick_sql(values: tuple, at: str) -> str:
    made = ["[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, tuple) else f"'{v}'" for v in values]
    return "CASE " + at + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(made)) + " END"


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("cls"), F.col("p_type").alias("tab"), F.replace(pick(TEXTS, z % 5), F.lit("{n}"), z.cast("string")).alias("text"), pick(TAGS, k % 6).alias("tags"),
        pick((("fire",), ("frost", "nature"), (), ()), z % 4).alias("schools"), pick((("energy",), (), ()), z % 3).alias("resources"), (k % 4 == 0).alias("passive"), z.alias("level"), (z % 3).alias("ae"), (z % 2).alias("te"),
    )


NODES_SQL = f"""pn AS (SELECT p_partkey AS node, p_name AS name, p_brand AS cls, p_type AS tab, replace({pick_sql(TEXTS, 'p_size % 5')}, '{{n}}', p_size::VARCHAR) AS text, {pick_sql(TAGS, 'p_partkey % 6')} AS tags,
  {pick_sql((("fire",), ("frost", "nature"), (), ()), 'p_size % 4')} AS schools, {pick_sql((("energy",), (), ()), 'p_size % 3')} AS resources, p_partkey % 4 = 0 AS passive, p_size AS level, p_size % 3 AS ae, p_size % 2 AS te FROM part)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("node")).distinct()


MEMBERS_SQL = "mb AS (SELECT DISTINCT l_orderkey AS build, l_partkey AS node FROM lineitem)"


def order_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("build"), F.col("o_custkey").alias("scope"), pick(ROLES, k % 6).alias("role"), F.round("o_totalprice", 2).alias("score"))


BUILDS_SQL = f"bu AS (SELECT o_orderkey AS build, o_custkey AS scope, {pick_sql(ROLES, 'o_orderkey % 6')} AS role, round(o_totalprice, 2) AS score FROM orders)"


def build_nodes(spark: SparkSession, sf_dir: str, some: DataFrame | None = None) -> DataFrame:
    """The nodes of all builds, or of some members."""
    return (members(spark, sf_dir) if some is None else some).join(part_nodes(spark, sf_dir), "node")


def build_actions(spark: SparkSession, sf_dir: str, some: DataFrame | None = None) -> DataFrame:
    """Every part of an order, active or not, as an action; of all builds, or of some members."""
    m = (members(spark, sf_dir) if some is None else some).join(table(spark, sf_dir, "part"), F.col("node") == F.col("p_partkey"))
    return m.select(
        "build", "node", F.concat(F.lit("k"), F.col("node").cast("string")).alias("key"), F.col("p_name").alias("name"), pick(CATEGORIES, (F.col("build") + F.col("node")) % 8).alias("category"), F.col("p_size").alias("priority"), F.when(F.col("p_size") % 2 == 0, "low").otherwise("medium").alias("confidence")
    )


ACTIONS_SQL = f"""ac AS (SELECT build, node, 'k' || node AS key, p_name AS name, {pick_sql(CATEGORIES, '(build + node) % 8')} AS category, p_size AS priority, CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM mb JOIN part ON node = p_partkey)"""


# Node states, marginal values, prerequisites


def _needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("required"))


def node_state_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts at the levels that the nations give; chosen, free and open ones, and what speaks against the others."""
    levels = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4 + 2).cast("int").alias("at"), (F.col("n_nationkey") % 3).alias("budget"))
    n = part_nodes(spark, sf_dir).join(levels, F.lit(True)).select(F.col("at").alias("level"), "node", F.col("level").alias("needs_level"), "ae", "te", "budget")
    codes = {"level_required": "needs_level > level", "tab_ae_gate_unmet": "node % 10 = 1", "tab_te_gate_unmet": "node % 10 = 2", "required_node_missing": "node % 3 = 0 AND (node + 1) % 5 <> 0", "ae_budget_exceeded": "ae > budget"}
    issues = rules.violations(n.withColumn("k", F.struct("level", "node")), "k", codes).select("k.*", "code")
    selected, free = n.filter("node % 5 = 0"), n.filter("node % 11 = 0")
    available = n.join(issues.select("level", "node").distinct(), ["level", "node"], "left_anti").filter("node % 5 <> 0 AND ae + te > 0")
    return bd.node_states(n.select("level", "node"), selected, free, available, issues)


STATES_SQL = """SELECT n_nationkey * 4 + 2 AS level, p_partkey AS node,
  CASE WHEN p_partkey % 11 = 0 THEN 'free'
    WHEN p_size > n_nationkey * 4 + 2 THEN 'gated_level' WHEN p_partkey % 10 = 1 THEN 'gated_tab_ae' WHEN p_partkey % 10 = 2 THEN 'gated_tab_te'
    WHEN p_partkey % 3 = 0 AND (p_partkey + 1) % 5 <> 0 THEN 'gated_required_node' WHEN p_size % 3 > n_nationkey % 3 THEN 'over_budget'
    WHEN p_partkey % 5 = 0 THEN 'selected' WHEN p_size % 3 + p_size % 2 > 0 THEN 'available' ELSE 'inactive' END AS state
FROM part CROSS JOIN nation"""


def marginal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir).withColumn("role", pick(ROLES, F.col("level") % 6))
    named = table(spark, sf_dir, "part").filter("p_size <= 20").select(pick(("core", "priority", "cooldown", "role", "other"), F.col("p_size") % 5).alias("section"), F.col("p_name").alias("name"))
    return bd.marginal_values(nodes, named, _needs(spark, sf_dir), nodes.filter("node % 5 = 0").select("node")).select("node", "value")


MARGINAL_SQL = f"""WITH {NODES_SQL}, g AS (SELECT DISTINCT p_name AS name, p_size % 5 AS s FROM part WHERE p_size <= 20),
w AS (SELECT name, sum(CASE s WHEN 0 THEN 60.0 WHEN 1 THEN 40.0 WHEN 2 THEN 35.0 WHEN 3 THEN 35.0 ELSE 0 END) AS w FROM g GROUP BY 1)
SELECT node, round(100.0 + coalesce(w, 0) - CASE WHEN node % 3 = 0 AND (node + 1) % 5 <> 0 THEN 10.0 ELSE 0 END + greatest(0.0, 10.0 - level / 10.0)
  + CASE WHEN level % 6 IN (0, 4, 5) AND node % 6 IN (0, 3) OR level % 6 = 1 AND node % 6 = 2 OR level % 6 = 2 AND node % 6 = 1 OR level % 6 = 3 AND node % 6 = 4 THEN 20.0 ELSE 0 END, 4)::DOUBLE AS value
FROM pn LEFT JOIN w USING (name)"""


def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dearest parts need, along chains of parts; every seventh part costs nothing and breaks the chain."""
    p = table(spark, sf_dir, "part")
    needs = p.filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("required"))
    return graph.dependency_closure(p.filter("p_size >= 40").select(F.col("p_partkey").alias("node")), needs, p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("node")))


CLOSURE_SQL = """WITH RECURSIVE r AS (SELECT p_partkey AS node FROM part WHERE p_size >= 40 UNION SELECT p_partkey FROM r JOIN part ON p_partkey = node + 1 WHERE node % 50 <> 0 AND p_partkey % 7 <> 0) SELECT node FROM r"""


def _tab_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = part_nodes(spark, sf_dir).select("cls", (F.col("node") % 3).alias("tab"), "node")
    links = n.select(F.col("node").alias("src"), (F.col("node") + 15).alias("dst")).filter("src % 8 <> 0")
    needs = n.filter("node % 4 <> 1").select("node", (F.col("node") - 15).alias("required"))
    return graph.tab_reach(n, links, needs, ["cls", "tab"])


def tab_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tab_graph(spark, sf_dir)


def tab_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tab_faults(_tab_graph(spark, sf_dir), ["cls", "tab"])


REACH_SQL = """n AS (SELECT p_brand AS cls, p_partkey % 3 AS tab, p_partkey AS node FROM part),
e AS (SELECT a.node AS x, b.node AS y FROM n a JOIN n b ON b.node = a.node + 15 AND a.cls = b.cls AND a.tab = b.tab WHERE a.node % 8 <> 0), u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
o AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE n.node % 4 <> 1 AND b.node = n.node - 15 AND b.cls = n.cls AND b.tab = n.tab)),
r AS (SELECT node FROM o UNION SELECT y FROM r JOIN u ON x = node),
t AS (SELECT n.*, node IN (SELECT node FROM o) AS root, node IN (SELECT node FROM r) AS reached FROM n)"""


# Scores


def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir).withColumns({"node_type": F.when(F.col("node") % 5 == 0, "SpendSquare").otherwise("Circle"), "paid": F.col("ae") + F.col("te") > 0, "max_rank": F.col("level") % 5})
    weights = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg((F.max("p_size") % 7).cast("double").alias("weight")).withColumn("kind", F.lit("tab"))
    scored = score.legacy_node_scores(nodes, score.node_components(nodes, weights))
    builds = order_builds(spark, sf_dir).withColumn("encounter", F.when(F.col("build") % 2 == 0, "aoe").otherwise("single"))
    return score.legacy_score(members(spark, sf_dir), scored, builds, [(["red", "small"], 3.0), (["blue ring"], -1.5)])


LEGACY_SQL = f"""WITH {NODES_SQL}, {MEMBERS_SQL}, t AS (SELECT p_type AS tab, (max(p_size) % 7)::DOUBLE AS w FROM part GROUP BY 1),
v AS (SELECT pn.*, round(w + CASE WHEN node % 5 = 0 THEN 4.0 ELSE 0 END + CASE WHEN passive AND ae + te > 0 THEN 0.75 ELSE 0 END + least(level % 5, 3) * 0.2, 4)::DECIMAL(18,4) AS v FROM pn JOIN t USING (tab)),
s AS (SELECT build, sum(v)::DOUBLE AS s, count(*) FILTER (level % 5 = 3) AS area, count(*) FILTER (node % 6 = 2) AS dil, string_agg(name, chr(10) ORDER BY name) AS names FROM mb JOIN v USING (node) GROUP BY build)
SELECT build, round(s + CASE WHEN build % 2 = 0 THEN 2.0 * least(area, 8) ELSE -1.25 * dil END + CASE WHEN contains(names, 'red') AND contains(names, 'small') THEN 3.0 ELSE 0 END - CASE WHEN contains(names, 'blue ring') THEN 1.5 ELSE 0 END, 2)::DOUBLE AS score FROM s JOIN orders ON o_orderkey = build"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    amount = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").select(
        k.alias("key"), pick(("damage", "utility", "mitigation", "support", "heal", "unknown"), k % 6).alias("classification"), F.when(k % 3 == 0, 4000).alias("duration_ms"), F.lit(1500).alias("effect_ms"), F.when(k % 4 == 0, 30000).otherwise(0).alias("cooldown_ms"),
        F.create_map(F.when(k % 2 == 0, "Mana").otherwise("rage"), amount).alias("costs"), F.create_map(F.lit("rage"), F.when(k % 5 == 0, amount).otherwise(0.0)).alias("generates"),
    )


def usage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate"), F.col("l_partkey").alias("key")).agg(F.sum(F.floor("l_quantity")).cast("long").alias("count"))
    k = F.col("build")
    results = order_builds(spark, sf_dir).select(
        k.alias("candidate"), "role", F.when(k % 50 == 0, 0).otherwise(600_000).alias("duration_ms"), (F.floor("score") * 10).alias("damage"), (F.floor("score") * 4).alias("healing"), (k % 3).alias("mitigation_events"), (k % 2).alias("support_events"),
        F.when(k % 9 == 0, 1).otherwise(0).alias("unsupported_conditions"), F.when(k % 7 == 0, 1).otherwise(0).alias("unsupported_effects"), (F.lit(100.0) - k % 70).alias("coverage_pct"),
        F.when(k % 11 == 0, F.array(F.lit("missing_mechanics:7"))).when(k % 13 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return score.usage_scores(results, usage, _catalogue(spark, sf_dir))


def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = usage_scores(spark, sf_dir).join(order_builds(spark, sf_dir).select(F.col("build").alias("candidate"), "scope"), "candidate")
    return score.best_run(runs, ["scope"])


USAGE_SQL = f"""{BUILDS_SQL}, u AS (SELECT l_orderkey AS k, l_partkey AS p, sum(floor(l_quantity)) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT k, sum(n * CASE WHEN p % 3 = 0 THEN 4000 ELSE 1500 END) FILTER (p % 6 IN (0, 1)) AS up, sum(n * CASE WHEN p % 3 = 0 THEN 4000 ELSE 1500 END) FILTER (p % 6 = 2) AS mit_ms, sum(n * CASE WHEN p % 3 = 0 THEN 4000 ELSE 1500 END) FILTER (p % 6 = 3) AS sup_ms,
  sum(n) FILTER (p % 6 = 4) AS heals, sum(n) FILTER (p % 6 = 2) AS mits, sum(n) FILTER (p % 6 = 3) AS sups, sum(n * p_size) FILTER (p % 5 = 0) AS made, sum(n * p_size) AS spent, sum(n * p_size) FILTER (p % 2 = 0) AS mana, sum(n) FILTER (p % 4 = 0) AS cds
  FROM u JOIN part ON p_partkey = p WHERE p % 10 <> 0 GROUP BY k),
j AS (SELECT build AS k, scope, role, floor(score) * 10 AS d, floor(score) * 4 AS h, CASE WHEN build % 50 = 0 THEN 0 ELSE 600000 END AS ms, s.* EXCLUDE (k) FROM bu LEFT JOIN s ON s.k = build),
c AS (SELECT k, scope, role, CASE WHEN ms = 0 THEN 0 ELSE d / 10 END AS d, CASE WHEN ms = 0 THEN 0 ELSE h / 10 END AS h, h AS hh, CASE WHEN ms = 0 THEN 0 ELSE least(100.0, coalesce(up, 0) / ms * 100) END AS up, CASE WHEN ms = 0 THEN 0 ELSE least(100.0, coalesce(mit_ms, 0) / ms * 100) END AS mp,
  CASE WHEN ms = 0 THEN 0 ELSE least(100.0, coalesce(sup_ms, 0) / ms * 100) END AS sp, coalesce(heals, 0) AS heals, k % 3 + coalesce(mits, 0) AS mits, k % 2 + coalesce(sups, 0) AS sups, CASE WHEN coalesce(made, 0) > 0 THEN least(1.0, spent / made) ELSE 0 END AS eff, coalesce(mana, 0) AS mana, coalesce(cds, 0) AS cds FROM j),
r AS (SELECT k AS candidate, scope, role, round(CASE role WHEN 'tank' THEN round(mp * 8, 2) + round(h * 0.4 + mits * 25, 2) + round(d * 0.15 + mits * 12, 2) + round(d * 0.1, 2)
    WHEN 'healer' THEN round(h, 2) + round(CASE WHEN mana > 0 THEN hh / mana ELSE 0 END * 10, 2) + heals * 20 + round(d * 0.2, 2)
    WHEN 'support' THEN round(sp * 8, 2) + sups * 25 + sups * 10 + round(d * 0.15, 2) ELSE round(d, 2) + round(up * 0.5, 2) + round(eff * 50, 2) + cds * 10 END, 2)::DOUBLE AS score,
  CASE WHEN k % 9 = 0 OR 100 - k % 70 < 50 OR k % 11 = 0 THEN 'low' WHEN k % 7 = 0 OR 100 - k % 70 < 80 OR k % 13 = 0 THEN 'medium' ELSE 'high' END AS reliability FROM c),
z AS (SELECT *, round(score * CASE reliability WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.85 ELSE 0.55 END + 1e-7, 2)::DOUBLE AS adjusted FROM r)"""


def action_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, m = _catalogue_inputs(spark, sf_dir)
    return mechanics.action_catalogue(nodes, m).drop("name")


def catalogue_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mechanics.catalogue_coverage(*_catalogue_inputs(spark, sf_dir))


def _catalogue_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = build_nodes(spark, sf_dir).join(order_builds(spark, sf_dir), "build").select("build", "role", "node", F.col("node").alias("spell"), "name", "passive")
    k = F.col("p_partkey")
    effect = F.struct(pick(("heal", "shield", "damage", "summon", "aura_apply", "other"), k % 6).alias("effect_type"), pick((("support",), ("tank",), ()), k % 7 % 3).alias("tags"))
    m = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").select(
        k.alias("spell"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("name"), pick(("ability", "debuff", "cooldown", "passive", "mitigation"), k % 5).alias("kind"), F.array(effect).alias("effects"),
        F.lit("medium").alias("confidence"), (k % 3 * 1000).cast("int").alias("cooldown_ms"), F.lit(None).cast("int").alias("duration_ms"), F.when(k % 2 == 0, 1000).alias("gcd_ms"),
    )
    return nodes, m


CATALOGUE_SQL = f"""{NODES_SQL}, {MEMBERS_SQL}, {BUILDS_SQL},
j AS (SELECT build, role, node, node % 9 <> 0 AS found, passive OR node % 9 <> 0 AND node % 5 = 3 AS p, trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS key, node % 6 AS e, node % 7 % 3 AS t, node % 5 AS k FROM mb JOIN pn USING (node) JOIN bu USING (build))"""
CATALOGUE_ROWS = """SELECT build, node, node AS spell, CASE WHEN key = '' THEN 'action' ELSE key END AS key, CASE WHEN found THEN CASE k WHEN 0 THEN 'ability' WHEN 1 THEN 'debuff' WHEN 2 THEN 'cooldown' WHEN 4 THEN 'mitigation' END ELSE 'unknown' END AS kind, CASE WHEN found THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN NOT found THEN 'unknown' WHEN role = 'support' AND (t = 0 OR e = 4) THEN 'support' WHEN e = 0 THEN 'heal' WHEN e = 1 OR t = 1 OR k = 4 THEN 'mitigation' WHEN e = 2 OR k = 1 THEN 'damage' WHEN e IN (3, 4) OR k = 2 THEN 'utility' ELSE 'unknown' END AS classification,
  CASE WHEN found THEN (node % 3 * 1000)::INT ELSE 0 END AS cooldown_ms, CASE WHEN found AND node % 2 = 0 THEN 1000 ELSE 1500 END AS gcd_ms, NULL::INT AS duration_ms, CASE WHEN found THEN 'mechanics' ELSE 'fallback' END AS source, CASE WHEN NOT found THEN 'missing_mechanics:' || node END AS warning FROM j WHERE NOT p"""


def candidate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 0").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), pick(("heal", "mitigation", "support", "damage"), F.col("p_partkey") % 16 / 4).alias("classification"))
    builds = order_builds(spark, sf_dir).select(F.col("build").alias("candidate"), "role")
    return rules.candidate_validity(builds, build_actions(spark, sf_dir).select(F.col("build").alias("candidate"), "key", "category"), catalogue, most=4)


VALIDITY_SQL = f"""WITH {MEMBERS_SQL}, {BUILDS_SQL}, {ACTIONS_SQL},
g AS (SELECT build, count(*) AS n, count(*) FILTER (node % 4 <> 0) AS run, count(*) FILTER (node % 4 <> 0 AND category <> 'cooldown') AS other,
  bool_or(node % 4 <> 0 AND (category = 'healing' OR node % 16 // 4 = 0)) AS h, bool_or(node % 4 <> 0 AND (category = 'defensive' OR node % 16 // 4 = 1)) AS t, bool_or(node % 4 <> 0 AND (category = 'support' OR node % 16 // 4 = 2)) AS s FROM ac GROUP BY build)
SELECT bu.build AS candidate, role, coalesce(n <= 4 AND run > 0 AND other > 0 AND CASE role WHEN 'healer' THEN h WHEN 'tank' THEN t WHEN 'support' THEN s ELSE true END, false) AS valid FROM bu LEFT JOIN g ON g.build = bu.build"""


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = order_builds(spark, sf_dir).withColumn("warnings", F.when(F.col("build") % 5 == 0, F.array(F.lit("No Tooltip"), F.lit("other"))).otherwise(F.array(F.lit("other"))))
    return score.build_reliability(builds, build_nodes(spark, sf_dir), build_actions(spark, sf_dir))


RELIABILITY_SQL = f"""WITH {NODES_SQL}, {MEMBERS_SQL}, {BUILDS_SQL}, {ACTIONS_SQL},
n AS (SELECT build, bool_or(node % 6 IN (0, 3)) AS loop FROM mb JOIN pn USING (node) GROUP BY build),
a AS (SELECT build, count(*) AS n, count(*) FILTER (confidence = 'low') AS low, bool_or(node % 4 <> 0) AS own, list(category) AS c FROM ac GROUP BY build),
x AS (SELECT bu.build, round(1.0 - CASE WHEN coalesce(own, false) THEN 0 ELSE 0.2 END
  - CASE WHEN list_has_any(coalesce(c, []), CASE role WHEN 'tank' THEN ['defensive', 'cooldown', 'utility', 'filler'] WHEN 'healer' THEN ['heal', 'maintenance', 'cooldown', 'utility'] WHEN 'support' THEN ['support', 'utility', 'maintenance', 'cooldown'] ELSE ['builder', 'spender', 'filler', 'maintenance', 'cooldown'] END) THEN 0 ELSE 0.15 END
  - CASE WHEN coalesce(low > a.n / 2, false) THEN 0.1 ELSE 0 END - CASE WHEN coalesce(loop, false) AND NOT list_has_any(coalesce(c, []), ['spender', 'builder']) THEN 0.1 ELSE 0 END - CASE WHEN bu.build % 5 = 0 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score
  FROM bu LEFT JOIN n ON n.build = bu.build LEFT JOIN a ON a.build = bu.build)
SELECT build, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM x"""


def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("build")
    builds = order_builds(spark, sf_dir).select(
        "build", F.when(k % 3 == 0, "curated").otherwise("inferred").alias("role_source"), F.when(k % 2 == 0, "high").otherwise("medium").alias("role_confidence"), F.when(k % 5 == 0, F.array(F.lit("missing_mechanics:1"))).otherwise(F.array(F.lit("x"))).alias("warnings"),
        pick(("high", "medium", "low"), k % 4).alias("reliability"), F.when(k % 7 == 0, 2).otherwise(0).alias("unsupported_conditions"), F.when(k % 6 == 0, 1).otherwise(0).alias("unsupported_effects"),
    )
    matches = order_builds(spark, sf_dir).filter("build % 10 < 3").select("build", F.when(k % 10 == 0, "high").otherwise("low").alias("severity"))
    return score.trust(builds, matches).select("build", "role_score", "mechanics_score", "rotation_score", "watchlist_score", "score", "label")


TRUST_SQL = """WITH p AS (SELECT o_orderkey AS build, CASE WHEN o_orderkey % 6 = 0 THEN 1.0 ELSE 0.65 END AS role_score, CASE WHEN o_orderkey % 5 = 0 THEN 0.45 ELSE 0.85 END AS mechanics_score,
  greatest(0.0, CASE o_orderkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.45 ELSE 0.4 END - CASE WHEN o_orderkey % 7 = 0 THEN 0.2 ELSE 0 END - CASE WHEN o_orderkey % 6 = 0 THEN 0.1 ELSE 0 END)::DOUBLE AS rotation_score, CASE WHEN o_orderkey % 10 >= 3 THEN 1.0 WHEN o_orderkey % 10 = 0 THEN 0.35 ELSE 0.55 END AS watchlist_score FROM orders),
s AS (SELECT *, round(role_score * 0.2 + mechanics_score * 0.3 + rotation_score * 0.3 + watchlist_score * 0.2, 6)::DOUBLE AS score FROM p)
SELECT build, role_score::DOUBLE AS role_score, mechanics_score::DOUBLE AS mechanics_score, rotation_score, watchlist_score::DOUBLE AS watchlist_score, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM s"""


def role_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir)
    return score.infer_role(score.role_scores(nodes, "cls", "text", "tags", "name"), "cls")


def role_sql(source: str = "pn", key: str = "cls") -> str:
    def found(p: str) -> str:
        word = p.replace(r"\b", "")
        return f"len(regexp_extract_all(t, '{('(?:^|[^a-z0-9_])' if p.startswith(chr(92)) else '') + word + ('(?:[^a-z0-9_]|$)' if p.endswith(chr(92) + 'b') else '')}'))"

    sums = []
    for role, patterns in score.ROLE_PATTERNS.items():
        tags = " + ".join(f"CASE WHEN list_contains(tags, '{t}') THEN {w} ELSE 0 END" for t, w in score.ROLE_TAGS[role].items())
        sums.append(f"round(sum(({tags} + {' + '.join(map(found, patterns))})::DECIMAL(18,2))::DOUBLE, 2) AS {role}")
    order = ", ".join(f"{{'s': -{r}, 'i': {i}, 'r': '{r}'}}" for i, r in enumerate(score.ROLE_TAGS))
    dps = ", ".join(f"{{'s': -{r}, 'i': {i}, 'r': '{r}'}}" for i, r in enumerate(list(score.ROLE_TAGS)[:3]))
    own = "CASE role " + " ".join(f"WHEN '{r}' THEN {r}" for r in score.ROLE_TAGS) + " END"
    return f"""rs AS (SELECT {key}, {', '.join(sums)} FROM (SELECT *, replace(lower(name || ' ' || text), ' ', '  ') AS t FROM {source}) GROUP BY {key}),
ro AS (SELECT *, list_sort([{order}]) AS l, list_sort([{dps}]) AS d FROM rs),
rr AS (SELECT *, CASE WHEN tank >= 20 AND tank >= healer - 5 THEN 'tank' WHEN healer >= 24 AND healer >= support + 4 THEN 'healer' WHEN support >= 22 AND support > healer THEN 'support' WHEN l[1].r IN ('tank', 'healer', 'support') AND -l[1].s < 10 THEN d[1].r ELSE l[1].r END AS role FROM ro),
ri AS (SELECT {key}, role, CASE WHEN {own} >= 12 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(list_transform(l[1:3], lambda x: x.r || ':' || printf('%.1f', -x.s)), ',') AS evidence FROM rr)"""


def configured_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("build")
    rows = order_builds(spark, sf_dir).select("build", pick(("auto", "dps", "healer_support", "tank", "caster_dps", "wrong"), k % 7 % 6).alias("configured"), F.col("role").alias("inferred_role"), F.lit("low").alias("inferred_confidence"))
    out = score.configured_role(rows)
    return out.select("build", "role", "role_source", "role_confidence", engine_role(F.col("role")).alias("engine_role"), score.objective(F.col("role"))["id"].alias("objective"), score.objective(F.col("role"))["label"].alias("objective_label"))


CONFIGURED_SQL = f"""WITH {BUILDS_SQL}, c AS (SELECT build, role AS seen, build % 7 % 6 AS c FROM bu),
i AS (SELECT *, c = 0 OR c = 1 AND ends_with(seen, '_dps') OR c = 2 AND seen IN ('healer', 'support') AS inf FROM c),
r AS (SELECT build, inf, CASE WHEN inf THEN seen WHEN c = 1 THEN 'melee_dps' WHEN c = 2 THEN 'healer' WHEN c = 3 THEN 'tank' WHEN c = 4 THEN 'caster_dps' END AS role FROM i)
SELECT build, role, CASE WHEN inf THEN 'inferred' WHEN role IS NOT NULL THEN 'configured' END AS role_source, CASE WHEN inf THEN 'low' WHEN role IS NOT NULL THEN 'high' END AS role_confidence, CASE WHEN ends_with(role, '_dps') THEN 'dps' WHEN role = 'tank' THEN 'tank' WHEN role IN ('healer', 'support') THEN 'healer_support' END AS engine_role,
  CASE role WHEN 'healer' THEN 'healing' WHEN 'tank' THEN 'survival_threat' WHEN 'support' THEN 'support' ELSE 'damage' END AS objective, CASE role WHEN 'healer' THEN 'Projected Healing Index' WHEN 'tank' THEN 'Projected Survival/Threat Index' WHEN 'support' THEN 'Projected Support Index' ELSE 'Projected Damage Index' END AS objective_label FROM r"""


def gear_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(pick(("dps", "tank"), F.col("p_partkey") % 2).alias("engine_role"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise("").alias("weapon_type"), F.lower("p_type").alias("armor_type"), F.when(F.col("p_partkey") == 4, "low").otherwise("medium").alias("confidence"))
    wanted = table(spark, sf_dir, "region").select(pick(("dps", "tank", "healer_support"), F.col("r_regionkey")).alias("engine_role")).filter("engine_role IS NOT NULL")
    return score.gear_types(items, wanted).select("engine_role", F.array_join("weapon_types", ",").alias("weapons"), F.array_join("armor_types", ",").alias("armors"), "gear_warning")


GEAR_SQL = """SELECT 'dps' AS engine_role, (SELECT string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) FROM part WHERE p_partkey % 2 = 0) AS weapons, (SELECT string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) FROM part WHERE p_partkey % 2 = 0) AS armors, 'item_data_low_confidence' AS gear_warning
UNION ALL SELECT 'tank', 'shield,sword,mace,axe', (SELECT string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) FROM part WHERE p_partkey % 2 = 1), NULL UNION ALL SELECT 'healer_support', 'staff,mace,dagger', 'cloth,leather,mail', 'item_data_missing'"""


# Likeness


def _prints(spark: SparkSession, sf_dir: str, builds: DataFrame) -> DataFrame:
    """Fingerprints and signatures of some builds (scope, build, role)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("node"))
    some = materialize(lines.join(builds.select("build"), "build", "left_semi").distinct(), "some-members")
    actions = build_actions(spark, sf_dir, some)
    prints = similarity.fingerprints(builds.select("scope", "build", "role"), build_nodes(spark, sf_dir, some), actions)
    played = similarity.signatures(builds.select("build", "role"), actions).drop("role").withColumn("played", F.col("build") % 10 != 0)
    return prints.join(played, "build")


def playstyles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = similarity.fingerprints(order_builds(spark, sf_dir), build_nodes(spark, sf_dir), build_actions(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("primary", "names", "schools", "resources", "categories")]
    return p.select("build", *lists, "passive_ratio", "active", "cooldowns", "dots", "summons", "heals", "defensives", "supports", "melee", "ranged", "caster", "label")


PRINTS_SQL = f"""{NODES_SQL}, {MEMBERS_SQL}, {BUILDS_SQL}, {ACTIONS_SQL}, bn AS (SELECT * FROM mb JOIN pn USING (node)),
k AS (SELECT build, replace(lower(trim(t)), ' ', '_') AS tag FROM (SELECT build, unnest(list_distinct(tags)) AS t FROM bn)
  UNION ALL SELECT build, unnest(list_filter([CASE WHEN x LIKE '%poison%' OR x LIKE '%venom%' THEN 'poison' END, CASE WHEN x LIKE '%damage over time%' OR x LIKE '%periodic%' THEN 'dot' END, CASE WHEN x LIKE '%cooldown%' THEN 'cooldown' END, CASE WHEN x LIKE '%heal%' THEN 'heal' END, CASE WHEN x LIKE '%summon%' OR x LIKE '%pet%' THEN 'summon' END,
    CASE WHEN x LIKE '%armor%' OR x LIKE '%shield%' OR x LIKE '%mitigation%' OR x LIKE '%defensive%' THEN 'defensive' END], lambda v: v IS NOT NULL)) FROM (SELECT build, lower(name || ' ' || text) AS x FROM bn)),
tc AS (SELECT build, tag, count(*) AS n FROM k GROUP BY ALL),
tg AS (SELECT build, list(tag ORDER BY n DESC, tag)[1:6] AS prim, list(tag) AS tags, coalesce(sum(n) FILTER (tag = 'cooldown'), 0) AS cooldown, coalesce(sum(n) FILTER (tag = 'dot'), 0) AS dot, coalesce(sum(n) FILTER (tag IN ('summon', 'pet')), 0) AS summons, coalesce(sum(n) FILTER (tag IN ('heal', 'healing')), 0) AS heals,
  coalesce(sum(n) FILTER (tag IN ('tank', 'defensive', 'mitigation')), 0) AS defensives, coalesce(sum(n) FILTER (tag IN ('support', 'utility', 'aura', 'buff')), 0) AS supports, coalesce(sum(n) FILTER (tag = 'melee'), 0) AS melee FROM tc GROUP BY build),
sm AS (SELECT build, count(*) AS n, count(*) FILTER (passive) AS np, list(name ORDER BY node) FILTER (NOT passive) AS names, bool_or(level % 4 = 0) AS s0, bool_or(level % 4 = 1) AS s1, bool_or(level % 3 = 0) AS r0 FROM bn GROUP BY build),
aa AS (SELECT build, list(name ORDER BY node) AS names, list_sort(list_distinct(list(category))) AS cats, count(*) FILTER (category = 'cooldown') AS cds FROM ac GROUP BY build),
fe AS (SELECT build, list(name ORDER BY p) AS extra FROM (SELECT build, name, min(node) AS p FROM ac WHERE NOT EXISTS (SELECT 1 FROM bn WHERE bn.build = ac.build AND bn.name = ac.name AND NOT passive) GROUP BY ALL) GROUP BY build),
fp AS (SELECT bu.*, coalesce(prim, []) AS prim, coalesce(tags, []) AS tags, (coalesce(sm.names, []) || coalesce(extra, [])) AS every, list_concat(list_concat(CASE WHEN s0 THEN ['fire'] ELSE [] END, CASE WHEN s1 THEN ['frost', 'nature'] ELSE [] END), []::VARCHAR[]) AS schools, CASE WHEN r0 THEN ['energy'] ELSE []::VARCHAR[] END AS resources, coalesce(cats, []) AS categories,
  coalesce(round(np / greatest(n, 1), 4), 0.0)::DOUBLE AS passive_ratio, coalesce(n - np, 0) AS active, (coalesce(cooldown, 0) + coalesce(cds, 0))::DOUBLE AS cooldowns, coalesce(dot, 0)::DOUBLE AS dots, coalesce(summons, 0)::DOUBLE AS summons, coalesce(heals, 0)::DOUBLE AS heals, coalesce(defensives, 0)::DOUBLE AS defensives, coalesce(supports, 0)::DOUBLE AS supports,
  (coalesce(melee, 0) + (role = 'melee_dps')::INT)::DOUBLE AS melee, (role = 'ranged_dps')::INT::DOUBLE AS ranged, (role = 'caster_dps')::INT::DOUBLE AS caster
  FROM bu LEFT JOIN tg ON tg.build = bu.build LEFT JOIN sm ON sm.build = bu.build LEFT JOIN aa ON aa.build = bu.build LEFT JOIN fe ON fe.build = bu.build)"""
PLAYSTYLE_ROWS = """SELECT build, array_to_string(prim, ',') AS primary, array_to_string(every[1:8], ',') AS names, array_to_string(schools, ',') AS schools, array_to_string(resources, ',') AS resources, array_to_string(categories, ',') AS categories, passive_ratio, active, cooldowns, dots, summons, heals, defensives, supports, melee, ranged, caster,
  CASE WHEN list_has_any(tags, ['poison', 'venom']) THEN 'poison DoT loop' WHEN list_contains(tags, 'dot') OR list_contains(categories, 'maintenance') THEN 'DoT upkeep loop' WHEN list_has_any(tags, ['summon', 'pet']) THEN 'pet setup window' WHEN list_contains(tags, 'cooldown') OR list_contains(categories, 'cooldown') THEN 'burst cooldown cycle'
    WHEN role = 'tank' OR list_has_any(tags, ['tank', 'defensive']) THEN 'defensive sustain' WHEN role = 'healer' OR list_has_any(tags, ['heal', 'healing']) THEN 'healing cadence' WHEN role = 'support' OR list_has_any(tags, ['support', 'aura', 'utility']) THEN 'support uptime'
    WHEN list_has_any(tags, ['builder', 'spender']) OR list_has_any(categories, ['builder', 'spender']) THEN 'builder-spender loop' WHEN len(tags) > 0 THEN prim[1] || ' build' ELSE 'generalist build' END AS label FROM fp"""


def _apart(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 0.0::DOUBLE ELSE 1 - len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct({x} || {y})) END"


DISTANCE_SQL = f"""round(least(1.0::DOUBLE, 0.30::DOUBLE * ({_apart('a.every[1:8]', 'b.every[1:8]')}) + 0.25::DOUBLE * ({_apart('a.prim', 'b.prim')}) + 0.15::DOUBLE * ({_apart('a.categories', 'b.categories')}) + 0.10::DOUBLE * (({_apart('a.schools', 'b.schools')}) + ({_apart('a.resources', 'b.resources')})) / 2
  + 0.10::DOUBLE * (least(1.0::DOUBLE, abs(a.passive_ratio - b.passive_ratio)) + least(1.0::DOUBLE, abs(a.cooldowns - b.cooldowns)) + least(1.0::DOUBLE, abs(a.dots - b.dots)) + least(1.0::DOUBLE, abs(a.summons - b.summons))) / 4
  + 0.10::DOUBLE * (least(1.0::DOUBLE, abs(a.melee - b.melee)) + least(1.0::DOUBLE, abs(a.ranged - b.ranged)) + least(1.0::DOUBLE, abs(a.caster - b.caster)) + least(1.0::DOUBLE, abs(a.heals + a.defensives + a.supports - b.heals - b.defensives - b.supports))) / 4 + 1e-9), 4)"""


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every build to the best one of its scope."""
    p = similarity.fingerprints(order_builds(spark, sf_dir), build_nodes(spark, sf_dir), build_actions(spark, sf_dir))
    return similarity.best_distances(p, "scope", "build")


BEST_SQL = "be AS (SELECT scope, arg_max(build, (score, build)) AS build FROM bu GROUP BY scope)"


def rotation_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.signatures(order_builds(spark, sf_dir).select("build", "role"), build_actions(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("core_actions", "maintenance_actions", "cooldown_actions", "tools_actions", "opener_actions", "uptime")]
    return s.select("build", *lists, "resource_loop", "burst", "reach")


SIGNATURE_SQL = """sg AS (SELECT bu.build, bu.scope, bu.score, role, coalesce(core, []) AS core, coalesce(mt, []) AS mt, coalesce(cd, []) AS cd, coalesce(tl, []) AS tl, coalesce(mt[1:1], []) || coalesce(cd[1:1], []) || coalesce(core[1:2], []) AS op, coalesce(c, []) AS c
  FROM bu LEFT JOIN (SELECT build, list(key ORDER BY CASE category WHEN 'builder' THEN 1 WHEN 'spender' THEN 2 ELSE 3 END, priority, key) FILTER (category IN ('builder', 'spender', 'filler')) AS core, list(key ORDER BY priority, key) FILTER (category = 'maintenance') AS mt, list(key ORDER BY priority, key) FILTER (category = 'cooldown') AS cd,
    list(key ORDER BY CASE category WHEN 'defensive' THEN 1 WHEN 'healing' THEN 2 WHEN 'support' THEN 3 ELSE 4 END, priority, key) FILTER (category IN ('defensive', 'healing', 'support', 'utility')) AS tl, list(category) AS c FROM ac GROUP BY build) g ON g.build = bu.build),
sh AS (SELECT *, CASE WHEN list_contains(c, 'builder') AND list_contains(c, 'spender') THEN 'builder_spender' WHEN list_contains(c, 'maintenance') THEN 'maintenance_loop' WHEN list_contains(c, 'cooldown') THEN 'cooldown_driven' WHEN list_contains(c, 'support') THEN 'support_cycle' WHEN list_contains(c, 'defensive') THEN 'defensive_cycle' ELSE 'unknown' END AS resource_loop,
  CASE WHEN len(cd) >= 2 THEN 'long' WHEN len(cd) = 1 THEN 'medium' ELSE 'none' END AS burst, replace(role, '_dps', '') AS reach, list_filter([CASE WHEN list_contains(c, 'maintenance') THEN 'dot' END, CASE WHEN list_contains(c, 'healing') THEN 'hot' END, CASE WHEN list_contains(c, 'support') THEN 'aura' END, CASE WHEN list_contains(c, 'defensive') THEN 'mitigation' END], lambda x: x IS NOT NULL) AS uptime FROM sg)"""


def signature_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of how every build is played to the best one of its scope."""
    s = similarity.signatures(order_builds(spark, sf_dir), build_actions(spark, sf_dir))
    return similarity.best_distances(s, "scope", "build", similarity.signature_distance)


SIGNATURE_DISTANCE_SQL = f"""round(least(1.0::DOUBLE, 0.35::DOUBLE * ({_apart('a.core', 'b.core')}) + 0.15::DOUBLE * ({_apart('a.op', 'b.op')}) + 0.15::DOUBLE * ({_apart('a.mt', 'b.mt')}) + 0.15::DOUBLE * ({_apart('a.cd', 'b.cd')}) + 0.05::DOUBLE * ({_apart('a.tl', 'b.tl')})
  + 0.10::DOUBLE * (((a.resource_loop <> b.resource_loop)::INT + (a.burst <> b.burst)::INT + (a.reach <> b.reach)::INT) / 3) + 0.05::DOUBLE * ({_apart('a.uptime', 'b.uptime')}) + 1e-9), 4)"""


def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = order_builds(spark, sf_dir).withColumn("reliability", (F.col("build") % 4) / 4)
    return similarity.select_diverse(similarity.in_band(builds, "scope"), lambda some: _prints(spark, sf_dir, some), "scope", "build", 2, measure=similarity.blended_distance)


def diverse_sql(reliability: str, played: str) -> str:
    """CTEs from prints (fp) and signatures (sh) to the first two places, ``dv``; what is given is SQL on a row of ``fp``."""
    return f"""q AS (SELECT fp.*, {reliability} AS reliability, {played} AS played, sh.core, sh.op, sh.mt, sh.cd, sh.tl, sh.resource_loop, sh.burst, sh.reach, sh.uptime FROM fp JOIN sh ON sh.build = fp.build),
b0 AS (SELECT scope, max(score) AS best, median(score) AS med, count(*) AS n, list_reverse_sort(list(score)) AS al FROM q GROUP BY scope),
m0 AS (SELECT q.scope, median(abs(score - med)) AS mad FROM q JOIN b0 ON b0.scope = q.scope GROUP BY q.scope),
f0 AS (SELECT b0.*, greatest(best * 0.9, CASE WHEN n >= 6 THEN best - greatest(1.5 * mad, best * 0.05) ELSE best * 0.9 END) AS fl FROM b0 JOIN m0 ON m0.scope = b0.scope),
f1 AS (SELECT scope, best, round(CASE WHEN n > 1 AND al[2] < fl THEN greatest(best * 0.88, al[2]) ELSE fl END, 4) AS floor FROM f0),
el AS (SELECT q.*, best FROM q JOIN f1 ON f1.scope = q.scope WHERE round(score, 4) >= floor),
one AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY scope ORDER BY reliability >= 0.5 DESC, score DESC, reliability DESC, build) = 1),
two AS (SELECT a.scope, a.build, a.score, CASE WHEN a.played AND b.played THEN round(0.55::DOUBLE * ({DISTANCE_SQL}) + 0.45::DOUBLE * ({SIGNATURE_DISTANCE_SQL}) + 1e-9, 4) ELSE {DISTANCE_SQL} END AS d, a.best, a.reliability FROM el a JOIN one b ON a.scope = b.scope AND a.build <> b.build),
dv AS (SELECT scope, build, 1 AS place FROM one UNION ALL (SELECT scope, build, 2 FROM two WHERE d >= 0.22 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY round(0.60 * score / best + 0.25 * reliability + 0.15 * d, 9) DESC, score DESC, build) = 1))"""


DIVERSE_SQL = f"WITH {PRINTS_SQL}, {SIGNATURE_SQL}, {diverse_sql('(fp.build % 4) / 4', 'fp.build % 10 <> 0')} SELECT * FROM dv"


# Warnings


def scope_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir).select("cls", F.col("level") % 2, F.when(F.col("node") % 5 == 0, "Class").otherwise(F.col("tab")), F.when(F.col("node") % 7 != 0, F.col("level"))).toDF("cls", "tab_id", "tab", "availability")
    stated = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cls"), (F.col("p_size") % 3).alias("tab_id"), F.col("p_type").alias("tab")).distinct()
    metadata = stated.unionByName(table(spark, sf_dir, "region").select(F.lit("Brand#1").alias("cls"), F.lit(0).alias("tab_id"), F.when(F.col("r_regionkey") == 0, "None").otherwise(F.col("r_name")).alias("tab")))
    scopes = nodes.select("cls").distinct().withColumn("level", F.when(F.endswith("cls", F.lit("1")), 60).otherwise(50))
    return report.warnings(nodes, metadata, scopes, ("Class", "None"))


WARNINGS_SQL = """WITH t AS (SELECT DISTINCT p_brand AS cls, p_size % 2 AS i, p_type AS tab FROM part WHERE p_partkey % 5 <> 0), m AS (SELECT DISTINCT p_brand AS cls, p_size % 3 AS i, p_type AS tab FROM part UNION SELECT 'Brand#1', 0, r_name FROM region WHERE r_regionkey <> 0)
SELECT cls, 'metadata_tab_has_no_nodes' AS warning, tab AS detail FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.cls = m.cls AND t.i = m.i AND t.tab = m.tab)
UNION ALL SELECT cls, unnest(['class_pool_level_gating_incomplete', 'shared_class_level_gating_incomplete']), NULL FROM (SELECT DISTINCT p_brand AS cls FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 7 = 0 AND NOT ends_with(p_brand, '1'))"""


QUERIES = {
    "node_state_levels": (node_state_levels, STATES_SQL),
    "marginal_values": (marginal_values, MARGINAL_SQL),
    "dependency_closure": (dependency_closure, CLOSURE_SQL),
    "tab_reach": (tab_reach, f"WITH RECURSIVE {REACH_SQL} SELECT * FROM t"),
    "tab_faults": (tab_faults, f"WITH RECURSIVE {REACH_SQL} SELECT cls, tab, count(*) AS nodes, count(*) FILTER (root) AS roots, count(*) FILTER (NOT reached) AS orphans, CASE WHEN count(*) > 1 AND count(*) FILTER (root) = 0 THEN 'no_root' WHEN count(*) FILTER (NOT reached) > 0 THEN 'orphan_nodes' END AS fault FROM t GROUP BY ALL"),
    "legacy_scores": (legacy_scores, LEGACY_SQL),
    "usage_scores": (usage_scores, f"WITH {USAGE_SQL} SELECT candidate, role, score, reliability, adjusted FROM z"),
    "best_runs": (best_runs, f"WITH {USAGE_SQL} SELECT scope, candidate, role, score, reliability, adjusted FROM z QUALIFY row_number() OVER (PARTITION BY scope ORDER BY adjusted DESC, CASE reliability WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, score DESC, candidate DESC) = 1"),
    "action_catalogue": (action_catalogue, f"WITH {CATALOGUE_SQL} {CATALOGUE_ROWS}"),
    "catalogue_coverage": (catalogue_coverage, f"WITH {CATALOGUE_SQL} SELECT build, count(*) AS selected, count(*) FILTER (NOT p) AS executable, count(*) FILTER (p) AS passive_skipped, count(*) FILTER (NOT p AND NOT found) AS missing, round((count(*) FILTER (NOT p) - count(*) FILTER (NOT p AND NOT found)) / greatest(count(*) FILTER (NOT p), 1) * 100, 2)::DOUBLE AS coverage_pct FROM j GROUP BY build"),
    "candidate_validity": (candidate_validity, VALIDITY_SQL),
    "reliability": (reliability, RELIABILITY_SQL),
    "trust_score": (trust_score, TRUST_SQL),
    "role_inference": (role_inference, f"WITH {NODES_SQL}, {role_sql()} SELECT * FROM ri"),
    "configured_roles": (configured_roles, CONFIGURED_SQL),
    "gear_types": (gear_types, GEAR_SQL),
    "playstyles": (playstyles, f"WITH {PRINTS_SQL} {PLAYSTYLE_ROWS}"),
    "jaccard_pairs": (jaccard_pairs, f"WITH {PRINTS_SQL}, {BEST_SQL} SELECT a.scope, a.build, {DISTANCE_SQL} AS distance FROM fp a JOIN be ON be.scope = a.scope JOIN fp b ON b.build = be.build"),
    "rotation_signatures": (rotation_signatures, f"WITH {MEMBERS_SQL}, {BUILDS_SQL}, {ACTIONS_SQL}, {SIGNATURE_SQL} SELECT build, array_to_string(core, ',') AS core_actions, array_to_string(mt, ',') AS maintenance_actions, array_to_string(cd, ',') AS cooldown_actions, array_to_string(tl, ',') AS tools_actions, array_to_string(op, ',') AS opener_actions, array_to_string(uptime, ',') AS uptime, resource_loop, burst, reach FROM sh"),
    "signature_distances": (signature_distances, f"WITH {MEMBERS_SQL}, {BUILDS_SQL}, {ACTIONS_SQL}, {SIGNATURE_SQL}, {BEST_SQL} SELECT a.scope, a.build, {SIGNATURE_DISTANCE_SQL} AS distance FROM sh a JOIN be ON be.scope = a.scope JOIN sh b ON b.build = be.build"),
    "diverse_topk": (diverse_topk, DIVERSE_SQL),
    "scope_warnings": (scope_warnings, WARNINGS_SQL),
}
