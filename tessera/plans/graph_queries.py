"""Discovery, graph, build, score, similarity, rule, cube and snapshot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import builds as bd
from tessera.operators import cube, discover, graph, report, rules, score, similarity, snapshots
from tessera.operators import events as ev
from tessera.plans.common import canonical_events, table
from tessera.sources import readers, writers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CELLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per order: the line of the largest part."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"), F.max("l_linenumber").alias("l_linenumber"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.unpivot(_wide(spark, sf_dir), "l_orderkey", CELLS)


CELLS_SQL = """w AS (SELECT l_orderkey, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS row_id, unnest([0, 1, 2, 3]) AS col, unnest([l_orderkey, l_partkey, l_suppkey, l_linenumber]) AS val FROM w)"""
RATES = f"""{CELLS_SQL},
r AS (SELECT col, count(*) FILTER (val IN (SELECT p_partkey FROM part)) AS hits, count(*) AS nonzero, count(DISTINCT val) FILTER (val IN (SELECT p_partkey FROM part)) AS distinct_values FROM c WHERE val <> 0 GROUP BY col)"""


def fk_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.hit_rates(_cells(spark, sf_dir), table(spark, sf_dir, "part"), "p_partkey")


def fk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.blocks(fk_hit_rate(spark, sf_dir), anchors=[0])


def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.index_columns(fk_hit_rate(spark, sf_dir))


def scalar_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    once = discover.unique_pairs(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), w.withColumnRenamed("l_orderkey", "k"), "k")
    known = w.join(once, F.col("l_orderkey") == F.col("k")).select(F.col("l_orderkey").alias("row_id"), F.lit("supplier").alias("field"), F.when(F.col("k") % 10 == 0, -1).otherwise(F.col("l_suppkey")).alias("value"))
    return discover.scalar_correlation(_cells(spark, sf_dir), known)


def anchor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    anchors = w.select(F.lit("part").alias("name"), F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("expected"))
    return discover.anchor_columns(_cells(spark, sf_dir), anchors)


def enum_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.enum_domain(_cells(spark, sf_dir), [1, 2, 3, 4, 5])


def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _wide(spark, sf_dir).select(F.col("l_orderkey").alias("row_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("label"))
    return discover.majority_labels(_cells(spark, sf_dir), labels)


def recon_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = [0, 1, 2]
    found = anchor_columns(spark, sf_dir).select("col", "status").unionByName(index_columns(spark, sf_dir).select("col", "status"))
    return discover.recon_status(found.withColumn("policy_match", F.col("col").isin(*policy)), reviewed=True, bound=True)


# Graphs: parts of one order in key order, each linked to the next one.


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))
    return lines.select(F.col("l_partkey").alias("src"), after.alias("dst")).filter("dst IS NOT NULL").distinct()


EDGES_SQL = """e AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE dst IS NOT NULL)"""


def edges_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = _edges(spark, sf_dir).groupBy("src").agg(F.collect_set("dst").alias("linked"))
    nodes = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").join(linked, F.col("p_partkey") == F.col("src"), "left")
    edges, missing = graph.undirected(nodes, "p_partkey", "linked")
    return edges.select("a", "b", F.lit("edge").alias("kind")).unionByName(missing.select(F.col("node").alias("a"), F.col("missing").alias("b"), F.lit("missing_endpoint").alias("kind")))


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with linked and required parts, a ninth of them not in the tree: edges of both kinds with their states, and warnings."""
    linked = _edges(spark, sf_dir).groupBy("src").agg(F.collect_set("dst").alias("linked"))
    rows = table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").join(linked, F.col("p_partkey") == F.col("src"), "left").withColumn("required", F.when(F.col("p_partkey") % 4 == 0, F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 2)))
    edges, told = graph.tree_edges(rows, "p_partkey", "linked", "required")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    states = graph.edge_states(edges, nodes.filter("p_size < 15"), nodes.filter("p_size BETWEEN 15 AND 30"))
    return states.unionByName(told.select("a", "b", F.lit("warning").alias("kind"), F.col("code").alias("state")))


def mask_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits of the wide table's columns, as masks, and those that a policy of the low twelve does not know."""
    return discover.mask_domain(_cells(spark, sf_dir), (1 << 12) - 1)


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as a chain; in every tenth order the second last leads back to the first, so the last is behind the cycle."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    rows = lines.withColumns({"after": F.lead("l_partkey").over(w), "second": F.lead("l_partkey", 2).over(w), "first": F.first("l_partkey").over(w)})
    node = lambda part: F.concat_ws(":", F.col("l_orderkey").cast("string"), part.cast("string"))
    chain = rows.filter("after IS NOT NULL").select(node(F.col("l_partkey")).alias("src"), node(F.col("after")).alias("dst"))
    turn = rows.filter("after IS NOT NULL AND second IS NULL AND l_orderkey % 10 = 0 AND first <> l_partkey").select(node(F.col("l_partkey")).alias("src"), node(F.col("first")).alias("dst"))
    return graph.on_cycles(chain.unionByName(turn)).select("node")


def edge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return graph.edge_states(_edges(spark, sf_dir).toDF("a", "b"), nodes.filter("p_size < 15"), nodes.filter("p_size BETWEEN 15 AND 30"))


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reference_faults(_edges(spark, sf_dir), table(spark, sf_dir, "part").filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("node")))


def gate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("tab"), (F.col("p_size") % 4).alias("g"), (F.col("p_size") % 3).alias("h"))
    return graph.gate_edges(p, "node", {"AE": "g", "TE": "h"})


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), table(spark, sf_dir, "part").filter("p_partkey < 5").select(F.col("p_partkey").alias("node"))).select("node")


def linked_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_edges(spark, sf_dir), table(spark, sf_dir, "part").filter("p_partkey < 5").select(F.col("p_partkey").alias("node")), depth=2)


def cycle_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order as a chain of prerequisites; in every tenth order the last one leads back to the first."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey")
    first = F.first("l_partkey").over(w)
    after = F.coalesce(F.lead("l_partkey").over(w), F.when((F.col("l_orderkey") % 10 == 0) & (first != F.col("l_partkey")), first))
    node = lambda part: F.concat_ws(":", F.col("l_orderkey").cast("string"), part.cast("string"))
    edges = lines.withColumn("after", after).filter("after IS NOT NULL").select(node(F.col("l_partkey")).alias("src"), node(F.col("after")).alias("dst"))
    return graph.in_cycles(edges)


def free_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    needs = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") - 1).alias("required"))
    free = p.filter("p_partkey % 7 <> 0").select(F.col("p_type").alias("build"), F.col("p_partkey").alias("node"))
    have = p.filter("p_partkey % 7 = 0").select(F.col("p_type").alias("build"), F.col("p_partkey").alias("node"))
    scope = free.unionByName(have)
    within = free.join(needs, "node").join(scope.select("build", F.col("node").alias("required")), ["build", "required"]).select("node", "required")
    return graph.closure(free, within, have)


# Builds: an order is a build, its parts are the nodes, the quantity is the rank.


def build_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.validate(*_build_tables(spark, sf_dir))


def _build_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    line = table(spark, sf_dir, "lineitem")
    selected = line.groupBy(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("node")).agg(F.max(F.floor(F.col("l_quantity") / 10)).cast("int").alias("rank"), F.count("*").alias("_c"))
    selected = selected.withColumn("x", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int")))).drop("_c", "x")
    p = table(spark, sf_dir, "part").filter("p_partkey % 50 <> 7")
    nodes = p.select(
        F.col("p_partkey").alias("node"), F.col("p_type").alias("tab"), F.when(F.col("p_partkey") % 13 == 0, "other").otherwise("main").alias("cls"), (F.col("p_size") % 3).alias("ae"), (F.col("p_size") % 2).alias("te"),
        (F.col("p_size") % 4).alias("tab_ae_gate"), (F.col("p_size") % 5).alias("tab_te_gate"), F.col("p_size").alias("level"), F.lit(3).alias("max_rank"),
    )
    builds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("build"), F.lit("main").alias("cls"), F.lit(45).alias("level"), F.lit(12).alias("max_ae"), F.lit(8).alias("max_te"))
    needs = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("required"))
    return builds, selected, nodes, needs


def frontier_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    candidates = p.select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("node"), (F.col("p_size") % 3).alias("ae"), (F.col("p_size") % 2).alias("te"), F.col("p_size").alias("level"), F.col("p_retailprice").alias("score"))
    needs = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("required"))
    start = p.select(F.col("p_brand").alias("scope")).distinct().select(F.lit("").alias("state"), "scope", F.lit(40).alias("level"), F.lit(4).alias("ae_left"), F.lit(3).alias("te_left"), F.array().cast("array<bigint>").alias("nodes"), F.lit(0).alias("spend"))
    one = bd.expand_frontier(start, candidates, needs, 10, 5)
    # The first round starts from empty states, which have no members to look at.
    return one.select("scope", "state", "ae_left", "te_left", "spend")


def award_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every size of a part stands for a level, so the table bounds the schedule and not the rules.
    return bd.award_schedule(table(spark, sf_dir, "part").select(F.col("p_size").alias("level")).distinct(), first=None, last=None)


# Scores


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("tab"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("tags"), F.array("p_brand").alias("schools"), F.array().cast("array<string>").alias("resources"), F.col("p_brand").alias("text"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight table from the catalogue's own values."""
    p = table(spark, sf_dir, "part")
    types = p.groupBy("p_type").agg((F.max("p_size") % 7).cast("double").alias("weight")).select(F.lit("tab").alias("kind"), F.col("p_type").alias("key"), "weight")
    words = p.select(F.explode(F.split("p_name", " ")).alias("key")).distinct().select(F.lit("tag").alias("kind"), "key", (F.length("key") - 4).cast("double").alias("weight"))
    named = p.filter("p_brand = 'Brand#2'").select(F.lit("named").alias("kind"), F.upper("p_brand").alias("key"), F.lit(2.5).alias("weight")).distinct()
    return types.unionByName(words).unionByName(named)


def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.node_components(_nodes(spark, sf_dir), _weights(spark, sf_dir)).groupBy("node").agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("components"))


def build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("node")).distinct()
    components = members.join(score.node_components(_nodes(spark, sf_dir), _weights(spark, sf_dir)), "node")
    counted = members.groupBy("build").agg(F.count("*").alias("nodes"), F.count_if(F.col("node") % 2 == 0).alias("bare"))
    return score.build_index(components, counted)


def synergies(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("build"), F.col("p_name").alias("name"))
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_name").alias("x"), F.max("p_name").alias("y"))
    sets = names.select(F.array("x", "y").alias("names")).distinct().withColumn("weight", F.lit(1.5))
    return score.synergy_components(members, sets)


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    stats = F.map_from_arrays(F.array(F.lit("size"), F.lit("price")), F.array(F.col("p_size").cast("double"), F.round("p_retailprice", 2)))
    items = p.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("role"), stats.alias("stats"))
    weights = p.groupBy(F.col("p_type").alias("role")).agg(F.min("p_size").cast("double").alias("w")).select("role", F.explode(F.create_map(F.lit("size"), F.col("w"), F.lit("price"), F.lit(0.5))).alias("stat", "weight"))
    return score.item_scores(items, weights, 10)


def watchlist_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "_dps").otherwise("")).alias("role"))
    entries = table(spark, sf_dir, "region").select("r_regionkey", F.when(F.col("r_regionkey") == 0, "*").otherwise(F.concat(F.lit("BRAND#"), F.col("r_regionkey").cast("string"))).alias("brand_pattern"), F.when(F.col("r_regionkey") % 2 == 0, "*_dps").otherwise("*").alias("role_pattern"))
    return rules.watchlist(p, entries, {"p_brand": "brand_pattern", "role": "role_pattern"}).groupBy("r_regionkey").agg(F.count("*").alias("n"))


# Similarity: builds are orders, features the parts' types and brands; the scope is a customer.




def band_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.round("o_totalprice", 2).alias("score"))
    return similarity.band_floor(scores, "scope")


# Rules


def _rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made from the regions: the part's colour word and size decide."""
    r = table(spark, sf_dir, "region")
    none, words = F.lit(None), F.array(F.lit("red"), F.lit("small"), F.lit("blue"), F.lit("green"), F.lit("large"))
    return r.select(
        F.col("r_name").alias("rule"), F.when(F.col("r_regionkey") % 2 == 0, "filler").otherwise("core").alias("category"), (F.col("r_regionkey") * 10).alias("priority"), F.array(F.get(words, F.col("r_regionkey"))).alias("tags_any"), none.cast("array<string>").alias("tags_all"),
        none.cast("array<string>").alias("schools_any"), none.cast("array<string>").alias("resources_any"), none.cast("array<string>").alias("name_any"), none.cast("array<string>").alias("text_any"), none.cast("array<string>").alias("types_in"),
        (F.col("r_regionkey") == 1).alias("active_only"), none.cast("boolean").alias("passive_only"), F.when(F.col("r_regionkey") > 2, 25).alias("rank_least"),
    )


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("rank")), "node").withColumns({"type": F.col("tab"), "passive": F.col("rank") % 2 == 0})
    found = rules.matches(nodes, _rule_rows(spark, sf_dir)).select(F.col("tab").alias("scope"), F.col("name").alias("key"), F.lit("").alias("condition"), "category", "priority", "rule")
    return rules.dedupe_actions(found)


def condition_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as state snapshots; the first action whose condition holds."""
    m = lambda *x: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x])
    v, n = F.coalesce("value", F.lit(0.0)), F.lit(0.0)
    s = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("snapshot"), m("burn", v * 20).alias("debuffs"), m("haste", F.greatest(n, v - 50)).alias("buffs"), m("nova", v * 100).alias("cooldowns"), m("rage", v).alias("resources"), m("rage", F.lit(100.0)).alias("max_resources"),
        F.lit(4000.0).alias("time_ms"), F.lit(1500.0).alias("gcd_ms"), v.alias("health_pct"), (F.col("event_id") % 5).alias("enemies"),
    )
    lines = ("active_enemies>=4", "target.health.pct<10", "cooldown.nova.ready", "dot.burn.remains<gcd", "rage>=60", "buff.haste.down", "rage.deficit>0")
    actions = table(spark, sf_dir, "nation").filter(f"n_nationkey < {len(lines)}").select(F.get(F.array(*[F.lit(x) for x in lines]), F.col("n_nationkey")).alias("condition"), F.col("n_nationkey").alias("priority"), F.col("n_name").alias("key"))
    return rules.first_usable(s, actions)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of actions: the parts of a brand and type, dealt by four; some conditions have a threshold, some two."""
    k, z = F.col("p_partkey"), F.col("p_size")
    condition = F.when(z % 3 == 0, F.concat(F.lit("rage>="), z.cast("string"))).when(z % 3 == 1, F.concat(F.lit("up&mana>="), (z / 4).cast("decimal(10,2)").cast("string"), F.lit("&rage>=5"))).otherwise("")
    categories = ("builder", "spender", "cooldown", "odd")
    a = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_brand", "p_type", (k % 4).cast("string")).alias("candidate"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.get(F.array(*[F.lit(c) for c in categories]), (k % 13 % 4).cast("int")).alias("category"), condition.alias("condition"), z.cast("double").alias("priority"), k.alias("id"))
    return a.withColumn("pos", F.row_number().over(Window.partitionBy("candidate").orderBy("priority", "id"))).drop("id")


LISTS_SQL = """a AS (SELECT concat_ws('|', p_brand, p_type, p_partkey % 4) AS candidate, 'k' || p_partkey AS key, (['builder', 'spender', 'cooldown', 'odd'])[p_partkey % 13 % 4 + 1] AS category,
  CASE p_size % 3 WHEN 0 THEN 'rage>=' || p_size WHEN 1 THEN 'up&mana>=' || (p_size / 4)::DECIMAL(10,2) || '&rage>=5' ELSE '' END AS condition, p_size::DOUBLE AS priority, p_size, row_number() OVER (PARTITION BY concat_ws('|', p_brand, p_type, p_partkey % 4) ORDER BY p_size, p_partkey) AS pos FROM part)"""
#: A list as one text: what the fingerprint is the digest of.
PAYLOAD = "sha1('[' || string_agg('{{\"action_key\":\"' || {key} || '\",\"category\":\"' || category || '\",\"condition\":\"' || {condition} || '\",\"priority\":' || priority || '}}', ',' ORDER BY pos) || ']')"


def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the lists as they are and of all variants with one threshold changed."""
    return rules.variants(_lists(spark, sf_dir)).filter("nth.kind < 2").select("candidate", "mutation", "fingerprint")


def order_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the variants in which one category's actions change places, less those that equal the base."""
    return rules.variants(_lists(spark, sf_dir)).filter("nth.kind = 2").select("candidate", "mutation", "note", "fingerprint")



def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.violations(table(spark, sf_dir, "lineitem").withColumn("k", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))), "k", {"bulk": "l_quantity >= 45", "free": "l_discount >= 0.1", "line": "l_linenumber NOT BETWEEN 1 AND 6"})


def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validation_summary(table(spark, sf_dir, "lineitem"), {"bulk": "l_quantity >= 45", "free": "l_discount >= 0.1", "never": "l_quantity < 0"}, warnings=("free",))


# Cubes, snapshots, reports, sources


def _cube(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    flat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.round("p_retailprice", 2).alias("value"))
    return cube.to_coordinates(flat, 10, 60, 64)


def cube_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 12).alias("c"), F.col("p_size").cast("long").alias("l"))
    return cube.lookup(rows, _cube(spark, sf_dir)[0], {"c": "first", "l": "second"})


def cube_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, totals = _cube(spark, sf_dir)
    anchors = table(spark, sf_dir, "part").filter("p_partkey % 64 < 60 AND p_partkey < 640").select(F.floor(F.col("p_partkey") / 64).cast("long").alias("first"), (F.col("p_partkey") % 64).alias("second"), F.round("p_retailprice", 1).alias("expected"), F.lit(0.01).alias("tolerance"))
    return cube.quality(placed, 10, 50).crossJoin(totals).crossJoin(cube.compare_anchors(placed, anchors))  # one row each


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.manifest({n: table(spark, sf_dir, n) for n in TABLES}, "g1").select("name", "records")


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nation", "part", "orders")
    before = snapshots.manifest({n: table(spark, sf_dir, n) for n in names}, "g1")
    after = snapshots.manifest({"nation": table(spark, sf_dir, "nation"), "part": table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") == 3).cast("int")), "supplier": table(spark, sf_dir, "supplier")}, "g2")
    return snapshots.verify(before, after)


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("generation"), (F.col("o_orderkey") - 1).cast("string").alias("predecessor"), F.col("o_orderdate").alias("published_at"))
    return snapshots.retention(g, "77", 86400 * 365, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cls"), F.col("p_type").alias("tab")).agg(F.sum("p_size").alias("index"))
    return report.class_summary(p)


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as text log lines, read again by the log scan, and summed per player."""
    e = table(spark, sf_dir, "events").transform(canonical_events)
    amount = F.floor("amount").cast("long").cast("string")
    line = F.concat(F.date_format(F.col("ts").cast("timestamp"), "M/d HH:mm:ss.SSS"), F.lit("  SPELL_DAMAGE,0x1,\"p"), F.col("player").cast("string"), F.lit("\",0x5,0x2,\"t\",0xa,17,\""), "ability", F.lit("\",0x4,"), amount, F.lit(",0,4,0,0,0,nil,nil,nil"))
    lines = e.filter("family = 'damage'").select(line.alias("value"))
    good, _ = readers.log_lines(lines)
    return good.groupBy("player", "ability").agg(F.count("*").alias("hits"), F.sum(ev.net_amount()).alias("damage"))


def graph_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.concat("p_name", F.lit("'s")).alias("name"))
    return writers.graph_statements(nodes, _edges(spark, sf_dir).toDF("a", "b"))


def empirical_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per event type and user, raised by the type's share of all damage."""
    events = table(spark, sf_dir, "events").transform(canonical_events)
    shares = ev.ability_metrics(events.withColumn("player", F.lit(1))).select("ability", "share")
    base = events.groupBy("player", F.upper("ability").alias("name")).agg(F.count("*").cast("double").alias("score"))
    return score.empirical_blend(base, shares, 0.5)


def alternate_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under the names of secondary roles, their own left out."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.lit("flag").alias("kind"), F.col("l_returnflag").alias("key"), F.col("l_quantity").alias("value"))
    k = F.col("o_orderkey")
    builds = table(spark, sf_dir, "orders").select(k.alias("build"), F.when(k % 3 == 0, "healer").otherwise("melee_dps").alias("role"), F.round("o_totalprice", 2).alias("index"))
    others = table(spark, sf_dir, "orders").select(k.alias("build"), F.explode(F.split(F.when(k % 2 == 0, "healer").otherwise("tank,support"), ",")).alias("role"))
    return score.alternate_objectives(line, builds, others)


def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column of the wide table holds the line number that is known by name only; a tenth of the names are wrong."""
    k = F.col("l_orderkey")
    labels = _wide(spark, sf_dir).select(k.alias("row_id"), F.when(k % 10 == 0, "stale").otherwise(F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))).alias("label"))
    return discover.label_column(_cells(spark, sf_dir), labels)


def layout_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid places of parts, and a captured layout of some of them and of unknown ones."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") % 2 == 0, "Class").otherwise(F.col("p_brand")).alias("tab"), (F.col("p_partkey") % 10).alias("col"), (F.col("p_partkey") % 7).alias("row"))
    captured = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select((F.col("p_partkey") + 10).alias("node"), F.col("p_size").cast("long").alias("x"), F.lit(1).cast("long").alias("y"))
    return graph.overlay_layout(graph.grid(p), captured)


def priority_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("key"), F.when(F.col("p_size") > 25, F.concat(F.lit("rage>="), F.col("p_size").cast("string"))).alias("condition"))
    return report.priority_lines(a).select("p_partkey", "line")


QUERIES = {
    "empirical_blend": (
        empirical_blend,
        """WITH d AS (SELECT event_type AS ability, coalesce(sum(greatest(0.0, value - greatest(0.0, value - 95.0))::DECIMAL(18,4)) FILTER (event_type IN ('purchase', 'click')), 0)::DOUBLE AS damage FROM events GROUP BY 1),
s AS (SELECT ability, damage / sum(damage) OVER () AS share FROM d)
SELECT user_id AS player, upper(event_type) AS name, round(count(*) + any_value(share) * 100 * 0.5, 4) AS score FROM events JOIN s ON ability = event_type GROUP BY ALL""",
    ),
    "alternate_objectives": (
        alternate_objectives,
        """WITH b AS (SELECT l_orderkey AS build, string_agg(e, ';' ORDER BY e) AS breakdown FROM (SELECT l_orderkey, 'flag:' || l_returnflag || '=' || printf('%.2f', sum(l_quantity)::DOUBLE) AS e FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY 1),
o AS (SELECT o_orderkey AS build, CASE WHEN o_orderkey % 3 = 0 THEN 'healer' ELSE 'melee_dps' END AS own, round(o_totalprice, 2) AS index, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['healer'] ELSE ['tank', 'support'] END) AS role FROM orders)
SELECT o.build, role, CASE role WHEN 'healer' THEN 'healing' WHEN 'tank' THEN 'survival_threat' ELSE 'support' END AS objective, CASE role WHEN 'healer' THEN 'Projected Healing Index' WHEN 'tank' THEN 'Projected Survival/Threat Index' ELSE 'Projected Support Index' END AS label, index, coalesce(breakdown, '') AS breakdown FROM o LEFT JOIN b ON b.build = o.build WHERE role <> own""",
    ),
    "label_column": (
        label_column,
        f"""WITH {CELLS_SQL}, t AS (SELECT col, val, CASE WHEN w.l_orderkey % 10 = 0 THEN 'stale' ELSE 'n' || l_linenumber END AS label, count(*) AS n FROM c JOIN w ON w.l_orderkey = row_id GROUP BY ALL), b AS (SELECT col, val, arg_max(label, (n, label)) AS label, max(n) AS top, sum(n) AS al FROM t GROUP BY ALL),
s AS (SELECT col, count(*) AS v, count(DISTINCT label) AS l, sum(top) / sum(al) AS score, sum(al)::BIGINT AS n, string_agg(val || ':' || label, ',' ORDER BY val) AS mapping FROM b GROUP BY col)
SELECT col, round(score, 4)::DOUBLE AS score, n, mapping FROM s WHERE n >= 50 AND v >= 2 AND v = l AND score >= 0.85 ORDER BY score DESC, col LIMIT 1""",
    ),
    "layout_overlay": (
        layout_overlay,
        """WITH c AS (SELECT p_partkey + 10 AS node, p_size AS x, 1 AS y FROM part WHERE p_partkey % 5 = 0)
SELECT coalesce(p_partkey, node) AS node, coalesce(x, p_partkey % 10 * 64 + 32) AS x, coalesce(y, p_partkey % 7 * 64 + 32) AS y, CASE WHEN p_partkey IS NULL THEN 'layout_node_unknown' WHEN node IS NULL THEN 'fallback_position' END AS warning FROM part FULL JOIN c ON p_partkey = node""",
    ),
    "priority_lines": (priority_lines, "SELECT p_partkey, 'actions+=/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || CASE WHEN p_size > 25 THEN ',if=rage>=' || p_size ELSE '' END AS line FROM part"),
    "fk_hit_rate": (fk_hit_rate, f"WITH {RATES} SELECT *, round(hits / nonzero, 3) AS rate FROM r"),
    "fk_blocks": (
        fk_blocks,
        f"""WITH {RATES}, v AS (SELECT *, row_number() OVER (ORDER BY col) AS p FROM r WHERE col <> 0), g AS (SELECT *, p - row_number() OVER (ORDER BY col) AS i FROM v WHERE hits / nonzero >= 0.9 AND nonzero >= 50)
SELECT min(col) AS first_col, max(col) AS last_col, count(*) AS columns, sum(nonzero)::BIGINT AS nonzero, bool_and(hits = nonzero) AS proven FROM g GROUP BY i""",
    ),
    "index_columns": (index_columns, f"WITH {RATES} SELECT col, round(hits / nonzero, 3) AS rate, CASE WHEN count(*) OVER () = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM r WHERE nonzero >= 2 AND hits / nonzero >= 0.99 AND distinct_values >= 2"),
    "scalar_correlation": (
        scalar_correlation,
        f"""WITH {CELLS_SQL}, k AS (SELECT l_orderkey AS row_id, CASE WHEN l_orderkey % 10 = 0 THEN -1 ELSE l_suppkey END AS value FROM w WHERE l_orderkey IN (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1)),
s AS (SELECT col, avg((val = value)::INT) AS score, count(*) FILTER (val = value AND val <> 0) AS nonzero, count(*) AS n FROM c JOIN k USING (row_id) GROUP BY col),
o AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM s WHERE n >= 50 WINDOW w AS (ORDER BY score DESC, nonzero DESC, col DESC))
SELECT 'supplier' AS field, col, round(score, 4) AS score, round(score - next, 4) AS margin, nonzero, CASE WHEN round(score, 4) >= 0.85 AND round(score - next, 4) >= 0.15 THEN 'high' ELSE 'low' END AS confidence FROM o WHERE place = 1 AND nonzero >= 50""",
    ),
    "anchor_columns": (anchor_columns, f"WITH {CELLS_SQL} SELECT 'part' AS name, c.col, count(*) AS anchors, 'unique' AS status FROM c JOIN w ON row_id = w.l_orderkey GROUP BY c.col HAVING bool_and(val = l_partkey)"),
    "enum_domain": (enum_domain, f"WITH {CELLS_SQL} SELECT col, count(DISTINCT val) AS symbols, count(DISTINCT val) FILTER (val NOT BETWEEN 1 AND 5) AS unknown_symbols, count(*) FILTER (val NOT BETWEEN 1 AND 5) AS unknown_rows FROM c GROUP BY col"),
    "majority_labels": (majority_labels, f"WITH {CELLS_SQL}, t AS (SELECT col, val, 'n' || l_linenumber AS label, count(*) AS n FROM c JOIN w ON w.l_orderkey = row_id GROUP BY ALL), b AS (SELECT col, val, arg_max(label, (n, label)) AS label, max(n) AS top, sum(n) AS al FROM t GROUP BY ALL) SELECT col, count(*) AS \"values\", round(sum(top) / sum(al), 4)::DOUBLE AS score, sum(al)::BIGINT AS n FROM b GROUP BY col HAVING count(*) >= 2 AND count(*) = count(DISTINCT label)"),
    "recon_status": (recon_status, f"WITH {RATES} SELECT 0 AS missing, CASE WHEN n > 1 THEN n ELSE 0 END AS ambiguous, u AS unlike_policy, n + 1 AS findings, CASE WHEN n > 1 THEN 'blocked' WHEN u = 0 THEN 'verified' ELSE 'review_required' END AS verdict FROM (SELECT count(*) AS n, count(*) FILTER (col > 2) AS u FROM r WHERE hits / nonzero >= 0.99 AND distinct_values >= 2)"),
    "edges_dedupe": (
        edges_dedupe,
        f"""WITH {EDGES_SQL}, k AS (SELECT * FROM e WHERE src % 9 <> 0 AND src <> dst)
SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, 'edge' AS kind FROM k WHERE dst % 9 <> 0 UNION ALL SELECT DISTINCT src, dst, 'missing_endpoint' FROM k WHERE dst % 9 = 0""",
    ),
    "tree_edges": (
        tree_edges,
        f"""WITH {EDGES_SQL}, p AS (SELECT p_partkey AS k, p_size AS z FROM part WHERE p_partkey % 9 <> 0), l AS (SELECT src AS x, dst AS y FROM e WHERE src % 9 <> 0 AND src <> dst), q AS (SELECT unnest([k + 1, k + 2]) AS a, k AS b FROM p WHERE k % 4 = 0),
w AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b, 'connection' AS kind FROM l WHERE y IN (SELECT k FROM p) UNION ALL SELECT a, b, 'requirement' FROM q WHERE a IN (SELECT k FROM p))
SELECT w.*, CASE WHEN x.z < 15 AND y.z < 15 THEN 'selected' WHEN x.z < 15 AND y.z BETWEEN 15 AND 30 THEN 'available' WHEN y.z < 15 THEN 'gated' ELSE 'inactive' END AS state FROM w JOIN p x ON x.k = a JOIN p y ON y.k = b
UNION ALL SELECT DISTINCT x, y, 'warning', 'tree_edge_missing_target' FROM l WHERE y NOT IN (SELECT k FROM p) UNION ALL SELECT a, b, 'warning', 'tree_requirement_missing_source' FROM q WHERE a NOT IN (SELECT k FROM p)""",
    ),
    "mask_domain": (mask_domain, f"WITH {CELLS_SQL} SELECT col, bit_or(coalesce(val, 0)) AS observed_bits, bit_or(coalesce(val, 0)) & ~4095 AS unknown_bits FROM c GROUP BY col"),
    "cycle_members": (cycle_members, "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_orderkey % 10 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY p) AS i, count(*) OVER (PARTITION BY o) AS m FROM l) SELECT o || ':' || p AS node FROM n WHERE m > 2 AND i < m"),
    "edge_state": (
        edge_state,
        f"""WITH {EDGES_SQL} SELECT src AS a, dst AS b, CASE WHEN x.p_size < 15 AND y.p_size < 15 THEN 'selected' WHEN x.p_size < 15 AND y.p_size BETWEEN 15 AND 30 THEN 'available' WHEN y.p_size < 15 THEN 'gated' ELSE 'inactive' END AS state
FROM e JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst""",
    ),
    "dangling": (dangling, f"WITH {EDGES_SQL} SELECT src, dst, 'dangling_reference' AS fault FROM e WHERE dst % 9 = 0 UNION ALL SELECT src, dst, 'self_reference' FROM e WHERE src = dst"),
    "gate_edges": (gate_edges, "SELECT concat_ws(':', 'tab', p_brand, 'AE', p_size % 4) AS src, p_partkey AS dst, 'gate' AS kind FROM part WHERE p_size % 4 > 0 UNION ALL SELECT concat_ws(':', 'tab', p_brand, 'TE', p_size % 3), p_partkey, 'gate' FROM part WHERE p_size % 3 > 0"),
    "reachability": (reachability, f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT p_partkey AS node FROM part WHERE p_partkey < 5 UNION SELECT dst FROM r JOIN e ON node = src) SELECT node FROM r"),
    "linked_discovery": (
        linked_discovery,
        f"""WITH {EDGES_SQL}, a AS (SELECT p_partkey AS node FROM part WHERE p_partkey < 5), b AS (SELECT DISTINCT dst AS node FROM e JOIN a ON src = node), c AS (SELECT DISTINCT dst AS node FROM e JOIN b ON src = node)
SELECT node, min(distance) AS distance FROM (SELECT node, 0 AS distance FROM a UNION ALL SELECT node, 1 FROM b UNION ALL SELECT node, 2 FROM c) GROUP BY node""",
    ),
    "cycle_peel": (cycle_peel, "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 10 = 0) SELECT l_orderkey || ':' || l_partkey AS node FROM l QUALIFY count(*) OVER (PARTITION BY l_orderkey) > 1"),
    "free_closure": (
        free_closure,
        """WITH RECURSIVE f AS (SELECT p_type AS build, p_partkey AS node FROM part WHERE p_partkey % 7 <> 0),
n AS (SELECT a.p_partkey AS node FROM part a JOIN part b ON b.p_partkey = a.p_partkey - 1 AND a.p_type = b.p_type WHERE a.p_partkey % 4 <> 0 AND a.p_partkey % 7 <> 0),
r AS (SELECT build, node FROM f WHERE node NOT IN (SELECT node FROM n) OR (node - 1) % 7 = 0 UNION SELECT f.build, f.node FROM r JOIN f ON f.node = r.node + 1 JOIN n ON n.node = f.node) SELECT build, node FROM r""",
    ),
    "build_validation": (
        build_validation,
        """WITH s AS (SELECT l_orderkey AS build, l_partkey AS node, floor(max(l_quantity) / 10)::INT AS rank, count(*) AS times FROM lineitem GROUP BY ALL),
n AS (SELECT p_partkey AS node, p_type AS tab, p_partkey % 13 <> 0 AS own, p_size % 3 AS ae, p_size % 2 AS te, p_size % 4 AS gae, p_size % 5 AS gte, p_size AS lv FROM part WHERE p_partkey % 50 <> 7),
j AS (SELECT s.*, n.* EXCLUDE (node), n.node IS NOT NULL AS known, greatest(rank, 1) AS paid FROM s JOIN orders ON o_orderkey = build LEFT JOIN n ON s.node = n.node),
v AS (SELECT *, sum(ae * paid) OVER w - ae * paid AS oae, sum(te * paid) OVER w - te * paid AS ote FROM j WHERE known AND own WINDOW w AS (PARTITION BY build, tab))
SELECT build, 'duplicate_node' AS code, node FROM j WHERE times > 1
UNION ALL SELECT build, 'unknown_node', node FROM j WHERE NOT known UNION ALL SELECT build, 'wrong_class', node FROM j WHERE known AND NOT own
UNION ALL SELECT build, 'rank_below_minimum', node FROM v WHERE rank < 1 UNION ALL SELECT build, 'rank_above_maximum', node FROM v WHERE rank > 3
UNION ALL SELECT build, 'level_required', node FROM v WHERE lv > 45 UNION ALL SELECT build, 'tab_ae_gate_unmet', node FROM v WHERE oae < gae UNION ALL SELECT build, 'tab_te_gate_unmet', node FROM v WHERE ote < gte
UNION ALL SELECT build, 'ae_budget_exceeded', NULL FROM v GROUP BY build HAVING sum(ae * paid) > 12 UNION ALL SELECT build, 'te_budget_exceeded', NULL FROM v GROUP BY build HAVING sum(te * paid) > 8
UNION ALL SELECT v.build, 'required_node_missing', v.node FROM v WHERE v.node % 3 = 0 AND EXISTS (SELECT 1 FROM n WHERE n.node = v.node + 1 AND own) AND NOT EXISTS (SELECT 1 FROM s WHERE s.build = v.build AND s.node = v.node + 1)""",
    ),
    "frontier_round": (
        frontier_round,
        """WITH c AS (SELECT p_brand AS scope, p_partkey AS node, p_size % 3 AS ae, p_size % 2 AS te, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS b FROM part WHERE p_size <= 40 AND p_size % 3 <= 4 AND p_size % 2 <= 3 AND p_partkey % 3 <> 0)
SELECT scope, node::VARCHAR AS state, 4 - ae AS ae_left, 3 - te AS te_left, ae + te AS spend FROM c WHERE b <= 10 QUALIFY row_number() OVER (PARTITION BY scope ORDER BY ae + te DESC, node::VARCHAR) <= 5""",
    ),
    "award_schedule": (award_schedule, "WITH l AS (SELECT DISTINCT p_size AS level FROM part), a AS (SELECT level, (level % 2 = 0)::INT AS ae_award, (level % 2 = 1)::INT AS te_award FROM l) SELECT *, sum(ae_award) OVER (ORDER BY level) AS ae_total, sum(te_award) OVER (ORDER BY level) AS te_total FROM a"),
    "node_scores": (
        node_scores,
        """WITH t AS (SELECT p_type, (max(p_size) % 7)::DOUBLE AS w FROM part GROUP BY 1),
c AS (SELECT p_partkey AS node, w AS value FROM part JOIN t USING (p_type) WHERE w <> 0 UNION ALL SELECT p_partkey, length(k) - 4 FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS k FROM part) WHERE length(k) <> 4 UNION ALL SELECT p_partkey, 2.5 FROM part WHERE contains(lower(p_brand), 'brand#2'))
SELECT node, round(sum(value), 4) AS value, count(*) AS components FROM c GROUP BY node""",
    ),
    "build_index": (
        build_index,
        """WITH t AS (SELECT p_type, (max(p_size) % 7)::DOUBLE AS w FROM part GROUP BY 1),
c AS (SELECT p_partkey AS node, w AS value FROM part JOIN t USING (p_type) WHERE w <> 0 UNION ALL SELECT p_partkey, length(k) - 4 FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS k FROM part) WHERE length(k) <> 4 UNION ALL SELECT p_partkey, 2.5 FROM part WHERE contains(lower(p_brand), 'brand#2')),
v AS (SELECT node, sum(value) AS value FROM c GROUP BY node), m AS (SELECT DISTINCT l_orderkey AS build, l_partkey AS node FROM lineitem),
b AS (SELECT build, round(100.0 + coalesce(sum(value), 0), 2) AS i, count(*) FILTER (node % 2 = 0) > greatest(3, floor(count(*) / 2)) AS low FROM m LEFT JOIN v USING (node) GROUP BY build)
SELECT build, i AS index, i AS mid, CASE WHEN low THEN 'low' ELSE 'medium' END AS confidence, round(i * (1 - CASE WHEN low THEN 0.22 ELSE 0.14 END), 2) AS "low", round(i * (1 + CASE WHEN low THEN 0.22 ELSE 0.14 END), 2) AS high FROM b""",
    ),
    "synergies": (
        synergies,
        """WITH s AS (SELECT DISTINCT x, y FROM (SELECT p_brand, min(p_name) AS x, max(p_name) AS y FROM part GROUP BY 1)), m AS (SELECT DISTINCT l_orderkey AS build, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.build, 'synergy' AS kind, x || '+' || y AS key, 1.5::DOUBLE AS value FROM s JOIN m a ON a.name = x JOIN m b ON b.name = y AND a.build = b.build""",
    ),
    "item_scores": (
        item_scores,
        """WITH w AS (SELECT p_type, min(p_size)::DOUBLE AS w FROM part GROUP BY 1), s AS (SELECT p_type AS role, p_partkey AS item, round(((p_size * w)::DECIMAL(18,4) + (round(p_retailprice, 2) * 0.5)::DECIMAL(18,4))::DOUBLE, 3) AS score FROM part JOIN w USING (p_type))
SELECT role, item, score, row_number() OVER (PARTITION BY role ORDER BY score DESC, item DESC) AS place FROM s QUALIFY place <= 10""",
    ),
    "watchlist_hits": (
        watchlist_hits,
        "SELECT r_regionkey, count(*) AS n FROM region JOIN part ON (r_regionkey = 0 OR lower(p_brand) = 'brand#' || r_regionkey) AND (r_regionkey % 2 = 1 OR p_size % 2 = 0) GROUP BY r_regionkey",
    ),
    "band_floors": (
        band_floors,
        """WITH s AS (SELECT o_custkey AS scope, round(o_totalprice, 2) AS score FROM orders), b AS (SELECT scope, max(score) AS best, median(score) AS med, count(*) AS n, list_reverse_sort(list(score)) AS al FROM s GROUP BY scope),
m AS (SELECT s.scope, median(abs(score - med)) AS mad FROM s JOIN b USING (scope) GROUP BY s.scope),
f AS (SELECT b.*, greatest(best * 0.9, CASE WHEN n >= 6 THEN best - greatest(1.5 * mad, best * 0.05) ELSE best * 0.9 END) AS fl FROM b JOIN m USING (scope)),
a AS (SELECT *, n > 1 AND al[2] < fl AS alone FROM f)
SELECT scope, round(CASE WHEN alone THEN greatest(best * 0.88, al[2]) ELSE fl END, 4) AS floor, alone AS widened, best FROM a""",
    ),
    "rule_matches": (
        rule_matches,
        """WITH m AS (SELECT p_type AS scope, p_name AS key, '' AS condition, CASE WHEN r_regionkey % 2 = 0 THEN 'filler' ELSE 'core' END AS category, r_regionkey * 10 AS priority, r_name AS rule FROM part JOIN region
  ON list_contains(string_split(p_name, ' '), (['red', 'small', 'blue', 'green', 'large'])[(r_regionkey + 1)::INT]) AND (r_regionkey <> 1 OR p_size % 2 <> 0) AND (r_regionkey <= 2 OR p_size >= 25)),
k AS (SELECT *, max((category <> 'filler')::INT) OVER (PARTITION BY scope, key) AS s FROM m)
SELECT scope, key, condition, category, priority, rule FROM k WHERE NOT (category = 'filler' AND s = 1) QUALIFY row_number() OVER (PARTITION BY scope, key, condition, category ORDER BY priority, rule) = 1""",
    ),
    "condition_eval": (
        condition_eval,
        """WITH s AS (SELECT event_id, coalesce(value, 0) AS v FROM events)
SELECT event_id AS snapshot, 0 AS unsupported, 'NATION_' || CASE WHEN event_id % 5 >= 4 THEN 0 WHEN v < 10 THEN 1 WHEN v * 100 <= 4000 THEN 2 WHEN v * 20 < 1500 THEN 3 WHEN v >= 60 THEN 4 WHEN v - 50 <= 0 THEN 5 ELSE 6 END AS action FROM s WHERE event_id % 5 >= 4 OR v < 100 OR v >= 60""",
    ),
    "param_sweep": (
        param_sweep,
        f"""WITH {LISTS_SQL},
f AS (SELECT candidate, pos, key, p_size % 3 AS form, CASE p_size % 3 WHEN 0 THEN 'rage' ELSE 'mana' END AS res, CASE p_size % 3 WHEN 0 THEN p_size ELSE p_size / 4 END::DOUBLE AS n, unnest([0.75, 1.0, 1.25])::DOUBLE AS mult FROM a WHERE condition <> ''),
t AS (SELECT *, regexp_replace(printf('%.2f', round_even(least(1000.0, n * mult)::DOUBLE, 2)), '\\.?0+$', '') AS new, regexp_replace(printf('%.2f', n), '\\.?0+$', '') AS old FROM f),
c AS (SELECT *, concat_ws(':', 'threshold', key, res, new) AS mutation, CASE form WHEN 0 THEN 'rage>=' || new ELSE 'up&mana>=' || new || '&rage>=5' END AS changed FROM t WHERE new <> old)
SELECT candidate, 'base' AS mutation, {PAYLOAD.format(key='key', condition='condition')} AS fingerprint FROM a GROUP BY candidate
UNION ALL SELECT a.candidate, mutation, {PAYLOAD.format(key='a.key', condition='CASE WHEN a.pos = c.pos THEN changed ELSE condition END').replace('ORDER BY pos', 'ORDER BY a.pos')} FROM a JOIN c ON a.candidate = c.candidate GROUP BY a.candidate, mutation""",
    ),
    "order_variants": (
        order_variants,
        f"""WITH {LISTS_SQL}, g AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY candidate, category) AS m FROM a WHERE category <> 'odd' WINDOW w AS (PARTITION BY candidate, category ORDER BY pos)),
v AS (SELECT candidate, category, 'Reverse' AS what, i, m + 1 - i AS src FROM g WHERE m > 1 UNION ALL SELECT candidate, category, 'Rotate', i, i % m + 1 FROM g WHERE m > 2),
c AS (SELECT v.candidate, v.category, what, x.pos, y.key AS new_key, y.condition AS new_condition FROM v JOIN g x ON x.candidate = v.candidate AND x.category = v.category AND x.i = v.i JOIN g y ON y.candidate = v.candidate AND y.category = v.category AND y.i = v.src),
u AS (SELECT DISTINCT candidate, category AS grp, what FROM c),
f AS (SELECT a.candidate, u.grp, u.what, {PAYLOAD.format(key='coalesce(new_key, a.key)', condition='coalesce(new_condition, a.condition)').replace('|| category ||', '|| a.category ||').replace('ORDER BY pos', 'ORDER BY a.pos')} AS fingerprint
  FROM a JOIN u ON u.candidate = a.candidate LEFT JOIN c ON c.candidate = a.candidate AND c.category = u.grp AND c.what = u.what AND c.pos = a.pos GROUP BY ALL)
SELECT candidate, 'reorder_group:' || grp AS mutation, what || ' ' || grp || ' priority order.' AS note, fingerprint FROM f QUALIFY row_number() OVER (PARTITION BY candidate, fingerprint ORDER BY grp, what) = 1""",
    ),
    "rule_violations": (
        rule_violations,
        "SELECT concat_ws('-', l_orderkey, l_partkey) AS k, unnest(list_filter([CASE WHEN l_quantity >= 45 THEN 'bulk' END, CASE WHEN l_discount >= 0.1 THEN 'free' END, CASE WHEN l_linenumber NOT BETWEEN 1 AND 6 THEN 'line' END], lambda x: x IS NOT NULL)) AS code FROM lineitem",
    ),
    "validation_summary": (validation_summary, "SELECT * FROM (SELECT 'bulk' AS code, count(*) FILTER (l_quantity >= 45) AS n, 'failure' AS level FROM lineitem UNION ALL SELECT 'free', count(*) FILTER (l_discount >= 0.1), 'warning' FROM lineitem) WHERE n > 0"),
    "cube_lookup": (
        cube_lookup,
        """WITH c AS (SELECT p_partkey // 64 AS f, p_partkey % 64 AS s, round(p_retailprice, 2) AS value FROM part WHERE p_partkey // 64 < 10 AND p_partkey % 64 < 60)
SELECT p_partkey, p_partkey % 12 AS c, p_size::BIGINT AS l, value, value IS NULL AS missed FROM part LEFT JOIN c ON p_partkey % 12 = f AND p_size = s""",
    ),
    "cube_quality": (
        cube_quality,
        """WITH c AS (SELECT p_partkey // 64 AS f, p_partkey % 64 AS s, round(p_retailprice, 2) AS value FROM part), i AS (SELECT * FROM c WHERE f < 10 AND s < 60)
SELECT 0 AS not_finite, 0 AS repeated, count(*) FILTER (s >= 50) AS out_of_range, count(*) AS "rows", count(*) AS emitted, (SELECT count(*) FROM part) - count(*) AS padding, count(*) AS checked, count(*) FILTER (abs(value - round(value, 1)) <= 0.01) AS equal,
       count(*) FILTER (abs(value - round(value, 1)) > 0.01) AS different, CASE WHEN bool_or(abs(value - round(value, 1)) > 0.01) THEN 'mismatch' ELSE 'match' END AS status FROM i""",
    ),
    "dataset_manifest": (dataset_manifest, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS records FROM {n}" for n in TABLES)),
    "manifest_check": (manifest_check, "SELECT 'orders' AS name, 'missing' AS finding FROM orders GROUP BY 1 UNION ALL SELECT 'supplier', 'not_recorded' FROM supplier GROUP BY 1 UNION ALL SELECT 'part', 'hash_mismatch' FROM part GROUP BY 1"),
    "retention": (retention, "SELECT o_orderkey::VARCHAR AS generation, o_orderdate AS published_at FROM orders WHERE o_orderkey NOT IN (76, 77) AND o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 365 DAYS"),
    "class_summary": (
        class_summary,
        "WITH p AS (SELECT p_brand AS cls, p_type AS tab, sum(p_size)::BIGINT AS i FROM part GROUP BY ALL) SELECT cls, tab AS best_tab, i AS best_index, count(*) OVER (PARTITION BY cls) AS tabs FROM p QUALIFY row_number() OVER (PARTITION BY cls ORDER BY i DESC, tab) = 1",
    ),
    "log_metrics": (
        log_metrics,
        "SELECT 'p' || user_id AS player, event_type AS ability, count(*) AS hits, sum(floor(value))::DOUBLE AS damage FROM events WHERE event_type IN ('purchase', 'click') GROUP BY ALL",
    ),
    "graph_statements": (
        graph_statements,
        f"WITH {EDGES_SQL} SELECT 'MERGE (n:Node {{id: ' || p_partkey || '}}) SET n.name = ''' || replace(p_name || '''s', '''', chr(92) || '''') || ''';' AS value FROM part UNION ALL SELECT 'MATCH (a:Node {{id: ' || src || '}}), (b:Node {{id: ' || dst || '}}) MERGE (a)-[:LINKS]->(b);' FROM e",
    ),
}
