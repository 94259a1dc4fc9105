"""Sources and sinks: tables written below the shared folder in each format, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import number
from tessera.operators import enrichment, mechanics, rules, shapes
from tessera.plans.catalogue_queries import NODES_SQL, part_nodes, pick
from tessera.plans.common import canonical_events, table
from tessera.session import shared_path
from tessera.sources import readers, writers


def _written(df: DataFrame, label: str) -> str:
    """Lines of the column ``value`` as text files; where they are."""
    path = shared_path(df.sparkSession, label)
    df.write.text(path)
    return path


def _apart(df: DataFrame, key: str, label: str) -> str:
    """One document of the column ``value`` to a file; where they are."""
    path = shared_path(df.sparkSession, label)
    df.select("value", F.col(key).alias("of")).write.partitionBy("of").text(path)
    return path


def _order_lines(spark: SparkSession, sf_dir: str) -> str:
    """Orders as JSON lines, some of them broken, of the wrong type, blank, or of another version."""
    k = F.col("o_orderkey")
    good = F.to_json(F.struct(k.alias("id"), F.when(k % 7 == 0, "v1").otherwise("v2").alias("schema_version"), F.col("o_orderpriority").alias("priority")))
    line = F.when(k % 50 == 1, F.concat(F.lit("broken "), k.cast("string"))).when(k % 50 == 2, "").when(k % 50 == 3, F.concat(F.lit('{"id": "x'), k.cast("string"), F.lit('"}'))).when(k % 50 == 4, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(good)
    return _written(table(spark, sf_dir, "orders").select(line.alias("value")), "order-lines")


def json_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed lines, rejects with their reasons, and the version gate."""
    good, bad = readers.json_lines(spark, _order_lines(spark, sf_dir), "id long, schema_version string, priority string")
    right, wrong = readers.version_gate(good, "v2")
    return right.select(F.col("id").cast("string").alias("what"), F.lit("read").alias("outcome")).unionByName(wrong.select(F.col("id").cast("string").alias("what"), F.col("reason").alias("outcome"))).unionByName(bad.select(F.col("line").alias("what"), F.col("reason").alias("outcome")))


JSON_SQL = """SELECT CASE WHEN o_orderkey % 50 = 1 THEN 'broken ' || o_orderkey WHEN o_orderkey % 50 = 3 THEN '{"id": "x' || o_orderkey || '"}' WHEN o_orderkey % 50 = 4 THEN '[' || o_orderkey || ']' ELSE o_orderkey::VARCHAR END AS what,
  CASE WHEN o_orderkey % 50 IN (1, 4) THEN 'not_a_json_object' WHEN o_orderkey % 50 = 3 THEN 'wrong_type' WHEN o_orderkey % 7 = 0 THEN 'unsupported_schema_version:v1' ELSE 'read' END AS outcome FROM orders WHERE o_orderkey % 50 <> 2"""


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested class documents as tabs, layouts as nodes and edges, and content files as one log; rows counted by kind and class."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("tab_name"), F.col("p_partkey").alias("k"))
    tabs = p.groupBy("class_name", "tab_name").agg(F.min("k").alias("tab_id")).groupBy("class_name").agg(F.min("tab_id").alias("class_id"), F.array_sort(F.collect_list(F.struct("tab_id", "tab_name"))).alias("tabs"))
    flat = readers.flat_tabs(spark, _apart(tabs.select("class_name", F.to_json(F.struct("class_id", "class_name", "tabs")).alias("value")), "class_name", "class-documents"))
    node = F.struct(F.col("k").alias("entry_id"), F.col("tab_name").alias("name"), (F.col("k") % 10).cast("double").alias("x"), F.lit(1.0).alias("y"))
    edge = F.struct(F.col("k").alias("source_entry_id"), (F.col("k") + 1).alias("target_entry_id"), F.lit("link").alias("kind"))
    trees = p.groupBy("class_name").agg(F.array(F.struct(F.lit("spec").alias("tree_kind"), F.array_sort(F.collect_list(node)).alias("nodes"), F.array_sort(F.collect_list(edge)).alias("edges"))).alias("trees"))
    documents = trees.select("class_name", F.to_json(F.struct(F.when(F.col("class_name") == "Brand#1", "old").otherwise("v1").alias("schema_version"), "class_name", "trees")).alias("value"))
    nodes, edges = readers.layout_documents(spark, _apart(documents, "class_name", "layouts"), "v1")
    contents = p.groupBy("class_name").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string").alias("ID"), F.col("tab_name").alias("Name"))))).alias("value"))
    buckets = contents.select("class_name", F.concat(F.lit('{"entries": '), "value", F.lit("}")).alias("value"))
    entries = buckets.select("class_name", F.explode(readers.bucket_entries(F.col("value"))).alias("e"))
    count = lambda df, kind: df.groupBy("class_name").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    log = readers.content_log(spark, {"part": _apart(contents, "class_name", "contents")}, ("ID",))
    logged = log.join(table(spark, sf_dir, "part"), F.col("id") == F.col("p_partkey")).filter("values['Name'] = p_type").withColumnRenamed("p_brand", "class_name")
    return count(flat, "tabs").unionByName(count(nodes, "nodes")).unionByName(count(edges, "edges")).unionByName(count(entries, "entries")).unionByName(count(logged, "log"))


DOCUMENTS_SQL = """SELECT p_brand AS class_name, count(DISTINCT p_type) AS n, 'tabs' AS kind FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(*), 'nodes' FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1 UNION ALL SELECT p_brand, count(*), 'edges' FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1
UNION ALL SELECT p_brand, count(*), 'entries' FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(*), 'log' FROM part GROUP BY 1"""


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sink writes, read back and counted: sorted JSON, a guarded projection, a listing, a graph, and the files' inventory."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, "high").otherwise("low").alias("confidence"))
    at = {name: shared_path(spark, f"sink-{name}") for name in ("json", "projection", "listing", "graph")}
    recorded = writers.write_json_sorted(rows, at["json"])
    withheld = writers.write_projection(rows, ["p_partkey"], F.col("p_partkey") % 10 != 0, at["projection"])
    writers.write_counts_tsv(rows, ["p_brand"], at["listing"])
    writers.write_graph(rows.select(F.col("p_partkey").alias("node")), rows.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")), at["graph"])
    one = lambda df, what: df.select(F.lit(what).alias("what"), "n")
    counted = lambda df, what: one(df.agg(F.count("*").alias("n")), what)
    listing = spark.read.csv(at["listing"], sep="\t", header=True, schema="p_brand string, n long")
    files = readers.file_inventory(spark, at["graph"], "*.parquet")
    return (
        one(recorded.select(F.col("records").alias("n")), "recorded")
        .unionByName(counted(spark.read.schema("confidence string, p_brand string, p_partkey long").json(at["json"]).filter("p_partkey IS NOT NULL"), "json"))
        .unionByName(counted(spark.read.parquet(at["projection"]), "projection"))
        .unionByName(withheld.select(F.concat_ws(":", F.when(F.col("withheld"), "withheld").otherwise("kept"), "confidence").alias("what"), "n"))
        .unionByName(listing.select(F.col("p_brand").alias("what"), "n"))
        .unionByName(counted(spark.read.parquet(f"{at['graph']}/edges"), "edges"))
        .unionByName(one(files.agg((F.count_if(F.col("length") > 0) > 0).cast("long").alias("n")), "has_files"))
    )


SINKS_SQL = """SELECT 'recorded' AS what, count(*) AS n FROM part UNION ALL SELECT 'json', count(*) FROM part UNION ALL SELECT 'edges', count(*) FROM part UNION ALL SELECT 'projection', count(*) FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'has_files', 1
UNION ALL SELECT CASE WHEN p_partkey % 10 = 0 THEN 'withheld:' ELSE 'kept:' END || CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END, count(*) FROM part GROUP BY 1 UNION ALL SELECT p_brand, count(*) FROM part GROUP BY 1"""


def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one document per player, read again as events."""
    e = table(spark, sf_dir, "events").transform(canonical_events)
    one = F.struct(F.col("ts").cast("string").alias("ts"), F.lit("SPELL_DAMAGE").alias("event"), "ability", "target", "amount", "critical")
    documents = e.groupBy("player").agg(F.collect_list(one).alias("events")).select(F.to_json(F.struct(F.col("player").cast("string").alias("player"), "events")).alias("d"))
    return readers.session_events(documents, "d").groupBy("player", "ability", "family").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("decimal(18,4)")).cast("double"), 4).alias("amount"))


def payload_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and kinds of the events' property objects."""
    return shapes.json_shape(table(spark, sf_dir, "events"), "props").select("key", "kind", "n")


def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.key_histogram(table(spark, sf_dir, "events"), "props")


def infer_mechanics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_nodes(spark, sf_dir).select(F.col("node").alias("id"), "text", "tags", "schools", "resources")
    overrides = rows.filter("id % 17 = 0").select("id", F.lit("special").alias("kind"), F.lit(9).alias("charges"))
    m = mechanics.infer_mechanics(rows, overrides)
    costs = F.array_join(F.transform(F.array_sort(F.map_entries("costs")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("int").cast("string"))), ",")
    return m.select("id", "kind", "school", "power_type", "duration_ms", "tick_interval_ms", "cooldown_ms", "charges", "max_targets", "chance", "internal_cooldown_ms", costs.alias("costs"), F.col("effect.effect_type").alias("effect_type"), F.col("effect.amount").alias("amount"), F.col("effect.target").alias("target"), F.array_join("effect.tags", ",").alias("effect_tags"), "confidence")


MECHANICS_SQL = f"""WITH {NODES_SQL}, m AS (SELECT *, level % 5 AS z, node % 6 AS g FROM pn)
SELECT node AS id, CASE WHEN node % 17 = 0 THEN 'special' WHEN g = 0 OR z = 0 AND g <> 1 THEN 'debuff' WHEN g = 2 THEN 'cooldown' WHEN z = 2 AND g NOT IN (0, 1) THEN 'buff' ELSE 'ability' END AS kind,
  CASE WHEN len(schools) > 0 THEN schools[1] WHEN z = 0 THEN 'fire' ELSE '' END AS school, coalesce(resources[1], '') AS power_type, CASE z WHEN 0 THEN 12000 WHEN 1 THEN 8000 WHEN 2 THEN 10000 END::BIGINT AS duration_ms, CASE WHEN z = 0 THEN 3000 WHEN z = 3 THEN 45000 END::BIGINT AS tick_interval_ms, CASE WHEN z = 1 THEN 30000 END::BIGINT AS cooldown_ms,
  CASE WHEN node % 17 = 0 THEN 9 WHEN z = 2 THEN 2 END AS charges, CASE WHEN z = 3 THEN 3 END AS max_targets, CASE WHEN z = 3 THEN 0.15::DOUBLE END AS chance, CASE WHEN z = 3 THEN 45000 END::BIGINT AS internal_cooldown_ms, CASE z WHEN 0 THEN CASE WHEN len(resources) > 0 THEN 'energy' ELSE 'Energy' END || '=' || level WHEN 1 THEN 'Focus=5,Mana=20' ELSE '' END AS costs,
  CASE WHEN z = 1 OR g = 1 THEN 'heal' WHEN z = 0 OR g = 0 THEN 'damage' WHEN z = 2 THEN 'aura_apply' END AS effect_type, CASE WHEN z = 1 OR z = 0 AND g <> 1 THEN level::DOUBLE END AS amount, CASE WHEN z = 1 OR g = 1 THEN 'ally' WHEN z = 0 OR g = 0 THEN 'enemy' WHEN z = 2 THEN 'self' END AS target,
  CASE WHEN z IN (0, 1, 2) OR g IN (0, 1) THEN array_to_string(CASE WHEN z = 0 AND g <> 0 THEN list_append(tags, 'dot') ELSE tags END, ',') END AS effect_tags, CASE WHEN z < 4 OR g IN (0, 1) THEN 'medium' ELSE 'low' END AS confidence FROM m"""


def infer_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = part_nodes(spark, sf_dir).withColumns({"entry_type": F.when(F.col("node") % 2 == 0, "Talent").otherwise("Ability"), "known_duration_ms": F.when(F.col("node") % 3 == 0, 7000).cast("long"), "period_ms": F.when(F.col("node") % 5 == 0, 1000).cast("long")})
    e = mechanics.infer_effects(n)
    return e.select("node", "kind", *[F.col(f"effect.{c}").alias(c) for c in ("effect_type", "school", "target", "amount", "duration_ms", "tick_interval_ms")])


EFFECTS_SQL = f"""WITH {NODES_SQL}, m AS (SELECT *, level % 5 AS z, node % 6 AS g FROM pn),
e AS (SELECT *, CASE WHEN g = 1 OR z = 1 THEN 'heal' WHEN z = 3 THEN 'summon' WHEN g IN (2, 4) OR z = 2 THEN 'aura_apply' WHEN g = 0 OR len(schools) > 0 OR z = 0 THEN 'damage' END AS t FROM m)
SELECT node, CASE WHEN passive OR node % 2 = 0 AND z IN (2, 3, 4) THEN 'passive' WHEN g = 0 THEN 'debuff' WHEN g = 2 THEN 'cooldown' ELSE 'ability' END AS kind, t AS effect_type, CASE WHEN t IN ('heal', 'damage') THEN CASE WHEN len(schools) = 1 THEN schools[1] WHEN len(schools) > 1 THEN '' WHEN z = 0 THEN 'fire' ELSE '' END END AS school,
  CASE WHEN t = 'heal' THEN 'ally' WHEN t = 'damage' THEN 'enemy' WHEN t IS NOT NULL THEN 'self' END AS target, CASE WHEN t IN ('heal', 'damage') AND z = 0 THEN level::DOUBLE END AS amount, CASE WHEN t IS NOT NULL THEN coalesce(CASE WHEN node % 3 = 0 THEN 7000 END, CASE z WHEN 0 THEN 12000 WHEN 1 THEN 8000 WHEN 2 THEN 10000 END)::BIGINT END AS duration_ms, CASE WHEN t IS NOT NULL AND node % 5 = 0 THEN 1000::BIGINT END AS tick_interval_ms FROM e"""


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("spell"), F.when(k % 4 == 0, "other").otherwise(F.concat(F.lit("Spell-"), k.cast("string"))).alias("name"), F.when(k % 5 == 0, "fetch_failed").otherwise("matched").alias("status"), F.when(k % 3 == 0, k.cast("int")).alias("tooltip_level"), (k * 10).alias("cooldown_ms")
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_nodes(spark, sf_dir).select(F.col("node").alias("entry"), (F.col("node") % 40).alias("spell"), F.concat(F.lit("spell "), (F.col("node") % 40).cast("string")).alias("name"))


ENRICH_SQL = """e AS (SELECT DISTINCT p_partkey % 40 AS spell FROM part), l AS (SELECT p_partkey % 40 AS spell, max(p_partkey) AS entry FROM part GROUP BY 1),
f AS (SELECT s_suppkey AS spell, s_suppkey % 4 <> 0 AS same, CASE WHEN s_suppkey % 5 = 0 THEN 'fetch_failed' ELSE 'matched' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS tooltip_level FROM supplier),
r AS (SELECT e.spell, coalesce(status, 'fetch_failed') AS status, tooltip_level::INT AS tooltip_level, entry, coalesce(same, false) AS name_match FROM e JOIN l USING (spell) LEFT JOIN f USING (spell))"""


def enrichment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrichment_rows(_entries(spark, sf_dir), _fetched(spark, sf_dir)).select("spell", "status", "tooltip_level", "entry", "name_match")


def enrichment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.enrichment_rows(_entries(spark, sf_dir), _fetched(spark, sf_dir))
    one = enrichment.enrichment_summary(rows)
    return one.select("ids", "name_mismatches", "with_level", F.coalesce(F.try_element_at("statuses", F.lit("matched")), F.lit(0)).alias("matched"))


def three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the fetched side, gated by the client's or the builder's name."""
    client = table(spark, sf_dir, "supplier").filter("s_suppkey % 6 = 0").select(F.col("s_suppkey").alias("spell"), F.when(F.col("s_suppkey") % 4 == 0, "Other").otherwise("x").alias("name"))
    entries = _entries(spark, sf_dir).withColumn("name", F.when(F.col("entry") % 120 == 7, "Another").otherwise(F.col("name")))
    fetched = _fetched(spark, sf_dir).withColumn("name", F.when(F.col("spell") % 20 == 9, "").otherwise(F.col("name")))
    return enrichment.single_source(enrichment.three_sources(entries, fetched, client), "cooldown_ms")


THREE_SQL = """WITH b AS (SELECT p_partkey % 40 AS spell, count(DISTINCT CASE WHEN p_partkey % 120 = 7 THEN 'another' ELSE 'spell' END) = 1 AS agree FROM part GROUP BY 1),
f AS (SELECT s_suppkey AS spell, CASE WHEN s_suppkey % 20 = 9 THEN '' WHEN s_suppkey % 4 = 0 THEN 'other' ELSE 'spell ' || s_suppkey END AS name FROM supplier),
g AS (SELECT f.spell, name, CASE WHEN f.spell % 6 = 0 THEN CASE WHEN f.spell % 4 = 0 THEN 'other' ELSE 'x' END WHEN agree THEN 'spell ' || f.spell ELSE name END AS reference FROM f JOIN b ON b.spell = f.spell),
e AS (SELECT *, CASE WHEN name = '' THEN 'db_identity_unverifiable' WHEN name <> reference THEN 'db_identity_mismatch' END AS ineligible FROM g)
SELECT spell, CASE WHEN ineligible IS NULL THEN spell * 10 END AS value, CASE WHEN ineligible IS NULL THEN 'fetched' END AS source, CASE WHEN ineligible IS NULL THEN 'db_fallback' ELSE 'omitted_no_eligible_candidate' END AS reason, ineligible FROM e"""


def tooltips(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = part_nodes(spark, sf_dir).select("node", F.when(F.col("node") % 9 != 0, F.col("node")).alias("spell"), "name", F.when(F.col("node") % 8 == 0, "").otherwise(F.col("text")).alias("text"))
    k = F.col("p_partkey")
    fetched = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(k.alias("spell"), F.when(k % 10 == 0, "failed").otherwise("matched").alias("status"), F.concat(F.lit("tip "), k.cast("string")).alias("tooltip_text"), F.when(k % 12 == 0, "").otherwise('<b onclick="x">hi</b><ins>').alias("tooltip_html"), (k % 3 == 0).alias("name_match"))
    return enrichment.choose_tooltip(nodes, fetched)


TOOLTIPS_SQL = f"""WITH {NODES_SQL}, j AS (SELECT node, name, CASE WHEN node % 8 = 0 THEN '' ELSE text END AS text, node % 9 <> 0 AS sp, node % 9 <> 0 AND node % 2 = 0 AND node % 10 <> 0 AS db FROM pn),
t AS (SELECT *, CASE WHEN db THEN 'tip ' || node WHEN text <> '' THEN text ELSE name END AS x FROM j)
SELECT CASE WHEN sp THEN 'spell:' ELSE 'entry:' END || node AS tooltip_id, node, name, x AS text, '<strong>' || name || '</strong><div>' || CASE WHEN db AND node % 12 <> 0 THEN '<b>hi</b>' ELSE x END || '</div>' AS html, CASE WHEN db THEN 'fetched' ELSE 'own' END AS source,
  CASE WHEN db AND node % 3 = 0 THEN 'high' WHEN db OR text <> '' THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN db AND node % 3 <> 0 THEN 'name_mismatch' END AS warning FROM t"""


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    payloads = table(spark, sf_dir, "part").select(
        k.alias("item"), F.when(k % 3 == 0, "failed").otherwise("matched").alias("status"), F.col("p_name").alias("name"), pick(("One-Hand Sword", "Plate Chest", "Nothing"), k % 4).alias("tooltip_text"), F.when(k % 5 == 0, "main_hand").alias("inventory_type"),
        F.lit(None).cast("string").alias("item_class"), F.lit(None).cast("string").alias("weapon_type"), F.lit(None).cast("string").alias("armor_type"), F.array(F.struct(F.lit("haste").alias("name"), F.col("p_size").cast("double").alias("value"))).alias("stats"),
    )
    return enrichment.item_rows(payloads).select("item", "name", "slot", "item_class", "weapon_type", "armor_type", F.col("stats")["haste"].alias("haste"))


ITEMS_SQL = """SELECT p_partkey AS item, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'main_hand' WHEN p_partkey % 4 = 0 THEN 'one_hand' WHEN p_partkey % 4 = 1 THEN 'chest' END AS slot, CASE p_partkey % 4 WHEN 0 THEN 'weapon' WHEN 1 THEN 'armor' END AS item_class, CASE WHEN p_partkey % 4 = 0 THEN 'sword' END AS weapon_type, CASE WHEN p_partkey % 4 = 1 THEN 'plate' END AS armor_type, p_size::DOUBLE AS haste FROM part WHERE p_partkey % 3 <> 0"""


def stat_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of the parts of each order, as items that are worn."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.create_map(F.lit("haste"), F.col("p_size").cast("double"), F.lit("armor"), F.lit(2.0)).alias("stats"), F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("haste"), F.lit(7.0))).otherwise(F.create_map().cast("map<string,double>")).alias("ratings"), F.when(F.col("p_partkey") % 2 == 0, 1.5).alias("spell_power"), F.lit(None).cast("double").alias("attack_power"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("item")).join(p, "item")
    return enrichment.stat_totals(items, ["build"])


STATS_SQL = """WITH i AS (SELECT l_orderkey AS build, p_partkey AS k, p_size AS z FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT build, 'haste' AS stat, sum(CASE WHEN k % 3 = 0 THEN 7.0 ELSE z END)::DOUBLE AS total FROM i GROUP BY 1 UNION ALL SELECT build, 'armor', 2.0 * count(*) FROM i GROUP BY 1 UNION ALL SELECT build, 'spell_power', 1.5 * count(*) FROM i WHERE k % 2 = 0 GROUP BY 1"""


def catalogue_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = part_nodes(spark, sf_dir), F.col("node")
    number_or = lambda bad, c: F.when(~bad, F.lit(1)).cast("long").alias(c)
    entries = n.select(
        F.when(k % 31 == 0, "v0").when(k % 37 != 0, "v1").alias("schema_version"), F.when(k % 20 == 0, "").otherwise(F.col("cls")).alias("class_name"), F.col("tab").alias("tab_name"), F.when(k % 11 == 0, "unknown").when(k % 13 == 0, "odd").otherwise("talent").alias("essence_kind"), "name", number_or(k % 17 == 0, "class_id"), number_or(F.lit(False), "tab_id"),
        F.col("ae").alias("ae_cost"), F.when(k % 19 != 0, F.col("te")).alias("te_cost"), F.lit(0).alias("required_tab_ae"), F.lit(0).alias("required_tab_te"), F.when(k % 23 == 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(k)).alias("required_ids"), F.array(k).alias("connected_node_ids"), "tags", F.col("schools").alias("damage_schools"), "resources",
        F.lit("s").alias("field_sources"), F.lit("i").alias("inferred"), F.lit("r").alias("raw"), F.when(k % 29 == 0, "elsewhere").when(k % 2 == 0, "trainer").alias("source_category"), F.when(k % 3 == 0, F.struct(F.when(k % 2 == 0, F.lit(1)).alias("effective_required_level"), F.lit("high").alias("level_confidence"))).alias("availability"),
    )
    classes = n.select(F.col("cls").alias("class_name")).distinct().unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("class_name"))).select(F.lit("v1").alias("schema_version"), "class_name", F.lit(1).alias("class_id"), F.array(F.lit(1)).alias("tabs"))
    return rules.catalogue_faults(entries, classes, "v1")


def catalogue_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the catalogue may be published, and why not."""
    return rules.catalogue_verdict(catalogue_faults(spark, sf_dir))


FAULTS_SQL = """SELECT * FROM (SELECT 'missing_schema_version' AS code, count(*) FILTER (p_partkey % 31 = 0 OR p_partkey % 37 = 0) AS n FROM part UNION ALL SELECT 'missing_class', count(*) FILTER (p_partkey % 20 = 0) FROM part UNION ALL SELECT 'unknown_essence_kind', count(*) FILTER (p_partkey % 11 = 0) FROM part UNION ALL SELECT 'invalid_essence_kind', count(*) FILTER (p_partkey % 13 = 0 AND p_partkey % 11 <> 0) FROM part
UNION ALL SELECT 'class_id_not_numeric', count(*) FILTER (p_partkey % 17 = 0) FROM part UNION ALL SELECT 'te_cost_not_numeric', count(*) FILTER (p_partkey % 19 = 0) FROM part UNION ALL SELECT 'required_ids_not_numbers', count(*) FILTER (p_partkey % 23 = 0) FROM part UNION ALL SELECT 'invalid_source_category', count(*) FILTER (p_partkey % 29 = 0) FROM part
UNION ALL SELECT 'level_not_numeric', count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 2 = 1) FROM part UNION ALL SELECT 'class_without_entries', (SELECT count(*) FROM region) + (SELECT count(DISTINCT p_brand) FROM part) - (SELECT count(DISTINCT p_brand) FROM part WHERE p_partkey % 20 <> 0)) WHERE n > 0"""


def rule_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_brand").alias("profile"), k.cast("string").alias("rule"), F.when(k % 5 == 0, "odd").otherwise("filler").alias("category"), F.when(k % 7 == 0, "sure").alias("confidence"), F.when(k % 6 == 0, "x").otherwise("10").alias("priority"), F.col("p_type").alias("template"), F.when(k % 4 == 0, F.create_map(F.lit("moon"), F.lit("x"))).otherwise(F.create_map(F.lit("tags_any"), F.lit("x"))).alias("match"))
    templates = p.filter("p_partkey % 3 <> 0").select(F.col("p_brand").alias("profile"), F.col("p_type").alias("template"))
    branches = table(spark, sf_dir, "nation").select(F.lit("Brand#1").alias("profile"), F.col("n_name").alias("encounter"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("aoe"), F.lit("moon"))).otherwise(F.array(F.lit("aoe"))).alias("categories"))
    encounters = table(spark, sf_dir, "nation").filter("n_nationkey > 3").select(F.lit("Brand#1").alias("profile"), F.col("n_name").alias("encounter"))
    return rules.rule_faults(r, templates, branches, encounters)


RULE_FAULTS_SQL = """SELECT p_brand AS profile, p_partkey::VARCHAR AS id, 'invalid_category' AS code FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'invalid_confidence' FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'priority_not_numeric' FROM part WHERE p_partkey % 6 = 0
UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'unsupported_operator' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_brand, p_partkey::VARCHAR, 'unknown_template' FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_brand = x.p_brand AND y.p_type = x.p_type AND y.p_partkey % 3 <> 0)
UNION ALL SELECT 'Brand#1', n_name, 'unsupported_encounter' FROM nation WHERE n_nationkey <= 3 UNION ALL SELECT 'Brand#1', n_name, 'unknown_branch_category' FROM nation WHERE n_nationkey % 2 = 0"""


def profile_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rule tables: some lack a field, are of another version or ask for an input of the future."""
    k = F.col("o_orderkey")
    fields = F.array_except(F.array(*[F.lit(f) for f in rules.PROFILE_FIELDS]), F.array(F.when(k % 5 == 0, "rules"), F.when(k % 7 == 0, "branches"), F.when(k % 11 == 0, "role")))
    profiles = table(spark, sf_dir, "orders").select(k.alias("profile"), fields.alias("fields"), F.when(k % 13 == 0, "v0").when(k % 17 != 0, "v1").alias("schema_version"), F.when(k % 3 == 0, F.array(F.lit("sim_state"), F.lit("log"), F.lit("combat_log_metrics"))).alias("required_inputs"))
    return rules.profile_faults(profiles, "v1")


def bound_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes with fields that a wrong column would give."""
    k = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(k.alias("node"), (k % 600).alias("ae_cost"), F.when(k % 3 == 0, -1).alias("te_cost"), (k % 25).alias("max_rank"), (k % 70).alias("required_level"), F.lit(None).cast("int").alias("row"))
    return rules.bound_faults(nodes, "node")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of an order's texts: the numbers among them, and the larger of two maps' values."""
    k = F.col("o_orderkey")
    m = F.create_map(F.lit("b"), k.cast("string"), F.lit("a"), F.when(k % 2 == 0, "x").otherwise("7"), F.lit("c"), F.lit(None).cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", shapes.number_map(m).alias("m"), shapes.largest_by_key(F.create_map(F.lit("x"), k), F.create_map(F.lit("x"), 1000 - k)).alias("g"))
    return o.select("o_orderkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.try_element_at("m", F.lit("b")).alias("b"), F.try_element_at("g", F.lit("x")).alias("x"), number(F.lit("5")).alias("five"))


QUERIES = {
    "json_sources": (json_sources, JSON_SQL),
    "document_sources": (document_sources, DOCUMENTS_SQL),
    "sinks": (sinks, SINKS_SQL),
    "session_documents": (session_documents, "SELECT user_id::VARCHAR AS player, event_type AS ability, 'damage' AS family, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS amount FROM events GROUP BY ALL"),
    "payload_shape": (payload_shape, "SELECT key, CASE json_type(props, '$.' || key) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'null' END AS kind, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL"),
    "payload_keys": (payload_keys, "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key"),
    "infer_mechanics": (infer_mechanics, MECHANICS_SQL),
    "infer_effects": (infer_effects, EFFECTS_SQL),
    "enrichment_rows": (enrichment_rows, f"WITH {ENRICH_SQL} SELECT * FROM r"),
    "enrichment_summary": (enrichment_summary, f"WITH {ENRICH_SQL} SELECT count(*) AS ids, count(*) FILTER (status = 'matched' AND NOT name_match) AS name_mismatches, count(tooltip_level) AS with_level, count(*) FILTER (status = 'matched') AS matched FROM r"),
    "three_sources": (three_sources, THREE_SQL),
    "tooltips": (tooltips, TOOLTIPS_SQL),
    "item_rows": (item_rows, ITEMS_SQL),
    "stat_totals": (stat_totals, STATS_SQL),
    "catalogue_faults": (catalogue_faults, FAULTS_SQL),
    "catalogue_verdict": (catalogue_verdict, f"SELECT CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS kinds, sum(n)::BIGINT AS faults, string_agg(code, ',' ORDER BY code) AS codes FROM ({FAULTS_SQL})"),
    "profile_faults": (
        profile_faults,
        """SELECT o_orderkey AS profile, 'rules' AS id, 'missing_field' AS code FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'branches', 'missing_field' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'role', 'missing_field' FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 'schema_version', 'invalid_schema_version' FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 UNION ALL SELECT o_orderkey, unnest(['combat_log_metrics', 'sim_state']), 'future_input_required' FROM orders WHERE o_orderkey % 3 = 0""",
    ),
    "bound_faults": (
        bound_faults,
        """SELECT p_partkey AS node, 'ae_cost_out_of_bounds' AS code FROM part WHERE p_partkey % 600 > 500 UNION ALL SELECT p_partkey, 'te_cost_out_of_bounds' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'max_rank_out_of_bounds' FROM part WHERE p_partkey % 25 > 20
UNION ALL SELECT p_partkey, 'required_level_out_of_domain' FROM part WHERE p_partkey % 70 > 60""",
    ),
    "rule_faults": (rule_faults, RULE_FAULTS_SQL),
    "numbers": (numbers, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'a,b' END AS keys, o_orderkey::DOUBLE AS b, greatest(o_orderkey, 1000 - o_orderkey) AS x, 5.0::DOUBLE AS five FROM orders"),
}
