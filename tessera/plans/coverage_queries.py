"""Queries of operators that no larger query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cube, diff, discover, reconcile, relational, report, rules, score, snapshots
from tessera.plans.catalogue_queries import MEMBERS_SQL, NODES_SQL, members, part_nodes
from tessera.plans.common import table
from tessera.plans.graph_queries import TABLES
from tessera.sources import writers


def scope_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each (class, tab) scope up to its level, with the shared tab's."""
    n = part_nodes(spark, sf_dir).select("cls", F.when(F.col("node") % 5 == 0, "Class").otherwise(F.col("tab")).alias("tab"), "level", "node")
    scopes = n.filter("tab <> 'Class'").select("cls", "tab").distinct().withColumns({"scope": F.concat_ws(":", "cls", "tab"), "level": F.lit(30)})
    return rules.in_scope(n, scopes, "Class")


SCOPE_SQL = """WITH n AS (SELECT p_brand AS cls, CASE WHEN p_partkey % 5 = 0 THEN 'Class' ELSE p_type END AS tab, p_size AS level, p_partkey AS node FROM part), s AS (SELECT DISTINCT cls, tab FROM n WHERE tab <> 'Class')
SELECT s.cls || ':' || s.tab AS scope, node FROM n JOIN s ON n.cls = s.cls AND (n.tab = s.tab OR n.tab = 'Class') WHERE level <= 30"""


def array_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the names of the parts in an array of ids."""
    ids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    return relational.by_array_key(ids, "ids", table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("l_orderkey", "p_partkey", "p_name")


def wide_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.claims_from(table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], "orders", "verified_builder", F.col("o_orderkey") % 3 != 0)


def field_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "high").when(F.col("p_partkey") % 3 == 1, "medium").alias("confidence"))
    return diff.field_status(f).groupBy("status").agg(F.count("*").alias("n"))


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tables with as many fields as their nation, against a policy by supplier."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("name")
    present = s.filter("s_suppkey % 4 <> 0").select(name, F.col("s_nationkey").alias("fields"))
    policy = s.filter("s_suppkey % 5 <> 0").select(name, (F.col("s_suppkey") % 2 == 0).alias("required"), F.when(F.col("s_suppkey") % 3 == 0, 99).otherwise(F.col("s_nationkey")).alias("fields"))
    return diff.drift(present, policy)


DRIFT_SQL = """SELECT 't' || s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'not_in_policy' WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 'required_missing' WHEN s_suppkey % 2 = 1 AND s_suppkey % 4 <> 0 THEN 'expected_absent' WHEN s_suppkey % 3 = 0 AND s_nationkey <> 99 THEN 'field_count_mismatch' ELSE 'ok' END AS finding FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey % 5 <> 0"""


def _order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_partkey").alias("a"), F.min("l_partkey").alias("b"), F.lit(0).cast("long").alias("c"))
    return discover.unpivot(wide, "id", ["a", "b", "c"])


def set_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the cells of an order are the ids that are known for it."""
    known = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_set("l_partkey").alias("ids"))
    return discover.set_agreement(_order_cells(spark, sf_dir), known.withColumn("field", F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd")))


AGREEMENT_SQL = """WITH l AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n, min(l_partkey) AS least FROM lineitem GROUP BY 1) SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS field, round(avg((n <= 2 AND least <> 0)::INT), 4)::DOUBLE AS agreement, count(*) AS rows FROM l GROUP BY 1"""


def translated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column that holds an order's largest part, known by name only."""
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("id"))
    known = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.max("l_partkey").alias("m")).select("row_id", F.lit("largest").alias("field"), F.concat(F.lit("part "), F.col("m").cast("string")).alias("name"))
    return discover.translated(_order_cells(spark, sf_dir), names, known).select("field", "col", "score", "confidence")


def proven_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("c0"), F.col("o_custkey").cast("long").alias("c1"))
    return discover.emit_proven(wide, {"order": ("c0", "high"), "customer": ("c1", "low")})


def merged_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = p.groupBy(F.col("p_type").alias("key")).agg(F.max("p_size").cast("double").alias("weight")).withColumn("kind", F.lit("tab"))
    changed = p.filter("p_size % 2 = 0").groupBy(F.col("p_type").alias("key")).agg(F.count("*").cast("double").alias("weight")).withColumn("kind", F.lit("tab"))
    return score.merge_weights(base, changed.unionByName(p.select(F.col("p_brand").alias("key"), F.lit(1.0).alias("weight"), F.lit("school").alias("kind")).distinct()))


MERGED_SQL = """WITH b AS (SELECT p_type AS key, max(p_size)::DOUBLE AS w FROM part GROUP BY 1), o AS (SELECT p_type AS key, count(*)::DOUBLE AS w FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT 'tab' AS kind, b.key, coalesce(o.w, b.w) AS weight FROM b LEFT JOIN o ON b.key = o.key UNION ALL SELECT DISTINCT 'school', p_brand, 1.0 FROM part"""


def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = members(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("node") == F.col("p_partkey")).groupBy("build").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("names"))
    return named.select("build", score.contains_all(F.col("names"), ["Red", "small"]).alias("both"))


def build_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per build and tab its nodes with their scores, best first."""
    m = members(spark, sf_dir).join(part_nodes(spark, sf_dir).select("node", "tab"), "node")
    scores = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("score"))
    return report.explain(m, scores)


EXPLAIN_SQL = f"""WITH {NODES_SQL}, {MEMBERS_SQL}, x AS (SELECT build, tab, node, CASE WHEN node % 3 <> 0 THEN level ELSE 0 END::DOUBLE AS s FROM mb JOIN pn USING (node))
SELECT build, tab, string_agg(node || ':' || printf('%.2f', s), ',' ORDER BY s DESC, node) AS nodes FROM x GROUP BY ALL"""


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = members(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("node") == F.col("p_partkey")).select("build", F.lit("tab").alias("kind"), F.col("p_type").alias("key"), F.col("p_size").cast("double").alias("value"))
    return score.breakdown(parts)


BREAKDOWN_SQL = f"""WITH {MEMBERS_SQL}, s AS (SELECT build, 'tab:' || p_type || '=' || printf('%.2f', sum(p_size)::DOUBLE) AS e FROM mb JOIN part ON node = p_partkey GROUP BY build, p_type) SELECT build, string_agg(e, ';' ORDER BY e) AS breakdown FROM s GROUP BY build"""


def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rules.fill_template(F.when(F.col("p_size") % 2 == 0, "{resource}>={threshold}").otherwise("buff.{name}.down"), {"resource": F.lit("rage"), "threshold": F.col("p_size"), "name": F.lower("p_brand")}).alias("condition"))


def indexed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' prices as tables of all four index forms: coordinates, and what is padding."""
    flat = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.round("p_retailprice", 2).alias("value"))
    classes = table(spark, sf_dir, "nation").filter("n_nationkey BETWEEN 1 AND 9").select(F.col("n_nationkey").alias("cls"))
    out = None
    for form in cube.FORMS:
        placed, totals = cube.indexed(flat, form, classes, level_stride=10, rating_stride=12, levels=10, ratings=8)
        one = placed.agg(F.count("*").alias("emitted"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total")).crossJoin(totals.select("padding")).withColumn("form", F.lit(form))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


INDEXED_SQL = """WITH p AS (SELECT p_partkey AS o, round(p_retailprice, 2)::DECIMAL(18,2) AS v FROM part), f AS (
  SELECT 'rating_by_level' AS form, o, v, o < 80 AS k FROM p UNION ALL SELECT 'class_rating_scalar', o, v, o BETWEEN 1 AND 108 AND (o - 1) % 12 < 8 FROM p UNION ALL SELECT 'class_by_level', o, v, o // 10 BETWEEN 0 AND 8 FROM p UNION ALL SELECT 'class_only', o, v, o BETWEEN 0 AND 8 FROM p)
SELECT form, count(*) FILTER (k) AS emitted, round(sum(v) FILTER (k)::DOUBLE, 2) AS total, count(*) FILTER (NOT k) AS padding FROM f GROUP BY form"""


def roster_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations against a stated roster, and codes without a name."""
    s = table(spark, sf_dir, "supplier")
    drift = cube.roster_drift(s, list(range(3, 30)), "s_nationkey").select(F.col("s_nationkey").alias("id"), "finding", F.lit(1).cast("long").alias("n"))
    codes = cube.unmapped(s.withColumn("code", F.col("s_nationkey") % 5), "code", {0: "mana", 1: "rage", 3: "energy"})
    return drift.unionByName(codes.select(F.col("code").alias("id"), F.lit("unmapped").alias("finding"), "n"))


ROSTER_SQL = """SELECT i AS id, 'missing' AS finding, 1 AS n FROM range(3, 30) t(i) WHERE i NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT DISTINCT s_nationkey, 'unexpected', 1 FROM supplier WHERE s_nationkey NOT BETWEEN 3 AND 29 UNION ALL SELECT s_nationkey % 5, 'unmapped', count(*) FROM supplier WHERE s_nationkey % 5 IN (2, 4) GROUP BY 1"""


def value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the reasons why fields of theirs were not decoded."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.create_map(F.lit("school"), F.when(k % 7 == 0, "value_out_of_domain").when(k % 3 == 0, "absent"), F.lit("power"), F.when(k % 11 == 0, "value_out_of_domain")).alias("reasons"))
    return writers.value_gate(rows)


def band_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers by bands of their ids: how many are of the middle one, and which are of none."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"))
    return reconcile.band_cardinality(ids, [(0, 4, "low"), (5, 14, "middle"), (20, 99, "high")], "middle", 10)


def sized_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and bytes of every table's files."""
    rows = snapshots.manifest({n: table(spark, sf_dir, n) for n in TABLES}, "g1", paths={n: f"{sf_dir}/{n}.parquet" for n in TABLES})
    return rows.select("name", "records", (F.col("bytes") > 0).alias("sized"), (F.length("content_hash") > 0).alias("hashed"))


MANIFEST_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS records, true AS sized, true AS hashed FROM {n}" for n in TABLES)


QUERIES = {
    "scope_nodes": (scope_nodes, SCOPE_SQL),
    "array_key_join": (array_key_join, "SELECT DISTINCT l_orderkey, p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "wide_claims": (wide_claims, "SELECT o_orderkey AS key, 'o_orderstatus' AS field, 'orders' AS source, 'verified_builder' AS tier, o_orderstatus AS value, o_orderkey % 3 <> 0 AS eligible FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', 'orders', 'verified_builder', o_orderpriority, o_orderkey % 3 <> 0 FROM orders"),
    "field_readiness": (field_readiness, "SELECT CASE p_partkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'low' ELSE 'unresolved' END AS status, count(*) AS n FROM part GROUP BY 1"),
    "schema_drift": (schema_drift, DRIFT_SQL),
    "set_agreement": (set_agreement, AGREEMENT_SQL),
    "translated_fields": (translated_fields, "SELECT 'largest' AS field, 0 AS col, 1.0::DOUBLE AS score, 'high' AS confidence FROM lineitem LIMIT 1"),
    "proven_columns": (proven_columns, "SELECT o_orderkey AS \"order\", NULL::BIGINT AS customer FROM orders"),
    "merged_weights": (merged_weights, MERGED_SQL),
    "contained_names": (contained_names, f"WITH {MEMBERS_SQL}, n AS (SELECT build, string_agg(lower(p_name), chr(10) ORDER BY p_name) AS s FROM mb JOIN part ON node = p_partkey GROUP BY build) SELECT build, contains(s, 'red') AND contains(s, 'small') AS \"both\" FROM n"),
    "build_explanations": (build_explanations, EXPLAIN_SQL),
    "score_breakdown": (score_breakdown, BREAKDOWN_SQL),
    "filled_templates": (filled_templates, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'rage>=' || p_size ELSE 'buff.' || lower(p_brand) || '.down' END AS condition FROM part"),
    "indexed_tables": (indexed_tables, INDEXED_SQL),
    "roster_drift": (roster_drift, ROSTER_SQL),
    "sized_manifest": (sized_manifest, MANIFEST_SQL),
    "value_gate": (value_gate, "SELECT count(*) FILTER (p_partkey % 7 = 0 OR p_partkey % 11 = 0) AS records_with_withheld_value, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 11 <> 0) AS records_all_in_domain FROM part"),
    "band_cardinality": (band_cardinality, "WITH i AS (SELECT DISTINCT s_nationkey AS i FROM supplier) SELECT count(*) FILTER (i BETWEEN 5 AND 14) AS n, count(*) FILTER (i BETWEEN 5 AND 14) = 10 AS as_expected, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (i BETWEEN 15 AND 19 OR i > 99), '') AS unknown_ids FROM i"),
}
