"""Text, coercion and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl
from tessera.operators import diff, reconcile, relational as rel
from tessera.plans.common import table

joined = lambda c: F.array_join(c, ",")


def _sql_tags(rules: dict) -> str:
    """The same rules for the oracle, whose word boundary is ASCII."""
    tests = []
    for name, patterns in rules.items():
        some = patterns if isinstance(patterns, list) else [patterns]
        test = " AND ".join(f"regexp_matches(t, '(?i){p}')" for p in some)
        tests.append(f"CASE WHEN {test} THEN '{name}' END")
    return f"array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), ',')"


def text_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return table(spark, sf_dir, "documents").select("doc_id", tx.folded(F.col("text")).alias("t")).select(
        "doc_id", joined(tx.detect(t, tx.TAG_RULES, True)).alias("tags"), joined(tx.detect(t, tx.SCHOOL_RULES, True)).alias("schools"), joined(tx.detect(t, tx.RESOURCE_RULES, True)).alias("resources"), joined(tx.detect_all(t, tx.MECHANIC_RULES, True)).alias("mechanics")
    )


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tooltip-like texts with the amounts of the line items."""
    q, p = F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")
    text = F.concat(
        F.lit("Requires Level "), p, F.lit(". Costs "), q, F.lit(" Rage. Deals fire damage every "), F.col("l_linenumber").cast("string"), F.lit(" sec for "), q, F.lit(" min, "), q, F.lit(" yd range, "),
        F.when(F.col("l_linenumber") > 3, F.concat(q, F.lit(".5 sec cast"))).otherwise("Instant"), F.lit(", "), p, F.lit(" sec cooldown. +"), q, F.lit(" Haste and +"), p, F.lit(" Attack Power on a one-hand sword or plate chest"),
    )
    # The text is made of the three columns, so these alone are told apart.
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_quantity").distinct().withColumn("t", text)


DESCRIBED_SQL = """d AS (
  SELECT DISTINCT l_partkey, l_linenumber, l_quantity,
         'Requires Level ' || l_partkey || '. Costs ' || l_quantity::INT || ' Rage. Deals fire damage every ' || l_linenumber || ' sec for ' || l_quantity::INT || ' min, ' || l_quantity::INT || ' yd range, '
         || CASE WHEN l_linenumber > 3 THEN l_quantity::INT || '.5 sec cast' ELSE 'Instant' END || ', ' || l_partkey || ' sec cooldown. +' || l_quantity::INT || ' Haste and +' || l_partkey || ' Attack Power on a one-hand sword or plate chest' AS t
  FROM lineitem)"""


def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    stats, cost = F.col("stats"), F.col("costs")
    return _described(spark, sf_dir).withColumns({"stats": tx.stats(t), "costs": F.get(tx.power_costs(t), 0)}).select(
        "l_partkey", "l_linenumber", "l_quantity", tx.level(t).alias("level"), tx.required_level(t).alias("required_level"), tx.cooldown_ms(t).alias("cooldown_ms"), tx.cast_time_ms(t).alias("cast_time_ms"), tx.duration_ms(t).alias("duration_ms"),
        tx.period_ms(t).alias("period_ms"), tx.range_yards(t).alias("range_yards"), cost["amount"].alias("cost"), cost["resource"].alias("resource"), stats["haste"].alias("haste"), stats["attack_power"].alias("attack_power"), tx.item_kind(t)["item_subclass"].alias("item_subclass"),
    )


def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(h).alias("plain"), F.size(tx.linked_ids(h, "page")).alias("linked"))


def label_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select(labels.alias("label")).filter("label <> ''").distinct()


def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id", vl.number(k).alias("k"), vl.integer_or(F.col("event_type"), -1).alias("bad"), vl.first_path(F.col("props"), "$.missing", "$.k").alias("first"), joined(F.transform(vl.clean_ids(F.array(k, F.lit("0"), F.lit("x"))), lambda x: x.cast("string"))).alias("ids"),
        joined(F.transform(vl.slot_ids(F.col("user_id"), F.lit(0).cast("long"), F.col("event_id"), F.col("user_id")), lambda x: x.cast("string"))).alias("slots"),
    )


def part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tab = F.when(F.col("p_size") % 5 == 0, "Class").when(F.col("p_size") % 7 == 0, "None").otherwise(F.col("p_brand"))
    category = vl.source_category(tab)
    return p.select(
        "p_partkey", tx.slug(F.col("p_name")).alias("key"), tx.canonical_label(F.col("p_name")).alias("label"), tx.icon_token(F.concat(F.lit("Icons\\Big/"), "p_name", F.lit(".PNG"))).alias("icon"),
        vl.essence_kind(F.col("p_type"), F.col("p_size") % 3, F.col("p_size") % 2).alias("kind"), category["category"].alias("category"), category["confidence"].alias("confidence"),
    )


def availability_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    stated, db = F.when(F.col("p_size") % 3 == 0, F.col("p_size")).otherwise(0), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1)
    text = tx.level(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("Level "), F.col("p_size").cast("string"))))
    ladder = p.select("p_partkey", "p_size", vl.availability(stated, db, text).alias("a"))
    return ladder.select("p_partkey", "a.effective_required_level", "a.level_source", "a.level_confidence", joined(F.col("a.notes")).alias("notes"), vl.effective_level(F.col("a"), F.lit(-1)).alias("effective"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_partkey")
    power = vl.code_name(F.col("l_linenumber") - 1)
    gate = vl.gated(F.col("l_linenumber"), F.col("l_linenumber").between(1, 5))
    level = lambda c: F.when(c % 3 == 0, "low").when(c % 3 == 1, "medium").otherwise("high")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey").distinct().select(
        "l_partkey", "l_linenumber", "l_suppkey", joined(vl.mask_names(m)).alias("schools"), vl.unknown_bits(m).alias("unknown"), power["name"].alias("power"), power["unknown"].alias("power_unknown"), gate["decoded"].alias("decoded"), gate["reason"].alias("reason"),
        vl.weakest(level(F.col("l_partkey")), level(F.col("l_suppkey"))).alias("proof"),
    )


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.counts(table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_size") > 3, F.col("p_type"))), "p_brand", "p_type")


def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes: kinds, three histograms, and tabs with their entries."""
    k = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("cls"), (F.col("p_size") % 3).alias("tab_id"), F.col("p_type").alias("tab"), F.when(k % 5 == 0, "unknown").when(k % 2 == 0, "ability").otherwise("talent").alias("kind"), k.alias("entry"), F.col("p_name").alias("name"),
        F.array(F.when(k % 3 == 0, "mana").when(k % 3 == 1, "rage")).alias("resources"), F.array(F.lower("p_type")).alias("schools"), F.split("p_name", " ").alias("tags"),
    )
    classes = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cls")).distinct().unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("cls")))
    lists = [F.coalesce(F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["value"], e["n"].cast("string"))), ","), F.lit("")).alias(c) for c in ("resources", "schools", "tags")]
    line = F.transform("tabs", lambda t: F.concat_ws(":", t["tab_id"].cast("string"), t["tab"], t["ability_count"].cast("string"), t["talent_count"].cast("string"), F.array_join(F.transform(t["entries"], lambda e: e["entry"].cast("string")), "+")))
    return rel.class_profile(entries, classes).select("cls", "ability", "talent", *lists, F.coalesce(F.array_join(line, ","), F.lit("")).alias("tabs"))


def layer_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a part as layers, loaded in the order of their orders, declared by their line numbers: which came too late."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_linenumber").alias("rank"))
    return rel.order_inversions(line, ["l_partkey"], F.col("rank"), F.col("l_orderkey"))


def kind_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rel.sampled_counts(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 5, "p_partkey")
    return out.select("p_brand", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


def topk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_k(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 12).select("p_brand", "place", "p_partkey", rel.rank_buckets(F.col("place")).alias("bucket"))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.trim(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_type") == "PROMO", [F.col("p_size"), F.col("p_partkey")], 12).select("p_brand", "place", "p_partkey")


def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    first = rel.first_by(o, ["o_custkey", "o_orderstatus"], ["o_orderkey"]).withColumn("rule", F.lit("first"))
    last = rel.last_by(o, ["o_custkey", "o_orderstatus"], ["o_orderkey"]).withColumn("rule", F.lit("last"))
    return first.unionByName(last)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines (semi), and orders without (anti)."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return o.join(line, "o_orderkey", "left_semi").select("o_orderkey", F.lit("covered").alias("state")).unionByName(o.join(line, "o_orderkey", "left_anti").select("o_orderkey", F.lit("gap").alias("state")))


def name_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"))
    wanted = nodes.select(F.upper("name").alias("requested")).union(nodes.select(F.concat("name", F.lit("?")).alias("requested"))).distinct()
    return rel.name_selection(wanted, nodes)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.max("o_orderkey").alias("k"))
    return rel.upsert(o.filter("y < 1997").groupBy("o_custkey").agg(F.max("k").alias("k")), o.filter("y >= 1997").groupBy("o_custkey").agg(F.min("k").alias("k")), ["o_custkey"])


def layered_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_orderkey").alias("v")).withColumn("layer", F.concat(F.lit("patch"), F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", "-3").otherwise("-x")))
    return rel.overlay(line.drop("l_returnflag"), ["l_partkey"], "layer", vl.layer_key(F.col("layer")))


def claims_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(_claims(spark, sf_dir)).drop("source")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_returnflag") == "A", reconcile.TIERS[0]).when(F.col("l_returnflag") == "N", reconcile.TIERS[2]).otherwise(reconcile.TIERS[3])
    return line.select(
        F.col("l_partkey").alias("key"), F.when(F.col("l_linestatus") == "F", "discount").otherwise("tax").alias("field"), F.lit("lines").alias("source"), tier.alias("tier"), F.floor(F.col("l_discount") * 20).cast("string").alias("value"), (F.col("l_quantity") > 40).alias("eligible"), F.col("l_orderkey").alias("ordinal")
    )


def claim_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.winner_counts(reconcile.reconcile(_claims(spark, sf_dir)))


def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.audit(reconcile.reconcile(_claims(spark, sf_dir)))


def claim_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.record_confidence(reconcile.reconcile(_claims(spark, sf_dir)), ["discount"], ["tax"])


def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    grouped = p.groupBy("p_size", "p_type").agg(F.sort_array(F.collect_list(F.upper("p_name"))).alias("builder_names"), F.min("p_name").alias("db_name"), F.max(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("client_name"))
    return reconcile.identity_gate(grouped, tx.slug).select("p_size", "p_type", "reference", "excluded_reason")


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumns({"tags": F.split("p_name", " "), "text": F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")})
    return reconcile.merge_rows(p, "p_brand", "tags", "text", "p_partkey").select("p_brand", joined(F.col("tags")).alias("tags"), "text")


def resolved_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.resolve_order(table(spark, sf_dir, "part"), "p_brand", "p_type", ("PROMO", "SMALL", "LARGE"))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("group"), F.col("l_returnflag").alias("kind"))
    return reconcile.attribute(line, {"A": "own", "R": "shared"}, "own")


def attribution_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_type", "p_name").alias("group"))
    return reconcile.attribute_derived(p, p.filter("id % 10 = 3").select("id"))


def attribution_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "part").select("p_partkey", reconcile.id_band(F.col("p_partkey"), [(0, 99, "low"), (100, 999, "middle")]).alias("band"))
    some = attribution(spark, sf_dir).filter("id % 2 = 0")
    return reconcile.fill_attribution(facts, some.select("id", "modes", "is_own", "confidence"), "p_partkey")


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "orders").filter("o_orderkey % 11 <> 0").select("o_orderkey", F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") % 5).alias("b"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_suppkey").alias("a"), (F.count("*") % 5).alias("b"))
    return left, right


def catalogue_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.coverage(rel.crosswalk(*_rebuilt(spark, sf_dir), "o_orderkey"))


def field_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.scalar_differences(*_rebuilt(spark, sf_dir), "o_orderkey", ["a", "b"])


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the nodes of two catalogues that differ in every way there is."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    cost = lambda bad: F.when(bad, F.lit(99)).otherwise(F.col("p_size")).cast("long")
    label = F.when(k % 89 == 0, "Other").when(k % 5 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    client = p.filter("p_partkey % 17 <> 0").select(k.alias("node"), (k * 10).alias("spell"), F.col("p_brand").alias("cls"), F.when(k % 3 == 0, F.array(k + 1, k + 2)).alias("connected"), F.array(k - 1).alias("required"), F.create_map(F.lit("ae"), F.col("p_size").cast("long"), F.lit("extra"), F.lit(1).cast("long")).alias("values"))
    builder = p.filter("p_partkey % 19 <> 0").select(k.alias("node"), (k * 10 + (k % 97 == 0).cast("int")).alias("spell"), label.alias("cls"), F.when(k % 101 == 0, F.array(k)).otherwise(F.array(k + 2, k + 1, k + 1)).alias("connected"), F.array(k - 1).alias("required"), F.create_map(F.lit("ae"), cost(k % 23 == 0)).alias("values"))
    verdicts = p.select(k.alias("node"), F.when(k % 3 == 0, "verified_client_current").when(k % 3 == 1, "odd").otherwise("extraction_defect").alias("classification"))
    n = F.col("n_nationkey")
    fields = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("field"), F.when(n < 2, "adjacency").when(n < 20, "legality").otherwise("layout").alias("part"), F.when(n % 7 == 3, "medium").when(n % 7 != 5, "high").alias("confidence"))
    return diff.readiness(client, builder, verdicts, fields, tx.canonical_label, ("playable_class_count",), 100)


def set_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    sets = line.groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber").cast("long"))).alias("left"), F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("long"))).alias("right"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    relation = rel.set_relation(F.col("left"), F.col("right"))
    return diff.set_differences(sets).select("key", text(F.col("left")).alias("left"), text(F.col("right")).alias("right"), relation.alias("relation"))


def label_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("left_id"), F.when(k % 7 == 0, k + 1).otherwise(k).alias("right_id"), F.col("p_name").alias("left"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("right"))
    return diff.identity_differences(p, tx.canonical_label)


def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    left = orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    said = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 5 < 3, "verified_client_current").otherwise("extraction_defect")
    return diff.adjudicate(left, orders.filter("o_orderkey % 3 = 0").select("o_orderkey", said.alias("classification")), "o_orderkey")


def tab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.tab_coverage(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")


def side_join_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    side = table(spark, sf_dir, "part").filter("p_partkey % 4 <> 1")
    return rel.side_status(facts, "l_partkey", side, "p_partkey", "p_name", F.col("l_linenumber") > 2)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join by id into a struct, with the owner of a two-column key."""
    o = rel.enrich(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0"), "c_custkey", "c")
    owners = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 5).alias("m")).agg(F.min("s_name").alias("owner"))
    return rel.with_owner(o.select("o_orderkey", F.col("c.c_name").alias("name"), F.col("c.c_nationkey").alias("n"), (F.col("o_orderkey") % 5).alias("m")), owners, ["n", "m"])


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override by nation and segment, else by segment, else a default; and specific or generic profiles."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    exact = c.filter("c_nationkey < 5").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").cast("string").alias("v"))
    loose = c.filter("c_mktsegment <> 'MACHINERY'").groupBy("c_mktsegment").agg(F.max("c_custkey").cast("string").alias("v")).withColumn("c_nationkey", F.lit(None).cast("int"))
    out = rel.with_override(c, exact.unionByName(loose), ["c_nationkey", "c_mktsegment"], ["c_mktsegment"], "v", F.lit("default"))
    profiles = c.filter("c_custkey % 7 = 0").select("c_custkey", F.lit("own").alias("profile"))
    generic = c.filter("c_mktsegment LIKE 'B%'").select("c_mktsegment").distinct().withColumn("profile", F.lit("generic"))
    return rel.with_profile(out, profiles, generic, "c_custkey", "c_mktsegment", "profile").select("c_custkey", "v", "profile", "warning")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.snapshots import freshness as split

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("matched").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("verified_at"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("fetched_at"))
    return rel.counts(split(o.withColumn("cached_at", F.lit(None).cast("timestamp_ntz")), 400, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")), "state", "status")


REBUILT = """l AS (SELECT o_orderkey, o_custkey::BIGINT AS a, o_orderkey % 5 AS b FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT l_orderkey AS o_orderkey, max(l_suppkey) AS a, count(*) % 5 AS b FROM lineitem GROUP BY 1)"""
COVER = f"""WITH {REBUILT}, x AS (
  SELECT count(*) FILTER (l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL) AS matched, count(*) FILTER (r.o_orderkey IS NULL) AS left_only, count(*) FILTER (l.o_orderkey IS NULL) AS right_only
  FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey)"""
CLAIMS = """c AS (
  SELECT l_partkey AS key, CASE WHEN l_linestatus = 'F' THEN 'discount' ELSE 'tax' END AS field,
         CASE l_returnflag WHEN 'A' THEN 'authoritative_client' WHEN 'N' THEN 'external_db' ELSE 'inferred' END AS tier,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 4 END AS rank,
         CASE WHEN l_quantity > 40 THEN floor(l_discount * 20)::BIGINT::VARCHAR END AS v
  FROM lineitem),
t AS (SELECT key, field, tier, rank, min(v) AS lo, max(v) AS hi, count(*) AS n FROM c GROUP BY ALL),
s AS (
  SELECT key, field, min(rank) FILTER (lo = hi) AS win, sum(n)::BIGINT AS candidates, coalesce(bool_or(lo <> hi), false) AS had_conflict FROM t GROUP BY ALL),
w AS (
  SELECT s.key, s.field, t.lo AS value, t.tier,
         CASE WHEN win IS NULL AND had_conflict THEN 'omitted_unresolved_conflict' WHEN win IS NULL THEN 'omitted_no_eligible_candidate' WHEN win = 3 THEN 'db_fallback' WHEN win = 4 THEN 'inferred_last_resort'
              WHEN candidates = 1 THEN 'only_candidate' ELSE 'highest_precedence_eligible' END AS reason, candidates, had_conflict
  FROM s LEFT JOIN t ON s.key = t.key AND s.field = t.field AND s.win = t.rank)"""
SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
HTML = "html"
for _old, _new in (("'(?i)<br\\s*/?>'", " "), ("'<[^>]+>'", " ")):
    HTML = f"regexp_replace({HTML}, {_old}, '{_new}', 'g')"
for _e, _p in tx.ENTITIES:
    HTML = f"replace({HTML}, '{_e}', '{_p.replace(chr(39), chr(39) * 2)}')"
HTML = rf"trim(regexp_replace({HTML}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"

QUERIES = {
    "text_tags": (text_tags, f"SELECT doc_id, {_sql_tags(tx.TAG_RULES)} AS tags, {_sql_tags(tx.SCHOOL_RULES)} AS schools, {_sql_tags(tx.RESOURCE_RULES)} AS resources, {_sql_tags(dict(sorted(tx.MECHANIC_RULES.items())))} AS mechanics FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"),
    "text_extract": (
        text_extract,
        rf"""WITH {DESCRIBED_SQL}
SELECT l_partkey, l_linenumber, l_quantity, regexp_extract(t, '(?i)\bLevel\s+(\d+)\b', 1)::INT AS level, l_partkey::INT AS required_level, l_partkey * 1000 AS cooldown_ms,
       CASE WHEN l_linenumber > 3 THEN (l_quantity::INT * 1000 + 500)::BIGINT ELSE 0 END AS cast_time_ms, l_quantity::BIGINT * 60000 AS duration_ms, l_linenumber::BIGINT * 1000 AS period_ms,
       regexp_extract(t, '(\d+) yd range', 1)::DOUBLE AS range_yards, l_quantity AS cost, 'Rage' AS resource, l_quantity AS haste, l_partkey::DOUBLE AS attack_power, 'sword' AS item_subclass FROM d""",
    ),
    "html_texts": (
        html_texts,
        rf"""SELECT page_id, {HTML} AS plain,
       len(list_distinct(regexp_extract_all(html, 'href=["'']\?page=(\d+)["'']', 1)))::INT AS linked FROM pages""",
    ),
    "label_distinct": (label_distinct, """SELECT DISTINCT label FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS label FROM pages) WHERE label <> ''"""),
    "coercions": (
        coercions,
        """SELECT event_id, try_cast(k AS DOUBLE) AS k, -1 AS bad, k AS first, CASE WHEN k IS NULL OR k = '0' THEN '' ELSE k END AS ids,
       array_to_string(list_sort(list_distinct(list_filter([user_id, event_id], lambda x: x <> 0))), ',') AS slots
FROM (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events)""",
    ),
    "part_kinds": (
        part_kinds,
        f"""WITH p AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'Class' WHEN p_size % 7 = 0 THEN 'None' ELSE p_brand END AS tab FROM part)
SELECT p_partkey, {SLUG.format("p_name")} AS key, lower(replace(p_name, ' ', '')) AS label, {SLUG.format("p_name")} AS icon,
       CASE WHEN p_size % 3 > 0 AND p_size % 2 <= 0 THEN 'ability' WHEN p_size % 2 > 0 AND p_size % 3 <= 0 THEN 'talent' ELSE 'unknown' END AS kind,
       CASE tab WHEN 'Class' THEN 'class_pool' WHEN 'None' THEN 'metadata_only' ELSE 'spec_tree' END AS category, CASE tab WHEN 'None' THEN 'medium' ELSE 'high' END AS confidence FROM p""",
    ),
    "availability_ladder": (
        availability_ladder,
        """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS s, CASE WHEN p_size % 2 = 0 THEN p_size + 1 END AS d, CASE WHEN p_size % 5 = 0 THEN p_size END AS t FROM part),
q AS (SELECT *, CASE WHEN s > 0 THEN s WHEN d IS NOT NULL THEN d WHEN t IS NOT NULL THEN t ELSE s END AS e,
       CASE WHEN s > 0 THEN 'high' WHEN d IS NOT NULL OR t IS NOT NULL THEN 'medium' ELSE 'low' END AS c FROM p)
SELECT p_partkey, e AS effective_required_level, CASE WHEN s > 0 THEN 'builder_required_level' WHEN d IS NOT NULL THEN 'db_tooltip' WHEN t IS NOT NULL THEN 'builder_tooltip' ELSE 'builder_required_level_zero_or_unknown' END AS level_source,
       c AS level_confidence, CASE WHEN s > 0 AND d <> s THEN 'db_tooltip_level_conflicts_with_builder_required_level' WHEN s > 0 THEN '' WHEN d IS NOT NULL OR t IS NOT NULL THEN 'builder_required_level_zero_but_tooltip_has_level' ELSE 'required_level_zero_means_available_or_unknown' END AS notes,
       CASE WHEN c = 'low' THEN -1 ELSE e END AS effective FROM q""",
    ),
    "masks": (
        masks,
        """SELECT l_partkey, l_linenumber, l_suppkey, array_to_string(list_filter(list_transform([(1, 'physical'), (2, 'holy'), (4, 'fire'), (8, 'nature'), (16, 'frost'), (32, 'shadow'), (64, 'arcane')], lambda b: CASE WHEN l_partkey & b[1] <> 0 THEN b[2] END), lambda x: x IS NOT NULL), ',') AS schools,
       (l_partkey >> 7) << 7 AS unknown, ['mana', 'rage', 'focus', 'energy', 'happiness', 'runes', 'runic_power'][l_linenumber] AS power, false AS power_unknown,
       CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS decoded, CASE WHEN l_linenumber > 5 THEN 'value_out_of_domain' END AS reason, ['low', 'medium', 'high'][least(l_partkey % 3, l_suppkey % 3) + 1] AS proof
FROM (SELECT DISTINCT l_partkey, l_linenumber, l_suppkey FROM lineitem)""",
    ),
    "tag_histogram": (tag_histogram, "SELECT p_brand, CASE WHEN p_size > 3 THEN p_type ELSE 'unknown' END AS p_type, count(*) AS n FROM part GROUP BY ALL"),
    "class_profile": (
        class_profile,
        """WITH e AS (SELECT p_brand AS cls, p_size % 3 AS tab_id, p_type AS tab, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 2 = 0 THEN 'ability' ELSE 'talent' END AS kind, p_partkey AS entry, CASE p_partkey % 3 WHEN 0 THEN 'mana' WHEN 1 THEN 'rage' END AS res, lower(p_type) AS school, string_split(p_name, ' ') AS tags FROM part),
c AS (SELECT DISTINCT cls FROM e UNION ALL SELECT r_name FROM region), k AS (SELECT cls, count(*) FILTER (kind = 'ability') AS ability, count(*) FILTER (kind = 'talent') AS talent FROM e GROUP BY cls),
r AS (SELECT cls, string_agg(v || '=' || n, ',' ORDER BY n DESC, v) AS s FROM (SELECT cls, res AS v, count(*) AS n FROM e WHERE res IS NOT NULL GROUP BY ALL) GROUP BY cls), s AS (SELECT cls, string_agg(v || '=' || n, ',' ORDER BY n DESC, v) AS s FROM (SELECT cls, school AS v, count(*) AS n FROM e GROUP BY ALL) GROUP BY cls),
g AS (SELECT cls, string_agg(v || '=' || n, ',' ORDER BY n DESC, v) AS s FROM (SELECT cls, v, count(*) AS n FROM (SELECT cls, unnest(tags) AS v FROM e) GROUP BY ALL) GROUP BY cls),
t AS (SELECT cls, string_agg(concat_ws(':', tab_id, tab, a, b, l), ',' ORDER BY tab_id, tab) AS s FROM (SELECT cls, tab_id, tab, count(*) FILTER (kind = 'ability') AS a, count(*) FILTER (kind = 'talent') AS b, string_agg(entry::VARCHAR, '+' ORDER BY entry) AS l FROM e GROUP BY ALL) GROUP BY cls)
SELECT c.cls, coalesce(ability, 0) AS ability, coalesce(talent, 0) AS talent, coalesce(r.s, '') AS resources, coalesce(s.s, '') AS schools, coalesce(g.s, '') AS tags, coalesce(t.s, '') AS tabs FROM c LEFT JOIN k ON k.cls = c.cls LEFT JOIN r ON r.cls = c.cls LEFT JOIN s ON s.cls = c.cls LEFT JOIN g ON g.cls = c.cls LEFT JOIN t ON t.cls = c.cls""",
    ),
    "layer_inversions": (layer_inversions, "WITH l AS (SELECT l_partkey, l_orderkey, max(l_linenumber) AS rank FROM lineitem GROUP BY ALL), w AS (SELECT *, max(rank) OVER (PARTITION BY l_partkey ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS outranked_by FROM l) SELECT * FROM w WHERE rank < outranked_by"),
    "kind_rollup": (kind_rollup, "SELECT p_brand, p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY ROLLUP (p_brand, p_type)"),
    "sample_counts": (sample_counts, "SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(p_partkey))[1:5], ',') AS samples FROM part GROUP BY p_brand"),
    "topk_items": (topk_items, "SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place, p_partkey, CASE WHEN place <= 3 THEN 'primary' WHEN place <= 7 THEN 'secondary' ELSE 'situational' END AS bucket FROM part QUALIFY place <= 12"),
    "trimmed": (trimmed, "SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY (p_type = 'PROMO') DESC, p_size, p_partkey) AS place, p_partkey FROM part QUALIFY place <= 12"),
    "dedupe_rows": (dedupe_rows, "SELECT o_custkey, min(o_orderkey) AS o_orderkey, o_orderstatus, 'first' AS rule FROM orders GROUP BY ALL UNION ALL SELECT o_custkey, max(o_orderkey), o_orderstatus, 'last' FROM orders GROUP BY ALL"),
    "duplicate_keys": (duplicate_keys, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "coverage_gaps": (coverage_gaps, "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'covered' ELSE 'gap' END AS state FROM orders"),
    "name_selection": (name_selection, "WITH k AS (SELECT lower(p_name) AS k, min(p_partkey) AS node_id FROM part GROUP BY 1), w AS (SELECT DISTINCT upper(p_name) AS requested FROM part UNION SELECT p_name || '?' FROM part) SELECT requested, node_id, node_id IS NOT NULL AS found FROM w LEFT JOIN k ON lower(requested) = k"),
    "upsert_latest": (
        upsert_latest,
        """WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT coalesce(n.o_custkey, p.o_custkey) AS o_custkey, coalesce(n.k, p.k) AS k FROM (SELECT o_custkey, max(k) AS k FROM o WHERE y < 1997 GROUP BY 1) p FULL JOIN (SELECT o_custkey, min(k) AS k FROM o WHERE y >= 1997 GROUP BY 1) n ON n.o_custkey = p.o_custkey""",
    ),
    "layered_overlay": (
        layered_overlay,
        """WITH l AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'patch' WHEN 'N' THEN 'patch-3' ELSE 'patch-x' END AS layer, max(l_orderkey) AS v FROM lineitem GROUP BY ALL)
SELECT l_partkey, arg_max(v, layer) AS v, max(layer) AS layer, string_agg(layer, '>' ORDER BY layer) AS chain FROM l GROUP BY l_partkey""",
    ),
    "claims_reconcile": (claims_reconcile, f"WITH {CLAIMS} SELECT * FROM w"),
    "claim_winners": (claim_winners, f"WITH {CLAIMS} SELECT field, tier, count(*) AS n FROM w WHERE tier IS NOT NULL GROUP BY ALL"),
    "claim_audit": (claim_audit, f"WITH {CLAIMS} SELECT count(*) FILTER (had_conflict) AS conflicts, count(*) FILTER (tier IS NULL) AS omitted, sum(candidates)::BIGINT AS candidates, count(*) AS fields FROM w"),
    "claim_confidence": (
        claim_confidence,
        f"""WITH {CLAIMS} SELECT key, CASE WHEN bool_or(field = 'discount' AND coalesce(tier, '') = 'authoritative_client') AND bool_or(field = 'tax' AND coalesce(tier, '') = 'authoritative_client') THEN 'high' WHEN bool_or(coalesce(tier, '') = 'authoritative_client') THEN 'medium' ELSE 'low' END AS confidence,
       array_to_string(list_filter(['authoritative_client', 'verified_builder', 'external_db', 'inferred'], lambda t: list_contains(list(tier), t)), '>') AS provenance FROM w GROUP BY key""",
    ),
    "identity_gate": (
        identity_gate,
        f"""WITH g AS (SELECT p_size, p_type, list_sort(list(upper(p_name))) AS b, min(p_name) AS db, max(p_name) FILTER (p_partkey % 2 = 0) AS client FROM part GROUP BY ALL),
r AS (SELECT *, coalesce(client, CASE WHEN len(list_distinct(b)) = 1 THEN b[1] END, db) AS reference FROM g)
SELECT p_size, p_type, reference, CASE WHEN {SLUG.format("db")} <> {SLUG.format("reference")} THEN 'db_identity_mismatch' END AS excluded_reason FROM r""",
    ),
    "merged_rows": (merged_rows, "SELECT p_brand, string_agg(DISTINCT w, ',' ORDER BY w) AS tags, (SELECT arg_min(p_type, p_partkey) FROM part q WHERE q.p_brand = x.p_brand AND p_size % 2 = 0) AS text FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) x GROUP BY p_brand"),
    "resolved_kinds": (resolved_kinds, "SELECT p_brand, CASE WHEN bool_or(p_type = 'PROMO') THEN 'PROMO' WHEN bool_or(p_type = 'SMALL') THEN 'SMALL' ELSE 'LARGE' END AS p_type, count(DISTINCT p_type) > 1 AS disagreed FROM part WHERE p_type IN ('PROMO', 'SMALL', 'LARGE') GROUP BY p_brand"),
    "attribution": (
        attribution,
        """WITH m AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'own' WHEN 'R' THEN 'shared' END AS mode, l_suppkey FROM lineitem),
a AS (SELECT id, coalesce(list_sort(list(DISTINCT mode) FILTER (mode IS NOT NULL)), []) AS m, count(DISTINCT l_suppkey) AS groups FROM m GROUP BY id)
SELECT id, array_to_string(m, ',') AS modes, list_contains(m, 'own') AS is_own, CASE WHEN len(m) = 1 THEN m[1] END AS exclusive_mode, groups, CASE WHEN len(m) > 0 THEN 'high' ELSE 'low' END AS confidence FROM a""",
    ),
    "attribution_derived": (
        attribution_derived,
        "WITH p AS (SELECT p_partkey AS id, concat_ws('/', p_brand, p_type, p_name) AS g FROM part) SELECT DISTINCT id, 'medium' AS confidence FROM p WHERE g IN (SELECT g FROM p WHERE id % 10 = 3) AND id % 10 <> 3",
    ),
    "attribution_fill": (
        attribution_fill,
        """WITH m AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'own' WHEN 'R' THEN 'shared' END AS mode FROM lineitem WHERE l_partkey % 2 = 0),
a AS (SELECT id, coalesce(list_sort(list(DISTINCT mode) FILTER (mode IS NOT NULL)), []) AS m FROM m GROUP BY id)
SELECT p_partkey, CASE WHEN p_partkey BETWEEN 0 AND 99 THEN 'low' WHEN p_partkey BETWEEN 100 AND 999 THEN 'middle' ELSE 'unknown' END AS band, coalesce(array_to_string(m, ','), '') AS modes, coalesce(list_contains(m, 'own'), false) AS is_own,
       CASE WHEN id IS NULL THEN 'none' WHEN len(m) > 0 THEN 'high' ELSE 'low' END AS confidence FROM part LEFT JOIN a ON p_partkey = id""",
    ),
    "catalogue_parity": (catalogue_parity, f"{COVER} SELECT *, matched / (matched + right_only)::DOUBLE AS recall, matched / (matched + left_only)::DOUBLE AS precision FROM x"),
    "field_parity": (field_parity, f"WITH {REBUILT} SELECT * FROM (SELECT o_orderkey, 'a' AS field, l.a AS \"left\", r.a AS \"right\" FROM l JOIN r USING (o_orderkey) UNION ALL SELECT o_orderkey, 'b', l.b, r.b FROM l JOIN r USING (o_orderkey)) WHERE \"left\" <> \"right\""),
    "readiness": (
        readiness,
        """WITH x AS (SELECT p_partkey AS k, p_partkey % 17 <> 0 AS c, p_partkey % 19 <> 0 AS b FROM part),
n AS (SELECT count(*) FILTER (c) AS client_nodes, count(*) FILTER (b) AS builder_records, count(*) FILTER (c AND b) AS matched, count(*) FILTER (b AND NOT c) AS builder_only, count(*) FILTER (c AND NOT b AND k % 3 = 0) AS verified_client_current, 0::BIGINT AS representation_difference,
  count(*) FILTER (c AND NOT b AND k % 3 = 2) AS extraction_defect, count(*) FILTER (c AND NOT b AND k % 3 = 1) AS unresolved, count(*) FILTER (c AND b AND k % 97 <> 0 AND k % 89 <> 0 AND k % 5 = 0) AS representation_pairs, count(*) FILTER (c AND b AND (k % 97 = 0 OR k % 89 = 0)) AS identity_mismatches,
  count(*) FILTER (c AND b AND k % 3 = 0 AND k % 101 = 0) AS adjacency_mismatches, count(*) FILTER (c AND b AND k % 23 = 0) AS legality_differences FROM x),
f AS (SELECT lower(n_name) AS field, n_nationkey AS i, CASE n_nationkey % 7 WHEN 3 THEN 'low' WHEN 5 THEN 'lost' ELSE 'ready' END AS s FROM nation),
l AS (SELECT string_agg(field || CASE WHEN s = 'ready' THEN ':ready' ELSE ':unresolved' END, ',' ORDER BY field || CASE WHEN s = 'ready' THEN ':ready' ELSE ':unresolved' END) FILTER (i BETWEEN 2 AND 19) AS legality, string_agg(field || CASE WHEN s = 'ready' THEN ':ready' ELSE ':unresolved' END, ',' ORDER BY field || CASE WHEN s = 'ready' THEN ':ready' ELSE ':unresolved' END) FILTER (i >= 20) AS layout,
  string_agg('low_confidence:' || field, ',' ORDER BY field) FILTER (s = 'low') AS low, string_agg('unresolved_layout_column:' || field, ',' ORDER BY field) FILTER (s = 'lost') AS lost FROM f)
SELECT n.*, legality, layout, false AS attribution_ready, false AS ownership_ready, adjacency_mismatches = 0 AS adjacency_ready, false AS leveling_progression_ready, false AS full_retirement_ready,
  concat_ws(',', 'playable_class_count', CASE WHEN builder_records <> 100 THEN 'builder_record_count' END, CASE WHEN builder_only > 0 THEN 'builder_only_node_instances' END, CASE WHEN unresolved > 0 THEN 'client_only_unresolved' END, CASE WHEN extraction_defect > 0 THEN 'client_only_extraction_defect' END,
    CASE WHEN identity_mismatches > 0 THEN 'identity_mismatch' END, CASE WHEN adjacency_mismatches > 0 THEN 'adjacency_mismatch' END, low, lost) AS blockers FROM n CROSS JOIN l""",
    ),
    "set_parity": (
        set_parity,
        """WITH s AS (SELECT l_orderkey AS key, coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_returnflag = 'A')), []) AS a, coalesce(list_sort(list(DISTINCT l_linenumber) FILTER (l_linestatus = 'F')), []) AS b FROM lineitem GROUP BY 1)
SELECT key, array_to_string(a, ',') AS "left", array_to_string(b, ',') AS "right", CASE WHEN list_has_all(a, b) THEN 'extended' WHEN list_has_all(b, a) THEN 'changed' ELSE 'ambiguous' END AS relation FROM s WHERE a <> b""",
    ),
    "label_parity": (
        label_parity,
        """WITH p AS (SELECT p_partkey % 7 = 0 AS moved, p_name AS l, CASE WHEN p_size % 2 = 0 THEN upper(p_name) WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS r FROM part)
SELECT l AS "left", r AS "right", CASE WHEN NOT moved AND lower(replace(l, ' ', '')) = lower(replace(r, ' ', '')) THEN 'representation' ELSE 'hard' END AS kind, count(*) AS n FROM p WHERE moved OR l <> r GROUP BY ALL""",
    ),
    "adjudication": (adjudication, "SELECT CASE WHEN o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0 THEN 'unresolved' WHEN o_orderkey % 5 < 3 THEN 'verified_client_current' ELSE 'extraction_defect' END AS classification, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL"),
    "tab_coverage": (tab_coverage, "SELECT n_nationkey, n_name, count(s_suppkey) AS nodes, count(s_suppkey) > 0 AS has_nodes FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL"),
    "side_join_status": (
        side_join_status,
        """WITH f AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem), j AS (SELECT f.*, p_name, CASE WHEN l_partkey = 0 THEN 'index_zero' WHEN p_partkey IS NULL THEN 'side_row_missing' ELSE 'resolved' END AS status FROM f LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 1) ON l_partkey = p_partkey)
SELECT l_orderkey, l_partkey, l_linenumber, status, CASE WHEN status = 'resolved' AND l_linenumber > 2 THEN p_name END AS decoded FROM j""",
    ),
    "enriched": (
        enriched,
        """WITH o AS (SELECT o_orderkey, c_name AS name, c_nationkey AS n, o_orderkey % 5 AS m FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey),
w AS (SELECT s_nationkey AS n, s_suppkey % 5 AS m, min(s_name) AS owner FROM supplier GROUP BY ALL) SELECT o.*, owner FROM o LEFT JOIN w ON o.n = w.n AND o.m = w.m""",
    ),
    "overrides": (
        overrides,
        """WITH e AS (SELECT c_nationkey, c_mktsegment, min(c_custkey)::VARCHAR AS v FROM customer WHERE c_nationkey < 5 GROUP BY ALL), g AS (SELECT c_mktsegment, max(c_custkey)::VARCHAR AS v FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY ALL)
SELECT c_custkey, coalesce(e.v, g.v, 'default') AS v, CASE WHEN c_custkey % 7 = 0 THEN 'own' WHEN c.c_mktsegment LIKE 'B%' THEN 'generic' END AS profile,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c.c_mktsegment LIKE 'B%' THEN 'generic_profile_used' ELSE 'no_profile' END AS warning
FROM customer c LEFT JOIN e ON c.c_nationkey = e.c_nationkey AND c.c_mktsegment = e.c_mktsegment LEFT JOIN g ON c.c_mktsegment = g.c_mktsegment""",
    ),
    "freshness": (
        freshness,
        """WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'matched' END AS status, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN o_orderdate END AS seen FROM orders)
SELECT CASE WHEN status = 'failed' THEN 'failed' WHEN seen > TIMESTAMP '1999-01-01' - INTERVAL 400 DAYS THEN 'fresh' ELSE 'stale' END AS state, status, count(*) AS n FROM o GROUP BY ALL""",
    ),
}
