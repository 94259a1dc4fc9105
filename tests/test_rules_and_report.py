"""Literal rows with the values that the rules give: relations, verdicts, rules, variants, sessions, streams, medians, cycles, report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import builds, diff, discover, enrichment, events, graph, reconcile, relational, report, rules, score, similarity
from tessera.operators import spec_report as sr
from tessera.streaming import event_stream as es


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("observed", "relation"), [([1, 2], "exact"), ([1, 2, 3], "extended"), ([1], "changed"), ([1, 3], "ambiguous"), ([], "changed")])
def test_a_subset_is_changed_and_anything_else_ambiguous(spark, observed, relation):
    ids = F.array(*[F.lit(x) for x in observed]).cast("array<int>")
    assert one(spark, relational.set_relation(ids, F.array(F.lit(1), F.lit(2)))) == relation


def test_edge_states_have_a_direction(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (3, 4), (1, 4)], "a long, b long")
    mark = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node long")
    got = {(r["a"], r["b"]): r["state"] for r in graph.edge_states(edges, mark(1, 2), mark(3)).collect()}
    assert got == {(1, 2): "selected", (1, 3): "available", (3, 1): "gated", (3, 4): "inactive", (1, 4): "inactive"}


def test_tree_edges_and_their_warnings(spark):
    rows = spark.createDataFrame([(1, [2, 9, 1], [3]), (2, [1], None), (3, None, [8])], "node long, linked array<long>, required array<long>")
    edges, told = graph.tree_edges(rows, "node", "linked", "required")
    assert sorted(map(tuple, edges.collect())) == [(1, 2, "connection"), (3, 1, "requirement")]
    assert sorted(map(tuple, told.collect())) == [("tree_edge_missing_target", 1, 9), ("tree_requirement_missing_source", 8, 3)]


def test_record_confidence_needs_the_clients_timing(spark):
    best, other = reconcile.TIERS[0], reconcile.TIERS[2]
    rows = [("high", "schools", best), ("high", "power", best), ("high", "cast", best), ("med", "schools", best), ("med", "power", best), ("med", "cast", other), ("any", "range", best), ("low", "schools", other), ("low", "cast", None)]
    got = reconcile.record_confidence(spark.createDataFrame(rows, "key string, field string, tier string"), ["schools", "power"], ["cast", "duration"]).collect()
    assert {r["key"]: r["confidence"] for r in got} == {"high": "high", "med": "medium", "any": "medium", "low": "low"}


def test_unknown_kinds_claim_no_mode(spark):
    rows = [(1, 10, "own"), (1, 11, "strange"), (2, 10, "strange"), (3, 10, "own"), (3, 12, "shared"), (4, 10, "shared")]
    got = {r["id"]: (r["modes"], r["is_own"], r["exclusive_mode"], r["confidence"]) for r in reconcile.attribute(spark.createDataFrame(rows, "id long, group long, kind string"), {"own": "own", "shared": "shared"}, "own").collect()}
    assert got == {1: ("own", True, "own", "high"), 2: ("", False, None, "low"), 3: ("own,shared", True, None, "high"), 4: ("shared", False, "shared", "high")}


def test_a_fetched_row_is_gated_by_its_name(spark):
    entries = spark.createDataFrame([(1, 1, "Fire Bolt"), (2, 2, "A"), (3, 2, "B"), (4, 3, "Frost"), (5, 4, "Ice"), (6, 5, "Gone")], "entry long, spell long, name string")
    fetched = spark.createDataFrame([(1, "fire-bolt", 5), (2, "whatever", 6), (3, "Other", 7), (4, "", 8), (5, None, None)], "spell long, name string, cooldown_ms int")
    client = spark.createDataFrame([(3, "Other")], "spell long, name string")
    got = {r["spell"]: tuple(r)[1:] for r in enrichment.single_source(enrichment.three_sources(entries, fetched, client), "cooldown_ms").collect()}
    assert got == {
        1: (5, "fetched", "db_fallback", None),
        2: (6, "fetched", "db_fallback", None),  # builders disagree, so the reference is the row's own name
        3: (7, "fetched", "db_fallback", None),  # the client's name counts first
        4: (None, None, "omitted_no_eligible_candidate", "db_identity_unverifiable"),
    }


def test_pending_corrections(spark):
    got = events.pending_corrections(spark.createDataFrame([(7,), (7,)], "spell long"), "spell").collect()
    assert sorted((r["correction_type"], r["confidence"], r["status"]) for r in got) == [(f"{c}_correction", "low", "pending") for c in ("coefficient", "proc_rate", "tick_interval", "uptime")]


@pytest.mark.parametrize(("rows", "reviewed", "verdict"), [([("unique", True)], True, "verified"), ([("unique", True)], False, "review_required"), ([("unique", False)], True, "review_required"), ([("ambiguous", True)], True, "blocked"), ([("missing", None)], True, "blocked")])
def test_recon_blocks_what_is_not_unique(spark, rows, reviewed, verdict):
    assert discover.recon_status(spark.createDataFrame(rows, "status string, policy_match boolean"), reviewed, True).first()["verdict"] == verdict


def test_masks(spark):
    got = discover.mask_domain(spark.createDataFrame([(0, 5), (0, 16), (1, 3), (1, None)], "col int, val long"), 7).collect()
    assert {r["col"]: (r["observed_bits"], r["unknown_bits"]) for r in got} == {0: (21, 16), 1: (3, 0)}


def test_only_three_verdicts_count(spark):
    left = spark.createDataFrame([(i,) for i in range(5)], "k long")
    said = spark.createDataFrame([(0, "verified_client_current"), (1, "representation_difference"), (2, "extraction_defect"), (3, "fine by me")], "k long, classification string")
    assert {r["classification"]: r["n"] for r in diff.adjudicate(left, said, "k").collect()} == {"verified_client_current": 1, "representation_difference": 1, "extraction_defect": 1, "unresolved": 2}


CATALOGUE = "node long, spell long, cls string, connected array<long>, required array<long>, values map<string,long>"


def ready(spark, client, builder, verdicts=(), fields=(("ae_cost", "legality", "high"), ("connected", "adjacency", "high"), ("row", "layout", "low")), **more):
    said = spark.createDataFrame(list(verdicts), "node long, classification string")
    told = spark.createDataFrame(list(fields), "field string, part string, confidence string")
    return diff.readiness(spark.createDataFrame(client, CATALOGUE), spark.createDataFrame(builder, CATALOGUE), said, told, tx.canonical_label, **more).first()


def test_readiness_gates_and_blockers(spark):
    good = [(1, 10, "Sun Cleric", [2], [], {"ae_cost": 1}), (2, 20, "Ranger", [1], None, {"ae_cost": 2})]
    alike = [(1, 10, "SunCleric", [2, 2], [], {"ae_cost": 1}), (2, 20, "Ranger", [1], [5], {"ae_cost": 9})]
    r = ready(spark, good, alike, expected=2)
    assert (r["attribution_ready"], r["ownership_ready"], r["adjacency_ready"], r["full_retirement_ready"], r["leveling_progression_ready"]) == (True, True, True, True, False)
    # A label that is only written otherwise is accepted; a value that differs is the client's; layout never gates.
    assert (r["representation_pairs"], r["legality_differences"], r["layout"], r["blockers"]) == (1, 1, "row:unresolved", "low_confidence:row")
    r = ready(spark, [*good, (3, 30, "X", None, None, None), (4, 40, "X", None, None, None)], [(1, 11, "Sun Cleric", [7], [], {}), (9, 90, "Y", None, None, None)], [(3, "extraction_defect")], [("ae_cost", "legality", None)], taxonomy=("playable_class_count",), expected=3)
    assert not (r["attribution_ready"] or r["ownership_ready"] or r["adjacency_ready"] or r["full_retirement_ready"])
    assert r["blockers"] == "playable_class_count,builder_record_count,builder_only_node_instances,client_only_unresolved,client_only_extraction_defect,identity_mismatch,adjacency_mismatch,unresolved_layout_column:ae_cost"
    assert ready(spark, [], [])["blockers"].startswith("empty_client_input,empty_builder_input")


def test_an_identity_is_an_id_and_a_label(spark):
    pairs = spark.createDataFrame([(1, 1, "Sun Cleric", "SunCleric"), (2, 3, "A", "A"), (4, 4, "A", "B"), (5, 5, "A", "A")], "left_id long, right_id long, left string, right string")
    assert sorted((r["left"], r["right"], r["kind"]) for r in diff.identity_differences(pairs, tx.canonical_label).collect()) == [("A", "A", "hard"), ("A", "B", "hard"), ("Sun Cleric", "SunCleric", "representation")]


def test_only_the_stated_version_passes(spark):
    bad = rules.ENTRY_RULES["missing_schema_version"].replace("{version}", "v2")
    got = spark.createDataFrame([("v1",), ("v2",), (None,)], "schema_version string").select("schema_version", F.expr(bad).alias("bad")).collect()
    assert {r["schema_version"]: r["bad"] for r in got} == {"v1": True, "v2": False, None: True}
    faults = spark.createDataFrame([("b", 2), ("a", 1)], "code string, n long")
    assert tuple(rules.catalogue_verdict(faults).first()) == ("fail", 2, 3, "a,b") and rules.catalogue_verdict(faults.limit(0)).first()["verdict"] == "pass"


def test_awards_are_from_ten_to_sixty(spark):
    got = builds.award_schedule(spark.range(1, 70).withColumnRenamed("id", "level")).agg(F.min("level"), F.max("level"), F.max("ae_total"), F.max("te_total")).first()
    assert tuple(got) == (10, 60, 26, 25)


def test_the_schedule_of_the_table_has_every_level(spark, tmp_path):
    from tessera.plans import queries

    sizes = [(1,), (2,), (9,), (9,), (10,), (61,), (None,)]
    spark.createDataFrame(sizes, "p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in queries.queries()["award_schedule"](spark, str(tmp_path)).collect()]
    assert got == [(1, 0, 1, 0, 1), (2, 1, 0, 1, 1), (9, 0, 1, 1, 2), (10, 1, 0, 2, 2), (61, 0, 1, 2, 3), (None, None, None, 2, 3)]


def test_layers_out_of_order(spark):
    rows = [("k", "base", 0, 0), ("k", "patch-3", 3, 1), ("k", "patch-2", 2, 2), ("m", "patch-1", 1, 0), ("m", "patch-2", 2, 1)]
    got = relational.order_inversions(spark.createDataFrame(rows, "key string, layer string, d int, l int"), ["key"], F.col("d"), F.col("l")).collect()
    assert [(r["key"], r["layer"], r["outranked_by"]) for r in got] == [("k", "patch-2", 3)]


def test_nodes_on_a_cycle_are_told_from_those_between_and_behind(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (0, 1), (8, 8), (9, 10)], "src long, dst long")
    assert {r["node"]: r["cycle"] for r in graph.on_cycles(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8}
    assert graph.on_cycles(edges.filter("src = 9")).count() == 0


NODES = "node long, name string, text string, tags array<string>, schools array<string>, resources array<string>, type string, kind string, passive boolean, rank int"
RULES = "rule string, category string, priority double, tags_any array<string>, tags_all array<string>, schools_any array<string>, resources_any array<string>, types_in array<string>, kinds_in array<string>, name_any array<string>, text_any array<string>, active_only boolean, passive_only boolean, rank_least int"


def rule(name, **match):
    empty = dict.fromkeys([f.split()[0] for f in RULES.split(", ")])
    return {**empty, "rule": name, "category": "filler", "priority": 1.0, **match}


def test_all_operators_of_rules(spark):
    nodes = spark.createDataFrame([(1, "Red Bolt", "Deals FIRE", ["dot", "fire"], ["fire"], ["mana"], "Spell", "talent", False, 2), (2, "Wall", None, [], [], [], "Talent", "ability", True, 1)], NODES)
    stated = {
        "tags": rule("tags", tags_any=["dot", "x"]), "empty": rule("empty", tags_any=[]), "all": rule("all", tags_all=["dot", "fire"]), "not all": rule("not all", tags_all=["dot", "ice"]), "school": rule("school", schools_any=["fire"]),
        "resource": rule("resource", resources_any=["mana"]), "name": rule("name", name_any=["BOLT"]), "text": rule("text", text_any=["deals fire"]), "type": rule("type", types_in=["Talent"]), "kind": rule("kind", kinds_in=["talent"]),
        "active": rule("active", active_only=True), "passive": rule("passive", passive_only=True), "rank": rule("rank", rank_least=2), "any": rule("any"), "two": rule("two", tags_any=["dot"], schools_any=["frost"]),
    }
    found = rules.matches(nodes, spark.createDataFrame(list(stated.values()), RULES))
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = {n: sorted(r["rule"] for r in found.collect() if r["node"] == n) for n in (1, 2)}
    assert got == {1: sorted(["tags", "all", "school", "resource", "name", "text", "kind", "active", "rank", "any"]), 2: sorted(["type", "passive", "any"])}
    told = {r["rule"]: (r["key"], r["evidence"], r["inferred"]) for r in rules.rule_actions(found).filter("node = 1").collect()}
    assert told["all"] == ("red_bolt", ["tag:fire", "tag:dot", "profile_rule:all"], True) and told["any"] == ("red_bolt", ["profile_rule:any"], True)
    assert {r["rule"]: r["inferred"] for r in rules.rule_actions(found).filter("node = 2").collect()} == {"type": False, "passive": False, "any": False}


def test_warnings_of_actions(spark):
    built = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "scope string, nodes int")
    kept = spark.createDataFrame([("a", "filler", True), ("b", "aoe", False)], "scope string, category string, inferred boolean")
    got = {r["scope"]: r["action_warnings"] for r in rules.action_warnings(built, kept, kept, ["aoe", "filler"]).collect()}
    none = ["no action matched category:aoe", "no action matched category:filler"]
    assert got == {"a": ["condition inferred from normalized tooltip tags", none[0]], "b": [none[1], "selected build has active nodes but no filler action"], "c": none}


def test_watch_lists_are_looked_up(spark):
    rows = spark.createDataFrame([("Mage", "caster_dps"), ("Monk", "tank")], "cls string, role string")
    entries = spark.createDataFrame([(1, "*_dps", "*"), (2, "TANK", "mage"), (3, "*", "MONK")], "id long, role_pattern string, cls_pattern string")
    found = rules.watchlist(rows, entries, {"role": "role_pattern", "cls": "cls_pattern"})
    assert "NestedLoop" not in plan(found) and sorted((r["cls"], r["id"]) for r in found.collect()) == [("Mage", 1), ("Monk", 3)]


def test_first_usable_neither_joins_nor_shuffles(spark):
    state = spark.range(5).select(F.col("id").alias("snapshot"), F.expr("map('rage', double(id * 10))").alias("resources"), F.expr("map()").cast("map<string,double>").alias("cooldowns"))
    actions = spark.createDataFrame([("big", "rage>=30", 1), ("small", "", 2), ("odd", "moon", 3)], "key string, condition string, priority int")
    full = state.withColumns({c: F.expr("map()").cast("map<string,double>") for c in ("debuffs", "buffs", "max_resources")}).withColumns({c: F.lit(0.0) for c in ("time_ms", "gcd_ms", "health_pct")}).withColumn("enemies", F.lit(1))
    found = rules.first_usable(full, actions)
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    assert [(r["action"], r["unsupported"]) for r in found.orderBy("snapshot").collect()] == [("small", 1)] * 3 + [("big", 1)] * 2


def test_variants_change_one_thing(spark):
    rows = [("c", 1, "a", "builder", "rage>=80&mana>=10", 1.0), ("c", 2, "b", "builder", "", 2.0), ("c", 3, "d", "builder", "x.up", 3.0), ("c", 4, "e", "odd", "rage>=0", 4.0), ("c", 5, "f", "odd", "energy>=2000", 5.0), ("c", 6, "g", "spender", "focus>=0.37", 6.0)]
    actions = spark.createDataFrame(rows, "candidate string, pos int, key string, category string, condition string, priority double")
    changed = sorted((r["mutation"], r["condition"]) for r in rules.threshold_changes(actions).collect())
    assert changed == [
        ("threshold:a:rage:100", "rage>=100&mana>=10"), ("threshold:a:rage:60", "rage>=60&mana>=10"), ("threshold:f:energy:1000", "energy>=1000"), ("threshold:f:energy:1000", "energy>=1000"), ("threshold:f:energy:1000", "energy>=1000"),
        ("threshold:g:focus:0.28", "focus>=0.28"), ("threshold:g:focus:0.46", "focus>=0.46"),
    ]
    moved = sorted((r["note"], r["pos"], r["key"], r["priority"]) for r in rules.reorder_changes(actions).collect())
    assert moved == [("Reverse builder priority order.", 1, "d", 1.0), ("Reverse builder priority order.", 3, "a", 3.0), ("Rotate builder priority order.", 1, "b", 1.0), ("Rotate builder priority order.", 2, "d", 2.0), ("Rotate builder priority order.", 3, "a", 3.0)]


def test_the_fingerprint_is_of_the_list(spark):
    import hashlib
    import json

    actions = spark.createDataFrame([("c", 1, "a", "builder", "rage>=80", 1.5), ("c", 2, "b", "odd", "", 2.0)], "candidate string, pos int, key string, category string, condition string, priority double")
    got = {r["mutation"]: r["fingerprint"] for r in rules.variants(actions).collect()}

    def digest(condition):
        rows = [{"action_key": "a", "category": "builder", "condition": condition, "priority": 1.5}, {"action_key": "b", "category": "odd", "condition": "", "priority": 2.0}]
        return hashlib.sha1(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    assert got == {"base": digest("rage>=80"), "threshold:a:rage:60": digest("rage>=60"), "threshold:a:rage:100": digest("rage>=100")}


def list_digest(actions):
    import hashlib
    import json

    rows = [{"action_key": k, "category": c, "condition": x, "priority": p} for _, _, k, c, x, p in actions]
    return hashlib.sha1(json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_variants_are_cut_out_of_the_text(spark):
    """Places count in bytes, a change met three times is one change, and slices of a list's variants give the same."""
    rows = [("c", 1, "ä€", "builder", "rage>=80", 1.0), ("c", 2, 'q"\\', "builder", "ö&mana>=10", 2.0), ("c", 3, "f", "odd", "energy>=2000", 5.0), ("d", 1, "z", "odd", "", 1.5)]
    actions = spark.createDataFrame(rows, "candidate string, pos int, key string, category string, condition string, priority double")
    c, want = rows[:3], {}
    put = lambda i, condition: [(*r[:4], condition, r[5]) if n == i else r for n, r in enumerate(c)]
    want["c", "base"], want["d", "base"] = list_digest(c), list_digest(rows[3:])
    for i, mutation, condition in ((0, "ä€:rage:60", "rage>=60"), (0, "ä€:rage:100", "rage>=100"), (1, 'q"\\:mana:7.5', "ö&mana>=7.5"), (1, 'q"\\:mana:12.5', "ö&mana>=12.5"), (2, "f:energy:1000", "energy>=1000")):
        want["c", "threshold:" + mutation] = list_digest(put(i, condition))
    a, b = c[:2]
    want["c", "reorder_group:builder"] = list_digest([(*b[:5], 1.0), (*a[:5], 2.0), c[2]])
    for digested in (rules.DIGESTED, 100):
        got = rules.variants(actions, digested).collect()
        assert {(r["candidate"], r["mutation"]): r["fingerprint"] for r in got} == want and len(got) == len(want)


def shuffled_bytes(spark, run):
    """Bytes that all stages of ``run`` write for shuffles."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    seen = lambda: [stages().apply(i) for i in range(stages().size())]
    last = max((x.stageId() for x in seen()), default=-1)
    run()
    return sum(x.shuffleWriteBytes() for x in seen() if x.stageId() > last)


def test_variants_of_a_long_list_are_not_shuffled(spark):
    def moved(n):
        actions = spark.createDataFrame([("c", i, f"k{i}", "odd", f"rage>={i + 1}", float(i)) for i in range(n)], "candidate string, pos int, key string, category string, condition string, priority double")
        return shuffled_bytes(spark, lambda: rules.variants(actions).filter("nth.kind < 2").write.format("noop").mode("overwrite").save())

    assert moved(400) < 3 * moved(200)  # there are 2 n variants of n places


# sessions and streams

T0 = dt.datetime(2024, 1, 1)
LOG = "event_id long, ts timestamp, player long, ability string, target string, amount double"


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), p, a, "x", 1.0) for i, m, p, a in rows], LOG)


def test_sessions_of_one_huge_player_are_stitched(spark):
    """One player has all rows, over many ranges and across their borders; ranges are ordered apart."""
    import random

    rng, minute, rows, want, last = random.Random(2), 0, [], [], None
    for i in range(3000):
        minute += rng.choice((0, 1, 5, 29, 30, 31, 2000))
        want.append((want[-1] if want else 0) + (last is None or minute - last >= 30))
        rows.append((i, minute, 1, "hit"))
        last = minute
    df = log(spark, rows).repartition(4)
    for width in ("INTERVAL 1 HOUR", "INTERVAL 1 DAY", "INTERVAL 1000 DAYS"):
        found = events.sessionize(df, width=width)
        assert {r["event_id"]: r["session"] for r in found.collect()} == dict(enumerate(want))
    ordered = [line for line in plan(events.sessionize(df)).split("\n") if "Window" in line and "event_id" in line]
    assert ordered and all("_range" in line for line in ordered)


def test_marked_sessions_over_ranges(spark):
    rows = [(1, 0, 1, "hit"), (2, 5, 1, "start"), (3, 4000, 1, "hit"), (4, 9000, 1, "stop"), (5, 9001, 1, "hit"), (6, 9002, 1, "start"), (7, 20000, 1, "start"), (8, 50000, 1, "hit"), (9, 1, 2, "hit")]
    got = events.marked_sessions(log(spark, rows), F.col("ability") == "start", F.col("ability") == "stop").collect()
    assert sorted((r["event_id"], r["session"]) for r in got) == [(2, 1), (3, 1), (6, 2), (7, 3), (8, 3)]


def test_marked_stream_with_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    is_start, is_stop = F.col("ability") == "start", F.col("ability") == "stop"
    first = log(spark, [(1, 0, 1, "start"), (3, 5, 1, "hit"), (2, 2, 1, "hit"), (2, 2, 1, "hit"), (4, 9, 1, "stop"), (5, 12, 1, "hit"), (6, 100, 1, "start"), (7, 3, 2, "start"), (8, 200, 2, "hit")])
    second = log(spark, [(9, 300, 1, "hit"), (10, 50, 1, "hit"), (8, 200, 2, "hit"), (11, 310, 1, "start"), (12, 320, 2, "start"), (13, 1000, 1, "stop"), (14, 1500, 3, "hit")])
    progress = []
    for part in (first, second):  # the second run goes on from the checkpoint of the first
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = es.marked_stream(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")), is_start, is_stop)
        out = es.run_available(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), progress, es.ROCKS)
    on_time = first.unionByName(second).dropDuplicates(["event_id"]).filter("event_id <> 10")
    whole = events.marked_sessions(on_time, is_start, is_stop).groupBy("player", "session").agg(F.min("ts"), F.max("ts"), F.count("*"))
    batch = {tuple(r) for r in whole.collect()}
    got = {tuple(r)[:5]: r["closed_by"] for r in out.collect()}
    assert set(got) == {r for r in batch if r[:2] != (2, 2)}  # the last session of player 2 is open
    assert [got[k] for k in sorted(got)] == ["stop", "start", "stop", "start"]
    assert es.late_rows(progress) >= 1  # event 10 came when minute 190 had passed


def test_tumbling_windows_count_late_rows_as_dropped(spark, tmp_path):
    progress = []
    for rows in ([(1, 10, 1, "a"), (2, 20, 1, "a"), (3, 200, 1, "a")], [(4, 30, 1, "a"), (2, 20, 1, "a"), (5, 250, 1, "a"), (6, 600, 1, "a")]):
        log(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = es.tumbling_metrics(spark.readStream.schema(LOG).parquet(str(tmp_path / "in")))
        out = es.run_available(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"), progress)
    got = sorted(((r["window"]["start"] - T0).total_seconds() / 3600, r["events"]) for r in out.collect())
    assert got == [(0.0, 2), (3.0, 1), (4.0, 1)]  # the late row of minute 30 is not in the first hour
    assert es.late_rows(progress) >= 1


def test_only_a_choice_needs_fingerprints(spark):
    """Three places by hand; prints are asked for candidates in the band of scopes with more than one, and nothing of them is carried on."""
    scores = [("a", 1, 100.0, 0.75), ("a", 2, 99.0, 0.5), ("a", 3, 98.0, 0.5), ("a", 4, 97.0, 0.0), ("a", 5, 96.0, 0.5), ("a", 6, 10.0, 1.0), ("b", 7, 5.0, 0.0), ("b", 8, 1.0, 1.0), ("c", 9, 7.0, 0.25), ("c", 10, 7.0, 0.25)]
    scored = spark.createDataFrame(scores, "scope string, key long, score double, reliability double")
    at = {1: 0.0, 2: 0.1, 3: 0.3, 4: 1.0, 5: 0.9, 9: 0.0, 10: 0.2}
    asked = []

    def prints(some):
        asked.extend(r["key"] for r in some.collect())
        return some.select("scope", "key").join(spark.createDataFrame(list(at.items()), "key long, x double"), "key")

    eligible = similarity.in_band(scored, "scope")
    assert {r["key"]: r["best"] for r in eligible.collect()} == {1: 100.0, 2: 100.0, 3: 100.0, 4: 100.0, 5: 100.0, 7: 5.0, 9: 7.0, 10: 7.0}
    chosen = similarity.select_diverse(eligible, prints, "scope", "key", 4, 0.22, lambda a, b: F.round(F.abs(F.col(f"{a}.x") - F.col(f"{b}.x")), 4))
    # a: 5 (0.836) before 3 (0.758) and 4 (0.732); then 3 at 0.3, as 4 is too near to 5 and 2 to 1. c: 10 is too near.
    assert sorted((r["place"], r["scope"], r["key"]) for r in chosen.collect()) == [(1, "a", 1), (1, "b", 7), (1, "c", 9), (2, "a", 5), (3, "a", 3)]
    assert sorted(asked) == [1, 2, 3, 4, 5, 9, 10]


def test_diverse_topk_shuffles_few_fingerprints(spark, tmp_path):
    """Builds under their scope's floor are never fingerprinted: fifty times as many of them move the scores, not their nodes."""
    from tessera.plans import catalogue_queries

    def moved(n):
        at = tmp_path / str(n)
        k = F.col("id")
        spark.createDataFrame([(i, "a part", "Brand#1", "LARGE", i % 50, 1.0) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(at / "part.parquet"))
        spark.range(100 * n).select(k.alias("o_orderkey"), (k % 100).alias("o_custkey"), F.when(k < 200, 1000.0 + k).otherwise(1.0).alias("o_totalprice")).write.parquet(str(at / "orders.parquet"))
        spark.range(500 * n).select((k / 5).cast("long").alias("l_orderkey"), (k * 7 % 40).alias("l_partkey")).write.parquet(str(at / "lineitem.parquet"))
        return shuffled_bytes(spark, lambda: catalogue_queries.diverse_topk(spark, str(at)).write.format("noop").mode("overwrite").save())

    assert moved(100) < 4 * moved(2)


def test_medians_of_one_scope_with_all_rows(spark):
    import statistics

    values = [(i * 7919 % 100_003) % 30_000 / 8 for i in range(60_001)]
    df = spark.createDataFrame([("hot", v) for v in values] + [("small", 1.0), ("small", 2.0), ("none", None)] + [("same", 5.0)] * 7, "scope string, score double").repartition(4)
    got = {r["scope"]: r["median"] for r in similarity.medians(df, "scope", F.col("score"), cut=500).collect()}
    assert got == {"hot": statistics.median(values), "small": 1.5, "same": 5.0}
    floors = {r["scope"]: r["floor"] for r in similarity.band_floor(df.filter("score IS NOT NULL"), "scope", cut=500).collect()}
    assert floors == {r["scope"]: r["floor"] for r in similarity.band_floor(df.filter("score IS NOT NULL"), "scope").collect()}


# ledgers of files


def test_a_file_ledger_names_the_changed_file_and_reads_no_other(spark, tmp_path):
    import hashlib
    import os

    from tessera.operators import snapshots

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    for path, data in (("a/one", b"1"), ("a/two", b"22"), ("b/one", b"333")):
        (tmp_path / path).write_bytes(data)
    paths = {name: f"file://{tmp_path}/{name}" for name in ("a", "b")}
    first = spark.createDataFrame(snapshots.file_ledger(spark, paths).collect())
    assert {(r["name"], r["file"]): (r["bytes"], r["sha256"]) for r in first.collect()} == {tuple(p.split("/")): (len(d), hashlib.sha256(d).hexdigest()) for p, d in (("a/one", b"1"), ("a/two", b"22"), ("b/one", b"333"))}
    assert snapshots.verify_files(first, snapshots.file_ledger(spark, paths, first)).count() == 0
    # A record of equal size and time is taken over as it stands: the file isn't read.
    marked = first.withColumn("sha256", F.lit("as recorded"))
    assert {r["sha256"] for r in snapshots.file_ledger(spark, paths, marked).collect()} == {"as recorded"}
    (tmp_path / "a/two").write_bytes(b"23")
    os.utime(tmp_path / "a/two", (1, 1))
    (tmp_path / "b/new").write_bytes(b"4")
    os.remove(tmp_path / "a/one")
    now = snapshots.file_ledger(spark, paths, first)
    assert sorted(map(tuple, snapshots.verify_files(first, now).collect())) == [("a", "one", "missing"), ("a", "two", "hash_mismatch"), ("b", "new", "not_recorded")]
    before = snapshots.generation_digest(first).first()["digest"]
    assert before == snapshots.generation_digest(first.withColumn("modified", F.current_timestamp())).first()["digest"]
    assert len({before, snapshots.generation_digest(now).first()["digest"], snapshots.generation_digest(now, before).first()["digest"]}) == 3


# the report


def test_sections_of_a_rotation(spark):
    rows = [("b", "melee_dps", "maintenance", "Dot", 1.0), ("b", "melee_dps", "spender", "Hit", 2.0), ("b", "melee_dps", "aoe", "Cleave", 1.0), ("b", "melee_dps", "utility", "Kick", 1.0), ("b", "melee_dps", "precombat", "Flask", 1.0), ("t", "tank", "precombat", "Flask", 1.0), ("t", "tank", "cooldown", "Wall", 1.0)]
    df = spark.createDataFrame(rows, "build string, role string, category string, name string, priority double").withColumns({"key": F.lower("name"), "order": F.lit(1), "condition": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string")})
    got = {(r["build"], r["at"], r["section"]): [(a["name"], a["condition"], a["confidence"]) for a in r["actions"]] for r in report.rotation_sections(df).collect()}
    assert got == {
        ("b", 1, "opener"): [("Flask", "", "low")], ("b", 2, "maintenance"): [("Dot", "", "low")], ("b", 4, "builder_spender"): [("Cleave", "", "low"), ("Hit", "", "low")],
        ("b", 5, "defensive_support"): [("Kick", "", "low")], ("t", 3, "cooldowns"): [("Wall", "", "low")], ("t", 5, "defensive_support"): [("Flask", "", "low")],
    }


def test_gear_report_with_and_without_items(spark):
    items = spark.createDataFrame([(1, "sword", "", "low", {"armor": 1.0}), (2, "axe", "plate", "high", {"armor": 1.0})], "item long, weapon_type string, armor_type string, confidence string, stats map<string,double>")
    weights = spark.createDataFrame([("tank", "armor", 2.8), ("tank", "stamina", 3.0)], "role string, stat string, weight double")
    wanted = spark.createDataFrame([("tank", "tank"), ("healer", "healer_support")], "role string, engine_role string")
    got = {r["role"]: r for r in score.gear_report(items, weights, wanted).collect()}
    assert got["tank"]["available_weapon_types"] == ["axe", "sword"] and got["tank"]["best_weapon_types"] == ["shield", "sword", "mace", "axe"] and got["tank"]["stat_priority"] == ["stamina", "armor"]
    assert [(i["item"], i["score"]) for i in got["tank"]["item_scores"]] == [(2, 2.8), (1, 2.8)] and got["tank"]["gear_warnings"] == ["item_data_low_confidence"]  # of equal scores the larger id first
    bare = {r["role"]: r for r in score.gear_report(items.limit(0), weights, wanted).collect()}
    assert (bare["healer"]["gear_source"], bare["healer"]["gear_confidence"], bare["healer"]["gear_warnings"]) == ("defaults", "low", ["item_data_missing", "gear_targets_from_role_defaults"])
    assert bare["healer"]["available_weapon_types"] == ["staff", "mace", "dagger", "sword"]


def test_scope_warnings_have_two_names_and_go_by_tab_id(spark):
    nodes = spark.createDataFrame([("a", 1, "Sun", 5), ("a", 0, "Class", None), ("b", 0, "Class", 3)], "cls string, tab_id int, tab string, availability int")
    metadata = spark.createDataFrame([("a", 1, "Sun"), ("a", 2, "Sun"), ("a", 9, "None"), ("b", 0, "Class")], "cls string, tab_id int, tab string")
    scopes = spark.createDataFrame([("a", 50), ("b", 50)], "cls string, level int")
    got = sorted((r["cls"], r["warning"], r["detail"]) for r in report.warnings(nodes, metadata, scopes, ("Class", "None")).collect())
    assert [g[:2] for g in got] == [("a", "class_pool_level_gating_incomplete"), ("a", "metadata_tab_has_no_nodes"), ("a", "shared_class_level_gating_incomplete")]


def test_a_scope_without_builds_is_told(spark):
    scopes = spark.createDataFrame([("s", "a", 45), ("t", "a", 60)], "scope string, cls string, level int")
    nodes = spark.createDataFrame([("a", "Class", None)], "cls string, tab string, availability int")
    built = spark.createDataFrame([("t", 120.0)], "scope string, index double")
    found = spark.createDataFrame([("t", "budget_floor_unreachable_with_current_gates")], "scope string, warning string")
    got = {r["scope"]: (r["builds"], r["warnings"]) for r in sr.scope_results(built, found, scopes, nodes, "Class").collect()}
    assert got == {"s": (0, ["class_pool_level_gating_incomplete", "shared_class_level_gating_incomplete", "no_valid_builds_found"]), "t": (1, ["budget_floor_unreachable_with_current_gates"])}
