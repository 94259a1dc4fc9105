"""Scores, playstyles, mechanics and enrichment on literal rows, with the numbers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import safe_html
from tessera.operators import builds, enrichment, mechanics, report, rules, score, shapes, similarity


def test_marginal_values(spark):
    nodes = spark.createDataFrame([(1, "Rend", ["Bleed", "DOT"], 10, "melee_dps"), (2, "Wall", ["tank"], 60, "tank"), (3, "Plain", [], 200, "healer")], "node long, name string, tags array<string>, level int, role string")
    named = spark.createDataFrame([("core", "Rend"), ("core", "Rend"), ("cooldown", "Rend"), ("other", "Wall")], "section string, name string")
    needs = spark.createDataFrame([(2, 1), (3, 9)], "node long, required long")
    got = builds.marginal_values(nodes, named, needs, spark.createDataFrame([(1,)], "node long"))
    # 100 + 60 + 35 + 20 + 9; 100 + 20 + 4; 100 - 10
    assert {r["node"]: r["value"] for r in got.collect()} == {1: 224.0, 2: 124.0, 3: 90.0}


def test_node_states_go_by_precedence(spark):
    keys = "level int, node long"
    nodes = spark.createDataFrame([(1, n) for n in range(1, 9)], keys)
    some = lambda *ns: spark.createDataFrame([(1, n) for n in ns], keys)
    issues = spark.createDataFrame([(1, 1, "level_required"), (1, 3, "duplicate_node"), (1, 4, "tab_te_gate_unmet"), (1, 4, "level_required"), (1, 5, "te_budget_exceeded"), (1, 8, "odd")], f"{keys}, code string")
    got = builds.node_states(nodes, some(1, 2, 3), some(1), some(6), issues)
    assert {r["node"]: r["state"] for r in got.collect()} == {1: "free", 2: "selected", 3: "over_budget", 4: "gated_level", 5: "over_budget", 6: "available", 7: "inactive", 8: "inactive"}


def test_legacy_score_goes_by_encounter(spark):
    nodes = spark.createDataFrame(
        [(1, "A", "hits nearby foes", ["tank"], "SpendSquare", False, True, 5), (2, "B", "plain", ["hot"], "Circle", True, True, 1)],
        "node long, name string, text string, tags array<string>, node_type string, passive boolean, paid boolean, max_rank int",
    )
    parts = spark.createDataFrame([(1, "tag", "tank", 2.0)], "node long, kind string, key string, value double")
    valued = score.legacy_node_scores(nodes, parts)
    assert {r["node"]: r["value"] for r in valued.collect()} == {1: 6.6, 2: 0.95}
    members = spark.createDataFrame([(b, n) for b in (1, 2) for n in (1, 2)], "build long, node long")
    kinds = spark.createDataFrame([(1, "aoe"), (2, "single")], "build long, encounter string")
    got = {r["build"]: r["score"] for r in score.legacy_score(members, valued, kinds, [(["A", "B"], 3.0), (["A", "C"], 9.0)]).collect()}
    assert got == {1: 12.55, 2: 8.05}  # 7.55 + 3, and 2 for one area node or 2.5 off for two diluting ones


def test_usage_scores(spark):
    maps = "map<string,double>"
    catalogue = spark.createDataFrame(
        [("hit", "damage", 1000, None, 0, {"Mana": 10.0}, {}), ("gen", "utility", None, 500, 9000, {}, {"rage": 20.0}), ("wall", "mitigation", 6000, None, 0, {}, {})],
        f"key string, classification string, duration_ms int, effect_ms int, cooldown_ms int, costs {maps}, generates {maps}",
    )
    usage = spark.createDataFrame([(c, k, n) for c in (1, 2, 3) for k, n in (("hit", 10), ("gen", 10), ("wall", 2), ("unknown", 99))], "candidate long, key string, count long")
    results = spark.createDataFrame(
        [(1, "melee_dps", 60000, 600.0, 60.0, 0, 0, 0, 0, 100.0, []), (2, "tank", 60000, 600.0, 60.0, 1, 0, 0, 1, 100.0, []), (3, "healer", 0, 600.0, 60.0, 0, 0, 0, 0, 100.0, ["missing_action:x"])],
        "candidate long, role string, duration_ms int, damage double, healing double, mitigation_events int, support_events int, unsupported_conditions int, unsupported_effects int, coverage_pct double, warnings array<string>",
    )
    got = {r["candidate"]: (r["score"], r["reliability"], r["adjusted"]) for r in score.usage_scores(results, usage, catalogue).collect()}
    assert got[1] == (600 + 25 * 0.5 + 0.5 * 50 + 10 * 10, "high", 737.5)  # damage, 25 % uptime, 100 of 200 spent, 10 cooldowns
    assert got[2] == (20 * 8 + (24 + 75) + (90 + 36) + 60, "medium", 378.25)
    assert got[3] == (6.0, "low", 3.3)  # no duration: only 60 healing for 100 mana counts


def test_candidate_validity(spark):
    candidates = spark.createDataFrame([(1, "healer"), (2, "healer"), (3, "melee_dps"), (4, "melee_dps"), (5, "tank")], "candidate long, role string")
    actions = spark.createDataFrame([(1, "h", "filler"), (2, "f", "filler"), (3, "c", "cooldown"), (3, "odd", "filler"), (4, "f", "filler"), (4, "c", "cooldown")], "candidate long, key string, category string")
    catalogue = spark.createDataFrame([("h", "heal"), ("f", "damage"), ("c", "damage")], "key string, classification string")
    ask = lambda most: {r["candidate"]: r["valid"] for r in rules.candidate_validity(candidates, actions, catalogue, most).collect()}
    assert ask(20) == {1: True, 2: False, 3: False, 4: True, 5: False} and ask(1)[4] is False


def test_first_usable_goes_by_cost_cooldown_and_catalogue(spark):
    state = "1 AS snapshot, map() AS debuffs, map() AS buffs, map('nova', 900d) AS cooldowns, map('rage', 30d) AS resources, map() AS max_resources, 500d AS time_ms, 1500d AS gcd_ms, 20d AS health_pct, 2 AS enemies"
    actions = spark.createDataFrame([("nova", "", 1, {}, True), ("slam", "", 2, {"rage": 40.0}, True), ("gone", "", 3, {}, False), ("odd", "moon.phase", 4, {}, True), ("hit", "rage>=10", 5, {"rage": 20.0}, True)], "key string, condition string, priority int, costs map<string,double>, known boolean")
    got = rules.first_usable(spark.sql(f"SELECT {state}"), actions).first()
    assert (got["action"], got["unsupported"]) == ("hit", 1)


def test_roles(spark):
    rows = [("a", "Shield Wall", "Block and parry. Damage taken is less.", ["tank"] * 1), ("b", "Mend", "Healing allies, heals the raid", ["heal", "hot"]), ("c", "Archery", "archers shoot bolts, a shot", ["ranged"])]
    got = {r["k"]: r for r in score.role_scores(spark.createDataFrame(rows, "k string, name string, text string, tags array<string>"), "k", "text", "tags", "name").collect()}
    assert (got["a"]["tank"], got["b"]["healer"], got["c"]["ranged_dps"]) == (6.0, 6 + 2 + 1 + 1 + 1, 2.4 + 2 + 1 + 1)
    scores = spark.createDataFrame([("t", 0.0, 0.0, 0.0, 20.0, 25.0, 0.0), ("h", 0.0, 0.0, 0.0, 19.0, 24.0, 20.0), ("s", 0.0, 0.0, 0.0, 0.0, 21.0, 22.0), ("d", 1.0, 2.0, 0.0, 9.0, 0.0, 0.0)], "k string, melee_dps double, caster_dps double, ranged_dps double, tank double, healer double, support double")
    got = {r["k"]: (r["role"], r["confidence"]) for r in score.infer_role(scores, "k").collect()}
    assert got == {"t": ("tank", "medium"), "h": ("healer", "medium"), "s": ("support", "medium"), "d": ("caster_dps", "low")}


def test_distances(spark):
    builds_ = spark.createDataFrame([(1, "melee_dps"), (2, "melee_dps"), (3, "healer")], "build long, role string")
    nodes = spark.createDataFrame(
        [(1, 1, "Venom Bite", "periodic", ["Melee"], ["nature"], ["energy"], False), (2, 1, "Venom Bite", "periodic", ["Melee"], ["nature"], ["energy"], False), (3, 2, "Mend", "heals", ["heal"], ["holy"], [], True)],
        "build long, node long, name string, text string, tags array<string>, schools array<string>, resources array<string>, passive boolean",
    )
    actions = spark.createDataFrame([(1, "bite", "Venom Bite", "builder", 1, 1), (2, "bite", "Venom Bite", "builder", 1, 1), (3, "mend", "Mend", "healing", 2, 1)], "build long, key string, name string, category string, node long, priority int")
    p = similarity.fingerprints(builds_, nodes, actions)
    got = {r["build"]: r for r in p.collect()}
    assert got[1]["primary"] == ["dot", "melee", "poison"] and got[1]["label"] == "poison DoT loop" and (got[1]["dots"], got[1]["melee"]) == (2.0, 2.0)
    assert got[3]["names"] == ["Mend"] and got[3]["passive_ratio"] == 1.0 and got[3]["heals"] == 2.0
    pair = lambda x, y: p.filter(f"build = {x}").alias("a").join(p.filter(f"build = {y}").alias("b"))
    assert pair(1, 2).select(similarity.distance("a", "b")).first()[0] == 0.0
    # all five sets apart; passive ratio and dots differ of four numbers, melee and helping of four for the role
    assert pair(1, 3).select(similarity.distance("a", "b")).first()[0] == pytest.approx(0.30 + 0.25 + 0.15 + 0.10 + 0.10 * 2 / 4 + 0.10 * 2 / 4)
    s = similarity.signatures(builds_, actions)
    both = s.filter("build = 1").alias("a").join(s.filter("build = 3").alias("b"))
    assert both.select(similarity.signature_distance("a", "b")).first()[0] == pytest.approx(0.35 + 0.15 + 0.05 + 0.10 / 3 + 0.05, abs=1e-4)


def test_mechanics(spark):
    rows = [
        (1, "Deals 12 fire damage every 3 sec for 12 sec. Costs 30 energy, costs 5 Rage.", ["x"], [], ["Energy"]),
        (2, "Heals all allies for 7.5 over 2 seconds. 20 sec cooldown", [], ["holy"], []),
        (3, "Increases armor", ["cooldown"], [], []),
        (4, "10% chance, once every 45 sec. 2 charges on up to 3 enemies", [], [], []),
        (5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>, schools array<string>, resources array<string>")
    got = {r["id"]: r for r in mechanics.infer_mechanics(df, spark.createDataFrame([(3, "buff2", 9)], "id long, kind string, charges int")).collect()}
    assert (got[1]["kind"], got[1]["school"], got[1]["costs"], got[1]["effect"]["amount"], got[1]["effect"]["tags"]) == ("debuff", "fire", {"Energy": 30.0, "Rage": 5.0}, 12.0, ["x", "dot"])
    assert (got[2]["effect"]["effect_type"], got[2]["effect"]["amount"], got[2]["duration_ms"], got[2]["cooldown_ms"], got[2]["school"]) == ("heal", 7.5, 2000, 20000, "holy")
    assert (got[3]["kind"], got[3]["charges"], got[3]["effect"]["target"]) == ("buff2", 9, "self")
    assert (got[4]["chance"], got[4]["internal_cooldown_ms"], got[4]["charges"], got[4]["max_targets"], got[4]["confidence"], got[4]["effect"]) == (0.1, 45000, 2, 3, "medium", None)
    assert (got[5]["kind"], got[5]["confidence"], got[5]["costs"]) == ("ability", "low", {})


def test_tooltips_and_enrichment(spark):
    nodes = spark.createDataFrame([(1, 10, "A & B", "own"), (2, 11, "C", ""), (3, None, "D", "x<y")], "node long, spell long, name string, text string")
    fetched = spark.createDataFrame([(10, "matched", "tip", '<b onclick="x">hi</b><a href="javascript:1">z</a>', True), (11, "failed", "t", "h", False)], "spell long, status string, tooltip_text string, tooltip_html string, name_match boolean")
    got = {r["node"]: r for r in enrichment.choose_tooltip(nodes, fetched).collect()}
    assert (got[1]["html"], got[1]["confidence"], got[1]["source"]) == ("<strong>A &amp; B</strong><div><b>hi</b>z</div>", "high", "fetched")
    assert (got[2]["text"], got[2]["confidence"], got[3]["tooltip_id"], got[3]["html"]) == ("C", "low", "entry:3", "<strong>D</strong><div>x&lt;y</div>")
    entries = spark.createDataFrame([(1, 10, "A-b"), (2, 10, "Other"), (3, 12, "C")], "entry long, spell long, name string")
    side = spark.createDataFrame([(10, "OTHER!", "matched", 5), (12, "D", "matched", None)], "spell long, name string, status string, tooltip_level int")
    rows = enrichment.enrichment_rows(entries, side)
    assert {r["spell"]: (r["entry"], r["name_match"]) for r in rows.collect()} == {10: (2, True), 12: (3, False)}
    one = enrichment.enrichment_summary(rows).first()
    assert (one["ids"], one["statuses"], one["name_mismatches"], one["with_level"]) == (2, {"matched": 2}, 1, 1)
    client = spark.createDataFrame([(10, "other", 3)], "spell long, name string, cast_ms int")
    wide = enrichment.three_sources(entries, side, client)
    assert {r["spell"]: (r["fetched_usable"], r["reference"]) for r in wide.collect()} == {10: (True, "other"), 12: (False, "C")}
    level = {r["spell"]: (r["value"], r["source"], r["ineligible"]) for r in enrichment.single_source(wide, "name").collect()}
    assert level == {10: ("OTHER!", "fetched", None), 12: (None, None, "db_identity_mismatch")}


def test_stat_totals(spark):
    items = spark.createDataFrame([(1, {"str": 5.0, "haste": 1.0}, {"haste": 3.0}, 10.0, None), (1, {"str": 2.0}, {}, None, 4.0)], "g long, stats map<string,double>, ratings map<string,double>, spell_power double, attack_power double")
    assert {r["stat"]: r["total"] for r in enrichment.stat_totals(items, ["g"]).collect()} == {"str": 7.0, "haste": 3.0, "spell_power": 10.0, "attack_power": 4.0}


def test_shapes(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x  y"}',), ('{"a": null, "c": [1]}',), ("[1]",), ("bad",), (None,)], "j string")
    assert [(r["key"], r["n"]) for r in shapes.key_histogram(df, "j").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert {(r["key"], r["kind"], r["sample"]) for r in shapes.json_shape(df, "j").collect()} >= {("a", "number", "1"), ("a", "null", None), ("c", "array", "[1]"), ("b", "string", "x y")}


def test_rule_tables(spark):
    r = spark.createDataFrame([("p", "a", "filler", "high", "1", "", {"tags_any": "x"}), ("p", "b", "odd", "sure", "one", "none", {"moon": "x"}), ("p", "c", None, None, None, "t", None)], "profile string, rule string, category string, confidence string, priority string, template string, match map<string,string>")
    t = spark.createDataFrame([("p", "t")], "profile string, template string")
    b = spark.createDataFrame([("p", "aoe", ["filler"]), ("p", "raid", ["odd"])], "profile string, encounter string, categories array<string>")
    e = spark.createDataFrame([("p", "aoe")], "profile string, encounter string")
    got = {(x["id"], x["code"]) for x in rules.rule_faults(r, t, b, e).collect()}
    assert got == {("b", c) for c in ("invalid_category", "invalid_confidence", "priority_not_numeric", "unknown_template", "unsupported_operator")} | {("c", "invalid_category"), ("raid", "unsupported_encounter"), ("raid", "unknown_branch_category")}


def test_warnings_once_in_order(spark):
    df = spark.sql("SELECT array('b', 'a', 'b') AS x, array('c', 'a') AS y, CAST(NULL AS array<string>) AS z")
    assert df.select(report.ordered_distinct(F.col("x"), F.col("z"), F.col("y"))).first()[0] == ["b", "a", "c"]


@pytest.mark.parametrize(("html", "want"), [
    ('<SPAN onclick="x()" class="q2">hi</SPAN>', '<span class="q2">hi</span>'), ('<a href="javascript:x">z</a>', "z"), ("a < b", "a < b"), ("<script>alert(1)</script>t", "t"), ('<td style="x" colspan=2>', "<td>"), (None, ""), ("<unk>x<br/>", "x<br>"),
])
def test_safe_html(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(safe_html(F.col("h"))).first()[0] == want


def test_tag_rules_match_their_patterns(spark):
    """Substring searches and guarded expressions against the patterns themselves, on texts made of the rules' own words."""
    import random
    import re

    from tessera.functions import text as tx

    rng, patterns = random.Random(5), [*tx.TAG_RULES.values(), *tx.SCHOOL_RULES.values(), *tx.RESOURCE_RULES.values(), *(p for ps in tx.MECHANIC_RULES.values() for p in ps)]
    words = [w for p in patterns for w in re.findall(r"[A-Za-z%0-9-]+", p.replace(r"\b", " ").replace(r"\s", " ").replace(r"\d", " 7 "))] + ["over 7", "every 3 sec", "é", "\n", "health", "mana", "x", "restores", "of the"]
    glue = [" ", " ", " ", "", "s ", "_", "é", "\n", "  "]
    texts = ["".join(rng.choice((str.lower, str.upper, str.title, str))(rng.choice(words)) + rng.choice(glue) for _ in range(rng.randrange(0, 6))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("v", tx.folded(F.col("t")))
    got = {r["i"]: r["m"] for r in df.select("i", F.array(*[tx.holds(F.col("v"), p) for p in patterns]).alias("m")).collect()}
    for i, t in enumerate(texts):
        # Case folding of the patterns is that of ASCII letters.
        assert got[i] == [bool(re.search(p, t, re.IGNORECASE | re.ASCII)) for p in patterns], repr(t)


def test_marked_sessions(spark):
    import datetime as dt

    from tessera.operators import events

    rows = [(i, 1, dt.datetime(2024, 1, 1, 0, i), k) for i, k in enumerate(["hit", "start", "hit", "stop", "hit", "start", "hit"])]
    df = spark.createDataFrame(rows, "event_id long, player long, ts timestamp, ability string")
    got = events.marked_sessions(df, F.col("ability") == "start", F.col("ability") == "stop").collect()
    assert sorted((r["event_id"], r["session"]) for r in got) == [(1, 1), (2, 1), (5, 2), (6, 2)]
