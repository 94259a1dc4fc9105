"""Operators on literal rows: edge cases, fixtures, order independence, stream against batch."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as vl
from tessera.operators import builds, discover, events, graph, reconcile, relational, rules, similarity
from tessera.sources import readers
from tessera.streaming.event_stream import run_available, session_metrics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("fn", "text", "expected"),
    [
        (tx.cooldown_ms, "1.5 min cooldown", 90000),
        (tx.cast_time_ms, "Instant", 0),
        (tx.cast_time_ms, "nothing", None),
        (tx.duration_ms, "lasts 8 sec", 8000),
        (tx.required_level, "Requires Level 12, Level 3", 12),
        (tx.level, None, None),
        (tx.range_yards, "30 yd range", 30.0),
    ],
)
def test_text_numbers(spark, fn, text, expected):
    assert one(spark, fn(F.lit(text).cast("string"))) == expected


def test_text_rules_take_ascii_boundaries(spark):
    assert one(spark, tx.detect(F.lit("A healing éfire strike"), tx.SCHOOL_RULES)) == ["fire"]
    assert one(spark, tx.detect(F.lit(None).cast("string"), tx.TAG_RULES)) == []


def test_costs_and_stats(spark):
    costs = one(spark, tx.power_costs(F.lit("Costs 20 Rage and more. Costs 5 Fill Level.")))
    assert [(c["amount"], c["resource"]) for c in costs] == [(20.0, "Rage"), (5.0, "Fill Level")]
    assert one(spark, tx.stats(F.lit("+5 Haste +7 haste +3 Attack Power"))) == {"haste": 7.0, "attack_power": 3.0}


@pytest.mark.parametrize(
    ("fn", "text", "expected"),
    [
        (tx.cooldown_ms, "x5 sec cooldown, 1.5.2 SECONDS  Cooldown", 5200),
        (tx.cooldown_ms, "5 secs cooldowns", None),
        (tx.duration_ms, "before 3 sec, over\n2 Minutes", 120000),
        (tx.period_ms, "every 2 min, every 0.5second", 500),
        (tx.range_yards, "9yds range 7.5yd range", 7.5),
        (tx.cast_time_ms, "instantly 3 sec cast", 3000),
        (tx.level, "xLevel 3 LEVEL 4", 4),
    ],
)
def test_words_and_numbers_are_whole(spark, fn, text, expected):
    assert one(spark, fn(F.lit(text))) == expected


def test_item_kinds(spark):
    assert tuple(one(spark, tx.item_kind(F.lit("Tone-hand sword, Off Hand Fist Weapon")))) == ("weapon", "fist_weapon", "off_hand")
    assert tuple(one(spark, tx.item_kind(F.lit("mail chests, plate legs")))) == ("armor", "plate", "legs")


def test_a_text_is_searched_once_a_pattern(spark, tmp_path):
    """And only the columns that the text is made of are told apart."""
    from tessera.plans import text_queries

    spark.createDataFrame([(1, 2, 3.0)], "l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = text_queries.text_extract(spark, str(tmp_path))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Critical Strike") == 1 and text.count("osts?") == 1
    assert [re.sub("#[0-9]+L?", "", line) for line in re.findall(r"Aggregate (\[.*?\])", text)] == ["[l_partkey, l_linenumber, l_quantity]"]


def test_safe_html(spark):
    assert one(spark, tx.safe_html(F.lit('<script>x</script><span class="q" onclick="y">a</span><blink>b</blink>'))) == '<span class="q">a</span>b'


def test_canonical_label(spark):
    assert one(spark, tx.canonical_label(F.lit("Ａ B"))) == "ab"


def test_values(spark):
    assert one(spark, vl.number(F.lit(" -1.5 "))) == -1.5
    assert one(spark, vl.number(F.lit("1e5"))) is None
    assert one(spark, vl.weakest(F.lit("high"), F.lit("low"))) == "low"
    assert one(spark, vl.weakest(F.lit("high"), F.lit("odd"))) is None
    assert one(spark, vl.unknown_bits(F.lit(129))) == 128


FIXTURE = [
    (100, "Class", 0, 0, 0, 0, 1, []),
    (101, "Class", 1, 0, 0, 0, 1, [100]),
    (102, "Damage", 0, 1, 0, 0, 3, []),
    (103, "Damage", 0, 1, 0, 2, 1, [102]),
]


def build_issues(spark, selected):
    nodes = spark.createDataFrame([(n, t, "Main", a, te, ga, gt, 0, m) for n, t, a, te, ga, gt, m, _ in FIXTURE], "node long, tab string, cls string, ae int, te int, tab_ae_gate int, tab_te_gate int, level int, max_rank int")
    needs = spark.createDataFrame([(n, r) for n, *_, req in FIXTURE for r in req], "node long, required long")
    free = spark.createDataFrame([(1, 100)], "build long, node long")
    b = spark.createDataFrame([(1, "Main", 60, 10, 10)], "build long, cls string, level int, max_ae int, max_te int")
    s = spark.createDataFrame([(1, n, r) for n, r in selected], "build long, node long, rank int")
    return {r["code"] for r in builds.validate(b, s, nodes, needs, free=free).collect()}


def test_build_fixture(spark):
    assert build_issues(spark, [(101, 1)]) == set()
    assert build_issues(spark, [(103, 1)]) == {"tab_te_gate_unmet", "required_node_missing"}
    assert build_issues(spark, [(102, 3), (103, 1)]) == set()
    assert "rank_above_maximum" in build_issues(spark, [(102, 4)])
    assert build_issues(spark, [(999, 1)]) == {"unknown_node"}


def test_reconcile_conflict_falls_to_the_next_tier(spark):
    t = reconcile.TIERS
    rows = [(1, "f", "a", t[0], "x", True, 1), (1, "f", "b", t[0], "y", True, 2), (1, "f", "c", t[2], "z", True, 3), (2, "f", "a", t[0], None, True, 1), (3, "f", "a", t[1], "0", True, 1)]
    schema = "key long, field string, source string, tier string, value string, eligible boolean, ordinal int"
    for some in (rows, rows[::-1]):
        got = {r["key"]: (r["value"], r["reason"]) for r in reconcile.reconcile(spark.createDataFrame(some, schema)).collect()}
        assert got == {1: ("z", "db_fallback"), 2: (None, "omitted_no_eligible_candidate"), 3: ("0", "only_candidate")}


def test_discovery_ignores_a_mostly_zero_decoy(spark):
    wide = spark.createDataFrame([(i, 0 if i < 190 else i, i * 3, i * 3 if i % 2 else 0) for i in range(200)], "id long, a long, b long, c long")
    cells = discover.unpivot(wide, "id", ["a", "b", "c"])
    known = wide.select(F.col("id").alias("row_id"), F.lit("f").alias("field"), F.col("b").alias("value"))
    best = discover.scalar_correlation(cells, known).first()
    assert (best["col"], best["score"], best["confidence"]) == (1, 1.0, "high")


def test_graph_fixpoints(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 3), (4, 5)], "src long, dst long")
    roots = spark.createDataFrame([(2,)], "node long")
    assert {r["node"]: r["distance"] for r in graph.reachable(edges, roots).collect()} == {2: 0, 3: 1, 4: 2, 5: 3}
    assert {r["node"] for r in graph.in_cycles(edges).collect()} == {3, 4, 5}
    long = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.reachable(long, spark.createDataFrame([(0,)], "node long")).count() == 71


def test_tab_reach_and_dependencies(spark):
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("b", 6)], "tab string, node long")
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 5)], "src long, dst long")
    needs = spark.createDataFrame([(2, 1), (3, 2), (4, 1), (5, 6), (6, 5), (2, 99)], "node long, required long")
    reach = graph.tab_reach(nodes, links, needs, ["tab"])
    assert {r["node"]: (r["root"], r["reached"]) for r in reach.collect()} == {1: (True, True), 2: (False, True), 3: (False, True), 4: (False, False), 5: (False, False), 6: (False, False)}
    assert {r["tab"]: (r["orphans"], r["fault"]) for r in graph.tab_faults(reach, ["tab"]).collect()} == {"a": (1, "orphan_nodes"), "b": (2, "no_root")}
    paid = spark.createDataFrame([(1,), (2,), (5,)], "node long")
    got = graph.dependency_closure(spark.createDataFrame([(3,), (6,)], "node long"), needs, paid)
    assert {r["node"] for r in got.collect()} == {1, 2, 3, 5, 6}


def test_free_closure(spark):
    free = spark.createDataFrame([(1, n) for n in (10, 11, 12, 13)], "build long, node long")
    needs = spark.createDataFrame([(11, 10), (12, 11), (13, 99)], "node long, required long")
    have = spark.createDataFrame([(1, 50)], "build long, node long")
    assert {r["node"] for r in graph.closure(free, needs, have).collect()} == {10, 11, 12}


def test_search_is_per_scope(spark):
    cand = spark.createDataFrame([("a", 1, 1, 0, 1, 1.0), ("a", 2, 1, 0, 1, 2.0), ("b", 3, 1, 0, 99, 1.0)], "scope string, node long, ae int, te int, level int, score double")
    needs = spark.createDataFrame([(2, 1)], "node long, required long")
    start = spark.createDataFrame([("", s, 10, 2, 0, [], 0) for s in "ab"], "state string, scope string, level int, ae_left int, te_left int, nodes array<long>, spend int")
    got = {r["scope"]: r["state"] for r in builds.search(start, cand, needs, rounds=3).collect()}
    assert got == {"a": "1,2", "b": ""}


def test_band_regimes(spark):
    rows = [("small", 100.0), ("small", 95.0), ("alone", 100.0), ("alone", 50.0), *(("large", 100.0 - i) for i in range(6))]
    got = {r["scope"]: (r["floor"], r["widened"]) for r in similarity.band_floor(spark.createDataFrame(rows, "scope string, score double"), "scope").collect()}
    assert got == {"small": (90.0, False), "alone": (88.0, True), "large": (95.0, False)}


def test_conditions(spark):
    state = "map('burn', 1000d) AS debuffs, map('haste', 0d) AS buffs, map() AS cooldowns, map('rage', 30d) AS resources, map('rage', 100d) AS max_resources, 0d AS time_ms, 1500d AS gcd_ms, 20d AS health_pct, 2 AS enemies"
    df = spark.sql(f"SELECT {state}, explode(array('', 'dot.burn.remains<gcd', 'buff.haste.down', 'rage>=31', 'rage.deficit>0', 'target.health.pct<21', 'active_enemies>=3', 'odd')) AS c")
    assert [r["x"] for r in df.select(rules.condition_holds(F.col("c")).alias("x")).collect()] == [True, True, True, False, True, True, False, None]


def test_overlay_and_dedupe(spark):
    layers = spark.createDataFrame([(1, "patch", "a"), (1, "patch-3", "b"), (1, "patch-x", "c"), (2, "patch", "d")], "k long, layer string, v string")
    got = {r["k"]: (r["v"], r["chain"]) for r in relational.overlay(layers, ["k"], "layer", vl.layer_key(F.col("layer"))).collect()}
    assert got == {1: ("c", "patch>patch-3>patch-x"), 2: ("d", "patch")}


def test_log_lines(spark):
    lines = [
        '1/2 03:04:05.678  SPELL_DAMAGE,0x1,"Ann",0x5,0x2,"Dummy",0xa,17,"Fire, Ball",0x4,100,40,4,0,0,0,1,nil,nil',
        '1/2 03:04:06.000  SWING_DAMAGE,0x1,"Ann",0x5,0x2,"Dummy",0xa,50,0,1,0,0,0,nil,nil,nil',
        "garbage",
        "",
    ]
    good, bad = readers.log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {r["ability"]: r for r in good.collect()}
    assert (rows["Fire, Ball"]["amount"], rows["Fire, Ball"]["critical"], rows["Swing"]["amount"]) == (100.0, True, 50.0)
    assert [r["line"] for r in bad.collect()] == ["garbage"]
    total = events.player_metrics(good).first()
    assert (total["total_damage"], round(total["active_time"], 3)) == (110.0, 0.322)


def test_json_rejects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n{"a": "x"}\n')
    (tmp_path / "y.jsonl").write_text('[1]\n{"a": 3, "more": 1}\n')
    good, bad = readers.json_lines(spark, str(tmp_path), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2, 3]
    got = sorted((r["file"][-7:], r["number"], r["line"], r["reason"]) for r in bad.collect())
    assert got == [("x.jsonl", 3, "not json", "not_a_json_object"), ("x.jsonl", 5, '{"a": "x"}', "wrong_type"), ("y.jsonl", 1, "[1]", "not_a_json_object")]


def test_json_rejects_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"a": {i}}}' if i % 37 else f"bad {i}" for i in range(1, 4001)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "5000")
    try:
        _, bad = readers.json_lines(spark, str(tmp_path), "a int")
        assert {(r["number"], r["line"]) for r in bad.collect()} == {(i, f"bad {i}") for i in range(37, 4001, 37)}
    finally:
        spark.conf.set(key, old)


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), p, "hit", "x", 1.0) for i, (m, p) in enumerate([(0, 1), (10, 1), (60, 1), (5, 2), (500, 3)])]
    schema = "event_id long, ts timestamp, player long, ability string, target string, amount double"
    df = spark.createDataFrame([*rows, rows[0]], schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = session_metrics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = run_available(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    closed = {(r["player"], r["session_window"]["start"]): r["events"] for r in got.collect()}
    batch = {(r["player"], r["started"]): r["events"] for r in events.sessions(df.dropDuplicates(["event_id"])).collect()}
    batch.pop((3, t0 + dt.timedelta(minutes=500)))  # still open at the watermark
    assert closed == batch


def test_stated_sides_are_checked(spark):
    assert relational.stated(spark.range(5), 5).count() == 5
    with pytest.raises(relational.TooManyRows):
        relational.stated(spark.range(6), 5)
