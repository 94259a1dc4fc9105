"""The report: catalogues of parts as nodes, brands and types as scopes; search, actions, gear, sections and the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import engine_role
from tessera.operators import builds as bd
from tessera.operators import report, rules, score
from tessera.operators import spec_report as sr
from tessera.plans.catalogue_queries import ACTIONS_SQL, BUILDS_SQL, MEMBERS_SQL, NODES_SQL, PLAYSTYLE_ROWS, PRINTS_SQL, RELIABILITY_SQL, SIGNATURE_SQL, build_actions, diverse_sql, order_builds, part_nodes, pick, role_sql
from tessera.plans.common import table
from tessera.session import shared_path

CATEGORIES = ["maintenance", "cooldown", "builder", "spender", "filler", "utility", "execute"]
#: Rules with all the operators there are: the match, as columns, and what it makes.
RULES = [
    {"rule": "dots", "category": "maintenance", "priority": 10.0, "confidence": "high", "template": "dot.{action_key}.remains<gcd", "tags_any": ["dot", "bleed"], "active_only": True},
    {"rule": "heals", "category": "utility", "priority": 20.0, "confidence": "medium", "template": "", "tags_all": ["heal"], "text_any": [r"OVER \d+ SEC", "nothing of it"]},
    {"rule": "frost", "category": "builder", "priority": 30.0, "confidence": "medium", "template": "", "schools_any": ["frost"], "rank_least": 1},
    {"rule": "still", "category": "filler", "priority": 40.0, "confidence": "medium", "template": "", "resources_any": ["energy"], "passive_only": True},
    {"rule": "names", "category": "spender", "priority": 50.0, "confidence": "medium", "template": "energy>=20", "name_any": ["RED", "bolt"]},
    {"rule": "types", "category": "cooldown", "priority": 60.0, "confidence": "low", "template": "cooldown.{action_key}.ready", "types_in": ["PROMO", "ECONOMY"], "kinds_in": ["talent"], "active_only": True},
    {"rule": "any", "category": "filler", "priority": 90.0, "confidence": "low", "template": "", "active_only": True},
    {"rule": "never", "category": "execute", "priority": 1.0, "confidence": "high", "template": "", "tags_any": []},
    {"rule": "elsewhere", "category": "precombat", "priority": 1.0, "confidence": "high", "template": ""},
]
RULE_SCHEMA = (
    "rule string, category string, priority double, confidence string, template string, place int, tags_any array<string>, tags_all array<string>, schools_any array<string>, resources_any array<string>,"
    " types_in array<string>, kinds_in array<string>, name_any array<string>, text_any array<string>, active_only boolean, passive_only boolean, rank_least int"
)
EFFORT = sr.Effort(top=2, beam=5, branch=10, rounds=3, least_fraction=0.7)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("node")
    n = part_nodes(spark, sf_dir).withColumns({"type": F.col("tab"), "kind": F.when(k % 2 == 1, "talent").otherwise("ability"), "rank": (k % 3).cast("int"), "availability": F.when(k % 7 != 0, F.col("level"))})
    return n.withColumn("tab", F.when(k % 11 == 0, "Class").otherwise(F.col("tab")))


def _scopes(nodes: DataFrame) -> DataFrame:
    """Every class and own tab once, with an encounter; a part of the roles is configured."""
    s = report.scopes(nodes, ["single"], "Class")
    low = F.endswith("cls", F.lit("7"))
    return s.select(F.concat_ws("|", "cls", "tab").alias("scope"), "cls", "tab", "encounter", F.when(low, 60).otherwise(45).alias("level"), F.lit(4).alias("max_ae"), F.lit(3).alias("max_te"), F.when(F.endswith("cls", F.lit("3")), "tank").otherwise("auto").alias("configured"))


def _catalogue(spark: SparkSession, sf_dir: str) -> sr.Catalogue:
    nodes = _nodes(spark, sf_dir)
    parts = table(spark, sf_dir, "part")
    tabs = parts.groupBy(F.col("p_type").alias("key")).agg((F.max("p_size") % 7).cast("double").alias("weight")).withColumn("kind", F.lit("tab"))
    tags = spark.createDataFrame([("tag", "dot", 3.0), ("tag", "heal", 2.0), ("tag", "tank", 1.5), ("tag", "melee", 2.5), ("tag", "aura", -1.0), ("named", "red", 0.5)], "kind string, key string, weight double")
    sets = parts.agg(F.array(F.min("p_name"), F.max("p_name")).alias("names")).withColumn("weight", F.lit(1.5))
    items = parts.filter("p_size > 25").select(
        F.col("p_partkey").alias("item"), F.lower("p_type").alias("weapon_type"), F.lit("").alias("armor_type"), F.when(F.col("p_partkey") % 50 == 0, "low").otherwise("medium").alias("confidence"), F.create_map(F.lit("armor"), F.col("p_size").cast("double")).alias("stats")
    )
    stats = spark.createDataFrame([("tank", "armor", 2.8), ("tank", "stamina", 3.0), ("dps", "armor", 0.5), ("healer_support", "armor", 0.25)], "role string, stat string, weight double")
    watch = spark.createDataFrame([("high", "Brand#5", "*", "*_dps"), ("low", "*", "promo", "*"), ("low", "brand#9", "*", "TANK")], "severity string, cls_pattern string, tab_pattern string, role_pattern string")
    listed = spark.createDataFrame([{**dict.fromkeys(f.split()[0] for f in RULE_SCHEMA.split(",")), **r, "place": i} for i, r in enumerate(RULES)], RULE_SCHEMA)
    needs = nodes.filter("node % 3 = 0").select("node", (F.col("node") + 1).alias("required"))
    return sr.Catalogue(nodes, needs, tabs.unionByName(tags), sets, listed, items, stats, watch)


CATALOGUE = f"""{NODES_SQL.replace("pn AS (", "p0 AS (", 1)}, pn AS (SELECT * EXCLUDE (tab), CASE WHEN node % 11 = 0 THEN 'Class' ELSE tab END AS tab, tab AS type, node % 3 AS rank FROM p0),
sc AS (SELECT DISTINCT cls || '|' || tab AS scope, cls, tab, CASE WHEN ends_with(cls, '7') THEN 60 ELSE 45 END AS level, ends_with(cls, '3') AS is_set FROM pn WHERE tab <> 'Class'),
eg AS (SELECT sc.scope, pn.node, ae, te, (ae + te)::DOUBLE AS score FROM pn JOIN sc ON pn.cls = sc.cls AND (pn.tab = sc.tab OR pn.tab = 'Class') AND pn.level <= sc.level WHERE ae + te > 0)"""


def search_sql(rounds: int = EFFORT.rounds, branch: int = EFFORT.branch, beam: int = EFFORT.beam, ae: int = 4, te: int = 3) -> str:
    """CTEs of the search, a pair for each round: what it grows, and what of it grows on."""
    best = "QUALIFY row_number() OVER (PARTITION BY scope ORDER BY spend + 0.01 * len(nodes) DESC, array_to_string(nodes, ',')) <= {0}"
    parts = [f"st0 AS (SELECT scope, []::BIGINT[] AS nodes, {ae} AS ael, {te} AS tel, 0 AS spend FROM sc)"]
    for r in range(1, rounds + 1):
        parts.append(
            f"gr{r} AS MATERIALIZED (SELECT DISTINCT scope, list_sort(list_append(nodes, node)) AS nodes, ael - ae AS ael, tel - te AS tel, spend + ae + te AS spend FROM (SELECT st{r - 1}.*, node, ae, te, row_number() OVER (PARTITION BY st{r - 1}.scope, nodes ORDER BY score DESC, node) AS b"
            f" FROM st{r - 1} JOIN eg ON eg.scope = st{r - 1}.scope AND ae <= ael AND te <= tel AND NOT list_contains(nodes, node) AND (node % 3 <> 0 OR list_contains(nodes, node + 1))) WHERE b <= {branch})"
        )
        parts.append(f"st{r} AS (SELECT * FROM gr{r} {best.format(beam)})")
    every = " UNION ALL ".join(f"SELECT scope, nodes, spend FROM {t}" for t in ["st0", *(f"gr{r}" for r in range(1, rounds + 1))])
    parts.append(f"al AS (SELECT *, spend >= {EFFORT.least_fraction} * {ae + te} AS met FROM ({every}))")
    parts.append(f"fd AS (SELECT scope, scope || '/' || array_to_string(nodes, ',') AS build, nodes, spend, reached FROM (SELECT *, bool_or(met) OVER (PARTITION BY scope) AS reached FROM al) WHERE met OR NOT reached {best.format(EFFORT.candidates)})")
    return ", ".join(parts)


SLUG = "trim(regexp_replace(replace(lower(name), '''', ''), '[^a-z0-9_]+', '_', 'g'), '_')"
MATCHES = f"""mt0 AS (SELECT node, name, tags, {SLUG} AS key, unnest(list_filter([
  CASE WHEN list_contains(tags, 'dot') AND NOT passive THEN {{'rule': 'dots', 'category': 'maintenance', 'priority': 10.0, 'confidence': 'high', 'condition': 'dot.' || {SLUG} || '.remains<gcd', 'ord': 2, 'named': ['dot'], 'pat': false}} END,
  CASE WHEN list_contains(tags, 'heal') AND regexp_matches(text, '(?i)over \\d+ sec') THEN {{'rule': 'heals', 'category': 'utility', 'priority': 20.0, 'confidence': 'medium', 'condition': '', 'ord': 9, 'named': ['heal'], 'pat': true}} END,
  CASE WHEN list_contains(schools, 'frost') AND rank >= 1 THEN {{'rule': 'frost', 'category': 'builder', 'priority': 30.0, 'confidence': 'medium', 'condition': '', 'ord': 7, 'named': [], 'pat': false}} END,
  CASE WHEN list_contains(resources, 'energy') AND passive THEN {{'rule': 'still', 'category': 'filler', 'priority': 40.0, 'confidence': 'medium', 'condition': '', 'ord': 8, 'named': [], 'pat': false}} END,
  CASE WHEN contains(lower(name), 'red') OR contains(lower(name), 'bolt') THEN {{'rule': 'names', 'category': 'spender', 'priority': 50.0, 'confidence': 'medium', 'condition': 'energy>=20', 'ord': 6, 'named': [], 'pat': false}} END,
  CASE WHEN type IN ('PROMO', 'ECONOMY') AND node % 2 = 1 AND NOT passive THEN {{'rule': 'types', 'category': 'cooldown', 'priority': 60.0, 'confidence': 'low', 'condition': 'cooldown.' || {SLUG} || '.ready', 'ord': 3, 'named': [], 'pat': false}} END,
  CASE WHEN NOT passive THEN {{'rule': 'any', 'category': 'filler', 'priority': 90.0, 'confidence': 'low', 'condition': '', 'ord': 8, 'named': [], 'pat': false}} END], lambda x: x IS NOT NULL)) AS r FROM pn),
ma AS (SELECT node, name, key, r.*, list_concat(list_transform(list_reverse(list_filter(tags, lambda t: list_contains(r.named, t))), lambda t: 'tag:' || t), ['profile_rule:' || r.rule]) AS evidence, len(tags) > 0 OR r.pat AS inferred,
  list_position(['dots', 'heals', 'frost', 'still', 'names', 'types', 'any'], r.rule) AS rp FROM mt0)"""
KEPT = """am AS (SELECT build, ma.* FROM mb JOIN ma USING (node)), as0 AS (SELECT *, max((category <> 'filler')::INT) OVER (PARTITION BY build, key) AS s FROM am),
ac AS (SELECT * FROM as0 WHERE NOT (category = 'filler' AND s = 1) QUALIFY row_number() OVER (PARTITION BY build, key, condition, category ORDER BY priority, ord, name, rp, node) = 1)"""
TOLD = """tw AS (SELECT build, list_filter([CASE WHEN (SELECT bool_or(inferred) FROM am WHERE am.build = b.build) THEN 'condition inferred from normalized tooltip tags' END,
  """ + ", ".join(f"CASE WHEN NOT EXISTS (SELECT 1 FROM ac WHERE ac.build = b.build AND category = '{c}') THEN 'no action matched category:{c}' END" for c in CATEGORIES) + """,
  CASE WHEN n > 0 AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.build = b.build AND category = 'filler') THEN 'selected build has active nodes but no filler action' END], lambda x: x IS NOT NULL) AS told FROM {0} b)"""


def rule_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of every order's parts by rules with all operators, with their evidence."""
    catalogue = _catalogue(spark, sf_dir)
    actions, _ = sr.build_actions(_order_members(spark, sf_dir, catalogue), catalogue, _order_nodes(spark, sf_dir), CATEGORIES)
    return actions.select("build", "node", "key", "rule", "category", "condition", "priority", "confidence", F.array_join("evidence", ",").alias("evidence"))


def action_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = _catalogue(spark, sf_dir)
    _, told = sr.build_actions(_order_members(spark, sf_dir, catalogue), catalogue, _order_nodes(spark, sf_dir), CATEGORIES)
    return told.select("build", F.array_join("action_warnings", ";").alias("warnings"))


def _order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("build")).agg(F.collect_set("l_partkey").alias("nodes"))


def _order_members(spark: SparkSession, sf_dir: str, catalogue: sr.Catalogue) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("build"), F.col("l_partkey").alias("node")).distinct()
    return pairs.join(catalogue.nodes.select("node"), "node", "left_semi")


def build_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best builds of every scope after three rounds, and whether the budget could be spent."""
    nodes = _nodes(spark, sf_dir)
    return sr.found_builds(_catalogue(spark, sf_dir), _scopes(nodes), "Class", EFFORT).select("scope", "build", "spend", F.col("warning").isNotNull().alias("floor_missed"))


def gear_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gear for every guide role: from the large parts as items, and from the defaults."""
    c = _catalogue(spark, sf_dir)
    roles = table(spark, sf_dir, "nation").filter("n_nationkey < 6").select(pick(("melee_dps", "tank", "healer", "support", "caster_dps", "ranged_dps"), F.col("n_nationkey")).alias("role"))
    wanted = roles.withColumn("engine_role", engine_role(F.col("role")))
    none = c.items.filter(F.length("weapon_type") < 0)  # no item has a type of negative length
    both = score.gear_report(c.items, c.stats, wanted).withColumn("known", F.lit(True)).unionByName(score.gear_report(none, c.stats, wanted).withColumn("known", F.lit(False)))
    lists = [F.array_join(x, ",").alias(x) for x in ("best_weapon_types", "best_armor_types", "available_weapon_types", "available_armor_types", "gear_warnings")]
    items = F.array_join(F.transform("item_scores", lambda i: F.concat_ws(":", i["item"].cast("string"), F.format_string("%.3f", i["score"]))), ",")
    return both.select("role", "known", *lists, F.coalesce(items, F.lit("")).alias("items"), F.coalesce(F.array_join("stat_priority", ","), F.lit("")).alias("stats"), "gear_source", "gear_confidence")


def _gear_sql() -> str:
    best = lambda place: "CASE role " + " ".join(f"WHEN '{r}' THEN '{','.join(kinds[place])}'" for r, kinds in score.GUIDE_GEAR.items()) + " END"
    engine = "CASE WHEN ends_with(role, '_dps') THEN 'dps' WHEN role = 'tank' THEN 'tank' ELSE 'healer_support' END"
    return f"""WITH r AS (SELECT unnest(['melee_dps', 'tank', 'healer', 'support', 'caster_dps', 'ranged_dps']) AS role, unnest([false, true]) IS NULL AS x), g AS (SELECT DISTINCT role FROM r WHERE role IS NOT NULL), w AS (SELECT role, known, CASE {engine} WHEN 'dps' THEN 0.5 WHEN 'tank' THEN 2.8 ELSE 0.25 END AS w FROM g, (VALUES (true), (false)) v(known)),
i AS (SELECT role, known, p_partkey AS item, round(p_size * w, 3) AS s, row_number() OVER (PARTITION BY role ORDER BY p_size * w DESC, p_partkey DESC) AS place FROM w JOIN part ON p_size > 25 WHERE known QUALIFY place <= 10),
l AS (SELECT role, string_agg(item || ':' || printf('%.3f', s), ',' ORDER BY place) AS items FROM i GROUP BY role), t AS (SELECT string_agg(DISTINCT lower(p_type), ',' ORDER BY lower(p_type)) AS types, bool_or(p_partkey % 50 = 0) AS low FROM part WHERE p_size > 25)
SELECT w.role, known, {best(0).replace('role', 'w.role', 1)} AS best_weapon_types, {best(1).replace('role', 'w.role', 1)} AS best_armor_types, CASE WHEN known THEN types ELSE {best(2).replace('role', 'w.role', 1)} END AS available_weapon_types, {best(3).replace('role', 'w.role', 1)} AS available_armor_types,
  CASE WHEN NOT known THEN 'item_data_missing,gear_targets_from_role_defaults' WHEN low THEN 'item_data_low_confidence' ELSE '' END AS gear_warnings, CASE WHEN known THEN items ELSE '' END AS items, CASE w.role WHEN 'tank' THEN 'stamina,armor' ELSE '' END AS stats, CASE WHEN known THEN 'mixed' ELSE 'defaults' END AS gear_source, CASE WHEN known THEN 'medium' ELSE 'low' END AS gear_confidence
FROM w CROSS JOIN t LEFT JOIN l ON l.role = w.role"""


def usage_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of every order's rotation, by the categories of its actions and its role."""
    actions = build_actions(spark, sf_dir).join(order_builds(spark, sf_dir).select("build", "role"), "build")
    found = report.rotation_sections(actions.withColumns({"order": rules.category_place(F.col("category")), "condition": F.when(F.col("priority") > 25, F.concat(F.lit("rage>="), F.col("priority").cast("string")))}))
    return found.select("build", "at", "section", F.array_join(F.transform("actions", lambda a: F.concat_ws("|", a["name"], a["condition"], a["confidence"])), ";").alias("actions"))


SECTION_SQL = """CASE WHEN category = 'maintenance' THEN 'maintenance' WHEN category = 'cooldown' THEN 'cooldowns' WHEN category IN ('builder', 'spender', 'filler', 'execute', 'aoe') THEN 'builder_spender' WHEN category = 'utility' OR role IN ('tank', 'healer', 'support') THEN 'defensive_support' ELSE 'opener' END"""
PLACE_SQL = "list_position(['opener', 'maintenance', 'cooldowns', 'builder_spender', 'defensive_support'], section)"
ORDER_SQL = "coalesce(nullif(list_position(['precombat', 'maintenance', 'cooldown', 'execute', 'aoe', 'spender', 'builder', 'filler', 'utility'], category), 0), 999)"
SECTIONS_SQL = f"""WITH {MEMBERS_SQL}, {BUILDS_SQL}, {ACTIONS_SQL}, s AS (SELECT ac.*, {SECTION_SQL} AS section, {ORDER_SQL} AS o FROM ac JOIN bu ON bu.build = ac.build)
SELECT build, {PLACE_SQL}::INT AS at, section, string_agg(name || '|' || CASE WHEN priority > 25 THEN 'rage>=' || priority ELSE '' END || '|' || confidence, ';' ORDER BY priority, o, name, key) AS actions FROM s GROUP BY ALL"""


def loop_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a guide says of every order's rotation, one line per list."""
    said = report.loop_sentences(build_actions(spark, sf_dir))
    return said.select("build", *[F.array_join(c, " ").alias(c) for c in ("opener", "core_loop", "cooldowns")])


def guide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority lines with notes, and the guide's sentence, of every part as an action of some section."""
    k, z = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(k.alias("node"), F.concat(F.lit("k"), k.cast("string")).alias("key"), F.when(z % 3 == 0, F.concat(F.lit("rage>="), z.cast("string"))).alias("condition"), F.when(k % 4 == 0, F.array(F.col("p_type"), F.lit("unused"))).otherwise(F.array().cast("array<string>")).alias("notes"), "p_name", pick((*report.SENTENCES, "other"), k % 10).alias("section"))
    return report.priority_lines(rows).select("node", "line", report.rule_sentence(F.col("section"), F.col("p_name"), F.col("condition")).alias("sentence"))


def _sentence_sql() -> str:
    every = " ".join(f"WHEN {i} THEN {_said(text, 'p_name')}" for i, text in enumerate(report.SENTENCES.values()))
    return f"CASE WHEN p_partkey % 10 = 2 AND p_size % 3 = 0 THEN {_said(report.KEEP_ACTIVE, 'p_name')} ELSE CASE p_partkey % 10 {every} ELSE {_said(report.ANY_SECTION, 'p_name')} END END"


def _said(text: str, name: str) -> str:
    before, after = text.split("{}")
    return f"'{before}' || {name} || '{after}'"


def _loop_sql() -> str:
    spoken = lambda x: f"CASE len({x}) WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2] ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"
    kinds, lines = ("maintenance", "cooldown", "builder", "spender", "filler"), report.LOOP_SENTENCES
    lists = ", ".join(f"coalesce(list(name ORDER BY p, k) FILTER (category = '{c}'), []) AS {c}" for c in kinds)
    both = "len(builder) > 0 AND len(spender) > 0"
    loop = [f"CASE WHEN len(maintenance) > 0 THEN {_said(lines['maintenance'], spoken('maintenance'))} END", f"CASE WHEN {both} THEN {_said(lines['both'][0], spoken('builder'))} END"]
    loop += [f"CASE WHEN {both} THEN {_said(lines['both'][1], spoken('spender'))} WHEN len(spender) > 0 THEN {_said(lines['spender'], spoken('spender'))} WHEN len(builder) > 0 THEN {_said(lines['builder'], spoken('builder'))} END", f"CASE WHEN len(filler) > 0 THEN {_said(lines['filler'], spoken('filler'))} END"]
    each = lambda text, x: f"array_to_string(list_transform({x}, lambda n: {_said(text, 'n')}), ' ')"
    return f"""WITH {MEMBERS_SQL}, {ACTIONS_SQL}, o AS (SELECT build, category, name, min((priority, key)).priority AS p, arg_min(key, (priority, key)) AS k FROM ac GROUP BY ALL), g AS (SELECT build, {lists} FROM o GROUP BY build)
SELECT build, {each(report.OPENER_SENTENCE, 'cooldown[1:2]')} AS opener, concat_ws(' ', {', '.join(loop)}) AS core_loop, {each(report.COOLDOWN_SENTENCE, 'cooldown')} AS cooldowns FROM g"""


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, sr.Catalogue, DataFrame]:
    catalogue = _catalogue(spark, sf_dir)
    scopes = _scopes(catalogue.nodes)
    built, found = sr.spec_builds(catalogue, scopes, "Class", CATEGORIES, EFFORT)
    return built, found, catalogue, scopes


def spec_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen builds of every scope with all that is said of them."""
    built = _report(spark, sf_dir)[0]
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s["section"], F.lit("="), F.array_join(F.transform(s["actions"], lambda a: a["name"]), "+"))), ";")
    return built.select(
        "scope", "place", "build", "role", "role_source", "engine_role", "objective_label", "index", "confidence", "low", "high", "reliability", "reliability_label", "trust_score", "trust", "playstyle", "gear_source",
        F.array_join("best_weapon_types", ",").alias("weapons"), F.array_join("warnings", ";").alias("warnings"), F.coalesce(F.array_join(F.transform("selected_nodes", lambda n: n["node"].cast("string")), ","), F.lit("")).alias("nodes"), F.coalesce(sections, F.lit("")).alias("sections"),
    )


def scope_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, found, catalogue, scopes = _report(spark, sf_dir)
    return sr.scope_results(built, found, scopes, catalogue.nodes, "Class").select("scope", "builds", "best_index", F.array_join("warnings", ",").alias("warnings"))


def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as nested documents, one per class, and read back: builds and the first line of each class."""
    built, found, catalogue, scopes = _report(spark, sf_dir)
    whole = sr.nested(built, sr.scope_results(built, found, scopes, catalogue.nodes, "Class"), scopes)
    path = shared_path(spark, "report")
    whole.write.json(path)
    read = spark.read.schema(whole.schema).json(path)
    specs = F.size("specs")
    return read.select("cls", specs.alias("n_specs"), F.aggregate("specs", F.lit(0).cast("long"), lambda acc, s: acc + s["n_builds"]).alias("n_builds"), F.array_join(F.transform("specs", lambda s: F.concat_ws(":", s["tab"], s["top_builds"][0]["build"])), ",").alias("best"))


CHOSEN = f"""{CATALOGUE}, {search_sql()}, mb AS (SELECT scope, build, unnest(nodes) AS node FROM fd), {MATCHES}, {KEPT}, {TOLD.format("(SELECT build, len(nodes) AS n FROM fd)")},
own AS (SELECT sc.scope, pn.* EXCLUDE (rank) FROM pn JOIN sc ON sc.cls = pn.cls AND sc.tab = pn.tab), {role_sql("own", "scope")},
ro2 AS (SELECT sc.scope, CASE WHEN is_set THEN 'tank' ELSE ri.role END AS role, CASE WHEN is_set THEN 'configured' ELSE 'inferred' END AS role_source, CASE WHEN is_set THEN 'high' ELSE ri.confidence END AS role_confidence FROM sc JOIN ri ON ri.scope = sc.scope),
tb AS (SELECT p_type AS tab, max(p_size) % 7 AS w FROM part GROUP BY 1), st AS (SELECT min(p_name) AS x, max(p_name) AS y FROM part),
nv AS (SELECT node, coalesce(w, 0) + CASE node % 6 WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 WHEN 3 THEN 2.5 WHEN 4 THEN -1.0 ELSE 0 END + CASE WHEN contains(lower(name || chr(10) || text), 'red') THEN 0.5 ELSE 0 END AS v, len(tags) = 0 AND len(schools) = 0 AND len(resources) = 0 AS bare FROM pn LEFT JOIN tb ON tb.tab = pn.tab),
ix AS (SELECT fd.build, round(100.0 + coalesce(sum(v), 0) + CASE WHEN (SELECT count(DISTINCT name) FROM mb JOIN pn USING (node) WHERE mb.build = fd.build AND name IN (SELECT unnest([x, y]) FROM st)) = 2 THEN 1.5 ELSE 0 END, 2)::DOUBLE AS score, count(*) FILTER (bare) > greatest(3, floor(count(mb.node) / 2)) AS lowc
  FROM fd LEFT JOIN mb ON mb.build = fd.build LEFT JOIN nv ON nv.node = mb.node GROUP BY fd.build),
bu AS (SELECT fd.build, fd.scope, role, score FROM fd JOIN ro2 ON ro2.scope = fd.scope JOIN ix ON ix.build = fd.build),
bn AS ({PRINTS_SQL.split("bn AS (", 1)[1].replace("SELECT * FROM mb JOIN pn USING (node)", "SELECT mb.build, pn.* FROM mb JOIN pn USING (node)", 1)}, {SIGNATURE_SQL},
{RELIABILITY_SQL.split(ACTIONS_SQL + ",", 1)[1].rsplit("SELECT build, score, CASE", 1)[0].strip().replace("n AS (", "rn AS (", 1).replace("a AS (SELECT build, count(*) AS n", "ra AS (SELECT build, count(*) AS n", 1).replace("x AS (", "rl AS (", 1).replace("LEFT JOIN n ON n.build", "LEFT JOIN rn ON rn.build").replace("LEFT JOIN a ON a.build", "LEFT JOIN ra ON ra.build").replace("low > a.n / 2", "low > ra.n / 2").replace("CASE WHEN bu.build % 5 = 0 THEN 0.1", "CASE WHEN (SELECT bool_or(inferred) FROM am WHERE am.build = bu.build) THEN 0.1")},
{diverse_sql("(SELECT rl.score FROM rl WHERE rl.build = fp.build)", "EXISTS (SELECT 1 FROM ac WHERE ac.build = fp.build)")}"""
DETAILS = f"""{CHOSEN}, pl AS ({PLAYSTYLE_ROWS}),
d0 AS (SELECT dv.scope, dv.place::INT AS place, dv.build, ro2.role, role_source, role_confidence, ix.score AS index, lowc, rl.score AS reliability, told, sc.cls, sc.tab, fd.nodes, pl.label AS playstyle
  FROM dv JOIN ro2 ON ro2.scope = dv.scope JOIN ix ON ix.build = dv.build JOIN rl ON rl.build = dv.build JOIN tw ON tw.build = dv.build JOIN sc ON sc.scope = dv.scope JOIN fd ON fd.build = dv.build JOIN pl ON pl.build = dv.build),
d1 AS (SELECT *, CASE WHEN reliability >= 0.75 THEN 'high' WHEN reliability >= 0.5 THEN 'medium' ELSE 'low' END AS rlabel, CASE WHEN cls = 'Brand#5' AND ends_with(role, '_dps') THEN 'high' WHEN tab = 'PROMO' OR cls = 'Brand#9' AND role = 'tank' THEN 'low' END AS hit FROM d0),
d2 AS (SELECT *, round((0.65 * 0.2 + 0.85 * 0.3 + CASE rlabel WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.7 ELSE 0.45 END * 0.3 + CASE WHEN hit IS NULL THEN 1.0 WHEN hit = 'high' THEN 0.35 ELSE 0.55 END * 0.2), 6)::DOUBLE AS trust_score FROM d1),
se AS (SELECT build, section, string_agg(name, '+' ORDER BY priority, ord, name, key) AS names FROM (SELECT ac.*, {SECTION_SQL} AS section FROM ac JOIN bu ON bu.build = ac.build WHERE ac.build IN (SELECT build FROM dv)) GROUP BY ALL),
sl AS (SELECT build, string_agg(section || '=' || names, ';' ORDER BY {PLACE_SQL}) AS sections FROM se GROUP BY build), lowi AS (SELECT bool_or(p_partkey % 50 = 0) AS low FROM part WHERE p_size > 25)"""
GEAR_BEST = "CASE role " + " ".join(f"WHEN '{r}' THEN '{','.join(kinds[0])}'" for r, kinds in score.GUIDE_GEAR.items()) + " END"
SPREAD_SQL = "CASE WHEN lowc THEN 0.22 ELSE 0.14 END"
REPORT_SQL = f"""WITH RECURSIVE {DETAILS}
SELECT scope, place, d2.build, role, role_source, CASE WHEN ends_with(role, '_dps') THEN 'dps' WHEN role = 'tank' THEN 'tank' ELSE 'healer_support' END AS engine_role,
  CASE role WHEN 'healer' THEN 'Projected Healing Index' WHEN 'tank' THEN 'Projected Survival/Threat Index' WHEN 'support' THEN 'Projected Support Index' ELSE 'Projected Damage Index' END AS objective_label, index, CASE WHEN lowc THEN 'low' ELSE 'medium' END AS confidence,
  round(index * (1 - {SPREAD_SQL}), 2)::DOUBLE AS "low", round(index * (1 + {SPREAD_SQL}), 2)::DOUBLE AS high, reliability, rlabel AS reliability_label, trust_score, CASE WHEN trust_score >= 0.8 THEN 'high' WHEN trust_score >= 0.5 THEN 'medium' ELSE 'low' END AS trust, playstyle, 'mixed' AS gear_source, {GEAR_BEST} AS weapons,
  array_to_string(told, ';') || CASE WHEN lowi.low THEN CASE WHEN len(told) > 0 THEN ';' ELSE '' END || 'item_data_low_confidence' ELSE '' END AS warnings, array_to_string(nodes, ',') AS nodes, coalesce(sections, '') AS sections
FROM d2 CROSS JOIN lowi LEFT JOIN sl ON sl.build = d2.build"""
RESULTS = f"""{CHOSEN}, sr AS (SELECT sc.scope, cls, tab, count(dv.build) AS builds, max(ix.score) AS best_index, sc.level < 60 AND EXISTS (SELECT 1 FROM pn WHERE pn.cls = sc.cls AND tab = 'Class' AND node % 7 = 0) AS early, NOT coalesce((SELECT bool_and(reached) FROM fd WHERE fd.scope = sc.scope), true) AS missed
  FROM sc LEFT JOIN dv ON dv.scope = sc.scope LEFT JOIN ix ON ix.build = dv.build GROUP BY ALL)"""
SCOPE_RESULTS_SQL = f"""WITH RECURSIVE {RESULTS} SELECT scope, builds, best_index, array_to_string(list_filter([CASE WHEN early THEN 'class_pool_level_gating_incomplete,shared_class_level_gating_incomplete' END, CASE WHEN missed THEN 'budget_floor_unreachable_with_current_gates' END, CASE WHEN builds = 0 THEN 'no_valid_builds_found' END], lambda x: x IS NOT NULL), ',') AS warnings FROM sr"""
NESTED_SQL = f"""WITH RECURSIVE {RESULTS} SELECT cls, count(*)::INT AS n_specs, sum(builds)::BIGINT AS n_builds, string_agg(tab || ':' || dv.build, ',' ORDER BY tab) AS best FROM sr JOIN dv ON dv.scope = sr.scope AND place = 1 GROUP BY cls"""
ORDERS_SQL = f"""{CATALOGUE}, {MEMBERS_SQL.replace("FROM lineitem", "FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)")}, {MATCHES}, {KEPT}"""


QUERIES = {
    "build_search": (build_search, f"WITH RECURSIVE {CATALOGUE}, {search_sql()} SELECT scope, build, spend, NOT reached AS floor_missed FROM fd"),
    "rule_actions": (rule_actions, f"WITH {ORDERS_SQL} SELECT build, node, key, rule, category, condition, priority::DOUBLE AS priority, confidence, array_to_string(evidence, ',') AS evidence FROM ac"),
    "action_warnings": (action_warnings, f"WITH {ORDERS_SQL}, {TOLD.format('(SELECT l_orderkey AS build, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)')} SELECT build, array_to_string(told, ';') AS warnings FROM tw"),
    "gear_report": (gear_report, _gear_sql()),
    "usage_sections": (usage_sections, SECTIONS_SQL),
    "loop_sentences": (loop_sentences, _loop_sql().replace("min((priority, key)).priority AS p", "min(priority) AS p")),
    "guide_lines": (guide_lines, f"SELECT p_partkey AS node, 'actions+=/k' || p_partkey || CASE WHEN p_size % 3 = 0 THEN ',if=rage>=' || p_size ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '  # ' || p_type ELSE '' END AS line, {_sentence_sql()} AS sentence FROM part"),
    "spec_report": (spec_report, REPORT_SQL),
    "scope_results": (scope_results, SCOPE_RESULTS_SQL),
    "nested_report": (nested_report, NESTED_SQL),
}
