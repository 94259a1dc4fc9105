"""Scores from weight tables: weights, boosts and synergies are rows, so a new scoring is new data.

weights: kind (tab, tag, school, resource, named, regex), key, weight
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import clamp, per_minute, trust_label
from tessera.operators.relational import stated

# Role scoring. Per role: weights of tags, and patterns that are counted in names and texts, in lower case.
ROLE_TAGS = {
    "melee_dps": {"melee": 2.0, "builder": 1.0, "spender": 1.0},
    "caster_dps": {"dot": 1.5, "proc": 1.0},
    "ranged_dps": {"ranged": 2.4, "builder": 0.6, "spender": 0.6},
    "tank": {"tank": 3.0},
    "healer": {"heal": 3.0, "hot": 3.0},
    "support": {"aura": 3.0, "crowd_control": 1.5, "resource_management": 1.0},
}
ROLE_PATTERNS = {
    "melee_dps": [r"\bmelee\b", r"\bstrike\b", r"\bfang\b", r"\bblade\b"],
    "caster_dps": [r"\bspell\b", r"\bcast\b", r"\bshadow\b", r"\bnature\b", r"\bfire\b", r"\bfrost\b", r"\barcane\b"],
    "ranged_dps": [r"\branged\b", r"\bbow\b", r"\bgun\b", r"\bshot\b", r"\barrow\b", r"\barcher", r"\bbolt"],
    "tank": [r"\btank\b", r"\bthreat\b", r"\barmor\b", r"\bblock\b", r"\bparry\b", r"\bdodge\b", r"damage taken"],
    "healer": [r"\bheal", r"\bhealing\b", r"\bally\b", r"\ballies\b", r"\bparty\b", r"\braid\b"],
    "support": [r"\baura\b", r"\bbuff\b", r"\bdebuff\b", r"\bgroup\b", r"\ballies\b"],
}
OBJECTIVES = {
    "melee_dps": ("damage", "Projected Damage Index"),
    "ranged_dps": ("damage", "Projected Damage Index"),
    "caster_dps": ("damage", "Projected Damage Index"),
    "healer": ("healing", "Projected Healing Index"),
    "tank": ("survival_threat", "Projected Survival/Threat Index"),
    "support": ("support", "Projected Support Index"),
}
GEAR_DEFAULTS = {
    "dps": (["sword", "axe", "dagger", "bow", "gun", "staff"], ["leather", "mail", "plate", "cloth"]),
    "tank": (["shield", "sword", "mace", "axe"], ["plate", "mail"]),
    "healer_support": (["staff", "mace", "dagger"], ["cloth", "leather", "mail"]),
}
ROLE_CORE = {
    "tank": ["defensive", "cooldown", "utility", "filler"],
    "healer": ["heal", "maintenance", "cooldown", "utility"],
    "support": ["support", "utility", "maintenance", "cooldown"],
    "dps": ["builder", "spender", "filler", "maintenance", "cooldown"],
}
SPREAD = {"high": 8.0, "medium": 14.0, "low": 22.0}
TRUST_WEIGHTS = {"role": 0.2, "mechanics": 0.3, "rotation": 0.3, "watchlist": 0.2}


def merge_weights(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Key-wise replacement of weights."""
    both = base.join(overrides.withColumnRenamed("weight", "_o"), ["kind", "key"], "full_outer")
    return both.select("kind", "key", F.coalesce("_o", "weight").alias("weight"))


def node_components(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, kind, key, value) components; zero weights give none.

    Exact keys are an equi join on (kind, key). Named and regex boosts have no
    key to join on, so their few rows are a stated set that is tested against
    every text.
    """
    w = weights.filter("weight <> 0")
    arrays = {"tag": "tags", "school": "schools", "resource": "resources"}

    def tagged(kind: str, column: str) -> Column:
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    tab = F.array(F.struct(F.lit("tab").alias("kind"), F.col("tab").alias("key")))
    keys = F.array_distinct(F.concat(tab, *[tagged(kind, column) for kind, column in arrays.items()]))
    exact = nodes.select("node", F.explode(keys).alias("k")).select("node", "k.kind", "k.key").join(w.filter("kind IN ('tab', 'tag', 'school', 'resource')"), ["kind", "key"])
    texts = nodes.select("node", F.concat_ws("\n", "name", "text").alias("t"))
    boosts = stated(w.filter("kind IN ('named', 'regex')"))
    tested = texts.join(boosts, F.expr("(kind = 'named' AND contains(lower(t), lower(key))) OR (kind = 'regex' AND t RLIKE key)"))
    return exact.select("node", "kind", "key", F.col("weight").alias("value")).unionByName(tested.select("node", "kind", "key", F.col("weight").alias("value")))


def synergy_components(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(build, kind, key, value) for sets (names array, weight) all of whose names are in the build.

    Where sets have a ``kind`` (synergy or anti_synergy) the components have it.
    """
    kind = F.col("kind") if "kind" in sets.columns else F.lit("synergy")
    each = sets.withColumn("_kind", kind).withColumns({"_set": F.array_join(F.array_sort("names"), "+"), "_n": F.size(F.array_distinct("names"))}).withColumn("name", F.explode(F.array_distinct("names")))
    met = members.select("build", "name").distinct().join(each, "name").groupBy("build", "_kind", "_set", "_n", "weight").agg(F.count("*").alias("_m")).filter("_m = _n")
    return met.select("build", F.col("_kind").alias("kind"), F.col("_set").alias("key"), F.col("weight").alias("value"))


def build_index(components: DataFrame, builds: DataFrame, baseline: float = 100.0, base: str = "medium", own_profile: bool = False) -> DataFrame:
    """Index = baseline + sum of the components; confidence and its low, mid and high band.

    builds: build, nodes (count), bare (count of nodes without tags, schools and
    resources). ``base`` is the profile's confidence; that of a class's own
    profile stays high whatever its nodes are.
    """
    sums = components.groupBy("build").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("raw"))
    out = builds.join(sums, "build", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    many = F.col("bare") > F.greatest(F.lit(3), F.floor(F.col("nodes") / 2))
    confidence = F.lit("high") if base == "high" and own_profile else F.when(many, "low").otherwise(base if base in SPREAD else "medium")
    index = F.round(F.lit(baseline) + F.col("raw"), 2)
    spread = F.coalesce(*[F.when(confidence == name, F.lit(by / 100)) for name, by in SPREAD.items()])
    return out.select("build", index.alias("index"), confidence.alias("confidence"), F.round(index * (1 - spread), 2).alias("low"), index.alias("mid"), F.round(index * (1 + spread), 2).alias("high"))


def breakdown(components: DataFrame) -> DataFrame:
    """Per build a map of kind:key to the rounded sum."""
    each = components.groupBy("build", F.concat_ws(":", "kind", "key").alias("k")).agg(F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 2).alias("v"))
    return each.groupBy("build").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", F.format_string("%.2f", "v")))), ";").alias("breakdown"))


def contains_all(joined_names: Column, required: list[str]) -> Column:
    """The older synergy test: every name is somewhere in the joined names."""
    out = F.lit(True)
    for name in required:
        out = out & F.contains(F.lower(joined_names), F.lit(name.lower()))
    return out


#: Fixed value: what tells of several enemies in a description.
AREA = r"(?i)\bnearby|up to \d+|all enemies|cleave|area|enemies\b"


def legacy_node_scores(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``nodes`` with ``value``, the older score of each: its components, 4 for a square, 0.75 for a paid passive, 0.2 a rank up to three.

    nodes: node, node_type, passive, paid, max_rank
    """
    sums = components.groupBy("node").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("_sum"))
    own = F.when(F.col("node_type") == "SpendSquare", 4.0).otherwise(0.0) + F.when(F.col("passive") & F.col("paid"), 0.75).otherwise(0.0) + F.least("max_rank", F.lit(3)) * 0.2
    return nodes.join(sums, "node", "left").withColumn("value", F.round(F.coalesce("_sum", F.lit(0.0)) + own, 4)).drop("_sum")


def legacy_score(members: DataFrame, nodes: DataFrame, builds: DataFrame, synergies: list[tuple[list[str], float]] = ()) -> DataFrame:
    """(build, score): the nodes' values, named sets all of whose names occur, and the encounter's nudge.

    Of an ``aoe`` encounter 2 for each node with area wording, up to eight; of
    any other 1.25 off for each tank or hot node. members: build, node; nodes:
    node, name, text, tags, value; builds: build, encounter. The sets of names,
    with a bonus or a penalty, are a stated list.
    """
    n = nodes.select("node", "name", F.col("value").cast("decimal(18,4)").alias("value"), F.regexp_like("text", F.lit(AREA)).alias("area"), F.arrays_overlap("tags", F.array(F.lit("tank"), F.lit("hot"))).alias("dilutes"))
    sums = members.join(n, "node").groupBy("build").agg(
        F.sum("value").cast("double").alias("_sum"), F.count_if("area").alias("_area"), F.count_if("dilutes").alias("_dilutes"), F.array_join(F.array_sort(F.collect_list("name")), "\n").alias("_names")
    )
    nudge = F.when(F.col("encounter") == "aoe", 2.0 * F.least("_area", F.lit(8))).otherwise(-1.25 * F.col("_dilutes"))
    for names, bonus in synergies:
        every = F.lit(True)
        for name in names:
            every = every & F.contains("_names", F.lit(name))
        nudge = nudge + F.when(every, float(bonus)).otherwise(0.0)
    return builds.join(sums, "build").select("build", F.round(F.col("_sum") + nudge, 2).alias("score"))


def empirical_blend(scores: DataFrame, shares: DataFrame, blend: float) -> DataFrame:
    """Scores plus share of damage × 100 × blend where the name is in the log."""
    joined = scores.join(shares.select(F.lower("ability").alias("_a"), "share"), F.lower("name") == F.col("_a"), "left")
    return joined.withColumn("score", F.round(F.col("score") + F.coalesce("share", F.lit(0.0)) * 100 * blend, 4)).drop("_a", "share")


def role_scores(rows: DataFrame, key: str, text: str, tags: str, name: str | None = None) -> DataFrame:
    """Per key the score of each role: weighted tags, plus the patterns found in the names and texts in lower case.

    A pattern is only searched where its plain part occurs; a word boundary is
    one of ASCII letters, digits and the underscore.
    """
    value = F.lower(F.concat_ws(" ", *([F.col(name)] if name else []), F.coalesce(text, F.lit(""))))
    rows = rows.withColumn("_t", F.concat(F.lit(" "), value, F.lit(" ")))

    def found(pattern: str) -> Column:
        word = pattern.replace(r"\b", "")
        bounded = pattern.replace(r"\b" + word, "(?<![a-z0-9_])" + word).replace(word + r"\b", word + "(?![a-z0-9_])")
        return F.when(F.contains("_t", F.lit(word)), F.regexp_count("_t", F.lit(bounded))).otherwise(0)

    aggs = []
    for role, weights in ROLE_TAGS.items():
        tagged = sum((F.array_contains(tags, t).cast("double") * w for t, w in weights.items()), F.lit(0.0))
        words = sum((found(p) for p in ROLE_PATTERNS[role]), F.lit(0))
        aggs.append(F.round(F.sum((tagged + words).cast("decimal(18,2)")).cast("double"), 2).alias(role))
    return rows.groupBy(key).agg(*aggs)


def infer_role(scores: DataFrame, key: str) -> DataFrame:
    """(key, role, confidence, evidence): the strongest role, ties to the earlier one, with thresholds that put tank, healer and support first.

    The evidence is the three best scores, ties in role order.
    """
    roles = list(ROLE_TAGS)
    ranked = lambda names: F.array_sort(F.array(*[F.struct((-F.col(r)).alias("s"), F.lit(roles.index(r)).alias("i"), F.lit(r).alias("r")) for r in names]))
    top, dps = F.get(ranked(roles), 0)["r"], F.get(ranked(roles[:3]), 0)["r"]
    own = lambda role: F.coalesce(*[F.when(role == r, F.col(r)) for r in roles])
    # The thresholds.
    role = (
        F.when((F.col("tank") >= 20) & (F.col("tank") >= F.col("healer") - 5), "tank")
        .when((F.col("healer") >= 24) & (F.col("healer") >= F.col("support") + 4), "healer")
        .when((F.col("support") >= 22) & (F.col("support") > F.col("healer")), "support")
        .when(top.isin("tank", "healer", "support") & (own(top) < 10), dps)
        .otherwise(top)
    )
    evidence = F.array_join(F.transform(F.slice(ranked(roles), 1, 3), lambda x: F.concat_ws(":", x["r"], F.format_string("%.1f", -x["s"]))), ",")
    return scores.withColumn("role", role).select(key, "role", F.when(own(F.col("role")) >= 12, "medium").otherwise("low").alias("confidence"), evidence.alias("evidence"))


def objective(role: Column) -> Column:
    """Struct of id and label of what a role is measured by."""
    return F.coalesce(*[F.when(role == r, F.struct(F.lit(i).alias("id"), F.lit(n).alias("label"))) for r, (i, n) in OBJECTIVES.items()], F.struct(F.lit("damage").alias("id"), F.lit("Projected Damage Index").alias("label")))


def configured_role(rows: DataFrame) -> DataFrame:
    """``rows`` (configured, inferred_role, inferred_confidence) with role, role_source and role_confidence.

    ``auto`` takes what is inferred; a broad role takes it where it is of that
    kind, else its fallback; a guide role is taken as it stands; null otherwise.
    """
    wish, seen = F.col("configured"), F.col("inferred_role")
    inferred = (wish == "auto") | ((wish == "dps") & F.endswith(seen, F.lit("_dps"))) | ((wish == "healer_support") & seen.isin("healer", "support"))
    inferred = F.coalesce(inferred, F.lit(False))
    stated = F.when(wish == "dps", "melee_dps").when(wish == "healer_support", "healer").when(wish.isin(*ROLE_TAGS), wish)
    role = F.when(inferred, seen).otherwise(stated)
    source = F.when(inferred, "inferred").when(stated.isNotNull(), "configured")
    return rows.withColumns({"role": role, "role_source": source, "role_confidence": F.when(inferred, F.col("inferred_confidence")).when(stated.isNotNull(), "high")})


def item_scores(items: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """Items (item, role, stats map) by the weighted sum of their stats; the best k per role, of equal scores the larger id first."""
    each = items.select("item", "role", F.explode("stats").alias("stat", "amount")).join(weights, ["role", "stat"])
    total = each.groupBy("role", "item").agg(F.round(F.sum((F.col("amount") * F.col("weight")).cast("decimal(18,4)")).cast("double"), 3).alias("score"))
    w = Window.partitionBy("role").orderBy(F.desc("score"), F.desc("item"))
    return total.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


# Per guide role the best and the available types of weapons and armor where no items are known.
GUIDE_GEAR = {
    "melee_dps": (["sword", "axe", "dagger", "mace"], ["leather", "mail"], ["sword", "axe", "dagger", "mace", "staff"], ["cloth", "leather", "mail", "plate"]),
    "caster_dps": (["staff", "dagger", "mace"], ["cloth", "leather"], ["staff", "dagger", "mace", "sword"], ["cloth", "leather", "mail"]),
    "ranged_dps": (["bow", "gun", "crossbow"], ["leather", "mail"], ["bow", "gun", "crossbow", "dagger", "sword", "axe"], ["cloth", "leather", "mail"]),
    "tank": (["shield", "sword", "mace", "axe"], ["plate", "mail"], ["shield", "sword", "mace", "axe"], ["plate", "mail", "leather"]),
    "healer": (["staff", "mace", "dagger"], ["cloth", "leather", "mail"], ["staff", "mace", "dagger", "sword"], ["cloth", "leather", "mail"]),
    "support": (["staff", "mace", "dagger", "sword"], ["cloth", "leather", "mail"], ["staff", "mace", "dagger", "sword", "axe"], ["cloth", "leather", "mail", "plate"]),
}


def gear_report(items: DataFrame, weights: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """``wanted`` (role, engine_role) with best and available types, the best items, where that comes from, and warnings.

    items: item, weapon_type, armor_type, confidence, stats; weights: role,
    stat, weight, for engine roles and guide roles. Without items the role's
    defaults are told, with low confidence and two warnings.
    """
    kinds = items.agg(
        F.count("*").alias("_n"), F.sort_array(F.collect_set(F.when(F.col("weapon_type") != "", F.col("weapon_type")))).alias("_w"), F.sort_array(F.collect_set(F.when(F.col("armor_type") != "", F.col("armor_type")))).alias("_a"), F.coalesce(F.bool_or(F.col("confidence") == "low"), F.lit(False)).alias("_low")
    )
    scored = item_scores(items.withColumn("role", F.explode(F.array(*[F.lit(r) for r in GEAR_DEFAULTS]))), weights, k)
    best = scored.groupBy(F.col("role").alias("engine_role")).agg(F.sort_array(F.collect_list(F.struct("place", "item", "score"))).alias("item_scores"))
    stats = weights.groupBy("role").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "stat"))), lambda x: x["stat"]).alias("stat_priority"))
    default = lambda place: F.coalesce(*[F.when(F.col("role") == r, F.array(*[F.lit(x) for x in lists[place]])) for r, lists in GUIDE_GEAR.items()])
    offered = lambda column, place: F.when(F.size(column) > 0, F.col(column)).otherwise(default(place))
    out = wanted.join(best, "engine_role", "left").join(stats, "role", "left").join(F.broadcast(kinds))  # one row
    some = F.col("_n") > 0
    warnings = F.when(some, F.when(F.col("_low"), F.array(F.lit("item_data_low_confidence"))).otherwise(F.array().cast("array<string>"))).otherwise(F.array(F.lit("item_data_missing"), F.lit("gear_targets_from_role_defaults")))
    return out.select(
        *wanted.columns, default(0).alias("best_weapon_types"), default(1).alias("best_armor_types"), offered("_w", 2).alias("available_weapon_types"), offered("_a", 3).alias("available_armor_types"), "item_scores", "stat_priority",
        F.when(some, "mixed").otherwise("defaults").alias("gear_source"), F.when(some, "medium").otherwise("low").alias("gear_confidence"), warnings.alias("gear_warnings"),
    )


def gear_types(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (engine_role) with the weapon and armor types on offer, defaults where there are none, and warnings.

    items: engine_role, weapon_type, armor_type, confidence
    """
    sums = items.groupBy("engine_role").agg(
        F.sort_array(F.collect_set(F.when(F.col("weapon_type") != "", F.col("weapon_type")))).alias("_w"),
        F.sort_array(F.collect_set(F.when(F.col("armor_type") != "", F.col("armor_type")))).alias("_a"),
        F.bool_or(F.col("confidence") == "low").alias("_low"),
    )
    out = wanted.join(sums, "engine_role", "left")

    def chosen(column: str, place: int) -> Column:
        default = F.coalesce(*[F.when(F.col("engine_role") == r, F.array(*[F.lit(x) for x in kinds[place]])) for r, kinds in GEAR_DEFAULTS.items()])
        return F.when(F.size(column) > 0, F.col(column)).otherwise(default)

    warning = F.when(F.col("_low").isNull(), "item_data_missing").when(F.col("_low"), "item_data_low_confidence")
    return out.select(*wanted.columns, chosen("_w", 0).alias("weapon_types"), chosen("_a", 1).alias("armor_types"), warning.alias("gear_warning"))


FACTORS = {"high": 1.0, "medium": 0.85, "low": 0.55}
MAJOR = r"^(unsupported_condition:|missing_action:|no_simulatable|missing_mechanics:)"


def usage_scores(results: DataFrame, usage: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Observed runs to objective scores: (candidate, role, score, reliability, adjusted).

    results: candidate, role, duration_ms, damage, healing, mitigation_events, support_events, unsupported_conditions,
    unsupported_effects, coverage_pct, warnings (array). usage: candidate, key, count. catalogue: key, classification,
    duration_ms, effect_ms, cooldown_ms, costs and generates (maps). Uses of actions outside the catalogue don't count.
    """
    each = usage.join(catalogue, "key")
    n = F.col("count").cast("double")
    total = lambda m: F.coalesce(F.aggregate(F.map_values(m), F.lit(0.0), lambda x, y: x + y.cast("double")), F.lit(0.0))
    mana = F.aggregate(F.map_entries("costs"), F.lit(0.0), lambda x, e: x + F.when(F.lower(e["key"]) == "mana", e["value"].cast("double")).otherwise(0.0))
    lasting = F.when(F.coalesce("duration_ms", F.lit(0)) > 0, F.col("duration_ms")).otherwise(F.coalesce("effect_ms", F.lit(0)))
    kind = F.col("classification")
    summed = lambda x, *kinds: F.sum(F.when(kind.isin(*kinds), x).otherwise(0.0))
    sums = each.groupBy("candidate").agg(
        summed(lasting * n, "damage", "utility").alias("_up"), summed(lasting * n, "mitigation").alias("_mit_ms"), summed(lasting * n, "support").alias("_sup_ms"),
        summed(n, "heal").alias("_heals"), summed(n, "mitigation").alias("_mits"), summed(n, "support").alias("_sups"),
        F.sum(total("generates") * n).alias("_made"), F.sum(total("costs") * n).alias("_spent"), F.sum(F.coalesce(mana, F.lit(0.0)) * n).alias("_mana"), F.sum(F.when(F.coalesce("cooldown_ms", F.lit(0)) > 0, n).otherwise(0.0)).alias("_cds"),
    )
    made = [c for c in sums.columns if c != "candidate"]
    r = results.join(sums, "candidate", "left").fillna(0.0, made)
    damage, healing = per_minute(F.col("damage"), F.col("duration_ms")), per_minute(F.col("healing"), F.col("duration_ms"))
    covered = lambda ms: F.when(F.col("duration_ms") > 0, F.least(F.lit(100.0), F.col(ms) / F.col("duration_ms") * 100.0)).otherwise(0.0)
    efficiency = F.when(F.col("_made") > 0, F.least(F.lit(1.0), F.col("_spent") / F.col("_made"))).otherwise(0.0)
    mana_use = F.when(F.col("_mana") > 0, F.col("healing") / F.col("_mana")).otherwise(0.0)
    mits, sups = F.col("mitigation_events") + F.col("_mits"), F.col("support_events") + F.col("_sups")
    parts = {
        "tank": [covered("_mit_ms") * 8.0, healing * 0.4 + mits * 25.0, damage * 0.15 + mits * 12.0, damage * 0.1],
        "healer": [healing, mana_use * 10.0, F.col("_heals") * 20.0, damage * 0.2],
        "support": [covered("_sup_ms") * 8.0, sups * 25.0, sups * 10.0, damage * 0.15],
        None: [damage, covered("_up") * 0.5, efficiency * 50.0, F.col("_cds") * 10.0],
    }
    whole = {role: sum((F.round(x, 2) for x in xs[1:]), F.round(xs[0], 2)) for role, xs in parts.items()}
    score = F.when(F.col("role") == "tank", whole["tank"]).when(F.col("role") == "healer", whole["healer"]).when(F.col("role") == "support", whole["support"]).otherwise(whole[None])
    told = F.coalesce("warnings", F.array().cast("array<string>"))
    coverage = F.coalesce("coverage_pct", F.lit(100.0))
    low = (F.col("unsupported_conditions") > 0) | (coverage < 50) | F.exists(told, lambda w: F.regexp_like(w, F.lit(MAJOR)))
    medium = (F.col("unsupported_effects") > 0) | (coverage < 80) | (F.size(told) > 0)
    reliability = F.when(low, "low").when(medium, "medium").otherwise("high")
    out = r.select("candidate", "role", F.round(score, 2).alias("score"), reliability.alias("reliability"))
    factor = F.coalesce(*[F.when(F.col("reliability") == name, F.lit(by)) for name, by in FACTORS.items()])
    # The small addend makes halves go up whatever their binary form is.
    return out.withColumn("adjusted", F.round(F.col("score") * factor + 1e-7, 2))


def best_run(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per group the best adjusted score, then reliability, then score, then id."""
    rank = F.coalesce(*[F.when(F.col("reliability") == name, F.lit(n)) for n, name in enumerate(("low", "medium", "high"))])
    best = F.max_by(F.struct(*[c for c in scores.columns if c not in by]), F.struct("adjusted", rank, "score", "candidate"))
    return scores.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def build_reliability(builds: DataFrame, nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """(build, score, label): 1 less what is missing.

    0.2 where no action is of a selected active node, 0.15 without a category
    that the role is built on, 0.1 if more than half of the actions are of low
    confidence, 0.1 if builder or spender tags have no such action, 0.1 for
    warnings of missing roles, levels or tooltips. builds: build, role,
    warnings (array); nodes: build, node, passive, tags; actions: build, node,
    category, confidence.
    """
    tidy = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    n = nodes.groupBy("build").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("tags", tidy)))).alias("_tags"))
    active = nodes.filter(~F.col("passive")).select("build", "node").distinct().withColumn("_own", F.lit(True))
    a = actions.join(active, ["build", "node"], "left").groupBy("build").agg(
        F.count("*").alias("_n"), F.bool_or(F.coalesce("_own", F.lit(False))).alias("_some"), F.collect_set(tidy(F.col("category"))).alias("_categories"), F.count_if(F.col("confidence") == "low").alias("_low")
    )
    out = builds.join(n, "build", "left").join(a, "build", "left")
    none = F.array().cast("array<string>")
    categories, tags = F.coalesce("_categories", none), F.coalesce("_tags", none)
    core = F.coalesce(*[F.when(F.col("role") == r, F.array(*[F.lit(x) for x in c])) for r, c in ROLE_CORE.items() if r != "dps"], F.array(*[F.lit(x) for x in ROLE_CORE["dps"]]))
    loop = F.array(F.lit("spender"), F.lit("builder"))
    minus = lambda bad, by: F.when(F.coalesce(bad, F.lit(True)), by).otherwise(0.0)
    score = (
        1.0
        - minus(~F.col("_some"), 0.20)
        - minus(~F.arrays_overlap(categories, core), 0.15)
        - minus(F.coalesce(F.col("_low") > F.col("_n") / 2, F.lit(False)), 0.10)
        - minus(F.arrays_overlap(tags, loop) & ~F.arrays_overlap(categories, loop), 0.10)
        - minus(F.regexp_like(F.lower(F.array_join("warnings", " ")), F.lit("missing role|missing_level|tooltip")), 0.10)
    )
    out = out.select("build", F.round(clamp(score), 4).alias("score"))
    return out.withColumn("label", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.5, "medium").otherwise("low"))


def trust(builds: DataFrame, matches: DataFrame) -> DataFrame:
    """``builds`` with the four component scores, the weighted mean and its label.

    builds: build, role_source, role_confidence, warnings (array), reliability, unsupported_conditions,
    unsupported_effects; matches: build, severity (of watch-list entries that match).
    """
    hits = matches.groupBy("build").agg(F.bool_or(F.col("severity") == "high").alias("_severe"))
    both = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    sure = F.coalesce(F.col("role_source").isin("authoritative", "authoritative_video", "curated") & (F.col("role_confidence") == "high"), F.lit(False))
    base = F.when(F.col("reliability") == "high", 0.9).when(F.col("reliability") == "medium", 0.7).when(F.col("reliability") == "low", 0.45).otherwise(0.4)
    penalty = F.when(both("unsupported_conditions"), 0.20).otherwise(0.0) + F.when(both("unsupported_effects"), 0.10).otherwise(0.0)
    parts = {
        "role": F.when(sure, 1.0).otherwise(0.65),
        "mechanics": F.when(F.contains(F.array_join(F.coalesce("warnings", F.array().cast("array<string>")), " "), F.lit("missing_mechanics")), 0.45).otherwise(0.85),
        "rotation": F.greatest(F.lit(0.0), base - penalty),
        "watchlist": F.when(F.col("_severe").isNull(), 1.0).when(F.col("_severe"), 0.35).otherwise(0.55),
    }
    scored = builds.join(hits, "build", "left").withColumns({f"{name}_score": x for name, x in parts.items()}).drop("_severe")
    score = sum((F.col(f"{name}_score") * w for name, w in TRUST_WEIGHTS.items()), F.lit(0.0)) / sum(TRUST_WEIGHTS.values())
    return scored.withColumn("score", F.round(score, 6)).withColumn("label", trust_label(F.col("score")))


def alternate_objectives(components: DataFrame, builds: DataFrame, others: DataFrame) -> DataFrame:
    """(build, role, objective, label, index, breakdown) of each secondary role: the build's own index and parts under another name.

    builds: build, role, index; others: build, role. A build's own role is left out.
    """
    own = builds.select("build", F.col("role").alias("_own"), "index")
    rows = others.select("build", "role").distinct().join(own, "build").filter("role <> _own").join(breakdown(components), "build", "left")
    what = objective(F.col("role"))
    return rows.select("build", "role", what["id"].alias("objective"), what["label"].alias("label"), "index", F.coalesce("breakdown", F.lit("")).alias("breakdown"))
