r"""Mechanics of abilities from their tooltips, and the catalogue of actions that a build can run.

Patterns are fixed values; they are searched in any case. A word boundary is
Java's ``\b``, which counts letters of all scripts; ``text.py`` says where that
differs from boundaries of ASCII letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import slug

# Schools, and what tooltips say. Group 1 is the value.
SCHOOLS = ("arcane", "fire", "frost", "holy", "nature", "physical", "shadow", "fel")
SECONDS = r"\s*(?:sec|second|seconds|s)\b"
NUMBER = r"(\d+(?:\.\d+)?)"
PATTERNS = {
    "duration_ms": rf"\b(?:for|over|lasts?)\s+{NUMBER}{SECONDS}",
    "tick_interval_ms": rf"\bevery\s+{NUMBER}{SECONDS}",
    "cooldown_ms": rf"\b{NUMBER}\s*(?:sec|second|seconds|s)\s+cooldown\b",
    "charges": r"\b(\d+)\s+charges?\b",
    "max_targets": r"\bup to\s+(\d+)\s+(?:enemies|targets|allies)\b",
    "chance": rf"\b{NUMBER}%\s+chance\b",
    "internal_cooldown_ms": rf"\bonce every\s+{NUMBER}{SECONDS}",
    "damage": rf"\bDeals?\s+{NUMBER}\s+(?:[A-Za-z]+\s+)?damage\b",
    "heal": rf"\bHeals?(?:\s+\w+)*\s+for\s+{NUMBER}\b",
    "school": rf"\b({'|'.join(SCHOOLS)})\b",
    "any_amount": rf"\b{NUMBER}\s+(?:[A-Za-z]+\s+)?(?:damage|healing|health|heal)\b",
}
COST = r"\bCosts?\s+(\d+(?:\.\d+)?)\s+([A-Za-z][A-Za-z ]+?)(?:\.|,|$)"
DAMAGE, RAISES = r"\bdamage\b", r"\bincreases?|buff|aura\b"
HEALS, SUMMONS, AURAS, ACTS = r"\bheal", r"\bsummon|companion|pet\b", r"\bbuff|aura|increases?\b", r"\bcast|deals?|heals?\b"


def says(text: Column, pattern: str) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit("(?i)" + pattern))


def said(text: Column, name: str) -> Column:
    """The first value of a pattern, null where it isn't there."""
    value = F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + PATTERNS[name], 1)
    return F.when(value != "", value)


def milliseconds(text: Column, name: str) -> Column:
    return F.round(said(text, name).cast("double") * 1000).cast("long")


def has(tags: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names])), F.lit(False))


def infer_mechanics(rows: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``rows`` (id, text, tags, schools, resources) with what the tooltip tells.

    Adds kind, school, power_type, the timing and limits, costs (map), effect
    (struct, null where none is told) and confidence: medium if there is an
    effect, a cost, a cooldown or a proc. ``overrides`` (id, and any of kind,
    cooldown_ms, charges, max_targets, confidence) win where they aren't null.
    """
    text, tags = F.col("text"), F.coalesce("tags", F.array().cast("array<string>"))
    out = rows.withColumns(
        {
            **{c: milliseconds(text, c) for c in ("duration_ms", "tick_interval_ms", "cooldown_ms", "internal_cooldown_ms")},
            **{c: said(text, c).cast("int") for c in ("charges", "max_targets")},
            "chance": F.round(said(text, "chance").cast("double") / 100, 6),
            "school": F.coalesce(F.get("schools", 0), F.lower(said(text, "school")), F.lit("")),
            "power_type": F.coalesce(F.get("resources", 0), F.lit("")),
            "_heal": said(text, "heal").cast("double"),
            "_damage": said(text, "damage").cast("double"),
        }
    )
    named = lambda raw: F.coalesce(F.get(F.filter("resources", lambda r: F.lower(r) == F.lower(raw)), 0), F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, 2, 1000)))
    amounts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + COST), F.lit(1))
    names = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + COST), F.lit(2)), lambda x: named(F.trim(x)))
    pairs = F.arrays_zip(names.alias("k"), amounts.alias("v"))
    last = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.element_at(F.filter(F.zip_with(names, amounts, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda p: p["k"] == n), -1)["v"].cast("double")))
    kind = F.when(F.col("_heal").isNotNull() | has(tags, "heal"), "heal").when(F.col("_damage").isNotNull() | has(tags, "dot") | says(text, DAMAGE), "damage").when(says(text, RAISES), "aura_apply")
    ticking = F.col("duration_ms").isNotNull() & F.col("tick_interval_ms").isNotNull()
    out = out.withColumns({"costs": F.when(F.size(pairs) > 0, last).otherwise(F.create_map().cast("map<string,double>")), "effect_type": kind})
    effect = F.struct(
        F.col("effect_type"), F.when(F.col("effect_type") == "aura_apply", "").otherwise(F.col("school")).alias("school"),
        F.when(F.col("effect_type") == "heal", "ally").when(F.col("effect_type") == "damage", "enemy").otherwise("self").alias("target"),
        F.when(F.col("effect_type") == "heal", F.col("_heal")).when(F.col("effect_type") == "damage", F.col("_damage")).alias("amount"), F.col("duration_ms"),
        F.when(F.col("effect_type") != "aura_apply", F.col("tick_interval_ms")).alias("tick_interval_ms"),
        F.when(ticking & ~has(tags, "dot"), F.array_append(tags, F.lit("dot"))).otherwise(tags).alias("tags"),
    )
    whole = F.when(has(tags, "dot") | (F.coalesce(F.col("tick_interval_ms"), F.lit(0)) > 0) & (F.col("effect_type") == "damage"), "debuff").when(has(tags, "cooldown"), "cooldown").when(F.col("effect_type") == "aura_apply", "buff").otherwise("ability")
    proc = F.col("chance").isNotNull() | F.col("internal_cooldown_ms").isNotNull()
    told = F.col("effect_type").isNotNull() | (F.size("costs") > 0) | F.col("cooldown_ms").isNotNull() | proc
    out = out.withColumns({"kind": F.coalesce(whole, F.lit("ability")), "effect": F.when(F.col("effect_type").isNotNull(), effect), "confidence": F.when(told, "medium").otherwise("low")}).drop("_heal", "_damage", "effect_type")
    if overrides is None:
        return out
    o = overrides.withColumnsRenamed({c: f"_o_{c}" for c in overrides.columns if c != "id"}).join(rows.select("id").distinct(), "id", "left_semi")
    out = out.join(o, "id", "left")
    return out.withColumns({c: F.coalesce(f"_o_{c}", c) for c in overrides.columns if c != "id"}).drop(*[f"_o_{c}" for c in overrides.columns])


def infer_effects(rows: DataFrame) -> DataFrame:
    """``rows`` (text, tags, schools, passive, entry_type, and the nullable known_duration_ms and period_ms) with ``kind`` and ``effect``, of several sources.

    One school is the effect's; of several none is; without any the text
    tells. A duration that is known goes before the text's.
    """
    text, tags = F.col("text"), F.coalesce("tags", F.array().cast("array<string>"))
    n = F.size(F.coalesce("schools", F.array().cast("array<string>")))
    school = F.when(n == 1, F.get("schools", 0)).when(n > 1, "").otherwise(F.coalesce(F.lower(said(text, "school")), F.lit("")))
    lasting = F.coalesce(F.col("known_duration_ms"), milliseconds(text, "duration_ms"))
    kind = (
        F.when(has(tags, "heal") | says(text, HEALS), "heal")
        .when(has(tags, "summon") | says(text, SUMMONS), "summon")
        .when(has(tags, "aura", "cooldown") | says(text, AURAS), "aura_apply")
        .when(has(tags, "dot") | (n > 0) | says(text, DAMAGE), "damage")
    )
    hits = F.col("_kind").isin("heal", "damage")
    effect = F.struct(
        F.col("_kind").alias("effect_type"), F.when(hits, school).alias("school"), F.when(F.col("_kind") == "heal", "ally").when(F.col("_kind") == "damage", "enemy").otherwise("self").alias("target"),
        F.when(hits, said(text, "any_amount").cast("double")).alias("amount"), lasting.alias("duration_ms"), F.col("period_ms").alias("tick_interval_ms"), F.filter(tags, lambda t: t != "").alias("tags"),
    )
    passive = F.col("passive") | ((F.col("entry_type") == "Talent") & ~says(text, ACTS))
    whole = F.when(passive, "passive").when(has(tags, "summon"), "pet_action").when(has(tags, "dot"), "debuff").when(has(tags, "cooldown"), "cooldown").otherwise("ability")
    return rows.withColumn("_kind", kind).withColumns({"kind": whole, "effect": F.when(F.col("_kind").isNotNull(), effect)}).drop("_kind")


def action_role(kind: Column, effects: Column, role: Column) -> Column:
    """What an action does for a role, from its kind and effects (array of struct with effect_type and tags)."""
    types = F.transform(effects, lambda e: e["effect_type"])
    tags = F.flatten(F.transform(effects, lambda e: e["tags"]))
    return (
        F.when((role == "support") & (has(tags, "support") | has(types, "aura_apply")), "support")
        .when(has(types, "heal"), "heal")
        .when(has(types, "damage_reduction", "shield", "absorb") | has(tags, "tank", "mitigation") | kind.isin("tank", "mitigation"), "mitigation")
        .when(has(types, "damage") | (kind == "debuff"), "damage")
        .when(has(types, "summon", "aura_apply", "stat_modify") | kind.isin("pet_action", "cooldown"), "utility")
        .otherwise("unknown")
    )


def action_catalogue(nodes: DataFrame, mechanics: DataFrame) -> DataFrame:
    """One row per active node of a build: its action key, classification, confidence, source and warning.

    nodes: build, role, node, spell, name, passive; mechanics: spell, name,
    kind, effects, confidence, cooldown_ms, duration_ms, gcd_ms. A node without
    mechanics is an unknown action of low confidence.
    """
    m = mechanics.select("spell", F.struct("name", "kind", "effects", "confidence", "cooldown_ms", "duration_ms", "gcd_ms").alias("m"))
    j = nodes.join(m, "spell", "left").filter(~(F.col("passive") | (F.coalesce(F.col("m.kind"), F.lit("")) == "passive")))
    found = F.col("m").isNotNull()
    name = F.when(F.coalesce(F.col("m.name"), F.lit("")) != "", F.col("m.name")).otherwise(F.col("name"))
    key = slug(name)
    return j.select(
        "build", "node", "spell", F.when(key == "", "action").otherwise(key).alias("key"), name.alias("name"), F.when(found, F.col("m.kind")).otherwise("unknown").alias("kind"), F.when(found, F.col("m.confidence")).otherwise("low").alias("confidence"),
        F.when(found, action_role(F.col("m.kind"), F.col("m.effects"), F.col("role"))).otherwise("unknown").alias("classification"), F.coalesce(F.col("m.cooldown_ms"), F.lit(0)).alias("cooldown_ms"), F.coalesce(F.col("m.gcd_ms"), F.lit(1500)).alias("gcd_ms"), F.col("m.duration_ms").alias("duration_ms"),
        F.when(found, "mechanics").otherwise("fallback").alias("source"), F.when(~found, F.concat(F.lit("missing_mechanics:"), F.coalesce(F.col("spell").cast("string"), F.lit("None")))).alias("warning"),
    )


def catalogue_coverage(nodes: DataFrame, mechanics: DataFrame) -> DataFrame:
    """Per build: selected, executable, passive and missing counts, and the share of active nodes with mechanics in percent."""
    m = mechanics.select("spell", F.col("kind").alias("_k"))
    j = nodes.join(m, "spell", "left").withColumn("_p", F.col("passive") | (F.coalesce("_k", F.lit("")) == "passive"))
    out = j.groupBy("build").agg(F.count("*").alias("selected"), F.count_if(~F.col("_p")).alias("executable"), F.count_if("_p").alias("passive_skipped"), F.count_if(~F.col("_p") & F.col("_k").isNull()).alias("missing"))
    pct = (F.col("executable") - F.col("missing")) / F.greatest(F.col("executable"), F.lit(1)) * 100
    return out.withColumn("coverage_pct", F.round(pct, 2))
