"""Coercion, derivation and lookup on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of confidence and proof, best last.
CONFIDENCE = ("low", "medium", "high")
SCHOOL_BITS = {1: "physical", 2: "holy", 4: "fire", 8: "nature", 16: "frost", 32: "shadow", 64: "arcane"}
POWER_TYPES = {-2: "health", 0: "mana", 1: "rage", 2: "focus", 3: "energy", 4: "happiness", 5: "runes", 6: "runic_power"}


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def first_path(json: Column, *paths: str) -> Column:
    """The first filled value among JSON paths."""
    return first_filled(*[F.get_json_object(json, p) for p in paths])


def number(text: Column) -> Column:
    """A plain decimal number as double, everything else null."""
    value = F.trim(text.cast("string"))
    return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))


def integer_or(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def clean_ids(values: Column) -> Column:
    """Strings to ids; what is no number and zero (no id) is dropped."""
    return F.filter(F.transform(values, lambda x: x.try_cast("long")), lambda x: x.isNotNull() & (x != 0))


def slot_ids(*slots: Column) -> Column:
    """Slot columns as a sorted array of distinct ids, without zero and null."""
    return F.sort_array(F.array_distinct(F.filter(F.array(*slots), lambda x: x.isNotNull() & (x != 0))))


def essence_kind(entry_type: Column, ability_cost: Column, talent_cost: Column) -> Column:
    kind, a, t = F.lower(entry_type), F.coalesce(ability_cost, F.lit(0)), F.coalesce(talent_cost, F.lit(0))
    return (
        F.when(kind == "ability", "ability").when(kind == "talent", "talent").when((a > 0) & (t <= 0), "ability").when((t > 0) & (a <= 0), "talent").otherwise("unknown")
    )


def source_category(tab: Column) -> Column:
    """struct(category, confidence) of a tab name."""
    category = F.when(F.coalesce(tab, F.lit("")) == "", "unknown").when(tab == "Class", "class_pool").when(tab == "None", "metadata_only").otherwise("spec_tree")
    confidence = F.when(category.isin("spec_tree", "class_pool"), "high").when(category == "metadata_only", "medium").otherwise("low")
    return F.struct(category.alias("category"), confidence.alias("confidence"))


def availability(stated: Column, from_db: Column, from_text: Column) -> Column:
    """Effective level from the stated one, else the database's, else the text's, with source, confidence and notes."""
    stated = F.coalesce(stated, F.lit(0))
    has, db, text = stated > 0, from_db.isNotNull(), from_text.isNotNull()
    return F.struct(
        F.when(has, stated).when(db, from_db).when(text, from_text).otherwise(stated).alias("effective_required_level"),
        F.when(has, "builder_required_level").when(db, "db_tooltip").when(text, "builder_tooltip").when(stated == 0, "builder_required_level_zero_or_unknown").otherwise("builder_required_level").alias("level_source"),
        F.when(has, "high").when(db | text, "medium").when(stated == 0, "low").otherwise("high").alias("level_confidence"),
        F.array_compact(
            F.array(
                F.when(has & db & (from_db != stated), "db_tooltip_level_conflicts_with_builder_required_level"),
                F.when(~has & (db | text), "builder_required_level_zero_but_tooltip_has_level"),
                F.when(~has & ~db & ~text & (stated == 0), "required_level_zero_means_available_or_unknown"),
            )
        ).alias("notes"),
    )


def effective_level(ladder: Column, fallback: Column) -> Column:
    """The ladder's level where its confidence is high or medium."""
    trusted = ladder["level_confidence"].isin("high", "medium") & ladder["effective_required_level"].isNotNull()
    return F.when(trusted, ladder["effective_required_level"]).otherwise(F.coalesce(fallback, F.lit(0)))


def mask_names(mask: Column, bits: dict[int, str] = SCHOOL_BITS) -> Column:
    """Names of the set bits, in bit order."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(b).cast("long")) != 0, F.lit(n)) for b, n in bits.items()]))


def unknown_bits(mask: Column, bits: dict[int, str] = SCHOOL_BITS) -> Column:
    return mask.bitwiseAND(F.lit(~reduce(int.__or__, bits)).cast("long"))


def code_name(code: Column, names: dict[int, str] = POWER_TYPES) -> Column:
    """struct(name, unknown): the name of a code, and whether a given code has none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    name = F.try_element_at(table, code.cast("int"))
    return F.struct(name.alias("name"), (code.isNotNull() & name.isNull()).alias("unknown"))


def gated(raw: Column, allowed: Column) -> Column:
    """struct(raw, decoded, reason): a value outside its domain decodes to null, and stays as raw."""
    return F.struct(raw.alias("raw"), F.when(allowed, raw).alias("decoded"), F.when(raw.isNotNull() & ~allowed, "value_out_of_domain").alias("reason"))


def weakest(*levels: Column) -> Column:
    """The lowest of some confidence names; null if one is unknown."""
    ranks = [F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), x) for x in levels]
    lowest = F.least(*[F.nullif(r, F.lit(0)) for r in ranks]) if len(ranks) > 1 else F.nullif(ranks[0], F.lit(0))
    any_null = reduce(Column.__or__, [F.coalesce(r, F.lit(0)) == 0 for r in ranks])
    return F.when(~any_null, F.get(F.array(*[F.lit(c) for c in CONFIDENCE]), lowest.cast("int") - 1))


def band(score: Column, steps: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The label of the first step that the score reaches."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(score >= least, label)
    return out.otherwise(rest)


def trust_label(score: Column) -> Column:
    return band(score, ((0.80, "high"), (0.50, "medium")), "low")


def reliability_label(score: Column) -> Column:
    return band(score, ((0.75, "high"), (0.50, "medium")), "low")


def per_minute(value: Column, duration_ms: Column) -> Column:
    return F.coalesce(F.try_divide(value * 60000.0, duration_ms.cast("double")), F.lit(0.0))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def bounded_delta(a: Column, b: Column) -> Column:
    """Distance of two numbers as a share of the larger one, at most 1."""
    top = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.least(F.lit(1.0), F.abs(a - b) / top)


def is_fresh(stamps: list[Column], stale_days: int, now: Column) -> Column:
    """Whether the first given time is less than ``stale_days`` old; false without any."""
    return F.coalesce(F.coalesce(*stamps) > now - F.make_dt_interval(F.lit(stale_days)), F.lit(False))


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def drop_empty(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != 0))


def engine_role(role: Column) -> Column:
    return F.when(role.isin("melee_dps", "caster_dps", "ranged_dps"), "dps").when(role.isin("healer", "support"), "healer_support").when(role == "tank", "tank").otherwise(role)


def layer_key(name: Column) -> Column:
    """Load order of layer names: base, then numbered, then other, then longer and later suffixes."""
    suffix = F.regexp_extract(F.lower(name), r"-([a-z0-9]+)$", 1)
    family = F.when(suffix == "", 0).when(suffix.rlike(r"^\d+$"), 1).otherwise(2)
    return F.struct(family.alias("family"), F.length(suffix).alias("length"), suffix.alias("suffix"))
