"""Reconciling conflicting sources field by field, with full provenance.

Claims are long rows: key, field, source, tier, value (serialised), eligible,
ordinal. All fields of all keys are settled in one aggregation by (key, field).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers, best first, and reasons.
TIERS = ("authoritative_client", "verified_builder", "external_db", "inferred")
CONFLICT = "same_tier_conflict"


def claims_from(wide: DataFrame, key: str, fields: list[str], source: str, tier: str, eligible: Column | None = None) -> DataFrame:
    """One claim per row and field of a wide source."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return wide.select(
        F.col(key).alias("key"), F.explode(parts).alias("_c"), (F.lit(True) if eligible is None else eligible).alias("eligible")
    ).select("key", "_c.field", F.lit(source).alias("source"), F.lit(tier).alias("tier"), "_c.value", "eligible")


def tier_rank(tier: Column, tiers: tuple[str, ...] = TIERS) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in tiers]), tier)


def mark_conflicts(claims: DataFrame) -> DataFrame:
    """Eligible, present claims of a tier that disagree all become ineligible."""
    w = Window.partitionBy("key", "field", "tier")
    present = F.when(F.col("eligible") & F.col("value").isNotNull(), F.col("value"))
    clash = F.coalesce(F.min(present).over(w) != F.max(present).over(w), F.lit(False)) & present.isNotNull()
    return claims.withColumns({"conflict": clash, "eligible": F.col("eligible") & ~clash})


def reconcile(claims: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """The winning value per key and field: the first tier with an eligible value, the lowest ordinal within it.

    Without the window: the distinct eligible values of a tier are at most told
    apart by their minimum and maximum, so tiers are settled by partial
    aggregates first, and a hot key does not gather its claims in one task.
    """
    present = F.when(F.col("eligible") & F.col("value").isNotNull(), F.col("value"))
    by_tier = claims.groupBy("key", "field", "tier").agg(
        F.min(present).alias("_lo"),
        F.max(present).alias("_hi"),
        F.min(F.when(present.isNotNull(), F.struct("ordinal", "source"))).alias("_first"),
        F.count("*").alias("_n"),
    )
    clash = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False))
    ranked = by_tier.withColumns({"_rank": tier_rank(F.col("tier"), tiers), "_clash": clash})
    wins = F.when(F.col("_lo").isNotNull() & ~F.col("_clash"), F.struct("_rank", "tier", F.col("_lo").alias("value"), F.col("_first.source").alias("source")))
    out = ranked.groupBy("key", "field").agg(F.min(wins).alias("_w"), F.sum("_n").alias("candidates"), F.max("_clash").alias("had_conflict"))
    reason = (
        F.when(F.col("_w").isNull() & F.col("had_conflict"), "omitted_unresolved_conflict")
        .when(F.col("_w").isNull(), "omitted_no_eligible_candidate")
        .when(F.col("_w.tier") == tiers[2], "db_fallback")
        .when(F.col("_w.tier") == tiers[3], "inferred_last_resort")
        .when(F.col("candidates") == 1, "only_candidate")
        .otherwise("highest_precedence_eligible")
    )
    return out.select("key", "field", F.col("_w.value").alias("value"), F.col("_w.source").alias("source"), F.col("_w.tier").alias("tier"), reason.alias("reason"), "candidates", "had_conflict")


def winner_counts(settled: DataFrame) -> DataFrame:
    return settled.filter("tier IS NOT NULL").groupBy("field", "tier").agg(F.count("*").alias("n"))


def audit(settled: DataFrame) -> DataFrame:
    return settled.agg(
        F.count_if("had_conflict").alias("conflicts"), F.count_if(F.col("tier").isNull()).alias("omitted"), F.sum("candidates").alias("candidates"), F.count("*").alias("fields")
    )


def record_confidence(settled: DataFrame, core: list[str], timing: list[str], tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """high: all core fields and some timing field from the best tier; medium: any field from it; else low."""
    best = F.coalesce(F.col("tier") == tiers[0], F.lit(False))
    flags = settled.groupBy("key").agg(
        (F.count_distinct(F.when(F.col("field").isin(*core) & best, F.col("field"))) == len(core)).alias("_core"),
        F.bool_or(F.col("field").isin(*timing) & best).alias("_timing"),
        F.bool_or(best).alias("_some"),
        F.collect_set("tier").alias("_tiers"),
    )
    label = F.when(F.col("_core") & F.col("_timing"), "high").when(F.col("_some"), "medium").otherwise("low")
    provenance = F.array_join(F.filter(F.array(*[F.lit(t) for t in tiers]), lambda t: F.array_contains(F.col("_tiers"), t)), ">")
    return flags.select("key", label.alias("confidence"), provenance.alias("provenance"))


def identity_gate(rows: DataFrame, normalize) -> DataFrame:
    """Rows (key, client_name, builder_names, db_name) with the identity reference and whether the database row is shut out.

    The reference is the client's name, else the builders' if they agree, else
    the database's own: where builders disagree it passes by itself.
    """
    names = F.filter("builder_names", lambda x: F.coalesce(x, F.lit("")) != "")
    agree = F.size(F.array_distinct(F.transform(names, normalize))) == 1
    reference = F.coalesce(F.nullif("client_name", F.lit("")), F.when(agree, F.get(names, 0)), F.nullif("db_name", F.lit("")))
    verdict = F.when(F.nullif("db_name", F.lit("")).isNull() | F.col("reference").isNull(), "db_identity_unverifiable").when(
        normalize(F.col("db_name")) != normalize(F.col("reference")), "db_identity_mismatch"
    )
    return rows.withColumn("reference", reference).withColumn("excluded_reason", verdict).drop("builder_names")


def resolve_order(rows: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """Of disagreeing values the first in a fixed order, with a flag."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(value))
    known = rows.filter(rank > 0)
    return known.groupBy(key).agg(F.min_by(value, rank).alias(value), (F.min(value) != F.max(value)).alias("disagreed"))


def merge_rows(rows: DataFrame, key: str, tags: str, text: str, order: str) -> DataFrame:
    """Order-free grouping: union of the tags, sorted, and the first filled text by id."""
    return rows.groupBy(key).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(tags)))).alias(tags), F.min_by(text, F.when(F.coalesce(text, F.lit("")) != "", F.col(order))).alias(text)
    )


# Attribution


def attribute(memberships: DataFrame, modes: dict[str, str], own: str) -> DataFrame:
    """(id, group, kind) to modes per id: which kinds hold it, whether it is our own, and whether only one does.

    A kind that ``modes`` does not name claims no mode. An id with some mode is
    of high confidence, one of unknown kinds only of low.
    """
    mode = F.try_element_at(F.create_map(*[F.lit(x) for kv in modes.items() for x in kv]), F.col("kind"))
    sets = memberships.withColumn("mode", mode).groupBy("id").agg(F.sort_array(F.collect_set("mode")).alias("_m"), F.count_distinct("group").alias("groups"))
    exclusive = F.when(F.size("_m") == 1, F.get("_m", 0))
    return sets.select("id", F.array_join("_m", ",").alias("modes"), F.array_contains("_m", own).alias("is_own"), exclusive.alias("exclusive_mode"), "groups", F.when(F.size("_m") > 0, "high").otherwise("low").alias("confidence"))


def attribute_derived(memberships: DataFrame, known: DataFrame) -> DataFrame:
    """Ids that are not known but stand in a group with a known one: medium."""
    groups = memberships.join(known, "id", "left_semi").select("group").distinct()
    return memberships.join(groups, "group", "left_semi").join(known, "id", "left_anti").select("id").distinct().withColumn("confidence", F.lit("medium"))


def fill_attribution(facts: DataFrame, attribution: DataFrame, key: str) -> DataFrame:
    """Facts with their attribution, a default where there is none."""
    joined = facts.join(attribution.withColumnRenamed("id", key), key, "left")
    return joined.withColumns({"is_own": F.coalesce("is_own", F.lit(False)), "confidence": F.coalesce("confidence", F.lit("none")), "modes": F.coalesce("modes", F.lit(""))})


def id_band(value: Column, bands: list[tuple[int, int, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for low, high, label in bands:
        out = out.when(value.between(low, high), label)
    return out.otherwise("unknown")


def band_cardinality(ids: DataFrame, bands: list[tuple[int, int, str]], band: str, expected: int) -> DataFrame:
    """One row: how many different ids are of a band, whether that is as expected, and which ids are of no band."""
    label = id_band(F.col("id"), bands)
    one = ids.select("id").distinct().agg(F.count_if(label == band).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(label == "unknown", F.col("id")))), lambda x: x.cast("string")), ",").alias("unknown_ids"))
    return one.select("n", (F.col("n") == expected).alias("as_expected"), "unknown_ids")
