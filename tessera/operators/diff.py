"""Differences of two catalogues: identity, sets, scalars, adjudication and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity_differences(pairs: DataFrame, canonical) -> DataFrame:
    """(left_id, right_id, left, right) identities that differ: counts per pair of labels, hard or only in how they are written.

    An identity is an id and a label: where the ids differ it is hard whatever the labels are.
    """
    same_id = F.col("left_id").eqNullSafe(F.col("right_id"))
    raw = pairs.filter(~same_id | ~F.col("left").eqNullSafe(F.col("right")))
    kind = F.when(same_id & canonical(F.col("left")).eqNullSafe(canonical(F.col("right"))), "representation").otherwise("hard")
    return raw.withColumn("kind", kind).groupBy("left", "right", "kind").agg(F.count("*").alias("n"))


def set_differences(pairs: DataFrame) -> DataFrame:
    """(key, left, right) id arrays compared as sets."""
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<long>"))))
    return pairs.select("key", tidy(F.col("left")).alias("left"), tidy(F.col("right")).alias("right")).filter("left <> right")


def scalar_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) of differing fields of matched keys; null and 0 are alike."""
    a = left.select(key, *[F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f"l_{f}") for f in fields])
    b = right.select(key, *[F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f"r_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("left"), F.col(f"r_{f}").alias("right")) for f in fields])
    return a.join(b, key).select(key, F.explode(each).alias("d")).select(key, "d.*").filter("left <> right")


# What may be said of a key that only the left side has. The last blocks.
VERDICTS = ("verified_client_current", "representation_difference", "extraction_defect")


def adjudicated(left_only: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Left-only rows with their curated class; any other label, or none, is unresolved."""
    named = left_only.join(verdicts.select(key, F.col("classification").alias("_c")), key, "left")
    return named.withColumn("classification", F.when(F.col("_c").isin(*VERDICTS), F.col("_c")).otherwise("unresolved")).drop("_c")


def adjudicate(left_only: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """How many left-only keys there are of each class."""
    return adjudicated(left_only, verdicts, key).groupBy("classification").agg(F.count("*").alias("n"))


def coverage(crosswalk: DataFrame) -> DataFrame:
    """Recall, precision and counts of a crosswalk, 1 where there is nothing to cover."""
    n = {s: F.count_if(F.col("side") == s) for s in ("matched", "left_only", "right_only")}
    one = crosswalk.agg(*[v.alias(k) for k, v in n.items()])
    share = lambda other: F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("matched") + F.col(other)), F.lit(1.0))
    return one.withColumns({"recall": share("right_only"), "precision": share("left_only")})


def readiness(client: DataFrame, builder: DataFrame, verdicts: DataFrame, fields: DataFrame, canonical, taxonomy: tuple[str, ...] = (), expected: int | None = None) -> DataFrame:
    """One row: what of the client's catalogue may replace the builder's, and all that stands against it.

    client and builder: node, spell, cls, and, null where not decoded,
    connected and required (arrays) and values (map of field to number).
    verdicts: node, classification of nodes that only the client has. fields:
    field, part (adjacency, legality or layout), confidence (null where its
    column is not found). ``taxonomy`` has the blockers of the classes, if any;
    ``expected`` is the number of builder records there have to be.

    Ownership needs every builder node, equal identities and accepted verdicts;
    adjacency needs both fields decoded and no different sets; a field of
    legality is ready when decoded, differing values or not, as the client's
    win; layout never gates, nor does levelling, which is not decoded.
    """
    side = lambda df, s: df.select("node", F.struct("spell", "cls", "connected", "required", "values").alias(s))
    both = adjudicated(side(client, "c").join(side(builder, "b"), "node", "full_outer"), verdicts, "node")
    has_c, has_b = F.col("c").isNotNull(), F.col("b").isNotNull()
    matched, only = has_c & has_b, has_c & ~has_b
    same_spell = F.col("c.spell").eqNullSafe(F.col("b.spell"))
    raw = matched & ~(same_spell & F.col("c.cls").eqNullSafe(F.col("b.cls")))
    hard = matched & ~(same_spell & canonical(F.col("c.cls")).eqNullSafe(canonical(F.col("b.cls"))))
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<long>"))))
    unlike = lambda name: F.col(f"c.{name}").isNotNull() & (tidy(F.col(f"c.{name}")) != tidy(F.col(f"b.{name}")))
    zero = F.lit(0).cast("long")
    legal = F.size(F.filter(F.coalesce(F.map_entries("c.values"), F.array().cast("array<struct<key:string,value:bigint>>")), lambda e: F.map_contains_key(F.col("b.values"), e["key"]) & (F.coalesce(e["value"], zero) != F.coalesce(F.try_element_at("b.values", e["key"]), zero))))
    counts = both.agg(
        F.count_if(has_c).alias("client_nodes"), F.count_if(has_b).alias("builder_records"), F.count_if(matched).alias("matched"), F.count_if(has_b & ~has_c).alias("builder_only"),
        *[F.count_if(only & (F.col("classification") == v)).alias(v) for v in (*VERDICTS, "unresolved")],
        F.count_if(raw & ~hard).alias("representation_pairs"), F.count_if(hard).alias("identity_mismatches"), F.count_if(matched & (unlike("connected") | unlike("required"))).alias("adjacency_mismatches"), F.coalesce(F.sum(F.when(matched, legal)), zero).alias("legality_differences"),
    )
    high = F.col("confidence").eqNullSafe(F.lit("high"))
    listed = lambda test, text: F.array_sort(F.collect_list(F.when(test, text)))
    told = fields.agg(
        listed(F.col("confidence").isNotNull() & ~high, F.concat(F.lit("low_confidence:"), "field")).alias("_low"), listed(F.col("confidence").isNull(), F.concat(F.lit("unresolved_layout_column:"), "field")).alias("_lost"),
        F.coalesce(F.bool_and(F.when(F.col("part") == "adjacency", high)), F.lit(True)).alias("_adjacency"), F.coalesce(F.bool_and(F.when(F.col("part") == "legality", high)), F.lit(True)).alias("_legality"),
        *[F.array_join(listed(F.col("part") == part, F.concat("field", F.when(high, ":ready").otherwise(":unresolved"))), ",").alias(part) for part in ("legality", "layout")],
    )
    one = counts.join(F.broadcast(told))  # one row each
    clear, counted = F.lit(not taxonomy), F.lit(True) if expected is None else F.col("builder_records") == expected
    attribution = (F.col("client_nodes") > 0) & clear
    blocked = F.col("unresolved") + F.col("extraction_defect") > 0
    ownership = attribution & (F.col("builder_records") > 0) & counted & (F.col("builder_only") == 0) & (F.col("identity_mismatches") == 0) & ~blocked
    adjacency = F.col("_adjacency") & (F.col("adjacency_mismatches") == 0)
    codes = [("empty_client_input", F.col("client_nodes") == 0), ("empty_builder_input", F.col("builder_records") == 0), *[(t, F.lit(True)) for t in taxonomy], ("builder_record_count", ~counted), ("builder_only_node_instances", F.col("builder_only") > 0)]
    codes += [("client_only_unresolved", F.col("unresolved") > 0), ("client_only_extraction_defect", F.col("extraction_defect") > 0), ("identity_mismatch", F.col("identity_mismatches") > 0), ("adjacency_mismatch", F.col("adjacency_mismatches") > 0)]
    blockers = F.concat(F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in codes])), "_low", "_lost")
    return one.select(
        *counts.columns, "legality", "layout", attribution.alias("attribution_ready"), ownership.alias("ownership_ready"), adjacency.alias("adjacency_ready"), F.lit(False).alias("leveling_progression_ready"),
        (attribution & ownership & adjacency & F.col("_legality")).alias("full_retirement_ready"), F.array_join(blockers, ",").alias("blockers"),
    )


def field_status(fields: DataFrame) -> DataFrame:
    """Confidence per field to ready, low or unresolved."""
    label = F.when(F.col("confidence").isNull(), "unresolved").when(F.col("confidence") == "high", "ready").otherwise("low")
    return fields.withColumn("status", label)


def tab_coverage(tabs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Tabs with the number of their nodes; a tab may have none."""
    n = nodes.groupBy(key).agg(F.count("*").alias("_n"))
    return tabs.join(n, key, "left").select(*tabs.columns, F.coalesce("_n", F.lit(0)).alias("nodes"), F.col("_n").isNotNull().alias("has_nodes"))


def drift(present: DataFrame, policy: DataFrame) -> DataFrame:
    """Tables (name, fields) against a policy (name, required, fields): what is missing, unexpected or of another width."""
    both = policy.alias("p").join(present.alias("t"), "name", "full_outer")
    finding = (
        F.when(F.col("p.required").isNull(), "not_in_policy")
        .when(F.col("p.required") & F.col("t.fields").isNull(), "required_missing")
        .when(~F.col("p.required") & F.col("t.fields").isNotNull(), "expected_absent")
        .when(F.col("t.fields") != F.col("p.fields"), "field_count_mismatch")
        .otherwise("ok")
    )
    return both.select("name", finding.alias("finding"))
