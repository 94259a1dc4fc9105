"""What the columns of an unnamed wide table mean, shown by the data.

Wide rows are unpivoted to (row_id, col, val); every step aggregates by column
at once, so the shuffle carries one partial row per column and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import ratio

SCORE, MARGIN, EVIDENCE, HIT = 0.85, 0.15, 50, 0.9


def signed32(value: Column) -> Column:
    """An unsigned 32-bit cell read as signed."""
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def unpivot(wide: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, col, val); ``col`` is the column's place among ``columns``."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("long").alias("val")) for i, c in enumerate(columns)])
    return wide.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.*")


def unique_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that occur exactly once on both sides."""
    once = lambda df: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(key)
    return once(left).join(once(right), key)


def scalar_correlation(cells: DataFrame, known: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """Per field the column that equals it most often, its score, margin over the next, and non-zero evidence.

    ``known`` is (row_id, field, value). Ties go to more evidence, then to the
    larger column; a field whose best column has too little evidence is left out.
    """
    match = (F.col("val") == F.col("value")) | (signed32(F.col("val")) == F.col("value"))
    scored = cells.join(known, "row_id").filter("val IS NOT NULL AND value IS NOT NULL").groupBy("field", "col").agg(
        F.avg(match.cast("int")).alias("score"), F.count_if(match & (F.col("val") != 0)).alias("nonzero"), F.count("*").alias("n")
    )
    order = Window.partitionBy("field").orderBy(F.desc("score"), F.desc("nonzero"), F.desc("col"))
    ranked = scored.filter(F.col("n") >= evidence).withColumns({"place": F.row_number().over(order), "next": F.lead("score").over(order)})
    best = ranked.filter((F.col("place") == 1) & (F.col("nonzero") >= evidence))
    margin = F.round(F.col("score") - F.coalesce("next", F.lit(0.0)), 4)
    return best.select("field", "col", F.round("score", 4).alias("score"), margin.alias("margin"), "nonzero").withColumn("confidence", proof_confidence(F.col("score"), F.col("margin"), F.col("nonzero")))


def proof_confidence(score: Column, margin: Column, nonzero: Column) -> Column:
    return F.when((score >= SCORE) & (margin >= MARGIN) & (nonzero >= EVIDENCE), "high").when(nonzero >= EVIDENCE, "low").otherwise("unproven")


def hit_rates(cells: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Per column the share of its non-zero values that are known ids, and how many different ids these are."""
    known = ids.select(F.col(key).alias("_id")).distinct()
    filled = cells.filter("val <> 0").groupBy("col", "val").agg(F.count("*").alias("_n"))
    flagged = filled.join(known, F.col("val") == F.col("_id"), "left")
    hits = F.sum(F.when(F.col("_id").isNotNull(), F.col("_n")).otherwise(0))
    return flagged.groupBy("col").agg(hits.alias("hits"), F.sum("_n").alias("nonzero"), F.count("_id").alias("distinct_values")).withColumn("rate", F.round(F.col("hits") / F.col("nonzero"), 3))


def blocks(rates: DataFrame, anchors: list[int], hit: float = HIT, evidence: int = EVIDENCE) -> DataFrame:
    """Runs of neighbouring qualifying columns (places counted among the columns that are no anchors)."""
    every = rates.filter(~F.col("col").isin(*anchors) if anchors else F.lit(True)).withColumn("_p", F.row_number().over(Window.orderBy("col")))
    good = every.filter((F.col("hits") / F.col("nonzero") >= hit) & (F.col("nonzero") >= evidence))
    island = good.withColumn("_g", F.col("_p") - F.row_number().over(Window.orderBy("col")))
    return island.groupBy("_g").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count("*").alias("columns"), F.sum("nonzero").alias("nonzero"), F.bool_and(F.col("hits") == F.col("nonzero")).alias("proven")).drop("_g")


def index_columns(rates: DataFrame, share: float = 0.99) -> DataFrame:
    """Columns that can be an index into the ids; unique or ambiguous."""
    fit = rates.filter((F.col("nonzero") >= 2) & (F.col("hits") / F.col("nonzero") >= share) & (F.col("distinct_values") >= 2))
    return fit.select("col", "rate", F.when(F.count("*").over(Window.partitionBy(F.lit(0))) == 1, "unique").otherwise("ambiguous").alias("status"))


def anchor_columns(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Columns that match every anchor (name, row_id, expected) that is present; unique or ambiguous."""
    met = cells.join(anchors, "row_id").groupBy("name", "col").agg(F.bool_and(F.col("val").eqNullSafe(F.col("expected"))).alias("_all"), F.count("*").alias("anchors"))
    fit = met.filter("_all").drop("_all")
    return fit.withColumn("status", F.when(F.count("*").over(Window.partitionBy("name")) == 1, "unique").otherwise("ambiguous"))


def set_agreement(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Share of rows whose non-zero cells are, as a set, the known ids (row_id, field, ids)."""
    own = cells.filter("val <> 0").groupBy("row_id").agg(F.sort_array(F.collect_set("val")).alias("_own"))
    both = known.join(own, "row_id", "left").withColumn("_same", F.sort_array(F.array_distinct("ids")) == F.coalesce("_own", F.array().cast("array<long>")))
    return both.groupBy("field").agg(F.round(F.avg(F.col("_same").cast("int")), 4).alias("agreement"), F.count("*").alias("rows"))


def translated(cells: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """Correlation through a lookup: the known side has names, the cells have ids."""
    ids = known.join(names, "name").select("row_id", "field", F.col("id").alias("value"))
    return scalar_correlation(cells, ids)


def mask_domain(cells: DataFrame, known: int) -> DataFrame:
    """Per column the bits that occur in its masks, and those of them that are not in ``known``, as one sum each.

    The union of all masks is a partial ``bit_or``; no value is listed.
    """
    bits = cells.groupBy("col").agg(F.bit_or(F.coalesce(F.col("val"), F.lit(0))).alias("observed_bits"))
    return bits.withColumn("unknown_bits", F.col("observed_bits").bitwiseAND(F.lit(~known)))


def enum_domain(cells: DataFrame, allowed: list[int]) -> DataFrame:
    """Observed symbols per column: how many there are, and how many are unknown."""
    seen = cells.filter("val IS NOT NULL").groupBy("col", "val").agg(F.count("*").alias("_n"))
    return seen.groupBy("col").agg(F.count("*").alias("symbols"), F.count_if(~F.col("val").isin(*allowed)).alias("unknown_symbols"), F.sum(F.when(~F.col("val").isin(*allowed), F.col("_n")).otherwise(0)).alias("unknown_rows"))


def majority_labels(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Per column the score of mapping each value to its most common label, if that mapping is one to one."""
    n = cells.join(labels, "row_id").groupBy("col", "val", "label").agg(F.count("*").alias("_n"))
    best = n.groupBy("col", "val").agg(F.max(F.struct(F.col("_n"), F.col("label")))["label"].alias("label"), F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    out = best.groupBy("col").agg(F.count("*").alias("values"), F.count_distinct("label").alias("labels"), F.sum("_top").alias("_t"), F.sum("_all").alias("n"))
    return out.filter("values >= 2 AND values = labels").select("col", "values", F.round(ratio(F.col("_t"), F.col("n")), 4).alias("score"), "n")


def label_column(cells: DataFrame, labels: DataFrame, evidence: int = EVIDENCE, share: float = 0.85) -> DataFrame:
    """(col, score, n, mapping): the column whose values stand for the labels best, if one does.

    It needs ``evidence`` rows, two values or more, another label for each, and a
    share of ``share`` of its rows explained; of equal columns the first wins.
    The mapping is value:label in order of the values.
    """
    n = cells.filter("val IS NOT NULL").join(labels, "row_id").groupBy("col", "val", "label").agg(F.count("*").alias("_n"))
    best = n.groupBy("col", "val").agg(F.max(F.struct(F.col("_n"), F.col("label")))["label"].alias("label"), F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    pair = F.struct("val", F.concat_ws(":", F.col("val").cast("string"), "label").alias("text"))
    out = best.groupBy("col").agg(F.count("*").alias("_v"), F.count_distinct("label").alias("_l"), (F.sum("_top") / F.sum("_all")).alias("score"), F.sum("_all").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["text"]), ",").alias("mapping"))
    fit = out.filter((F.col("n") >= evidence) & (F.col("_v") >= 2) & (F.col("_v") == F.col("_l")) & (F.col("score") >= share))
    return fit.orderBy(F.desc("score"), "col").limit(1).select("col", F.round("score", 4).alias("score"), "n", "mapping")


def recon_status(findings: DataFrame, reviewed: bool = False, bound: bool = False) -> DataFrame:
    """One verdict from all findings (status: unique, ambiguous or missing; policy_match: where the policy has it too).

    Whatever is not uniquely found blocks. Verified are findings that a
    reviewed policy, bound to this very input, names alike; all else is to be reviewed.
    """
    one = findings.agg(
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(~F.coalesce(F.col("policy_match"), F.lit(False))).alias("unlike_policy"), F.count("*").alias("findings")
    )
    agreed = F.lit(reviewed and bound) & (F.col("unlike_policy") == 0)
    return one.withColumn("verdict", F.when(F.col("missing") + F.col("ambiguous") > 0, "blocked").when(agreed, "verified").otherwise("review_required"))


def emit_proven(wide: DataFrame, layout: dict[str, tuple[str, str]]) -> DataFrame:
    """A select of the proven columns under their names: name -> (column, confidence); others are null."""
    return wide.select(*[(F.col(c) if confidence == "high" else F.lit(None).cast("long")).alias(name) for name, (c, confidence) in layout.items()])
