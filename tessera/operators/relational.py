"""Joins with a status, deterministic dedupe, top-k, counts, and layered unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.values import ratio


# Joins


class TooManyRows(ValueError):
    """A side that has to be small isn't."""


def stated(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` if there are at most ``most``: rules, entries and the like that are tested against every row of a large table.

    Runs a job that reads no more than one row beyond; raises ``TooManyRows``
    rather than let a nested loop grow with the data.
    """
    n = rows.limit(most + 1).count()
    if n > most:
        raise TooManyRows(f"more than {most} rows in a side that is tested against all rows")
    return rows


def stated_rows(rows: DataFrame, most: int = 1_000) -> list:
    """The rows of a stated side on the driver, to be written into expressions; raises beyond ``most``."""
    return stated(rows, most).collect()


def enrich(entries: DataFrame, rows: DataFrame, key: str, name: str = "enrichment") -> DataFrame:
    """Left join by id; the other side becomes one struct, null where nothing matches."""
    side = rows.select(key, F.struct(*[c for c in rows.columns if c != key]).alias(name))
    return entries.join(side, key, "left")


def with_owner(entries: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Composite-key lookup; small owner tables are broadcast by their size."""
    return entries.join(owners, keys, "left")


def side_status(facts: DataFrame, index: str, side: DataFrame, side_key: str, value: str, eligible: Column | None = None) -> DataFrame:
    """Foreign key into a side table with a status: index_zero, side_row_missing or resolved; decoded only if eligible."""
    first = side.groupBy(F.col(side_key).alias("_side")).agg(F.min(value).alias("_value"))
    joined = facts.join(first, F.col(index) == F.col("_side"), "left")
    status = F.when(F.coalesce(F.col(index), F.lit(0)) == 0, "index_zero").when(F.col("_side").isNull(), "side_row_missing").otherwise("resolved")
    decoded = F.when((status == "resolved") & (F.lit(True) if eligible is None else eligible), F.col("_value"))
    return joined.withColumns({"status": status, "decoded": decoded}).drop("_side", "_value")


def crosswalk(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two catalogues with the side(s) that have the key."""
    a = left.select(F.col(key).alias("_l"), F.struct("*").alias("left"))
    b = right.select(F.col(key).alias("_r"), F.struct("*").alias("right"))
    both = a.join(b, F.col("_l") == F.col("_r"), "full_outer")
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("matched")
    return both.select(F.coalesce("_l", "_r").alias(key), side.alias("side"), "left", "right")


def with_override(rows: DataFrame, overrides: DataFrame, keys: list[str], fallback: list[str], value: str, default: Column) -> DataFrame:
    """The override of all keys, else the one of the fallback keys, else a default."""
    exact = overrides.filter(F.col(keys[0]).isNotNull()).select(*keys, F.col(value).alias("_exact"))
    loose = overrides.filter(F.col(keys[0]).isNull()).select(*fallback, F.col(value).alias("_loose"))
    return rows.join(exact, keys, "left").join(loose, fallback, "left").withColumn(value, F.coalesce("_exact", "_loose", default)).drop("_exact", "_loose")


def with_profile(rows: DataFrame, specific: DataFrame, generic: DataFrame, key: str, role: str, value: str) -> DataFrame:
    """A specific profile, else the generic one of the role with a warning."""
    s = specific.select(key, F.col(value).alias("_specific"))
    g = generic.select(role, F.col(value).alias("_generic"))
    out = rows.join(s, key, "left").join(g, role, "left").withColumn(value, F.coalesce("_specific", "_generic"))
    warning = F.when(F.col("_specific").isNotNull(), None).when(F.col("_generic").isNotNull(), "generic_profile_used").otherwise("no_profile")
    return out.withColumn("warning", warning).drop("_specific", "_generic")


def by_array_key(rows: DataFrame, array: str, other: DataFrame, key: str) -> DataFrame:
    """Join through an array of ids."""
    return rows.withColumn(key, F.explode(array)).join(other, key)


def name_selection(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested names with the id of the node of that name, in any case; null where there is none."""
    known = nodes.groupBy(F.lower("name").alias("_k")).agg(F.min("node_id").alias("node_id"))
    return names.join(known, F.lower("requested") == F.col("_k"), "left").select("requested", "node_id", F.col("node_id").isNotNull().alias("found"))


# Aggregations


def counts(rows: DataFrame, *keys: str, unknown: str = "unknown") -> DataFrame:
    """Rows per key; null keys count as "unknown"."""
    return rows.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit(unknown)).alias(k) for k in keys]).agg(F.count("*").alias("n"))


def histogram_map(rows: DataFrame, key: str, array: str, name: str) -> DataFrame:
    """Per key a map of array element to count."""
    each = rows.select(key, F.explode(array).alias("_e")).groupBy(key, "_e").agg(F.count("*").alias("_n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_e", "_n")))).alias(name))


def class_profile(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class with its counts of kinds, three histograms and its tabs with their entries.

    entries: cls, tab_id, tab, kind, entry, name, resources, schools, tags;
    classes: cls. A class without entries has zeros. Histograms are arrays of
    (value, n), most frequent first, ties by value; tabs stand by id.
    """
    own = entries.join(classes.select("cls").distinct(), "cls", "left_semi")
    counted = own.groupBy("cls").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("ability", "talent")])
    out = classes.join(counted, "cls", "left").fillna(0, ["ability", "talent"])
    for column in ("resources", "schools", "tags"):
        each = own.select("cls", F.explode(column).alias("value")).filter(F.coalesce("value", F.lit("")) != "").groupBy("cls", "value").agg(F.count("*").alias("n"))
        listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_o"), "value", "n")))
        out = out.join(each.groupBy("cls").agg(F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(column)), "cls", "left")
    row = F.struct("entry", "name", "kind")
    tabs = own.groupBy("cls", "tab_id", "tab").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("ability", "talent")], F.sort_array(F.collect_list(row)).alias("entries"))
    nested = tabs.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("tab_id", "tab", "ability_count", "talent_count", "entries"))).alias("tabs"))
    return out.join(nested, "cls", "left")


def sampled_counts(rows: DataFrame, keys: list[str], order: list[str], first: int, sample: str) -> DataFrame:
    """Rows per group with the first few of them as a sample."""
    w = Window.partitionBy(*keys).orderBy(*order)
    few = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first)
    samples = few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", sample))), lambda x: x[sample]).alias("samples"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).join(samples, keys)


def mode(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most common label per key, ties to the smaller label, with its share."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    best = n.groupBy(*keys).agg(F.max("_n").alias("_top"), F.sum("_n").alias("_all"))
    first = n.join(best, keys).filter("_n = _top").groupBy(*keys).agg(F.min(label).alias(label), F.first("_top").alias("_top"), F.first("_all").alias("_all"))
    return first.select(*keys, label, ratio(F.col("_top"), F.col("_all")).alias("share"))


# Windows


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group; the order ends in a unique column. Spark limits the groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def rank_buckets(place: Column) -> Column:
    return F.when(place <= 3, "primary").when(place <= 7, "secondary").otherwise("situational")


def trim(rows: DataFrame, keys: list[str], mandatory: Column, order: list[Column], n: int) -> DataFrame:
    """At most n rows per group, the mandatory ones first."""
    return top_k(rows, keys, [mandatory.cast("int").desc(), *order], n)


def spent_so_far(rows: DataFrame, keys: list[str], order: str, cost: str) -> DataFrame:
    return rows.withColumn("spent", F.sum(cost).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


# Dedupe and set operations


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ``dropDuplicates`` would keep any."""
    return top_k(rows, keys, [F.col(o) for o in order], 1).drop("place")


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate with partial sums of one row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return last_by(both, keys, ["_v"]).drop("_v")


def overlay(layers: DataFrame, keys: list[str], layer: str, rank: Column) -> DataFrame:
    """Of layered rows the one of the highest layer, with the chain of layers that supply the key."""
    ranked = layers.withColumn("_rank", rank)
    rest = [c for c in layers.columns if c not in keys]
    return ranked.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "_rank").alias("_r"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_rank", layer))), lambda x: x[layer]), ">").alias("chain")
    ).select(*keys, "_r.*", "chain")


def order_inversions(layers: DataFrame, keys: list[str], declared: Column, loaded: Column) -> DataFrame:
    """Layers that were loaded after one which outranks them: of the same key, by the declared order.

    The running maximum of the declared rank over the load order says which
    layer had the last word before; a layer below it is out of order. Layers of
    one key are few: the archives that supply it.
    """
    w = Window.partitionBy(*keys).orderBy("_l", "_d").rowsBetween(Window.unboundedPreceding, -1)
    placed = layers.withColumns({"_d": declared, "_l": loaded})
    placed = placed.withColumn("outranked_by", F.max("_d").over(w))
    return placed.filter(F.col("_d") < F.col("outranked_by")).drop("_d", "_l")


def set_relation(observed: Column, expected: Column) -> Column:
    """How an observed id set stands to the expected one."""
    missing, extra = F.size(F.array_except(expected, observed)), F.size(F.array_except(observed, expected))
    return F.when((missing == 0) & (extra == 0), "exact").when(missing == 0, "extended").when(extra == 0, "changed").otherwise("ambiguous")
