"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w``: ``u`` is a hash of its
id, ``w`` a quality weight, so a document of higher quality tends to come
earlier. A source whose target is e.g. 1.7 times its size gives one complete
epoch, and the remaining 0.7 are the documents of smallest key, up to the
budget; the document at the cut gives only as many words as still fit.

No source is ever sorted as a whole. The keys of a source are cut into
``RANGES`` ranges at their approximate quantiles, so each holds about as many
rows however the weights lie; sizes are summed by range and prefix-summed, and
the range that holds the cut is cut again, until it has few rows. Only that one
is ordered. What comes back to the documents is one row per source. The windows
have one row per source, or one per range, or the rows at the cut. While it
plans, the operator runs jobs; its tables in between are deleted.

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; a null id counts as an empty id; rows with equal id and size share the
cut evenly; an empty table gives an empty result. Other columns pass through;
``mix`` replaces input columns of its four output names, ``mixed`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Weights of the sources in code point order, repeating.
CYCLE = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
#: Ranges that a stretch of keys is cut into, and how many rows are ordered as they are.
RANGES, CUT_ROWS = 64, 2_000


#: What is added to rows, and what only stands there in between.
OUTPUT = ("size", "source_size", "target", "taken")
INNER = ("_key", "_rest", "_epochs", "_cut_key", "_cut_size", "_cut_take", "_source", "_copies", "_copy")


def set_aside(docs: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of reserved names renamed, and the names to give back."""
    away = {c: f"{c}_{i}_aside" for i, c in enumerate(docs.columns) if c.lower() in reserved}
    return docs.withColumnsRenamed(away), {new: old for old, new in away.items()}


def size_of(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Quality weight in [0.05, 1]: markup symbols per word lower it."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = F.try_divide(size.cast("double"), (size + 4 * symbols).cast("double"))
    return F.greatest(F.lit(0.05), F.coalesce(share, F.lit(1.0)))


def key_of(doc_id: Column, weight: Column, seed: int) -> Column:
    """The exponential key: 52 bits of a digest as the uniform variate."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return -F.log(uniform) / weight


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    sized = docs.withColumn("size", size_of(F.col("text")))
    return sized.withColumn("_key", key_of(F.col("doc_id"), quality_of(F.col("text"), F.col("size")), seed))


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) to targets: one row per source in, one out.

    ``share`` times all words are dealt by weight; no target is above ``limit``
    times its source, and what is cut off is dealt again by weight. With the
    sources in order of limit over weight, a prefix of them is full and the
    level of the others follows from prefix sums: the first level that the
    next source can hold is the final one. The window has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = sizes.withColumn("_w", F.get(weights, (F.row_number().over(by_name) - 1) % len(cycle)))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
    by_fill = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    final = F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(final * F.col("_w"), F.col("_cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def _narrowed(slim: DataFrame, spots: DataFrame) -> DataFrame:
    """For each source the part of its key stretch that holds the cut: a 64th of its rows, or all with one key."""
    within = F.expr("d.source <=> a.source AND (a._lo IS NULL OR d._key >= a._lo) AND (a._hi IS NULL OR d._key < a._hi)")
    inside = slim.alias("d").join(spots.alias("a"), within).select("d.source", "d._key", "d.size", "a._rest", "a._start", "a._lo", "a._hi")
    steps = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    bounds = materialize(inside.groupBy("source").agg(F.array_distinct(F.percentile_approx("_key", steps)).alias("_b")), "mix-bounds")
    ranged = inside.alias("d").join(bounds.alias("q"), F.expr("d.source <=> q.source")).select("d.*", "_b", F.size(F.filter("_b", lambda b: b <= F.col("d._key"))).alias("_range"))
    sums = ranged.groupBy("source", "_range").agg(
        F.sum("size").alias("_sum"), F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("_rest", "_start", "_lo", "_hi")], F.first(F.get("_b", F.col("_range") - 1)).alias("_from"), F.first(F.get("_b", F.col("_range"))).alias("_to")
    )
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    placed = sums.withColumn("_start", F.col("_start") + F.sum("_sum").over(upto) - F.col("_sum"))
    at = placed.filter("_start <= _rest AND _rest < _start + _sum")
    return at.select("source", "_rest", "_start", F.coalesce("_from", "_lo").alias("_lo"), F.coalesce("_to", "_hi").alias("_hi"), "_n")


def _cuts(slim: DataFrame, cycle, share: float, limit: float, rows: int = CUT_ROWS) -> DataFrame:
    """One row per source: target, full epochs, and where the fractional epoch is cut."""
    sizes = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "mix-sizes")
    sources = source_targets(sizes.select("source", "source_size"), cycle, share, limit)
    ratio = F.coalesce(F.floor(F.try_divide(F.floor("target").cast("double"), F.col("source_size").cast("double"))), F.lit(0))
    sources = sources.withColumn("_epochs", ratio.cast("long")).withColumn("_rest", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    sources = materialize(sources, "mix-sources")
    none = F.lit(None).cast("double")
    at = sources.alias("s").join(sizes.alias("n"), F.expr("s.source <=> n.source")).filter("_rest < s.source_size")
    at = materialize(at.select("s.source", "_rest", F.lit(0).cast("long").alias("_start"), none.alias("_lo"), none.alias("_hi"), "_n"), "mix-spots")
    while not (large := at.filter(F.col("_n") > rows)).isEmpty():
        better = materialize(_narrowed(slim, large), "mix-spots")
        fewer = better.alias("b").join(large.alias("l"), F.expr("b.source <=> l.source AND b._n < l._n"), "left_semi")
        done = fewer.isEmpty()  # all that is left are rows with one key, which are summed before they are ordered
        at = materialize(at.filter(F.col("_n") <= rows).unionByName(better), "mix-spots")
        if done:
            break
    inside = slim.alias("d").join(at.alias("a"), F.expr("d.source <=> a.source AND (a._lo IS NULL OR d._key >= a._lo) AND (a._hi IS NULL OR d._key < a._hi)"))
    ties = inside.groupBy("a.source", "_key", "size").agg(
        F.count("*").alias("_rows"), F.first("_start").alias("_start"), F.first("_rest").alias("_rest")
    )
    order = Window.partitionBy("source").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("_rows") * F.col("size")
    walked = ties.withColumn("_from", F.col("_start") + F.sum(whole).over(order) - whole)
    cut = walked.filter((F.col("_from") <= F.col("_rest")) & (F.col("_rest") < F.col("_from") + whole)).select(
        F.col("source").alias("_source"),
        F.col("_key").alias("_cut_key"),
        F.col("size").alias("_cut_size"),
        F.floor((F.col("_rest") - F.col("_from")) / F.col("_rows")).cast("long").alias("_cut_take"),
    )
    return sources.join(cut, F.expr("source <=> _source"), "left").drop("_source")


def mix(docs: DataFrame, seed: int = 0, cycle=CYCLE, share: float = SHARE, limit: float = LIMIT, rows: int = CUT_ROWS) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted)."""
    docs, back = set_aside(docs.drop(*OUTPUT), INNER)
    keyed = _keyed(docs, seed)
    with scratch(docs.sparkSession) as result:
        cuts = result(_cuts(materialize(keyed.select("source", "size", "_key"), "mix-keys"), cycle, share, limit, rows), "mix-cuts")
    cuts = cuts.withColumnRenamed("source", "_source")
    joined = keyed.join(cuts, F.expr("source <=> _source"), "left").drop("_source")
    # A source without a cut has its fractional epoch empty (the budget is an exact number of epochs).
    here, cut = F.struct("_key", "size"), F.struct("_cut_key", "_cut_size")
    extra = (
        F.when(F.col("_cut_key").isNull(), F.lit(0))
        .when(here < cut, F.col("size"))
        .when(here == cut, F.col("_cut_take"))
        .otherwise(F.lit(0))
    )
    taken = joined.withColumn("taken", (F.col("_epochs") * F.col("size") + extra).cast("long"))
    return taken.drop("_key", "_cut_key", "_cut_size", "_cut_take", "_epochs", "_rest").withColumnsRenamed(back)


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Repeat whole documents as the mix says; the document at the cut is repeated if at least half of it fits.

    A document of size 0 is never taken. A row that stands there twice is repeated twice.
    """
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0).cast("int")
    return mixed.filter(copies > 0).select(*[F.col(f"`{c}`") for c in columns], F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).drop("_copy")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``, whatever their names."""
    aside, back = set_aside(docs, OUTPUT + INNER)
    return expand(mix(aside, seed), aside.columns).withColumnsRenamed(back)
