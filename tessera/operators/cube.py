"""Coordinate tables: flat ordinals to coordinates, anchors, quality, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_coordinates(flat: DataFrame, n_first: int, n_second: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """(ordinal, value) of a padded table to (first, second, value); and one row of counts: emitted and padding.

    ordinal = first * stride + second, so a coordinate is arithmetic on the row itself.
    """
    placed = flat.withColumns({"first": F.floor(F.col("ordinal") / stride).cast("long"), "second": (F.col("ordinal") % stride).cast("long")})
    inside = (F.col("first") < n_first) & (F.col("second") < n_second)
    totals = placed.agg(F.count_if(inside).alias("emitted"), F.count_if(~inside).alias("padding"))
    return placed.filter(inside).select("first", "second", "value"), totals


#: The forms of a flat table's index.
FORMS = ("rating_by_level", "class_rating_scalar", "class_by_level", "class_only")


def indexed(flat: DataFrame, form: str, classes: DataFrame, level_stride: int, rating_stride: int, levels: int, ratings: int, offset: int = 1) -> tuple[DataFrame, DataFrame]:
    """(ordinal, value) in one of ``FORMS`` to (cls, rating, level, value), and one row of counts: emitted and padding.

    Levels go from 1 to ``levels``, ratings from 0 to ``ratings`` - 1; classes
    (cls) are those of the roster, and what an index form lacks is null. The
    place in the table is arithmetic on the ordinal, so nothing is crossed; only
    the roster is joined.
    """
    o, none = F.col("ordinal"), F.lit(None).cast("long")
    div = lambda x, n: F.floor(x / n).cast("long")
    cls, rating, level = {
        "rating_by_level": (none, div(o, level_stride), o % level_stride + 1),
        "class_rating_scalar": (div(o - offset, rating_stride) + 1, F.pmod(o - offset, F.lit(rating_stride)), none),
        "class_by_level": (div(o, level_stride) + 1, none, o % level_stride + 1),
        "class_only": (o + 1, none, none),
    }[form]
    placed = flat.select(o.alias("ordinal"), cls.cast("long").alias("cls"), rating.cast("long").alias("rating"), level.cast("long").alias("level"), "value")
    inside = (F.col("rating").isNull() | F.col("rating").between(0, ratings - 1)) & (F.col("level").isNull() | F.col("level").between(1, levels))
    kept = placed.filter(inside)
    if form != "rating_by_level":
        kept = kept.join(classes.select(F.col("cls").cast("long").alias("cls")).distinct(), "cls")
    totals = flat.agg(F.count("*").alias("_all")).crossJoin(kept.agg(F.count("*").alias("emitted")))  # one row each
    return kept.select("cls", "rating", "level", "value"), totals.select("emitted", (F.col("_all") - F.col("emitted")).alias("padding"))


def unmapped(rows: DataFrame, code: str, known: dict[int, str]) -> DataFrame:
    """(code, n) of codes without a name."""
    return rows.filter(~F.col(code).isin(*known)).groupBy(code).agg(F.count("*").alias("n"))


def roster_drift(observed: DataFrame, expected: list[int], key: str) -> DataFrame:
    """(id, finding): ids that are expected and missing, or there and not expected."""
    want = observed.sparkSession.createDataFrame([(i,) for i in expected], f"{key} long")
    both = observed.select(F.col(key).cast("long").alias(key), F.lit(True).alias("_o")).distinct().join(want.withColumn("_w", F.lit(True)), key, "full_outer")
    return both.withColumn("finding", F.when(F.col("_o").isNull(), "missing").when(F.col("_w").isNull(), "unexpected")).filter("finding IS NOT NULL").select(key, "finding")


def compare_anchors(cube: DataFrame, anchors: DataFrame) -> DataFrame:
    """Expected values within a tolerance: checked, equal, different and a status."""
    both = anchors.join(cube, ["first", "second"], "left")
    close = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    one = both.agg(F.count("value").alias("checked"), F.count_if(close).alias("equal"), F.count_if(F.col("value").isNotNull() & ~close).alias("different"))
    return one.withColumn("status", F.when(F.col("checked") == 0, "unverified").when(F.col("different") > 0, "mismatch").otherwise("match"))


def quality(cube: DataFrame, n_first: int, n_second: int) -> DataFrame:
    """Findings as counts: not finite, repeated coordinates, out of range."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    per = cube.groupBy("first", "second").agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad"))
    outside = (F.col("first") >= n_first) | (F.col("second") >= n_second) | (F.col("first") < 0) | (F.col("second") < 0)
    return per.agg(F.sum("_bad").alias("not_finite"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(outside).alias("out_of_range"), F.sum("_n").alias("rows"))


def monotonic_violations(rows: DataFrame, group: list[str], order: str, value: str = "value") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("_f", F.col(value) < before).groupBy(*group).agg(F.count_if("_f").alias("violations"))


class WrongNamespace(ValueError):
    """Coordinates of one namespace are looked up in a table of another."""


def lookup(rows: DataFrame, cube: DataFrame, axes: dict[str, str], namespace: str | None = None, expected: str | None = None) -> DataFrame:
    """Values at coordinates; misses stay with a flag. Raises if the table's namespace isn't the expected one."""
    if namespace != expected:
        raise WrongNamespace(f"coordinates of {expected}, a table of {namespace}")
    renamed = cube.select(*[F.col(axis).alias(column) for column, axis in axes.items()], "value")
    return rows.join(renamed, list(axes), "left").withColumn("missed", F.col("value").isNull())
