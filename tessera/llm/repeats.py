"""Rows that stand for several equal rows, and rows in one order without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Copies of one row that one task makes.
BLOCK = 4096


def repeat_rows(df: DataFrame, copies: str, index: str) -> DataFrame:
    """Each row ``copies`` times, numbered from 0 in ``index``; ``df`` is read twice and has to give the same rows.

    A row with very many copies is dealt out in blocks first, so no task makes
    them all. Where nothing is repeated, nothing is dealt out.
    """
    if df.filter(F.col(copies) > 1).isEmpty():
        return df.withColumn(index, F.lit(0).cast("long"))
    once = df.filter(F.col(copies) == 1).withColumn(index, F.lit(0).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / BLOCK).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.filter(F.col(copies) > 1).withColumn("_block", F.explode(blocks)).repartition(parts)
    first = F.col("_block") * BLOCK
    many = dealt.withColumn(index, F.explode(F.sequence(first, F.least(first + BLOCK, F.col(copies)) - 1))).drop("_block")
    return once.unionByName(many)


def numbered(df: DataFrame, order: Column, index: str) -> DataFrame:
    """Rows numbered from 0 by ``order``: sorted in ranges, then shifted by the sizes of the ranges before.

    The window has one row per range of the sort, not one per row.
    """
    ranges = materialize(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return ranges.withColumn("_part", part).join(starts, "_part").withColumn(index, F.col("_start") + place).drop("_part", "_start", "_at")
