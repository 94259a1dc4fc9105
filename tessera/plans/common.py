"""Tables by their roles, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_events(events: DataFrame) -> DataFrame:
    """The web event log as an event log of players: a log format is a function like this one."""
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("player"),
        F.col("event_type").alias("ability"),
        F.when(F.col("event_type").isin("purchase", "click"), "damage").when(F.col("event_type") == "view", "cast").otherwise("aura").alias("family"),
        F.get_json_object("props", "$.k").alias("target"),
        F.col("value").alias("amount"),
        F.greatest(F.lit(0.0), F.col("value") - 95.0).alias("overkill"),
        (F.col("value") >= 90).alias("critical"),
    )
