"""Manifests of datasets: order-free content hashes, verification, retention, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_row(df: DataFrame, name: str, schema_version: str = "1") -> DataFrame:
    """One row: records and an order-free hash of all rows (a decimal sum of row hashes)."""
    row = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("records"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("content_hash"), F.lit(schema_version).alias("schema_version"))


def manifest(tables: dict[str, DataFrame], generation: str, predecessor: str | None = None, paths: dict[str, str] | None = None) -> DataFrame:
    """One row per table: records, content hash and, where its path is given, the bytes of its files (from their metadata)."""
    out = None
    for name, df in tables.items():
        row = manifest_row(df, name)
        if paths:
            files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths[name])
            row = row.crossJoin(files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))  # one row each
        out = row if out is None else out.unionByName(row)
    return out.withColumns({"generation": F.lit(generation), "predecessor": F.lit(predecessor).cast("string")})


def verify(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """Children that are missing, new, or differ from the record; none means verified."""
    a, b = recorded.select("name", "records", "content_hash"), now.select("name", F.col("records").alias("_r"), F.col("content_hash").alias("_h"))
    both = a.join(b, "name", "full_outer")
    finding = F.when(F.col("_h").isNull(), "missing").when(F.col("content_hash").isNull(), "not_recorded").when(F.col("records") != F.col("_r"), "record_count_mismatch").when(F.col("content_hash") != F.col("_h"), "hash_mismatch")
    return both.withColumn("finding", finding).filter("finding IS NOT NULL").select("name", "finding")


LEDGER = ["name", "file", "bytes", "modified", "sha256"]


def _files(spark: SparkSession, paths: dict[str, str], content: bool) -> DataFrame:
    """(name, file, bytes, modified) of all files below the paths, and their content if it is asked for."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        file = F.element_at(F.split("path", "/"), -1)
        one = files.select(F.lit(name).alias("name"), file.alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
        out = one if out is None else out.unionByName(one)
    return out


def file_ledger(spark: SparkSession, paths: dict[str, str], before: DataFrame | None = None) -> DataFrame:
    """(name, file, bytes, modified, sha256) of all files of some tables.

    Of ``before``, an earlier ledger, rows of equal size and time are taken over:
    only files that are new or changed are read. A file is hashed in one task
    (files of more than 2 GB can't be); names of files are unique in a table.
    """
    key = ["name", "file", "bytes", "modified"]
    if before is None:
        return _files(spark, paths, True).withColumn("sha256", F.sha2("content", 256)).select(*LEDGER)
    known = before.select(*LEDGER)
    same = _files(spark, paths, False).join(known, key)
    other = _files(spark, paths, True).join(known.select(*key), key, "left_anti").withColumn("sha256", F.sha2("content", 256))
    return same.select(*LEDGER).unionByName(other.select(*LEDGER))


def generation_digest(ledger: DataFrame, predecessor: str = "") -> DataFrame:
    """One row: the digest of a generation, chained to its predecessor's.

    Files of a table in order of their names give the table's digest, tables in
    order of theirs, after the predecessor's digest, the generation's; times don't count.
    """
    entry = F.struct("file", F.concat_ws(":", "file", F.col("bytes").cast("string"), "sha256").alias("line"))
    tables = ledger.groupBy("name").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"]), "\n"), 256).alias("digest"))
    line = F.struct("name", F.concat_ws(":", "name", "digest").alias("line"))
    return tables.agg(F.sha2(F.concat(F.lit(predecessor + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")), 256).alias("digest"))


def verify_files(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(name, file, finding) of files that are missing, new, or of another size or content than recorded; none means verified."""
    a = recorded.select("name", "file", "bytes", "sha256")
    both = a.join(now.select("name", "file", F.col("bytes").alias("_b"), F.col("sha256").alias("_h")), ["name", "file"], "full_outer")
    finding = F.when(F.col("_h").isNull(), "missing").when(F.col("sha256").isNull(), "not_recorded").when(F.col("bytes") != F.col("_b"), "size_mismatch").when(F.col("sha256") != F.col("_h"), "hash_mismatch")
    return both.withColumn("finding", finding).filter("finding IS NOT NULL").select("name", "file", "finding")


def retention(generations: DataFrame, active: str, grace_seconds: int, now) -> DataFrame:
    """What may go: not the active generation, not its predecessor, and older than the grace time."""
    keep = generations.filter(F.col("generation") == active).select(F.explode(F.array("generation", "predecessor")).alias("generation")).filter("generation IS NOT NULL")
    old = generations.filter(F.col("published_at") < now - F.expr(f"INTERVAL {int(grace_seconds)} SECONDS"))
    return old.join(keep, "generation", "left_anti").select("generation", "published_at")


def freshness(rows: DataFrame, stale_days: int, now) -> DataFrame:
    """fresh, stale or failed per row."""
    from tessera.functions.values import is_fresh

    state = F.when(F.col("status") == "failed", "failed").when(is_fresh([F.col("verified_at"), F.col("fetched_at"), F.col("cached_at")], stale_days, now), "fresh").otherwise("stale")
    return rows.withColumn("state", state)
