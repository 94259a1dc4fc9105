"""Sinks: guarded projections, sorted listings, graph statements, nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateKeys(ValueError):
    """A projection's key occurs more than once."""


def write_json_sorted(df: DataFrame, path: str) -> DataFrame:
    """JSON lines with keys in sorted order; returns the manifest row with the content hash."""
    from tessera.operators.snapshots import manifest_row

    ordered = df.select(*sorted(df.columns))
    ordered.write.json(path)
    return manifest_row(ordered, path.rsplit("/", 1)[-1])


def write_projection(df: DataFrame, keys: list[str], keep, path: str) -> DataFrame:
    """Write the rows that pass; fail before writing if a key repeats; returns counts by confidence, withheld ones too."""
    kept = df.filter(keep)
    if not kept.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise DuplicateKeys(f"{keys} is not unique")
    kept.write.parquet(path)
    return df.withColumn("withheld", ~F.coalesce(keep, F.lit(False))).groupBy("withheld", "confidence").agg(F.count("*").alias("n"))


def value_gate(projected: DataFrame, reasons: str = "reasons") -> DataFrame:
    """One row: records of which some value was withheld as out of its domain, and the others. ``reasons``: field to why it was not decoded."""
    out = F.array_contains(F.map_values(reasons), "value_out_of_domain")
    return projected.agg(F.count_if(F.coalesce(out, F.lit(False))).alias("records_with_withheld_value"), F.count_if(~F.coalesce(out, F.lit(False))).alias("records_all_in_domain"))


def write_counts_tsv(df: DataFrame, keys: list[str], path: str) -> None:
    """A sorted listing of counts."""
    df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).write.csv(path, sep="\t", header=True)


def graph_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Statements that recreate a graph, one per line; quotes are escaped."""
    quoted = F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    n = nodes.select(F.format_string("MERGE (n:Node {id: %d}) SET n.name = '%s';", "node", quoted).alias("value"))
    e = edges.select(F.format_string("MATCH (a:Node {id: %d}), (b:Node {id: %d}) MERGE (a)-[:LINKS]->(b);", "a", "b").alias("value"))
    return n.unionByName(e)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
