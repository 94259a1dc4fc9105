"""Sources: typed JSON lines with rejects, versions, nested documents, logs, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.events import family

#: Keys under which a nested bucket may hold its entries.
ENTRY_KEYS = ("entries", "nodes", "items", "talents", "abilities", "values")


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects (file, number, line, reason); blank lines are skipped.

    A line is rejected that is no JSON object, or whose values don't have the
    schema's types. Numbers count all lines of the file from 1: lines stand in
    order within a split, so only the sizes of the splits are gathered, and
    only for rejects is a number worked out. Rows whose own fields are named
    ``_corrupt`` aren't supported.
    """
    kind = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    told = F.from_json("value", f"{kind}, `_corrupt` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = text.filter(F.trim("value") != "").withColumn("row", told)
    is_object = F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False))
    reason = F.when(~is_object, "not_a_json_object").when(F.col("row._corrupt").isNotNull(), "wrong_type")
    good = parsed.filter(reason.isNull()).select("row.*").drop("_corrupt")
    splits = text.groupBy("file", "split").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rejects = parsed.withColumn("reason", reason).filter("reason IS NOT NULL").join(splits, ["file", "split"])
    return good, rejects.select("file", (F.col("_before") + F.col("at") - F.col("_first") + 1).alias("number"), F.col("value").alias("line"), "reason")


def version_gate(rows: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Rows of one schema version; the others with a reason."""
    right = F.coalesce(F.col("schema_version") == version, F.lit(False))
    return rows.filter(right), rows.filter(~right).withColumn("reason", F.concat(F.lit("unsupported_schema_version:"), F.coalesce("schema_version", F.lit("none"))))


def flat_tabs(spark: SparkSession, path: str) -> DataFrame:
    """Nested class metadata documents as one row per tab."""
    schema = "class_id long, class_name string, tabs array<struct<tab_id:long,tab_name:string,sort_order:int,nominal_essence_kind:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("class_id", "class_name", F.inline("tabs"))


def content_log(spark: SparkSession, paths: dict[str, str], ids: tuple[str, ...]) -> DataFrame:
    """JSON files of several kinds as one log: kind, ids, the other fields as a map of strings, file and its hash."""
    out = None
    for kind, path in paths.items():
        text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
        rows = text.select("file", F.sha2("value", 256).alias("file_hash"), F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
        rest = F.map_filter("m", lambda k, v: ~k.isin(*ids) & v.isNotNull())
        part = rows.select(F.lit(kind).alias("kind"), *[F.try_element_at("m", F.lit(i)).cast("long").alias(i.lower()) for i in ids], rest.alias("values"), "file", "file_hash")
        out = part if out is None else out.unionByName(part)
    return out


def bucket_entries(json: Column) -> Column:
    """Entries of a nested bucket: the array itself, or the array under one of the known keys; as JSON strings."""
    plain = F.from_json(json, "array<string>")
    keyed = [F.from_json(F.get_json_object(json, f"$.{k}"), "array<string>") for k in ENTRY_KEYS]
    return F.coalesce(F.when(F.ltrim(json).startswith("["), plain), *keyed, F.array().cast("array<string>"))


def log_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text log lines (value) to events, and the lines that don't parse.

    ``M/D HH:MM:SS.mmm  EVENT,…``: six base fields, three spell fields for
    spell-like events (a ranged hit is one), then the damage suffix. Times get
    the year of the column ``year`` if there is one, else 1970.
    """
    header = r"^(\d+)/(\d+)\s+(\d+):(\d+):(\d+\.\d+)\s+(.+)$"
    text = F.trim("value")
    part = [F.regexp_extract(text, header, i) for i in range(1, 7)]
    body = F.from_csv(part[5], ", ".join(f"f{i} string" for i in range(22)), {"ignoreLeadingWhiteSpace": "true"})
    year = F.col("year") if "year" in lines.columns else F.lit(1970)
    parsed = lines.withColumns({"_ok": F.regexp_like(text, F.lit(header)), "_b": body, "_ts": F.make_timestamp(year, part[0].try_cast("int"), part[1].try_cast("int"), part[2].try_cast("int"), part[3].try_cast("int"), part[4].try_cast("decimal(8,6)"))})
    event = F.col("_b.f0")
    spell = event.startswith("SPELL_") | event.isin("DAMAGE_SHIELD", "DAMAGE_SPLIT", "RANGE_DAMAGE")
    kind = family(event)
    at = lambda i: F.when(spell, F.col(f"_b.f{i + 3}")).otherwise(F.col(f"_b.f{i}"))
    hit = kind == "damage"
    good = parsed.filter("_ok").select(
        F.col("_ts").alias("ts"),
        event.alias("event"),
        F.nullif(F.col("_b.f2"), F.lit("")).alias("player"),
        F.coalesce(F.when(spell, F.col("_b.f8")), F.when(event == "SWING_DAMAGE", "Swing").otherwise("Unknown")).alias("ability"),
        kind.alias("family"),
        F.coalesce(F.nullif(F.col("_b.f5"), F.lit("")), F.lit("Unknown")).alias("target"),
        F.when(hit, F.coalesce(at(7).try_cast("double"), F.lit(0.0))).alias("amount"),
        F.when(hit, F.coalesce(at(8).try_cast("double"), F.lit(0.0))).alias("overkill"),
        F.when(hit, F.coalesce(at(13).isin("1", "true", "True"), F.lit(False))).alias("critical"),
    )
    return good, parsed.filter("NOT _ok AND trim(value) <> ''").select(F.col("value").alias("line"))


def session_events(rows: DataFrame, json: str) -> DataFrame:
    """``{player, events[]}`` documents as events."""
    kind = "player string, events array<struct<ts:string,event:string,ability:string,target:string,amount:double,critical:boolean>>"
    return rows.select(F.from_json(json, kind).alias("d")).select("d.player", F.inline("d.events")).withColumn("family", family(F.col("event")))


def layout_documents(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Layout documents of one version as flat nodes and edges; others are skipped."""
    tree = "tree_kind:string,nodes:array<struct<entry_id:long,name:string,x:double,y:double>>,edges:array<struct<source_entry_id:long,target_entry_id:long,kind:string>>"
    docs = spark.read.schema(f"schema_version string, class_name string, trees array<struct<{tree}>>").json(path, multiLine=True).filter(F.col("schema_version") == version)
    trees = docs.select("class_name", F.explode("trees").alias("t"))
    return trees.select("class_name", "t.tree_kind", F.inline("t.nodes")), trees.select("class_name", "t.tree_kind", F.inline("t.edges"))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files by size; only their metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").orderBy(F.desc("length"), "path")
