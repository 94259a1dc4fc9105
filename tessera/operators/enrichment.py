"""Rows put together from a catalogue and what was fetched for it: tooltips, enrichment, items, mechanics of three sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import escaped, item_kind, safe_html
from tessera.operators.reconcile import identity_gate
from tessera.operators.relational import first_by


def plain_name(name: Column) -> Column:
    """Lower case, all but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def choose_tooltip(nodes: DataFrame, fetched: DataFrame) -> DataFrame:
    """The tooltip of each node (node, spell, name, text): the fetched one if it matched, else its own text.

    fetched: spell, status, tooltip_text, tooltip_html, name_match; one row per
    spell. Result: tooltip_id, node, name, text, html, source, confidence, warning.
    """
    side = fetched.filter("status = 'matched'").select("spell", F.struct("tooltip_text", "tooltip_html", "name_match").alias("_db"))
    j = nodes.join(side, "spell", "left")
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    db, same = F.col("_db").isNotNull(), F.coalesce(F.col("_db.name_match"), F.lit(False))
    own = F.coalesce(filled(F.col("text")), F.col("name"))
    text = F.when(db, F.coalesce(filled(F.col("_db.tooltip_text")), own)).otherwise(own)
    body = F.when(db, F.coalesce(filled(safe_html(F.col("_db.tooltip_html"))), escaped(text))).otherwise(escaped(text))
    return j.select(
        F.when(F.col("spell").isNotNull(), F.concat(F.lit("spell:"), F.col("spell").cast("string"))).otherwise(F.concat(F.lit("entry:"), F.col("node").cast("string"))).alias("tooltip_id"),
        "node", "name", text.alias("text"), F.concat(F.lit("<strong>"), escaped(F.col("name")), F.lit("</strong><div>"), body, F.lit("</div>")).alias("html"), F.when(db, "fetched").otherwise("own").alias("source"),
        F.when(db & same, "high").when(db | filled(F.col("text")).isNotNull(), "medium").otherwise("low").alias("confidence"), F.when(db & ~same, "name_mismatch").alias("warning"),
    )


def enrichment_rows(entries: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row per distinct id of the catalogue: what was fetched, the entry, and whether the names agree.

    entries: entry, spell, name; fetched: spell, name, status, tooltip_level.
    Of several entries with one id the last by entry id counts; an id without
    a fetched row failed.
    """
    last = entries.filter("spell IS NOT NULL").groupBy("spell").agg(F.max_by(F.struct("entry", "name"), "entry").alias("_e"))
    f = fetched.select("spell", F.col("name").alias("fetched_name"), "status", "tooltip_level")
    match = (F.coalesce("fetched_name", F.lit("")) != "") & (plain_name(F.col("fetched_name")) == plain_name(F.col("_e.name")))
    return last.join(f, "spell", "left").select(
        "spell", F.coalesce("status", F.lit("fetch_failed")).alias("status"), "fetched_name", "tooltip_level", F.col("_e.entry").alias("entry"), F.col("_e.name").alias("own_name"), F.coalesce(match, F.lit(False)).alias("name_match")
    )


def enrichment_summary(rows: DataFrame) -> DataFrame:
    """One row: number of ids, counts per status as a map, name mismatches, rows with a level."""
    statuses = rows.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    one = rows.agg(F.count("*").alias("ids"), F.count_if((F.col("status") == "matched") & ~F.col("name_match")).alias("name_mismatches"), F.count("tooltip_level").alias("with_level"))
    return one.crossJoin(statuses)  # one row each


def item_rows(payloads: DataFrame) -> DataFrame:
    """Items of matched payloads; slot, class and types from the tooltip where they aren't given, stats as a map.

    payloads: item, status, name, tooltip_text, inventory_type, item_class, weapon_type, armor_type, stats (array of name and value).
    """
    told = item_kind(F.col("tooltip_text"))
    own = lambda kind: F.when(told["item_class"] == kind, told["item_subclass"])
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    stats = F.filter(F.coalesce("stats", F.array().cast("array<struct<name:string,value:double>>")), lambda s: (F.coalesce(s["name"], F.lit("")) != "") & s["value"].isNotNull())
    names = F.array_distinct(F.transform(stats, lambda s: s["name"]))
    last = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(stats, lambda s: s["name"] == n), -1)["value"]))
    return payloads.filter("status = 'matched'").select(
        "item", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(filled("inventory_type"), told["inventory_type"]).alias("slot"), F.coalesce(filled("item_class"), told["item_class"]).alias("item_class"),
        F.coalesce(filled("weapon_type"), own("weapon")).alias("weapon_type"), F.coalesce(filled("armor_type"), own("armor")).alias("armor_type"), last.alias("stats"), F.lit("medium").alias("confidence"),
    )


def stat_totals(items: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the stats of all items: maps ``stats`` and ``ratings`` (a rating replaces the stat of its name), spell and attack power added.

    Result: by, stat, total.
    """
    both = F.map_concat(F.map_filter("stats", lambda k, v: ~F.array_contains(F.map_keys("ratings"), k)), F.col("ratings"))
    own = F.map_entries(both.cast("map<string,double>"))
    power = F.array(*[F.struct(F.lit(c).alias("key"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in ("spell_power", "attack_power")])
    each = items.select(*by, F.explode(F.concat(own, power)).alias("e")).select(*by, F.col("e.key").alias("stat"), F.col("e.value").cast("decimal(18,4)").alias("v"))
    return each.groupBy(*by, "stat").agg(F.sum("v").cast("double").alias("total")).filter("total <> 0")


def three_sources(entries: DataFrame, fetched: DataFrame, client: DataFrame) -> DataFrame:
    """One row per spell of the catalogue with its nodes in order, its fetched and its client row, and whether the fetched one may be used.

    The gate is that of ``reconcile.identity_gate``: the reference is the
    client's name, else the builders' if they agree, else the fetched one; a
    fetched row of another name, or one that can't be told, is excluded, with
    the reason. entries: entry, spell, name; fetched and client: spell, name and others.
    """
    nodes = entries.filter("spell IS NOT NULL").groupBy("spell").agg(F.array_sort(F.collect_list(F.struct("entry", "name"))).alias("nodes"))
    side = lambda df, name: first_by(df, ["spell"], ["name"]).select("spell", F.struct(*[c for c in df.columns if c != "spell"]).alias(name))
    j = nodes.join(side(fetched, "fetched"), "spell", "left").join(side(client, "client"), "spell", "left")
    named = j.withColumns({"client_name": F.col("client.name"), "builder_names": F.transform("nodes", lambda n: n["name"]), "db_name": F.col("fetched.name")})
    gated = identity_gate(named, plain_name).drop("client_name", "db_name")
    excluded = F.when(F.col("fetched").isNotNull(), F.col("excluded_reason"))
    return gated.withColumns({"excluded_reason": excluded, "fetched_usable": F.col("fetched").isNotNull() & excluded.isNull()})


def single_source(rows: DataFrame, field: str) -> DataFrame:
    """A field that only the fetched side has: its value if that side may be used, with source, reason and why not; no row where it is absent."""
    value, ok = F.col("fetched")[field], F.col("fetched_usable")
    chosen = F.when(ok, "db_fallback").otherwise("omitted_no_eligible_candidate")
    return rows.filter(value.isNotNull()).select("spell", F.when(ok, value).alias("value"), F.when(ok, "fetched").alias("source"), chosen.alias("reason"), F.when(~ok, F.col("excluded_reason")).alias("ineligible"))
