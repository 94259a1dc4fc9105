"""Event logs: metrics per player and ability, sessions, openers, usage, calibration.

Canonical columns: event_id, ts, player, ability, family, target, amount,
overkill, critical. Any log format becomes one by a function from DataFrame to
DataFrame (``DataFrame.transform``). Money-like amounts are summed as decimals,
so results do not depend on the order of rows. A hot ability or player is
pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event families.
DAMAGE_EVENTS = ("SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE", "RANGE_DAMAGE", "SWING_DAMAGE", "DAMAGE_SHIELD", "DAMAGE_SPLIT")
CAST_EVENTS = ("SPELL_CAST_SUCCESS", "SPELL_CAST_START")
AURA_EVENTS = ("SPELL_AURA_APPLIED", "SPELL_AURA_REMOVED", "SPELL_AURA_REFRESH", "SPELL_AURA_APPLIED_DOSE", "SPELL_AURA_REMOVED_DOSE")
CORRECTIONS = ("coefficient_correction", "proc_rate_correction", "tick_interval_correction", "uptime_correction")


def family(event: Column, damage=DAMAGE_EVENTS, cast=CAST_EVENTS, aura=AURA_EVENTS) -> Column:
    return F.when(event.isin(*cast), "cast").when(event.isin(*aura), "aura").when(event.isin(*damage), "damage").otherwise("other")


def total(value: Column) -> Column:
    return F.sum(value.cast("decimal(18,4)")).cast("double")


def net_amount(subtract_overkill: bool = True) -> Column:
    """The log form subtracts overkill; the session form does not."""
    amount = F.coalesce("amount", F.lit(0.0))
    return F.greatest(F.lit(0.0), amount - F.greatest(F.lit(0.0), F.coalesce("overkill", F.lit(0.0)))) if subtract_overkill else amount


def for_player(events: DataFrame, player: object, keep_null_source: bool) -> DataFrame:
    """Events of one player; rows without a player stay only in the session form."""
    own = F.col("player") == F.lit(player)
    return events.filter(own | F.col("player").isNull() if keep_null_source else own)


def player_metrics(events: DataFrame, subtract_overkill: bool = True) -> DataFrame:
    """Total damage, active seconds, damage per second and event count per player."""
    hit = F.when(F.col("family") == "damage", net_amount(subtract_overkill))
    seconds = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    out = events.groupBy("player").agg(F.coalesce(total(hit), F.lit(0.0)).alias("total_damage"), (seconds / 1e6).alias("active_time"), F.count("*").alias("event_count"))
    return out.withColumn("dps", F.coalesce(F.try_divide("total_damage", "active_time"), F.lit(0.0)))


def ability_metrics(events: DataFrame, subtract_overkill: bool = True) -> DataFrame:
    """Casts, hits, damage, crits, aura events, distinct targets and share of damage per player and ability."""
    is_hit = F.col("family") == "damage"
    out = events.groupBy("player", "ability").agg(
        F.count_if(F.col("family") == "cast").alias("casts"),
        F.count_if(is_hit).alias("hits"),
        F.coalesce(total(F.when(is_hit, net_amount(subtract_overkill))), F.lit(0.0)).alias("damage"),
        F.count_if(is_hit & F.coalesce("critical", F.lit(False))).alias("crits"),
        F.count_if(F.col("family") == "aura").alias("aura_events"),
        F.count_distinct(F.when(is_hit, F.col("target"))).alias("targets"),
    )
    whole = F.sum(F.col("damage").cast("decimal(24,4)")).over(Window.partitionBy("player")).cast("double")
    return out.withColumn("share", F.coalesce(F.try_divide("damage", whole), F.lit(0.0)))


def _ranged(events: DataFrame, width: str) -> DataFrame:
    """Events with the time range that they lie in: a player's events are ordered range by range, so no task has a whole player."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.withColumn("_range", F.floor(micros / F.lit(_micros(events, width))))


def _micros(events: DataFrame, width: str) -> int:
    zero = F.expr("TIMESTAMP '1970-01-01 00:00:00'")
    one = events.sparkSession.range(1).select((F.unix_micros(zero + F.expr(width)) - F.unix_micros(zero)).alias("w"))
    return one.first()["w"]


def sessionize(events: DataFrame, gap: str = "INTERVAL 30 MINUTES", width: str = "INTERVAL 1 DAY") -> DataFrame:
    """Number events into sessions per player: a new one starts when the gap has passed, as ``session_window`` has it.

    Events are ordered within time ranges of ``width``. Each range gives one row
    (first and last time, breaks inside); a window over these few rows says
    whether a range goes on with the session of the one before, and how many
    sessions came before it. So the largest group that a task orders is what one
    player does within one range, not the player.
    """
    local = Window.partitionBy("player", "_range").orderBy("ts", "event_id")
    before, place = F.lag("ts").over(local), F.row_number().over(local)
    breaks = ((place > 1) & (before.isNull() | (F.col("ts") >= before + F.expr(gap)))).cast("int")
    rows = _ranged(events, width).withColumn("_break", breaks).withColumn("_local", F.sum("_break").over(local))
    heads = rows.groupBy("player", "_range").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.sum("_break").alias("_breaks"))
    across = Window.partitionBy("player").orderBy("_range")
    opens = F.coalesce(F.col("_first") >= F.lag("_last").over(across) + F.expr(gap), F.lit(True)).cast("int")
    carried = heads.withColumn("_opens", opens).withColumn("_base", F.sum(F.col("_breaks") + F.col("_opens")).over(across) - F.col("_breaks"))
    return _stitched(rows, carried.select("player", "_range", "_base"), events.columns).withColumn("session", F.col("_base") + F.col("_local")).drop("_base", "_local")


def _stitched(rows: DataFrame, carried: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with what their range has from the ranges before; both are partitioned alike, so nothing moves."""
    side = carried.withColumnsRenamed({"player": "_player", "_range": "_at"})
    same = F.col("player").eqNullSafe(F.col("_player")) & F.col("_range").eqNullSafe(F.col("_at"))
    inner = [c for c in rows.columns if c.startswith("_local")]
    return rows.join(side, same).select(*columns, *inner, *[c for c in carried.columns if c not in ("player", "_range")])


def sessions(events: DataFrame, gap: str = "INTERVAL 30 MINUTES", width: str = "INTERVAL 1 DAY") -> DataFrame:
    numbered = sessionize(events, gap, width)
    return numbered.groupBy("player", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def marked_sessions(events: DataFrame, is_start: Column, is_stop: Column, width: str = "INTERVAL 1 DAY") -> DataFrame:
    """Sessions from one marker to the next per player; events before the first start, or after a stop, belong to none and go.

    Ordered range by range as in ``sessionize``; a range takes over how many
    starts came before it, and whether the last marker before it was a start.
    """
    local = Window.partitionBy("player", "_range").orderBy("ts", "event_id")
    rows = _ranged(events, width).withColumn("_marker", F.when(is_start, True).when(is_stop, False))
    rows = rows.withColumns({"_local": F.sum(is_start.cast("int")).over(local), "_local_on": F.last("_marker", ignorenulls=True).over(local)})
    order = F.struct("ts", "event_id")
    heads = rows.groupBy("player", "_range").agg(F.sum(is_start.cast("int")).alias("_starts"), F.max_by("_marker", F.when(F.col("_marker").isNotNull(), order)).alias("_left"))
    across = Window.partitionBy("player").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("player", "_range", F.coalesce(F.sum("_starts").over(across), F.lit(0)).alias("_base"), F.last("_left", ignorenulls=True).over(across).alias("_on"))
    whole = _stitched(rows, carried, events.columns)
    on = F.coalesce("_local_on", "_on", F.lit(False))
    return whole.filter(on).withColumn("session", F.col("_base") + F.coalesce("_local", F.lit(0))).drop("_base", "_local", "_local_on", "_on")


def latest_snapshot(events: DataFrame, fields: list[str]) -> DataFrame:
    """The last values of some fields per player and session."""
    return events.groupBy("player", "session").agg(F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("last")).select("player", "session", "last.*")


def opener(events: DataFrame, seconds: int = 15, first: int = 4) -> DataFrame:
    """The first distinct abilities within the first seconds of each session, in order."""
    starts = events.groupBy("player", "session").agg(F.min("ts").alias("_t0"))
    used = events.groupBy("player", "session", "ability").agg(F.min(F.struct("ts", "event_id")).alias("_at"))
    once = used.join(starts, ["player", "session"]).filter(F.col("_at.ts") <= F.col("_t0") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    place = F.row_number().over(Window.partitionBy("player", "session").orderBy("_at"))
    return once.withColumn("place", place).filter(F.col("place") <= first).select("player", "session", "place", "ability")


def core_loop(events: DataFrame, abilities: list[str], first: int = 12) -> DataFrame:
    """The first events of each session that use one of some abilities, as one ordered sequence."""
    place = F.row_number().over(Window.partitionBy("player", "session").orderBy("ts", "event_id"))
    some = events.filter(F.col("ability").isin(*abilities)).withColumn("_n", place).filter(F.col("_n") <= first)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "ability")))
    return some.groupBy("player", "session").agg(F.array_join(F.transform(ordered, lambda x: x["ability"]), ">").alias("sequence"))


def usage(events: DataFrame, seconds_each: float = 10.0) -> DataFrame:
    """Count, first and last use, and share of the session's length that the uses cover, per session and ability."""
    span = events.groupBy("player", "session").agg(F.min("ts").alias("_s"), F.max("ts").alias("_e"))
    used = events.groupBy("player", "session", "ability").agg(F.count("*").alias("uses"), F.min("ts").alias("first_use"), F.max("ts").alias("last_use"))
    length = (F.unix_micros(F.col("_e").cast("timestamp")) - F.unix_micros(F.col("_s").cast("timestamp"))) / 1e6
    covered = F.least(F.lit(100.0), F.coalesce(F.try_divide(100.0 * seconds_each * F.col("uses"), length), F.lit(100.0)))
    return used.join(span, ["player", "session"]).select("player", "session", "ability", "uses", "first_use", "last_use", F.round(covered, 2).alias("uptime_pct"))


def sample_confidence(n: Column, variance: Column) -> Column:
    return F.when((n < 10) | (variance > 0.5), "low").when((n >= 25) & (variance <= 0.1), "high").otherwise("medium")


def calibrate(observed: DataFrame, projected: DataFrame, key: str = "ability") -> DataFrame:
    """Observed over projected value per key; keys of one side only, and zero projections, get a warning instead."""
    o = observed.select(F.col(key), F.col("value").alias("observed"), "n", "variance")
    p = projected.select(F.col(key), F.col("value").alias("projected"))
    both = o.join(p, key, "full_outer")
    warning = (
        F.when(F.col("projected").isNull(), "observed_missing_in_projection").when(F.col("observed").isNull(), "projected_missing_in_observed").when(F.col("projected") <= 0, "projected_is_zero")
    )
    multiplier = F.when(warning.isNull(), F.round(F.try_divide("observed", "projected"), 3))
    return both.select(key, "observed", "projected", multiplier.alias("multiplier"), sample_confidence(F.coalesce("n", F.lit(0)), F.coalesce("variance", F.lit(0.0))).alias("confidence"), warning.alias("warning"))


def pending_corrections(ids: DataFrame, key: str) -> DataFrame:
    """Each id with each kind of correction, of low confidence, to be filled in."""
    kinds = F.array(*[F.lit(c) for c in CORRECTIONS])
    return ids.select(key).distinct().select(key, F.explode(kinds).alias("correction_type"), F.lit("low").alias("confidence"), F.lit("pending").alias("status"))
