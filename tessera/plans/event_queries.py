"""Event log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import events as ev
from tessera.plans.common import canonical_events, table
from tessera.session import shared_path
from tessera.streaming.event_stream import ROCKS, marked_stream, run_available, session_metrics, tumbling_metrics

EVENTS = """
e AS (
  SELECT event_id, ts, user_id AS player, event_type AS ability,
         CASE WHEN event_type IN ('purchase', 'click') THEN 'damage' WHEN event_type = 'view' THEN 'cast' ELSE 'aura' END AS family,
         json_extract_string(props, '$.k') AS target, value AS amount, greatest(0.0, value - 95.0) AS overkill, value >= 90 AS critical
  FROM events)
"""
SESSIONS = (
    EVENTS
    + """,
f AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS starts
  FROM e WINDOW w AS (PARTITION BY player ORDER BY ts, event_id)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY player ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM f)
"""
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").transform(canonical_events)


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ability_metrics(_events(spark, sf_dir))


def event_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.player_metrics(_events(spark, sf_dir))


def session_form_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session form: overkill is not subtracted, rows without a player would stay."""
    return ev.player_metrics(ev.for_player(_events(spark, sf_dir), 7, keep_null_source=True), subtract_overkill=False)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(_events(spark, sf_dir))


def session_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest_snapshot(ev.sessionize(_events(spark, sf_dir)), ["ability", "amount", "target"])


def opener_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.opener(ev.sessionize(_events(spark, sf_dir), "INTERVAL 1 DAY"), seconds=7200)


def core_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.core_loop(ev.sessionize(_events(spark, sf_dir), "INTERVAL 1 DAY"), ["click", "purchase"])


def action_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.usage(ev.sessionize(_events(spark, sf_dir), "INTERVAL 1 DAY"), seconds_each=600.0)


def _side(events: DataFrame, odd: int) -> DataFrame:
    some = events.filter(F.pmod("player", F.lit(2)) == odd).withColumn("key", F.concat_ws("/", "ability", "target"))
    mean = F.avg(F.col("amount").cast("decimal(18,4)")).cast("double")
    return some.groupBy("key").agg(F.round(mean, 6).alias("value"), F.count("*").alias("n"), F.round(F.var_pop(F.col("amount") / 100.0), 6).alias("variance"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return ev.calibrate(_side(events, 1), _side(events, 0), "key")


def pending_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.pending_corrections(_events(spark, sf_dir), "ability")


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    sessions = session_metrics(stream.transform(canonical_events))
    return run_available(spark, sessions, shared_path(spark, "stream"), shared_path(spark, "stream-state")).select(
        "player", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "events", F.col("amount").cast("double").alias("amount")
    )


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "events")
    return spark.readStream.schema(source.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).transform(canonical_events)


def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums per player and ability, of the hours that the watermark has passed."""
    made = run_available(spark, tumbling_metrics(_stream(spark, sf_dir)), shared_path(spark, "stream"), shared_path(spark, "stream-state"))
    return made.select("player", "ability", F.col("window.start").cast("timestamp_ntz").alias("started"), "events", F.col("amount").cast("double").alias("amount"))


def marked_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from a sign-up to the next, or to an error, on a stream: those whose closing marker the watermark has passed."""
    stream = marked_stream(_stream(spark, sf_dir), F.col("ability") == "signup", F.col("ability") == "error")
    made = run_available(spark, stream, shared_path(spark, "stream"), shared_path(spark, "stream-state"), store=ROCKS)
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


def marked_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.marked_sessions(_events(spark, sf_dir), F.col("ability") == "signup", F.col("ability") == "error")
    return found.groupBy("player", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


MARKED = """m AS (SELECT user_id AS player, ts, event_id, event_type = 'signup' AS starts, CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END AS marker FROM events WHERE {0}),
o AS (SELECT *, sum(starts::INT) OVER w AS session, last_value(marker IGNORE NULLS) OVER w AS is_on FROM m WINDOW w AS (PARTITION BY player ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT player, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM o WHERE is_on GROUP BY ALL)"""


def monotonic_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.cube import monotonic_violations

    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("value"))
    return monotonic_violations(daily, ["event_type"], "day")


QUERIES = {
    "event_metrics": (
        event_metrics,
        f"""WITH {EVENTS}, a AS (
  SELECT player, ability, count(*) FILTER (family = 'cast') AS casts, count(*) FILTER (family = 'damage') AS hits,
         coalesce(sum(greatest(0.0, amount - overkill)::DECIMAL(18,4)) FILTER (family = 'damage'), 0)::DOUBLE AS damage,
         count(*) FILTER (family = 'damage' AND critical) AS crits, count(*) FILTER (family = 'aura') AS aura_events,
         count(DISTINCT target) FILTER (family = 'damage') AS targets
  FROM e GROUP BY ALL)
SELECT *, coalesce(damage / nullif(sum(damage::DECIMAL(24,4)) OVER (PARTITION BY player)::DOUBLE, 0), 0.0) AS share FROM a""",
    ),
    "event_shares": (
        event_shares,
        f"""WITH {EVENTS}, a AS (
  SELECT player, coalesce(sum(greatest(0.0, amount - overkill)::DECIMAL(18,4)) FILTER (family = 'damage'), 0)::DOUBLE AS total_damage,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS active_time, count(*) AS event_count FROM e GROUP BY player)
SELECT *, coalesce(total_damage / nullif(active_time, 0), 0.0) AS dps FROM a""",
    ),
    "session_form_metrics": (
        session_form_metrics,
        f"""WITH {EVENTS}, a AS (
  SELECT player, coalesce(sum(coalesce(amount, 0)::DECIMAL(18,4)) FILTER (family = 'damage'), 0)::DOUBLE AS total_damage,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS active_time, count(*) AS event_count FROM e WHERE player = 7 OR player IS NULL GROUP BY player)
SELECT *, coalesce(total_damage / nullif(active_time, 0), 0.0) AS dps FROM a""",
    ),
    "event_sessions": (
        event_sessions,
        f"WITH {SESSIONS} SELECT player, session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY ALL",
    ),
    "session_snapshots": (
        session_snapshots,
        f"WITH {SESSIONS} SELECT player, session, ability, amount, target FROM s QUALIFY row_number() OVER (PARTITION BY player, session ORDER BY ts DESC, event_id DESC) = 1",
    ),
    "opener_sequence": (
        opener_sequence,
        f"""WITH {SESSIONS.replace("30 MINUTES", "1 DAY")},
o AS (SELECT *, min(ts) OVER (PARTITION BY player, session) AS t0 FROM s),
u AS (SELECT player, session, ability, min((ts, event_id)) AS first_at FROM o WHERE ts <= t0 + INTERVAL 7200 SECONDS GROUP BY ALL)
SELECT player, session, row_number() OVER (PARTITION BY player, session ORDER BY first_at) AS place, ability FROM u
QUALIFY place <= 4""",
    ),
    "core_loop": (
        core_loop,
        f"""WITH {SESSIONS.replace("30 MINUTES", "1 DAY")},
n AS (SELECT *, row_number() OVER (PARTITION BY player, session ORDER BY ts, event_id) AS n FROM s WHERE ability IN ('click', 'purchase'))
SELECT player, session, string_agg(ability, '>' ORDER BY n) AS sequence FROM n WHERE n <= 12 GROUP BY ALL""",
    ),
    "action_usage": (
        action_usage,
        f"""WITH {SESSIONS.replace("30 MINUTES", "1 DAY")},
t AS (SELECT player, session, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs FROM s GROUP BY ALL),
u AS (SELECT player, session, ability, count(*) AS uses, min(ts) AS first_use, max(ts) AS last_use FROM s GROUP BY ALL)
SELECT u.*, round(least(100.0, coalesce(100.0 * 600.0 * uses / nullif(secs, 0), 100.0)), 2) AS uptime_pct FROM u JOIN t USING (player, session)""",
    ),
    "calibration": (
        calibration,
        f"""WITH {EVENTS},
m AS (
  SELECT player % 2 AS odd, concat_ws('/', ability, target) AS key, round((sum(amount::DECIMAL(18,4)) / count(amount))::DOUBLE, 6) AS value, count(*) AS n, round(var_pop(amount / 100.0), 6) AS variance
  FROM e GROUP BY ALL),
j AS (
  SELECT coalesce(o.key, p.key) AS key, o.value AS observed, p.value AS projected, coalesce(o.n, 0) AS n, coalesce(o.variance, 0) AS v
  FROM (SELECT * FROM m WHERE odd = 1) o FULL JOIN (SELECT * FROM m WHERE odd = 0) p ON o.key = p.key),
w AS (SELECT *, CASE WHEN projected IS NULL THEN 'observed_missing_in_projection' WHEN observed IS NULL THEN 'projected_missing_in_observed' WHEN projected <= 0 THEN 'projected_is_zero' END AS warning FROM j)
SELECT key, observed, projected, CASE WHEN warning IS NULL THEN round(observed / projected, 3) END AS multiplier,
       CASE WHEN n < 10 OR v > 0.5 THEN 'low' WHEN n >= 25 AND v <= 0.1 THEN 'high' ELSE 'medium' END AS confidence, warning FROM w""",
    ),
    "pending_corrections": (
        pending_corrections,
        """SELECT ability, correction_type, 'low' AS confidence, 'pending' AS status
FROM (SELECT DISTINCT event_type AS ability FROM events)
CROSS JOIN (VALUES ('coefficient_correction'), ('proc_rate_correction'), ('tick_interval_correction'), ('uptime_correction')) v(correction_type)""",
    ),
    "session_stream": (
        session_stream,
        """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), n AS (SELECT *, sum((b IS NULL OR ts >= b + INTERVAL 30 MINUTES)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e),
g AS (SELECT user_id AS player, min(ts) AS started, max(ts) AS ended, count(*) AS events, sum(value::DECIMAL(18,4))::DOUBLE AS amount FROM n GROUP BY user_id, s)
SELECT player, started, events, amount FROM g WHERE ended + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
    ),
    "tumbling_stream": (
        tumbling_stream,
        """WITH t AS (SELECT user_id AS player, event_type AS ability, date_trunc('hour', ts)::TIMESTAMP AS started, value FROM events)
SELECT player, ability, started, count(*) AS events, sum(value::DECIMAL(18,4))::DOUBLE AS amount FROM t WHERE started + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES GROUP BY ALL""",
    ),
    "marked_sessions": (marked_sessions, f"WITH {MARKED.format('true')} SELECT * FROM g"),
    "marked_stream_sessions": (
        marked_stream_sessions,
        f"""WITH {MARKED.format("epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM events)")}, c AS (SELECT player, session::BIGINT AS session, bool_or(marker IS NOT NULL AND NOT marker) AS stopped FROM o GROUP BY ALL),
n AS (SELECT player, max(session) AS latest FROM c GROUP BY player)
SELECT g.*, CASE WHEN stopped THEN 'stop' ELSE 'start' END AS closed_by FROM g JOIN c USING (player, session) JOIN n USING (player) WHERE stopped OR session < latest""",
    ),
    "monotonic_days": (
        monotonic_days,
        """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS value FROM events GROUP BY ALL),
l AS (SELECT event_type, value < lag(value) OVER (PARTITION BY event_type ORDER BY day) AS falls FROM d)
SELECT event_type, count(*) FILTER (falls) AS violations FROM l GROUP BY event_type""",
    ),
}
