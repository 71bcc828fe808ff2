"""Folds of ordered events, in batch form."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import folds
from .registry import Fixture, case, query, table

EVENTS = Fixture(
    "line string",
    (
        ('{"stream":"a","seq":1,"type":"progress","markdown":"one"}',), ("garbage",), ('{"stream":"a","seq":3,"type":"final","markdown":"done"}',), ('{"stream":"a","seq":4,"type":"progress","markdown":"late"}',),
        ('{"stream":"b","seq":1,"type":"progress","markdown":"x"}',), ('{"stream":"b","seq":2,"type":"progress","markdown":"xy"}',), ('{"stream":"b","seq":3,"type":"error"}',), ('{"other":1}',),
    ),
    "SELECT CASE WHEN event_id % 11 = 0 THEN 'garbage' ELSE '{{\"stream\":\"' || user_id || '\",\"seq\":' || event_id || ',\"type\":\"' || CASE event_type WHEN 'purchase' THEN 'final' WHEN 'error' THEN 'error' WHEN 'click' THEN 'progress' ELSE 'status' END || '\",\"markdown\":\"' || event_type || event_id || '\"}}' END AS line FROM {events}",
)


@query(
    "event_fold",
    f"""
    WITH e AS (SELECT line ->> '$.stream' AS stream, (line ->> '$.seq')::BIGINT AS seq, line ->> '$.type' AS kind, line ->> '$.markdown' AS markdown FROM {EVENTS.sql()} WHERE json_valid(line))
    SELECT stream, coalesce(arg_max(markdown, seq) FILTER (WHERE kind = 'final'), arg_max(markdown, seq) FILTER (WHERE kind = 'progress')) AS markdown, bool_or(kind = 'error') AS failed
    FROM e WHERE kind IS NOT NULL GROUP BY stream
    """,
)
def event_fold(spark, sf_dir):
    return folds.final_text(folds.parse_events(EVENTS.frame(spark, sf_dir), "line"))


@query(
    "stable_streak",
    """
    WITH RECURSIVE s AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (
      SELECT user_id, k, event_id, CASE WHEN v < 5 THEN 0 ELSE 1 END AS n, v AS low, v AS high FROM s WHERE k = 1
      UNION ALL
      SELECT s.user_id, s.k, s.event_id, CASE WHEN v < 5 THEN 0 WHEN n > 0 AND greatest(high, v) - least(low, v) <= 60 THEN n + 1 ELSE 1 END,
             CASE WHEN n > 0 AND greatest(high, v) - least(low, v) <= 60 THEN least(low, v) ELSE v END,
             CASE WHEN n > 0 AND greatest(high, v) - least(low, v) <= 60 THEN greatest(high, v) ELSE v END
      FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1
    )
    SELECT user_id, arg_min(event_id, k) AS at FROM f WHERE n >= 3 GROUP BY user_id
    """,
)
def stable_streak(spark, sf_dir):
    return folds.stable_release(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value"), 5, 60, 3)


@query(
    "changed_values",
    """
    SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    WHERE k = 1 OR before IS DISTINCT FROM event_type
    """,
)
def changed_values(spark, sf_dir):
    return folds.changed_values(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id", "user_id", "event_type")


DELTAS = Fixture(
    "stream string, seq long, at double, delta string",
    (("a", 1, 0.1, "short"), ("a", 2, 0.15, " and then a good deal more text"), ("a", 3, 0.2, " x"), ("a", 4, 0.6, "y"), ("a", 5, 0.61, "."), ("b", 1, 0.0, ""), ("b", 2, 0.1, "n\n")),
)


@case(
    "text_snapshots",
    "SELECT unnest(['a', 'a', 'a', 'b']) AS stream, unnest([2, 4, 5, 2])::BIGINT AS seq, unnest(['short and then a good deal more text', 'short and then a good deal more text xy', 'short and then a good deal more text xy.', 'n' || chr(10)]) AS markdown",
)
def text_snapshots(spark, sf_dir):
    return folds.snapshots(DELTAS.frame(spark, sf_dir))


@query(
    "lease_fold",
    """
    WITH RECURSIVE s AS (
      SELECT user_id::VARCHAR AS pool, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, epoch_us(ts) / 1e6 AS moment, CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END AS kind,
             'l' || (event_id % 4) AS lease, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS model, CASE WHEN event_type = 'view' THEN NULL ELSE value * 20000 END AS ttl FROM events
    ), f AS (
      SELECT DISTINCT pool, 0::BIGINT AS seq, [] :: STRUCT(l VARCHAR, m VARCHAR, e DOUBLE)[] AS live, NULL::VARCHAR AS lease, NULL::VARCHAR AS kind, NULL::BOOLEAN AS accepted FROM s
      UNION ALL
      SELECT pool, seq, CASE WHEN kind = 'release' THEN list_filter(kept, lambda x: x.l <> lease) WHEN accepted THEN list_append(kept, {'l': lease, 'm': model, 'e': CASE WHEN ttl > 0 THEN moment + ttl END}) ELSE kept END,
             lease, kind, accepted
      FROM (
        SELECT *, CASE WHEN kind = 'release' THEN len(list_filter(kept, lambda x: x.l = lease)) > 0 ELSE len(kept) < 2 AND len(list_filter(kept, lambda x: x.l = lease OR x.m <> model)) = 0 END AS accepted
        FROM (SELECT s.*, list_filter(f.live, lambda x: x.e IS NULL OR x.e > s.moment) AS kept FROM f JOIN s ON s.pool = f.pool AND s.seq = f.seq + 1)
      )
    )
    SELECT pool, seq, lease, kind, accepted FROM f WHERE seq > 0
    """,
)
def lease_fold(spark, sf_dir):
    """Users as pools: events take leases, errors give them back, views take them without end."""
    events = table(spark, sf_dir, "events")
    return folds.leases(
        events.select(
            F.col("user_id").cast("string").alias("pool"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"),
            F.when(F.col("event_type") == "error", "release").otherwise("acquire").alias("kind"), F.concat(F.lit("l"), F.col("event_id") % 4).alias("lease"),
            F.when(F.col("event_id") % 3 == 0, "b").otherwise("a").alias("model"), F.when(F.col("event_type") != "view", F.col("value") * 20000).alias("ttl"),
        ),
        most=2,
    )


@query(
    "heartbeats",
    """
    WITH e AS (SELECT user_id::VARCHAR AS stream, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS moment, event_type = 'purchase' AS text FROM events),
    n AS (SELECT stream, floor(coalesce(min(moment) FILTER (WHERE text), max(moment)) / 40000)::INTEGER AS n FROM e GROUP BY stream)
    SELECT stream, unnest(range(1, n + 1)) * 40000::DOUBLE AS at FROM n
    """,
)
def heartbeats(spark, sf_dir):
    """Users as streams that begin with their first event and say something when they buy."""
    began = F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id"))
    at = ((F.unix_micros(F.col("ts").cast("timestamp")) - began) / 1e6).alias("at")
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream"), at, (F.col("event_type") == "purchase").alias("has_text"))
    return folds.heartbeats(events, idle=40000.0)
