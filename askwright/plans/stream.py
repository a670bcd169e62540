"""Queries on sessions and observers (the batch forms of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.plans.base import query, table
from askwright.streaming import sessions as s


def session_events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "text").otherwise("action")
    action = F.when(F.col("event_type") == "signup", "pick:1").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "blocked").otherwise("")
    return e.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("event_id"), kind.alias("kind"), F.when(F.col("event_id") % 5 == 0, "start").otherwise(action).alias("action"),
        F.array(F.concat(F.lit("F"), F.col("event_id") % 7), F.concat(F.lit("G"), F.col("event_id") % 3)).alias("fiches"), F.array(F.col("event_id") % 4 / 1.5, F.lit(0.5)).alias("scores"),
    )


@query()
def session_state(spark, d):
    """The state machine is no SQL: tests hold the stream against this fold."""
    return s.sessions_batch(session_events(spark, d))


@query("""WITH RECURSIVE e AS (SELECT event_type || '-' || (event_id % 11) AS term, user_id AS session, event_id, row_number() OVER (PARTITION BY event_type, event_id % 11 ORDER BY event_id) AS k FROM events),
w AS (SELECT term, k, 1 AS n, [session] AS last FROM e WHERE k = 1 UNION ALL SELECT e.term, e.k, w.n + CASE WHEN list_contains(w.last, e.session) THEN 0 ELSE 1 END, CASE WHEN list_contains(w.last, e.session) THEN w.last ELSE list_concat([e.session], w.last)[1:8] END FROM w JOIN e ON e.term = w.term AND e.k = w.k + 1)
SELECT term, arg_max(n, k) AS seen, arg_max(n, k) >= 3 AS ready FROM w GROUP BY term""")
def observe_terms(spark, d):
    e = table(spark, d, "events")
    return s.observe(e.select(F.concat_ws("-", "event_type", (F.col("event_id") % 11).cast("string")).alias("term"), F.col("user_id").alias("session"), F.col("event_id").alias("ord")))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_last, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def turn_index(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy(F.desc("turn"))).cast("long").alias("from_last"), F.count("*").over(w).alias("turns"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, d):
    """Event-time windows, an extra of this engine."""
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")
