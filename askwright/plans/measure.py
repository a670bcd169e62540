"""Measurement queries over decision records derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.functions import stats
from askwright.operators import measurement as m
from askwright.plans.base import planted, planted_sql, query, rounded, table, values

Z = "1.959963984540054"


def wilson_sql(k: str, n: str, sign: str) -> str:
    edge = "1.0" if sign == "+" else "0.0"
    n, k = f"CAST({n} AS DOUBLE)", f"CAST({k} AS DOUBLE)"
    return f"CASE WHEN {n} <= 0 THEN {edge} ELSE greatest(0.0, least(1.0, ({k}/{n} + {Z}*{Z}/(2*{n}) {sign} {Z}*sqrt({k}/{n}*(1-{k}/{n})/{n} + {Z}*{Z}/(4*{n}*{n})))/(1+{Z}*{Z}/{n}))) END"


def records(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    e = li.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1))))
    k = (F.col("l_partkey") + F.col("e") * F.col("l_suppkey")) % 10
    f = lambda i: F.concat(F.lit("F"), ((F.col("l_orderkey") + F.col("l_partkey") % 3 + i) % 50).cast("string"))
    return e.select(
        F.when(F.col("e") == 0, "base").otherwise("routed").alias("engine"), (F.col("l_linenumber") % 3).alias("run"), F.col("l_orderkey").alias("ticket_id"),
        F.concat(F.lit("c"), (F.col("l_orderkey") % 3).cast("string")).alias("client"), (F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ord"),
        F.when(k < 6, "fiche").when(k < 9, "question").otherwise("abstain").alias("kind"), F.array(f(0), f(1), f(2)).alias("fiches"),
        F.when(F.col("l_orderkey") % 5 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("F"), (F.col("l_orderkey") % 50).cast("string")))).alias("expected"),
        F.when(F.col("l_partkey") % 11 != 0, rounded(F.col("l_extendedprice") / 10000, 2)).alias("score"), (F.col("l_quantity") / 10).alias("latency_s"),
        F.when(F.col("l_suppkey") % 97 == 0, "timeout").alias("error"), F.when(F.col("l_partkey") % 4 < 3, F.concat(F.lit("L"), (F.col("l_partkey") % 4).cast("string"))).alias("level"),
        (F.col("l_quantity") * 100).alias("tokens_in"), (F.col("l_quantity") * 7).alias("tokens_out"),
    )


R = """r AS (SELECT CASE e WHEN 0 THEN 'base' ELSE 'routed' END AS engine, l_linenumber % 3 AS run, l_orderkey AS ticket_id, 'c' || (l_orderkey % 3) AS client, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS ord,
 CASE WHEN (l_partkey + e * l_suppkey) % 10 < 6 THEN 'fiche' WHEN (l_partkey + e * l_suppkey) % 10 < 9 THEN 'question' ELSE 'abstain' END AS kind,
 ['F' || ((l_orderkey + l_partkey % 3) % 50), 'F' || ((l_orderkey + l_partkey % 3 + 1) % 50), 'F' || ((l_orderkey + l_partkey % 3 + 2) % 50)] AS fiches,
 CASE WHEN l_orderkey % 5 = 0 THEN [] ELSE ['F' || (l_orderkey % 50)] END AS expected,
 CASE WHEN l_partkey % 11 <> 0 THEN round(l_extendedprice / 10000, 2) END AS score, l_quantity / 10 AS latency_s, CASE WHEN l_suppkey % 97 = 0 THEN 'timeout' END AS error,
 CASE WHEN l_partkey % 4 < 3 THEN 'L' || (l_partkey % 4) END AS level, l_quantity * 100 AS tokens_in, l_quantity * 7 AS tokens_out FROM lineitem, (VALUES (0), (1)) AS v(e)),
lr AS (SELECT *, CASE WHEN kind = 'fiche' THEN fiches[1] END AS shown FROM r QUALIFY row_number() OVER (PARTITION BY engine, run, client, ticket_id ORDER BY ord DESC) = 1),
c AS (SELECT * FROM lr WHERE run = (SELECT min(run) FROM r r2 WHERE r2.engine = lr.engine))"""
EXACT = "(len(expected) > 0 AND list_contains(expected, shown))"


@query(f"WITH {R} SELECT engine, count(*) AS tickets, count(*) FILTER (WHERE len(expected) > 0) AS with_fiche, count(*) FILTER (WHERE {EXACT}) AS exact, count(*) FILTER (WHERE shown IS NOT NULL AND NOT list_contains(expected, shown)) AS wrong_shown, count(*) FILTER (WHERE shown IS NULL) AS no_fiche, count(*) FILTER (WHERE kind = 'question') AS questions, count(*) FILTER (WHERE len(expected) = 0 AND shown IS NULL) AS correct_none, count(*) FILTER (WHERE len(expected) > 0 AND list_has_any(fiches[1:5], expected)) AS recall5 FROM c GROUP BY engine")
def summarize_results(spark, d):
    return m.summarize(records(spark, d))


@query(f"WITH {R} SELECT engine, round(quantile_cont(latency_s, 0.5), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, count(*) AS n FROM r WHERE error IS NULL GROUP BY engine")
def percentile_latency(spark, d):
    return m.latencies(records(spark, d))


@query(f"WITH {R}, p AS (SELECT engine, client, ticket_id, count(DISTINCT kind || '|' || coalesce(shown, '')) AS sigs, count(*) AS seen, bool_or(run = 0) AS f FROM lr GROUP BY ALL) SELECT engine, count(*) FILTER (WHERE sigs = 1 AND seen = 3) AS stable, count(*) AS n FROM p WHERE f GROUP BY engine")
def stability_runs(spark, d):
    return m.stability(records(spark, d))


@query(f"WITH {R} SELECT engine, run, count(*) FILTER (WHERE {EXACT}) AS exact, count(*) AS n FROM lr WHERE len(expected) > 0 GROUP BY engine, run")
def exact_by_run(spark, d):
    return m.exact_by_run(records(spark, d))


@query(f"""WITH RECURSIVE {R}, j AS (SELECT x.client, x.ticket_id, list_contains(x.expected, x.shown) AS a, list_contains(y.expected, y.shown) AS b FROM c x JOIN c y ON x.client = y.client AND x.ticket_id = y.ticket_id AND x.engine = 'base' AND y.engine = 'routed' WHERE len(x.expected) > 0),
t AS (SELECT count(*) AS tickets, count(*) FILTER (WHERE coalesce(a, false) AND NOT coalesce(b, false)) AS first_only, count(*) FILTER (WHERE coalesce(b, false) AND NOT coalesce(a, false)) AS second_only, count(*) FILTER (WHERE coalesce(a, false) AND coalesce(b, false)) AS both, count(*) FILTER (WHERE NOT coalesce(a, false) AND NOT coalesce(b, false)) AS neither FROM j)
SELECT *, round(CASE WHEN first_only + second_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(first_only + second_only + 1) - lgamma(i + 1) - lgamma(first_only + second_only - i + 1) - (first_only + second_only) * ln(2.0))) FROM range(0, least(first_only, second_only) + 1) AS g(i))) END, 6) AS p_value FROM t""")
def mcnemar_pairs(spark, d):
    return m.compare(records(spark, d), "base", "routed")


SWEEP = f"""{R}, k AS (SELECT engine, score, {EXACT} AS ok, shown FROM c WHERE shown IS NOT NULL), tot AS (SELECT engine, count(*) AS n, count(*) FILTER (WHERE len(expected) > 0) AS answerable FROM c GROUP BY engine),
th AS (SELECT DISTINCT engine, score AS threshold FROM k WHERE score IS NOT NULL UNION ALL SELECT DISTINCT engine, NULL FROM k WHERE score IS NOT NULL),
p AS (SELECT engine, score, count(*) AS k, count(*) FILTER (WHERE ok) AS e FROM k GROUP BY engine, score),
sw AS (SELECT th.engine, threshold, CAST(sum(p.e) AS BIGINT) AS exact, CAST(sum(p.k) - sum(p.e) AS BIGINT) AS wrong_shown, CAST(any_value(n) - sum(p.k) AS BIGINT) AS no_fiche, any_value(answerable) AS answerable, any_value(n) AS n
 FROM th JOIN p ON p.engine = th.engine AND (p.score IS NULL OR th.threshold IS NULL OR p.score >= th.threshold) JOIN tot ON tot.engine = th.engine GROUP BY th.engine, threshold)"""


@query(f"WITH {SWEEP} SELECT engine, threshold, exact, wrong_shown, no_fiche, answerable, n FROM sw")
def threshold_sweep(spark, d):
    return m.threshold_sweep(records(spark, d))


@query(f"WITH {SWEEP}, h AS (SELECT *, {wilson_sql('wrong_shown', 'n', '+')} AS high FROM sw) SELECT engine, threshold, exact, wrong_shown, round(high, 6) AS high FROM h WHERE high <= 0.2 QUALIFY row_number() OVER (PARTITION BY engine ORDER BY threshold NULLS FIRST) = 1")
def floor_recommend(spark, d):
    return m.recommend(m.threshold_sweep(records(spark, d)), 0.2)


@query(f"WITH {R} SELECT engine, coalesce(level, 'none') AS level, count(*) AS n, count(shown) AS shown, count(*) FILTER (WHERE {EXACT}) AS exact, count(*) FILTER (WHERE shown IS NOT NULL AND NOT list_contains(expected, shown)) AS wrong FROM c GROUP BY 1, 2")
def route_levels(spark, d):
    return m.by_route(records(spark, d))


@query(f"""WITH {R}, b AS (SELECT *, CASE WHEN kind IN ('fiche', 'question') THEN fiches[1] END AS ff FROM c WHERE engine = 'base'), q AS (SELECT *, CASE WHEN kind IN ('fiche', 'question') THEN fiches[1] END AS ff FROM c WHERE engine = 'routed'),
runs AS (SELECT DISTINCT engine, run FROM r WHERE run > 0), had AS (SELECT DISTINCT engine, run, client, ticket_id FROM r),
uneven AS (SELECT count(*) AS k FROM runs WHERE (SELECT count(*) FROM had WHERE had.engine = runs.engine AND had.run = runs.run) <> (SELECT count(*) FROM b) OR (SELECT count(*) FROM had JOIN b USING (client, ticket_id) WHERE had.engine = runs.engine AND had.run = runs.run) <> (SELECT count(*) FROM b)),
x AS (SELECT (SELECT count(*) FROM b FULL JOIN q USING (client, ticket_id) WHERE b.ord IS NULL OR q.ord IS NULL) AS unpaired, (SELECT count(*) FROM b JOIN q USING (client, ticket_id) WHERE list_sort(b.expected) <> list_sort(q.expected)) AS relabelled,
 (SELECT count(*) FROM r WHERE engine = 'routed' AND level IN ('L0', 'L1', 'L2') AND kind = 'fiche') AS exact_decisions, (SELECT count(DISTINCT (client, ticket_id)) FROM r WHERE engine = 'routed' AND level IN ('L0', 'L1', 'L2') AND kind = 'fiche' AND NOT list_contains(expected, fiches[1])) AS wrong_exact,
 (SELECT count(DISTINCT (client, ticket_id)) FROM r WHERE engine = 'routed' AND level IN ('L0', 'L1', 'L2') AND kind = 'fiche' AND ticket_id % 7 <> 0) AS unseen_exact,
 (SELECT count(*) FROM r WHERE error IS NOT NULL) AS errors, CAST(0 AS BIGINT) AS degraded, (SELECT count(*) FROM b JOIN q USING (client, ticket_id) WHERE len(b.expected) > 0 AND ticket_id % 7 <> 0) AS compared,
 (SELECT count(*) FROM b JOIN q USING (client, ticket_id) WHERE len(b.expected) > 0 AND ticket_id % 7 <> 0 AND list_contains(b.expected, b.ff)) AS base_first, (SELECT count(*) FROM b JOIN q USING (client, ticket_id) WHERE len(b.expected) > 0 AND ticket_id % 7 <> 0 AND list_contains(b.expected, q.ff)) AS route_first, (SELECT k FROM uneven) AS uneven),
y AS (SELECT *, list_filter([CASE WHEN unpaired > 0 THEN 'unpaired' END, CASE WHEN uneven > 0 THEN 'uneven_runs' END, CASE WHEN relabelled > 0 THEN 'relabelled' END, CASE WHEN errors > 0 THEN 'errors' END], lambda v: v IS NOT NULL) AS i,
 list_filter([CASE WHEN wrong_exact > 0 THEN 'wrong_exact' END, CASE WHEN route_first < base_first THEN 'right_first' END], lambda v: v IS NOT NULL) AS f,
 list_filter([CASE WHEN compared < 30 THEN 'few_questions' END, CASE WHEN exact_decisions = 0 THEN 'no_exact_decision' END, CASE WHEN exact_decisions > 0 AND unseen_exact = 0 THEN 'only_seen_questions' END], lambda v: v IS NOT NULL) AS s FROM x)
SELECT * EXCLUDE (i, f, s), array_to_string(list_concat(i, list_concat(f, s)), '|') AS reasons, CASE WHEN len(i) > 0 THEN 'invalid' WHEN len(f) > 0 THEN 'failed' WHEN len(s) > 0 THEN 'insufficient' ELSE 'passed' END AS status FROM y""")
def gate_status(spark, d):
    rows = records(spark, d)
    seen = rows.where("ticket_id % 7 = 0").select("client", "ticket_id")
    return m.gate(rows, "base", "routed", seen).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"SELECT source, count(*) FILTER (WHERE toxic = 1) AS k, count(*) AS n, round({wilson_sql('count(*) FILTER (WHERE toxic = 1)', 'count(*)', '-')}, 6) AS low, round({wilson_sql('count(*) FILTER (WHERE toxic = 1)', 'count(*)', '+')}, 6) AS high FROM labels JOIN documents USING (doc_id) GROUP BY source")
def wilson_by_source(spark, d):
    g = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("k"), F.count("*").alias("n"))
    return g.select("source", "k", "n", F.round(stats.wilson(F.col("k"), F.col("n"), False), 6).alias("low"), F.round(stats.wilson(F.col("k"), F.col("n"), True), 6).alias("high"))


@query(f"SELECT p, CAST((SELECT min(n) FROM range(1, 5001) g(n) WHERE {Z}*{Z}/(n + {Z}*{Z}) <= p) AS INTEGER) AS tickets FROM (SELECT DISTINCT (1 + o_orderkey % 200) / 400 AS p FROM orders)")
def tickets_needed(spark, d):
    return table(spark, d, "orders").select(((1 + F.col("o_orderkey") % 200) / 400).alias("p")).distinct().select("p", stats.tickets_needed(F.col("p")).alias("tickets"))


@query(f"WITH {R} SELECT engine, round(avg((tokens_in * 2.5 + tokens_out * 10.0) / 1e6), 6) AS cost_per_ticket FROM r GROUP BY engine")
def cost_by_engine(spark, d):
    return records(spark, d).groupBy("engine").agg(F.round(F.avg(stats.cost(F.col("tokens_in"), F.col("tokens_out"))), 6).alias("cost_per_ticket"))


@query(f"WITH {R} SELECT client, count(DISTINCT ticket_id) AS tickets, count(DISTINCT ticket_id) FILTER (WHERE len(expected) = 0) AS none_expected, count(DISTINCT ticket_id) FILTER (WHERE len(expected) > 0) AS labelled FROM r GROUP BY client")
def dataset_describe(spark, d):
    return records(spark, d).groupBy("client").agg(
        F.countDistinct("ticket_id").alias("tickets"), F.countDistinct(F.when(F.size("expected") == 0, F.col("ticket_id"))).alias("none_expected"), F.countDistinct(F.when(F.size("expected") > 0, F.col("ticket_id"))).alias("labelled")
    )


@query(f"WITH {R} SELECT DISTINCT unnest(expected) AS fiche FROM c EXCEPT SELECT unnest(fiches) FROM r WHERE engine = 'base' AND run = 0 AND ticket_id % 2 = 0")
def never_produced(spark, d):
    """Expected ids that an engine never returns."""
    rows = records(spark, d)
    want = m.canonical(rows).select(F.explode("expected").alias("fiche")).distinct()
    got = rows.where("engine = 'base' and run = 0 and ticket_id % 2 = 0").select(F.explode("fiches").alias("fiche")).distinct()
    return want.join(got, "fiche", "left_anti")


@query(f"WITH {R}, k AS (SELECT engine, run, client, ticket_id FROM lr), f AS (SELECT engine, client, ticket_id FROM k WHERE run = 0) SELECT engine, run, count(*) FILTER (WHERE side = 'missing') AS missing, count(*) FILTER (WHERE side = 'extra') AS extra FROM (SELECT f.engine, v.run, 'missing' AS side FROM f, (VALUES (1), (2)) v(run) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.engine = f.engine AND k.run = v.run AND k.client = f.client AND k.ticket_id = f.ticket_id) UNION ALL SELECT k.engine, k.run, 'extra' FROM k WHERE run > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.engine = k.engine AND f.client = k.client AND f.ticket_id = k.ticket_id)) GROUP BY engine, run")
def later_runs_keys(spark, d):
    """Questions that a later run lacks or adds."""
    k = m.last_of_run(records(spark, d)).select("engine", "run", *m.KEY)
    first = k.where("run = 0").drop("run")
    runs = k.where("run > 0").select("engine", "run").distinct()
    missing = first.join(F.broadcast(runs), "engine").join(k, ["engine", "run", *m.KEY], "left_anti").withColumn("side", F.lit("missing"))
    extra = k.where("run > 0").join(first, ["engine", *m.KEY], "left_anti").withColumn("side", F.lit("extra"))
    rows = missing.select("engine", "run", "side").unionByName(extra.select("engine", "run", "side"))
    return rows.groupBy("engine", "run").agg(F.count(F.when(F.col("side") == "missing", 1)).alias("missing"), F.count(F.when(F.col("side") == "extra", 1)).alias("extra"))


FAILURES = [(1, "HTTP 429 too many requests"), (2, "timeout while reading"), (3, "content filter refused"), (4, None), (5, "503 Service Unavailable"), (6, "invalid schema")]


@query(f"SELECT id, CASE WHEN message IS NULL THEN 'ok' WHEN regexp_matches(message, '(?i)429|5[0-9]{{2}}|timeout|timed out|throttl|connection') THEN 'transient' ELSE 'definitive' END AS class FROM {planted_sql(FAILURES, 'id int, message string')}")
def failure_classes(spark, d):
    c = F.when(F.col("message").isNull(), "ok").when(F.col("message").rlike(r"(?i)429|5[0-9]{2}|timeout|timed out|throttl|connection"), "transient").otherwise("definitive")
    return planted(spark, d, FAILURES, "id int, message string").select("id", c.alias("class"))
