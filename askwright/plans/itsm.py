"""Queries on ticket actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.operators import itsm as i
from askwright.plans.base import planted, planted_sql, query, table, values


@query("SELECT o_custkey, o_orderkey AS version, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_upsert(spark, d):
    return i.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("version"), "o_orderstatus", "o_totalprice")


A = "['password_reset', 'mfa_reset', 'offboarding', 'group_add', 'license_assign', 'escalate', 'other']"
G = f"""g AS (SELECT o_orderkey AS id, {A}[1 + o_orderkey % 7] AS action, o_custkey % 11 = 0 AS privileged, o_custkey % 5 <> 0 AS is_requester, o_custkey % 17 = 0 AS third_party, 'M' || (o_custkey % 3) AS opened_by, 'm' || (o_orderkey % 3) AS manager,
 o_custkey % 4 <> 0 AS group_ok, o_custkey % 6 = 0 AS member, o_custkey % 3 - 1 AS free_seats, (o_orderkey % 10) / 10.0 AS confidence FROM orders),
rr AS (SELECT id, list_filter([CASE WHEN action IN ('password_reset', 'mfa_reset') AND privileged THEN 'target_privileged_role' END, CASE WHEN action IN ('password_reset', 'mfa_reset') AND NOT is_requester THEN 'target_is_not_requester' END, CASE WHEN third_party THEN 'secret_requested_for_third_party' END,
 CASE WHEN action = 'offboarding' AND lower(opened_by) <> lower(manager) THEN 'requester_not_manager' END, CASE WHEN action = 'group_add' AND NOT group_ok THEN 'group_not_allowlisted' END, CASE WHEN action = 'group_add' AND member THEN 'already_member' END,
 CASE WHEN action = 'license_assign' AND free_seats <= 0 THEN 'no_free_license_seat' END, CASE WHEN action = 'escalate' THEN 'llm_escalated' END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS r FROM g)"""


def guarded(spark, d):
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    actions = F.array(*map(F.lit, ["password_reset", "mfa_reset", "offboarding", "group_add", "license_assign", "escalate", "other"]))
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.get(actions, (F.col("o_orderkey") % 7).cast("int")).alias("action"), (c % 11 == 0).alias("privileged"), (c % 5 != 0).alias("is_requester"), (c % 17 == 0).alias("third_party"),
        F.concat(F.lit("M"), c % 3).alias("opened_by"), F.concat(F.lit("m"), F.col("o_orderkey") % 3).alias("manager"), (c % 4 != 0).alias("group_ok"), (c % 6 == 0).alias("member"), (c % 3 - 1).alias("free_seats"), (F.col("o_orderkey") % 10 / 10.0).alias("confidence"),
    )
    return rows.withColumn("r", i.guard_reasons())


@query(f"WITH {G} SELECT id, array_to_string(r, ',') AS reasons, CASE WHEN list_has_any(r, ['target_privileged_role', 'target_is_not_requester', 'secret_requested_for_third_party']) THEN 'refused' WHEN len(r) > 0 THEN 'needs_human' ELSE 'pending_review' END AS status FROM rr")
def guard_reasons(spark, d):
    return guarded(spark, d).select("id", F.array_join("r", ",").alias("reasons"), i.guard_status(F.col("r")).alias("status"))


@query(f"WITH {G} SELECT coalesce(x, 'none') AS reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN [NULL] ELSE r END) AS x FROM rr) GROUP BY 1")
def queue_counts(spark, d):
    return guarded(spark, d).select(F.explode_outer("r").alias("x")).groupBy(F.coalesce("x", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


STEPS = [(1, False, "tt"), (2, True, "tt"), (3, False, "tf"), (4, False, ""), (5, True, "f")]


@query(f"SELECT id, CASE WHEN s = '' THEN 'blocked' WHEN contains(s, 'f') THEN 'partial' WHEN dry THEN 'dry_run' ELSE 'success' END AS status FROM {planted_sql(STEPS, 'id int, dry boolean, s string')}")
def execution_status(spark, d):
    rows = planted(spark, d, STEPS, "id int, dry boolean, s string")
    ok = F.transform(F.filter(F.split("s", ""), lambda x: x != ""), lambda x: x == "t")
    return rows.select("id", i.execution_status(F.col("dry"), ok).alias("status"))


@query("SELECT id FROM (SELECT event_id AS id, ts AS due_at, CASE WHEN event_id % 3 = 0 THEN 'validated' ELSE 'new' END AS status, CASE event_id % 4 WHEN 0 THEN 'dry_run' WHEN 1 THEN 'success' ELSE '' END AS execution FROM events) WHERE status = 'validated' AND (execution = '' OR (execution = 'dry_run' AND due_at >= TIMESTAMP '2024-01-20' - INTERVAL 2 DAYS)) ORDER BY due_at, id LIMIT 50")
def writeback_due(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select(e.alias("id"), F.col("ts").alias("at"), F.when(e % 3 == 0, "validated").otherwise("new").alias("status"), F.when(e % 4 == 0, "dry_run").when(e % 4 == 1, "success").otherwise("").alias("execution"))
    return i.writeback_due(rows, F.lit("2024-01-20").cast("timestamp")).select("id")


@query("""WITH u AS (SELECT s_name AS "user", 't' || (s_nationkey % 6) AS tenant, ['g' || (s_suppkey % 4), 'g' || (s_suppkey % 3)] AS grps FROM supplier), o AS (SELECT "user", 'c' || replace(tenant, 't', '') AS client FROM u WHERE tenant IN ('t0', 't1')),
b AS (SELECT DISTINCT "user", 'k' || replace(tenant, 't', '') AS client FROM (SELECT "user", tenant, unnest(grps) AS grp FROM u) WHERE tenant IN ('t1', 't2', 't3') AND grp = 'g1') SELECT u."user", coalesce(string_agg(client, ',' ORDER BY client), '') AS clients FROM u LEFT JOIN (SELECT * FROM o UNION SELECT * FROM b) x ON x."user" = u."user" GROUP BY u."user" """)
def access_resolve(spark, d):
    s = table(spark, d, "supplier")
    users = s.select(F.col("s_name").alias("user"), F.concat(F.lit("t"), F.col("s_nationkey") % 6).alias("tenant"), F.array(F.concat(F.lit("g"), F.col("s_suppkey") % 4), F.concat(F.lit("g"), F.col("s_suppkey") % 3)).alias("groups"))
    tenants = spark.createDataFrame([("t0", "c0", False), ("t1", "c1", False), ("t2", "k2", True)], "tenant string, client string, needs_group boolean")
    groups = spark.createDataFrame([("t1", "g1", "k1"), ("t2", "g1", "k2"), ("t3", "g1", "k3")], "tenant string, grp string, client string")
    return i.resolve_access(users, tenants, groups).select("user", F.array_join("clients", ",").alias("clients"))


@query("SELECT lang AS outcome, count(*) AS n, count(l.doc_id) AS labelled, arg_min(d.doc_id, sha256(CAST(d.doc_id AS VARCHAR))) FILTER (WHERE l.doc_id IS NULL) AS next_id FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def label_progress(spark, d):
    return i.label_progress(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("outcome")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("WITH o AS (SELECT doc_id AS id, n_chars AS sha FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE n_chars END AS sha FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.sha <> n.sha")
def catalog_refresh(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("sha"))
    new = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("n_chars")).alias("sha"))
    return i.catalog_changes(old, new)
