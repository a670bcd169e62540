"""Routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.operators import decisions, routing as r
from askwright.plans.base import planted, planted_sql, query, table, values

REV = "SELECT 'F' || (o_custkey % 500) AS fiche_id, 'h' || (o_orderkey % 2) AS source_sha256, CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'rejected' ELSE 'review' END AS status, o_orderkey AS revision, CAST(o_orderdate AS VARCHAR) AS decided_at  FROM orders"


@query(f"WITH v AS ({REV}), s AS (SELECT 'F' || i AS fiche_id, 'h' || (i % 3) AS sha FROM range(0, 520) t(i)), m AS (SELECT v.fiche_id, status, revision FROM v JOIN s ON v.fiche_id = s.fiche_id AND source_sha256 = sha QUALIFY row_number() OVER (PARTITION BY v.fiche_id ORDER BY revision DESC, decided_at DESC, status DESC) = 1) SELECT s.fiche_id, coalesce(m.status, CASE WHEN s.fiche_id IN (SELECT fiche_id FROM v) THEN 'stale' ELSE 'proposed' END) AS status, CAST(coalesce(revision, -1) AS BIGINT) AS revision FROM s LEFT JOIN m USING (fiche_id)")
def current_decision(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "rejected").otherwise("review")
    reviews = o.select(F.concat(F.lit("F"), F.col("o_custkey") % 500).alias("fiche_id"), F.concat(F.lit("h"), F.col("o_orderkey") % 2).alias("source_sha256"), status.alias("status"), F.col("o_orderkey").alias("revision"), F.col("o_orderdate").cast("string").alias("decided_at"))
    sources = spark.range(520).select(F.concat(F.lit("F"), F.col("id")).alias("fiche_id"), F.concat(F.lit("h"), F.col("id") % 3).alias("sha"))
    return r.current_decision(reviews, sources).withColumn("revision", F.coalesce("revision", F.lit(-1)).cast("long"))


@query("WITH a AS (SELECT 'F' || (p_partkey % 97) AS fiche_id, 'k' || (p_size * 7 + p_partkey % 11) AS key, CASE WHEN p_partkey % 3 = 0 THEN 'review' ELSE 'validated' END AS status FROM part), g AS (SELECT key, list_sort(list(DISTINCT fiche_id) FILTER (WHERE status = 'validated')) AS c, list_sort(list(DISTINCT fiche_id) FILTER (WHERE status = 'review')) AS w FROM a GROUP BY key) SELECT key, coalesce(array_to_string(c, '|'), '') AS claimed, coalesce(array_to_string(w, '|'), '') AS waiting, CASE WHEN len(c) > 1 THEN 'collision' WHEN len(c) = 1 AND len(w) > 0 THEN 'blocked' WHEN len(c) = 1 THEN 'l1' ELSE 'pending' END AS outcome FROM g")
def alias_collisions(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.concat(F.lit("F"), F.col("p_partkey") % 97).alias("fiche_id"), F.concat(F.lit("k"), F.col("p_size") * 7 + F.col("p_partkey") % 11).alias("key"), F.when(F.col("p_partkey") % 3 == 0, "review").otherwise("validated").alias("status"))
    return r.alias_tables(rows).select("key", F.array_join("claimed", "|").alias("claimed"), F.array_join("waiting", "|").alias("waiting"), "outcome")


@query("SELECT 'c' || l_orderkey AS code, min(l_suppkey) AS fiche FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def code_owners(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("c"), F.col("l_orderkey")).alias("code"), F.col("l_suppkey").alias("fiche"))
    return r.code_owners(li)


@query(f"WITH s AS (SELECT l_orderkey AS query, 'i' || (l_suppkey % 5) AS identifier, 'f' || (l_partkey % 20) AS fiche FROM lineitem), h AS (SELECT query, fiche, count(DISTINCT identifier) AS k FROM s GROUP BY ALL) SELECT query, coalesce(array_to_string(list(fiche ORDER BY fiche) FILTER (WHERE k = (SELECT count(DISTINCT identifier) FROM s WHERE s.query = h.query)), '|'), '') AS shared, array_to_string(list(fiche ORDER BY fiche), '|') AS any_of FROM h GROUP BY query")
def identifier_scope(spark, d):
    return r.identifier_scope(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.concat(F.lit("i"), F.col("l_suppkey") % 5).alias("identifier"), F.concat(F.lit("f"), F.col("l_partkey") % 20).alias("fiche"))).select("query", F.array_join("shared", "|").alias("shared"), F.array_join("any", "|").alias("any_of"))


QUESTIONS = [(1, ["reset", "password"]), (2, ["reset", "password", "sap"]), (3, ["impossible", "reset", "password"]), (4, ["vpn"]), (5, ["outlook", "start", "sync", "not"]), (6, ["printer", "paper", "jam"])]
ENTRIES = [("A", "reset password", ["reset", "password"], ""), ("B", "reset password sap", ["reset", "password", "sap"], "sap"), ("C", "outlook start", ["outlook", "start"], ""), (None, "outlook sync", ["outlook", "sync"], ""), ("D", "printer paper", ["printer", "paper"], ""), (None, "printer", ["printer"], "")]
NEG = ", ".join(f"'{w}'" for w in r.NEGATIONS)


@query(f"""WITH q AS (SELECT id AS query, tokens FROM {planted_sql(QUESTIONS, 'id int, tokens array<string>')}), e AS (SELECT fiche_id, alias, tokens AS et FROM {values(ENTRIES, 'fiche_id string, alias string, tokens array<string>, app string')}), m AS (SELECT query, tokens, e.* FROM q JOIN e ON list_has_all(tokens, et)),
w AS (SELECT * FROM m a WHERE fiche_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m b WHERE b.query = a.query AND b.fiche_id IS DISTINCT FROM a.fiche_id AND NOT (list_has_all(a.et, b.et) AND len(b.et) < len(a.et))) QUALIFY row_number() OVER (PARTITION BY query ORDER BY len(et) DESC, array_to_string(et, ' '), alias) = 1),
u AS (SELECT *, list_filter(tokens, lambda x: NOT list_contains(et, x)) AS l FROM w) SELECT query, fiche_id, alias, CAST(len(l) AS INTEGER) AS uncovered, len(l) <= 1 AND NOT list_has_any(l, [{NEG}]) AS decided FROM u""")
def alias_match(spark, d):
    return r.match_aliases(planted(spark, d, QUESTIONS, "id int, tokens array<string>").withColumnRenamed("id", "query"), spark.createDataFrame(ENTRIES, "fiche_id string, alias string, tokens array<string>, app string"))


ASKED = [(1, "RESET", "sap"), (2, "RESET", ""), (3, "VPN", ""), (4, "VPN", "teams"), (5, "NONE", ""), (6, "PRINT", "sap"), (7, "ONE", ""), (8, None, "")]
L2 = [("RESET", "sap", "A", False), ("RESET", "", "B", False), ("VPN", "", "C", False), ("PRINT", "sap", "D", True), ("PRINT", "sap", "E", False), ("ONE", "teams", "F", False)]
L2_WANT = [(1, "A", "", "intent_app"), (2, None, "A|B", "several_fiches"), (3, "C", "", "intent_no_app"), (4, None, "C", "no_fiche_for_app_generic_offered"), (5, None, "", "no_fiche"), (6, None, "D|E", "pending_review"), (7, None, "F", "fiche_of_an_application"), (8, None, "", "no_intent")]


@query(f"SELECT id AS query, exact, offer, reason FROM {planted_sql(L2_WANT, 'id int, exact string, offer string, reason string')}")
def intent_lookup(spark, d):
    return r.lookup_intent(planted(spark, d, ASKED, "id int, intent string, app string").withColumnRenamed("id", "query"), spark.createDataFrame(L2, "intent string, app string, fiche string, blocked boolean"))


@query("WITH q AS (SELECT o_orderkey AS query FROM orders), l0 AS (SELECT query, 'n' || (query % 9) AS f FROM q WHERE query % 5 = 0), l1 AS (SELECT query, 'a' || (query % 7) AS f FROM q WHERE query % 3 = 0), l2 AS (SELECT query, 'i' || (query % 4) AS f FROM q WHERE query % 2 = 0) SELECT query, coalesce(l0.f, l1.f, l2.f) AS fiche_id, CASE WHEN l0.f IS NOT NULL THEN 'L0' WHEN l1.f IS NOT NULL THEN 'L1' WHEN l2.f IS NOT NULL THEN 'L2' ELSE 'none' END AS level FROM q LEFT JOIN l0 USING (query) LEFT JOIN l1 USING (query) LEFT JOIN l2 USING (query)")
def routing_ladder(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"))
    level = lambda k, m, p: q.where(F.col("query") % k == 0).withColumn("fiche_id", F.concat(F.lit(p), F.col("query") % m))
    return r.ladder([level(5, 9, "n"), level(3, 7, "a"), level(2, 4, "i")], q)


@query("SELECT l_orderkey AS entry, l_partkey AS member, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ord, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT), l_orderkey) = 1 AS accepted FROM lineitem")
def taxonomy_claims(spark, d):
    li = table(spark, d, "lineitem")
    order = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")
    return r.claims(li.select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("member"), order.alias("ord")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS query, l_linenumber AS place, CASE l_linenumber WHEN 1 THEN 'err:' || (l_partkey % 40) WHEN 2 THEN 'app:' || (l_suppkey % 10) ELSE 'os:' || (l_partkey % 4) END AS entity FROM lineitem WHERE l_linenumber <= 3),
x AS (SELECT p_partkey AS fiche, unnest(['err:' || (p_partkey % 37), 'app:' || (p_partkey % 9), 'os:' || (p_partkey % 3)]) AS entity FROM part WHERE p_partkey <= 60),
hold AS (SELECT DISTINCT query, place, fiche FROM a JOIN x USING (entity)), act AS (SELECT query, place, row_number() OVER (PARTITION BY query ORDER BY place) AS k FROM (SELECT DISTINCT query, place FROM hold)),
pd AS (SELECT query, fiche, t.d AS depth FROM hold JOIN act USING (query, place), range(1, 4) t(d) WHERE k <= t.d GROUP BY query, fiche, t.d HAVING count(*) = t.d)
SELECT query, fiche, CAST(depth AS INTEGER) AS depth FROM pd WHERE (query, depth) IN (SELECT (query, max(depth)) FROM pd GROUP BY query)""")
def level_backoff(spark, d):
    said = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    at = F.col("l_linenumber")
    entity = F.when(at == 1, said("err:", F.col("l_partkey") % 40)).when(at == 2, said("app:", F.col("l_suppkey") % 10)).otherwise(said("os:", F.col("l_partkey") % 4))
    asked = table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("query"), F.element_at(F.array(F.lit("identifier"), F.lit("app"), F.lit("os")), at).alias("level"), entity.alias("entity"))
    p = F.col("p_partkey")
    index = table(spark, d, "part").where(p <= 60).select(p.alias("fiche"), F.explode(F.array(said("err:", p % 37), said("app:", p % 9), said("os:", p % 3))).alias("entity"))  # the articles there are
    return decisions.level_backoff(asked, index, ["identifier", "update", "app", "os"])


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS query, 'f' || (l_partkey % 50) AS fiche, unnest(['app:' || (l_suppkey % 3), 'err:' || (l_partkey % 7)]) AS entity FROM lineitem),
n AS (SELECT query, count(DISTINCT fiche) AS n FROM c GROUP BY query), kd AS (SELECT query, split_part(entity, ':', 1) AS kind, entity, fiche FROM c),
o AS (SELECT query, kind, entity, list(fiche) AS fs FROM kd JOIN n USING (query) GROUP BY query, kind, entity HAVING count(*) < any_value(n)),
g AS (SELECT query, kind, array_to_string(list(entity ORDER BY entity), '|') AS options FROM o JOIN n USING (query) GROUP BY query, kind HAVING count(*) BETWEEN 2 AND 5 AND len(list_distinct(flatten(list(fs)))) = any_value(n))
SELECT query, arg_min(kind, kind) AS kind, arg_min(options, kind) AS options FROM g GROUP BY query""")
def discriminator(spark, d):
    li = table(spark, d, "lineitem")
    entity = F.explode(F.array(F.concat(F.lit("app:"), F.col("l_suppkey") % 3), F.concat(F.lit("err:"), F.col("l_partkey") % 7)))
    close = li.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("f"), F.col("l_partkey") % 50).alias("fiche"), entity.alias("entity"))
    return decisions.discriminator(close, ["app", "err", "evt", "os"]).select("query", "kind", F.array_join("options", "|").alias("options"))
