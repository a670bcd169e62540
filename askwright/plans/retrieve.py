"""Queries on chunks, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.operators import retrieval as r
from askwright.plans.base import query, table

CH = "c AS (SELECT doc_id AS doc, n, substr(text, CAST(n * 1500 + 1 AS BIGINT), 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 1500.0), 1) AS BIGINT))) AS n FROM documents))"


@query(f"WITH {CH} SELECT doc, CAST(n AS INTEGER) AS n, length(chunk) AS chars, sha256(chunk) AS sha FROM c")
def page_chunks(spark, d):
    return r.page_chunks(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc", "n", F.length("chunk").cast("long").alias("chars"), F.sha2("chunk", 256).alias("sha"))


@query(f"WITH {CH} SELECT doc, length(left(string_agg(chunk, chr(10) ORDER BY n), 20000)) AS chars, sha256(left(string_agg(chunk, chr(10) ORDER BY n), 20000)) AS sha FROM c GROUP BY doc")
def doc_expand(spark, d):
    docs = table(spark, d, "documents")
    wanted = docs.select(F.col("doc_id").alias("doc"))
    return r.expand(r.page_chunks(docs, "doc_id", F.col("text")), wanted).select("doc", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha"))


SCORED = "s AS (SELECT l_orderkey % 500 AS query, l_partkey % 50 AS doc, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS score, CASE WHEN (l_partkey % 50) % 3 = 0 THEN 'video' WHEN (l_partkey % 50) % 3 = 1 THEN 'audio' ELSE 'text' END AS modality FROM lineitem)"


def scored(spark, d):
    m = F.col("l_partkey") % 50 % 3
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("query"), (F.col("l_partkey") % 50).alias("doc"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("score"), F.when(m == 0, "video").when(m == 1, "audio").otherwise("text").alias("modality"))


@query(f"WITH {SCORED} SELECT query, doc, max(score) AS score, CAST(arg_min(n, (-score, n)) AS INTEGER) AS n FROM s GROUP BY query, doc")
def chunk_collapse(spark, d):
    return r.collapse_chunks(scored(spark, d))


@query(f"""WITH {SCORED}, b AS (SELECT query, doc, any_value(modality) AS modality, max(score) AS score FROM s GROUP BY query, doc), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM b WHERE modality = 'text' QUALIFY rank <= 3),
x AS (SELECT b.*, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN modality = 'text' THEN 1 ELSE 0 END, score DESC, doc) AS rank FROM b WHERE (query, doc) NOT IN (SELECT query, doc FROM p) QUALIFY rank <= 4) SELECT query, doc, modality, score, rank, 'primary' AS part FROM p UNION ALL SELECT query, doc, modality, score, rank, 'annex' FROM x""")
def modality_split(spark, d):
    best = scored(spark, d).groupBy("query", "doc").agg(F.min("modality").alias("modality"), F.max("score").alias("score"))
    return r.modality_split(best, 3, 4).select("query", "doc", "modality", "score", "rank", "part")


@query("SELECT p_name AS title, max(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS used, arg_min(p_type, p_partkey) FILTER (WHERE p_size % 5 <> 0) AS summary FROM part GROUP BY p_name")
def source_merge(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("used"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("summary"), F.col("p_partkey").alias("ord"))
    return r.merge_sources(p)


@query("SELECT value, count(*) AS n FROM (SELECT event_type || ':' || (user_id % 40) AS value FROM events) GROUP BY value ORDER BY n DESC, value LIMIT 100")
def facet_top(spark, d):
    return r.facets(table(spark, d, "events"), F.concat_ws(":", "event_type", (F.col("user_id") % 40).cast("string")), 100)


@query("SELECT conv_id, turn, sha256(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS sha FROM conversations")
def turn_context(spark, d):
    return r.turn_context(table(spark, d, "conversations")).select("conv_id", "turn", F.sha2("context", 256).alias("sha"))


@query("SELECT g, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT lower(p_brand) AS g, unnest([lower(p_brand), lower(p_type)]) AS x FROM part) GROUP BY g HAVING count(*) >= 2")
def synonym_groups(spark, d):
    return r.synonym_groups(table(spark, d, "part").select(F.col("p_brand").alias("canonical"), F.col("p_type").alias("alias")))
