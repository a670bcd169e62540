"""Queries on smaller rules: ladders, merged variables, running state, sheets, imports, context blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askwright.operators import decisions, retrieval
from askwright.plans.base import planted, planted_sql, query, rounded, table, values

# candidates of questions: scores from prices, names and applications from keys; twelve candidates a question at most
RANKED = """li AS (SELECT l_orderkey AS query, 'F' || l_partkey AS doc, round((l_extendedprice % 1000) / 1000 * CASE WHEN l_orderkey % 4 = 0 THEN 0.3 ELSE 1 END, 3) AS score, l_partkey % 3 = 0 AS named, CASE WHEN l_suppkey % 4 = 0 THEN 'app:' || (l_suppkey % 12) END AS app FROM lineitem),
ded AS (SELECT query, doc, max(score) AS score, any_value(named) AS named, min(app) AS app FROM li GROUP BY query, doc), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ded),
mo AS (SELECT o_orderkey AS query, o_orderkey % 3 <> 0 AS entities, o_orderkey % 3 = 1 AS strong FROM orders)"""


def ranked_candidates(spark, d):
    li = table(spark, d, "lineitem")
    score = rounded(F.col("l_extendedprice") % 1000 / 1000 * F.when(F.col("l_orderkey") % 4 == 0, 0.3).otherwise(1), 3)
    rows = li.select(F.col("l_orderkey").alias("query"), F.concat(F.lit("F"), F.col("l_partkey")).alias("doc"), score.alias("score"), (F.col("l_partkey") % 3 == 0).alias("named"), F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("app:"), F.col("l_suppkey") % 12)).alias("app"))
    once = rows.groupBy("query", "doc").agg(F.max("score").alias("score"), F.first("named").alias("named"), F.min("app").alias("app"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")))


@query(f"""WITH {RANKED}, t AS (SELECT query, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(doc) FILTER (WHERE rank = 1) AS top, bool_or(named AND rank = 1) AS top_named, count(*) AS n, bool_or(app IS NOT NULL AND rank <= 10) AS apps FROM k GROUP BY query),
x AS (SELECT k.*, round(s1 - score, 6) < 0.12 AS near FROM k JOIN t USING (query)), a AS (SELECT query, count(*) FILTER (WHERE near AND named) AS titled, count(DISTINCT CAST(doc[2:] AS BIGINT) % 3) FILTER (WHERE near) AS values_near, min(doc) FILTER (WHERE near AND named) AS titled_doc, list(doc ORDER BY rank) FILTER (WHERE near) AS close_docs, list(doc ORDER BY rank) FILTER (WHERE rank <= 3) AS few, list(doc ORDER BY rank) FILTER (WHERE rank <= 3 AND score > 0) AS plausible FROM x GROUP BY query),
v AS (SELECT mo.query, entities, strong, t.*, a.*, s1 >= CASE WHEN mo.query % 9 = 1 THEN 0 WHEN strong THEN 0.10 WHEN entities THEN 0.25 ELSE 0.40 END AS enough, s2 IS NULL OR round(s1 - s2, 6) >= 0.12 AS lead FROM mo LEFT JOIN t ON t.query = mo.query LEFT JOIN a ON a.query = mo.query),
r AS (SELECT *, CASE WHEN n IS NULL THEN 'no_candidate' WHEN enough AND lead AND (strong OR top_named) THEN CASE WHEN s2 IS NULL THEN 'single' ELSE 'clear_lead' END WHEN enough AND lead THEN 'no_title_match' WHEN enough AND titled = 1 THEN 'close_title_match' WHEN enough AND entities AND values_near >= 2 THEN 'close_entity' WHEN enough THEN 'close_choice'
 WHEN entities AND n <= 3 THEN 'weak_text_few' WHEN entities THEN 'weak_text' WHEN s1 >= 0.25 AND apps THEN 'ask_application' WHEN s1 >= 0.25 THEN 'text_only_weak' ELSE 'nothing_close' END AS reason FROM v)
SELECT query, CASE WHEN reason IN ('single', 'clear_lead', 'close_title_match') THEN 'fiche' WHEN reason IN ('no_title_match', 'close_entity', 'close_choice', 'weak_text_few', 'ask_application') THEN 'question' ELSE 'abstain' END AS kind, reason,
 CASE WHEN reason IN ('single', 'clear_lead') THEN top WHEN reason = 'close_title_match' THEN titled_doc END AS doc,
 array_to_string(CASE reason WHEN 'no_title_match' THEN CASE WHEN len(plausible) > 0 THEN plausible ELSE [top] END WHEN 'close_choice' THEN close_docs[1:3] WHEN 'weak_text_few' THEN few END, '|') AS offered FROM r""")
def words_ladder(spark, d):
    mode = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 3 != 0).alias("entities"), (F.col("o_orderkey") % 3 == 1).alias("strong"), (F.col("o_orderkey") % 9 == 1).alias("designated"))
    ranked = ranked_candidates(spark, d)
    near = decisions.close_set(ranked).select("query", F.explode("close").alias("fiche"))
    value = F.concat(F.lit("app:"), (F.substring("fiche", 2, 20).cast("long") % 3).cast("string"))
    splits = decisions.discriminator(near.withColumn("entity", value), ["app", "err", "evt", "os"])
    return decisions.words_ladder(ranked, mode, splits=splits).withColumn("offered", F.array_join("offered", "|"))


@query(f"WITH {RANKED}, f AS (SELECT query, score AS s1 FROM k WHERE rank = 1) SELECT query, array_to_string(list(doc ORDER BY rank), '|') AS close FROM k JOIN f USING (query) WHERE round(s1 - score, 6) < 0.12 GROUP BY query")
def close_candidates(spark, d):
    return decisions.close_set(ranked_candidates(spark, d)).select("query", F.array_join("close", "|").alias("close"))


SHOWN = [(1, "fiche", 0.3, False), (2, "fiche", 0.3, True), (3, "fiche", 0.9, False), (4, "question", 0.1, False)]


@query(f"SELECT id, CASE WHEN kind = 'fiche' AND NOT designated AND score < 0.5 THEN 'question' ELSE kind END AS kind FROM {planted_sql(SHOWN, 'id int, kind string, score double, designated boolean')}")
def min_show_floor(spark, d):
    r = planted(spark, d, SHOWN, "id int, kind string, score double, designated boolean")
    return r.select("id", decisions.min_show(F.col("kind"), F.col("score"), 0.5, F.col("designated")).alias("kind"))


@query("SELECT user_id, event_type AS name, arg_max(event_id, (CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END, value, event_id)) AS chosen FROM events GROUP BY user_id, event_type")
def merged_variables(spark, d):
    """A confirmed value wins, else the more confident one."""
    e = table(spark, d, "events").withColumn("confirmed", F.when(F.col("event_id") % 13 == 0, 1).otherwise(0))
    return e.groupBy("user_id", F.col("event_type").alias("name")).agg(F.max_by("event_id", F.struct("confirmed", "value", "event_id")).alias("chosen"))


@query("SELECT conv_id, turn, count(DISTINCT role) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS roles, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chars FROM conversations")
def running_state(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(F.array_distinct(F.collect_list("role").over(w))).cast("long").alias("roles"), F.sum(F.length("text")).over(w).alias("chars"))


@query("SELECT source, max(doc_id) FILTER (WHERE k = 1) AS cand_1, max(doc_id) FILTER (WHERE k = 2) AS cand_2, max(doc_id) FILTER (WHERE k = 3) AS cand_3 FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) GROUP BY source")
def labeling_sheet(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("k")).where("k <= 3")
    return top.groupBy("source").pivot("k", [1, 2, 3]).agg(F.max("doc_id")).toDF("source", "cand_1", "cand_2", "cand_3")


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN conv_id % 17 = 0 THEN 'no_id' WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 THEN 'duplicate' ELSE 'imported' END AS outcome FROM conversations WHERE role = 'user') GROUP BY outcome""")
def import_outcomes(spark, d):
    """Each row of an import counts under one reason."""
    again = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) > 1
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select(F.when(F.trim("text") == "", "empty").when(F.col("conv_id") % 17 == 0, "no_id").when(again, "duplicate").otherwise("imported").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT doc_id, source, n, substr(text, CAST(n * 1500 + 1 AS BIGINT), 2000) AS chunk FROM (SELECT doc_id, source, text, unnest(range(0, CAST(greatest(ceil((length(text) - 500) / 1500.0), 1) AS BIGINT))) AS n FROM documents))
SELECT doc_id, sha256(string_agg('[' || (n + 1) || '] ' || source || ': ' || chunk, chr(10) ORDER BY n)) AS block FROM c GROUP BY doc_id""")
def context_blocks(spark, d):
    """The chunks of each document as numbered context lines."""
    docs = table(spark, d, "documents")
    chunks = retrieval.page_chunks(docs, "doc_id", F.col("text")).join(docs.select(F.col("doc_id").alias("doc"), "source"), "doc")
    line = F.format_string("[%d] %s: %s", F.col("n") + 1, F.col("source"), F.col("chunk"))
    rows = chunks.groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("block"))


@query("SELECT conv_id, count(*) AS turns FROM conversations WHERE (conv_id % 5) || ':' || (conv_id % 3) = '2:1' GROUP BY conv_id")
def owned_conversations(spark, d):
    """A conversation of another owner is as absent as one that is not there."""
    owner = F.concat_ws(":", F.col("conv_id") % 5, F.col("conv_id") % 3)
    return table(spark, d, "conversations").where(owner == "2:1").groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("""SELECT query, fiche, pos FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS k FROM (SELECT query, fiche, min(p) AS pos FROM (SELECT l_orderkey AS query, l_partkey % 9 AS fiche,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 2, l_suppkey % 2, l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem) GROUP BY query, fiche)) WHERE k <= 5""")
def interleaved_candidates(spark, d):
    """Options one of each branch in turn, each fiche once, five at most."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), (F.col("l_partkey") % 9).alias("fiche"), F.floor(F.col("l_linenumber") / 2).alias("turn"), (F.col("l_suppkey") % 2).alias("branch"), "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("query")
    placed = rows.withColumn("p", F.row_number().over(w.orderBy("turn", "branch", "l_linenumber", "l_partkey", "l_suppkey")).cast("long")).groupBy("query", "fiche").agg(F.min("p").alias("pos"))
    return placed.withColumn("k", F.row_number().over(w.orderBy("pos"))).where("k <= 5").select("query", "fiche", "pos")


STATES = [(1, "running", 20), (2, "running", 10), (3, "error", 1), (4, "dry_run", 100), (5, "success", 1)]


@query(f"SELECT id, CASE WHEN status = 'running' THEN minutes > 15 ELSE status IN ('error', 'dry_run') END AS retry FROM {planted_sql(STATES, 'id int, status string, minutes int')}")
def retry_eligible(spark, d):
    r = planted(spark, d, STATES, "id int, status string, minutes int")
    return r.select("id", F.when(F.col("status") == "running", F.col("minutes") > 15).otherwise(F.col("status").isin("error", "dry_run")).alias("retry"))
