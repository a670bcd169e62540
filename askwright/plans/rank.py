"""Ranking queries: words, fields, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askwright.functions.text import SEARCH_STOP
from askwright.operators import ranking as r
from askwright.plans.measure import wilson_sql
from askwright.plans.base import query, table

STOP = ", ".join(f"'{w}'" for w in sorted(set(SEARCH_STOP)))
FOLD = r"lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'))"


def tokens(col: str) -> str:
    return f"list_filter(regexp_extract_all({FOLD.format(col)}, '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP}))"


BM25 = f"""
bag AS (SELECT doc_id AS doc, {tokens('text')} AS b FROM documents),
size AS (SELECT count(*) AS n, avg(len(b)) AS avg_len FROM bag),
post AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(b) AS len, unnest(b) AS term FROM bag) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT DISTINCT query, term FROM (SELECT item_id AS query, unnest({tokens('text')}) AS term FROM benchmark)),
scored AS (SELECT query, doc, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
           FROM q JOIN post USING (term) JOIN df USING (term), size GROUP BY query, doc),
ranked AS (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scored)"""


def ranked(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    scored = r.bm25(r.stored_postings(docs, "doc_id", F.col("text")), docs.count(), r.query_terms(items, "item_id", F.col("text")))
    return scored.withColumn("score", F.round("score", 6))


@query(f"WITH {BM25} SELECT query, doc, score, rank FROM ranked WHERE rank <= 5")
def bm25_topk(spark, d):
    return r.top_k(ranked(spark, d), 5).select("query", "doc", "score", "rank")


@query(f"""WITH {BM25}, two AS (SELECT query, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2,
 max(doc) FILTER (WHERE rank = 1) AS doc, count(*) FILTER (WHERE s <= 0.12 - 1e-12 OR rank = 1) AS close
 FROM (SELECT *, max(sat) OVER (PARTITION BY query) - sat AS s FROM (SELECT *, round(score / (score + 4.0), 6) AS sat FROM ranked WHERE rank <= 20)) GROUP BY query),
 t AS (SELECT query, doc, round(s1 / (s1 + 4.0), 6) AS first, round(s2 / (s2 + 4.0), 6) AS second FROM two)
 SELECT query, doc, first, second, CASE WHEN first < 0.18 THEN 'abstain' WHEN second IS NULL OR round(first - second, 6) >= 0.12 THEN 'fiche' ELSE 'question' END AS kind FROM t""")
def gap_decision(spark, d):
    from askwright.operators.decisions import gap_decide

    top = r.top_k(ranked(spark, d), 2).withColumn("score", F.round(r.saturate(F.col("score")), 6))
    return gap_decide(top).select("query", "doc", "first", "second", "kind")


@query(f"""WITH bag AS (SELECT doc_id AS doc, {tokens('text')} AS b FROM documents),
post AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(b) AS len, unnest(b) AS term FROM bag) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT doc, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS most FROM (
 SELECT doc, term, tf / len * (ln((n + 1) / (df + 1)) + 1) AS w FROM post JOIN df USING (term), n) GROUP BY doc""")
def tfidf_weights(spark, d):
    docs = table(spark, d, "documents")
    post = r.stored_postings(docs, "doc_id", F.col("text"))
    n = F.lit(docs.count())
    w = r.tfidf(post, post.groupBy("term").agg(F.count("*").alias("df")), n)
    return w.groupBy("doc").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 6).alias("total"), F.round(F.max("w"), 6).alias("most"))


FUSION = f"""
post0 AS (SELECT doc, len, term, tf FROM post), nn AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, nn),
dv AS (SELECT doc, term, tf / len * idf AS w FROM post0 JOIN idf USING (term)),
qb AS (SELECT item_id AS query, {tokens('text')} AS b FROM benchmark),
qp AS (SELECT query, term, count(*) / len AS tf FROM (SELECT query, len(b) AS len, unnest(b) AS term FROM qb) GROUP BY query, len, term),
qv AS (SELECT query, term, tf * idf AS w FROM qp JOIN idf USING (term)),
qn AS (SELECT query, sqrt(sum(w * w)) AS qn FROM qv GROUP BY query), dn AS (SELECT doc, sqrt(sum(w * w)) AS dn FROM dv GROUP BY doc),
cs AS (SELECT query, doc, sum(qv.w * dv.w) AS dot FROM qv JOIN dv USING (term) GROUP BY query, doc),
cosines AS (SELECT query, doc, dot / (qn * dn) AS cosine FROM cs JOIN qn USING (query) JOIN dn USING (doc)),
fused AS (SELECT query, doc, round(0.5 * score / (score + 4.0) + 0.5 * coalesce(cosine, 0), 6) AS fused, round(score, 6) AS lexical
 FROM scored LEFT JOIN cosines USING (query, doc))"""


@query(f"""WITH {BM25}, {FUSION} SELECT * FROM (SELECT query, doc, fused, lexical, row_number() OVER (PARTITION BY query ORDER BY fused DESC, lexical DESC, doc) AS rank FROM fused) WHERE rank <= 20""")
def hybrid_fusion(spark, d):
    """Half saturated words, half cosine of meaning; ties by words, then by input order.  Documents without a word in common
    have neither score."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    met = r.bm25_and_cosine(r.stored_postings(docs, "doc_id", F.col("text")), docs.count(), r.postings(items, "item_id", F.col("text")))
    fused = met.select("query", "doc", F.round(0.5 * r.saturate(F.col("score")) + 0.5 * F.coalesce("cosine", F.lit(0.0)), 6).alias("fused"), F.round("score", 6).alias("lexical"))
    return r.top_k(fused, 20, [F.desc("fused"), F.desc("lexical"), F.asc("doc")]).select("query", "doc", "fused", "lexical", "rank")


@query(f"""WITH f AS (SELECT doc_id AS doc, 'title' AS field, split_part(text, chr(10), 1) AS t FROM documents
 UNION ALL SELECT doc_id, 'symptom', split_part(text, chr(10), 2) FROM documents
 UNION ALL SELECT doc_id, 'steps', split_part(text, chr(10), 3) FROM documents UNION ALL SELECT doc_id, 'body', text FROM documents),
b AS (SELECT doc, field, {tokens('t')} AS b FROM f), av AS (SELECT field, avg(len(b)) AS av FROM b GROUP BY field), n AS (SELECT count(DISTINCT doc) AS n FROM b),
q AS (SELECT DISTINCT query, term FROM (SELECT item_id AS query, unnest({tokens('text')}) AS term FROM benchmark)),
post AS (SELECT doc, field, len, term, count(*) AS tf FROM (SELECT doc, field, len(b) AS len, unnest(b) AS term FROM b) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc) AS df FROM post GROUP BY term),
w AS (SELECT doc, term, sum(CASE field WHEN 'title' THEN 3.0 WHEN 'symptom' THEN 2.0 ELSE 1.0 END * tf / (0.25 + 0.75 * len / CASE WHEN av > 0 THEN av ELSE 1.0 END)) AS w FROM post JOIN av USING (field) GROUP BY doc, term),
s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * w / (1.2 + w)), 6) AS score, count(*) AS matched FROM q JOIN w USING (term) JOIN df USING (term), n GROUP BY query, doc)
SELECT * FROM (SELECT query, doc, score, matched, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def bm25f_topk(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    line = lambda k: F.coalesce(F.get(F.split("text", "\n"), k), F.lit(""))
    fields = docs.select(F.col("doc_id").alias("doc"), line(0).alias("title"), line(1).alias("symptom"), line(2).alias("steps"), F.col("text").alias("body"))
    scored = r.bm25f(fields, r.query_terms(items, "item_id", F.col("text"))).withColumn("score", F.round("score", 6))
    return r.top_k(scored, 5).select("query", "doc", "score", "matched", "rank")


VECTORS = """
u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT)) AS v FROM embeddings),
e AS (SELECT vec_id AS entry, label AS fiche, v FROM u), qq AS (SELECT vec_id AS query, label AS own, v FROM u WHERE vec_id % 20 = 0),
s AS (SELECT query, own, fiche, entry, round(list_sum(list_transform(list_zip(qq.v, e.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS score FROM qq JOIN e ON query <> entry),
b AS (SELECT query, own, fiche, max(score) AS score, arg_min(entry, (-score, entry)) AS entry FROM s GROUP BY query, own, fiche),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, fiche) AS rank FROM b)"""

ALL_VECTORS = VECTORS.replace(" WHERE vec_id % 20 = 0", "")  # each entry is a question


def unit_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("entry"), F.col("label").alias("fiche"), r.unit(F.col("embedding")).alias("vector"))


def vector_scores(spark, d):
    vectors = unit_vectors(spark, d)
    asked = vectors.where(F.col("entry") % 20 == 0).select(F.col("entry").alias("query"), F.col("fiche").alias("own"), "vector")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "fiche"))
    return r.rank_entries(asked, vectors).withColumn("doc", F.col("fiche")).withColumn("rank", rank)


@query(f"WITH {VECTORS} SELECT query, fiche, entry, score, rank FROM k WHERE rank <= 5")
def vector_rank(spark, d):
    return vector_scores(spark, d).where("rank <= 5").select("query", "fiche", "entry", "score", "rank")


@query(f"WITH {ALL_VECTORS} SELECT query, max(score) FILTER (WHERE fiche = own) AS best_own, max(score) FILTER (WHERE fiche <> own) AS best_other, coalesce(max(score) FILTER (WHERE fiche <> own) > max(score) FILTER (WHERE fiche = own), false) AS dropped FROM k GROUP BY query")
def vector_drop_rule(spark, d):
    """A generated line goes if another fiche is closer to it than its own."""
    k = r.own_and_other(unit_vectors(spark, d))
    return k.withColumn("dropped", F.coalesce(F.col("best_other") > F.col("best_own"), F.lit(False)))


@query(f"""WITH {VECTORS}, t AS (SELECT query, max(score) FILTER (WHERE rank = 1) AS first, max(score) FILTER (WHERE rank = 2) AS second FROM k GROUP BY query)
SELECT query, first, second, CASE WHEN first >= 0.4 AND (second IS NULL OR (round(first - second, 6) > 0 AND round(first - second, 6) >= 0.05)) THEN 'show' WHEN first >= 0.35 THEN 'offer' ELSE 'abstain' END AS verdict FROM t""")
def semantic_verdict(spark, d):
    from askwright.operators.decisions import semantic_decide

    return semantic_decide(vector_scores(spark, d), floor=0.4, margin=0.05, offer=0.35).select("query", "first", "second", "verdict")


GRID = f"""{VECTORS}, t AS (SELECT query, any_value(own) AS own, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, max(fiche) FILTER (WHERE rank = 1) AS f1, min(rank) FILTER (WHERE fiche = own) AS pl FROM k GROUP BY query),
lo AS (SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, fiche) AS rank FROM k WHERE fiche <> own), l AS (SELECT query, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2 FROM lo GROUP BY query),
o AS (SELECT coalesce(floor(quantile_cont(s1, 0.05) FILTER (WHERE pl <= 3) * 1000) / 1000, 0.35) AS offer FROM t),
g AS (SELECT floor, round(m * 0.005, 6) AS margin, offer FROM (SELECT DISTINCT s1 AS floor, offer FROM t, o WHERE s1 >= offer), range(1, 61) r(m)),
w AS (SELECT floor, margin, offer, count(*) AS n, (SELECT count(*) FROM l) AS loo_n, count(*) FILTER (WHERE ok AND f1 = own) AS right_shown, count(*) FILTER (WHERE ok AND f1 <> own) AS wrong_shown FROM (SELECT g.*, t.own, t.f1, s1 >= floor AND (s2 IS NULL OR round(s1 - s2, 6) >= margin) AS ok FROM g, t) GROUP BY ALL),
z AS (SELECT floor, margin, count(*) FILTER (WHERE s1 >= floor AND (s2 IS NULL OR round(s1 - s2, 6) >= margin)) AS loo_shown FROM g, l GROUP BY ALL), gm AS (SELECT * FROM w JOIN z USING (floor, margin))"""


@query(f"WITH {GRID} SELECT floor, margin, offer, n, loo_n, right_shown, wrong_shown, loo_shown FROM gm")
def grid_measure(spark, d):
    from askwright.operators.calibration import measure_grid

    return measure_grid(vector_scores(spark, d))


@query(f"WITH {GRID} SELECT floor, margin, offer, n, right_shown, wrong_shown, loo_shown FROM gm WHERE {wilson_sql('wrong_shown', 'n', '+')} <= 0.6 AND loo_shown <= 0.9 * loo_n ORDER BY right_shown DESC, wrong_shown, floor DESC, margin DESC LIMIT 1")
def grid_choose(spark, d):
    """The best pair within the bounds; the tables' vectors are random, so the bounds are wider than those of an exam."""
    from askwright.operators.calibration import choose_grid, measure_grid

    return choose_grid(measure_grid(vector_scores(spark, d)), most_wrong=0.6, most_loo=0.9)


@query(f"WITH {ALL_VECTORS}, t AS (SELECT query, any_value(own) AS own, list(fiche ORDER BY rank) AS top FROM k GROUP BY query) SELECT kk AS k, count(*) AS n, count(*) FILTER (WHERE list_contains(top[1:kk], own)) AS hits FROM t, (VALUES (1), (3), (5)) AS v(kk) GROUP BY kk")
def recall_at_k(spark, d):
    from askwright.operators.calibration import recall

    ks = [1, 3, 5]
    return recall(r.first_fiches(unit_vectors(spark, d), max(ks)), ks)


@query(f"""WITH {VECTORS}, l AS (SELECT query, own, fiche, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, fiche) AS rank FROM k WHERE fiche <> own),
t AS (SELECT query, max(score) FILTER (WHERE rank = 1) AS s1, max(score) FILTER (WHERE rank = 2) AS s2 FROM l GROUP BY query)
SELECT count(*) AS n, count(*) FILTER (WHERE s1 >= 0.4 AND round(s1 - s2, 6) >= 0.05) AS shown FROM t""")
def loo_measure(spark, d):
    """Leave one out: with the right fiche taken away, how often is one shown all the same."""
    from askwright.operators.calibration import leave_one_out

    return leave_one_out(vector_scores(spark, d), floor=0.4, margin=0.05)
