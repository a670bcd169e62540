"""Queries of the semantic funnel over the vectors: five entries are an article, every row whose id is divisible by 20 asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.operators import funnel, ranking, vector_index
from askwright.operators.graph import written
from askwright.plans.base import query, table

THRESHOLDS = {"floor": 0.3, "margin": 0.04, "offer": 0.2}

#: The planted world in SQL: entities of articles, what each question names, duplicates and replacements.
WORLD = """
u AS (SELECT vec_id AS entry, vec_id // 5 AS fiche, list_transform(embedding, lambda x: CAST(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT)) AS v FROM embeddings),
ask AS (SELECT entry AS query, entry // 20 AS q, v FROM u WHERE entry % 20 = 0),
f AS (SELECT DISTINCT fiche FROM u),
idx AS (SELECT fiche, 'app:a' || (fiche // 12) AS entity FROM f UNION ALL SELECT fiche, 'err:' || (fiche // 6) FROM f UNION ALL SELECT fiche, 'update:u' || (fiche // 9) FROM f
  UNION ALL SELECT fiche, 'os:' || (fiche % 2) FROM f WHERE fiche % 13 > 0 UNION ALL SELECT fiche, 'kb:' || fiche FROM f),
asked AS (SELECT query, 'identifier' AS level, 'err:' || ((4 * q + CASE WHEN q % 8 = 4 THEN 60 ELSE 0 END) // 6) AS entity FROM ask WHERE q % 8 IN (1, 2, 4)
  UNION ALL SELECT query, 'update', 'update:u' || ((4 * q + CASE WHEN q % 8 = 7 THEN 100 ELSE 0 END) // 9) FROM ask WHERE q % 8 IN (2, 7)
  UNION ALL SELECT query, 'answered', 'app:a' || ((4 * q) // 12) FROM ask WHERE q % 8 IN (3, 7)
  UNION ALL SELECT query, 'answered', 'os:' || (q % 2) FROM ask WHERE q % 8 = 3
  UNION ALL SELECT query, 'cited', 'kb:' || (4 * q) FROM ask WHERE q % 8 = 4
  UNION ALL SELECT query, 'identifier', 'err:none' FROM ask WHERE q % 8 = 5
  UNION ALL SELECT query, 'application', 'app:a' || ((4 * q) // 12) FROM ask WHERE q % 8 = 6),
same AS (SELECT fiche, fiche - 1 AS other FROM f WHERE fiche % 10 = 9),
newer AS (SELECT fiche, fiche + 1 AS other FROM f WHERE fiche % 10 = 4)"""

POOL = f"""{WORLD},
known AS (SELECT DISTINCT query, level, entity FROM asked SEMI JOIN idx USING (entity)),
lv AS (SELECT query, level, count(*) AS n, row_number() OVER (PARTITION BY query ORDER BY CASE level WHEN 'answered' THEN 1 WHEN 'cited' THEN 2 WHEN 'identifier' THEN 3 ELSE 4 END) AS k
       FROM known WHERE level <> 'application' GROUP BY query, level),
hold AS (SELECT query, fiche, level, k FROM known JOIN lv USING (query, level) JOIN idx USING (entity) GROUP BY ALL HAVING level <> 'answered' OR count(*) = max(n)),
pd AS (SELECT query, d, fiche FROM hold, range(1, 5) r(d) WHERE k <= d GROUP BY query, d, fiche HAVING count(*) = d),
held AS (SELECT query, fiche FROM pd WHERE (query, d) IN (SELECT (query, max(d)) FROM pd GROUP BY query)),
mark AS (SELECT DISTINCT query, level IN ('answered', 'cited') AS designated FROM lv JOIN held USING (query) WHERE k = 1)"""

RANKED = f"""{POOL},
wide AS (SELECT query, fiche FROM ask, (SELECT fiche FROM f WHERE fiche % 10 <> 9) WHERE query NOT IN (SELECT query FROM held)),
cand AS (SELECT DISTINCT query, coalesce(n.other, x.fiche) AS fiche FROM (SELECT query, coalesce(s.other, p.fiche) AS fiche FROM (SELECT * FROM held UNION ALL SELECT * FROM wide) p LEFT JOIN same s USING (fiche)) x LEFT JOIN newer n USING (fiche)),
met AS (SELECT c.query, c.fiche, u.entry, round(list_sum(list_transform(list_zip(ask.v, u.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS score
        FROM cand c JOIN u USING (fiche) JOIN ask USING (query) WHERE u.entry <> c.query),
best AS (SELECT query, fiche, max(score) AS score, arg_min(entry, (-score, entry)) AS entry FROM met GROUP BY query, fiche),
ranked AS (SELECT query, fiche, entry, score, designated IS NOT NULL AS strong, coalesce(designated, false) AS designated,
           count(*) OVER (PARTITION BY query) AS candidates, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, fiche) AS INTEGER) AS rank FROM best LEFT JOIN mark USING (query))"""

FOUND = f"""{RANKED},
top AS (SELECT query, max(score) AS s1, max(score) FILTER (WHERE rank = 2) AS s2, arg_min(fiche, rank) AS f1, count(*) AS n, bool_or(strong) AS strong, bool_or(designated) AS designated, list(fiche ORDER BY rank)[1:5] AS ranked,
        list(CAST(fiche AS VARCHAR) ORDER BY rank) FILTER (WHERE score >= 0.2)[1:3] AS offered FROM ranked GROUP BY query),
vd AS (SELECT *, CASE WHEN designated AND n = 1 THEN 'show' WHEN s1 >= CASE WHEN strong OR designated THEN 0.2 ELSE 0.3 END AND (s2 IS NULL OR (round(s1 - s2, 6) > 0 AND round(s1 - s2, 6) >= 0.04)) THEN 'show'
       WHEN s1 >= 0.2 THEN 'offer' ELSE 'abstain' END AS v FROM top),
near AS (SELECT r.query, r.fiche FROM ranked r JOIN vd USING (query) WHERE v = 'offer' AND score >= 0.2 AND round(s1 - score, 6) < 0.04),
ct AS (SELECT query, count(*) AS c FROM near GROUP BY query HAVING count(*) > 1),
val AS (SELECT query, fiche, entity, split_part(entity, ':', 1) AS kind FROM near JOIN ct USING (query) JOIN idx USING (fiche) WHERE split_part(entity, ':', 1) IN ('app', 'err', 'evt', 'os') AND (query, entity) NOT IN (SELECT (query, entity) FROM asked)),
opt AS (SELECT query, kind, entity, list(fiche) AS fs FROM val JOIN ct USING (query) GROUP BY query, kind, entity HAVING count(*) < any_value(c)),
good AS (SELECT query, kind, list(entity ORDER BY entity) AS options FROM opt JOIN ct USING (query) GROUP BY query, kind
         HAVING count(*) BETWEEN 2 AND 5 AND len(list_distinct(flatten(list(fs)))) = any_value(c)),
whole AS (SELECT query, kind FROM val JOIN ct USING (query) GROUP BY query, kind HAVING count(DISTINCT fiche) = any_value(c)),
split AS (SELECT query, arg_min(kind, o) AS kind, arg_min(options, o) AS options FROM (SELECT *, list_position(['app', 'err', 'evt', 'os'], kind) AS o FROM good SEMI JOIN whole USING (query, kind)) GROUP BY query),
said AS (SELECT ask.query, coalesce(vd.v, 'abstain') AS v, f1, s1, s2, n, designated, offered, ranked, s.kind AS splits, s.options AS vals FROM ask LEFT JOIN vd USING (query) LEFT JOIN split s USING (query))"""


def world(spark, d):
    """questions, asked, index, entries, canonical, superseded."""
    c, lit = F.col, F.lit
    entries = table(spark, d, "embeddings").select(c("vec_id").alias("entry"), F.floor(c("vec_id") / 5).alias("fiche"), ranking.unit(c("embedding")).alias("vector"))
    questions = entries.where("entry % 20 = 0").select(c("entry").alias("query"), c("fiche").alias("own"), "vector")
    fiches = entries.select("fiche").distinct()
    named = lambda prefix, of, width=1: F.concat(lit(prefix), F.floor(of / width).cast("string"))
    fiche = c("fiche")
    carries = F.array(named("app:a", fiche, 12), named("err:", fiche, 6), named("update:u", fiche, 9), F.when(fiche % 13 > 0, named("os:", fiche % 2)), named("kb:", fiche))
    index = written(fiches.select("fiche", F.explode(carries).alias("entity")).where("entity is not null"), "entities")
    q = F.floor(c("query") / 20)
    off = lambda which, by: 4 * q + F.when(q % 8 == which, by).otherwise(0)
    says = lambda level, entity, *of: F.when((q % 8).isin(*of), F.struct(lit(level).alias("level"), entity.alias("entity")))
    asked = questions.select("query", F.explode(F.array(
        says("identifier", named("err:", off(4, 60), 6), 1, 2, 4), says("update", named("update:u", off(7, 100), 9), 2, 7), says("answered", named("app:a", 4 * q, 12), 3, 7),
        says("answered", named("os:", q % 2), 3), says("cited", named("kb:", 4 * q), 4), says("identifier", lit("err:none"), 5), says("application", named("app:a", 4 * q, 12), 6),
    )).alias("x")).where("x is not null").select("query", "x.level", "x.entity")
    canonical = fiches.where("fiche % 10 = 9").select("fiche", (c("fiche") - 1).alias("canonical"))
    superseded = fiches.where("fiche % 10 = 4").select("fiche", (c("fiche") + 1).alias("superseded_by"))
    return questions, asked, index, entries, canonical, superseded


@query(f"WITH {POOL} SELECT query, fiche, designated FROM held JOIN mark USING (query)")
def semantic_pool(spark, d):
    _, asked, index, *_ = world(spark, d)
    return funnel.strong_pool(asked, index)


@query(f"WITH {RANKED} SELECT * FROM ranked WHERE rank <= 20")
def semantic_scored(spark, d):
    return funnel.funnel_scores(*world(spark, d))


@query(f"""WITH {FOUND} SELECT query, CASE v WHEN 'show' THEN 'fiche' WHEN 'offer' THEN 'question' ELSE 'abstain' END AS kind,
 'semantic_' || CASE WHEN n IS NULL THEN 'no_candidate' WHEN v = 'show' AND designated THEN 'designated' WHEN v = 'show' AND s2 IS NULL THEN 'single' WHEN v = 'show' THEN 'clear_lead' WHEN v = 'abstain' THEN 'nothing_close'
  WHEN splits IS NOT NULL THEN 'close_entity' WHEN s1 >= 0.3 THEN 'close_choice' ELSE 'below_floor' END AS reason,
 CASE v WHEN 'show' THEN f1 END AS fiche, s1 AS score, CASE WHEN v = 'offer' THEN coalesce(splits, 'fiche') END AS asks,
 CASE WHEN v = 'offer' THEN array_to_string(coalesce(vals, offered), '|') END AS options, coalesce(array_to_string(ranked, '|'), '') AS ranked, coalesce(n, 0) AS candidates FROM said""")
def semantic_find(spark, d):
    questions, asked, index, *rest = world(spark, d)
    found = funnel.semantic_find(funnel.funnel_scores(questions, asked, index, *rest, top=5, least=THRESHOLDS["offer"]), questions, asked, index, **THRESHOLDS)
    return found.withColumn("options", F.array_join("options", "|")).withColumn("ranked", F.array_join("ranked", "|"))


@query(f"""WITH {RANKED.replace("cand AS (", "whole_cand AS (").replace("FROM cand c", "FROM cand c").replace("met AS (", '''app AS (SELECT query, any_value(entity) AS entity FROM asked WHERE entity LIKE 'app:%' GROUP BY query HAVING count(DISTINCT entity) = 1),
fits AS (SELECT query, fiche FROM whole_cand JOIN app USING (query) SEMI JOIN idx ON idx.fiche = whole_cand.fiche AND idx.entity = app.entity SEMI JOIN f ON f.fiche = whole_cand.fiche),
cand AS (SELECT * FROM fits UNION ALL SELECT * FROM whole_cand WHERE query NOT IN (SELECT query FROM fits)),
met AS (''')} SELECT query, fiche, entry, score, rank FROM ranked WHERE rank <= 20""")
def semantic_scored_by_app(spark, d):
    """A question that names one application ranks the articles that carry it, if there are any."""
    world_ = world(spark, d)
    apps = world_[1].where("entity LIKE 'app:%'").select("query", F.col("entity").alias("app"))
    return funnel.funnel_scores(*world_, apps=apps).select("query", "fiche", "entry", "score", "rank")


def vectors(spark, d):
    entries = table(spark, d, "embeddings").select(F.col("vec_id").alias("entry"), F.col("label").cast("long").alias("fiche"), ranking.unit(F.col("embedding")).alias("vector"))
    return entries.where("entry % 20 = 0").select(F.col("entry").alias("query"), "vector"), entries


@query("""WITH u AS (SELECT vec_id AS entry, label AS fiche, list_transform(embedding, lambda x: CAST(x / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT)) AS v FROM embeddings),
s AS (SELECT q.entry AS query, e.entry, e.fiche, round(list_sum(list_transform(list_zip(q.v, e.v), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS score FROM u q JOIN u e ON q.entry <> e.entry WHERE q.entry % 20 = 0)
SELECT query, entry, fiche, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS INTEGER) AS rank FROM s) WHERE rank <= 5""")
def exact_neighbours(spark, d):
    queries, entries = vectors(spark, d)
    return vector_index.exact(queries, entries)


@query()
def indexed_neighbours(spark, d):
    """Through the index, whatever the number of entries; tests hold its recall against exact_neighbours."""
    queries, entries = vectors(spark, d)
    return vector_index.search(vector_index.build(entries), queries)
