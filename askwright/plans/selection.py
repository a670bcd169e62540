"""Queries of what models answered, planted beside the rows of documents and pages, and of the scoring profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.functions.text import tokenize
from askwright.operators import selection as s
from askwright.operators.ranking import field_postings
from askwright.plans.base import query, table
from askwright.plans.rank import tokens

c, lit = F.col, F.lit

#: An answer for each document, of eight kinds; the same text in both languages.
ANSWER = """CASE doc_id % 8 WHEN 0 THEN '{"sections": [{"heading": " Cause ", "role": "cause"}, {"heading": "X", "role": "title"}], "steps": [{"quote": " ' || source || ' ", "kind": "action", "section_role": "resolution"}, {"quote": "b", "kind": "check", "section_role": "cause", "condition": " "}]}'
 WHEN 1 THEN '{"steps": [{"quote": "  ", "kind": "action"}, {"quote": 5, "kind": "check"}, {"quote": "q", "kind": "other"}, "text", null, {"quote": "k", "kind": "check", "on_failure": "f' || doc_id || '", "instruction": 7}]}'
 WHEN 2 THEN '{"steps": [{"quote": "cut'
 WHEN 3 THEN '{"steps": {"quote": "no list"}, "sections": null}'
 WHEN 4 THEN '[1, 2]'
 WHEN 5 THEN '{}'
 WHEN 6 THEN '{"sections": ["s", {"heading": "", "role": "info"}, {"heading": "Note", "role": "info"}], "steps": []}' END"""

READ = f"""a AS (SELECT doc_id AS id, text, {ANSWER} AS answer FROM documents),
v AS (SELECT id, length(text) > 60000 AS skipped, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS j FROM a),
st AS (SELECT id, CAST(k - 1 AS INTEGER) AS ord, x FROM (SELECT id, generate_subscripts(l, 1) AS k, unnest(l) AS x FROM (SELECT id, CAST(json_extract(j, '$.steps') AS JSON[]) AS l FROM v WHERE NOT skipped AND json_type(j, '$.steps') = 'ARRAY'))),
se AS (SELECT id, x FROM (SELECT id, unnest(CAST(json_extract(j, '$.sections') AS JSON[])) AS x FROM v WHERE NOT skipped AND json_type(j, '$.sections') = 'ARRAY'))"""


def _text(name: str) -> str:
    return f"CASE WHEN json_type(x, '$.{name}') = 'VARCHAR' THEN nullif(trim(json_extract_string(x, '$.{name}')), '') END"


STEPS = f"""p AS (SELECT id, ord, json_type(x) AS t, {_text('quote')} AS quote, {_text('kind')} AS kind, {_text('section_role')} AS role, {_text('condition')} AS condition, {_text('on_failure')} AS failure, {_text('instruction')} AS instruction FROM st),
q AS (SELECT id, ord, quote, kind, CASE WHEN role IN ('prerequisite', 'resolution', 'workaround', 'escalation', 'other') THEN role ELSE 'other' END AS role, condition, failure, instruction,
 CASE WHEN coalesce(t, '') <> 'OBJECT' THEN 'not_an_object' WHEN quote IS NULL THEN 'no_quote' WHEN coalesce(kind NOT IN ('check', 'action'), true) THEN 'bad_kind' END AS malformed FROM p)"""


def answers(spark, d):
    return table(spark, d, "documents").select(c("doc_id").alias("id"), "text", F.expr(ANSWER).alias("answer"))


@query(f"WITH {READ}, {STEPS} SELECT * FROM q")
def proposed_steps(spark, d):
    return s.proposed_steps(answers(spark, d))


@query(f"""WITH {READ}, {STEPS}, n AS (SELECT id, count(*) FILTER (WHERE malformed IS NULL) AS steps, count(malformed) AS bad FROM q GROUP BY id),
h AS (SELECT id, {_text('heading')} AS heading, {_text('role')} AS role FROM se), m AS (SELECT id, count(*) FILTER (WHERE ok) AS sections, count(*) FILTER (WHERE NOT ok) AS bad
 FROM (SELECT id, heading IS NOT NULL AND coalesce(role IN ('symptom', 'cause', 'prerequisite', 'resolution', 'workaround', 'escalation', 'info', 'other'), false) AS ok FROM h) GROUP BY id)
SELECT id, skipped, NOT skipped AND j IS NULL AS unreadable, coalesce(steps, 0) AS steps, coalesce(sections, 0) AS sections, coalesce(n.bad, 0) + coalesce(m.bad, 0) AS malformed FROM v LEFT JOIN n USING (id) LEFT JOIN m USING (id)""")
def proposal_report(spark, d):
    return s.proposal_report(answers(spark, d))


@query("""WITH cd AS (SELECT page_id AS query, CAST(r AS INTEGER) AS place, CASE WHEN r % 3 = 0 THEN 'title ' || r ELSE 'p' || ((page_id + r) % 9) END AS key FROM pages, range(1, 6) t(r) WHERE r <= page_id % 6),
ax AS (SELECT page_id AS query, CAST(r AS INTEGER) AS place, 'p' || ((page_id + r) % 9) AS key FROM pages, range(1, 5) t(r) WHERE page_id % 6 > 0),
n AS (SELECT query, count(*) AS n FROM cd GROUP BY query),
pk AS (SELECT query, CASE WHEN n = 1 OR query % 7 = 5 THEN [1] WHEN query % 7 = 6 THEN [] ELSE list_distinct(list_filter([query % 4, 2, query % 4, query % 5, 9], lambda k: k BETWEEN 1 AND n)) END AS l,
        [query % 4, 2, query % 4, query % 5, 9] AS said FROM n),
o AS (SELECT query, k, min(list_position(said, k)) AS pos FROM (SELECT query, said, unnest(l) AS k FROM pk) GROUP BY query, k),
ch AS (SELECT o.query, CAST(row_number() OVER (PARTITION BY o.query ORDER BY pos) AS INTEGER) AS place, key FROM o JOIN cd ON cd.query = o.query AND cd.place = o.k QUALIFY row_number() OVER (PARTITION BY o.query ORDER BY pos) <= 2)
SELECT query, 'primary' AS part, place, key, true AS expanded FROM ch
UNION ALL SELECT query, 'primary', 1, key, false FROM cd WHERE place = 1 AND query NOT IN (SELECT query FROM ch)
UNION ALL SELECT query, 'annex', CAST(row_number() OVER (PARTITION BY query ORDER BY place) AS INTEGER), key, false FROM ax WHERE (query, key) NOT IN (SELECT (query, key) FROM ch)""")
def chosen_documents(spark, d):
    """Answers with numbers in and out of range, repeated ones, booleans, fractions and words; every seventh answer is broken."""
    pages = table(spark, d, "pages").select(c("page_id").alias("query"))
    listed = lambda n: F.explode(F.sequence(lit(1), lit(n))).alias("place")
    parent = F.concat(lit("p"), ((c("query") + c("place")) % 9).cast("string"))
    cand = pages.select("query", listed(5)).where("place <= query % 6").select("query", "place", F.when(c("place") % 3 == 0, lit("")).otherwise(parent).alias("parent"), F.concat(lit("title "), c("place").cast("string")).alias("title"))
    annex = pages.where("query % 6 > 0").select("query", listed(4)).select("query", "place", parent.alias("parent"), lit("annex").alias("title"))
    said = F.concat(lit('{"indexes": [true, 1.0, "2", '), F.concat_ws(", ", *[x.cast("string") for x in (c("query") % 4, lit(2), c("query") % 4, c("query") % 5, lit(9))]), lit("]}"))
    answer = F.when(c("query") % 7 == 5, lit('{"indexes": [')).when(c("query") % 7 == 6, lit('{"indexes": [0, 77]}')).otherwise(said)
    return s.chosen_documents(cand, pages.select("query", answer.alias("answer")), annex, 2)


@query(f"""WITH t AS (SELECT item_id AS query, list_distinct({tokens('text')}) AS l FROM benchmark), q AS (SELECT query, unnest(l) AS term, len(l) AS n FROM t),
f AS (SELECT doc_id AS doc, 'title' AS field, list_distinct({tokens("split_part(text, chr(10), 1)")}) AS l FROM documents UNION ALL SELECT doc_id, 'chunk', list_distinct({tokens('text')}) FROM documents
 UNION ALL SELECT doc_id, 'entities', list_distinct({tokens("split_part(text, ' ', 3)")}) FROM documents),
e AS (SELECT doc, field, unnest(l) AS term FROM f),
w AS (SELECT query, doc, field, count(*) / any_value(n) AS score FROM q JOIN e USING (term) GROUP BY query, doc, field),
b AS (SELECT query, doc, sum(score * CASE field WHEN 'title' THEN 3 WHEN 'entities' THEN 5 ELSE 1 END) AS base FROM w GROUP BY query, doc),
x AS (SELECT query, doc, base, CASE query % 3 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(source = 'src' || (query % 20) AS INT) * 1.0 ELSE (CAST(source = 'src' || (query % 20) AS INT) + CAST(lang = 'en' AS INT)) / 2 END AS share FROM b JOIN documents ON doc_id = doc),
k AS (SELECT query, doc, round(base, 6) AS score, round(base * (1 + 3 * share), 6) AS boosted FROM x)
SELECT query, doc, score, boosted, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY boosted DESC, doc) AS INTEGER) AS rank FROM k) WHERE rank <= 10""")
def profile_scores(spark, d):
    """Shares of a question's words in three fields; questions name a source, a source and a language, or nothing."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    asked = items.select(c("item_id").alias("query"), F.array_distinct(tokenize(c("text"))).alias("l")).select("query", F.size("l").alias("n"), F.explode("l").alias("term"))
    line, third = F.get(F.split("text", "\n"), lit(0)), F.get(F.split("text", " "), lit(2))
    names = ["title", "entities", "chunk"]
    post = field_postings(docs.select(c("doc_id").alias("doc"), F.array(line, third, c("text")).alias("texts")))
    hits = [F.count_if(F.get("tfs", lit(k)) > 0) / F.max("n") for k in range(len(names))]
    met = asked.join(post, "term").groupBy("query", "doc").agg(F.array(*[F.struct(lit(x).alias("field"), h.alias("score")) for x, h in zip(names, hits)]).alias("f"))
    fields = met.select("query", "doc", F.inline("f")).where("score > 0")
    tags = docs.select(c("doc_id").alias("doc"), F.explode(F.array(F.concat(lit("of:"), c("source")), F.concat(lit("in:"), c("lang")))).alias("entity"))
    said = F.array(F.when(c("item_id") % 3 > 0, F.concat(lit("of:src"), (c("item_id") % 20).cast("string"))), F.when(c("item_id") % 3 == 2, lit("in:en")))
    entities = items.select(c("item_id").alias("query"), F.explode(said).alias("entity")).where("entity is not null")
    return s.profile_scores(fields, tags, entities, 10)
