"""Queries on corpus profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.functions import text as t
from askwright.operators import corpus as c
from askwright.plans.base import planted, planted_sql, query, table
from askwright.plans.rank import FOLD

PLAIN = f"trim(regexp_replace({FOLD.format('replace({0}, chr(8217), chr(39))')}, '\\s+', ' ', 'g'))"
ITEM = r"^\s*(?:\d{1,2}[.)]|[a-zA-Z][.)]|[-*•–·▪●◦➢➤►])\s"
_FIRST = f"trim(regexp_extract(regexp_replace(regexp_replace({PLAIN.format('line')}, '^(?:{t.FILLERS.replace(chr(39), chr(39) * 2)})[ ,]+', ''), '^alors ', ''), '^([a-z''-]+)', 1), chr(39) || '-')"
_VERBS = ", ".join("'" + v.replace("'", "''") + "'" for v in t.ACTION_VERBS)
INSTRUCTION = f"(({_FIRST} IN ({_VERBS}) OR split_part({_FIRST}, '-', 1) IN ({_VERBS})) AND NOT regexp_matches(line, '{c.NOTICE}'))"
LINES = f"l AS (SELECT DISTINCT doc_id, {PLAIN.format('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '{ITEM}') AND NOT {INSTRUCTION})"


@query(f"WITH {LINES} SELECT line, count(*) AS n FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(*) >= greatest(3, 0.005 * (SELECT count(*) FROM documents))")
def boilerplate_lines(spark, d):
    return c.boilerplate(table(spark, d, "documents"), "doc_id", F.col("text"), share=0.005)


@query(f"""WITH {LINES}, b AS (SELECT line FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(*) >= greatest(3, 0.005 * (SELECT count(*) FROM documents))),
x AS (SELECT doc_id, {PLAIN.format('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) SELECT doc_id AS doc, count(*) FILTER (WHERE line IN (SELECT line FROM b)) AS removed FROM x GROUP BY doc_id""")
def boilerplate_removed(spark, d):
    docs = table(spark, d, "documents")
    return c.remove_boilerplate(docs, "doc_id", "text", c.boilerplate(docs, "doc_id", F.col("text"), share=0.005)).select("doc", "removed")


@query(r"""SELECT lang, CASE WHEN regexp_matches(text, '(?:^|\n)[^\S\n]*\d{1,2}[.)]\s') THEN 'numbered' WHEN regexp_matches(text, '(?:^|\n)[^\S\n]*[-*•–·▪●◦➢➤►]\s') THEN 'bulleted' ELSE 'prose' END AS style, count(*) AS n FROM documents GROUP BY 1, 2""")
def style_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", c.style(F.col("text")).alias("style")).agg(F.count("*").alias("n"))


HEADS = f"k AS (SELECT DISTINCT doc_id, split_part({PLAIN.format('text')}, ' ', 1) AS key FROM documents)"


@query(f"WITH {HEADS} SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) >= greatest(2, 0.01 * (SELECT count(DISTINCT doc_id) FROM k))")
def heading_frequency(spark, d):
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.substring_index(t.plain(F.col("text")), " ", 1).alias("key"))
    return c.frequent_keys(keys, share=0.01)


@query(f"""WITH {HEADS}, h AS (SELECT *, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 2, 1))::INTEGER % 2 AS half FROM k), o AS (SELECT half, key FROM h GROUP BY half, key HAVING count(*) >= greatest(2.0, 0.1 * (SELECT count(DISTINCT doc_id) FROM h g WHERE g.half = h.half))),
s AS (SELECT key, count(*) AS sides FROM o GROUP BY key) SELECT count(*) FILTER (WHERE sides = 2) AS both, count(*) AS either, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE sides = 2) / count(*), 6) ELSE 1.0 END AS jaccard FROM s""")
def heading_stability(spark, d):
    keys = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.substring_index(t.plain(F.col("text")), " ", 1).alias("key"))
    return c.half_stability(keys, t.split_half(F.col("doc"), "profile"))


@query(r"""WITH n AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(url), '[a-z]{3,}')) AS word FROM pages) GROUP BY word HAVING count(*) BETWEEN 2 AND greatest(10, (SELECT count(*) FROM pages) // 2)),
w AS (SELECT lower(w) AS word, count(*) AS seen, count(*) FILTER (WHERE regexp_matches(w, '^[A-Z]')) AS capital FROM (SELECT unnest(regexp_extract_all(html, '\b[A-Za-z]{3,}\b')) AS w FROM pages) GROUP BY 1)
SELECT word, n, round(capital / seen, 6) AS share FROM n JOIN w USING (word) WHERE capital >= 0.2 * seen ORDER BY n DESC, word LIMIT 150""")
def name_candidates(spark, d):
    """Words of the pages' names that their texts write with a capital; the texts are prose, so a lower share is asked for."""
    return c.name_candidates(table(spark, d, "pages"), "page_id", F.col("url"), F.col("html"), share=0.2)


FICHES = [(1, "A réutiliser - Imprimante", "x", "texte assez long pour rester dans la base de connaissances", 0), (2, "Vide", "vide", "# Vide", 0), (3, "Ne pas utiliser", "y", "t", 3), (4, "Guide", "guide", "court", 2), (5, "Guide long", "z", "# Guide long et un corps de plus de quarante caractères hors titre", 0), (6, "Presque", "NE PAS UTILISER doc", "", 1)]
FS = "id int, title string, stem string, text string, n_steps int"
PAD = "' ' || trim(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9]+', ' ', 'g')) || ' '"


@query(f"""SELECT id AS fiche_id, pattern, CASE WHEN pattern IS NOT NULL THEN 'title_pattern' WHEN n_steps = 0 AND chars < 40 THEN 'empty' END AS rule FROM (SELECT *, CASE WHEN contains(names, ' A REUTILISER ') THEN 'A REUTILISER' WHEN contains(names, ' NE PAS UTILISER ') THEN 'NE PAS UTILISER' END AS pattern,
 length(regexp_replace(regexp_replace(CASE WHEN length(title) > 0 AND instr(text, title) > 0 THEN left(text, instr(text, title) - 1) || ' ' || substr(text, instr(text, title) + length(title)) ELSE text END, '\\s+', '', 'g'), '^#+', '')) AS chars
 FROM (SELECT *, {PAD.format('title')} || {PAD.format('stem')} AS names FROM {planted_sql(FICHES, FS)}))""")
def exclusion_rules(spark, d):
    return c.excluded(planted(spark, d, FICHES, FS).withColumnRenamed("id", "fiche_id"), ["A REUTILISER", "NE PAS UTILISER"]).select("fiche_id", "pattern", "rule")


ENTRIES = """SELECT CASE doc_id % 4 WHEN 0 THEN 'f ' || doc_id WHEN 1 THEN 'F  ' || doc_id WHEN 2 THEN ' f ' || doc_id ELSE 'nothing ' || doc_id END AS entry FROM documents"""
IDS = "SELECT 'f ' || doc_id AS fiche_id FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'F ' || doc_id FROM documents WHERE doc_id % 7 = 0"


@query(f"""WITH w AS ({ENTRIES}), f AS ({IDS}), k AS (SELECT lower(trim(regexp_replace(fiche_id, '\\s+', ' ', 'g'))) AS k, min(fiche_id) AS loose FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT entry, coalesce(f.fiche_id, k.loose) AS fiche_id FROM w LEFT JOIN f ON f.fiche_id = entry LEFT JOIN k ON k.k = lower(trim(regexp_replace(entry, '\\s+', ' ', 'g')))""")
def force_included(spark, d):
    docs, i, n = table(spark, d, "documents"), F.col("doc_id") % 4, F.col("doc_id").cast("string")
    said = lambda prefix: F.concat(F.lit(prefix), n)
    entries = docs.select(F.when(i == 0, said("f ")).when(i == 1, said("F  ")).when(i == 2, said(" f ")).otherwise(said("nothing ")).alias("entry"))
    ids = docs.where("doc_id % 5 <> 0").select(said("f ").alias("fiche_id")).unionByName(docs.where("doc_id % 7 = 0").select(said("F ").alias("fiche_id")))
    return c.force_include(entries, ids)


@query("SELECT term, seen FROM (SELECT event_type || '-' || (event_id % 37) AS term, count(DISTINCT user_id) AS seen FROM events GROUP BY 1) WHERE seen >= 3 AND term NOT LIKE 'error%' ORDER BY seen DESC, term")
def ready_terms(spark, d):
    terms = table(spark, d, "events").groupBy(F.concat_ws("-", "event_type", (F.col("event_id") % 37).cast("string")).alias("term")).agg(F.countDistinct("user_id").alias("seen"))
    return c.ready_for_review(terms.withColumn("status", F.when(F.col("term").startswith("error"), "rejected").otherwise("pending"))).select("term", "seen")
