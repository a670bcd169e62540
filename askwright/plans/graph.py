"""Queries on near duplicates, groups and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.operators import graph as g
from askwright.plans.base import query, table, values
from askwright.plans.rank import tokens

SETS = f"""tk AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
sh AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(t) <= 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) END)) AS s FROM tk WHERE len(t) > 0),
mem AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sh),
reps AS (SELECT sh.doc_id, s FROM sh JOIN mem USING (doc_id) WHERE sh.doc_id = rep),
x AS (SELECT doc_id, unnest(s) AS g FROM reps),
co AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM x p JOIN x q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, c / (len(ra.s) + len(rb.s) - c) AS jaccard FROM co JOIN reps ra ON ra.doc_id = a JOIN reps rb ON rb.doc_id = b WHERE c / (len(ra.s) + len(rb.s) - c) >= 0.8)"""


@query(f"WITH {SETS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs")
def shingle_jaccard(spark, d):
    pairs, _ = g.similar_pairs(table(spark, d, "documents"), "doc_id", F.col("text"))
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


NUMBERED = SETS.split("pairs AS")[0] + """nums AS (SELECT DISTINCT rep, source FROM mem JOIN documents USING (doc_id)),
pairs AS (SELECT a, b, c / (len(ra.s) + len(rb.s) - c) AS jaccard FROM co JOIN reps ra ON ra.doc_id = a JOIN reps rb ON rb.doc_id = b WHERE c / (len(ra.s) + len(rb.s) - c) >= 0.8 OR (c / (len(ra.s) + len(rb.s) - c) >= 0.5 AND EXISTS (SELECT 1 FROM nums x JOIN nums y USING (source) WHERE x.rep = a AND y.rep = b)))"""


@query(f"WITH {NUMBERED} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs")
def numbered_pairs(spark, d):
    """Two texts of one source, which stands for an article's number, are a pair from half of their shingles on."""
    pairs, _ = g.similar_pairs(table(spark, d, "documents"), "doc_id", F.col("text"), number=F.col("source"))
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


COMP = f"""{SETS}, und AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (SELECT DISTINCT a AS n, a AS r FROM und UNION SELECT und.b, walk.r FROM walk JOIN und ON und.a = walk.n),
roots AS (SELECT n, min(r) AS root FROM walk GROUP BY n)"""


@query(f"WITH RECURSIVE {COMP} SELECT doc_id AS doc, coalesce(root, rep) AS component FROM mem LEFT JOIN roots ON roots.n = mem.rep")
def dup_components(spark, d):
    pairs, members = g.similar_pairs(table(spark, d, "documents"), "doc_id", F.col("text"))
    roots = g.components(pairs)
    return members.join(roots, members["rep"] == roots["node"], "left").select("doc", F.coalesce("root", "rep").alias("component"))


@query(f"""WITH RECURSIVE {COMP}, c AS (SELECT doc_id, coalesce(root, rep) AS grp FROM mem LEFT JOIN roots ON roots.n = mem.rep)
SELECT grp, doc_id AS canonical FROM c JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, n_chars DESC, (doc_id % 2) DESC, doc_id) = 1""")
def canonical_pick(spark, d):
    docs = table(spark, d, "documents")
    groups = dup_components(spark, d)
    status = F.when(F.col("doc_id") % 3 == 0, "guided").when(F.col("doc_id") % 3 == 1, "citable").otherwise("info_only")
    members = groups.join(docs, groups["doc"] == docs["doc_id"]).select(F.col("component").alias("grp"), F.col("doc_id").alias("fiche_id"), status.alias("status"), F.col("n_chars").alias("n_steps"), (F.col("doc_id") % 2).alias("numbered"))
    return g.canonical_pick(members)


#: Each document is an article that cites its neighbours by number; a sixth shares a number, a sixth has none.
ARTICLES = """SELECT CASE i % 6 WHEN 5 THEN 'sans numéro ' || i ELSE 'KB000' || i || ' - A' END AS fiche_id, CASE i % 6 WHEN 5 THEN 'sans numéro ' || i ELSE 'KB000' || i || ' - A' END AS canonical,
 CASE i % 6 WHEN 5 THEN NULL WHEN 4 THEN i - 1 ELSE i END AS number,
 CASE i % 6 WHEN 0 THEN 'Voir KB' || (i + 1) || ' et KB 9999977. Cet article annule et remplace KB' || (i + 2) WHEN 1 THEN 'Remplacé par KB' || (i + 3) || '. kb-' || (i - 1) || ' en détail.' WHEN 3 THEN 'Citer KB' || i || ' soi-même, KB9999999 et KB9999999.'
  WHEN 4 THEN 'See KB' || (i - 4) || '.' WHEN 5 THEN 'KB' || (i - 3) || ' superseded by KB' || (i - 5) ELSE 'Rien.' END || chr(10) || text AS text,
 CASE i % 6 WHEN 0 THEN 'Lire KB' || (i + 1) || ' avant.' WHEN 5 THEN 'KB' || (i - 3) ELSE '' END AS prerequisite_text FROM (SELECT doc_id AS i, text FROM documents)"""


def articles(spark, d):
    i, c = F.col("doc_id") % 6, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else (F.col("doc_id") + y).cast("string") for y in x])
    name = F.when(i == 5, c("sans numéro ", 0)).otherwise(c("KB000", 0, " - A"))
    said = (
        F.when(i == 0, c("Voir KB", 1, " et KB 9999977. Cet article annule et remplace KB", 2)).when(i == 1, c("Remplacé par KB", 3, ". kb-", -1, " en détail.")).when(i == 3, c("Citer KB", 0, " soi-même, KB9999999 et KB9999999."))
        .when(i == 4, c("See KB", -4, ".")).when(i == 5, c("KB", -3, " superseded by KB", -5)).otherwise("Rien.")
    )
    number = F.when(i == 4, F.col("doc_id") - 1).when(i < 5, F.col("doc_id"))
    before = F.when(i == 0, c("Lire KB", 1, " avant.")).when(i == 5, c("KB", -3)).otherwise("")
    return table(spark, d, "documents").select(name.alias("fiche_id"), name.alias("canonical"), number.alias("number"), F.concat_ws("\n", said, "text").alias("text"), before.alias("prerequisite_text"))


NUM = r"(?i)\bKB\s?[-_]?0*(\d{1,7})\b"
CITED = f"""f AS ({ARTICLES}), h AS (SELECT DISTINCT number, canonical AS target FROM f WHERE number IS NOT NULL),
c AS (SELECT DISTINCT fiche_id, canonical, number AS own, prerequisite_text, CAST(unnest(regexp_extract_all(text, '{NUM}', 1)) AS BIGINT) AS n FROM f)"""


@query(f"SELECT fiche_id, CAST(coalesce(nullif(regexp_extract(fiche_id, '{NUM}', 1), ''), nullif(regexp_extract(canonical, '{NUM}', 1), ''), '-1') AS BIGINT) AS number FROM ({ARTICLES})")
def own_numbers(spark, d):
    return articles(spark, d).select("fiche_id", F.coalesce(g.own_numbers(F.col("fiche_id"), F.col("canonical")), F.lit(-1)).alias("number"))


@query(f"WITH {CITED} SELECT number, array_to_string(list_sort(list(DISTINCT canonical)), '|') AS holders FROM f WHERE number IS NOT NULL GROUP BY number HAVING count(DISTINCT canonical) > 1")
def number_conflicts(spark, d):
    return g.number_conflicts(articles(spark, d)).select("number", F.array_join("holders", "|").alias("holders"))


@query(f"WITH {CITED} SELECT fiche_id, target, bool_or(list_contains(list_transform(regexp_extract_all(prerequisite_text, '{NUM}', 1), lambda x: CAST(x AS BIGINT)), n)) AS prerequisite FROM c JOIN h ON h.number = n WHERE (own IS NULL OR n <> own) AND target <> canonical GROUP BY fiche_id, target")
def reference_edges(spark, d):
    return g.references(articles(spark, d))[0]


@query(f"WITH {CITED} SELECT DISTINCT fiche_id, n AS number FROM c WHERE (own IS NULL OR n <> own) AND n NOT IN (SELECT number FROM h)")
def references_missing(spark, d):
    return g.references(articles(spark, d))[1]


@query(f"""WITH {CITED}, r AS (SELECT fiche_id, canonical, CAST(unnest(regexp_extract_all(text, '(?i)\\b(?:annule et remplace|remplace|replaces|supersedes)\\b[^.\\n]{{0,40}}?\\bKB\\s?[-_]?0*(\\d{{1,7}})\\b', 1)) AS BIGINT) AS n FROM f),
b AS (SELECT fiche_id, canonical, CAST(unnest(regexp_extract_all(text, '(?i)(?:remplac[ée]e? par|obsol[eè]te[^.\\n]{{0,20}}?par|replaced by|superseded by)\\b[^.\\n]{{0,40}}?\\bKB\\s?[-_]?0*(\\d{{1,7}})\\b', 1)) AS BIGINT) AS n FROM f)
SELECT target AS fiche, fiche_id AS superseded_by FROM r JOIN h ON h.number = n WHERE target <> canonical UNION SELECT fiche_id, target FROM b JOIN h ON h.number = n WHERE target <> canonical""")
def replacement_edges(spark, d):
    return g.replacements(articles(spark, d))


@query("""WITH l AS (SELECT l_orderkey AS query, l_linenumber AS ord, l_partkey % 50 AS f FROM lineitem), c AS (SELECT query, ord, CASE WHEN f % 10 = 9 THEN f - 1 ELSE f END AS f FROM l)
SELECT query, CASE WHEN f % 10 = 4 THEN f + 1 ELSE f END AS fiche, min(ord) AS ord FROM c GROUP BY ALL""")
def prune_order(spark, d):
    li, f = table(spark, d, "lineitem"), F.col("l_partkey") % 50
    fiches = li.select(f.alias("fiche")).distinct()
    newer = fiches.where("fiche % 10 = 4").select("fiche", F.explode(F.array(F.col("fiche") + 2, F.col("fiche") + 1)).alias("superseded_by"))
    return g.prune(li.select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("ord"), f.alias("fiche")), fiches.where("fiche % 10 = 9").select("fiche", (F.col("fiche") - 1).alias("canonical")), newer)
