"""Queries on records, decomposition, routing builders, reviews, dictionaries and windows, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askwright.functions import entities, text as t
from askwright.operators import corpus, decisions, decomposition as dec, extraction as x, itsm, measurement as m, reports, routing as r
from askwright.plans.base import query, table
from askwright.plans.measure import EXACT, R, SWEEP, records, wilson_sql
from askwright.plans.rank import tokens
from askwright.streaming import windows

c, lit = F.col, F.lit


def tag(prefix, column):
    return F.concat(lit(prefix), column.cast("string"))


@query("SELECT doc_id, source || ' KB' || (doc_id + 10000) || ', 0xAB' || doc_id || ' kbx' AS clean FROM documents")
def canonical_identifiers(spark, d):
    planted = F.concat(c("source"), lit(" kb"), (c("doc_id") + 10000).cast("string"), lit(", 0XAB"), c("doc_id").cast("string"), lit(" kbx"))
    return table(spark, d, "documents").select("doc_id", t.canonical_identifiers(planted).alias("clean"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || ' guide' WHEN 1 THEN 'Titre ' || lang ELSE 'F' || doc_id END AS label FROM documents")
def label_texts(spark, d):
    n = c("doc_id").cast("string")
    label = F.when(c("doc_id") % 3 == 0, F.concat(lit("KB"), n, lit(" - "), c("source"), lit(" guide"))).otherwise(F.concat(lit("KB"), n))
    title = F.when(c("doc_id") % 3 == 1, F.concat(lit("KB-"), n, lit(" | Titre "), c("lang"))).otherwise(lit("KB9"))
    return table(spark, d, "documents").select("doc_id", t.label_text(label, title, tag("F", c("doc_id"))).alias("label"))


@query(r"""SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)</t[dh]>', ' | ', 'g'), '(?i)</(?:p|div|li|tr|h\d)>|<br\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)),
 lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> ''), chr(10))) AS sha FROM pages""")
def guide_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(t.guide_text(c("html")), 256).alias("sha"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(left(text, 39)) || '…' END AS head, upper(left(source, 1)) || upper(left(lang, 1)) AS letters FROM documents")
def display_forms(spark, d):
    return table(spark, d, "documents").select("doc_id", t.truncate(c("text"), 40).alias("head"), t.initials(F.concat_ws("  ", "source", "lang")).alias("letters"))


@query("SELECT source, substr(sha256(array_to_string(list_sort(list(DISTINCT lang)), chr(10))), 1, 16) AS fingerprint FROM documents GROUP BY source")
def source_fingerprints(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("l")).select("source", t.fingerprint(c("l")).alias("fingerprint"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'app:teams|' ELSE '' END || 'err:' || (1000 + doc_id % 500) || '|update:KB' || (100000 + doc_id) AS names FROM documents")
def entity_sets(spark, d):
    planted = F.concat(lit("Erreur "), (1000 + c("doc_id") % 500).cast("string"), F.when(c("doc_id") % 2 == 0, " sous Microsoft Teams").otherwise(" ici"), lit(" après KB"), (100000 + c("doc_id")).cast("string"), lit(", erreur "), (1000 + c("doc_id") % 500).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(x.canonical_set(entities.extract_udf(planted)), "|").alias("names"))


@query("SELECT DISTINCT l_orderkey AS line, 'app:' || (l_suppkey % 5) AS canonical FROM lineitem EXCEPT SELECT l_orderkey, 'app:' || (l_partkey % 5) FROM lineitem")
def novel_products(spark, d):
    li = table(spark, d, "lineitem")
    pick = lambda k: li.select(c("l_orderkey").alias("line"), tag("app:", c(k) % 5).alias("canonical"))
    return x.novel(pick("l_suppkey"), pick("l_partkey"), "line")


@query("SELECT DISTINCT l_orderkey AS doc, 's' || (l_partkey % 100) AS subject, 'r' || l_linenumber AS relation, 's' || (l_suppkey % 100) AS object FROM lineitem WHERE (l_orderkey + l_partkey) % 7 = 0 OR EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = lineitem.l_orderkey AND (k.l_orderkey + k.l_partkey) % 7 = 0 AND k.l_partkey % 100 IN (lineitem.l_partkey % 100, lineitem.l_suppkey % 100))")
def kept_triples(spark, d):
    li = table(spark, d, "lineitem")
    triples = li.select(c("l_orderkey").alias("doc"), tag("s", c("l_partkey") % 100).alias("subject"), tag("r", c("l_linenumber")).alias("relation"), tag("s", c("l_suppkey") % 100).alias("object"))
    return x.kept_triples(triples, li.where("(l_orderkey + l_partkey) % 7 = 0").select(c("l_orderkey").alias("doc"), tag("s", c("l_partkey") % 100).alias("entity")))


@query("WITH h AS (SELECT l_orderkey AS call, 'App ' || (l_partkey % 40) AS written, min(l_linenumber) AS pos FROM lineitem WHERE l_partkey % 40 < 25 GROUP BY ALL) SELECT call, array_to_string(list(written ORDER BY pos, written), '|') AS names FROM h GROUP BY call")
def locked_entities(spark, d):
    called = table(spark, d, "lineitem").select(c("l_orderkey").alias("call"), c("l_linenumber").alias("pos"), F.concat(lit(" ÀPP  "), (c("l_partkey") % 40).cast("string")).alias("name"))
    return x.locked_entities(called, spark.range(25).select(tag("App ", c("id")).alias("name"))).select("call", F.array_join("names", "|").alias("names"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim('Probleme : ' || left(source, 9) || chr(10) || 'Resolution : x') ELSE left(text, 3000) END AS summary FROM documents")
def call_summaries(spark, d):
    head = F.concat(lit("Problème : "), c("source").substr(1, 9), lit("\nResolution : x\n--- Transcription\n"), c("text"))
    return table(spark, d, "documents").select("doc_id", x.call_summary(F.when(c("doc_id") % 2 == 0, head).otherwise(c("text"))).alias("summary"))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 4 = 1 THEN 'data_deletion' END, CASE WHEN turn % 3 = 0 THEN 'mfa_reset' END, CASE WHEN turn % 5 = 2 THEN 'privileged_access' END, CASE WHEN turn % 4 = 3 THEN 'security_incident' END], lambda v: v IS NOT NULL), '|') AS flags FROM conversations""")
def risk_flags(spark, d):
    k = c("turn")
    planted = F.concat_ws(" ; ", c("role"), F.when(k % 3 == 0, "Réinitialiser le MFA"), F.when(k % 4 == 1, "merci d'effacer la boîte mail"), F.when(k % 5 == 2, "make me global admin"), F.when(k % 4 == 3, "un phishing"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(x.risk_flags(planted), "|").alias("flags"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'error_code' ELSE 'app' END AS name, event_type AS value, CASE WHEN event_id % 2 = 0 THEN least(0.5, least(1.0, greatest(0.0, value / 50))) ELSE least(1.0, greatest(0.0, value / 50)) END AS confidence FROM events WHERE event_id % 3 <> 0")
def checked_variables(spark, d):
    e = table(spark, d, "events")
    rows = e.select("event_id", F.concat(lit("vu: "), F.when(c("event_id") % 3 != 0, F.upper("event_type")).otherwise("rien")).alias("text"), F.when(c("event_id") % 2 == 0, "error_code").otherwise("app").alias("name"), c("event_type").alias("value"), (c("value") / 50).alias("confidence"))
    return x.checked_variables(rows).select("event_id", "name", "value", "confidence")


STEPS = "s AS (SELECT doc_id AS doc, text, CAST(least(5, length(text)) AS INTEGER) AS start, CAST(least(30, length(text)) AS INTEGER) AS e FROM documents WHERE text IS NOT NULL)"


def planted_steps(spark, d):
    s = table(spark, d, "documents").where("text is not null").select(c("doc_id").alias("doc"), "text", F.least(lit(5), F.length("text")).alias("start"), F.least(lit(30), F.length("text")).alias("end"))
    step = c("text").substr(c("start") + 1, c("end") - c("start"))
    return s.withColumn("step", F.when(c("doc") % 5 == 0, F.concat(step, lit("!"))).otherwise(step))


@query(f"WITH {STEPS} SELECT doc, CAST(1 AS BIGINT) AS steps, CAST(CASE WHEN doc % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS verified FROM s")
def step_checks(spark, d):
    return dec.step_checks(planted_steps(spark, d))


@query("WITH n AS (SELECT l_orderkey AS doc, CASE WHEN l_partkey % 3 = 0 THEN 'kb:KB' || (l_suppkey % 40) ELSE 'app:a' || (l_partkey % 9) END AS canonical, count(*) AS n FROM lineitem GROUP BY ALL) SELECT doc, array_to_string(list(canonical ORDER BY canonical), '|') AS refs FROM n WHERE canonical LIKE 'kb:%' AND canonical <> 'kb:KB' || (doc % 40) GROUP BY doc")
def document_references(spark, d):
    li = table(spark, d, "lineitem")
    named = li.select(c("l_orderkey").alias("doc"), F.when(c("l_partkey") % 3 == 0, tag("kb:KB", c("l_suppkey") % 40)).otherwise(tag("app:a", c("l_partkey") % 9)).alias("canonical"))
    own = li.select(c("l_orderkey").alias("doc"), tag("kb:KB", c("l_orderkey") % 40).alias("number")).distinct()
    return dec.references(dec.entity_counts(named), own).select("doc", F.array_join("references", "|").alias("refs"))


@query("SELECT count(*) AS fiches, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS guided, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS citable, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS info_only, CAST(sum(o_orderkey % 7) AS BIGINT) AS steps, CAST(sum(o_orderkey % 7 - o_orderkey % 2) AS BIGINT) AS verified, round(avg((o_orderkey % 10) / 10), 4) AS agreement FROM orders")
def kb_summary(spark, d):
    k = c("o_orderkey")
    return dec.summarize_kb(table(spark, d, "orders").select(F.when(k % 3 == 0, "guided").when(k % 3 == 1, "citable").otherwise("info_only").alias("status"), (k % 7).alias("n_steps"), (k % 7 - k % 2).alias("verified"), (k % 10 / 10).alias("agreement")))


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) AS pos FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<p>1. Ouvrir ' || source || '</p><p>intro</p><p>- Fermer ' || lang || '</p>' ELSE '<p>' || replace(coalesce(text, ''), chr(10), '</p><p>') || '</p>' END AS h, regexp_replace(regexp_replace(h, '(?i)</p>', chr(10), 'g'), '<[^>]*>', '', 'g') AS p FROM documents)),
k AS (SELECT doc, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS w FROM l), g AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i, regexp_extract(w, '(?i)^\s*(?:\d{1,2}\s*[.)]|[-•*]|(?:[ée]tape|step)\s*\d{1,2}\s*[:.\-]?)\s+(\S.*)$', 1) AS item FROM k WHERE w <> ''),
b AS (SELECT *, CASE WHEN item <> '' THEN 1 WHEN length(w) >= 25 THEN 2 ELSE 3 END AS kind, CASE WHEN item <> '' THEN item ELSE w END AS said FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS o FROM b QUALIFY kind = min(kind) OVER (PARTITION BY doc)), z AS (SELECT doc, kind, said, row_number() OVER (PARTITION BY doc ORDER BY pos) AS ord FROM o)
SELECT doc, CAST(ord AS INTEGER) AS "order", regexp_replace(left(said, 60), '[ .,:;]+$', '') AS title, left(said, 700) AS instruction FROM z WHERE ord <= 25 AND (kind < 3 OR ord = 1)""")
def fallback_guides(spark, d):
    docs = table(spark, d, "documents")
    listed = F.concat(lit("<p>1. Ouvrir "), c("source"), lit("</p><p>intro</p><p>- Fermer "), c("lang"), lit("</p>"))
    html = F.when(c("doc_id") % 2 == 0, listed).otherwise(F.concat(lit("<p>"), F.replace(F.coalesce("text", lit("")), lit("\n"), lit("</p><p>")), lit("</p>")))
    return dec.fallback_guide(docs, "doc_id", "doc_id", html).select("doc", "order", "title", "instruction")


@query("WITH s AS (SELECT l_orderkey AS guide, 'c' || (l_partkey % 50) AS chunk, CASE WHEN l_suppkey % 29 = 0 THEN ' ' ELSE 'etape ' || (l_partkey % 50) END AS instruction FROM lineitem) SELECT guide, min(CASE WHEN CAST(substr(chunk, 2) AS INTEGER) < 48 AND trim(instruction) <> '' THEN 1 ELSE 0 END) = 1 AND count(*) <= 25 AS ok, count(*) FILTER (WHERE CAST(substr(chunk, 2) AS INTEGER) < 48 AND trim(instruction) <> '' AND CAST(substr(chunk, 2) AS INTEGER) % 2 = 0) AS verbatim FROM s GROUP BY guide")
def checked_guides(spark, d):
    li = table(spark, d, "lineitem")
    steps = li.select(c("l_orderkey").alias("guide"), tag("c", c("l_partkey") % 50).alias("chunk"), F.when(c("l_suppkey") % 29 == 0, " ").otherwise(tag("etape ", c("l_partkey") % 50)).alias("instruction"), lit(True).alias("verbatim"))
    chunks = spark.range(48).select(tag("c", c("id")).alias("chunk"), F.when(c("id") % 2 == 0, F.concat(lit("Voir l'ETAPE  "), c("id").cast("string"), lit(" ici"))).otherwise("autre").alias("text"))
    return dec.check_guide(steps, chunks)


@query("SELECT l_orderkey AS doc, coalesce(min(l_linenumber) FILTER (WHERE l_linenumber = 1 + l_orderkey % 9), min(l_linenumber) FILTER (WHERE l_linenumber % 3 = 0), min(l_linenumber)) AS n, count(*) FILTER (WHERE l_linenumber = 1 + l_orderkey % 9) > 0 AS verified FROM lineitem GROUP BY l_orderkey")
def cited_steps(spark, d):
    li = table(spark, d, "lineitem")
    steps = li.select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("n"), F.concat(lit("Ouvrez « la "), c("l_linenumber").cast("string"), lit("e page » puis validez.")).alias("text"), F.when(c("l_linenumber") % 3 == 0, "resolution").otherwise("symptom").alias("role"))
    cited = li.select(c("l_orderkey").alias("doc"), F.concat(lit('ouvrez "LA '), (1 + c("l_orderkey") % 9).cast("string"), lit('e page"')).alias("citation")).distinct()
    return dec.cited_step(steps, cited).select("doc", "n", "verified")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Harmony ' || 'RH' || '|Zed' || (doc_id % 10) WHEN 1 THEN '' ELSE 'Zed' || (doc_id % 10) END AS names FROM documents")
def dictionary_candidates(spark, d):
    zed = F.concat(lit(", le module Zed"), (c("doc_id") % 10).cast("string"), lit(" puis logiciel Excel"))
    planted = F.when(c("doc_id") % 3 == 0, F.concat(lit("l'application Harmony  RH"), zed)).when(c("doc_id") % 3 == 1, "le service desk").otherwise(F.concat(lit("x"), zed))
    return table(spark, d, "documents").select("doc_id", F.array_join(corpus.dictionary_candidates(planted), "|").alias("names"))


@query(f"WITH df AS (SELECT alias, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS alias FROM documents) GROUP BY alias), p AS (SELECT DISTINCT 't' || (item_id % 7) AS term, unnest({tokens('text')}) AS alias FROM benchmark) SELECT term, alias, n FROM p JOIN df USING (alias) WHERE n >= 2 AND term <> 't3'")
def verified_aliases(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    frequency = docs.select("doc_id", F.explode(F.array_distinct(t.tokenize(c("text")))).alias("alias")).groupBy("alias").agg(F.count("*").alias("n"))
    proposed = items.select(tag("t", c("item_id") % 7).alias("term"), F.explode(t.tokenize(c("text"))).alias("alias")).distinct()
    return corpus.verified_aliases(proposed, frequency, spark.createDataFrame([("t3",)], "term string"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(' ' || regexp_replace(html, '[^A-Za-z]+', '  ', 'g') || ' ', ' [A-Za-z]+ ')) AS w FROM pages) SELECT lower(trim(w)) AS word, count(*) AS seen, round(count(*) FILTER (WHERE regexp_matches(trim(w), '^[A-Z]')) / count(*), 6) AS share FROM w GROUP BY 1""")
def capitalized_shares(spark, d):
    letters = F.regexp_replace("html", "[^A-Za-z]+", "  ")
    return corpus.capitalized_shares(table(spark, d, "pages"), letters).select("word", "seen", F.round("share", 6).alias("share"))


@query("SELECT CASE WHEN o_orderkey % 5 > 1 THEN 'kept' WHEN o_custkey % 3 = 0 THEN 'forced' WHEN o_orderkey % 5 = 0 THEN 'empty' ELSE 'title_pattern' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def exclusion_stats(spark, d):
    o = table(spark, d, "orders")
    rule = F.when(c("o_orderkey") % 5 == 0, "empty").when(c("o_orderkey") % 5 == 1, "title_pattern")
    return corpus.exclusion_stats(o.select(c("o_orderkey").alias("fiche_id"), rule.alias("rule")), o.where("o_custkey % 3 = 0").select(c("o_orderkey").alias("fiche_id")))


@query("SELECT 'F' || p_partkey AS fiche FROM part WHERE p_size > 5 AND p_partkey % 6 <> 0 AND 'F' || p_partkey NOT IN (SELECT 'F' || l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_suppkey % 5 = 0)")
def routable_fiches(spark, d):
    return r.routable(_fiches(spark, d), _superseded(spark, d))


def _fiches(spark, d):
    k = c("p_partkey")
    return table(spark, d, "part").select(tag("F", k).alias("fiche"), (c("p_size") > 5).alias("searchable"), F.when(k % 6 == 0, tag("F", k - 1)).otherwise(tag("F", k)).alias("canonical"))


def _superseded(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber = 7 AND l_suppkey % 5 = 0").select(tag("F", c("l_partkey")).alias("fiche"))


@query("WITH h AS (SELECT DISTINCT l_orderkey AS number, CASE WHEN l_partkey % 4 = 0 THEN 'F' || (l_partkey // 8) ELSE 'F' || l_partkey END AS fiche FROM lineitem WHERE l_linenumber <= 2), p AS (SELECT number, list_sort(list(DISTINCT fiche)) AS f FROM h GROUP BY number) SELECT number, CASE WHEN len(f) = 1 THEN f[1] END AS fiche, array_to_string(f, '|') AS fiches, CASE WHEN len(f) > 1 THEN 'collision' ELSE 'l0' END AS outcome FROM p WHERE len(f) > 1 OR CAST(substr(f[1], 2) AS BIGINT) % 5 <> 0")
def number_table(spark, d):
    li = table(spark, d, "lineitem")
    holders = li.where("l_linenumber <= 2").select(c("l_orderkey").alias("number"), tag("F", c("l_partkey")).alias("fiche"))
    resolve = table(spark, d, "part").where("p_partkey % 4 = 0").select(tag("F", c("p_partkey")).alias("fiche"), tag("F", F.floor(c("p_partkey") / 8)).alias("target"))
    known = table(spark, d, "part").select(F.explode(F.array("p_partkey", F.floor(c("p_partkey") / 8))).alias("k")).where("k % 5 = 0").distinct()
    status = known.select(tag("F", c("k")).alias("fiche"), lit("rejected").alias("status"))
    return r.number_table(holders, resolve, status).withColumn("fiches", F.array_join("fiches", "|"))


@query("""WITH dn AS (SELECT 'F' || p_partkey AS fiche, 'I' || (p_partkey % 60) AS intent, CASE WHEN p_partkey % 11 = 0 THEN 'old' ELSE 'f' END AS fp, CASE WHEN p_size % 3 > 0 THEN 'a' || (p_size % 3) ELSE '' END AS app FROM part), k AS (SELECT intent, app, list_sort(list(DISTINCT fiche)) AS f FROM dn WHERE fp = 'f' AND CAST(substr(intent, 2) AS INTEGER) < 50 GROUP BY ALL),
p AS (SELECT DISTINCT 'P' || o_custkey AS p, 'I' || (o_custkey % 400) AS intent, CASE WHEN o_custkey % 2 = 0 THEN 'a1' ELSE '' END AS other FROM orders), j AS (SELECT k.intent, k.app, list_sort(list(DISTINCT p.p) FILTER (WHERE p.p IS NOT NULL AND (other = app OR other = '' OR app = ''))) AS pending, any_value(f) AS f FROM k LEFT JOIN p ON p.intent = k.intent GROUP BY k.intent, k.app)
SELECT intent, app, array_to_string(f, '|') AS fiches, coalesce(array_to_string(pending, '|'), '') AS pending, CASE WHEN len(coalesce(pending, [])) > 0 THEN 'blocked' WHEN len(f) > 1 THEN 'collision' ELSE 'l2' END AS outcome FROM j""")
def intent_table(spark, d):
    k = c("p_partkey")
    decided = table(spark, d, "part").select(tag("F", k).alias("fiche"), tag("I", k % 60).alias("intent"), F.when(k % 11 == 0, "old").otherwise("f").alias("fingerprint"), F.when(c("p_size") % 3 > 0, tag("a", c("p_size") % 3)).alias("app"))
    taxonomy = spark.range(50).select(tag("I", c("id")).alias("intent"), lit("f").alias("now"))
    proposals = table(spark, d, "orders").select(tag("P", c("o_custkey")).alias("fiche"), tag("I", c("o_custkey") % 400).alias("intent"), F.when(c("o_custkey") % 2 == 0, "a1").alias("app")).distinct()
    found = r.intent_table(decided, taxonomy, proposals, proposals.select("fiche").where("false"))
    return found.select("intent", "app", F.array_join("fiches", "|").alias("fiches"), F.array_join("pending", "|").alias("pending"), "outcome")


@query("""WITH s AS (SELECT l_orderkey AS query, 'k' || l_linenumber AS identifier, 'F' || (l_partkey % 3) AS fiche, l_suppkey % 2 = 0 AS entry FROM lineitem), n AS (SELECT query, count(DISTINCT identifier) AS n FROM s GROUP BY query), h AS (SELECT query, fiche, count(DISTINCT identifier) AS k, min(identifier) FILTER (WHERE entry) AS key FROM s GROUP BY ALL),
a AS (SELECT h.* FROM h JOIN n USING (query) WHERE k = n QUALIFY count(*) OVER (PARTITION BY query) = 1) SELECT query, fiche, key FROM a WHERE key IS NOT NULL AND fiche <> 'F2'""")
def number_match(spark, d):
    s = table(spark, d, "lineitem").select(c("l_orderkey").alias("query"), tag("k", c("l_linenumber")).alias("identifier"), tag("F", c("l_partkey") % 3).alias("fiche"), (c("l_suppkey") % 2 == 0).alias("entry"))
    return r.match_numbers(s, spark.createDataFrame([("F0",), ("F1",)], "fiche string"))


@query("""WITH n AS (SELECT l_orderkey AS query, list_sort(list(DISTINCT 'a' || (l_partkey % 4)) FILTER (WHERE l_linenumber > 3)) AS apps FROM lineitem GROUP BY 1), q AS (SELECT n.query, coalesce(apps, []) AS apps, CASE WHEN n.query % 3 > 0 THEN 'a' || (n.query % 4) END AS app FROM n)
SELECT query, CASE WHEN len(apps) = 1 THEN apps[1] WHEN app IS NOT NULL AND (len(apps) = 0 OR list_contains(apps, app)) THEN app END AS app, CASE WHEN len(apps) = 1 THEN 'code' WHEN app IS NOT NULL AND (len(apps) = 0 OR list_contains(apps, app)) THEN 'model' END AS source FROM q""")
def question_app(spark, d):
    li = table(spark, d, "lineitem")
    named = li.groupBy(c("l_orderkey").alias("query")).agg(F.array_sort(F.collect_set(F.when(c("l_linenumber") > 3, tag("a", c("l_partkey") % 4)))).alias("apps"))
    model = named.select("query", F.when(c("query") % 3 > 0, tag("a", c("query") % 4)).alias("app"))
    return r.question_app(named, model)


@query("""WITH l AS (SELECT substr(sha256('F' || p_partkey), 1, 2) AS part, 'F' || p_partkey || ' ' || sha256(CAST(p_size AS VARCHAR)) AS line FROM part), p AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha FROM l GROUP BY part) SELECT sha256(string_agg(sha, chr(10) ORDER BY part)) AS kb_sha256 FROM p""")
def kb_digest(spark, d):
    return r.kb_digest(table(spark, d, "part").select(tag("F", c("p_partkey")).alias("fiche"), F.sha2(c("p_size").cast("string"), 256).alias("sha256")))


@query("SELECT 'F' || o_orderkey AS fiche, 'I' || (o_custkey % 90) AS intent FROM orders WHERE o_custkey % 90 >= 80 OR o_custkey % 7 = 0")
def orphaned_decisions(spark, d):
    new = spark.range(80).select(tag("I", c("id")).alias("intent"), lit("f").alias("fingerprint"))
    made = table(spark, d, "orders").select(tag("F", c("o_orderkey")).alias("fiche"), tag("I", c("o_custkey") % 90).alias("intent"), F.when(c("o_custkey") % 7 == 0, "old").otherwise("f").alias("fingerprint"))
    return r.taxonomy_changes(new, new, made)[1]


@query("SELECT 'F' || p_partkey AS fiche, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS r, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS i, p_name AS label FROM part")
def review_queue(spark, d):
    p = table(spark, d, "part")
    every = lambda n: p.where(c("p_partkey") % n == 0).select(tag("F", c("p_partkey")).alias("fiche"))
    return r.review_queue(p.select(tag("F", c("p_partkey")).alias("fiche"), c("p_name").alias("label")), every(5), every(3))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN 'unknown_status' WHEN o_custkey % 10 = 0 THEN 'no_reviewer' WHEN o_custkey % 9 = 0 THEN 'text_changed' WHEN o_orderkey % 6 < 3 AND o_custkey % 2 = 0 AND o_custkey % 4 <> 0 THEN 'unknown_intent' WHEN o_orderkey % 6 < 3 AND o_custkey % 5 = 0 THEN 'alias_refused' WHEN o_orderkey % 6 < 3 AND o_custkey % 7 = 0 THEN 'code_not_unique' END AS problem FROM orders")
def review_problems(spark, d):
    k, s = c("o_custkey"), c("o_orderkey") % 6
    rows = table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), F.when(s < 3, "validated").when(s < 5, "rejected").otherwise("maybe").alias("status"), F.when(k % 2 == 0, "I").alias("intent"), (k % 4 == 0).alias("known_intent"),
        (k % 5 != 0).alias("aliases_ok"), (k % 7 != 0).alias("codes_ok"), (k % 9 != 0).alias("sha_current"), F.when(k % 10 != 0, "someone").otherwise(" ").alias("decided_by"),
    )
    return rows.select("id", r.decision_problem().alias("problem"))


@query("""WITH e AS (SELECT l_orderkey AS query, 'e' || (l_partkey % 60) AS entity, l_linenumber > 4 AS answer FROM lineitem), k AS (SELECT query, entity, answer, CAST(substr(entity, 2) AS INTEGER) < 45 AS known FROM e) SELECT query, coalesce(array_to_string(list_sort(list(DISTINCT entity) FILTER (WHERE known AND NOT answer)), '|'), '') AS known, coalesce(array_to_string(list_sort(list(DISTINCT entity) FILTER (WHERE NOT known AND NOT answer)), '|'), '') AS ignored, coalesce(array_to_string(list_sort(list(DISTINCT entity) FILTER (WHERE known AND answer)), '|'), '') AS answers FROM k GROUP BY query""")
def ticket_entities(spark, d):
    e = table(spark, d, "lineitem").select(c("l_orderkey").alias("query"), tag("e", c("l_partkey") % 60).alias("entity"), (c("l_linenumber") > 4).alias("answer"))
    index = spark.range(45).select(tag("e", c("id")).alias("entity"), lit("F").alias("fiche"))
    found = decisions.ticket_entities(e.where("NOT answer").drop("answer"), index, e.where("answer").drop("answer"))
    return found.select("query", *[F.array_join(n, "|").alias(n) for n in ("known", "ignored", "answers")])


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS query, l_partkey % 30 AS f FROM lineitem), a AS (SELECT l_orderkey AS query, count(DISTINCT l_suppkey % 6) AS n, min(l_suppkey % 6) AS app FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), j AS (SELECT k.*, n = 1 AND f % 6 = app AS has FROM k LEFT JOIN a USING (query)) SELECT query, 'F' || f AS fiche FROM j QUALIFY coalesce(has, false) OR NOT bool_or(coalesce(has, false)) OVER (PARTITION BY query)""")
def single_app_filter(spark, d):
    li = table(spark, d, "lineitem")
    apps = li.where("l_linenumber <= 2").select(c("l_orderkey").alias("query"), tag("app:", c("l_suppkey") % 6).alias("app"))
    index = spark.range(30).select(tag("app:", c("id") % 6).alias("entity"), tag("F", c("id")).alias("fiche"))
    return decisions.single_app_filter(li.select(c("l_orderkey").alias("query"), tag("F", c("l_partkey") % 30).alias("fiche")).distinct(), apps, index)


HALF = "('0x' || substr(sha256(CAST(ticket_id AS VARCHAR)), 8, 1))::INTEGER % 2"
SWEEP_A = f"{R}, ca AS (SELECT * FROM c WHERE {HALF} = 0), cb AS (SELECT * FROM c WHERE {HALF} = 1){SWEEP.removeprefix(R).replace('FROM c WHERE', 'FROM ca WHERE').replace('FROM c GROUP', 'FROM ca GROUP')}"


@query(f"""WITH {SWEEP_A}, h AS (SELECT engine, threshold, exact, wrong_shown FROM sw WHERE {wilson_sql('wrong_shown', 'n', '+')} <= 0.45 QUALIFY row_number() OVER (PARTITION BY engine ORDER BY threshold NULLS FIRST) = 1),
nb AS (SELECT engine, count(*) AS tickets_b FROM cb GROUP BY engine), kb AS (SELECT engine, count(*) FILTER (WHERE {EXACT}) AS exact_b, count(*) FILTER (WHERE NOT {EXACT}) AS wrong_b FROM cb JOIN h USING (engine) WHERE shown IS NOT NULL AND (score IS NULL OR threshold IS NULL OR score >= threshold) GROUP BY engine)
SELECT tot.engine, tot.n AS tickets_a, tickets_b, threshold, exact AS exact_a, wrong_shown AS wrong_a, exact_b, wrong_b, coalesce({wilson_sql('wrong_b', 'tickets_b', '+')} <= 0.45, false) AS confirmed,
 CASE WHEN wrong_b IS NULL THEN 'over_ceiling' WHEN {wilson_sql('wrong_b', 'tickets_b', '+')} <= 0.45 THEN 'confirmed' ELSE 'not_confirmed' END AS reason
 FROM tot JOIN nb USING (engine) LEFT JOIN h USING (engine) LEFT JOIN kb USING (engine)""")
def split_recommendation(spark, d):
    return m.split_recommendation(records(spark, d), t.split_half(c("ticket_id"), "scoreboard"), 0.45)


@query("SELECT DISTINCT l_orderkey AS ticket_id, f AS fiche FROM (SELECT l_orderkey, 'F' || (l_partkey % 100) AS f FROM lineitem UNION ALL SELECT l_orderkey, 'F' || (l_partkey % 100 // 10) FROM lineitem WHERE l_partkey % 100 >= 50)")
def accepted_closure(spark, d):
    expected = table(spark, d, "lineitem").select(c("l_orderkey").alias("ticket_id"), tag("F", c("l_partkey") % 100).alias("fiche"))
    return m.accepted_closure(expected, spark.range(50, 100).select(tag("F", c("id")).alias("fiche"), tag("F", F.floor(c("id") / 10)).alias("target")))


@query("""WITH p AS (SELECT 'e' || (o_custkey % 3) AS engine, o_orderkey AS threshold, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 3) AS n, o_orderkey % 997 = 0 AS rec FROM orders)
SELECT engine, threshold, rec AS recommended, n <= 9 OR rec OR i = 0 OR i = n - 1 OR i IN (SELECT CAST(round_even(k * ((n - 1) / 7), 0) AS BIGINT) FROM range(1, 7) t(k)) AS sampled FROM p""")
def sampled_sweep(spark, d):
    """Every threshold, and whether it is among the nine that a report shows."""
    sweep = table(spark, d, "orders").select(tag("e", c("o_custkey") % 3).alias("engine"), c("o_orderkey").alias("threshold"), (c("o_orderkey") % 997 == 0).alias("recommended"))
    return m.marked_sweep(sweep)


@query("SELECT what, value, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'status' AS what, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2) GROUP BY ALL")
def tallies(spark, d):
    o = table(spark, d, "orders")
    part = lambda what, col, half: o.where(c("o_orderkey") % 2 == half).groupBy(lit(what).alias("what"), c(col).alias("value")).agg(F.count("*").alias("n"))
    parts = [part(w, k, h) for w, k in (("status", "o_orderstatus"), ("priority", "o_orderpriority")) for h in (0, 1)]
    return m.tallies(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


@query("SELECT l_orderkey AS number, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'F' || min(l_suppkey) END AS fiche, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM lineitem GROUP BY 1")
def number_holders(spark, d):
    return m.unique_holders(table(spark, d, "lineitem").select(c("l_orderkey").alias("number"), tag("F", c("l_suppkey")).alias("fiche")))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_custkey % 11 = 0 THEN 'target_privileged_role' END, CASE WHEN o_orderkey % 7 >= 5 THEN 'action_not_implemented' END, CASE WHEN o_orderkey % 7 = 3 AND o_custkey % 4 = 0 THEN 'group_not_allowlisted' END, CASE WHEN o_custkey % 3 = 0 THEN 'proposal_not_pending' END, CASE WHEN o_custkey % 5 = 0 THEN 'not_validated' END], lambda v: v IS NOT NULL), ',') AS reasons FROM orders""")
def execution_prechecks(spark, d):
    k = c("o_custkey")
    names = F.array(*map(lit, ["password_reset", "mfa_reset", "offboarding", "group_add", "license_assign", "escalate", "other"]))
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (k % 11 == 0).alias("privileged"), F.get(names, (c("o_orderkey") % 7).cast("int")).alias("action"), (k % 4 != 0).alias("group_ok"), F.when(k % 3 != 0, "pending_review").alias("proposal_status"), F.when(k % 5 != 0, "validated").otherwise("x").alias("review_status"))
    return rows.select("id", F.array_join(itsm.precheck(), ",").alias("reasons"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN 'not_found' WHEN o_custkey % 5 = 0 THEN 'inactive' WHEN o_custkey % 3 = 0 THEN 'dry_run' WHEN o_orderkey % 2 = 0 AND o_custkey % 11 = 0 THEN 'error' WHEN o_orderkey % 10 < 8 THEN 'success' ELSE 'error' END AS status FROM orders")
def write_back_status(spark, d):
    k = c("o_custkey")
    rows = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (k % 7 != 0).alias("found"), (k % 5 != 0).alias("active"), (k % 3 == 0).alias("dry_run"), F.when(c("o_orderkey") % 2 == 0, "handover").otherwise("note").alias("kind"), (k % 11 != 0).alias("group_found"), F.when(c("o_orderkey") % 10 < 8, 200).when(c("o_orderkey") % 10 == 8, 500).alias("code"))
    return rows.select("id", itsm.write_back_status().alias("status"))


@query("SELECT p_partkey AS sku, CAST(p_size - p_partkey % 30 AS BIGINT) AS free FROM part WHERE p_size > p_partkey % 30")
def free_licence_seats(spark, d):
    return itsm.free_seats(table(spark, d, "part").select(c("p_partkey").alias("sku"), c("p_size").cast("long").alias("enabled"), (c("p_partkey") % 30).alias("consumed")))


@query("SELECT o_orderkey AS session, CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'O' THEN 'handover' ELSE 'open' END AS outcome, array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'Étapes suivies' END, o_orderpriority, ' '], lambda v: v IS NOT NULL AND trim(v) <> ''), chr(10)) AS note FROM orders")
def session_outcomes(spark, d):
    rules = spark.createDataFrame([(2, "F", "late"), (1, "F", "solved"), (1, "O", "handover"), (3, "P", "open")], "ord int, phase string, outcome string")
    parts = F.array(F.when(c("o_orderkey") % 2 == 0, "Étapes suivies"), c("o_orderpriority"), lit(" "))
    return itsm.first_outcome(rules, table(spark, d, "orders").select(c("o_orderkey").alias("session"), c("o_orderstatus").alias("phase"), parts.alias("parts")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    return windows.session_windows(table(spark, d, "events"), "ts", "user_id")


@query("""SELECT event_type, w AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL""")
def sliding_events(spark, d):
    return windows.sliding_counts(table(spark, d, "events"), "ts", "event_type")


@query("""WITH RECURSIVE e AS (SELECT event_type || (user_id % 20) AS key, epoch(ts)::BIGINT AS t FROM events), o AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM e), f AS (SELECT key, i, t AS made, 0 AS hit FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, CASE WHEN o.t - f.made < 3600 THEN f.made ELSE o.t END, CASE WHEN o.t - f.made < 3600 THEN 1 ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1) SELECT key, count(*) AS requests, CAST(sum(hit) AS BIGINT) AS hits FROM f GROUP BY key""")
def cached_answers(spark, d):
    return windows.cached_answers(table(spark, d, "events").select(F.concat("event_type", (c("user_id") % 20).cast("string")).alias("key"), "ts"), 3600)


@query("SELECT conv_id, least(count(*), 14) AS messages, sha256(right(string_agg(text, ' ' ORDER BY turn, text), 4000)) AS memory FROM conversations GROUP BY conv_id")
def session_memory(spark, d):
    return windows.bounded_memory(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "messages", F.sha2("memory", 256).alias("memory"))


@query("SELECT event_id, 'sn-inc' || (event_id % 500) AS session, abs(epoch(ts)::BIGINT - (epoch(ts)::BIGINT + (event_id % 1000) - 500)) <= 300 AS accepted FROM events")
def signed_calls(spark, d):
    e = table(spark, d, "events")
    sent = F.timestamp_seconds(F.unix_timestamp("ts") + c("event_id") % 1000 - 500)
    return e.select("event_id", windows.session_id(F.concat(lit(" INC"), (c("event_id") % 500).cast("string"), lit(" "))).alias("session"), windows.accepted_call(sent, c("ts")).alias("accepted"))


@query(r"""WITH f AS (SELECT 'KB' || doc_id AS fiche_id, left(split_part(text, chr(10), 1), 60) AS title, CASE doc_id % 5 WHEN 0 THEN 'a/KB' || doc_id || '.md' WHEN 1 THEN 'b\Guide ' || source || '.v1.pdf' WHEN 2 THEN '' WHEN 3 THEN 'KB0012 - Cache ' || doc_id ELSE 'x/12.html' END AS source FROM documents),
s AS (SELECT *, regexp_replace(list_last(string_split(replace(source, '\', '/'), '/')), '(.)[.][^.]+$', '\1') AS stem, CASE WHEN title <> '' AND count(*) OVER (PARTITION BY title) = 1 THEN title END AS own FROM f)
SELECT fiche_id, CASE WHEN regexp_matches(regexp_replace(stem, '(?i)KB *0*[0-9]+', ' ', 'g'), '[A-Za-z]{3}') THEN stem WHEN own IS NOT NULL AND NOT contains(fiche_id, own) THEN fiche_id || ' – ' || own ELSE fiche_id END AS label,
 array_to_string(list_filter([stem, CASE WHEN fiche_id <> stem THEN fiche_id END, own], lambda x: x <> ''), chr(10)) AS names FROM s""")
def map_labels(spark, d):
    """Documents as articles named by paths of five kinds; the title is the first line."""
    i, n = c("doc_id") % 5, c("doc_id").cast("string")
    path = F.when(i == 0, F.concat(lit("a/KB"), n, lit(".md"))).when(i == 1, F.concat(lit("b\\Guide "), c("source"), lit(".v1.pdf"))).when(i == 2, "").when(i == 3, F.concat(lit("KB0012 - Cache "), n)).otherwise("x/12.html")
    return reports.map_labels(table(spark, d, "documents").select(F.concat(lit("KB"), n).alias("fiche_id"), F.substring_index("text", "\n", 1).substr(1, 60).alias("title"), path.alias("source")))


@query("""WITH s AS (SELECT l_orderkey AS query, l_linenumber = 1 AS pr, CASE l_partkey % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'text' END AS kind FROM lineitem),
g AS (SELECT query, min(kind) FILTER (WHERE pr) AS k, count(*) FILTER (WHERE NOT pr AND kind <> 'text') AS a, count(*) FILTER (WHERE NOT pr AND kind = 'text') AS t FROM s GROUP BY query)
SELECT query, CASE WHEN k IS NULL THEN '' ELSE CASE k WHEN 'text' THEN 'Basé sur un document KB' ELSE 'Basé sur un appel support' END || CASE a WHEN 0 THEN '' WHEN 1 THEN ' · corroboré par 1 appel' ELSE ' · corroboré par ' || a || ' appels' END
 || CASE t WHEN 0 THEN '' WHEN 1 THEN ' · 1 document KB en complément' ELSE ' · ' || t || ' documents KB en complément' END END AS said FROM g""")
def modality_summary(spark, d):
    """An order's first line is the primary source of an answer, the others are related."""
    k = c("l_partkey") % 4
    kind = F.when(k == 0, "audio").when(k == 1, "video").otherwise("text")
    return reports.modality_summary(table(spark, d, "lineitem").select(c("l_orderkey").alias("query"), (c("l_linenumber") == 1).alias("primary"), kind.alias("kind")))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 0.5 END AS score FROM orders")
def designated_scores(spark, d):
    """A designated fiche has no score: no threshold may hide it."""
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_custkey") % 7 != 0, lit(0.5)).alias("score"))


@query("""SELECT count(*) AS fiches, count(*) FILTER (WHERE doc_id % 17 = 0) AS errors, count(*) FILTER (WHERE doc_id % 3 > 0) AS with_intent, count(*) FILTER (WHERE doc_id % 5 = 0) AS with_primary_app,
 count(*) FILTER (WHERE doc_id % 10 = 0) AS app_inferred, CAST(sum(doc_id % 4 + CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS aliases, CAST(sum(doc_id % 2) AS BIGINT) AS dropped FROM documents""")
def enrichment_stats(spark, d):
    n = c("doc_id")
    rows = table(spark, d, "documents").select(
        n.alias("fiche_id"), F.when(n % 17 == 0, "failed").alias("error"), F.when(n % 3 > 0, "RESET").otherwise("").alias("canonical_intent"), F.when(n % 5 == 0, c("lang")).alias("primary_app"), (n % 10 == 0).alias("app_inferred"),
        F.array_repeat(c("source"), (n % 4).cast("int")).alias("aliases_fr"), F.when(n % 6 != 0, F.array("lang")).alias("aliases_en"), F.array_repeat(lit("x"), (n % 2).cast("int")).alias("dropped"),
    )
    return reports.enrichment_stats(rows)
