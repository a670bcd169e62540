"""Queries on extraction and segmentation over literal fixtures (the corpus tables hold no such text), and on scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.functions import entities, segment, unicode_text
from askwright.operators import extraction
from askwright.plans.base import planted, planted_sql, query, table, values

SENTENCES = [
    (1, "Erreur 0x80070005 puis -2147024891", ["err:0x80070005", "err:0x80070005"]),
    (2, "KB0012345 et KB893803, INC0012345", ["kb:KB0012345", "update:KB893803", "ticket:INC0012345"]),
    (3, "Microsoft Teams sous Windows 10, event id 4625", ["app:teams", "os:windows-10", "evt:4625"]),
    (4, "Rien de technique", []),
    (5, "Voir https://Example.COM/Aide/ puis ctrl + maj + esc", ["url:https://example.com/Aide", "key:ctrl+shift+esc"]),
]
TEXTS = [(i, t) for i, t, _ in SENTENCES]
FOUND = [(i, n + 1, c) for i, _, cs in SENTENCES for n, c in enumerate(cs)]


@query(f"SELECT doc_id AS id, n, canonical FROM documents JOIN {values(FOUND, 'id int, n int, canonical string')} f ON f.id = 1 + doc_id % 5")
def entity_rows(spark, d):
    rows = planted(spark, d, TEXTS, "id int, t string").select("id", F.posexplode(entities.extract_udf("t")).alias("n", "e"))
    return rows.select("id", (F.col("n") + 1).alias("n"), "e.canonical")


@query(rf"SELECT id, upper(unnest(regexp_extract_all(t, '0x([0-9a-fA-F]{{4,8}})\b', 1))) AS code FROM {planted_sql(TEXTS, 'id int, t string', ('t',))}")
def hex_codes(spark, d):
    return planted(spark, d, TEXTS, "id int, t string", ("t",)).select("id", F.explode(extraction.hex_codes(F.col("t"))).alias("code"))


@query(rf"SELECT id, substr(printf('%X', 4294967296 - n), 1, 8) AS code FROM (SELECT id, CAST(unnest(regexp_extract_all(t || ' -2147483648 -2999999999 -' || (2147400000 + id * 1000), '(?:^|[^\w.])-(2\d{{9}})\b', 1)) AS BIGINT) AS n FROM {planted_sql(TEXTS, 'id int, t string', ('t',))}) WHERE n <= 2147483648")
def negative_codes(spark, d):
    rows = planted(spark, d, TEXTS, "id int, t string", ("t",))
    said = F.concat("t", F.lit(" -2147483648 -2999999999 -"), (2147400000 + F.col("id") * 1000).cast("string"))
    return rows.select("id", F.explode(extraction.negative_codes(said)).alias("code"))


TERMS = "(SELECT n_name AS term, n_nationkey AS k FROM nation UNION ALL SELECT r_name, 100 + r_regionkey FROM region)"


@query(f"""SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS rank FROM (SELECT doc_id AS id, concat_ws(chr(10), n_name, 'aux é', text) AS t FROM documents JOIN nation ON n_nationkey = doc_id % 25) JOIN {TERMS}
 ON contains(lower(strip_accents(t)), lower(strip_accents(term))) WHERE length(term) >= 2""")
def vocabulary_entities(spark, d):
    """Names of nations and regions; each document is given one."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    terms = nation.select(F.col("n_name").alias("term")).unionByName(region.select(F.col("r_name").alias("term")))
    texts = table(spark, d, "documents").join(nation, F.col("doc_id") % 25 == F.col("n_nationkey")).select(F.col("doc_id").alias("id"), F.concat_ws("\n", "n_name", F.lit("aux é"), "text").alias("t"))
    return extraction.vocabulary_entities(texts, terms)


PROPOSED = [(1, "Réseau", ["vpn", "wifi"], "le vpn est lent"), (2, "SAP", ["erp"], "rien"), (3, "Teams", ["visio", "réunion"], "Réunion Teams")]


@query(f"SELECT id, canonical, array_to_string(kept, '|') AS aliases FROM (SELECT id, canonical, t, list_filter(aliases, lambda x: contains(lower(t), lower(x))) AS kept FROM {planted_sql(PROPOSED, 'id int, canonical string, aliases array<string>, t string')}) WHERE len(kept) > 0 OR contains(lower(t), lower(canonical))")
def verified_alias_rows(spark, d):
    return extraction.verified_aliases(planted(spark, d, PROPOSED, "id int, canonical string, aliases array<string>, t string"))


SPANS = [(1, 0, 10, 5, 15), (2, 0, 10, 20, 30), (3, 0, 10, 0, 10), (4, 5, 5, 5, 5)]


@query(f"SELECT id, round(CASE WHEN greatest(a1, b1) - least(a0, b0) > 0 THEN greatest(0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) ELSE 0.0 END, 6) AS iou FROM {planted_sql(SPANS, 'id int, a0 int, a1 int, b0 int, b1 int')}")
def hull_iou(spark, d):
    r = planted(spark, d, SPANS, "id int, a0 int, a1 int, b0 int, b1 int")
    return r.select("id", F.round(segment.hull_overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")), 6).alias("iou"))


ARTICLE = "# Symptôme\nRien\n# Résolution\n1. Cliquez ici\n   - Vérifiez le nom\n2. Si erreur, passez à l'étape 1\n# Si le problème persiste\n- Redémarrez"
STEPS = [(1, "Cliquez ici", "action", 0, -1), (2, "Vérifiez le nom", "check", 1, -1), (3, "Si erreur, passez à l'étape 1", "action", 0, 1), (4, "Redémarrez", "action", 0, -1)]


@query(f"SELECT doc_id AS id, n, step, kind, level, goto FROM documents, {values(STEPS, 'n int, step string, kind string, level int, goto int')}")
def article_steps(spark, d):
    """The article behind each document's own lines, without marks of lists and headings."""
    own = F.regexp_replace(F.regexp_replace("text", r"(?m)^.{0,80}$", "x"), r"(?m)^[^A-Za-z]+", "x")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("# Contexte\n"), own, F.lit("\n"), F.lit(ARTICLE)).alias("t"))
    return rows.select("id", F.explode(segment.steps_udf("t")).alias("s")).select("id", "s.n", F.col("s.text").alias("step"), "s.kind", "s.level", F.coalesce("s.goto", F.lit(-1)).alias("goto"))


@query("SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.parse_url("url", F.lit("PROTOCOL"))).alias("scheme"), F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"))


NAMES_SQL = """SELECT doc_id, source || CASE doc_id % 6 WHEN 0 THEN '/x.MP4' WHEN 1 THEN '/y.' || doc_id || '.wav' WHEN 2 THEN '/z' || doc_id || '.pdf' WHEN 3 THEN '/' WHEN 4 THEN '/x' || doc_id || '.mp4' ELSE '/w' || doc_id || '.mp3' END AS name FROM documents"""


@query(f"WITH f AS ({NAMES_SQL}) SELECT name, CASE WHEN e IN ('mp3', 'wav', 'm4a') THEN 'audio' WHEN e IN ('mp4', 'mov', 'avi') THEN 'video' ELSE 'other' END AS kind FROM (SELECT name, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS e FROM f WHERE NOT ends_with(name, '/')) WHERE name NOT IN (SELECT name FROM f WHERE doc_id % 4 = 0)")
def copy_routes(spark, d):
    i, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    ends = F.when(i == 0, "/x.MP4").when(i == 1, F.concat(F.lit("/y."), n, F.lit(".wav"))).when(i == 2, F.concat(F.lit("/z"), n, F.lit(".pdf"))).when(i == 3, "/").when(i == 4, F.concat(F.lit("/x"), n, F.lit(".mp4"))).otherwise(F.concat(F.lit("/w"), n, F.lit(".mp3")))
    files = table(spark, d, "documents").select("doc_id", F.concat("source", ends).alias("name"))
    return extraction.copy_routes(files, files.where("doc_id % 4 = 0").select("name"))
