"""Queries on text functions, masking, keys and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from askwright.functions import masking as m
from askwright.functions import stats
from askwright.functions import text as t
from askwright.plans.base import planted, planted_sql, query, table, values
from askwright.plans.rank import FOLD, tokens

ROUTE_STOP = ", ".join(f"'{w}'" for w in sorted(set(t.ROUTE_STOP)))
_LIG = "{0}"
for _a, _b in t.LIGATURES.items():
    _LIG = f"replace({_LIG}, '{_a}', '{_b}')"
ROUTE_FOLD = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(" + _LIG + r")), '\b(?:can[''’]t|cannot)\b', 'can not', 'g'),"
    r" '\bwon[''’]t\b', 'will not', 'g'), '\bshan[''’]t\b', 'shall not', 'g'), '\b(\w+)n[''’]t\b', '\1 not', 'g')"
)


def fold_token(x: str) -> str:
    s = f"(CASE WHEN length({x}) >= 4 AND ends_with({x}, 's') AND NOT regexp_matches({x}, '(ss|us|is)$') THEN left({x}, length({x}) - 1) ELSE {x} END)"
    return f"(CASE WHEN regexp_full_match({x}, '[0-9]+') THEN {x} WHEN length({s}) >= 4 AND ends_with({s}, 'ee') THEN left({s}, length({s}) - 1) ELSE {s} END)"


def route_list(col: str) -> str:
    kept = f"list_filter(regexp_extract_all({ROUTE_FOLD.format(col)}, '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({ROUTE_STOP}))"
    return f"list_filter(list_transform({kept}, lambda x: {fold_token('x')}), lambda x: length(x) > 1 AND x NOT IN ({ROUTE_STOP}))"


@query(f"SELECT doc_id, CAST(len({tokens('text')}) AS INTEGER) AS n_tokens, array_to_string(list_sort(list_distinct({tokens('text')}))[1:12], ' ') AS first_terms FROM documents")
def search_tokens(spark, d):
    tok = t.tokenize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tok).alias("n_tokens"), F.array_join(F.slice(F.array_sort(F.array_distinct(tok)), 1, 12), " ").alias("first_terms"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({route_list('text')})), ' ') AS token_key, CAST(len(list_distinct({route_list('text')})) AS INTEGER) AS n FROM documents")
def route_token_key(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(t.token_key(text), " ").alias("token_key"), F.size(t.route_tokens(text)).alias("n"))


@query(f"SELECT word, {fold_token('word')} AS folded FROM (SELECT DISTINCT unnest(flatten(list_transform({tokens('text')}, lambda w: [w, w || 's']))) AS word FROM documents)")
def fold_tokens(spark, d):
    """Every token of the documents, and its plural."""
    word = F.explode(F.flatten(F.transform(t.tokenize(F.col("text")), lambda w: F.array(w, F.concat(w, F.lit("s"))))))
    return table(spark, d, "documents").select(word.alias("word")).distinct().select("word", t.fold_token(F.col("word")).alias("folded"))


PHONE_SQL = r"(?:(?:\+|00)[0-9]{2,3}[\s.-]?(?:\(0\)[\s.-]?)?|0)[1-9](?:[\s.-]?[0-9]{2}){4}"


@query(rf"""WITH m AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')) AS INTEGER) AS n_email, regexp_replace(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', '[email]', 'g') AS masked FROM documents)
SELECT doc_id, n_email, CAST(len(regexp_extract_all(masked, '(?:^|[^\p{{L}}\p{{N}}_+]){PHONE_SQL}(?:$|[^\p{{L}}\p{{N}}_])')) AS INTEGER) AS n_phone, sha256(masked) AS masked_sha FROM m""")
def mask_counts(spark, d):
    counts = m.scrub_counts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", counts["[email]"].alias("n_email"), counts["[phone]"].alias("n_phone"), F.sha2(F.regexp_replace("text", m.EMAIL, "[email]"), 256).alias("masked_sha"))


SENSITIVE = [
    (1, "majuscule A, minuscule b, chiffre 1"), (2, "code 1 2 3 4 5 6"), (3, "Mot de passe : azerty12"), (4, "rien à voir"), (5, "password=Hunter2 puis pwd: x"),
    (6, "lettre par lettre s'il vous plaît. Épelle. Voici: 4, 5, 6, 7, 8."), (7, "minuscule seul"), (8, "12 34 56"),
]
SPELLED_SQL = r"(?i)\b(minuscule|majuscule|en capitale|j''epelle|je vous epelle|epelle|lettre par lettre|chiffre par chiffre|comme dans le mot)\b"


@query(rf"SELECT id, len(regexp_extract_all(strip_accents(s), '{SPELLED_SQL}')) >= 2 OR regexp_matches(s, '(?:\b\d\b[\s,.-]+){{4,}}\d\b') AS sensitive, regexp_replace(s, '(?i)(mot de passe|password|passwd|pwd|mdp)\s*[:=]\s*\S+', '\1: [REDACTED]', 'g') AS redacted FROM {planted_sql(SENSITIVE, 'id int, s string')}")
def sensitive_flags(spark, d):
    return planted(spark, d, SENSITIVE, "id int, s string").select("id", m.looks_sensitive(F.col("s")).alias("sensitive"), m.redact_secrets(F.col("s")).alias("redacted"))


@query("""SELECT role, conv_id, turn, trim(regexp_replace(regexp_replace(text, '\\[(?:email|phone|nom|mention|masqué|masked)\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS readable FROM conversations WHERE role = 'user'""")
def ticket_text(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("role", "conv_id", "turn", m.readable(F.col("text")).alias("readable"))


@query("""SELECT lang, profile, calibration, scoreboard, count(*) AS n FROM (SELECT lang,
 CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 2, 1))::INTEGER % 2 AS VARCHAR) AS profile,
 CASE WHEN ('0x' || right(sha256(CAST(doc_id AS VARCHAR)), 1))::INTEGER % 2 = 0 THEN 'calibration' ELSE 'test' END AS calibration,
 CASE WHEN ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 8, 1))::INTEGER % 2 = 0 THEN 'A' ELSE 'B' END AS scoreboard FROM documents) GROUP BY ALL""")
def split_halves(spark, d):
    rules = ["profile", "calibration", "scoreboard"]
    return table(spark, d, "documents").select("lang", *[t.split_half(F.col("doc_id"), r).alias(r) for r in rules]).groupBy("lang", *rules).agg(F.count("*").alias("n"))


@query("SELECT text_sha256, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(text) AS text_sha256 FROM documents) GROUP BY 1 HAVING count(*) > 1")
def content_hash_dupes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256")).groupBy("text_sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, substr(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32) AS row_key, substr(sha256(text), 1, 24) AS ref_id, row_number() OVER (PARTITION BY source ORDER BY sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS pos FROM documents")
def hash_keys(spark, d):
    from pyspark.sql import Window

    key = F.concat("source", F.lit("\0"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", t.digest(key, 32).alias("row_key"), t.digest(F.col("text"), 24).alias("ref_id"), F.row_number().over(Window.partitionBy("source").orderBy(F.sha2(key, 256), "doc_id")).cast("long").alias("pos"))


NAMES = [
    ("a/b/KB0012345 - Reset.docx", "Réinitialiser le mot de passe!", "Bloqué"), ("Guide VPN.pdf", "connexion vpn", "ab"), ("kb893803.txt", "1 étape", "Ouvrir - Session"),
    ("x\\y\\notes", "Où est-ce ?", "Ça"), ("readme.MD", "Œuvre à faire", "Déjà-vu 2"), ("KB12.html", "__init__", "9 lives"),
]


@query(rf"""SELECT id, path, CASE WHEN regexp_extract(p, '(?i)(KB[0-9]{{5,}})', 1) <> '' THEN upper(regexp_extract(p, '(?i)(KB[0-9]{{5,}})', 1)) ELSE regexp_replace(p, '(?i)\.(md|markdown|txt|html|htm|docx|pdf)$', '') END AS fiche_id,
 CASE WHEN regexp_full_match(i, '[A-Z][A-Z0-9_]{{2,63}}') THEN i END AS intent, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'c_' || s ELSE s END AS slug, lower(trim(regexp_replace(strip_accents(name), '\s+', ' ', 'g'))) AS entity,
 ' ' || trim(regexp_replace(upper(strip_accents(title)), '[^A-Z0-9]+', ' ', 'g')) || ' ' AS padded
 FROM (SELECT *, list_last(regexp_split_to_array(path, '[/\\]')) AS p, regexp_replace(regexp_replace(upper(strip_accents(title)), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS i,
 regexp_replace(regexp_replace({FOLD.format('name')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM {planted_sql([(i, *r) for i, r in enumerate(NAMES, 1)], 'id int, path string, title string, name string')})""")
def identifiers(spark, d):
    rows = planted(spark, d, [(i, *r) for i, r in enumerate(NAMES, 1)], "id int, path string, title string, name string")
    return rows.select(
        "id", "path", t.fiche_id_for(F.col("path")).alias("fiche_id"), t.canonical_intent(F.col("title")).alias("intent"), t.slug(F.col("name")).alias("slug"), t.entity_form(F.col("name")).alias("entity"), t.exclusion_form(F.col("title")).alias("padded")
    )


@query(r"""SELECT doc_id, CASE WHEN q = '' THEN '*' ELSE q END AS clean FROM (SELECT doc_id, CASE WHEN length(c) <= 1000 THEN c WHEN contains(left(c, 1000), ' ') THEN regexp_replace(left(c, 1000), ' [^ ]*$', '') ELSE left(c, 1000) END AS q
 FROM (SELECT doc_id, trim(regexp_replace(translate(text, '+-|"*()~\', '         '), '\s+', ' ', 'g')) AS c FROM documents))""")
def sanitized_queries(spark, d):
    return table(spark, d, "documents").select("doc_id", t.sanitize_query(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(CASE WHEN length(h) > 0 AND instr(b, h) > 0 THEN left(b, instr(b, h) - 1) || ' ' || substr(b, instr(b, h) + length(h)) ELSE b END, '\s+', '', 'g'), '^#+', '')) AS body_chars
 FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS h FROM documents)""")
def body_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", t.body_chars(F.col("text"), F.substring_index("text", "\n", 1)).cast("long").alias("body_chars"))


SCORES = [(1, 2.5), (2, 1.5), (3, 1.49), (4, None), (5, 4.0), (6, 0.0)]


@query(f"SELECT id, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 2.5 THEN 'high' WHEN score >= 1.5 THEN 'medium' ELSE 'low' END AS confidence FROM {planted_sql(SCORES, 'id int, score double')}")
def confidence_buckets(spark, d):
    return planted(spark, d, SCORES, "id int, score double").select("id", t.confidence(F.col("score")).alias("confidence"))


LABELS = [(1, None), (2, ""), (3, "none"), (4, "KB1|KB2| KB1 "), (5, "N/A"), (6, "KB3"), (7, " aucun "), (8, "||"), (9, "-")]


@query(f"""SELECT id, CASE WHEN raw IS NULL OR trim(raw) = '' THEN NULL WHEN lower(trim(raw)) IN ('none', 'aucune', 'aucun', 'no', '-', 'n/a', 'na') THEN '' ELSE array_to_string(l, '|') END AS expected,
 raw IS NOT NULL AND trim(raw) <> '' AS labelled FROM (SELECT *, (SELECT coalesce(list(x ORDER BY i), []) FROM (SELECT trim(x) AS x, min(i) AS i FROM (SELECT unnest(string_split(raw, '|')) AS x, generate_subscripts(string_split(raw, '|'), 1) AS i) GROUP BY trim(x)) WHERE x <> '') AS l
 FROM {planted_sql(LABELS, 'id int, raw string')})""")
def format_labels(spark, d):
    e = stats.expected_list(F.col("raw"))
    return planted(spark, d, LABELS, "id int, raw string").select("id", F.array_join(e, "|").alias("expected"), e.isNotNull().alias("labelled"))


CELLS = [(1, "a;b;c", ";"), (2, "a,b|c|d", "|"), (3, "x\ty", "\t"), (4, "plain", ","), (5, "a;b,c", ";")]


@query(f"SELECT doc_id AS id, delimiter FROM documents JOIN {values([(a, c) for a, _, c in CELLS], 'id int, delimiter string')} f ON f.id = 1 + doc_id % 5")
def guessed_delimiters(spark, d):
    from askwright.sources.tables import guess_delimiter_column

    return planted(spark, d, [(a, b) for a, b, _ in CELLS], "id int, line string").select("id", guess_delimiter_column(F.col("line")).alias("delimiter"))


@query("SELECT o_orderkey, replace(CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR, '.00', '') AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day, o_orderstatus || ' | ' || o_orderpriority AS cell FROM orders")
def cell_strings(spark, d):
    from askwright.sources.tables import cell_to_str

    o = table(spark, d, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select("o_orderkey", F.replace("price", F.lit(".00"), F.lit("")).alias("price"), cell_to_str(F.col("o_orderdate"), "timestamp").alias("day"), F.concat_ws(" | ", "o_orderstatus", "o_orderpriority").alias("cell"))
