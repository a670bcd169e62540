"""Corpus profiling: headings, boilerplate, styles, dictionary candidates, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwright.functions.text import body_chars, exclusion_form, loose_key, opens_with_verb, plain
from askwright.operators.graph import written

#: Fixed value: what a line that opens with a verb may speak of and still be boilerplate.
NOTICE = (
    r"(?i)(contact|support|assistance|hotline|service desk|©|copyright|confidentiel|tous droits|mentions l[ée]gales|"
    r"r[ée]dig[ée] par|auteur|derni[eè]re mise [àa] jour|mis [àa] jour le|version du document|ne pas diffuser)"
)
LIST_ITEM = r"^\s*(?:\d{1,2}[.)]|[a-zA-Z][.)]|[-*•–·▪●◦➢➤►])\s"




def lines(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(doc, pos, line)."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def boilerplate(docs: DataFrame, id_col: str, text: Column, share: float = 0.3, least: int = 3) -> DataFrame:
    """Normalised lines of 20 characters or more, no list items and no instructions, that max(least, share of all) documents hold.
    A line that opens with a verb of action is an instruction, unless it speaks of contacts, rights or versions."""
    floor = F.lit(max(float(least), share * docs.count()))
    keyed = lines(docs, id_col, text).where(~F.col("line").rlike(LIST_ITEM)).select("doc", "line", plain(F.col("line")).alias("key")).where(F.length("key") >= 20)
    # whether a line is an instruction is only asked of lines that are frequent enough
    frequent = written(keyed.select("doc", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= floor).select("key"), "frequent-lines")
    instruction = opens_with_verb(F.col("line")) & ~F.col("line").rlike(NOTICE)
    held = keyed.join(frequent, "key", "left_semi").where(~instruction).select("doc", F.col("key").alias("line")).distinct()
    return held.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= floor)


def remove_boilerplate(docs: DataFrame, id_col: str, text_col: str, banned: DataFrame) -> DataFrame:
    """One row per row of docs: doc, text without the banned lines and with blank runs as one, and how many lines went.

    Lines meet the banned ones by their key; Spark broadcasts these where it knows them to be few, and splits the hottest lines
    where not.  A row is put together again by a number of its own, so rows of one id stay apart.  A null text stays null.
    """
    tidy = lambda kept: F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    numbered = docs.select(F.col(id_col).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    rows = numbered.select("doc", "row", F.posexplode_outer(F.split("t", "\n")).alias("pos", "line")).withColumn("key", plain(F.col("line")))
    marked = rows.join(banned.select(F.col("line").alias("key"), F.lit(1).alias("gone")).distinct(), "key", "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull() & F.col("line").isNotNull(), F.struct("pos", "line"))))
    back = marked.groupBy("row", "doc").agg(kept.alias("l"), F.count("gone").alias("removed"), F.count("line").alias("n"))
    return back.select("doc", F.when(F.col("n") > 0, tidy(F.transform("l", lambda x: x["line"]))).alias("text"), "removed")


def style(text: Column) -> Column:
    """Numbered, bulleted or prose, by a document's own lines."""
    each = F.split(text, "\n")
    return F.when(F.exists(each, lambda x: x.rlike(r"^\s*\d{1,2}[.)]\s")), "numbered").when(F.exists(each, lambda x: x.rlike(r"^\s*[-*•–·▪●◦➢➤►]\s")), "bulleted").otherwise("prose")


def frequent_keys(keys: DataFrame, share: float = 0.1, least: int = 2) -> DataFrame:
    """keys: doc, key.  Keys (headings) of max(least, share) documents."""
    total = keys.select("doc").distinct().count()
    return keys.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(max(float(least), share * total)))


def half_stability(keys: DataFrame, half: Column) -> DataFrame:
    """Jaccard of the frequent keys of two halves of the corpus."""
    tagged = keys.withColumn("half", half).distinct()
    totals = tagged.groupBy("half").agg(F.countDistinct("doc").alias("total"))
    often = tagged.groupBy("half", "key").agg(F.count("*").alias("n")).join(F.broadcast(totals), "half").where(F.col("n") >= F.greatest(F.lit(2.0), 0.1 * F.col("total")))
    sides = often.groupBy("key").agg(F.countDistinct("half").alias("sides"))
    return sides.agg(F.count(F.when(F.col("sides") == 2, 1)).alias("both"), F.count("*").alias("either")).withColumn("jaccard", F.when(F.col("either") > 0, F.round(F.col("both") / F.col("either"), 6)).otherwise(1.0))


def name_candidates(docs: DataFrame, id_col: str, name: Column, text: Column, share: float = 0.8, top: int = 150) -> DataFrame:
    """Words of document names, in 2 to max(10, half) documents, written with a capital in most places of the corpus."""
    total = docs.count()
    names = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[a-z]{3,}"), 0))).alias("word"))
    in_names = names.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n").between(2, max(10, total // 2)))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]{3,}\b"), 0)).alias("w"))
    cased = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("seen"), F.count(F.when(F.col("w").rlike("^[A-Z]"), 1)).alias("capital"))
    good = in_names.join(cased, "word").where(F.col("capital") >= share * F.col("seen"))
    return good.select("word", "n", F.round(F.col("capital") / F.col("seen"), 6).alias("share")).orderBy(F.desc("n"), "word").limit(top)


def excluded(fiches: DataFrame, patterns: list[str], least: int = 40) -> DataFrame:
    """fiches: fiche_id, title, stem, text, n_steps.  rule: title_pattern (with the first pattern), empty, or null to keep."""
    names = F.concat(exclusion_form(F.col("title")), exclusion_form(F.col("stem")))
    hit = F.lit(None).cast("string")
    for p in reversed(patterns):
        hit = F.when(F.contains(names, exclusion_form(F.lit(p))), F.lit(p)).otherwise(hit)
    chars = body_chars(F.col("text"), F.col("title"))
    rows = fiches.withColumn("pattern", hit).withColumn("chars", chars)
    return rows.withColumn("rule", F.when(F.col("pattern").isNotNull(), "title_pattern").when((F.col("n_steps") == 0) & (F.col("chars") < least), "empty"))


def force_include(wanted: DataFrame, fiches: DataFrame) -> DataFrame:
    """wanted: entry.  The fiche that an entry names: exactly, else as the only one with its loose key; else null."""
    keyed = fiches.select("fiche_id", loose_key(F.col("fiche_id")).alias("k"))
    unique = keyed.groupBy("k").agg(F.min("fiche_id").alias("loose"), F.count("*").alias("n")).where("n = 1")
    exact = wanted.join(fiches.select(F.col("fiche_id").alias("exact")), wanted["entry"] == F.col("exact"), "left")
    return exact.withColumn("k", loose_key(F.col("entry"))).join(unique, "k", "left").select("entry", F.coalesce("exact", "loose").alias("fiche_id"))


def ready_for_review(terms: DataFrame, least: int = 3) -> DataFrame:
    return terms.where((F.col("status") == "pending") & (F.col("seen") >= least)).orderBy(F.desc("seen"), "term")


def merge_accepted(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rejection wins."""
    return accepted.distinct().join(rejected, "term", "left_anti")


#: Words that announce a product's name, names that are none, and what is no prose.
TRIGGERS = ["application", "applicatif", "logiciel", "outil", "erp", "progiciel", "systeme", "système", "plateforme", "interface", "portail", "module", "solution", "service"]
NO_NAMES = ["windows", "microsoft", "office", "outlook", "teams", "word", "excel", "powerpoint", "onedrive", "sharepoint", "exchange", "edge", "chrome", "firefox", "citrix", "vpn", "wifi", "active", "directory"]
LINK_OR_PATH = r"(?iU)\bhttps?://\S+|\bwww\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+|\\\\\S+|\b[a-z]:\\\S*|%\w+%\S*"


def dictionary_candidates(text: Column) -> Column:
    """Capitalised names after a word that announces one; each once."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\b(?i:" + "|".join(TRIGGERS) + r")\s+([A-Z][\w&-]{1,24}(?:\s+(?:[A-Z][\w&-]{1,24}|&|et|and))*)"), 1)
    names = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(names, lambda x: ~F.lower(x).isin(NO_NAMES) & (F.length(x) > 1)))


def capitalized_shares(docs: DataFrame, text: Column) -> DataFrame:
    """(word, seen, share): of each word's places outside links, addresses and paths, how many begin with a capital."""
    words = docs.select(F.explode(F.regexp_extract_all(F.regexp_replace(text, LINK_OR_PATH, " "), F.lit(r"(?U)(?<![\w.-])[\p{L}][\w&]*(?![\w-])"), 0)).alias("w"))
    per = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("seen"), F.count(F.when(F.col("w").rlike(r"^\p{Lu}"), 1)).alias("capital"))
    return per.select("word", "seen", (F.col("capital") / F.col("seen")).alias("share"))


def verified_aliases(proposed: DataFrame, frequency: DataFrame, rejected: DataFrame, least: int = 2) -> DataFrame:
    """proposed: term, alias; frequency: alias, n (documents).  Aliases that enough documents hold; a rejected term is never proposed."""
    return proposed.join(frequency.where(F.col("n") >= least), "alias").join(rejected, "term", "left_anti").select("term", "alias", "n")


def exclusion_stats(ruled: DataFrame, forced: DataFrame) -> DataFrame:
    """ruled: fiche_id, rule (null: kept); forced: fiche_id.  How many are kept, excluded by each rule, and kept by force."""
    marked = ruled.join(forced.select("fiche_id", F.lit(True).alias("f")).distinct(), "fiche_id", "left")
    return marked.groupBy(F.when(F.col("rule").isNull(), "kept").when(F.col("f"), "forced").otherwise(F.col("rule")).alias("outcome")).agg(F.count("*").alias("n"))


def candidate_terms(text: Column, known: list[str], most_words: int = 3, most_chars: int = 40) -> Column:
    """Short product-like names of a question that the dictionary does not know."""
    return F.filter(dictionary_candidates(text), lambda x: ~F.lower(x).isin(known or [""]) & (F.length(x) <= most_chars) & (F.size(F.split(x, " ")) <= most_words))
