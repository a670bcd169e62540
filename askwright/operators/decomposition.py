"""Decomposed articles: entity counts, verified steps, summaries, guides made from an article's own lines, cited steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions.text import collapse, guide_text

RESOLUTION_LIKE = ["resolution", "workaround", "unknown", "other"]
NUMBERED = r"(?i)^\s*(?:\d{1,2}\s*[.)]|[-•*]|(?:[ée]tape|step)\s*\d{1,2}\s*[:.\-]?)\s+(\S.*)$"
MOST_STEPS = 25


def entity_counts(entities: DataFrame) -> DataFrame:
    """entities: doc, canonical.  How often each document names each."""
    return entities.groupBy("doc", "canonical").agg(F.count("*").alias("n"))


def references(counts: DataFrame, own: DataFrame) -> DataFrame:
    """Article numbers a document names, its own (own: doc, number as 'kb:...') left out, sorted."""
    named = counts.where(F.col("canonical").startswith("kb:"))
    others = named.join(own.select("doc", F.col("number").alias("canonical")), ["doc", "canonical"], "left_anti")
    return others.groupBy("doc").agg(F.array_sort(F.collect_set("canonical")).alias("references"))


def verified(text: Column, start: Column, end: Column, step: Column) -> Column:
    """The span of the text is the step, letter for letter."""
    return text.substr(start + 1, end - start) == step


def step_checks(steps: DataFrame) -> DataFrame:
    """steps: doc, text, start, end, step.  Steps and verified steps of each document."""
    return steps.groupBy("doc").agg(F.count("*").alias("steps"), F.count(F.when(verified(F.col("text"), F.col("start"), F.col("end"), F.col("step")), 1)).alias("verified"))


def summarize_kb(docs: DataFrame) -> DataFrame:
    """docs: status, n_steps, verified, agreement.  One row: counts by status, sums, the mean agreement."""
    by = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return docs.agg(F.count("*").alias("fiches"), by("guided"), by("citable"), by("info_only"), F.sum("n_steps").alias("steps"), F.sum("verified").alias("verified"), F.round(F.avg("agreement"), 4).alias("agreement"))


def fallback_guide(chunks: DataFrame, doc_col: str, id_col: str, html: Column) -> DataFrame:
    """(doc, order, chunk, title, instruction): the numbered or bulleted lines of an article's chunks; without any its
    paragraphs of 25 characters or more; without these the first chunk.  25 steps at most."""
    rows = chunks.select(F.col(doc_col).alias("doc"), F.col(id_col).alias("chunk"), F.posexplode(F.split(guide_text(html), "\n")).alias("pos", "line"))
    item = F.regexp_extract("line", NUMBERED, 1)
    said = rows.withColumn("item", F.when(item != "", F.trim(item))).withColumn("whole", F.trim("line"))
    kinds = said.select(
        "doc", "chunk", "pos",
        F.when(F.col("item").isNotNull(), 1).when(F.length("whole") >= 25, 2).otherwise(3).alias("kind"),
        F.coalesce("item", "whole").alias("text"), (F.col("item").isNull() & (F.length("whole") >= 25)).alias("paragraph"),
    )
    best = kinds.withColumn("best", F.min("kind").over(Window.partitionBy("doc"))).where("kind = best")
    placed = best.withColumn("order", F.row_number().over(Window.partitionBy("doc").orderBy("chunk", "pos")))
    kept = placed.where((F.col("order") <= MOST_STEPS) & ((F.col("kind") < 3) | (F.col("order") == 1)))
    return kept.select("doc", "order", "chunk", F.regexp_replace(F.col("text").substr(1, 60), r"[ .,:;]+$", "").alias("title"), F.col("text").substr(1, 700).alias("instruction"))


def check_guide(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """steps: guide, order, chunk, instruction, verbatim; chunks: chunk, text.  (guide, ok, verbatim): a guide holds one to 25
    steps that say something and cite a chunk that is there; a step is verbatim only where its chunk has its words."""
    form = lambda c: F.lower(collapse(c))
    known = steps.join(chunks.select("chunk", F.col("text").alias("source")), "chunk", "left")
    good = known["source"].isNotNull() & (F.trim("instruction") != "")
    word_for_word = F.col("verbatim") & F.contains(form(F.col("source")), form(F.trim("instruction")))
    return known.groupBy("guide").agg(
        (F.min(good.cast("int")).cast("boolean") & F.count("*").between(1, MOST_STEPS)).alias("ok"), F.count(F.when(good & word_for_word, 1)).alias("verbatim")
    )


def cited_step(steps: DataFrame, citations: DataFrame) -> DataFrame:
    """steps: doc, n, text, role; citations: doc, citation.  The step whose text has the citation (from functions.quotes'
    rule), else the first one that resolves, else the first: doc, n, verified."""
    from askwright.functions.quotes import find_quote_udf

    rows = citations.join(steps, "doc")
    hit = find_quote_udf("text", "citation")["start"].isNotNull() & (F.trim("citation") != "")
    told = rows.withColumn("hit", hit).groupBy("doc", "citation").agg(
        F.min(F.when(F.col("hit"), F.col("n"))).alias("matched"), F.min(F.when(F.col("role").isin(RESOLUTION_LIKE), F.col("n"))).alias("resolving"), F.min("n").alias("first")
    )
    return told.select("doc", "citation", F.coalesce("matched", "resolving", "first").alias("n"), F.col("matched").isNotNull().alias("verified"))
