"""Small reports: what an answer rests on, what an enrichment gave, how articles are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwright.operators.graph import NUMBER

MEDIA = ["audio", "video"]


def modality_sentence(primary: Column, calls: Column, documents: Column) -> Column:
    """What an answer rests on, in a sentence: the kind of its primary source (null: there is none), and how many calls and other
    documents are related."""
    many = lambda n: F.when(n > 1, "s").otherwise("")
    base = F.when(primary.isin(MEDIA), "Basé sur un appel support").otherwise("Basé sur un document KB")
    said = F.concat_ws(
        " · ", base, F.when(calls > 0, F.concat(F.lit("corroboré par "), calls.cast("string"), F.lit(" appel"), many(calls))),
        F.when(documents > 0, F.concat(documents.cast("string"), F.lit(" document"), many(documents), F.lit(" KB en complément"))),
    )
    return F.when(primary.isNull(), "").otherwise(said)


def modality_summary(sources: DataFrame) -> DataFrame:
    """sources: query, primary (whether it is the primary one), kind.  query, said."""
    media = F.col("kind").isin(MEDIA)
    related = lambda c: F.count(F.when(~F.col("primary") & c, 1))
    told = sources.groupBy("query").agg(F.min(F.when(F.col("primary"), F.col("kind"))).alias("first"), related(media).alias("calls"), related(~media).alias("documents"))
    return told.select("query", modality_sentence(F.col("first"), F.col("calls"), F.col("documents")).alias("said"))


def enrichment_stats(enrichments: DataFrame) -> DataFrame:
    """enrichments: fiche_id, error, canonical_intent, primary_app, app_inferred, aliases_fr, aliases_en, dropped.  One row of
    counts; an empty error, intent or application counts as none."""
    some = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1))
    held = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0))
    return enrichments.agg(
        F.count("*").alias("fiches"), some("error").alias("errors"), some("canonical_intent").alias("with_intent"), some("primary_app").alias("with_primary_app"),
        F.count(F.when(F.col("app_inferred"), 1)).alias("app_inferred"), (held("aliases_fr") + held("aliases_en")).alias("aliases"), held("dropped").alias("dropped"),
    )


def map_labels(fiches: DataFrame) -> DataFrame:
    """fiches: fiche_id, title, source.  fiche_id, label, names: how an article is named, and its document name, id and own title
    (each once, by lines), by which it is found.

    A title that several articles have is the heading of a template and none of its own.  The label is the document's name if
    that says more than a number, else the id with the own title unless the id holds it, else the id.
    """
    alone = fiches.where("title <> ''").groupBy("title").agg(F.count("*").alias("n")).where("n = 1").select("title", F.lit(True).alias("own"))
    name = F.regexp_extract(F.replace(F.coalesce("source", F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    told = fiches.join(alone, "title", "left").select("fiche_id", F.when(F.col("own"), F.col("title")).alias("own"), stem.alias("stem"))
    says_more = F.regexp_replace("stem", NUMBER, " ").rlike(r"\p{L}{3,}")
    label = F.when(says_more, F.col("stem")).when(F.col("own").isNotNull() & ~F.contains("fiche_id", "own"), F.concat_ws(" – ", "fiche_id", "own")).otherwise(F.col("fiche_id"))
    lines = F.filter(F.array_distinct(F.array(F.col("stem"), F.col("fiche_id"), F.coalesce("own", F.lit("")))), lambda x: x != "")
    return told.select("fiche_id", label.alias("label"), F.array_join(lines, "\n").alias("names"))
