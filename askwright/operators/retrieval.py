"""Chunks, documents and conversations around an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_chunks(docs: DataFrame, id_col: str, text: Column, size: int = 2000, overlap: int = 500) -> DataFrame:
    """(doc, n, chunk): pages of `size` characters that overlap."""
    step = size - overlap
    pages = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0)))
    return docs.select(F.col(id_col).alias("doc"), text.alias("t"), F.explode(pages).alias("n")).select("doc", "n", F.substring(F.col("t"), F.col("n") * step + 1, F.lit(size)).alias("chunk"))


def collapse_chunks(scored: DataFrame) -> DataFrame:
    """query, doc, n, score: the best chunk of each document."""
    best = scored.groupBy("query", "doc").agg(F.max(F.struct("score", (-F.col("n")).alias("n"))).alias("m"))
    return best.select("query", "doc", F.col("m.score").alias("score"), (-F.col("m.n")).alias("n"))


def expand(chunks: DataFrame, wanted: DataFrame, most: int = 20_000) -> DataFrame:
    """Whole documents of a key list, chunks in order, cut."""
    back = chunks.join(wanted, "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "chunk"))).alias("l"))
    return back.select("doc", F.array_join(F.transform("l", lambda x: x["chunk"]), "\n").substr(1, most).alias("text"))


def modality_split(ranked: DataFrame, primaries: int, annexes: int) -> DataFrame:
    """ranked: query, doc, modality, score.  Primaries come from text; annexes from media first, then text; no document twice."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    first = ranked.where("modality = 'text'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= primaries).withColumn("part", F.lit("primary"))
    rest = ranked.join(first.select("query", "doc"), ["query", "doc"], "left_anti")
    order = Window.partitionBy("query").orderBy((F.col("modality") == "text").cast("int"), F.desc("score"), "doc")
    second = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= annexes).withColumn("part", F.lit("annex"))
    return first.unionByName(second)


def merge_sources(rows: DataFrame) -> DataFrame:
    """title, used, summary, ord: one source a title; used if any is; the first summary that is there."""
    return rows.groupBy("title").agg(F.max("used").alias("used"), F.min_by("summary", F.when(F.col("summary").isNotNull(), F.col("ord"))).alias("summary"))


def facets(rows: DataFrame, value: Column, top: int = 1000) -> DataFrame:
    return rows.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def turn_context(turns: DataFrame, back: int = 2) -> DataFrame:
    """conv_id, turn, text: the text of each turn after those of the `back` turns before."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, 0)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " ").alias("context"))


def synonym_groups(rows: DataFrame) -> DataFrame:
    """canonical, alias: groups by lower-cased canonical name, of two or more names."""
    both = rows.select(F.lower("canonical").alias("g"), F.lower("canonical").alias("x")).unionByName(rows.select(F.lower("canonical").alias("g"), F.lower("alias").alias("x")))
    return both.groupBy("g").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("names"), F.countDistinct("x").alias("n")).where("n >= 2").select("g", "names")
