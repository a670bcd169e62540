"""Joins of spans of texts: (doc, start, end), end exclusive, in code points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions.segment import hull_overlap

BIN = 256  # code points


def _binned(spans: DataFrame, width: int) -> DataFrame:
    covers = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    return spans.where("end > start").withColumn("bin", F.explode(covers))


def overlapping(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of a left and a right span of one document that share a character: doc, left, right (their whole rows).

    Spans meet in the bins of `width` characters that both cover, so a document of many spans is dealt out by bins, and the work
    is that of neighbours and not of all pairs of a document.  A pair is told once, in the first bin that both cover.  Empty
    spans, and null documents, meet nothing.
    """
    a = _binned(left, width).select("doc", "bin", F.struct(*left.columns).alias("left"))
    b = _binned(right, width).select("doc", "bin", F.struct(*right.columns).alias("right"))
    met = a.join(b, ["doc", "bin"])
    first = F.greatest(F.floor(F.col("left.start") / width), F.floor(F.col("right.start") / width))
    return met.where((F.col("left.start") < F.col("right.end")) & (F.col("right.start") < F.col("left.end")) & (F.col("bin") == first)).select("doc", "left", "right")


def matched(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """doc, left_start, right_start: spans paired one to one that share `least` of their hull or more.

    The spans of each side must be disjoint.  Then two spans share half of one's hull only as its halves, so the best partner of
    each side settles the pairs; of equal ones the later is taken.
    """
    share = hull_overlap(F.col("left.start"), F.col("left.end"), F.col("right.start"), F.col("right.end"))
    pairs = overlapping(left.select("doc", "start", "end"), right.select("doc", "start", "end")).select("doc", F.col("left.start").alias("left_start"), F.col("right.start").alias("right_start"), share.alias("share"))
    best = lambda side, other: F.row_number().over(Window.partitionBy("doc", side).orderBy(F.desc("share"), F.desc(other)))
    told = pairs.where(F.col("share") >= least).withColumn("of_left", best("left_start", "right_start")).withColumn("of_right", best("right_start", "left_start"))
    return told.where("of_left = 1 AND of_right = 1").select("doc", "left_start", "right_start")
