"""Calibration of the semantic decision: grids of thresholds, recall, leave one out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwright.operators.graph import written


def exam(ranked: DataFrame) -> DataFrame:
    """ranked: query, own, fiche, score, rank.  One row a question: own, first two scores, first fiche."""
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return ranked.groupBy("query").agg(F.max("own").alias("own"), at(1, "score").alias("s1"), at(2, "score").alias("s2"), at(1, "fiche").alias("f1"))


NEVER, MARGIN, OFFER = 1.01, 0.05, 0.35  # an uncalibrated index shows nothing on its score
MARGINS = 60  # of 0.005


def offer_level(ranked: DataFrame, reach: float = 0.95, choices: int = 3) -> DataFrame:
    """One row: the score that the first candidate of so many reachable questions has, rounded down to three decimals."""
    own = ranked.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.min(F.when(F.col("fiche") == F.col("own"), F.col("rank"))).alias("at"))
    level = F.percentile(F.when(F.col("at") <= choices, F.col("s1")), F.lit(1 - reach))
    return own.agg(F.coalesce(F.floor(level * 1000) / 1000, F.lit(OFFER)).alias("offer"))


def measure_grid(ranked: DataFrame) -> DataFrame:
    """Right and wrong answers shown at each floor (a first candidate's score of at least the offer level) and each margin of
    0.005 to 0.300, and, of questions ranked without their own fiche, how many are shown all the same.

    A pair of floor and margin shows a question whose first score reaches the floor and whose lead reaches the margin: sums
    over both, not a product of questions and pairs.  The grid has sixty margins for each floor, whatever the number of floors.
    """
    ranked = written(ranked.select("query", "own", "fiche", "score", "rank"), "ranked")  # read five times
    offer = offer_level(ranked)
    rows = exam(ranked)
    others = ranked.where("fiche <> own").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "fiche")))
    lead = F.when(F.col("s2").isNull(), MARGINS).otherwise(F.when(F.round(F.col("s1") - F.col("s2"), 6) > 0, F.floor(F.round((F.col("s1") - F.col("s2")) * 200, 6))).otherwise(0))
    step = F.least(F.lit(MARGINS), lead).cast("int")  # the highest margin that the lead reaches
    said = rows.select("s1", step.alias("m"), F.when(F.col("f1") == F.col("own"), "right").otherwise("wrong").alias("kind"))
    loo = exam(others).select("s1", step.alias("m"), F.lit("loo").alias("kind"))
    seen = said.unionByName(loo).where("s1 is not null and m >= 1").groupBy("s1", "m").pivot("kind", ["right", "wrong", "loo"]).count().na.fill(0)
    floors = rows.crossJoin(offer).where("s1 >= offer").select(F.col("s1").alias("floor"), "offer").distinct()  # offer is one row
    margins = ranked.sparkSession.range(1, MARGINS + 1).select(F.col("id").cast("int").alias("m"))
    # a score that is no floor counts at the highest floor below it
    merged = floors.select(F.col("floor").alias("s1"), "offer").crossJoin(F.broadcast(margins)).join(seen, ["s1", "m"], "full_outer").na.fill(0, ["right", "wrong", "loo"])
    by_floor = Window.partitionBy("m").orderBy(F.desc("s1"))
    down = merged.select("s1", "m", "offer", *[F.sum(c).over(by_floor).alias(c) for c in ("right", "wrong", "loo")])
    by_margin = Window.partitionBy("s1").orderBy(F.desc("m"))
    both = down.where("offer is not null").select("s1", "m", "offer", *[F.sum(c).over(by_margin).alias(c) for c in ("right", "wrong", "loo")])
    totals = rows.agg(F.count("*").alias("n")).crossJoin(exam(others).agg(F.count("*").alias("loo_n")))
    return both.crossJoin(totals).select(F.col("s1").alias("floor"), F.round(F.col("m") * 0.005, 6).alias("margin"), "offer", "n", "loo_n", F.col("right").alias("right_shown"), F.col("wrong").alias("wrong_shown"), F.col("loo").alias("loo_shown"))


def choose_grid(grid: DataFrame, most_wrong: float = 0.03, most_loo: float = 0.10) -> DataFrame:
    """The pair within both bounds (the upper Wilson bound of the wrong share, and the share shown without a right answer) that
    shows most right ones, then fewest wrong ones, then has the highest floor and margin.  No row if no pair is within them."""
    from askwright.functions import stats

    allowed = grid.where((stats.wilson(F.col("wrong_shown"), F.col("n"), True) <= most_wrong) & ((F.col("loo_n") == 0) | (F.col("loo_shown") <= most_loo * F.col("loo_n"))))
    best = allowed.agg(F.max(F.struct("right_shown", (-F.col("wrong_shown")).alias("w"), "floor", "margin", "offer", "n", "loo_shown")).alias("m")).where("m is not null")
    return best.select("m.floor", "m.margin", "m.offer", "m.n", "m.right_shown", (-F.col("m.w")).alias("wrong_shown"), "m.loo_shown")


def recall(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Own entries found: questions whose own fiche is among the first k."""
    own = ranked.groupBy("query").agg(F.min(F.when(F.col("fiche") == F.col("own"), F.col("rank"))).alias("at"))
    return own.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "at").groupBy("k").agg(F.count("*").alias("n"), F.count(F.when(F.col("at") <= F.col("k"), 1)).alias("hits"))


def leave_one_out(ranked: DataFrame, floor: float, margin: float) -> DataFrame:
    others = ranked.where("fiche <> own").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "fiche")))
    rows = exam(others)
    return rows.agg(F.count("*").alias("n"), F.count(F.when((F.col("s1") >= floor) & (F.round(F.col("s1") - F.col("s2"), 6) >= margin), 1)).alias("shown"))
