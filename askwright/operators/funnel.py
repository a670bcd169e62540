"""The semantic funnel: from a question's vector and the entities it names to one article, a question back, or nothing.

1. pool: the strong levels (answers given, cited numbers, error codes, updates) keep the articles that hold them; the least
   telling level is dropped until some article is left.  Duplicates and replaced articles give way to those that stand for them.
2. ranking: a question with a pool meets the entries of its pool only, as the pool is joined before any product of vectors;
   a question without one meets all entries, in blocks of
   questions; a task sends on its first articles only.
3. verdict: comparisons of the first two scores with calibrated thresholds.
4. a question back: the kind of entity that tells the close articles apart, else a choice of three at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.operators.decisions import discriminator, semantic_verdict, single_app_filter
from askwright.operators.graph import prune, written
from askwright.operators.ranking import best_entries, dot

STRONG_LEVELS = ["answered", "cited", "identifier", "update"]  # the most telling first
DESIGNATING = ["answered", "cited"]  # they name the article: no score is needed
ASKED_KINDS = ["app", "err", "evt", "os"]


def strong_pool(asked: DataFrame, index: DataFrame, levels: list[str] = STRONG_LEVELS) -> DataFrame:
    """query, fiche, designated: what the strong levels of each question keep; a question that they leave nothing has no row.

    asked: query, level, entity; index: entity, fiche.  Entities that no article carries, and other levels, do not count.
    All answers given must hold, of other levels any entity.  The levels that hold together are a prefix of those named, as
    long as some article has it.
    """
    index = index.select("entity", "fiche").distinct()
    known = asked.select("query", "level", "entity").where(F.col("level").isin(levels)).distinct().join(index.select("entity").distinct(), "entity", "left_semi")
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col("level"))
    w = Window.partitionBy("query")
    named = known.groupBy("query", "level").agg(F.count("*").alias("entities")).withColumn("k", F.row_number().over(w.orderBy(place)))
    # of the answers, which must all hold, the rarest finds the articles and the others are looked up for these
    carriers = index.groupBy("entity").agg(F.count("*").alias("carriers"))
    answers = known.where("level = 'answered'").join(carriers, "entity").withColumn("r", F.row_number().over(w.orderBy("carriers", "entity")))
    others = answers.where("r > 1").select("query", "entity").join(answers.where("r = 1").select("query", F.col("entity").alias("rarest")), "query")
    found = known.where("level <> 'answered'").unionByName(answers.where("r = 1").select("query", "level", "entity")).join(index, "entity")
    held = found.select("query", "level", "fiche").distinct().join(named, ["query", "level"])
    checked = held.where("level = 'answered' AND entities > 1").select("query", "fiche").join(others, "query").join(index, ["entity", "fiche"], "left_semi")
    whole = checked.groupBy("query", "fiche").agg((F.count("*") + 1).alias("n"))
    held = held.join(whole, ["query", "fiche"], "left").where((F.col("level") != "answered") | (F.coalesce("n", F.lit(1)) == F.col("entities")))
    depth = held.groupBy("query", "fiche").agg(F.array_sort(F.collect_list("k")).alias("ks")).select("query", "fiche", F.size(F.filter("ks", lambda k, i: k == i + 1)).alias("depth"))
    best = depth.withColumn("most", F.max("depth").over(w)).where("depth = most AND depth > 0")
    first = named.where("k = 1").select("query", F.col("level").isin(DESIGNATING).alias("designated"))
    return best.join(first, "query").select("query", "fiche", "designated")


def pool_scores(questions: DataFrame, pool: DataFrame, entries: DataFrame) -> DataFrame:
    """query, fiche, entry, score: the best entry of each article of a question's pool, rounded to 6, the lowest of equal ones.

    questions: query, own, vector; pool: query, fiche; entries: entry, fiche, vector.  A question that is an entry itself does
    not meet it.
    """
    met = pool.select("query", "fiche").join(entries, "fiche").where("entry <> query").join(questions.select("query", F.col("vector").alias("asked")), "query")
    best = met.groupBy("query", "fiche").agg(F.max(F.struct(F.round(dot(F.col("asked"), F.col("vector")), 6).alias("score"), (-F.col("entry")).alias("e"))).alias("m"))
    return best.select("query", "fiche", (-F.col("m.e")).alias("entry"), F.col("m.score").alias("score"))


def funnel_scores(
    questions: DataFrame, asked: DataFrame, index: DataFrame, entries: DataFrame, canonical: DataFrame, superseded: DataFrame,
    apps: DataFrame | None = None, top: int = 20, least: float = float("inf"),
) -> DataFrame:
    """query, fiche, entry, score, strong, designated, candidates, rank: the ranking that a decision is made on, without deciding.

    Told are the first `top` articles of each question and all that reach `least`; candidates counts all that were ranked.
    canonical: fiche, canonical; superseded: fiche, superseded_by.  apps (query, app), where given, narrows a question that names
    one application to the articles that carry it, if there are any.
    """
    found = written(strong_pool(asked, index), "pools")  # read three times below
    kept = prune(found.select("query", F.lit(0).alias("ord"), "fiche"), canonical, superseded).select("query", "fiche")
    marks = found.select("query", "designated").distinct()
    everywhere = entries.select(F.lit(0).alias("query"), F.lit(0).alias("ord"), "fiche").distinct().join(canonical.select("fiche"), "fiche", "left_anti").select("query", "ord", "fiche")
    standing = written(entries.join(prune(everywhere, canonical, superseded).select("fiche"), "fiche", "left_semi"), "standing")
    alone = questions.join(marks, "query", "left_anti")
    if apps is not None:
        kept = single_app_filter(kept, apps, index)
        carried = index.select(F.col("entity").alias("app"), "fiche").distinct().join(standing.select("fiche").distinct(), "fiche", "left_semi")
        one = apps.join(alone, "query", "left_semi").distinct().groupBy("query").agg(F.count("*").alias("n"), F.min("app").alias("app")).where("n = 1")
        narrowed = one.join(carried, "app").select("query", "fiche")
        kept, alone = kept.unionByName(narrowed), alone.join(narrowed.select("query").distinct(), "query", "left_anti")
    w = Window.partitionBy("query")
    pooled = pool_scores(questions, kept, entries).withColumn("candidates", F.count("*").over(w))
    sizes = written(standing.groupBy("fiche").agg(F.count("*").alias("n"), F.min("entry").alias("only")), "sizes")
    total, own = sizes.count(), sizes.where("n = 1").select(F.col("only").alias("query"), F.lit(1).alias("own"))  # it does not meet itself
    wide = best_entries(alone, standing, top, least).join(own, "query", "left").select("query", "fiche", "entry", "score", (F.lit(total) - F.coalesce("own", F.lit(0))).cast("long").alias("candidates"))
    told = pooled.unionByName(wide).join(marks, "query", "left").withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "fiche")))
    return told.where((F.col("rank") <= top) | (F.col("score") >= least)).select(
        "query", "fiche", "entry", "score", F.col("designated").isNotNull().alias("strong"), F.coalesce("designated", F.lit(False)).alias("designated"), "candidates", "rank"
    )


def _first(column: str, k: int) -> Column:
    return F.max(F.when(F.col("rank") == k, F.col(column)))


def semantic_find(
    scores: DataFrame, questions: DataFrame, asked: DataFrame, index: DataFrame, floor: float, margin: float, offer: float, choices: int = 3, options: int = 5, top: int = 5
) -> DataFrame:
    """The decision on each question: query, kind, reason, fiche, score, asks, options, ranked, candidates.

    scores: of funnel_scores(top=5 or more, least=offer or less).  kind is `fiche` (shown alone), `question` or `abstain`.  asks is the kind of entity asked for, or
    `fiche` for a choice; options are the entities, or the articles offered.  ranked are the first `top` articles.
    """
    w = Window.partitionBy("query")
    seen = written(scores.withColumn("first", F.max("score").over(w)), "funnel-scores")  # read four times below
    offered = F.col("score") >= offer
    close = offered & (F.round(F.col("first") - F.col("score"), 6) < margin)
    firsts = lambda keep, most: F.transform(F.array_sort(F.collect_list(F.when(keep & (F.col("rank") <= most), F.struct("rank", "fiche")))), lambda x: x["fiche"])
    told = seen.groupBy("query").agg(
        _first("fiche", 1).alias("top"), _first("score", 1).alias("score"), _first("score", 2).alias("second"), F.max("candidates").alias("candidates"), F.count(F.when(close, 1)).alias("n_close"),
        F.max("strong").alias("strong"), F.max("designated").alias("designated"), firsts(offered, choices).alias("offered"), firsts(F.lit(True), top).alias("ranked"),
    )
    verdict = semantic_verdict(F.col("score"), F.col("second"), floor, margin, offer, F.coalesce("strong", F.lit(False)), F.coalesce("designated", F.lit(False)))
    row = questions.select("query").join(told, "query", "left").withColumn("verdict", verdict)
    # entities are fetched for the close articles of the questions that ask back, and for no others
    asking = row.where("verdict = 'offer' AND n_close > 1").select("query")
    entities = index.select("fiche", "entity").distinct()
    near = seen.where(close).join(asking, "query", "left_semi").select("query", "fiche")
    carried = near.join(entities, "fiche", "left").join(asked.select("query", "entity").distinct(), ["query", "entity"], "left_anti")
    splits = discriminator(near.withColumn("entity", F.lit("")).unionByName(carried.where("entity is not null")), ASKED_KINDS, options)
    row = row.join(splits.select("query", F.col("kind").alias("splits"), F.col("options").alias("values")), "query", "left")
    reason = (
        F.when(F.col("top").isNull(), "no_candidate")
        .when(F.col("verdict") == "show", F.when(F.col("designated"), "designated").when(F.col("second").isNull(), "single").otherwise("clear_lead"))
        .when(F.col("verdict") == "abstain", "nothing_close")
        .when(F.col("splits").isNotNull(), "close_entity")
        .when(F.col("score") >= floor, "close_choice")
        .otherwise("below_floor")
    )
    v = F.col("verdict")
    return row.select(
        "query", F.when(v == "show", "fiche").when(v == "offer", "question").otherwise("abstain").alias("kind"), F.concat(F.lit("semantic_"), reason).alias("reason"),
        F.when(v == "show", F.col("top")).alias("fiche"), "score", F.when(v == "offer", F.coalesce("splits", F.lit("fiche"))).alias("asks"),
        F.when(v == "offer", F.coalesce("values", F.col("offered").cast("array<string>"))).alias("options"),
        F.coalesce("ranked", F.array().cast(scores.select(F.array("fiche")).schema[0].dataType)).alias("ranked"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )
