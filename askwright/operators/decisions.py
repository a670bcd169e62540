"""Decisions: show, ask or abstain.  Ladders of comparisons over the first candidates of a ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_two(ranked: DataFrame) -> DataFrame:
    """ranked: query, doc, score, rank.  One row a query: doc, first, second (null if there is one candidate)."""
    return ranked.where("rank <= 2").groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("doc"))).alias("doc"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )


def gap_decide(ranked: DataFrame, least: float = 0.18, gap: float = 0.12) -> DataFrame:
    lead = F.col("second").isNull() | (F.round(F.col("first") - F.col("second"), 6) >= gap)
    return first_two(ranked).withColumn("kind", F.when(F.col("first") < least, "abstain").when(lead, "fiche").otherwise("question"))


def semantic_verdict(first: Column, second: Column, floor: float, margin: float, offer: float, strong: Column | None = None, designated: Column | None = None) -> Column:
    """A floor above 1 never shows on a score; strong or designated candidates need the offer level only; a lead is positive."""
    strong = F.lit(False) if strong is None else strong
    designated = F.lit(False) if designated is None else designated
    gap = F.round(first - second, 6)
    lead = second.isNull() | ((gap > 0) & (gap >= margin))
    level = F.when((strong | designated) & F.lit(floor <= 1.0), F.lit(float(offer))).otherwise(F.lit(float(floor)))
    return F.when(first.isNull(), "abstain").when(designated & second.isNull(), "show").when((first >= level) & lead, "show").when(first >= offer, "offer").otherwise("abstain")


def semantic_decide(ranked: DataFrame, floor: float, margin: float, offer: float) -> DataFrame:
    return first_two(ranked).withColumn("verdict", semantic_verdict(F.col("first"), F.col("second"), floor, margin, offer))


def level_backoff(asked: DataFrame, index: DataFrame, levels: list[str]) -> DataFrame:
    """Intersect the levels of a ticket's entities, the most telling first, and drop the least telling until a fiche is left.

    asked: query, level, entity; index: entity, fiche.  Within a level any entity suffices.
    Returns query, fiche, depth (how many active levels hold).
    """
    order = F.create_map(*[F.lit(x) for i, n in enumerate(levels) for x in (n, i)])
    # entities that no fiche carries are not active
    reached = asked.join(index, "entity").select("query", order[F.col("level")].alias("l"), "fiche").distinct()
    active = reached.select("query", "l").distinct().withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("l")))
    placed = reached.join(active, ["query", "l"])
    # a fiche holds a prefix of the active levels if its ranks 1..depth are all there
    held = placed.groupBy("query", "fiche").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    depth = held.select("query", "fiche", F.size(F.filter("ks", lambda k, i: k == i + 1)).alias("depth"))
    best = depth.groupBy("query").agg(F.max("depth").alias("most"))
    return depth.join(best, "query").where((F.col("depth") == F.col("most")) & (F.col("depth") > 0)).select("query", "fiche", "depth")


def discriminator(close: DataFrame, kinds: list[str], most: int = 5) -> DataFrame:
    """close: query, fiche, entity ('kind:value').  The first kind for which every close fiche has a value, and of whose values
    that not all fiches carry, 2 to `most` reach every fiche: query, kind, options."""
    kind = F.substring_index("entity", ":", 1)
    rows = close.where("query IS NOT NULL").select("query", "fiche", F.when(kind.isin(kinds), kind).alias("kind"), F.when(kind.isin(kinds), F.col("entity")).alias("entity"))
    # dealt out by query once: the three steps that follow need no exchange of their own
    held = rows.repartition("query").groupBy("query", "kind", "entity").agg(F.collect_set("fiche").alias("held"))
    by_kind = held.groupBy("query", "kind").agg(F.collect_list(F.struct("entity", "held")).alias("values"))
    asked = by_kind.groupBy("query").agg(F.collect_list(F.struct("kind", "values")).alias("kinds"))
    reach = lambda values: F.size(F.array_distinct(F.flatten(F.transform(values, lambda v: v["held"]))))
    whole = F.size(F.array_distinct(F.flatten(F.flatten(F.transform("kinds", lambda k: F.transform(k["values"], lambda v: v["held"]))))))
    sized = asked.select("query", whole.alias("fiches"), F.explode("kinds").alias("k")).where(F.col("k.kind").isNotNull() & (reach(F.col("k.values")) == F.col("fiches")))
    split = sized.select("query", "fiches", F.col("k.kind").alias("kind"), F.filter("k.values", lambda v: F.size(v["held"]) < F.col("fiches")).alias("split"))
    good = split.where(F.size("split").between(2, most) & (reach(F.col("split")) == F.col("fiches")))
    order = F.create_map(*[F.lit(x) for i, n in enumerate(kinds) for x in (n, i)])
    told = good.select("query", "kind", F.array_sort(F.transform("split", lambda v: v["entity"])).alias("options"))
    return told.groupBy("query").agg(F.min(F.struct(order[F.col("kind")].alias("o"), "kind", "options")).alias("m")).select("query", "m.kind", "m.options")


def words_ladder(ranked: DataFrame, mode: DataFrame, least: tuple[float, float, float] = (0.10, 0.25, 0.40), gap: float = 0.12, choices: int = 3, fallback: float = 0.25, splits: DataFrame | None = None) -> DataFrame:
    """The decision of the word mode.

    ranked: query, doc, score, rank, named (the question holds two words of the title, one of them telling), app (null
    without one); mode: query, entities (known ones kept the candidates), strong (one of them as telling as an error code).
    Returns query, kind, reason, doc (of a shown one), offered.  Above the threshold of the mode a lead shows the first if it
    is named or strong, else it is offered; close ones ask, unless one alone of them is named.  Below it, few candidates of
    known entities are offered, and of words alone, from `fallback` on, the applications of the first ten are asked for.
    mode may have a column designated (the question names the article: no score is needed).  splits (query, kind, options), of
    discriminator() over the close ones, is asked for instead of offering close articles that known entities brought together.
    """
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    tops = ranked.groupBy("query").agg(first.alias("first"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count("*").alias("n"))
    seen = ranked.join(tops.select("query", "first"), "query").withColumn("close", F.round(F.col("first") - F.col("score"), 6) < gap)
    doc_at = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("rank", "doc"))))
    told = seen.groupBy("query").agg(
        doc_at(F.col("close")).alias("near"), doc_at(F.col("close") & F.col("named")).alias("titled"), doc_at((F.col("score") > 0) & (F.col("rank") <= choices)).alias("plausible"),
        doc_at(F.col("rank") <= choices).alias("few"), F.max((F.col("rank") == 1) & F.col("named")).alias("top_named"),
        F.max(F.when(F.col("rank") == 1, F.col("doc"))).alias("top"), F.max(F.when(F.col("rank") <= 10, F.col("app"))).isNotNull().alias("apps"),
    )
    row = mode.join(tops, "query", "left").join(told, "query", "left")
    row = row if "designated" in mode.columns else row.withColumn("designated", F.lit(False))
    told_apart = F.lit(None).cast("string") if splits is None else F.col("splits")
    row = row if splits is None else row.join(splits.select("query", F.col("kind").alias("splits")), "query", "left")
    enough = F.col("first") >= F.when(F.col("designated"), 0.0).when(F.col("strong"), least[0]).when(F.col("entities"), least[1]).otherwise(least[2])
    lead = F.col("second").isNull() | (F.round(F.col("first") - F.col("second"), 6) >= gap)
    reason = (
        F.when(F.col("n").isNull(), "no_candidate")
        .when(enough & lead & (F.col("strong") | F.col("top_named")), F.when(F.col("second").isNull(), "single").otherwise("clear_lead"))
        .when(enough & lead, "no_title_match")
        .when(enough & (F.size("titled") == 1), "close_title_match")
        .when(enough & F.col("entities") & told_apart.isNotNull(), "close_entity")
        .when(enough, "close_choice")
        .when(F.col("entities") & (F.col("n") <= choices), "weak_text_few")
        .when(F.col("entities"), "weak_text")
        .when((F.col("first") >= fallback) & F.col("apps"), "ask_application")
        .when(F.col("first") >= fallback, "text_only_weak")
        .otherwise("nothing_close")
    )
    docs = lambda c: F.transform(F.slice(c, 1, choices), lambda x: x["doc"])
    told_reason = row.withColumn("reason", reason)
    r = F.col("reason")
    return told_reason.select(
        "query",
        F.when(r.isin("single", "clear_lead", "close_title_match"), "fiche").when(r.isin("no_title_match", "close_entity", "close_choice", "weak_text_few", "ask_application"), "question").otherwise("abstain").alias("kind"),
        "reason",
        F.when(r.isin("single", "clear_lead"), F.col("top")).when(r == "close_title_match", F.col("titled")[0]["doc"]).alias("doc"),
        F.when(r == "no_title_match", F.when(F.size("plausible") > 0, docs(F.col("plausible"))).otherwise(F.array("top"))).when(r == "close_choice", docs(F.col("near"))).when(r == "weak_text_few", docs(F.col("few"))).alias("offered"),
    )


def close_set(ranked: DataFrame, gap: float = 0.12) -> DataFrame:
    """The documents within `gap` of the first, by rank."""
    first = ranked.where("rank = 1").select("query", F.col("score").alias("__first"))
    near = ranked.join(first, "query").where(F.round(F.col("__first") - F.col("score"), 6) < gap)
    return near.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("close"))


def ticket_entities(asked: DataFrame, index: DataFrame, answered: DataFrame) -> DataFrame:
    """asked: query, entity; index: entity, fiche; answered: query, entity.  known (some fiche carries it), ignored, and the
    answers that are known, each sorted."""
    carried = index.select("entity").distinct().withColumn("known", F.lit(True))
    rows = asked.withColumn("answer", F.lit(False)).unionByName(answered.withColumn("answer", F.lit(True))).join(carried, "entity", "left")
    sorted_set = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("entity"))))
    known = F.coalesce("known", F.lit(False))
    return rows.groupBy("query").agg(sorted_set(known & ~F.col("answer")).alias("known"), sorted_set(~known & ~F.col("answer")).alias("ignored"), sorted_set(known & F.col("answer")).alias("answers"))


def single_app_filter(candidates: DataFrame, apps: DataFrame, index: DataFrame) -> DataFrame:
    """candidates: query, fiche; apps: query, app; index: entity, fiche.  Where a question names exactly one application and some
    candidates carry it, only these stay."""
    one = apps.distinct().groupBy("query").agg(F.count("*").alias("n"), F.min("app").alias("app")).where("n = 1").select("query", "app")
    carried = index.select(F.col("entity").alias("app"), "fiche").distinct().withColumn("has", F.lit(1))
    marked = candidates.join(one, "query", "left").join(carried, ["app", "fiche"], "left")
    some = marked.groupBy("query").agg(F.count("has").alias("some"))
    return marked.join(some, "query").where((F.col("some") == 0) | F.col("has").isNotNull()).select("query", "fiche")


def app_options(ranked: DataFrame, index: DataFrame, depth: int = 10, most: int = 5) -> DataFrame:
    """The applications of a question's first `depth` fiches, in order of appearance, `most` at most."""
    apps = index.where(F.col("entity").startswith("app:")).select("fiche", "entity")
    seen = ranked.where(F.col("rank") <= depth).join(apps, ranked["doc"] == apps["fiche"]).groupBy("query", "entity").agg(F.min("rank").alias("at"))
    w = Window.partitionBy("query").orderBy("at", "entity")
    return seen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query", "entity", "place")


def min_show(kind: Column, score: Column, floor: float, designated: Column) -> Column:
    """Under the calibrated floor a shown fiche becomes a choice, unless the ticket designates it."""
    return F.when((kind == "fiche") & ~designated & (score < floor), "question").otherwise(kind)
