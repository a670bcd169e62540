"""Measurement over the fact table of decisions.

records: engine, run, ticket_id, client, ord, kind, fiches array<string>, expected array<string> (null: unlabelled),
score, latency_s, error, level, tokens_in, tokens_out.  (client, ticket_id) names a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions import stats

KEY = ["client", "ticket_id"]


def last_of_run(records: DataFrame) -> DataFrame:
    """Of each (engine, run, question) the last record."""
    w = Window.partitionBy("ticket_id", "client", "engine", "run").orderBy(F.desc("ord"))  # what tells most apart is sorted first
    return records.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def canonical(records: DataFrame) -> DataFrame:
    """The last records of each engine's smallest run; other runs are left out before anything is sorted."""
    first = records.groupBy("engine").agg(F.min("run").alias("run"))
    return last_of_run(records.join(F.broadcast(first), ["engine", "run"]))  # one row an engine


def shown() -> Column:
    return F.when((F.col("kind") == "fiche") & (F.size("fiches") > 0), F.get("fiches", F.lit(0)))


def answerable() -> Column:
    return F.coalesce(F.size("expected") > 0, F.lit(False))


def exact() -> Column:
    return F.coalesce(answerable() & F.array_contains("expected", shown()), F.lit(False))


def first_fiche() -> Column:
    return F.when(F.col("kind").isin("fiche", "question") & (F.size("fiches") > 0), F.get("fiches", F.lit(0)))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def summarize(records: DataFrame) -> DataFrame:
    """One row an engine: the counts of its canonical run."""
    s, a = shown(), answerable()
    return canonical(records).groupBy("engine").agg(
        F.count("*").alias("tickets"),
        count_if(a).alias("with_fiche"),
        count_if(exact()).alias("exact"),
        count_if(s.isNotNull() & ~F.coalesce(F.array_contains("expected", s), F.lit(False))).alias("wrong_shown"),
        count_if(s.isNull()).alias("no_fiche"),
        count_if(F.col("kind") == "question").alias("questions"),
        count_if(~a & s.isNull()).alias("correct_none"),
        count_if(a & F.arrays_overlap(F.slice("fiches", 1, 5), F.coalesce("expected", F.expr("array('')")))).alias("recall5"),
    )


def latencies(records: DataFrame) -> DataFrame:
    good = records.where("latency_s is not null and error is null")
    return good.groupBy("engine").agg(F.round(F.percentile("latency_s", 0.5), 6).alias("p50"), F.round(F.percentile("latency_s", 0.95), 6).alias("p95"), F.count("*").alias("n"))


def stability(records: DataFrame) -> DataFrame:
    """Questions of the first run with the same kind and shown fiche in every run."""
    rows = last_of_run(records).withColumn("sig", F.concat_ws("|", "kind", F.coalesce(shown(), F.lit(""))))
    runs = records.groupBy("engine").agg(F.countDistinct("run").alias("runs"), F.min("run").alias("first"))
    per = rows.join(F.broadcast(runs), "engine").groupBy("engine", "runs", *KEY).agg(F.countDistinct("sig").alias("sigs"), F.count("*").alias("seen"), F.max((F.col("run") == F.col("first")).cast("int")).alias("in_first"))
    return per.where("in_first = 1").groupBy("engine").agg(count_if((F.col("sigs") == 1) & (F.col("seen") == F.col("runs"))).alias("stable"), F.count("*").alias("n"))


def exact_by_run(records: DataFrame) -> DataFrame:
    return last_of_run(records).where(answerable()).groupBy("engine", "run").agg(count_if(exact()).alias("exact"), F.count("*").alias("n"))


def compare(records: DataFrame, first: str, second: str) -> DataFrame:
    """Paired outcomes of two engines on the questions that expect a fiche, with McNemar's exact p."""
    mine = canonical(records).where(answerable())
    a = mine.where(F.col("engine") == first).select(*KEY, exact().alias("a"))
    b = mine.where(F.col("engine") == second).select(*KEY, exact().alias("b"))
    t = a.join(b, KEY).agg(F.count("*").alias("tickets"), count_if(F.expr("a and not b")).alias("first_only"), count_if(F.expr("b and not a")).alias("second_only"), count_if(F.expr("a and b")).alias("both"), count_if(F.expr("not a and not b")).alias("neither"))
    return t.withColumn("p_value", F.round(stats.mcnemar(F.col("first_only"), F.col("second_only")), 6))


def threshold_sweep(records: DataFrame) -> DataFrame:
    """What if a fiche were shown at its score or above only: counts at each distinct score (null: all), by engine.

    Sums over distinct scores come first, so the running window holds one row a score.
    """
    canon = canonical(records).withColumn("s", shown())
    totals = canon.groupBy("engine").agg(
        F.count("*").alias("n"), count_if(answerable()).alias("answerable"),
        count_if(F.col("s").isNotNull() & F.col("score").isNull()).alias("u_kept"), count_if(F.col("s").isNotNull() & F.col("score").isNull() & exact()).alias("u_exact"),
    )
    per = canon.where("s is not null and score is not null").groupBy("engine", F.col("score").alias("threshold")).agg(F.count("*").alias("k"), count_if(exact()).alias("e"))
    w = Window.partitionBy("engine").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    rows = per.select("engine", "threshold", F.sum("k").over(w).alias("k"), F.sum("e").over(w).alias("e"))
    everything = per.groupBy("engine").agg(F.lit(None).cast("double").alias("threshold"), F.sum("k").alias("k"), F.sum("e").alias("e"))
    out = rows.unionByName(everything).join(F.broadcast(totals), "engine")  # one row an engine
    kept, right = F.col("k") + F.col("u_kept"), F.col("e") + F.col("u_exact")
    return out.select("engine", "threshold", right.alias("exact"), (kept - right).alias("wrong_shown"), (F.col("n") - kept).alias("no_fiche"), "answerable", "n")


def recommend(sweep: DataFrame, ceiling: float) -> DataFrame:
    """The lowest threshold whose wrong rate stays under the ceiling at the top of its interval."""
    high = stats.wilson(F.col("wrong_shown"), F.col("n"), True)
    ok = sweep.withColumn("high", F.round(high, 6)).where(high <= ceiling)
    best = ok.groupBy("engine").agg(F.min(F.struct(F.coalesce("threshold", F.lit(float("-inf"))).alias("t"), "threshold", "exact", "wrong_shown", "high")).alias("m"))
    return best.select("engine", "m.threshold", "m.exact", "m.wrong_shown", "m.high")


def by_route(records: DataFrame) -> DataFrame:
    s = shown()
    return canonical(records).groupBy("engine", F.coalesce("level", F.lit("none")).alias("level")).agg(
        F.count("*").alias("n"), count_if(s.isNotNull()).alias("shown"), count_if(exact()).alias("exact"),
        count_if(s.isNotNull() & ~F.coalesce(F.array_contains("expected", s), F.lit(False))).alias("wrong"),
    )


def gate_questions(records: DataFrame, base: str, routed: str, excluded: DataFrame) -> DataFrame:
    """A row for each question that base or routed answered: b and r (their last records of the first run: first fiche and labels), the
    later runs of each that have it, its exact decisions, how many of them are wrong, errors, degraded, and whether it was seen.

    Records are combined by question once; all that the gate counts is read off these rows.
    """
    own = records.where(F.col("engine").isin(base, routed))
    first = own.groupBy("engine").agg(F.min("run").alias("__first"))
    own = own.join(F.broadcast(first), "engine")  # one row an engine
    of_base, of_routed = F.col("engine") == base, F.col("engine") == routed
    in_first, later = F.col("run") == F.col("__first"), F.col("run") > F.col("__first")
    last = F.struct("ord", first_fiche().alias("fiche"), "expected")
    wrong = ~F.coalesce(F.array_contains("expected", shown()), F.lit(False))
    exact_level = of_routed & F.col("level").isin("L0", "L1", "L2") & shown().isNotNull()
    slim = own.select(
        *KEY, F.when(of_base & in_first, last).alias("b"), F.when(of_routed & in_first, last).alias("r"), F.when(of_base & later, F.col("run")).alias("base_run"),
        F.when(of_routed & later & F.lit(base != routed), F.col("run")).alias("routed_run"), exact_level.alias("exact"), (exact_level & wrong).alias("wrong"),
        F.col("error").isNotNull().alias("failed"), F.col("degraded").isNotNull().alias("degraded"),
    )
    asked = slim.groupBy(*reversed(KEY)).agg(
        F.max("b").alias("b"), F.max("r").alias("r"), F.collect_set("base_run").alias("base_runs"), F.collect_set("routed_run").alias("routed_runs"), count_if(F.col("exact")).alias("exact_decisions"),
        count_if(F.col("wrong")).alias("wrong_exact"), count_if(F.col("failed")).alias("errors"), count_if(F.col("degraded")).alias("degraded"),
    )
    seen = excluded.select(*reversed(KEY)).distinct().withColumn("seen", F.lit(True))  # dealt out as the questions are
    return asked.join(seen, KEY, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def gate(records: DataFrame, base: str, routed: str, excluded: DataFrame, least: int = 30, failures: int = 0, degraded: int = 0) -> DataFrame:
    """One row: status (invalid, failed, insufficient, passed), the counts it rests on and the reasons that hold, in order.

    invalid: the engines answered other questions or labels, a later run is uneven, a decision failed, a call failed for a
    while (failures), or decisions are marked degraded; failed: a fiche shown as exact is wrong in any run, or the right one
    comes first less often; insufficient: too few compared questions, or no exact decision on a question that no reviewer saw.
    """
    if "degraded" not in records.columns:
        records = records.withColumn("degraded", F.lit(None).cast("string"))
    q = gate_questions(records, base, routed, excluded)
    named = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in KEY))  # a question without a name is nobody's pair
    has_b, has_r = F.col("b").isNotNull(), F.col("r").isNotNull()
    paired = F.coalesce(named & F.col("b.expected").isNotNull() & F.col("r.expected").isNotNull(), F.lit(False))
    sides = F.when(paired | ~(has_b | has_r), 0).when(has_b & has_r & ~named, 2).otherwise(1)
    compared = paired & (F.size("b.expected") > 0) & ~F.col("seen")
    counts = {
        "asked": has_b.cast("int"), "unpaired": sides, "relabelled": (paired & (F.sort_array("b.expected") != F.sort_array("r.expected"))).cast("int"), "exact_decisions": F.col("exact_decisions"),
        "wrong_exact": (F.col("wrong_exact") > 0).cast("int"), "unseen_exact": ((F.col("exact_decisions") > 0) & ~F.col("seen")).cast("int"), "errors": F.col("errors"),
        "degraded": (F.col("degraded") > 0).cast("int"), "compared": compared.cast("int"), "base_first": (compared & F.array_contains("b.expected", F.col("b.fiche"))).cast("int"),
        "route_first": (compared & F.array_contains("b.expected", F.col("r.fiche"))).cast("int"),
    }
    # a row without a run holds the question's own counts, one for each later run that it is in tells whether the base was asked it
    of = lambda side, runs: F.transform(runs, lambda run: F.struct(F.lit(side).alias("side"), run.alias("run")))
    own = F.array(F.struct(F.lit("").alias("side"), F.lit(None).cast(q.schema["base_runs"].dataType.elementType).alias("run")))
    rows = q.select(*[c.cast("long").alias(n) for n, c in counts.items()], (named & has_b).cast("long").alias("both"), F.explode(F.concat(own, of("base", F.col("base_runs")), of("routed", F.col("routed_runs")))).alias("of"))
    total = lambda n: F.sum(F.when(F.col("of.side") == "", F.col(n)))
    runs = rows.groupBy("of").agg(*[total(n).alias(n) for n in counts], F.count("*").alias("had"), F.sum("both").alias("both"))
    held = F.collect_list(F.when(F.col("of.side") != "", F.struct("had", "both")))  # runs are few
    row = runs.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], held.alias("held"))
    row = row.select(*[n for n in counts if n != "asked"], F.size(F.filter("held", lambda x: (x["had"] != x["both"]) | (x["both"] != F.col("asked")))).cast("long").alias("uneven"))
    rules = [
        ("invalid", "unpaired", F.col("unpaired") > 0), ("invalid", "uneven_runs", F.col("uneven") > 0), ("invalid", "relabelled", F.col("relabelled") > 0),
        ("invalid", "errors", F.col("errors") > 0), ("invalid", "failures", F.lit(failures > 0)), ("invalid", "degraded", (F.col("degraded") > 0) | F.lit(degraded > 0)),
        ("failed", "wrong_exact", F.col("wrong_exact") > 0), ("failed", "right_first", F.col("route_first") < F.col("base_first")),
        ("insufficient", "few_questions", F.col("compared") < max(1, least)), ("insufficient", "no_exact_decision", F.col("exact_decisions") == 0),
        ("insufficient", "only_seen_questions", (F.col("exact_decisions") > 0) & (F.col("unseen_exact") == 0)),
    ]
    holds = lambda status: F.filter(F.array(*[F.when(c, F.lit(name)) for s, name, c in rules if s == status]), lambda x: x.isNotNull())
    told = row.withColumn("reasons", F.concat(holds("invalid"), holds("failed"), holds("insufficient")))
    status = F.lit("passed")
    for name in ("insufficient", "failed", "invalid"):
        status = F.when(F.size(holds(name)) > 0, name).otherwise(status)
    return told.withColumn("status", status)


def split_recommendation(records: DataFrame, half: Column, most_wrong: float) -> DataFrame:
    """The floor that half A allows, held against half B: engine, tickets_a, tickets_b, threshold, exact_a, wrong_a, exact_b, wrong_b,
    confirmed, reason.

    The floor is recommend()'s on half A.  On half B what has no score is shown, whatever the floor; the floor is confirmed if
    the wrong ones, at the top of their interval, stay under the ceiling there too.  reason: empty_half, nothing_scored, too_few
    (half A has fewer tickets than no wrong one would need), over_ceiling, confirmed or not_confirmed.
    """
    split = records.withColumn("__half", half)
    a, b = (split.where(F.col("__half") == h).drop("__half") for h in ("A", "B"))
    scored = shown().isNotNull() & F.col("score").isNotNull()
    sizes = canonical(a).groupBy("engine").agg(F.count("*").alias("tickets_a"), count_if(scored).alias("scored")).join(canonical(b).groupBy("engine").agg(F.count("*").alias("tickets_b")), "engine", "full_outer")
    best = recommend(threshold_sweep(a), most_wrong).select("engine", "threshold", F.col("exact").alias("exact_a"), F.col("wrong_shown").alias("wrong_a"))
    kept = shown().isNotNull() & (F.col("score").isNull() | (F.col("score") >= F.coalesce("threshold", F.lit(0.0))))
    held = canonical(b).join(F.broadcast(best), "engine").groupBy("engine").agg(count_if(kept & exact()).alias("exact_b"), count_if(kept & ~exact()).alias("wrong_b"))  # one row an engine
    row = sizes.na.fill(0, ["tickets_a", "tickets_b", "scored"]).join(best, "engine", "left").join(held, "engine", "left")
    high = stats.wilson(F.col("wrong_b"), F.col("tickets_b"), True)
    empty = (F.col("tickets_a") == 0) | (F.col("tickets_b") == 0)
    reason = (
        F.when(empty, "empty_half").when(F.col("scored") == 0, "nothing_scored")
        .when(F.col("wrong_a").isNull(), F.when(F.col("tickets_a") < stats.tickets_needed(F.lit(most_wrong)), "too_few").otherwise("over_ceiling"))
        .when(high <= most_wrong, "confirmed").otherwise("not_confirmed")
    )
    told = row.withColumn("reason", reason)
    found = F.col("reason").isin("confirmed", "not_confirmed")
    values = [F.when(found, F.col(c)).alias(c) for c in ("threshold", "exact_a", "wrong_a", "exact_b", "wrong_b")]
    return told.select("engine", "tickets_a", "tickets_b", *values, (F.col("reason") == "confirmed").alias("confirmed"), "reason")


CLOSED = 1_000_000  # answers of a task that sets their closure's rows apart


def accepted_closure(expected: DataFrame, resolve: DataFrame) -> DataFrame:
    """expected: ticket_id, fiche; resolve: fiche, target (of a duplicate or superseded one).  Right answers and what they lead to,
    each once.  Answers are dealt out by ticket before anything is set apart, in parts of a bounded size."""
    dealt = expected.select("ticket_id", "fiche")
    dealt = dealt.repartition(max(1, -(-dealt.count() // CLOSED)), "ticket_id")
    led = dealt.join(resolve, "fiche", "left").select("ticket_id", F.explode(F.array_distinct(F.array("fiche", F.coalesce("target", "fiche")))).alias("fiche"))
    return led.distinct()


def marked_sweep(sweep: DataFrame, most: int = 9) -> DataFrame:
    """All of each engine's thresholds, `sampled` on those that sampled_sweep() keeps."""
    w = Window.partitionBy("engine").orderBy("threshold")
    placed = sweep.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("engine")))
    places = F.transform(F.sequence(F.lit(1), F.lit(most - 3)), lambda k: F.bround(k * ((F.col("n") - 1) / (most - 2))).cast("int"))
    ends = F.col("i").isin(0) | (F.col("i") == F.col("n") - 1)
    return placed.withColumn("sampled", (F.col("n") <= most) | ends | F.array_contains(places, F.col("i")) | F.col("recommended")).drop("i", "n")


def sampled_sweep(sweep: DataFrame, most: int = 9) -> DataFrame:
    """Of each engine's thresholds (engine, threshold, recommended) the ends, evenly spaced ones between (halves to the even
    place), and the recommended one: `most` rows, or all where there are no more."""
    return marked_sweep(sweep, most).where("sampled").drop("sampled")


def tallies(partial: DataFrame) -> DataFrame:
    """Counts by what (kind, reason, mode) and value, merged from partial ones."""
    return partial.groupBy("what", "value").agg(F.sum("n").alias("n"))


def unique_holders(numbers: DataFrame) -> DataFrame:
    """numbers: number, fiche.  The fiche of a number, or 'ambiguous' where several hold it."""
    held = numbers.distinct().groupBy("number").agg(F.count("*").alias("n"), F.min("fiche").alias("fiche"))
    return held.select("number", F.when(F.col("n") == 1, F.col("fiche")).alias("fiche"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("state"))
