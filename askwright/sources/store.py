"""Key-value tables and recorded answers as DataFrames: merge, replace, create if absent, optimistic versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], create_only: bool = False, replace: bool = False) -> DataFrame:
    """old with new's rows: a null in new keeps what is there (replace: it does not); create_only leaves present rows alone."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("__old"))
    b = new.select(*keys, F.struct(*rest).alias("__new"))
    both = a.join(b, keys, "full_outer")

    def value(c: str):
        was, now = F.col(f"__old.{c}"), F.col(f"__new.{c}")
        if create_only:
            return F.when(F.col("__old").isNotNull(), was).otherwise(now)
        if replace:
            return F.when(F.col("__new").isNotNull(), now).otherwise(was)
        return F.coalesce(now, was)

    return both.select(*keys, *[value(c).alias(c) for c in rest])


def merge_if_version(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> tuple[DataFrame, DataFrame]:
    """(table, refused): a change counts only if it names the version that is there; the version grows by one."""
    now = old.select(*keys, F.col(version).alias("__is"))
    marked = new.join(now, keys, "left")
    good = marked.where(F.col("__is") == F.col(version)).drop("__is").withColumn(version, F.col(version) + 1)
    return merge(old, good, keys), marked.where("__is is null or __is <> " + version).drop("__is")


def recorded(answers: DataFrame) -> DataFrame:
    """request, answer, recorded_at: the first answer to a request wins."""
    return answers.groupBy("request").agg(F.min_by("answer", F.struct("recorded_at", "answer")).alias("answer"))


def replay(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with their recorded answers; a miss is a row with an error, never a call."""
    return requests.join(recorded(answers), "request", "left").withColumn("error", F.when(F.col("answer").isNull(), "not recorded"))


def replay_engine(tickets: DataFrame, decisions: DataFrame) -> DataFrame:
    """tickets: key, run; decisions: key, ord, kind, fiches.  A list of decisions is used up one a run, then from its start."""
    n = decisions.groupBy("key").agg(F.count("*").alias("n"))
    asked = tickets.join(n, "key", "left").withColumn("ord", F.when(F.col("n") > 0, F.col("run") % F.col("n")))
    return asked.join(decisions, ["key", "ord"], "left").select("key", "run", F.coalesce("kind", F.lit("abstain")).alias("kind"), "fiches")
