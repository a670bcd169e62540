"""Audit of how filters interact, from histograms of failure masks.

Five filters judge a document by its own text (A to D) or against the table (E):
    A  fewer than 50 words                       B  100 * distinct words < 65 * words (case counts)
    C  100 * letters A-Z > 5 * code points       D  holds any of # $ % & * |
    E  its text is identical to that of a row with a smaller id, whatever other filters say of that row
A document's failures are a mask of five bits, so a part of the corpus is told by 32 cells, each with counts of documents
and of labelled ones.  What any order of the filters keeps and removes follows from the cells alone: all 120 orders are
enumerated from them, however many documents there are.

How it runs: words, letters and signs are counted by native expressions.  A grouping by whole texts supplies each text's
smallest id (copies meet in the map tasks first, so a text of a third of all rows arrives as one row a task).  That smallest
id goes back to its row by the id and the text's SHA-256, as no other row can be the first of this text: the join is on ids,
which are many, and not on texts, of which one may be hot.  Labels join by id, too; null ids, which match nothing, are dealt
out by a salt.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
CELLS = 1 << len(FILTERS)
SPACES = "\t\n\v\f\r"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SALTS = 1024  # that rows without an id are dealt to
VALUES = ("n", "good", "toxic")  # what a cell counts


def _text_mask(text: Column, words: Column) -> Column:
    """Bits 0 to 3: the filters that a text fails by itself."""
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * capitals > MOST_CAPITALS * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(fail, F.lit(1 << k)).otherwise(F.lit(0)) for k, fail in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of docs.

    part is the source, null as the empty string.  A null text is empty: no words, so it fails A and is a copy of the other
    empty texts.  A row without an id is no copy of any (nothing is smaller than null) and has no label; rows with one id and
    one text are not copies of each other; an id with several texts is judged text by text.  An id with several labels is
    good, or toxic, if one of them says so.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    firsts = rows.groupBy("text").agg(F.min("id").alias("id")).where("id is not null").select("id", F.lit(-1).alias("salt"), F.unhex(F.sha2("text", 256)).alias("sha"), F.lit(True).alias("first"))
    words = F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "")
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text", "part"), F.lit(SALTS)).cast("int")).otherwise(-1)
    judged = rows.select("id", salt.alias("salt"), "part", F.unhex(F.sha2("text", 256)).alias("sha"), "text", words.alias("words")).select(
        "id", "salt", "part", "sha", _text_mask(F.col("text"), F.col("words")).alias("own")
    )
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    joined = judged.join(firsts, ["id", "salt", "sha"], "left").join(told.withColumn("salt", F.lit(-1)), ["id", "salt"], "left")
    copy = F.when(F.col("first").isNull() & F.col("id").isNotNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    return joined.select("part", (F.col("own") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def histogram(masks: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows a part.  Counted on the map side first, so a part may hold any share of all rows."""
    return masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def _total(value: str, holds: str) -> Column:
    """The sum of a cell value over the masks m of 0 to 31 for which the expression holds."""
    return F.expr(f"aggregate(sequence(0, {CELLS - 1}), 0L, (s, m) -> s + IF({holds}, {value}[m], 0L))")


def enumerate_orders(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    shapley adds up what the step's filter removes over all 120 orders.  A part without any row has no result.
    """
    arrays = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*VALUES)))).alias("cell"))
    dense = arrays.select("part", *[F.expr(f"transform(sequence(0, {CELLS - 1}), m -> coalesce(try_element_at(cell, m).{v}, 0L))").alias(v) for v in VALUES])
    orders = dense.select("part", *VALUES, F.explode(F.array(*[F.lit(x) for x in ORDERS])).alias("filter_order"))
    steps = orders.select(
        "*", F.posexplode(F.expr("transform(sequence(1, 5), k -> shiftleft(1, ascii(substr(filter_order, k, 1)) - 65))")).alias("at", "bit"),
    ).withColumn("before", F.expr("aggregate(sequence(1, 5), 0, (s, k) -> s + IF(k <= at, shiftleft(1, ascii(substr(filter_order, k, 1)) - 65), 0))"))
    here = "(m & bit) <> 0 AND (m & before) = 0"
    counted = steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), "bit",
        _total("n", "(m & (before | bit)) = 0").alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", "(m & bit) <> 0 AND (m & before) <> 0").alias("redundant"),
        F.expr("n[bit]").alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return enumerate_orders(histogram(failure_masks(docs, labels)))


ORACLE = r"""
WITH told AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS words
      FROM documents d LEFT JOIN told USING (doc_id)),
judged AS (SELECT part, good, toxic, {
      'A': len(words) < 50,
      'B': 100 * len(list_distinct(words)) < 65 * len(words),
      'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'),
      'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f FROM t),
fails AS (SELECT part, good, toxic, [f.A, f.B, f.C, f.D, f.E] AS f, f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS n_fails FROM judged),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, chr(64 + o[1]) || chr(64 + o[2]) || chr(64 + o[3]) || chr(64 + o[4]) || chr(64 + o[5]) AS filter_order, k AS step FROM orders, letters),
seen AS (SELECT part, good, toxic, n_fails, filter_order, step, o[step] AS filter, f[o[step]] AS fails_here,
                f[o[1]] AND step > 1 OR f[o[2]] AND step > 2 OR f[o[3]] AND step > 3 OR f[o[4]] AND step > 4 AS gone FROM fails, steps),
counted AS (SELECT part, filter_order, step, filter,
       count(*) FILTER (NOT gone AND NOT fails_here) AS kept, count(*) FILTER (NOT gone AND fails_here) AS removed,
       count(*) FILTER (gone AND fails_here) AS redundant, count(*) FILTER (fails_here AND n_fails = 1) AS unique_fails,
       count(*) FILTER (NOT gone AND fails_here AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND fails_here AND toxic = 1) AS toxic_lost
FROM seen GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""
