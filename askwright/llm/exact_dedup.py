"""Exact dedup by skew-safe combining (DataFrame operations only).

1. local: the map side of the first aggregation keeps one row for each distinct text and salt of a task;
2. salted: equal digests meet in `salts` independent groups, so a text that fills a third of the table
   reaches a reducer as at most one row per map task and salt;
3. global: the winners of the salts are combined.
Digest and full normalised text are grouping keys at each of these, so texts are merged only where their contents are equal.
Verdicts then go back to the rows, by salt and by a key of SHA-256, an independent 64-bit hash and the length.  This last step
decides nothing about which texts are equal; it would send the texts over the network a third time to compare them again, and
two different texts that share all 352 bits of the key have never been seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import ascii_lower, materialize

KEY = ["__sha", "__xx", "__len"]
SALTS = 32  # 62 at most: the salts that hold a text are bits of a long


def _key(norm: Column) -> list[Column]:
    return [F.unhex(F.sha2(norm, 256)).alias("__sha"), F.xxhash64(norm).alias("__xx"), F.octet_length(norm).alias("__len")]


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """__id, KEY, __keep, __n of every row."""
    rows = docs.select(F.col(id_col).alias("__id"), _norm(text_col).alias("__norm"))
    keyed = rows.select("__id", "__norm", *_key(F.col("__norm")), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("__salt"))
    salted = keyed.groupBy("__salt", *KEY, "__norm").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    winners = salted.groupBy(*KEY, "__norm").agg(
        F.max("__keep").alias("__keep"), F.sum("__n").alias("__n"), F.bit_or(F.expr("shiftleft(1L, __salt)")).alias("__salts")
    )
    # one row for each salt that holds the text: the rows of a very frequent text are joined salt by salt
    dealt = winners.select(*KEY, "__keep", "__n", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> shiftright(__salts, s) % 2 <> 0)")).alias("__salt"))
    return keyed.select("__id", "__salt", *KEY).join(dealt, ["__salt", *KEY])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text; of equal texts the
    largest id stays.  A null id never wins over a present one; a group of null ids only has a null keep_id and its
    rows are kept.  Repeated rows count in group_size and share their id's verdict.  Long texts are read whole.  Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    return _verdicts(docs, id_col, text_col, salts).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each distinct text, with all its columns: the one with the largest id, whole.

    A row is judged by its own id and text, so an id that has several texts stays with those it wins.  Of rows with equal id
    and text one stays, whichever; a row with a null id stays where no row with an id has its text.
    """
    verdicts = _verdicts(docs, id_col, text_col, SALTS).where(F.col("__id").eqNullSafe(F.col("__keep")))
    kept = materialize(verdicts.groupBy("__id", *KEY).agg(F.count(F.lit(1)).alias("__times")), "kept")
    keyed = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), *_key(_norm(text_col)))
    columns = [F.col("__row")[x].alias(x) for x in docs.columns]  # packed meanwhile: their names clash with nothing
    rows = lambda which: keyed.join(
        kept.where(which).select(F.col("__id").alias("__kid"), *[F.col(k).alias("k" + k) for k in KEY]),
        F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__sha") == F.col("k__sha")) & (F.col("__xx") == F.col("k__xx")) & (F.col("__len") == F.col("k__len")),
        "left_semi",
    )
    found = rows("__times = 1").select(*columns)
    if kept.where("__times > 1").limit(1).count():  # rows repeated whole: only these are made distinct
        found = found.unionByName(rows("__times > 1").dropDuplicates(["__id", *KEY]).select(*columns))
    return found


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
