"""Steps proposed for a text (by a model, say) held against the text: quotes placed, structure of rules merged, steps linked."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions.entities import extract_udf
from askwright.functions.quotes import Source, needles
from askwright.functions.segment import FAILED, ITEM
from askwright.functions.text import opens_with_verb, plain
from askwright.operators.spans import matched, overlapping

ROWS = 500  # documents whose proposals are held as Python values at once
REACH = 300  # characters before a step within which its condition may stand
VAGUE_ROLES = ["other", "unknown", "preamble"]
TECHNICAL = ["err", "evt", "kb", "update", "path", "registry", "command", "url", "menu", "key"]  # kinds of entities
PROPOSED = "doc long, ord int, start int, end int, cond_start int, cond_end int, fail_start int, fail_end int, rejected boolean"


def _placed(text: str, quotes: list, conditions: list, failures: list) -> list[tuple]:
    """(start, end, condition span, failure span) or None of each item, in order: a quote is looked for after the one before."""
    source, cursor, taken, out = Source(text), 0, [(-1, -1)], []
    made = needles([*quotes, *conditions, *failures])
    n = len(quotes)
    for i, (quote, condition, failure) in enumerate(zip(quotes, conditions, failures)):
        span = source.find(quote, cursor, made[i]) if quote and quote.strip() else None
        k = bisect_left(taken, span) if span else 0
        if span is None or taken[k - 1][1] > span[0] or k < len(taken) and taken[k][0] < span[1]:
            out.append(None)
            continue
        taken.insert(k, span)  # in order of place
        cursor = span[1]
        near = max(0, span[0] - REACH)
        before = source.find(condition, near, made[n + i]) if (condition or "").strip() else None
        if before and not (span[0] - REACH <= before[0] and before[1] <= span[1]):
            before = None
        then = source.find(failure, span[1], made[2 * n + i]) if (failure or "").strip() else None
        out.append((span, before or (None, None), then or (None, None)))
    return out


def locate(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """Each proposed quote's place in its document's text: doc, ord, start, end, cond_start, cond_end, fail_start, fail_end, rejected.

    docs: doc, text; proposals: doc, ord, quote, condition, failure.  Quotes are placed in the order of ord, each after the one
    placed before (else anywhere); one that the text lacks, or that overlaps a placed one, is rejected.  A condition counts up to
    300 characters before its quote and within it; a failure is looked for after it.  Proposals for a document that is not
    there, or whose text is null, are rejected.  The order within a document is a fold, so a document's proposals come
    together: they are as many as were made for this one text.
    """
    item = F.struct("ord", "quote", "condition", "failure")
    asked = proposals.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = asked.join(docs.select("doc", "text"), "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"), "items")

    names = [c.split(" ")[0] for c in PROPOSED.split(", ")]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                some = batch.slice(begin, ROWS)
                items, ends = some["items"].flatten(), np.cumsum(pc.list_value_length(some["items"]).to_numpy(zero_copy_only=False)).tolist()
                ords, *asked = (items.field(name) for name in ("ord", "quote", "condition", "failure"))
                asked = [x.to_pylist() for x in asked]
                places, docs = [], np.repeat(np.arange(some.num_rows), np.diff([0, *ends]))
                for text, a, b in zip(some["text"].to_pylist(), [0, *ends], ends):
                    places += _placed(text, *(x[a:b] for x in asked))
                spans = [x and (*x[0], *x[1], *x[2]) or (None,) * 6 for x in places]
                columns = [pa.array(x, pa.int32()) for x in zip(*spans)]
                yield pa.RecordBatch.from_arrays([some["doc"].take(pa.array(docs)), ords, *columns, pa.array([x is None for x in places])], names)

    return rows.mapInArrow(run, PROPOSED)


def kept_instructions(located: DataFrame, docs: DataFrame, rewordings: DataFrame) -> DataFrame:
    """rewordings: doc, ord, instruction.  doc, ord, instruction of those that name nothing technical that their quote lacks; a menu
    path may be named where the quote has its labels."""
    rows = rewordings.join(located.where("NOT rejected"), ["doc", "ord"]).join(docs.select("doc", "text"), "doc")
    technical = lambda column: F.filter(extract_udf(column), lambda e: e["kind"].isin(TECHNICAL))
    told = rows.select("doc", "ord", "instruction", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("quote"))
    said = told.withColumn("own", F.transform(technical(F.col("quote")), lambda e: e["canonical"])).withColumn("new", technical(F.col("instruction")))
    labels = lambda e: F.split(F.regexp_replace(e["canonical"], "^menu:", ""), " > ")
    held = lambda e: (e["kind"] == "menu") & F.forall(labels(e), lambda x: F.contains(plain(F.col("quote")), x))
    added = F.exists("new", lambda e: ~F.array_contains("own", e["canonical"]) & ~held(e))
    return said.where(~added).select("doc", "ord", "instruction")


def merge_steps(proposed: DataFrame, rules: DataFrame) -> DataFrame:
    """The steps of each document: placed proposals with the structure of the rule steps that they match; where a document has
    none, its rule steps.

    proposed: doc, start, end, role, condition, cond_start, fail_start, fail_end; rules: doc, start, end, role, condition, cond_start,
    level, number, after_failure, goto.  A rule's condition, level, number, target and definite role take precedence.
    """
    pairs = matched(proposed, rules).withColumnRenamed("left_start", "start")
    told = rules.select("doc", F.col("start").alias("right_start"), F.struct("role", "condition", "cond_start", "level", "number", "after_failure", "goto").alias("r"))
    joined = proposed.join(pairs, ["doc", "start"], "left").join(told, ["doc", "right_start"], "left")
    r = F.col("r")
    by_rule = r["condition"].isNotNull()
    merged = joined.select(
        "doc", "start", "end", F.when(r["role"].isNotNull() & ~r["role"].isin(VAGUE_ROLES), r["role"]).otherwise(F.col("role")).alias("role"),
        F.when(by_rule, r["condition"]).otherwise(F.col("condition")).alias("condition"), F.when(by_rule, r["cond_start"]).otherwise(F.col("cond_start")).alias("cond_start"),
        F.coalesce(r["level"], F.lit(0)).alias("level"), r["number"].alias("number"), F.coalesce(r["after_failure"], F.lit(False)).alias("after_failure"), r["goto"].alias("goto"),
        "fail_start", "fail_end", F.when(r.isNotNull(), "proposal|rule").otherwise("proposal").alias("sources"),
    )
    bare = rules.join(proposed.select("doc").distinct(), "doc", "left_anti")
    none = F.lit(None).cast("int")
    return merged.unionByName(bare.select("doc", "start", "end", "role", "condition", "cond_start", "level", "number", "after_failure", "goto", none.alias("fail_start"), none.alias("fail_end"), F.lit("rule").alias("sources")))


def link_steps(steps: DataFrame) -> DataFrame:
    """steps of merge_steps(), numbered by their place (n from 1), with goto and on_failure as numbers of steps of the document.

    A step that opens with a failure is where the step before goes when it fails; if such a step sends elsewhere, the step
    before goes there.  A target is the step written with that number, the last of equal ones, else the step of that rank;
    a target that is not there, or the step itself, is null.  A proposal's own failure span leads to the first other step
    that it overlaps.
    """
    doc = Window.partitionBy("doc")
    opens = F.col("condition").rlike("(?iu)" + FAILED) & (F.col("cond_start") >= F.col("start"))
    placed = steps.withColumn("n", F.row_number().over(doc.orderBy("start"))).withColumn("after_failure", F.col("after_failure") | F.coalesce(opens, F.lit(False)))
    placed = placed.withColumn("count", F.count("*").over(doc))
    written = placed.where("number IS NOT NULL").groupBy("doc", F.col("number").alias("goto")).agg(F.max("n").alias("named"))
    to = F.coalesce("named", F.when(F.col("goto").between(1, F.col("count")), F.col("goto")))
    sent = placed.join(written, ["doc", "goto"], "left").withColumn("to", F.when(to != F.col("n"), to))
    failing = placed.where("fail_end > fail_start").select("doc", F.col("fail_start").alias("start"), F.col("fail_end").alias("end"), "n")
    reached = overlapping(failing, placed.select("doc", "start", "end", "n")).where("left.n <> right.n").groupBy("doc", F.col("left.n").alias("n")).agg(F.min("right.n").alias("fails_to"))
    seen = sent.join(reached, ["doc", "n"], "left")
    order = doc.orderBy("n")
    next_failure, next_to = F.lead("after_failure").over(order), F.lead("to").over(order)
    linked = seen.select(
        "*", F.when(next_failure & next_to.isNotNull(), next_to).otherwise(F.coalesce("fails_to", F.when(next_failure, F.col("n") + 1))).alias("on_failure"),
        F.when(~(F.col("after_failure") & (F.col("n") > 1)), F.col("to")).alias("goes_to"),
    )
    return linked.select("doc", "n", "start", "end", "role", "level", "condition", "after_failure", "on_failure", F.col("goes_to").alias("goto"), "sources")


SPACE = r"[\s\x1c-\x1f]"
#: Between sentences: after . ! ? ; and before a capital or a digit, past an opening quote.  Nothing is consumed, so lengths add up.
SENTENCE = rf"(?U)(?<=[.!?;])(?={SPACE}+[\"«(]?[A-ZÀ-ÖØ-Þ0-9])"


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """doc, block, start, text: the lines before the first list item of each paragraph (paragraphs are set apart by blank lines)."""
    line = F.posexplode(F.split("text", "\n"))
    rows = docs.select("doc", line.alias("at", "line"))
    w = Window.partitionBy("doc").orderBy("at")
    placed = rows.withColumn("start", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1)
    blank = F.regexp_replace("line", rf"(?U){SPACE}", "") == ""
    told = placed.withColumn("paragraph", F.sum(blank.cast("int")).over(w)).where(~blank).withColumn("item", F.col("line").rlike(ITEM.pattern))
    within = Window.partitionBy("doc", "paragraph").orderBy("at")
    kept = told.withColumn("items", F.sum(F.col("item").cast("int")).over(within)).where("items = 0")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc", F.col("paragraph").alias("block")).agg(F.min("start").alias("start"), lines.alias("text"))


def sentence_steps(blocks: DataFrame) -> DataFrame:
    """doc, start, end, step: the sentences of blocks (doc, block, start, text) that open with an instruction verb.

    Native columns; start and end are code points of the document, and the document's text from start to end is the step.
    """
    pieces = blocks.select("doc", "block", "start", F.posexplode(F.split("text", SENTENCE)).alias("at", "piece"))
    w = Window.partitionBy("doc", "block").orderBy("at")
    offset = F.col("start") + F.sum(F.length("piece")).over(w) - F.length("piece")
    bare = F.regexp_replace("piece", rf"(?U)^{SPACE}+", "")
    step = F.regexp_replace(bare, rf"(?U){SPACE}+$", "")
    told = pieces.select("doc", (offset + F.length("piece") - F.length(bare)).alias("start"), step.alias("step"))
    return told.where((F.length("step") >= 4) & opens_with_verb(F.col("step"))).select("doc", "start", (F.col("start") + F.length("step")).alias("end"), "step")
