"""Licence scans by ordered signature rules (DataFrame operations only).

Keywords decide which texts, and which rules of a text, are tried at all.  A rule finds all its places; of two detections
where one's words contain the other's, the weaker or later one is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.llm.common import ascii_lower
from askwright.llm.license_rules import rules

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.4}
OPEN, CLOSE = "\x01", "\x02"  # separators never occur in a joined text


def spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def places(joined: Column, pattern: Column) -> Column:
    """array<struct<start,end>> in words: the leftmost non-overlapping matches from word start to word end.

    joined is ' word word ... word '.  Matches are bracketed in one pass, and the words that carry a bracket are numbered.
    """
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def numbered(words: Column) -> Column:
        at = lambda told, less: F.filter(F.transform(words, lambda w, i: F.when(told(w), i - less)), lambda i: i.isNotNull())
        starts, ends = at(lambda w: F.startswith(w, F.lit(OPEN)), 1), at(lambda w: F.endswith(w, F.lit(CLOSE)), 0)
        return F.zip_with(starts, ends, lambda x, y: F.struct(x.alias("start"), y.alias("end")))

    marked = F.regexp_replace(joined, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), OPEN + "$0" + CLOSE)
    return let(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), let(F.split(m, " ", -1), numbered)).otherwise(none))


def trie(words: list[str]) -> str:
    """One regular expression for many words, which reads common beginnings once; of a word and its beginnings the longest."""
    ends, by_first = "" in words, {}
    for w in words:
        if w:
            by_first.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + trie(rest) for c, rest in sorted(by_first.items())]
    if not branches:
        return ""
    whole = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return whole + "?" * ends


def unsuppressed(items: DataFrame) -> DataFrame:
    """items: __row and d (start, end, priority, rule, label; priority 0: a base place), d null in a row without any.  Adds
    kept: no detection of the same or a stronger priority contains this one; base places are always kept.

    In the order start, falling end, priority, rule every container comes first, so the farthest end so far of each
    priority tells whether one contains the next; of equal spans and priorities the first rule stays.
    """
    order = Window.partitionBy("__row").orderBy("d.start", F.desc("d.end"), "d.priority", "d.rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    far = [F.when(F.col("d.priority") >= k, F.max(F.when(F.col("d.priority") == k, F.col("d.end"))).over(before)) for k in CONFIDENCE]
    return items.withColumn("kept", (F.col("d.priority") == 0) | F.coalesce(F.greatest(*far) < F.col("d.end"), F.lit(True)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, base array<struct<start,end,label>>, detections array<struct<start,end,label,priority,rule>>).

    A-Z are lower-cased, words are runs of other characters than ASCII punctuation, white space and controls; starts and
    ends count words.  Null text is empty: no words, no detections.  One row per input row, repeated ones too; long texts are
    read whole, in time and memory proportional to them; an empty table gives an empty result; other columns are ignored.
    """
    table = rules()
    keywords = sorted({k for _, _, k, _ in table})  # at a word's start: as mere substrings the short ones are everywhere
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("__id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"))
    # a generator between the projections: the joined text is made once a row, whatever refers to it
    joined = rows.select("__row", "__id", F.explode(F.array(F.concat(F.lit(" "), F.trim(F.regexp_replace("__low", SEPARATORS, " ")), F.lit(" ")))).alias("__joined"))
    hits = F.array_distinct(F.regexp_extract_all("__joined", F.lit(f" (?=({trie(keywords)}))"), F.lit(1)))  # the longest at each word
    n_words = F.when(F.col("__joined") == "  ", F.lit(0)).otherwise(spaces(F.col("__joined")) - 1)
    gated = joined.select("__row", "__id", n_words.cast("long").alias("n_words"), "__joined", F.explode(F.array(hits)).alias("__hits"))
    longer = {k: [x for x in keywords if x.startswith(k)] for k in keywords}
    rule_array = F.from_json(
        F.lit(json.dumps([{"rule": i, "label": a, "priority": p, "keywords": longer[k], "pattern": x} for i, (a, p, k, x) in enumerate(table)], ensure_ascii=False)),
        "array<struct<rule:int,label:string,priority:int,keywords:array<string>,pattern:string>>",
    )
    tried = F.filter(rule_array, lambda r: F.arrays_overlap(F.col("__hits"), r["keywords"]))

    def told(pattern: Column, priority: Column, rule: Column, label: Column) -> Column:
        return F.transform(
            places(F.col("__joined"), pattern),
            lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), priority.alias("priority"), rule.alias("rule"), label.alias("label")),
        )

    found = F.flatten(F.transform(tried, lambda r: told(r["pattern"], r["priority"], r["rule"], r["label"])))
    base = F.flatten(F.array(*[told(F.lit(words), F.lit(0), F.lit(-1), F.lit(label)) for words, label in BASE.items()]))
    none = F.expr("cast(array() as array<struct<start:int,end:int,priority:int,rule:int,label:string>>)")
    items = gated.select(
        "__row",
        "__id",
        "n_words",
        F.explode_outer(F.when(F.size("__hits") > 0, F.concat(base, found)).otherwise(none)).alias("d"),
    )
    judged = unsuppressed(items)
    return (
        judged.groupBy("__row")
        .agg(
            F.first("__id").alias(id_col),
            F.first("n_words").alias("n_words"),
            F.sort_array(F.collect_list(F.when(F.col("d.priority") == 0, F.struct("d.start", "d.end", "d.label")))).alias("base"),
            F.sort_array(F.collect_list(F.when(F.col("kept") & (F.col("d.priority") > 0), F.struct("d.start", "d.end", "d.label", "d.priority", "d.rule")))).alias("detections"),
        )
        .drop("__row")
    )


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, places, labels and score of scan()'s rows; the score is the strongest detection's confidence."""
    once = scanned.select(id_col, "n_words", F.explode(F.array(F.struct("base", "detections"))).alias("s"))
    starts = F.transform("s.base", lambda b: b["start"].cast("long"))
    base_labels = F.array_sort(F.array_distinct(F.transform("s.base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("s.detections", lambda d: d["label"])))
    worth = F.transform("s.detections", lambda d: F.when(d["priority"] == 1, CONFIDENCE[1]).when(d["priority"] == 2, CONFIDENCE[2]).otherwise(CONFIDENCE[3]))
    return once.select(
        id_col,
        "n_words",
        F.size("s.base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(worth), F.lit(0.0)), F.when(F.size("s.base") > 0, F.lit(CONFIDENCE[2])).otherwise(0.0)).alias("score"),
    )
