"""The graph of articles: shingles, near duplicates, groups, numbers, references, replacement."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions.text import search_tokens

NUMBER = r"(?i)\bKB\s?[-_]?0*(\d{1,7})\b"
REPLACES = r"(?i)\b(?:annule et remplace|remplace|replaces|supersedes)\b[^.\n]{0,40}?\bKB\s?[-_]?0*(\d{1,7})\b"
REPLACED_BY = r"(?i)\b(?:remplac[ée]e? par|obsol[eè]te[^.\n]{0,20}?par|replaced by|superseded by)\b[^.\n]{0,40}?\bKB\s?[-_]?0*(\d{1,7})\b"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the folder that the cluster shares (spark.checkpoint.dir), read again: short lineage, safe from lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="askwright-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/askwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


WIDTH, MIXED = 5, np.uint64(0x9E3779B97F4A7C15)  # tokens of a shingle; an odd factor
ROWS = 500  # texts held as Python values at once


def shingles(bags: list[list[str]], width: int = WIDTH) -> list[np.ndarray]:
    """Of each bag of tokens, the sorted distinct hashes of its sequences of `width` tokens; a shorter one is one sequence, an
    empty one has none."""
    codes, known = pd.factorize(np.array([t for bag in bags for t in bag], object))
    hashes = pd.util.hash_array(np.asarray(known, object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * MIXED + hashes[k : k + len(rolled)]
    out, begin = [], 0
    for bag in bags:
        end = begin + len(bag)
        if 0 < len(bag) < width:
            whole = np.uint64(len(bag))  # sequences of other lengths are others
            for h in hashes[begin:end]:
                whole = whole * MIXED + h
            out.append(np.array([whole]).view(np.int64))
        else:
            out.append(np.unique(rolled[begin : max(begin, end - width + 1)].view(np.int64)))
        begin = end
    return out


def shingle_sets(texts: DataFrame) -> DataFrame:
    """doc, number, h, n, s of texts (doc, number, text) that have a token: the set of shingles, its size and a digest of it."""
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS):
                    some = batch.slice(begin, ROWS)
                    sets = shingles([search_tokens(t or "") for t in some["text"].to_pylist()])
                    kept = [i for i, s in enumerate(sets) if len(s)]
                    sets = [sets[i] for i in kept]
                    sizes, digests = [len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=32).digest() for s in sets]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                    at = pa.array(kept, pa.int64())
                    yield pa.RecordBatch.from_arrays([some["doc"].take(at), some["number"].take(at), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), lists], ["doc", "number", "h", "n", "s"])

    return texts.mapInArrow(run, f"doc {kind}, number string, h binary, n int, s array<bigint>")


def similar_pairs(docs: DataFrame, id_col: str, text: Column, least: float = 0.8, number: Column | None = None, same_number: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b with their Jaccard, membership doc -> rep).  number: two texts of one number are a pair from same_number on.

    Texts with equal shingle sets are one representative (their least id), so copies are never expanded into pairs.  Of a
    set of n shingles in order of rarity, two sets as similar as `least` share one of the first n - ceil(least n) + 1:
    only these are joined, so a shingle that fills the corpus, which comes last, joins nothing.

    All shingles are dealt out once, by shingle, to be counted.  Those of one set only join nothing and are in no other set: they
    are left out from there on, so pairs are measured by the others and the sizes of the whole sets.
    """
    own = F.lit(None).cast("string") if number is None else number.cast("string")
    sets = shingle_sets(docs.select(F.col(id_col).alias("doc"), own.alias("number"), text.alias("text")))
    keyed = written(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    members = keyed.groupBy("h").agg(F.min(F.struct("doc", "row")).alias("m")).select("h", F.col("m.doc").alias("rep"), F.col("m.row").alias("row"))
    membership = keyed.select("doc", "h").join(members, "h").select("doc", "rep")
    chosen = written(members.groupBy("rep").agg(F.min("row").alias("row")).select("row"), "reps")
    shingled = keyed.join(chosen, "row", "left_semi").select("doc", "n", F.explode("s").alias("x"))
    shared = shingled.withColumn("df", F.count("*").over(Window.partitionBy("x"))).where("df > 1")
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("df", "x"))), lambda o: o["x"])
    ordered = written(shared.groupBy("doc", "n").agg(rarest.alias("o")), "ordered")

    def candidates(rows: DataFrame, level: float, keys: list[str]) -> DataFrame:
        # shingles of one set only are the rarest: they take places of the prefix and join nothing
        room = F.col("n") - F.ceil(F.lit(level) * F.col("n")).cast("int") + 1 - (F.col("n") - F.size("o"))
        prefix = rows.where(room > 0).select("doc", "n", *keys[1:], F.explode(F.slice("o", F.lit(1), room)).alias("x"))
        left, right = prefix.select(F.col("doc").alias("a"), F.col("n").alias("na"), *keys), prefix.select(F.col("doc").alias("b"), F.col("n").alias("nb"), *keys)
        close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= level * F.greatest("na", "nb"))
        return left.join(right, keys).where(close).select("a", "b", F.lit(level).alias("level"))

    found = candidates(ordered, least, ["x"])
    if number is not None:
        numbers = keyed.where("number is not null").select("h", "number").join(members, "h").select(F.col("rep").alias("doc"), "number").distinct()
        found = found.unionByName(candidates(ordered.join(numbers, "doc"), same_number, ["x", "number"]))
    found = found.groupBy("a", "b").agg(F.min("level").alias("level"))
    side = lambda c: ordered.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("o").alias(f"o{c}"))
    both = F.size(F.array_intersect("oa", "ob"))
    pairs = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "level", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= F.col("level")).select("a", "b", "jaccard"), membership


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable.  Stars are drawn to ever smaller centres, each round a written table."""
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def own_numbers(fiche_id: Column, title: Column) -> Column:
    first = lambda c: F.nullif(F.regexp_extract(c, NUMBER, 1), F.lit(""))
    return F.coalesce(first(fiche_id), first(title)).cast("long")


def canonical_pick(members: DataFrame) -> DataFrame:
    """members: grp, fiche_id, status, n_steps, numbered.  The canonical fiche of each group: status, most steps, numbered, id."""
    rank = F.when(F.col("status") == "guided", 0).when(F.col("status") == "citable", 1).otherwise(2)
    w = Window.partitionBy("grp").orderBy(rank, F.desc("n_steps"), F.desc("numbered"), "fiche_id")
    return members.withColumn("k", F.row_number().over(w)).where("k = 1").select("grp", F.col("fiche_id").alias("canonical"))


def number_conflicts(fiches: DataFrame) -> DataFrame:
    """fiches: canonical, number.  Numbers that two canonical fiches hold."""
    return fiches.where("number is not null").groupBy("number").agg(F.array_sort(F.collect_set("canonical")).alias("holders")).where(F.size("holders") > 1)


def references(fiches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fiches: fiche_id, canonical, number, text, prerequisite_text.  (references with their prerequisite mark, missing numbers)."""
    cited = fiches.select("fiche_id", "canonical", F.col("number").alias("own"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER), 1))).alias("c"), "prerequisite_text")
    cited = cited.select("fiche_id", "canonical", F.col("c").cast("long").alias("number"), "own", F.array_contains(F.transform(F.regexp_extract_all("prerequisite_text", F.lit(NUMBER), 1), lambda x: x.cast("long")), F.col("c").cast("long")).alias("prerequisite"))
    cited = cited.where("own is null or number <> own")
    holders = fiches.where("number is not null").select("number", F.col("canonical").alias("target")).distinct()
    missing = cited.join(holders, "number", "left_anti").select("fiche_id", "number").distinct()
    found = cited.join(holders, "number").where("target <> canonical").groupBy("fiche_id", "target").agg(F.max("prerequisite").alias("prerequisite"))
    return found, missing


def replacements(fiches: DataFrame) -> DataFrame:
    """(fiche, superseded_by) from the sentences of either direction."""
    holders = fiches.where("number is not null").select("number", F.col("canonical").alias("target")).distinct()
    def said(pattern: str, replaces: bool) -> DataFrame:
        rows = fiches.select("fiche_id", "canonical", F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("c")).select("fiche_id", "canonical", F.col("c").cast("long").alias("number"))
        hit = rows.join(holders, "number").where("target <> canonical")
        return hit.select(F.col("target").alias("fiche"), F.col("fiche_id").alias("superseded_by")) if replaces else hit.select(F.col("fiche_id").alias("fiche"), F.col("target").alias("superseded_by"))
    return said(REPLACES, True).unionByName(said(REPLACED_BY, False)).distinct()


def prune(lists: DataFrame, canonical: DataFrame, superseded: DataFrame) -> DataFrame:
    """lists: query, ord, fiche.  Duplicates become their canonical fiche, a superseded one its smallest replacement (one hop);
    the first occurrence stays."""
    one = superseded.groupBy("fiche").agg(F.min("superseded_by").alias("to"))
    step = lists.join(canonical, "fiche", "left").select("query", "ord", F.coalesce("canonical", "fiche").alias("fiche"))
    step = step.join(one, "fiche", "left").select("query", "ord", F.coalesce("to", "fiche").alias("fiche"))
    return step.groupBy("query", "fiche").agg(F.min("ord").alias("ord"))
