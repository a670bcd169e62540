"""Nearest entries: exact for few entries, through an index of cells for many.

The index cuts the space into cells around centres.  Centres are fitted on a bounded sample (SAMPLE entries, the first by a
hash); every entry is indexed, in the cell of its nearest centre.  How many cells a question looks into is not guessed: the
least number with which questions of the sample find RECALL of their true neighbours is kept with the index, so vectors that
cluster are searched in few cells and vectors without any order in most.

Entries are written as a table bucketed by cell and part; a cell of more than PART entries, such as one full of copies, is cut
into parts by hash, and its questions go to all of them.  A task holds one part and the questions that look into it, so
products are blocks of numpy; it sends on k rows for each question.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwright.operators.graph import written
from askwright.operators.ranking import nearest_entries

EXACT_UP_TO = 5_000  # entries; below, every entry is compared
SAMPLE, ASKED = 20_000, 500  # entries that centres are fitted on; questions among them that settle the number of cells
RECALL, DEPTH = 0.95, 5
MOST_CELLS = 4_096
PART = 50_000  # entries of a part of a cell
ROUNDS = 12
BLOCK = 2_000  # questions multiplied at once


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def fit_cells(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by spherical k-means, started from evenly spaced rows; an empty cell keeps its centre."""
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        at = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, vectors)
        full = np.bincount(at, minlength=cells) > 0
        centres[full] = _unit(sums[full])
    return centres


def needed_probes(vectors: np.ndarray, centres: np.ndarray, recall: float = RECALL, k: int = DEPTH, asked: int = ASKED) -> int:
    """The least number of cells in which sampled questions find `recall` of their k nearest rows."""
    at = (vectors @ centres.T).argmax(axis=1)
    picked = np.linspace(0, len(vectors) - 1, min(asked, len(vectors))).astype(int)
    near = vectors[picked] @ vectors.T
    near[np.arange(len(picked)), picked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    order = np.argsort(np.argsort(-(vectors[picked] @ centres.T), axis=1, kind="stable"), axis=1)  # rank of each cell for each question
    ranks = np.take_along_axis(order, at[best], axis=1)
    return int(next((p for p in range(1, len(centres) + 1) if (ranks < p).mean() >= recall), len(centres)))


@dataclass
class VectorIndex:
    entries: DataFrame  # cell, part, entry, fiche, vector
    parts: DataFrame  # cell, parts: the cells that are cut
    centres: np.ndarray
    probes: int


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """df as a table bucketed by cell and part in the folder that the cluster shares (the warehouse)."""
    made = f"askwright_{name}_{uuid.uuid4().hex}"
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, "cell", "part").saveAsTable(made, format="parquet")
    return df.sparkSession.table(made)


def build(entries: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, part: int = PART) -> VectorIndex:
    """entries: entry, fiche, vector (of one length; null or empty vectors are left out).  Indexes every entry."""
    rows = entries.where("size(vector) > 0").select("entry", "fiche", "vector")
    total = rows.count()
    share = min(1.0, 0.9 * sample / max(1, total))  # by hash, a little below the sample's size: no sort, the same in every run
    taken = rows.where(F.pmod(F.xxhash64("entry"), F.lit(1_000_000_000)) < int(1_000_000_000 * share)).limit(sample).select("vector").toPandas()
    if taken.empty:
        taken = rows.limit(min(sample, 1_000)).select("vector").toPandas()
    fitted = _unit(np.array(taken["vector"].tolist(), np.float64)) if len(taken) else np.zeros((0, 0))
    cells = max(1, min(cells or int(np.sqrt(total)), MOST_CELLS, len(fitted)))
    centres = fit_cells(fitted, cells) if len(fitted) else np.zeros((1, 0))
    held = entries.sparkSession.sparkContext.broadcast(centres)  # at most 4,096 centres

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((np.array(vectors.tolist(), np.float64) @ held.value.T).argmax(axis=1), dtype="int32") if len(vectors) else pd.Series([], dtype="int32")

    assigned = written(rows.withColumn("cell", nearest("vector")), "cells")
    parts = written(assigned.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "parts")
    dealt = assigned.join(parts, "cell").select("cell", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int").alias("part"), "entry", "fiche", "vector")
    return VectorIndex(_bucketed(dealt, "vectors"), parts, centres, needed_probes(fitted, centres, recall) if len(fitted) else 1)


SCORED = "query long, entry long, fiche long, score double"


def _best(questions: pd.DataFrame, entries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best entries of a part for each question: score rounded to 6, lowest entry of equal ones, itself left out."""
    out = []
    if len(questions) and len(entries):
        entries = entries.sort_values("entry", kind="stable")
        known, ids, fiches = np.array(entries["vector"].tolist(), np.float64), entries["entry"].to_numpy(), entries["fiche"].to_numpy()
        for begin in range(0, len(questions), BLOCK):
            some = questions.iloc[begin : begin + BLOCK]
            own = some["query"].to_numpy()
            score = np.round(np.array(some["vector"].tolist(), np.float64) @ known.T, 6)
            score[own[:, None] == ids[None, :]] = -np.inf
            first = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(score, first, axis=1)
            out.append(pd.DataFrame({"query": np.repeat(own, first.shape[1]), "entry": ids[first].ravel(), "fiche": fiches[first].ravel(), "score": found.ravel()}))
    found = pd.concat(out) if out else pd.DataFrame({"query": [], "entry": [], "fiche": [], "score": []})
    return found[found["score"] > -np.inf]


def search(index: VectorIndex, queries: DataFrame, k: int = DEPTH, probes: int | None = None) -> DataFrame:
    """query, entry, fiche, score, rank: the k best entries in the cells nearest to each question.

    queries: query, vector.  A question that is an entry does not find itself; equal scores rank by entry.
    """
    held, probes = queries.sparkSession.sparkContext.broadcast(index.centres), min(probes or index.probes, len(index.centres))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        asked = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)[:, : held.value.shape[1]]
        order = np.argsort(-(asked @ held.value.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(order.astype("int32")))

    asked = queries.where("size(vector) > 0").select("query", "vector", F.explode(nearest("vector")).alias("cell")).join(index.parts, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query", "vector")
    met = asked.groupBy("cell", "part").cogroup(index.entries.groupBy("cell", "part")).applyInPandas(lambda q, e: _best(q, e, k), SCORED)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(queries: DataFrame, entries: DataFrame, k: int = DEPTH) -> DataFrame:
    """The same by comparing every entry: blocks of questions meet parts of the entries, the best of each part first."""
    return nearest_entries(queries, entries, k)


def neighbours(queries: DataFrame, entries: DataFrame, k: int = DEPTH, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Exact where there are at most `exact_up_to` entries, else through an index made of them."""
    if entries.count() <= exact_up_to:
        return exact(queries, entries, k)
    return search(build(entries), queries, k)
