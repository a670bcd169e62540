"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic texts (positive) and from texts whose label is not used (unlabelled).
The risk is corrected by the class prior p, the share of toxic rows among the labelled ones that may be learned from:
    R = p R_P(+) + max(0, R_U(-) - p R_P(-));
where the second part turns negative, which is overfitting, its gradient is reversed (the non-negative estimator).

Learning starts from weights of zero and the prior's log odds as bias, and minimises R by accelerated proximal steps, twice:
with the logistic loss, which is convex, and a penalty on the sum of weights that leaves few features; then, on these, with
the bounded sigmoid loss and nearly no penalty.  Labels of clean documents serve the prior only.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import slices

BITS = 20  # hashed features
PREFIXES = (4, 5, 6, 7, 8)  # a word counts as itself and as its beginnings
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 8_000  # bounds of the training sample, taken by a hash of the id
LEAST_TEXTS = 4  # features in fewer texts of the sample are not learned
PENALTY = 0.03  # on the absolute weight of a feature scaled to unit deviation, while features are chosen
RELAXED = 0.002  # of PENALTY, once they are
CHOOSING, FITTING = 60, 600  # proximal steps of either part
ROUNDS = 20  # of adding features that the penalty would let in
WORD = re.compile(r"[^\W_]+")
_cells: dict[str, tuple] = {}


def _word_cells(word: str) -> tuple:
    raw = [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in raw)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of a text: log(1 + count), damped by the text's length."""
    if len(_cells) > 500_000:
        _cells.clear()
    found = []
    for word in WORD.findall((text or "").lower()):
        if (cells := _cells.get(word)) is None:
            cells = _cells[word] = _word_cells(word)
        found += cells
    cells, counts = np.unique(np.array(found, np.int32), return_counts=True)
    return cells, np.log1p(counts).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        cells, values = features(text)
        z = self.bias + float(self.weights[cells] @ values)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def losses(z: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The losses of calling texts with decision values z toxic and clean, and their slopes in z."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    if kind == "logistic":
        return np.logaddexp(0, -z), np.logaddexp(0, z), s - 1, s
    return 1 - s, s, -s * (1 - s), s * (1 - s)


def risk(z: np.ndarray, positive: np.ndarray, prior: float, kind: str) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk of decision values, the slope that a step goes down, and whether that is the reversed one.

    positive marks the positive texts, the others are unlabelled."""
    p, u = positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    toxic, clean, to_toxic, to_clean = losses(z, kind)
    negative = float((u - prior * p) @ clean)
    if negative < 0:
        return prior * float(p @ toxic), (prior * p - u) * to_clean, True
    return prior * float(p @ toxic) + negative, prior * p * to_toxic + (u - prior * p) * to_clean, False


class _Matrix:
    """Sparse rows of features, centred by means and scaled to unit deviation over the mixture of positive and unlabelled."""

    def __init__(self, row, col, value, n, means):
        self.row, self.col, self.value, self.n, self.means = row, col, value, n, means

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n) - float(self.means @ w)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r.astype(np.float32)[self.row], minlength=len(self.means)) - self.means * r.sum()

    def of(self, chosen: np.ndarray) -> _Matrix:
        number = np.full(len(self.means), -1, np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        col = number[self.col]
        keep = col >= 0
        return _Matrix(self.row[keep], col[keep], self.value[keep], self.n, self.means[chosen])


def descend(x: _Matrix, positive: np.ndarray, prior: float, w: np.ndarray, bias: float, kind: str, penalty: float, steps: int):
    """Weights and bias after accelerated proximal steps down the risk and the penalty; a reversed step drops the pace."""
    share = np.where(positive, prior / max(1, positive.sum()), (1 - prior) / max(1, (~positive).sum()))
    direction, size = np.ones(len(w)), 1e-9
    for _ in range(8):  # the largest curvature, by powers
        direction = x.back(share * x.times(direction / max(1e-12, np.linalg.norm(direction))))
        size = max(1e-9, float(np.linalg.norm(direction)))
    rate, rate_bias = 1 / ((0.25 if kind == "logistic" else 0.1) * size), 4.0
    at, at_bias, pace = w, bias, 1.0
    for _ in range(steps):
        _, slope, reversed_ = risk(x.times(at) + at_bias, positive, prior, kind)
        new = at - rate * x.back(slope)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_bias = at_bias - rate_bias * float(slope.sum())
        pace = 1.0 if reversed_ else pace
        later = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / later
        at, at_bias = new + push * (new - w), new_bias + push * (new_bias - bias)
        w, bias, pace = new, new_bias, later
    return w, bias


def learn(positive: list[str], unlabelled: list[str], prior: float, choosing: int = CHOOSING, fitting: int = FITTING) -> Model:
    """Fit on texts.  Without positive or unlabelled texts the score is the prior for every text."""
    return learn_features([features(t) for t in positive], [features(t) for t in unlabelled], prior, choosing, fitting)


def learn_features(positive: list, unlabelled: list, prior: float, choosing: int = CHOOSING, fitting: int = FITTING) -> Model:
    """learn() on the features() of texts."""
    size = 1 << BITS
    start = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    nothing = Model(np.zeros(size, np.float32), start, prior)
    if not positive or not unlabelled or not 0 < prior < 1:
        return nothing
    found = [*positive, *unlabelled]
    sizes = np.fromiter((len(c) for c, _ in found), np.int64, len(found))
    cells, value = np.concatenate([c for c, _ in found]), np.concatenate([v for _, v in found])
    del found
    used = np.flatnonzero(np.bincount(cells, minlength=size) >= LEAST_TEXTS)
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    col = number[cells]
    keep = col >= 0
    row, col, value = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[keep], col[keep], value[keep]
    if not len(col):
        return nothing
    is_p = np.arange(len(sizes)) < len(positive)
    share = np.where(is_p, prior / len(positive), (1 - prior) / len(unlabelled)).astype(np.float32)
    means = np.bincount(col, value * share[row], minlength=len(used))
    deviation = np.sqrt(np.maximum(np.bincount(col, value * value * share[row], minlength=len(used)) - means * means, 0) + 1e-12)
    x = _Matrix(row, col, (value / deviation[col]).astype(np.float32), len(sizes), means / deviation)
    # features whose slope exceeds the penalty come in, until none is left outside: the rest stays at zero at the optimum
    w, bias, chosen = np.zeros(len(used)), start, np.empty(0, np.int64)
    for _ in range(ROUNDS if choosing else 0):
        slope = x.back(risk(x.of(chosen).times(w[chosen]) + bias, is_p, prior, "logistic")[1])
        more = np.setdiff1d(np.flatnonzero(np.abs(slope) > PENALTY), chosen)
        if not len(more):
            break
        chosen = np.union1d(chosen, more)
        w[chosen], bias = descend(x.of(chosen), is_p, prior, w[chosen], bias, "logistic", PENALTY, choosing)
    chosen = np.flatnonzero(w)
    if not len(chosen):
        return nothing
    fitted, bias = descend(x.of(chosen), is_p, prior, w[chosen], bias, "sigmoid", RELAXED * PENALTY, fitting)
    weights = np.zeros(size, np.float32)
    weights[used[chosen]] = fitted / deviation[chosen]
    return Model(weights, bias - float(x.means[chosen] @ fitted), prior)


def learnable(id_col: str = "doc_id"):
    """Rows whose labels may be used: crc32(id as text) mod 5 is not 0.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on a bounded sample: at most so many confirmed toxic texts and texts without a label, the first by a hash of the
    id, in one task.  Where texts without a label do not fill their part, labelled ones with hidden labels do.  The prior
    counts all labelled rows.  An id with several labels is toxic if one of them says so; of repeated ids the least text
    counts.  Null texts are empty.  Long texts are read whole.  Without documents or labels the score is the prior.
    """
    import pickle

    rows = docs.where(learnable()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = labels.where(learnable()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, all_ = told.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count(F.lit(1))).first()
    prior = min(0.5, max(0.001, (toxic or 0) / all_)) if all_ else 0.001
    # ids are ordered and cut first; what is broadcast are these few ids, and texts outside the sample are never shuffled
    first = lambda ids, n, *keys: F.broadcast(ids.orderBy(*keys, F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id"))
    texts = lambda ids, known: rows.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(known).alias("known"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    positive = texts(first(told.where("toxic = 1"), most_positive), 1)
    marked = labels.select("doc_id", F.lit(1).alias("marked")).distinct()
    free = rows.select("doc_id").distinct().join(marked, "doc_id", "left").select("doc_id", F.coalesce("marked", F.lit(0)).alias("marked"))
    unlabelled = texts(first(free, most_unlabelled, "marked"), 0)

    def featured(batches):
        for batch in batches:
            for part in slices(batch, 2):
                made = [features(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c, _ in made]), pa.array([v.tobytes() for _, v in made])], ["known", "doc_id", "cells", "amounts"])

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["known", "doc_id"], kind="stable")
        made = [[(np.frombuffer(c, np.int32), np.frombuffer(v, np.float32)) for c, v in zip(some["cells"], some["amounts"])] for some in (sample[sample["known"] == 1], sample[sample["known"] == 0])]
        model = learn_features(*made, prior)
        kept = np.flatnonzero(model.weights)
        packed = (kept.astype(np.int32), model.weights[kept], model.bias, model.prior)
        return pd.DataFrame({"model": [pickle.dumps(packed)]})

    # the task that fits gets features and no texts: at most 2^20 cells of a text, however long, and so many texts
    made = positive.unionByName(unlabelled).mapInArrow(featured, "known int, doc_id long, cells binary, amounts binary")
    found = made.groupBy(F.lit(0).alias("all")).applyInPandas(lambda p: fit(p[["known", "doc_id", "cells", "amounts"]]), "model binary").collect()
    if not found:
        return learn([], [], prior)
    kept, values, *rest = pickle.loads(found[0][0])
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = values
    return Model(weights, *rest)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one per input row, repeated rows too; null or empty text has the score of no words, and a long text
    is read whole.  An empty table gives an empty result; other columns are ignored, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, score double").withColumnRenamed("id", id_col)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    found = score(docs, train(docs, labels))
    return found.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
