"""Language identification: script ranges narrow the candidates of a word, per-word character n-gram scores and a
switching penalty give the best labelling of the whole text (Viterbi), and runs of equal labels are its spans.

All steps work on arrays of code points of many documents at once; the Viterbi recursion advances all documents of a
slice by one word per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import slices, summed

CELLS = 1 << 16  # hashed n-grams of a language
SWITCH = 9.0  # nats that a change of language costs
SMOOTH = 0.5
SCRIPT_SHARE = 0.01  # a language is a candidate for a script that holds this share of its training letters
SLICE = 2 << 20
#: First code point and name of the script ranges (letters of other blocks count as "other").
SCRIPTS = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFEFF, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_OF_RANGE = np.array([NAMES.index(n) for _, n in SCRIPTS], np.int8)
_tables: dict = {}


def _plane() -> tuple[np.ndarray, np.ndarray]:
    """For the first plane: whether a code point is a letter, and its one-character lower case."""
    if not _tables:
        chars = [chr(c) for c in range(0x10000)]
        _tables["alpha"] = np.array([c.isalpha() for c in chars])
        _tables["lower"] = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32)
    return _tables["alpha"], _tables["lower"]


@dataclass
class Words:
    """The words (runs of letters) of a slice's documents."""

    doc: np.ndarray
    begin: np.ndarray  # code points from the document's start
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray  # of each word, its first place in cells
    cells: tuple[np.ndarray, np.ndarray]  # of each letter, its trigram's and its bigram's cell


def read_words(texts: list) -> Words:
    alpha, lower = _plane()
    raw = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.fromiter((len(r) // 4 + 1 for r in raw), np.int64, len(raw))
    points = np.frombuffer(b"\0\0\0\0" + b"\0\0\0\0".join(raw) + b"\0\0\0\0", np.uint32)
    low = points & 0xFFFF
    letter = alpha[low]
    points = lower[low] if (wide := points > 0xFFFF).sum() == 0 else np.where(wide, points, lower[low])
    if wide.any():
        letter[wide] = [chr(c).isalpha() for c in points[wide].tolist()]
    edge = np.diff(letter.astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    at = np.flatnonzero(letter)
    held = np.where(letter, points, 0).astype(np.uint32)
    a, b, c = held[at - 1] * np.uint32(0x9E3779B1), held[at] * np.uint32(0x85EBCA77), held[at + 1] * np.uint32(0xC2B2AE3D)
    two = (a ^ (b << np.uint32(7))) * np.uint32(0x27D4EB2F)
    three = (a ^ (b << np.uint32(7)) ^ (c << np.uint32(13) | c >> np.uint32(19))) * np.uint32(0x165667B1)
    starts = 1 + np.cumsum(lengths) - lengths
    doc = np.searchsorted(starts, begins, "right") - 1
    first = np.cumsum(ends - begins) - (ends - begins)
    script = _OF_RANGE[np.searchsorted(_STARTS, points[begins], "right") - 1] if len(begins) else np.empty(0, np.int8)
    return Words(doc, begins - starts[doc] if len(doc) else begins, ends - starts[doc] if len(doc) else ends, script, first, (three >> np.uint32(16), two >> np.uint32(16)))


@dataclass
class Model:
    langs: list[str]  # sorted
    scores: np.ndarray  # [3-gram, 2-gram][cell, language], log probability
    allowed: np.ndarray  # [script, language]
    usual: int  # the most frequent language


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Counts of n-grams over all given rows with text and language; what reaches the driver is a table of fixed size a
    language.  None without such rows."""
    width = 2 * CELLS + len(NAMES) + 1

    def count(batches):
        from pyspark import TaskContext

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                langs = part.column(1).to_pylist()
                words = read_words(part.column(0).to_pylist())
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.int64)
                sizes = words.end - words.begin
                of_word = number[words.doc]
                of_letter = np.repeat(of_word, sizes)
                for k, name in enumerate(names):
                    mine = of_letter == k
                    total = sums.setdefault(name, np.zeros(width))
                    total[:CELLS] += np.bincount(words.cells[0][mine], minlength=CELLS)
                    total[CELLS : 2 * CELLS] += np.bincount(words.cells[1][mine], minlength=CELLS)
                    mine = of_word == k
                    total[2 * CELLS : -1] += np.bincount(words.script[mine], sizes[mine], minlength=len(NAMES))
                    total[-1] += (number == k).sum()
        if sums:
            task = pa.array(np.full(len(sums), TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), task, pa.array([v.tobytes() for v in sums.values()])], ["key", "salt", "sums"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = sorted(summed(rows.mapInArrow(count, "key string, salt int, sums binary"), width, "float64").items())
    if not found:
        return None
    tables, allowed = [], []
    for _, sums in found:
        logs = []
        for part in (sums[:CELLS], sums[CELLS : 2 * CELLS]):
            logs.append(np.log((part + SMOOTH) / (part.sum() + SMOOTH * CELLS)))
        tables.append(logs)
        letters = sums[2 * CELLS : -1]
        allowed.append(letters >= max(1, SCRIPT_SHARE * letters.sum()))
    scores = np.ascontiguousarray(np.array(tables).transpose(1, 2, 0).astype(np.float32))
    return Model([n for n, _ in found], scores, np.array(allowed).T.copy(), int(np.argmax([s[-1] for _, s in found])))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """[word, language]; -inf where the script excludes the language; zeros where it excludes all."""
    n = len(words.doc)
    out = np.zeros((n, len(model.langs)), np.float32)
    if not n:
        return out
    for k in range(len(model.langs)):
        letters = model.scores[0][:, k][words.cells[0]] + model.scores[1][:, k][words.cells[1]]
        out[:, k] = np.add.reduceat(letters, words.first) * 0.5
    candidates = model.allowed[words.script]
    out[~candidates] = -np.inf
    out[~candidates.any(axis=1)] = 0
    return out


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word; words of a document are consecutive.  Ties go to the earlier language, then to no switch."""
    n, langs = scores.shape
    labels = np.zeros(n, np.int64)
    if not n:
        return labels
    lengths = np.bincount(doc, minlength=n_docs)
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], begins[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # documents longer than t
    came = np.empty((n, langs), np.int16)
    own = np.arange(langs)
    best = scores[begins[: active[0]]].copy()
    for t in range(1, int(lengths[0])):
        k = active[t]
        before = best[:k]
        top = before.argmax(axis=1)
        other = before[np.arange(k), top] - penalty
        stay = before >= other[:, None]
        at = begins[:k] + t
        came[at] = np.where(stay, own, top[:, None])
        now = np.where(stay, before, other[:, None]) + scores[at]
        now -= now.max(axis=1, keepdims=True)  # keeps the sums small in long texts
        best[:k] = now
    state = best.argmax(axis=1)  # of each document at its last word
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = active[t]
        at = begins[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return labels


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """Rows (id, lang_pred, score, spans array<struct<start,end,lang>>), one per input row.

    lang_pred is the language of most labelled letters (ties: the first by name), score its share of them; spans are code
    points, end exclusive.  Words in scripts of no learned language stay unlabelled; a text with such letters only gets
    the most frequent learned language at score 0.  Null text, a text without letters, or no model: `und` at score 0.
    Repeated rows are repeated, long texts are read whole, an empty table gives an empty result; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = held.value
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts = part.column(1).to_pylist()
                preds, scores, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                words = read_words(texts)
                if model is not None and len(words.doc):
                    labels = viterbi(word_scores(words, model), words.doc, len(texts), penalty)
                    known = model.allowed[words.script].any(axis=1)
                    letters = np.zeros((len(texts), len(model.langs)))
                    np.add.at(letters, (words.doc[known], labels[known]), (words.end - words.begin)[known])
                    top = letters.argmax(axis=1)
                    total = letters.sum(axis=1)
                    for i in np.unique(words.doc).tolist():
                        preds[i] = model.langs[int(top[i])] if total[i] else model.langs[model.usual]
                        scores[i] = letters[i, top[i]] / total[i] if total[i] else 0.0
                    doc, begin, end, label = words.doc[known], words.begin[known], words.end[known], labels[known]
                    if len(doc):
                        new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(label) != 0)]))
                        last = np.concatenate([new[1:] - 1, [len(doc) - 1]])
                        for i, s, e, k in zip(doc[new].tolist(), begin[new].tolist(), end[last].tolist(), label[new].tolist()):
                            spans[i].append({"start": s, "end": e, "lang": model.langs[k]})
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(preds), pa.array(scores), pa.array(spans, kind)], ["id", "lang_pred", "score", "spans"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 4 is 2; a null id is never learned from, so it counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans: the model learns from text and lang of the rows not held out."""
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
