"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes the hashes of its words (a written table that all later passes read).
2. Document frequencies, then a randomised SVD: the TF-IDF passages of all documents are sketched by random signs into a
   few rows, more than the rank (a count sketch, summed over tasks); their span is the range that holds the latent space, and
   its strongest RANK right singular vectors are the space's axes.  The benchmark has no part in it.
3. Items are cut into pieces of a passage's length at most.  A passage (two blocks of STRIDE words, each block in two
   passages) is a candidate if its latent cosine to a piece is high; of candidates that hold too few of the piece's telling
   words to pass, the checks are left out.
4. A candidate is a leak where the longest common subsequence covers enough of the item and its telling words, the
   answer among them, are there.
The benchmark is a stated query set: it is read in blocks of about BLOCK pieces, each held against all documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import materialize, slices, summed, without

CELLS = 1 << 14
SKETCH = 96  # rows: half as many again as the rank
RANK = 64
STRIDE = 16
BLOCK = 1024
COSINE = 0.35  # of a piece that fills a passage; a shorter piece's falls with the root of its length
LCS = 0.6
ANSWER = 0.6
TELLING = 0.25  # words of this share of the item's highest weight tell it, its answer, apart
NEAR = 0.2  # share of a piece's telling words that a candidate passage itself holds
SHORT = 8  # an item of fewer words leaks only as a whole
WORD = re.compile(r"[^\W_]+")


_rng = np.random.default_rng(1234)
_PLACES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)  # a factor for each place in a word
_LETTER = np.zeros(256, bool)
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyz") + list(range(0x80, 0x100))] = True


def hash_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and how many each text has.

    A word is a run of ASCII letters and digits and other characters from U+00C0 on, but general punctuation."""
    raw = b"\0".join([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]) + b"\0\0\0"
    b = np.frombuffer(raw, np.uint8)
    letter = _LETTER[b]
    sign = np.flatnonzero((b[:-1] == 0xC2) & (b[1:] >= 0xA0) & (b[1:] < 0xC0))
    letter[sign] = letter[sign + 1] = False
    sign = np.flatnonzero((b[:-2] == 0xE2) & ((b[1:-1] == 0x80) | (b[1:-1] == 0x81)))
    letter[sign] = letter[sign + 1] = letter[sign + 2] = False
    edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    borders = np.flatnonzero(b == 0)[: len(texts)] if texts else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(begins, borders), prepend=0)
    if not len(begins):
        return np.empty(0, np.uint32), counts
    at = np.flatnonzero(letter)
    first = np.cumsum(ends - begins) - (ends - begins)
    place = np.arange(len(at)) - np.repeat(first, ends - begins)
    sums = np.add.reduceat(b[at].astype(np.uint64) * _PLACES[place & 255], first)
    sums = (sums ^ (ends - begins).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (sums >> np.uint64(32)).astype(np.uint32), counts


def word_hashes(text: str | None) -> np.ndarray:
    return hash_words([(text or "").replace("\0", " ")])[0]


def words_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                flat, counts = hash_words([t.replace("\0", " ") if t and "\0" in t else t for t in part.column(1).to_pylist()])
                held, ends = flat.tobytes(), (np.cumsum(counts) * 4).tolist()
                rows = [held[a:b] for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["id", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(run, "id bigint, words binary"), "words")


def _arrays(batch) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch, and how many each document has."""
    col = batch.column(1)
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32), np.fromiter((len(x) // 4 for x in col.to_pylist()), np.int64, len(col))


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of float32 arrays, one a task, numbered by salt."""
    return summed(parts.withColumn("key", F.lit("")), size).get("", np.zeros(size))


def document_frequency(words: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches):
        from pyspark import TaskContext

        sums, n = np.zeros(CELLS + 1), 0
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                flat, counts = _arrays(part)
                doc = np.repeat(np.arange(len(counts)), counts)
                seen = np.zeros((len(counts), CELLS), bool)
                seen[doc, flat & (CELLS - 1)] = True
                sums[:CELLS] += seen.sum(axis=0)
                n += len(counts)
        sums[CELLS] = n
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.astype(np.float32).tobytes()])], ["salt", "sums"])

    total = _summed(words.mapInArrow(run, "salt int, sums binary"), CELLS + 1)
    return total[:CELLS], int(total[CELLS])


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its block; of each block its document; of each document its number of blocks."""
    many = -(-counts // STRIDE)
    first = np.cumsum(many) - many
    begins = np.cumsum(counts) - counts
    inside = np.arange(int(counts.sum())) - np.repeat(begins, counts)
    return np.repeat(first, counts) + inside // STRIDE, np.repeat(np.arange(len(counts)), many), many


def sketch(words: DataFrame, idf: np.ndarray) -> np.ndarray:
    """SKETCH x CELLS: each TF-IDF passage of each document is added to one row, with a random sign."""

    def run(batches):
        from pyspark import TaskContext

        sums = np.zeros(SKETCH * CELLS)
        mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for batch in batches:
            for part in slices(batch, 1):
                flat, counts = _arrays(part)
                if not len(flat):
                    continue
                block, doc, many = _blocks(counts)
                # sign and row come from the document's id, the block's number and its first word: the same in any partitioning
                number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                ids = np.array([0 if i is None else i for i in part.column(0).to_pylist()], np.int64).view(np.uint64)
                heads = np.flatnonzero(np.diff(block, prepend=-1))
                mix = mixed(ids[doc] * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) + flat[heads]
                mix = mixed(mix * np.uint64(0x94D049BB133111EB)) >> np.uint64(20)
                row, sign = (mix % np.uint64(SKETCH)).astype(np.int64), np.where(mix >> np.uint64(30) & np.uint64(1), 1.0, -1.0)
                cell = (flat & (CELLS - 1)).astype(np.int64)
                sums += np.bincount(row[block] * CELLS + cell, sign[block] * idf[cell], minlength=SKETCH * CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.astype(np.float32).tobytes()])], ["salt", "sums"])

    return _summed(words.mapInArrow(run, "salt int, sums binary"), SKETCH * CELLS).reshape(SKETCH, CELLS)


@dataclass
class Item:
    item_id: int
    size: int
    masks: dict[int, int]  # word -> the places where the item has it
    telling: frozenset


@dataclass
class Space:
    terms: np.ndarray  # CELLS x rank, idf times the right singular vectors
    pieces: np.ndarray  # pieces x rank, unit rows
    cosine: np.ndarray  # of each piece, the least latent cosine of a candidate passage
    first: np.ndarray  # CELLS + 1: where each cell's pieces begin in told
    told: np.ndarray  # the pieces that each cell's words tell
    need: np.ndarray  # of a piece's telling words, how many a candidate passage holds at least
    known: list[Item]  # of each piece its item


def cut(items: list[tuple[int, np.ndarray]], idf: np.ndarray) -> list[tuple[Item, np.ndarray]]:
    """The items' pieces: even parts of two blocks at most, so that two neighbouring passages cover a copied piece, and the
    whole of longer items."""
    found = []
    for item_id, words in items:
        masks: dict[int, int] = {}
        for at, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << at
        rare = sorted(masks, key=lambda w: (-idf[w & (CELLS - 1)], w))
        worth = [idf[w & (CELLS - 1)] for w in rare]
        telling = sum(x >= TELLING * worth[0] for x in worth)
        item = Item(item_id, len(words), masks, frozenset(rare[: max(3, telling)]))
        parts = np.array_split(words, -(-len(words) // (2 * STRIDE)))
        whole = [words] if len(parts) > 1 else []  # a passage may hold a little of each part
        found += [(item, x) for x in parts + whole if item.telling.intersection(x.tolist())]
    return found


def build_space(pieces: list[tuple[Item, np.ndarray]], sketched: np.ndarray, idf: np.ndarray, rank: int = RANK) -> Space:
    q = np.zeros((len(pieces), CELLS), np.float32)
    pairs, holds, sizes = [], [], np.array([len(words) for _, words in pieces])
    for i, (item, words) in enumerate(pieces):
        cell = words & (CELLS - 1)
        np.add.at(q[i], cell, idf[cell])
        telling = item.telling.intersection(words.tolist())
        holds.append(len(telling))
        pairs += [(w & (CELLS - 1), i) for w in telling]
    rows = sketched.astype(np.float64)
    values, vectors = np.linalg.eigh(rows @ rows.T)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-12 * max(1e-300, values[keep[0]])]
    v = rows.T @ vectors[:, keep] / np.sqrt(values[keep])
    latent = q @ v
    latent /= np.maximum(1e-12, np.linalg.norm(latent, axis=1, keepdims=True))
    cells, told = np.array(sorted(set(pairs)), np.int64).T
    return Space(
        (idf[:, None] * v).astype(np.float32),
        latent.astype(np.float32),
        (COSINE * np.sqrt(np.minimum(1, sizes / (2 * STRIDE)))).astype(np.float32),
        np.searchsorted(cells, np.arange(CELLS + 1)),
        told,
        np.maximum(1, np.ceil(NEAR * np.array(holds) - 1e-9)).astype(np.int64),
        [item for item, _ in pieces],
    )


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel recursion over the item's places."""
    full = (1 << size) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def verify(item: Item, words: np.ndarray, near: int) -> tuple[float, float] | None:
    """Shares of the item's sequence and of its telling words around a block; None if it is no leak."""
    if not item.size:
        return None
    around = words[max(0, near * STRIDE - item.size) : (near + 2) * STRIDE + item.size].tolist()
    told = len(item.telling.intersection(around)) / len(item.telling)
    if told < ANSWER:
        return None
    share = lcs(item.masks, item.size, around) / item.size
    if share < (LCS if item.size >= SHORT else 1.0):
        return None
    return share, told


def candidates(flat: np.ndarray, counts: np.ndarray, space: Space):
    """Yield (document, its block, piece, cosine) of a slice: passages that are near to a piece and hold some of its telling
    words."""
    if not len(flat):
        return
    block, doc, _ = _blocks(counts)
    cells = (flat & (CELLS - 1)).astype(np.int64)
    sums = np.empty((len(doc), space.terms.shape[1]), np.float32)
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    step = 1 << 13  # blocks at a time: their words' rows are held at once
    ends = np.append(heads[1:], len(flat))
    for at in range(0, len(heads), step):
        lo, hi = heads[at], ends[min(at + step, len(heads)) - 1]
        sums[at : at + step] = np.add.reduceat(space.terms[cells[lo:hi]], heads[at : at + step] - lo, axis=0)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    last = np.concatenate([first[1:], [True]])
    sums[:-1][~last[:-1]] += sums[1:][~last[:-1]]  # of a passage: the block's and the next one's, which is not yet changed
    number = np.arange(len(doc)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = ~last | first  # a last block is in the passage before, if there is one
    pieces = len(space.known)
    step = max(16, (1 << 21) // pieces)  # blocks at a time: each has a count for each piece
    for at in range(0, len(doc), step):
        stop = min(at + step, len(doc))
        over = min(stop + 1, len(doc))  # the last passage's second block
        lo, hi = heads[at], ends[over - 1]
        begin = space.first[cells[lo:hi]]
        many = space.first[cells[lo:hi] + 1] - begin
        said = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        hits = np.bincount(np.repeat(block[lo:hi] - at, many) * pieces + space.told[said], minlength=(over - at) * pieces).reshape(over - at, pieces)
        inner = np.flatnonzero(~last[at : over - 1])
        hits[inner] += hits[inner + 1]
        p = sums[at:stop]
        close = (p / np.maximum(1e-12, np.linalg.norm(p, axis=1, keepdims=True))) @ space.pieces.T
        hits = hits[: stop - at]
        i, j = np.nonzero((hits >= space.need) & (close >= space.cosine) & keep[at:stop, None])
        yield from zip(doc[at + i].tolist(), number[at + i].tolist(), j.tolist(), close[i, j].tolist())


def find_leaks(words: DataFrame, space: Space) -> DataFrame:
    held = words.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        space = held.value
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                flat, counts = _arrays(part)
                begins = np.cumsum(counts) - counts
                ids = part.column(0).to_pylist()
                best: dict = {}
                tried: dict = {}
                for d, near, k, close in candidates(flat, counts, space):
                    item = space.known[k]
                    if (d, near, id(item)) not in tried:  # an item's pieces share what is around a passage
                        tried[d, near, id(item)] = verify(item, flat[begins[d] : begins[d] + counts[d]], near)
                    if (found := tried[d, near, id(item)]) is not None:
                        key, value = (d, item.item_id), (found[0], found[1], close, -near)
                        best[key] = max(best.get(key, value), value)
                if best:
                    rows = [(ids[d], item_id, v[0], v[1], v[2], -v[3] * STRIDE) for (d, item_id), v in best.items()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()])],
                        ["id", "item_id", "lcs", "answer", "cosine", "word"],
                    )

    return words.mapInArrow(run, "id bigint, item_id bigint, lcs double, answer double, cosine double, word bigint")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, item_id, lcs, answer, cosine, word) for each document and benchmark item that leaks into it: the best
    passage's shares, its cosine and about where it starts, in words.

    A null text has no words and no leaks; an item without words leaks nowhere; repeated rows give one row; a null id is
    reported as null.  Long texts and items are read whole.  Without documents or items the result is empty.  Other columns
    are ignored.
    """
    words = words_table(docs, id_col, text_col)
    df, n = document_frequency(words)
    idf = np.log1p((n + 1) / (df + 1)) ** 2  # squared: in passages of common words the rare ones decide
    sketched = sketch(words, idf)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.count()
    blocks = max(1, math.ceil(total / (0.8 * BLOCK)))
    leaks = None
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if total else []
        read = [(i, w) for i, t in sorted(some, key=str) if len(w := word_hashes(t))]
        pieces = cut(read, idf)
        for at in range(0, len(pieces), BLOCK):
            found = find_leaks(words, build_space(pieces[at : at + BLOCK], sketched, idf))
            leaks = found if leaks is None else leaks.unionByName(found)
    if leaks is None:
        leaks = words.select("id", F.lit(0).cast("long").alias("item_id"), *[F.lit(0.0).alias(c) for c in ("lcs", "answer", "cosine")], F.lit(0).cast("long").alias("word")).where("false")
    best = leaks.groupBy("id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine", "word")).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", "m.lcs", "m.answer", "m.cosine", "m.word")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no benchmark item leaks into, each judged by its own id and text; a row with a null id
    stays, repeated rows go or stay together."""
    return without(docs, lambda rows: contamination(rows, benchmark, id_col, text_col), id_col, text_col)
