"""Byte-level BPE by a global distinct-word shuffle, and decoding by the token-byte table.

1. Documents are split into pre-tokens.  A chunk of documents (about CHUNK_BYTES of text) becomes one packed row: its
   distinct words in the order of their hashes, and for each document the positions' codes into those words.
2. The hashes are cut into buckets, as many as the chunks' words need at WORD_BYTES each.  The words of a bucket, of all
   chunks, meet in one group, where each distinct word is encoded once.
3. The ids go back to their chunks, where every document is put together again by position.
Only distinct words of a chunk are shuffled, so a word that fills the corpus costs one entry a chunk.
"""

from __future__ import annotations

import base64
import re
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwright.llm.common import materialize_bucketed, partitions, slices

CHUNK_BYTES = 8 << 20
WORD_BYTES = 4 << 20  # of the chunks' words in a bucket, about
#: Fixed value: the characters with the property White_Space.
WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _class(name: str, most: int) -> str:
    """Character-class text of the code points up to `most` with a property, by the tables of the tiktoken library:
    its regular expressions may know another version of Unicode than Python does."""
    import tiktoken

    plain = {bytes([b]): b for b in range(256)}
    points = "".join(chr(c) for c in range(most + 1) if not 0xD800 <= c <= 0xDFFF)
    one = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks=plain, special_tokens={})
    codes = np.fromiter(map(ord, bytes(one.encode_ordinary(points)).decode("utf-8")), np.int64)
    begins = codes[np.diff(codes, prepend=-2) > 1]
    ends = codes[np.diff(codes, append=1 << 30) > 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins.tolist(), ends.tolist()))


def _pattern(most: int) -> re.Pattern:
    """The public pre-token pattern in the syntax of re; letters and numbers up to code point `most`."""
    letters, numbers = _class("L", most), _class("N", most)
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
    )


_made: dict = {}


def _cached(key, make):
    if key not in _made:
        _made[key] = make()
    return _made[key]


def pretokens(text: str) -> list[str]:
    """The matches of the pre-token pattern.  A text within the first plane takes the smaller, faster classes."""
    small = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
    most = 0xFFFF if small else sys.maxunicode
    return _cached(("pattern", most), lambda: _pattern(most)).findall(text)


def read_ranks(path: str) -> bytes:
    """The rank file's content; it is read on the driver and travels with the tasks (a vocabulary is of fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def _ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def _encoder(content: bytes):
    """Encoding whose pattern takes its whole input as one piece."""

    def make():
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(content), special_tokens={})

    return _cached(("encoder", hash(content)), make)


def _byte_table(content: bytes) -> list[bytes]:
    def make():
        ranks = _ranks(content)
        out = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        return out

    return _cached(("bytes", hash(content)), make)


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of small numbers cost nearly nothing."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


PACKED = (
    "chunk string, doc_ids array<bigint>, counts binary, low binary, high binary, frequent binary, n_words int,"
    " word_bytes bigint, lengths binary, content binary"
)


def _pack_chunk(name: str, ids: list, codes: list, vocabulary: list[str]) -> pa.RecordBatch:
    flat = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    n = len(vocabulary)
    raw = [w.encode("utf-8") for w in vocabulary]
    by_word = np.array(sorted(range(n), key=raw.__getitem__), np.int64)
    order = by_word[np.argsort(_hashes([raw[i] for i in by_word.tolist()]), kind="stable")]  # place in the shuffled lists -> word
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # codes: words seen twice or more by falling count, then the rest by place
    counts = np.bincount(flat, minlength=n) if n else np.empty(0, np.int64)
    frequent = np.flatnonzero(counts > 1)
    frequent = place[frequent[np.argsort(-counts[frequent], kind="stable")]]
    code_of_place = np.empty(n, np.uint32)
    code_of_place[_places(frequent, n)] = np.arange(n, dtype=np.uint32)
    coded = code_of_place[place[flat]] if n else flat
    words = b"".join([raw[i] for i in order.tolist()])
    row = {
        "chunk": name,
        "doc_ids": ids,
        "counts": _pack(np.fromiter(map(len, codes), np.uint32, len(codes))),
        "low": _pack((coded & 0xFFFF).astype(np.uint16)),
        "high": _pack((coded >> 16).astype(np.uint16)),
        "frequent": _pack(frequent.astype(np.uint32)),
        "n_words": n,
        "word_bytes": len(words),
        "lengths": _pack(np.fromiter(map(len, raw), np.uint32, n)[order]),
        "content": zstandard.ZstdCompressor(level=3).compress(words),
    }
    kinds = [pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))


def _places(frequent: np.ndarray, n: int) -> np.ndarray:
    """code -> place."""
    rest = np.ones(n, bool)
    rest[frequent] = False
    return np.concatenate([frequent, np.flatnonzero(rest)]).astype(np.int64)


def _chunks(batches, chunk_bytes: int):
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    ids, codes, held = [], [], 0
    vocabulary: dict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    for batch in batches:
        for part in slices(batch, 1):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(doc_id)
                codes.append(np.fromiter(map(vocabulary.__getitem__, pretokens(text or "")), np.uint32))
                held += len(text or "")
                if held >= chunk_bytes:
                    yield _pack_chunk(f"{task}-{made}", ids, codes, list(vocabulary))
                    made, ids, codes, held = made + 1, [], [], 0
                    vocabulary.clear()
    if ids:
        yield _pack_chunk(f"{task}-{made}", ids, codes, list(vocabulary))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words))


def _deal(batches, buckets: int):
    """A chunk's words as one row for each bucket that has any; the buckets are ranges of hashes, so their order is that of the
    chunk's list."""
    for batch in batches:
        for row in batch.to_pylist():
            text = zstandard.ZstdDecompressor().decompress(row["content"])
            lengths = _unpack(row["lengths"], np.uint32)
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).tolist()
            bucket = _hashes([text[a:b] for a, b in zip(ends, ends[1:])]) * buckets >> 32
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            out = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(bucket)]):
                out.append((row["chunk"], int(bucket[lo]), _pack(lengths[lo:hi]), zstandard.ZstdCompressor(level=3).compress(text[ends[lo] : ends[hi]])))
            if out:
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["chunk", "bucket", "lengths", "content"])


def _encode_bucket(rows: pa.Table, content: bytes) -> pa.Table:
    """rows: chunk, bucket, lengths, content.  Each distinct word is encoded once; ids return in each chunk's own order."""
    encode, known = _encoder(content).encode_ordinary, {}
    out = []
    for lengths, packed in zip(rows.column("lengths").to_pylist(), rows.column("content").to_pylist()):
        text = zstandard.ZstdDecompressor().decompress(packed)
        ends = np.cumsum(_unpack(lengths, np.uint32).astype(np.int64)).tolist()
        ids, begin = [], 0
        for end in ends:
            word = text[begin:end]
            begin = end
            if (found := known.get(word)) is None:
                found = known[word] = encode(word.decode("utf-8"))
            ids.append(found)
        counts = np.fromiter(map(len, ids), np.uint32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        out.append((_pack(counts), _pack(flat)))
    return pa.table(
        {
            "chunk": rows.column("chunk"),
            "bucket": rows.column("bucket").cast(pa.int32()),
            "counts": pa.array([x[0] for x in out], pa.binary()),
            "ids": pa.array([x[1] for x in out], pa.binary()),
        }
    )


def _gather(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions begin, begin + 1, ... of each of many runs, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(begins - (ends - counts), counts)


def _assemble(packed: pa.Table, ids: pa.Table) -> pa.Table:
    out_ids, lists = [], []
    for row in packed.to_pylist():
        back = sorted(ids.to_pylist(), key=lambda r: r["bucket"])
        counts = np.concatenate([_unpack(r["counts"], np.uint32) for r in back]).astype(np.int64) if back else np.empty(0, np.int64)
        flat = np.concatenate([_unpack(r["ids"], np.uint32) for r in back]) if back else np.empty(0, np.uint32)
        begins = np.cumsum(counts) - counts
        places = _places(_unpack(row["frequent"], np.uint32).astype(np.int64), row["n_words"])
        coded = _unpack(row["low"], np.uint16).astype(np.int64) | _unpack(row["high"], np.uint16).astype(np.int64) << 16
        at = 0
        for doc_id, n in zip(row["doc_ids"], _unpack(row["counts"], np.uint32).tolist()):
            words = places[coded[at : at + n]]
            at += n
            out_ids.append(doc_id)
            lists.append(flat[_gather(begins[words], counts[words])].astype(np.int32))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate(lists) if lists else np.empty(0, np.int32)
    return pa.table({"id": pa.array(out_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})


def _broadcast(spark: SparkSession, content: bytes):
    return spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, word_bytes: int = WORD_BYTES) -> DataFrame:
    """Rows (id, ids array<int>), one per input row.

    Null text is empty and gives no ids; null and repeated ids are kept as they are; long texts are read whole; an empty table
    gives an empty result; other columns are ignored.
    """
    held = _broadcast(docs.sparkSession, read_ranks(ranks_path))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    packed = materialize_bucketed(rows.mapInArrow(lambda it: _chunks(it, chunk_bytes), PACKED), "pretokens", "chunk", rows_a_file=16)
    total = packed.agg(F.sum("word_bytes")).first()[0] or 0
    buckets = max(16, partitions(docs), -(-total // word_bytes))
    words = packed.select("chunk", "lengths", "content").mapInArrow(lambda it: _deal(it, buckets), "chunk string, bucket int, lengths binary, content binary")
    ids = words.groupBy("bucket").applyInArrow(lambda t: _encode_bucket(t, held.value), "chunk string, bucket int, counts binary, ids binary")
    return (
        packed.drop("word_bytes", "lengths", "content")
        .groupBy("chunk")
        .cogroup(ids.groupBy("chunk"))
        .applyInArrow(_assemble, "id bigint, ids array<int>")
        .select(F.col("id").alias(id_col), "ids")
    )


def decode_ids(ids: list[int], content: bytes) -> bytes:
    return b"".join(map(_byte_table(content).__getitem__, ids))


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, decoded binary): the token-byte table is of fixed size and stands with every task."""
    held = _broadcast(tokens.sparkSession, read_ranks(ranks_path))

    def run(batches):
        for batch in batches:
            decoded = [decode_ids(x or [], held.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["id", "decoded"])

    return tokens.select(F.col(id_col).cast("long").alias("id"), "ids").mapInArrow(run, "id bigint, decoded binary").withColumnRenamed("id", id_col)


def digests(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (little-endian unsigned 32-bit) and decoded_sha256 of encode()'s rows."""
    held = _broadcast(tokens.sparkSession, read_ranks(ranks_path))

    def run(batches):
        from hashlib import sha256

        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            n, a, b = [], [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                ids = flat[lo:hi]
                n.append(hi - lo)
                a.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(sha256(decode_ids(ids.tolist(), held.value)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return tokens.select(F.col(id_col).cast("long").alias("id"), "ids").mapInArrow(run, schema).withColumnRenamed("id", id_col)
