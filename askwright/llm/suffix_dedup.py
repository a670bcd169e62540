"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows its common prefixes.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a smaller id.

Which suffixes are sorted: every window of LENGTH bytes has an anchor, the least hash of its MER-byte strings, so equal
windows have equal anchors at equal places, and consecutive windows of one anchor form a segment.  Anchors that occur
once in all documents cannot be part of a repeat; sorted runs of their hashes find these, and they are left out.
Of the others, each segment is the suffix that begins at its anchor, followed by its left context, read backwards.

Sorting: a chunk of documents sorts its suffixes and writes runs, front-coded (the length of the prefix shared with the
suffix before, and the rest).  A bucket merges the runs of all chunks by a loser tree that keeps, for each loser, the
prefix it shares with its winner, so known prefixes are never compared again; the merge gives the order and the common
prefixes of neighbours.  Suffixes that share LENGTH - o bytes are neighbours, and those among them with equal o bytes of
left context hold the same window: the least id of each such group decides the windows of the others, exactly.

Skew: a chunk sends equal segments once, with their least id.  Anchors with very many occurrences (the edges of a
passage that fills the corpus) are not kept together: their windows are dealt out singly, by content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwright.llm.common import materialize, materialize_bucketed, partitions, slices

LENGTH = 50
MER = 24
SPAN = LENGTH - MER + 1  # anchors that a window chooses from
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text for each bucket, about: buckets are as many as the text needs
SLICE = 1 << 20  # bytes whose hashes are held at once
HOT = 20_000  # occurrences beyond which an anchor's windows are dealt out singly
LAST = np.iinfo(np.int64).max  # stands for a null id, which is after all others
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _squeeze(a: np.ndarray, level: int = 1) -> bytes:
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) if len(a) else a
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def _expand(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


def _mix(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes that three words hold."""
    h = x * C[0]
    y = y * C[1]
    h ^= (y >> np.uint64(13)) | (y << np.uint64(51))
    z = z * C[2]
    h ^= (z >> np.uint64(27)) | (z << np.uint64(37))
    h *= C[3]
    h ^= h >> np.uint64(32)
    return h * C[0]


def _all_hashes(raw: bytes, n: int) -> np.ndarray:
    """Upper halves of the hashes of the MER bytes at 0 .. n - 1."""
    padded = raw + bytes(48)
    words = np.empty(n + 16, np.uint64)
    for r in range(8):
        part = words[r::8]
        part[:] = np.frombuffer(padded, np.uint64, len(part), offset=r) if r + 8 * len(part) <= len(padded) else 0
    return (_mix(words[:n], words[8 : n + 8], words[16 : n + 16]) >> np.uint64(32)).astype(np.uint32)


def _hashes_at(raw: bytes, at: np.ndarray) -> np.ndarray:
    """48-bit hashes of the MER bytes at some places."""
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), MER)
    out = np.empty(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 17):
        w = np.ascontiguousarray(view[at[lo : lo + (1 << 17)]]).view(np.uint64)
        out[lo : lo + (1 << 17)] = _mix(w[:, 0], w[:, 1], w[:, 2]) >> np.uint64(16)
    return out


def segments(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of the documents in order: segments of consecutive windows with one anchor, as number of windows
    less one, and place of the anchor after the first window's start."""
    n = len(raw)
    if n < LENGTH:
        return np.empty(0, np.uint8), np.empty(0, np.uint8)
    h = _all_hashes(raw, n - MER + 1)
    # least of 1, 2, 4, 8, 16 neighbours and its place; the left one of equals
    place = np.arange(len(h), dtype=np.int32)
    size = 1
    while size * 2 <= SPAN:
        later = h[size:] < h[:-size]
        place = np.where(later, place[size:], place[:-size])
        h = np.where(later, h[size:], h[:-size])
        size *= 2
    shift = SPAN - size
    place = np.where(h[shift:] < h[:-shift], place[shift:], place[:-shift])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    windows = np.maximum(lengths - LENGTH + 1, 0)
    starts = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    if not len(starts):
        return np.empty(0, np.uint8), np.empty(0, np.uint8)
    anchor = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
    return (np.diff(np.append(first, len(starts))) - 1).astype(np.uint8), (anchor[first] - starts[first]).astype(np.uint8)


def _by_bucket(bucket: np.ndarray):
    """Yield the buckets that occur, in order, and the places of each."""
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        yield int(bucket[order[lo]]), order[lo:hi]


PACKED = "chunk string, n_bytes bigint, doc_ids array<bigint>, lengths binary, content binary, widths binary, offsets binary"


def _pack_chunk(name: str, ids: list, parts: list) -> pa.RecordBatch:
    """parts: (bytes, lengths, widths, offsets) of consecutive slices."""
    cat = lambda k, kind: np.concatenate([p[k] for p in parts]).astype(kind)
    values = [
        pa.array([name]),
        pa.array([sum(len(p[0]) for p in parts)], pa.int64()),
        pa.array([ids], pa.list_(pa.int64())),
        pa.array([_squeeze(cat(1, np.uint32))], pa.binary()),
        pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(p[0] for p in parts))], pa.binary()),
        pa.array([_squeeze(cat(2, np.uint8))], pa.binary()),
        pa.array([_squeeze(cat(3, np.uint8))], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(values, ["chunk", "n_bytes", "doc_ids", "lengths", "content", "widths", "offsets"])


def _chunks(batches, chunk_bytes: int):
    from pyspark import TaskContext

    task, made, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for part in slices(batch, 1, SLICE):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            raw = b"".join(texts)
            ids += part.column(0).to_pylist()
            parts.append((raw, lengths, *segments(raw, lengths)))
            held += len(raw)
            if held >= chunk_bytes:
                yield _pack_chunk(f"{task}-{made}", ids, parts)
                made, ids, parts, held = made + 1, [], [], 0
    if ids:
        yield _pack_chunk(f"{task}-{made}", ids, parts)


class Chunk:
    """A packed row, opened: bytes, documents, and of each segment its document, first window, last window and anchor."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.keys = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.lengths = _expand(row["lengths"], np.uint32).astype(np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(row["content"])
        widths = _expand(row["widths"], np.uint8).astype(np.int64) + 1
        self.begins = np.cumsum(self.lengths) - self.lengths
        windows = np.maximum(self.lengths - LENGTH + 1, 0)
        before = np.cumsum(windows) - windows
        first = np.cumsum(widths) - widths  # number of the segment's first window among all
        self.doc = np.searchsorted(before + windows, first, "right")
        self.a = self.begins[self.doc] + first - before[self.doc] if len(first) else first
        self.b = self.a + widths - 1
        self.p = self.a + _expand(row["offsets"], np.uint8)
        self.hash = _hashes_at(self.raw, self.p) if len(self.p) else np.empty(0, np.uint64)
        self.anchors, self.of, self.many = np.unique(self.hash, return_inverse=True, return_counts=True)


def anchor_runs(batches, buckets: int):
    """For each chunk and bucket, the sorted run of its anchors' hashes, as differences, and how often each occurs."""
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk(row)
            bucket = (chunk.anchors % np.uint64(buckets)).astype(np.int64)
            out = []
            for k, mine in _by_bucket(bucket):
                rest = chunk.anchors[mine] // np.uint64(buckets)
                out.append((row["chunk"], k, _squeeze(np.diff(rest, prepend=np.uint64(0))), _squeeze(np.minimum(chunk.many[mine], 65535).astype(np.uint16))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int32(), pa.binary(), pa.binary()])], ["chunk", "bucket", "run", "many"])


def anchor_answers(rows: pa.Table, hot: int) -> pa.Table:
    """For each anchor of each run: 0 alone, 1 repeated, 2 repeated very often."""
    runs = [np.cumsum(_expand(x, np.uint64)) for x in rows.column("run").to_pylist()]
    many = np.concatenate([_expand(x, np.uint16) for x in rows.column("many").to_pylist()])
    _, of = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.bincount(of, many)
    told = ((total > 1).astype(np.uint8) + (total > hot))[of].astype(np.uint8)
    cuts = np.cumsum([0, *map(len, runs)])
    return pa.table(
        {"chunk": rows.column("chunk"), "bucket": rows.column("bucket").cast(pa.int32()), "answer": pa.array([_squeeze(told[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())}
    )


class Suffixes:
    """The distinct suffixes and single windows that a chunk sends, the same whenever they are made again.

    entries[mode]: sorted list of keys; a key of mode 0 is (text from the anchor + reversed left context, length of the
    former), of mode 1 (window, LENGTH); least[mode]: the least id of each; members[mode]: (segment or window start, entry)."""

    def __init__(self, chunk: Chunk, answers: list[dict], buckets: int):
        flags = np.zeros(len(chunk.anchors), np.uint8)
        places = dict(_by_bucket((chunk.anchors % np.uint64(buckets)).astype(np.int64)))
        for r in answers:
            flags[places[r["bucket"]]] = _expand(r["answer"], np.uint8)
        of_segment = flags[chunk.of] if len(chunk.of) else np.empty(0, np.uint8)
        raw = chunk.raw
        usual = np.flatnonzero(of_segment == 1)
        a, b, p = chunk.a[usual].tolist(), chunk.b[usual].tolist(), chunk.p[usual].tolist()
        keys0 = [(raw[q : y + LENGTH] + raw[x:q][::-1], y + LENGTH - q) for x, y, q in zip(a, b, p)]
        often = np.flatnonzero(of_segment == 2)
        widths = chunk.b[often] - chunk.a[often] + 1
        starts = np.repeat(chunk.a[often] - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))
        keys1 = [(raw[i : i + LENGTH], LENGTH) for i in starts.tolist()]
        self.places = (usual, starts)
        docs = (chunk.keys[chunk.doc[usual]], chunk.keys[np.repeat(chunk.doc[often], widths)])
        self.entries, self.least, self.entry, self.ids = [], [], [], docs
        for keys, ids in zip((keys0, keys1), docs):
            distinct = sorted(set(keys))
            number = {k: i for i, k in enumerate(distinct)}
            entry = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
            least = np.full(len(distinct), LAST, np.int64)
            np.minimum.at(least, entry, ids)
            self.entries.append(distinct)
            self.least.append(least)
            self.entry.append(entry)
        first = _hashes_at(b"".join(s[:MER] for s, _ in self.entries[0]), np.arange(len(self.entries[0])) * MER) if self.entries[0] else np.empty(0, np.uint64)
        whole = self.entries[1]
        if whole:
            flat = b"".join(s for s, _ in whole)
            at = np.arange(len(whole)) * LENGTH
            second = _hashes_at(flat, at) ^ (_hashes_at(flat, at + LENGTH - MER) >> np.uint64(7)) ^ _hashes_at(flat, at + 13)
        else:
            second = np.empty(0, np.uint64)
        # entries of an anchor meet in one bucket; single windows by their whole content
        self.bucket = [((x >> np.uint64(9)) % np.uint64(buckets)).astype(np.int64) for x in (first, second)]


def suffix_runs(chunk_rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The front-coded sorted runs of a chunk, one for each mode and bucket."""
    out = []
    told = answers.select(["bucket", "answer"]).to_pylist()
    for row in chunk_rows.to_pylist():
        made = Suffixes(Chunk(row), told, buckets)
        for mode in (0, 1):
            for k, mine in _by_bucket(made.bucket[mode]):
                texts = [made.entries[mode][i] for i in mine.tolist()]
                shared, rest, before = bytearray(), [], b""
                for s, _ in texts:
                    c = common(before, s, 0)
                    shared.append(c)
                    rest.append(s[c:])
                    before = s
                sizes = np.frombuffer(bytes(x for s, n in texts for x in (len(s), n)), np.uint8)
                content = zstandard.ZstdCompressor(level=1).compress(b"".join(rest))
                out.append((row["chunk"], mode, k, zstandard.compress(bytes(shared), 1), _squeeze(sizes[0::2].copy()), _squeeze(sizes[1::2].copy()), content, _squeeze(made.least[mode][mine])))
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names=["chunk", "mode", "bucket", "shared", "sizes", "rights", "content", "least"])


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share `known` bytes."""
    top = min(len(a), len(b))
    while known < top:
        step = min(16, top - known)
        x = int.from_bytes(a[known : known + step]) ^ int.from_bytes(b[known : known + step])
        if x:
            return known + step - (x.bit_length() + 7 >> 3)
        known += step
    return known


def decode_run(shared: bytes, sizes: np.ndarray, content: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for c, n in zip(shared, sizes.tolist()):
        before = before[:c] + content[at : at + n - c]
        at += n - c
        out.append(before)
    return out


def merge(runs: list[list[bytes]], shared: list[bytes]) -> tuple[list[int], list[int]]:
    """Merge sorted runs by a loser tree.  Returns, in sorted order, each string's run and the prefix it shares with the
    string before it.  shared[r][i] is the prefix that runs[r][i] shares with runs[r][i - 1].

    A node keeps the loser of its last match and the prefix that it shares with the string that went out last; of two
    strings with different such prefixes the one with the longer is smaller, and only equal prefixes are compared on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    ends = [len(r) for r in runs] + [0] * (k - len(runs))
    at = [0] * k
    current: list = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    loser, prefix = [0] * k, [0] * k
    # first matches, from the leaves: nothing is known, prefixes count from 0
    winners = [0] * (2 * k)
    for r in range(k):
        winners[k + r] = r
    for node in range(k - 1, 0, -1):
        x, y = winners[2 * node], winners[2 * node + 1]
        a, b = current[x], current[y]
        if b is None or (a is not None and a <= b):
            win, lose = x, y
        else:
            win, lose = y, x
        c = common(a, b, 0) if a is not None and b is not None else -1  # a run used up loses to all
        winners[node], loser[node], prefix[node] = win, lose, c
    win = winners[1]
    out_run, out_shared, known = [], [], 0
    push_run, push_shared = out_run.append, out_shared.append
    total = sum(ends)
    for _ in range(total):
        push_run(win)
        push_shared(known)
        i = at[win] + 1
        at[win] = i
        if i < ends[win]:
            s, c = runs[win][i], shared[win][i]
        else:
            s, c = None, -1
        current[win] = s
        node = win + k >> 1
        while node:
            d = prefix[node]
            if c < d:  # the loser shares more with what went out: it is smaller
                loser[node], win = win, loser[node]
                prefix[node], c = c, d
                s = current[win]
            elif c == d and s is not None:
                other = loser[node]
                t = current[other]
                e = prefix[node] = common(s, t, c)
                if e < len(s) and (e == len(t) or s[e] > t[e]):
                    loser[node], win = win, other
                    s = t
            node >>= 1
        known = c
    return out_run, out_shared


def _roll(prefix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Hashes of left contexts, a byte longer."""
    prefix = (prefix ^ (column.astype(np.uint64) + np.uint64(1))) * C[0]
    return prefix ^ (prefix >> np.uint64(29))


def _resolve(strings: list[bytes], shared: np.ndarray, right: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit o of an entry: its window with o bytes before the anchor is also held by an entry with a smaller id.

    strings, in sorted order; shared: prefix in common with the one before; right: bytes from the anchor on."""
    n = len(strings)
    mask = np.zeros(n, np.uint32)
    family = np.cumsum(shared < MER)
    multi = np.bincount(family)[family] > 1
    if not multi.any():
        return mask
    left = np.fromiter(map(len, strings), np.int64, n) - right
    some = np.flatnonzero(multi)
    text = np.zeros((len(some), SPAN - 1), np.uint8)  # left contexts
    for row, i in enumerate(some.tolist()):
        x = strings[i][int(right[i]) :]
        if x:
            text[row, : len(x)] = np.frombuffer(x, np.uint8)
    ids, left, right = ids[some], left[some], right[some]
    prefix = np.zeros(len(some), np.uint64)
    for o in range(SPAN):
        if o:
            prefix = _roll(prefix, text[:, o - 1])
        valid = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(valid) < 2:
            continue
        group = np.cumsum(shared < LENGTH - o)[some[valid]]
        key = prefix[valid] ^ (group.astype(np.uint64) * C[1])
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        heads = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
        mine = ids[valid[order]]
        by_id = np.lexsort((mine, of))  # the first of each group has its least id
        least = by_id[heads]
        later = np.flatnonzero(mine > mine[least][of])
        x, y = valid[order[later]], valid[order[least[of[later]]]]
        # hashes chose the pairs, the bytes decide
        same = (group[order[later]] == group[order[least[of[later]]]]) & (text[x, :o] == text[y, :o]).all(axis=1)
        mixed = np.unique(of[later[~same]])
        mask[some[x[~np.isin(of[later], mixed)]]] |= np.uint32(1 << o)
        # different contexts under one hash: these are told apart by their bytes
        firsts: dict = {}
        apart = [(k, (int(group[order[k]]), text[valid[order[k]], :o].tobytes())) for k in np.flatnonzero(np.isin(of, mixed)).tolist()]
        for k, key in apart:
            firsts[key] = min(firsts.get(key, mine[k]), mine[k])
        for k, key in apart:
            if mine[k] > firsts[key]:
                mask[some[valid[order[k]]]] |= np.uint32(1 << o)
    return mask


def suffix_answers(rows: pa.Table) -> pa.Table:
    """Merge the runs of a bucket and answer each suffix of each run with its mask."""
    cols = rows.to_pydict()
    shared = [zstandard.decompress(x) for x in cols["shared"]]
    runs = [decode_run(c, _expand(s, np.uint8), zstandard.decompress(t)) for c, s, t in zip(shared, cols["sizes"], cols["content"])]
    run, prefix = merge(runs, shared)
    run, prefix = np.array(run, np.int64), np.array(prefix, np.int64)
    # place of each merged string in its run: runs are used up in order
    by_run = np.argsort(run, kind="stable")
    sizes = np.array([len(r) for r in runs], np.int64)
    place = np.empty(len(run), np.int64)
    place[by_run] = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = (np.cumsum(sizes) - sizes)[run] + place
    ids = np.concatenate([_expand(x, np.int64) for x in cols["least"]])[flat]
    right = np.concatenate([_expand(x, np.uint8) for x in cols["rights"]]).astype(np.int64)[flat]
    strings = [runs[r][i] for r, i in zip(run.tolist(), place.tolist())]
    mask = np.empty(len(run), np.uint32)
    mask[flat] = _resolve(strings, prefix, right, ids)
    cuts = np.cumsum(np.concatenate([[0], sizes]))
    return pa.table(
        {
            "chunk": rows.column("chunk"),
            "mode": rows.column("mode").cast(pa.int32()),
            "bucket": rows.column("bucket").cast(pa.int32()),
            "answer": pa.array([_squeeze(mask[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def _remove(chunk_rows: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    told = answers.select(["mode", "bucket", "answer"]).to_pylist()
    ids, n_bytes, spans, kept = [], [], [], []
    for row in chunk_rows.to_pylist():
        chunk = Chunk(row)
        made = Suffixes(chunk, [r for r in told if r["mode"] < 0], buckets)
        edge = np.zeros(len(chunk.raw) + 1, np.int32)
        for mode in (0, 1):
            mask = np.zeros(len(made.entries[mode]), np.uint32)
            places = dict(_by_bucket(made.bucket[mode]))
            for r in told:
                if r["mode"] == mode:
                    mask[places[r["bucket"]]] = _expand(r["answer"], np.uint32)
            own = mask[made.entry[mode]]
            # an equal segment of this chunk with a smaller id decides all windows of a segment
            own[made.ids[mode] > made.least[mode][made.entry[mode]]] = np.uint32(0xFFFFFFFF)
            if mode == 1:
                starts = made.places[1][own != 0]
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + LENGTH, -1)
                continue
            seg = made.places[0]
            for o in range(SPAN):
                start = chunk.p[seg] - o
                hit = (own >> np.uint32(o) & np.uint32(1)).astype(bool) & (start >= chunk.a[seg]) & (start <= chunk.b[seg])
                np.add.at(edge, start[hit], 1)
                np.add.at(edge, start[hit] + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = np.frombuffer(chunk.raw, np.uint8)
        for doc_id, lo, n in zip(chunk.ids, chunk.begins.tolist(), chunk.lengths.tolist()):
            mine = gone[lo : lo + n]
            ids.append(doc_id)
            n_bytes.append(n)
            if mine.any():
                steps = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist())])
                kept.append(raw[lo : lo + n][~mine].tobytes())
            else:
                spans.append([])
                kept.append(chunk.raw[lo : lo + n])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (id, n_bytes, spans array<struct<start,end>>, kept binary), one per input row; spans are removed bytes.

    Null text is empty.  A null id counts as after all others.  Rows with equal ids are never each other's earlier
    document, so a repeated row loses what an earlier id holds, and no more.  Texts under LENGTH bytes stay whole, long ones
    are read whole.  An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = materialize_bucketed(rows.mapInArrow(lambda it: _chunks(it, chunk_bytes), PACKED), "chunks", "chunk", rows_a_file=16)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(16, partitions(docs), -(-total // bucket_bytes))
    runs = packed.mapInArrow(lambda it: anchor_runs(it, buckets), "chunk string, bucket int, run binary, many binary")
    first = materialize(runs.groupBy("bucket").applyInArrow(lambda t: anchor_answers(t, hot), "chunk string, bucket int, answer binary"), "anchors")
    suffixes = packed.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(
        lambda a, b: suffix_runs(a, b, buckets), "chunk string, mode int, bucket int, shared binary, sizes binary, rights binary, content binary, least binary"
    )
    second = materialize(suffixes.groupBy("mode", "bucket").applyInArrow(suffix_answers, "chunk string, mode int, bucket int, answer binary"), "suffixes")
    answers = second.unionByName(first.select("chunk", F.lit(-1).alias("mode"), "bucket", "answer"))
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda a, b: _remove(a, b, buckets), "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    ).withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
