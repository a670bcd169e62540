import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askwright.llm import suffix_dedup as sd


def brute(rows):
    least = {}
    key = lambda i: sd.LAST if i is None else i
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            w = raw[s : s + 50]
            least[w] = min(key(i), least.get(w, key(i)))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if least[raw[s : s + 50]] < key(i):
                gone[s : s + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=6))
def test_loser_tree_merges_with_prefixes(runs):
    runs = [sorted(r) for r in runs]
    shared = [bytes([0] + [sd.common(a, b, 0) for a, b in zip(r, r[1:])]) if r else b"" for r in runs]
    order, prefix = sd.merge(runs, shared)
    left = [iter(r) for r in runs]
    got = [next(left[r]) for r in order]
    assert got == sorted(x for r in runs for x in r)
    assert prefix[1:] == [sd.common(a, b, 0) for a, b in zip(got, got[1:])]


def test_segments_cover_every_window_and_depend_on_content_only():
    rng = np.random.default_rng(6)
    text = bytes(rng.integers(97, 105, 700, dtype=np.uint8))
    def anchors(raw):
        w, o = sd.segments(raw, np.array([len(raw)]))
        w = w.astype(int) + 1
        assert w.sum() == len(raw) - 49
        first = np.cumsum(w) - w
        at = np.repeat(first + o, w)
        return {raw[i : i + 50]: int(p) - i for i, p in enumerate(at)}
    whole, cut = anchors(text), anchors(text[133:500])
    assert all(whole[k] == v for k, v in cut.items()) and max(whole.values()) <= 26


@pytest.mark.parametrize("hot, bucket_bytes", [(20_000, sd.BUCKET_BYTES), (3, 100)])
def test_equals_brute_force(spark, hot, bucket_bytes):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "eps", "zeta", "日本", "x", "yy"], n)) + str(rng.integers(1e9))
    shared = [prose(40) for _ in range(4)]
    rows = []
    for i in range(70):
        parts = [prose(int(rng.integers(0, 30)))]
        for s in shared:
            if rng.random() < 0.4:
                cut = int(rng.integers(0, 60))
                parts += [s[cut : cut + int(rng.integers(40, 200))], prose(int(rng.integers(0, 12)))]
        rows.append((int(i * 7 % 70), "".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[3][1][:-1] + "!"), (103, None), (104, ""), (105, "short"), (106, "a" * 400), (107, "a" * 60)]
    rows += [(None, rows[5][1]), (None, "unique " + prose(60)), (rows[0][0], rows[0][1]), (108, shared[0] * 3), (109, "b" * 49), (110, "b" * 50), (111, "\0" * 120), (112, "\0" * 77)]
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, kept binary").repartition(3)
    got = sorted((tuple(r) for r in sd.report(sd.remove_repeats(docs, chunk_bytes=4000, hot=hot, bucket_bytes=bucket_bytes)).collect()), key=str)
    assert got == brute(rows)


def test_left_contexts_of_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(4)
    right = b"x" * 49
    entries = sorted({right + bytes(rng.integers(97, 100, 26, dtype=np.uint8)) for _ in range(80)} | {right[:48] + b"y" + b"a" * 26})
    shared = np.array([0] + [sd.common(a, b, 0) for a, b in zip(entries, entries[1:])])
    args = (entries, shared, np.full(len(entries), 49), rng.integers(0, 40, len(entries)))
    want = sd._resolve(*args)
    monkeypatch.setattr(sd, "_roll", lambda prefix, column: np.zeros_like(prefix))
    assert want.any() and (sd._resolve(*args) == want).all()


def test_corpus_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in sd.report(sd.remove_repeats(docs)).collect()), key=str) == brute(rows)
    assert sd.report(sd.remove_repeats(docs.limit(0))).collect() == []
