import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from askwright.llm import decontamination as dc


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 5), max_size=25))
def test_lcs_equals_the_table(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    masks = {}
    for at, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << at
    assert dc.lcs(masks, len(a), b) == table[-1, -1]


def test_planted_passages_and_edge_rows(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 300
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, prose(int(rng.integers(16, 60)))) for i in range(40)]
    docs, want = [], set()
    for i in range(300):
        text = prose(int(rng.integers(5, 800)))
        if i % 6 == 0:
            k = int(rng.integers(0, 40))
            words = items[k][1].split()
            if i % 12 == 0:  # a paraphrase: one word in eight is another
                words = [w if j % 8 else "other" for j, w in enumerate(words)]
            text = f"{text}\n{' '.join(words).capitalize()}.\n{prose(int(rng.integers(0, 300)))}"
            want.add((i, k))
        docs.append((i, text))
    docs += [(1000, None), (1001, ""), (None, items[3][1]), (0, docs[0][1]), (1002, prose(150_000) + " " + items[5][1])]
    want |= {(None, 3), (1002, 5)}
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "!!")], "item_id long, text string")
    found = dc.contamination(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    kept = {r.doc_id for r in dc.drop_leaking(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want if i is not None}
    assert dc.contamination(frame.limit(0), bench).collect() == [] and dc.contamination(frame, bench.limit(0)).collect() == []


def test_corpus_against_brute_force(spark):
    """Every document that holds an item word for word is found, and little else."""
    d = "/root/testdata/sf0.01"
    frame, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    flat = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in frame.collect() for i, t in items if t in flat(r.text)}
    found = {(r.doc_id, r.item_id) for r in dc.contamination(frame, bench).collect()}
    assert want and want <= found and len(found) <= 1.5 * len(want) + 3


def test_hashes_follow_the_words():
    texts = ["Été à l'École — fin…", None, "", "a b  A", "«mot» mot\0mot", "x" * 1000 + " y"]
    flat, counts = dc.hash_words([t.replace("\0", " ") if t else t for t in texts])
    assert counts.tolist() == [5, 0, 0, 3, 3, 2] and flat[5] == flat[7] and len({*flat[8:11].tolist()}) == 1
    assert dc.word_hashes("école")[0] == flat[3]


def test_items_of_any_length_against_brute_force(spark):
    """No leak that the checks of step 4, tried at every passage, accept is lost for want of a candidate."""
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(5000)] + ["the", "of", "and"] * 500
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(n, prose(n)) for n in (5, 7, 9, 12, 16, 17, 24, 32, 33, 40, 64, 100, 160, 200, 250, 320, 400, 500)]
    docs, copied = [], set()
    for n, text in items:
        for every in (0, 0, 8, 5, 4, 3):  # word for word, or a word in so many is another
            words = [f"other{j}" if every and j % every == 0 else w for j, w in enumerate(text.split())]
            if not every:
                copied.add((len(docs), n))
            docs.append((len(docs), f"{prose(int(rng.integers(0, 300)))}\n{' '.join(words)}.\n{prose(int(rng.integers(0, 300)))}"))
        words = [f"{w} filler{j}" if j % 3 == 0 else w for j, w in enumerate(text.split())]  # a word more after each third
        docs.append((len(docs), f"{prose(int(rng.integers(0, 300)))}\n{' '.join(words)}.\n{prose(int(rng.integers(0, 300)))}"))
    docs += [(1000 + i, prose(200)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    found = {(r.doc_id, r.item_id) for r in dc.contamination(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    n_docs = {}
    hashed = [(i, dc.word_hashes(t)) for i, t in docs]
    for _, words in hashed:
        for cell in np.unique(words & (dc.CELLS - 1)):
            n_docs[cell] = n_docs.get(cell, 0) + 1
    idf = np.log1p((len(docs) + 1) / (np.array([n_docs.get(c, 0) for c in range(dc.CELLS)]) + 1)) ** 2
    known = {x.item_id: x for x, _ in dc.cut([(i, dc.word_hashes(t)) for i, t in items], idf)}
    want = {(d, i) for d, words in hashed for i, item in known.items() if any(dc.verify(item, words, near) for near in range(-(-len(words) // dc.STRIDE)))}
    assert copied <= want and len(want) > 100 and found == want


def _paraphrased(rng, n_items):
    """More items than the space has dimensions, each with a paraphrase: of every three words one is replaced."""
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, prose(int(rng.integers(20, 70)))) for i in range(n_items)]
    docs = []
    for i, text in items:
        words = [f"other{int(rng.integers(500))}" if rng.random() < 0.3 else w for w in text.split()]
        docs.append((i, f"{prose(int(rng.integers(0, 200)))}\n{' '.join(words)}\n{prose(int(rng.integers(0, 200)))}"))
    return items, docs + [(1000 + i, prose(300)) for i in range(200)]


def _searched(items, docs, sketched=None):
    """Leaks found by candidates of the latent space and by checking every passage; a sketch of zeros knows nothing of the corpus."""
    hashed = [(i, dc.word_hashes(t)) for i, t in docs]
    df = np.bincount(np.concatenate([np.unique(w & (dc.CELLS - 1)) for _, w in hashed]), minlength=dc.CELLS)
    idf = np.log1p((len(docs) + 1) / (df + 1)) ** 2
    pieces = dc.cut([(i, dc.word_hashes(t)) for i, t in items], idf)
    space = dc.build_space(pieces, sketched(hashed, idf), idf)
    flat, counts = np.concatenate([w for _, w in hashed]), np.array([len(w) for _, w in hashed])
    tried = {(d, near, id(space.known[k])): space.known[k] for d, near, k, _ in dc.candidates(flat, counts, space)}
    found = {(docs[d][0], item.item_id) for (d, near, _), item in tried.items() if dc.verify(item, hashed[d][1], near)}
    known = {x.item_id: x for x, _ in pieces}
    want = {(i, k) for i, words in hashed for k, item in known.items() if any(dc.verify(item, words, near) for near in range(-(-len(words) // dc.STRIDE)))}
    return found, want


def _sketch(spark):
    def made(hashed, idf):
        return dc.sketch(spark.createDataFrame([(i, w.tobytes()) for i, w in hashed], "id long, words binary").repartition(3), idf)

    return made


def test_paraphrases_are_found_by_the_corpus_space(spark):
    """The candidate search loses little against checks at every passage, and much without the corpus' own space."""
    items, docs = _paraphrased(np.random.default_rng(12), 2 * dc.RANK)
    found, want = _searched(items, docs, _sketch(spark))
    assert len(want) > 0.6 * len(items) and len(found & want) >= 0.97 * len(want) and found <= want
    blind, _ = _searched(items, docs, lambda hashed, idf: np.zeros((dc.SKETCH, dc.CELLS)))
    assert len(blind) < 0.8 * len(found)


def test_sketch_is_the_same_in_any_partitioning(spark):
    _, docs = _paraphrased(np.random.default_rng(13), 30)
    words = spark.createDataFrame([(i if i % 7 else None, dc.word_hashes(t).tobytes()) for i, t in docs], "id long, words binary")
    idf = np.ones(dc.CELLS)
    assert np.allclose(dc.sketch(words.coalesce(1), idf), dc.sketch(words.repartition(7), idf))
