import numpy as np
from pyspark.sql import functions as F

from askwright.llm import simhash


def brute(rows):
    ids = [i for i, _ in rows]
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (f"{fps[i]:016x}", least[find(i)]) for i in range(len(ids))}


def test_fingerprint_equals_sql(spark):
    text = "Aa bb\tCC dd  ee É ff\ngg aa bb cc dd"
    words = [w for w in text.encode().lower().decode().split()]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [r[0] % 2**64 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n ") == 0


def test_matches_brute_force_with_edge_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 120))
        rows.append((i * 10 + 5, " ".join(words)))
        for j in range(int(rng.integers(0, 6))):
            changed = list(words)
            changed[int(rng.integers(0, 120))] = "changed"
            rows.append((i * 10 - j, " ".join(changed)))
    rows = list({i: (i, t) for i, t in rows}.values()) + [(5000, ""), (5001, None), (5002, "   "), (5003, "one two")]
    monkeypatch.setattr(simhash, "SHARD_POINTS", 16)  # many shards, so that links cross their boundaries
    monkeypatch.setattr(simhash, "LEAF_POINTS", 4)
    monkeypatch.setattr(simhash, "ASK_POINTS", 5)  # and many blocks of each
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").repartition(5)
    found = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(docs).collect()}
    assert found == brute(rows)
    kept = {r[0] for r in simhash.one_of_each(docs).collect()}
    assert kept == {c for _, c in brute(rows).values()}


def test_search_is_exact_on_random_points():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.int64).view(np.uint64)
    flips = base[rng.integers(0, 400, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    points = np.unique(np.concatenate([base, flips]))
    forest = simhash.Forest(len(points))
    for asking in np.array_split(rng.permutation(len(points)), 7):
        simhash.search(points, np.arange(len(points)), asking, 4, forest)
    other = simhash.Forest(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    other.link(i, j)
    assert (forest.label == other.label).all()


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "zzz"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    found = sorted(((r[0], r[2]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == [(3, 3), (3, 3), (None, 3), (None, None)]


def test_the_texts_of_one_id_are_judged_each_for_itself(spark):
    one, other = "aa bb cc dd ee ff", "something else that shares no shingle with it"
    rows = [(3, one, "a"), (7, one, "b"), (7, other, "c"), (None, one, "d"), (8, None, "e"), (9, "", "f"), (5, "lone words of their own here", "g"), (5, "lone words of their own here", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = sorted((str(r.doc_id), r.key) for r in simhash.one_of_each(docs).collect())
    assert kept == [("3", "a"), ("5", "g"), ("5", "g"), ("7", "c"), ("8", "e"), ("None", "d")]
