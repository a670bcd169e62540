"""Near duplicates: the step that shingle_jaccard, numbered_pairs, dup_components and canonical_pick share."""

import random

import pytest
from pyspark.sql import functions as F

from askwright.functions.text import search_tokens, tokenize
from askwright.operators import graph as g


def test_tokens_of_a_task_are_those_of_columns(spark):
    texts = ["", "L'été à KÖLN x 7z ß Ǆ Kelvin K", "été ｆｕｌｌ 日本 a_b-c", "the THE tHe  under\tscore\n99", "\U0001d4d0bc ŉx ĳ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("w")).collect()
    assert all(search_tokens(r.t) == r.w for r in rows)


@pytest.mark.parametrize("seed", [1, 5])
def test_pairs_equal_brute_force(spark, seed):
    """short texts, copies, repeated ids and rows, numbers that differ; every pair, each shingle dealt out once."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 100, 120]))] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(9)}" for w in rng.choice(base)) for _ in range(90)]
    rows = [(i, t, f"n{i % 3}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (200, None, "n1"), (201, "alone here", None)], "id long, t string, num string")

    def shingled(t):
        w = t.split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, reps, numbers = {}, {}, {}
    for i, t, n in [*rows, (201, "alone xhere", "")]:
        if s := shingled(t):
            rep = reps[i] = sets.setdefault(s, i)
            numbers.setdefault(rep, set()).add(n)
    for number, least in ((None, 0.8), (F.col("num"), 0.5)):
        pairs, membership = g.similar_pairs(docs, "id", F.col("t"), number=number)
        want = set()
        for s, a in sets.items():
            for z, b in sets.items():
                j = len(s & z) / len(s | z)
                if a < b and (j >= 0.8 or number is not None and j >= least and numbers[a] & numbers[b]):
                    want.add((a, b, round(j, 9)))
        assert {(r.a, r.b, round(r.jaccard, 9)) for r in pairs.collect()} == want and want
        assert {(r.doc, r.rep) for r in membership.collect()} == set(reps.items())


def test_pairs_are_measured_from_a_written_table(spark):
    """The plan of the pairs holds no shingles to be counted anew, on either side."""
    pairs, _ = g.similar_pairs(spark.createDataFrame([(1, "a1 b1 c1 d1 e1 f1"), (2, "b1 c1 d1 e1 f1")], "id long, t string"), "id", F.col("t"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "count(" not in plan and "MapInArrow" not in plan
