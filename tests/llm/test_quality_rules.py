import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwright.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    """The base counts by their definitions, window by window."""
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


def texts(seed, n):
    rng = random.Random(seed)
    pool = ["a", "b", "the", "Ünï", "日本", "x|y", "<p>", "END.", " ", "é", "#", "\x1c"]
    made = []
    for _ in range(n):
        few = rng.sample(pool, rng.randint(1, 6))
        words = rng.choices(few, k=rng.randint(0, 60))
        made.append("".join(w + rng.choice([" ", " ", "\n", "\t", " \n", "\x0b", "\r"]) for w in words))
    return made


EDGES = [None, "", " \n\t", "a", "a " * 8, "a " * 9, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "x\n\n x\nx\n", "x\n x", "\x85   　", "long words " * 60_000]


def test_counts_equal_brute_force():
    for t in texts(1, 1500) + EDGES[:-1]:
        assert qr.counts_of((t or "").encode())[:5] == base(t), t


def test_rows_of_every_kind(spark):
    rows = list(enumerate(texts(2, 40) + EDGES)) + [(None, "a b"), (None, None), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, 1.0, 7) for r in rows], "doc_id long, text string, p_good double, n_words int").repartition(4)
    found = qr.report(qr.judge(docs)).collect()
    seen = sorted([(r.doc_id, *r[1:6]) for r in found], key=str)
    assert seen == sorted([(i, *base(t)) for i, t in rows], key=str)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and 0 <= r.p_good <= 1
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)
    assert qr.report(qr.judge(docs.limit(0))).collect() == []


def planted(seed, n, share=0.8):
    """Votes of known rates; the last rule votes at random."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < share
    rates = np.array([[0.97, 0.5], [0.95, 0.3], [0.99, 0.6], [0.9, 0.2], [0.98, 0.55], [0.7, 0.7]])
    vote = np.where(rng.random((n, len(rates))) < np.where(good[:, None], rates[:, 0], rates[:, 1]), 1, -1)
    return good, rates, np.where(rng.random(vote.shape) < 0.25, 0, vote)


def test_expectation_maximisation_finds_the_rates():
    good, rates, vote = planted(4, 60_000)
    pattern, rows = np.unique(vote, axis=0, return_counts=True)
    model = qr.fit(pattern, rows.astype(float))
    assert abs(model.share - 0.8) < 0.03 and np.abs(model.rates - rates).max() < 0.06
    assert np.abs(model.weights()[-1]).max() < 0.1  # a rule that knows nothing weighs nothing
    said = model.odds(vote) > 0
    assert (said == good).mean() > 0.93 > ((vote != -1).all(axis=1) == good).mean() + 0.2  # all-must-pass is far worse


def test_every_round_climbs():
    _, _, vote = planted(5, 5_000)
    pattern, rows = np.unique(vote, axis=0, return_counts=True)
    at = [qr.log_posterior(qr.fit(pattern, rows.astype(float), k), pattern, rows) for k in range(0, 30, 3)]
    assert all(b >= a - 1e-6 for a, b in zip(at, at[1:])) and at[-1] > at[0]


def test_posterior_column_equals_bayes(spark):
    """The native column against the rule of Bayes, rule by rule."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3, 200))], "doc_id long, text string")
    counts = qr.measure(docs)
    rng = np.random.default_rng(1)
    model = qr.Model(0.7, np.stack([rng.uniform(0.6, 0.99, len(qr.RULES)), rng.uniform(0.1, 0.6, len(qr.RULES))], axis=1))
    for r in counts.select(qr.posterior(model).alias("p"), F.array(*qr.votes()).alias("v")).collect():
        likely = [s * np.prod([1 if v == 0 else rate if v == 1 else 1 - rate for v, rate in zip(r.v, model.rates[:, k])]) for k, s in ((0, 0.7), (1, 0.3))]
        assert abs(r.p - likely[0] / sum(likely)) < 1e-9


def test_bounds_of_the_pattern_table(spark):
    with pytest.raises(ValueError):
        qr.patterns(spark.createDataFrame([], "n_words long"), qr.RULES + qr.RULES)


def test_agreement_with_labels(spark):
    """The labels are not used by the method; they tell how good it is."""
    d = "/root/testdata/sf0.1"
    judged = qr.judge(spark.read.parquet(f"{d}/documents.parquet")).where("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    good, lost, bad, let = judged.agg(*[F.sum(F.expr(f"int({c})")) for c in ("quality = 1", "quality = 1 AND NOT kept", "quality = 0", "quality = 0 AND kept")]).first()
    assert good > 3000 and lost / good < 0.005 and bad > 250 and let / bad < 0.05
