import numpy as np
import pytest
from pyspark.sql import functions as F

from askwright.llm import toxicity


@pytest.mark.parametrize("kind", ["logistic", "sigmoid"])
def test_risk_and_slopes_equal_the_definition(kind):
    """The risk by its formula, text by text; the slopes by finite differences; the reversal where the second part is negative."""
    rng = np.random.default_rng(3)
    loss = {"logistic": lambda z: np.log1p(np.exp(-z)), "sigmoid": lambda z: 1 / (1 + np.exp(z))}[kind]  # of calling z toxic
    turned = set()
    for trial in range(40):
        positive = np.arange(30) < 12
        z = rng.normal(0, 1, 30) + (rng.normal(0, 3) if trial % 2 else 0) * positive
        prior = float(rng.uniform(0.05, 0.9))

        def second(z):
            return np.mean([loss(-x) for x in z[~positive]]) - prior * np.mean([loss(-x) for x in z[positive]])

        def first(z):
            return prior * np.mean([loss(x) for x in z[positive]])

        value, slope, reversed_ = toxicity.risk(z, positive, prior, kind)
        assert reversed_ == (second(z) < 0) and abs(value - first(z) - max(0, second(z))) < 1e-9
        turned.add(reversed_)
        down = (lambda z: -second(z)) if reversed_ else (lambda z: first(z) + second(z))
        step = 1e-5 * np.eye(30)
        assert np.abs(slope - [(down(z + e) - down(z - e)) / 2e-5 for e in step]).max() < 1e-6
    assert turned == {True, False}


def planted(rng, n):
    words = [f"word{i}" for i in range(200)]
    toxic = rng.random(n) < 0.3
    return toxic, [" ".join(list(rng.choice(words, 30)) + (["vile", "awful"] if bad else [])) for bad in toxic]


def test_what_is_learned_comes_from_the_risk():
    """Without descent nothing is told apart; the descent lowers the risk, and the score follows it."""
    rng = np.random.default_rng(5)
    toxic, texts = planted(rng, 900)
    positive = [t for t, bad in zip(texts[:300], toxic[:300]) if bad]
    model = toxicity.learn(positive, texts[300:600], 0.3)
    said = np.array([model.score(t) >= 0.5 for t in texts[600:]])
    assert (said == toxic[600:]).mean() > 0.98
    for untrained in (toxicity.learn(positive, texts[300:600], 0.3, 0, 0), toxicity.learn([], texts[300:600], 0.3), toxicity.learn(positive, [], 0.3)):
        assert not untrained.weights.any() and {round(untrained.score(t), 3) for t in texts[600:]} == {0.3}
    at = lambda m: toxicity.risk(np.log([(s := m.score(t)) / (1 - s) for t in positive + texts[300:600]]), np.arange(len(positive) + 300) < len(positive), 0.3, "sigmoid")[0]
    assert at(model) < 0.5 * at(untrained)


def test_noise_words_stay_small():
    """The planted words gain weight, a word of both kinds does not."""
    rng = np.random.default_rng(6)
    toxic, texts = planted(rng, 600)
    positive = [t for t, bad in zip(texts, toxic) if bad][:80]
    model = toxicity.learn(positive, texts, 0.3)
    told = {w: toxicity.features(w)[0] for w in ("vile", "awful", "word7")}
    assert model.weights[told["vile"]].max() > 0 and model.weights[told["awful"]].max() > 0
    assert np.abs(model.weights[told["word7"]]).max() < 0.2 * model.weights[told["vile"]].max()


def test_rows_of_every_kind_get_a_score(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(200)]
    text = lambda bad: " ".join(list(rng.choice(words, 30)) + (["vile", "awful", "nasty"] if bad else []))
    rows = [(i, text(i % 3 == 0)) for i in range(600)] + [(900, None), (901, ""), (None, text(True)), (3, text(False)), (902, "word1 " * 100_000)]
    docs = spark.createDataFrame([(i, t, 7.0) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(0, 600, 2)] + [(0, None, "x"), (None, 1, "x"), (6, 1, "x")], "doc_id long, toxic int, text string")
    found = toxicity.score_documents(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    by = {r.doc_id: r for r in found}
    assert by[900].score == by[901].score and by[None].held_out
    truth = np.array([r.doc_id % 3 == 0 for r in found if r.doc_id is not None and r.doc_id < 600])
    said = np.array([r.predicted == 1 for r in found if r.doc_id is not None and r.doc_id < 600])
    assert (truth == said).mean() > 0.97


def test_labels_on_every_document(spark):
    """No text is without a label: labelled texts with hidden labels stand for the unlabelled ones."""
    rng = np.random.default_rng(8)
    toxic, texts = planted(rng, 500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad)) for i, bad in enumerate(toxic)], "doc_id long, toxic int")
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    assert np.mean([found[i] == int(bad) for i, bad in enumerate(toxic)]) > 0.97


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score_documents(docs, labels).collect()] == [0, 0]
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
    tp, fp, fn, tn = found.agg(*[F.sum(((F.col("predicted") == p) & (F.col("toxic") == t)).cast("int")) for p, t in ((1, 1), (1, 0), (0, 1), (0, 0))]).first()
    assert tp / (tp + fn) > 0.8 and fp / (fp + tn) < 0.03
