import itertools

import numpy as np
from pyspark.sql import functions as F

from askwright.llm import language_id as li


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    doc = np.repeat([0, 2, 3], [5, 1, 6])
    scores = rng.normal(0, 4, (12, 3)).astype(np.float32)
    got = li.viterbi(scores, doc, 4, 3.0)
    for d in (0, 2, 3):
        mine = scores[doc == d]
        worth = lambda p: sum(mine[i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(worth(p) for p in itertools.product(range(3), repeat=len(mine)))
        assert abs(worth(got[doc == d].tolist()) - best) < 1e-4


def test_words_and_scripts():
    words = li.read_words(["Ab, ЯЖ1x", None, "", "日本 𝔘"])
    spans = [(d, b, e, li.NAMES[s]) for d, b, e, s in zip(words.doc, words.begin, words.end, words.script)]
    assert spans == [(0, 0, 2, "latin"), (0, 4, 6, "cyrillic"), (0, 7, 8, "latin"), (3, 0, 2, "han"), (3, 3, 4, "other")]


def test_mixed_text_unknown_scripts_and_edges(spark):
    en, ru, de = "the cat and the other thing with that ", "это просто русский текст для проверки ", "und das ist nicht der mit einer für "
    train = [(i, t * 5, l, "x") for i, (t, l) in enumerate([(en, "en"), (ru, "ru"), (de, "de")] * 8)] + [(900, None, "en", "x"), (901, "text", None, "x")]
    model = li.train(spark.createDataFrame(train, "doc_id long, text string, lang string, id string"))
    assert model.langs == ["de", "en", "ru"]
    rows = [(1, en * 3 + de * 3), (2, ru), (3, None), (4, "12 !!"), (5, "日本語"), (6, ""), (None, de), (7, en * 30000)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de"] and abs(got[1].spans[1].start - len(en) * 3) < 8
    assert got[2].lang_pred == "ru" and got[None].lang_pred == "de" and got[7].lang_pred == "en" and len(got[7].spans) == 1
    assert [got[i].lang_pred for i in (3, 4, 6)] == ["und"] * 3 and got[5].lang_pred in model.langs and got[5].score == 0
    assert li.train(docs.select("text", F.lit(None).cast("string").alias("lang"))) is None
    assert {r.lang_pred for r in li.identify(docs, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 100 and right / total > 0.98
