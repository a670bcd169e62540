from askwright.operators import extraction


def test_vocabulary_of_more_than_a_thousand_terms(spark):
    terms = [f"term{i:04d}x" for i in range(2500)]
    texts = [(i, f"about {t} here") for i, t in enumerate(terms)]
    found = extraction.vocabulary_entities(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.id, r.term, r["rank"]) for r in found.collect()} == {(i, t, 1) for i, t in enumerate(terms)}


def test_a_text_is_folded_once_whatever_the_vocabulary(spark):
    """the join compares folded texts, it folds none."""
    texts, terms = spark.createDataFrame([(1, "Été à FOO")], "id int, t string"), spark.createDataFrame([("foo",), ("ete",), ("été",), ("x",)], "term string")
    found = extraction.vocabulary_entities(texts, terms)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("translate" in x for x in joins)
    assert sorted((r.term, r["rank"]) for r in found.collect()) == [("ete", 1), ("foo", 2), ("été", 3)]
