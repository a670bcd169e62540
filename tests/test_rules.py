"""Rules held against small cases of their own: boilerplate of rows, the gate, the sweep, the ladder, codes, names of queries."""

import pytest
from pyspark.sql import functions as F

from askwright.operators import corpus, decisions, extraction, measurement
from askwright.plans import base


@pytest.mark.parametrize("more", [0, 1500])
def test_boilerplate_goes_row_by_row(spark, more):
    """The same whether few lines are banned or many; rows of one id stay apart, a null text stays null."""
    rows = [(1, "keep\nThis line is boilerplate text\nend"), (1, "other\nThis line is boilerplate text"), (2, None), (3, ""), (4, "This line is boilerplate text"), (None, "a\n\n\n\n\nb"), (1, "other\nThis line is boilerplate text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    banned = spark.createDataFrame([("this line is boilerplate text", 3)] * 2 + [(f"line number {i}", 3) for i in range(more)], "line string, n long")
    found = sorted(map(tuple, corpus.remove_boilerplate(docs, "doc_id", "text", banned).collect()), key=repr)
    want = [(1, "keep\nend", 1), (1, "other", 1), (1, "other", 1), (2, None, 0), (3, "", 0), (4, "", 1), (None, "a\n\nb", 0)]
    assert found == sorted(want, key=repr)
    assert corpus.remove_boilerplate(docs.limit(0), "doc_id", "text", banned).collect() == []


def test_a_name_is_given_once(monkeypatch):
    monkeypatch.setattr(base, "QUERIES", {})

    def twice(spark, d):
        return None

    base.query()(twice)
    with pytest.raises(ValueError, match="two queries"):
        base.query()(twice)


def test_codes_end_at_the_least_integer(spark):
    rows = spark.createDataFrame([("-2147483648 -2999999999 -2147024891 x-2147024891 1.-2147024891",)], "t string")
    assert rows.select(extraction.negative_codes(F.col("t"))).first()[0] == ["80000000", "80070005"]


def test_the_sweep_keeps_nine_places(spark):
    rows = [("a", float(i), i == 37) for i in range(100)] + [("b", float(i), False) for i in range(9)] + [("c", float(i), False) for i in range(10)]
    found = measurement.sampled_sweep(spark.createDataFrame(rows, "engine string, threshold double, recommended boolean")).collect()
    kept = {e: sorted(r.threshold for r in found if r.engine == e) for e in "abc"}
    step = 99 / 7
    assert kept["a"] == sorted({0, 99, 37} | {round(i * step) for i in range(1, 7)}) and kept["b"] == list(range(9))
    assert kept["c"] == sorted({0, 9} | {round(i * 9 / 7) for i in range(1, 7)})


RECORD = "engine string, run int, ord int, client string, ticket_id string, expected array<string>, kind string, fiches array<string>, score double, level string, error string"


def test_a_question_of_one_engine_is_unpaired_and_nothing_else(spark):
    row = lambda engine, ticket, fiche="F": (engine, 0, 1, "c", ticket, ["F"], "fiche", [fiche], 0.9, "L1" if engine == "routed" else None, None)
    rows = [row("base", "1"), row("base", "2"), row("routed", "2")]
    got = measurement.gate(spark.createDataFrame(rows, RECORD), "base", "routed", spark.createDataFrame([], "client string, ticket_id string"), least=1).first()
    assert (got.status, got.reasons, got.compared, got.unpaired, got.relabelled) == ("invalid", ["unpaired"], 1, 1, 0)
    other = rows[:1] + [(*row("routed", "1")[:5], ["G"], *row("routed", "1")[6:])]
    got = measurement.gate(spark.createDataFrame(other, RECORD), "base", "routed", spark.createDataFrame([], "client string, ticket_id string"), least=1).first()
    assert "relabelled" in got.reasons and "unpaired" not in got.reasons


def test_the_gate_combines_records_by_question_once(spark):
    """Later records win, repeats count once, runs are held against what the base was asked, a question without a name is nobody's pair."""
    row = lambda engine, run, order, ticket, fiche="F", level=None, error=None: (engine, run, order, "c", ticket, ["G", "F"], "fiche", [fiche], 0.9, level, error)
    rows = [
        row("base", 1, 1, "1", "X"), row("base", 1, 2, "1"), row("base", 1, 3, "2", "X"), row("base", 2, 4, "1"), row("base", 2, 5, "1"),  # run 2 lacks question 2
        row("routed", 0, 6, "1"), row("routed", 0, 7, "2", "X", "L1"), row("routed", 0, 8, "2", "X", "L1"), row("routed", 1, 9, "2", "F", "L1"), row("routed", 1, 10, "1", "F", "L2"),
        row("routed", 2, 11, "1", "F", "L3", "e"), row("routed", 2, 12, "3", "F", "L0"), row("base", 1, 13, None), row("routed", 0, 14, None), row("other", 0, 15, "9", "X", "L1", "e"),
    ]
    records = spark.createDataFrame(rows, RECORD)
    seen = spark.createDataFrame([("c", "2"), ("c", "2"), (None, "1")], "client string, ticket_id string")
    gate = measurement.gate(records, "base", "routed", seen, least=1)
    got = gate.first()
    assert (got.unpaired, got.relabelled, got.exact_decisions, got.wrong_exact, got.unseen_exact, got.errors, got.degraded) == (2, 0, 5, 1, 2, 1, 0)
    assert (got.compared, got.base_first, got.route_first, got.uneven) == (1, 1, 1, 3) and (got.status, got.reasons) == ("invalid", ["unpaired", "uneven_runs", "errors", "wrong_exact"])
    assert measurement.gate(records.limit(0), "base", "routed", seen).first().asDict() | {"reasons": None} == dict.fromkeys(gate.columns, 0) | {"reasons": None, "status": "insufficient"}
    plan = gate._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("LogicalRDD") == 3  # the smallest runs, the records, what was seen
    plan = measurement.canonical(records)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")  # other runs are left out below what sorts


def test_the_ladder_below_its_thresholds(spark):
    rows = [
        (1, "a", 0.30, 1, False, "app:x"), (1, "b", 0.05, 2, False, None),  # words alone, an application: asked for
        (2, "a", 0.39, 1, False, None), (2, "b", 0.05, 2, False, None),  # words alone, no application
        (3, "a", 0.24, 1, True, "app:x"),  # words alone, too weak
        (4, "a", 0.01, 1, False, None),  # designated: no score is needed
        (5, "a", 0.80, 1, False, None), (5, "b", 0.79, 2, False, None),  # close, told apart by an entity
        (6, "a", 0.80, 1, False, None), (6, "b", 0.79, 2, False, None),  # close, but words alone
    ]
    ranked = spark.createDataFrame(rows, "query int, doc string, score double, rank int, named boolean, app string")
    modes = [(1, False, False, False), (2, False, False, False), (3, False, False, False), (4, True, True, True), (5, True, False, False), (6, False, False, False), (7, False, False, False)]
    mode = spark.createDataFrame(modes, "query int, entities boolean, strong boolean, designated boolean")
    splits = spark.createDataFrame([(5, "err", ["err:1", "err:2"]), (6, "err", ["err:1", "err:2"])], "query int, kind string, options array<string>")
    found = {r["query"]: (r.kind, r.reason, r.doc) for r in decisions.words_ladder(ranked, mode, splits=splits).collect()}
    assert found == {
        1: ("question", "ask_application", None), 2: ("abstain", "text_only_weak", None), 3: ("abstain", "nothing_close", None), 4: ("fiche", "single", "a"),
        5: ("question", "close_entity", None), 6: ("question", "close_choice", None), 7: ("abstain", "no_candidate", None),
    }


def test_a_floor_is_confirmed_on_the_other_half(spark):
    def rows(engine, half, right, wrong, score, start):
        return [(engine, 0, i, "c", f"{half}{engine}{start + i}", ["F"], "fiche", ["F" if i < right else "G"], score, None, None) for i in range(right + wrong)]

    said = rows("e", "A", 60, 0, 0.9, 0) + rows("e", "A", 0, 20, 0.2, 100) + rows("e", "B", 60, 1, 0.95, 0)  # the floor of 0.9 holds
    said += rows("u", "A", 60, 0, 0.9, 0) + rows("u", "B", 60, 0, 0.9, 0) + rows("u", "B", 0, 30, None, 100)  # wrong without a score: shown
    said += rows("n", "A", 5, 5, None, 0) + rows("n", "B", 5, 0, 0.5, 0) + rows("o", "A", 9, 0, 0.9, 0) + rows("f", "A", 3, 0, 0.9, 0) + rows("f", "B", 3, 0, 0.9, 0)
    found = {r.engine: r for r in measurement.split_recommendation(spark.createDataFrame(said, RECORD), F.substring("ticket_id", 1, 1), 0.1).collect()}
    assert {e: r.reason for e, r in found.items()} == {"e": "confirmed", "u": "not_confirmed", "n": "nothing_scored", "o": "empty_half", "f": "too_few"}
    e, u = found["e"], found["u"]
    assert (e.threshold, e.exact_a, e.wrong_a, e.exact_b, e.wrong_b, e.confirmed) == (0.9, 60, 0, 60, 1, True) and (u.exact_b, u.wrong_b, u.confirmed) == (60, 30, False)
