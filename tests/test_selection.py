"""Answers of models against a plain reading of their JSON, the scoring profile, and the polled source."""

import json
import random

import pytest

from askwright.operators import selection as s
from askwright.sources.tickets import ticket_source


def test_steps_equal_a_plain_reading(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([" a ", "", "  ", 5, None, True, 1.5, ["x"], {"y": 1}, "check", "action", "resolution", "cause"])
    item = lambda: rng.choice([7, None, "text", []]) if rng.random() < 0.2 else {k: value() for k in ("quote", "kind", "section_role", "condition", "on_failure", "instruction") if rng.random() < 0.8}
    rows, want = [], []
    for i in range(400):
        items = rng.choice([None, 3, "s", {}]) if rng.random() < 0.1 else [item() for _ in range(rng.randint(0, 5))]
        data = json.dumps({"steps": items})
        data = data[:-2] if rng.random() < 0.1 else data
        text = "x" * (60_001 if rng.random() < 0.05 else 60_000 if rng.random() < 0.05 else 3)
        rows.append((i, text, data))
        try:
            read = json.loads(data)["steps"] if len(text) <= 60_000 else []
        except ValueError:
            read = []
        for n, x in enumerate(read if isinstance(read, list) else []):
            say = lambda k, x=x: x[k].strip() or None if isinstance(x, dict) and isinstance(x.get(k), str) else None
            role = say("section_role") if say("section_role") in ("resolution", "workaround", "prerequisite", "escalation", "other") else "other"
            wrong = "not_an_object" if not isinstance(x, dict) else "no_quote" if say("quote") is None else None if say("kind") in ("check", "action") else "bad_kind"
            want.append((i, n, say("quote"), say("kind"), role, say("condition"), say("on_failure"), say("instruction"), wrong))
    rows += [(900, None, "{}"), (901, "t", None), (902, "t", "")]
    answers = spark.createDataFrame(rows, "id long, text string, answer string")
    assert sorted(map(tuple, s.proposed_steps(answers).collect()), key=repr) == sorted(want, key=repr)
    report = {r.id: r for r in s.proposal_report(answers).collect()}
    assert len(report) == len(rows) and sum(r.steps for r in report.values()) == sum(w[-1] is None for w in want) and report[902].unreadable


def test_documents_are_chosen(spark):
    cand = [(q, n, f"p{n}", "t") for q in range(6) for n in (1, 2, 3)] + [(6, 1, "p1", "t"), (7, 1, None, "bare"), (7, 2, "", "none")]
    said = {0: "[3, 1, 3, 2]", 1: "[0, 4]", 2: "[true, 2.0, \"2\", 2]", 4: "[]", 6: "[9]", 7: "[2]"}
    answers = [(q, f'{{"indexes": {x}}}') for q, x in said.items()] + [(3, "{broken"), (5, None)]
    annex = [(q, n, f"p{n}", "t") for q in range(7) for n in (1, 2, 4)] + [(7, 1, "x", "none"), (7, 2, None, "none")]
    kind = "query long, place int, parent string, title string"
    found = s.chosen_documents(spark.createDataFrame(cand, kind), spark.createDataFrame(answers, "query long, answer string"), spark.createDataFrame(annex, kind), 2)
    told = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r.part, r.place)):
        told.setdefault((r["query"], r.part), []).append((r.key, r.expanded))
    primary = lambda q: told[q, "primary"]
    assert primary(0) == [("p3", True), ("p1", True)] and primary(1) == [("p1", False)] and primary(2) == [("p2", True)] and primary(3) == primary(5) == primary(6) == [("p1", True)]
    assert primary(4) == [("p1", False)] and primary(7) == [("none", True)]
    annexes = lambda q: [k for k, _ in told[q, "annex"]]
    assert annexes(0) == ["p2", "p4"] and annexes(1) == ["p1", "p2", "p4"] and annexes(2) == ["p1", "p4"] and annexes(7) == ["x"]


def test_the_boost_is_linear(spark):
    fields = spark.createDataFrame([(1, 1, "title", 1.0), (1, 1, "chunk", 2.0), (1, 2, "entities", 1.0), (1, 3, "title", 1.0), (1, 4, "other", 9.0), (2, 1, "chunk", 1.0)], "query long, doc long, field string, score double")
    tags = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a"), (3, "b")], "doc long, entity string")
    asked = spark.createDataFrame([(1, "a"), (1, "b")], "query long, entity string")
    found = [(r["query"], r.doc, r.score, r.boosted, r.rank) for r in s.profile_scores(fields, tags, asked, 3).orderBy("query", "rank").collect()]
    assert found == [(1, 1, 5.0, 12.5, 1), (1, 3, 3.0, 12.0, 2), (1, 2, 5.0, 5.0, 3), (2, 1, 1.0, 1.0, 1)]


def service(rows):
    def fetch(group, after, limit):
        left = [r for r in rows if (r["updated"], r["sys_id"]) > after]
        return sorted(left, key=lambda r: (r["updated"], r["sys_id"]))[:limit]

    return fetch


def test_tickets_are_polled_once_each_in_order(spark, tmp_path):
    rows = [{"sys_id": f"s{i:04}", "number": f"INC{i}", "assignment_group": "desk", "active": True, "updated": f"2024-01-01 00:{i // 40:02}:00", "mod_count": i} for i in range(330)]
    spark.dataSource.register(ticket_source(service(rows), "polled_tickets"))
    out, cp, fails = str(tmp_path / "out"), str(tmp_path / "cp"), [True]
    sizes = []

    def put(batch, k):
        sizes.append(batch.count())
        if k == 1 and fails.pop():
            raise RuntimeError("the writer is lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")

    def poll():
        stream = spark.readStream.format("polled_tickets").option("group", "desk").load()
        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", cp).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="the writer is lost"):
        poll()
    fails.append(False)
    poll()
    found = spark.read.parquet(out).orderBy("batch", "updated", "sys_id").collect()
    assert [r.sys_id for r in found] == [r["sys_id"] for r in rows] and max(sizes) == 100
    assert {type(r.active) for r in found} == {bool} and {r.mod_count for r in found} == set(range(330))


def test_a_profile_reads_the_texts_once(spark):
    """the plan of the ranks holds no tokens, the scores of the fields are a written table."""
    from askwright.plans import catalogue

    plan = catalogue.QUERIES["profile_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "regexp_extract_all" not in plan
