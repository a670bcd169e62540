import json

import pytest
from pyspark.sql import functions as F

from askwright.sources import records as rec
from askwright.sources.tables import InputError
from askwright.streaming import windows


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_articles_and_decomposed_articles(spark, tmp_path):
    path = lines(tmp_path / "f.jsonl", [{"fiche_id": "F1", "client": "a", "text": "x", "meta": {"k": "v"}}, {"fiche_id": "F2", "client": "b", "title": "T", "text": "y"}, {"fiche_id": "F3", "text": "z"}])
    assert [(r.fiche_id, r.title, r.client) for r in rec.read_fiches(spark, path, "a").orderBy("fiche_id").collect()] == [("F1", "F1", "a"), ("F3", "F3", "a")]
    with pytest.raises(InputError):
        rec.read_fiches(spark, path)  # one has no client
    step = {"n": 1, "start": 0, "end": 3, "text": "abc", "kind": "action", "role": "resolution"}
    whole = {"fiche_id": "D1", "client": "a", "text": "abc", "status": "guided", "steps": [step], "entities": [{"canonical": "app:teams", "kind": "app", "count": 2}]}
    (row,) = rec.read_decomposed(spark, lines(tmp_path / "d.jsonl", [whole])).collect()
    assert row.steps[0].text == "abc" and row.entities[0]["count"] == 2
    with pytest.raises(InputError):
        rec.read_decomposed(spark, lines(tmp_path / "d2.jsonl", [whole, whole]))


def test_tickets_and_results(spark, tmp_path):
    good = [{"ticket_id": " T1 ", "client": "a", "text": "t", "expected": ["F1", "F1"], "notes": " "}, {"ticket_id": "T1", "client": "b", "text": "t", "expected": []}, {"ticket_id": "T2", "client": "a", "text": "t"}]
    rows = {(r.client, r.ticket_id): r for r in rec.read_tickets(spark, lines(tmp_path / "t.jsonl", good)).collect()}
    assert rows["a", "T1"].expected == ["F1"] and rows["a", "T1"].notes is None and rows["b", "T1"].expected == [] and rows["a", "T2"].expected is None
    for bad in ([*good, {"ticket_id": "T2", "client": "a", "text": "again"}], [{"ticket_id": "T", "client": "a", "text": " "}]):
        with pytest.raises(InputError):
            rec.read_tickets(spark, lines(tmp_path / "bad.jsonl", bad))
    (tmp_path / "broken.jsonl").write_text('{"ticket_id": \n', encoding="utf-8")
    with pytest.raises(InputError):
        rec.read_tickets(spark, str(tmp_path / "broken.jsonl"))
    record = {"engine": "e", "run": 1, "ticket_id": "T1", "client": "a", "expected": [], "kind": "fiche", "fiches": ["F1"], "route": {"level": "L1"}}
    assert rec.read_results(spark, lines(tmp_path / "r.jsonl", [record])).first().route.level == "L1"
    for change in ({"fiches": []}, {"kind": "guess"}, {"route": {"level": "L9"}}, {"engine": None}):
        with pytest.raises(InputError):
            rec.read_results(spark, lines(tmp_path / "r2.jsonl", [record | change]))


def test_labels_references_and_exports(spark):
    rows = spark.createDataFrame([("ref-1", " a \n b ", '["F1"]', False), ("x", "t", "[]", True), ("ref-2", "t", "broken", False), ("ref-3", " ", "[]", False)], "id string, text string, expected string, skipped boolean")
    assert {r.id: r.expected for r in rec.labels_of(rows).collect()} == {"ref-1": ["F1"], "ref-3": []}
    assert [(r.id, r.text, r.expected) for r in rec.references_of(rows).collect()] == [("ref-1", "a b", ["F1"])]
    export = spark.createDataFrame(
        [("I100_1", 2, "Titre", "Bonjour Luc,\nécrire à a@b.fr", "Luc MARTIN", "z"), ("I100_1", 1, "Premier", "MARTIN Luc appelle", "Luc MARTIN", "z"), ("total", 3, "", "", "", "")],
        "num string, ord int, titre string, description string, demandeur string, autre string",
    )
    found, unknown = rec.scrub_export(export, "num", "ord", ["titre", "description"], ["description"], ["demandeur"])
    assert [tuple(r) for r in found.collect()] == [("I100_1", "Premier", "[nom] appelle")] and unknown == ["autre"]
    assert rec.resolve_headers(["N° de Ticket", "Étage"], ["etage", "absent"], spark) == {"etage": "Étage", "absent": None}


def test_polling_pulling_and_windows_of_streams(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    schema = "number string, active boolean, assignment_group string"
    for k in range(2):
        lines(source / f"{k}.json", [{"number": f"INC{k}", "active": True, "assignment_group": "a"}, {"number": f"X{k}", "active": k > 5, "assignment_group": "a"}, {"number": f"Y{k}", "active": True, "assignment_group": "z"}])
    query = windows.poll_into(windows.polled(spark, str(source), schema, ["a"]), lambda rows, batch: seen.append((batch, sorted(r.number for r in rows.collect()))), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted(x for _, found in seen for x in found) == ["INC0", "INC1"] and len(seen) == 2
    files = tmp_path / "files"
    files.mkdir()
    for name in ("a.PDF", "b.mp4", "c.md", "d"):
        (files / name).write_bytes(b"x")
    pulled = []
    windows.poll_into(windows.pulled(spark, str(files), exclude=["md"]), lambda rows, _: pulled.extend(r.extension for r in rows.collect()), str(tmp_path / "cp2")).awaitTermination(120)
    assert pulled == ["pdf"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    for name, make in (("sliding", lambda e: windows.sliding_counts(e, "ts", "event_type", late="60 days")), ("sessions", lambda e: windows.session_windows(e, "ts", "user_id", late="60 days"))):
        made = make(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "sliding" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        made.awaitTermination(180)
        got, want = {tuple(r) for r in spark.table(name).collect()}, {tuple(r) for r in make(events).collect()}
        assert got <= want and (name == "sessions" or got == want)
    assert events.select(windows.session_id(F.lit(" INC7 "))).first()[0] == "sn-inc7"
