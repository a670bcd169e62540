"""Stateful processors in streams: equal to the batch fold, restarted from a checkpoint, forgetting by age."""

import time

import pytest

from askwright.streaming import processors, sessions

EVENT = "session bigint, ord bigint, event_id string, kind string, action string, fiches array<string>, scores array<double>"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(stream, name, checkpoint, mode="update", ages=False):
    """ages: with a time to live there is always a next micro-batch, as state may age, so one is run and no more."""
    trigger = {"once": True} if ages else {"availableNow": True}
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, k: rows.write.mode("append").parquet(name)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    assert query.awaitTermination(120)


def event_rows():
    kinds = [("text", ""), ("action", "start"), ("action", "done"), ("text", ""), ("action", "wrong_fiche"), ("action", "pick:2"), ("action", "solved_yes"), ("action", "none"), ("action", "blocked")]
    rows = []
    for i in range(240):
        kind, action = kinds[(i * 7 + i // 9) % len(kinds)]
        session = i % 8
        rows.append((session, i, str(i if i % 11 else i - 8), kind, action, [f"F{i % 5}", f"G{i % 3}"], [(i % 4) / 1.5, 0.5]))
    return rows


def test_stream_equals_batch_over_a_restart(rocks, tmp_path):
    spark, source, out, cp = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    events = spark.createDataFrame(event_rows(), EVENT)
    part = lambda k: events.where(f"ord >= {k * 80} AND ord < {(k + 1) * 80}").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: processors.sessions(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source))
    part(0)
    part(1)
    run(stream(), out, cp)
    part(2)
    run(stream(), out, cp)  # goes on from the checkpoint: typed states are read again
    run(stream(), out, cp)  # nothing new: nothing told twice
    rows = spark.read.parquet(out)
    assert rows.count() == 3 * 8
    last = {r.session: r for r in sorted(rows.collect(), key=lambda r: r.events)}
    want = {r.session: r for r in sessions.sessions_batch(events).collect()}
    assert {k: tuple(r) for k, r in last.items()} == {k: tuple(r) for k, r in want.items()} and len({r.phase for r in want.values()}) > 1


def test_ports_are_parameters(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "in")
    spark.createDataFrame([(1, 0, "a", "text", "", ["F", "G0"], [1.5, 1.2])], EVENT).write.parquet(source)
    stream = processors.sessions(spark.readStream.schema(EVENT).parquet(source), processors.Ports(judge=lambda event: "G0"))
    run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (row.phase, row.fiche, row.exact) == ("GUIDING", "G0", True)


def test_old_sessions_are_forgotten(rocks, tmp_path):
    spark, source, out, cp = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    say = lambda n: spark.createDataFrame([(1, n, str(n), "text", "", ["F"], [3.0])], EVENT).coalesce(1).write.mode("append").parquet(source)
    age = 30_000
    for wait, n in ((0, 0), (0, 1), (35, 2)):
        time.sleep(wait)
        say(n)
        run(processors.sessions(spark.readStream.schema(EVENT).parquet(source), age_ms=age), out, cp, ages=True)
    assert sorted(r.events for r in spark.read.parquet(out).collect()) == [1, 1, 2]  # the third event met no state


def test_answers_live_for_their_time(rocks, tmp_path):
    spark, source, out, cp = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for n, wait in ((0, 0), (1, 0), (2, 40)):
        time.sleep(wait)
        spark.createDataFrame([("a", n), ("a", n + 10), ("b" if n else "c", n)], "key string, request bigint").coalesce(1).write.mode("append").parquet(source)
        run(processors.kept_answers(spark.readStream.schema("key string, request bigint").parquet(source), lambda key: f"answer to {key}", 35_000), out, cp, "append", ages=True)
    found = {(r.key, r.request): (r.answer, r.hit) for r in spark.read.parquet(out).collect()}
    assert len(found) == 9 and {a for (k, _), (a, _) in found.items() if k == "a"} == {"answer to a"}
    hits = lambda n: sum(found["a", r][1] for r in (n, n + 10))
    assert (hits(0), hits(1), hits(2)) == (1, 2, 1) and not found["c", 0][1] and not found["b", 1][1]


@pytest.mark.parametrize(
    "steps, want",
    [
        ([("text", ""), ("action", "solved_yes")], ("GUIDING", 0)),  # before the steps have started, nothing is solved
        ([("text", ""), ("action", "solved_no")], ("GUIDING", 0)),
        ([("text", ""), ("action", "start"), ("action", "solved_yes")], ("SOLVED", 0)),
        ([("text", ""), ("action", "wrong_fiche")], ("LOCATE", 1)),  # one round, whatever came before
    ],
)
def test_transitions_of_the_preview(steps, want):
    s = sessions.fresh()
    s["rounds"] = 2
    for n, (kind, action) in enumerate(steps):
        s = sessions.advance(s, str(n), kind, action, [("F", 3.0), ("G", 1.0)])
    assert (s["phase"], s["rounds"]) == want


def test_text_in_open_starts_the_rounds_anew():
    s = sessions.fresh() | {"phase": "OPEN", "rounds": 2, "rejected": ["F"]}
    s = sessions.advance(s, "1", "text", "", [("F", 1.0), ("G", 0.9)])
    assert (s["phase"], s["rounds"], s["offered"]) == ("LOCATE", 1, ["F", "G"])
