"""Streams: the guided session's state machine, the dictionary observer, upserts.

The transitions are pure functions over a state dictionary; the stream keeps the state by key, and the batch form folds a
key's events in order with the same functions, so both give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the session machine.
EXACT, MARGIN, JUDGED, ROUNDS, ATTEMPTS, SEEN, CANDIDATES = 2.0, 0.5, 1.0, 2, 2, 60, 5
STATE = "phase string, fiche string, step int, attempts int, rounds int, exact boolean, started boolean, events int"


def fresh() -> dict:
    return {"phase": "LOCATE", "fiche": "", "step": 0, "attempts": 0, "rounds": 0, "exact": False, "started": False, "events": 0, "seen": [], "rejected": [], "offered": []}


def _guide(s: dict, fiche: str, exact: bool) -> None:
    s |= {"phase": "GUIDING", "fiche": fiche, "exact": exact, "step": 0, "attempts": 0, "rounds": 0, "started": False, "offered": []}


def _locate(s: dict, candidates: list[tuple[str, float]], force_choice: bool = False, judged: str | None = None) -> None:
    left = [(f, x) for f, x in candidates if f not in s["rejected"]][:CANDIDATES]
    if not left:
        s["phase"] = "OPEN"
        return
    s["phase"] = "LOCATE"
    top = left[0][1]
    strong = top >= EXACT and (len(left) == 1 or top - left[1][1] >= MARGIN)
    picked = next((f for f, x in left[:3] if f == judged and x >= JUDGED), None)
    if not force_choice and strong and judged in (None, left[0][0]):
        _guide(s, left[0][0], True)
    elif not force_choice and not strong and picked is not None:
        _guide(s, picked, True)
    elif not force_choice and s["rounds"] >= ROUNDS:
        _guide(s, left[0][0], False)
    else:
        s["offered"] = [f for f, _ in left[:3]]
        s["rounds"] += 1


def advance(s: dict, event_id: str, kind: str, action: str, candidates: list[tuple[str, float]], n_steps: int = 3, judged: str | None = None) -> dict:
    """One event.  Seen ids (the last 60), a solved session and empty events change nothing.  Past the last of n_steps comes the
    step that verifies; judged: the candidate that a judge names, if any."""
    if event_id in s["seen"] or s["phase"] == "SOLVED" or not (kind or action):
        return s
    s["seen"] = [*s["seen"], event_id][-SEEN:]
    s["events"] += 1
    text = kind == "text"
    if s["phase"] == "STUCK":
        s |= {"rejected": [], "rounds": 0}
        _locate(s, candidates, judged=judged)
    elif s["phase"] == "LOCATE":
        if action.startswith("pick:") and action[5:].isdigit() and 1 <= int(action[5:]) <= len(s["offered"]):
            _guide(s, s["offered"][int(action[5:]) - 1], True)
        elif action == "none":
            s["rejected"] = s["rejected"] + s["offered"]
            _locate(s, candidates, judged=judged)
        elif text:
            _locate(s, candidates, judged=judged)
    elif s["phase"] == "GUIDING" and not s["started"]:  # the guide is shown: started, refused, or more is said
        if action == "start":
            s |= {"started": True, "step": 1}
        elif action == "wrong_fiche":
            s |= {"rejected": [*s["rejected"], s["fiche"]], "rounds": 0}
            _locate(s, candidates, force_choice=True)
        elif text and not action:
            s["rounds"] = 0
            _locate(s, candidates, judged=judged)
    elif s["phase"] == "GUIDING":
        if action == "solved_yes":
            s["phase"] = "SOLVED"
        elif action in ("solved_no", "wrong_fiche"):
            s |= {"rejected": [*s["rejected"], s["fiche"]], "rounds": 0}
            _locate(s, candidates, force_choice=True)
        elif action == "done":
            s |= {"step": min(s["step"], n_steps) + 1, "attempts": 0}
        elif action == "back":
            s |= {"step": max(1, min(s["step"], n_steps + 1) - 1), "attempts": 0}
        elif action == "blocked" or text:
            s["attempts"] += 1
    elif s["phase"] == "OPEN":
        if action == "solved_yes":
            s["phase"] = "SOLVED"
        elif text and action != "solved_no":
            s |= {"rejected": [], "rounds": 0}
            _locate(s, candidates, judged=judged)
    return s


def offers_other(state: DataFrame) -> DataFrame:
    """Of sessions that follow a guide: whether another one is offered, after ATTEMPTS tries at a step."""
    return state.where("phase = 'GUIDING' AND started").select("session", (F.col("attempts") >= ATTEMPTS).alias("offer_other"))


def _rows(key: tuple, s: dict) -> pd.DataFrame:
    return pd.DataFrame([[*key, *[s[c.split(" ")[0]] for c in STATE.split(", ")]]], columns=["session", *[c.split(" ")[0] for c in STATE.split(", ")]])


def _fold(s: dict, rows: pd.DataFrame) -> dict:
    for e in rows.sort_values(["ord"], kind="stable").itertuples():
        more = {k: v for k in ("n_steps", "judged") if (v := getattr(e, k, None)) is not None}
        s = advance(s, e.event_id, e.kind or "", e.action or "", list(zip(e.fiches, map(float, e.scores))), **more)
    return s


def sessions_batch(events: DataFrame) -> DataFrame:
    """events: session, ord, event_id, kind, action, fiches, scores.  The state of each session after all its events."""
    return events.groupBy("session").applyInPandas(lambda key, rows: _rows(key, _fold(fresh(), rows)), f"session bigint, {STATE}")


def sessions_stream(events: DataFrame) -> DataFrame:
    """The same over a stream: state by session, one row for each session that a micro-batch touches."""
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else fresh()
        s = _fold(s, pd.concat(list(batches)))
        state.update((json.dumps(s),))
        yield _rows(key, s)

    return events.groupBy("session").applyInPandasWithState(step, f"session bigint, {STATE}", "state string", "update", "NoTimeout")


def observe(events: DataFrame, memory: int = 8, least: int = 3) -> DataFrame:
    """events: term, session, ord.  Times a term was seen in a session not among its last `memory` ones; ready at `least`.

    The memory is bounded on purpose: an old session counts again.  An array of eight is all that the fold keeps.
    """
    ordered = events.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("ord", "session"))).alias("l"))
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<bigint>)").alias("last"))

    def step(acc, x):
        new = ~F.array_contains(acc["last"], x["session"])
        last = F.when(new, F.slice(F.concat(F.array(x["session"]), acc["last"]), 1, memory)).otherwise(acc["last"])
        return F.struct((acc["n"] + new.cast("int")).alias("n"), last.alias("last"))

    return ordered.select("term", F.aggregate("l", start, step)["n"].alias("seen")).withColumn("ready", F.col("seen") >= least)


def upsert_sink(path: str, keys: list[str], version: str):
    """foreachBatch function: the table at path holds the highest version of each key; replays change nothing.

    Each batch writes a new folder and the pointer file comes last, so readers never see half a batch."""
    def put(batch: DataFrame, epoch: int) -> None:
        from askwright.operators.itsm import latest
        from askwright.sources.runs import publish, read_latest

        old = read_latest(batch.sparkSession, path)
        rows = batch if old is None else batch.unionByName(old)
        publish(latest(rows, keys, [F.desc(version)]), path, f"epoch-{epoch}")

    return put
