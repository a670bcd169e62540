"""Stateful processors: sessions with typed state and an age limit, and answers that are kept for a while.

Both run in streams through transformWithStateInPandas; the session needs the RocksDB state store
(spark.sql.streaming.stateStore.providerClass), as typed states have column families of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from askwright.streaming.sessions import SEEN, STATE, advance, fresh

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = [c.split(" ")[0] for c in STATE.split(", ")]


def event_candidates(event) -> list[tuple[str, float]]:
    return list(zip(event.fiches, map(float, event.scores)))


@dataclass(frozen=True)
class Ports:
    """What a session asks of the outside, as functions of an event: the candidates that a search finds, the one that a judge
    names, and how many steps a guide has.  They travel with the processor, so they must be picklable."""

    candidates: Callable = event_candidates
    judge: Callable = lambda event: getattr(event, "judged", None)
    steps: Callable = lambda event: getattr(event, "n_steps", None) or 3


class SessionProcessor(StatefulProcessor):
    """The session machine: its scalars are a value, the articles refused and offered are lists, the ids of events are a map from
    id to order of arrival.  With an age limit, what was not touched for that long is forgotten by the store itself."""

    def __init__(self, ports: Ports = Ports(), age_ms: int | None = None):
        self.ports, self.age_ms = ports, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", STATE, self.age_ms)
        self.rejected = handle.getListState("rejected", "fiche string", self.age_ms)
        self.offered = handle.getListState("offered", "fiche string", self.age_ms)
        self.seen = handle.getMapState("seen", "event_id string", "at int", self.age_ms)

    def _read(self) -> dict:
        if not self.core.exists():
            return fresh()
        s = fresh() | dict(zip(FIELDS, self.core.get()))
        s["rejected"] = [r[0] for r in self.rejected.get()] if self.rejected.exists() else []
        s["offered"] = [r[0] for r in self.offered.get()] if self.offered.exists() else []
        s["seen"] = [k for k, _ in sorted(((k[0], v[0]) for k, v in self.seen.iterator()), key=lambda x: x[1])] if self.seen.exists() else []
        return s

    def _write(self, s: dict) -> None:
        self.core.update(tuple(s[f] for f in FIELDS))
        for state, rows in ((self.rejected, s["rejected"]), (self.offered, s["offered"])):
            state.put([(x,) for x in rows]) if rows else state.clear()
        self.seen.clear()
        for at, event_id in enumerate(s["seen"][-SEEN:]):
            self.seen.updateValue((event_id,), (at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._read()
        for e in pd.concat(list(rows)).sort_values("ord", kind="stable").itertuples():
            s = advance(s, e.event_id, e.kind or "", e.action or "", self.ports.candidates(e), self.ports.steps(e), self.ports.judge(e))
        self._write(s)
        yield pd.DataFrame([[*key, *[s[f] for f in FIELDS]]], columns=["session", *FIELDS])

    def close(self) -> None:
        pass


def sessions(events: DataFrame, ports: Ports = Ports(), age_ms: int | None = None) -> DataFrame:
    """events: session, ord, event_id, kind, action, fiches, scores, a stream.  One row for each session that a micro-batch
    touches: its state after the events.  Events of one micro-batch count by ord; an id seen among the last 60 counts once."""
    return events.groupBy("session").transformWithStateInPandas(SessionProcessor(ports, age_ms), f"session bigint, {STATE}", "update", "processingtime" if age_ms else "none")


class AnswerKeeper(StatefulProcessor):
    """Answers by key, kept for a time to live from when they were made: a hit does not renew one."""

    def __init__(self, answer: Callable[[object], str], ttl_ms: int):
        self.answer, self.ttl_ms = answer, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "answer string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            hit = self.kept.exists()
            answer = self.kept.get()[0] if hit else self.answer(key[0])
            if not hit:
                self.kept.update((answer,))
            yield pd.DataFrame({"key": [key[0]] * len(batch), "request": batch["request"].to_numpy(), "answer": [answer] * len(batch), "hit": [hit] + [True] * (len(batch) - 1)})

    def close(self) -> None:
        pass


def kept_answers(requests: DataFrame, answer: Callable[[object], str], ttl_ms: int) -> DataFrame:
    """requests: key string, request bigint, a stream.  key, request, answer, hit: the answer to each request, from what is kept
    of its key if that is younger than the time to live."""
    return requests.groupBy("key").transformWithStateInPandas(AnswerKeeper(answer, ttl_ms), "key string, request bigint, answer string, hit boolean", "append", "processingtime")
