"""Tickets polled from a service as a stream: a Python data source with offsets by time of update."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

FIELDS = ["sys_id", "number", "assignment_group", "active", "short_description", "description", "updated", "mod_count"]
SCHEMA = "sys_id string, number string, assignment_group string, active boolean, short_description string, description string, updated string, mod_count int"
MOST = 100  # tickets a micro-batch


def ticket_source(fetch: Callable[[str, tuple[str, str], int], list[dict]], name: str = "tickets") -> type[DataSource]:
    """A data source to register: spark.dataSource.register(ticket_source(fetch)); then
    spark.readStream.format(name).option("group", ...).load().

    fetch(group, after, limit) asks the service for the active tickets of a group whose (updated, sys_id) is greater than `after`,
    the least first, `limit` at most; it travels with the source, so it must be picklable.  A micro-batch has 100 tickets at
    most, in order of update.  The offset is the last ticket's (updated, sys_id): two tickets of one second are told apart, and
    a batch that is replayed after a failure asks for what lies between its two offsets, so no ticket is told twice.
    """

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, group: str, most: int):
            self.group, self.most = group, most

        def initialOffset(self) -> dict:
            return {"updated": "", "sys_id": ""}

        def _after(self, start: dict, limit: int) -> list[dict]:
            rows = [r for r in fetch(self.group, (start["updated"], start["sys_id"]), limit) if r["active"] and r["assignment_group"] == self.group]
            return sorted(rows, key=lambda r: (r["updated"], r["sys_id"]))[:limit]

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = self._after(start, self.most)
            end = {"updated": rows[-1]["updated"], "sys_id": rows[-1]["sys_id"]} if rows else start
            return iter([tuple(r.get(f) for f in FIELDS) for r in rows]), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            last = (end["updated"], end["sys_id"])
            return iter([tuple(r.get(f) for f in FIELDS) for r in self._after(start, self.most) if (r["updated"], r["sys_id"]) <= last])

    class Tickets(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Reader(self.options["group"], int(self.options.get("most", MOST)))

    return Tickets
