"""What the catalogues share: tables, registration, fixture rows for both sides of a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(value: Column, places: int) -> Column:
    """round() of SQL on doubles: the product with a power of ten is rounded, half away from zero.  F.round() rounds the shortest
    decimal form, which may lie on a half where the product does not."""
    return F.round(value * 10.0**places, 0) / 10.0**places


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def put(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], schema: str) -> str:
    """The rows as a SQL sub-select; schema as in createDataFrame ("a string, b array<string>")."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}
    names, casts = [], []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        names.append(name)
        casts.append(f"CAST({name} AS {kinds[kind]}) AS {name}")
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(casts)} FROM (VALUES {body}) AS v({', '.join(names)}))"


def _numbered(rows: list[tuple], schema: str) -> tuple[list[tuple], str]:
    """Fixture rows with the ids 1 to n, their id as a place from 0."""
    if sorted({r[0] for r in rows}) != list(range(1, len({r[0] for r in rows}) + 1)) or not schema.startswith("id int, "):
        raise ValueError("fixture rows have the ids 1 to n")
    return [(r[0] - 1, *r[1:]) for r in rows], "k int, " + schema.removeprefix("id int, ")


def planted(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str, text: tuple[str, ...] = ()) -> DataFrame:
    """The fixture's rows planted into all documents: document i takes those of the number i modulo n; columns of `text` go on
    with the document's own text, whole.  The id is the document's."""
    numbered, kind = _numbered(rows, schema)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("__text"))
    n = len({r[0] for r in rows})
    fixture = F.broadcast(spark.createDataFrame(numbered, kind))  # a few rows
    joined = docs.join(fixture, F.col("id") % n == F.col("k"))
    names = [c.split(" ")[0] for c in kind.split(", ")[1:]]
    return joined.select("id", *[F.concat_ws("\n", c, "__text").alias(c) if c in text else F.col(c) for c in names])


def planted_sql(rows: list[tuple], schema: str, text: tuple[str, ...] = ()) -> str:
    """planted() as a SQL sub-select."""
    numbered, kind = _numbered(rows, schema)
    n = len({r[0] for r in rows})
    names = [c.split(" ")[0] for c in kind.split(", ")[1:]]
    cols = ", ".join(f"concat_ws(chr(10), f.{c}, documents.text) AS {c}" if c in text else f"f.{c}" for c in names)
    return f"(SELECT doc_id AS id, {cols} FROM documents JOIN {values(numbered, kind)} f ON f.k = doc_id % {n})"
