"""Every query with SQL against DuckDB on the smallest tables; streams against their batch forms."""

import os

import duckdb
import pandas as pd
import pytest

from askwright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def value(x):
        if x is None or x is pd.NA or x is pd.NaT:
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        if isinstance(x, int):
            return round(float(x), 6)
        return str(x) if isinstance(x, pd.Timestamp) else x

    cols = sorted(df.columns)
    return [cols, *sorted((tuple(value(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_queries_without_sql_give_rows(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_session_stream_equals_batch(spark, tmp_path):
    from askwright.plans.stream import session_events
    from askwright.streaming import sessions

    events = session_events(spark, SF).orderBy("ord")
    source = str(tmp_path / "in")
    for k in range(3):  # three micro-batches, in order of time
        events.where(f"ord >= {k * 400} and ord < {(k + 1) * 400}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = sessions.sessions_stream(stream).writeStream.outputMode("update").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("sessions_out").toPandas().sort_values("events").groupby("session").last().reset_index()
    want = sessions.sessions_batch(events).toPandas()
    assert rows(last[sorted(want.columns)]) == rows(want)


def test_upsert_sink_and_runs(spark, tmp_path):
    from askwright.sources import runs
    from askwright.streaming.sessions import upsert_sink

    path = str(tmp_path / "table")
    put = upsert_sink(path, ["k"], "v")
    assert runs.read_latest(spark, path) is None
    put(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), 0)
    put(spark.createDataFrame([(1, 3), (2, 0)], "k int, v int"), 1)
    put(spark.createDataFrame([(1, 3), (2, 0)], "k int, v int"), 1)
    assert sorted(map(tuple, runs.read_latest(spark, path).collect())) == [(1, 3), (2, 1)] and runs.latest_run(spark, path) == "epoch-1"


def test_tables_are_read(spark, tmp_path):
    from askwright.sources import tables

    p = tmp_path / "t.csv"
    p.write_text('Numéro;Texte;\n1;"a;b\nc";x\n2;d;y\n', encoding="utf-8")
    df = tables.read_rows(spark, str(p))
    assert df.columns[:2] == ["Numéro", "Texte"] and df.count() == 2
    assert tables.resolve_column(df.columns, "numero") == "Numéro"
    with pytest.raises(tables.InputError):
        tables.resolve_column(df.columns, "absent")
    assert tables.decode_bytes(b"\xe9t\xe9") == "été" and tables.guess_delimiter("a,b;c;d") == ";" and os.path.exists(p)
