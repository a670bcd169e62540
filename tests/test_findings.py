"""Cases that findings of reviews named."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from askwright.operators import calibration, ranking
from askwright.operators import vector_index as vi
from askwright.plans import catalogue, rank

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings benchmark labels".split()


def tables(spark, folder, **changed):
    """The smallest tables in a folder of their own, some of them replaced by the result of a SQL text."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"COPY ({changed.get(t, f'SELECT * FROM {t}')}) TO '{folder}/{t}.parquet'")
    for t in TABLES:
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def same(spark, con, folder, name):
    frame = catalogue.QUERIES[name](spark, str(folder))
    got = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in frame.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in frame.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert got == sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want), key=repr) and got


ENTRY = "entry long, fiche int, vector array<float>"


def test_blocks_and_parts_give_the_same(spark, monkeypatch):
    """Equal scores, a missing vector and one of another length, whatever the blocks and parts that they fall in."""
    rows = [(i, i % 3, [1.0, float(i % 4)]) for i in range(40)] + [(40, 1, None), (41, 2, [1.0]), (42, 7, None)]
    entries = spark.createDataFrame(rows, ENTRY).withColumn("vector", ranking.unit(F.col("vector")))
    asked = entries.where("entry % 10 = 0 OR entry > 39").selectExpr("entry AS query", "fiche AS own", "vector")
    one = sorted(map(tuple, ranking.rank_entries(asked, entries).collect()), key=repr)
    near = sorted(map(tuple, vi.exact(asked.drop("own"), entries).collect()), key=repr)
    monkeypatch.setattr(ranking, "ASKED_BLOCK", 2)
    monkeypatch.setattr(ranking, "ENTRY_PART", 7)
    monkeypatch.setattr(ranking, "TILE", 5)
    assert sorted(map(tuple, ranking.rank_entries(asked, entries).collect()), key=repr) == one
    assert sorted(map(tuple, vi.exact(asked.drop("own"), entries).collect()), key=repr) == near
    assert (0, 0, 0, 1.0, 12) in one and (0, 0, 1, 1.0, 4) in one and (0, 0, 7, None, 42) in one
    assert [r[1] for r in sorted((r for r in near if r[0] == 0), key=lambda r: r[4])] == [4, 8, 12, 16, 20]


def test_products_are_made_once_and_not_row_by_row(spark, monkeypatch):
    """The grid reads a written table of ranks, and no operator of the plan pairs rows by a nested loop or a cartesian product."""
    ranks = rank.vector_scores(spark, SF)
    plan = ranks._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "FlatMapCoGroupsInArrow" not in calibration.measure_grid(ranks)._jdf.queryExecution().toString()


def test_cached_answers_take_the_nearest_second(spark, tmp_path):
    con = tables(spark, tmp_path, events="SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i * 1_200_000_000 + i * i * 137_113 % 1_000_000) AS ts, 0 AS user_id, 'view' AS event_type, 1.0 AS value, '' AS props FROM range(200) r(i)")
    same(spark, con, tmp_path, "cached_answers")


#: Prices whose quotient lies on a half in its shortest form and not as a product of doubles, and one that is 0.12 above.
HALVES = "SELECT * REPLACE (CASE l_partkey % 4 WHEN 0 THEN 109500.5 WHEN 1 THEN 110195.0 WHEN 2 THEN 21350.0 ELSE 620.0 END AS l_extendedprice) FROM lineitem"


@pytest.mark.parametrize("name", ["close_candidates", "words_ladder", "threshold_sweep"])
def test_scores_are_rounded_as_sql_rounds(spark, tmp_path, name):
    same(spark, tables(spark, tmp_path, lineitem=HALVES), tmp_path, name)


def test_number_table_knows_every_number(spark, tmp_path):
    far = {"lineitem": "SELECT * REPLACE (l_partkey + 2_000_000 AS l_partkey) FROM lineitem", "part": "SELECT * REPLACE (p_partkey + 2_000_000 AS p_partkey) FROM part"}
    same(spark, tables(spark, tmp_path, **far), tmp_path, "number_table")


def test_sentence_steps_are_the_planted_ones(spark, tmp_path):
    text = "'Ne. Test der Zeit. Weiter.' || chr(10) || 'b' || chr(10) || 'c. Cliquez ici.'"
    same(spark, tables(spark, tmp_path, documents=f"SELECT * REPLACE ({text} AS text) FROM documents WHERE doc_id < 5"), tmp_path, "sentence_steps")


def test_the_sampled_sweep_gives_every_threshold(spark, tmp_path):
    found = catalogue.QUERIES["sampled_sweep"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/orders.parquet").count() and 20 <= sum(r.sampled for r in found) < len(found)
    same(spark, tables(spark, tmp_path), tmp_path, "sampled_sweep")


def test_outcomes_leave_sessions_where_they_are(spark):
    plan = catalogue.QUERIES["session_outcomes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and plan.count("Aggregate") == 1  # of the rules alone


def test_closure_is_dealt_out_in_bounded_parts(spark, monkeypatch):
    from askwright.operators import measurement as m

    monkeypatch.setattr(m, "CLOSED", 2)
    asked = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "a")], "ticket_id long, fiche string")
    led = m.accepted_closure(asked, spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "c")], "fiche string, target string"))
    assert sorted(map(tuple, led.collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (3, "c"), (4, "a"), (4, "b"), (4, "c")]


def test_the_discriminator_deals_rows_out_once(spark):
    plan = catalogue.QUERIES["discriminator"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


#: No id is divisible by 20; equal vectors, lines of no fiche and a fiche of one line.
ODD_IDS = """SELECT vec_id * 20 + 1 AS vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x, i: CAST(i + 1 AS FLOAT)) ELSE embedding END AS embedding,
 CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id = 3 THEN 99 ELSE label END AS label FROM embeddings WHERE vec_id < 120 UNION ALL SELECT NULL, embedding, label FROM embeddings WHERE vec_id = 5"""
SMALL = {"PAIR_BLOCK": 40, "PAIR_BLOCKS": 3, "TILE": 150, "SIDE": 7}


def test_every_line_is_held_against_its_fiche(spark, tmp_path, monkeypatch):
    """not only the lines whose id is divisible by 20."""
    con = tables(spark, tmp_path, embeddings=ODD_IDS)
    same(spark, con, tmp_path, "vector_drop_rule")
    for name, value in SMALL.items():
        monkeypatch.setattr(ranking, name, value)
    same(spark, con, tmp_path, "vector_drop_rule")


def odd_entries(spark):
    rows = [(i, i % 3, [1.0, float(i % 4)]) for i in range(40)] + [(40, 1, None), (41, 2, [1.0]), (42, 7, None), (43, None, [1.0, 3.0]), (44, None, [2.0, 2.0]), (45, 8, [float("nan"), 1.0])]
    entries = spark.createDataFrame(rows, ENTRY).withColumn("vector", ranking.unit(F.col("vector")))
    return entries, ranking.rank_entries(entries.selectExpr("entry AS query", "fiche AS own", "vector"), entries)


def test_own_and_other_whatever_the_blocks(spark, monkeypatch):
    entries, ranked = odd_entries(spark)
    want = ranked.groupBy("query").agg(F.max(F.when(F.col("fiche") == F.col("own"), F.col("score"))).alias("o"), F.max(F.when(F.col("fiche") != F.col("own"), F.col("score"))).alias("b"))
    want = sorted(map(tuple, want.collect()), key=repr)
    for block in (50, 9):
        monkeypatch.setattr(ranking, "PAIR_BLOCK", block)
        monkeypatch.setattr(ranking, "SIDE", block // 3)
        assert repr(sorted(map(tuple, ranking.own_and_other(entries).collect()), key=repr)) == repr(want)


def test_recall_asks_every_entry(spark, tmp_path, monkeypatch):
    """not only the entries whose id is divisible by 20."""
    con = tables(spark, tmp_path, embeddings=ODD_IDS)
    same(spark, con, tmp_path, "recall_at_k")
    for name, value in SMALL.items():
        monkeypatch.setattr(ranking, name, value)
    same(spark, con, tmp_path, "recall_at_k")
    assert catalogue.QUERIES["recall_at_k"](spark, str(tmp_path)).first()["n"] == 120


def test_first_fiches_whatever_the_blocks(spark, monkeypatch):
    entries, ranked = odd_entries(spark)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("fiche")))
    want = ranked.withColumn("rank", rank).where("rank <= 2").select("query", "own", "fiche", "score", "rank")
    want = repr(sorted(map(tuple, want.collect()), key=repr))
    for block in (50, 9):
        monkeypatch.setattr(ranking, "PAIR_BLOCK", block)
        monkeypatch.setattr(ranking, "SIDE", block // 3)
        assert repr(sorted(map(tuple, ranking.first_fiches(entries, 2).collect()), key=repr)) == want


def test_a_norm_is_taken_once_a_vector(spark):
    """not for each of its numbers; null, empty and zero vectors and nulls within stay what they were."""
    rows = [(0, 0, [3.0, 4.0]), (1, 0, [0.0, 0.0]), (2, 0, []), (3, 0, None), (4, 0, [1.0, None]), (5, 0, [float("nan"), 1.0])]
    got = spark.createDataFrame(rows, ENTRY).withColumn("vector", ranking.unit(F.col("vector")))
    assert repr([r.vector for r in got.orderBy("entry").collect()]) == repr([[0.6000000238418579, 0.800000011920929], [0.0, 0.0], [], None, [1.0, None], [float("nan")] * 2])
    assert ranking.unit(F.col("vector"))._jc.toString().count("aggregate") == 1
