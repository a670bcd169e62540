"""The index of cells against all entries."""

import numpy as np

from askwright.operators import vector_index as vi

SCHEMA = "entry long, fiche long, vector array<float>"


def frames(spark, vectors, asked):
    rows = [(i, i % 7, [float(x) for x in v]) for i, v in enumerate(vectors)]
    entries = spark.createDataFrame(rows, SCHEMA).repartition(6)
    return entries.where(f"entry % {asked} = 0").selectExpr("entry AS query", "vector"), entries


def pairs(df):
    return {(r["query"], r["entry"]) for r in df.collect()}


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_recall_on_vectors_without_order(spark):
    queries, entries = frames(spark, unit(np.random.default_rng(1).normal(size=(6_000, 32))), 20)
    index = vi.build(entries, cells=40)
    want, got = pairs(vi.exact(queries, entries)), pairs(vi.search(index, queries))
    assert len(want) == len(got) == 5 * 300 and len(want & got) / len(want) >= 0.9
    assert index.entries.count() == 6_000
    assert pairs(vi.neighbours(queries, entries)) != set() and len(pairs(vi.neighbours(queries, entries)) & want) / len(want) >= 0.9
    assert pairs(vi.search(index, queries, probes=40)) == want  # all cells: exact


def test_vectors_that_cluster_need_few_cells(spark):
    rng = np.random.default_rng(2)
    centres = unit(rng.normal(size=(50, 24)))
    queries, entries = frames(spark, unit(centres[rng.integers(0, 50, 5_000)] + 0.05 * rng.normal(size=(5_000, 24))), 25)
    index = vi.build(entries, cells=50)
    want = pairs(vi.exact(queries, entries))
    assert index.probes <= 10 and len(want & pairs(vi.search(index, queries))) / len(want) >= 0.9


def test_copies_are_cut_into_parts(spark):
    """A third of the entries is one vector: its cell has parts, and nothing is lost."""
    rng = np.random.default_rng(3)
    v = unit(rng.normal(size=(900, 8)))
    v[300:600] = v[0]
    queries, entries = frames(spark, v, 100)
    index = vi.build(entries, cells=10, part=50)
    assert max(r.parts for r in index.parts.collect()) >= 6
    assert pairs(vi.search(index, queries, probes=10)) == pairs(vi.exact(queries, entries))
    assert sorted(r["entry"] for r in vi.search(index, queries).where("query = 400").collect()) == [0, 300, 301, 302, 303]


def test_few_entries_and_none(spark):
    queries, entries = frames(spark, np.eye(4), 2)
    assert pairs(vi.neighbours(queries, entries)) == pairs(vi.search(vi.build(entries), queries, probes=9)) == {(a, b) for a in (0, 2) for b in range(4) if a != b}
    odd = entries.unionByName(spark.createDataFrame([(9, 1, None), (10, 1, [])], SCHEMA))
    assert len(pairs(vi.search(vi.build(odd), queries, probes=9))) == 6
    assert vi.search(vi.build(entries.limit(0)), queries).collect() == [] and vi.search(vi.build(entries), queries.limit(0)).collect() == []
