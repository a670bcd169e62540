import re
from itertools import permutations

import duckdb

from askwright.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"word{i}" for i in range(60))


def masks(rows, labels):
    """(part, set of failed filters, good, toxic) of each row, by the definitions."""
    out = []
    for doc_id, text, source in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows) else set()
        told = [lab for lab in labels if lab[0] == doc_id and doc_id is not None]
        out.append((source or "", fails, any(q == 1 for _, q, _ in told), any(x == 1 for _, _, x in told)))
    return out


def brute(rows, labels):
    judged = masks(rows, labels)
    result = {}
    for part in {m[0] for m in judged}:
        mine = [m for m in judged if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                kept = [m for m in left if f not in m[1]]
                failing = [m for m in mine if f in m[1]]
                result[part, order, step] = [len(kept), len(gone), len(failing) - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                left = kept
    for (part, order, step), found in result.items():
        found.append(sum(v[1] for (p, o, s), v in result.items() if p == part and o[s - 1] == order[step - 1]))
    return sorted((*k, *v) for k, v in result.items())


ROWS = [
    (1, PROSE, "a"), (2, PROSE, "a"), (3, PROSE.upper(), "a"), (4, PROSE + " 5%", "a"), (5, "x " * 70, "a"), (6, "X | " * 70, "a"), (7, None, "a"), (8, "", "a"),
    (9, "", None), (10, PROSE, ""), (None, PROSE, "a"), (None, "", "b"), (None, None, "b"), (11, "one", "b"), (11, "one", "b"), (11, "two", "b"), (12, "two", "b"), (0, "two", "b"),
    (20, "Été " * 100_000, "long"), (21, PROSE + "\x0b\x0c\x1c$", "long"), (22, PROSE + "\x85", "long"), (23, " \t\n" + PROSE, "long"), (24, "A" * 2 + "b" * 38, "long"), (25, "A" * 3 + "b" * 37, "long"),
] + [(100 + i, "hot text |", "hot") for i in range(300)]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (4, 0, 0), (9, 1, 1), (12, 1, 0), (None, 1, 1), (100, 1, 1), (399, 1, 1), (777, 1, 1)]
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_rows_of_every_kind_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, source string, mask int, part string").repartition(5)
    labels = spark.createDataFrame([(*r, 3) for r in LABELS], "doc_id long, quality int, toxic int, id int")
    found = fa.filter_interactions(docs, labels)
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == brute(ROWS, LABELS)
    assert fa.filter_interactions(docs.limit(0), labels).collect() == []
    bare = fa.filter_interactions(docs, labels.limit(0))
    assert sorted(map(tuple, bare.select(COLUMNS).collect())) == brute(ROWS, [])


def test_cells_tell_the_orders_without_documents(spark):
    cells = fa.histogram(spark.createDataFrame([("p", 0, 1, 0), ("p", 31, 0, 1), ("p", 31, 1, 1), ("p", 4, 0, 0)], "part string, mask int, good int, toxic int"))
    assert {tuple(r) for r in cells.collect()} == {("p", 0, 1, 1, 0), ("p", 31, 2, 1, 2), ("p", 4, 1, 0, 0)}
    found = {(r.filter_order, r.step): r for r in fa.enumerate_orders(cells).collect()}
    assert len(found) == 600 and len(fa.ORDERS) == 120
    first, third = found["CABDE", 1], found["ABCDE", 3]
    assert (first.removed, first.kept, first.redundant, first.good_lost, first.toxic_lost) == (3, 1, 0, 1, 2)
    assert (third.removed, third.kept, third.redundant, third.unique_fails) == (1, 1, 2, 1)
    assert first.shapley == 24 * 3 + 96 * 1 and sum(found["ABCDE", k].shapley for k in range(1, 6)) == 120 * 3


def test_corpus_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    found = fa.filter_interactions(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({fa.ORACLE})").fetchall())
