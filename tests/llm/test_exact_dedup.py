import hashlib

import duckdb

from askwright.llm import exact_dedup as ed


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Aa É"), (2, "aA É"), (3, "aa é"), (4, None), (5, ""), (None, "Aa É"), (None, "alone"), (None, "alone"), (7, "aaa"), (7, "bbb"), (9, "BBB")]
ROWS += [(9, "bbb"), (20, "x" * 1_000_000), (21, "X" * 1_000_000), (-3, "ß"), (-4, "ß"), (30, "same"), (30, "same")] + [(100 + i, "Hot text") for i in range(200)]


def test_rows_of_every_kind_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in ROWS], "doc_id long, text string, keep_id string, __n int").repartition(5)
    for salts in (1, 3, 32):
        assert sorted(map(tuple, ed.exact_dedup(docs, salts=salts).collect()), key=str) == brute(ROWS)
    assert ed.exact_dedup(docs.limit(0)).collect() == [] and ed.drop_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_text_stays(spark):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, keep_id int")
    kept = [(r.doc_id, norm(r.text)) for r in ed.drop_duplicates(docs).collect()]
    want = {}
    for i, t in ROWS:
        want[norm(t)] = max(want.get(norm(t), i), i, key=lambda x: -(10**9) if x is None else x)
    assert len(kept) == len(set(kept)) and {(i, t) for t, i in want.items()} == set(kept) and (7, "bbb") not in kept


def test_corpus_equals_sql(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}'")
    found = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(spark.read.parquet(d)).collect())
    assert found == sorted(con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ed.ORACLE})").fetchall())
