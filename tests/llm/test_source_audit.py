import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from askwright.llm import source_audit as sa

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least_docs, top):
    """The report by its definition, in Python's integers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        shares = lambda c: [1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept]
        q, p = shares(sum(groups.values(), Counter())), {s: shares(c) for s, c in groups.items()}
        for source in groups:
            parts = {"pair": [(o, sum(abs(a - b) for a, b in zip(p[source], p[o]))) for o in groups if o != source]}
            parts["term"] = [(t, a - b) for t, a, b in zip(kept, p[source], q) if groups[source][t] and a > b]
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found, 1) if part == "pair" or rank <= top]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90)] + ["Über", "über", "straße", "日本", "A1b", "x_y", "it's"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), f"s{rng.choice([0, 0, 0, *range(1, 23)])}"
        rows.append((" ".join(rng.choices(words[int(source[1:]) :], k=rng.randint(0, 40))), lang, source))
    return rows


EDGES = [
    (None, "en", "nulls"), ("", "en", None), ("12 34 %", "en", "bare"), ("alone", "fr", "only"), ("rare words", "it", "a"), ("few words", "it", "b"), (None, None, None),
    ("wak " * 30_000 + "Wbk," * 30_000, "en", "long"), ("same text", "en", "s1"), ("same text", "en", "s1"), ("a\x00b\x7fc\x80d e", "de", "signs"),
]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "segment": 3, "block": 4}, {"chunk": 1, "segment": 1, "block": 1}])
def test_rows_of_every_kind_equal_brute_force(spark, sizes):
    rows = corpus(1, 600) + EDGES
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n int, term string, number int").repartition(6)
    found = sa.divergence(docs, least_docs=8, top=5, **sizes).select(COLUMNS)
    assert sorted(map(tuple, found.collect())) == brute(rows, 8, 5)


def test_no_kept_terms_and_no_rows(spark):
    docs = spark.createDataFrame([("a b", "en", "s1"), ("b c", "en", "s2"), (None, "en", "s3")], "text string, lang string, source string")
    found = sorted(map(tuple, sa.divergence(docs).select(COLUMNS).collect()))
    assert len(found) == 6 and found == brute([("a b", "en", "s1"), ("b c", "en", "s2"), (None, "en", "s3")], 30, 50) and {r[4] for r in found} == {0}
    assert sa.divergence(docs.limit(0)).collect() == []


def test_shares_are_exact_at_any_size():
    rng = random.Random(3)
    for _ in range(3000):
        below = rng.randint(1, 9 * 10 ** rng.randint(1, 15))
        n = rng.randint(0, max(0, below - 5))
        assert sa.shares(np.array([n]), np.array([below]))[0] == 1 + 10**9 * (n + 5) // below


def test_both_forms_of_a_share_agree(spark):
    rows = [(0, 0, 1), (7, 100, 9), (10**12, 3 * 10**12, 10**7), (5 * 10**15, 8 * 10**15, 10**8)]
    found = [r[0] for r in spark.createDataFrame(rows, "n long, total long, terms long").select(sa._share("n", "total", "terms")).collect()]
    assert found == [1 + 10**9 * (n + 5) // (total + 5 * terms) for n, total, terms in rows]


def test_a_task_holds_a_bounded_dictionary(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sa, "MOST_ENTRIES", 50)
    monkeypatch.setattr(sa, "PIECE", 64)
    rows = corpus(2, 300)
    batches = [pa.RecordBatch.from_arrays([pa.array([(r[k] or "").encode() for r in rows[i : i + 10]], pa.binary()) for k in (1, 2, 0)], ["lang", "source", "text"]) for i in range(0, 300, 10)]
    sent = list(sa._local_counts(batches))
    assert max(b.num_rows for b in sent) < 400 and len(sent) > 100
    times = Counter()
    for b in sent:
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in b.columns)):
            times[lang.decode(), source.decode(), term.decode()] += n
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert times == Counter((lang or "", source or "", t) for text, lang, source in rows for t in TERM.findall(text.translate(lower)))


def test_corpus_equals_sql(spark):
    d = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}'")
    found = sorted(map(tuple, sa.divergence(spark.read.parquet(d)).select(COLUMNS).collect()))
    assert found == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({sa.ORACLE})").fetchall())
