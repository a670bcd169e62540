import hashlib

import numpy as np
import pytest

import corpus_pipeline
from askwright.llm import bpe, decontamination, language_id, simhash

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
        kept[name] = frames[-1]
        if name != "bpe":
            assert frames[-1].columns == columns
    rows = lambda f: {r.doc_id: r.text for r in f.collect()}
    start, lang, exact, near, clean = (rows(f) for f in frames[:5])
    assert lang == {i: t for i, t in start.items() if any(c.isalpha() for c in t or "")}
    last = {}
    for i, t in lang.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    assert set(exact) == set(last.values())
    fps = {i: simhash.fingerprint(t) for i, t in exact.items()}
    ids, seen, least = sorted(fps), set(), set()
    for i in ids:
        if i in seen:
            continue
        least.add(i)
        work = [i]
        while work:
            x = work.pop()
            seen.add(x)
            work += [y for y in ids if y not in seen and (fps[x] ^ fps[y]).bit_count() <= 4]
    assert set(near) == least
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " " + " ".join(decontamination.WORD.findall(t.lower())) + " "
    items = [flat(r.text) for r in bench.collect()]
    assert {i for i, t in near.items() if any(x in flat(t) for x in items)} <= set(near) - set(clean)
    assert len(set(near) - set(clean)) <= 0.2 * len(near)
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe._ranks(bpe.read_ranks(corpus_pipeline.ranks_path())), special_tokens={})
    tokens = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in frames[5].collect()}
    assert tokens == {i: (len(x := lib.encode_ordinary(t)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, t in clean.items()}
    assert language_id.SWITCH > 0


def test_run_equals_the_stages_and_takes_edge_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(90_001, None, None, None, 0), (None, "text without an id", "en", "src0", 18), (90_002, "", "en", "src0", 0)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert None in got and not got & {90_001, 90_002}


def test_empty_repeated_clashing_and_long(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
    rows = [(1, "Alpha beta gamma delta words here", "en", "s", 5), (1, "Alpha beta gamma delta words here", "en", "s", 5), (1, "another text of the same id", "en", "s", 5), (9, "ALPHA beta gamma delta words here", "en", "s", 5), (7, "long words " * 60_000 + "end", "en", "s", 5)]
    clash = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp int, __sha string")
    kept = clash
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == clash.columns, name
    assert sorted((r.doc_id, r.text[:12]) for r in kept.collect()) == [(1, "another text"), (7, "long words l"), (9, "ALPHA beta g")]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()} == {1, 7, 9}
