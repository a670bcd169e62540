import hashlib
import unicodedata

import numpy as np
import pytest
import regex

from askwright.llm import bpe

public = pytest.importorskip("public_tokenizers")
NAME = "byte_bpe_multi_50k.tiktoken"


def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe._ranks(bpe.read_ranks(public.path(NAME))), special_tokens={})


TEXTS = [
    "Hello world, it's 12 o'clock!  \n\n  tabs\tand  spaces   ",
    "été naïve Straße ñandú 日本語 テスト 123４５ ½",
    "emoji 😀😀 and 𝔘𝔫𝔦 x\x1cy\x85z w ​",
    "",
    None,
    "a" * 3000 + " " * 50 + "\n" * 5,
    "don't DON'T we'll we're I'd I'm they've 's's",
]


def test_pretokens_equal_the_public_pattern():
    pattern = regex.compile(public.PATTERN.replace(r"\s", f"[{bpe.WHITE}]").replace(r"\S", f"[^{bpe.WHITE}]").replace(f"[^[{bpe.WHITE}]", f"[^{bpe.WHITE}"))
    rng = np.random.default_rng(5)
    plane = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]  # libraries differ on later additions
    for _ in range(300):
        text = "".join(chr(plane[i]) if i >= 0 else " a'1\n"[i] for i in np.where(rng.random(40) < 0.5, rng.integers(-5, 0, 40), rng.integers(0, len(plane), 40)))
        assert "".join(bpe.pretokens(text)) == text
        assert bpe.pretokens(text) == pattern.findall(text)
    latin = "".join(chr(c) for c in rng.integers(9, 0x250, 5000))
    assert bpe.pretokens(latin) == pattern.findall(latin)


def test_ids_equal_the_library_and_round_trip(spark):
    path, lib = public.path(NAME), library()
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    tokens = bpe.encode(docs, path, chunk_bytes=200, word_bytes=20)  # many chunks and buckets
    found = sorted(((r[0], list(r[1])) for r in tokens.collect()), key=str)
    assert found == sorted(((i, lib.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    decoded = sorted(((r[0], bytes(r[1])) for r in bpe.decode(tokens, path).collect()), key=str)
    assert decoded == sorted(((i, (t or "").encode()) for i, t, _ in rows), key=str)
    for r in bpe.digests(tokens, path).where("doc_id = 0").collect():
        ids = lib.encode_ordinary(TEXTS[0])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TEXTS[0].encode()).hexdigest()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(docs, public.path(NAME)), public.path(NAME)).collect() == []
