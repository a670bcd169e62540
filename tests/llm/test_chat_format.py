import hashlib
import time

import duckdb
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from askwright.llm import chat_format as cf


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """conv_id -> n_turns, turns digest, loss characters, loss digest."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (1, 0, "user", "hi <|im_end|> <\\|x|> <\\\\|"), (1, 1, "assistant", "<|im_start|>assistant\n%0A"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""),
    (2, 0, "user", "only a question"), (3, None, "assistant", "null turn first"), (3, 0, "sys\ntem%", "é😀"), (3, 1, None, "no role"), (None, 0, "user", "q"), (None, 1, "assistant", "a" * 1_000_000),
    (4, 0, "assistant", "one"), (4, 0, "assistant", "one"), (5, 1, "b", "x"), (5, 1, "a", "y"),
]
SCHEMA = "conv_id long, turn long, role string, text string, example int, transcript string"


def test_read_back_equals_brute_force(spark):
    frame = spark.createDataFrame([(*r, 7, "clash") for r in ROWS], SCHEMA).repartition(3)
    examples = cf.prefix_target_examples(frame)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cf.read_back(examples).collect()}
    assert got == brute(ROWS)
    sizes = {r.conv_id: r.formatted_chars for r in cf.read_back(examples).collect()}
    assert sizes == {r.conv_id: r.n for r in examples.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    one = sorted(((r.example, r.text, r.loss_start, r.loss_chars) for r in examples.where("conv_id = 4").collect()))
    turn = "<|im_start|>assistant\none<|im_end|>\n"
    assert one == [(0, turn, 22, 3), (1, turn * 2, len(turn) + 22, 3)]
    assert cf.read_back(cf.prefix_target_examples(frame.limit(0))).collect() == []


def test_probe_and_corpus_equal_sql(spark):
    d = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}'")
    found = cf.read_back(cf.prefix_target_examples(cf.with_probe(spark.read.parquet(d)))).collect()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(tuple(r[c] for c in columns) for r in found) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({cf.ORACLE})").fetchall())
    assert -1 in {r.conv_id for r in found}


def test_many_turns_in_linear_time(spark):
    """Placing the turns of one conversation takes time in proportion to them; only its examples' texts grow beyond that."""
    rows = spark.range(40_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("text").alias("text"))
    began = time.time()
    got = cf.read_back(cf.prefix_target_examples(rows)).first()
    assert got.n_turns == 40_000 and got.loss_chars == 0 and time.time() - began < 40


@given(st.lists(st.sampled_from(["<", "\\", "|", "im_end", "<|im_start|>", "é", "\n"]), max_size=12).map("".join))
def test_escaped_texts_hold_no_control_string(text):
    import re

    escaped = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in escaped and re.sub(r"<\\(\\*)\|", r"<\1|", escaped) == text
