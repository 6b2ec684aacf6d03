import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbflow.llm import chat, queries
from ebbflow.llm.common import shared_path

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<|im_start|>", "\\", "\n", "<", "[", "a", "|>", "é🙂"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    random.seed(3)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text")).alias("e")).collect()
    for r in rows:
        assert chat.unescape(r.e) == r.text
        assert not any(c in r.e for c in PARTS[:8])


def test_fold_replays_the_log(spark):
    log = [(1, 10, 0, "message", "user", "hi"), (1, 11, 1, "message", "assistant", None), (1, 11, 2, "delta", None, "wro"),
           (1, 11, 3, "regenerate", None, None), (1, 11, 4, "delta", None, "rig"), (1, 11, 5, "delta", None, "ht"),
           (1, 10, 6, "edit", None, "hello"), (1, 10, 7, "seen", None, "?"), (None, 1, 0, "message", None, "x")]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string"))
    assert {(r.conv_id, r.message, r.seq, r.role, r.text) for r in got.collect()} == {
        (1, 10, 0, "user", "hello"), (1, 11, 1, "assistant", "right"), (None, 1, 0, "", "x")}


def expected(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = sorted([(t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv])
        loss = "".join(x for _, role, x in rows if role == "assistant")
        out[conv] = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_written_conversations_give_back_their_turns(spark):
    random.seed(5)
    turns = [(c, i, random.choice(["user", "assistant", "system", "a\\b\nc", None]),
              random.choice([None, "", "".join(random.choices(PARTS, k=9))])) for c in [None, 1, 2, 3] for i in range(9)]
    turns += [turns[-1], (9, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    path = shared_path(spark, "chat")
    chat.write_chat(chat.render(chat.fold(chat.events_of_turns(df))), path)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(spark, path).collect()}
    assert got == expected(turns)
    empty = shared_path(spark, "chat")
    chat.write_chat(chat.render(chat.fold(chat.events_of_turns(df.limit(0)))), empty)
    assert chat.digest(spark, empty).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op10_chat_format(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(queries.OP10_SQL).fetchall())


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("\\<>s/[]INST|\n")), max_size=12))
def test_unescape_undoes_doubling(text):
    assert chat.unescape(text.replace("\\", "\\\\")) == text
