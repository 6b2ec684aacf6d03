import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from ebbflow.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_version(rows):
    """Every distinct sequence of first turns, by walking all of them."""
    original = defaultdict(list)
    for c, turn, role, text in rows:
        original[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    original = {c: [(r[2], r[4]) for r in sorted(found)] for c, found in original.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 9
        base = [] if c is None else original.get(c - c % 5, [])
        rebuilt[c] = tuple(base[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    least = lambda p: min((c for c in members[p] if c is not None), default=None)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, found in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(found) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, found in members.items():
        ids = ",".join(map(str, sorted(c for c in ends[p] if c is not None)))
        out.append((least(p), len(p), least(p[:-1]) if p else None, len(found), len(children[p]), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def query(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    conv_id = F.col("conv_id")
    shared = F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 9
    return prefix_trie.prefix_trie(df, conv_id - conv_id % 5, shared, most_shared=8).select(*COLUMNS)


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def conversations(seed, n=60, longest=14, variety=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, *["é ok " * k for k in range(variety)]]))
            for c in range(n) for t in range(rng.randint(1, longest))]
    return rows


def test_small_tables_equal_the_plain_version(spark):
    rows = conversations(1)
    rows += [(200, None, "user", "x"), (200, None, "user", None), (200, 3, None, "x"), (200, 3, None, "x"), (200, 2, "user", "x" * 70000)]
    rows += [(None, 1, "user", "é"), (None, 0, None, None), (403, 0, "user", "only a head")]
    same(query(spark, rows).collect(), plain_version(rows))


def test_copies_long_conversations_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rng = random.Random(2)
    one = [(t, rng.choice(["user", "assistant"]), f"text {t % 5}") for t in range(30)]
    rows = [(c, *turn) for c in range(40) for turn in one]  # a large group of copies
    rows += [(c, *turn) for c in range(40, 60) for turn in one[:c % 30 + 1]]  # each the beginning of them
    rows += [(c + 100, t, r, x) for c, t, r, x in conversations(3, 30, 20, 1)]
    same(query(spark, rows).collect(), plain_version(rows))


def test_empty_table_and_extra_columns(spark):
    assert query(spark, []).count() == 0
    rows = conversations(5, 7, 4)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("y") for c in ("c", "pos", "len", "depth", "k1", "tie", "leaf", "b", "h", "_gp_pid")})
    conv_id = F.col("conv_id")
    shared = F.crc32(conv_id.cast("string").cast("binary")) % 9
    same(prefix_trie.prefix_trie(wide, conv_id - conv_id % 5, shared, 8).select(*COLUMNS).collect(), plain_version(rows))


def test_query_equals_its_sql_and_the_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_prefix_trie(spark, sf)
    assert got.columns == COLUMNS
    got = list(map(tuple, got.collect()))
    same(got, plain_version(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    same(con.execute(queries.OP13_SQL).fetchall(), got)


def test_sql_on_odd_rows(spark):
    rows = conversations(8, 40, 6, 1) + [(None, 1, "user", "é"), (90, None, None, None), (90, None, None, None)]
    import pandas as pd
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], dtype="Int64"), "turn": pd.array([r[1] for r in rows], dtype="Int64"),
                                        "role": [r[2] for r in rows], "text": [r[3] for r in rows]}))
    con.execute("CREATE VIEW conversations AS SELECT conv_id, turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM given")
    same(con.execute(queries.OP13_SQL).fetchall(), plain_version(rows))
