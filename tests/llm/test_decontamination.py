import random

import duckdb
import pytest
from helpers import EMPTY, ODD, docs_of, with_clashes

from ebbflow.llm import decontamination as D
from ebbflow.llm import queries

ITEMS = "item_id long, text string"


def brute(docs, items, window=10):
    """(doc_id, n_words, hit words, items) by trying every window everywhere."""
    wins = []
    for item, text in items:
        w = D.words((text or "").encode())
        n = min(window, len(w))
        wins += [(str(item) if item is not None else "", w[s:s + n]) for s in range(len(w) - n + 1)] if n else []
    out = []
    for doc_id, text in docs:
        w = D.words((text or "").encode())
        hit, found = set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


def got(frame):
    rows = []
    for r in frame.collect():
        d = r.decontamination
        hit = [i for a, b in zip(d.hit_spans[::2], d.hit_spans[1::2]) for i in range(a, b)]
        assert d.hit_spans == sorted(set(d.hit_spans))
        rows.append((r.doc_id, d.n_words, hit, list(d["items"])))
    return sorted(rows, key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 150])
def test_equals_brute_force(spark, block_bytes):
    random.seed(7)
    vocab = ["a", "B", "c3", "é", "d"]
    say = lambda n: random.choice([" ", ", ", "\n"]).join(random.choices(vocab, k=n))
    items = [(i, say(random.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(20)] + [(None, say(12)), (50, None), (51, " .. "), (3, say(12))]
    texts = [say(random.randint(0, 40)) for _ in range(60)] + ODD + [items[0][1], "x " + items[7][1] + " y " + items[7][1], items[-1][1] * 3]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, ITEMS)
    frame = D.annotate(with_clashes(docs), bench, block_bytes=block_bytes)
    assert {"length", "spans", "text", "lang"} <= set(frame.columns)
    assert got(frame) == brute([(r.doc_id, r.text) for r in docs.collect()], items)


def test_empty_tables(spark):
    docs, bench = docs_of(spark, ODD), spark.createDataFrame([], ITEMS)
    assert all(not r.decontamination.hit_spans for r in D.annotate(docs, bench).collect())
    assert D.annotate(spark.createDataFrame([], EMPTY), spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


def test_prefix_is_the_rarest_shingle(spark):
    index = D.ItemIndex([("1", "a b c d e")], 10)
    counts = [5] * len(index.shingles)
    counts[1] = 2
    import numpy as np
    index.order_by(np.array(counts))
    assert index.prefix_key.tolist() == [index.shingles[1]] and len(index.shingles) == 3


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rows = sorted(map(tuple, queries.op6_decontamination(spark, sf).collect()))
    assert rows == sorted(con.execute(queries.OP6_SQL).fetchall()) and any(r[-1] for r in rows)
