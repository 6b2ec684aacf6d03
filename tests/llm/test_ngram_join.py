import random
from collections import Counter

import duckdb
import pytest
from helpers import EMPTY, ODD, docs_of, with_clashes

from ebbflow.llm import ngram_join, queries
from ebbflow.llm.components import components


def brute(rows):
    """Counter of (doc_id, set size, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(ngram_join.LOWER).split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[(doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id)] += 1
    return out


def texts(seed, groups=25):
    random.seed(seed)
    say = lambda n: random.choices([f"w{i}" for i in range(300)], k=n)
    common = say(60)
    out = []
    for _ in range(groups):
        base = say(random.choice([3, 6, 20, 60, 150]))
        for _ in range(random.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                copy[random.randrange(len(copy))] = random.choice(["x", "y", "Z"])
            if random.random() < 0.2:
                copy = common + copy
            out.append(random.choice([" ", "\n", "  "]).join(copy))
    return out


@pytest.mark.parametrize("seed,chunk,keys", [(1, 4096, 10**6), (2, 3, 10**6), (3, 2, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, keys):
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(ngram_join, "PIVOT_ROWS", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    docs = docs_of(spark, [*ODD, *texts(seed)], first=seed).orderBy("n_chars")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(with_clashes(docs)).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_threshold_is_exact(spark):
    # 8 of 10 shingles are shared: 80 / 100 links, one less does not
    a = [f"a{i}" for i in range(13)]  # 9 shingles
    b = a[:12] + ["b"]                # shares 8, union 10
    c = a[:11] + ["c", "d"]           # shares 7 with a, union 11
    rows = [(5, " ".join(a)), (3, " ".join(b)), (1, " ".join(c))]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 1: 1}


def test_near_copies_are_not_expanded_to_all_pairs(spark):
    random.seed(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[random.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}
    from pyspark.sql import functions as F
    import numpy as np
    t = ngram_join.Threshold()
    none = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    prefixes = ngram_join._prefixes(docs.withColumn("th", F.xxhash64("text")), 5, t, none)
    assert ngram_join._first_pairs(ngram_join._lists(ngram_join._shared(prefixes)), t).count() < 300 * 30
    # a passage that unlike documents share is no reason to compare them
    passage = " ".join(f"p{i}" for i in range(40))
    unlike = spark.createDataFrame([(i, " ".join(f"u{i}x{j}" for j in range(400)) + " " + passage) for i in range(50)], "doc_id long, text string")
    prefixes = ngram_join._prefixes(unlike.withColumn("th", F.xxhash64("text")), 5, t, none)
    assert prefixes.groupBy("shingle").count().filter("count > 1").count() > 3
    assert ngram_join._lists(ngram_join._shared(prefixes)).count() == 0


def test_what_a_class_spares_never_hides_a_link():
    t = ngram_join.Threshold()
    for a in range(1, 1500):
        for b in range(-(-t.above * a // t.below), a + 1):
            least = -(-t.above * (a + b) // (t.above + t.below)) - max(a - t.prefix(a), b - t.prefix(b))
            assert max(a // 10 - 1, b // 10 - 1, 0) < max(least, 1)


def test_empty_table_and_texts_without_words(spark):
    assert ngram_join.join(spark.createDataFrame([], EMPTY)).count() == 0
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, ["", None, " \n"])).collect()}
    assert (0, 0, 0) in got and (1, 0, 1) in got and (2, 0, 2) in got


def test_components(spark):
    random.seed(4)
    links = [(random.randrange(60), random.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if a != b:
            root.setdefault(a, {a}), root.setdefault(b, {b})
            merged = root[a] | root[b]
            for x in merged:
                root[x] = merged
    assert got == {x: min(s) for x, s in root.items()}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries.op2_ngram_join(spark, sf).collect())) == sorted(con.execute(queries.OP2_SQL).fetchall())
