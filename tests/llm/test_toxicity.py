import math
import random
from collections import Counter

import numpy as np
from helpers import EMPTY, ODD, docs_of, with_clashes
from pyspark.sql import functions as F

from ebbflow.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def small(spark, n=300):
    random.seed(11)
    rows, labels = [], []
    for i in range(n):
        words = random.choices([f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80)], k=30)
        bad = i % 4 == 0
        if bad:
            words[3:5] = random.sample(["vilest", "awful", "nasty"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, None if i == 5 else int(bad)))
    labels += [(0, 1), (10_000, 1), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_neighbours_equal_brute_force_cosines(spark):
    docs, labels = small(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0, block=4, neighbours=7)
    number = lambda t: int(model.numbers(toxicity.hashes_of([t]))[0])
    assert all(number(t) < model.evident for t in (b"vilest", b"awful", b"nasty"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    vectors = {int(d): model.vector(rows[int(d)]) for d in model.doc_ids}
    df = Counter(t for text in rows.values() for t in set(toxicity.terms_of(toxicity.text_words(text))))
    known = {t: number(t) for t in df if number(t) < len(model.terms)}
    assert len(known) == len(model.terms)
    for t, i in known.items():
        assert math.isclose(model.idf[i], math.log(301 / (1 + df[t])) + 1)
    for text in list(rows.values())[:40]:
        i, w = model.vector(text)
        mine = dict(zip(i.tolist(), w.tolist()))
        every = sorted((-sum(mine.get(a, 0) * b for a, b in zip(*map(np.ndarray.tolist, v))) for v in vectors.values()))
        want = [-x for x in every[:7] if x < 0]
        assert np.allclose([c for c, _ in model.nearest(i, w)], want)


def test_scores_depend_on_text_alone_and_odd_rows_are_scored(spark):
    docs, labels = small(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    odd = with_clashes(docs_of(spark, [*ODD, "vilest awful", "so nasty and awful"]))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.toxicity.score <= 1 for r in rows)
    by_text = {r.text: r.toxicity.score for r in rows}
    assert by_text["vilest awful"] > 0.9 and by_text[""] < 0.5 and by_text[None] == by_text[""]
    assert all(r.toxicity.evidence for r in rows if r.text == "vilest awful")


def test_empty_tables(spark):
    docs, labels = small(spark)
    empty = spark.createDataFrame([], EMPTY)
    model = toxicity.fit(empty, labels, F.lit(True))
    assert toxicity.score(empty, model).count() == 0
    assert {r.toxicity.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)).prior == 0.0


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    words = {r.doc_id: set(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [d for d in labels if rows[d].held_out]
    assert all(rows[d].predicted == 0 for d in held if labels[d] == 0)
    plain = [d for d in held if labels[d] == 1 and {"idiot", "scum", "moron", "trash", "stupid", "loser"} & words[d]]
    assert plain and all(rows[d].predicted == 1 for d in plain)


def test_copies_of_labelled_rows_without_evidence_are_found(spark):
    docs, labels = small(spark)
    random.seed(12)
    plain = [" ".join(random.choices([f"p{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)], k=40)) for _ in range(12)]
    near = [" ".join([*t.split()[:-2], "other", "ending"]) for t in plain]
    more = spark.createDataFrame([(1000 + 100 * (i % 2) + i // 2, t) for i, t in enumerate(x for p in zip(plain, near) for x in p)], docs.schema)
    toxic = spark.createDataFrame([(1000 + i, int(i < 6)) for i in range(12)], labels.schema)
    model = toxicity.fit(docs.unionByName(more), labels.unionByName(toxic), F.lit(True))
    assert not {w.encode() for t in plain for w in t.split()} & set(list(model.terms)[:model.evident])
    assert {*range(1000, 1012)} <= set(model.doc_ids.tolist())
    for again, least in ((0, 1 - 1e-9), (100, 0.8)):
        rows = {r.doc_id - again: r.toxicity for r in toxicity.score(more.filter(F.col("doc_id") - again < 1050), model).collect() if r.doc_id >= 1000 + again}
        for i in range(12):
            first = rows[1000 + i].evidence[0]
            assert first.doc_id == 1000 + i and first.cosine >= least and (rows[1000 + i].score >= 0.5) == (i < 6)


def test_words_that_no_example_has_count_in_the_length(spark):
    docs, labels = small(spark)
    model = toxicity.fit(docs, labels, F.lit(True))
    text = docs.first().text
    alone, longer = (model.nearest(*model.vector(t))[0][0] for t in (text, text + " never seen before in any example"))
    assert alone == 1 and longer < 0.99


def test_texts_numbered_together_equal_those_numbered_alone_and_cosines_are_exact(spark):
    docs, labels = small(spark)
    again = docs.select((F.col("doc_id") + 500).alias("doc_id"), F.concat_ws(" ", "text", F.lit("waa waa waa"), F.substring("text", 1, 30)).alias("text"))
    model = toxicity.fit(docs.unionByName(again), labels.unionByName(again.select("doc_id", F.lit(0).alias("toxic"))), F.lit(True), block=8)
    texts = [r.text for r in again.collect()] + ["", None, "neverseenbefore neverseenlater", "ééééééé waa"]
    together = model.vectors(texts)
    for text, (i, w) in zip(texts, together):
        j, v = model.vector(text)
        assert np.array_equal(i, j) and np.array_equal(w, v)
        found = toxicity.counts(text)
        assert sorted(i.tolist()) == sorted(set(model.numbers(toxicity.hashes_of(found)).tolist()))
    full = np.zeros((len(model.labels), len(model.terms) + 1))  # the last column: words that no example has
    begin, example, count = model.postings
    term = np.repeat(np.arange(len(model.terms)), np.diff(begin))
    full[example, term] = model._weights(term, count) / model.length[example]
    for (i, w), near in zip(together, model.nearest_of(together)):
        every = np.round(full[:, np.minimum(i, len(model.terms))] @ w, 12)
        best = np.lexsort((np.arange(len(every)), -every))[:model.neighbours]
        assert np.allclose([c for c, _ in near], every[best][every[best] > 0], atol=2e-12, rtol=0)
