import zlib
from collections import Counter

import numpy as np
from helpers import EMPTY, ODD, WORD, docs_of, ids_of, with_clashes
from pyspark.sql import functions as F
from test_decontamination import brute as contaminated
from test_ngram_join import brute as near_copies
from test_ngram_join import texts as near_texts
from test_pii import plain as personal

import corpus_pipeline as P
from ebbflow.llm import ngram_join, pii

SF = "/root/testdata/sf0.001"


def test_keep_one_of_each_group(spark):
    docs = with_clashes(docs_of(spark, [*ODD, *near_texts(6)], first=3))
    rows = docs.collect()
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = near_copies([(r.doc_id, r.text) for r in rows])
    with_words = Counter(c for (_, n, c), k in groups.items() for _ in range(k) if n)
    got = kept.collect()
    empty = [r for r in rows if not (r.text or "").split()]
    assert Counter(r.doc_id for r in got) == Counter([*(set(with_words)), *(r.doc_id for r in empty)])
    assert not Counter(map(str, got)) - Counter(map(str, rows))


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    before = {r.doc_id: r for r in docs.collect()}
    step = docs
    for name, stage in P.STAGES[:-1]:
        made = stage(spark, step, SF)
        assert made.columns == docs.columns
        made = spark.createDataFrame(made.collect(), docs.schema)
        old, new = {r.doc_id: r for r in step.collect()}, {r.doc_id: r for r in made.collect()}
        assert set(new) <= set(old) and len(new) == made.count()
        if name == "near_duplicates":
            assert set(new) == {c for _, _, c in near_copies([(i, r.text) for i, r in old.items()])}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(new) == {i for i, _, hit, _ in contaminated([(i, r.text) for i, r in old.items()], items) if not hit}
        if name == "personal_data":
            assert set(new) == set(old)
            for i, r in new.items():
                assert not personal(r.text) and r.n_chars == len(r.text)
                assert (r.text == old[i].text) or personal(old[i].text) or pii.train(step).spans(old[i].text, [])
        elif name != "personal_data":
            assert all(new[i].text == before[i].text for i in new)
        step = made
    packed = P.STAGES[-1][1](spark, step, SF).collect()
    want = Counter()
    for r in step.collect():
        ids = [*ids_of(WORD, r.text), 0]
        for at in range(0, len(ids), 2048):
            want[(r.doc_id, at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_toxic_documents_go_and_others_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in P.drop_toxic(spark, docs, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(i in kept for i, toxic in labels.items() if not toxic)
    assert sum(i not in kept for i, toxic in labels.items() if toxic) >= 25


def test_stages_take_empty_tables(spark):
    empty = spark.createDataFrame([], EMPTY)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
