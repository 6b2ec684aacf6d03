import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import BYTE, EMPTY, ODD, WORD, docs_of, ids_of, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbflow.llm import packing, token_counts, token_files
from ebbflow.llm.common import shared_path
from ebbflow.llm.tokens import WordTokenizer

TEXT = st.text(st.sampled_from(list("abZÉß '’.,!9½\n\t\x1c\xa0\u0301你🙂<|>")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_library(text):
    words = WordTokenizer.at(WORD)
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pre_tokens_are_counted_as_the_library_counts_texts(text):
    library = token_counts._library(BYTE)
    pieces = token_counts.pre_tokens(text)
    assert "".join(pieces) == text
    if "<|endoftext|>" not in text:
        assert sum(len(library.encode(p, add_special_tokens=False)) for p in pieces) == len(library.encode(text, add_special_tokens=False))


def test_token_counts(spark):
    docs = docs_of(spark, ODD)
    got = token_counts.token_counts(with_clashes(docs), BYTE, 1024).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(ids_of(BYTE, r.text)), len(ids_of(BYTE, r.text)) > 1024) for r in docs.collect())
    assert Counter(map(tuple, got)) == want
    assert token_counts.token_counts(spark.createDataFrame([], EMPTY), BYTE, 1024).count() == 0


def test_small_blocks_and_frequent_pre_tokens_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD_BLOCKS", 2)
    docs = docs_of(spark, [*ODD, "a " * 2000 + "b", "a b " * 255])
    want = Counter(map(tuple, token_counts.token_counts(docs, BYTE, 9).collect()))
    assert want == Counter(map(tuple, token_counts.token_counts(docs, BYTE, 9, block_chars=50).collect()))
    assert want == Counter((r.doc_id, len((r.text or "").encode()), n, n > 9) for r in docs.collect() for n in [len(ids_of(BYTE, r.text))])


def test_token_files(spark):
    docs = docs_of(spark, ODD)
    path = shared_path(spark, "tokens")
    token_files.write_tokens(with_clashes(docs), path, WORD, 2)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    at = 0
    for r, w in zip(rows, want):
        assert r.start == at and list(r.ids) == [*ids_of(WORD, w.text), 2]
        at += r.n_tokens
    crcs = {r.doc_id: r.ids_crc32 for r in token_files.with_crc32(token_files.read_tokens(spark, path)).collect()}
    assert crcs[4] == zlib.crc32(np.array([*ids_of(WORD, "That it."), 2], "<u4").tobytes())
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().toString()
    assert "ids" not in plan.rsplit("ReadSchema", 1)[1]
    assert {r.doc_id for r in token_files.read_tokens(spark, path, 3, 5).collect()} == {3, 4, 5}


def test_token_files_of_an_empty_table(spark):
    path = shared_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], EMPTY), path, WORD, 2)
    assert token_files.read_tokens(spark, path).count() == 0


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("capacity,seed", [(1, 0), (7, 1), (20, 2), (64, 3), (100, 4)])
def test_plan_is_best_fit_decreasing(capacity, seed):
    random.seed(seed)
    lengths = [random.choice([1, capacity, random.randint(1, capacity)]) for _ in range(500)]
    counts = Counter(lengths)
    room, filled = {}, {}
    for length, rank, each, first, offset in packing.best_fit_plan(counts, capacity):
        upto = min([r for n, r, *_ in packing.best_fit_plan(counts, capacity) if n == length and r > rank], default=counts[length])
        for j in range(upto - rank):
            b = first + j // each
            filled.setdefault(b, []).append((offset + j % each * length, length))
    for b, parts in filled.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        room[b] = capacity - at
    assert sum(map(len, filled.values())) == len(lengths)
    assert sorted(room.values()) == brute_best_fit(lengths, capacity)


def test_packing(spark):
    docs = docs_of(spark, ODD)
    pieces = packing.token_pieces(with_clashes(docs), WORD, 64, 0)
    placed = packing.pack(token_files.with_crc32(pieces), 64).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*ids_of(WORD, r.text), 0]
        for p in range(0, len(ids), 64):
            cut = ids[p:p + 64]
            want[(r.doc_id, p // 64, p, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) == len(brute_best_fit([r.length for r in placed], 64))
    whole = packing.sequences(pieces, packing.pack(pieces.drop("ids"), 64)).collect()
    assert len(whole) == len(bins) and all(len(r.ids) <= 64 for r in whole)
    assert sorted(i for r in whole for i in r.ids) == sorted(i for r in docs.collect() for i in [*ids_of(WORD, r.text), 0])
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], EMPTY), WORD, 64, 0), 64).count() == 0
