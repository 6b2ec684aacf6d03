import random
from collections import Counter

import numpy as np
import pytest
from helpers import EMPTY, ODD, docs_of, with_clashes

from ebbflow.llm import suffix_dedup as S


def brute(texts, length):
    """(n_bytes, spans, kept) of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in raw for i in range(len(d) - length + 1))
    out = []
    for d in raw:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                hit[i:i + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(hit, np.uint8), [0]]).astype(np.int8))).tolist()
        out.append((len(d), tuple(edges), bytes(b for b, h in zip(d, hit) if not h)))
    return out


def texts(seed, n=60):
    random.seed(seed)
    say = lambda k: "".join(random.choices("abcdé \n", k=k))
    passages = [say(random.choice([15, 25, 40, 90])) for _ in range(8)]
    out = ["ab" * 60, "a" * 100, "a" * 21, "a" * 20, "a" * 19]
    for _ in range(n):
        parts = [say(random.randint(0, 40))]
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            cut = random.randint(0, 10)
            parts += [p[cut:] if random.random() < 0.5 else p[:len(p) - cut], say(random.randint(0, 30))]
        out.append("".join(parts))
    for _ in range(8):
        near = list(out[-1] + say(150))
        near[random.randrange(len(near))] = "Z"
        out.append("".join(near))
    return out + [out[-1], out[-2]]


@pytest.mark.parametrize("seed,hot,block,step", [(1, 10_000, 24 << 20, 1 << 20), (2, 2, 200, 1 << 20), (3, 5, 2000, 32)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, block, step):
    for name, value in (("HOT_RUNS", hot), ("BLOCK_BYTES", block), ("STEP", step), ("BATCH_RUNS", 50)):
        monkeypatch.setattr(S, name, value)
    docs = docs_of(spark, [*ODD[:7], *texts(seed)])
    rows = docs.collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 20)))
    got = Counter((r.doc_id, r.n_bytes, tuple(r.spans), bytes(r.kept)) for r in S.remove_repeats(with_clashes(docs), 20, 8).collect())
    assert got == want and any(r[2] for r in want)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(S.PrefixHashes, "__call__", lambda self, b, e: np.zeros(len(b), np.uint64))
    data = b"xxabcdefgh" + b"yyabcdefgh" + b"zzabcdezzz"
    # windows of 8 that begin 0 to 2 bytes before the anchor "c"... at 4
    found = S.repeated_starts(data, np.array([0, 10, 20]), np.array([2, 2, 2]), np.array([4, 4, 4]), np.ones(3, bool), 8)
    assert sorted(found) == [(0, 2, 2), (1, 2, 2)]


def test_windows_of_a_run_share_its_anchor():
    random.seed(5)
    data = np.frombuffer("".join(random.choices("ab", k=500)).encode(), np.uint8)
    covered = []
    for lo, hi, place, key in S.anchors(data, 30, 10):
        for a, b, p in zip(lo.tolist(), hi.tolist(), place.tolist()):
            assert all(s <= p <= s + 20 for s in range(a, b + 1))
            covered += range(a, b + 1)
    assert covered == list(range(471))


def test_empty_table_and_short_texts(spark):
    assert S.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    assert all(not r.spans for r in S.remove_repeats(docs_of(spark, ODD[:6])).collect())
