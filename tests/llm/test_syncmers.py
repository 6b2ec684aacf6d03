import base64
import hashlib
import random

import numpy as np
from helpers import EMPTY, ODD, docs_of, with_clashes

from ebbflow.llm import syncmers
from ebbflow.llm.syncmers import Syncmers


def naive_positions(text, method):
    """Closed syncmers by their definition, over the same inner hashes."""
    code = [ord(c) for c in text]
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    inner = []
    for i in range(len(code) - method.s + 1):
        h = code[i]
        for j in range(1, method.s):
            h = (h * 0x9E3779B97F4A7C15 + code[i + j]) & mask
        inner.append(mix(h))
    width = method.k - method.s + 1
    return [i for i in range(len(inner) - width + 1) if min(inner[i:i + width]) in (inner[i], inner[i + width - 1])]


def test_anchors_are_the_closed_syncmers():
    random.seed(2)
    method = Syncmers(size=10_000)
    for n in (15, 16, 40, 300):
        text = "".join(random.choices("abc é🙂", k=n))
        first = {}
        for p in naive_positions(text, method):
            first.setdefault(text[p:p + method.k], p)
        assert sorted(method.anchors(text)[1].tolist()) == sorted(first.values()) or not first


def test_anchors_are_free_of_context():
    random.seed(4)
    text = "".join(random.choices("abcdefgh ", k=400))
    method = Syncmers(size=10_000)
    inside = set(method.anchors(text)[0].tolist())
    assert inside <= set(method.anchors("zzzz" + text + "yyyy")[0].tolist())


def test_likeness():
    random.seed(6)
    method = Syncmers()
    a, b = ("".join(random.choices("abcdefgh ", k=2000)) for _ in range(2))
    f = method.anchors
    assert method.likeness(f(a), f(a)) == 1 and method.likeness(f(a), f(b)) < 0.05
    assert 0.2 < method.likeness(f(a), f(a[:1000] + b[:1000])) < 0.5
    assert method.likeness(f(a), f(a[:990] + "x" + a[991:])) > 0.85
    assert method.likeness(f(""), f("")) == 1 and method.likeness(f(""), f(a)) == 0
    assert method.likeness(f("abc"), f("abd")) == 0


def test_with_next_equals_a_plain_loop(spark):
    random.seed(8)
    texts = [*ODD, *("".join(random.choices("ab c", k=random.randint(0, 90))) for _ in range(40))]
    docs = docs_of(spark, texts, first=(1 << 60))  # ids beyond a double's whole numbers
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    method, want = Syncmers(), []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, following = r.text or "", after.text or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        mine, other, theirs = map(method.anchors, (text, changed, following))
        want.append((r.doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), method.text_of(mine), method.text_of(other),
                     method.likeness(mine, other), method.likeness(mine, theirs)))
    got = syncmers.with_next(with_clashes(docs))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_row_and_none(spark):
    one = syncmers.with_next(docs_of(spark, ["abcdefghijklmnopqrstuvwxyz"], extra=False)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert syncmers.with_next(spark.createDataFrame([], EMPTY)).count() == 0


def test_text_form():
    method = Syncmers()
    f = method.anchors("the quick brown fox jumps over the lazy dog")
    raw = np.frombuffer(base64.b64decode(method.text_of(f)), "<u4").reshape(-1, 2)
    assert (raw[:, 0] == f[0]).all() and (raw[:, 1] == f[1]).all()


def test_small_edits_and_passages_of_long_texts_are_seen(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BATCH_CHARS", 100_000)
    random.seed(10)
    a, b = ("".join(random.choices("abcdefgh ", k=100_000)) for _ in range(2))
    method, f = Syncmers(), Syncmers().anchors
    assert len(f(a)[0]) == len({a[p:p + method.k] for p in naive_positions(a, method)}) > 10_000
    for at in range(500, 100_000, 9_000):
        assert 0.99 < method.likeness(f(a), f(a[:at] + b[:100] + a[at + 100:])) < 1
        assert method.likeness(f(a), f(b[:at] + a[at:at + 100] + b[at + 100:])) > 0
    rows = [(3, a), (2, a[:50_000] + "x" + a[50_001:]), (1, b)]
    got = {r.doc_id: r for r in syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 3 and 0.99 < got[3].near_next < 1
    assert got[3].near_next == method.likeness(f(a), f(rows[1][1])) and got[3].fingerprint == method.text_of(f(a))
