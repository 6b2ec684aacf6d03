import re

import pytest
from helpers import EMPTY, ODD, docs_of, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbflow.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and slow_luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(st.sampled_from("a1@.+-_% ()9é\n0"), max_size=40),
                 st.lists(st.sampled_from(["4465758382889437", " ", "-", "+1 (663) 555-6869", "1.2.3.4", "255.0.1.256", "a.b@c.de", "@", "x", ".", "007.1.1.1"]),
                          max_size=9).map("".join)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + " 1", "1." * 50_000, "a@" * 50_000, "+1" + "(" * 100_000, "a.b" * 60_000 + "@"])
def test_base_spans_take_linear_time(text):
    pii.base_spans(text)


@pytest.fixture(scope="module")
def model(spark):
    from ebbflow.llm.common import documents
    return pii.train(documents(spark, "/root/testdata/sf0.01"))


def test_forward_backward_equals_enumeration(model):
    import numpy as np
    text = "x 4465758382889437 +1 (663) 555-6869"
    tokens = next(iter(pii.chunks(text)))
    arcs = model.arcs(text, tokens)
    paths = [[]]
    done = []
    while paths:
        p = paths.pop()
        at = p[-1][1] if p else 0
        if at == len(tokens):
            done.append(p)
        else:
            paths += [[*p, a] for a in arcs if a[0] == at]
    score = [sum(model.weight[f] for a in p for f in a[3]) for p in done]
    z = np.logaddexp.reduce(score)
    for a, p in zip(arcs, model.expected(len(tokens), arcs)):
        assert abs(p - sum(np.exp(s - z) for s, q in zip(score, done) if a in q)) < 1e-9
    best = max(range(len(done)), key=lambda i: score[i])
    assert model.best(len(tokens), arcs) == [(a[0], a[1], a[2]) for a in done[best] if a[2]]


def test_model_adds_what_the_patterns_miss_and_leaves_prose_alone(model):
    text = "a ramiar, 4465758382889437 4465758382889437 b (663) 555-6869 c"
    base = pii.base_spans(text)
    assert not base
    assert model.spans(text, base) == [("card", 10, 26), ("card", 27, 43), ("phone", 46, 60)]
    for clean in ["Licensed under the Apache License, Version 2.0.", "token = \"a530279e89c01177a88ad094a7ee94c82d3e0111\"", "in 1999 and 2001, 3.14"]:
        assert not model.spans(clean, [])


def test_find_and_mask(spark, model):
    texts = [*ODD, "mail a.b@c.de, 1.2.3.4", "+1 (663) 555-6869", "🙂é a@b.cc"]
    docs = with_clashes(docs_of(spark, texts))
    for r in pii.find(docs, model).collect():
        assert [tuple(s) for s in r.pii.base] == plain(r.text or "")
        assert set(r.pii.base) <= set(r.pii.spans)
    masked = {r.text for r in pii.mask(docs, model).collect()}
    assert {"mail <EMAIL>, <IP>", "<PHONE>", "🙂é <EMAIL>", "", None} <= masked
    assert pii.mask(docs, model).columns == docs.columns
    empty = spark.createDataFrame([], EMPTY)
    assert pii.find(empty, pii.train(empty)).count() == 0
    assert pii.train(empty).spans("4465758382889437 4465758382889437", []) == []
