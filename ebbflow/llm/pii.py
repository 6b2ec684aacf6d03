"""Personal data by a semi-Markov conditional random field (operator 3).

The base spans come from the four fixed patterns below. The model adds spans of
the same kinds where a whole candidate looks like one: text is cut into chunks,
runs of words with a digit or an at sign that single spaces join; a chunk's
tokens (runs of letters and digits, or one other character) form a lattice of
outside tokens and candidate segments of at most ``LONGEST`` tokens. A segment's
score is linear in features of the whole span (its shape, digits, check digit,
octets, what stands on either side), and bounded-entity dynamic programming
chooses boundaries and types jointly. Base spans are fixed in the decoding: a
segment never overlaps one.

The model is trained on the driver by the conditional likelihood, on at most
``rows`` documents that have a digit or an at sign (the least by a hash of their
text) with the base spans as labels. A base phone number also serves without its
country prefix, so that the model learns the shape as a whole and not the sign.

Results, in a struct column (replacing one of that name): ``base`` and ``spans``,
each an array of (kind, begin, end) in code points, end exclusive, ordered by kind
as listed, then begin. Null and empty texts have none; spans of a repeated row are
the same; without rows to train on, only base spans are found. All patterns run in
time linear in the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import row_chunks, utf8

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
_TYPE = "struct<base:array<struct<kind:string,begin:int,end:int>>,spans:array<struct<kind:string,begin:int,end:int>>>"
_HOT = re.compile(rb"[0-9@]")
# The first part of an e-mail address or a number is a run that can only succeed
# from its beginning, so a failing run is passed over as a whole.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]+((?:\.[0-9]+){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W_]+|\S")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, by kind as listed, then begin."""
    found = []
    if "@" in text:
        found += [("email", m.start(), m.end()) for m in _EMAIL.finditer(text) if m[1]]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
              if m[1] and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def chunks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens (begin, end) of each run of single-spaced words that have a digit or an at sign."""
    run: list[tuple[int, int]] = []
    for m in re.finditer(r"\S+", text):
        word = m[0]
        if "@" not in word and not any("0" <= c <= "9" for c in word):
            continue
        if run and not (m.start() == run[-1][1] + 1 and text[run[-1][1]] == " "):
            yield run
            run = []
        run = run + [(m.start() + t.start(), m.start() + t.end()) for t in _TOKEN.finditer(word)]
    if run:
        yield run


def _shape(token: str) -> str:
    if token.isascii() and token.isdigit():
        return f"d{min(len(token), 7)}"
    if token.isalpha():
        return "a"
    return "m" if token.isalnum() else token


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "#"
    c = text[at]
    return "a" if c.isalnum() else "_" if c.isspace() else c


def _outside(text: str, tokens: list[tuple[int, int]], i: int) -> list[str]:
    a, b = tokens[i]
    return ["O", "O:" + _shape(text[a:b]), f"O:{_side(text, a - 1)}{_side(text, b)}"]


def _segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(first token, end token, family) of spans that can be an entity at all: addresses have one at
    sign and no space; numbers have digits and separators, at most one space between tokens."""
    parts = [text[a:b] for a, b in tokens]
    digit = [p.isascii() and p.isdigit() for p in parts]
    for i, p in enumerate(parts):
        if digit[i] or p in "+(":
            some = 0
            for j in range(i, min(i + LONGEST, len(parts))):
                if not digit[j] and parts[j] not in "+().-" or j > i and tokens[j][0] > tokens[j - 1][1] + 1:
                    break
                some += len(parts[j]) if digit[j] else 0
                if digit[j] and some >= 4:
                    yield i, j + 1, "number"
        if p.isalnum() and p.isascii():
            at = 0
            for j in range(i + 1, min(i + LONGEST, len(parts))):
                if tokens[j][0] > tokens[j - 1][1] or not (parts[j].isalnum() and parts[j].isascii() or parts[j] in "._%+-@"):
                    break
                at += parts[j] == "@"
                if at == 1 and parts[j].isalnum():
                    yield i, j + 1, "address"


def _whole(text: str, tokens: list[tuple[int, int]], i: int, j: int, family: str) -> list[str]:
    a, b = tokens[i][0], tokens[j - 1][1]
    span = text[a:b]
    digits = _digits(span)
    sides = _side(text, a - 1) + _side(text, b)
    if family == "address":
        local, _, domain = span.partition("@")
        labels = domain.split(".")
        return ["address", f"dots:{min(len(labels), 3)}", f"top:{_shape(labels[-1])}", f"sides:{sides}", f"local:{_side(local, 0)}{_side(local, len(local) - 1)}"]
    shape = "".join((" " if k > i and tokens[k][0] > tokens[k - 1][1] else "") + _shape(text[tokens[k][0]:tokens[k][1]]) for k in range(i, j))
    octets = span.split(".")
    quad = len(octets) == 4 and all(o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets)
    return [f"shape:{shape}", f"digits:{len(digits)}", f"check:{len(digits)}:{luhn(digits)}", f"quad:{quad}", f"plus:{span[0] == '+'}", f"sides:{sides}",
            f"marks:{''.join(sorted(set(shape) & set('+().- ')))}"]


class SemiMarkov:
    """Weights of (type, feature); a lattice's arcs are outside tokens and segments."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.weight = np.zeros(0)

    def arcs(self, text: str, tokens: list[tuple[int, int]], learn: bool = False, blocked=()) -> list[tuple[int, int, str | None, list[int]]]:
        def numbers(names: list[str]) -> list[int]:
            if learn:
                return [self.number.setdefault(n, len(self.number)) for n in names]
            return [self.number[n] for n in names if n in self.number]

        arcs: list = [(k, k + 1, None, numbers(_outside(text, tokens, k))) for k in range(len(tokens))]
        for i, j, family in _segments(text, tokens):
            if any(tokens[i][0] < e and b < tokens[j - 1][1] for _, b, e in blocked):
                continue
            features = _whole(text, tokens, i, j, family)
            for kind in ("email",) if family == "address" else KINDS[1:]:
                arcs.append((i, j, kind, numbers([f"{kind}|{f}" for f in features])))
        return arcs

    def best(self, n: int, arcs) -> list[tuple[int, int, str]]:
        """Segments of the highest-scoring path (ties: the outside, then the earlier kind)."""
        into: list = [[] for _ in range(n + 1)]
        for arc in arcs:
            into[arc[1]].append(arc)
        score, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            for arc in into[end]:
                s = score[arc[0]] + sum(self.weight[f] for f in arc[3])
                if s > score[end]:
                    score[end], back[end] = s, arc
        path, at = [], n
        while at:
            arc = back[at]
            if arc[2]:
                path.append((arc[0], arc[1], arc[2]))
            at = arc[0]
        return path[::-1]

    def expected(self, n: int, arcs) -> np.ndarray:
        """Probability of each arc under the model (forward and backward sums)."""
        s = np.array([sum(self.weight[f] for f in a[3]) for a in arcs])
        forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for k in sorted(range(len(arcs)), key=lambda k: arcs[k][1]):
            a, b = arcs[k][0], arcs[k][1]
            forward[b] = np.logaddexp(forward[b], forward[a] + s[k])
        for k in sorted(range(len(arcs)), key=lambda k: -arcs[k][0]):
            a, b = arcs[k][0], arcs[k][1]
            backward[a] = np.logaddexp(backward[a], backward[b] + s[k])
        return np.exp([forward[a[0]] + x + backward[a[1]] - forward[n] for a, x in zip(arcs, s)])

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Adagrad on the conditional likelihood of the labelled spans."""
        lattices = []
        for text, spans in examples:
            gold = {(b, e): kind for kind, b, e in spans}
            for tokens in chunks(text):
                if len(tokens) > 200:
                    continue  # the sample only; decoding takes chunks of any length
                arcs = self.arcs(text, tokens, learn=True)
                right = [a for a in arcs if a[2] and gold.get((tokens[a[0]][0], tokens[a[1] - 1][1])) == a[2]]
                covered = {k for a in right for k in range(a[0], a[1])}
                right += [a for a in arcs if a[2] is None and a[0] not in covered]
                lattices.append((len(tokens), arcs, [f for a in right for f in a[3]]))
        self.weight = np.zeros(len(self.number))
        grown = np.full(len(self.number), 1e-6)
        for _ in range(rounds):
            for n, arcs, right in lattices:
                gradient: dict[int, float] = {}
                for a, p in zip(arcs, self.expected(n, arcs)):
                    for f in a[3]:
                        gradient[f] = gradient.get(f, 0.0) - p
                for f in right:
                    gradient[f] = gradient.get(f, 0.0) + 1
                f = np.array(list(gradient))
                g = np.array(list(gradient.values())) - decay * self.weight[f]
                grown[f] += g * g
                self.weight[f] += rate * g / np.sqrt(grown[f])

    def spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        if not len(self.weight):
            return []
        found = []
        for tokens in chunks(text):
            near = [s for s in base if s[1] < tokens[-1][1] and tokens[0][0] < s[2]]
            arcs = self.arcs(text, tokens, blocked=near)
            if any(a[2] for a in arcs):
                found += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in self.best(len(tokens), arcs)]
        return found


def train(docs: DataFrame, rows: int = 600, longest: int = 20_000) -> SemiMarkov:
    """On at most ``rows`` documents (of at most ``longest`` characters) with a digit or an at sign."""
    text = F.col("text").cast("string")
    sample = (docs.select(text.alias("text")).filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest)).groupBy(F.xxhash64("text").alias("h"))
              .agg(F.min("text").alias("text")).orderBy("h").limit(rows).collect())
    examples = []
    for r in sample:
        spans = base_spans(r["text"])
        examples.append((r["text"], spans))
        for kind, b, e in spans:
            m = re.match(r"\+[0-9]{1,3}[ .-]", r["text"][b:e])
            if kind == "phone" and m:
                short = r["text"][b + m.end():e]
                examples.append((f"x {short} x", [(kind, 2, 2 + len(short))]))
    model = SemiMarkov()
    model.fit(examples)
    return model


def find(docs: DataFrame, model: SemiMarkov, keep: list[str] | None = None, out: str = "pii") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the struct column ``out``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    need = [*keep, *(["text"] if "text" not in keep else [])]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    entry = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        semi: SemiMarkov = shared.value
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in row_chunks(batches):
            offsets, data = utf8(batch.column("text"))
            base: list = [[] for _ in range(batch.num_rows)]
            spans: list = [[] for _ in range(batch.num_rows)]
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if _HOT.search(data, a, b):
                    text = data[a:b].decode()
                    found = base_spans(text)
                    base[i] = found
                    spans[i] = sorted([*found, *semi.spans(text, found)], key=lambda s: (order[s[0]], s[1]))
            named = lambda rows: pa.array([[{"kind": k, "begin": b, "end": e} for k, b, e in r] for r in rows], entry)
            found = pa.StructArray.from_arrays([named(base), named(spans)], names=["base", "spans"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` {_TYPE}"])
    return docs.select(*need).mapInArrow(scan, schema)


def mask(docs: DataFrame, model: SemiMarkov, column: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in angle brackets; of
    overlapping spans the union is replaced once, by the first one's kind."""
    names = docs.columns

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd
        out = []
        for t, found in zip(text, spans):
            if t is not None and found is not None and len(found):
                parts, at = [], 0
                for s in sorted(found, key=lambda s: (s["begin"], -s["end"])):
                    if s["begin"] >= at:
                        parts += [t[at:s["begin"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    marked = find(docs, model, out="_pii_found")
    masked = F.when(F.size("_pii_found.spans") > 0, cut(F.col(column), F.col("_pii_found.spans"))).otherwise(F.col(column))
    return marked.withColumn(column, masked).select(*names)
