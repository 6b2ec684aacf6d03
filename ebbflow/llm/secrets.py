"""Secrets: fixed patterns and a randomness test battery (operator 12).

Base spans come from the three fixed patterns below. The battery looks at every
other maximal run of ``[A-Za-z0-9+/_-]`` of at least ``shortest`` characters:

1. its encoding is the smallest alphabet that holds all its characters;
2. over that alphabet three tests of uniform randomness give a normal deviate
   each: chi-squared of the symbol counts (both tails), runs below and above the
   middle of the alphabet, and lag-one serial correlation. ``s`` is the sum of
   their squares, about chi-squared with three degrees for a random string;
3. ``z`` tells how far ``log s`` lies from that of ordinary text of the same length
   read in the same encoding. Ordinary text is a Markov chain with the character
   transitions of all documents, restricted to the alphabet; strings drawn from it
   give mean and deviation at each length. Short runs therefore need much more than
   long ones. What the chain misses of real words shows in the runs of letters alone
   of all documents: their median and lower quantiles shift and widen the scale;
4. false discoveries are controlled by Benjamini and Hochberg's rule among all
   runs of a length class, over the whole table. A run is a secret of kind
   ``random`` if its p-value is within the cut of its class and the battery does
   not reject that it is random.

Runs of digits alone belong to no encoding here, and neither do runs that mix
``+/`` with ``-_``. Over all documents only transition counts (67 x 67) and histograms
of ``z`` (some 40 classes of length, 800 bins) reach the driver.

Results, in a struct column (replacing one of that name): ``base`` and ``spans``,
arrays of (kind, begin, end) in code points, end exclusive, by begin, then kind as
listed, and ``tested``, the battery's figures for each run. A run that overlaps a
base span is not tested. Null and empty texts have none; repeated rows have the
same; an empty table gives no rows; other columns pass unread. Patterns and tests
take time in proportion to the text.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import materialize, row_chunks, utf8

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_SYMBOLS = string.digits + string.ascii_uppercase + string.ascii_lowercase + "+/-_"
#: Alphabets in the order of their symbols' values, smallest first.
ENCODINGS = {
    "hex_lower": string.digits + "abcdef",
    "hex_upper": string.digits + "ABCDEF",
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567",
    "lower_digits": string.digits + string.ascii_lowercase,
    "upper_digits": string.digits + string.ascii_uppercase,
    "letters": string.ascii_uppercase + string.ascii_lowercase,
    "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
}
NAMES = list(ENCODINGS)
OTHER = len(_SYMBOLS)
_CODE = np.full(256, OTHER, dtype=np.uint8)
_CODE[np.frombuffer(_SYMBOLS.encode(), dtype=np.uint8)] = np.arange(OTHER)
_HEX = np.zeros(256, dtype=bool)
_HEX[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = True
#: Value of each symbol in each encoding, -1 where it has none.
_VALUE = np.array([[ENCODINGS[e].find(c) for c in _SYMBOLS] for e in NAMES])
_SIZE = np.array([len(ENCODINGS[e]) for e in NAMES])
_DIGITS = np.array([c.isdigit() for c in _SYMBOLS])
LENGTHS = np.array([16, 20, 24, 28, 32, 40, 48, 64, 96, 128])
#: ``z`` is kept within this bound, in bins of a tenth.
FAR = 40
#: Upper 0.1 % point of chi-squared with three degrees of freedom.
CRITICAL = 16.266
_TYPE = ("struct<base:array<struct<kind:string,begin:int,end:int>>,"
         "tested:array<struct<begin:int,end:int,encoding:string,s:double,z:double,class:int>>>")


def _runs(mask: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of true values of at least ``least``; ``bounds`` part rows."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    inner = bounds[(bounds > 0) & (bounds < len(mask))]
    cuts = np.unique(np.concatenate([[0], edge, inner, [len(mask)]]))
    begin, end = cuts[:-1], cuts[1:]
    take = (end - begin >= least) & mask[begin] if len(mask) else np.zeros(0, dtype=bool)
    return begin[take], end[take]


def battery(values: np.ndarray, begins: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Sum of the three squared deviates of each string. ``values`` holds the strings' symbols one
    after the other, each of at least two; ``k`` is the size of each string's alphabet."""
    length = np.diff(np.append(begins, len(values)))
    which = np.repeat(np.arange(len(begins)), length)
    counts = np.zeros(len(begins) * 64, dtype=np.int64)
    np.add.at(counts, which * 64 + values, 1)
    square = (counts.reshape(-1, 64) ** 2).sum(1)
    n = length.astype(float)
    z_counts = (k * square / n - n - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    same = which[1:] == which[:-1]
    high = 2 * values >= np.repeat(k, length)
    changes = np.bincount(which[1:], weights=same & (high[1:] != high[:-1]), minlength=len(begins))
    # both halves have the same size, as every alphabet is even
    z_runs = (changes - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    centred = values - (np.repeat(k, length) - 1) / 2
    product = np.bincount(which[1:], weights=same * centred[1:] * centred[:-1], minlength=len(begins))
    z_serial = product / ((k * k - 1) / 12) / np.sqrt(n - 1)
    return z_counts ** 2 + z_runs ** 2 + z_serial ** 2


def length_class(length: np.ndarray) -> np.ndarray:
    """Classes of length, two to each doubling."""
    return np.floor(2 * np.log2(length)).astype(int)


@dataclass
class Ordinary:
    """Mean and deviation of ``log s`` of ordinary text, by encoding and length."""
    mean: np.ndarray
    deviation: np.ndarray

    def deviate(self, encoding: np.ndarray, length: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Standard deviate of ``log s`` among ordinary texts; low for random strings."""
        out = np.zeros(len(s))
        at = np.log(np.minimum(length, LENGTHS[-1]))
        for e in np.unique(encoding):
            i = np.flatnonzero(encoding == e)
            mean = np.interp(at[i], np.log(LENGTHS), self.mean[e])
            spread = np.interp(at[i], np.log(LENGTHS), self.deviation[e])
            out[i] = (np.log(np.maximum(s[i], 1e-9)) - mean) / spread
        return np.clip(out, -FAR, FAR)


def transitions(docs: DataFrame) -> np.ndarray:
    """Counts of neighbouring characters in all texts; the last row and column are other bytes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((OTHER + 1) ** 2, dtype=np.int64)
        for batch in row_chunks(batches, 500):
            offsets, data = utf8(batch.column("t"))
            code = _CODE[np.frombuffer(data, dtype=np.uint8)].astype(np.int32)
            if len(code) < 2:
                continue
            pair = code[:-1] * (OTHER + 1) + code[1:]
            inner = offsets[(offsets > 0) & (offsets < len(code))]
            pair[inner - 1] = OTHER * (OTHER + 1) + OTHER  # not neighbours: two texts
            total += np.bincount(pair, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    rows = (docs.select(F.col("text").cast("string").alias("t")).mapInArrow(count, "pair int, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).collect())
    found = np.zeros((OTHER + 1) ** 2)
    for r in rows:
        found[r["pair"]] = r["n"]
    return found.reshape(OTHER + 1, OTHER + 1)[:OTHER, :OTHER]


def ordinary(counts: np.ndarray, strings: int = 2000, seed: int = 12) -> Ordinary:
    """The distribution of ``log s`` under the chain of ``counts``, from ``strings`` drawn per encoding."""
    draw = np.random.default_rng(seed)
    mean, deviation = (np.zeros((len(NAMES), len(LENGTHS))) for _ in range(2))
    for e, name in enumerate(NAMES):
        alphabet = ENCODINGS[name]
        k = len(alphabet)
        # where the alphabet has one case only, text counts in that case
        home = [alphabet.find(c) if c in alphabet else alphabet.find(c.swapcase()) for c in _SYMBOLS]
        inside = [i for i, h in enumerate(home) if h >= 0]
        chain = np.full((k, k), 0.1)
        for i in inside:
            for j in inside:
                chain[home[i], home[j]] += counts[i, j]
        first = np.cumsum(chain.sum(1) / chain.sum())
        step = np.cumsum(chain / chain.sum(1, keepdims=True), axis=1)
        state = np.minimum(np.searchsorted(first, draw.random(strings)), k - 1)
        text = np.zeros((strings, LENGTHS[-1]), dtype=np.int64)
        for i in range(LENGTHS[-1]):
            text[:, i] = state
            state = np.minimum((step[state] < draw.random(strings)[:, None]).sum(1), k - 1)
        for i, n in enumerate(LENGTHS):
            s = np.log(np.maximum(battery(text[:, :n].ravel(), np.arange(strings) * n, np.full(strings, k)), 1e-9))
            mean[e, i], deviation[e, i] = s.mean(), max(s.std(), 0.1)
    return Ordinary(mean, deviation)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(kind number, begin, end) in bytes of the fixed patterns but ``hex``."""
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(data) if len(m[2]) >= 12]
    if b"AKIA" in data:
        found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(data) if len(m[0]) >= 18]
    return found


def examine(docs: DataFrame, null: Ordinary, keep: list[str], out: str, shortest: int) -> DataFrame:
    """``keep`` of ``docs`` with base spans and the battery's figures of every other run."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [f"k{i}" for i in range(len(keep))]
    shared = docs.sparkSession.sparkContext.broadcast(null)
    span = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])
    figures = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("s", pa.float64()),
                         ("z", pa.float64()), ("class", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 500):
            offsets, data = utf8(batch.column("t"))
            raw = np.frombuffer(data, dtype=np.uint8)
            #: code points before each byte of the chunk
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
            row_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
            base = [[(k, int(offsets[i]) + b, int(offsets[i]) + e) for k, b, e in base_spans(data[offsets[i]:offsets[i + 1]])]
                    for i in range(batch.num_rows)]
            begin, end = _runs(_HEX[raw], offsets, 16)
            for i, b, e in zip(row_of(begin).tolist(), begin.tolist(), end.tolist()):
                base[i].append((2, b, e))
            code = _CODE[raw]
            begin, end = _runs(code != OTHER, offsets, shortest)
            row = row_of(begin)
            free = np.array([not any(b < y and x < e for _, x, y in base[i])
                             for i, b, e in zip(row.tolist(), begin.tolist(), end.tolist())], dtype=bool)
            begin, end, row = begin[free], end[free], row[free]
            tested: list = [[] for _ in range(batch.num_rows)]
            if len(begin):
                length = end - begin
                first = np.concatenate([[0], np.cumsum(length)[:-1]])
                at = np.repeat(begin - first, length) + np.arange(length.sum())
                symbols = code[at].astype(np.int64)
                which = np.repeat(np.arange(len(begin)), length)
                held = np.zeros((len(begin), OTHER), dtype=bool)
                held[which, symbols] = True
                fits = ~(held @ (_VALUE < 0).T)
                encoding = np.where(fits.any(1) & (held & ~_DIGITS).any(1), fits.argmax(1), -1)
                known = np.flatnonzero(encoding >= 0)
                if len(known):
                    use = (encoding >= 0)[which]
                    lengths = length[known]
                    e = encoding[known]
                    s = battery(_VALUE[np.repeat(e, lengths), symbols[use]], np.concatenate([[0], np.cumsum(lengths)[:-1]]), _SIZE[e])
                    z = shared.value.deviate(e, lengths, s)
                    sort = length_class(lengths)
                    for j, n in enumerate(known.tolist()):
                        i = int(row[n])
                        from_ = points[offsets[i]]
                        tested[i].append((int(points[begin[n]] - from_), int(points[end[n]] - from_), NAMES[e[j]], float(s[j]), float(z[j]), int(sort[j])))
            spans = [[(KINDS[k], int(points[b] - points[o]), int(points[e] - points[o])) for k, b, e in sorted(found, key=lambda x: (x[1], x[0]))]
                     for found, o in zip(base, offsets.tolist())]
            listed = lambda rows, kind: pa.array([[dict(zip(kind.names, r)) for r in one] for one in rows], pa.list_(kind))
            made = pa.StructArray.from_arrays([listed(spans, span), listed(tested, figures)], names=["base", "tested"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "found"])

    read = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)], F.col("text").cast("string").alias("t"))
    schema = ", ".join([*(f"{k} {types[c]}" for c, k in zip(keep, names)), f"found {_TYPE}"])
    return read.mapInArrow(scan, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, names)], F.col("found").alias(out))


def cuts(examined: DataFrame, out: str, rate: float) -> dict[int, float]:
    """Largest ``z`` of a discovery by class of length: the most runs whose p-value, rounded up to
    its bin's edge, is at most ``rate`` times their share of the class."""
    rows = (examined.select(F.explode(f"{out}.tested").alias("x"))
            .groupBy("x.class", F.col("x.encoding").isin("lower", "upper", "letters").alias("word"), F.floor(10 * F.col("x.z")).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")).collect())
    edges = (np.arange(-10 * FAR, 10 * FAR + 1) + 1) / 10
    count = lambda take: np.bincount([r["bin"] + 10 * FAR for r in rows if take(r)], [r["n"] for r in rows if take(r)], len(edges))
    words = count(lambda r: r["word"])
    middle, spread = 0.0, 1.0
    if words.sum():
        low, lower, half = np.interp([0.0228, 0.1587, 0.5], np.cumsum(words) / words.sum(), edges)
        middle, spread = min(half, 0.0), max(1.0, half - lower, (half - low) / 2)
    p = np.array([0.5 * math.erfc(-(x - middle) / spread / math.sqrt(2)) for x in edges])
    found: dict[int, float] = {}
    for kind in sorted({r["class"] for r in rows}):
        n = count(lambda r: r["class"] == kind)
        good = np.flatnonzero((n > 0) & (p * n.sum() <= rate * n.cumsum()))
        if len(good):
            found[kind] = float(edges[good[-1]])
    return found


def find(docs: DataFrame, keep: list[str] | None = None, out: str = "secrets", shortest: int = 16, rate: float = 0.01) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the struct column ``out``; ``rate`` is the rate of
    false discoveries among the spans of kind ``random``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    examined = materialize(examine(docs, ordinary(transitions(docs)), keep, out, shortest), "secrets")
    limits = cuts(examined, out, rate)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    random = F.filter(f"{out}.tested", lambda x: (x.s <= CRITICAL) & F.coalesce(x.z < most[x["class"]], F.lit(False))
                      if limits else F.lit(False))
    span = lambda x: F.struct(x.begin, order[x.kind].alias("order"), x.kind, x.end)
    added = F.transform(random, lambda x: F.struct(x.begin, F.lit(len(KINDS) - 1).alias("order"), F.lit("random").alias("kind"), x.end))
    both = F.array_sort(F.concat(F.transform(f"{out}.base", span), added))
    spans = F.transform(both, lambda x: F.struct(x.kind, x.begin, x.end))
    return examined.select(*[F.col(f"`{c}`") for c in keep],
                           F.struct(F.col(f"{out}.base").alias("base"), spans.alias("spans"), F.col(f"{out}.tested").alias("tested")).alias(out))
