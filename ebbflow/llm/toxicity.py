"""Toxicity by nearest labelled examples (operator 4).

Terms are all lower-cased words of a text and, of words over five bytes, the
first five bytes (inflected forms share them). At most ``max_rows`` labelled rows to
learn from (the least by a hash of the id) are counted per term and label; a term has
evidence if its rows are toxic so much more often than the base rate that fewer than
``alpha`` such terms are expected by chance (Chernoff bound), at most ``max_terms``
of them by evidence. Evidence only weighs a term ``evidence`` times (1: plain TF-IDF). Inverse document
frequencies come from all documents. A text is its TF-IDF vector over all its words:
those of the examples have numbers of their own; others, which no example has, only
count in the length and share ``BUCKETS`` document frequencies by hash. Terms are
known by 64-bit hashes, of words of any length; counts are kept, not weights, so the
model is small in every worker, and what is sent out is dropped when its stage ends.

Examples are the first ``max_examples`` of those rows that have a word. They lie in
blocks behind an inverted index. The words that many examples have are columns of a
dense matrix with, per block, the largest weight of each; the others' postings are
added up first. A block's largest sum, and the query's product with its largest
weights, bound every cosine in the block. The blocks of largest bound are opened
first, then those that can still beat the k-th neighbour; the others never are. The dense
part of opened blocks is multiplied in single precision, and exactly for every example
that its error lets among the nearest: the
cosines are exact (to twelve digits), so a copy of an example has cosine 1. Neighbours
vote with the fourth power of their cosine, against a prior of weight ``prior_weight``
at the rate of toxic rows among labelled rows without evidence; the score is the
weighted share of toxic votes.

Results, in a struct column (replacing one of that name): ``score`` (0 to 1) and
``evidence``, the nearest examples (doc_id, cosine, label), nearest first, ties by
the index's order. Texts without words, and null ones, get the prior. Labels are only read for the rows to learn from (null labels are skipped,
of repeated ids the largest label counts); without any, every score is 0.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import materialize, row_chunks

_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 0x20 for b in range(256))
PREFIX = 5
#: Blocks opened before the k-th cosine is known.
FIRST_BLOCKS = 4
#: Terms tested, per labelled row, in the bound over all terms.
NEW_TERMS = 100
#: Shared document frequencies of the words that no example has; a power of two.
BUCKETS = 1 << 21
#: Words of most examples whose weights are a dense matrix, and queries multiplied with it at once.
COMMON, QUERIES = 512, 128
#: Rows whose words are numbered together; a multiple of QUERIES.
ROWS = 1024
#: Over twice the error of a product of COMMON positive terms in single precision whose exact value is 1 at most.
SLACK = 1e-4
_TYPE = "struct<score:double,evidence:array<struct<doc_id:long,cosine:double,label:int>>>"


def text_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TABLE).split()


def terms_of(words) -> list[bytes]:
    return [*words, *(w[:PREFIX] + b"*" for w in words if len(w) > PREFIX)]


def hashes_of(terms: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def hashes_in(text: str | None) -> np.ndarray:
    """Of each of a text's terms, once."""
    return hashes_of(set(terms_of(set(text_words(text or "")))))


def counts(text: str | None) -> dict[bytes, int]:
    """How often a text has each of its terms."""
    words = Counter(text_words(text or ""))
    found = dict(words)
    for word, n in words.items():
        if len(word) > PREFIX:
            start = word[:PREFIX] + b"*"
            found[start] = found.get(start, 0) + n
    return found


def terms_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms that the texts have; text and term of each occurrence."""
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__
    found = [np.fromiter(map(words.__getitem__, text_words(text or "")), np.int64) for text in texts]
    starts: defaultdict[bytes, int] = defaultdict()
    starts.default_factory = lambda: len(words) + len(starts)
    start = np.array([starts[w[:PREFIX] + b"*"] if len(w) > PREFIX else -1 for w in words], np.int64)
    word, of = np.concatenate([np.zeros(0, np.int64), *found]), np.repeat(np.arange(len(texts)), list(map(len, found)))
    first = start[word]
    return hashes_of([*words, *starts]), np.concatenate([of, of[first >= 0]]), np.concatenate([word, first[first >= 0]])


@dataclass
class ToxicityModel:
    """What the driver holds and sends out: bounded by ``max_examples``, their words and ``BUCKETS``."""
    #: Hashes of the known terms, ascending, and the number of each.
    terms: np.ndarray
    number: np.ndarray
    #: The first so many numbers have evidence, which multiplies their weight.
    evident: int
    evidence: float
    #: By term, then by bucket of the words that no example has.
    idf: np.ndarray
    prior: float
    prior_weight: float
    neighbours: int
    doc_ids: np.ndarray
    labels: np.ndarray
    block: int
    #: The examples' words: first posting of each term; example and count of each posting; lengths by example.
    postings: tuple[np.ndarray, np.ndarray, np.ndarray]
    length: np.ndarray

    def __getstate__(self) -> bytes:
        """What is sent out, packed; the index is made of it where it is used."""
        return zlib.compress(pickle.dumps({f.name: getattr(self, f.name) for f in fields(self)}, 5), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))

    @cached_property
    def index(self) -> tuple[np.ndarray, ...]:
        """Per term its column of the dense matrix or -1; the columns' terms; weights by example (whole
        blocks) and column, in single precision; the counts they are of; the largest weights by column and
        block; 1 + logarithms of counts (0 of none); lengths by example (whole blocks); for the terms' postings, then for those of
        counts over 1: where each term's begin, and the examples, then also the counts, as binary values, which
        one call gathers for many terms."""
        begin, example, count = self.postings
        n_terms, blocks = len(self.terms), -(-len(self.labels) // self.block)
        often = np.diff(begin)
        common = np.sort(np.lexsort((np.arange(n_terms), -often))[:COMMON])
        column = np.full(n_terms, -1, np.int16)
        column[common] = np.arange(len(common))
        dense = np.zeros((blocks * self.block, len(common)), np.float32)
        held = np.zeros(dense.shape, count.dtype)
        largest = np.zeros((len(common), blocks))
        for c, t in enumerate(common.tolist()):
            some = slice(int(begin[t]), int(begin[t + 1]))
            e = example[some]
            w = self._weights(np.full(len(e), t), count[some]) / self.length[e]
            dense[e, c], held[e, c] = w, count[some]
            np.maximum.at(largest[c], e // self.block, w)
        logs = 1 + np.log(np.maximum(np.arange(int(count.max(initial=1)) + 1), 1))
        logs[0] = 0
        length = np.concatenate([self.length, np.ones(blocks * self.block - len(self.length))])
        lists = lambda at, x: pa.Array.from_buffers(pa.large_binary(), n_terms, [None, pa.py_buffer(at * x.itemsize), pa.py_buffer(x)])
        more = np.flatnonzero(count > 1)
        at = np.searchsorted(more, begin)
        return (column, common, dense, held, largest, logs, length, begin, lists(begin, example),
                at, lists(at, example[more]), lists(at, count[more]))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """A term's number, or a bucket past all numbers if no example has it."""
        shared = len(self.terms) + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        if not len(self.terms):
            return shared
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, self.number[at], shared)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and normalised weights of a text."""
        return self.vectors([text])[0]

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number, count) of every term number that a text has, ascending."""
        hashes, of, term = terms_in(texts)
        numbers = self.numbers(hashes)
        key, n = np.unique(of * (len(self.terms) + BUCKETS) + numbers[term], return_counts=True)
        return *np.divmod(key, len(self.terms) + BUCKETS), n

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        of, i, n = self.numbered(texts)
        ends = np.searchsorted(of, np.arange(1, len(texts))) if len(texts) else []
        return [(i, self._unit(i, n)) for i, n in zip(np.split(i, ends), np.split(n, ends))]

    def _weights(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1 + np.log(n.astype(float))) * self.idf[i] * np.where(i < self.evident, self.evidence, 1.0)

    def _unit(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = self._weights(i, n)
        return w / np.sqrt((w * w).sum()) if len(i) else w

    def nearest(self, i: np.ndarray, w: np.ndarray) -> list[tuple[float, int]]:
        """(cosine, example) of the nearest examples of a vector."""
        return self.nearest_of([(i, w)])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[float, int]]]:
        if not len(self.labels):
            return [[] for _ in vectors]
        return [x for at in range(0, len(vectors), QUERIES) for x in self._nearest(vectors[at:at + QUERIES])]

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[float, int]]]:
        columns, _, dense, _, largest, logs, length, begin, examples, more, more_examples, more_counts = self.index
        _, example, count = self.postings
        size, blocks = len(dense), len(dense) // self.block
        cosine, q = np.zeros((len(vectors), size)), np.zeros((len(vectors), dense.shape[1]))
        for k, (i, w) in enumerate(vectors):
            known = i < len(self.terms)
            i, w = i[known], w[known]
            column = columns[i]
            q[k, column[column >= 0]] = w[column >= 0]
            i, w = i[column < 0], w[column < 0]
            each = w * self.idf[i] * np.where(i < self.evident, self.evidence, 1.0)
            n, m, terms = begin[i + 1] - begin[i], more[i + 1] - more[i], pa.array(i)
            values = lambda x, like, n: np.frombuffer(x.take(terms).buffers()[2] or b"", like.dtype, int(n.sum()))
            if n.any():
                cosine[k] = np.bincount(values(examples, example, n), np.repeat(each, n), minlength=size)
            if m.any():
                rest = np.repeat(each, m) * (logs[values(more_counts, count, m)] - 1)
                cosine[k] += np.bincount(values(more_examples, example, m), rest, minlength=size)
        cosine /= length
        bound = cosine.reshape(len(vectors), blocks, self.block).max(2) + q @ largest
        first = min(max(FIRST_BLOCKS, -(-self.neighbours // self.block)), blocks)
        opened = np.zeros(bound.shape, bool)
        np.put_along_axis(opened, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)  # the most promising, then all that can still matter
        near = np.full((len(vectors), blocks, self.block), -1.0, np.float32)  # -1: not opened
        self._open(near, cosine, q, opened)
        worst = np.array([self._least(near[k, opened[k]].ravel()) for k in range(len(vectors))])
        self._open(near, cosine, q, ~opened & (bound > worst[:, None] - SLACK))
        near = near.reshape(len(vectors), size)
        found = []
        for k in range(len(vectors)):
            some = np.flatnonzero(near[k] >= max(worst[k] - SLACK, 0.0))
            some = some[near[k, some] >= self._least(near[k, some]) - SLACK]
            found.append(self._best(some, cosine[k], q[k]))
        return found

    def _open(self, near: np.ndarray, cosine: np.ndarray, q: np.ndarray, some: np.ndarray) -> None:
        """Cosines, the common words' part in single precision, in the chosen blocks of each query."""
        dense, q = self.index[2], q.astype(np.float32)
        cosine = cosine.reshape(near.shape)
        if some.mean() > 0.25:  # the whole product costs less than its many parts
            near[:] = cosine + (q @ dense.T).reshape(near.shape)
            return
        for b in np.flatnonzero(some.any(0)).tolist():
            k = np.flatnonzero(some[:, b])
            near[k, b] = cosine[k, b] + q[k] @ dense[b * self.block:(b + 1) * self.block].T

    def _least(self, near: np.ndarray) -> float:
        """The k-th cosine; 0 if there are fewer."""
        at = len(near) - self.neighbours
        return float(np.partition(near, at)[at]) if at >= 0 else 0.0

    def _best(self, which: np.ndarray, cosine: np.ndarray, q: np.ndarray) -> list[tuple[float, int]]:
        """The nearest of the examples ``which``, by exact cosines, ties by their order."""
        _, common, _, held, _, logs, length, *_ = self.index
        c = np.flatnonzero(q)
        found = cosine[which].copy()
        if len(c):
            each = self.idf[common[c]] * np.where(common[c] < self.evident, self.evidence, 1.0)
            for at in range(0, len(which), 1024):  # many copies may be equally near
                e = which[at:at + 1024]
                found[at:at + 1024] += (logs[held[e[:, None], c]] * each / length[e, None]) @ q[c]
        found = np.round(found, 12)
        best = np.lexsort((which, -found))[:self.neighbours]
        return [(c, e) for c, e in zip(found[best].tolist(), which[best].tolist()) if c > 0]

    def score(self, near: list[tuple[float, int]]) -> float:
        votes = [(c ** 4, int(self.labels[e])) for c, e in near]
        return (sum(v * y for v, y in votes) + self.prior_weight * self.prior) / (sum(v for v, _ in votes) + self.prior_weight)


def labelled_rows(docs: DataFrame, labels: DataFrame, learn: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` rows to learn from, those of least hash of the id;
    ``learn`` is a condition on doc_id. Only ids and labels are sent to the documents."""
    known = (labels.filter("toxic is not null and doc_id is not null").filter(learn).groupBy(F.col("doc_id").cast("long").alias("i"))
             .agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("i"), "i").limit(most))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(known), F.col("doc_id") == F.col("i")).drop("i"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, alpha: float = 1.0, max_rows: int = 50_000, max_terms: int = 20_000,
        max_examples: int = 20_000, neighbours: int = 15, prior_weight: float = 0.02, block: int = 64, evidence: float = 8.0) -> ToxicityModel:
    rows = labelled_rows(docs, labels, learn, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 10_000):
            found = [hashes_in(text) for text in batch.column("text").to_pylist()]
            toxic = np.repeat([int(label or 0) for label in batch.column("label").to_pylist()], list(map(len, found)))
            term, place, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n), pa.array(np.bincount(place, toxic, len(term)).astype(np.int64))],
                                             names=["term", "n", "a"])

    total = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    n_rows, n_toxic = total[0], total[1] or 0
    rate = n_toxic / n_rows if n_rows else 0.0
    per_term = rows.select("text", "label").mapInArrow(count, "term long, n long, a long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    # divergence of the term's rate of toxic rows from the base rate, times its rows
    p = F.col("a") / F.col("n")
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - rate))).otherwise(0.0)
    weight = F.col("n") * (p * F.log(p / F.lit(rate)) + rest)
    threshold = math.log(max(n_rows, 1) * NEW_TERMS / alpha)
    terms = (per_term.filter(f"a > {rate} * n").withColumn("e", weight).filter(F.col("e") >= threshold)
             .orderBy(F.desc("e"), "term").limit(max_terms).collect() if 0 < rate < 1 else [])
    known = np.array([r["term"] for r in terms], np.int64).view(np.uint64)
    order = np.argsort(known)
    model = ToxicityModel(known[order], order.astype(np.int32), len(known), evidence, np.zeros(0), 0.0, prior_weight, neighbours, np.zeros(0, np.int64), np.zeros(0, np.int8), block,
                          (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)), np.zeros(0))
    if not n_rows:
        model.idf = np.ones(BUCKETS)
        return model
    examples = _sample(rows, model, max_examples)
    _document_frequencies(docs, model)
    _index(examples, model)
    return model


def _sample(rows: DataFrame, model: ToxicityModel, most: int) -> DataFrame:
    """(doc_id, label, terms, counts) of the examples. Sets the prior and numbers the examples' terms."""
    evident = rows.sparkSession.sparkContext.broadcast(model.terms)  # sorted hashes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 500):
            found = [counts(x) for x in batch.column("text").to_pylist()]
            terms = [hashes_of(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([bool(np.isin(t, evident.value, kind="sort").any()) for t in terms], pa.bool_()),
                 pa.array([t.view(np.int64) for t in terms], pa.list_(pa.int64())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "label", "evident", "terms", "counts"])

    made = materialize(rows.mapInArrow(count, "doc_id long, label int, evident boolean, terms array<long>, counts array<int>"), "labelled")
    evident.destroy()
    none = made.filter("not evident").agg(F.count(F.lit(1)), F.sum("label")).first()
    model.prior = (none[1] or 0) / none[0] if none[0] else 0.0
    some = made.filter("size(terms) > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).drop("evident")
    examples = materialize(some, "examples")
    held = examples.select(F.explode("terms").alias("t")).distinct().toArrow().column("t").to_numpy().view(np.uint64)
    new = np.setdiff1d(held, model.terms)
    terms = np.concatenate([model.terms, new])
    order = np.argsort(terms)
    model.number = np.concatenate([model.number, model.evident + np.arange(len(new), dtype=np.int32)])[order]
    model.terms = terms[order]
    return examples


def _document_frequencies(docs: DataFrame, model: ToxicityModel) -> None:
    model.idf = np.zeros(len(model.terms) + BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        df, n = np.zeros(len(m.idf), np.int64), 0
        for batch in row_chunks(batches, ROWS):
            n += batch.num_rows
            np.add.at(df, m.numbered(batch.column("text").to_pylist())[1], 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["i", "n"])

    found = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "i long, n long")
             .groupBy("i").agg(F.sum("n").alias("n")).toArrow())  # a row per term and bucket at most
    shared.destroy()
    i, n = (found.column(c).to_numpy() for c in ("i", "n"))
    del found
    df = np.zeros(len(model.idf))
    df[i[i >= 0]] = n[i >= 0]
    model.idf = np.log((1 + n[i < 0].sum()) / (1 + df)) + 1


def _small(x: np.ndarray) -> np.ndarray:
    """In the least unsigned type that holds every value."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _index(examples: DataFrame, model: ToxicityModel) -> None:
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        for batch in row_chunks(batches, 500):
            terms = batch.column("terms")
            numbers = m.numbers(pc.list_flatten(terms).to_numpy(zero_copy_only=False).view(np.uint64))
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32())),
                 batch.column("counts")], names=["doc_id", "label", "i", "n"])

    some = examples.mapInArrow(number, "doc_id long, label int, i array<int>, n array<int>").toArrow()
    shared.destroy()
    n_rows = some.num_rows
    if not n_rows:
        return
    doc_ids, labels = some.column("doc_id").to_numpy(), some.column("label").to_numpy()
    sizes = pc.list_value_length(some.column("i")).to_numpy().astype(np.int64)
    term = pc.list_flatten(some.column("i")).to_numpy().astype(np.int32)
    count = _small(pc.list_flatten(some.column("n")).to_numpy())
    del some
    pa.default_memory_pool().release_unused()
    end = np.cumsum(sizes)
    length, strongest = np.zeros(n_rows), []
    for e, (lo, hi) in enumerate(zip((end - sizes).tolist(), end.tolist())):
        i = term[lo:hi]
        w = model._weights(i, count[lo:hi])
        length[e] = np.sqrt((w * w).sum())
        top = np.lexsort((i, -w))[:3]
        strongest.append([(-x, t) for x, t in zip((w[top] / length[e]).tolist(), i[top].tolist())])
    # examples with the same strongest terms share a block, which keeps the bounds tight
    order = np.array(sorted(range(n_rows), key=lambda e: (strongest[e], doc_ids[e])))
    place = np.empty(n_rows, np.int32)
    place[order] = np.arange(n_rows)
    model.doc_ids, model.labels, model.length = doc_ids[order].astype(np.int64), labels[order].astype(np.int8), length[order]
    example = _small(np.repeat(place, sizes))
    begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(model.terms)))])
    by_term = np.empty_like(example), np.empty_like(count)
    # a stretch of terms at a time, so that the sort takes a part of the postings' memory
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(term), 1 << 20)), len(model.terms)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        some = np.flatnonzero((term >= a) & (term < b))
        some = some[np.argsort(term[some].astype(np.int64) * n_rows + example[some])]
        for to, of in zip(by_term, (example, count)):
            to[begin[a]:begin[b]] = of[some]
    model.postings = begin, *by_term


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the struct column ``out``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    need = [*keep, *(["text"] if "text" not in keep else [])]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        entry = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])
        for batch in row_chunks(batches, ROWS):
            near = m.nearest_of(m.vectors(batch.column("text").to_pylist()))
            evidence = [[{"doc_id": int(m.doc_ids[e]), "cosine": c, "label": int(m.labels[e])} for c, e in n] for n in near]
            found = pa.StructArray.from_arrays([pa.array([m.score(n) for n in near], pa.float64()), pa.array(evidence, pa.list_(entry))],
                                               names=["score", "evidence"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, out])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` {_TYPE}"])
    return docs.select(*need).mapInArrow(apply, schema)
