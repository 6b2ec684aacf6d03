"""N-gram Jaccard join (operator 2).

Documents are rows, distinct word shingles columns of a sparse incidence matrix;
two documents link when their shingle sets' Jaccard similarity reaches a rational
threshold, exactly. Steps:

1. ``_sets``: per document the set's size and a 128-bit digest; per block of rows
   the shingles that many of its documents have. Documents with equal sets are one
   class from here on (its number: 64 bits of the digest).
2. ``_prefixes``: shingles are ordered by how frequent they are, then by hash. Of the
   first n - ceil(t n) + 1 + n // 10 shingles of a set of n, at least n // 10 are
   shared with any set it links with, so only those columns are multiplied out. The
   order merely keeps frequent passages out of the prefixes; any order is exact.
3. ``_shared``: rows are dealt by shingle; those of one class alone are dropped. Each
   class then spares its n // 10 - 1 most widely shared ones, which leaves at least
   one that it shares with every class it links with: a passage that many unlike
   documents hold stops being a reason to compare them.
4. ``_lists``: classes that share a shingle, with whether each spares it. Lists that
   all spare are dropped, equal lists count once, and lists longer than ``CHUNK`` go
   on in chunks. Candidate pairs have one member that does not spare the shingle:
   first the pairs of each list's smallest such class, then, between classes not yet
   connected, all that the bounds allow: sizes, and a parity bitmap of each set, whose
   differing bits are at most as many as the sets' differing shingles. So copies and
   near copies are connected through a few links instead of all their pairs, unlike
   documents are told apart inside a list, and no link between components is lost.
5. ``_links``: blocks of the product, a pivot against its members, which stream past
   it (pivots with many are split by a salt). The overlap is accumulated over the
   prefixes first, and pairs that the sizes then rule out are discarded; the others'
   overlap is counted over the whole sets, and pairs below 100 i >= 80 u are dropped.
6. Components of the links, then the smallest ``doc_id`` of each.

Results: ``n_shingles`` and ``component_id`` per row. A text of fewer words than a
shingle is one shingle; without words it has none and links with nothing, not even
its equals. A null id is in its component like any row but never names it unless
the component has no other id (then null). Equal rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import id_text, materialize, row_chunks, utf8
from ebbflow.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 4096
#: Rows after which a block's frequent shingles are counted, and how many documents make one frequent.
BLOCK_ROWS = 10_000
FREQUENT = 5
#: Most entries of the broadcast table of frequent shingles (16 bytes each); it only orders shingles.
MOST_FREQUENT = 500_000
#: Keys up to which candidate texts are found by a broadcast; beyond, by a shuffled join.
BROADCAST_KEYS = 1_000_000
PIVOT_ROWS = 1024
#: Bits of a set's parity bitmap, a power of two.
BITS = 1024
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


@dataclass(frozen=True)
class Threshold:
    """Similarity ``above / below`` and the bounds on sizes that follow from it."""
    above: int = 80
    below: int = 100

    def linked(self, overlap, a, b):
        return self.below * overlap >= self.above * (a + b - overlap)

    def prefix(self, n: int) -> int:
        """How many first shingles are looked at: any linked set shares n // 10 of them at least."""
        return n - -(-self.above * n // self.below) + 1 + n // 10


    def sizes(self, a, b):
        """Whether sets of these sizes, a <= b, can reach the threshold."""
        return self.below * a >= self.above * b

    def enough(self, rest, a, b):
        """Whether an overlap of ``rest`` would do for sets of these sizes."""
        return (self.above + self.below) * rest >= self.above * (a + b)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a lower-cased (A-Z) text."""
    split = text.translate(LOWER).split()
    if not split:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > 400_000:
        _HASHES.clear()
    word = np.fromiter(map(_HASHES.__getitem__, split), np.uint64, len(split))
    width = min(words, len(split))
    n = len(split) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = (h ^ word[j:j + n]) * _P
        h ^= h >> np.uint64(29)
    return np.unique(h * _P)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in row_chunks(batches):
        offsets, data = utf8(batch.column("text"))
        yield batch, [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _digest(s: np.ndarray) -> bytes | None:
    import xxhash
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _parity(s: np.ndarray) -> bytes:
    """A bit per shingle's leading hash bits, set if an odd number of shingles has them."""
    place = (s >> np.uint64(65 - BITS.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=BITS) & 1).tobytes()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _long(s) -> np.ndarray:
    return np.asarray(s, np.uint64).view(np.int64)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, th, n, bits, node) and, with a null ``n``, (shingle, count) of frequent shingles."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["doc_id", "th", "n", "bits", "node", "shingle", "count"]

        def frequent() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            some = count >= FREQUENT
            held.clear()
            none = pa.nulls(int(some.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(none), pa.binary()), none, pa.array(_long(value[some])), pa.array(count[some])], names=names)

        for batch, texts in _texts(batches):
            sets = [shingles(t, words) for t in texts]
            digests = [_digest(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_parity, sets), pa.binary()),
                 pa.array([None if d is None else _node(d) for d in digests], pa.int64()), none, none], names=names)
            held += sets
            if len(held) >= BLOCK_ROWS:
                yield frequent()
        if held:
            yield frequent()

    return rows.mapInArrow(scan, "doc_id long, th long, n long, bits binary, node long, shingle long, count long")


def _ordered(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A sorted set in the order of the prefixes: by frequency, then hash."""
    value, count = frequent
    if len(value):
        at = np.minimum(np.searchsorted(value, s), len(value) - 1)
        often = np.where(value[at] == s, count[at], 0)
        if often.any():
            return s[np.argsort(often, kind="stable")]
    return s


def _prefixes(rows: DataFrame, words: int, t: Threshold, frequent) -> DataFrame:
    """(shingle, n, node): the prefix of each set."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch, texts in _texts(batches):
            out: list = []
            for text in texts:
                s = shingles(text, words)
                if not len(s):
                    continue
                node = _node(_digest(s))
                if node in seen:  # an equal set of this task has been sent
                    continue
                seen.add(node)
                out.append((_ordered(s, frequent.value)[:t.prefix(len(s))], len(s), node))
            if len(seen) > 500_000:
                seen.clear()
            sizes = np.array([len(o[0]) for o in out], np.int64)
            n = np.repeat(np.array([o[1] for o in out], np.int64), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_long(np.concatenate([o[0] for o in out]) if out else [])), pa.array(n.astype(np.int32)),
                 pa.array(np.repeat(np.array([o[2] for o in out], np.int64), sizes))], names=["shingle", "n", "node"])

    return rows.select("text").mapInArrow(scan, "shingle long, n int, node long")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of a sorted stream with begin and end of the groups of more than one row of equal
    first column; a batch's last group waits for the next batch."""
    carry = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if carry is not None:
            columns = [np.concatenate(x) for x in zip(carry, columns)]
        cuts = np.flatnonzero(np.diff(columns[0])) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(columns[0])]])
        last = int(begin[-1])
        carry = [c[last:].copy() for c in columns]
        many = (end - begin > 1)[:-1]
        yield columns, begin[:-1][many], end[:-1][many]
    if carry is not None and len(carry[0]) > 1:
        yield carry, np.array([0]), np.array([len(carry[0])])


def _shared(prefixes: DataFrame) -> DataFrame:
    """(shingle, n, node, kept): prefix shingles of more than one class; ``kept`` unless the class spares it."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "n", "node"]
        for columns, begin, end in _groups(batches, names):
            inside = np.zeros(len(columns[0]) + 1, np.int64)
            inside[begin] += 1
            inside[end] -= 1
            rows = np.flatnonzero(np.cumsum(inside[:-1]))
            shingle, n, node = (c[rows] for c in columns)
            new = np.concatenate([[True], (np.diff(shingle) != 0) | (np.diff(node) != 0) | (np.diff(n) != 0)])[:len(rows)]
            shingle, n, node = shingle[new], n[new], node[new]
            group = np.cumsum(np.concatenate([[True], np.diff(shingle) != 0])[:len(shingle)]) - 1
            df = np.bincount(group, minlength=1)[group]
            some = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(shingle[some]), pa.array(n[some].astype(np.int32)), pa.array(node[some]), pa.array(df[some])],
                                             names=[*names, "df"])

    dealt = prefixes.repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    found = dealt.mapInArrow(scan, "shingle long, n int, node long, df long")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), "shingle"))  # a class's prefix
    spare = F.greatest(F.floor(F.col("n") / 10) - 1, F.lit(0))
    return found.withColumn("kept", place > spare).drop("df")


def _lists(shared: DataFrame) -> DataFrame:
    """(list, chunk, nodes, sizes, kept): classes that share a shingle, by size."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        sent: set[bytes] = set()
        for columns, begin, end in _groups(batches, ["shingle", "n", "node", "kept"]):
            out: list = []
            for lo, hi in zip(begin.tolist(), end.tolist()):
                n, node, kept = (c[lo:hi] for c in columns[1:])
                if not kept.any():
                    continue
                if hi - lo <= CHUNK:
                    key = xxhash.xxh3_128_digest(node.tobytes() + kept.tobytes())
                    if key not in sent:
                        sent.add(key)
                        out.append((key, 0, node, n, kept))
                    continue
                key = int(columns[0][lo]).to_bytes(8, "little", signed=True)
                first = int(np.argmax(kept))
                for c, at in enumerate(range(0, hi - lo, CHUNK)):
                    # every chunk has the list's first class that keeps the shingle, which connects the chunks
                    rows = np.unique([first, *range(at, min(at + CHUNK, hi - lo))])
                    out.append((key, c, node[rows], n[rows], kept[rows]))
            if len(sent) > 300_000:
                sent.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.int64())),
                 pa.array([o[3] for o in out], pa.list_(pa.int32())), pa.array([o[4] for o in out], pa.list_(pa.bool_()))],
                names=["list", "chunk", "nodes", "sizes", "kept"])

    dealt = shared.repartition("shingle").sortWithinPartitions("shingle", "n", "node")
    return (dealt.mapInArrow(scan, "list binary, chunk int, nodes array<long>, sizes array<int>, kept array<boolean>")
            .dropDuplicates(["list", "chunk"]))


def _first_pairs(lists: DataFrame, t: Threshold) -> DataFrame:
    """Each list's smallest class that keeps the shingle with those its size allows; the next one beyond takes its place."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches):
            a, b = [], []
            for nodes, sizes, kept in zip(*(batch.column(c).to_pylist() for c in ("nodes", "sizes", "kept"))):
                first = kept.index(True)
                pivot, size = nodes[first], sizes[first]
                for i, (node, n) in enumerate(zip(nodes, sizes)):
                    if t.sizes(min(size, n), max(size, n)):
                        a.append(pivot if i > first else node)
                        b.append(node if i > first else pivot)
                    elif kept[i] and i > first:
                        pivot, size = node, n
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("nodes", "sizes", "kept").mapInArrow(scan, "a long, b long").filter("a != b").distinct()


def _other_pairs(lists: DataFrame, parts: DataFrame, classes: DataFrame, t: Threshold) -> DataFrame:
    """Pairs of a list's classes in different parts (node, component), of which one keeps the shingle,
    that the bounds allow."""
    zipped = F.arrays_zip("nodes", "sizes", "kept")
    member = (lists.select("list", "chunk", F.explode(zipped).alias("m"))
              .select("list", "chunk", F.col("m.nodes").alias("node"), F.col("m.sizes").alias("n"), F.col("m.kept").alias("kept")))
    about = (classes.select("node", "bits").join(parts, "node", "left")
             .select("node", F.coalesce("component", "node").alias("part"), "bits"))
    grouped = (member.join(about, "node").groupBy("list", "chunk")  # at most CHUNK + 1 members
               .agg(F.array_sort(F.collect_list(F.struct("n", "node", "part", "kept", "bits"))).alias("m"), F.min("part").alias("lo"), F.max("part").alias("hi")))
    one = grouped.filter("lo != hi").select("m", F.lit(None).cast(grouped.schema["m"].dataType).alias("o"))
    longer = lists.filter("chunk > 0").select("list").distinct()
    chunks = grouped.join(longer, "list", "left_semi")
    x, y = chunks.select("list", F.col("chunk").alias("c"), "m"), chunks.select("list", F.col("chunk").alias("d"), F.col("m").alias("o"))
    two = x.join(y, "list").filter("c < d").select("m", "o")  # pairs of blocks of a long list

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrays(column, i):
            part = column.slice(i, 1).flatten()
            bits = np.frombuffer(b"".join(part.field(4).to_pylist()), np.uint64).reshape(len(part), -1)
            return [*(part.field(k).to_numpy(zero_copy_only=False) for k in range(4)), bits]

        for batch in batches:
            for i in range(batch.num_rows):
                n, node, part, kept, bits = first = arrays(batch.column("m"), i)
                same = not batch.column("o")[i].is_valid
                n2, node2, part2, kept2, bits2 = first if same else arrays(batch.column("o"), i)
                pairs: list = []
                for j in range(len(n)):
                    lo = j + 1 if same else 0
                    big, small = np.maximum(n2[lo:], n[j]).astype(np.int64), np.minimum(n2[lo:], n[j]).astype(np.int64)
                    some = lo + np.flatnonzero((part2[lo:] != part[j]) & t.sizes(small, big) & (kept2[lo:] | kept[j]))
                    # the overlap is (a + b - differing shingles) / 2
                    differ = np.bitwise_count(bits2[some] ^ bits[j]).sum(1, dtype=np.int64)
                    a, b = n2[some].astype(np.int64), int(n[j])
                    some = some[t.enough((a + b - differ) / 2, a, b)]
                    if len(some):
                        first = (n2[some] > n[j]) | (n2[some] == n[j]) & (node2[some] > node[j])
                        pairs.append((np.where(first, node[j], node2[some]), np.where(first, node2[some], node[j])))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in range(2)], names=["a", "b"])

    return one.unionByName(two).mapInArrow(scan, "a long, b long").distinct()


def _sets_by_pivot(rows: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, t: Threshold, frequent, prefixes: bool) -> DataFrame:
    """(a, salt, b, n, part): for each pair the set of ``b`` (or its prefix), and with a null ``b`` the pivot's
    own, first; sorted. The texts are read again; those asked for are found by their rows' keys."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    own = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).withColumn("b", F.lit(None).cast("long"))
    asked = (members.unionByName(own).withColumn("node", F.coalesce("b", "a")).join(classes.select("node", "rep"), "node")
             .groupBy(F.col("rep.id").alias("i"), F.col("rep.th").alias("h")).agg(F.collect_list(F.struct("a", "salt", "b")).alias("asked")))
    asked = materialize(asked, "asked")
    side = F.broadcast(asked) if pairs.count() <= BROADCAST_KEYS else asked
    found = rows.join(side, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).select("doc_id", "th", "text", "asked")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set = set()
        for batch, texts in _texts(batches):
            out: list = []
            for doc_id, th, text, entries in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), texts, batch.column("asked").to_pylist()):
                if (doc_id, th) in done:  # an equal row of this task
                    continue
                done.add((doc_id, th))
                s = shingles(text, words)
                part = (np.sort(_ordered(s, frequent.value)[:t.prefix(len(s))]) if prefixes else s).tobytes()
                out += [(e["a"], e["salt"], e["b"], len(s), part) for e in entries]
            for cut in range(0, len(out), 2000):
                some = out[cut:cut + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in some], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                                 names=["a", "salt", "b", "n", "part"])

    return (found.mapInArrow(scan, "a long, salt int, b long, n int, part binary").repartition("a", "salt")
            .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()))


def _block_products(sets: DataFrame, t: Threshold, prefixes: bool) -> DataFrame:
    """Pairs (a, b) that pass: with whole sets those that link; with prefixes those that still can, as the
    overlap is at most the prefixes' own and what the longer remainder could add."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, mine, size = None, None, 0
        for batch in row_chunks(batches, 500):
            x, y = [], []
            for a, salt, b, n, data in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "n", "part"))):
                s = np.frombuffer(data, np.uint64)
                if b is None:
                    pivot, mine, size = (a, salt), s, n
                    continue
                if pivot != (a, salt):
                    raise ValueError("a pivot's own row comes first")
                if not t.sizes(min(n, size), max(n, size)):
                    continue
                at = np.minimum(np.searchsorted(mine, s), len(mine) - 1)
                overlap = int((mine[at] == s).sum())
                rest = max(n - len(s), size - len(mine))
                if t.enough(overlap + rest, n, size) if prefixes else t.linked(overlap, n, size):
                    x.append(a)
                    y.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return sets.mapInArrow(scan, "a long, b long").distinct()


def _links(rows: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, t: Threshold, frequent) -> DataFrame:
    """The pairs (a, b) that link: first by their prefixes, then by the whole sets."""
    for prefixes in (True, False):
        pairs = materialize(_block_products(_sets_by_pivot(rows, classes, pairs, words, t, frequent, prefixes), t, prefixes), "pairs")
    return pairs


def join(docs: DataFrame, words: int = 5, threshold: Threshold = Threshold()) -> DataFrame:
    """(doc_id, th, n_shingles, part, component_id) per row; ``th`` is the hash of the text (null as empty),
    ``part`` a number of the component (null without shingles)."""
    rows = id_text(docs).withColumn("th", F.xxhash64("text"))
    found = materialize(_sets(rows, words), "sets")
    per_row = found.filter("n is not null").select("doc_id", "th", "n", "node", "bits")
    often = (found.filter("n is null").groupBy("shingle").agg(F.sum("count").alias("c"))
             .orderBy(F.desc("c"), "shingle").limit(MOST_FREQUENT).toPandas())
    value = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    frequent = docs.sparkSession.sparkContext.broadcast((value[order], often["c"].to_numpy(np.int64)[order]))
    rep = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")
    classes = materialize(per_row.filter("n > 0").groupBy("node").agg(F.min(rep).alias("rep"), F.min("doc_id").alias("least"), F.first("bits").alias("bits")), "classes")

    lists = materialize(_lists(_shared(_prefixes(rows, words, threshold, frequent))), "lists")
    first = materialize(_first_pairs(lists, threshold), "pairs")
    parts = components(_links(rows, classes, first, words, threshold, frequent))
    rest = materialize(_other_pairs(lists, parts, classes, threshold).join(first, ["a", "b"], "left_anti"), "pairs")
    more = _links(rows, classes, rest, words, threshold, frequent)
    if not more.isEmpty():
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = classes.select("node", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.select("node", "component").join(least, "component").select("node", F.col("component").alias("part"), "component_id")
    return per_row.join(by_node, "node", "left").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), "part",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, threshold: Threshold = Threshold()) -> DataFrame:
    """``docs`` with one row of each component (the least ``doc_id``; of equal ids the least hash of the
    text; a null id only if there is no other; of equal rows one) and every row without shingles."""
    found = materialize(join(docs, words, threshold).filter("n_shingles > 0").select("doc_id", "th", "part"), "joined")
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "th")).alias("first"))
    keys = found.groupBy("doc_id", "th", "part").agg(F.count(F.lit(1)).alias("copies")).join(first, "part")
    stays = F.col("first.id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    # only rows that go, or come more than once, need to be looked up
    known = materialize(keys.select(F.col("doc_id").alias("_i"), F.col("th").alias("_h"), stays.alias("_stays"), "copies")
                        .filter("not _stays or copies > 1").drop("copies"), "known")
    side = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_h"))
    rows = docs.join(side, on, "left")
    once = rows.filter("_stays is null").select(*docs.columns)
    return once.unionByName(rows.filter("_stays").dropDuplicates(["_i", "_h"]).select(*docs.columns))
