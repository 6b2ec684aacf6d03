"""Conversation prefix trie by whole-sequence collapse (operator 13).

A node of the trie is a distinct sequence of first turns (role, text). No turn is
followed through the trie: every conversation becomes its whole sequence at once.

1. ``positions`` numbers the turns of each conversation, ``rebuild`` gives each
   conversation the first turns of another one;
2. ``prefixes`` gives every depth of every conversation a 128-bit key, the
   exclusive or of hashes of (depth, role, text) so far: equal keys, equal prefixes;
3. ``collapse`` groups identical conversations into one weighted sequence; from
   here on each distinct sequence stands for all its copies;
4. a sequence whose key is that of a shorter prefix of another one is a proper
   prefix; the anti-join of the sequences with those keys leaves the leaves;
5. ``trie`` aggregates the weighted prefixes of the sequences into nodes.

What a subtree saves is the sum over its conversations less the sum over its nodes.
For the latter each node belongs to the least leaf below it, so a leaf owns a run of
nodes down to its end, and only where that run begins is needed.

Scale: turns are numbered by distributed prefix sums, keys by windows over blocks of
``BLOCK`` turns whose totals are joined back, ends in blocks of ``IDS`` ids; copies of
a conversation are counted before they are shuffled. So neither a conversation nor a
group of copies nor a common prefix is gathered in one task. Only the digest of one
node's ends, sequential by nature, streams through one task, block by block.

Results: null turns come first, null roles and texts are empty, ties of turn go by
role, then by MD5 of the text; repeated rows are turns of their own. Rows with a null
id are one conversation without a base, which counts as a member and sorts last; it
has no decimal id to list. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import materialize
from ebbflow.operators.ranks import grouped_prefix_sums

BLOCK = 1024
IDS = 1024
#: Stands for a null id, after all others.
NO_ID = "10000000000000000000"
KEY = ["depth", "k1", "k2"]


def _id(conv_id: Column) -> Column:
    return F.coalesce(conv_id.cast("long").cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)"))


def _long(c: Column) -> Column:
    return F.when(c != F.lit(NO_ID).cast("decimal(20,0)"), c.cast("long"))


def positions(conversations: DataFrame) -> DataFrame:
    """(c, pos from 0, h1, h2, bytes): the turns in order, (role, text) as a 128-bit hash."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda n: F.xxhash64(F.lit(n), digest)
    turns = conversations.select(_id(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                 F.md5(text).alias("text_md5"), half(1).alias("h1"), half(2).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
                                 F.monotonically_increasing_id().alias("tie"))
    order = ["turn", "role", "text_md5", "tie"]
    placed = grouped_prefix_sums(turns, ["c"], [(o, True) for o in order], {"pos": F.lit(1).cast("long")}, freeze=True)
    return placed.select("c", (F.col("pos") - 1).alias("pos"), "h1", "h2", "bytes")


def rebuild(turns: DataFrame, base: Column, shared: Column, most_shared: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, len) and their rebuilt turns (c, len, depth from 1, h1, h2, bytes): the first
    ``shared`` turns of conversation ``base`` (expressions over ``conv_id``; at most ``most_shared``),
    then the conversation's own turns after its first ``shared``."""
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    plan = (sizes.withColumn("conv_id", _long(F.col("c")))
            .withColumns({"b": base.cast("decimal(20,0)"), "h": shared.cast("long")}))
    bases = sizes.select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = plan.join(bases, "b", "left").select("c", "b", "h", taken.alias("taken"),
                                                (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"))
    own = (turns.join(plan, "c").filter("pos >= h")
           .select("c", "len", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "h1", "h2", "bytes"))
    heads = turns.filter(F.col("pos") < most_shared).withColumnRenamed("c", "b")
    borrowed = (heads.join(plan.filter("taken > 0"), "b").filter("pos < taken")
                .select("c", "len", (F.col("pos") + 1).alias("depth"), "h1", "h2", "bytes"))
    return plan.select("c", "len"), own.unionByName(borrowed)


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: its key (k1, k2), its parent's (p1, p2), the bytes of its
    last text and of all its texts (cum)."""
    z = turns.select("c", "len", "depth", "bytes", F.floor((F.col("depth") - 1) / BLOCK).alias("block"),
                     F.xxhash64(F.lit(3), "depth", "h1", "h2").alias("z1"), F.xxhash64(F.lit(4), "depth", "h2", "h1").alias("z2"))
    inside = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (z.filter(F.col("len") > BLOCK).groupBy("c", "block")
              .agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("bytes").alias("bytes"))
              .select("c", "block", F.bit_xor("z1").over(earlier).alias("x1"), F.bit_xor("z2").over(earlier).alias("x2"),
                      F.sum("bytes").over(earlier).alias("before"))
              .filter("block > 0"))
    run = z.select("*", F.bit_xor("z1").over(inside).alias("i1"), F.bit_xor("z2").over(inside).alias("i2"), F.sum("bytes").over(inside).alias("sum"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    k1, k2 = F.col("i1").bitwiseXOR(zero("x1")), F.col("i2").bitwiseXOR(zero("x2"))
    return run.join(totals, ["c", "block"], "left").select(
        "c", "len", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("z1")).alias("p1"), k2.bitwiseXOR(F.col("z2")).alias("p2"),
        "bytes", (F.col("sum") + zero("before")).alias("cum"))


def _whole(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation: the key of its whole sequence and its bytes."""
    zero = F.lit(0).cast("long")
    empty = conversations.filter("len = 0").select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("total"))
    return rows.filter("depth = len").select("c", "depth", "k1", "k2", F.col("cum").alias("total")).unionByName(empty)


def collapse(whole: DataFrame) -> DataFrame:
    """Identical conversations as one weighted sequence: key, weight, rep (the least of them), total."""
    return whole.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("rep"), F.max("total").alias("total"))


def end_lists(whole: DataFrame) -> DataFrame:
    """SHA-256 of the ids of each group of identical conversations, ascending, comma-joined."""
    ids = whole.filter(_long(F.col("c")).isNotNull()).withColumn("id", _long(F.col("c")))
    blocks = (ids.groupBy(*KEY, F.floor(F.col("id") / IDS).alias("block"))
              .agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [*(pa.array([r[0][i] for r in done], pa.int64()) for i in range(3)), pa.array([r[1] for r in done], pa.string())],
                names=[*KEY, "ends_sha256"])
            done.clear()
            return made

        for batch in batches:
            for *found, ids in zip(*(batch.column(n).to_pylist() for n in [*KEY, "ids"])):
                if found == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = found, hashlib.sha256()
                sha.update(ids.encode())
            yield out()
        if key is not None:
            done.append((key, sha.hexdigest()))
            yield out()

    return (blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def trie(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes from conversations (c, len) and their ``prefixes``, which are read several times."""
    whole = _whole(conversations, rows)
    sequences = materialize(collapse(whole), "sequences")
    zero = F.lit(0).cast("long")
    root = rows.filter("depth = 1").select(*[zero.alias(n) for n in KEY])
    proper = rows.filter("depth < len").select(*KEY).unionByName(root).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    inner = sequences.join(proper, KEY, "left_semi").withColumn("leaf", zero)
    marked = leaves.unionByName(inner).select("rep", "weight", "total", "leaf")

    # the weighted prefixes of each distinct sequence, the empty one included
    roots = marked.select("rep", "weight", "total", "leaf", *[zero.alias(n) for n in ("depth", "k1", "k2", "p1", "p2", "bytes", "cum")])
    steps = rows.join(marked, F.col("c") == F.col("rep")).select(*roots.columns)
    weighted = materialize(steps.unionByName(roots), "prefixes")

    before = F.col("cum") - F.col("bytes")
    nodes = materialize(
        weighted.groupBy(*KEY).agg(
            F.sum("weight").alias("n_convs"), F.min("rep").alias("conv"), F.sum("leaf").alias("n_leaves"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
            F.min(F.when(F.col("leaf") == 1, F.col("rep"))).alias("owner"), F.max(before).alias("before"),
            F.sum(F.col("weight") * F.col("total")).alias("all_bytes")), "nodes")
    owned = nodes.groupBy(F.col("owner").alias("rep")).agg(F.min(F.struct("depth", "before")).getField("before").alias("from"))
    distinct_bytes = (weighted.filter("leaf = 1").join(owned, "rep").groupBy(*KEY)
                      .agg(F.sum(F.col("total") - F.greatest(before, F.col("from"))).alias("distinct_bytes")))
    children = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    saved = F.col("all_bytes") - F.col("n_convs") * F.col("before") - F.col("distinct_bytes")
    nothing = hashlib.sha256().hexdigest()
    return (nodes.join(distinct_bytes, KEY).join(children, KEY, "left").join(end_lists(whole), KEY, "left")
            .join(parents, ["depth", "p1", "p2"], "left")
            .select(_long(F.col("conv")).alias("conv_id"), "depth", _long(F.col("parent")).alias("parent_conv_id"), "n_convs",
                    F.coalesce("n_children", zero).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, base: Column, shared: Column, most_shared: int) -> DataFrame:
    """Nodes of the trie of rebuilt conversations; see ``rebuild`` for the expressions."""
    turns = materialize(positions(conversations), "turns")
    plan, rebuilt = rebuild(turns, base, shared, most_shared)
    return trie(plan, materialize(prefixes(rebuilt), "all-prefixes"))
