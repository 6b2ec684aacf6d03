"""Global order statistics without single-partition windows.

An un-partitioned ``Window`` pulls every row into one task. The helpers here
instead

1. count the rows and draw a sample of their sort keys (``PER_BUCKET`` keys a bucket,
   whatever the number of rows); its quantiles are cut keys, of the full sort key, so a
   hot value is split by the tie-break columns,
2. number each row's bucket by a binary search among the cut keys, a JVM expression
   over one constant array,
3. total the buckets by partial aggregation (one row per bucket),
4. finish with a window partitioned by bucket, the only exchange of the rows, and
5. join the offsets of the earlier buckets (one broadcast row per bucket).

The input is counted, then read for the sample, the totals and the window;
``freeze=True`` writes it once before the count (for inputs that are dear to compute). It
must be deterministic: a column whose values change when it is read again needs
``freeze``. Inputs of at most ``SMALL`` rows need no buckets: one task orders them. Callers whose input is known to be small and bounded (≤ a few
hundred distinct values, e.g. 73 tenure values) pass ``bounded=True`` and get a plain
window without a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.columns import attach
from ebbflow.session import materialize

SMALL = 250_000
PER_BUCKET = 25
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Buckets per shuffle partition: they are hashed to partitions, several even out.
BUCKETS_PER_PARTITION = 4
#: Rows whose values a task counts together, and rows that the brackets of quantiles come from.
COUNTED = 100_000
BRACKET_SAMPLE = 200_000


def _order_exprs(order) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, tuple):
            name, asc = o
            c = F.col(name)
            out.append(c.asc_nulls_first() if asc else c.desc_nulls_last())
        elif isinstance(o, str):
            out.append(F.col(o).asc_nulls_first())
        else:
            out.append(o)
    return out


def _fields(order) -> list[tuple[str, bool]]:
    return [o if isinstance(o, tuple) else (o, True) for o in order]


def _cut_keys(df: DataFrame, fields: list[tuple[str, bool]], buckets: int, n: int) -> Column:
    """Constant array of ascending cut keys, fewer than ``buckets``. The sample is evaluated here,
    once, so every later reading of the input meets the same cuts; they travel as JSON, which
    Spark writes and folds into a literal of the keys' own types."""
    names = [f"k{i}" for i in range(len(fields))]
    keys = df.select(*[F.col(c).alias(k) for (c, _), k in zip(fields, names)])
    sample = [r[0] for r in keys.sample(fraction=min(1.0, PER_BUCKET * buckets / n), seed=11).repartition(1)
              .sortWithinPartitions(*_order_exprs(list(zip(names, [asc for _, asc in fields]))))
              .select(F.to_json(F.struct(*names), _JSON)).collect()]
    step = max(1, len(sample) // buckets)
    cuts = list(dict.fromkeys(sample[step::step]))
    return F.from_json(F.lit(f"[{','.join(cuts)}]"), T.ArrayType(keys.schema), _JSON)


def _reaches(fields: list[tuple[str, bool]], cut: Column) -> Column:
    """Whether a row sorts at or after the key ``cut`` (nulls first ascending, last descending)."""
    out = F.lit(True)
    for i, (c, asc) in reversed(list(enumerate(fields))):
        x, k = F.col(c), cut.getField(f"k{i}")
        later = F.coalesce(x > k, x.isNotNull() & k.isNull()) if asc else F.coalesce(x < k, x.isNull() & k.isNotNull())
        out = later | (x.eqNullSafe(k) & out)
    return out


def _bucket(fields: list[tuple[str, bool]], cuts: Column, buckets: int) -> Column:
    """How many of the fewer than ``buckets`` cut keys a row reaches."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])

    def search(reached: Column, step: Column) -> Column:
        more = (reached + step <= F.size(cuts)) & _reaches(fields, F.get(cuts, reached + step - 1))
        return F.when(more, reached + step).otherwise(reached)

    return F.aggregate(steps, F.lit(0), search)


def _shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _plain_sums(df: DataFrame, by: list[str], order, sums: dict[str, Column]) -> DataFrame:
    tmp = {f"_ps_in_{i}": e for i, e in enumerate(sums.values())}
    w = Window.partitionBy(*by) if by else Window
    w = w.orderBy(*_order_exprs(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns(tmp)
    return out.withColumns({n: F.sum(F.col(k)).over(w) for n, k in zip(sums, tmp)}).drop(*tmp)


def prefix_sums(df: DataFrame, order, sums: dict[str, Column], bounded: bool = False,
                partitions: int | None = None, freeze: bool = False) -> DataFrame:
    """Add inclusive running sums ``sums`` (name → expression) in ``order``.

    ``order`` is a list of column names (ascending) or ``(name, ascending)``
    tuples and must be a total order (append a unique id) unless the caller
    wants ROWS-frame semantics among ties.
    """
    return grouped_prefix_sums(df, [], order, sums, bounded, partitions, freeze)


def global_row_number(df: DataFrame, order, name: str = "row_num",
                      bounded: bool = False, freeze: bool = False) -> DataFrame:
    """1-based position in a total ``order`` (a distributed ``row_number``)."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")}, bounded=bounded, freeze=freeze)


def ntile_from_position(pos: Column, n: Column, buckets: int) -> Column:
    """SQL ``NTILE(buckets)`` from a 1-based position and the row count:
    the first ``n % buckets`` tiles hold one extra row."""
    q = F.floor(n / buckets).cast("long")
    rem = (n % buckets).cast("long")
    big = rem * (q + 1)
    return F.when(pos <= big, F.floor((pos - 1) / (q + 1)) + 1).otherwise(
        rem + F.floor((pos - big - 1) / q) + 1).cast("long")


def distinct_value_ranks(df: DataFrame, c: str, bounded: bool = False,
                         descending: bool = False) -> DataFrame:
    """Per distinct non-null value of ``c``: count, rows before it, average rank.

    Returns (c, cnt, before, avg_rank, n). Work: one partial aggregation, written
    once, then prefix sums over the distinct values only.
    """
    counts = (df.where(F.col(c).isNotNull()).groupBy(c)
              .agg(F.count(F.lit(1)).alias("cnt")))
    if not bounded:
        counts = materialize(counts, "values")
    cum = prefix_sums(counts, [(c, not descending)], {"_cum": F.col("cnt")}, bounded=bounded)
    total = counts.agg(F.sum("cnt").alias("n"))
    return (cum.transform(attach, total)
            .withColumn("before", F.col("_cum") - F.col("cnt"))
            .withColumn("avg_rank", F.col("before") + (F.col("cnt") + 1) / 2.0)
            .drop("_cum"))


def pct_rank_avg(df: DataFrame, c: str, name: str, bounded: bool = False) -> DataFrame:
    """Pandas ``rank(pct=True)`` — average rank / non-null count.

    The rank table has one row per distinct value; it is joined back on the
    value (AQE broadcasts it when small and splits a hot value when skewed).
    """
    ranks = distinct_value_ranks(df, c, bounded=bounded).select(
        F.col(c).alias("_pr_v"), (F.col("avg_rank") / F.col("n")).alias(name))
    return (df.join(ranks, df[c] == ranks["_pr_v"], "left").drop("_pr_v"))


def avg_rank_desc_int(df: DataFrame, c: str, name: str, bounded: bool = False) -> DataFrame:
    """Descending average rank truncated to int (``rank(ascending=False)``)."""
    ranks = distinct_value_ranks(df, c, bounded=bounded, descending=True).select(
        F.col(c).alias("_ar_v"), F.floor(F.col("avg_rank")).cast("long").alias(name))
    return df.join(ranks, df[c] == ranks["_ar_v"], "left").drop("_ar_v")


def grouped_prefix_sums(df: DataFrame, by: list[str], order, sums: dict[str, Column], bounded: bool = False,
                        partitions: int | None = None, freeze: bool = False) -> DataFrame:
    """Running sums within each ``by`` group, in ``order``.

    The cut keys cover (by…, order), so one large group is spread over several
    buckets, and its sums in earlier buckets are its offset in a later one (never
    another group's rows, so signs and magnitudes elsewhere do not matter). Only
    groups that a cut key lies in are totalled: offsets have fewer rows than there
    are buckets. No group is ever collected into one task.
    """
    if bounded:
        return _plain_sums(df, by, order, sums)
    if freeze:  # before the count, which would evaluate it a second time
        df = materialize(df, "prefix")
    n = df.count()
    if n <= SMALL:
        return _plain_sums(df, by, order, sums)
    fields = _fields([*by, *order])
    tmp = {f"_ps_in_{i}": e for i, e in enumerate(sums.values())}
    buckets = BUCKETS_PER_PARTITION * (partitions or _shuffle_partitions(df))
    cuts = _cut_keys(df, fields, buckets, n)
    rows = df.withColumns(tmp).withColumn("_bucket", _bucket(fields, cuts, buckets))
    cut_in_group = lambda i: F.coalesce(_same(by, F.get(cuts, i)), F.lit(False))
    # rows of groups without a cut fall into one null key: a row of each task
    split = cut_in_group(F.col("_bucket") - 1) | cut_in_group(F.col("_bucket")) if by else F.lit(True)
    keyed = rows.select(F.when(split, F.struct(*by, "_bucket")).alias("_key"), *tmp)
    totals = (keyed.groupBy("_key").agg(*[F.sum(k).alias(f"_t{k}") for k in tmp])
              .filter(F.col("_key").isNotNull()).select("_key.*", *[f"_t{k}" for k in tmp]))
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumns({f"_o{k}": F.sum(f"_t{k}").over(earlier) for k in tmp} | {"_first": F.min("_bucket").over(earlier)})
               .filter(F.col("_first").isNotNull())
               .select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_of_bucket"), *[f"_o{k}" for k in tmp]))
    inside = (Window.partitionBy(*by, "_bucket").orderBy(*_order_exprs(order))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumns({f"_s{k}": F.sum(k).over(inside) for k in tmp})
    same = F.col("_bucket") == F.col("_of_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = found.join(F.broadcast(offsets), same, "left").withColumns(
        {name: F.coalesce(f"_o{k}", F.lit(0)) + F.col(f"_s{k}") for name, k in zip(sums, tmp)})
    return out.drop(*tmp, *[f"_o{k}" for k in tmp], *[f"_s{k}" for k in tmp], *[f"_by_{c}" for c in by], "_bucket", "_of_bucket")


def _same(by: list[str], cut: Column) -> Column:
    out = cut.isNotNull()
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(cut.getField(f"k{i}"))
    return out


def grouped_quantiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None,
                      reread: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles of many columns in many groups.

    Returns (by…, column, n, q): ``q`` is an array aligned with ``qs``, of doubles, over
    the non-null values of a column in a group, null where there are none at all.
    The rows become one histogram, written once; running counts over it give every value
    the ranks it covers, so each value tells by itself which wanted ranks it holds: neither
    a value map nor a group is kept in a task. (A histogram of at most ``SMALL`` rows goes
    through ``percentile``, whose map it bounds.) ``reread`` (without ``by``): the input is
    cheap to read again, so the histogram is a ``coarse_histogram``.
    """
    by = by or []
    h = coarse_histogram(df, cols, qs) if reread and not by else histogram(df, cols, by)
    return histogram_quantiles(h, [*by, "column"], qs)


def counted_values(df: DataFrame, cols: list[str], by: list[str] | None = None,
                   brackets: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """(by…, column, v, cnt): how often each non-null value occurs, as a double. Tasks count each
    column's values over many rows at a time, so a row is not repeated per column and a column
    of few values hands on few rows. With ``brackets`` (column → ascending starts, ends) the values
    between two brackets are counted together, under one number that lies there."""
    by = by or []
    schema = T.StructType([*[df.select(c).schema[0] for c in by], T.StructField("_column", T.IntegerType()),
                           T.StructField("v", T.DoubleType()), T.StructField("cnt", T.LongType())])
    edges = [tuple(np.array(e) for e in brackets[c]) if brackets and c in brackets else None for c in cols]

    def between(v: pa.ChunkedArray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        # a value outside all brackets becomes the least double after the bracket before it (or minus infinity)
        x = v.to_numpy()
        at = np.searchsorted(starts, x, "right") - 1
        gap = np.concatenate(([-np.inf], np.nextafter(ends, np.inf)))
        outside = (at < 0) | (x > ends[at])
        return pa.array(np.where(outside, gap[at + 1], x), mask=v.is_null().to_numpy(), from_pandas=False)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= COUNTED:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            keys = [table.column(i) for i in range(len(by))]
            names = [f"k{i}" for i in range(len(by))]
            for j, edge in enumerate(edges):
                v = table.column(len(by) + j)
                if edge:
                    v = between(v, *edge)
                found = pa.table([*keys, v], names=[*names, "v"]).group_by([*names, "v"], use_threads=False).aggregate([([], "count_all")])
                for b in found.filter(found["v"].is_valid()).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(np.full(b.num_rows, j, np.int32)), b.column("v"),
                                                      b.column("count_all")], schema=pa.schema(
                        [*[pa.field(f.name, b.column(n).type) for n, f in zip(names, schema)], ("_column", pa.int32()), ("v", pa.float64()), ("cnt", pa.int64())]))

    given = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    counts = given.mapInArrow(count, schema).groupBy(*by, "_column", "v").agg(F.sum("cnt").alias("cnt"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_column") + 1)
    return counts.select(*by, name.alias("column"), "v", "cnt")


def histogram(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by…, column, v, cnt): how often each non-null value occurs, written once."""
    by = by or []
    long = (df.select(*by, *[F.col(c).cast("double").alias(f"_v_{c}") for c in cols])
            .unpivot(by, [f"_v_{c}" for c in cols], "column", "v").where(F.col("v").isNotNull()))
    counts = long.groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("cnt"))
    return materialize(counts.withColumn("column", F.substring("column", 4, 1_000_000)), "histogram")


def coarse_histogram(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None) -> DataFrame:
    """A ``histogram`` that keeps each value near the quantiles ``qs`` of its column (over all groups)
    and counts the others between them together, so quantiles from it are exact and its size is a
    small share of the rows. Where a sample says the quantiles may be, values are kept; a column with
    a quantile elsewhere is counted again, value by value. Reads ``df`` three times."""
    by = by or []
    n = df.count()
    if n <= SMALL:
        return histogram(df, cols, by)
    brackets = _brackets(df, cols, qs, n)
    h = materialize(counted_values(df, cols, by, brackets), "histogram")
    missed = _outside_brackets(h, cols, qs, brackets)
    if not missed:
        return h
    return materialize(h.where(~F.col("column").isin(missed)).unionByName(counted_values(df, missed, by)), "histogram")


def _brackets(df: DataFrame, cols: list[str], qs: list[float], n: int) -> dict[str, tuple[list[float], list[float]]]:
    """For each column with sampled values: starts and ends of intervals that hold its quantiles, six
    standard errors wide to either side, joined where they meet."""
    fraction = min(1.0, BRACKET_SAMPLE / n)
    names = [f"v{i}" for i in range(len(cols))]
    long = (df.select(*[F.col(c).cast("double").alias(v) for c, v in zip(cols, names)]).sample(fraction=fraction, seed=11)
            .unpivot([], names, "column", "v").where(F.col("v").isNotNull()))
    found = {}
    for name, m, *q in long.groupBy("column").agg(
            F.count(F.lit(1)), *[F.percentile("v", F.array(*[F.lit(float(p)) for p in _around(qs)]))]).collect():
        found[name] = (m, q[0])
    out = {}
    for c, name in zip(cols, names):
        if name not in found or found[name][0] < BRACKET_SAMPLE // 2:
            continue  # too few to say where the quantiles are: every value counts by itself
        q = found[name][1]
        pairs = sorted(zip(q[::2], q[1::2]))
        starts, ends = [], []
        for lo, hi in pairs:
            if math.isnan(lo) or math.isnan(hi):
                starts = []
                break
            if ends and lo <= ends[-1]:
                ends[-1] = max(ends[-1], hi)
            else:
                starts.append(lo)
                ends.append(hi)
        if starts:
            out[c] = (starts, ends)
    return out


def _around(qs: list[float]) -> list[float]:
    """Levels on either side of each of ``qs``, six standard errors of a sample away."""
    far = 6 * math.sqrt(0.25 / BRACKET_SAMPLE)
    return [level for q in qs for level in (max(0.0, q - far), min(1.0, q + far))]


def _outside_brackets(h: DataFrame, cols: list[str], qs: list[float], brackets: dict[str, tuple[list[float], list[float]]]) -> list[str]:
    """The columns of which a wanted rank falls between brackets."""
    if not brackets:
        return []
    edges = h.sparkSession.createDataFrame([(c, *e) for c, e in brackets.items()], "column string, starts array<double>, ends array<double>")
    passed = F.size(F.filter("starts", lambda e: e <= F.col("v"))) + F.size(F.filter("ends", lambda e: e < F.col("v")))
    totals: dict[str, dict[int, int]] = {}
    for c, at, cnt in h.join(F.broadcast(edges), "column").groupBy("column", passed.alias("_at")).agg(F.sum("cnt")).collect():
        totals.setdefault(c, {})[at] = cnt
    missed = []
    for c, counts in totals.items():
        n, held, before = sum(counts.values()), [], 0
        for at in sorted(counts):  # odd: inside a bracket
            if at % 2:
                held.append((before, before + counts[at]))
            before += counts[at]
        ranks = [edge(p) for q in qs for p in [(n - 1) * float(q)] for edge in (math.floor, math.ceil)]
        if not all(any(a <= r < b for a, b in held) for r in ranks):
            missed.append(c)
    return missed


def histogram_quantiles(h: DataFrame, by: list[str], qs: list[float], v: str = "v", cnt: str = "cnt") -> DataFrame:
    """(by…, n, q) from a histogram (by…, v, cnt) that is cheap to read again."""
    if h.count() <= SMALL:  # so few values may stand in a task's value map
        found = h.groupBy(*by).agg(F.sum(cnt).alias("n"), F.percentile(v, F.array(*[F.lit(float(q)) for q in qs]), F.col(cnt)).alias("q"))
        return found.filter("n > 0")
    held = _with_totals(h, by, v, cnt)
    place = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    holds = lambda rank: F.when((F.col("_upto") - F.col(cnt) <= rank) & (rank < F.col("_upto")), F.col(v).cast("double"))
    found = held.groupBy(*by, "_n").agg(*[F.max(holds(edge(p))).alias(f"_{side}{i}") for i, p in enumerate(place)
                                          for side, edge in (("lo", F.floor), ("hi", F.ceil))])
    parts = []
    for i, p in enumerate(place):
        lo, hi, at = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.floor(p)
        parts.append(F.when((F.ceil(p) == at) | (lo == hi), lo).otherwise((F.ceil(p) - p) * lo + (p - at) * hi))
    return found.select(*by, F.col("_n").alias("n"), F.array(*parts).alias("q"))


def _with_totals(h: DataFrame, by: list[str], v: str, cnt: str) -> DataFrame:
    """``h`` with running counts ``_upto`` and group totals ``_n``."""
    upto = grouped_prefix_sums(h, by, [(v, True)], {"_upto": F.col(cnt)})
    totals = h.groupBy(*by).agg(F.sum(cnt).alias("_n"))
    if not by:
        return upto.transform(attach, totals)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return upto.join(totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_n"), same).drop(*[f"_by_{c}" for c in by])


def quantile_row(df: DataFrame, wanted: dict[str, list[float]], reread: bool = False) -> DataFrame:
    """One row with an array of quantiles for each column of ``wanted``; null where it has no value."""
    levels = sorted({q for qs in wanted.values() for q in qs})
    long = grouped_quantiles(df, list(wanted), levels, reread=reread)
    at = lambda c: F.max(F.when(F.col("column") == c, F.col("q")))
    wide = long.agg(*[at(c).alias(f"_{i}") for i, c in enumerate(wanted)])
    return wide.select(*[F.when(F.col(f"_{i}").isNotNull(), F.array(*[F.col(f"_{i}")[levels.index(q)] for q in qs])).alias(c)
                         for i, (c, qs) in enumerate(wanted.items())])


def exact_quantiles(df: DataFrame, c: str, qs: list[float], bounded: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles of one column: (level, quantile) per requested level."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    found = histogram_quantiles(counts if bounded else materialize(counts, "histogram"), [], qs)
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("level"), F.col("q")[i].alias("quantile")) for i, q in enumerate(qs)])
    return found.select(F.inline(pairs))


def first_fraction_flag(df: DataFrame, order: list[str], frac: float, name: str,
                        first, rest) -> DataFrame:
    """Label the first ⌊frac·n⌋ rows in ascending (order…) as ``first``, the
    rest as ``rest`` — without moving the wide rows.

    Only the key columns are read for it: cut keys from a sample deal them into buckets,
    the buckets are counted, and the keys of the one bucket that the cut lies in are put in
    order. The key at the cut becomes a one-row aggregate, and every row is labelled by a
    lexicographic struct comparison with it. ``order`` must be a total order (end with a
    unique key)."""
    row = F.struct(*[F.col(c) for c in order])
    return (df.transform(attach, _key_at(df.select(*order), order, frac))
            .withColumn(name, F.when(row <= F.col("_cut"), F.lit(first)).otherwise(F.lit(rest)))
            .drop("_cut"))


def _key_at(keys: DataFrame, order: list[str], frac: float) -> DataFrame:
    """One row: the key ``_cut`` at position ⌊frac·n⌋, null before the first."""
    n = keys.count()
    k, row = math.floor(n * frac), F.struct(*[F.col(c) for c in order])
    fields, rest = _fields(order), k
    if n > SMALL:
        buckets = 2 * math.ceil(n / SMALL)
        cuts = _cut_keys(keys, fields, buckets, n)
        for bucket, cnt in sorted(map(tuple, keys.groupBy(_bucket(fields, cuts, buckets)).count().collect())):
            if rest <= cnt:
                break
            rest -= cnt
        if bucket:
            keys = keys.where(_reaches(fields, F.get(cuts, F.lit(bucket - 1))))
        keys = keys.where((F.size(cuts) <= bucket) | ~_reaches(fields, F.get(cuts, F.lit(bucket))))
    counts = keys.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))  # rows that share a key count as one
    upto = _plain_sums(counts, [], fields, {"_upto": F.col("_n")})
    return upto.agg(F.max(F.when((F.col("_upto") - F.col("_n") < rest) & (F.col("_upto") >= rest), row)).alias("_cut"))
