"""Fill-in-middle transformation by repeated-capture matching (operator 11).

A text is a sequence of units, ``[A-Za-z]+|[^A-Za-z]`` from left to right. One
``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of its
group, so ``ends(1)`` gives the number of units and the code-point offset of any
cut at once. Two cuts, drawn from the SHA-256 of ``salt:doc_id``, part the text
into prefix, middle and suffix, written as

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is.

The library keeps some 90 bytes a unit and gives up beyond about 7 million code
points, so a text longer than ``BLOCK`` code points is matched in blocks that end
where a unit ends; the units are the same, and memory stays that of a block.

Results, in a struct column (replacing one of that name): ``n``, ``form``,
``prefix_chars`` and ``middle_chars`` (code points; null if plain), ``output``.
Null text is empty; empty texts and those that hold a marker are plain, so
``restore`` is exact: no marker can arise where a piece and a marker meet. A null
id counts as an empty one. Repeated rows give equal results; other columns pass
unread. There is no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import row_chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 500_000
_UNITS = regex.compile(r"([A-Za-z]+|[^A-Za-z])*")
_NOT_LETTER = regex.compile(r"[^A-Za-z]")
_TYPE = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def unit_ends(text: str, block: int = BLOCK) -> np.ndarray:
    """Offset of the end of every unit, ascending."""
    if len(text) <= block:
        return np.array(_UNITS.fullmatch(text).ends(1), dtype=np.int64)
    parts, at = [], 0
    while at < len(text):
        # past the first character from the block's last place on that is no letter: a unit ends there
        stop = _NOT_LETTER.search(text, at + block - 1)
        end = stop.end() if stop else len(text)
        parts.append(np.array(_UNITS.fullmatch(text, at, end).ends(1), dtype=np.int64))
        at = end
    return np.concatenate(parts)


def draws(doc_id: int | None, salt: str = "1") -> list[int]:
    """The first four 8-digit groups of the hexadecimal SHA-256 of ``salt:doc_id``."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def fill_in_middle(text: str, h: list[int], fim_percent: int = 90, spm_percent: int = 20) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a = int(ends[first - 1]) if first else 0
    b = int(ends[second - 1]) if second else 0
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, keep: list[str] | None = None, out: str = "fim", salt: str = "1",
              fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the struct column ``out``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [f"k{i}" for i in range(len(keep))]
    fields = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 200):
            rows = [fill_in_middle(t or "", draws(i, salt), fim_percent, spm_percent)
                    for i, t in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist())]
            made = pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], pa.string() if f in ("form", "output") else pa.int64()) for k, f in enumerate(fields)],
                names=fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, "fim"])

    read = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)],
                       F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
    schema = ", ".join([*(f"{k} {types[c]}" for c, k in zip(keep, names)), f"fim {_TYPE}"])
    return read.mapInArrow(scan, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, names)], F.col("fim").alias(out))


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
