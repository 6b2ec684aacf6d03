import hashlib
import re

import pytest
from helpers import EMPTY, ODD, docs_of, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbflow.llm import fim, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, output, a, b = "plain", text, None, None
    else:
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        prefix, middle, suffix = "".join(units[:cuts[0]]), "".join(units[cuts[0]:cuts[1]]), "".join(units[cuts[1]:])
        a, b = len(prefix), len(middle)
        form = "spm" if h4 % 100 < 20 else "psm"
        output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, a, b, sha(output), sha(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aZ é<PSM>\n1İ🙂")), max_size=60), st.integers(1, 12))
def test_units_do_not_depend_on_blocks(text, block):
    assert fim.unit_ends(text, block).tolist() == [m.end() for m in UNIT.finditer(text)]


@pytest.mark.parametrize("text", ["a" * 3_000_000, "a" * 2_000_000 + "1" + "b" * 700_000, "é" * 600_000 + "ab" * 900_000, "ab, " * 700_000])
def test_very_long_texts(text):
    assert fim.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


MARKED = ["a <P> b", "<S>", "x<M>", "a<P", "<S a", "S>M>P>" * 9, "<" * 40, "<<<P" * 9, "<M" * 30]


def test_rows_equal_the_plain_version(spark):
    texts = ODD + MARKED + ["some words, and < more <P more " * k for k in range(1, 40)]
    docs = docs_of(spark, texts)
    rows = docs.select("doc_id", "text").collect()
    docs.createOrReplaceTempView("fim_docs")
    found = fim.transform(docs, keep=["doc_id"])
    got = found.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256),
                       F.sha2(fim.restore(F.col("fim.output"), F.col("fim.form")), 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain_version(r.doc_id, r.text)) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_fill_in_middle(spark, sf)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_version(r.doc_id, r.text) for r in rows)


def test_clashing_columns_and_empty_tables(spark):
    docs = with_clashes(docs_of(spark, ["one two", None])).withColumns({c: F.lit("y") for c in ("fim", "i", "t", "k0", "n", "form", "output")})
    found = fim.transform(docs)
    assert set(found.columns) == set(docs.columns) and {r.i for r in found.collect()} == {"y"}
    assert fim.transform(spark.createDataFrame([], EMPTY)).count() == 0
