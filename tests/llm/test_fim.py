"""Fill-in-middle against a version over code points, on odd texts and with every cut."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm.fim import Exceptions, fill_in_middle, restored, transformed

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def want(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    x = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


ODD = ["", None, " ", " \n\t", "a", "é", "  é 𝒜𝒷 ü\x0b", "x<P>y", "x<Py <S z <", "<", "<P", "S> <M", "日本 語 😀 a b c d", "    a", "word " * 50_000, "ü" * 100_000 + " " + "é a " * 20_000, "\x00 \x1f b"]


def test_fill_in_middle(spark):
    rows = [(i, t, "x", 1) for i in [*range(40), 2**60, -5, None] for t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n long").repartition(3)
    out = fill_in_middle(df)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("again")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *want(i, t), t or "") for i, t, *_ in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_index(text, h):
    data = np.frombuffer(text.encode(), np.uint8)
    index = Exceptions(data)
    assert len(index.at_byte) == sum(ord(c) > 127 for c in text)
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert [index.byte_of(k) for k in range(len(text) + 1)] == at
    assert [index.char_of(b) for b in at] == list(range(len(text) + 1))
    n, form, pre, mid, a, b, out = transformed(text.encode(), [h[0], h[1], 0, h[3]])
    if form != "plain":
        assert (len(text.encode()[:a].decode()), len(text.encode()[a : a + b].decode())) == (pre, mid)
        assert n == len(UNIT.findall(text))


def test_rates(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    n = {r.form: r["count"] for r in fill_in_middle(df, rate=100, spm_rate=25).groupBy("form").count().collect()}
    assert "plain" not in n and 0.2 < n["spm"] / 3000 < 0.3
    assert fill_in_middle(df, rate=0).where("form <> 'plain'").count() == 0


@pytest.mark.parametrize("text", ["plain", "ünï"])
def test_same_row_same_result(spark, text):
    df = spark.createDataFrame([(1, text)] * 5, "doc_id long, text string")
    assert fill_in_middle(df).distinct().count() == 1
