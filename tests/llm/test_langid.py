"""Language ID against a plain version, and its accuracy on documents that were held out."""

import zlib
from collections import Counter

import pytest
import regex

from skyloom.llm import langid
from skyloom.llm.langid import MOST, PROFILE, counted, hashed, identify, language_id, profiles

SCHEMA = "doc_id long, text string, lang string, score double, held_out string"


def words(t):
    return regex.findall(r"[\p{L}\p{M}]+", (t or "").lower())


def grams(word):
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, MOST + 1) for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


def ranked(texts):
    n = Counter(hashed(g) for t in texts for w in words(t) for g in grams(w))
    return sorted(n, key=lambda g: (-n[g], g))[:PROFILE], n


@pytest.mark.parametrize("part", [1 << 20, 7])
@pytest.mark.parametrize("text", ["ab", "a", " a b", "Ab, cd-efghi! j.", "x" * 30 + " yz 12 é日本 मराठी ", "İI ſ a\u0301", "_a_ b__c", "1 2", "", None, "word " * 500])
def test_grams(monkeypatch, text, part):
    monkeypatch.setattr(langid, "PART", part)
    h, n = counted(langid.grams(text))
    assert dict(zip(h.view("int64").tolist(), n.tolist())) == ranked([text])[1]


def test_profiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    got: dict = {}
    for r in profiles(docs).collect():
        got.setdefault(r.lang, {})[r.rank] = r.gram
    rows = docs.collect()
    assert set(got) == {r.lang for r in rows}
    for lang, p in got.items():
        assert [p[k] for k in range(len(p))] == ranked([r.text for r in rows if r.lang == lang])[0]


def test_profiles_in_small_parts(spark, monkeypatch):
    """What a task gathers and holds does not change the sums."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text").toPandas()
    import pyarrow as pa

    def sums():
        out = Counter()
        for b in langid._learn([pa.RecordBatch.from_pandas(docs[k : k + 50], preserve_index=False) for k in range(0, len(docs), 50)]):
            for lang, g, n in zip(*(c.to_pylist() for c in b.columns)):
                out[lang, g] += n
        return out

    whole = sums()
    monkeypatch.setattr(langid, "GATHERED", 3000)
    monkeypatch.setattr(langid, "HELD", 500)
    assert sums() == whole


@pytest.mark.parametrize("at_once", [1000, 1])
def test_distances(spark, at_once):
    """Every distance by hand; the languages in one group of profiles, or one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(900, None, "en"), (901, "", "de"), (902, "12 34 !?", "fr"), (903, "le " * 50_000, "fr"), (904, "Ünd", None), (None, "the of and", "en"), (905, "́", "en")], "doc_id long, text string, lang string")
    learnt, asked = docs.where("lang is not null").select("lang", "text"), docs.unionByName(odd).unionByName(odd)
    own: dict = {}
    for r in profiles(learnt).collect():
        own.setdefault(r.lang, {})[r.gram] = r.rank
    want = []
    for r in asked.collect():
        w = words(r.text)
        if not any(regex.search(r"\p{L}", x) for x in w):
            want.append((r.doc_id, "und", 0.0))
            continue
        mine, _ = ranked([r.text])
        far = {g: sum(abs(p[x] - k) if x in p else PROFILE for k, x in enumerate(mine)) for g, p in own.items()}
        best = min(far, key=lambda g: (far[g], g))
        want.append((r.doc_id, best, round(1 - far[best] / (PROFILE * len(mine)), 9)))
    got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in identify(asked, learnt, at_once=at_once).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_learns_from_the_rest_only(spark):
    """What held-out rows and rows without a language or an id say does not count."""
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)
    free = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(free, "abc abd abe", "xx", 1.0, "y"), (held, "zzz zzy", "yy", None, None), (free + 1000, None, "zz", None, None), (None, "qqq", "qq", 0.0, ""), (free, "ooo", None, 0.0, "")]
    got = language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.lang_pred for r in got if r.doc_id != free + 1000} == {"xx"} and {r.held_out for r in got if r.doc_id is None} == {None}
    none = language_id(spark.createDataFrame(rows[1:3], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2
    assert language_id(spark.createDataFrame([], SCHEMA)).count() == 0
