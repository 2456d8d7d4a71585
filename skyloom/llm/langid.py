"""Language ID by rank-order profiles.

The n-grams of a text are the runs of 1 to ``MOST`` characters in its lower-case words (runs of letters and marks, with a
``_`` at both ends); a run that is the ``_`` alone is left out. The profile of a language is the list of its ``PROFILE``
most frequent n-grams over all the texts that are learnt from; that of a document is made alike. The out-of-place distance
sums up, over the n-grams of the document, how far apart the two ranks are; an n-gram that the language does not have
counts ``PROFILE``. The nearest language is predicted.

Texts are arrays of code points, from which the hashes of all n-grams are made at once, in parts of ``PART`` characters
that end between words. N-grams are counted in the tasks that read the texts and summed up over the cluster: all texts count
whole, and what a task holds is bounded. Profiles are broadcast ``AT_ONCE`` languages at a time (16 bytes an n-gram); with
more languages than that, each text's ranked n-grams go on to the next group of profiles in the same task, so every language
counts, however many there are.

Results by row: doc_id, held_out, lang_pred, score (1 minus the share of the greatest distance the document could have;
0 for ``und``). Only rows with text, language and doc_id that are not held out are learnt from; a prediction reads the text
alone. Nulls: a null text, like one without a letter, is ``und``; held_out is null where doc_id is. Ties: of equally
frequent n-grams those of the smaller hash rank first, of equally near languages the smaller name wins. Very long texts
are read whole. Repeated rows come out as often as they come in (and are learnt from as often); with nothing to learn from
every row is ``und``; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import U, table

MOST, PROFILE, FOLDS, UNKNOWN = 4, 400, 3, "und"
#: Languages whose profiles are broadcast together, characters read at once, n-grams gathered and counted ones held by a task.
AT_ONCE, PART, GATHERED, HELD = 1000, 1 << 20, 1 << 21, 1 << 20
_STEP, _EDGE = 0x9E3779B97F4A7C15, ord("_")


@cache
def kinds() -> np.ndarray:
    """For every code point: 2 for a letter, 1 for a mark, else 0."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8)


def hashed(gram: str) -> int:
    """The 64-bit hash of an n-gram, moved to the range of a long."""
    h = 0
    for c in gram:
        h = (h * _STEP + ord(c) + 1) % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def _part(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of some words; ``inside``: which code points are in a word."""
    # one edge before the first word, and after each word
    keep = inside | np.r_[False, inside[:-1]]
    c = np.r_[_EDGE, np.where(inside, codes, _EDGE)[keep]]
    edge = np.r_[True, ~inside[keep]]
    if inside[-1]:
        c, edge = np.r_[c, _EDGE], np.r_[edge, True]
    h, made, crossed = c.astype(U) + U(1), [], np.zeros(len(c), bool)
    made.append(h[~edge])
    for n in range(2, MOST + 1):
        if len(c) < n:
            break
        h = h[:-1] * U(_STEP) + (c[n - 1 :].astype(U) + U(1))
        crossed = crossed[:-1] | edge[n - 2 : len(c) - 1] if n > 2 else crossed[:-1]  # an edge within, not at an end
        made.append(h[~crossed])
    return np.concatenate(made)


def grams(text: str | None):
    """Hashes of the n-grams of a text, with repeats, in parts; nothing if the text has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = kinds()[codes]
    if not (kind == 2).any():
        return
    inside, at = kind > 0, 0
    while at < len(codes):
        end = min(len(codes), at + PART)
        if end < len(codes):
            gap = np.flatnonzero(~inside[end:])
            end = end + int(gap[0]) if len(gap) else len(codes)
        if inside[at:end].any():
            yield _part(codes[at:end], inside[at:end])
        at = end


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in their order, and the sums of their counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n, first)


def counted(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text by their hash, and how often each occurs."""
    found = [np.unique(p, return_counts=True) for p in parts]
    if not found:
        return np.empty(0, U), np.empty(0, np.int64)
    return found[0] if len(found) == 1 else summed(*zip(*found))


def _learn(batches):
    """(lang, gram, n): n-grams of all words of the partition, in parts of bounded size."""
    gathered: dict[str, list[np.ndarray]] = defaultdict(list)
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def settle():
        for lang, parts in gathered.items():
            new = np.unique(np.concatenate(parts), return_counts=True)
            held[lang] = summed(*zip(held[lang], new)) if lang in held else new
        gathered.clear()

    def sent():
        for lang, (h, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            for part in grams(text.as_py()):
                gathered[lang].append(part)
                size += len(part)
                if size > GATHERED:
                    settle()
                    size = 0
                    if sum(len(h) for h, _ in held.values()) > HELD:
                        yield from sent()
    settle()
    yield from sent()


def profiles(docs: DataFrame, most: int = PROFILE) -> DataFrame:
    """(lang, rank from 0, gram): the most frequent n-grams of every language of ``docs`` (lang, text), by their hashes."""
    sums = docs.select("lang", "text").mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("rank", place - 1).where(F.col("rank") < most).select("lang", "rank", "gram")


class Profiles:
    """Profiles of some languages as one sorted table of hashes; :meth:`nearest` compares a document with all of them."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        number = {lang: k for k, lang in enumerate(self.langs)}
        found = sorted((g, number[lang], rank) for lang, rank, g in rows)
        self.hash = np.array([x[0] for x in found], np.int64)
        self.lang = np.array([x[1] for x in found], np.int64)
        self.rank = np.array([x[2] for x in found], np.int64)

    def nearest(self, ranked: np.ndarray, most: int) -> tuple[int, str]:
        """(distance, language) of the nearest profile; ``ranked``: the document's hashes in their order."""
        first, last = np.searchsorted(self.hash, ranked, "left"), np.searchsorted(self.hash, ranked, "right")
        each = last - first
        at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
        saved = most - np.abs(self.rank[at] - np.repeat(np.arange(len(ranked)), each))
        total = len(ranked) * most - np.bincount(self.lang[at], saved, len(self.langs)).astype(np.int64)
        k = int(total.argmin())
        return int(total[k]), self.langs[k]


def ranked(text: str | None, most: int = PROFILE) -> np.ndarray:
    """Hashes of a document's most frequent n-grams, in their order."""
    h, n = counted(grams(text))
    h = h.view(np.int64)
    order = np.lexsort((h, -n))
    return h[order[:most]]


def _nearest(shared, first: bool, most: int):
    """Batches of (doc_id, text or ranked n-grams, distance, language) -> the same with nearer languages."""

    def run(batches):
        own = shared.value
        for b in batches:
            for at in range(0, len(b), 200):
                p = b.slice(at, 200)
                if first:
                    made = [ranked(x.as_py(), most) for x in p.column(1)]
                    best = [(None, None)] * len(p)
                else:
                    made = [np.frombuffer(x.as_py(), np.int64) for x in p.column(1)]
                    best = list(zip(p.column(2).to_pylist(), p.column(3).to_pylist()))
                for k, r in enumerate(made):
                    if len(r) and own.langs:
                        found = own.nearest(r, most)
                        best[k] = found if best[k][0] is None or found < best[k] else best[k]
                yield pa.RecordBatch.from_arrays(
                    [p.column(0).cast(pa.int64()), pa.array([r.tobytes() for r in made], pa.binary()), pa.array([d for d, _ in best], pa.int64()), pa.array([g for _, g in best], pa.string())],
                    names=["doc_id", "ranked", "distance", "lang_pred"],
                )

    return run


def identify(docs: DataFrame, learnt: DataFrame, most: int = PROFILE, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text) by the profiles of ``learnt`` (lang, text)."""
    spark = docs.sparkSession
    found = table(profiles(learnt, most), "langid-profiles")
    names = found.select("lang").distinct()
    groups = max(1, -(-names.count() // at_once))
    by_group = F.pmod(F.xxhash64("lang"), F.lit(groups))
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for k in range(groups):
        rows = found.where(by_group == k).select("lang", "rank", "gram").collect()  # ``at_once`` languages of ``most`` rows
        shared = spark.sparkContext.broadcast(Profiles([tuple(r) for r in rows]))
        out = out.mapInArrow(_nearest(shared, k == 0, most), "doc_id long, ranked binary, distance long, lang_pred string")
    furthest = (F.octet_length("ranked") / 8) * most
    score = F.when(F.col("lang_pred").isNull(), 0.0).otherwise(1 - F.col("distance") / furthest)
    return out.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def language_id(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang); see the module's text."""
    held = F.crc32(F.col("doc_id").cast("string")) % folds == 1
    learnt = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    return identify(docs, learnt).select("doc_id", held.alias("held_out"), "lang_pred", "score")
