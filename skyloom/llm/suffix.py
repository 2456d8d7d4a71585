"""Suffix dedup on bytes: every byte covered by a ``length``-byte string that also starts earlier is removed.

"Earlier" is a smaller doc_id, or the same document and a smaller start; strings are judged on the input. The suffixes
that are sorted are the anchored ones: in every ``length`` bytes, the leftmost smallest hash of a ``GRAM``-byte string
marks an anchor. It depends on these bytes only, so equal strings have equal anchors at equal places, and all suffixes
in which one anchor is the smallest form one run (35 suffixes on average). Two jobs of two stages each:

1. Sampled splitters (quantiles of the leading tokens of at most ``SAMPLED`` anchored suffixes) range-partition the
   runs by the anchor's leading four bytes, then by the hash of its gram, then by the hash of all bytes of the run.
   Each bucket is sorted by multikey quicksort. Equal runs repeat as a whole: all but the first are removed. Anchors with
   several different runs, whose neighbours in sorted order differ somewhere, are laid open.
2. Laid-open runs are cut out of their texts and every suffix in them is known by the hash of its ``length`` bytes. A
   bucket of the ranges compares the suffixes of its own anchors. What stands first and last in a bucket may go on in the
   neighbouring one, and an anchor with over ``HOT`` different runs would be a hot group: these suffixes are compared
   across the boundaries of buckets, dealt by their own hash. Suffixes that are not the first of their content are
   repeats, merged to intervals of bytes at once.

Texts that hold intervals lose these bytes. Every stage reduces its equal keys before the shuffle, so a passage of a
third of all documents reaches a bucket once per map batch. A bucket holds about 1 / (number of shuffle partitions) of
the runs and is sorted in memory; texts only stream by. Intervals of a bucket of documents are held while they do.

Contents are told apart by two 64-bit hashes (of the gram with its four leading bytes, and of all bytes).

Nulls: a null text is empty. A null doc_id counts as larger than all others. Rows with the same doc_id and text count
as one document and get the same result; one doc_id with different texts counts as several documents that start
equally early, of which none removes the other's bytes. So rows are known by doc_id and a hash of the text, and only
doc_id decides what is earlier; ties between equal rows need no order. Empty texts, and texts under ``length`` bytes,
lose nothing; an empty table gives an empty result; very long texts are hashed in blocks of ``BLOCK`` bytes that
overlap by ``length - 1``. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import U, mix, partitions, release, table

LENGTH, GRAM = 100, 32
#: Bytes hashed at once; at most 2**19, as positions take 20 bits of a packed key.
BLOCK = 1 << 18
#: Rows sorted at once before a shuffle, sampled documents and suffixes, different runs of an anchor that is hot.
ROWS, SAMPLED_DOCS, SAMPLED, HOT = 1_000_000, 2000, 200_000, 4096
LAST = (1 << 63) - 1

_B = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U), np.ones(1, U)

RUN = np.dtype([("key", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("v", "<i8"), ("first", "<u4"), ("off", "u1"), ("more", "u1")])
OPEN = np.dtype([("doc", "<i8"), ("v", "<i8"), ("first", "<u4"), ("off", "u1"), ("more", "u1"), ("hot", "u1"), ("key", "<u8"), ("bucket", "<u4")])
HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("v", "<i8"), ("first", "<u4"), ("off", "u1"), ("more", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("v", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
SPANS, WORK, TEXT = 0, 1, 2
PARCEL = "bucket int, kind int, data binary"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for x in (_B, pow(_B, -1, 1 << 64)):
            p = np.ones(size, U)
            p[1:] = U(x)
            out.append(np.multiply.accumulate(p))
        _powers = tuple(out)
    return _powers


class Rolling:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(U))

    def every(self, n: int) -> np.ndarray:
        m = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:m]) * self.down[:m] + U(n))


def made(kind: np.dtype, **columns) -> np.ndarray:
    out = np.empty(len(next(iter(columns.values()))), kind)
    for k, x in columns.items():
        out[k] = x
    return out


def parcels(rows) -> pa.RecordBatch:
    b, k, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=["bucket", "kind", "data"])


def dealt(bucket: np.ndarray, rows: np.ndarray, kind: int):
    """One parcel per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else []
    return [(int(bucket[lo]), kind, rows[lo:hi].tobytes()) for lo, hi in zip(cuts, [*cuts[1:], len(rows)])]


def home(doc: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document; the same as :func:`home_column`."""
    return np.mod(doc ^ v, n)


def home_column(n: int):
    return F.pmod(F.col("doc").bitwiseXOR(F.col("v")), F.lit(n)).cast("int")


def merged(doc: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Overlapping or touching intervals of each document become one."""
    order = np.lexsort([lo, v, doc])
    doc, v, lo, hi = doc[order], v[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])
    base = np.cumsum(other) << 33
    reach = np.maximum.accumulate(hi + base) - base
    new = other.copy()
    new[1:] |= lo[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return made(SPAN, doc=doc[at], v=v[at], lo=lo[at], hi=reach[np.r_[at[1:] - 1, len(doc) - 1]] if len(at) else [])


def spans_of(doc, v, lo, hi, n: int):
    """Parcels of merged intervals for the documents' buckets."""
    rows = merged(doc, v, lo, hi)
    return dealt(home(rows["doc"], rows["v"], n), rows, SPANS)


def multikey_order(keys: list[np.ndarray], least: int = 4096) -> np.ndarray:
    """Order of rows by multikey quicksort: three-way partition by one key; equal rows go on with the next key."""
    out, done = np.empty(len(keys[0]), np.int64), 0
    stack = [(np.arange(len(keys[0])), 0)]
    while stack:
        rows, depth = stack.pop()
        if depth == len(keys) or len(rows) <= 1 or len(rows) <= least:
            rows = rows[np.lexsort([k[rows] for k in keys[depth:][::-1]])] if depth < len(keys) and len(rows) > 1 else rows
            out[done : done + len(rows)] = rows
            done += len(rows)
            continue
        k = keys[depth][rows]
        some = k[:: max(1, len(k) // 255)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        # the last pushed comes first: smaller, then equal, then larger
        stack += [(x, d) for x, d in ((rows[k > pivot], depth), (rows[k == pivot], depth + 1), (rows[k < pivot], depth)) if len(x)]
    return out


def told_apart(keys: list[np.ndarray], doc: np.ndarray, v: np.ndarray, pos: np.ndarray, least: int = 65_536):
    """Rows in order of their keys -> (order, is it a head, is it a repeat).

    Of equal keys, those of a larger document than the smallest are repeats, and those at a larger place than the first
    of their own text. The first of each text of the smallest doc is a head. A row that is there twice is neither.
    """
    order = multikey_order(keys, least)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1) if len(order) else order
    head, repeat = np.ones(len(order), bool), np.zeros(len(order), bool)
    if len(many):
        g, rows = group[many], order[many]
        fine = np.lexsort([pos[rows], v[rows], doc[rows], g])
        rows = rows[fine]
        order[many] = rows
        d, t, p = doc[rows], v[rows], pos[rows]
        start = np.r_[True, g[1:] != g[:-1]]
        least_doc = d[np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))]
        own = start.copy()
        own[1:] |= (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        from_ = p[np.maximum.accumulate(np.where(own, np.arange(len(g)), 0))]
        head[many] = own & (d == least_doc)
        repeat[many] = (d > least_doc) | (p > from_)
    return order, head, repeat


def runs_of(pieces: list[tuple[bytes, int, int, int]], length: int, gram: int) -> np.ndarray:
    """The runs of some pieces of texts (bytes, place in the text, doc, v), each of ``length`` bytes or more."""
    data = np.frombuffer(b"".join(p[0] for p in pieces), np.uint8)
    sizes = np.array([len(p[0]) for p in pieces])
    ends = np.cumsum(sizes)
    roll = Rolling(data)
    g = roll.every(gram)
    n = len(data) - length + 1
    width = length - gram + 1
    low, size = (g & ~U((1 << 20) - 1)) | np.arange(len(g), dtype=U), 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    at = (low & U((1 << 20) - 1)).astype(np.int64)
    valid = np.arange(n) + length <= np.repeat(ends, sizes)[:n]
    change = at[1:] != at[:-1]
    begin, end = valid.copy(), valid.copy()
    begin[1:] &= change | ~valid[:-1]
    end[:-1] &= change | ~valid[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    anchor = at[first]
    lead = np.zeros(len(first), U)
    for i in range(4):
        lead = lead << U(8) | data[anchor + i].astype(U)
    off = anchor - first
    run = mix(roll.of(first, last + length) ^ (off.astype(U) * U(0xD1B54A32D192ED03)))
    p = np.searchsorted(ends, first, "right")
    place = np.array([x[1] for x in pieces]) - (ends - sizes)
    doc, v = (np.array([x[i] for x in pieces], np.int64)[p] for i in (2, 3))
    return made(RUN, key=lead << U(32) | g[anchor] >> U(32), run=run, doc=doc, v=v, first=first + place[p], off=off, more=last - first)


def _chunks(batches, length: int):
    """Columns doc, v, text (bytes) -> pieces of about ``BLOCK`` bytes in all."""
    part, size = [], 0
    for b in batches:
        for doc, v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = t.as_py() or b""
            for lo in range(0, len(raw) - length + 1, BLOCK):
                part.append((raw[lo : lo + BLOCK + length - 1], lo, doc, v))
                size += len(part[-1][0])
                if size >= BLOCK:
                    yield part
                    part, size = [], 0
    if part:
        yield part


def _sample(length: int, gram: int):
    def run(batches):
        for part in _chunks(batches, length):
            rows = runs_of(part, length, gram)
            rows = rows[rows["run"] & U(7) == 0]
            yield pa.RecordBatch.from_arrays([pa.array(rows[k].astype(U).view(np.int64)) for k in ("key", "run")], names=["key", "run"])

    return run


def cuts_of(key: np.ndarray, run: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the ranges of rows in order begin and end."""
    lo, hi = np.searchsorted(key, splitters[0], "left"), np.searchsorted(key, splitters[0], "right")
    inside = [a + np.searchsorted(run[a:b], r, "right") if b > a else a for a, b, r in zip(lo, hi, splitters[1])]
    return np.array([0, *inside, len(key)], np.int64)


def _runs(length: int, gram: int, splitters, n: int):
    def sent(held):
        rows = np.concatenate(held)
        key, run, doc, v, first = (rows[k].copy() for k in ("key", "run", "doc", "v", "first"))
        order, head, repeat = told_apart([key, run], doc, v, first)
        again = rows[order[repeat]]
        if len(again):
            yield from spans_of(again["doc"], again["v"], again["first"], again["first"].astype(np.int64) + again["more"] + length, n)
        rows = rows[order[head]]
        cuts = cuts_of(rows["key"].copy(), rows["run"].copy(), splitters)
        yield from ((i, WORK, rows[lo:hi].tobytes()) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo)

    def run(batches):
        held, total = [], 0
        for part in _chunks(batches, length):
            held.append(runs_of(part, length, gram))
            total += len(held[-1])
            if total >= ROWS:
                yield parcels(sent(held))
                held, total = [], 0
        if total:
            yield parcels(sent(held))

    return run


def _compare(length: int, n: int, most: int):
    """A range of runs -> intervals of repeated runs, and the runs to lay open."""

    def run(batches):
        work, bucket = [], 0
        for b in batches:
            passed = [x for x in zip(*(c.to_pylist() for c in b.columns)) if x[1] == SPANS]
            for k, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if kind == WORK:
                    bucket = k
                    work.append(np.frombuffer(data.as_py(), RUN))
            if passed:
                yield parcels(passed)
        if not work:
            return
        rows = np.concatenate(work)
        key, hashes, doc, v, first = (rows[k].copy() for k in ("key", "run", "doc", "v", "first"))
        order, head, repeat = told_apart([key, hashes], doc, v, first, 4096)
        again, rows = rows[order[repeat]], rows[order[head]]
        out = spans_of(again["doc"], again["v"], again["first"], again["first"].astype(np.int64) + again["more"] + length, n) if len(again) else []
        key, hashes = rows["key"], rows["run"]
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        different = np.bincount(group, np.r_[1, new[1:] | (hashes[1:] != hashes[:-1])])[group]
        edge = (group == 0) | (group == group[-1])
        opened = (different > 1) | edge
        r = rows[opened]
        o = made(OPEN, **{k: r[k] for k in ("doc", "v", "first", "off", "more", "key")}, hot=(edge | (different > most))[opened], bucket=np.full(len(r), bucket))
        out += dealt(home(o["doc"], o["v"], n), o, WORK)
        if out:
            yield parcels(out)

    return run


def lookup(rows: np.ndarray) -> tuple[np.ndarray, dict]:
    """Rows in order of their documents, and where those of each document stand."""
    rows = rows[np.lexsort([rows["v"], rows["doc"]])]
    new = np.flatnonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["v"][1:] != rows["v"][:-1])]) if len(rows) else np.array([], int)
    return rows, {x: (lo, hi) for x, lo, hi in zip(zip(rows["doc"][new].tolist(), rows["v"][new].tolist()), new.tolist(), [*new[1:].tolist(), len(rows)])}


def _laid_open(length: int, n: int):
    """Parcels of runs, then the texts of the same bucket -> parcels of runs with the hashes of their suffixes."""

    def sent(runs, pieces):
        o = np.concatenate(runs)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        count = o["more"].astype(np.int64) + 1
        starts = np.cumsum(count + length - 1) - (count + length - 1)
        ends = np.cumsum(count)
        inside = np.arange(ends[-1]) - np.repeat(ends - count, count)
        at = np.repeat(starts, count) + inside
        content = Rolling(data).of(at, at + length)
        hot = o["hot"] == 1
        wide = np.repeat(hot, count)
        if hot.any():
            c, place = content[wide], (np.repeat(o["first"], count) + inside)[wide]
            doc, v = np.repeat(o["doc"], count)[wide], np.repeat(o["v"], count)[wide]
            order, head, repeat = told_apart([c], doc, v, place)
            again, keep = order[repeat], order[head]
            if len(again):
                yield from spans_of(doc[again], v[again], place[again], place[again] + length, n)
            c = c[keep]
            zero = np.zeros(len(keep), np.uint8)
            heads = made(HEAD, key=mix(c + U(1)), doc=doc[keep], v=v[keep], first=place[keep], off=zero, more=zero)
            yield from _packed(c % U(n), heads, c)
        cold = o[~hot]
        if len(cold):
            yield from _packed(cold["bucket"], made(HEAD, **{k: cold[k] for k in HEAD.names}), content[~wide])

    def run(batches):
        opens, where = [], None
        runs, pieces, total = [], [], 0
        for b in batches:
            for kind, doc, v, data in zip(*(b.column(k).to_pylist() for k in ("kind", "doc", "v")), b.column("data")):
                if kind == WORK:
                    opens.append(np.frombuffer(data.as_py(), OPEN))
                    continue
                if where is None:
                    opens, where = lookup(np.concatenate(opens) if opens else np.empty(0, OPEN))
                found = where.pop((doc, v), None)  # a repeated row is laid open once
                if found:
                    raw, o = data.as_py(), opens[found[0] : found[1]]
                    runs.append(o)
                    pieces += [raw[f : f + m + length] for f, m in zip(o["first"].tolist(), o["more"].tolist())]
                    total += int(o["more"].sum()) + len(o)
                    if total >= ROWS:
                        yield parcels(sent(runs, pieces))
                        runs, pieces, total = [], [], 0
        if total:
            yield parcels(sent(runs, pieces))

    return run


def _packed(bucket: np.ndarray, heads: np.ndarray, content: np.ndarray):
    """Parcels of (number of runs, runs, hashes of their suffixes)."""
    count = heads["more"].astype(np.int64) + 1
    order = np.argsort(bucket, kind="stable")
    bucket, heads = bucket[order], heads[order]
    starts, count = (np.cumsum(count) - count)[order], count[order]
    ends = np.cumsum(count)
    content = content[np.repeat(starts - (ends - count), count) + np.arange(ends[-1])]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for lo, hi in zip(cuts, [*cuts[1:], len(heads)]):
        yield int(bucket[lo]), WORK, np.int64(hi - lo).tobytes() + heads[lo:hi].tobytes() + content[ends[lo] - count[lo] : ends[hi - 1]].tobytes()


def _suffixes(length: int, n: int):
    """A bucket of laid-open runs -> intervals of repeated suffixes."""

    def run(batches):
        heads, content = [], []
        for b in batches:
            passed = []
            for k, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = data.as_py()
                if kind == SPANS:
                    passed.append((k, kind, raw))
                else:
                    m = int(np.frombuffer(raw, np.int64, 1)[0])
                    heads.append(np.frombuffer(raw, HEAD, m, 8))
                    content.append(np.frombuffer(raw, np.uint64, -1, 8 + m * HEAD.itemsize))
            if passed:
                yield parcels(passed)
        if not heads:
            return
        h, content = np.concatenate(heads), np.concatenate(content)
        count = h["more"].astype(np.int64) + 1
        ends = np.cumsum(count)
        inside = np.arange(ends[-1]) - np.repeat(ends - count, count)
        doc, v, place = np.repeat(h["doc"], count), np.repeat(h["v"], count), np.repeat(h["first"], count) + inside
        anchored = mix(np.repeat(h["key"], count) + (np.repeat(h["off"], count) - inside).astype(U) * U(0x9E3779B97F4A7C15))
        order, _, repeat = told_apart([content, anchored], doc, v, place)
        again = order[repeat]
        if len(again):
            yield parcels(spans_of(doc[again], v[again], place[again], place[again] + length, n))

    return run


def _cut(with_text: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names[: 5 + with_text])

    def run(batches):
        spans, where, out = [], None, []
        for b in batches:
            for kind, doc, v, doc_id, text in zip(*(b.column(k).to_pylist() for k in ("kind", "doc", "v", "doc_id")), b.column("data")):
                data = text.as_py() or b""
                if kind == SPANS:
                    spans.append(np.frombuffer(data, SPAN))
                    continue
                if where is None:
                    s = np.concatenate(spans) if spans else np.empty(0, SPAN)
                    spans, where = lookup(merged(s["doc"].copy(), s["v"].copy(), s["lo"], s["hi"]))
                lo, hi = where.get((doc, v), (0, 0))
                at, keep = 0, []
                for x, y in zip(spans["lo"][lo:hi].tolist(), spans["hi"][lo:hi].tolist()):
                    keep.append(data[at:x])
                    at = y
                kept = b"".join([*keep, data[at:]])
                out.append((doc_id, len(data), len(data) - len(kept), hi - lo, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
                if len(out) == 500:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining bytes) of every row; see the module's text."""
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), F.xxhash64("text").alias("v"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    texts = docs.select("doc", "v", "data")
    fraction = min(1.0, SAMPLED_DOCS / max(1, docs.count()))
    sample = texts.sample(fraction, seed=7).mapInArrow(_sample(length, gram), "key long, run long").limit(SAMPLED).toArrow()
    key, run = (sample.column(k).to_numpy().view(U) for k in ("key", "run"))
    order = np.lexsort([run, key])
    cut = order[(np.arange(1, n) * len(order)) // n] if len(order) else order
    splitters = key[cut], run[cut]
    runs = texts.mapInArrow(_runs(length, gram, splitters, n), PARCEL).repartitionById(n, "bucket")
    found = table(runs.mapInArrow(_compare(length, n, hot), PARCEL), "suffix-runs")
    del runs
    release(spark)
    whole = docs.select(home_column(n).alias("bucket"), F.lit(TEXT).alias("kind"), "doc", "v", "doc_id", "data")
    none = F.lit(None).cast("long")

    def beside(parcel: DataFrame) -> DataFrame:
        return parcel.select("bucket", "kind", none.alias("doc"), none.alias("v"), none.alias("doc_id"), "data").union(whole).repartitionById(n, "bucket").sortWithinPartitions("kind")

    opened = beside(found.where(F.col("kind") == WORK)).mapInArrow(_laid_open(length, n), PARCEL).repartitionById(n, "bucket")
    later = table(opened.mapInArrow(_suffixes(length, n), PARCEL), "suffix-later")
    del opened
    release(spark)
    spans = found.where(F.col("kind") == SPANS).union(later)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return beside(spans).mapInArrow(_cut(with_text), schema)
