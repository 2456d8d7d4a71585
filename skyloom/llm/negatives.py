"""Hard-negative mining with an inverted multi-index.

Vectors of integers are cut into two halves, each half has a codebook, and the pair of nearest codes is a vector's cell. The
codebooks are fitted by k-means on ``SAMPLE`` rows at most (those of the smallest hash of vec_id, ``SAMPLE_BYTES`` in all);
every row is indexed. The index is dealt out by vec_id, so that no label, cell or copied vector is a hot key; each task
reads its rows in parts of ``PART``, with the radius of every code over these rows: the largest distance of a half from it.

Anchors are asked in blocks of ``BLOCK``, broadcast to all parts (a stated set of questions against all rows). For an
anchor, half an inner product with any row of a code is at most that with the code plus radius times the length of the
anchor's half. The multi-sequence heap visits the cells of a part by the sum of both bounds, largest first, leaves out cells
whose smallest possible score lies above all windows, and stops once no unvisited cell can reach into a window that is not
full, or beat the last of a full one. So the windows are certified: results are exact, whatever the codebooks are like, and
good ones only make it end earlier. Each part gives its best few; the best of all parts are the result.

An anchor's positives are its first ``positives`` other rows of the same label; for each positive the first ``negatives``
rows of other labels are mined whose score s satisfies low * p <= 100 * s <= high * p, p being the positive's score. Scores
are integer inner products, higher ones come first, ties by smaller vec_id.

Nulls: rows without vec_id or label, and those whose vector is null or holds a null, take no part. Of several rows with
one vec_id the smallest (label, vector) counts. Vectors shorter than the longest one are continued by zeros. Scores beyond a
long are the nearest long. Anchors without rows that fit give no row; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import partitions, shared_dir, table

CODES, SAMPLE, SAMPLE_BYTES, ROUNDS = 16, 8192, 32 << 20, 12
#: Rows of a part, rows scored at once, anchors of a block and bytes of their vectors.
PART, SCORED, BLOCK, BLOCK_BYTES = 16_384, 1024, 2048, 8 << 20
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
_LONG = (1 << 63) - 1


def matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix of int64."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(ends)
    if (size == dim).all():
        return values.reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)] = values
    return out


def fit_codes(x: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """k-means: centres of at most ``codes`` groups of rows."""
    x = np.unique(x.astype(float), axis=0)
    rng = np.random.default_rng(11)
    centres = x[rng.permutation(len(x))[:codes]]
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centre."""
    near = ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def _assign(shared):
    def run(batches):
        half, books = shared.value
        for b in batches:
            x = matrix(b.column(2), books[0].shape[1] + books[1].shape[1]).astype(float)
            (a, ra), (c, rc) = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            made = [pa.array(a, pa.int32()), pa.array(c, pa.int32()), pa.array(ra), pa.array(rc)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=["vec_id", "label", "vector", "anchor", "code_a", "code_b", "off_a", "off_b"])

    return run


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q``, exact: in floats where these hold the sums, else in Python's integers."""
    most = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * len(q)
    return x.astype(float) @ q.astype(float) if most < 2.0**53 else x.astype(object) @ q.astype(object)


class Part:
    """Some rows of the index, grouped by cell."""

    def __init__(self, ids, labels, x, code_a, code_b, off_a, off_b, books, half):
        self.half = half
        self.sides = []
        numbers = []
        for code, off, book in ((code_a, off_a, books[0]), (code_b, off_b, books[1])):
            used, number = np.unique(code, return_inverse=True)
            radius = np.zeros(len(used))
            np.maximum.at(radius, number, off)
            centres = book[used]
            self.sides.append((centres, radius, np.sqrt((centres**2).sum(1)) + radius))
            numbers.append(number)
        self.width = len(self.sides[1][0])
        cell = numbers[0] * self.width + numbers[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(self.sides[0][0]) * self.width + 1))

    def bounds(self, q: np.ndarray):
        """Largest and smallest half score for every code of both sides."""
        for part, (centres, radius, reach) in zip((q[: self.half], q[self.half :]), self.sides):
            length = float(np.sqrt((part**2).sum()))
            mid, give = centres @ part, radius * length + 1e-9 * reach * length
            yield mid + give, mid - give

    def cells(self, q: np.ndarray):
        """(largest possible score, smallest possible score, cell) by the multi-sequence heap, largest first."""
        (up_a, low_a), (up_b, low_b) = self.bounds(q.astype(float))
        a, b = np.argsort(-up_a, kind="stable").tolist(), np.argsort(-up_b, kind="stable").tolist()
        ua, ub = up_a[a].tolist(), up_b[b].tolist()
        heap = [(-(ua[0] + ub[0]), 0, 0)]
        while heap:
            s, i, j = heapq.heappop(heap)
            yield -s, low_a[a[i]] + low_b[b[j]], a[i] * self.width + b[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (-(ua[i] + ub[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(ua[i + 1] + ub[0]), i + 1, 0))

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) the first ``k`` (score, vec_id) of rows with the same label, or with others."""
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        need = [low for low, _ in windows]  # what a row must reach to matter to each window
        top = max((high for _, high in windows), default=-np.inf)

        def score(cells: list[int]) -> None:
            rows = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in cells])
            ids, labels = self.ids[rows], self.labels[rows]
            fits = ((labels == label) & (ids != own)) if same else labels != label
            rows, ids = rows[fits], ids[fits]
            if not len(rows):
                return
            s = products(self.x[rows], q)
            for w, (_, high) in enumerate(windows):
                ok = np.flatnonzero((s >= need[w]) & (s <= high))
                if not len(ok):
                    continue
                if len(ok) > 4 * k and s.dtype != object:  # no row under the k-th best score can stay
                    ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
                found = [(int(s[i]), int(ids[i])) for i in ok]
                best[w] = sorted(best[w] + found, key=lambda x: (-x[0], x[1]))[:k]
                if len(best[w]) == k:
                    need[w] = max(need[w], best[w][-1][0])

        waiting, n, seen = [], 0, 0
        for up, low, cell in self.cells(q):
            size = int(self.starts[cell + 1] - self.starts[cell])
            if n and n + size > SCORED:
                score(waiting)
                waiting, n = [], 0
            if up < min(need, default=np.inf):
                break
            seen += size
            if size and low <= top:
                waiting.append(cell)
                n += size
            if seen == len(self.ids):
                break
        if n:
            score(waiting)
        return best


class Anchors:
    """A block of anchors: rows of the index, and the positives that have been found for them."""

    def __init__(self, ids, labels, x):
        self.ids, self.labels, self.x = ids, labels, x
        self.positives: dict[int, list[tuple[int, int]]] = {}


_FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def _search(shared, books, dim: int, k: int, low: int, high: int, same: bool):
    def parts(batches):
        held, n = [], 0
        for b in batches:
            for at in range(0, len(b), PART):
                held.append(b.slice(at, PART))
                n += len(held[-1])
                if n >= PART:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches):
        block, (half, codes) = shared.value, books.value
        for t in parts(batches):
            number = lambda name: t.column(name).to_numpy()
            x = matrix(t.column("vector").chunk(0), dim)
            part = Part(number("vec_id"), number("label"), x, number("code_a"), number("code_b"), number("off_a"), number("off_b"), codes, half)
            out = []
            for anchor, label, q in zip(block.ids.tolist(), block.labels.tolist(), block.x):
                if same:
                    asked, windows = [(None, None)], [(-np.inf, np.inf)]
                else:
                    asked = [p for p in block.positives.get(anchor, ()) if -(-low * p[1] // 100) <= high * p[1] // 100]
                    windows = [(-(-low * s // 100), high * s // 100) for _, s in asked]
                if windows:
                    for (positive, s), best in zip(asked, part.search(q, anchor, label, same, windows, k)):
                        out += [(anchor, positive, s, i, max(-_LONG - 1, min(_LONG, v))) for v, i in best]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each question over all parts, with their rank."""
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``vectors`` (vec_id, label, vector:
    array of long); ``is_anchor`` tells from vec_id which rows are anchors. See the module's text."""
    spark = vectors.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<bigint>").alias("vector")).where(whole)
    rows = rows.repartition(partitions(spark), "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    rows = table(rows.select("vec_id", "r.label", "r.vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "mined-rows")
    dim = max(2, rows.agg(F.max(F.size("vector")).alias("d")).first().d or 0)
    half = dim // 2
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(max(CODES, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).toArrow()
    sample = matrix(some.column(0).combine_chunks(), dim) if some.num_rows else np.zeros((1, dim), np.int64)
    books = spark.sparkContext.broadcast((half, (fit_codes(sample[:, :half]), fit_codes(sample[:, half:]))))
    index = table(rows.mapInArrow(_assign(books), "vec_id long, label long, vector array<bigint>, anchor boolean, code_a int, code_b int, off_a double, off_b double"), "mined-index")
    anchors = index.where("anchor")
    blocks = max(1, -(-anchors.count() // max(1, min(block, BLOCK_BYTES // (8 * dim)))))
    path = f"{shared_dir(spark)}/mined-found-{uuid.uuid4().hex[:12]}.parquet"
    for k in range(blocks):
        t = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).select("vec_id", "label", "vector").toArrow()
        asked = Anchors(t.column(0).to_numpy(), t.column(1).to_numpy(), matrix(t.column(2).combine_chunks(), dim) if t.num_rows else np.zeros((0, dim), np.int64))
        shared = spark.sparkContext.broadcast(asked)
        near = first(index.mapInArrow(_search(shared, books, dim, positives, low, high, True), _FOUND), positives)
        for r in near.select("anchor_id", "found_id", "score").collect():  # ``positives`` rows for each anchor of the block
            asked.positives.setdefault(r.anchor_id, []).append((r.found_id, r.score))
        shared.unpersist()
        shared = spark.sparkContext.broadcast(asked)
        index.mapInArrow(_search(shared, books, dim, negatives, low, high, False), _FOUND).write.mode("append").parquet(path)
        shared.unpersist()
    found = first(spark.read.schema(_FOUND).parquet(path), negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
