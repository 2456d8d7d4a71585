"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the scaled sum of hashed rows of one embedding table: one for the whole word and one for each run of
3 to 6 of its bytes, with marks at both ends, so that unseen forms of a known stem are near it. Filters of widths 1, 2
and 3 run over the text; max pooling keeps the two strongest answers of each filter (one place may be chance, two are
not), and a logistic layer scores them.

The model is fitted on all labelled rows, whatever the length of their text (``train`` leaves out texts of over
``ROW_BYTES`` bytes if no other bound is given; :func:`toxicity` gives none). They are dealt over shards by the hash of
doc_id, each of a size that a task can hold. The first shard alone trains the model that all others start from, in several
passes, which end where the loss on its calibration rows is least. If there are more shards, all of them then go over their
rows from there, ``PASSES`` times; after each time what the shards moved is averaged, a row of the embedding table over the
shards that moved it, so that a word of one shard counts whole. A quarter of the rows (by hash) is for calibration: all of
them are scored, the logit is shifted so that 0.5 is the cut of best F1, and thresholds by language are set on the same rows.
Shards train and scores are cut in Spark tasks; the driver gets the mean model and the thresholds. Scoring
reads the text only; the language is used for the extra column ``flagged`` alone.

Results by row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), flagged (score at or over the threshold of
the row's language; 0.5 for languages with few calibration rows). Nulls: a null text is empty and gets the score of
an empty word, as does an empty text; labels with a null doc_id or mark are not used; rows with null doc_id are scored,
held_out null. Very long texts are scored whole. Ties: equal texts get equal scores, a score at a threshold counts as
over it. Repeated rows come out as often as they come in; several labels of one doc_id count as their maximum, and of
several texts of one doc_id the smallest is learnt from. Without labelled rows every score is 0; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm.common import U, drop_table, mix, release, table
from skyloom.llm.licenses import words

ROW_BYTES, FOLDS = 64 << 10, 5
#: Rows of a shard and bytes of their texts (on average, at most), and rows of the embedding table that it sends at once.
SHARD_ROWS, SHARD_BYTES, BLOCK = 8000, 32 << 20, 1024
ROWS, DIM, FILTERS, WIDTHS, GRAMS = 1 << 17, 16, 8, (1, 2, 3), (3, 4, 5, 6)
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 6, 400, 32, 0.01, 1e-4, 7  # STEPS: the fewest
#: Passes of the first shard if there are more, and passes over all shards after it.
FIRST_EPOCHS, PASSES = 2, 2
#: Marked calibration rows that a language needs for a threshold of its own.
LEAST_MARKED = 10
#: Tokens scored at once, and words whose answers are remembered.
TOKENS, REMEMBERED = 100_000, 200_000


def gram_rows(vocabulary: list[bytes], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word, and where those of each word begin (one more at the end)."""
    parts = [_gram_rows(vocabulary[k : k + at_once]) for k in range(0, len(vocabulary), at_once)]
    sizes = np.concatenate([n for _, n in parts])
    return np.concatenate([r for r, _ in parts]), np.r_[0, np.cumsum(sizes)]


def _gram_rows(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of some words, and how many each has."""
    marked = [b"\x02" + w + b"\x03" for w in vocabulary]
    size = np.array([len(w) for w in marked], np.int64)
    data = np.frombuffer(b"".join(marked), np.uint8).astype(U)
    end = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(size)), size)
    here = np.arange(len(data))
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), U, len(vocabulary))
    owner, rows = [np.arange(len(size))], [whole >> U(47)]
    h = np.zeros(len(data), U)
    for n in range(min(max(GRAMS), len(data))):
        h[: len(data) - n] += data[n:] * U(pow(0x9E3779B97F4A7C15, n + 1, 1 << 64))
        if n + 1 in GRAMS:
            ok = here + n + 1 <= end
            owner.append(word[ok])
            rows.append(mix(h[ok] + U(n)) >> U(47))
    owner, rows = np.concatenate(owner), np.concatenate(rows).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(size))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Cnn:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.p = {
            "e": rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32),
            "k": rng.normal(0, 0.4, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32),
            "b": np.zeros(n, np.float32),
            "o": np.abs(rng.normal(0, 0.3, 2 * n)).astype(np.float32) * np.where(np.arange(2 * n) % 4 < 3, 1, -1).astype(np.float32),
            "c": np.full(1, -1.0, np.float32),
        }
        self.shift = 0.0
        self.known: dict[bytes, int] = {}
        self.answers = np.empty((0, sum(WIDTHS) * FILTERS), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "answers": self.answers[:0]}

    def vectors(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.p["e"][rows], starts, axis=0) / np.sqrt(sizes)[:, None].astype(np.float32)

    def convolved(self, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Answers of all filters at all places from the shares of each word."""
        end = np.repeat(np.cumsum(sizes), sizes)
        here = np.arange(len(y))
        out, col = np.empty((len(y), len(WIDTHS) * FILTERS), np.float32), 0
        for i, width in enumerate(WIDTHS):
            z = out[:, i * FILTERS : (i + 1) * FILTERS]
            z[:] = y[:, col : col + FILTERS] + self.p["b"][i * FILTERS : (i + 1) * FILTERS]
            for j in range(1, min(width, len(y))):
                z[: len(z) - j] += np.where((here[: len(z) - j] + j < end[: len(z) - j])[:, None], y[j:, col + j * FILTERS : col + (j + 1) * FILTERS], 0)
            col += width * FILTERS
        return out

    @staticmethod
    def pooled(z: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two strongest answers of each filter in each text (negative ones count as 0), and their places (else -1)."""
        n = z.shape[1]
        values, places = np.zeros((len(sizes), 2 * n), np.float32), np.full((len(sizes), 2 * n), -1)
        cols, at = np.arange(n), 0
        for i, size in enumerate(sizes):
            part = z[at : at + size]
            for k in range(min(2, size)):
                top = part.argmax(0)
                best = part[top, cols]
                values[i, k * n : (k + 1) * n] = np.maximum(best, 0)
                places[i, k * n : (k + 1) * n] = np.where(best > 0, at + top, -1)
                part[top, cols] = -np.inf
            at += size
        return values, places

    def strongest(self, shares: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`pooled` for texts whose words have these rows of ``shares``, in parts of at most ``TOKENS`` places, so that
        a text of any length needs no more memory."""
        values, places, k, at = [], [], 0, 0
        while k < len(sizes):
            n = k + 1
            total = int(sizes[k])
            while n < len(sizes) and total + sizes[n] <= TOKENS:
                total += int(sizes[n])
                n += 1
            if total <= TOKENS:
                v, p = self.pooled(self.convolved(shares[ids[at : at + total]], sizes[k:n]), sizes[k:n])
            else:
                v, p = self._strongest_of_long(shares, ids[at : at + total])
            values.append(v)
            places.append(np.where(p >= 0, p + at, -1))
            k, at = n, at + total
        return np.concatenate(values), np.concatenate(places)

    def _strongest_of_long(self, shares: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(WIDTHS) * FILTERS
        values, places = np.zeros((2, n), np.float32), np.full((2, n), -1)
        for s in range(0, len(ids), TOKENS):
            part = ids[s : s + TOKENS + max(WIDTHS) - 1]  # a filter looks ahead
            z = self.convolved(shares[part], np.array([len(part)]))[:TOKENS]
            v, p = self.pooled(z, np.array([len(z)]))
            values = np.concatenate([values, v.reshape(2, n)])
            places = np.concatenate([places, np.where(p >= 0, p + s, -1).reshape(2, n)])
            first = np.argsort(-values, axis=0, kind="stable")[:2]  # of equal answers the earlier one
            values, places = np.take_along_axis(values, first, 0), np.take_along_axis(places, first, 0)
        return values.reshape(1, -1), places.reshape(1, -1)

    def _ids(self, texts: list[list[bytes]]) -> np.ndarray:
        flat = [w for t in texts for w in t]
        new = list({w for w in flat if w not in self.known})
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.answers = {}, self.answers[:0]
                new = list(set(flat))
            parts = []
            for k in range(0, len(new), 20_000):
                rows, starts = gram_rows(new[k : k + 20_000])
                parts.append(self.vectors(rows, np.diff(starts)) @ self.p["k"])
            self.known |= dict(zip(new, range(len(self.answers), len(self.answers) + len(new))))
            self.answers = np.concatenate([self.answers, *parts])
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        out, k = [], 0
        while k < len(texts):
            n, total = k, 0
            while n < len(texts) and (n == k or total + len(texts[n]) <= TOKENS):
                total += len(texts[n])
                n += 1
            sizes = np.array([len(t) for t in texts[k:n]])
            ids = self._ids(texts[k:n])  # fills self.answers first
            h, _ = self.strongest(self.answers, ids, sizes)
            out.append(h @ self.p["o"] + self.p["c"][0])
            k = n
        return np.concatenate(out) + self.shift if out else np.empty(0)

    def fit(self, texts: Iterable[list[bytes]], marks: np.ndarray, check: list[list[bytes]], check_marks: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS) -> None:
        rng = np.random.default_rng(SEED)
        index: dict[bytes, int] = {}
        docs = [np.fromiter((index.setdefault(w, len(index)) for w in t), np.int32, len(t)) for t in texts]
        if not docs:
            return
        rows, starts = gram_rows(list(index))
        del index
        grams = np.diff(starts)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        weight = np.where(marks == 1, (marks == 0).sum() / max(1, (marks == 1).sum()), 1.0) ** 0.5
        best, kept = np.inf, {k: x.copy() for k, x in self.p.items()}
        n, cols = len(WIDTHS) * FILTERS, sum(WIDTHS) * FILTERS
        for _ in range(max(epochs, -(-steps * BATCH // len(docs)))):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), BATCH):
                some = order[s : s + BATCH]
                sizes = np.array([len(docs[i]) for i in some])
                here, back = np.unique(np.concatenate([docs[i] for i in some]), return_inverse=True)
                e = self.vectors(rows[spread(starts[here], grams[here])], grams[here])
                end = np.repeat(np.cumsum(sizes), sizes)
                h, place = self.strongest(e @ self.p["k"], back, sizes)
                p = 1 / (1 + np.exp(-np.clip(h @ self.p["o"] + self.p["c"][0], -30, 30)))
                d = ((p - marks[some]) * weight[some] / len(some)).astype(np.float32)
                dh = d[:, None] * self.p["o"] * (place >= 0)
                # what each word gets from each column of the filters, over all places where it was among the strongest
                word, gain, col = [], [], 0
                for i, width in enumerate(WIDTHS):
                    for half in (0, n):
                        part = slice(half + i * FILTERS, half + (i + 1) * FILTERS)
                        for j in range(width):
                            at = place[:, part]
                            ok = (at >= 0) & (at + j < end[np.maximum(at, 0)])
                            word.append(back[at[ok] + j] * cols + (col + j * FILTERS + np.nonzero(ok)[1]))
                            gain.append(dh[:, part][ok])
                    col += width * FILTERS
                got = np.bincount(np.concatenate(word), np.concatenate(gain), len(here) * cols).reshape(-1, cols).astype(np.float32)
                g = {"k": e.T @ got, "b": dh[:, :n].sum(0) + dh[:, n:].sum(0), "o": h.T @ d + DECAY * self.p["o"], "c": d.sum(keepdims=True)}
                touched = np.flatnonzero(got.any(1))
                de = got[touched] @ self.p["k"].T
                t += 1
                fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for k in g:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    self.p[k] -= (RATE * fix * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
                if len(touched):
                    w = here[touched]
                    own = rows[spread(starts[w], grams[w])]
                    by = np.argsort(own, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(own[by]) > 0])
                    at = own[by[first]]
                    share = np.repeat(de / np.sqrt(grams[w])[:, None].astype(np.float32), grams[w], axis=0)
                    dense = np.add.reduceat(share[by], first, axis=0)
                    m["e"][at] += 0.1 * (dense - m["e"][at])
                    v["e"][at] += 0.001 * (dense**2 - v["e"][at])
                    self.p["e"][at] -= (RATE * fix * m["e"][at] / (np.sqrt(v["e"][at]) + 1e-8)).astype(np.float32)
            self.known, self.answers = {}, self.answers[:0]
            z = np.clip(self.logits(check), -30, 30)
            loss = float(np.mean(np.where(check_marks == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z))))) if len(z) else 0.0
            if loss <= best:
                best, kept = loss, {k: x.copy() for k, x in self.p.items()}
        self.p, self.known, self.answers = kept, {}, self.answers[:0]

    def copy(self) -> Cnn:
        out = Cnn.__new__(Cnn)
        out.__dict__ |= self.__getstate__() | {"p": {k: x.copy() for k, x in self.p.items()}}
        return out

    def blocks(self) -> dict[int, np.ndarray]:
        """All weights: the embedding table by blocks of rows, the others as block -1."""
        return {-1: np.concatenate([self.p[k].ravel() for k in "kboc"])} | {b: self.p["e"][b * BLOCK : (b + 1) * BLOCK].ravel() for b in range(-(-ROWS // BLOCK))}

    def moved(self, by: dict[int, np.ndarray]) -> Cnn:
        """The model with blocks of weights moved."""
        out = self.copy()
        for b, d in by.items():
            if b >= 0:
                out.p["e"][b * BLOCK : (b + 1) * BLOCK] += d.reshape(-1, DIM)
                continue
            at = 0
            for k in "kboc":
                out.p[k] += d[at : at + out.p[k].size].reshape(out.p[k].shape)
                at += out.p[k].size
        return out


def tokens(text: str | None) -> list[bytes]:
    return words(text) or [b""]


def _trained(start, epochs: int, steps: int, checked: bool):
    """Rows of one shard -> how far its weights moved from the start, by blocks."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        hold, y = (part.column(c).to_numpy() for c in ("hold", "toxic"))
        texts = part.column("text")
        old = start.value
        net = old.copy()
        check = [tokens(texts[int(k)].as_py()) for k in np.flatnonzero(hold)] if checked else []
        net.fit((tokens(texts[int(k)].as_py()) for k in np.flatnonzero(~hold)), y[~hold], check, y[hold], epochs, steps)
        was, now = old.blocks(), net.blocks()
        shards = pa.array([part.column("shard")[0].as_py()] * len(now), pa.int32())
        return pa.table([shards, pa.array(list(now), pa.int32()), pa.array([(now[b] - was[b]).tobytes() for b in now], pa.binary())], names=["shard", "block", "delta"])

    return run


def _mean(part: pa.Table) -> pa.Table:
    """The mean of what all shards moved in a block; of a row of the embedding table, over the shards that moved it."""
    part = part.sort_by("shard")
    block = part.column("block")[0].as_py()
    total = n = 0
    for x in part.column("delta"):
        d = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, DIM if block >= 0 else 1)
        total = total + d.astype(float)
        n = n + (d != 0).any(1, keepdims=True) if block >= 0 else n + 1
    out = (total / np.maximum(n, 1)).astype(np.float32)
    return pa.table([pa.array([block], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "delta"])


def _released(spark: SparkSession) -> None:
    """Release what earlier steps shuffled: the first call frees what Python held, which only the second one can find."""
    release(spark)
    release(spark)


def _round(rows: DataFrame, model: Cnn, shards: int, *how) -> Cnn:
    """The model moved by the mean of what the shards of ``rows`` make of it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    # more partitions than shards, so that few shards share one
    moves = rows.repartition(4 * shards + 64, "shard").groupBy("shard").applyInArrow(_trained(shared, *how), "shard int, block int, delta binary")
    mean = moves.groupBy("block").applyInArrow(_mean, "block int, delta binary").collect()
    shared.unpersist()
    return model.moved({r.block: np.frombuffer(r.delta, np.float32) for r in mean})


def best_cuts(scored: DataFrame) -> DataFrame:
    """(g, z, toxic), g not null -> for each g the z of best F1 as a cut, half-way to the next lower one, and its marked rows.

    Sums of ranges of z come first, so that a g of any size is ordered in parts.
    """
    each = scored.groupBy("g", "z", F.floor(F.col("z") * 8).alias("part")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    parts = each.groupBy("g", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("z").alias("top"))
    down, whole = Window.partitionBy("g").orderBy(F.desc("part")), Window.partitionBy("g")
    over = down.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("hits").over(over), F.lit(0)).alias("hits0"), F.sum("hits").over(whole).alias("marked"), F.lead("top").over(down).alias("below"))
    inside = Window.partitionBy("g", "part").orderBy(F.desc("z"))
    f1 = 2 * (F.col("hits0") + F.sum("hits").over(inside)) / (F.col("n0") + F.sum("n").over(inside) + F.greatest("marked", F.lit(1)))
    cut = F.coalesce((F.col("z") + F.coalesce(F.lead("z").over(inside), "below")) / 2, "z")
    return each.join(parts, ["g", "part"]).select("g", "z", "marked", f1.alias("f1"), cut.alias("cut")).groupBy("g").agg(F.max_by("cut", F.struct("f1", "z")).alias("cut"), F.max("marked").alias("marked"))


def _calibrated(model):
    def run(batches):
        net = model.value
        for b in batches:
            for at in range(0, len(b), 200):
                z = net.logits([tokens(t.as_py()) for t in b.column(0).slice(at, 200)])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, 200).cast(pa.string()), b.column(2).slice(at, 200).cast(pa.int32()), pa.array(z.astype(float), pa.float64())], names=["lang", "toxic", "z"])

    return run


def train(docs: DataFrame, labels: DataFrame, row_bytes: int | None = ROW_BYTES) -> tuple[Cnn, dict[str, float]]:
    """The model and its thresholds by language, from all labelled rows that are not held out and whose text has at most
    ``row_bytes`` bytes (None: any length)."""
    spark = docs.sparkSession
    learnt = F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0
    marks = labels.where("doc_id is not null and toxic is not null").where(learnt).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = docs.where(learnt).select("doc_id", "text", "lang").join(marks, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("one"))
    size, h = F.coalesce(F.octet_length("one.text"), F.lit(0)), F.xxhash64("doc_id")
    found = found if row_bytes is None else found.where(size <= row_bytes)
    rows = table(found.select("doc_id", "toxic", "one.text", F.coalesce("one.lang", F.lit("")).alias("lang"), h.alias("h"), (F.pmod(h, F.lit(4)) == 3).alias("hold"), size.alias("size")), "toxicity-rows")
    model = Cnn()
    n, size, marked = rows.select(F.sum((~F.col("hold")).cast("long")), F.sum(F.when(~F.col("hold"), F.col("size"))), F.max("toxic")).first()
    _released(spark)
    if not marked:
        model.p["o"][:] = 0
        model.p["c"][0] = -50.0
        drop_table(rows)
        return model, {}
    shards = max(1, -(-(n or 0) // SHARD_ROWS), -(-(size or 0) // SHARD_BYTES))
    dealt = rows.select("doc_id", "toxic", "text", "h", "hold", F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int").alias("shard"))
    model = _round(dealt.where("shard = 0"), model, 1, EPOCHS if shards == 1 else FIRST_EPOCHS, STEPS, True)
    for _ in range(PASSES if shards > 1 else 0):
        model = _round(dealt.where("not hold"), model, shards, 1, 0, False)
        _released(spark)
    shared = spark.sparkContext.broadcast(model)
    scored = table(rows.where("hold").select("text", "lang", "toxic").mapInArrow(_calibrated(shared), "lang string, toxic int, z double"), "toxicity-scored")
    # g: all rows, and those of the language
    groups = F.array(F.lit("all"), F.concat(F.lit("lang "), "lang"))
    cuts = {r.g: r for r in best_cuts(scored.select(F.explode(groups).alias("g"), "z", "toxic")).where("marked > 0").collect()}
    for x in (rows, scored):
        drop_table(x)
    shared.unpersist()
    _released(spark)
    if "all" in cuts:
        model.shift = -cuts.pop("all").cut
    return model, {g.removeprefix("lang "): float(1 / (1 + np.exp(-(r.cut + model.shift)))) for g, r in cuts.items() if r.marked >= LEAST_MARKED}


def _score(model):
    def run(batches):
        net = model.value
        for b in batches:
            for at in range(0, len(b), 200):
                z = net.logits([tokens(t.as_py()) for t in b.column(1).slice(at, 200)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 200).cast(pa.int64()), b.column(2).slice(at, 200).cast(pa.string()), pa.array(1 / (1 + np.exp(-z.astype(float))), pa.float64())], names=["doc_id", "lang", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, cuts = train(docs, labels, None)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS * DIM floats, whatever the corpus
    scored = docs.select("doc_id", "text", "lang").mapInArrow(_score(shared), "doc_id long, lang string, score double")
    cut = F.lit(0.5)
    for lang, x in cuts.items():
        cut = F.when(F.col("lang") == lang, x).otherwise(cut)
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
