"""Language-model scores from a log-frequency Bloom filter.

Tokens: words of the lower-cased (A-Z) text, then one end. Single tokens and pairs of neighbours (the first token
follows an end) of the training documents are counted over the whole corpus, every pair included, in one shuffle of
packed parcels. A count c is quantised to 1 + floor(log(c) / log(``BASE``)), and an n-gram of level q sets the bits of
(n-gram, 1) ... (n-gram, q), so a lookup probes levels until one is missing, up to the largest level there is. The
filter is cut into one shard per shuffle partition by the n-gram's hash; a shard has ``BITS`` bits for each level that is
set in it, at every size of the corpus, so the rate of false hits does not depend on the size.

Shards of at most ``MOST_BROADCAST`` bytes in all (the proven bound of what is broadcast) are broadcast to the workers.
A larger filter stays a table: each chunk of texts asks every shard for the levels of its distinct n-grams in one
shuffle, and the answers meet the chunk in another. Both ways give the same scores.

Probability of w after v: l * c(v, w) / c(v) + (1 - l) * (c(w) + 0.5) / (N + 0.5 * (V + 1)), with
l = ``TRUST`` * c(v) / (c(v) + 1), all counts from the filter. The base score needs exact counts: those of the most
frequent words (at most ``HEAD``) are broadcast, all other words are joined.

Nulls: a null text is empty (one token, the end). A null doc_id belongs to no remainder: it is scored, not learnt from,
and held_out is null. Empty texts have the end only; very long texts are scored whole, in one chunk of their own.
Repeated rows come out (and are learnt from) as often as they come in; equal texts get equal scores, so ties need no
order. An empty table gives an empty result; without training documents all counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import U, drop_table, mix, partitions, release, table

FOLDS, HELD = 5, 1
BASE, BITS, PROBES, TRUST = 1.5, 10, 4, 0.8
HEAD, MOST_BROADCAST = 200_000, 96 << 20
END_TOKEN = U(xxhash.xxh3_64_intdigest(b" "))  # no word holds a space
#: Tokens that are scored, and counted, at once (a longer text is a chunk of its own).
TOKENS, COUNTED = 200_000, 1_000_000

ONE = np.dtype([("key", "<u8"), ("c", "<u4")])
SHARD, ASK, ANSWER, CHUNK = range(4)


def tokens(text: str | None) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(w) + 1, U)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, w), U, len(w))
    out[-1] = END_TOKEN
    return out


def pairs(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it; the tokens at ``starts`` follow an end."""
    before = np.roll(h, 1)
    before[starts] = END_TOKEN
    return mix(before * U(0x9E3779B97F4A7C15) + h + U(2))


def singles(h: np.ndarray) -> np.ndarray:
    return mix(h ^ U(0x5851F42D4C957F2D))


def shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _chunks(column, limit: int):
    """Tokens of consecutive texts: (first row, arrays)."""
    part, total, first = [], 0, 0
    for i, t in enumerate(column):
        part.append(tokens(t.as_py()))
        total += len(part[-1])
        if total >= limit:
            yield first, part
            part, total, first = [], 0, i + 1
    if part:
        yield first, part


def _starts(part: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0] + [len(x) for x in part[:-1]])


def ranges(sorted_keys: np.ndarray, n: int):
    """(shard, from, to) of sorted keys."""
    shard = shard_of(sorted_keys, n)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    return zip(shard[cuts].tolist() if len(shard) else [], cuts, [*cuts[1:], len(shard)])


def _parcels(names, kinds, rows):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def _count(n: int):
    def run(batches):
        for b in batches:
            for _, part in _chunks(b.column(0), COUNTED):
                h, out = np.concatenate(part), []
                for kind, keys in ((1, singles(h)), (2, pairs(h, _starts(part)))):
                    keys, c = np.unique(keys, return_counts=True)
                    rows = np.empty(len(keys), ONE)
                    rows["key"], rows["c"] = keys, c
                    out += [(shard, kind, rows[lo:hi].tobytes()) for shard, lo, hi in ranges(keys, n)]
                yield _parcels(["shard", "kind", "data"], [pa.int32(), pa.int32(), pa.binary()], out)

    return run


def level(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(c) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(q: np.ndarray) -> np.ndarray:
    """A count that stands for a level: the mean of the smallest and largest count it holds; 0 for level 0."""
    low = np.ceil(BASE ** (q - 1.0) - 1e-6)
    high = np.maximum(low, np.ceil(BASE ** (q + 0.0) - 1e-6) - 1)
    return np.where(q > 0, (low + high) / 2, 0.0)


def place_of(key: np.ndarray, q: int, size, i: int) -> np.ndarray:
    """The ``i``-th bit for level q inside shards of ``size`` bits."""
    x = mix(key + U(0x9E3779B97F4A7C15 * (q * PROBES + i) % 2**64))
    return (x >> U(32)) * np.asarray(size, U) >> U(32)


def _shards(per_level: int):
    """All counts of a shard -> its bits, its numbers and its single tokens' exact counts."""

    def run(batches):
        held: dict[int, list] = {1: [], 2: []}
        shard = 0
        for b in batches:
            for k, kind, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                shard = k
                held[kind].append(np.frombuffer(data.as_py(), ONE))
        if not held[1] and not held[2]:
            return
        found = {}
        for kind, parts in held.items():
            rows = np.concatenate(parts) if parts else np.empty(0, ONE)
            parts.clear()
            key = rows["key"].copy()
            order = np.argsort(key)
            key, c = key[order], rows["c"][order].astype(np.int64)
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            found[kind] = key[new], np.add.reduceat(c, new) if len(new) else c
        key, q = (np.concatenate(x) for x in zip(*((k, level(c)) for k, c in found.values())))
        size = max(64, -(-per_level * int(q.sum()) // 8) * 8)
        bits = np.zeros(size, bool)
        for k in range(1, int(q.max()) + 1):
            held_by = key[q >= k]
            for i in range(PROBES):
                bits[place_of(held_by, k, size, i).astype(np.intp)] = True
        key, c = found[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), *[pa.array([x], pa.int64()) for x in (size // 8, int(q.max()), int(c.sum()), len(c))], pa.array([key.view(np.int64)], pa.list_(pa.int64())), pa.array([c], pa.list_(pa.int64()))],
            names=["shard", "bits", "bytes", "top", "n", "v", "key", "c"],
        )

    return run


class Filter:
    """What workers need: totals, the frequent words' exact counts and, if they fit, the shards' bits."""

    def __init__(self, shards: int, top: int, n: int, v: int, head: np.ndarray, head_counts: np.ndarray):
        self.shards, self.top, self.n, self.v, self.head, self.head_counts = shards, top, n, v, head, head_counts
        self.bits, self.starts, self.sizes = None, None, None

    def hold(self, found: dict[int, bytes]) -> None:
        size = np.array([len(found.get(i, b"")) for i in range(self.shards)])
        self.bits = np.frombuffer(b"".join(found[i] for i in sorted(found)), np.uint8)
        self.starts, self.sizes = np.cumsum(size) - size, size * 8

    def levels(self, key: np.ndarray) -> np.ndarray:
        shard = shard_of(key, self.shards)
        return probed(self.bits, key, self.starts[shard], self.sizes[shard], self.top)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))

    def score(self, part: list[np.ndarray], levels=None):
        """Per text: log10 probability, exact sum and number of known words of the head; the words that are not in it."""
        levels = levels or self.levels
        h, starts = np.concatenate(part), _starts(part)
        end = singles(np.array([END_TOKEN]))
        one, back = np.unique(singles(h), return_inverse=True)
        two, back2 = np.unique(pairs(h, starts), return_inverse=True)
        q = level_count(levels(np.concatenate([one, two])))
        c1, c2 = q[: len(one)], q[len(one) :][back2]
        w = c1[back]
        before = np.roll(w, 1)
        before[starts] = c1[np.searchsorted(one, end[0])]  # every text has an end
        trust = TRUST * before / (before + 1)
        p = trust * np.minimum(1.0, c2 / np.maximum(before, 1)) + (1 - trust) * self.unigram(w)
        at = np.minimum(np.searchsorted(self.head, one), max(0, len(self.head) - 1))
        known = (self.head[at] == one) if len(self.head) else np.zeros(len(one), bool)
        exact = np.where(known, np.log10(self.unigram(self.head_counts[at] if len(self.head) else 0.0)), 0.0)
        in_head = known[back]
        sizes = [len(x) for x in part]
        rest = np.cumsum(~in_head)
        ends = np.r_[0, rest[np.cumsum(sizes) - 1]]
        return np.add.reduceat(np.log10(p), starts), np.add.reduceat(exact[back], starts), np.add.reduceat(in_head.astype(np.int64), starts), ends, one[back[~in_head]]


def probed(bits: np.ndarray, key: np.ndarray, start, size, top: int) -> np.ndarray:
    """Levels of n-grams whose shards begin at byte ``start`` and have ``size`` bits (0: no such shard)."""
    q = np.zeros(len(key), np.int64)
    left = np.flatnonzero(size > 0)
    for k in range(1, top + 1):
        for i in range(PROBES):  # most n-grams that lack this level fall at the first probe
            place = place_of(key[left], k, size[left], i)
            left = left[(bits[start[left] + (place >> U(3)).astype(np.intp)] >> (7 - (place & U(7)).astype(np.uint8)) & 1).astype(bool)]
        if not len(left):
            break
        q[left] = k
    return q


NAMES = ["row", "doc_id", "n_tokens", "score", "head_sum", "head_known", "tail"]
SCORED = "row long, doc_id long, n_tokens long, score double, head_sum double, head_known long, tail array<long>"


def _scored(model: Filter, part: list[np.ndarray], rows, ids, levels=None) -> pa.RecordBatch:
    score, exact, known, ends, tail = model.score(part, levels)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tail.view(np.int64)))
    return pa.RecordBatch.from_arrays([rows, ids, pa.array([len(x) for x in part], pa.int64()), pa.array(score), pa.array(exact), pa.array(known), lists], names=NAMES)


def _score(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            for first, part in _chunks(b.column(2), TOKENS):
                yield _scored(model, part, b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)).cast(pa.int64()))

    return run


def _chunked(batches):
    """Rows -> one row per chunk of them."""
    for b in batches:
        for first, part in _chunks(b.column(2), TOKENS):
            s = b.slice(first, len(part))
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t))
            yield pa.RecordBatch.from_arrays([s.column(0)[:1].cast(pa.int64()), one(s.column(0), pa.int64()), one(s.column(1), pa.int64()), one(s.column(2), pa.string())], names=["chunk", "rows", "ids", "texts"])


def _asked(part: list[np.ndarray]) -> np.ndarray:
    h = np.concatenate(part)
    return np.unique(np.concatenate([singles(h), pairs(h, _starts(part))]))


def _asks(n: int):
    """Chunks -> the distinct n-grams they ask each shard for."""

    def run(batches):
        for b in batches:
            for chunk, texts in zip(b.column(0).to_pylist(), b.column(1)):
                keys = _asked([tokens(t) for t in texts.as_py()])
                yield _parcels(["bucket", "kind", "chunk", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()], [(shard, ASK, chunk, keys[lo:hi].tobytes()) for shard, lo, hi in ranges(keys, n)])

    return run


def _answers(top: int):
    """A shard, then what it is asked -> levels, one byte each."""

    def run(batches):
        bits = None
        for b in batches:
            out = []
            for bucket, kind, chunk, data in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                if kind == SHARD:
                    bits = np.frombuffer(data.as_py(), np.uint8)
                    continue
                key = np.frombuffer(data.as_py(), U)
                q = np.zeros(len(key), np.int64) if bits is None else probed(bits, key, np.zeros(len(key), np.int64), np.full(len(key), len(bits) * 8), top)
                out.append((bucket, ANSWER, chunk, q.astype(np.uint8).tobytes()))
            if out:
                yield _parcels(["bucket", "kind", "chunk", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()], out)

    return run


def _score_answered(shared):
    """Answers of one chunk after the other (in order of shards, which is that of the n-grams), each followed by its texts."""

    def run(batches):
        model, answers = shared.value, []
        for b in batches:
            for kind, data, rows, ids, texts in zip(b.column("kind").to_pylist(), *(b.column(k) for k in ("data", "rows", "ids", "texts"))):
                if kind == ANSWER:
                    answers.append(np.frombuffer(data.as_py(), np.uint8))
                    continue
                part = [tokens(t) for t in texts.as_py()]
                keys, q = _asked(part), np.concatenate(answers).astype(np.int64)
                answers = []
                yield _scored(model, part, rows.values, ids.values, lambda key, keys=keys, q=q: q[np.searchsorted(keys, key)])

    return run


def fit(train: DataFrame, most_broadcast: int = MOST_BROADCAST, per_level: int = BITS) -> tuple[Filter, DataFrame]:
    """The model of the texts of ``train`` (with its bits, if they fit), and the table of its shards."""
    spark = train.sparkSession
    n = partitions(spark)
    counts = train.select("text").mapInArrow(_count(n), "shard int, kind int, data binary").repartitionById(n, "shard")
    shards = table(counts.mapInArrow(_shards(per_level), "shard int, bits binary, bytes long, top long, n long, v long, key array<long>, c array<long>"), "lm-shards")
    del counts
    release(spark)
    sums = shards.agg(F.sum("bytes").alias("bytes"), F.max("top").alias("top"), F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    words = shards.select(F.explode(F.arrays_zip("key", "c")).alias("w")).select("w.key", "w.c")
    # the least count of the head: as many whole levels as give at most HEAD words
    step = F.floor(F.log(F.col("c").cast("double")) / float(np.log(BASE)) + 1e-9)
    least, room = np.inf, HEAD
    for r in words.groupBy(step.alias("q")).count().orderBy(F.desc("q")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = BASE**r.q - 1e-6
    head = words.where(F.col("c") >= float(least)).toArrow()
    key, c = head.column("key").to_numpy().view(U), head.column("c").to_numpy()
    order = np.argsort(key)
    model = Filter(n, sums.top or 0, sums.n or 0, sums.v or 0, key[order], c[order].astype(float))
    if (sums.bytes or 0) <= most_broadcast:
        model.hold({r.shard: bytes(r.bits) for r in shards.select("shard", "bits").toLocalIterator()})
    return model, shards


def _by_shards(rows: DataFrame, shards: DataFrame, model: Filter, shared) -> DataFrame:
    n = model.shards
    chunks = table(rows.mapInArrow(_chunked, "chunk long, rows array<long>, ids array<long>, texts array<string>"), "lm-chunks")
    asks = chunks.select("chunk", "texts").mapInArrow(_asks(n), "bucket int, kind int, chunk long, data binary")
    bits = shards.select(F.col("shard").alias("bucket"), F.lit(SHARD).alias("kind"), F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("data"))
    both = bits.union(asks).repartitionById(n, "bucket").sortWithinPartitions("kind")
    answers = both.mapInArrow(_answers(model.top), "bucket int, kind int, chunk long, data binary")
    answers = answers.select("bucket", "kind", "chunk", "data", *[F.lit(None).cast(t).alias(k) for k, t in (("rows", "array<long>"), ("ids", "array<long>"), ("texts", "array<string>"))])
    asked = chunks.select(F.lit(None).cast("int").alias("bucket"), F.lit(CHUNK).alias("kind"), "chunk", F.lit(None).cast("binary").alias("data"), "rows", "ids", "texts")
    met = answers.union(asked).repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    scored = table(met.mapInArrow(_score_answered(shared), SCORED), "lm-scores")
    drop_table(chunks)
    return scored


def lm_scores(docs: DataFrame, most_broadcast: int = MOST_BROADCAST, per_level: int = BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; see the module's text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    model, shards = fit(docs.where(fold != HELD), most_broadcast, per_level)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = table(rows.mapInArrow(_score(shared), SCORED), "lm-scores") if model.bits is not None else _by_shards(rows, shards, model, shared)
    release(spark)
    words = shards.select(F.explode(F.arrays_zip("key", "c")).alias("w")).select("w.key", "w.c")
    exact = scored.select("row", F.explode("tail").alias("key")).join(words, "key", "left")
    under = model.n + 0.5 * (model.v + 1)
    sums = exact.groupBy("row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(under))).alias("tail_sum"), F.count("c").alias("tail_known"))
    out = scored.select("row", "doc_id", "n_tokens", "score", "head_sum", "head_known").join(sums, "row", "left")
    return out.select(
        "doc_id",
        (fold == HELD).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0))).alias("base_score"),
        "score",
    )
