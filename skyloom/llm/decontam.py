"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

Texts are lower-cased, everything but letters and digits becomes a space, and 5-word shingles are hashed. A window is
a run of as many words as an item has (fewer at the end of the text). Where a window is as similar to its item as asked
for, it holds at least ``least / (1 + least)`` of the sum of both numbers of shingles in shingles of the item (8/9 of
the item's for 0.8 and a whole window), so every start is tried at which that many positions are hit, wherever in the
item the shingles stand; this bound loses none that could pass. For these windows:

1. a 64-bit SimHash: each shingle votes on every bit, weighted by its occurrences in the window; the votes are summed
   in byte lanes of eight longs;
2. multi-index Hamming blocks: fingerprints are cut into ``RADIUS + 1`` blocks, of which two fingerprints within the
   radius must share one, so an equi-join on (item, block, value) finds all of them; then bit counts decide;
3. the exact weighted Jaccard similarity of the shingle bags (sum of the smaller over sum of the larger counts)
   verifies candidates: 0.8 or more is a leak.

Items with fewer words than a shingle count as one shingle of their whole text; an item without words matches nothing.
At similarity 0.8 a bit of two fingerprints differs with p = acos(8/9) / pi = 0.151, so more than ``RADIUS`` of 64
differ in 8e-7 of all cases (binomial).

Nulls: a null text has no words; a null doc_id is reported like any other; an item with null text or item_id matches
nothing. Repeated rows are reported once per (doc_id, item). Ties: of equally similar windows of a pair the one that starts
first is reported. Very long texts are read whole; an empty table (or benchmark) gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import table

K, RADIUS, LEAST = 5, 25, 0.8
#: Most shingle rows of the benchmark that are broadcast (24 bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(text: Column, k: int) -> Column:
    """Hashes of all k-word shingles, in order; of the whole sequence if it is shorter; none without words."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words(text)), of), 0)  # the words are made once, wherever the plan puts this


def simhash(h: Column) -> Column:
    """64-bit SimHash of a bag of hashes. Byte lanes hold the votes of 120 hashes; longer bags add up several parts."""
    mask = F.lit(0x0101010101010101)

    def lanes(part: Column, bit: int) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftrightunsigned(x, bit).bitwiseAND(mask))

    def by_bit(bit: int) -> Column:
        # sums of up to 120 votes a lane never reach the sign bit, so one long carries eight lanes
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(120))
        parts = F.transform(starts, lambda s: lanes(F.slice(h, s, 120), bit))
        return F.get(
            F.transform(
                F.array(parts),
                lambda p: sum_bits([F.when(2 * F.aggregate(p, F.lit(0).cast("bigint"), add_lane(lane)) > F.size(h), F.lit(1 << (8 * lane + bit) if 8 * lane + bit < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for lane in range(8)]),
            ),
            0,
        )

    def add_lane(lane: int):
        return lambda a, x: a + F.shiftrightunsigned(x, 8 * lane).bitwiseAND(F.lit(255))

    def sum_bits(bits: list[Column]) -> Column:
        out = bits[0]
        for b in bits[1:]:
            out = out.bitwiseOR(b)
        return out

    return sum_bits([by_bit(b) for b in range(8)])


def blocks(f: Column, radius: int) -> Column:
    """(block, value) of each of radius + 1 blocks of a 64-bit fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(f, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)).alias("value")) for i in range(n)])


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller counts over sum of larger counts of two bags (arrays of hashes)."""
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    total = F.size(a) + F.size(b)
    return F.get(F.transform(F.array(both), lambda m: m / F.greatest(total - m, F.lit(1))), 0)


def window_starts(at: Column, n: Column, size: Column, least: float) -> Column:
    """Starts of all windows of n shingles with enough hits; ``at``: the sorted hit positions among ``size`` shingles.

    Windows that end with the text may be shorter, and as few hits as ``least * n`` can do there.
    """

    def of(x: Column) -> Column:
        p, m, size = x["at"], x["n"], x["size"]

        def begin(i: Column) -> Column:
            """Starts whose first hit is the i-th."""
            need = F.when(F.get(p, i) + m <= size, F.ceil(m * (2 * least / (1 + least)) - 1e-9)).otherwise(F.ceil(m * least - 1e-9)).cast("int")
            last = F.get(p, i + need - 1)
            low = F.greatest(F.when(i > 0, F.get(p, F.greatest(i - 1, F.lit(0))) + 1).otherwise(0), last - m + 1)
            return F.when(last.isNotNull() & (low <= F.get(p, i)), F.sequence(F.least(low, F.get(p, i)), F.get(p, i))).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(p) - 1), begin))

    return F.get(F.transform(F.array(F.struct(at.alias("at"), n.alias("n"), size.alias("size"))), of), 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, radius: int = RADIUS, least: float = LEAST) -> DataFrame:
    """Leaks: doc_id, item_id, start_word (from 0), n_words, distance (bits), similarity; the best window of each pair."""
    items = benchmark.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    items = table(items.select("item_id", F.size(words(F.col("text"))).alias("n_words"), shingle_hashes(F.col("text"), k).alias("item")), "leak-bags").where("n_words > 0")
    items = table(items.withColumn("print", simhash(F.col("item"))), "leak-items")
    posts = items.select("item_id", F.size("item").alias("n"), F.explode(F.array_distinct("item")).alias("h")).groupBy("h").agg(F.collect_list(F.struct("item_id", "n")).alias("posts"))
    if (items.agg(F.sum(F.size("item")).alias("n")).first().n or 0) <= BROADCAST_ROWS:
        posts = F.broadcast(posts)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("v"), "text")
    hashed = keyed.select("doc_id", "v", shingle_hashes(F.col("text"), k).alias("doc"))
    # the outer form: the inner one would have the optimizer compute the hashes once more in a filter
    hits = hashed.select("doc_id", "v", F.size("doc").alias("size"), F.posexplode_outer("doc").alias("pos", "h")).join(posts, "h")
    hits = hits.select("doc_id", "v", "size", "pos", F.explode("posts").alias("p")).groupBy("doc_id", "v", "size", "p.item_id", "p.n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    starts = table(hits.where(F.size("at") >= F.col("n") * least - 1e-9).select("doc_id", "v", "item_id", "n", F.explode(window_starts(F.col("at"), F.col("n"), F.col("size"), least)).alias("start")), "leak-starts")
    per_doc = starts.groupBy(F.col("doc_id").alias("d"), "v").agg(F.collect_list(F.struct("item_id", "n", "start")).alias("w"))
    laid = keyed.join(per_doc.hint("merge"), keyed.doc_id.eqNullSafe(per_doc.d) & (keyed.v == per_doc.v)).select("doc_id", shingle_hashes(F.col("text"), k).alias("doc"), "w").select("doc_id", "doc", F.explode_outer("w").alias("w"))
    windows = laid.select("doc_id", "w.item_id", "w.start", F.slice("doc", F.col("w.start") + 1, F.col("w.n")).alias("window")).dropDuplicates(["doc_id", "item_id", "start", "window"])
    printed = table(windows.select("*", simhash(F.col("window")).alias("wprint"), F.monotonically_increasing_id().alias("wid")), "leak-windows")
    mine = printed.select("wid", "item_id", "wprint", F.explode(blocks(F.col("wprint"), radius)).alias("b")).select("*", "b.block", "b.value")
    theirs = items.select("item_id", "print", F.explode(blocks(F.col("print"), radius)).alias("b")).select("item_id", "print", "b.block", "b.value")
    near = mine.join(theirs, ["item_id", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("wprint"))) <= radius)
    sure = printed.join(near.select("wid").distinct(), "wid")
    scored = sure.join(items, "item_id").select("doc_id", "item_id", "start", "n_words", F.bit_count(F.col("print").bitwiseXOR(F.col("wprint"))).alias("distance"), weighted_jaccard(F.col("window"), F.col("item")).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("doc_id", "item_id", "n_words").agg(F.max(F.struct("similarity", -F.col("start"), "distance")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.col2")).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), F.col("b.distance").cast("long").alias("distance"), F.round("b.similarity", 6).alias("similarity"))
