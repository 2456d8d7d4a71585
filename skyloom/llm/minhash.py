"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

Texts are lower-cased (A-Z only), split on ASCII white space and turned into distinct k-word shingles (a text with
fewer words is one shingle; without words it is empty and linked with nothing). Two documents are linked when
``den * intersection >= num * union`` of their sets.

1. Documents with the same set collapse into one class (its smallest doc_id), so copies never form pairs.
2. A SuperMinHash signature per class: every element walks through its own permutation of the components and offers
   ``rank + fraction``; a document stops as soon as no later rank can lower its signature.
3. Bands of the signature are bucket keys. In each bucket all members are compared with one centre at a time
   (a star, not all pairs): first the smallest id, then other centres from the largest component of the bucket.
   What is still outside its bucket's largest component is at last compared with the members of other components by
   an exact prefix filter: sets that are similar enough share one of their rarest shingles. So no link between
   components is lost that shares a bucket, and texts that merely resemble a large group form no pairs with it.
4. Every link is verified on the full sets; components are found by distributed union-find.

With ``bands=40, rows=5`` a pair at similarity 0.8 shares no bucket with probability 1e-7.

Nulls: a null text counts as no words; a null doc_id is returned, unlinked, with a null component and kept = true.
Repeated rows are returned as often as they come, as members of one group; rows of one doc_id count as one document.
Ties: of equal sets the smallest doc_id stands for all. Very long texts are shingled whole, in parts. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import U, connected_components, drop_table, merge_components, mix, table

BANDS, ROWS = 40, 5
#: 64-bit words of the parity sketches that bound the difference of two sets from below.
PARITY = 8
#: Elements that are signed at once; their permutations take this many times BANDS * ROWS bytes.
CHUNK = 150_000


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit k-word shingle hashes of a text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), U)
    for i in range(min(k, len(h))):
        out = mix(out + h[i : i + n] * U(2 * i + 0x9E3779B97F4A7C15))
    return np.unique(out)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (len(sets), m) of non-empty sets: uint32 values of rank * 2**24 + 24 random bits."""
    size = np.array([len(s) for s in sets])
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    sig = np.full(len(sets) * m, 0xFFFFFFFF, np.uint32)
    perm = None
    for j in range(m):
        r = mix(h + U((j + 1) * 0xD1B54A32D192ED03 % 2**64))
        k = j + (((r & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.intp)
        value = ((r >> U(40)) + U(j << 24)).astype(np.uint32)
        if perm is None:
            where = k
        else:
            rows = np.arange(len(h))
            where = perm[rows, k].astype(np.intp)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, owner * m + where, value)
        alive = sig.reshape(-1, m).max(1) > np.uint32(min((j + 1) << 24, 0xFFFFFFFF))
        keep = alive[owner]
        if j + 1 == m or not keep.any():
            break
        h, owner = h[keep], owner[keep]
        if perm is None:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(h), m)).copy()
            perm[np.arange(len(h)), k[keep]] = 0
        else:
            perm = perm[keep]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=U), (len(sig), 1))
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(U)
    for i in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out.view(np.int64)


def _sign(k: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < len(ids):
                sets, total, first = [], 0, at
                while at < len(ids) and total < CHUNK:
                    sets.append(shingles(texts[at].as_py(), k))
                    total += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(superminhash(full, bands * rows), bands, rows) if full else [])
                with np.errstate(over="ignore"):
                    d1 = [int(mix(s).sum(dtype=U).view(np.int64)) if len(s) else None for s in sets]
                    d2 = [int(mix(s + U(77)).sum(dtype=U).view(np.int64)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, at - first).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(d1, pa.int64()),
                        pa.array(d2, pa.int64()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "d1", "d2", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for at in range(0, len(ids), 500):
                out = [shingles(t.as_py(), k).tobytes() for t in texts.slice(at, 500)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500).cast(pa.int64()), pa.array(out, pa.binary())], names=["node", "s"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _grams(batches):
    for b in batches:
        for at in range(0, len(b), 100):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1).slice(at, 100)]
            size = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).slice(at, 100).to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets))], names=["node", "n", "g"])


def _lead(num: int, den: int):
    """Prefix entries of sets (node, n, g: the shingles that others have, rarest first): how many shingles stand before one,
    and one bit for each residue of those after it: is their number odd?"""

    def run(batches):
        for b in batches:
            for node, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                g = x.values.to_numpy().view(U)
                alone = n - len(g)
                k = min(len(g), max(0, n + (-num * n // den) + 1 - alone))
                bit = ((g >> U(17)) % U(64 * PARITY)).astype(np.intp)
                odd = (np.bincount(bit, minlength=64 * PARITY) & 1).astype(np.uint8)
                for at in range(0, k, 1000):
                    some = bit[at : min(k, at + 1000)]
                    gone = np.zeros((len(some), 64 * PARITY), np.uint8)
                    gone[np.arange(len(some)), some] = 1
                    left = np.bitwise_xor.accumulate(gone, axis=0) ^ odd
                    odd = left[-1]
                    words = np.packbits(left, axis=1).view(np.int64)
                    w = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, PARITY, dtype=np.int32)), pa.array(words.ravel()))
                    fixed = [pa.array(np.full(len(some), v, np.int64)) for v in (node, n)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(g[at : at + len(some)].view(np.int64)), pa.array(alone + at + np.arange(len(some)), pa.int64()), w], names=["node", "n", "g", "before", "w"])

    return run


def meetings(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that can reach the similarity, b outside the largest one of a bucket.

    ``members`` (rep, component, top) are bucket entries, ``sets`` (node, s) their shingles. Sets with the similarity
    share at least ceil(similarity * n) of n shingles, so in any common order their first n - ceil(similarity * n) + 1
    shingles meet. The order is by number of sets, rarest first; shingles of one set alone meet nothing. A meeting counts
    only if it can be the first one of a similar pair: there all shingles before it, in either set, are in one of the two
    alone, and the parity sketches of those after it differ in at most as many bits as those do in shingles. The sum bounds
    the difference from below, so this loses nothing, and later meetings of a pair seldom count again.
    """
    part = members.groupBy(F.col("rep").alias("node"), "component").agg(F.max(F.col("component") != F.col("top")).alias("out"))
    mine = sets.join(part.select("node"), "node", "left_semi")
    grams = mine.mapInArrow(_grams, "node long, n long, g long")
    common = grams.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
    held = grams.join(common, "g").groupBy("node", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "g"))), lambda x: x["g"]).alias("s"))
    lead = table(held.select("node", "n", "s").mapInArrow(_lead(num, den), "node long, n long, g long, before long, w array<long>").join(part, "node"), "mh-lead")
    a, b = (lead.select("g", *[F.col(c).alias(c + "_" + side) for c in ("node", "n", "component", "out", "before", "w")]) for side in "ab")
    fits = f"component_a <> component_b and (not out_a or node_a < node_b) and {den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"
    differ = " + ".join(f"bit_count(w_a[{i}] ^ w_b[{i}])" for i in range(PARITY))
    near = f"{den + num} * (before_a + before_b + {differ}) <= {den - num} * (n_a + n_b)"
    return a.join(b.where("out_b"), "g").where(fits).where(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def rare_first_pairs(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct pairs of :func:`meetings`."""
    return meetings(members, sets, num, den).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS, stars: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text); see the module's text.

    ``num / den``: least similarity. ``stars``: rounds with one further centre per bucket before the last, full one.
    """
    docs = docs.select("doc_id", "text")
    signed = table(docs.mapInArrow(_sign(k, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "mh-signed")
    real = signed.where("n > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"))
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("centre")).where("members > 1")
    # A bucket whose members do not differ in id holds no pair.
    bucket = table(keyed.join(shared, "key").select("key", "rep", "n", "centre").distinct(), "mh-buckets")
    nodes = table(bucket.select(F.col("rep").alias("node")).distinct(), "mh-nodes")
    sets = table(docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(_sets(k), "node long, s binary").where("length(s) > 0").distinct(), "mh-sets")
    size_ok = f"{den} * least(n, nb) >= {num} * greatest(n, nb)"

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sa, sb = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        return table(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_verify(num, den), "a long, b long"), name)

    def link(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        edges = verified(pairs, "mh-links")
        out = merge_components(labels, edges, "mh")
        drop_table(edges)
        return out

    labels = table(nodes.select("node", F.col("node").alias("component")), "mh-labels")
    # One centre for each class first (its smallest), then its other buckets' centres as far as they still tell something.
    stars_all = bucket.where("rep <> centre").groupBy(F.col("rep").alias("b"), F.col("centre").alias("a")).agg(F.count("*").alias("times"))
    labels = link(labels, stars_all.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")))
    la, lb = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    labels = link(labels, stars_all.join(la, "a").join(lb, "b").where("ca <> cb").select("a", "b"))
    for turn in range(stars + 1):
        held = bucket.join(labels, bucket.rep == labels.node).select("key", "rep", "n", "centre", "component")
        sized = held.groupBy("key", "component").agg(F.count("*").alias("c"), F.max_by("rep", F.xxhash64("rep", F.lit(turn))).alias("other"), F.max_by("n", F.xxhash64("rep", F.lit(turn))).alias("nb"))
        per = sized.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("all"), F.max_by(F.struct("component", "other", "nb"), F.struct("c", F.col("component"))).alias("top")).where("parts > 1 and all > 2")
        open_ = held.join(per.select("key", F.col("top.component").alias("top"), F.col("top.other").alias("other"), F.col("top.nb").alias("nb")), "key")
        small = open_.where("component <> top")
        if turn < stars:
            pairs = small.where("rep <> centre and other <> centre and " + size_ok).groupBy(F.col("rep").alias("b")).agg(F.max_by("other", F.xxhash64("other", F.lit(turn))).alias("a"))
        else:
            pairs = rare_first_pairs(open_, sets, num, den)
        labels = link(labels, pairs)
    drop_table(bucket)
    drop_table(sets)
    drop_table(nodes)
    found = classes.join(labels, classes.rep == labels.node, "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("c"))
    joined = real.select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2", "n"]).select("doc_id", "n", "c")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("c"))
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))
