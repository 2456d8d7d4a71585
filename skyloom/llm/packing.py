"""Best-fit packing by minimum bin slack.

Every document becomes token ids (byte-level BPE, then the end id); only documents over ``size`` tokens are cut, into
pieces of ``size``, the first piece holding the remainder. How many pieces have each length is a table of at most
``size`` rows whatever the corpus holds, and all the packing needs: a bitset subset-sum over the lengths at hand finds
the fullest feasible combination with the longest one, which is removed as often as the counts allow, until nothing is
left. Each such step uses up a length, so the plan has a few thousand rows at most. Pieces are then numbered within
their length (in salted parts, so a hot length spreads over many tasks) and look up their place in the plan.

Ids come from the rank file of the byte-level BPE vocabulary, whose path is a parameter (a file on every worker, as
installed with the tokenizer package); the tests hold them against the vocabulary's other form, read by ``tokenizers``.

Nulls: a null text counts as empty (one piece with the end id). A null doc_id is packed like any other. Repeated rows
are packed as often as they come. Very long texts are encoded whole and cut; ties: which of the pieces of one length takes
which place is free, lengths and counts decide the plan. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import partitions, table

SIZE, END = 1024, 2
#: The splitting pattern and the special token of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Texts -> little-endian 32-bit ids. One per worker process, by :func:`encoder`."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in SPECIAL):
            ids = self.bpe.encode(text, allowed_special="all")
        else:
            ids = self.bpe.encode_ordinary(text)
        return array("I", ids).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, size: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_pylist()
            for at in range(0, len(ids), 256):
                out = []
                for doc, buf in zip(ids[at : at + 256], (enc.encode(t.as_py() or "") for t in b.column(1).slice(at, 256))):
                    buf += tail
                    n = len(buf) // 4
                    k = -(-n // size)
                    first = n - (k - 1) * size
                    for i in range(k):
                        lo, hi = (0, first) if i == 0 else (first + (i - 1) * size, first + i * size)
                        part = buf[4 * lo : 4 * hi]
                        out.append((doc, i, lo, hi - lo, zlib.crc32(part)) + ((part,) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    return run


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, copies, sequence_from, offset_from): where the pieces of each length go.

    The piece of a length with rank r in [rank_from, rank_to) goes to sequence_from + (r - rank_from) // copies, at
    offset_from + (r - rank_from) % copies * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    order = sorted(left, reverse=True)
    while order:
        seed = order[0]
        room = size - seed
        reach, steps = 1, []
        mask = (1 << (room + 1)) - 1
        for n in order:
            most = min((left[n] - (n == seed)), room // n)
            part = 1
            while most > 0 and not reach >> room & 1:
                part = min(part, most)
                steps.append((n, part, reach))
                reach |= reach << n * part & mask
                most -= part
                part *= 2
            if reach >> room & 1:
                break
        take = {seed: 1}
        at = reach.bit_length() - 1
        for n, part, before in reversed(steps):
            if not before >> at & 1:
                take[n] = take.get(n, 0) + part
                at -= n * part
        times = min(left[n] // c for n, c in take.items())
        offset = 0
        for n, c in take.items():
            rows.append((n, used[n], used[n] + c * times, c, sequence, offset))
            offset += c * n
            used[n] += c * times
            left[n] -= c * times
        sequence += times
        order = [n for n in order if left[n]]
    return rows


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path, size, end, with_ids), schema)
    pieces = table(pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")), "pack-pieces")
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("c"))  # at most size * parts rows
    before = sizes.select("length", "part", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {r.length: r.c for r in sizes.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most size rows
    rows = spark.createDataFrame(plan(counts, size), "pl long, lo long, hi long, copies long, s0 long, o0 long")
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "part"])  # both sides are dealt by these keys already
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r"))
    placed = ranked.join(F.broadcast(rows), (F.col("length") == F.col("pl")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids),
        (F.col("s0") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("o0") + k % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )
