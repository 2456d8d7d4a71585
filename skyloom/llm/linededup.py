"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A text is split at \\n. Its lines with a word are hashed, and a hash rolls over every two neighbours of them. A place where
this rolling hash is not larger than all others within ``REACH`` places is a boundary: what is chosen depends on the lines
around it alone, so inserted or removed lines elsewhere shift no boundary. The chunk at a boundary is the two lines of the
window with the blank lines between them. A chunk that occurs more than once in the whole table stays at its first place
(smallest doc_id, then position); elsewhere it is removed, and so is each neighbouring line (up to the next one with a
word) that the first place has at the same side: a place that is no boundary has boundaries on both sides, so a match that
grows over one line on either side is whole. Chunk hashes find candidates; only equal bytes are removed, and the first
occurrence of a line never is, as what removes a line stands at an earlier place.

A passage that stands at two places between other lines goes whole from the second if it has three lines with a word or
more: the smaller of two neighbouring rolling hashes is a boundary in any surroundings. It can lose less where a part of it
stands still earlier between other lines, as a match grows by what its chunk's first place has. One of two lines is found if
it is a boundary in both its places. With ``every``, each window is a chunk, a boundary or not: no two neighbouring lines with
a word stay that stand earlier. A line that repeats alone, with other lines around it, stays; so do the blank lines around a chunk.

Results: the columns of the input, with ``text`` rebuilt from the lines that stay and ``n_chars`` (if there is one)
counted anew, plus n_lines, n_removed_lines and n_removed_chunks (long; runs of removed lines). Nulls: a null text stays
null, with 0 lines. A null doc_id counts as larger than all others. Rows with the same doc_id and text are one document:
they get the same result, and none takes lines from the other. Very long texts are split whole; ties of a place cannot be,
as equal places are one document; an empty table gives an empty result. Other columns are carried through under their own
names; a column named like one of the three counts gives way to it, or stays where ``counts`` is false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import drop_table, release, table

#: Places on either side among which the largest rolling hash is no boundary.
REACH = 2
#: The rolling hash of the line hashes a, b: (a * STEP + b) % PRIME.
STEP, PRIME = 1_103_515_245, 4_294_967_291
#: A chunk that occurs more often is met in so many parts.
HOT, PARTS = 256, 32
#: Stands for a null doc_id.
LAST = (1 << 63) - 1
_WORD = r"[^\x20\x09-\x0D]"


def once(x: Column, f) -> Column:
    """f(x) with x made once."""
    return F.get(F.transform(F.array(x), f), 0)


def with_lines(text: Column, f) -> Column:
    """``f`` of the lines of a text, which are made once."""
    return once(F.split(text, "\n"), f)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def boundaries(lines: Column) -> Column:
    """Array of (k0, k1, k2, k3) for each boundary: the lines of its chunk are k1 to k2, and k0 and k3 the next lines with a
    word before and after them (-1 if there is none)."""
    return windows(lines, every=False)


def windows(lines: Column, every: bool) -> Column:
    """What :func:`boundaries` gives, for boundaries or for every window."""
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_WORD), F.struct(i.alias("k"), line_hash(x).alias("h")))), lambda x: x.isNotNull())

    def rolled(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda j: j < F.size(w))
        r = F.transform(at, lambda j: (F.get(w, j - 1)["h"] * STEP + F.get(w, j)["h"]) % PRIME)
        return once(r, lambda r: F.filter(F.transform(at, lambda j: chosen(w, r, j)), lambda x: x.isNotNull()))

    def chosen(w: Column, r: Column, j: Column) -> Column:
        other = lambda d: F.when(j - 1 + d >= 0, F.get(r, F.greatest(j - 1 + d, F.lit(0))))
        largest = F.greatest(*[other(d) for d in range(-REACH, REACH + 1) if d])  # null without neighbours
        line = lambda i: F.coalesce(F.when(i >= 0, F.get(w, F.greatest(i, F.lit(0)))["k"]), F.lit(-1)).cast("int")
        place = F.struct(line(j - 2).alias("k0"), line(j - 1).alias("k1"), line(j).alias("k2"), line(j + 1).alias("k3"))
        return place if every else F.when(largest.isNull() | (F.get(r, j - 1) <= largest), place)

    return once(worded, rolled)


def joined(lines: Column, a: Column, b: Column) -> Column:
    """Lines a to b (not included) as text; null if there are none."""
    return F.when(b > a, F.array_join(F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))), "\n"))


def line_dedup(docs: DataFrame, counts: bool = True, every: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without repeated chunks (at boundaries, or every window of two lines), with or
    without the counts; see the module's text."""
    spark, names = docs.sparkSession, docs.columns
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_v"), F.struct(*names).alias("_doc"))
    chunks = with_lines(F.col("_doc.text"), lambda x: once(windows(x, every), lambda c: F.transform(c, lambda c: F.struct(c.alias("_c"), F.xxhash64(joined(x, c["k1"], c["k2"] + 1)).alias("_h")))))
    each = rows.select("_id", "_v", F.explode_outer(chunks).alias("_s")).where("_s is not null")
    hashed = table(each.select("_id", "_v", "_s._c", "_s._h"), "lines-hashes")
    place = F.struct(F.col("_id").alias("a"), F.col("_v").alias("b"), F.col("_c.k1").alias("c"), F.col("_c.k2").alias("d"))
    again = hashed.groupBy("_h").agg(F.count("*").alias("n"), F.min(place).alias("_f")).where("n > 1")
    own = (F.col("_id") == F.col("_f.a")) & (F.col("_v") == F.col("_f.b"))
    part = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("_id", "_v"), F.lit(PARTS))).otherwise(-1).cast("int")
    wanted = hashed.join(again, "_h").select("_id", "_v", F.struct("_c.*", own.alias("own"), part.alias("part")).alias("_c")).distinct()
    # Byte comparison: the bytes of every candidate, and of the lines beside it, meet those of the same chunk.
    per_row = wanted.groupBy("_id", "_v").agg(F.sort_array(F.collect_list("_c")).alias("_want"))
    texts = rows.select("_id", "_v", F.col("_doc.text").alias("_text")).join(per_row.hint("merge"), ["_id", "_v"])

    def bytes_of(lines: Column) -> Column:
        def beside(c: Column, other: Column, line: Column, covers: Column, text: Column) -> Column:
            """Bytes of the lines beside a chunk, but where another chunk removes all of them anyway (of every window, always)."""
            return F.lit(None).cast("string") if every else F.when((line >= 0) & (c["own"] | ~F.coalesce(covers & ~other["own"], F.lit(False))), text)

        def one(c: Column, i: Column) -> Column:
            last, next_ = F.get("_want", F.when(i > 0, i - 1)), F.get("_want", i + 1)
            before = beside(c, last, c["k0"], (last["k2"] >= c["k1"]) | ((last["k2"] == c["k0"]) & (c["k0"] + 1 == c["k1"])), joined(lines, c["k0"], c["k1"]))
            after = beside(c, next_, c["k3"], (next_["k1"] <= c["k2"]) | ((next_["k1"] == c["k3"]) & (c["k2"] + 1 == c["k3"])), joined(lines, c["k2"] + 1, c["k3"] + 1))
            return F.struct(c.alias("_c"), joined(lines, c["k1"], c["k2"] + 1).alias("_text"), before.alias("_before"), after.alias("_after"))

        return F.transform("_want", one)

    found = table(texts.select("_id", "_v", F.explode_outer(with_lines(F.col("_text"), bytes_of)).alias("_w")).select("_id", "_v", "_w.*"), "lines-found")
    drop_table(hashed)
    release(spark)
    first = found.groupBy("_text").agg(F.min(place).alias("_first"), F.min_by("_before", place).alias("_before1"), F.min_by("_after", place).alias("_after1"), F.count("*").alias("n"), F.max("_c.part").alias("_hot")).where("n > 1")
    # the first place of a frequent chunk goes to each part of its occurrences
    parts = F.when(F.col("_hot") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    later = found.withColumn("_part", F.col("_c.part")).join(first.withColumn("_part", F.explode(parts)), ["_text", "_part"]).where(place != F.col("_first"))
    low = F.when(F.col("_before") == F.col("_before1"), F.col("_c.k0")).otherwise(F.col("_c.k1"))
    high = F.when(F.col("_after") == F.col("_after1"), F.col("_c.k3")).otherwise(F.col("_c.k2"))
    # a chunk that overlaps its own first place takes nothing from it
    own = (F.col("_id") == F.col("_first.a")) & (F.col("_v") == F.col("_first.b"))
    lines = F.explode(F.sequence(F.when(own, F.greatest(low, F.col("_first.d") + 1)).otherwise(low), high)).alias("_l")
    drops = table(later.select("_id", "_v", lines).groupBy("_id", "_v").agg(F.collect_set("_l").alias("_drop")), "lines-drops")
    drop_table(found)
    release(spark)
    both = rows.join(drops.hint("merge"), ["_id", "_v"], "left").select("_doc", F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"))
    stay = with_lines(F.col("_doc.text"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_drop"), lambda i: F.get(x, i)))
    text = F.when(F.size("_drop") > 0, F.array_join(stay, "\n")).otherwise(F.col("_doc.text"))
    n_runs = F.size("_drop") - F.size(F.array_intersect("_drop", F.transform("_drop", lambda i: i + 1)))
    out = {"text": text, "n_chars": F.length(text).cast("long")}
    extra = [F.when(F.col("_doc.text").isNull(), 0).otherwise(F.size(F.split("_doc.text", "\n"))).cast("long").alias("n_lines"), F.size("_drop").cast("long").alias("n_removed_lines"), n_runs.cast("long").alias("n_removed_chunks")]
    taken = ("n_lines", "n_removed_lines", "n_removed_chunks") if counts else ()
    kept = [out.get(c, F.col("_doc")[c]).alias(c) for c in names if c not in taken]
    return both.select(*kept, *(extra if counts else []))
