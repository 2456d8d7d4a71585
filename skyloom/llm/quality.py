"""Quality rules: base counts plus distribution divergence against language references. DataFrame functions only.

Words are ``[^\\x20\\x09-\\x0D]+``. Base rule: a document fails when it has under 50 words, or when over half of
its words stand in 3-word windows that occur twice or more in it (the first occurrence included).

Divergence: the histogram of character classes (lower case, upper case, digit, white space, symbol, other ASCII,
other) and the histogram of the language's common words (each of the listed words, and all others) are compared with
the reference of the document's language by Jensen-Shannon distance (base 2, 0 to 1). A language's reference is the
sum over all its documents that pass the base rule, null being a language, too; how many languages there are does not matter.
A language with fewer than ``LEAST_DOCS`` such documents would be compared with itself, and is compared with the pooled
reference of all languages instead: with classes that do not depend on the script (letters of any kind as one), a wider
threshold, and without a word verdict. Guards: a text under ``MIN_CHARS`` characters has no character verdict, one under
``MIN_WORDS`` words no word verdict; nor have languages without a word list the latter.

Nulls: a null text counts as empty (no words: it fails the base rule). A null doc_id or language is kept as it is.
Ties: a distance equal to its threshold passes. Very long texts are counted whole. Rows are judged one by one, so
repeated rows come out as often as they come in (and count as often in the reference); an empty table gives an empty
result. Columns to carry whose names are also those of a result give way to the result; others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import SPACE, table

#: Frequent function words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
MIN_CHARS, MIN_WORDS = 400, 120
#: Fewest documents of a language's own reference; most references that are broadcast (about 200 bytes each), more are joined.
LEAST_DOCS, LANGUAGES = 20, 100_000
MAX_CHAR_DISTANCE, MAX_POOLED_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.4, 0.293
#: Character classes by what is deleted to count them.
CLASSES = ["a-z", r"\x20\x09-\x0D", "A-Z", "0-9", r"#*$%&|<>", r"\x00-\x08\x0E-\x1F!\x22'-)+-/:;=?@\x5B-\x60{}~\x7F"]
#: Classes (by their place, the last being all others) that the pooled reference takes together.
POOLED = [[0, 2, 6], [1], [3], [4], [5]]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def once(x: Column, f) -> Column:
    """f(x) with x made once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


#: Up to so many repeated windows of a text are looked up one by one; more are found by a sort with positions.
FEW = 64


def repeated_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Equal windows become neighbours by a sort of their hashes."""
    h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    some = F.when(F.size(w) > 3, h).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def few(h: Column, again: Column) -> Column:
        return covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull()))

    def many(h: Column) -> Column:
        def starts(s: Column) -> Column:
            same = F.transform(s, lambda x, k: F.when((x.h == F.get(s, k + 1).h) | ((k > 0) & (x.h == F.get(s, F.greatest(k - 1, F.lit(0))).h)), x.i))
            return covered(F.filter(same, lambda x: x.isNotNull()))

        return once(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), starts)

    def repeats(h: Column) -> Column:
        sort = once(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        return once(sort, lambda again: F.when(F.size(again) <= FEW, few(h, again)).otherwise(many(h)))

    return once(some, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeats(h)))


def char_histogram(t: Column) -> Column:
    """Characters of each class in the order of CLASSES, then of all others. Each class is cut out of what the one
    before has left, so only the first goes through the whole text."""

    def rest(left: Column, at: int) -> Column:
        if at == len(CLASSES):
            return F.array(F.length(left).cast("double"))
        cut = F.regexp_replace(left, f"[{CLASSES[at]}]+", "")
        return once(cut, lambda c: F.concat(F.array((F.length(left) - F.length(c)).cast("double")), rest(c, at + 1)))

    return rest(t, 0)


def word_histogram(w: Column, g: Column) -> Column:
    """Counts of the language's common words (in the list's order), then of all other words; else no entry."""
    def counted(listed: list[str]) -> Column:
        def by_word(common: Column) -> Column:
            return F.array(*[F.size(F.filter(common, is_word(v))).cast("long") for v in listed])

        common = F.filter(F.transform(w, F.lower), lambda x: x.isin(listed))
        counts = F.get(F.transform(F.array(common), by_word), 0)
        rest = F.size(w) - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.concat(counts, F.array(rest.cast("long")))

    def is_word(v: str):
        return lambda x: x == v

    out = F.array().cast("array<bigint>")
    for lang, listed in COMMON.items():
        out = F.when(g == lang, counted(listed)).otherwise(out)
    return out


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (square root of the divergence in bits) of two arrays of counts; 0 if one of them is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    sp, sq = total(p), total(q)
    js = total(F.transform(F.arrays_zip(p.alias("p"), q.alias("q")), lambda z: (term(z["p"] / sp, (z["p"] / sp + z["q"] / sq) / 2) + term(z["q"] / sq, (z["p"] / sp + z["q"] / sq) / 2)) / 2))
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(js, F.lit(0.0)))).otherwise(0.0)


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts and both histograms of every row, with the columns ``keep`` in one struct: made once, then read twice."""
    t = F.coalesce(F.col("text"), F.lit(""))
    g = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    f = docs.select(F.struct(*keep).alias("carried"), t.alias("t"), words_of(t).alias("w"), g.alias("g"))
    t, w = F.col("t"), F.col("w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return f.select(
        "carried",
        "g",
        F.size(w).cast("long").alias("n_words"),
        F.length(t).cast("long").alias("n_chars"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
        char_histogram(t).alias("hc"),
        word_histogram(w, F.col("g")).cast("array<double>").alias("hw"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(feats: DataFrame) -> DataFrame:
    """A row per language: its documents that pass the base rule, and the sums of both histograms over them."""
    n_c, n_w = len(CLASSES) + 1, max(map(len, COMMON.values())) + 1
    sums = [F.sum(F.get("hc", F.lit(i))).alias(f"c{i}") for i in range(n_c)] + [F.sum(F.get("hw", F.lit(i))).alias(f"w{i}") for i in range(n_w)]
    s = feats.where(~base_failed()).groupBy("g").agg(F.count("*").alias("docs"), *sums)
    return s.select(F.col("g").alias("rg"), "docs", F.array(*[f"c{i}" for i in range(n_c)]).alias("rc"), F.filter(F.array(*[f"w{i}" for i in range(n_w)]), lambda x: x.isNotNull()).alias("rw"))


def pooled(h: Column) -> Column:
    """A character histogram by classes that do not depend on the script."""
    return F.array(*[sum((F.get(h, F.lit(i)) for i in part), F.lit(0.0)) for part in POOLED])


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """Two structs for every row: ``carried`` with the columns ``keep``, ``judged`` with the counts and verdicts."""
    feats = table(features(docs, *keep), "quality-features")
    refs = table(references(feats), "quality-references")
    world = refs.agg(*[F.coalesce(F.sum(F.get("rc", F.lit(i))), F.lit(0.0)).alias(f"a{i}") for i in range(len(CLASSES) + 1)])
    world = world.select(pooled(F.array(*world.columns)).alias("wc"))
    own = refs.where(F.col("docs") >= LEAST_DOCS).select("rg", "rc", "rw")
    own = F.broadcast(own) if own.limit(LANGUAGES + 1).count() <= LANGUAGES else own
    d = feats.join(own, F.col("g") == F.col("rg"), "left").crossJoin(F.broadcast(world))  # one row
    alone = F.col("rg").isNull()
    long = F.col("n_chars") >= MIN_CHARS
    char = F.when(long & alone, jensen_shannon(pooled(F.col("hc")), F.col("wc"))).when(long, jensen_shannon(F.col("hc"), F.col("rc")))
    word = F.when(~alone & (F.col("n_words") >= MIN_WORDS) & (F.size("hw") > 0), jensen_shannon(F.col("hw"), F.col("rw")))
    most = F.when(alone, MAX_POOLED_DISTANCE).otherwise(MAX_CHAR_DISTANCE)
    near = (F.coalesce(char, F.lit(0.0)) <= most) & (F.coalesce(word, F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return d.select(
        "carried",
        F.struct(
            "n_words",
            (F.col("n_chars") - F.get("hc", F.lit(1))).cast("long").alias("word_chars"),
            F.get("hc", F.lit(4)).cast("long").alias("n_symbols"),
            "n_dup_lines",
            "n_repeat_words",
            base_failed().alias("base_failed"),
            (~base_failed() & near).alias("kept"),
            F.round(char, 6).alias("char_distance"),
            F.round(word, 6).alias("word_distance"),
        ).alias("judged"),
    )


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def quality(docs: DataFrame, *keep: str) -> DataFrame:
    """Counts and verdicts for every row; ``keep``: columns of ``docs`` to carry along (doc_id if none are named)."""
    return judged(docs, *([c for c in keep if c not in RESULTS] or ["doc_id"])).select("carried.*", "judged.*")
