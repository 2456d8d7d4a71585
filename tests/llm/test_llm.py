"""The corpus operators against brute force on small tables, with nulls, empty texts, ties, repeats and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Nulls in any column, empty and long texts, repeated rows, clashing extra columns."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1) for r in docs.limit(12).collect()]
    rows = [*base, base[0], (900, base[1][1], None, None, None, None, None), (901, None, None, None, None, None, None), (902, "", "en", "s", 0, "x", 1), (None, base[2][1], "en", "s", 1, "x", 1), (903, " \n\t ", "xx", "s", 1, "x", 1), (904, "word " * 30_000, "en", "s", 1, "x", 1), (905, "one", "de", "s", 1, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_quality(odd, empty):
    from skyloom.llm.quality import quality

    def want(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality(odd).collect())
    assert got == Counter((i, *want(t)) for i, t in texts(odd))
    assert quality(empty).count() == 0


def test_quality_verdict(odd, docs, spark):
    """Distances and verdicts against references summed up in Python: those of languages with enough documents that pass,
    null too, and the pooled one for all others."""
    from skyloom.llm.quality import COMMON, LEAST_DOCS, MAX_CHAR_DISTANCE, MAX_POOLED_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, POOLED, quality

    def histograms(t, lang):
        c = [0] * 7
        for x in t:
            c[0 if "a" <= x <= "z" else 1 if x in " \t\n\x0b\x0c\r" else 2 if "A" <= x <= "Z" else 3 if "0" <= x <= "9" else 4 if x in "#*$%&|<>" else 5 if ord(x) < 128 else 6] += 1
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        listed = COMMON.get(lang, [])
        counts = [w.count(v) for v in listed]
        return c, ([*counts, len(w) - sum(counts)] if listed else []), len(w)

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return math.sqrt(max(0.0, (np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()) / 2))

    prose = [t for _, t in texts(docs) if t and len(t) > 500]
    many = [(100 + i, prose[i % len(prose)], g) for g in (None, "zz") for i in range(30)]
    other = spark.createDataFrame([(1, "ÄÖ " * 300, "xx"), (2, "word and " * 200, "xx"), (3, "word and " * 200, None), (4, " ".join("".join("#*$%&|<>"[k >> 3 * j & 7] for j in range(3)) for k in range(300)), "qq"), *many], "doc_id long, text string, lang string")
    for df in (docs, odd, other):
        rows = [(r.doc_id, r.text or "", r.lang or "") for r in df.select("doc_id", "text", "lang").collect()]
        failed = Counter((r.doc_id, r.lang or "", r.base_failed) for r in quality(df, "doc_id", "lang").collect())
        made = [(i, t, g, *histograms(t, g)) for i, t, g in rows]
        sums, world = {}, np.zeros(7)
        for i, t, g, c, w, _ in made:
            if not failed[i, g, True]:
                a, b, n = sums.setdefault(g, [np.zeros(7), np.zeros(len(w)), 0])
                a += c
                b += w
                world += c
                sums[g][2] = n + 1
        own = {g for g, (_, _, n) in sums.items() if n >= LEAST_DOCS}
        pool = lambda c: [sum(c[k] for k in part) for part in POOLED]
        want = {}
        for i, t, g, c, w, n in made:
            char = distance(c, sums[g][0]) if g in own else distance(pool(c), pool(world))
            word = distance(w, sums[g][1]) if g in own and n >= MIN_WORDS and w else None
            want.setdefault(i, []).append((char if len(t) >= MIN_CHARS else None, word, MAX_CHAR_DISTANCE if g in own else MAX_POOLED_DISTANCE))
        got = quality(df, "doc_id", "lang").collect()
        assert len(got) == len(rows)
        same = lambda x, y: x is y if x is None or y is None else abs(x - y) < 2e-6
        for r in got:
            found = next(p for p in want[r.doc_id] if same(p[0], r.char_distance) and same(p[1], r.word_distance))
            want[r.doc_id].remove(found)
            assert r.kept == (not r.base_failed and (found[0] or 0) <= found[2] and (found[1] or 0) <= MAX_WORD_DISTANCE)
        if df is other:
            assert "zz" in own and "" in own and "qq" not in own
            assert [r.kept for r in got if r.lang == "qq"] == [False] and not next(r for r in got if r.lang == "qq").base_failed


def components(rows, k, num=4, den=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids, parent = sorted(x for x in sets if x is not None), {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i) if i is not None else None) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, odd, empty, k):
    from skyloom.llm.minhash import near_duplicates

    for df in (docs, odd):
        want = components(texts(df), k)
        got = near_duplicates(df, k=k).collect()
        assert len(got) == df.count()
        assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_chain(spark):
    """A chain whose ends are not similar is one group; no link may hang on the choice of a centre."""
    from skyloom.llm.minhash import near_duplicates

    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i : i + 40])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 1).items()} and set(got.values()) == {0}


def test_superminhash_estimates():
    from skyloom.llm.minhash import superminhash

    rng = np.random.default_rng(1)
    x = rng.integers(1, 2**63, 900).astype(np.uint64)
    sig = superminhash([np.sort(x[:600]), np.sort(x[300:])], 200)
    assert abs((sig[0] == sig[1]).mean() - 300 / 900) < 0.12


def test_decontamination(spark, docs, odd, empty):
    from skyloom.llm.decontam import decontaminate

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    want = {(i, k) for i, t in texts(docs) for k, v in items.items() if norm(v) in norm(t)}
    got = {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()}
    assert want and got == want
    words = items[min(items)].split()
    near = [(1, "x y z " + " ".join([*words[:6], "changed", *words[7:]]) + " tail of it"), (2, " ".join(words[:5])), (None, items[min(items)]), (4, None), (4, "")]
    r = decontaminate(spark.createDataFrame(near, "doc_id long, text string"), bench).collect()
    assert None in {x.doc_id for x in r} and {x.doc_id for x in r} <= {None, 1}
    assert decontaminate(empty, bench).count() == 0 and decontaminate(odd, bench.limit(0)).count() == 0


def test_decontamination_windows(spark, docs):
    """Against a brute force over all item-sized windows: swapped halves, reordered sentences, edits, cut ends, repeats."""
    from skyloom.llm.decontam import decontaminate

    rng = np.random.default_rng(7)
    own = lambda n: [f"u{x}" for x in rng.integers(0, 10**9, n)]
    items = {1: own(50), 2: own(59), 3: own(30), 4: own(90), 5: own(20) + ["a"] * 12 + own(20), 6: own(24)}
    rows = []
    for w in items.values():
        n = len(w)
        third = n // 3
        sub = [*w[: n // 2], "changed", *w[n // 2 + 1 :]]
        for x in (w, w[n // 2 :] + w[: n // 2], w[third : 2 * third] + w[:third] + w[2 * third :], w[2 * third :] + w[:third] + w[third : 2 * third], sub, w[3:], w[:-4], [*w[: n // 2], "in", "serted", *w[n // 2 :]], ["a", *w[:-1]], w[:-1] + ["b"]):
            rows += [" ".join([*own(7), *x, *own(9)]), " ".join([*own(4), *x]), " ".join(x)]
    rows += ["a " * 300, " ".join(items[1][:20] * 5)]
    table = [(i if i else None, t) for i, t in enumerate(rows)]
    bag = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)]
    want = {}
    for d, t in table:
        s = bag(t.split())
        for k, w in items.items():
            x = bag(w)
            best = (0, 0)
            for a in range(len(s)):
                y = s[a : a + len(x)]
                m = sum((Counter(x) & Counter(y)).values())
                best = max(best, (round(m / (len(x) + len(y) - m), 6), -a))
            if best[0] >= 0.8:
                want[d, k] = best[0], -best[1]
    got = decontaminate(spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    assert len(want) > 100 and {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got.collect()} == want


def test_simhash_radius(spark):
    """Bags at similarity 0.8 (8 of 9 shingles shared) stay inside the radius."""
    from pyspark.sql import functions as F

    from skyloom.llm.decontam import RADIUS, simhash

    rng = np.random.default_rng(9)
    rows = []
    for k in range(4000):
        n = 9 * (2 + k % 5)
        x = rng.integers(-(2**63), 2**63 - 1, n + n // 9)
        rows.append((x[:n].tolist(), x[n // 9 :].tolist()))
    apart = spark.createDataFrame(rows, "a array<long>, b array<long>").select(F.bit_count(simhash(F.col("a")).bitwiseXOR(simhash(F.col("b")))).alias("d"))
    assert apart.where(F.col("d") > RADIUS).count() == 0


def test_line_dedup(spark, odd, empty):
    from skyloom.llm.linededup import line_dedup

    lines = [f"line number {i} of a shared passage" for i in range(30)]
    rows = [(i, "\n".join([f"own start {i}", *lines, f"own end {i}"]), "k") for i in range(6)] + [(9, None, "k"), (10, "", "k"), (None, "a\nb", "k"), (0, "\n".join(["own start 0", *lines, "own end 0"]), "k")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, _row string"))
    assert got.columns[:3] == ["doc_id", "text", "_row"]
    out = {}
    for r in got.collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed_lines for r in out[0]] == [0, 0] and out[9][0].text is None and out[10][0].text == ""
    for i in range(1, 6):
        r = out[i][0]
        assert r.n_removed_lines == 30 and f"own start {i}" in r.text and f"own end {i}" in r.text
        assert len(r.text.split("\n")) == r.n_lines - r.n_removed_lines
    assert line_dedup(odd).count() == odd.count() and line_dedup(empty).count() == 0


def lines_left(rows):
    """Brute force of line dedup: chunks at boundaries, at their first places, and what stands beside them there."""
    from skyloom.llm.linededup import PRIME, REACH, STEP

    chunks, out, seen = [], {}, {}
    for i, t in sorted(rows):
        x = t.split("\n")
        w = [k for k, v in enumerate(x) if v.strip(" \t\n\v\f\r")]
        h = [int(hashlib.md5(x[k].encode()).hexdigest()[:8], 16) for k in w]
        r = [(a * STEP + b) % PRIME for a, b in zip(h, h[1:])]
        for j in range(len(r)):
            others = [r[m] for m in range(max(0, j - REACH), min(len(r), j + REACH + 1)) if m != j]
            if not others or r[j] <= max(others):
                k1, k2 = w[j], w[j + 1]
                k0, k3 = w[j - 1] if j else None, w[j + 2] if j + 2 < len(w) else None
                chunks.append((i, k1, k2, k0, k3, x))
        out[i] = x, set()
    for i, k1, k2, k0, k3, x in chunks:
        before = None if k0 is None else x[k0:k1]
        after = None if k3 is None else x[k2 + 1 : k3 + 1]
        first = seen.setdefault(tuple(x[k1 : k2 + 1]), (i, k1, k2, before, after))
        if first[:2] != (i, k1):
            low = k0 if before is not None and before == first[3] else k1
            high = k3 if after is not None and after == first[4] else k2
            out[i][1].update(range(max(low, first[2] + 1) if first[0] == i else low, high + 1))
    return {i: ("\n".join(v for k, v in enumerate(x) if k not in gone), len(gone), sum(k - 1 not in gone for k in gone)) for i, (x, gone) in out.items()}


def test_line_dedup_recall_by_length(spark, docs):
    """Passages of three lines or more between different neighbours are removed whole, most of two; single lines stay."""
    from skyloom.llm.linededup import line_dedup

    rows, lengths = [], [1, 2, 3, 4, 5, 6, 8, 10, 15, 30]
    for n in lengths:
        for c in range(20):
            shared = [f"shared {n} {c} {j}" + ("\n" if j % 4 == 1 else "") for j in range(n)]
            for d in range(2):
                around = [[f"{side} {n} {c} {d} {j}" for j in range(4)] for side in ("before", "after")]
                rows.append((len(rows), "\n".join([*around[0], *shared, *around[1]])))
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {n: sum(got[40 * k + 2 * c + 1].n_removed_lines >= n for c in range(20)) for k, n in enumerate(lengths)}
    assert whole.pop(1) == 0 and whole.pop(2) >= 8 and set(whole.values()) == {20}
    odd = [(1, "x\n" + "long " * 50 + "\ny"), (2, "p\n" + "long " * 50 + "\nq"), (3, "same\nsame\nsame\nsame"), (4, "a\nshort\nb"), (5, "c\nshort\nd"), (6, "a\nb\n\nc\nd\n\na\nb"), (7, "\n\n\n\n"), (8, "only\nsame\nsame"), (9, "u\nv\nu\nv\nu\nv"), (10, ""), (11, "one"), (12, "one\ntwo"), (13, "\none\n\ntwo\n"), (14, "one\n\ntwo")]
    for part in (rows, odd, texts(docs)):
        got = line_dedup(spark.createDataFrame(part, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.text, r.n_removed_lines, r.n_removed_chunks) for r in got} == lines_left(part)


def test_line_dedup_hot_chunks(spark, monkeypatch):
    """A chunk that is met in parts gives the same rows."""
    from skyloom.llm import linededup

    rows = [(i, "\n".join([f"own {i}", *[f"everywhere {j}" for j in range(4)], f"end {i}", *[f"seldom {i // 2} {j}" for j in range(4)]])) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    want = lines_left(rows)
    for hot in (256, 10, 1):
        monkeypatch.setattr(linededup, "HOT", hot)
        got = linededup.line_dedup(df).collect()
        assert len(got) == 61 and {r.doc_id: (r.text, r.n_removed_lines, r.n_removed_chunks) for r in got} == want


def test_line_dedup_boundaries_decide(spark):
    """Boundaries do not move with lines elsewhere, and a passage goes whole although not all its places are boundaries."""
    from skyloom.llm.linededup import boundaries, line_dedup, with_lines

    shared = [f"passage line {j}" for j in range(12)]
    heads = [[f"other {d} {j}" for j in range(d)] for d in range(3, 9)]
    df = spark.createDataFrame([(d, "\n".join(["## Summary", "", *h, *shared, "## Summary", "", f"end {d}"])) for d, h in enumerate(heads)], "doc_id long, text string")
    found = {}
    for r in df.select("doc_id", with_lines(F.col("text"), boundaries).alias("c")).collect():
        skip = 2 + len(heads[r.doc_id])
        found[r.doc_id] = {c.k1 - skip for c in r.c if 2 <= c.k1 - skip < 9}
    assert len({frozenset(x) for x in found.values()}) == 1 and 3 < len(found[0]) < 7
    for r in line_dedup(df).collect():
        assert r.n_removed_lines == (0 if r.doc_id == 0 else 12 + 1) or r.doc_id == 0
        assert r.text.startswith("## Summary\n\nother") and r.text.endswith(f"end {r.doc_id}")


def windows_left(rows):
    """Brute force over every window of two lines with a word: all but its first place goes."""
    out, seen = {}, {}
    for i, t in sorted(rows):
        x = t.split("\n")
        w = [k for k, v in enumerate(x) if v.strip(" \t\n\v\f\r")]
        gone = set()
        for a, b in zip(w, w[1:]):
            d, first, last = seen.setdefault(tuple(x[a : b + 1]), (i, a, b))
            if (d, first) != (i, a):
                gone.update(range(max(a, last + 1) if d == i else a, b + 1))
        out[i] = "\n".join(v for k, v in enumerate(x) if k not in gone), len(gone)
    return out


def test_line_dedup_every_window(spark, docs):
    """The pipeline's stage loses no repeat of two lines or more, nor one of which a part stands earlier between other lines."""
    import corpus_pipeline
    from skyloom.llm.linededup import line_dedup

    rows, sizes = [], [n for n in (1, 2, 3, 4, 6) for _ in range(20)]
    for c, n in enumerate(sizes):
        shared = [f"shared {c} {j}" + ("\n" if j % 3 == 1 else "") for j in range(n)]
        for d, part in enumerate((shared[1 : max(3, n - 1)], shared, shared)):
            rows.append((3 * c + d, "\n".join([f"before {c} {d}", "", *part, f"after {c} {d}"])))
    odd = [(1, "same\nsame\nsame\nsame"), (2, "a\nb\n\nc\nd\n\na\nb"), (3, "\n\n\n\n"), (4, "only\nsame\nsame"), (5, "u\nv\nu\nv\nu\nv"), (6, ""), (7, "one"), (8, "one\ntwo"), (9, "\none\n\ntwo\n"), (10, "one\n\ntwo"), (11, "b\r\na\nb")]
    for part in (rows, odd, texts(docs)):
        df = spark.createDataFrame(part, "doc_id long, text string")
        got, want = line_dedup(df, every=True).collect(), windows_left(part)
        assert {r.doc_id: (r.text, r.n_removed_lines) for r in got} == want
        assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, df, SF).collect()} == {i: t for i, (t, _) in want.items()}
    assert all("shared" not in windows_left(rows)[3 * c + 2][0] for c, n in enumerate(sizes) if n > 1)


def test_packing(docs, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from skyloom.llm.packing import pack, plan
    from skyloom.llm.queries import bpe_path

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        want = Counter()
        for i, t in texts(df):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            first = (len(ids) - 1) % 1024 + 1
            at = [0, *range(first, len(ids) + 1, 1024)]
            for k, (lo, hi) in enumerate(zip(at, at[1:])):
                want[i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
        got = pack(df, bpe_path()).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for x in bins.values():
            x.sort()
            assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 1024
        assert len(bins) <= 1.03 * math.ceil(sum(r.length for r in got) / 1024) + 1
    assert pack(empty, bpe_path()).count() == 0
    assert sum((b - a) // c * c for _, a, b, c, _, _ in plan({600: 4, 424: 4, 1024: 2, 3: 5})) == 15


def test_lm(odd, empty, docs):
    """Base scores by exact counts; scores by quantised counts of a dictionary, which a filter of 64 bits a level equals."""
    from skyloom.llm.lm import BASE, TRUST, lm_scores

    @lru_cache(None)
    def rough(c):
        if not c:
            return 0.0
        q = 1
        while BASE**q <= c:
            q += 1
        held = [x for x in range(c // 2, 2 * c + 2) if BASE ** (q - 1) <= x < BASE**q]
        return (held[0] + held[-1]) / 2

    def model(df):
        one, two = Counter(), Counter()
        for i, t in texts(df):
            if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
                w = [*(t or "").encode().lower().split(), None]
                one.update(w)
                two.update(zip([None, *w], w))
        n, v = sum(one.values()), len(one)

        def score(t):
            w, out = [*(t or "").encode().lower().split(), None], 0.0
            for a, b in zip([None, *w], w):
                before = rough(one[a])
                trust = TRUST * before / (before + 1)
                out += math.log10(trust * min(1.0, rough(two[a, b]) / max(before, 1)) + (1 - trust) * (rough(one[b]) + 0.5) / (n + 0.5 * (v + 1)))
            return out

        return score

    for df in (docs, odd):
        score, scored = model(df), {}
        for i, t in texts(df):
            scored.setdefault((i, len((t or "").encode().split()) + 1), set()).add(round(score(t), 6))
        for most in (1 << 30, 0):  # shards broadcast, shards asked by joins
            got = lm_scores(df, most, 1024).collect()
            assert len(got) == df.count()
            off = [(r.doc_id, r.score, scored[r.doc_id, r.n_tokens]) for r in got if round(r.score, 6) not in scored[r.doc_id, r.n_tokens]]
            assert not off
    assert sorted(map(tuple, lm_scores(odd).collect()), key=str) == sorted(map(tuple, lm_scores(odd, 0).collect()), key=str)
    for df in (docs, odd):
        toks = lambda t: [*(t or "").encode().lower().split(), None]
        c = Counter()
        for i, t in texts(df):
            if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
                c.update(toks(t))
        n, v = sum(c.values()), len(c)
        want = {}
        for i, t in texts(df):
            x = toks(t)
            want[i, len(x)] = (sum(w in c for w in x), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
        got = lm_scores(df).collect()
        assert len(got) == df.count()
        for r in got:
            known, base = want[r.doc_id, r.n_tokens]
            assert r.n_known == known and r.train_tokens == n and math.isclose(r.base_score, base, rel_tol=1e-9)
            assert r.score < 0 and (r.held_out is None) == (r.doc_id is None)
    held = [r for r in lm_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(empty).count() == 0


def test_suffix(docs, odd, empty):
    from skyloom.llm.suffix import LAST, multikey_order, suffix_dedup

    for df in (docs, odd):
        seen, want = set(), {}
        for i, t in sorted({(LAST if i is None else i, t or "") for i, t in texts(df)}):
            b = t.encode()
            gone = bytearray(len(b))
            for k in range(len(b) - 99):
                s = b[k : k + 100]
                if s in seen:
                    gone[k : k + 100] = b"\1" * 100
                seen.add(s)
            kept = bytes(x for x, f in zip(b, gone) if not f)
            want[i, len(b)] = sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()
        got = suffix_dedup(df).collect()
        assert len(got) == df.count()
        assert all((r.n_removed, r.n_spans, r.kept_sha256) == want[LAST if r.doc_id is None else r.doc_id, r.n_bytes] for r in got)
    assert suffix_dedup(empty).count() == 0
    x = np.random.default_rng(0).integers(0, 50, (3, 20_000))
    assert (multikey_order(list(x), 16) >= 0).all() and (x[:, multikey_order(list(x), 16)] == x[:, np.lexsort(x[::-1])]).all()


def test_suffix_same_id(spark):
    """Different texts under null or under one id: none removes the other's bytes, earlier documents and own repeats do."""
    from skyloom.llm.suffix import LAST, suffix_dedup

    rng = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    a, b, c, d = (word(n) for n in (400, 300, 250, 500))
    rows = [(1, a + word(50)), (2, word(90) + b + word(200) + b), (2, word(500) + b[:200] + word(30) + c), (2, c + word(300) + a[100:350])]
    rows += [(None, word(600) + d), (None, d + word(20) + a[:180] + word(100) + d[:300]), (None, word(40) + c[50:] + word(800)), (7, d[:150] + word(700)), rows[2]]
    seen, want = {}, Counter()
    for i, t in sorted({(LAST if i is None else i, t) for i, t in rows}):
        own, gone = set(), bytearray(len(t))
        for k in range(len(t) - 99):
            s = t[k : k + 100]
            if s in own or seen.get(s, i) < i:
                gone[k : k + 100] = b"\1" * 100
            own.add(s)
            seen.setdefault(s, i)
        kept = "".join(x for x, f in zip(t, gone) if not f)
        want[i, len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += rows.count((None if i == LAST else i, t))
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want


def test_main_text(spark):
    from html import unescape

    from skyloom.llm.htmltext import main_text

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(unescape(re.sub(r"</?(p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", a))).split())
    got = main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    rows = [
        (1, "http://h.example/1", '<html><body><header>Top</header><div class="cookie-notice">We use</div><main><p>A&amp;b  c<p>d<b>e</b>f</main><aside>side</aside><form>x</form><div class="comments">me too</div><script>p("</main>")</script></body></html>'),
        (2, "http://h.example/2", "<html><body><div>plain <i>text</i></div><ul class=menu><li>m</ul>"),
        (3, None, None),
        (None, "http://h.example/1", ""),
    ]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {1: "A&b c def", 2: "plain text", 3: "", None: ""}
    assert main_text(pages.limit(0)).count() == 0


def test_main_text_template(spark):
    """The template decides: equal tags on three hosts, of which other slots are boilerplate, content or teasers."""
    from skyloom.llm.htmltext import main_text

    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    rows, want = [], {}
    for k in range(6):
        a, b, c = word(50), word(50), word(50)
        rows.append((k, "https://a.example/1", f"<body><div class=x1>{a}</div><div class=x2>one and the same text</div><div class='share-price'>{b}</div></body>", "x", 1))
        want[k] = f"{a} {b}"
        rows.append((10 + k, "https://b.example/1", f"<body><div class=x1>one and the same text</div><div class=x2>{a}</div><div class='share-price'>tell all your friends</div></body>", "x", 1))
        want[10 + k] = a
        rows.append((20 + k, "https://c.example/1", f"<body><article class=main><h1>{a}</h1><p>{b}</article><div class=x3><article class=teaser>{c}</article><article class=teaser>{a}</article></div></body>", "x", 1))
        want[20 + k] = f"{a} {b}"
    long = word(60_000)
    rows += [(30, "https://d.example/", f"<p title=don't>hi</p><div>{long}</div>", None, None), (31, "https://e.example/", "<form><article><header><h1>T</h1></header><p class='related-work'>r<section class='comments-on-law'>s</section></article></form>", "x", 1)]
    want |= {30: "hi " + long, 31: "T r s"}
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, host string, main long")
    got = [(r.page_id, r.text, r.n_chars) for r in main_text(pages).collect()]
    assert len(got) == len(rows) + 1 and all(want[i] == t and len(t) == n for i, t, n in got)


def test_main_text_unlisted_names(spark):
    """Root slots against slots that vary: no name on these pages is in the list, or the list is wrong about it."""
    from skyloom.llm.htmltext import extract, main_text

    rng = np.random.default_rng(8)
    word = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    links = lambda: "".join(f"<a href=/{k}>{word(3)}</a> " for k in range(6))
    rows, want = [], {}
    for k in range(8):
        a, lead = word(120), word(40)
        answers = "".join(f"<section class=reader-responses>{word(30)}</section>" for _ in range(k % 3))
        rows.append((k, "https://f.example/1", f"<body><div class=gdpr-bar>we store some things on your device</div><div class=lede>{lead}</div><div class=story><p>{a[:200]}<p>{a[200:]}<div class=zz9>{links()}</div></div>{answers}<div class=most-read>{links()}</div></body>"))
        want[k] = " ".join([lead, a[:200].strip(), a[200:].strip()])
        rows.append((10 + k, "https://g.example/1", f"<body><div class=top3>{links()}</div><div id=share><h1>{lead}</h1>{a}</div><div class=recommended>{links()}</div>{answers}</body>"))
        want[10 + k] = f"{lead} {a}"
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert all(extract(h) != want[i] for i, _, h in rows)  # names alone do not give it


def test_toxicity(spark, odd, empty):
    """Held-out accuracy on the labels of sf0.1; ties, repeated rows, empty and very long texts."""
    from skyloom.llm.toxicity import toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    marks = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    pos, neg = np.array([s for s, t in marks if t]), np.array([s for s, t in marks if not t])
    assert (pos[:, None] > neg).mean() > 0.95
    assert (pos >= 0.5).mean() > 0.8 and (neg < 0.5).mean() > 0.97
    small = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity(odd, small).collect()
    assert len(out) == odd.count() and toxicity(empty, small.limit(0)).count() == 0
    same = [r.score for r in out if r.doc_id in (901, 902)]
    assert len(set(same)) == 1 and all(0 <= r.score <= 1 for r in out)
    twice = Counter(r.doc_id for r in out).most_common(1)[0][0]
    assert len({r.score for r in out if r.doc_id == twice}) == 1
    assert max(r.score for r in toxicity(odd, small.limit(0)).collect()) < 1e-9


def test_toxicity_leaves_out_only_rows_that_are_too_long(spark):
    """A labelled text of any length costs no other row its place."""
    from skyloom.llm.toxicity import train

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    first = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id")).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long text "), 1_000_000)).otherwise(F.col("text")))
    a, _ = train(long, labels)
    b, _ = train(docs.where(F.col("doc_id") != first), labels)
    assert all((a.p[k] == b.p[k]).all() for k in a.p) and a.shift == b.shift


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """A word that only rows of the largest hashes teach is known, in one shard and in several."""
    from skyloom.llm import toxicity

    learnt = [r.i for r in spark.range(8000).where("crc32(cast(id as string)) % 5 <> 0").selectExpr("id as i", "xxhash64(id) as h").orderBy("h").collect()]
    held = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5 == 0]
    rng, words = np.random.default_rng(1), [f"{a}{b}" for a in ("mar", "ten", "sol", "vic", "dun") for b in ("ado", "eri", "ulp", "osk", "inth")]
    late, common = set(learnt[5000::10]), set(learnt[::12])  # more rows come before the late ones than were once learnt from
    common = (common | set(held[::12])) - late
    texts = {i: list(rng.choice(words, 10)) for i in [*learnt, *held]}
    asked = set(held[1::12])
    for i in late | common | asked:
        texts[i][int(rng.integers(10))] = "grobbish" if i in common else "zwyxxle"
    docs = spark.createDataFrame([(i, " ".join(t), "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in late or i in common)) for i in learnt], "doc_id long, toxic int")
    for most in (toxicity.SHARD_ROWS, 1000):
        monkeypatch.setattr(toxicity, "SHARD_ROWS", most)
        got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
        assert all(got[i].predicted and got[i].flagged for i in asked | common)
        assert not any(got[i].predicted for i in held if i not in asked and i not in common)


def test_toxicity_learns_from_long_texts(spark):
    """A word that only texts of over 64 kB teach is known; what makes them long says nothing."""
    from skyloom.llm.toxicity import ROW_BYTES, toxicity

    rng, words = np.random.default_rng(3), [f"{a}{b}" for a in ("mar", "ten", "sol", "vic", "dun") for b in ("ado", "eri", "ulp", "osk", "inth")]
    long, texts, marks, asked = " ".join(["x" * 1000] * (ROW_BYTES // 1000 + 1)), {}, {}, set()
    for i in range(1500):
        t = list(rng.choice(words, 10))
        if zlib.crc32(str(i).encode()) % 5:
            marks[i] = int(i % 8 == 0)
            t += [long] if i % 4 == 0 else []
        elif i % 2:
            asked.add(i)
        if marks.get(i) or i in asked:
            t[int(rng.integers(10))] = "zwyxxle"
        texts[i] = " ".join(t)
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in toxicity(docs, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int")).collect()}
    assert len(got) == 1500 and {i for i, r in got.items() if r.held_out and r.predicted} == asked


def test_toxicity_in_parts(monkeypatch):
    """Texts taken in parts give the answers and places of whole ones: all lengths around a part, and equal answers."""
    from skyloom.llm import toxicity

    net, rng = toxicity.Cnn(3), np.random.default_rng(5)
    shares = rng.normal(0, 1, (9, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32)
    sizes = np.array([1, 2, 30, 6, 7, 8, 9, 15, 1, 22, 14])
    ids = rng.integers(0, 9, sizes.sum())
    want = net.strongest(shares, ids, sizes)
    for most in (7, 8, 40):
        monkeypatch.setattr(toxicity, "TOKENS", most)
        got = net.strongest(shares, ids, sizes)
        assert all((a == b).all() for a, b in zip(got, want))


def test_toxicity_cuts(spark):
    """Cuts of best F1 against a search over all scores: ties, one score, no marked rows, several ranges."""
    from skyloom.llm.toxicity import best_cuts

    def want(rows):
        z = sorted({z for z, _ in rows}, reverse=True)
        marked = sum(t for _, t in rows)
        f1 = [2 * sum(t for x, t in rows if x >= c) / (sum(x >= c for x, _ in rows) + max(1, marked)) for c in z]
        k = f1.index(max(f1))
        return (z[k] + z[min(k + 1, len(z) - 1)]) / 2, marked

    rng = np.random.default_rng(2)
    sets = {"one": [(0.5, 1)], "same": [(1.0, 1), (1.0, 0)], "none": [(1.0, 0), (2.0, 0)], "tie": [(3.0, 1), (2.0, 0), (1.0, 1), (1.0, 1)]}
    sets |= {f"n{k}": [(float(round(rng.normal(2 * t, 1), k % 4)), t) for t in (rng.random(300) < 0.2).astype(int).tolist()] for k in range(8)}
    df = spark.createDataFrame([(g, *r) for g, rows in sets.items() for r in rows], "g string, z double, toxic int")
    assert {r.g: (r.cut, r.marked) for r in best_cuts(df).collect()} == {g: want(rows) for g, rows in sets.items()}


def test_toxicity_forward_pass():
    """Scores against loops over texts, places, filters and n-grams."""
    from skyloom.llm.toxicity import FILTERS, WIDTHS, Cnn, gram_rows

    net, rng = Cnn(3), np.random.default_rng(5)
    net.p["b"] = rng.normal(0, 0.1, net.p["b"].shape).astype(np.float32)
    data = [[b""], [b"one"], [b"one", b"two"], "the quick brown fox jumps over the the lazy dog ünï".encode().split(), [b"x" * 300, b"ab"], [b"same"] * 7]
    want = []
    for text in data:
        e = [net.p["e"][gram_rows([w])[0]].astype(float).sum(0) / math.sqrt(len(gram_rows([w])[0])) for w in text]
        tops, col = [], 0
        for i, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                z = sorted((sum(float(e[t + j] @ net.p["k"][:, col + j * FILTERS + f]) for j in range(width) if t + j < len(e)) + float(net.p["b"][i * FILTERS + f]) for t in range(len(e))), reverse=True)
                tops.append([max(0.0, v) for v in (*z[:2], 0.0)][:2])
            col += width * FILTERS
        h = np.array([t[0] for t in tops] + [t[1] for t in tops])
        want.append(float(h @ net.p["o"] + net.p["c"][0]))
    assert np.allclose(net.logits(data), want, atol=1e-4)
    assert np.allclose(np.concatenate([net.logits([t]) for t in data]), want, atol=1e-4)


def test_license_postings():
    """Templates without a word of the file are not looked at, however many there are; positions decide between others."""
    from skyloom.llm import licenses
    from skyloom.llm.licenses import Index, scan, templates_of

    many = {f"alpha{k} beta{k} gamma{k} delta": f"l{k}" for k in range(600)}
    templates = templates_of({}, many, {})
    idf = {w: 1.0 if w == b"delta" else 5.0 for t in templates for _, p in t.phrases for w in p}
    seen = []
    for t in templates:
        t.stands = lambda w, start, t=t, real=t.stands: seen.append(t.label) or real(w, start)
    index = Index(templates, idf, 3)
    assert scan(b"x alpha7 beta7 gamma7 delta alpha9 gamma9 beta9 delta".split(), index)[5] == "l7" and set(seen) == {"l7"}
    assert scan(b"delta delta".split(), index)[5:] == ("", 0.0) and licenses.RARE == 3


def test_licenses(odd, docs, empty, spark):
    """Base places and all labels against a search at every position, without an index."""
    from skyloom.llm.licenses import BASE, MORE, SLACK, TEXTS, license_scan

    full = [re.sub(r"[\[\]]", "", t) for t in TEXTS]
    extra = [(1, "Released Under the MIT-License.  CC BY-NC; under the mit license"), (2, "Apache License, Version 2.0"), (3, None), (None, "GNU General Public License"), (5, "mit"), (6, "")]
    extra += [(10 + k, "intro words " + t.upper().replace(" ", "\n# ", 5) + " and then " + t) for k, t in enumerate(full)]
    extra += [(30 + k, re.sub("software", "one two three four software", t)) for k, t in enumerate(full)]
    extra += [(50 + k, re.sub("copy|the", "", t)) for k, t in enumerate(full)]
    extra += [(70 + k, " ".join(reversed(t.split("]")))) for k, t in enumerate(TEXTS)]

    def labels_of(w):
        out = {lab for p, lab in [*BASE.items(), *MORE.items()] if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))}
        for t, lab in TEXTS.items():
            at, shifts = 0, []
            for k, part in enumerate(re.split(r"[\[\]]", t)):
                p = part.split()
                if k % 2:
                    shifts.append([i - at for i in range(len(w)) if w[i : i + len(p)] == p])
                at += len(p)
            if any(all(any(low <= s <= low + SLACK for s in f) for f in shifts) for low in (shifts[0] + [s - SLACK for s in shifts[0]] + [s for f in shifts for s in f])):
                out.add(lab)
        return ",".join(sorted(out))

    for df in (docs, odd, spark.createDataFrame(extra, "doc_id long, text string")):
        want = Counter()
        for i, t in texts(df):
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            at = [(k, lab) for p, lab in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
            want[i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})), labels_of(w)] += 1
        got = license_scan(df).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got) == want
        assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 and (r.score == 1) == bool(r.labels) for r in got)
    assert {r.labels.split(",")[0] != "" for r in got if r.doc_id and 10 <= r.doc_id < 20} == {True}
    assert license_scan(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    docs = dict(texts(spark.read.parquet(f"{SF}/documents.parquet")))
    assert kept < set(docs) and len(kept) > 100 and [n for n, _ in corpus_pipeline.STAGES][2] == "minhash near-dedup"


def test_suffix_hot(docs):
    """Anchors with many runs are compared by the hash of each suffix; the result is the same."""
    from skyloom.llm.suffix import suffix_dedup

    assert sorted(map(tuple, suffix_dedup(docs, hot=1).collect())) == sorted(map(tuple, suffix_dedup(docs).collect()))


def test_pipeline_stages_odd(spark, odd, empty, docs):
    """Nulls, empty and repeated rows, empty tables, and extra columns named like results of the stages."""
    import corpus_pipeline

    clash = "kept boolean, n_words long, base_failed boolean, n_lines string, n_removed_lines long, judged int, carried int, similarity double, start long, _doc int"
    names = [c.split()[0] for c in clash.split(", ")]
    extra = {c.split()[0]: c.split()[1] for c in clash.split(", ")}
    good = docs.unionByName(odd.select(docs.columns))
    for df in (good, odd.limit(0).select(docs.columns), empty.select(docs.columns)):
        for k, t in extra.items():
            df = df.selectExpr("*", f"cast(7 as {t}) as {k}")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            for c in names:
                assert out.select(c).distinct().count() <= 1
            df = spark.createDataFrame(out.collect(), out.schema)
        corpus_pipeline.STAGES[-1][1](spark, df, SF).count()
