"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its structural tags (with their class words and the tag around them) and the blocks of text in
each of them. For every host and token, the occurrence vector over all pages of the host is summed up as a fingerprint,
so that hosts of any size need one row per token only. Tokens with the same vector form an equivalence class. A class is
valid if its tokens occur on two pages of the host at least (or the host has one page); the class that occurs exactly
once on every page is the root of the template, the other valid classes nest in its slots. A text stands in the slot of
the innermost structural tag around it. The vectors of a host decide on the slots that stand on ``SEEN`` pages or more:

* a slot is boilerplate if most of its text are blocks of other pages, too, or links, and content if little of it is and
  it has ``LONG`` characters a page;
* the article is where the template has an article (or main) tag: the one of the root class, if there is one, so that a
  list of teasers in article tags is none;
* without such a tag the article is in the content slots of the root class (once on every page), whatever they are called,
  if they hold ``MOST`` of the host's new text; even a slot with a furniture word holds it, if it has so much of the text
  alone. What stands outside, as slots that a page may have or not or have often, is left out: responses of readers vary
  like an article, but are no part of the root;
* else the text of all slots counts that are not dropped;
* boilerplate slots are dropped, whatever they are called; compound class words (share-price, related-work) mark
  furniture only where the template does not say content and the slot is not in the article.

Tags that mean furniture (nav, aside, footer; header outside the article, form around no article) and plain class words
(ad, sidebar, comments) mark it on every page, with or without a template, but for the slot of the article. On hosts with fewer pages names alone decide.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one
space. Scripts, styles, comments and markup never count.

Nulls: a null html is an empty page (empty text); a null url is the host ''; a null page_id is kept. Repeated rows come
out as often as they come in (and count as pages that share all their text); ties need no order, as equal pages of a host
get equal texts. Very long pages are read whole. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import table

#: A quote opens a quoted value after an equals sign only.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>=]++|=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)>|<[!?][^>]*>", re.S)
CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
STRUCTURE = frozenset("html head body nav header footer aside main article section div p form ul ol table dialog".split())
#: Structural tags that stand for a slot only if they have class words.
PLAIN = frozenset(("p",))
RAW = frozenset("script style noscript template textarea svg iframe select button".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
ALWAYS, HEADERS, AROUND = frozenset("head nav footer aside".split()), frozenset(("header",)), frozenset(("form", "dialog"))
FURNITURE = re.compile(r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|header|footer|sidebar|widget|related|notice|cookies?|consent|alert|popup|newsletter|subscribe|share|social|comments?|disqus|replies|respond)", re.I)
MAIN = frozenset(("article", "main"))
SEEN, MOST, LEAST, LONG = 4, 0.6, 0.3, 200
#: Most bytes of all templates that are broadcast; larger ones meet the pages in a shuffle by host.
BROADCAST_BYTES = 32 << 20


def events(html: str):
    """('open', tag, class words), ('close', tag, ''), ('text', text, '') of a page; raw elements are left out."""
    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            yield "close", tag, ""
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        words = " ".join(sorted({w.lower() for c in CLASS.findall(m[3]) for x in c for w in x.split()})) if m[3] and tag in STRUCTURE else ""
        yield "open", tag, words
    if at < len(html):
        yield "text", html[at:], ""


def _walk(html: str):
    """Events with the slots that are open: (kind, tag or text, stack of (tag, token), did the stack change)."""
    stack: list[tuple[str, str]] = []
    for kind, x, words in events(html):
        moved = False
        if kind == "open" and x in STRUCTURE:
            if x in PLAIN or (stack and stack[-1][0] in PLAIN):  # a block opens: the paragraph before it has ended
                while stack and stack[-1][0] in PLAIN:
                    stack.pop()
                    moved = True
            if x not in PLAIN or words:
                key = (stack[-1][1].split(">")[-1] + ">" if stack else "") + x + ("." + words if words else "")
                stack.append((x, key))
                moved = True
        elif kind == "close" and x in STRUCTURE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == x:
                    del stack[k:]
                    moved = True
                    break
                if x in PLAIN:
                    break
        yield kind, x, stack, moved


@lru_cache(10_000)
def named(key: str) -> str:
    """What tag and class words alone say: always, header, around, word, compound, main or nothing."""
    tag, _, words = key.split(">")[-1].partition(".")
    if tag in ALWAYS:
        return "always"
    words = words.split()
    if any(FURNITURE.fullmatch(w) for w in words):
        return "word"
    if tag in HEADERS:
        return "header"
    if tag in AROUND:
        return "around"
    if any(FURNITURE.fullmatch(part) for w in words for part in re.split(r"[-_]", w)):
        return "compound"
    return "main" if tag in MAIN else ""


def _vectors(batches):
    names = ["host", "token", "block", "named", "pages", "n", "print", "chars", "linked"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5]
    for b in batches:
        sums: dict = defaultdict(lambda: [0, 0, 0, 0, 0])
        for host, page in zip(b.column(0).to_pylist(), b.column(1)):
            page = page.as_py() or ""
            mark = xxhash.xxh3_64_intdigest(page.encode("utf-8", "surrogatepass")) >> 40
            seen: dict = defaultdict(lambda: [0, 0, 0])
            part: list[str] = []
            links, linked, slot = 0, 0, ""

            def end():
                nonlocal linked
                if part and (text := " ".join("".join(part).split())):
                    s = seen[slot, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1]
                    s[0] += 1
                    s[1] += len(text)
                    s[2] += min(linked, len(text))
                part.clear()
                linked = 0

            for kind, x, stack, moved in _walk(page):
                if kind == "text":
                    part.append(x)
                    linked += len(x) if links > 0 else 0
                    continue
                if x == "a":
                    links = links + 1 if kind == "open" else max(0, links - 1)
                if moved or x not in INLINE:
                    end()
                if moved:
                    slot = stack[-1][1] if stack else ""
                    if kind == "open" and stack and stack[-1][0] == x:
                        seen[slot, None][0] += 1
            end()
            seen["", None] = [1, 0, 0]
            for k, (c, chars, some) in seen.items():
                s = sums[(host, *k)]
                for i, add in enumerate((1, c, c * mark, chars, some)):
                    s[i] += add
        rows = [(h, k, block, named(k), *s) for (h, k, block), s in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, dropped, content): what the template of each host says about its slots."""
    v = pages.select("host", "html").mapInArrow(_vectors, "host string, token string, block long, named string, pages long, n long, print long, chars long, linked long")
    v = v.groupBy("host", "token", "block").agg(F.first("named").alias("named"), *[F.sum(c).alias(c) for c in ("pages", "n", "print", "chars", "linked")])
    v = table(v, "html-tokens")
    tags = v.where("block is null")
    total = tags.where("token = ''").select("host", F.col("pages").alias("total"), F.col("print").alias("once"))
    slots = v.where("block is not null").groupBy("host", "token").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum(F.when(F.col("pages") > 1, F.col("chars")).otherwise(0)).alias("again"))
    valid = tags.where("token <> ''").select("host", "token", "named", "pages", "n", "print").join(total, "host").where("pages > 1 or total = 1").join(slots, ["host", "token"], "left").na.fill(0, ["chars", "linked", "again"])
    root = (F.col("pages") == F.col("total")) & (F.col("n") == F.col("total")) & (F.col("print") == F.col("once"))
    main = F.col("named") == "main"
    seen = (F.col("pages") >= SEEN) & (F.col("chars") > 0)
    boiler = seen & ((F.col("again") >= MOST * F.col("chars")) | (F.col("linked") >= MOST * F.col("chars")))
    content = seen & (F.col("again") <= LEAST * F.col("chars")) & (F.col("linked") <= LEAST * F.col("chars")) & (F.col("chars") >= LONG * F.col("pages"))
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("token"))))
    whole = F.regexp_extract("token", r"(?:^|>)(html|body)(?:\.|$)", 1) != ""
    slot = content & root & ~whole
    # new text by who holds it: slots of the root class, a furniture word's slot alone, the page itself, others
    fresh = F.greatest(F.col("chars") - F.greatest("again", "linked"), F.lit(0)).cast("double")
    plain = F.col("named").isin("", "compound")
    text = lambda c: F.coalesce(F.sum(F.when(c, fresh)), F.lit(0.0))
    alone = F.max(F.when(slot & (F.col("named") == "word"), F.struct(fresh.alias("n"), F.col("token").alias("t"))))
    said = valid.groupBy("host").agg(
        pick(main & root).alias("roots"), pick(main).alias("mains"), pick(slot & plain).alias("slots"), pick(boiler & plain).alias("dropped"), pick(content & (F.col("named") == "compound")).alias("content"),
        text(slot & plain).alias("n_slots"), text(content & whole).alias("n_page"), text(plain | whole).alias("n_plain"), text(F.lit(True)).alias("n_all"), alone.alias("alone"),
    )
    led = (F.col("n_slots") >= MOST * F.col("n_plain")) & (F.col("n_page") == 0) & (F.size("slots") > 0)
    lone = (F.col("alone.n") >= MOST * F.col("n_all")) & (F.col("n_page") == 0)
    place = F.when(F.size("roots") > 0, F.col("roots")).when(F.size("mains") > 0, F.col("mains")).when(lone, F.array("alone.t")).when(led, F.col("slots")).otherwise(F.array().cast("array<string>"))
    return said.select("host", place.alias("main"), "dropped", "content").where("size(main) + size(dropped) + size(content) > 0")


def standing(stack: list[tuple[str, str]], main: frozenset, dropped: frozenset, content: frozenset) -> tuple[bool, bool]:
    """Is a text in these slots furniture, and is it in the article?"""
    names = [named(k) for _, k in stack]
    inside = [i for i, (_, k) in enumerate(stack) if (k in main if main else names[i] == "main")]
    first, last = (inside[0], inside[-1]) if inside else (len(stack), -1)
    for i, name in enumerate(names):
        if name == "always" or name == "word" and stack[i][1] not in main or name == "header" and i < first or name == "around" and i > last:
            return True, False
        if name == "compound" and i < first and stack[i][1] not in content and not inside:
            return True, False
    if stack and stack[-1][1] in dropped and names[-1] != "main":
        return True, False
    return False, bool(inside)


def extract(html: str, main: list[str] = (), dropped: list[str] = (), content: list[str] = ()) -> str:
    """Main text of a page whose host has this template."""
    said = frozenset(main), frozenset(dropped), frozenset(content)
    part: list[str] = []
    article, others = [], []  # blocks of the article; of all slots that are not furniture
    now = standing([], *said)

    def end():
        if part:
            text = " ".join(unescape("".join(part)).split())
            part.clear()
            if text and not now[0]:
                others.append(text)
                if now[1]:
                    article.append(text)

    for kind, x, stack, moved in _walk(html):
        if kind == "text":
            part.append(x)
        elif moved or x not in INLINE:
            end()
            if moved:
                now = standing(stack, *said)
    end()
    return " ".join(article or others)


def _extract(batches):
    for b in batches:
        for at in range(0, len(b), 500):
            p = b.slice(at, 500)
            text = [extract(h.as_py() or "", *(x.as_py() or () for x in said)) for h, *said in zip(*(p.column(k) for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([p.column(0).cast(pa.int64()), p.column(1).cast(pa.string()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    found = table(templates(pages), "html-templates")
    size = F.octet_length("host") + sum(F.octet_length(F.concat_ws(" ", c)) for c in ("main", "dropped", "content"))
    few = (found.agg(F.sum(size).alias("b")).first().b or 0) <= BROADCAST_BYTES
    joined = pages.join(F.broadcast(found) if few else found, "host", "left")
    return joined.select("page_id", "url", "html", "main", "dropped", "content").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
