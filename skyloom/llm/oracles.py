"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from skyloom.llm.decontam import K, LEAST
from skyloom.llm.linededup import LAST, PRIME, REACH, STEP
from skyloom.llm.quality import COMMON, LEAST_DOCS, MAX_CHAR_DISTANCE, MAX_POOLED_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_WORDS, POOLED
from skyloom.llm.suffix import LENGTH

_WORDS = r"list_filter(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_SHINGLES = f"case when len(w) >= {K} then list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i+{K - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"

#: op3: every window with as many hits as its similarity needs, by exact weighted similarity alone.
OP3 = f"""
with items as (
  select item_id, {_WORDS.format(t="min(text)")} as w from benchmark where item_id is not null group by item_id having min(text) is not null
), it as (
  select item_id, len(w) as n_words, {_SHINGLES} as s from items where len(w) > 0
), docs as (
  select distinct doc_id, text, {_WORDS.format(t="coalesce(text, '')")} as w from documents
), d as (
  select row_number() over () as row, doc_id, {_SHINGLES} as s from docs where len(w) > 0
), ip as (
  select distinct item_id, unnest(s) as h from it
), dp as (
  select row, unnest(s) as h, generate_subscripts(s, 1) - 1 as pos from d
), hits as (
  select row, item_id, pos, len(it.s) as n from dp join ip using (h) join it using (item_id)
), starts as (
  select row, item_id, unnest(range(greatest(pos - n + 1, 0), pos + 1)) as start, n from hits
), laid as (
  select row, item_id, start from starts group by row, item_id, start, n having count(*) >= {LEAST} * n - 1e-9
), bags as (
  select d.doc_id, laid.item_id, laid.start, it.n_words, it.s as item, d.s[start + 1 : start + len(it.s)] as part
  from laid join it using (item_id) join d using (row)
), sim as (
  select *, list_sum(list_transform(list_distinct(item), lambda x: least(len(list_filter(item, lambda y: y = x)), len(list_filter(part, lambda y: y = x))))) as m from bags
), scored as (
  select doc_id, item_id, start, n_words, m / greatest(len(item) + len(part) - m, 1) as similarity from sim
)
select doc_id, item_id, cast(start as bigint) as start_word, cast(n_words as bigint) as n_words, round(similarity, 6) as similarity
from scored where similarity >= {LEAST}
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
"""

_WORD = r"[^\x20\x09-\x0D]"
_LISTS = "case lang " + " ".join(f"when '{g}' then {w}" for g, w in COMMON.items()) + " else [] end"
_CLASSES = ["[a-z]", r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[#*$%&|<>]", r"[\x00-\x08\x0E-\x1F!\x22'()+,\-./:;=?@\x5B-\x60{}~\x7F]"]
_COUNTS = ", ".join("cast(length(t) - length(regexp_replace(t, '{}', '', 'g')) as double)".format(c.replace("'", "''")) for c in _CLASSES)


_POOL = "[" + ", ".join("+".join("{h}[" + str(i + 1) + "]" for i in part) for part in POOLED) + "]"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts; 0 if one of them is empty."""
    x, y = f"({p}[i]/list_sum({p}))", f"({q}[i]/list_sum({q}))"
    term = "(case when {a} > 0 then {a} * log2({a} / (({x} + {y}) / 2)) else 0 end)"
    both = f"({term.format(a=x, x=x, y=y)} + {term.format(a=y, x=x, y=y)}) / 2"
    return f"case when coalesce(list_sum({p}), 0) > 0 and coalesce(list_sum({q}), 0) > 0 then sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {both})), 0)) else 0 end"


#: op1: counts, both histograms of every text, their sums by language, and the verdict.
OP1 = f"""
with t as (
  select row_number() over () as row, doc_id, coalesce(text, '') as t, coalesce(lang, '') as lang from documents
), w as (
  select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines, list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+'), lambda x: list_contains({_LISTS}, x)) as listed from t
), three as (
  select row, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) as s from w where len(w) >= 3
), seen as (
  select row, i, count(*) over (partition by row, s) as c from three
), cover as (
  select row, count(distinct k) as n from (select row, unnest([i, i+1, i+2]) as k from seen where c > 1) group by row
), h as (
  select w.row, doc_id, lang, length(t) as n_chars, len(w) as n_words, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(cover.n, 0) as n_repeat_words, [{_COUNTS}] as c,
    list_transform({_LISTS}, lambda v: cast(len(list_filter(listed, lambda x: x = v)) as double)) as g from w left join cover using (row)
), f as (
  select *, list_concat(c, [n_chars - list_sum(c)]) as hc, case when len(g) > 0 then list_concat(g, [n_words - list_sum(g)]) else [] end as hw from h
), p as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as failed, {_POOL.format(h="hc")} as mc from f
), s as (
  select lang, count(*) as docs, [{", ".join(f"sum(hc[{i}])" for i in range(1, 8))}] as rc, [{", ".join(f"sum(hw[{i}])" for i in range(1, 14))}] as rw from p where not failed group by lang
), w1 as (
  select [{", ".join(f"coalesce(sum(hc[{i}]), 0)" for i in range(1, 8))}] as wc from p where not failed
), j as (
  select p.*, s.lang is null as alone, case when n_chars >= {MIN_CHARS} and s.lang is null then {_distance("mc", "wp")} when n_chars >= {MIN_CHARS} then {_distance("hc", "rc")} end as dc, case when s.lang is not null and n_words >= {MIN_WORDS} and len(hw) > 0 then {_distance("hw", "rw")} end as dw
  from p left join s on s.lang = p.lang and s.docs >= {LEAST_DOCS} cross join (select {_POOL.format(h="wc")} as wp from w1)
)
select doc_id, cast(n_words as bigint) as n_words, cast(n_chars - hc[2] as bigint) as word_chars, cast(hc[5] as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  failed as base_failed, not failed and coalesce(dc, 0) <= case when alone then {MAX_POOLED_DISTANCE} else {MAX_CHAR_DISTANCE} end and coalesce(dw, 0) <= {MAX_WORD_DISTANCE} as kept,
  round(dc, 6) as char_distance, round(dw, 6) as word_distance from j
"""

#: op7: boundaries by a rolling hash of the lines' MD5, chunks by their bytes; all but the first place of each go.
OP7 = f"""
with d as (
  select row_number() over (order by coalesce(doc_id, {LAST})) as row, doc_id, text, string_split(text, chr(10)) as l from documents
), ln as (
  select row, unnest(l) as line, generate_subscripts(l, 1) - 1 as k from d
), w as (
  select row, k, ('0x' || substr(md5(line), 1, 8))::bigint as h from ln where regexp_matches(line, '{_WORD}')
), r as (
  select row, lag(k, 2) over o as k0, lag(k) over o as k1, k as k2, lead(k) over o as k3, (lag(h) over o * {STEP} + h) % {PRIME} as r from w window o as (partition by row order by k)
), c as (
  select *, greatest({", ".join(f"coalesce({f}(r, {d}) over o, -1)" for d in range(1, REACH + 1) for f in ("lag", "lead"))}) as largest from r where k1 is not null window o as (partition by row order by k2)
), p as (
  select c.row, k0, k1, k2, k3, array_to_string(l[k1 + 1:k2 + 1], chr(10)) as t, case when k0 is not null then array_to_string(l[k0 + 1:k1], chr(10)) end as t0, case when k3 is not null then array_to_string(l[k2 + 2:k3 + 1], chr(10)) end as t3
  from c join d using (row) where largest < 0 or r <= largest
), f as (
  select *, first_value(row) over s as fr, first_value(k1) over s as f1, first_value(k2) over s as f2, first_value(t0) over s as ft0, first_value(t3) over s as ft3 from p window s as (partition by t order by row, k1)
), g as (
  select row, case when t0 = ft0 then k0 else k1 end as low, case when t3 = ft3 then k3 else k2 end as high, case when row = fr then f2 + 1 else 0 end as least from f where row <> fr or k1 <> f1
), x as (
  select distinct row, unnest(range(greatest(low, least), high + 1)) as k from g
), m as (
  select ln.row, ln.k, line, x.k is not null as gone, lag(x.k is not null, 1, false) over (partition by ln.row order by ln.k) as before from ln left join x on x.row = ln.row and x.k = ln.k
), a as (
  select row, count(*) as n_lines, count(*) filter (gone) as n_removed_lines, count(*) filter (gone and not before) as n_removed_chunks, coalesce(string_agg(line, chr(10) order by k) filter (not gone), '') as t from m group by row
)
select d.doc_id, case when d.text is null then null when coalesce(a.n_removed_lines, 0) = 0 then d.text else a.t end as text, coalesce(a.n_lines, 0) as n_lines, coalesce(a.n_removed_lines, 0) as n_removed_lines, coalesce(a.n_removed_chunks, 0) as n_removed_chunks from d left join a using (row)
"""

#: op6: every 100-byte string (as hexadecimal digits) but the first of its content, merged to spans.
OP6 = f"""
with t as (
  select row_number() over (order by coalesce(doc_id, {LAST})) as row, doc_id, hex(encode(coalesce(text, ''))) as h from documents
), s as (
  select row, b + k as k, md5(substr(h, 2 * k + 1, {2 * LENGTH})) as m from (select row, b, h, unnest(range(0, least(400, len(h) // 2 - {LENGTH - 1}))) as k
    from (select row, b, substr(h, 2 * b + 1, {2 * (400 + LENGTH - 1)}) as h from (select row, h, unnest(range(0, len(h) // 2, 400)) as b from t)) where len(h) >= {2 * LENGTH})
), later as (
  select row, k from (select row, k, row_number() over (partition by m order by row, k) as r from s) where r > 1
), i as (
  select row, k, case when k <= lag(k) over (partition by row order by k) + {LENGTH} then 0 else 1 end as new from later
), g as (
  select row, k, sum(new) over (partition by row order by k) as island from i
), sp as (
  select row, min(k) as lo, max(k) + {LENGTH} as hi from g group by row, island
), parts as (
  select row, coalesce(lag(hi) over (partition by row order by lo), 0) as a, lo as b from sp union all select row, max(hi), null from sp group by row
), kept as (
  select row, string_agg(substr(h, 2 * a + 1, coalesce(2 * (b - a), len(h))), '' order by a) as x from parts join t using (row) group by row
), n as (
  select row, count(*) as n_spans, sum(hi - lo) as n_removed from sp group by row
)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, h))) as kept_sha256 from t left join n using (row) left join kept using (row)
"""

#: op11: units by the contract's pattern, cut and joined as text.
OP11 = r"""
with t as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as x from documents
), h as (
  select *, len(u) as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from t
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:n], '') as suf from c
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from p
"""

#: op13: all pairs of an anchor and a row.
OP13 = """
with v as (
  select vec_id, min({'label': label, 'e': e}) as r from (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)) group by vec_id
), s as (
  select a.vec_id as anchor_id, v.vec_id, a.r.label = v.r.label as same, cast(list_dot_product(a.r.e, v.r.e) as bigint) as score from v as a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5
), n as (
  select anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op3_decontamination": OP3, "op6_suffix_dedup": OP6, "op7_line_dedup": OP7, "op11_fill_in_middle": OP11, "op13_hard_negatives": OP13}
