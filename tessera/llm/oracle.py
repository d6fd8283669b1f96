"""SQL of the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Five hexadecimal digits of the SHA-1 give four characters.
_DIGEST = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(h, {5 * g + 1}, 5))::bigint >> {shift}) & 31)::int + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))

WARC = f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
f as (select h, min(page_id) first_id from p group by h)
select page_id, octet_length(encode(html))::bigint payload_bytes, {_DIGEST} payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to
from p join f using (h)
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

DECONTAMINATION = f"""
with d as (select doc_id, {_WORDS} ws from documents),
i as (select item_id, ws, least(10, len(ws))::bigint n from (select item_id, {_WORDS} ws from benchmark) where len(ws) > 0),
iw as (select distinct item_id, n, array_to_string(ws[s:s + n - 1], ' ') k from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) s from i)),
dw as (select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') k from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) s from d cross join (select distinct n from i) where len(ws) >= n)),
hit as (select doc_id, s, n, item_id from dw join iw using (n, k)),
h as (select doc_id, count(distinct w) n_hit from (select doc_id, unnest(range(s, s + n)) w from (select distinct doc_id, s, n from hit)) group by doc_id),
m as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from hit) group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join m using (doc_id)
"""

EMBEDDINGS = """
with recursive v as (select vec_id, embedding::double[] e from embeddings),
ok as (select vec_id, e from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) m from reach group by a),
n as (select a, count(*) c from links group by a)
select vec_id, coalesce(c, 0)::bigint n_links, m component_id, vec_id = m kept
from v join least on least.a = vec_id left join n on n.a = vec_id
"""

#: CRC-32 of a list of bytes; its table comes from the polynomial. Unsigned.
_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) k"


def _crc(text: str) -> str:
    """CRC-32 of the text's UTF-8 bytes by the table k; unsigned."""
    return f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)), lambda c, b: xor(c >> 8, k[1 + (xor(c, b) & 255)])), 4294967295)::bigint"



SHARDING = f"""
with t as ({_CRC_TABLE}),
d as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 8 size, {_crc("coalesce(text, '')")} text_crc32 from documents, t),
r as (select *, sum(size) over (order by doc_id nulls first, text_crc32 rows unbounded preceding) upto, sum(size) over () whole from d),
s as (select *, least(((2 * upto - size)::hugeint * 24 // (2 * whole))::int, 23) shard from r)
select doc_id, size, text_crc32, 'bytes' law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32) - 1 slot, null::int grown_shard from s
"""

#: A line, or a sentence of one: what stands before a break, and the break.
_UNIT = r"([^\n]*?)(\n+|[.!?\x{2026}][!-/:-@\[-`{-~\x{bb}\x{2018}-\x{201f}\x{2026}\x{203a}]*[ \t]+|$)"

LINE_DEDUP = f"""
with p as (select doc_id, regexp_extract_all(text, '{_UNIT}', 1) a, regexp_extract_all(text, '{_UNIT}', 2) b from documents where text is not null),
u as (select doc_id, unnest(range(len(a))) i, unnest(a) a, unnest(b) b from p),
o as (select doc_id, i, a || regexp_replace(b, '[ \\t\\n]+$', '') unit, sum(octet_length(encode(a || b))) over (partition by doc_id order by i) - octet_length(encode(a || b)) start from u),
w as (select doc_id, i, start, start + octet_length(encode(unit)) stop, regexp_extract_all(translate(unit, '{_UPPER}', '{_LOWER}'), '[^ \\t\\n\\x0b\\f\\r]+') ws from o),
k as (select doc_id, start, stop, len(ws) n, ws, array_to_string(ws, ' ') digest, row_number() over (partition by doc_id order by i) idx from w where len(ws) > 0),
e as (select *, lag(ws) over d pw, lead(ws) over d nw from k window d as (partition by doc_id order by idx)),
c as (select *, case when len(pw) >= 5 then array_to_string(pw[-5:], ' ') end pe, case when len(nw) >= 5 then array_to_string(nw[:5], ' ') end ne from e),
m as (select *, first_value(doc_id) over f kept, row_number() over f occurrence, pe is not null and count(*) over (partition by digest, pe) > 1 l, ne is not null and count(*) over (partition by digest, ne) > 1 r from c window f as (partition by digest order by doc_id nulls last, idx)),
g as (select *, idx - row_number() over (partition by doc_id order by idx) run from m where occurrence > 1),
s as (select doc_id, min(start) start, max(stop) stop, sum(n) n, min(kept) kept, arg_min(l, idx)::int + arg_max(r, idx)::int edges from g group by doc_id, run),
x as (select *, n >= 20 or (edges > 0 and n + 5 * edges >= 16) passage from s),
y as (select doc_id, coalesce(sum(n) filter (passage), 0) n_hit, sum(n) n_repeated, string_agg(start || '-' || stop || ':' || kept || ':' || n || case when passage then '*' else '' end, ' ' order by start) spans from x group by doc_id),
z as (select doc_id, sum(n) n_words from k group by doc_id)
select doc_id, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_words, 0)::bigint n_words, coalesce(n_repeated, 0)::bigint n_repeated, coalesce(spans, '') spans
from documents left join z using (doc_id) left join y using (doc_id)
"""

_NOT_BLANK = r"[^\x20\x09-\x0D]"

#: A step of the search takes one row: before it at most one insert (two lead back), then an edit; the best of each state goes on.
CONVERSATIONS = f"""
with recursive t as ({_CRC_TABLE}),
o as (select conv_id, turn, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') place, coalesce(role, ' ') role, coalesce(text, ' ') text from conversations),
f as (select *, ({_crc('place')}) % 20 fate from o, t),
d as (select conv_id, turn, case when fate = 4 then 'user' else role end role, case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end text, unnest(range(case fate when 3 then 2 else 1 end)) copy from f where fate <> 0),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(role || ':' || text), copy) i from d),
w as (select *, not regexp_matches(text, '{_NOT_BLANK}') blank, row_number() over (partition by conv_id, role, text order by i) > 1 seen, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') cut, left(role, 1) c, left(lag(role) over (partition by conv_id order by i), 1) p from r),
x as (select conv_id, i, role, text, c, p, turn, blank, seen and not blank seen, cut and not seen and not blank cut, blank or seen gone from w),
n as (select conv_id, count(*) rows_, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (seen) dup, count(*) filter (cut) cut, count(*) filter (i > 1 and c || p is not null and (p || c) not in ('su', 'ua', 'au')) illegal from x group by conv_id),
e(state, letters, to_, ins, cost) as (values (0, '', 0, '', 0), (1, '', 1, '', 0), (2, '', 2, '', 0), (3, '', 3, '', 0), (0, 'I', 2, chr(10) || 'user:', 2), (1, 'I', 2, chr(10) || 'user:', 2), (2, 'I', 3, chr(10) || 'assistant:', 2), (3, 'I', 2, chr(10) || 'user:', 2)),
k(state, c, to_) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
s(conv_id, i, state, cost, audit, body) as (
  select distinct conv_id, 0::bigint, 0, 0::bigint, '', '' from x
  union all
  select conv_id, i, state, b.cost, b.audit, b.body from (
    select conv_id, i, state, min({{'cost': cost, 'audit': audit, 'body': body}}) b from (
      select s.conv_id, x.i, e.to_ state, s.cost + e.cost + 3 cost, s.audit || e.letters || 'D' audit, s.body || e.ins body from s join x on x.conv_id is not distinct from s.conv_id and x.i = s.i + 1 join e on e.state = s.state
      union all
      select s.conv_id, x.i, k.to_, s.cost + e.cost + x.cut::int, s.audit || e.letters || 'K', s.body || e.ins || chr(10) || x.role || ':' || x.text from s join x on x.conv_id is not distinct from s.conv_id and x.i = s.i + 1 join e on e.state = s.state join k on k.state = e.to_ and k.c = x.c where not x.gone
      union all
      select s.conv_id, x.i, case e.to_ when 2 then 3 else 2 end, s.cost + e.cost + 2 + x.cut::int, s.audit || e.letters || 'R', s.body || e.ins || chr(10) || case e.to_ when 2 then 'assistant' else 'user' end || ':' || x.text from s join x on x.conv_id is not distinct from s.conv_id and x.i = s.i + 1 join e on e.state = s.state where not x.gone
    ) group by conv_id, i, state)
),
z as (select s.conv_id, min({{'cost': s.cost + case s.state when 1 then 4 when 2 then 2 else 0 end, 'audit': audit || case s.state when 1 then 'II' when 2 then 'I' else '' end, 'body': body || case s.state when 1 then chr(10) || 'user:' || chr(10) || 'assistant:' when 2 then chr(10) || 'assistant:' else '' end}}) b from s join n on n.conv_id is not distinct from s.conv_id and n.rows_ = s.i group by s.conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(dup, 0)::bigint duplicate, coalesce(cut, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(z.b.cost, 0)::bigint cost, coalesce(z.b.audit, '') audit, sha256(coalesce(z.b.body[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join z on z.conv_id is not distinct from c.conv_id
"""
