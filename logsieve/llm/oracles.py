"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: Windows of words as text, by a running aggregate; each repeated one covers its words.
OP7 = r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
lists as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from docs),
words as (select rid, unnest(ws) as w, unnest(range(len(ws))) as i, len(ws) as n from lists),
windows as (select rid, i, n, case when i + 8 <= n then string_agg(w, chr(31)) over (a rows between current row and 7 following) end as w8,
    case when i + 6 <= n then string_agg(w, chr(31)) over (a rows between current row and 5 following) end as w6,
    case when i + 61 <= n then md5(string_agg(w, chr(31)) over (a rows between current row and 60 following)) end as w61
  from words window a as (partition by rid order by i)),
counted as (select rid, i, w8 is not null and count(*) over (partition by rid, w8) > 1 as r8, w6 is not null and count(*) over (partition by rid, w6) > 1 as r6, w61 is not null and count(*) over (partition by rid, w61) > 1 as r61 from windows),
covered as (select rid, bool_or(r8) over (partition by rid order by i rows between 7 preceding and current row) as c8, bool_or(r6) over (partition by rid order by i rows between 5 preceding and current row) as c6, r61 from counted),
sums as (select rid, count(*) filter (c8) as n_repeat_words, count(*) filter (c6) as covered_words, bool_or(r61) as too_long from covered group by rid),
sizes as (select rid, count(*) as n_words, cast(sum(length(w)) as bigint) as word_chars from words group by rid),
parts as (select rid, unnest(string_split(text, chr(10))) as line from docs),
lines as (select rid, count(*) - count(distinct line) as n_dup_lines from parts where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_words, 0) < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (coalesce(n_words, 0) < 20 or 100 * n_repeat_words > 30 * n_words) and covered_words <= 0.25 * n_words and not too_long as kept, coalesce(covered_words, 0) as covered_words
from docs left join sizes using (rid) left join sums using (rid) left join lines using (rid)
"""

#: Bytes as hexadecimal text; every window of 200 bytes is counted.
OP9 = """
with docs as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as hx from documents),
starts as (select rid, unnest(range(length(hx) // 2 - 199)) as i from docs where length(hx) >= 400),
windows as (select rid, i, md5(substr(hx, 2 * i + 1, 400)) as s from starts join docs using (rid)),
twice as (select s from windows group by s having count(*) > 1),
hits as (select rid, i, i - lag(i) over (partition by rid order by i) as step from windows semi join twice using (s)),
numbered as (select rid, i, sum(case when step <= 200 then 0 else 1 end) over (partition by rid order by i) as g from hits),
spans as (select rid, min(i) as a, max(i) + 200 as b from numbered group by rid, g),
gaps as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before from spans),
cut as (select rid, count(*) as n_spans, cast(sum(b - a) as bigint) as n_removed, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(hx), 2 * max(b) + 1) as kept from gaps join docs using (rid) group by rid)
select doc_id, length(hx) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, hx))) as kept_sha256 from docs left join cut using (rid)
"""

#: crc32 by its definition over the digits; prefixes as lists, and each node's sums carried to all its prefixes.
OP12 = r"""
with own as (select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as l from conversations where conv_id is not null group by 1),
heads as (select c, l, xor(list_reduce([ascii(x) for x in string_split(cast(c as varchar), '')],
    lambda a, b: list_reduce(range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(a, cast(b as bigint))), cast(4294967295 as bigint)), 4294967295) % 4 as h from own),
whole as (select a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) as l from heads a left join own b on b.c = a.c - a.c % 20),
members as (select c, d, l[1:d] as p, len(l) = d as ends from (select c, l, unnest(range(len(l) + 1)) as d from whole)),
nodes as (select p, d, min(c) as conv_id, count(*) as n, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (ends), '')) as ends_sha256, case when d > 0 then (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) else 0 end as own from members group by 1, 2),
kids as (select p[1:d - 1] as p, count(*) as k from nodes where d > 0 group by 1),
told as (select nodes.*, coalesce(k, 0) as k from nodes left join kids using (p)),
sums as (select p[1:u] as p, sum(own) as saved, count(*) filter (k = 0) as leaves from (select *, unnest(range(d + 1)) as u from told) group by 1)
select n.conv_id, n.d as depth, case when n.d > 0 then m.conv_id end as parent_conv_id, n.n as n_convs, n.k as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, n.ends_sha256
from told n join sums using (p) left join nodes m on n.d > 0 and m.p = n.p[1:n.d - 1]
"""

#: What is read back is the turns themselves; lengths count the backslashes that escapes add.
_ADDED = "(2 * length({0}) - length(replace({0}, '\\', '')) + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all({0}, '#{{3,}}')]), 0) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7)"
_MOVE = "case s || ' ' || r when 'start system' then 'told' when 'start user' then 'asked' when 'told user' then 'asked' when 'asked assistant' then 'answered' when 'answered user' then 'asked' when 'answered tool' then 'returned' when 'returned tool' then 'returned' when 'returned assistant' then 'answered' else 'none' end"
OP13 = f"""
with given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, false as made from conversations
  union all select -7, i, ['user', 'assistant'][i + 1], '\\### Assistant: </turn> ok', true from range(2) r(i)),
sized as (select *, 4 + case when role in ('system', 'user', 'assistant', 'tool') then length(role) else 1 + {_ADDED.format("role")} + (length(role) - length(replace(role, ': ', ''))) // 2 end + 2 + {_ADDED.format("text")} + 8 as size from given),
told as (select conv_id, made, count(*) as n_turns, list(role order by turn nulls first, role, text) as roles, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
  coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as learned, sum(size) as size from sized group by 1, 2),
ran as (select *, [list_reduce(roles[1:i], lambda s, r: {_MOVE}, 'start') for i in range(1, n_turns + 1)] as states from told)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(learned) as loss_chars, sha256(learned) as loss_sha256, cast(size as bigint) as formatted_chars,
  cast(case when list_contains(states, 'none') then list_position(states, 'none') when states[n_turns] <> 'answered' then n_turns + 1 end as bigint) as bad_turn from ran
"""

ORACLES = {"op7_quality_rules": OP7, "op9_suffix_dedup": OP9, "op12_prefix_trie": OP12, "op13_chat_format": OP13}
