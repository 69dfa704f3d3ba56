"""SQL for the queries of this subpackage."""

import corpus_pipeline

from fleetlens.llm import quality_rules as q

_W = r"[^\x20\x09-\x0D]+"
_MENU = "length(t) - length(translate(t, '|»›·', ''))"
_SYM = "length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))"
_MD5 = "(('0x' || substr(md5(cast(doc_id as varchar)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"

_OP9 = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_W}') as ws from documents),
pos as (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from d where len(ws) > 8),
win as (select doc_id, i, list_slice(ws, i, i + 7) as g from pos),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) as c from win),
cov as (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as n from rep where c > 1),
rw as (select doc_id, sum(n)::BIGINT as n_repeat_words from cov group by doc_id),
ln as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
wl as (select doc_id, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t from ln),
jl as (select doc_id, line, t, len(regexp_extract_all(t, '{_W}')) as n from wl where t <> ''),
fl as (select doc_id, line, t,
  (not regexp_matches(t, '{q.ENDING.replace("'", "''")}') and n < {q.OPEN_LINE_WORDS})
  or ({_MENU} >= {q.MENU_SEPARATORS} and ({_MENU}) * 4 >= n)
  or {_SYM} > {q.SYMBOL_SHARE} * n
  or (not regexp_matches(t, '\p{{Ll}}') and regexp_matches(t, '\p{{Lu}}') and n >= 3)
  or len(regexp_extract_all(t, '{q.MARK_RUNS}')) > {q.MARK_SHARE} * n and contains(t, '!!')
  or (length(t) <= {q.BOILERPLATE_CHARS} and regexp_matches(t, '{q.BOILERPLATE}')) as failed from jl),
la as (select doc_id, count(*) - count(distinct line) as n_dup_lines,
  coalesce(sum(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))) filter (failed), 0)::BIGINT as lost_chars from fl group by doc_id),
b as (select doc_id, len(ws)::BIGINT as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT as n_symbols, coalesce(n_dup_lines, 0)::BIGINT as n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT as n_repeat_words, coalesce(lost_chars, 0)::BIGINT as lost_chars
  from d left join rw using (doc_id) left join la using (doc_id)),
f as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and lost_chars <= {q.LOST_SHARE} * word_chars as kept, lost_chars from f
"""

_OP5 = rf"""
with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT as size, {_MD5} as u from documents),
s as (select source, sum(size)::BIGINT as source_size from d group by source),
r as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s),
c as (select *, sum(2.0 * source_size) over o as capped, sum(w) over o as capped_w, row_number() over o as k, sum(source_size) over () * 1.5 as whole, sum(w) over () as all_w
  from r window o as (order by source_size / w, source nulls last rows unbounded preceding)),
lv as (select arg_min(level, k) as level from (
  select 0 as k, any_value(whole) / any_value(all_w) as level, min(2.0 * source_size / w) as next_cap from c
  union all select k, (whole - capped) / (all_w - capped_w), lead(2.0 * source_size / w) over (order by k) from c where all_w > capped_w) where next_cap is null or level <= next_cap),
g as (select source, source_size, least(2.0 * source_size, w * level) as target from c, lv),
k as (select *, case when size > 0 then length(bin(size)) * 8 + (case when length(bin(size)) > 4 then size >> (length(bin(size)) - 4) else size << (4 - length(bin(size))) end) % 8 else 0 end as class from d),
cw as (select source, class, sum(size) as words, pow(2.0, 0.125 * class / 8) as a from k where class > 0 group by source, class),
cl as (select w.source, class, a, (target - 2.0 * coalesce(sum(words) over (dn rows between unbounded preceding and 1 preceding), 0)) / sum(a * words) over (dn rows between current row and unbounded following) as level
  from cw w join g on w.source is not distinct from g.source window dn as (partition by w.source order by class desc)),
lf as (select source, arg_max(level, class) filter (level * a <= 2.0) as level from cl group by source),
ex as (select cl.source, class, greatest(0.0, least(2.0, coalesce(lf.level * a, 2.0))) as expected from cl join lf on cl.source is not distinct from lf.source),
x as (select k.doc_id, k.source, size, u, source_size, target, floor(coalesce(expected, 0.0)) as certain, coalesce(expected, 0.0) - floor(coalesce(expected, 0.0)) as p
  from k join g on k.source is not distinct from g.source left join ex on k.source is not distinct from ex.source and k.class = ex.class),
y as (select *, p > 0 and size > 0.001 * target as large, (u / (1 - u)) / (p / (1 - p)) as q from x),
l as (select source, list(struct_pack(doc_id := doc_id, size := size, p := p) order by size desc, u desc, doc_id desc) as docs from y where large group by source),
walk(source, docs, k, behind, chosen) as (
  select source, docs, 0, 0.0::double, null::BIGINT from l
  union all
  select source, docs, k + 1, case when behind + docs[k + 1].p * docs[k + 1].size >= docs[k + 1].size / 2 then behind + docs[k + 1].p * docs[k + 1].size - docs[k + 1].size else behind + docs[k + 1].p * docs[k + 1].size end,
    case when behind + docs[k + 1].p * docs[k + 1].size >= docs[k + 1].size / 2 then docs[k + 1].doc_id end from walk where k < len(docs)),
eb as (select source, arg_max(behind, k) as behind from walk group by source),
gp as (select y.source, coalesce(sum(p * size) filter (p > 0 and not large), 0) + coalesce(any_value(behind), 0) as gap from y left join eb on y.source is not distinct from eb.source group by y.source),
sm as (select y.doc_id, size, gap, sum(size) over (partition by y.source order by q, u, y.doc_id rows unbounded preceding) as running from y join gp on y.source is not distinct from gp.source where p > 0 and not large),
t as (select chosen from walk where chosen is not null union all select doc_id from sm where running - size / 2 <= gap)
select y.doc_id, y.size, y.source_size, y.target, (y.size * (y.certain + case when t.chosen is null then 0 else 1 end))::BIGINT as taken, y.source
from y left join t on y.doc_id = t.chosen
"""

_OP3 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings),
p as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as BIGINT) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as INTEGER) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""

# Base32: the 160 bits of the digest in groups of five.
_OP4 = """
with p as (select page_id, coalesce(html, '') as html from pages),
b as (select page_id, html, octet_length(encode(html)) as payload_bytes, unhex(sha1(html))::BIT::VARCHAR as bits,
  max(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(1, 6), lambda k: (ascii(substr(bits, cast(5 * i + k as INTEGER), 1)) - 48) * (1 << cast(5 - k as INTEGER)))) as INTEGER), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from b
"""

# The program row by row: a list of (state, cost, audit, repaired rows) per conversation; states as letters.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _best(candidates: str) -> str:
    """The least (cost, audit) of each state of a list of candidates."""
    return f"""list_filter(list_transform(['', 's', 'u', 'a'], lambda st: list_sort(list_filter({candidates}, lambda c: c.st = st))[1]), lambda c: c is not null)"""


def _step(st: str, cost: str, edit: str, row: str | None) -> str:
    """A candidate after ``e``."""
    return f"{{'st': {st}, 'cost': e.cost + {cost}, 'audit': e.audit || '{edit}', 'fixed': " + (f"list_append(e.fixed, {row})" if row else "e.fixed") + "}"


_INS = lambda p: _best(f"list_concat({p}, list_transform(list_filter({p}, lambda e: e.st <> 'u'), lambda e: {_step("'u'", '3', 'I', "'user:'")}))")
_INA = lambda p: _best(f"list_concat({p}, list_transform(list_filter({p}, lambda e: e.st = 'u'), lambda e: {_step("'a'", '3', 'I', "'assistant:'")}))")
_KEEP = "list_filter(p2, lambda e: (i = 'u' and e.st <> 'u') or (i = 'a' and e.st = 'u') or (i = 's' and e.st = ''))"
_OP11 = f"""
with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: ascii(c)::BIGINT),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT) as crc from conversations),
f as (select *, xor(crc, 4294967295) % 20 as fate from o),
d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role,
  case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text from f, unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) as u(copy)),
r as (select *, row_number() over w as k, rtrim(text, {_WS}) as tail,
  lag(role) over w as was from d window w as (partition by conv_id order by turn nulls first, role, text)),
q as (select *, row_number() over (partition by conv_id, role, text order by k) as seen from r),
g as (select conv_id, k, turn, role, text, was, left(role, 1) as i, case when tail = '' then 1 when seen > 1 then 2 when right(tail, 1) not in ('.', '!', '?') then 3 else 0 end as fault from q),
walk(conv_id, k, p) as (
  select distinct conv_id, 0::BIGINT, [{{'st': '', 'cost': 0, 'audit': '', 'fixed': []::VARCHAR[]}}] from g
  union all
  select conv_id, k, {_best(f"list_concat(list_transform(p2, lambda e: {_step('e.st', '4', 'D', None)}), case when fault in (1, 2) then [] else list_concat("
    + "list_transform(p2, lambda e: " + _step("case when e.st = 'u' then 'a' else 'u' end", "3 + case when fault = 3 then 3 else 0 end", "R", "case when e.st = 'u' then 'assistant:' else 'user:' end || text") + "), "
    + f"list_transform({_KEEP}, lambda e: " + _step("i", "case when fault = 3 then 3 else 0 end", "K", "role || ':' || text") + ")) end)")}
  from (select conv_id, k, text, role, i, fault, {_INA('p1')} as p2 from (
    select g.conv_id, g.k, g.text, g.role, g.i, g.fault, {_INS('w.p')} as p1 from walk w join g on g.conv_id is not distinct from w.conv_id and g.k = w.k + 1))),
ends as (select conv_id, {_INA('p1')} as p from (select conv_id, {_INS('arg_max(p, k)')} as p1 from walk group by conv_id)),
b as (select conv_id, list_sort(list_transform(list_filter(p, lambda e: e.st in ('', 'a')), lambda e: {{'cost': e.cost, 'audit': e.audit, 'fixed': e.fixed}}))[1] as z from ends),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
  count(*) filter (fault = 3) as truncated, count(*) filter (was is not null and left(was, 1) || i not in ('su', 'ua', 'au')) as illegal from g group by conv_id)
select c.conv_id, coalesce(gaps, 0)::BIGINT as gaps, coalesce(blank, 0)::BIGINT as blank, coalesce(duplicate, 0)::BIGINT as duplicate, coalesce(truncated, 0)::BIGINT as truncated,
  coalesce(illegal, 0)::BIGINT as illegal, coalesce(z.cost, 0)::BIGINT as cost, coalesce(z.audit, '') as audit, sha256(coalesce(array_to_string(z.fixed, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join n on c.conv_id is not distinct from n.conv_id left join b on c.conv_id is not distinct from b.conv_id
"""

ORACLE = {"op11_structure_repair": _OP11, "op3_maxscore": _OP3, "op4_warc": _OP4, "op9_quality_rules": _OP9, "op5_mixing": _OP5}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
