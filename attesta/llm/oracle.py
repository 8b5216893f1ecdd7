"""DuckDB SQL that states the same results as the queries."""

#: The rules, patterns and the scope that the SQL states on its own, apart from the operators.
RULES = {"failed": "base_failed", "short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines"}
#: kind: pattern, group of the value, its least length, class (secret, identifier, endpoint), strong
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "s", True),
    "access": ("AKIA[A-Z0-9]+", 0, 20, "i", True),
    "hex": ("[0-9a-f]+", 0, 24, "s", True),
    "ident": (r"""(?i:(username|user|login|account_?id|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 2, 3, "i", False),
    "token": ("[A-Za-z0-9+/_-]{20,}", 0, 20, "s", False),
    "endpoint": ("(?:https?|s3|postgresql|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9._~:/?@%+=&-]*", 0, 8, "e", False),
}
SCOPE = 256

SQL: dict[str, str] = {}

SQL["op1_quality_rules"] = r"""
with base as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from base where len(ws) >= 5),
keyed as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as k from windows),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from keyed) where c > 1),
covered as (select doc_id, count(distinct i + o) as n from twice, (select unnest(range(5)) as o) group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from base),
dups as (select doc_id, count(*) as lines, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
stats as (
  select b.doc_id, b.source, len(ws)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(d.n, 0)::bigint as n_dup_lines, coalesce(d.lines, 0)::bigint as n_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from base b left join dups d using (doc_id) left join covered c using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from stats),
""" + ",\n".join([
    "hosts as (select source, count(*)::double as n, " + ", ".join(f"count_if({rule})::double as f_{r}" for r, rule in RULES.items()) + " from judged group by source)",
    "moments as (select sum(n) as n, count(*) as k, " + ", ".join(f"sum(f_{r}) / sum(n) as m_{r}, sum(n * (f_{r} / n) * (f_{r} / n)) / sum(n) as r2_{r}" for r in RULES) + " from hosts)",
    "spread as (select *, " + ", ".join(f"greatest(r2_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * k / n, 0) as v_{r}" for r in RULES) + " from moments)",
    "prior as (select *, " + ", ".join(f"case when v_{r} <= 0 then 1000 else least(1000, greatest(2, m_{r} * (1 - m_{r}) / nullif(v_{r}, 0) - 1)) end as w_{r}" for r in RULES) + " from spread)",
    "verdicts as (select h.*, " + " or ".join(f"(f_{r} + m_{r} * w_{r}) / (h.n + w_{r}) > 0.5" for r in RULES) + " as rejected from hosts h, prior)",
]) + """
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected as kept, v.n::bigint as host_docs, """ + ", ".join(f"v.f_{r}::bigint as host_{r}" for r in RULES) + """
from judged j join verdicts v on j.source is not distinct from v.source
"""

SQL["op7_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
keys as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
frequent as (select key, max(doc_id) as last from keys where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, f.key is not null and k.doc_id <> f.last as gone from keys k left join frequent f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

SQL["op3_chat_format"] = r"""
with turns as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
placed as (select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as pos from turns),
convs as (
  select conv_id, count(*) as n_turns, list(struct_pack(r := role, t := text) order by pos) as said,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by pos) as rendered
  from placed group by conv_id),
ends as (select said, any_value(n_turns) as n_turns, min(conv_id) as conv_id, count(*) as n_same, any_value(rendered) as rendered from convs group by said),
inner_prefixes as (select distinct said[1:k] as said from (select said, unnest(range(1, n_turns)) as k from convs))
select conv_id, 0::bigint as part, n_turns::bigint as n_turns, n_same::bigint as n_same, length(rendered)::bigint as n_chars, sha256(rendered) as rendered_sha256
from ends e where not exists (select 1 from inner_prefixes p where p.said = e.said)
"""

SQL["op9_minhash_dedup"] = r"""
with recursive base as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
shingled as (
  select doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as k from base where len(ws) >= 3
  union all select doc_id, array_to_string(ws, ' ') from base where len(ws) in (1, 2)),
sets as (select distinct doc_id, k from shingled),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.k = b.k and a.doc_id < b.doc_id group by all),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, b.y from reach join both_ways b on b.x = reach.r),
roots as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from roots left join sizes using (doc_id)
"""


def _spans(kind: str) -> str:
    """doc_id, rank, s, e, strong of a kind's passing matches: running sums over gaps and matches."""
    pattern, group, least, cls, strong = KINDS[kind]
    q = "'" + pattern.replace("'", "''") + "'"
    mixed = " and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')" if kind == "token" else ""
    return f"""select doc_id, {list(KINDS).index(kind)} as rank, '{kind}' as kind, '{cls}' as cls, {strong} as strong, s, s + length(m) as e from (
  select doc_id, m, v, sum(length(g)) over (partition by doc_id order by i) + coalesce(sum(length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s
  from (select doc_id, unnest(range(len(ms))) as i, unnest(ms) as m, unnest(vs) as v, unnest(gs[1:len(ms)]) as g
    from (select doc_id, regexp_extract_all(text, {q}) as ms, regexp_extract_all(text, {q}, {group}) as vs, string_split_regex(text, {q}) as gs from texts)))
where length(v) >= {least}{mixed}"""


SQL["op2_secret_scan"] = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(map(_spans, KINDS))}),
parts as (select * from found w where strong or not exists (select 1 from found x where x.strong and x.doc_id = w.doc_id and x.s < w.e and w.s < x.e)),
near as (
  select w.doc_id, w.rank, w.kind, w.s, w.e, bool_or(x.cls = 's') as s_near, bool_or(x.cls = 'i') as i_near, bool_or(x.cls = 'e') as e_near
  from parts w join parts x on x.doc_id = w.doc_id and abs(x.s - w.s) <= {SCOPE} where not w.strong group by all),
linked as (select * from near where case kind when 'ident' then s_near when 'token' then i_near or e_near else i_near and s_near end),
every as (select doc_id, rank, kind, s, e, true as strong from parts where strong union all select doc_id, rank, kind, s, e, false from linked)
select d.doc_id, (count(*) filter (where kind = 'assign'))::bigint as n_assign, (count(*) filter (where kind = 'access'))::bigint as n_access, (count(*) filter (where kind = 'hex'))::bigint as n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where strong), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank), '') as spans, (count(*) filter (where not strong))::bigint as n_linked
from documents d left join every v on v.doc_id = d.doc_id group by d.doc_id
"""

SQL["op12_source_divergence"] = r"""
with recs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
said as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from recs),
kept as (select lang, term, count(*)::hugeint as c from said group by all having count(distinct r) >= 30),
counts as (select s.lang, s.source, s.term, count(*)::hugeint as c from said s semi join kept k on k.lang = s.lang and k.term = s.term group by all),
langs as (select lang, count(*)::hugeint as v, sum(c)::hugeint as n from kept group by lang),
teams as (select g.lang, g.source, coalesce(l.v, 0)::hugeint as v, l.n as lang_n, coalesce((select sum(c) from counts c where c.lang = g.lang and c.source = g.source), 0)::hugeint as n
  from (select distinct lang, source from recs) g left join langs l on l.lang = g.lang),
shares as (select t.lang, t.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (t.n + 5 * t.v) as p, 1 + (1000000000::hugeint * (k.c + 5)) // (t.lang_n + 5 * t.v) as q
  from teams t join kept k on k.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value from teams a join teams b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from shares where c > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from every
qualify part = 'pair' or rank <= 50
"""

SQL["op13_phrases"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
parts as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
placed as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from parts where len(ws) > 0),
grams as (select lang, k as size, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*)::hugeint as f from placed, (select unnest([1, 2, 3])::int as k) where i + k - 1 <= len(ws) group by all),
totals as (select lang, sum(f)::bigint as n from grams where size = 1 group by lang),
cands as (select *, string_split(phrase, ' ') as ws from grams where size > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.f as a, k, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f) // (x.f * y.f) as score
  from (select *, unnest(range(1, size)) as k from cands) c join grams x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1:k], ' ') join grams y on y.lang = c.lang and y.phrase = array_to_string(c.ws[k + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_pairs as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, f from cands where size = 3),
longest as (select lang, phrase, max(f) as most from inner_pairs group by all),
kept as (select w.* from lowest w left join longest g using (lang, phrase) where g.most is null or 100 * g.most < 50 * w.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from kept join totals using (lang) qualify rank <= 2000
"""
