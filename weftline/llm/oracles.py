"""SQL for DuckDB that says the same as the queries, where SQL can."""

from weftline.llm import op5_licenses as lic
from weftline.llm import op7_quality as q
from weftline.llm.op8_lines import ORACLE_SQL as LINES
from weftline.llm.op13_interaction import ORACLE_SQL as AUDIT

#: The smallest id reachable over (a, b) links in both directions.
_REACH = """
both_ways as (select a, b from links union select b, a from links),
reach(root, id) as (select distinct a, a from both_ways union select r.root, w.b from reach r join both_ways w on w.a = r.id),
least as (select root as id, min(id) as component from reach group by root)
"""

JACCARD = (
    r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents
),
s as (
  select doc_id, unnest(case when len(l) >= 5 then list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' '))) when len(l) > 0 then [array_to_string(l, ' ')] else [] end) as shingle from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
"""
    + _REACH
    + """
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(l.component, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join least l on l.id = d.doc_id
"""
)

VECTORS = (
    """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9),
"""
    + _REACH
    + """
select m.vec_id, (select count(*) from both_ways w where w.a = m.vec_id) as n_links, coalesce(l.component, m.vec_id) as component_id, coalesce(l.component, m.vec_id) = m.vec_id as kept
from embeddings m left join least l on l.id = m.vec_id
"""
)



def _distance(p: str, r: str) -> str:
    """Jensen-Shannon between two lists."""
    part = lambda x, y: f"case when {x} > 0 then {x} * log2({x} * 2 / ({x} + {y})) else 0 end"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(f'{p}[i]', f'{r}[i]')} + {part(f'{r}[i]', f'{p}[i]')}) / 2))))"


def _quality() -> str:
    lists = "case lang " + " ".join(f"when '{k}' then {ws}" for k, ws in q.COMMON.items()) + " end"
    bins = len(q.COMMON["en"]) + 1
    mean = lambda h, n: "[" + ", ".join(f"avg({h}[{i}])" for i in range(1, n + 1)) + "]"
    reference = lambda source: f"select lang, {mean('classes', 6)} as rc, {mean('common', bins)} as rw from {source} group by lang having count(*) >= {q.MIN_REFERENCE}"
    rounds = f"m0 as ({reference('sound')})"
    for i, radius in enumerate(q.RADII):
        rounds += f", m{i + 1} as ({reference(f'(select s.* from sound s join m{i} m on m.lang is not distinct from s.lang where {_distance("s.classes", "m.rc")} <= {radius})')})"
    return rf"""
with w as (
  select doc_id, lang, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l,
    regexp_replace(coalesce(text, ''), '[\p{{Ll}}\x20\x09-\x0D]+', '', 'g') as rest, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as inked
  from documents
),
tri as (select doc_id, unnest(range(1, len(l) - 1)) as i, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i : i + 2])) as t from w where len(l) > 2),
twice as (select doc_id, i, count(*) over (partition by doc_id, t) as c from tri),
covered as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) v(k) where c > 1 group by doc_id),
lines as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(text, chr(10))) as x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
counts as (
  select doc_id, lang, len(l)::bigint as n_words, length(array_to_string(l, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
    [inked - length(rest), length(text) - inked, length(rest) - length(regexp_replace(rest, '\p{{Lu}}+', '', 'g')), length(rest) - length(regexp_replace(rest, '\p{{Nd}}+', '', 'g')), length(rest) - length(regexp_replace(rest, '[.,;:!?''"()\-]+', '', 'g'))] as c5, length(rest) as n_rest,
    {lists} as own, list_transform(l, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as low
  from w
),
lists as (
  select *, list_append(c5, n_rest - c5[3] - c5[4] - c5[5]) as c6, list_transform(own, lambda c: len(list_filter(low, lambda x: x = c))) as found from counts
),
f as (
  select l.doc_id, l.lang, n_words, word_chars, n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    case when list_sum(c6) > 0 then list_transform(c6, lambda x: x / list_sum(c6)) end as classes,
    case when n_words > 0 and own is not null then list_transform(list_append(found, n_words - list_sum(found)), lambda x: x / n_words) end as common
  from lists l left join lines using (doc_id) left join covered using (doc_id)
),
held as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words as base_failed from f),
sound as (select * from held where not base_failed and word_chars >= {q.MIN_CHARS}),
{rounds},
measured as (
  select h.*, case when word_chars >= {q.MIN_CHARS} and m.rc is not null then {_distance('h.classes', 'm.rc')} end as dc,
    case when n_words >= {q.MIN_JUDGED_WORDS} and common is not null and m.rw is not null then {_distance('h.common', 'm.rw')} end as dw
  from held h left join m{len(q.RADII)} m on m.lang is not distinct from h.lang
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce(dc, 0) > {q.MAX_CLASS} or (coalesce(dc, 0) > {q.BOTH_CLASS} and coalesce(dw, 0) > {q.BOTH_WORD})) as kept, round(dc, 4) as class_distance, round(dw, 4) as word_distance
from measured
"""


QUALITY = _quality()



def _licences() -> str:
    rows = lambda xs: ", ".join(str(tuple(x)) for x in xs)
    terms = rows((t, p, w) for t, (_, ts, _) in enumerate(lic.TEMPLATES) for p, w in ts)
    keys = rows((t, p, w) for t, (_, _, ks) in enumerate(lic.TEMPLATES) for p, w in ks)
    names = rows((t, label) for t, (label, _, _) in enumerate(lic.TEMPLATES))
    phrases = rows((label, k, w, len(p.split())) for p, label in lic.PHRASES.items() for k, w in enumerate(p.split()))
    return rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as l from documents),
terms(t, p, w) as (values {terms}), keys(t, p, w) as (values {keys}), names(t, label) as (values {names}), phrases(label, k, w, n) as (values {phrases}),
hits as (select * from (select doc_id, unnest(range(0, len(l))) as i, unnest(l) as w from d) where w in {tuple(lic.VOCABULARY)}),
seen as (select w, count(distinct doc_id) as c from hits group by w),
rarest as (select t, p, w from (select t, p, k.w, row_number() over (partition by t order by coalesce(c, 0), p, k.w) as r from keys k left join seen on seen.w = k.w) where r <= {lic.VOTES}),
votes as (select h.doc_id, r.t, h.i - r.p as o, count(*) as n from hits h join rarest r on r.w = h.w group by all having count(*) = {lic.VOTES}),
keyed as (select v.doc_id, v.t, v.o, count(distinct k.p) as n from votes v join keys k on k.t = v.t join hits h on h.doc_id = v.doc_id and h.i = v.o + k.p and h.w = k.w group by all),
good as (select doc_id, t, o from keyed where n = (select count(*) from keys k where k.t = keyed.t)),
shares as (select g.doc_id, g.t, g.o, count(h.w) / count(*) as share from good g join terms t on t.t = g.t left join hits h on h.doc_id = g.doc_id and h.i = g.o + t.p and h.w = t.w group by g.doc_id, g.t, g.o),
base as (select h.doc_id, p.label, h.i - p.k as place from hits h join phrases p on p.w = h.w group by h.doc_id, p.label, h.i - p.k, p.n having count(distinct p.k) = p.n),
b as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by doc_id),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base union select doc_id, label from good join names using (t)) group by doc_id),
best as (select doc_id, max(share) as share from shares group by doc_id)
select d.doc_id, len(l)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from d left join b using (doc_id) left join every using (doc_id) left join best using (doc_id)
"""


LICENCES = _licences()


QUOTES = r"""
with recursive raw as (select conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from conversations),
marked as (select *, regexp_extract(x, '^[ \t]*(?:>[ \t]?)+') as m from raw),
lines as (
  select conv_id, turn, role, i, length(m) - length(replace(m, '>', '')) as level, case when m = '' then x else substr(x, length(m) + 1) end as line,
    trim(regexp_replace(lower(case when m = '' then x else substr(x, length(m) + 1) end), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as words
  from marked
),
own as (
  select conv_id, turn, role, max(level)::bigint as max_level, trim(coalesce(string_agg(line, chr(10) order by i) filter (level = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as content
  from lines group by all
),
islands as (
  select *, i - row_number() over (partition by conv_id, turn, level order by i) as g0,
    i - row_number() over (partition by conv_id, turn, level, words = '' order by i) as g1 from lines
),
quoted as (
  select conv_id, turn, 0 as rank, string_agg(words, ' ' order by i) filter (words <> '') as t from islands where level = 1 group by conv_id, turn, g0
  union select conv_id, turn, 1, string_agg(words, ' ' order by i) from islands where level = 1 and words <> '' group by conv_id, turn, g1
  union select conv_id, turn, 2, words from lines where level = 1 and len(string_split(words, ' ')) >= 3
),
asked as (select distinct * from quoted where t is not null and t <> ''),
pieces as (
  select conv_id, turn, content as p from own union all select conv_id, turn, unnest(regexp_split_to_array(content, '\n[\x20\x09-\x0D]*\n')) from own
  union all select conv_id, turn, x from (select conv_id, turn, unnest(string_split(content, chr(10))) as x from own) where len(string_split(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ')) >= 3
),
spoken as (select conv_id, turn, trim(regexp_replace(lower(p), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as t from pieces),
first as (select conv_id, t, min(turn) as said from spoken where t <> '' group by all),
parents as (select a.conv_id, a.turn, arg_min(said, (rank, -said)) as parent from asked a join first f on f.conv_id is not distinct from a.conv_id and f.t = a.t where said < a.turn group by all),
up(conv_id, turn, top, depth) as (
  select conv_id, turn, parent, 1::bigint from parents
  union all select u.conv_id, u.turn, p.parent, u.depth + 1 from up u join parents p on p.conv_id is not distinct from u.conv_id and p.turn = u.top
),
roots as (select conv_id, turn, arg_max(top, depth) as root, max(depth) as depth from up group by all),
paths(conv_id, turn, path) as (
  select distinct o.conv_id, o.turn, [o.turn] from own o where not exists (select 1 from parents p where p.conv_id is not distinct from o.conv_id and p.turn = o.turn)
  union all select c.conv_id, c.turn, list_append(p.path, c.turn) from paths p join parents c on c.conv_id is not distinct from p.conv_id and c.parent = p.turn
)
select o.conv_id, o.turn, o.role, coalesce(r.root, o.turn) as root_turn, coalesce(r.depth, 0) as depth, p.parent as parent_turn,
  row_number() over (partition by o.conv_id order by coalesce(r.root, o.turn) nulls last, w.path, o.turn nulls last, o.role nulls first, o.content) - 1 as position,
  (select count(distinct t) from asked a where a.conv_id is not distinct from o.conv_id and a.turn = o.turn and rank = 0) as n_quotes, o.max_level, o.content
from own o join paths w on w.conv_id is not distinct from o.conv_id and w.turn is not distinct from o.turn
left join parents p on p.conv_id is not distinct from o.conv_id and p.turn = o.turn left join roots r on r.conv_id is not distinct from o.conv_id and r.turn = o.turn
"""

ORACLES = {"op10_quote_threads": QUOTES, "op13_first_failures": AUDIT, "op5_rare_token_licenses": LICENCES, "op6_nn_descent": VECTORS, "op7_divergence_rules": QUALITY, "op8_line_windows": LINES, "op9_partenum_join": JACCARD}
