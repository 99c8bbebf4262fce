"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

from . import licenses
from .decontaminate import MIN_ITEM, MIN_SHARE, MIN_SPAN, SHORTEST
from .mixing import MOST_EPOCHS, SHARE, SOURCE_WEIGHTS, SYMBOLS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = f"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 2 then list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
    when len(words) = 1 then [words[1]] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by 1),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as both_ from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 80 * (x.n + y.n - both_)),
two as (select a, b from links union select b, a from links),
walk as (select a as doc_id, b as reach from two union select walk.doc_id, two.b from walk join two on two.a = walk.reach),
least_ as (select doc_id, min(reach) as m from walk group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) as kept
from documents d left join n on n.doc_id = d.doc_id left join least_ on least_.doc_id = d.doc_id"""

MIX = f"""with t as (
  select doc_id, source, coalesce(text, '') as text, len(regexp_extract_all(coalesce(text, ''), '{_BLANK}'))::bigint as size,
    (('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'text:' || coalesce(text, ''))), 1, 13))::bigint + 0.5::double) / {2**52}.0::double as u,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') as lines from documents),
k as (
  select doc_id, source, size, -ln(u) / greatest(0.1::double,
    (1.0::double - 4.0::double * (length(text) - length(translate(text, '{SYMBOLS}', ''))) / greatest(length(text), 1))
    * case when len(lines) > 0 then list_unique(lines)::double / len(lines) else 1.0::double end) as key from t),
s as (select source, sum(size)::bigint as source_size from k group by 1),
r as (select *, [{", ".join(map(str, SOURCE_WEIGHTS))}][(row_number() over (order by source nulls last) - 1) % {len(SOURCE_WEIGHTS)} + 1] as w from s),
c as (select *, {MOST_EPOCHS}::double * source_size / w as ratio, row_number() over (order by source nulls last) as nr from r),
l as (
  select *, ({SHARE}::double * sum(source_size) over () - coalesce(sum({MOST_EPOCHS} * source_size) over (order by ratio, nr rows between unbounded preceding and 1 preceding), 0))::double
    / sum(w) over (order by ratio, nr rows between current row and unbounded following) as level from c),
f as (select arg_min(level, (ratio, nr)) as level from l where ratio >= level),
g as (select source, source_size, least((select level from f) * w, {MOST_EPOCHS}::double * source_size) as target from r),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from g),
p as (
  select k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::bigint as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0)::bigint as prefix
  from k join e on k.source is not distinct from e.source)
select doc_id, source, size, source_size, target, epochs * size + least(greatest(rest - prefix, 0), size) as taken from p"""

_SHARE = round(100 * MIN_SHARE)

#: Every diagonal on which document and item share a word, without seeds.
LEAKS = f"""with d as (
  select distinct doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as h from documents),
dn as (select *, row_number() over () as row from d),
g as (select distinct item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as g from benchmark),
gn as (select *, row_number() over () as item, len(g) as n, least({MIN_SPAN}, len(g)) as span from g where len(g) > 0),
dw as (select row, unnest(h) as word, unnest(range(len(h))) as at from dn),
gw as (select item, unnest(g) as word, unnest(range(len(g))) as at from gn),
diagonal as (
  select dw.row, gw.item, dw.at - gw.at as diagonal from dw join gw using (word) join gn on gn.item = gw.item
  group by all having 100 * count(*) >= {_SHARE} * any_value(span)),
word as (
  select row, item, item_id, n, span, diagonal, unnest(range(n + 1)) as k, unnest(list_transform(range(n + 1), lambda k: case when k = 0 then 0
    when diagonal + k >= 1 and h[diagonal + k] = g[k] then 1 else -1 end)) as same
  from diagonal join gn using (item) join dn using (row) where n >= {SHORTEST} or (n = len(h) and diagonal = 0)),
sums as (
  select *, sum(case same when 1 then 1 when 0 then 0 else -2 end) over w as s, sum(greatest(same, 0)) over w as m,
    sum(case same when 1 then {100 - _SHARE} when 0 then 0 else -{_SHARE} end) over w as t
  from word window w as (partition by row, item, diagonal order by k)),
low as (
  select *, min(t) over w as t_low, arg_min(k, (s, -k)) over w as k_low, min(s) over w as s_low
  from sums window w as (partition by row, item, diagonal order by k)),
over_ as (
  select a.row, a.item, a.diagonal from low a join low b on a.row = b.row and a.item = b.item and a.diagonal = b.diagonal and b.k = a.k - a.span
  group by a.row, a.item, a.diagonal, a.n having max(a.t - b.t_low) >= 0 and (a.n >= {MIN_ITEM} or max(a.m) = a.n)),
top as (
  select a.row, a.item, a.item_id, a.diagonal, max(struct_pack(run := a.s - b.s_low, e := -a.k, b := b.k_low)) as top
  from low a join low b on a.row = b.row and a.item = b.item and a.diagonal = b.diagonal and b.k = a.k - 1 group by all),
stretch as (
  select top.row, top.item, top.item_id, -top.e - top.b as n_words, e.m - b.m as n_matched, top.diagonal + top.b as first_word
  from top join over_ using (row, item, diagonal)
  join low e on e.row = top.row and e.item = top.item and e.diagonal = top.diagonal and e.k = -top.e
  join low b on b.row = top.row and b.item = top.item and b.diagonal = top.diagonal and b.k = top.b),
best as (select row, item_id, max(struct_pack(m := n_matched, w := -n_words, f := -first_word)) as b from stretch group by all)
select doc_id, item_id, (-b.w)::int as n_words, b.m::int as n_matched, (-b.f)::int as first_word from best join dn using (row)"""


def _licenses() -> str:
    split = licenses.split()
    lexicon = sorted({w for _, _, whole, _ in split for w in whole})
    places, template = [], []
    for t, (label, phrase, whole, lead) in enumerate(split):
        same = " and ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(phrase))
        places.append(f"select doc_id, words, {t} as t, unnest(list_filter(range(1, len(words) + 1), lambda i: {same})) as i from w")
        template += [f"({t}, '{label}', {j - lead}, '{x}', {len(phrase) == len(whole)})" for j, x in enumerate(whole)]
    listed = "coalesce(string_agg(distinct label, ',' order by label){}, '')"
    near = f"list_contains(list_slice(words, greatest(i + j - {licenses.SLACK}, 1), greatest(i + j + {licenses.SLACK}, 0)), word)"
    return f"""with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
lexicon as (select unnest([{", ".join(f"'{x}'" for x in lexicon)}]) as word),
df as (select word, count(*) as n from (select distinct doc_id, unnest(words) as word from w) join lexicon using (word) group by 1),
idf as (select word, greatest(ln(((select count(*) from w) + 1) / (coalesce(n, 0) + 0.5)::double), 1e-6) as x from lexicon left join df using (word)),
template(t, label, j, word, plain) as (values {", ".join(template)}),
posted as (select * from template join idf using (word) qualify row_number() over (partition by t order by x desc, j) <= {licenses.RARE} or plain),
place as ({" union all ".join(places)}),
share as (
  select doc_id, t, i, label, case when plain then 1.0::double else least(sum(case when {near} then x else 0 end) / sum(x), 1.0) end as share
  from place join posted using (t) group by doc_id, t, i, label, plain),
kept as (select * from share where share >= {licenses.MIN_SHARE}),
hit as (
  select doc_id, count(*) filter (t < {licenses.BASE}) as n_base, min(i) filter (t < {licenses.BASE}) - 1 as first_word, max(i) filter (t < {licenses.BASE}) - 1 as last_word,
    {listed.format(f" filter (t < {licenses.BASE})")} as base_labels, {listed.format("")} as labels, round(max(share), 6) as score from kept group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from w left join hit using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": LEAKS, "op2_near_duplicates": NEAR_DUPLICATES, "op4_licenses": _licenses(), "op10_mix": MIX}
