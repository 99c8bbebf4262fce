"""DuckDB SQL with the results that the queries must have."""

from __future__ import annotations

from ..operators.recommend import BLEND, BLEND_BIAS
from ..operators.similarity import PRIME, coefficients
from ..streaming.sketches import BITS, BLOOM, MODULI, SAMPLE
from . import derived as d
from .queries import BANDS, RETAIL_ITEMS, ROWS, SINCE, SUPPORT_1, SUPPORT_2, SUPPORT_RETAIL


def residue(column: str, modulus: int) -> str:
    """The UTF-8 bytes of a column as one integer, modulo ``modulus``."""
    octets = f"list_transform(range(1, octet_length(encode({column})) + 1), lambda i: ('0x' || substr(hex(encode({column})), 2 * i - 1, 2))::BIGINT)"
    return f"list_reduce(list_prepend(0::BIGINT, {octets}), lambda a, b: (a * 256 + b) % {modulus})"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


STATES = """states as (select n_name as state, round(avg(l_quantity), 6) as stars
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1)"""

BASKET_TEXT = "array_to_string(list_transform(list_sort(list(distinct {item})), lambda x: cast(x as varchar)), ',')"


def baskets(cte: str, source: str, key: str, item: str, more: int = 0) -> str:
    return with_(cte) + (
        f"select cast(count(distinct {item}) as int) as size, {BASKET_TEXT.format(item=item)} as items, {key} as basket "
        f"from {source} group by {key} having count(distinct {item}) > {more}"
    )


def levels(rows: str, support: str, deepest: int, shard: bool = False) -> str:
    """Frequent sets of up to ``deepest`` items of ``rows`` (k, i), level by level; with shards, local ones."""
    by = "sh, " if shard else ""
    first = "a.sh, " if shard else ""
    ctes = [f"l1 as (select {first}a.i as i1, count(*) as n from {rows} a group by {first}a.i having count(*) >= {support})"]
    for k in range(2, deepest + 1):
        cols = ", ".join(f"i{j}" for j in range(1, k + 1))
        source = [f"{rows} a"]
        where = []
        for j in range(2, k + 1):
            source.append(f"{rows} b{j}")
            prev = "a" if j == 2 else f"b{j - 1}"
            where.append(f"b{j}.k = a.k and b{j}.i > {prev}.i")
        keep = " and ".join(f"exists (select 1 from l1 x where x.i1 = {t}.i{' and x.sh = a.sh' if shard else ''})" for t in ["a", *(f"b{j}" for j in range(2, k + 1))])
        pick = ", ".join([("a.sh, " if shard else "") + "a.i as i1", *(f"b{j}.i as i{j}" for j in range(2, k + 1))])
        ctes.append(
            f"l{k} as (select {by}{cols}, count(*) as n from (select {pick} from {', '.join(source)} where {' and '.join(where)} and {keep}) a "
            f"group by {first}{cols} having count(*) >= {support})"
        )
    return ",\n".join(ctes)


def all_levels(deepest: int, count: bool = True) -> str:
    out = []
    for k in range(1, deepest + 1):
        items = " || ',' || ".join(f"cast(i{j} as varchar)" for j in range(1, k + 1))
        out.append(f"select {k} as size, {items} as items{', n' if count else ''} from l{k}")
    return ("\nunion all\n" if count else "\nunion\n").join(out)


SHARDED = f"""rows as (select o as k, b as i, o % 4 as sh from order_brands),
least as (select sh, count(distinct k) * ({SUPPORT_1} / (select count(distinct k) from rows)::double) as least from rows group by 1)"""

FAMILY = coefficients(BANDS * ROWS)
MEMBERS = """word_rows as (select distinct doc_id as item, unnest(regexp_split_to_array(lower(text), '\\s+')) as word from documents),
members as (select item, ('0x' || substr(md5(word), 1, 8))::bigint as member from word_rows where word <> '')"""


def signature_sql(members: str, n: int) -> str:
    cols = ", ".join(f"min(({a}::BIGINT * member + {b}) % {PRIME}) as h{j}" for j, (a, b) in enumerate(coefficients(n)))
    return f"signed as (select item, {cols} from {members} group by 1)"


def pair_sql(bands: int, rows: int) -> str:
    each = " union ".join(
        f"select a.item as a, b.item as b from signed a join signed b on a.item < b.item and {' and '.join(f'a.h{i * rows + j} = b.h{i * rows + j}' for j in range(rows))}" for i in range(bands)
    )
    return f"pairs as ({each})"


def jaccard_sql(source: str, least: float) -> str:
    return f"""sizes as (select item, count(distinct member) as n from members group by 1),
distinct_members as (select distinct item, member from members),
shared as (select p.a, p.b, count(*) as both_ from {source} p join distinct_members x on x.item = p.a
  join distinct_members y on y.item = p.b and y.member = x.member group by 1, 2),
alike as (select a, b, both_ / (sa.n + sb.n - both_)::double as similarity from shared
  join sizes sa on sa.item = a join sizes sb on sb.item = b where both_ / (sa.n + sb.n - both_)::double >= {least})"""


def pearson_sql(pairs: str, key: str, other: str) -> str:
    return f"""sums as (select p.x, p.y, count(*) as n, sum(a.r) as sx, sum(b.r) as sy, sum(a.r * a.r) as sxx, sum(b.r * b.r) as syy, sum(a.r * b.r) as sxy
  from {pairs} p join train a on a.{key} = p.x join train b on b.{key} = p.y and b.{other} = a.{other} group by 1, 2),
sims as (select x, y, (n * sxy - sx * sy)::double / nullif(sqrt((n * sxx - sx * sx)::double) * sqrt((n * syy - sy * sy)::double), 0) as sim
  from sums where n >= 2 and n * sxy <> sx * sy)"""


MET = "met as (select distinct t.u as x, r.u as y from test t join train r on r.i = t.i)"
USER_MEANS = "means as (select u, sum(r)::double as s, count(*) as n from train group by 1)"


def user_cf(ratings: str, neighbours: str, guess: str) -> list[str]:
    return [
        ratings, d.SPLIT, MET, pearson_sql("met", "u", "i"), USER_MEANS,
        """near0 as (select t.u, t.i, r.u as v, r.r as rv, sim from test t join train r on r.i = t.i join sims on x = t.u and y = r.u where sim is not null)""",
        f"near1 as ({neighbours})",
        """pulled as (select near1.u, near1.i, sum(sim * (rv - (m.s - rv) / nullif(m.n - 1, 0))) / nullif(sum(abs(sim)), 0) as shift
  from near1 join means m on m.u = v group by 1, 2)""",
        f"""predicted as (select t.u, t.i, t.r, coalesce({guess}, 3.0) as prediction
  from test t left join means m on m.u = t.u left join pulled p on p.u = t.u and p.i = t.i)""",
    ]


PLAIN = "case when shift is null then m.s / m.n else least(greatest(m.s / m.n + shift, 1.0), 5.0) end"
POSITIVE = "case when m.s is not null then least(greatest(m.s / m.n + greatest(coalesce(shift, 0), 0), 0.0), 5.0) end"
ALL_NEAR = "select * from near0"
HALF_NEAR = """select * from (select *, row_number() over (partition by u, i order by sim desc, v desc) as k, count(*) over (partition by u, i) as m from near0)
  where k <= floor(m / 2)"""
USER_CF = user_cf(d.RATINGS, ALL_NEAR, PLAIN)
USER_POSITIVE = user_cf(d.RATINGS, "select * from near0 where sim >= 0", POSITIVE)


def baseline_ctes(epochs: int = 15) -> list[str]:
    out = ["mu as (select avg(r) as m from train)", "dev as (select u, i, r - m as d from train, mu)", "u0 as (select distinct u, 0.0::double as bu from dev)"]
    for k in range(1, epochs + 1):
        out.append(f"i{k} as materialized (select i, sum(d - bu) / (count(*) + 5.0) as bi from dev join u{k - 1} using (u) group by 1)")
        out.append(f"u{k} as materialized (select u, sum(d - bi) / (count(*) + 10.0) as bu from dev join i{k} using (i) group by 1)")
    out.append(
        f"""baseline as (select t.u, t.i, least(greatest(m + coalesce(bu, 0) + coalesce(bi, 0), 1.0), 5.0) as prediction
  from test t cross join mu left join u{epochs} using (u) left join i{epochs} using (i))"""
    )
    return out


CONTENT = [
    d.PART_WORDS,
    "long as (select i, unnest(words) as w from part_words)",
    "known as (select i from part_words)",
    "seen as (select t.* from train t join known using (i))",
    "cnt as (select u, r, w, count(*) as c from seen join long using (i) group by all)",
    "vocab as (select u, count(distinct w) as v from cnt group by 1)",
    "totals as (select u, r, sum(c) as t from cnt group by all)",
    "users_n as (select u, count(*) as nu from seen group by 1)",
    "classes as (select s.u, s.r, nr, nu, v, t from (select u, r, count(*) as nr from seen group by all) s join users_n using (u) join vocab using (u) join totals using (u, r))",
    "have as (select t.u, t.i, w, count(*) as k from test t join long using (i) where exists (select 1 from cnt c where c.u = t.u and c.w = long.w) group by all)",
    """fit as (select h.u, h.i, s.r, sum(k * ln((coalesce(c, 0) + 1) / (s.t + s.v)::double)) as words
  from have h join classes s on s.u = h.u left join cnt c on c.u = h.u and c.r = s.r and c.w = h.w group by all)""",
    """scored as (select t.u, t.i, s.r, round(ln(nr / nu::double) + coalesce(words, 0), 9) as score
  from test t join known using (i) join classes s on s.u = t.u left join fit f on f.u = t.u and f.i = t.i and f.r = s.r)""",
    """picked as (select u, i, r from (select *, row_number() over (partition by u, i order by score desc, r) as k from scored) where k = 1)""",
    "content as (select t.u, t.i, coalesce(p.r::double, 3.0) as prediction from test t left join picked p using (u, i))",
]


def propagation(rounds: int = 5) -> list[str]:
    out = ["p0 as (select distinct src as node, src as label from two)"]
    for k in range(1, rounds + 1):
        out.append(
            f"""p{k} as materialized (select node, label from (select src as node, label, row_number() over (partition by src order by count(*) desc, label) as k
  from two join p{k - 1} on node = dst group by src, label) where k = 1)"""
        )
    return out


REACH = """walk as (select src as node, src as reach from two union select w.node, t.dst from walk w join two t on t.src = w.reach),
comps as (select node, min(reach) as component from walk group by 1)"""

DEEPEST = 16


def betweenness() -> list[str]:
    """Levels from all roots and credits back, unrolled to DEEPEST levels."""
    out = ["v0 as (select distinct src as root, src as node, 1.0::double as paths from two)", "s0 as (select root, node from v0)"]
    for k in range(1, DEEPEST + 1):
        out.append(
            f"""v{k} as materialized (select root, dst as node, sum(paths) as paths from v{k - 1} join two on src = node
  where not exists (select 1 from s{k - 1} s where s.root = v{k - 1}.root and s.node = dst) group by 1, 2)"""
        )
        out.append(f"s{k} as materialized (select * from s{k - 1} union all select root, node from v{k})")
    out.append(f"c{DEEPEST} as (select root, node, paths, 1.0::double as credit from v{DEEPEST})")
    for k in range(DEEPEST, 0, -1):
        out.append(
            f"""f{k} as materialized (select y.root, y.node, x.node as up, y.credit * x.paths / y.paths as c from c{k} y join two on src = y.node
  join v{k - 1} x on x.root = y.root and x.node = dst)"""
        )
        out.append(
            f"""c{k - 1} as materialized (select v.root, v.node, v.paths, 1 + coalesce(g.c, 0) as credit from v{k - 1} v
  left join (select root, up as node, sum(c) as c from f{k} group by 1, 2) g using (root, node))"""
        )
    flows = " union all ".join(f"select least(node, up) as src, greatest(node, up) as dst, c from f{k}" for k in range(1, DEEPEST + 1))
    return [*out, f"flows as ({flows})"]


BLOOM_SQL = f"""arrivals as (select p_name as state, min(p_partkey) as ord, cast(floor(min(p_partkey) / 200) as bigint) as batch from part group by 1),
hashed as (select ord, batch, {residue("state", BITS)} as x from arrivals),
bits as (select ord, batch, unnest([{", ".join(f"({a} * x + {b}) % {BITS}" for a, b in BLOOM)}]) as bit from hashed),
first_set as (select bit, min(ord) as first from bits group by 1),
judged as (select batch, ord, max(first) < ord as f from bits join first_set using (bit) group by 1, 2),
each as (select batch, count(*) filter (f) as f, count(*) filter (not f) as t from judged group by 1),
rates as (select batch, cast(sum(f) over w as bigint) as fp, cast(sum(t) over w as bigint) as tn from each
  window w as (order by batch rows between unbounded preceding and current row))"""
BLOOM_OUT = "select batch, fp, tn, round(fp / (fp + tn)::double, 6) as fpr from rates"

_tops = ", ".join(f"max(x{j} & -x{j}) as r{j}" for j in range(len(MODULI)))
_means = ", ".join(f"(greatest(r{j}, 1) + greatest(r{j + 1}, 1)) // 2" for j in range(0, len(MODULI), 2))
FM_SQL = f"""hashed as (select props, {", ".join(f"{residue('props', m)} as x{j}" for j, m in enumerate(MODULI))} from (select distinct props from events)),
rows as (select date_trunc('day', ts) - to_days(cast(k as int)) as start, hashed.* from events join hashed using (props), range(3) r(k)),
tops as (select start, count(distinct props) as truth, {_tops} from rows group by 1)"""
FM_OUT = f"select strftime(start, '%Y-%m-%d %H:%M:%S') as start, truth, cast(list_sort([{_means}])[{len(MODULI) // 4 + 1}] as bigint) as estimate from tops"

SAMPLE_SQL = f"""tagged as (select event_id as id, json_extract_string(props, '$.k') as tag, (event_id * 1103515245 + 12345) % 2147483648 as rank from events),
sample as (select id, tag from tagged where tag is not null order by rank, id limit {SAMPLE})"""
TOP_SQL = """counts as (select tag, count(*) as n from sample group by 1),
ranked as (select tag, n, dense_rank() over (order by n desc) as rank, row_number() over (partition by n order by tag) as k from counts)"""


LIKE_ITEMS = [
    "members as (select i as item, u as member from train)", signature_sql("members", 8), pair_sql(8, 1), jaccard_sql("pairs", 0.65),
    "both_ways as (select a as x, b as y from alike union select b, a from alike)", pearson_sql("both_ways", "i", "u"),
]


def nearer_half(rows: str, keys: str) -> str:
    return f"""half as (select * from (select *, row_number() over (partition by {keys} order by sim desc, j desc) as k, count(*) over (partition by {keys}) as m from ({rows}))
  where k <= floor(m / 2))"""


def item_cf(neighbours: list[str]) -> str:
    """Predictions from the ratings of the neighbours ``near`` (u, i, j, sim)."""
    return with_(
        d.BRAND_RATINGS, d.SPLIT, *neighbours,
        "drawn as (select near.u, near.i, sum(sim * r.r) as top, sum(abs(sim)) as total from near join train r on r.u = near.u and r.i = near.j group by 1, 2)",
        "means as (select u, avg(r) as mean from train group by 1)",
    ) + """select t.u, t.i, round(coalesce(case when top <> 0 and total <> 0 then least(greatest(top / total, 1.0), 5.0) end, mean, 3.0), 6) as prediction
from test t left join means m on m.u = t.u left join drawn x on x.u = t.u and x.i = t.i"""  # fmt: skip


def report(deepest: int) -> str:
    """A line per size, sets in order, each as ('a', 'b')."""
    out = []
    for k in range(1, deepest + 1):
        items = " || ', ' || ".join(f"chr(39) || i{j} || chr(39)" for j in range(1, k + 1))
        out.append(f"select {k} as size, string_agg('(' || {items} || ')', ', ' order by {', '.join(f'i{j}' for j in range(1, k + 1))}) as line from l{k} having count(*) > 0")
    return "\nunion all\n".join(out)


def oracle_sql() -> dict[str, str]:
    rows1 = "rows as (select o as k, b as i from order_brands)"
    rows2 = "rows as (select item as k, key as i from retail)"
    rows3 = f"rows as (select key as k, item as i from retail where key in (select key from retail group by 1 having count(*) > {RETAIL_ITEMS}))"
    local = levels("rows", "(select least from least z where z.sh = a.sh)", 3, shard=True)
    son = with_(d.ORDER_BRANDS, rows1, levels("rows", str(SUPPORT_1), 3)) + all_levels(3)
    blend = f"{BLEND_BIAS} + {BLEND['content']} * c.prediction + {BLEND['user']} * p.prediction + {BLEND['baseline']} * b.prediction"
    sample = with_(SAMPLE_SQL) + "select id, tag from sample"
    return {
        "user_summary": with_(d.USERS) + f"""select count(*) as n_users, count(*) filter (contains(since, '{SINCE}')) as n_since,
  cast(sum(review_count) as bigint) as n_reviews, round(avg(review_count), 6) as avg_reviews, count(distinct name) as n_names from users""",
        "top10_popular_names": with_(d.USERS) + "select name, count(*) as n from users group by 1 order by n desc, name limit 10",
        "top10_most_reviews": with_(d.USERS) + "select user_id, review_count from users order by review_count desc, user_id limit 10",
        "state_avg_stars": with_(STATES) + "select * from states",
        "top5_states": with_(STATES) + "select * from states order by stars desc, state limit 5",
        "partition_profile_mod": "select cast(c_custkey % 8 as int) as partition, count(*) as n_items from customer group by 1",
        "round_robin_profile": "select 8::bigint as n_partitions, count(*) as n_items, true as even from customer",
        "baskets_case1": baskets(d.ORDER_BRANDS, "order_brands", "o", "b"),
        "baskets_case2": baskets(d.ORDER_BRANDS, "order_brands", "b", "o"),
        "retail_baskets_filtered": baskets(d.RETAIL, "retail", "key", "item", RETAIL_ITEMS),
        "son_candidates": with_(d.ORDER_BRANDS, SHARDED, local) + all_levels(3, count=False),
        "son_frequent_case1": son,
        "son_two_phase_case1": son,
        "itemset_report": with_(d.ORDER_BRANDS, rows1, levels("rows", str(SUPPORT_1), 3)) + report(3),
        "son_frequent_case2": with_(d.RETAIL, rows2, levels("rows", str(SUPPORT_2), 3)) + all_levels(3),
        "son_frequent_retail": with_(d.RETAIL, rows3, levels("rows", str(SUPPORT_RETAIL), 3)) + all_levels(3),
        "minhash_signatures": with_(MEMBERS, signature_sql("members", BANDS * ROWS)) + "select * from signed",
        "lsh_candidate_pairs": with_(MEMBERS, signature_sql("members", BANDS * ROWS), pair_sql(BANDS, ROWS)) + "select a, b from pairs",
        "lsh_similar_pairs": with_(MEMBERS, signature_sql("members", BANDS * ROWS), pair_sql(BANDS, ROWS), jaccard_sql("pairs", 0.5))
        + "select a, b, round(similarity, 6) as similarity from alike",
        "exact_jaccard_pairs": with_(
            MEMBERS, "pairs as (select a.item as a, b.item as b from (select distinct item from members) a join (select distinct item from members) b on a.item < b.item)", jaccard_sql("pairs", 0.8)
        ) + "select a, b, round(similarity, 6) as similarity from alike",
        "cold_start_pairs": with_(d.RATINGS, d.SPLIT) + "select u, i from test where u not in (select u from train) or i not in (select i from train)",
        "user_cf_similarity": with_(d.RATINGS, d.SPLIT, MET, pearson_sql("met", "u", "i")) + "select x as u, y as v, round(sim, 6) as sim from sims where sim is not null",
        "user_cf_predictions": with_(*USER_CF) + "select u, i, round(prediction, 6) as prediction from predicted",
        "user_cf_predictions_top_half": with_(*user_cf(d.BRAND_RATINGS, HALF_NEAR, PLAIN)) + "select u, i, round(prediction, 6) as prediction from predicted",
        "user_cf_predictions_nonneg": with_(*USER_POSITIVE) + "select u, i, round(prediction, 6) as prediction from predicted",
        "item_cf_lsh_predictions": item_cf([*LIKE_ITEMS, "near as (select t.u, t.i, y as j, sim from test t join sims on x = t.i where sim is not null)"]),
        "item_cf_lsh_predictions_top_half": item_cf([*LIKE_ITEMS, nearer_half("select x as i, y as j, sim from sims where sim is not null", "i"),
            "near as (select t.u, t.i, j, sim from test t join half on half.i = t.i)"]),
        "item_cf_rated_predictions": item_cf(["met as (select distinct t.i as x, r.i as y from test t join train r on r.u = t.u)", pearson_sql("met", "i", "u"),
            nearer_half("select t.u, t.i, r.i as j, sim from test t join train r on r.u = t.u join sims on x = t.i and y = r.i where sim is not null", "u, i"), "near as (select u, i, j, sim from half)"]),
        "baseline_predictions": with_(d.RATINGS, d.SPLIT, *baseline_ctes()) + "select u, i, round(prediction, 6) as prediction from baseline",
        "item_features": with_(d.PART_WORDS) + "select i, array_to_string(words, ' ') as words from part_words",
        "content_nb_predictions": with_(d.RATINGS, d.SPLIT, *CONTENT) + "select u, i, round(prediction, 6) as prediction from content",
        "hybrid_without_als": with_(*USER_POSITIVE, *CONTENT, *baseline_ctes())
        + f"select p.u, p.i, round({blend}, 6) as prediction from predicted p join content c on c.u = p.u and c.i = p.i join baseline b on b.u = p.u and b.i = p.i",
        "rmse_user_cf": with_(*USER_CF) + "select count(*) as n, round(sqrt(avg(pow(prediction - r, 2))), 6) as rmse from predicted",
        "error_histogram_user_cf": with_(*USER_CF) + "select cast(least(floor(abs(round(prediction, 6) - r)), 4) as int) as bucket, count(*) as n from predicted group by 1",
        "edge_betweenness": with_(d.EDGES, *betweenness()) + "select src, dst, round(sum(c) / 2, 6) as betweenness from flows group by 1, 2",
        "graph_degrees": with_(d.EDGES) + "select src as node, count(*) as degree from two group by 1",
        "connected_components": "with recursive " + d.EDGES + ",\n" + REACH + "\nselect node, component from comps",
        "label_propagation": with_(d.EDGES, *propagation()) + "select node, label from p5",
        "modularity_of_partition": with_(
            d.EDGES, *propagation(), "m as (select count(*)::double as m from edges)",
            "inner_ as (select a.label as l, count(*) as n from edges join p5 a on a.node = src join p5 b on b.node = dst where a.label = b.label group by 1)",
            "deg as (select label as l, count(*) as k from two join p5 on node = src group by 1)",
        ) + "select round(sum(coalesce(n, 0) / m - pow(k / (2 * m), 2)), 6) as q from deg left join inner_ using (l), m",
        "bloom_fpr": with_(BLOOM_SQL) + BLOOM_OUT,
        "stream_bloom": with_(BLOOM_SQL) + BLOOM_OUT,
        "fm_window_estimate": with_(FM_SQL) + FM_OUT,
        "stream_fm": with_(FM_SQL) + FM_OUT,
        "reservoir_sample": sample,
        "stream_reservoir": sample,
        "stream_tag_counts": with_(SAMPLE_SQL) + "select tag, count(*) as n from sample group by 1",
        "top_tags": with_(SAMPLE_SQL, TOP_SQL) + "select tag, n from ranked where rank < 5 or (rank = 5 and k = 1)",
    }
