"""DuckDB SQL of the queries over the same tables, by name. Sums are rounded and cast as the queries give them."""

from __future__ import annotations

F_ = "files as (select lang as dataset, doc_id as uid, text from documents)"
#: Tokens with ids, places, and metrics by md5; `src` has dataset, uid, text.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RE = rf"\n| *[A-Za-z_][A-Za-z0-9_]*| *\p{{Nd}}+| +|[^{_SPACE}A-Za-z0-9_]|[{_SPACE}]"


def toks(src: str = "files", p: str = "") -> str:
    return f"""
{p}raw as (select dataset, uid, unnest(a) as tok, generate_subscripts(a, 1) as i0 from (select dataset, uid, regexp_extract_all(coalesce(text, ''), '{_RE}') as a from {src})),
{p}placed as (select *, coalesce(sum(length(tok)) over (partition by dataset, uid order by i0 rows between unbounded preceding and 1 preceding), 0)::bigint as char_start from {p}raw),
{p}kept as (select * exclude (i0), (row_number() over (partition by dataset, uid order by i0) - 1)::bigint as pos from {p}placed where not regexp_full_match(tok, '[{_SPACE}]') or tok in (chr(10)) or tok = ' '),
{p}lined as (select *, (1 + coalesce(sum((tok = chr(10))::int) over w, 0))::bigint as line, coalesce(max(case when tok = chr(10) then char_start + 1 end) over w, 0) as line_start,
  min(pos) over (partition by dataset, uid, tok) as first_at from {p}kept window w as (partition by dataset, uid order by pos rows between unbounded preceding and 1 preceding)),
{p}numbered as (select dataset, uid, pos, tok, replace(replace(tok, chr(10), '<0x0A>'), ' ', '▁') as token_str, (dense_rank() over (partition by dataset, uid order by first_at) + 2)::bigint as token_id, char_start, line, char_start - line_start as col, line - 1 as seg from {p}lined),
{p}ctx as (select *, concat_ws(',', lag(token_id, 2) over o, lag(token_id, 1) over o, token_id) as c from {p}numbered window o as (partition by dataset, uid order by pos)),
{p}tokens as (select * exclude (c), (('0x' || substr(md5(c), 1, 8))::bigint % 3000) / 1000.0::double as e, (('0x' || substr(md5(c), 1, 8))::bigint % 3000) / 1000.0::double * 1.5::double as s from {p}ctx)"""


T = f"with {F_}, {toks()}"
ATTR = """,
attr as (select *, 'b' || ((line - 1) // 4)::varchar as fid, (line - 1) % 4 as depth from tokens),
att as (select *, coalesce(min(case when tok <> chr(10) then pos end) over (partition by dataset, uid, fid) = pos, false) as fstart, coalesce(min(case when tok <> chr(10) then pos end) over (partition by dataset, uid, line) = pos, false) as sstart from attr)"""
ISO = """,
isoctx as (select *, concat_ws(',', lag(token_id, 2) over o, lag(token_id, 1) over o, token_id) as c from att window o as (partition by dataset, uid, fid order by pos)),
iso as (select * exclude (c), (('0x' || substr(md5(c), 1, 8))::bigint % 3000) / 1000.0::double * 1.5::double as i from isoctx)"""
CHEAP_ = """sc as (select doc_id as uid, max(quality)::double as score from labels group by 1),
cheap as (select lang as dataset, doc_id as uid, source as cluster, (length(text) - length(replace(text, '.', '')) + 1)::bigint as su, (length(text) - length(replace(text, chr(10), '')) + 1)::bigint as loc, (length(text) - length(replace(text, ' ', '')))::bigint as words, score from documents left join sc on sc.uid = doc_id)"""
C = f"with {CHEAP_}"
XY = C + ", xy as (select dataset, cluster, su::double as x, score as y from cheap where score is not null)"


def trig(t: float) -> str:
    return f"(pos > 0 and e >= {t}::double)"


def avg_rank(x: str, part: str) -> str:
    return f"(rank() over (partition by {part} order by {x}) + (count(*) over (partition by {part}, {x}) - 1) / 2.0::double)"


ORACLE: dict[str, str] = {}

ORACLE["token_rows"] = T + " select dataset, uid, count(*) as n, sum(token_id)::bigint as ids, max(line) as lines, sum(col)::bigint as columns, sum(char_start)::bigint as starts, round(sum(e), 4) as entropy, round(sum(s), 4) as surprisal from tokens group by 1, 2"
ORACLE["token_bytes"] = f"with {F_} select uid, length(text) // 2 as chars, strlen(substring(text, 1, (length(text) // 2)::int))::bigint as bytes from files"
ORACLE["token_display"] = T + ", g as (select token_str, count(*) as n from tokens group by 1) select replace(replace(token_str, '<0x0A>', chr(10)), '▁', ' ') as shown, replace(token_str, ' ', '▁') as normal, n from g"
ORACLE["owner_of_token"] = T + """, sp as (select dataset, uid, k::bigint as id, (length(text) * a) // 4 as a, (length(text) * b) // 4 as b from files, (values (0, 0, 4), (1, 0, 2), (2, 1, 2), (3, 2, 4), (4, 3, 4)) v(k, a, b)),
o as (select t.dataset, t.uid, t.pos, max_by(sp.id, sp.a * 10 + sp.id) as owner, count(sp.id) as depth from tokens t left join sp on sp.dataset = t.dataset and sp.uid = t.uid and sp.a <= t.char_start and t.char_start < sp.b group by 1, 2, 3)
select dataset, uid, owner, count(*) as n, sum(case when owner is not null then depth end)::bigint as depths from o group by 1, 2, 3"""
ORACLE["span_starts"] = T + """, st as (select distinct dataset, uid, (length(text) * k) // 4 as s from files, range(4) r(k)),
h as (select t.dataset, t.uid, t.pos, bool_or(st.s >= t.char_start and st.s < t.char_start + greatest(length(t.tok), 1)) as hit from tokens t join st using (dataset, uid) group by 1, 2, 3)
select dataset, uid, count(*) filter (hit) as n, (sum(pos) filter (hit))::bigint as places from h group by 1, 2"""
ORACLE["anchors"] = T + r" select dataset, uid, sum(char_start + case when regexp_full_match(tok, '[ \n]*') then 0 else length(tok) - length(ltrim(tok, ' ' || chr(10))) end)::bigint as anchors from tokens group by 1, 2"
ORACLE["token_ends"] = T + ", n as (select t.dataset, t.uid, char_start, coalesce(lead(char_start) over (partition by t.dataset, t.uid order by pos), length(text)) as e from tokens t join files f on f.dataset = t.dataset and f.uid = t.uid) select dataset, uid, sum(e - char_start)::bigint as covered from n group by 1, 2"
ORACLE["isolated_by_window"] = T + ATTR + ISO + " select dataset, uid, count(i) filter (seg % 7 <> 6) as inside, round(sum(i) filter (seg % 7 <> 6), 4) as total from iso group by 1, 2"

ORACLE["file_summary"] = T + ATTR + ISO + f""",
dens as (select dataset, uid, fid, sum((1 + depth) * e) as w from iso where sstart group by 1, 2, 3), dd as (select dataset, uid, avg(w) as d from dens group by 1, 2),
ln as (select dataset, uid, seg, bool_or({trig(2.01)}) as a, bool_or({trig(2.4)}) as b from tokens group by 1, 2, 3), un as (select dataset, uid, 1 + count(*) filter (a) as ua, 1 + count(*) filter (b) as ub from ln group by 1, 2)
select i.dataset, i.uid, round(exp(avg(s)), 6) as ppl, max(line) as loc, count(*) as total_tokens, count(*) filter (fstart) as num_functions, round(avg(s) filter (fstart), 6) as avg_first_token_surprisal,
round(avg(i.i - s), 6) as avg_context_surprisal_gap, round(coalesce(any_value(d), 0), 6) as lm_cc_density, any_value(ua) as num_semantic_units_p67, any_value(ub) as num_semantic_units_p80
from iso i left join dd using (dataset, uid) join un using (dataset, uid) group by 1, 2"""
ORACLE["unit_counts"] = T + ", ln as (select dataset, uid, seg, " + ", ".join(f"bool_or({trig(t)}) as {k}" for k, t in (("a", 1.0), ("b", 1.5), ("c", 2.0), ("d", 2.9))) + " from tokens group by 1, 2, 3) select dataset, uid, " + ", ".join(f"1 + count(*) filter ({k}) as num_semantic_units_{k}" for k in "abcd") + " from ln group by 1, 2"
ORACLE["unit_rows"] = T + f""", m as (select *, {trig(2.4)} as t from tokens), b as (select *, bool_or(t) over (partition by dataset, uid, seg) as bd, row_number() over (partition by dataset, uid, seg order by pos) as r from m),
o as (select *, sum((bd and r = 1)::int) over (partition by dataset, uid order by pos rows unbounded preceding)::bigint as su from b),
u as (select dataset, uid, su, min(line) as start_line, max(line) as end_line, min(pos) as start_token, max(pos) as end_token, count(*) as n_tokens, count(*) filter (t) as n_triggers from o group by 1, 2, 3)
select * from u union all select dataset, uid, 0, null, null, null, null, 0, 0 from u group by 1, 2 having min(su) > 0"""
ORACLE["first_tokens"] = T + ATTR + " select dataset, uid, fid as function_id, round(s, 6) as first_token_surprisal from att where fstart"
ORACLE["summary_order"] = "with t as (select lang as dataset, 'u' || (doc_id % 97)::varchar || '__' || doc_id::varchar as uid from documents) select dataset, uid, row_number() over (partition by dataset order by regexp_extract(uid, '([0-9]+)', 1)::double nulls last, uid)::int as place from t"

_P = sorted({*range(0, 100, 5), 67})
ORACLE["entropy_percentiles"] = T + f", q as (select quantile_cont(e, [{', '.join(str(p / 100) for p in _P)}]) as v from tokens) select unnest([{', '.join(map(str, _P))}])::int as percentile, round(unnest(v), 6) as value from q"
ORACLE["frequency_bins"] = C + """, t as (select 'all' as scope, * from cheap union all select dataset, * from cheap),
r as (select scope, ceil((greatest(max(su::double), 200.0) + 1) / 10)::bigint as n from t group by 1), bins as (select scope, unnest(range(n)) as b from r)
select bins.scope, b * 10 as bin_start, (b + 1) * 10 as bin_end, count(score) as n, round(avg(score), 6) as score_mean, round(stddev_samp(score), 6) as score_std, round(avg(words::double), 6) as z_mean
from bins left join t on t.scope = bins.scope and t.su // 10 = b group by bins.scope, b"""
ORACLE["bin_trend"] = C + " select dataset, (su // 5 + 0.5::double) * 5 as bin_mid, count(score) as n, round(avg(score), 6) as score_mean from cheap group by 1, 2 having count(score) > 0"
ORACLE["quantile_bins"] = C + f""", t as (select dataset, loc, score from cheap where score is not null), g as (select dataset, least(10, count(*) // 5) as q, {', '.join(f"quantile_cont(loc::double, [{', '.join(f'{k}::double / {n}' for k in range(n + 1))}]) as g{n}" for n in range(1, 11))} from t group by 1 having count(*) >= 5),
ed as (select dataset, list_sort(list_distinct(case q {' '.join(f'when {n} then g{n}' for n in range(1, 11))} end)) as edges from g),
b as (select t.*, greatest(len(list_filter(edges, lambda x: x < loc)), 1) - 1 as bin from t join ed using (dataset))
select dataset, bin::int as bin, round(median(loc::double), 6) as loc_median, round(avg(score), 6) as score_mean, count(*) as n from b group by 1, 2"""
ORACLE["terciles"] = C + """, q as (select dataset, quantile_cont(su::double, [1.0::double / 3, 2.0::double / 3]) as q, min(su) as lo, max(su) as hi from cheap group by 1), c as (select dataset, list_distinct(list_filter(q, lambda x: x >= lo and x < hi)) as cuts from q),
i as (select cheap.*, len(list_filter(cuts, lambda x: x < su))::int as interval from cheap join c using (dataset)) select dataset, interval, count(*) as n, min(su) as lo, max(su) as hi from i group by 1, 2"""
ORACLE["describe_files"] = C + f""", t as (select *, {avg_rank('su', 'dataset')} as ra, {avg_rank('loc', 'dataset')} as rb from cheap where score is not null)
select dataset, count(*) as n, count(distinct cluster) as clusters, count(*) filter (score < 1) as with_error, count(*) filter (score = 1) as all_correct, count(*) filter (score = 0) as all_incorrect, count(*) filter (score > 0 and score < 1) as mixed,
count(distinct su) as distinct_su, count(distinct loc) as distinct_loc, round(case when count(distinct su) > 1 and count(distinct loc) > 1 then corr(ra, rb) end, 6) as spearman, """ + ", ".join(
    f"round(min({c})::double, 6) as {c}_min, round(quantile_cont({c}::double, 0.25), 6) as {c}_q25, round(quantile_cont({c}::double, 0.5), 6) as {c}_median, round(quantile_cont({c}::double, 0.75), 6) as {c}_q75, round(max({c})::double, 6) as {c}_max, round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_sd"
    for c in ("su", "loc")
) + " from t group by 1"
ORACLE["count_distribution"] = C + ", t as (select dataset, cluster, sum(score)::bigint as k, count(*) as n from cheap where score is not null group by 1, 2) select dataset, k, n, count(*) as clusters from t group by 1, 2, 3"

ORACLE["scored_files"] = "select lang as dataset, count(*) as n, sum(quality)::bigint as k from documents join labels using (doc_id) group by 1"
ORACLE["scored_legacy"] = "with s as (select (doc_id % 50)::varchar as id, max_by(quality, doc_id) as score from labels group by 1) select (doc_id % 60)::varchar || '__x' as uid, doc_id as doc, score from documents join s on s.id = (doc_id % 60)::varchar"
ORACLE["unique_join"] = C + " select cheap.uid, su, toxic from cheap join labels on doc_id = uid"
ORACLE["frame_differences"] = C + """, a as (select uid, su::double as su, loc::double as loc from cheap),
b as (select case when uid % 17 = 0 then -uid else uid end as uid, su + case when uid % 13 = 0 then 1e-3::double else 1e-12::double end as su, case when uid % 19 = 0 then null else loc end as loc from a where uid % 10 <> 0),
j as (select coalesce(a.uid, b.uid) as uid, case when a.uid is null then 'right_only' when b.uid is null then 'left_only' else 'both' end as side, a.su as asu, b.su as bsu, a.loc as aloc, b.loc as bloc from a full join b on a.uid = b.uid),
v as (select uid, side, 'su' as "column", asu as x, bsu as y from j union all select uid, side, 'loc', aloc, bloc from j)
select uid, side, "column", round(x, 6) as calculated, round(y, 6) as stored from v where side <> 'both' or not coalesce(x is not distinct from y or abs(x - y) <= 1e-10::double + 1e-9::double * abs(y), false)"""
ORACLE["missing_ids"] = "with f as (select distinct doc_id + case when doc_id % 7 = 0 then 1000000 else 0 end as uid from labels), e as (select distinct doc_id as uid from documents) select uid, 'missing' as state from e where uid not in (select uid from f) union all select uid, 'extra' from f where uid not in (select uid from e)"
ORACLE["first_missing"] = "select distinct doc_id as uid from documents where doc_id not in (select doc_id from labels) order by 1 limit 20"
ORACLE["outcome_groups"] = C + ", t as (select *, max(su) over (partition by dataset) * 0.15::double as lim from cheap where score is not null), g as (select dataset, su, 'A' as grp from t where su >= lim and score = 0 union all select dataset, su, 'B' from t where su <= lim and score = 0 union all select dataset, su, 'C' from t where su <= lim and score = 1) select dataset, grp, count(*) as n, sum(su)::bigint as su from g group by 1, 2"
ORACLE["enough_rows"] = C + " select dataset, count(*) as n from cheap where score is not null group by 1 having count(*) >= 90"
ORACLE["datasets_and_all"] = C + " select coalesce(dataset, 'all') as scope, count(*) as n, sum(su)::bigint as su, grouping(dataset)::int as pooled from cheap group by rollup (dataset)"
ORACLE["distinct_sources"] = "with a as (select distinct source from documents where lang = 'en'), b as (select distinct source from documents where lang = 'fr') select source, 'either' as kind from (select * from a union select * from b) union all select source, 'both' from (select * from a intersect select * from b)"

_RANKED = C + ", r as (select *, row_number() over (partition by dataset order by su, loc, uid) - 1 as i0, count(*) over (partition by dataset) as n from cheap where score is not null)"


def buckets(size: str, full: bool, keys: str = "dataset") -> str:
    src = "r" if size.isdigit() else "m"
    return f"b as (select {keys}, i0 // {size} as bucket, round(avg(score), 12) as y, round(median(su::double), 12) as x, round(median(loc::double), 12) as z, count(*) as n from {src} group by {keys}, bucket" + (f" having count(*) >= {'any_value(min_cnt)' if src == 'm' else size}" if full else "") + ")"


def ranked_buckets(keys: str = "dataset") -> str:
    return f"k as (select *, {avg_rank('x', keys)} as rx, {avg_rank('y', keys)} as ry, {avg_rank('z', keys)} as rz from b)"


def _corr(a: str, b: str) -> str:
    return f"case when min({a}) < max({a}) and min({b}) < max({b}) then corr({a}, {b}) end"


ORACLE["metric_buckets"] = _RANKED + ", " + buckets("14", False) + " select dataset, bucket, round(y, 6) as mean_score, round(x, 6) as median_metric, round(z, 6) as median_control, n from b"
ORACLE["bucket_spearman"] = _RANKED + ", " + buckets("10", True) + ", " + ranked_buckets() + f" select dataset, count(*) as groups, round(case when count(*) >= 2 then {_corr('rx', 'ry')} end, 6) as r from k group by 1"
ORACLE["bucket_partial"] = _RANKED + ", " + buckets("8", True) + ", " + ranked_buckets() + f", c as (select dataset, count(*) as groups, {_corr('rx', 'ry')} as xy, {_corr('rx', 'rz')} as xz, {_corr('ry', 'rz')} as yz from k group by 1) select dataset, groups, round(case when groups >= 4 and (1 - xz * xz) * (1 - yz * yz) > 1e-12 then (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) end, 6) as r from c"
_SWEEP = _RANKED + ", m as (select *, unnest(range(greatest(1, n // 20), greatest(1, n // 8) + 1)) as min_cnt from r), m2 as (select * from m where n // min_cnt between 9 and 11), b as (select dataset, min_cnt, i0 // min_cnt as bucket, round(avg(score), 12) as y, round(median(su::double), 12) as x, round(median(loc::double), 12) as z, count(*) as n from m2 group by 1, 2, 3 having count(*) >= min_cnt), " + ranked_buckets("dataset, min_cnt")
ORACLE["bucket_sweep"] = _SWEEP + f" select dataset, min_cnt, count(*) as groups, round(case when count(*) >= 2 then {_corr('rx', 'ry')} end, 6) as r from k group by 1, 2"
ORACLE["strongest_by_metric"] = C + """, u as (select dataset, uid, score, loc, 'su' as metric_name, su::double as metric from cheap where score is not null union all select dataset, uid, score, loc, 'words', words::double from cheap where score is not null),
r as (select *, row_number() over (partition by dataset, metric_name order by metric, loc, uid) - 1 as i0, count(*) over (partition by dataset, metric_name) as n from u),
m as (select *, unnest(range(greatest(1, n // 20), greatest(1, n // 8) + 1)) as min_cnt from r where n >= 10), m2 as (select * from m where n // min_cnt between 9 and 11),
b as (select dataset, metric_name, min_cnt, i0 // min_cnt as bucket, round(avg(score), 12) as y, round(median(metric), 12) as x, 0 as z, count(*) as n from m2 group by 1, 2, 3, 4 having count(*) >= min_cnt), """ + ranked_buckets("dataset, metric_name, min_cnt") + f""",
c as (select dataset, metric_name, min_cnt, count(*) as groups, case when count(*) >= 2 then {_corr('rx', 'ry')} end as r from k group by 1, 2, 3)
select dataset, metric_name, min_cnt, groups, round(r, 6) as r from c qualify row_number() over (partition by dataset, metric_name order by abs(round(r, 10)) desc nulls last, min_cnt) = 1"""
_TH = {f"t{k}": 0.5 + 0.12 * k for k in range(20)}
ORACLE["threshold_sweep"] = T + ", ln as (select dataset, uid, seg, " + ", ".join(f"bool_or({trig(t)}) as {k}" for k, t in _TH.items()) + " from tokens group by 1, 2, 3), un as (select dataset, uid, " + ", ".join(f"1 + count(*) filter ({k}) as num_semantic_units_{k}" for k in _TH) + """ from ln group by 1, 2),
u as (unpivot un on columns('num_semantic_units_.*') into name threshold value su), j as (select u.*, quality::double as score from u join labels on doc_id = uid), """ + f"k as (select *, {avg_rank('su', 'threshold, dataset')} as rx, {avg_rank('score', 'threshold, dataset')} as ry from j) select threshold, dataset, count(*) as n, round({_corr('rx', 'ry')}, 6) as r from k group by 1, 2"
ORACLE["threshold_correlations"] = T + ", ln as (select dataset, uid, seg, max(line) as line, " + ", ".join(f"bool_or({trig(t)}) as {k}" for k, t in _TH.items()) + " from tokens group by 1, 2, 3), un as (select dataset, uid, max(line) as loc, " + ", ".join(f"1 + count(*) filter ({k}) as num_semantic_units_{k}" for k in _TH) + """ from ln group by 1, 2),
uu as (unpivot un on columns('num_semantic_units_.*') into name metric_name value metric), lb as (select doc_id as uid, max(quality)::double as score from labels group by 1),
r as (select uu.*, score, row_number() over (partition by dataset, metric_name order by metric, loc, uid) - 1 as i0, count(*) over (partition by dataset, metric_name) as n from uu join lb using (uid)),
m as (select *, unnest(range(greatest(1, n // 20), greatest(1, n // 8) + 1)) as min_cnt from r where n >= 10), m2 as (select * from m where n // min_cnt between 9 and 11),
b as (select dataset, metric_name, min_cnt, i0 // min_cnt as bucket, round(avg(score), 12) as y, round(median(metric::double), 12) as x, 0 as z, count(*) as n from m2 group by 1, 2, 3, 4 having count(*) >= min_cnt), """ + ranked_buckets("dataset, metric_name, min_cnt") + f""",
c as (select dataset, metric_name, min_cnt, count(*) as groups, case when count(*) >= 2 then {_corr('rx', 'ry')} end as r from k group by 1, 2, 3)
select dataset, metric_name, min_cnt, groups, round(r, 6) as r from c qualify row_number() over (partition by dataset, metric_name order by abs(round(r, 10)) desc nulls last, min_cnt) = 1"""
ORACLE["code_level_spearman"] = C + f", k as (select dataset, {avg_rank('su', 'dataset')} as rx, {avg_rank('loc', 'dataset')} as ry from cheap) select dataset, count(*) as n, round({_corr('rx', 'ry')}, 6) as r from k group by 1"
ORACLE["significance_labels"] = "with t as (select doc_id as uid, case when doc_id % 11 <> 0 then (doc_id % 100) / 1000.0::double end as p from documents) select uid, case when p is null then '' when p < 0.001 then '0.001 ' when p < 0.01 then '<0.01 ' when p < 0.05 then '<0.05 ' else 'n.s.' end as label from t"

ORACLE["line_fit"] = XY + ", f as (select dataset, regr_intercept(y, x) as a, regr_slope(y, x) as b from xy group by 1) select dataset, count(*) as n, round(any_value(a), 6) as a, round(any_value(b), 6) as b, round(sum((y - a - b * x) ** 2), 6) as rss from xy join f using (dataset) group by 1"


def step_sql(keys: str, src: str, head: str = "") -> str:
    return f"""{head}q as (select {keys}, quantile_cont(x, 0.05::double) as lo, quantile_cont(x, 0.95::double) as hi, avg(y) as m from {src} group by 1), bp as (select {keys}, m, k, lo + (hi - lo) * k / 299 as bp from q, range(300) r(k)),
s as (select {keys}, x, count(*) as n, sum(y - m) as s, sum((y - m) ** 2) as ss from {src} join q using ({keys}) group by 1, 2),
p as (select {keys}, k, sum(n) as n, any_value(m) as m, sum(n) filter (x < bp) as n1, sum(s) filter (x < bp) as s1, sum(n) filter (x >= bp) as n2, sum(s) filter (x >= bp) as s2, sum(ss) as ss from s join bp using ({keys}) group by 1, 2),
st as (select {keys}, n, m + s1 / n1 as level_high, m + s2 / n2 as level_low, ss - s1 * s1 / n1 - s2 * s2 / n2 as rss from p where n1 >= 2 and n2 >= 2 qualify row_number() over (partition by {keys} order by round(ss - s1 * s1 / n1 - s2 * s2 / n2, 9), k) = 1)"""


def hinge_sql(keys: str, src: str) -> str:
    return f"""with q as (select {keys}, quantile_cont(x, 0.05::double) as lo, quantile_cont(x, 0.95::double) as hi from {src} group by 1),
h as (select {keys}, k, x, y, greatest(0.0::double, x - (lo + (hi - lo) * k / 299)) as h from {src} join q using ({keys}), range(300) r(k)),
m as (select {keys}, k, x - avg(x) over w as x, y - avg(y) over w as y, h - avg(h) over w as h from h window w as (partition by {keys}, k)),
s as (select {keys}, k, count(*) as n, sum(x * x) as xx, sum(x * h) as xh, sum(h * h) as hh, sum(x * y) as xy_, sum(h * y) as hy, sum(y * y) as yy from m group by 1, 2),
f as (select {keys}, k, n, case when xx * hh - xh * xh > 1e-9 * xx * hh then yy - (xy_ * hh - hy * xh) / (xx * hh - xh * xh) * xy_ - (hy * xx - xy_ * xh) / (xx * hh - xh * xh) * hy else yy - xy_ * xy_ / xx end as rss from s)
select {keys}, n, rss from f qualify row_number() over (partition by {keys} order by round(rss, 9), k) = 1"""


ORACLE["step_fit"] = XY + ", " + step_sql("dataset", "xy") + " select dataset, n::bigint as n, round(level_high, 6) as level_high, round(level_low, 6) as level_low, round(rss, 6) as rss from st"
ORACLE["line_by_dataset"] = XY + ", m as (select dataset, x - avg(x) over (partition by dataset) as x, y - avg(y) over (partition by dataset) as y from xy), f as (select sum(x * y) / sum(x * x) as b from m) select 'all' as scope, count(*) as n, count(distinct dataset) as datasets, round(any_value(b), 6) as b, round(sum((y - b * x) ** 2), 6) as rss from m, f"
ORACLE["information_criteria"] = XY + """, n as (select dataset, count(*) as c from xy group by 1), sc2 as (select 'all' as scope, x, y from xy union all select dataset, x, y from xy join n using (dataset) where c >= 30 union all select 'without_en', x, y from xy where dataset <> 'en'),
f as (select scope, regr_intercept(y, x) as a, regr_slope(y, x) as b from sc2 group by 1), li as (select scope, count(*) as n, sum((y - a - b * x) ** 2) as rss from sc2 join f using (scope) group by 1), """ + step_sql("scope", "sc2") + """,
hi as (""" + hinge_sql("scope", "sc2") + """),
al as (select scope, 'linear' as model, n, rss, 3 as k from li union all select scope, 'step', n::bigint, rss, 4 from st union all select scope, 'hinge', n, rss, 5 from hi), ic as (select scope, model, n, rss, n * ln(case when rss <= 0 then 1e-12 else rss end / n) + 2 * k as aic, n * ln(case when rss <= 0 then 1e-12 else rss end / n) + k * ln(n) as bic from al)
select scope, model, n, round(rss, 5) as rss, round(aic, 5) as aic, round(bic, 5) as bic, round(aic - min(aic) over (partition by scope), 5) as delta_aic, round(bic - min(bic) over (partition by scope), 5) as delta_bic from ic"""
ORACLE["hinge_by_dataset"] = XY + """, q as (select quantile_cont(x, 0.05::double) as lo, quantile_cont(x, 0.95::double) as hi from xy), h as (select dataset, k, x, y, greatest(0.0::double, x - (lo + (hi - lo) * k / 299)) as h from xy, q, range(300) r(k)),
m as (select k, x - avg(x) over w as x, y - avg(y) over w as y, h - avg(h) over w as h from h window w as (partition by k, dataset)), s as (select k, count(*) as n, sum(x * x) as xx, sum(x * h) as xh, sum(h * h) as hh, sum(x * y) as xy_, sum(h * y) as hy, sum(y * y) as yy from m group by 1),
f as (select k, n, yy - (xy_ * hh - hy * xh) / (xx * hh - xh * xh) * xy_ - (hy * xx - xy_ * xh) / (xx * hh - xh * xh) * hy as rss from s where xx * hh - xh * xh > 1e-9 * xx * hh) select 'all' as scope, n, round(rss, 6) as rss from f order by round(rss, 9), k limit 1"""
ORACLE["hinge_fit"] = XY + """, q as (select dataset, quantile_cont(x, 0.05::double) as lo, quantile_cont(x, 0.95::double) as hi from xy group by 1),
h as (select dataset, k, x, y, greatest(0.0::double, x - (lo + (hi - lo) * k / 299)) as h from xy join q using (dataset), range(300) r(k)),
m as (select dataset, k, x - avg(x) over w as x, y - avg(y) over w as y, h - avg(h) over w as h from h window w as (partition by dataset, k)),
s as (select dataset, k, count(*) as n, sum(x * x) as xx, sum(x * h) as xh, sum(h * h) as hh, sum(x * y) as xy_, sum(h * y) as hy, sum(y * y) as yy from m group by 1, 2),
f as (select dataset, k, n, case when xx * hh - xh * xh > 1e-9 * xx * hh then yy - (xy_ * hh - hy * xh) / (xx * hh - xh * xh) * xy_ - (hy * xx - xy_ * xh) / (xx * hh - xh * xh) * hy else yy - xy_ * xy_ / xx end as rss from s)
select dataset, n, round(rss, 6) as rss from f qualify row_number() over (partition by dataset order by round(rss, 9), k) = 1"""
ORACLE["holm_adjusted"] = """with t as (select lang as dataset, doc_id as uid, case when doc_id % 9 <> 0 then (doc_id * 37 % 1009) / 20000.0::double end as p from documents), r as (select *, coalesce(p, 1.0::double) as q, count(*) over (partition by dataset) as m, row_number() over (partition by dataset order by coalesce(p, 1.0::double)) as k from t)
select dataset, uid, round(p, 6) as p, round(case when p is not null then least(1.0::double, max((m - k + 1) * q) over (partition by dataset order by q, k rows unbounded preceding)) end, 6) as p_holm from r"""
ORACLE["sparse_groups"] = C + ", g as (select dataset, count(*) as n, count(distinct cluster) as c, count(*) filter (score < 1) as e, count(*) filter (score > 0) as k, count(distinct su) as d from cheap where score is not null group by 1) select dataset, concat_ws(',', case when n < 60 then 'few_rows' end, case when c < 25 then 'few_clusters' end, case when e < 8 then 'few_errors' end, case when k < 8 then 'few_correct' end, case when d < 5 then 'few_values' end) as reasons from g"
ORACLE["recovered_counts"] = C + " select dataset, cluster, count(*) as n, sum(score)::bigint as k from cheap where score is not null group by 1, 2"

_AFTER = "aft as (select dataset, uid, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) > 30), chr(10)) as text from files)"
_MAP = "ml as (select dataset, uid, unnest(a) as s, generate_subscripts(a, 1) as k from (select dataset, uid, string_split(text, chr(10)) as a from files)), lm as (select dataset, uid, k as ol, case when length(s) > 30 then sum((length(s) > 30)::int) over (partition by dataset, uid order by k rows unbounded preceding)::bigint end as nl, case (k - 1) % 3 when 0 then 'condition' when 1 then 'if_body' else 'else_body' end as region from ml)"
V = f"with {F_}, {_AFTER}, {_MAP}, {toks()}, {toks('aft', 'a_')}"
ORACLE["line_statistics"] = T + f""", m as (select *, {trig(2.4)} as t from tokens), b as (select *, bool_or(t) over (partition by dataset, uid, seg) as bd, row_number() over (partition by dataset, uid, seg order by pos) as r from m), o as (select *, sum((bd and r = 1)::int) over (partition by dataset, uid order by pos rows unbounded preceding)::bigint as su from b)
select dataset, uid, line, count(*) as n, round(avg(e), 4) as mean_entropy, round(max(e), 4) as max_entropy, round(sum(e), 4) as sum_entropy, count(*) filter (t) as triggers_p67, bool_or(t) as boundary_p67, min_by(su, pos) as su_p67 from o group by 1, 2, 3"""
ORACLE["line_comparison"] = V + """, b as (select dataset, uid, line, count(*) as n, sum(e) as e from tokens group by 1, 2, 3), a as (select dataset, uid, line, count(*) as n, sum(e) as e from a_tokens group by 1, 2, 3),
j as (select lm.dataset, lm.uid, case when ol is null then 'added' when nl is null then 'removed' else 'same' end as status, a.n - b.n as nd, a.e - b.e as ed from lm left join b on b.dataset = lm.dataset and b.uid = lm.uid and b.line = ol left join a on a.dataset = lm.dataset and a.uid = lm.uid and a.line = nl)
select dataset, uid, status, count(*) as lines, sum(nd)::bigint as n_delta, round(sum(ed), 4) as e_delta from j group by 1, 2, 3"""
_SIDE = "count(*) as n, sum(e) as s, avg(e) as m, count(*) filter ({t}) as t, count(distinct case when {t} then [t.uid, t.line] end) as l"
ORACLE["region_comparison"] = V + f""", b as (select t.dataset, coalesce(region, 'outside') as region, {_SIDE.format(t=trig(2.4))} from tokens t left join lm on lm.dataset = t.dataset and lm.uid = t.uid and lm.ol = t.line group by 1, 2),
a as (select t.dataset, coalesce(region, 'outside') as region, {_SIDE.format(t=trig(2.4))} from a_tokens t left join lm on lm.dataset = t.dataset and lm.uid = t.uid and lm.nl = t.line group by 1, 2)
select dataset, region, coalesce(b.n, 0) as n_before, round(b.s, 3) as sum_entropy_before, round(b.m, 3) as mean_entropy_before, coalesce(b.t, 0) as triggers_before, coalesce(b.l, 0) as boundary_lines_before,
coalesce(a.n, 0) as n_after, round(a.s, 3) as sum_entropy_after, round(a.m, 3) as mean_entropy_after, coalesce(a.t, 0) as triggers_after, coalesce(a.l, 0) as boundary_lines_after,
coalesce(a.n, 0) - coalesce(b.n, 0) as n_delta, coalesce(a.t, 0) - coalesce(b.t, 0) as triggers_delta, coalesce(a.l, 0) - coalesce(b.l, 0) as boundary_lines_delta, round(a.s - b.s, 3) as sum_entropy_delta, round(a.m - b.m, 3) as mean_entropy_delta,
case region when 'condition' then 1 when 'if_body' then 2 when 'else_body' then 3 when 'else_line' then 4 when 'outside' then 5 else 6 end::bigint as region_order from b full join a using (dataset, region)"""
ORACLE["total_changes"] = V + """, b as (select dataset, uid, count(*)::double as tokens, max(line)::double as loc from tokens group by 1, 2), a as (select dataset, uid, count(*)::double as tokens, max(line)::double as loc from a_tokens group by 1, 2),
u as (select dataset, uid, 'tokens' as metric, b.tokens as before, a.tokens as after from b join a using (dataset, uid) union all select dataset, uid, 'loc', b.loc, a.loc from b join a using (dataset, uid))
select *, after - before as delta, case when after > before then 'increased' when after < before then 'decreased' else 'unchanged' end as change from u"""
ORACLE["repeatability"] = T + ", g as (select dataset, uid, bool_or(uid % 5 = 0 and pos = 3) as o from tokens group by 1, 2) select dataset, uid, 1 as repetition, not o as same_tokens, 0.0::double as max_abs_difference from g union all select dataset, uid, 2, true, case when o then 0.25::double else 0 end from g"
ORACLE["entropy_reproduction"] = T + f""", p as (select dataset, uid, pos, e as b, e + case uid % 4 when 0 then 0.0::double when 1 then 0.001::double when 2 then (pos = 1)::int * 0.05::double else 0.5::double end * (pos % 2) as a from tokens where pos % 50 <> 7), k as (select *, {avg_rank('a', 'dataset, uid')} as ra, {avg_rank('b', 'dataset, uid')} as rb from p),
r as (select dataset, uid, count(*) as n, avg(abs(a - b)) as mae, max(abs(a - b)) as mx, case when min(a) < max(a) and min(b) < max(b) then corr(ra, rb) end as sp, case when min(a) < max(a) and min(b) < max(b) then corr(a, b) end as pe from k group by 1, 2)
select dataset, uid, n, round(mae, 5) as mae, round(mx, 5) as max_error, round(sp, 5) as spearman, round(pe, 5) as pearson, case when mx = 0 then 'Perfect' when mx < 1e-2 then 'Acceptable' else 'Error' end as status from r where n >= 2"""
ORACLE["verification_tallies"] = T + """, f as (select dataset, uid, count(*) as n, max(pos) as last from tokens group by 1, 2),
c as (select case when uid % 7 = 0 or (uid % 5 = 0 and n = 1) then 'not_in_baseline' when uid % 5 = 0 then 'length_mismatch' when uid % 6 = 1 and last >= 1 then 'token_mismatch' when uid % 4 = 0 then 'high_error' else 'perfect' end as status from f) select status, count(*) as n from c group by 1"""
ORACLE["worst_files"] = T + " select uid, round(avg(abs(e + (uid % 50) / 1000.0::double * (pos % 2) - e)), 6) as mae from tokens group by dataset, uid having count(*) >= 2 order by 2 desc, 1 limit 3"

ORACLE["answer_scores"] = """with t as (select conv_id, text as s, case when turn % 3 = 0 then ''' [END-OF -RESPONSE]' else ''' [END-OF-RESPONSE] x' end as tail from conversations), p as (select conv_id, string_split(list_extract(string_split('so <<<Output>>> ''' || s || tail, '<<<Output>>>'), -1), '[END-OF-RESPONSE]')[1] as pr, '"' || s || '"' as tr from t),
n as (select conv_id, pr, replace(regexp_replace(regexp_replace(replace(regexp_replace(pr, '[\\n ]', '', 'g'), '"', ''''), '^[''`]', ''), '[''`]$', ''), '[END-OF-RESPONSE]', '') as a, regexp_replace(regexp_replace(replace(regexp_replace(tr, '[\\n ]', '', 'g'), '"', ''''), '^[''`]', ''), '[''`]$', '') as b from p)
select conv_id, count(*) as n, count(*) filter (a = b) as k, max(pr) as last from n group by 1"""
ORACLE["pass_rates"] = "with g as (select conv_id, count(*) filter (turn % 4 <> 3) as scored, count(*) filter (turn % 4 <> 3 and length(text) % 2 = 0) as n_correct, count(*) as planned from conversations group by 1) select *, scored = planned as complete, round(case when scored = planned then n_correct / planned::double end, 6) as pass_at_1 from g"
ORACLE["variant_deltas"] = C + ", g as (select cluster as uid, case when dataset = 'en' then 'original' else dataset end as variant_id, count(*) as scored, count(*) filter (score = 1) as n_correct from cheap where score is not null group by 1, 2), o as (select uid, n_correct / scored::double as base from g where variant_id = 'original') select g.uid, variant_id, scored, n_correct, scored as planned, true as complete, round(n_correct / scored::double, 6) as pass_at_1, round(n_correct / scored::double - base, 6) as pass_at_1_delta from g left join o using (uid) where variant_id <> 'original'"
_FROZEN = C + """, every as (select dataset, uid, cluster, su, loc, score is not null as scored from cheap),
why as (select *, case when uid % 13 = 5 then 'no metric row' when not scored then 'no score' when uid % 11 = 0 then 'code differs' when uid % 17 = 3 then 'no trials' when su // 2 + uid % 2 <= 0 then 'missing or empty metric' end as reason from every where uid % 13 <> 5 or scored)"""
ORACLE["frozen_exclusions"] = _FROZEN + " select dataset, uid, reason from why where reason is not null"
ORACLE["frozen_input"] = _FROZEN + """, t as (select dataset, uid, cluster, loc, 'p67' as label, su from why where reason is null union all select dataset, uid, cluster, loc, 'p80', su // 2 + uid % 2 from why where reason is null),
q as (select label, dataset, quantile_cont(su::double, [1.0::double / 3, 2.0::double / 3]) as q, min(su) as lo, max(su) as hi from t group by 1, 2), c as (select label, dataset, list_distinct(list_filter(q, lambda x: x >= lo and x < hi)) as cuts from q)
select dataset, uid, label as threshold_label, su::bigint as su, loc, (uid % 6)::bigint as k, 5::bigint as n, round((uid % 6) / 5.0::double, 6) as y, round(ln(1 + loc::double), 6) as logloc, cluster as cluster_id, len(list_filter(cuts, lambda x: x < su))::int as interval from t join c using (label, dataset)"""
ORACLE["verified_tables"] = C + """, n as (select count(*) as n, count(*) filter (uid % 10 = 0) as m, count(*) filter (uid % 10 <> 0 and uid % 13 = 0) as d from cheap)
select 'files' as "table", 'su' as "column", n as calculated_rows, n - m as stored_rows, m as unmatched_keys, d as different_rows, case when d > 0 then 0.5::double else 0.0::double end as max_difference, m = 0 and d = 0 as agrees from n
union all select 'files', 'loc', n, n - m, m, 0, 0.0, m = 0 from n union all select 'totals', 'total', count(distinct dataset), count(distinct dataset), 0, 0, 0.0, true from cheap"""
ORACLE["audited_joins"] = """with t as (select lang as dataset, (doc_id % 100)::varchar || '__' || doc_id::varchar as uid, doc_id, (doc_id % 100)::varchar as id from documents), s as (select t.*, quality::double as score from t join labels using (doc_id)),
l as (select dataset, id, max_by(score, doc_id) as legacy_score from s group by 1, 2) select t.dataset, t.uid, legacy_score, s.score from t join l on l.dataset = t.dataset and l.id = t.id left join s on s.doc_id = t.doc_id where coalesce(abs(s.score - legacy_score) > 1e-10, true)"""
ORACLE["imported_trials"] = "with d as (select conv_id % 40 as task_id, row_number() over (partition by conv_id % 40 order by conv_id, turn, length(text)) - 1 as trial, length(text) % 2 = 0 as correct from conversations) select task_id, trial, correct from d join benchmark on item_id = task_id where task_id % 3 <> 0"
ORACLE["behaviour_status"] = """with t as (select source as cluster, case when doc_id % 5 <> 0 then doc_id end as c, doc_id % 9 <> 4 as eq, doc_id % 12 = 1 as ti from documents), g as (select cluster, count(c) as n_cases, count(*) filter (eq and not ti) as n_equal, count(*) filter (ti) as n_timeout from t group by 1)
select *, case when n_cases = 0 then 'unverified' when n_equal + n_timeout < n_cases then 'mismatch' when n_timeout > 0 then 'unverified' else 'match' end as status from g"""
ORACLE["stage_gates"] = "select 'compare' as stage, 'not_run' as status, count(*) as n from documents union all select 'measure', case when doc_id % 3 = 0 then 'not_run' when doc_id % 8 = 0 then 'stale' when doc_id % 5 = 0 then 'failed' else 'ok' end, count(*) from documents group by 2"
ORACLE["stratified_draw"] = C + """, o as (select loc, row_number() over (order by loc) - 1 as r, count(*) over () as n from cheap), c as (select max(n) as n, max((3 - (n - 1) % 3) * loc) filter (r = (n - 1) // 3) + coalesce(max((n - 1) % 3 * loc) filter (r = least(n - 1, (n - 1) // 3 + 1)), 0) as c1,
max((3 - (n - 1) * 2 % 3) * loc) filter (r = (n - 1) * 2 // 3) + coalesce(max((n - 1) * 2 % 3 * loc) filter (r = least(n - 1, (n - 1) * 2 // 3 + 1)), 0) as c2 from o),
g as (select uid, case when loc * 3 <= c1 then 'short' when loc * 3 <= c2 then 'medium' else 'long' end as grp from cheap, c), d as (select *, row_number() over (partition by grp order by md5('7' || uid::varchar), uid) as draw_rank from g)
select uid, grp, draw_rank, draw_rank <= case grp when 'medium' then 4 else 3 end as selected from d"""
ORACLE["exclusion_reasons"] = C + " select case when score is null then 'no score' when loc < 3 then 'short' when su > 100 then 'long' else 'eligible' end as reason, count(*) as n from cheap group by 1"
ORACLE["metric_validation"] = T + """, g as (select dataset, uid, uid % 4 as k, count(*) as n from tokens group by 1, 2),
m as (select dataset, uid, 'metric_entropy' as metric, n, (k = 1 and n > 5)::bigint as missing, (k = 2 and n > 7)::bigint as not_finite, k = 1 and n > 5 as bad from g
union all select dataset, uid, 'metric_surprisal', n, 1 + (k = 3 and n > 2)::bigint, 0, k = 3 and n > 2 from g)
select dataset, uid, metric, n, missing, not_finite, case when missing = n then 'all missing' when bad then 'missing' when not_finite > 0 then 'not finite' end as problem from m"""
ORACLE["latest_records"] = "select conv_id % 100 as id, max(conv_id) as conv_id, max_by(turn, conv_id * 100000 + turn) as turn, max_by(length(text), conv_id * 100000 + turn) as n from conversations group by 1"
ORACLE["remapped_paths"] = "with t as (select doc_id, source, case when doc_id % 7 = 0 then '/home/u/old/' else '/home/u/data/old/data/' end as lead, source || '/' || doc_id::varchar || '__1/main.py' as rest from documents) select doc_id, case when doc_id % 7 = 0 then lead || rest else rest end as path, doc_id::varchar as uid, substr(sha256(lead || rest), 1, 16) as h from t"
ORACLE["non_blank_lines"] = "select doc_id as uid, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''))::bigint as n from documents"
ORACLE["highlighted_tokens"] = T + ", m as (select *, max(e) over (partition by dataset, uid) as top from tokens) select dataset, uid, count(*) as n, min(pos) as first from m where e >= top * 0.9::double group by 1, 2"

#: Python sources as plans.tables.sources() makes them: sl has a row for each statement of eight words, src the texts.
_SOURCES = """wd as (select lang as dataset, doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') as w from documents),
pt as (select dataset, doc_id, w, unnest(range(greatest(1, (len(w) + 399) // 400))) as part from wd), pw as (select dataset, doc_id::varchar || '_' || part::varchar as uid, list_slice(w, part * 400 + 1, part * 400 + 400) as w from pt),
cu as (select dataset, uid, w, unnest(range((len(w) + 7) // 8)) as i from pw), sw as (select dataset, uid, i, list_slice(w, i * 8 + 1, i * 8 + 8) as w from cu),
sl as (select dataset, uid, i, 'w' || w[1] as name, array_to_string(w, ' ') as said, length(array_to_string(w, ' ')) % 4 as kind, max(i) over (partition by dataset, uid) as top from sw),
bd as (select *, case when i % 10 = 0 then 'def f' || i::varchar || '(n):' || chr(10) else '' end || '    ' as head, kind = 1 and i = min(i) filter (kind = 1) over (partition by dataset, uid) as swapped from sl),
st as (select *, head || case kind when 0 then name || ' = "' || said || '"' when 1 then 'if ' || name || ' > n:' || chr(10) || '        n = "' || said || '"' || chr(10) || '    else:' || chr(10) || '        ' || name || ' = n'
when 2 then name || '("' || said || '", n)' else 'for ' || name || ' in "' || said || '":' || chr(10) || '        n += 1' end || chr(10) as code from bd),
src as (select dataset, uid, string_agg(code, '' order by i) as text from st group by 1, 2)"""
ORACLE["complexity"] = f"with {_SOURCES}, " + """n as (select dataset, uid, count(*) filter (kind = 0) as k0, count(*) filter (kind = 1) as k1, count(*) filter (kind = 2) as k2, count(*) filter (kind = 3) as k3, count(*) filter (i % 10 = 0) as f,
count(distinct name) as names, count(distinct said) as said from sl group by 1, 2),
fu as (select dataset, uid, i // 10 as fn, count(*) filter (kind = 1) as k1, count(*) filter (kind = 3) as k3, count(distinct name) filter (kind = 1) as names from sl group by 1, 2, 3),
vo as (select dataset, uid, sum(k1 + k3) as ops, (max(k1) > 0)::int + (max(k3) > 0)::int as signs, sum(names + (k1 + k3 > 0)::int + (k3 > 0)::int) as own from fu group by 1, 2),
mi as (select dataset, uid, case when ops = 0 then 100.0 else round(least(greatest((171 - 5.2 * ln(3 * ops * log2(signs + own)) - 0.23 * (1 + k1 + k3) - 16.2 * ln(f + k0 + 4 * k1 + k2 + 2 * k3)) * 100 / 171, 0), 100), 2) end::double as maintainability from n join vo using (dataset, uid)),
h as (select dataset, uid, f + k1 + k3 as cyclomatic, (3 * k1 + 2 * k3)::double as cognitive, 3 + (k0 + k1 > 0)::int + (k1 > 0)::int + (k2 > 0)::int + (k3 > 0)::int as operators,
3 * f + 2 * k0 + 8 * k1 + 3 * k2 + 6 * k3 as operands, 2 + f + said + names + 2 * (k1 > 0)::int + 3 * (k3 > 0)::int as own from n)
select dataset, uid, cyclomatic, cognitive, round(operators / 2.0::double * operands / own, 6) as halstead_difficulty, maintainability from h join mi using (dataset, uid)
union all select dataset, uid, 1, null, 0.0, 100.0 from pw where len(w) = 0"""
ORACLE["statement_owners"] = f"with {_SOURCES}, {toks('src')}, " + """sd as (select *, coalesce(sum(case kind when 1 then 3 when 3 then 2 else 1 end + (i % 10 = 0)::int) over (partition by dataset, uid order by i rows between unbounded preceding and 1 preceding), 0)::bigint as base from sl),
fd as (select *, max(case when i % 10 = 0 then base end) over (partition by dataset, uid order by i) as f, base + (i % 10 = 0)::int as s, i % 10 = 9 or i = top as last from sd),
ln as (select dataset, uid, i, list_concat(case when i % 10 = 0 then [{'own': f, 'nl': f}] else [] end, case kind when 1 then [{'own': s, 'nl': s}, {'own': s + 1, 'nl': s}, {'own': s, 'nl': s}, {'own': s + 2, 'nl': case when not last then f end}]
when 3 then [{'own': s, 'nl': s}, {'own': s + 1, 'nl': case when not last then f end}] else [{'own': s, 'nl': case when not last then f end}] end) as rows from fd),
un as (select dataset, uid, i, unnest(rows) as r, generate_subscripts(rows, 1) as k from ln), nn as (select dataset, uid, r.own as own, r.nl as nl, row_number() over (partition by dataset, uid order by i, k) as line from un)
select t.dataset, t.uid, case when tok = chr(10) then nl else own end as owner, count(*) as n from tokens t join nn on nn.dataset = t.dataset and nn.uid = t.uid and nn.line = t.line group by 1, 2, 3"""
_BRACED = """cs as (select *, case when i % 10 = 0 then 'int f' || i::varchar || '(int n) {' || chr(10) else '' end || '    ' || case kind when 0 then name || ' = "' || said || '";' when 1 then 'if (' || name || ' > n) {' || chr(10) || '        n = "' || said || '";' || chr(10) || '    } else {' || chr(10) || '        ' || name || ' = n;' || chr(10) || '    }'
when 2 then name || '("' || said || '", n);' else 'while (n < ' || name || ') {' || chr(10) || '        n += 1;' || chr(10) || '    }' end || chr(10) || case when i % 10 = 9 or i = top then '}' else '' end as code, case when i % 10 = 9 or i = top then chr(10) else '' end as tail from sl),
fn as (select dataset, uid, 'f' || (i // 10 * 10)::varchar as function_id, string_agg(code || case when i % 10 = 9 or i = top then '' else tail end, '' order by i) as text, 1 + sum(case kind when 1 then 5 when 3 then 3 else 1 end)::bigint as statements, case when max((kind % 2)::int) > 0 then 2 else 1 end::bigint as deepest from cs group by 1, 2, 3),
tn as (select dataset, uid, function_id, len(regexp_extract_all(text, '""" + _RE + """'))::bigint as n, statements, 1::bigint as functions, deepest from fn),
ou as (select dataset, uid, count(*) as f from fn group by 1, 2)"""
ORACLE["syntax_of_languages"] = f"with {_SOURCES}, {_BRACED} " + """select l as language, dataset, uid, function_id, n, statements, functions, deepest from tn, (values ('c'), ('java')) v(l)
union all select 'c', dataset, uid, null, f, 0, 0, null from ou union all select 'java', dataset, uid, null, f + 7, 0, 0, 0 from ou"""
ORACLE["sample_eligibility"] = f"with {_SOURCES}, " + r"""ev as (select dataset, uid, split_part(uid, '_', 1)::bigint as d from pw), fi as (select dataset, uid, sum(1 + (i % 10 = 0)::int + (kind = 3)::int + 3 * (kind = 1)::int) filter (not coalesce(i >= fs, false)) + (any_value(fs) % 10 = 0)::int + 1 as line, any_value(fs) as fs
from (select *, min(i) filter (kind = 1) over (partition by dataset, uid) as fs from sl) group by 1, 2),
wh as (select e.dataset, case when d % 7 = 3 then 'not_python' when fs is null then 'no_applicable_if_else: no_if' when d % 5 = 2 or d % 4 = 0 then 'missing_or_invalid_hidden_tests' else 'eligible' end as reason, case when fs is not null then coalesce(line, 1 + (fs % 10 = 0)::int) end as line from ev e left join fi using (dataset, uid))
select dataset, reason, count(*) as n, sum(line)::bigint as if_lines from wh group by 1, 2"""
_TOTAL = "select dataset, uid, count(*)::double as total_tokens, max(line)::double as loc, avg(e) as mean_entropy, exp(avg(s)) as ppl, 1.0::double + count(distinct case when {t} then seg end) as su_count_p67 from {x} group by 1, 2"
ORACLE["pair_comparison"] = f"with {_SOURCES}, " + """swp as (select dataset, uid, string_agg(case when swapped then head || 'if not (' || name || ' > n):' || chr(10) || '        ' || name || ' = n' || chr(10) || '    else:' || chr(10) || '        n = "' || said || '"' || chr(10) else code end, '' order by i) as text from st group by 1, 2 having bool_or(swapped)),
bef as (select src.* from src semi join swp using (dataset, uid)), """ + f"{toks('bef')}, {toks('swp', 'a_')}, b as ({_TOTAL.format(t=trig(2.4), x='tokens')}), a as ({_TOTAL.format(t=trig(2.4), x='a_tokens')})," + """
u as (unpivot b on total_tokens, loc, mean_entropy, ppl, su_count_p67 into name metric value before), v as (unpivot a on total_tokens, loc, mean_entropy, ppl, su_count_p67 into name metric value after)
select dataset, uid, metric, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta, case when after > before then 'increased' when after < before then 'decreased' else 'unchanged' end as change from u join v using (dataset, uid, metric)"""

_ESC = "replace(replace(replace(replace(replace(ltrim(p.tok, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
ORACLE["highlighted_files"] = T + f""", tp as (select dataset, uid, max(e) as top from tokens group by 1, 2),
pc as (select p.dataset, p.uid, p.i0, e >= top * 0.9::double as hot, case when regexp_full_match(p.tok, '[{_SPACE}]+') or p.tok = chr(10) then p.tok else left(p.tok, length(p.tok) - length(ltrim(p.tok, ' '))) || case when e >= top * 0.9::double then '<span class="hot" title="' || printf('%.3f', e) || '">' else '<span>' end || {_ESC} || '</span>' end as piece,
from placed p left join tokens t on t.dataset = p.dataset and t.uid = p.uid and t.char_start = p.char_start left join tp on tp.dataset = p.dataset and tp.uid = p.uid),
ht as (select dataset, uid, count(*) filter (hot) as n_hot, string_agg(piece, '' order by i0) as html from pc group by 1, 2)
select f.dataset, f.uid, coalesce(n_hot, 0) as n_hot, length(coalesce(html, '')) as chars, md5(coalesce(html, '')) as digest from files f left join ht on ht.dataset = f.dataset and ht.uid = f.uid"""

for _name in ("file_summary", "line_statistics", "line_comparison"):  # means of thousandths can be exact ties, sums of nothing -0.0
    ORACLE[_name] = ORACLE[_name].replace("round(", "round(1e-9::double + ")
