"""SQL for the queries of queries.py, under the same names, for another engine over the same tables."""

from __future__ import annotations

from .operators.bytecodes import MARK, SYMBOLS
from .operators.codes import CENTER
from .operators.interpolation import CUBICS, STEPS
from .operators.neighbours import lorenzo_offsets
from .operators.sampling import N_TILES
from .operators.studies import TIMINGS
from .plans import catalog
from .sources.arrays import DIMS, strides

VIEWS = {
    "emb2d": "select 'emb2d' as field_id, vec_id * 64 + p - 1 as idx, embedding[p]::double as v from embeddings, range(1, 65) t(p)",
    "emb1d": "select vec_id::varchar as field_id, p - 1 as idx, embedding[p]::double as v from embeddings, range(1, 65) t(p)",
    "evt1d": "select event_type as field_id, row_number() over (partition by event_type order by event_id) - 1 as idx, value as v from events",
    "evt3d": "select 'evt3d' as field_id, row_number() over (order by event_id) - 1 as idx, value as v from events",
    "ord2d": "select 'ord2d' as field_id, row_number() over (order by o_orderkey) - 1 as idx, o_totalprice as v from orders",
    "part1d": "select 'part1d' as field_id, row_number() over (order by p_partkey) - 1 as idx, p_retailprice as v from part",
}
ORACLE: dict[str, str] = {}


def coords(dims: list[int]) -> list[str]:
    s = strides(dims)
    return [f"idx // {s[0]}"] + [f"(idx // {s[k]}) % {dims[k]}" for k in range(1, len(dims))]


def on_grid(dims: list[int]) -> str:
    return " and ".join(f"({c}) % 4 = 0" for c in coords(dims))


def at(offset: int) -> str:
    return f"lag(v, {-offset}) over w" if offset < 0 else f"lead(v, {offset}) over w"


def features(view: str) -> str:
    dims = DIMS[view]
    steps = strides(dims)
    axis = "[" + ", ".join(at(s) for d in steps for s in (-d, d)) + "]"
    lorenzo = " + ".join(f"({s}) * {at(o)}" for o, s in lorenzo_offsets(dims).items())
    spline = ", ".join(f"abs(v - (-{at(-3 * d)} + 9 * {at(-d)} + 9 * {at(d)} - {at(3 * d)}) / 16.0) as s{k}" for k, d in enumerate(steps))
    top = " + ".join(f"coalesce(sum(s{k}), 0)" for k in range(len(steps)))
    low = " + ".join(f"count(s{k})" for k in range(len(steps)))
    return f"""
with cells as ({VIEWS[view]}), n as (
  select *, list_avg(list_filter({axis}, lambda x: x is not null)) as a, ({lorenzo}) / {2 ** len(dims) - 1}.0 as l, {spline}
  from cells window w as (partition by field_id order by idx)
)
select field_id, round(max(v) - min(v), 6) as value_range, round(case when max(v) > min(v) then avg(v) - min(v) end, 6) as mean_value,
       round(avg(abs(a - v)), 6) as mean_neighbor_difference, round(avg(abs(l - v)), 6) as mean_lorenzo_difference,
       round(({top}) / nullif({low}, 0), 6) as mean_spline_difference
from n where {on_grid(dims)} group by field_id"""


def blocks(view: str) -> str:
    dims = DIMS[view]
    c = coords(dims)
    inside = " and ".join(f"({x}) % 16 < 4" for x in c)
    by = ", ".join(f"({x}) // 16" for x in c)
    return f"""
with cells as ({VIEWS[view]}), th as (select field_id, 0.15 * (avg(v) - min(v)) as lim from cells where {on_grid(dims)} group by field_id),
b as (select field_id, count(*) as n, max(v) - min(v) as r from cells where {inside} group by field_id, {by})
select field_id, round(0.5 + 0.5 * avg(case when n < {0.75 * 4 ** len(dims)} or r > lim then 1.0 else 0.0 end), 6) as non_constant_block_percentage
from b join th using (field_id) group by field_id"""


for _v in VIEWS:
    ORACLE[f"neighbour_features_{_v}"] = features(_v)
    ORACLE[f"constant_blocks_{_v}"] = blocks(_v)

_TOTALS = "count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(min(v), 6) as least, round(max(v), 6) as greatest"
_EMB1, _EMB2, _EVT1, _EVT3, _ORD2, _PART1 = (f"with cells as ({VIEWS[v]})" for v in ("emb1d", "emb2d", "evt1d", "evt3d", "ord2d", "part1d"))

#: Lorenzo codes of emb2d at a bound; beyond an edge counts 0.
_CODES = (
    f"with cells as ({VIEWS['emb2d']}), q as (select field_id, idx, floor(v / (2 * {{b}}::double) + 0.5)::bigint as v from cells), "
    "c as (select field_id, idx, v - (case when idx % 64 > 0 then coalesce(lag(v, 1) over w, 0) else 0 end + case when idx // 64 > 0 then coalesce(lag(v, 64) over w, 0) else 0 end "
    "- case when idx % 64 > 0 and idx // 64 > 0 then coalesce(lag(v, 65) over w, 0) else 0 end) as code from q window w as (partition by field_id order by idx)), "
    "h as (select field_id, code, count(*) as freq from c group by all), s as (select *, freq / sum(freq) over (partition by field_id)::double as f, sum(freq) over (partition by field_id) as n from h), "
    "k as (select *, case when -log2(f) >= 32 then 0 when -log2(f) >= 1 then -log2(f) when code = 0 then 1 when abs(code) = 1 then 2.5 else 4 end as bits from s)"
)

#: Tiles of ord2d, 10 x 10.
_TILE_ROWS = "t0 as (select field_id, idx // 50 as i, idx % 50 as j, {v} as v from {src}), t1 as (select field_id, i // 10 as tr, j // 10 as tc, i % 10 * 10 + j % 10 as pos, v from t0 where j < 50)"
_CENTRED = f"with cells as ({VIEWS['ord2d']}), cc as (select field_id, idx, v - avg(v) over (partition by field_id, idx % 50) as v from cells), {_TILE_ROWS.format(v='v', src='cc')}, tl as (select field_id, tr, tc, list(v order by pos) as vals, 2 * var_samp(v) as intra, avg(v * v) as ms from t1 group by all having count(*) = 100 and var_samp(v) > 0)"
_PAIRS = _CENTRED + ", pr as (select a.field_id, a.tr, a.tc, a.intra, abs(a.tr - b.tr) + abs(a.tc - b.tc) as w, list_distance(a.vals, b.vals) as d, abs(list_aggregate([1], 'sum') * 0 + (list_dot_product(a.vals, b.vals) - 100 * list_avg(a.vals) * list_avg(b.vals)) / (99 * list_stddev_samp(a.vals) * list_stddev_samp(b.vals))) as r from tl a join tl b on a.field_id = b.field_id and (a.tr <> b.tr or a.tc <> b.tc))"
_PAIRS = _PAIRS.replace("list_aggregate([1], 'sum') * 0 + ", "")


def _entropy(value: str, src: str, name: str) -> str:
    """CTEs that end in `name`: entropy over 15 right-closed bins per tile."""
    return (
        f"{name}_b as (select field_id, tr, tc, {value} as x from {src}), {name}_r as (select field_id, tr, tc, min(x) as lo, max(x) as hi, count(*) as n from {name}_b group by all), "
        f"{name}_h as (select field_id, tr, tc, greatest(0, least(15, ceil((x - lo) / nullif((hi - lo) / 15.0, 0))))::int as bin, count(*) as c, any_value(n) as n, any_value(hi - lo) as span from {name}_b join {name}_r using (field_id, tr, tc) group by all), "
        f"{name} as (select field_id, tr, tc, case when any_value(span) > 0 then -coalesce(sum(case when bin >= 1 then c / n::double * log2(c / n::double) end), 0) - (15 - count(*) filter (bin >= 1)) * 1e-10 * log2(1e-10::double) else 0 end as entropy from {name}_h group by all)"
    )


_WHOLE = f"with cells as ({VIEWS['ord2d']}), {_TILE_ROWS.format(v='v', src='cells')}, wh as (select field_id, tr, tc from t1 group by all having count(*) = 100 and var_samp(v) > 0), tw as (select t1.* from t1 join wh using (field_id, tr, tc))"

#: A forecast of each order's price by the one before, in ten folds.
_ERRORS = "with o as (select row_number() over (order by o_orderkey) - 1 as idx, o_totalprice as actual, lag(o_totalprice) over (order by o_orderkey) as predicted, ntile(10) over (order by o_orderkey) - 1 as fold from orders), e as (select fold, case when actual = 0 then 0 else abs(actual - predicted) / abs(actual) end as ape from o where predicted is not null)"
_PARTS = "with p as (select p_size::double as x, p_retailprice as y, ntile(5) over (order by p_partkey) - 1 as fold from part), m as (select fold, max(y - x) as m from p group by fold), s as (select a.fold, max(b.m) as state from m a join m b on a.fold <> b.fold group by a.fold)"


def _values(rows) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(lit(x) for x in v) + "]" if isinstance(v, (list, tuple)) else f"{v!r}::double" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_MOCK = (
    "with m(position, metric, module, usage, causes) as (values " + _values([(i, m.metric, m.module, m.usage, list(m.causes)) for i, m in enumerate(catalog.MOCK.metrics)]) + "), "
    'ch("case", classes, training) as (values ' + _values([(n, catalog.MOCK.classes(c), catalog.TRAINING in c) for n, c in catalog.MOCK_CASES.items()]) + "), "
    'x as (select "case", position, metric, module, usage, causes, list_has_any(causes, classes) and (usage = \'feature\' or training) as invalid from m, ch)'
)
_TIMES = "with t(method, codec, mean, sd) as (values " + _values(TIMINGS) + "), b as (select codec, mean as mean_baseline from t where method = 'none')"
_STORED = "with c as (select * from customer)"

ORACLE |= {
    "sampled_grid_stats": f"{_EMB2} select field_id, {_TOTALS} from cells where {on_grid(DIMS['emb2d'])} group by field_id",
    "rescaled_range": f"{_EVT1} select field_id, round(avg((v - lo) / nullif(hi - lo, 0)), 6) as mean_rescaled from (select *, min(v) over (partition by field_id) as lo, max(v) over (partition by field_id) as hi from cells) group by field_id",
    "quant_entropy_ratio": f"{_EMB1}, h as (select field_id, floor(v / 0.02::double + 0.5) as q, count(*) as c from cells group by all), f as (select field_id, c / sum(c) over (partition by field_id)::double as f from h), e as (select field_id, -sum(f * log2(f)) as entropy from f group by field_id) select field_id, round(entropy, 6) + 0 as entropy, round(64.0 / nullif(round(entropy, 12), 0), 6) as ratio from e",
    "changed_bound_run": f"{_EMB1}, h as (select field_id, floor(v / 0.02::double + 0.5) as q, count(*) as c from cells group by all), f as (select field_id, c / sum(c) over (partition by field_id)::double as f from h) select field_id, -1.0::double as value_range, round(-sum(f * log2(f)), 6) + 0 as entropy from f group by field_id",
    "code_histogram": f"{_EVT1} select field_id, floor(v / 2.0::double + 0.5)::bigint as code, count(*) as freq from cells group by all",
    "lorenzo_histogram": _CODES.format(b="0.01") + " select field_id, code, freq from h",
    "lorenzo_code_bits": _CODES.format(b="0.01") + " select field_id, round(sum(f * bits), 6) as mean_bits, round(32.0 / nullif(sum(f * bits), 0), 6) as ratio from k group by field_id",
    "lorenzo_corrected_ratio": _CODES.format(b="0.5")
    + ", g as (select field_id, sum(f * bits) as b, coalesce(max(f) filter (code = 0), 0) as fc, coalesce(max(freq) filter (code = 0), 0) as nc, any_value(n) as n from k group by field_id), "
    "p as (select *, (case when nc > n // 2 then fc when fc > 0 then -fc * log2(fc) else 0 end) / nullif(b, 0) as p0 from g), r as (select *, greatest(1, 1 / nullif((1 - fc) * p0 + 1 - p0, 0)) as rho from p) "
    "select field_id, round(b, 6) as mean_bits, round(p0, 6) as p0, round(rho, 6) as rho, round(32.0 * rho / nullif(b, 0), 6) as ratio from r",
    "top_codes": _CODES.format(b="0.01") + " select field_id, code, freq from (select *, row_number() over (partition by field_id order by freq desc, code) as r from h) where r <= 5 and code <> 0",
    "code_window": _CODES.format(b="0.01") + " select field_id, code, freq from h where abs(code) <= 10",
    "quantise_grid": f"{_EMB1} select field_id, round(avg(abs(v - floor(v / 0.1::double + 0.5) * 0.1::double)), 6) as mean_round_error, round(avg(v - floor(v / 0.1::double) * 0.1::double), 6) as mean_floor_error from cells group by field_id",
    "tile_spread": _CENTRED + " select field_id, tr, tc, round(intra / 1e9, 6) as intra, round(ms / 1e9, 6) as mean_square from tl",
    "tile_pairs": _PAIRS + " select field_id, count(*) as n_pairs, round(sum(w)::double, 6) as sum_w, round(avg(d) / 1e6, 6) as mean_d, round(avg(r), 6) as mean_r from pr group by field_id",
    "spatial_statistics": _PAIRS
    + ", n as (select field_id, count(*)::double as n from tl group by field_id), pt as (select field_id, tr, tc, any_value(intra) as intra, sum(sqrt(w * d)) / sum(sqrt(w)) as sv, sum(sqrt(w) * r) / sum(sqrt(w)) as sc, max(r) as rmax, min(r) as rmin from pr group by all) "
    "select field_id, round(-sum(intra * sv) * ln(1 / any_value(n)) / any_value(n) / 1e15, 6) as spatial_variation, round(sum(sc / intra) / sum(1 / intra), 6) as correlation_weighted, round(avg(sc), 6) as correlation_mean, round(min(rmax), 6) as correlation_minmax, round(min(rmin), 6) as correlation_min from pt join n using (field_id) group by field_id",
    "tile_entropy": f"with cells as ({VIEWS['ord2d']}), {_TILE_ROWS.format(v='v', src='cells')}, {_entropy('v', 't1', 'h')} select field_id, tr, tc, round(entropy, 6) + 0 as entropy from h",
    "tile_distortion": f"{_WHOLE}, {_entropy('v', 'tw', 'h')}, {_entropy('floor(v / 1000.0::double) * 1000.0', 'tw', 'q')} select field_id, round(sum(pow(2.0, -2 * (q.entropy - h.entropy)) / 12), 6) as distortion from h join q using (field_id, tr, tc) group by field_id",
    "total_statistics": f"{_EVT1} select field_id, {_TOTALS} from cells group by field_id",
    "singular_share": "with t as (select event_type, sum(value) as s from events group by 1), r as (select row_number() over (order by s desc, event_type) as rank, sum(s) over (order by s desc, event_type rows unbounded preceding) / sum(s) over () as share from t) select min(rank)::int as needed from r where share >= 0.99",
    "sampled_tile_ids": f"{_EMB2}, t as (select field_id, (idx // 64 // 16)::varchar || ',' || (idx % 64 // 16)::varchar as tile, v from cells), w as (select field_id, tile, sum(v) as total from t group by all having count(*) = 256), r as (select *, row_number() over (partition by field_id order by md5('0:' || tile), tile)::int as rank from w) select field_id, tile, rank, round(total, 6) + 0 as total from r where rank <= {N_TILES}",
    "reconstruction_error": f"{_EVT1}, e as (select *, abs(v - floor(v / 0.02::double + 0.5) * 0.02::double) as e from cells) select field_id, round(max(e), 6) as max_error, round(avg(e * e), 6) as mse, round(max(v) - min(v), 6) as value_range from e group by field_id",
    "sampled_block_cells": f"{_EMB2}, d as (select max(idx) // 64 + 1 as n from cells), a as (select n // 4 as blocks, floor(sqrt(0.02::double) * (n // 4))::int as k from d), x as (select distinct floor(i::double / greatest(1, k - 1) * (blocks - 1) + 0.5)::bigint as b from (select *, unnest(range(k)) as i from a)), y as (select distinct floor(i::double / greatest(1, 2 - 1) * 15 + 0.5)::bigint as b from range(2) t(i)) select field_id, idx, round(v, 6) + 0 as v from cells join x on idx // 64 // 4 = x.b join y on idx % 64 // 4 = y.b",
    "fold_sizes": "select fold::int as fold, count(*) as n, min(idx) as first, max(idx) as last from (select row_number() over (order by o_orderkey) - 1 as idx, ntile(7) over (order by o_orderkey) - 1 as fold from orders) group by 1",
    "fold_sizes_by_group": f"{_EVT1} select field_id, fold, count(*) as n from (select field_id, (ntile(10) over (partition by field_id order by idx) - 1)::int as fold from cells) group by all",
    "medape_folds": f"{_ERRORS} select fold::int as fold, count(*) as n, round(median(ape), 6) as medape, round(list_sort(list(ape))[1 + floor(count(*) * 0.1)::int], 6) as p10, round(list_sort(list(ape))[1 + floor(count(*) * 0.9)::int], 6) as p90 from e group by fold",
    "medape_overall": f"{_ERRORS} select count(*) as n, round(median(ape), 6) as medape, round(list_sort(list(ape))[1 + floor(count(*) * 0.1)::int], 6) as p10, round(list_sort(list(ape))[1 + floor(count(*) * 0.9)::int], 6) as p90 from e",
    "medape_upper_rule": f"{_ERRORS} select fold::int as fold, count(*) as n, round(case when count(*) % 2 = 0 and count(*) >= 4 then (list_sort(list(ape))[1 + count(*) // 2] + list_sort(list(ape))[2 + count(*) // 2]) / 2 else list_sort(list(ape))[1 + count(*) // 2] end, 6) as medape, round(list_sort(list(ape))[1 + floor(count(*) * 0.1)::int], 6) as p10, round(list_sort(list(ape))[1 + floor(count(*) * 0.9)::int], 6) as p90 from e group by fold",
    "offset_predictor": f"{_PARTS} select fold::int as fold, count(*) as n, round(avg(x + state), 6) as mean_predicted, round(avg(case when y = 0 then 0 else abs(y - x - state) / abs(y) end), 6) as mean_ape from p join s using (fold) group by fold",
    "program_predictor": f"{_PARTS} select fold::int as fold, count(*) as n, round(avg(x + state), 6) as mean_predicted from p join s using (fold) group by fold",
    "feature_matrix": "select p_partkey, p_size::double as a, p_retailprice as b from part",
    "standard_scaling": "with t as (select avg(p_size) as ms, stddev_samp(p_size) as ss, avg(p_retailprice) as mp, stddev_samp(p_retailprice) as sp from part where p_partkey % 4 <> 0) select p_partkey, round((p_size - ms) / nullif(ss, 0), 6) + 0 as s, round((p_retailprice - mp) / nullif(sp, 0), 6) + 0 as p from part, t",
    "linear_fit": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) as slope, round(regr_intercept(l_extendedprice, l_quantity), 6) as intercept from lineitem group by 1",
    "invalidation_matrix": f'{_MOCK} select "case", metric, usage, invalid from x',
    "invalidation_ids": f"""{_MOCK} select "case", usage, string_agg(metric, ',' order by position) as all_ids, coalesce(string_agg(metric, ',' order by metric) filter (not invalid), '') as valid_ids, coalesce(string_agg(metric, ',' order by metric) filter (invalid), '') as invalid_ids from x group by all""",
    "run_requirements": f'{_MOCK} select "case", bool_or(invalid) as compress, bool_or(invalid) as decompress, true as training from x group by 1',
    "module_map": f"{_MOCK} select module, string_agg(distinct metric, ',' order by metric) as metrics, array_to_string(list_sort(list_distinct(flatten(list(causes)))), ',') as causes from m group by module",
    "fresh_or_cached": "select event_id::varchar as field_id, round(case when event_id % 3 = 0 then value else -1.0 end, 6) + 0 as value from events",
    "task_grid": "select 1::bigint as experiment, 1::bigint as compressor, 1::bigint as dataset, s_suppkey as field, r as replicate from supplier, range(3) t(r)",
    "todo_tasks": "select c_custkey as field, 0::bigint as replicate from customer where c_custkey % 2 <> 0",
    "done_tasks": "select c_custkey as field, 0::bigint as replicate from customer where c_custkey % 2 = 0",
    "stored_results": f"{_STORED} select c_custkey as field, 'balance' as metric, c_acctbal as value from c union all select c_custkey, 'nation', c_nationkey::double from c",
    "stored_wide": f"{_STORED} select c_custkey as field, c_acctbal as balance, c_nationkey::double as nation from c",
    "config_hashes": """select distinct sha256(c) as hash, c as config from (select '{"brand":"' || p_brand || '","size":' || p_size || '}' as c from part)""",
    "outer_joined_entries": "select o_orderkey, c_name, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey",
    "key_lookup": "select o_orderkey, o_orderstatus from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and o_custkey = (select max(o_custkey) from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT')",
    "insert_ignore_union": "select c_nationkey as nation from customer union select s_nationkey from supplier",
    "set_differences": "select *, 'both' as part from (select c_nationkey as nation from customer intersect select s_nationkey from supplier) union all select *, 'customers' from (select c_nationkey as nation from customer except select s_nationkey from supplier)",
    "json_numbers": "select * from (select event_id, k as metric, try_cast(json_extract_string(props, '$.\"' || k || '\"') as double) as value from (select event_id, props, unnest(json_keys(props)) as k from events)) where value is not null",
    "split_settings": "select distinct p_brand as key, p_type || '=' || p_size as value from part",
    "regex_groups": "select c_custkey, regexp_extract(c_name, '([A-Za-z]+)\\D*(\\d+)', 1) as word, regexp_extract(c_name, '([A-Za-z]+)\\D*(\\d+)', 2) as number from customer",
    "elementary_functions": "select p_partkey, round(sqrt(x), 6) as root, round(cbrt(x), 6) as cube_root, round(ln(x), 6) as ln, round(log2(x), 6) as lb, round(log10(x), 6) as lg, round(exp(-x / 1000), 6) as decay, round(pow(x / 1000, 1.5), 6) as power, floor(x)::bigint as down, ceil(x)::bigint as up, floor(x / 7 + 0.5)::bigint as near from (select p_partkey, p_retailprice as x from part)",
    "spline_prediction": f"{_PART1}, n as (select idx, (-lag(v, 3) over w + 9 * lag(v, 1) over w + 9 * lead(v, 1) over w - lead(v, 3) over w) / 16.0 as guess from cells window w as (partition by field_id order by idx)) select idx, round(guess, 6) as guess from n where guess is not null",
    "vector_products": "select vec_id, round(sqrt(list_dot_product(x, x)), 6) as norm, round(list_dot_product(x, list_reverse(x)), 6) + 0 as turned from (select vec_id, list_transform(embedding::float[], lambda e: e::double) as x from embeddings)",
    "geometric_mean": "select p_brand, round(exp(avg(ln(p_retailprice))), 6) as geometric_mean from part group by 1",
    "weighted_mean": "select l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) as weighted_mean from lineitem group by 1",
    "outlier_filter": f"{_EVT1} select field_id, count(*) as n, round(avg(ln(greatest(v, 1e-9))), 6) as mean_log from cells where v < 100 group by field_id",
    "degenerate_fields": f"{_EMB1} select field_id from cells group by field_id having count(*) >= 10 and stddev_samp(v) >= 0.1",
    "slice_plane": f"{_EVT3} select idx // 100 as i, idx % 10 as k, v from cells where idx // 10 % 10 = 3",
    "every_hundredth": f"{_EVT3} select idx, v from cells where idx % 100 = 99",
    "running_maximum": "with r as (select event_type as series, event_id, max(value) over (partition by event_type order by event_id rows unbounded preceding) as running_max from events) select series, min(event_id) as event_id, running_max from r group by series, running_max",
    "relative_differences": f"{_EVT1} select field_id, idx, round((b - v) / nullif(b, 0), 6) + 0 as change from (select *, lag(v) over (partition by field_id order by idx) as b from cells) where idx < 10 and idx > 0",
    "least_by": "select p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) as cheapest from part group by 1",
    "distinct_by_column": "select o_orderpriority, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by 1, 2",
    "any_of": "select l_returnflag, bool_or(l_discount > 0.09) as any_large, count(distinct l_linestatus) as n_status from lineitem group by 1",
    "timing_summary": "select event_type, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(min(value), 6) as least, round(max(value), 6) as greatest from events group by 1",
    "synthetic_grid": "select idx, case when y = 0 then null else round(ln(y), 6) + 0 end as v from (select idx, pow(pow(sin((idx // 100) * 0.1::double + (idx % 100) * 0.2::double), 2) / cos((idx % 100) * 0.1::double), 2) as y from range(10000) t(idx))",
    "metadata_scan": "select 'nation.parquet' as name, true as filled",
    "dataset_count": "select count(distinct event_type) as n_fields from events",
    "one_field": f"{_EMB1} select idx, v from cells where field_id = '7'",
    "packed_round_trip": f"{_EMB1} select field_id, idx, v from cells",
    "search_speedup": f"{_TIMES}, c as (select method, codec, case when method = 'none' then 51 * mean else 50 * mean + mean_baseline end as cost from t join b using (codec)) select a.codec, a.method, round(log2(n.cost / a.cost), 6) as speedup from c a join c n on a.codec = n.codec and n.method = 'none' where a.method <> 'none'",
    "best_codec_speedup": f"{_TIMES}, c as (select method, sum(mean) as cost from t group by 1) select a.method, round(n.cost / a.cost, 6) as speedup from c a, c n where n.method = 'none' and a.method <> 'none'",
    "parallel_writes": f"{_TIMES} select codec, method, round(case when method = 'none' then 30 * (mean + 0.027::double) else 30 * (mean + mean_baseline + 0.027::double) end, 6) as seconds from t join b using (codec)",
    "bound_sweep": f"{_EVT1}, b as (select *, unnest([0.001, 0.01, 0.1, 1.0, 10.0]::double[]) as bound from cells), h as (select field_id, bound, floor(v / (2 * bound) + 0.5)::bigint as code, count(*) as c from b group by all), s as (select field_id, bound, c / sum(c) over (partition by field_id, bound)::double as f from h) select field_id || '@' || bound as field_id, round(-sum(f * log2(f)), 6) + 0 as entropy from s group by s.field_id, bound",
    "event_windows": "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, round(avg(value), 6) as mean_value, round(min(value), 6) as least, round(max(value), 6) as greatest from events group by all",
    "flagship": f"""
with cells as ({VIEWS['emb1d']}), l as (select field_id, idx, v, lag(v) over (partition by field_id order by idx) as w from cells),
x as (select field_id, avg(abs(w - v)) as x from l where idx % 4 = 0 group by 1), h as (select field_id, floor(v / 0.02::double + 0.5) as q, count(*) as c from cells group by all),
f as (select field_id, c / sum(c) over (partition by field_id)::double as f from h), y as (select field_id, 64.0 / nullif(round(-sum(f * log2(f)), 12), 0) as y from f group by 1),
r as (select x, y, ntile(10) over (order by field_id::bigint) - 1 as fold from x join y using (field_id)), m as (select fold, max(y - x) as m from r group by 1), s as (select a.fold, max(b.m) as state from m a join m b on a.fold <> b.fold group by 1),
e as (select fold, case when y = 0 then 0 else abs(y - x - state) / abs(y) end as ape from r join s using (fold))
select fold::int as fold, count(*) as n, round(median(ape), 6) as medape, round(list_sort(list(ape))[1 + floor(count(*) * 0.1)::int], 6) as p10, round(list_sort(list(ape))[1 + floor(count(*) * 0.9)::int], 6) as p90 from e group by fold""",
}


def text_ratios_sql(by: list[str], text: str) -> str:
    """Entropies of the bytes of documents, by themselves and given the byte before."""
    g = ", ".join(by)
    return f"""
with d as (
  select {g}, hex(coalesce({text}, '')) as x from documents
), s as (
  select {g}, list_append(list_prepend({MARK}, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::int)), {MARK}) as s from d
), p as (
  select {g}, unnest(list_transform(range(1, len(s)), lambda i: s[i] * {SYMBOLS} + s[i + 1])) as code from s
), h as (
  select {g}, code, count(*)::double as c from p group by {g}, code
), f as (
  select {g}, code // {SYMBOLS} as a, sum(c) * log2(sum(c)) - sum(c * log2(c)) as bits from h group by {g}, code // {SYMBOLS}
), o as (
  select {g}, sum(bits) as bits_1 from f group by {g}
), z as (
  select {g}, code % {SYMBOLS} as b, sum(c) as c from h group by {g}, code % {SYMBOLS}
), y as (
  select {g}, sum(c) as n, coalesce(sum(c) filter (b = {MARK}), 0)::bigint as n_texts, coalesce(sum(c) filter (b <> {MARK}), 0)::bigint as n_bytes, sum(c) * log2(sum(c)) - sum(c * log2(c)) as bits_0 from z group by {g}
)
select {', '.join(f'y.{c}' for c in by)}, n_texts, n_bytes, round(round(bits_0, 6) / n, 6) + 0.0 as entropy_0, round(round(bits_1, 6) / n, 6) + 0.0 as entropy_1,
       round(n_bytes * 8.0 / nullif(round(bits_0, 6), 0), 6) as ratio_0, round(n_bytes * 8.0 / nullif(round(bits_1, 6), 0), 6) as ratio_1
from y join o on {' and '.join(f'y.{c} is not distinct from o.{c}' for c in by)}"""


def _step(value: str, guess: str, bound: str) -> tuple[str, str]:
    """(code, decoded value) of a value given its guess."""
    half = f"floor((floor(abs({value} - {guess}) / {bound}) + 1) / 2)"
    back = f"({guess} + 2 * (case when {value} >= {guess} then {half} else -{half} end) * {bound})"
    good = f"{half} < {CENTER} and abs({back} - {value}) <= {bound}"
    return f"case when {good} then {CENTER} + case when {value} >= {guess} then {half} else -{half} end else 0 end::bigint", f"case when {good} then {back} else {value} end"


def finest_codes_sql(view: str, bound: str = "0.01::double", stride: int = 5) -> str:
    """CTEs that end in h: field_id, code, freq of the interpolating predictor's finest level."""
    dims = DIMS[view]
    steps, c = strides(dims), coords(dims)
    cols, cases = [], []
    for a in range(len(dims)):
        on = [f"({c[a]} - 1) % {2 * stride} = 0"] + [f"({c[k]}) % 2 = 0" for k in range(a + 1, len(dims))]
        near = {s: f"case when {f'({c[a]}) >= {-s}' if s < 0 else f'({c[a]}) + {s} < {dims[a]}' if a else 'true'} then {at(s * steps[a])} end" for s in STEPS}
        cols += [f"{near[s]} as n{a}_{s + 9}" for s in STEPS]
        guess = ", ".join("(" + " + ".join(["0.0::double"] + [f"{float(w)!r}::double * n{a}_{s + 9}" for s, w in sorted(ws.items())]) + f") / {float(d)!r}::double" for ws, d in CUBICS)
        cases.append((" and ".join(on), f"coalesce({guess})"))
    picked = "case " + " ".join(f"when {on} then {guess}" for on, guess in reversed(cases)) + " end"
    code, _ = _step("v", "g", bound)
    return (
        f"with cells as ({VIEWS[view]}), n as (select field_id, idx, v, {', '.join(cols)} from cells window w as (partition by field_id order by idx)), "
        f"g as (select field_id, v, {picked} as g from n), h as (select field_id, {code} as code, count(*) as freq from g where g is not null group by all)"
    )


for _v in ("part1d", "emb2d", "evt3d"):
    ORACLE[f"interpolation_codes_{_v}"] = finest_codes_sql(_v) + " select field_id, code, freq from h"

_scanned, _kept = _step("c.v", "s.back", "0.01::double")
_first, _first_kept = _step("v", "0.0::double", "0.01::double")
ORACLE |= {
    "text_ratios": text_ratios_sql(["source", "lang"], "text"),
    "interpolation_closed_loop_ratio": finest_codes_sql("emb1d")
    + f", s as (select *, freq / sum(freq) over (partition by field_id)::double as f from h), k as (select *, case when code = 0 then 32 when -log2(f) >= 32 then 0 when -log2(f) >= 1 then -log2(f) when code = {CENTER} then 1 when abs(code - {CENTER}) = 1 then 2.5 else 4 end as bits from s) "
    "select field_id, round(sum(f * bits), 6) as mean_bits, round(32.0 / nullif(sum(f * bits), 0), 6) as ratio from k group by field_id",
    "lorenzo_waves": f"with recursive cells as materialized ({VIEWS['evt1d']}), s as (select field_id, idx, {_first} as code, {_first_kept} as back from cells where idx = 0 "
    f"union all select c.field_id, c.idx, {_scanned}, {_kept} from s join cells c on c.field_id = s.field_id and c.idx = s.idx + 1) select field_id, code, count(*) as freq from s group by all",
    "decoded_lorenzo_histogram": ORACLE["lorenzo_histogram"],
    "least_squares_predictor": _PARTS.split(", m as")[0] + ", f as (select a.fold, regr_slope(b.y, b.x) as slope, regr_intercept(b.y, b.x) as cut from (select distinct fold from p) a join p b on a.fold <> b.fold group by a.fold) "
    "select fold::int as fold, count(*) as n, round(avg(slope * x + cut), 6) as mean_predicted, round(avg(case when y = 0 then 0 else abs(y - slope * x - cut) / abs(y) end), 6) as mean_ape from p join f using (fold) group by fold",
    "accumulated_errors": "with e as (select o_orderpriority as call, case when o_totalprice = 0 then 0 else abs(o_totalprice - avg(o_totalprice) over (partition by o_orderpriority)) / abs(o_totalprice) end as ape from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')), "
    "m as (select call, median(ape) as medape from e group by call), f as (select round(list_sort(list(medape))[1 + floor(count(*) * 0.1)::int], 6) as folds_10ape, round(list_sort(list(medape))[1 + floor(count(*) * 0.9)::int], 6) as folds_90ape, round(median(medape), 6) as folds_median from m), "
    "a as (select round(list_sort(list(ape))[1 + floor(count(*) * 0.1)::int], 6) as overall_10ape, round(list_sort(list(ape))[1 + floor(count(*) * 0.9)::int], 6) as overall_90ape, round(median(ape), 6) as overall_median, count(*) as n from e) select * from f, a",
    "collected_neighbours": f"select * from ({features('emb1d')}) join ({blocks('emb1d')}) using (field_id)",
    "scheme_scores": ORACLE["flagship"],
    "lorenzo_refined_ratio": _CODES.format(b="0.5")
    + ", g as (select field_id, sum(f * bits) as b, coalesce(max(f) filter (code = 0), 0) as fc, coalesce(max(freq) filter (code = 0), 0) as nc, any_value(n) as n from k group by field_id), "
    "p as (select *, (case when nc > n // 2 then fc when fc > 0 then -fc * log2(fc) else 0 end) / nullif(b, 0) as p0 from g), "
    "t as (select field_id, sum((1 - f) * -f * log2(f)) as l, sum(-f * log2(f)) as s from (select *, row_number() over (partition by field_id order by freq desc, code) as r from k) where r <= 5 and code <> 0 group by field_id) "
    "select field_id, round(b, 6) as mean_bits, round(32.0 * greatest(1, 1 / nullif((1 - fc) * p0 + 1 - p0, 0)) / nullif(b, 0), 6) as lossless_ratio, "
    "round(32.0 / nullif(((1 - fc) * p0 + coalesce(l, 0) / b + 1 - p0 - coalesce(s, 0) / b) * b, 0), 6) as refined_ratio from p left join t using (field_id)",
    "usable_fields": f"{_EMB1} select field_id, count(*) as n, round(stddev_samp(v), 6) as sd, 'square' as form from cells group by field_id having count(*) >= 10 and stddev_samp(v) >= 0.01 and max(idx // 8) > min(idx // 8) and max(idx % 8) > min(idx % 8)",
    "column_summary": "select label, p - 1 as column, round(sum(embedding[p]::double), 6) as total, round(avg(embedding[p]::double), 6) as mean, round(stddev_samp(embedding[p]::double), 6) as sd from embeddings, range(1, 65) t(p) group by label, p",
}

#: A closed loop over cells in order, with all that was decoded so far at hand.
_LOOP_2D = f"""with recursive cells as materialized ({VIEWS['emb1d']}), f as materialized (select field_id, list(v order by idx) as v from cells group by field_id),
s as (
  select field_id, v, 0 as n, []::double[] as back, null::bigint as code from f
  union all
  select field_id, v, n + 1, list_append(back, {_step('x', 'g', '0.01::double')[1]}), {_step('x', 'g', '0.01::double')[0]}
  from (select *, v[n + 1] as x, 0.0::double + case when n % 8 > 0 then back[n] else 0.0 end + case when n >= 8 then back[n - 7] else 0.0 end - case when n % 8 > 0 and n >= 8 then back[n - 8] else 0.0 end as g from s where n < len(v))
)"""
_SHARES = f"""h as (select field_id, code, count(*) as freq from c group by all), s2 as (select *, freq / sum(freq) over (partition by field_id)::double as f, sum(freq) over (partition by field_id) as n from h),
k as (select *, case when code = 0 then 32 when -log2(f) >= 32 then 0 when -log2(f) >= 1 then -log2(f) when code = {CENTER} then 1 when abs(code - {CENTER}) = 1 then 2.5 else 4 end as bits from s2),
g as (select field_id, sum(f * bits) as b, coalesce(max(f) filter (code = {CENTER}), 0) as fc, coalesce(max(freq) filter (code = {CENTER}), 0) as nc, any_value(n) as n from k group by field_id),
p as (select *, (case when nc > n // 2 then fc when fc > 0 then -fc * log2(fc) else 0 end) / nullif(b, 0) as p0 from g), r as (select *, greatest(1, 1 / nullif((1 - fc) * p0 + 1 - p0, 0)) as rho from p)
select field_id, round(b, 6) as mean_bits, round(p0, 6) as p0, round(rho, 6) as rho, round(32.0 * rho / nullif(b, 0), 6) as ratio from r"""
ORACLE["lorenzo_closed_loop_2d"] = f"{_LOOP_2D}, c as (select field_id, code from s where n > 0), {_SHARES}"
ORACLE["lorenzo_closed_loop_ratio"] = ORACLE["lorenzo_waves"].replace("select field_id, code, count(*) as freq from s group by all", f", c as (select field_id, code from s where (idx + 1) % 100 = 0), {_SHARES}").replace(") , c as", "), c as")

_DAY = "with t as (select case when hour(ts) < 8 then 'none' when hour(ts) < 16 then 'sampling' else 'tiles' end as method, event_type as codec, avg(value) as mean, stddev_samp(value) as sd from events group by all), b as (select codec, mean as mean_baseline from t where method = 'none')"
for _n in ("search_speedup", "best_codec_speedup", "parallel_writes"):
    ORACLE[f"event_{_n}"] = ORACLE[_n].replace(_TIMES, _DAY)


def _names(keys) -> str:
    return "[" + ", ".join(f"'{k}'" for k in keys) + "]::varchar[]"


_WHEN = ", ".join(f"case when list_has_any(changes, {_names(catalog.MOCK.settings[c])}) then {_names([c])} else [] end" for c in (catalog.RUNTIME, catalog.DEPENDENT, catalog.AGNOSTIC))
#: Orders as change sets: their classes, and each metric's validity.
_LOG = (
    "with m(position, metric, module, usage, causes) as (values " + _values([(i, m.metric, m.module, m.usage, list(m.causes)) for i, m in enumerate(catalog.MOCK.metrics)]) + "), "
    'lg as (select l_orderkey as "case", unnest([case l_returnflag when \'A\' then \'mock_compressor:error_agnostic\' when \'R\' then \'mock_compressor:runtime\' else \'mock_compressor:error_dependent\' end, '
    f"case when l_linestatus = 'F' and l_linenumber = 1 then '{catalog.DATA}' end, case when l_quantity >= 50 then '{catalog.ALL}' end, case when l_linenumber >= 6 then '{catalog.TRAINING}' end]) as key from lineitem), "
    'ch as (select "case", list(distinct key) as changes from lg where key is not null group by 1), '
    f"cl as (select \"case\", list_contains(changes, '{catalog.TRAINING}') as training, case when list_contains(changes, '{catalog.ALL}') then list_sort({_names(catalog.CLASSES)}) "
    f"else list_sort(list_distinct(list_concat({_names([catalog.NONDETERMINISTIC])}, case when list_contains(changes, '{catalog.DATA}') then {_names([catalog.DATA])} else [] end, {_WHEN}, changes))) end as classes from ch), "
    'x as (select "case", position, metric, module, usage, list_has_any(causes, classes) and (usage = \'feature\' or training) as invalid from m, cl)'
)
_TEXTURE_LABEL = f"select field_id, 64.0 / nullif(round(-sum(f * log2(f)), 12), 0) as ratio from (select field_id, c / sum(c) over (partition by field_id)::double as f from (select field_id, floor(v / 0.02::double + 0.5) as q, count(*) as c from ({VIEWS['emb1d']}) group by all)) group by field_id"
_TEXTURE_FEATURES = ("value_range", "mean_value", "mean_neighbor_difference", "mean_lorenzo_difference", "mean_spline_difference", "non_constant_block_percentage")
ORACLE |= {
    "change_log_classes": f"{_LOG} select \"case\", array_to_string(classes, ',') as classes from cl",
    "change_log_matrix": ORACLE["invalidation_matrix"].replace(_MOCK, _LOG),
    "change_log_ids": ORACLE["invalidation_ids"].replace(_MOCK, _LOG),
    "change_log_requirements": ORACLE["run_requirements"].replace(_MOCK, _LOG),
    "change_log_modules": f'{_LOG} select module, count(*) as n_cases, sum(n)::bigint as n_metrics from (select module, "case", count(*) as n from x where invalid group by all) group by module',
    "texture_run": f"select a.*, b.non_constant_block_percentage, round(c.ratio, 6) as ratio from ({features('emb1d')}) a join ({blocks('emb1d')}) b using (field_id) join ({_TEXTURE_LABEL}) c using (field_id)",
    "texture_run_changed_bound": f"select field_id, {', '.join(f'-1.0::double as {f}' for f in _TEXTURE_FEATURES)}, round(ratio, 6) as ratio from ({_TEXTURE_LABEL})",
}
