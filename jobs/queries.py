"""The jobs as registered queries, and SQL for what they write.

Each query runs its job twice into one new folder below spark.checkpoint.dir and returns what is there then.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.oracle import VIEWS, text_ratios_sql
from cellgauge.queries import r6
from cellgauge.sources.shared import new_folder

from . import scheme_benchmark, text_compressibility


def _config(job) -> dict:
    return json.loads(Path(job.__file__).with_suffix(".json").read_text(encoding="utf-8"))


def job1_scheme_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field's features, ratio and predictions at every bound, with the scores of its fold and of all folds."""
    out, config = new_folder(spark, "scheme_benchmark"), _config(scheme_benchmark)
    for _ in range(2):
        scheme_benchmark.run(spark, sf_dir, out, config)
    seen, made, scores = (scheme_benchmark.read(spark, out, n) for n in ("observations", "predictions", "scores"))
    key = ["view", "bound", "scheme"]
    each = scores.where("fold >= 0").select(*key, "fold", "n", "medape", "p10", "p90")
    every = scores.where("fold < 0").select(*key, F.col("n").alias("all_n"), F.col("medape").alias("all_medape"), F.col("p10").alias("all_p10"), F.col("p90").alias("all_p90"))
    rows = made.join(seen.select("view", "bound", "field_id", "entropy_ratio", "range_bits", "step_bits"), ["view", "bound", "field_id"])
    return r6(rows.join(each, [*key, "fold"], "left").join(every, key, "left"))


def _job1_sql() -> str:
    config = _config(scheme_benchmark)
    cells = " union all ".join(f"select '{v}' as view, * from ({VIEWS[v]})" for v in config["views"])
    bounds = ", ".join(f"({float(b)!r}::double)" for b in config["bounds"])

    def predicted(how: dict) -> str:
        first = how["features"][0]
        if how["predictor"] == "noop":
            return f"select view, bound, field_id, {first} as predicted from obs"
        whole = " and ".join(f"b.{c} is not null" for c in [*how["features"], "actual"])
        other = f"select a.*, b.fold as fold_b, {{}} from obs a left join obs b on a.view = b.view and a.bound = b.bound and a.fold <> b.fold and {whole}"
        if how["predictor"] == "offset":
            return f"select view, bound, field_id, {first} + max(d) as predicted from ({other.format(f'b.actual - b.{first} as d')}) group by view, bound, field_id, {first}"
        x = how["features"]
        if len(x) == 1:
            fit = "regr_slope(y, x1) as s1, regr_intercept(y, x1) as c"
            picked = other.format(f"b.{x[0]} as x1, b.actual as y")
            return f"select view, bound, field_id, {x[0]} * s1 + c as predicted from (select view, bound, field_id, {x[0]}, {fit} from ({picked}) group by view, bound, field_id, {x[0]})"
        # Two features: Cramer's rule on the co-moments.
        picked = other.format(f"b.{x[0]} as x1, b.{x[1]} as x2, b.actual as y")
        moments = "covar_pop(x1, x1) as a, covar_pop(x1, x2) as b, covar_pop(x2, x2) as d, covar_pop(x1, y) as e, covar_pop(x2, y) as f, avg(x1) as m1, avg(x2) as m2, avg(y) as m"
        inner = f"select view, bound, field_id, {x[0]}, {x[1]}, {moments} from ({picked}) group by view, bound, field_id, {x[0]}, {x[1]}"
        return f"select view, bound, field_id, m + ({x[0]} - m1) * (e * d - b * f) / (a * d - b * b) + ({x[1]} - m2) * (a * f - b * e) / (a * d - b * b) as predicted from ({inner})"

    made = " union all ".join(f"select '{s}' as scheme, * from ({predicted(how)})" for s, how in sorted(config["schemes"].items()))
    return f"""
with cells as ({cells}), bounds(bound) as (values {bounds}), q as (
  select view, bound, field_id, idx, v, floor(v / (2 * bound) + 0.5)::bigint as q from cells, bounds
), d as (
  select *, q - coalesce(lag(q) over (partition by view, bound, field_id order by idx), 0) as r from q
), hq as (
  select view, bound, field_id, count(*) as c from d group by view, bound, field_id, q
), hr as (
  select view, bound, field_id, count(*) as c from d group by view, bound, field_id, r
), eq as (
  select view, bound, field_id, -sum(f * log2(f)) as e from (select *, c / sum(c) over (partition by view, bound, field_id)::double as f from hq) group by all
), er as (
  select view, bound, field_id, -sum(f * log2(f)) as e from (select *, c / sum(c) over (partition by view, bound, field_id)::double as f from hr) group by all
), s as (
  select view, bound, field_id, log2((max(v) - min(v)) / (2 * bound) + 1) as range_bits, log2(avg(abs(r)) + 1) as step_bits from d group by view, bound, field_id
), obs as materialized (
  select view, bound, field_id, (('0x' || substr(md5(field_id), 1, 8))::bigint % {config['folds']})::int as fold, 64.0 / nullif(round(eq.e, 12), 0) as entropy_ratio, range_bits, step_bits, 64.0 / nullif(round(er.e, 12), 0) as actual
  from s join eq using (view, bound, field_id) join er using (view, bound, field_id)
), made as materialized (
  select m.scheme, o.view, o.bound, o.field_id, o.fold, o.entropy_ratio, o.range_bits, o.step_bits, o.actual, m.predicted,
         case when m.predicted is null or o.actual is null then null when o.actual = 0 then 0 else abs(o.actual - m.predicted) / abs(o.actual) end as ape
  from obs o join ({made}) m using (view, bound, field_id)
), each as (
  select view, bound, scheme, fold, count(*) as n, median(ape) as medape, list_sort(list(ape))[1 + floor(count(*) * 0.1)::int] as p10, list_sort(list(ape))[1 + floor(count(*) * 0.9)::int] as p90
  from made where ape is not null group by view, bound, scheme, fold
), every as (
  select view, bound, scheme, count(*) as all_n, median(ape) as all_medape, list_sort(list(ape))[1 + floor(count(*) * 0.1)::int] as all_p10, list_sort(list(ape))[1 + floor(count(*) * 0.9)::int] as all_p90
  from made where ape is not null group by view, bound, scheme
)
select view, bound, scheme, field_id, fold, round(entropy_ratio, 6) as entropy_ratio, round(range_bits, 6) as range_bits, round(step_bits, 6) as step_bits, round(actual, 6) as actual,
       round(predicted, 6) as predicted, round(ape, 6) as ape, n, round(medape, 6) as medape, round(p10, 6) as p10, round(p90, 6) as p90,
       all_n, round(all_medape, 6) as all_medape, round(all_p10, 6) as all_p10, round(all_p90, 6) as all_p90
from made left join each using (view, bound, scheme, fold) left join every using (view, bound, scheme)
"""


def job2_text_compressibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the documents of each source and language would compress; the second run finds no new files."""
    out, config = new_folder(spark, "text_compressibility"), _config(text_compressibility)
    # The table may be a single file, which a file stream takes by a pattern only.
    for _ in range(2):
        text_compressibility.run(spark, f"{sf_dir}/documents.parque[t]", out, config)
    kinds = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes)
    return r6(text_compressibility.report(spark, out, kinds, config["by"]))


QUERIES = {"job1_scheme_benchmark": job1_scheme_benchmark, "job2_text_compressibility": job2_text_compressibility}
ORACLE = {"job1_scheme_benchmark": _job1_sql(), "job2_text_compressibility": text_ratios_sql(_config(text_compressibility)["by"], _config(text_compressibility)["text"])}
