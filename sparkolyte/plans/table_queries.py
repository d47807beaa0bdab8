"""Queries for review tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded as r6
from ..operators import diagnostics as G
from ..operators import discovery as R
from ..operators import dose as D
from ..operators import evaluation as E
from ..operators import normalize as Z
from ..sources import adapters as A
from . import catalog
from . import model_free_queries as B
from . import tables as T
from .dose_queries import CORR, RANK
from .registry import query

K3 = ["device", "channel", "timepoint"]
SHARES = f"{A.MATRIX_LONG_SQL}, {B.VH.format(src='long')}, v as (select feature, greatest(b - s*s/n, 0) / (q - s*s/n) as between_channel, greatest(c - b, 0) / (q - s*s/n) as within_time, greatest(q - c, 0) / (q - s*s/n) as residual from t)"


def _shares(spark, sf):
    return G.variance_hierarchy(A.long_matrix(spark, sf))


@query(f"with {SHARES} select 'f' as type, count(*) as n_features, round(avg(within_time), 6) as within_time, round(avg(between_channel), 6) as between_channel from v")
def variance_by_type(spark, sf):
    named = _shares(spark, sf).withColumn("feature", F.regexp_replace("feature", r"^f(\d+)$", "f_f$1"))
    t = G.by_type(named, ["within_time", "between_channel"])
    return t.select("type", "n_features", r6(F.col("within_time")).alias("within_time"), r6(F.col("between_channel")).alias("between_channel"))


@query(f"with {SHARES} select feature, round(within_time, 6) as within_time from v order by abs(within_time) desc, feature limit 3")
def strongest_features(spark, sf):
    return G.strongest(_shares(spark, sf), "within_time", 3).select("feature", r6(F.col("within_time")).alias("within_time"))


RATIO = "round(greatest(sum(s * s / n) - sum(s) * sum(s) / sum(n), 0) / (sum(q) - sum(s) * sum(s) / sum(n)), 6)"
CELLS = "select feature, sensor, count(x) as n, sum(x) as s, sum(x * x) as q from ({rows}) where x is not null group by feature, sensor"
LONG = f"unpivot include nulls (x for feature in ({', '.join(A.FEATURES)}))"
RAW = f"select sensor, feature, x from (select sensor, {', '.join(A.FEATURES)} from b) {LONG}"
SHIFTED = f"select sensor, feature, x from (select sensor, {', '.join(f'{c} - d_{c} as {c}' for c in A.FEATURES)} from b) {LONG}"


@query(
    f"""with {B.BASE}, u as ({CELLS.format(rows=RAW)}), w as ({CELLS.format(rows=SHIFTED)}),
  x as (select feature, {RATIO} as before from u group by feature), y as (select feature, {RATIO} as after from w group by feature)
select feature, before, after from x join y using (feature)"""
)
def d0_effect(spark, sf):
    m = A.matrix(spark, sf)
    kinds = dict.fromkeys(A.FEATURES, "additive")
    after = Z.d0_normalize(m, A.FEATURES, ["sensor"], kinds=kinds).unpivot(["vec_id", "sensor", "timepoint", "y"], A.FEATURES, "feature", "value")
    d = G.before_and_after(_shares(spark, sf), G.variance_hierarchy(after), "between_channel")
    return d.select("feature", r6(F.col("before")).alias("before"), r6(F.col("after")).alias("after"))


PEARSON = CORR.format(x="log10(concentration)", y="response")


@query(
    f"""with {A.OBS_SQL}, k as (select *, {RANK.format(c='concentration')} as x, {RANK.format(c='response')} as y from obs),
  g as (select device, channel, timepoint, case when count(distinct concentration) >= 3 then {PEARSON} end as p, case when count(distinct concentration) >= 3 then {CORR.format(x='x', y='y')} end as s from k group by all)
select coalesce(p >= 0.55, false) as pearson_ok, coalesce(s >= 0.55, false) as spearman_ok, count(*) as n from g group by all"""
)
def spearman_rescue(spark, sf):
    o = A.observations(spark, sf)
    return G.rescued(D.dose_response(o), D.dose_response(o, method="spearman"), K3, 0.55)


@query(
    f"""with {B.PRED}, w as (select *, y > 100 as drifted from pred), s as (select 'all' as stratum, * from w union all select case when drifted then 'has_drifted' else 'still_flat' end, * from w)
select stratum, count(*) as n, round(1 - sum((y - pred) ** 2) / sum((y - train_mean) ** 2), 5) as q2, round(sqrt(avg((y - pred) ** 2)), 5) as rmsep, round(stddev_pop(y), 5) as target_std from s group by stratum"""
)
def stratify_by_drift(spark, sf):
    s = E.stratify_by_drift(B._predictions(spark, sf), F.col("y") > 100)
    return s.select("stratum", "n", *[r6(F.col(c), 5).alias(c) for c in ("q2", "rmsep", "target_std")])


@query("select p_brand as condition, round(avg(p_retailprice), 5) as rmsep, max(case when p_size = m then n end) as n_folds from (select *, p_partkey % 100 as n, min(p_size) over (partition by p_brand) as m from part) group by p_brand")
def seed_means(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_brand").alias("condition"), F.col("p_size").alias("seed"), F.col("p_retailprice").alias("rmsep"), (F.col("p_partkey") % 100).alias("n_folds"))
    m = E.mean_over_seeds(p, ["condition"])
    return m.select("condition", r6(F.col("rmsep"), 5).alias("rmsep"), "n_folds")


@query(
    f"""with {B.ALIGN}, me as (select feature, sensor, concentration, timepoint, avg(value) as x, avg(response) as y from al group by all),
  g as (select feature, {B.CORR.format(n=3, x='x', y='y')} as r from me group by feature, sensor, concentration), a as (select feature, tanh(avg(atanh(greatest(-0.999, least(0.999, r))))) as v from g group by feature),
  h as (select feature, {B.CORR.format(n=5, x='value', y='response')} as r from al group by feature, concentration), b as (select feature, tanh(avg(atanh(greatest(-0.999, least(0.999, r))))) as v from h group by feature),
  m as (select (select max(abs(v)) from a) as d, (select max(abs(v)) from b) as e)
select round(d, 5) as max_drift, round(e, 5) as max_absolute, case when d - e > 0.1 then 'drift' when d - e < -0.1 then 'absolute' else 'undecided' end as verdict from m"""
)
def alignment_verdict(spark, sf):
    long = A.long_matrix(spark, sf).withColumn("concentration", F.col("vec_id") % 2).withColumnRenamed("y", "response")
    v = G.alignment_verdict(G.drift_alignment(long), G.absolute_alignment(long))
    return v.select(r6(F.col("max_drift"), 5).alias("max_drift"), r6(F.col("max_absolute"), 5).alias("max_absolute"), "verdict")


@query("select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(h, 'Channel\\s+(\\d+)', 1))), ',') as channels from (select event_id, 'Fast Cyclic Channel ' || (event_id % 3) || ',,Channel  ' || (user_id % 5) || ',,Channel ' || (event_id % 3) as h from events)")
def header_channels(spark, sf):
    h = F.concat(F.lit("Fast Cyclic Channel "), (F.col("event_id") % 3).cast("string"), F.lit(",,Channel  "), (F.col("user_id") % 5).cast("string"), F.lit(",,Channel "), (F.col("event_id") % 3).cast("string"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit(r"Channel\s+(\d+)"), F.lit(1))))
    return A.table(spark, sf, "events").select("event_id", F.array_join(found, ",").alias("channels"))


@query()
def dose_framings(spark, sf):
    """Predictors of a sensor and time are its replicate statistics."""
    o = A.observations(spark, sf)
    p = o.groupBy(*K3).agg(F.avg("n_rep").alias("reps"), F.stddev_pop("response").alias("spread"), F.max("response").alias("top"))
    return R.target_framings(o.join(p, K3), ["reps", "spread", "top"], K3)


@query()
def dose_curve_model(spark, sf):
    o = A.observations(spark, sf)
    wide = D.dose_curve(o, [100.0, 500.0, 5000.0])
    p = o.groupBy(*K3).agg(F.avg("n_rep").alias("reps"), F.stddev_pop("response").alias("spread"))
    return R.dose_curve_cv(wide.join(p, K3), ["reps", "spread"], ["dose_100", "dose_500", "dose_5000"], "channel", "timepoint")


@query()
def domain_monitor(spark, sf):
    m = A.matrix(spark, sf)
    model = R.freeze(m.where("timepoint < 3"), A.FEATURES, "y", R.Condition("frozen"), 3)
    return R.monitor(model, m.where("timepoint >= 3").drop("y"), m.where("timepoint < 3"))


@query(
    f"""with {A.OBS_SQL}, w as (select device, channel, timepoint, concentration, response, min(timepoint) over (partition by device, channel) as t0,
   lag(response) over (partition by device, channel, concentration order by timepoint) as lag1 from obs)
select device, channel, timepoint, concentration, timepoint - t0 as time_since_baseline, round(lag1, 6) as response__lag1, round(response - lag1, 6) as response__delta from w"""
)
def sensor_history(spark, sf):
    d = catalog.with_history(A.observations(spark, sf), ["response"], ["device", "channel"])
    names = ("response__lag1", "response__delta")
    return d.select("device", "channel", "timepoint", "concentration", "time_since_baseline", *[r6(F.col(c)).alias(c) for c in names])


@query(
    f"""with {A.MATRIX_LONG_SQL}, e as (select feature, min(value) as lo, max(value) as hi from long group by feature)
select feature, cast(least(floor((value - lo) / (hi - lo) * 12), 11) as bigint) as bin, count(*) as count from long join e using (feature) where value is not null group by all"""
)
def feature_histograms(spark, sf):
    long = A.long_matrix(spark, sf).where("value is not null").select("feature", "value")
    return T.histograms(long, 12, ("feature",))


@query(
    f"""with {A.OBS_SQL}, p as (select device, channel, timepoint, concentration, 0.4::double + abs(sin(response)) * 0.6::double as v_peak from obs)
select concentration, count(*) as n, count(*) filter (where v_peak <= 0.43) as n_lower, count(*) filter (where v_peak >= 0.97) as n_upper,
  count(*) filter (where v_peak <= 0.43 or v_peak >= 0.97) as n_any, round(100.0::double * count(*) filter (where v_peak <= 0.43 or v_peak >= 0.97) / count(*), 1) as any_pct from p group by concentration"""
)
def edge_pinning(spark, sf):
    o = A.observations(spark, sf).withColumn("v_peak", 0.4 + F.abs(F.sin("response")) * 0.6)
    return T.edge_pinning(o).select("concentration", "n", "n_lower", "n_upper", "n_any", "any_pct")


@query(
    f"""with {A.OBS_SQL}, r as (select device || ':' || channel as sensor, timepoint, response as value from obs),
 cell as (select sensor, timepoint, count(*) as n, sum(value) as s, sum(value * value) as q from r group by all),
 mid as (select sensor, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as c from cell group by sensor),
 t as (select sum(n) as n, sum(s) as s, sum(q) as q, sum(c) as c, sum(s * s / n) as b from mid)
select 'NormIpeak' as response, 'dose' as level, round((b - s * s / n) / (q - s * s / n), 6) as between_channel, round((c - b) / (q - s * s / n), 6) as within_time, round((q - c) / (q - s * s / n), 6) as within_dose from t"""
)
def response_modes(spark, sf):
    d = T.response_modes(A.observations(spark, sf).withColumnRenamed("response", "NormIpeak")).where("level = 'dose'")
    return d.select("response", "level", *[r6(F.col(c)).alias(c) for c in ("between_channel", "within_time", "within_dose")])
