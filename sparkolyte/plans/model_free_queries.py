"""Queries for normalization, variance, folds and controls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded as r6
from ..operators import diagnostics as G
from ..operators import dose as D
from ..operators import evaluation as E
from ..operators import normalize as Z
from ..sources import adapters as A
from .registry import query

FS = A.FEATURES
KINDS = {f: "additive" if i % 2 else "multiplicative" for i, f in enumerate(FS)}
TRAIN = "timepoint < 4"


def _rounded(df, keys, cols, digits=6):
    return df.select(*keys, *[r6(F.col(c), digits).alias(c) for c in cols])


def _cols(f, join=", "):
    return join.join(f(c) for c in FS)


BASE = f"{A.MATRIX_SQL}, t as (select *, min(timepoint) over (partition by sensor) as t0 from mat), b as (select *, {_cols(lambda c: f'avg(case when timepoint = t0 then {c} end) over (partition by sensor) as d_{c}')} from t)"


@query(f"with {BASE} select vec_id, {_cols(lambda c: f'round({c} - d_{c}, 6) as {c}' if KINDS[c] == 'additive' else f'round({c} / nullif(d_{c}, 0), 4) as {c}')} from b")
def d0_normalize(spark, sf):
    d = Z.d0_normalize(A.matrix(spark, sf), FS, ["sensor"], kinds=KINDS)
    return d.select("vec_id", *[r6(F.col(c), 6 if KINDS[c] == "additive" else 4).alias(c) for c in FS])


@query(f"with {BASE} select vec_id, {_cols(lambda c: f'round({c} - d_{c}, 6) as {c}' if KINDS[c] == 'additive' else f'round(case when {c} > 0 and d_{c} > 0 then ln({c}) - ln(d_{c}) end, 6) as {c}')} from b")
def d0_normalize_log(spark, sf):
    m = A.matrix(spark, sf)
    return _rounded(Z.d0_normalize(m, FS, ["sensor"], log=True, kinds=KINDS), ["vec_id"], FS)


def _stat(sql):
    return f"with {A.MATRIX_SQL}, s as (select {_cols(lambda c: sql.format(c=c))} from mat where timepoint < 4) select vec_id, "


@query(_stat("avg({c}) as m_{c}, stddev_pop({c}) as s_{c}") + _cols(lambda c: f"round(({c} - m_{c}) / s_{c}, 6) as {c}") + " from mat, s")
def zscore_train(spark, sf):
    return _rounded(Z.scale(A.matrix(spark, sf), FS, F.expr(TRAIN), "zscore"), ["vec_id"], FS)


@query(_stat("median({c}) as m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) as s_{c}") + _cols(lambda c: f"round(({c} - m_{c}) / s_{c}, 6) as {c}") + " from mat, s")
def robust_scale(spark, sf):
    return _rounded(Z.scale(A.matrix(spark, sf), FS, F.expr(TRAIN), "robust"), ["vec_id"], FS)


@query(_stat("median({c}) as m_{c}") + _cols(lambda c: f"round(coalesce({c}, m_{c}), 6) as {c}") + " from mat, s")
def median_impute(spark, sf):
    return _rounded(Z.scale(A.matrix(spark, sf), FS, F.expr(TRAIN), "impute"), ["vec_id"], FS)


@query(f"with {A.MATRIX_SQL} select vec_id, {_cols(lambda c: f'round(ln(greatest({c}, 1e-12)), 6) as {c}')} from mat")
def log_representation(spark, sf):
    m = A.matrix(spark, sf)
    return _rounded(Z.to_log(m, FS), ["vec_id"], FS)


@query(f"with {A.MATRIX_LONG_SQL}, u as (select feature, count(value) as n from long group by feature) select feature, n from u where n > 0")
def drop_empty_features(spark, sf):
    long = A.long_matrix(spark, sf)
    return long.groupBy("feature").agg(F.count("value").alias("n")).where("n > 0")


IDS = ["device", "channel", "concentration"]
FIRST = A.OBS_SQL + ", f as (select *, first(response order by timepoint) over () as x from obs where false), g as (select obs.*, first_value(response ignore nulls) over (partition by device, channel, concentration order by timepoint rows between unbounded preceding and unbounded following) as base from obs)"
FIRST = FIRST.replace(", f as (select *, first(response order by timepoint) over () as x from obs where false)", "")
OBSKEY = "device, channel, concentration, timepoint"


@query(f"with {FIRST} select {OBSKEY}, case when abs(base) >= 1e-12 then cast(coalesce(abs(response - base) / abs(base) > 0.5, false) as bigint) end as degraded from g")
def degraded_labels(spark, sf):
    o = A.observations(spark, sf)
    return o.select(*IDS, "timepoint", Z.degraded(o, "response", IDS).alias("degraded"))


@query(f"with {FIRST} select {OBSKEY}, round(case when abs(base) >= 1e-12 then abs(response - base) / abs(base) end, 4) as drift from g")
def drift_magnitude(spark, sf):
    o = A.observations(spark, sf)
    return o.select(*IDS, "timepoint", r6(Z.drift_magnitude(o, "response", IDS), 4).alias("drift"))


def _rank(c):
    return f"rank() over (partition by {', '.join(IDS)} order by {c}) + (count(*) over (partition by {', '.join(IDS)}, {c}) - 1) / 2.0::double"


CORR = "case when count(*) >= {n} and stddev_pop({x}) > 1e-12 and stddev_pop({y}) > 1e-12 then covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) end"


@query(
    f"""with {A.OBS_SQL}, k as (select *, {_rank('timepoint')} as x, {_rank('response')} as y from obs),
  s as (select {', '.join(IDS)}, count(distinct timepoint) as n_times, {CORR.format(n=3, x='x', y='y')} as r from k group by all)
select {', '.join(IDS)}, n_times, round(r, 6) as spearman from s where n_times >= 4 and abs(r) >= 0.6 - 1e-9"""
)
def clean_trend_channels(spark, sf):
    c = G.clean_trend_channels(A.observations(spark, sf), "response", IDS, least_r=0.6 - 1e-9)
    return c.select(*IDS, "n_times", r6(F.col("spearman")).alias("spearman"))


TARGETS = {"slope": True, "intercept": False, "r_squared": False}


@query(
    f"""with {A.OBS_SQL}, s as (select device, channel, timepoint, regr_slope(response, log10(concentration)) as slope, regr_intercept(response, log10(concentration)) as intercept, {CORR.format(n=3, x='log10(concentration)', y='response')} as r from obs group by all having count(distinct concentration) >= 3),
  l as (select 'slope' as target, true as invertible, slope as v, r from s union all select 'intercept', false, intercept, r from s union all select 'r_squared', false, r * r, r from s)
select target, invertible, round(avg(case when v is not null then 1.0::double else 0 end), 6) as identifiable, round(stddev_pop(v), 4) as sd, round(stddev_pop(v) / avg(abs(v)), 5) as cv, round(median(case when v is not null then r end), 6) as median_r,
  avg(case when v is not null then 1.0::double else 0 end) >= 0.7 and invertible and stddev_pop(v) / avg(abs(v)) >= 0.15 as admissible from l group by target, invertible"""
)
def target_admissibility(spark, sf):
    s = D.sensitivity(A.observations(spark, sf)).withColumn("r_squared", F.col("dose_response_r") * F.col("dose_response_r"))
    t = G.target_admissibility(s, TARGETS, "dose_response_r")
    return t.select("target", "invertible", r6(F.col("identifiable")).alias("identifiable"), r6(F.col("sd"), 4).alias("sd"), r6(F.col("cv"), 5).alias("cv"), r6(F.col("median_r")).alias("median_r"), "admissible")


FOLDS = A.OBS_SQL + """, tt as (select timepoint, dense_rank() over (order by timepoint) - 1 as k from (select distinct timepoint from obs)),
  folds as (select distinct channel, timepoint as t_test from obs join tt using (timepoint) where k >= 3)"""


@query(f"with {FOLDS} select folds.channel, t_test, count(*) as n_train, round(avg(response), 6) as train_mean from folds join obs on obs.timepoint < t_test group by folds.channel, t_test")
def forward_folds(spark, sf):
    o = A.observations(spark, sf)
    f = E.fold_sizes(o, E.forward_folds(o), "response")
    return f.select("channel", "t_test", "n_train", r6(F.col("train_mean")).alias("train_mean"))


@query(f"with {FOLDS} select folds.channel, t_test, count(*) as n_train, round(avg(response), 6) as train_mean from folds join obs on obs.timepoint < t_test and obs.channel != folds.channel group by folds.channel, t_test")
def loco_folds(spark, sf):
    o = A.observations(spark, sf)
    f = E.fold_sizes(o, E.forward_folds(o), "response", leave_channel_out=True)
    return f.select("channel", "t_test", "n_train", r6(F.col("train_mean")).alias("train_mean"))


@query(f"with {FOLDS} select channel, t_test, (select max(timepoint) from tt where timepoint < t_test) as t_val, (select count(*) from tt where timepoint < t_test) >= 2 as has_inner from folds")
def inner_split(spark, sf):
    o = A.observations(spark, sf)
    return E.inner_validation_time(o, E.forward_folds(o)).select("channel", "t_test", "t_val", "has_inner")


PRED = FOLDS + """, tm as (select t_test, avg(response) as train_mean, avg(case when concentration >= 500 then response end) as high, avg(case when concentration < 500 then response end) as low
    from (select distinct t_test from folds) join obs on timepoint < t_test group by t_test),
  pred as (select o.channel, o.timepoint as t_test, o.concentration, response as y, train_mean, case when concentration >= 500 then high else low end as pred
    from obs o join folds f on o.channel = f.channel and o.timepoint = f.t_test join tm on tm.t_test = o.timepoint),
  res as (select channel, t_test, sum((y - pred) ** 2) as sse, count(*) as n_test, sum((y - train_mean) ** 2) as tss from pred group by all)"""
POOLED = "count(*) as n_folds, cast(sum(n_test) as bigint) as n_test, round(sqrt(sum(sse) / sum(n_test)), 5) as rmsep, round(avg(sqrt(sse / n_test)), 5) as macro_rmsep, round(1 - sum(sse) / sum(tss), 5) as q2"


def _predictions(spark, sf):
    """A two-level dose predictor fitted on earlier times."""
    o = A.observations(spark, sf)
    high = F.col("concentration") >= 500
    cell = o.groupBy("timepoint").agg(*[F.sum(F.when(c, F.col("response"))).alias(f"s{k}") for k, c in (("h", high), ("l", ~high))], *[F.count(F.when(c, F.col("response"))).alias(f"n{k}") for k, c in (("h", high), ("l", ~high))])
    from pyspark.sql import Window as W

    w = W.orderBy("timepoint").rowsBetween(W.unboundedPreceding, -1)
    run = {c: F.sum(c).over(w) for c in ("sh", "sl", "nh", "nl")}
    stats = cell.select(
        "timepoint",
        F.try_divide(run["sh"] + run["sl"], run["nh"] + run["nl"]).alias("train_mean"),
        F.try_divide(run["sh"], run["nh"]).alias("high"),
        F.try_divide(run["sl"], run["nl"]).alias("low"),
    )
    folds = E.forward_folds(o).withColumnRenamed("t_test", "timepoint")
    d = o.join(folds, ["channel", "timepoint"], "left_semi").join(stats, "timepoint")
    return d.select("channel", F.col("timepoint").alias("t_test"), "concentration", F.col("response").alias("y"), "train_mean", F.when(high, F.col("high")).otherwise(F.col("low")).alias("pred"))


def _results(spark, sf):
    return E.fold_results(_predictions(spark, sf), ["channel", "t_test"])


@query(f"with {PRED} select {POOLED} from res")
def pooled_metrics(spark, sf):
    p = E.pooled(_results(spark, sf))
    return p.select("n_folds", "n_test", *[r6(F.col(c), 5).alias(c) for c in ("rmsep", "macro_rmsep", "q2")])


@query(f"with {PRED} select round(stddev_samp(sqrt(sse / n_test)), 5) as fold_sd, round(quantile_cont(sqrt(sse / n_test), 0.75) - quantile_cont(sqrt(sse / n_test), 0.25), 5) as fold_iqr from res")
def fold_spread(spark, sf):
    return _rounded(E.pooled(_results(spark, sf)), [], ["fold_sd", "fold_iqr"], 5)


@query(f"with {PRED} select channel, {POOLED} from res group by channel")
def per_channel_metrics(spark, sf):
    p = E.pooled(_results(spark, sf), ["channel"])
    return p.select("channel", "n_folds", "n_test", *[r6(F.col(c), 5).alias(c) for c in ("rmsep", "macro_rmsep", "q2")])


@query()
def bootstrap_ci(spark, sf):
    return E.bootstrap_ci(_results(spark, sf))


@query(f"with {PRED} select concentration, count(*) as n, round(avg(pred), 5) as mean_pred, round(stddev_samp(pred), 5) as sd_pred, round(sqrt(avg((y - pred) ** 2)), 5) as rmse from pred group by concentration")
def calibration_slices(spark, sf):
    return _rounded(E.calibration_slices(_predictions(spark, sf), "concentration"), ["concentration", "n"], ["mean_pred", "sd_pred", "rmse"], 5)


SEN = A.OBS_SQL + ", sen as (select channel, timepoint, avg(response) as y from obs group by all)"


def _sensors(spark, sf):
    return A.observations(spark, sf).groupBy("channel", "timepoint").agg(F.avg("response").alias("value"))


@query(
    f"""with {SEN}, aged as (select *, (timepoint - min(timepoint) over (partition by channel))::double as age from sen),
  fit as (select t.timepoint, count(*) as n, avg(s.y) as m, regr_slope(s.y, s.age) as b, avg(s.age) as a from (select distinct timepoint from aged) t join aged s on s.timepoint < t.timepoint group by t.timepoint)
select channel, timepoint, round(m, 5) as train_mean, round(m + case when isfinite(b) then b else 0 end * (age - a), 5) as pred from aged join fit using (timepoint) where n >= 8"""
)
def time_only_baseline(spark, sf):
    return _rounded(E.time_only(_sensors(spark, sf), "value", ["channel"]), ["channel", "timepoint"], ["train_mean", "pred"], 5)


CTRL = SEN + """, al as (select t.timepoint, count(*) as all_n, avg(s.y) as all_mean from (select distinct timepoint from sen) t join sen s on s.timepoint < t.timepoint group by t.timepoint),
  own as (select t.channel, t.timepoint, count(s.y) as n, avg(s.y) as m, regr_slope(s.y, s.timepoint::double) as b, avg(s.timepoint) as a from sen t left join sen s on s.channel = t.channel and s.timepoint < t.timepoint group by all),
  ctl as (select sen.channel, sen.timepoint, sen.y, all_mean, n / (n + 1.0::double) as w, m, b, a, all_mean + n / (n + 1.0::double) * coalesce(m - all_mean, 0) as mean_pred from sen join al using (timepoint) join own on own.channel = sen.channel and own.timepoint = sen.timepoint where all_n >= 8)"""


@query(f"with {CTRL} select channel, timepoint, round(mean_pred, 5) as mean_pred from ctl")
def channel_mean_control(spark, sf):
    return _rounded(E.channel_controls(_sensors(spark, sf), "value", ["channel"]), ["channel", "timepoint"], ["mean_pred"], 5)


@query(f"with {CTRL} select channel, timepoint, round(mean_pred + w * case when isfinite(b) then b * (timepoint - a) else 0 end, 4) as trend_pred from ctl")
def channel_trend_control(spark, sf):
    return _rounded(E.channel_controls(_sensors(spark, sf), "value", ["channel"]), ["channel", "timepoint"], ["trend_pred"], 4)


@query(
    f"""with {CTRL}, r as (select y > 100 as pos, rank() over (order by round(mean_pred, 6)) + (count(*) over (partition by round(mean_pred, 6)) - 1) / 2.0::double as rk from ctl),
  s as (select count(*) filter (where pos) as p, count(*) filter (where not pos) as n, sum(case when pos then rk end) as r from r) select p as n_pos, n as n_neg, round((r - p * (p + 1) / 2.0::double) / nullif(p * n, 0), 6) as auc from s"""
)
def persistence_auc(spark, sf):
    c = E.channel_controls(_sensors(spark, sf), "value", ["channel"]).withColumn("s", F.round("mean_pred", 6))
    return E.auc(c, F.col("y") > 100, "s").select("n_pos", "n_neg", r6(F.col("auc")).alias("auc"))


VH = """c as (select feature, sensor, timepoint, count(value) as n, sum(value) as s, sum(value * value) as q from {src} where value is not null group by all),
  m as (select feature, sensor, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as c from c group by all), t as (select feature, sum(n) as n, sum(s) as s, sum(q) as q, sum(c) as c, sum(s * s / n) as b from m group by feature)"""


@query(f"with {A.MATRIX_LONG_SQL}, {VH.format(src='long')} select feature, round(greatest(b - s*s/n, 0) / (q - s*s/n), 6) as between_channel, round(greatest(c - b, 0) / (q - s*s/n), 6) as within_time, round(greatest(q - c, 0) / (q - s*s/n), 6) as residual, cast(n as bigint) as n_rows from t")
def variance_hierarchy(spark, sf):
    v = G.variance_hierarchy(A.long_matrix(spark, sf))
    return v.select("feature", *[r6(F.col(c)).alias(c) for c in ("between_channel", "within_time", "residual")], "n_rows")


@query(
    f"with {A.MATRIX_LONG_SQL}, {VH.format(src='long')}, v as (select greatest(c - b, 0) / (q - s*s/n) as x from t) select 'within_time' as component, count(x) as n, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_pop(x), 6) as std, round(min(x), 6) as min, round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.75), 6) as q75, round(max(x), 6) as max from v"
)
def component_summary(spark, sf):
    s = G.component_summary(G.variance_hierarchy(A.long_matrix(spark, sf)), ["within_time"])
    return _rounded(s, ["component", "n"], ["mean", "median", "std", "min", "q25", "q75", "max"])


@query(f"with {A.MATRIX_LONG_SQL}, {VH.format(src='long')} select feature from t where greatest(c - b, 0) / (q - s*s/n) >= 0.11")
def icc_select(spark, sf):
    return Z.within_temporal_share(A.long_matrix(spark, sf)).where("temporal_fraction >= 0.11").select("feature")


REL = A.REPS_SQL + """, o as (select device, channel, timepoint, concentration, count(value) as n, avg(value) as m, var_pop(value) * count(value) as ss from reps group by all),
 g as (select sum(case when n >= 2 then ss end) / nullif(sum(case when n >= 2 then n - 1 end), 0) as sm, var_samp(m) as so, avg(n) as k, count(*) as n_obs from o)"""


@query(f"with {REL} select round(sm, 3) as sigma2_meas, round(so, 3) as sigma2_obs, round(k, 6) as n_rep, n_obs, round(greatest(0, so - sm / k) / (greatest(0, so - sm / k) + sm), 6) as R from g")
def measurement_reliability(spark, sf):
    g = G.measurement_reliability(A.replicates(spark, sf), ["device", "channel", "timepoint", "concentration"])
    return g.select(r6(F.col("sigma2_meas"), 3).alias("sigma2_meas"), r6(F.col("sigma2_obs"), 3).alias("sigma2_obs"), r6(F.col("n_rep")).alias("n_rep"), "n_obs", r6(F.col("R")).alias("R"))


@query(
    f"""with {A.MATRIX_LONG_SQL}, me as (select feature, sensor, timepoint, avg(value) as m, count(value) as n, var_pop(value) * count(value) as ss from long where value is not null group by all),
  dr as (select feature, sum(v) / sum(k) as d from (select feature, sensor, count(*) as k, var_pop(m) * count(*) as v from me group by all) group by feature),
  no as (select feature, sum(case when n >= 2 then ss end) / nullif(sum(case when n >= 2 then n - 1 end), 0) as s from me group by feature)
select feature, round(d, 8) as sigma2_drift, round(d / s, 6) as snr, round(d / (d + s), 6) as R_drift from dr join no using (feature)"""
)
def drift_reliability(spark, sf):
    long = A.long_matrix(spark, sf)
    noise = G.measurement_reliability(long, ["sensor", "timepoint"], by=["feature"])
    d = G.drift_reliability(long, noise)
    return d.select("feature", r6(F.col("sigma2_drift"), 8).alias("sigma2_drift"), r6(F.col("snr")).alias("snr"), r6(F.col("R_drift")).alias("R_drift"))


ALIGN = A.MATRIX_LONG_SQL + ", al as (select feature, sensor, timepoint, vec_id % 2 as concentration, value, y as response from long where value is not null)"


@query(
    f"""with {ALIGN}, me as (select feature, sensor, concentration, timepoint, avg(value) as x, avg(response) as y from al group by all),
  g as (select feature, sensor, concentration, {CORR.format(n=3, x='x', y='y')} as r from me group by all)
select feature, round(tanh(avg(atanh(greatest(-0.999, least(0.999, r))))), 5) as alignment, count(r) as n_groups from g group by feature"""
)
def drift_alignment(spark, sf):
    long = A.long_matrix(spark, sf).withColumn("concentration", F.col("vec_id") % 2).withColumnRenamed("y", "response")
    return G.drift_alignment(long).select("feature", r6(F.col("alignment"), 5).alias("alignment"), "n_groups")


@query(f"with {ALIGN}, g as (select feature, concentration, {CORR.format(n=5, x='value', y='response')} as r from al group by all) select feature, round(tanh(avg(atanh(greatest(-0.999, least(0.999, r))))), 5) as alignment, count(r) as n_groups from g group by feature")
def absolute_alignment(spark, sf):
    long = A.long_matrix(spark, sf).withColumn("concentration", F.col("vec_id") % 2).withColumnRenamed("y", "response")
    return G.absolute_alignment(long).select("feature", r6(F.col("alignment"), 5).alias("alignment"), "n_groups")
