"""Queries over dose-response observations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.stats import rounded as r6
from ..operators import dose as D
from ..sources import adapters as A
from .registry import query

K = "device, channel, timepoint"
KEYS = ["device", "channel", "timepoint"]
CORR = "case when count(*) >= 3 and stddev_pop({x}) > 1e-12 and stddev_pop({y}) > 1e-12 then covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) end"


def _corr(x, y):
    return CORR.format(x=x, y=y)


@query(f"with {A.EVENTS_SQL} select distinct device, cast(date as varchar) as date, cast(d0 as varchar) as d0, timepoint from ev")
def session_origin_timepoint(spark, sf):
    e = A.events(spark, sf)
    return e.select("device", F.col("date").cast("string").alias("date"), F.col("d0").cast("string").alias("d0"), "timepoint").distinct()


FILES = """files as (
  select event_id, strftime(ts, '%Y%m%d') || '_' || case event_id % 3 when 0 then 'ca_v2' when 1 then 'cb' else 'cc' end || '_'
      || case event_id % 2 when 0 then 'Signal' else 'channeltest' end as folder,
    user_id || '_x_' || case event_id % 4 when 0 then 'EIS' when 1 then 'fscv' when 2 then 'paired' else 'misc' end || '_'
      || case when event_id % 5 = 0 then 'baseline' when event_id % 5 = 1 then 'Live' else (event_id % 7 * 50) || ' nM' end || '.csv' as name
  from events)"""


def _files(spark, sf):
    e = A.table(spark, sf, "events")
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % n).cast("int"))
    dose = F.concat((F.col("event_id") % 7 * 50).cast("string"), F.lit(" nM"))
    last = F.when(F.col("event_id") % 5 == 0, "baseline").when(F.col("event_id") % 5 == 1, "Live").otherwise(dose)
    return e.select(
        "event_id",
        F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), pick(3, "ca_v2", "cb", "cc"), pick(2, "Signal", "channeltest")).alias("folder"),
        F.concat(F.concat_ws("_", F.col("user_id").cast("string"), F.lit("x"), pick(4, "EIS", "fscv", "paired", "misc"), last), F.lit(".csv")).alias("name"),
    )


@query(
    f"""with {FILES}, p as (select *, string_split(regexp_replace(name, '\\.csv$', ''), '_') as s from files),
  q as (select event_id, folder, lower(s[len(s) - 1]) in ('eis', 'fscv', 'paired') as ok, lower(s[len(s) - 1]) as sig, s[len(s)] as last, array_to_string(s[1:len(s) - 2], '_') as dev from p)
select event_id, cast(strptime(substr(folder, 1, 8), '%Y%m%d')::date as varchar) as date, regexp_extract(folder, '^\\d{{8}}_(?:(.*)_)?([^_]*)$', 1) as devicetype,
  lower(regexp_extract(folder, '^\\d{{8}}_(?:(.*)_)?([^_]*)$', 2)) as testtype, case when ok then dev end as device, case when ok then sig end as signaltype,
  case when ok and regexp_matches(last, '^[0-9.]+\\s*n[mM]$') then cast(regexp_extract(last, '^([0-9.]+)', 1) as double) end as dose_nm,
  case when ok and not regexp_matches(last, '^[0-9.]+\\s*n[mM]$') then lower(last) end as token from q"""
)
def parse_session_names(spark, sf):
    f = _files(spark, sf)
    f = f.withColumn("a", N.parse_folder(F.col("folder"))).withColumn("b", N.parse_filename(F.col("name")))
    return f.select("event_id", F.col("a.date").cast("string").alias("date"), "a.devicetype", "a.testtype", "b.*")


REDO = """redo as (
  select user_id % 20 as folder, (user_id // 20) || '_fscv_' || (event_id % 4 * 100) || 'nM' || case when event_id % 11 = 0 then '_redo' when event_id % 11 = 1 then '_REDO' else '' end || '.csv' as name
  from events group by all)"""


def _redo_files(spark, sf):
    e = A.table(spark, sf, "events")
    tail = F.when(F.col("event_id") % 11 == 0, "_redo").when(F.col("event_id") % 11 == 1, "_REDO").otherwise("")
    name = F.concat(F.floor(F.col("user_id") / 20).cast("string"), F.lit("_fscv_"), (F.col("event_id") % 4 * 100).cast("string"), F.lit("nM"), tail, F.lit(".csv"))
    return e.select((F.col("user_id") % 20).alias("folder"), name.alias("name")).distinct()


@query(
    f"""with {REDO}, s as (select *, lower(regexp_replace(name, '(?i)\\.csv$', '')) as st from redo),
  t as (select folder, name, regexp_replace(st, '_redo$', '') as stem, st like '%\\_redo' escape '\\' as is_redo from s)
select folder, name, stem, is_redo from t qualify row_number() over (partition by folder, stem order by is_redo desc, case when is_redo then name end desc nulls last, name) = 1"""
)
def dedup_redo(spark, sf):
    return N.resolve_redo(_redo_files(spark, sf)).select("folder", "name", "stem", "is_redo")


@query(
    f"""with {REDO}, s as (select *, lower(regexp_replace(name, '(?i)\\.csv$', '')) as st from redo),
  t as (select folder, name, regexp_replace(st, '_redo$', '') as stem, st like '%\\_redo' escape '\\' as is_redo from s),
  u as (select * from t qualify row_number() over (partition by folder, stem order by is_redo desc, name desc) = 1)
select folder, string_split(stem, '_')[1] as device from u group by all having bool_or(is_redo) and bool_or(not is_redo)"""
)
def partial_redo_devices(spark, sf):
    return N.partial_redo(_redo_files(spark, sf))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, json_keys(props)[1] as first_key from events")
def json_props_extract(spark, sf):
    e = A.table(spark, sf, "events")
    keys = F.json_object_keys("props")
    whole = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.element_at(whole, F.get(keys, F.lit(0))).alias("first_value"), F.get(keys, F.lit(0)).alias("first_key"))


@query(f"with {A.REPS_SQL} select device, channel, timepoint, concentration, event_id, rep from reps")
def replicate_index(spark, sf):
    return A.replicates(spark, sf).drop("value")


@query(f"with {A.REPS_SQL} select {K}, concentration, round(avg(value), 6) as mean, count(*) as n from reps where rep < 3 group by all")
def replicate_mean_first3(spark, sf):
    g = A.replicates(spark, sf).where("rep < 3").groupBy(*KEYS, "concentration")
    return g.agg(r6(F.avg("value")).alias("mean"), F.count(F.lit(1)).alias("n"))


SNR_SQL = A.REPS_SQL + f""", snr as (select {K}, concentration, avg(value) as response, stddev_pop(value) as rep_std, count(*) as n,
  case when count(*) >= 2 then case when stddev_pop(value) > 0 then avg(value) / stddev_pop(value) else 'inf'::double end end as snr from reps group by all)"""


def _with_snr(spark, sf):
    r = D.repeatability(A.replicates(spark, sf), [*KEYS, "concentration"], order="event_id")
    return r.withColumnRenamed("mean", "response")


@query(f"with {SNR_SQL} select {K}, concentration, n, round(rep_std, 6) as rep_std, case when isinf(snr) then -1 else round(snr, 5) end as snr from snr")
def repeatability_snr(spark, sf):
    s = _with_snr(spark, sf)
    snr = F.when(F.col("snr") == float("inf"), -1.0).otherwise(F.round("snr", 5))
    return s.select(*KEYS, "concentration", "n", r6(F.col("rep_std")).alias("rep_std"), snr.alias("snr"))


@query(
    f"""with {A.OBS_SQL}, g as (select {K}, count(distinct concentration) as n_conc, {_corr('log10(concentration)', 'response')} as r,
  regr_slope(response, log10(concentration)) as slope, regr_intercept(response, log10(concentration)) as intercept from obs group by all)
select {K}, n_conc, round(r, 6) as r, round(slope, 5) as slope, round(intercept, 5) as intercept from g where n_conc >= 3 and r >= 0.6"""
)
def dose_monotone_channels(spark, sf):
    d = D.dose_monotone(A.observations(spark, sf))
    return d.select(*KEYS, "n_conc", r6(F.col("r")).alias("r"), r6(F.col("slope"), 5).alias("slope"), r6(F.col("intercept"), 5).alias("intercept"))


RANK = "rank() over (partition by device, channel, timepoint order by {c}) + (count(*) over (partition by device, channel, timepoint, {c}) - 1) / 2.0::double"


@query(
    f"""with {A.OBS_SQL}, k as (select *, {RANK.format(c='concentration')} as x, {RANK.format(c='response')} as y from obs)
select {K}, count(distinct concentration) as n_conc, case when count(distinct concentration) >= 3 then round({_corr('x', 'y')}, 6) end as r from k group by {K}"""
)
def dose_spearman(spark, sf):
    d = D.dose_response(A.observations(spark, sf), method="spearman")
    return d.select(*KEYS, "n_conc", r6(F.col("r")).alias("r"))


@query(f"with {A.OBS_SQL} select {K}, round(regr_slope(response, log10(concentration)), 5) as slope, round(regr_intercept(response, log10(concentration)), 5) as intercept from obs group by all having count(distinct concentration) >= 3")
def dose_slope_intercept(spark, sf):
    d = D.sensitivity(A.observations(spark, sf))
    return d.select(*KEYS, r6(F.col("slope"), 5).alias("slope"), r6(F.col("intercept"), 5).alias("intercept"))


WSUMS = """w as (select *, log10(concentration) as x, greatest(coalesce(case when snr > 0 and not isinf(snr) then snr end,
    min(case when snr > 0 and not isinf(snr) then snr end) over (partition by device, channel, timepoint), 1), 1e-9) ** 4 as w from snr where response is not null)"""


@query(
    f"""with {SNR_SQL}, {WSUMS}, m as (select *, x - sum(w * x) over k / sum(w) over k as cx, response - sum(w * response) over k / sum(w) over k as cy
    from w window k as (partition by device, channel, timepoint))
select {K}, count(distinct concentration) as n_conc, round(sum(w * cx * cy) / nullif(sum(w * cx * cx), 0), 3) as slope
from m group by all having count(distinct concentration) >= 3"""
)
def dose_slope_weighted(spark, sf):
    d = D.sensitivity(_with_snr(spark, sf), weight="snr")
    return d.select(*KEYS, "n_conc", r6(F.col("slope"), 3).alias("slope"))


@query(
    f"""with {A.OBS_SQL}, w as (select *, log10(concentration) - avg(log10(concentration)) over k as x, response - avg(response) over k as y from obs where response is not null window k as (partition by device, channel, timepoint)),
 s as (select {K}, count(distinct concentration) as n, count(*)::double as a, sum(x) as b, sum(x**2) as c, sum(x**3) as d, sum(x**4) as e, sum(y) as p, sum(x*y) as q, sum(x**2*y) as r from w group by all)
select {K}, case when n >= 4 then round((a*(c*r-q*d) - b*(b*r-q*c) + p*(b*d-c*c)) / nullif(a*(c*e-d*d) - b*(b*e-d*c) + c*(b*d-c*c), 0), 3) end as curvature from s where n >= 3"""
)
def dose_curvature(spark, sf):
    return D.sensitivity(A.observations(spark, sf)).select(*KEYS, r6(F.col("curvature"), 3).alias("curvature"))


@query(
    f"""with {A.OBS_SQL} select {K}, round(regr_slope(ln(response), ln(concentration)), 6) as exponent, round(exp(regr_intercept(ln(response), ln(concentration))), 4) as amplitude
from obs where response > 0 group by all having count(distinct concentration) >= 3"""
)
def power_law_fit(spark, sf):
    d = D.power_law(A.observations(spark, sf))
    return d.select(*KEYS, r6(F.col("exponent")).alias("exponent"), r6(F.col("amplitude"), 4).alias("amplitude"))


ROWS = f"select {K}, concentration, round(response, 6) as response from"
GOOD = f"good as (select {K} from snr where response >= 0 group by all having count(distinct concentration) >= 3 and {_corr('log10(concentration)', 'response')} >= 0.6"


def _accepted(spark, sf, how, **kw):
    rows = D.accept(_with_snr(spark, sf), how, **kw)
    return rows.select(*KEYS, "concentration", r6(F.col("response")).alias("response"))


@query(f"with {SNR_SQL} {ROWS} snr where response >= 0 and snr >= 1 and not isinf(snr)")
def acceptance_snr(spark, sf):
    return _accepted(spark, sf, "snr")


@query(f"with {SNR_SQL} {ROWS} snr where response >= 0")
def acceptance_none(spark, sf):
    return _accepted(spark, sf, "none")


@query(f"with {SNR_SQL}, {GOOD}) {ROWS} snr join good using ({K}) where response >= 0")
def acceptance_monotonic(spark, sf):
    return _accepted(spark, sf, "monotonic")


@query(f"with {SNR_SQL}, {GOOD}) {ROWS} snr join good using ({K}) where response >= 0 and snr >= 1 and not isinf(snr)")
def acceptance_monotonic_snr(spark, sf):
    return _accepted(spark, sf, "monotonic+snr")


@query(f"with {SNR_SQL}, {GOOD} and max(response) - min(response) >= 50) {ROWS} snr join good using ({K}) where response >= 0")
def dose_range_floor(spark, sf):
    return _accepted(spark, sf, "monotonic", min_range=50.0)


@query(f"with {A.OBS_SQL} select {K}, concentration, round(response - 60, 6) as response from obs where response - 60 >= 0")
def drop_negative(spark, sf):
    shifted = A.observations(spark, sf).withColumn("response", F.col("response") - 60)
    return D.accept(shifted, "none").select(*KEYS, "concentration", r6(F.col("response")).alias("response"))


@query(
    f"with {A.OBS_SQL} select {K}, "
    + ", ".join(f"round(avg(case when concentration = {c:g} then response end), 6) as dose_{c:g}" for c in A.DOSES.values())
    + " from obs group by all having count(distinct concentration) >= 3"
)
def dose_curve_pivot(spark, sf):
    doses = list(A.DOSES.values())
    wide = D.dose_curve(A.observations(spark, sf), doses)
    return wide.select(*KEYS, *[r6(F.col(f"dose_{c:g}")).alias(f"dose_{c:g}") for c in doses])
