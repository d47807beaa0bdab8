"""Queries for quality control, stabilization, domain shift and relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import rounded as r6
from ..operators import domain as M
from ..operators import dose as D
from ..operators import quality_control as C
from ..operators import waveforms as V
from ..sources import adapters as A
from .dose_queries import SNR_SQL, _with_snr
from .registry import query

K3 = ["device", "channel", "timepoint"]


@query(f"with {A.OBS_SQL} select device, timepoint, count(distinct channel) as n_channels, round(count(distinct channel) / 16.0::double, 6) as fraction from obs group by all")
def channel_survival(spark, sf):
    c = C.channel_survival(A.observations(spark, sf))
    return c.select("device", "timepoint", "n_channels", r6(F.col("fraction")).alias("fraction"))


@query(f"with {A.OBS_SQL} select device, timepoint, count(distinct channel) as n_channels, count(distinct case when response > 50 then channel end) as n_valid, count(distinct channel) - count(distinct case when response > 50 then channel end) as rejected from obs group by all")
def quality_filtering(spark, sf):
    return C.quality_filtering(A.observations(spark, sf).withColumn("ok", F.col("response") > 50), "ok")


@query(f"with {A.EVENTS_SQL} select device, timepoint, channel, event_type, concentration, count(*) as n_replicates from ev group by all")
def index_counts(spark, sf):
    return A.events(spark, sf).groupBy("device", "timepoint", "channel", "event_type", "concentration").agg(F.count(F.lit(1)).alias("n_replicates"))


KK = "device, channel, timepoint"
ROST = f"a as (select distinct {KK}, true as has_eis from obs where concentration in (100, 250)), b as (select distinct {KK}, true as has_fscv from obs where concentration = 5000)"


def _roster(spark, sf):
    o = A.observations(spark, sf)
    return C.roster(o.where(F.col("concentration").isin(100.0, 250.0)), o.where("concentration = 5000"), K3)


@query(f"with {A.OBS_SQL}, {ROST} select {KK}, coalesce(has_eis, false) as has_eis, coalesce(has_fscv, false) as has_fscv, coalesce(has_eis and has_fscv, false) as complete from a full join b using ({KK})")
def qc_roster_full_outer(spark, sf):
    return _roster(spark, sf)


DOSES = list(A.DOSES.values())
FLAGS = ", ".join(f"coalesce(bool_or(concentration = {c:g} and coalesce(snr >= 1, false)), false) as fscv_snr_{c:g}" for c in DOSES)
GATES = [f"fscv_snr_{c:g}" for c in (500.0, 5000.0)]


def _flags(spark, sf):
    return C.snr_flags(_with_snr(spark, sf), K3, DOSES, 1.0)


@query(f"with {SNR_SQL} select {KK}, {FLAGS} from snr group by all")
def qc_flag_pivot(spark, sf):
    return _flags(spark, sf)


VALID = SNR_SQL + f", fl as (select {KK}, {FLAGS} from snr group by all), va as (select *, {' and '.join(GATES)} as overall_valid from fl)"


@query(f"with {VALID} select {KK}, concentration, round(response, 6) as response from snr semi join (select * from va where overall_valid) v using ({KK})")
def qc_finalized(spark, sf):
    ok = C.gate(_flags(spark, sf), GATES).where("overall_valid")
    return _with_snr(spark, sf).join(ok, K3, "left_semi").select(*K3, "concentration", r6(F.col("response")).alias("response"))


@query(f"with {VALID} select {KK}, concat_ws('; ', case when not fscv_snr_500 then 'noisy at 500' end, case when not fscv_snr_5000 then 'noisy at 5000' end) as fail_reasons from va")
def fail_reasons(spark, sf):
    return _flags(spark, sf).select(*K3, C.fail_reasons({"fscv_snr_500": "noisy at 500", "fscv_snr_5000": "noisy at 5000"}).alias("fail_reasons"))


@query(f"with {VALID} select device, timepoint, array_to_string(list_sort(coalesce(list(channel) filter (where overall_valid), [])), ',') as valid_channels, array_to_string(list_sort(coalesce(list(channel) filter (where not overall_valid), [])), ',') as invalid_channels, round(100 * avg(overall_valid::int), 1) as valid_pct from va group by all")
def valid_channel_lists(spark, sf):
    v = C.valid_lists(C.gate(_flags(spark, sf), GATES), ["device", "timepoint"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return v.select("device", "timepoint", text("valid_channels"), text("invalid_channels"), "valid_pct")


@query(f"with {VALID} " + " union all ".join(f"select '{g}' as gate, count(*) as total, count(*) filter (where not {g}) as failed, round(100.0 * count(*) filter (where not {g}) / count(*), 1) as failed_pct from va" for g in GATES))
def gate_impact(spark, sf):
    return C.gate_impact(_flags(spark, sf), GATES)


SWEEP = [round(0.25 * i, 2) for i in range(20)]


@query(f"with {SNR_SQL} select t as threshold, count(*) filter (where snr >= t) as kept from snr, (select unnest([{', '.join(f'{t}::double' for t in SWEEP)}]) as t) group by t")
def threshold_sweep(spark, sf):
    return C.threshold_sweep(_with_snr(spark, sf), "snr", SWEEP)


@query(
    f"""with {A.OBS_SQL}, m as (select *, median(response) over (partition by device, concentration) as med, stddev(response) over (partition by device, concentration) as sd from obs),
  d as (select *, 1.4826 * median(abs(response - med)) over (partition by device, concentration) as mad from m), k as (select *, case when mad > 0 then mad else coalesce(sd, 0) end as w from d)
select device, concentration, count(*) as n, round(avg(response), 5) as mean, round(coalesce(stddev(response), 0), 5) as sd from k where w <= 0 or abs(response - med) <= 3 * w group by all"""
)
def device_mad_mean(spark, sf):
    m = C.mad_mean(A.observations(spark, sf), ["device", "concentration"], "response")
    return m.select("device", "concentration", "n", r6(F.col("mean"), 5).alias("mean"), r6(F.col("sd"), 5).alias("sd"))


@query(f"with {A.EVENTS_SQL} select device, channel, count(distinct concentration) filter (where timepoint = 0) as t0, count(distinct concentration) filter (where timepoint = 7) as t7, count(distinct concentration) filter (where timepoint = 14) as t14 from ev group by all")
def concentration_grid_pivot(spark, sf):
    e = A.events(spark, sf)
    p = e.groupBy("device", "channel").pivot("timepoint", [0, 7, 14]).agg(F.countDistinct("concentration"))
    return p.select("device", "channel", *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).alias(f"t{t}") for t in (0, 7, 14)])


@query(f"with {A.OBS_SQL} select {KK} from obs group by all having max(n_rep) >= 3 except select {KK} from obs where concentration = 5000")
def set_difference(spark, sf):
    o = A.observations(spark, sf)
    return o.groupBy(*K3).agg(F.max("n_rep").alias("m")).where("m >= 3").select(*K3).subtract(o.where("concentration = 5000").select(*K3))


@query(f"with {A.OBS_SQL} select {KK} from obs where concentration = 100 intersect select {KK} from obs where concentration = 5000")
def set_intersection(spark, sf):
    o = A.observations(spark, sf)
    return o.where("concentration = 100").select(*K3).intersect(o.where("concentration = 5000").select(*K3))


@query("select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all by name select s_suppkey as id, s_name as name, s_acctbal as balance, null as segment from supplier")
def union_by_name(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = A.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("select c_custkey, c_nationkey from customer anti join (select o_custkey as c_custkey from orders where o_totalprice > 100000) using (c_custkey)")
def anti_join_missing_sessions(spark, sf):
    c = A.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = A.table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return C.missing_sessions(c, o, ["c_custkey"])


@query("select o_orderkey, o_custkey, o_totalprice from orders semi join (select c_custkey as o_custkey from customer where c_mktsegment = (select min(c_mktsegment) from customer)) using (o_custkey)")
def semi_join_keep(spark, sf):
    c = A.table(spark, sf, "customer")
    keep = c.join(F.broadcast(c.agg(F.min("c_mktsegment").alias("m"))), F.expr("c_mktsegment = m")).select(F.col("c_custkey").alias("o_custkey"))
    return A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(keep, "o_custkey", "left_semi")


PIN = f"p as (select device, timepoint, count(*) as n_pinned from obs where device < 8 group by all), f as (select device, timepoint, count(*) filter (where concentration != 100 or device % 3 != 0) as n_found from obs where device > 1 group by all)"


@query(f"with {A.OBS_SQL}, {PIN} select device, timepoint, n_pinned, n_found, case when n_pinned is null then 'new' when n_found is null then 'missing' when n_pinned = n_found then 'ok' else 'changed' end as status from p full join f using (device, timepoint)")
def pin_row_count_check(spark, sf):
    o = A.observations(spark, sf)
    pinned = o.where("device < 8").groupBy("device", "timepoint").agg(F.count(F.lit(1)).alias("n"))
    found = o.where("device > 1").groupBy("device", "timepoint").agg(F.count_if(F.expr("concentration != 100 or device % 3 != 0")).alias("n"))
    return C.row_count_check(pinned, found, ["device", "timepoint"])


@query(
    """with r as (select c_nationkey, c_custkey, sum(l_extendedprice * (1 - l_discount)) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by all)
select n_name, c_custkey, round(revenue, 4) as revenue, cast(row_number() over (partition by c_nationkey order by revenue desc, c_custkey) as bigint) as place from r join nation on n_nationkey = c_nationkey
qualify row_number() over (partition by c_nationkey order by revenue desc, c_custkey) <= 3"""
)
def star_topk(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = A.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    r = li.join(o, F.expr("l_orderkey = o_orderkey")).groupBy("o_custkey").agg(F.sum("x").alias("revenue")).join(c, F.expr("o_custkey = c_custkey"))
    w = W.partitionBy("c_nationkey").orderBy(F.desc("revenue"), "c_custkey")
    top = r.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")
    n = A.table(spark, sf, "nation").select("n_nationkey", "n_name")
    return top.join(n, F.expr("n_nationkey = c_nationkey")).select("n_name", "c_custkey", F.round("revenue", 4).alias("revenue"), "place")


@query("select a.o_orderkey, count(b.o_orderkey) as earlier, round(coalesce(sum(b.o_totalprice), 0), 2) as spent from orders a left join orders b on a.o_custkey = b.o_custkey and b.o_orderdate < a.o_orderdate group by a.o_orderkey")
def theta_join_history(spark, sf):
    o = A.table(spark, sf, "orders").withColumn("_s", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    w = W.partitionBy("o_custkey").orderBy("_s").rangeBetween(W.unboundedPreceding, -1)
    return o.select("o_orderkey", F.count("o_orderkey").over(w).alias("earlier"), F.round(F.coalesce(F.sum("o_totalprice").over(w), F.lit(0.0)), 2).alias("spent"))


SER = A.EVENTS_SQL + ", ser as (select channel, row_number() over (partition by channel order by event_id) as cycle, value / 500 as x from ev)"


def _series(spark, sf):
    w = W.partitionBy("channel").orderBy("event_id")
    return A.events(spark, sf).select("channel", F.row_number().over(w).cast("long").alias("cycle"), (F.col("value") / 500).alias("x"))


SMOOTH = "case when count(*) over (partition by channel) < {w} then x else sum(x) over (partition by channel order by cycle rows between {b} preceding and {a} following) / {w} end"


@query(f"with {SER} select channel, cycle, round({SMOOTH.format(w=4, b=2, a=1)}, 6) as smooth from ser")
def moving_average_zero_pad(spark, sf):
    return C.moving_average(_series(spark, sf), ["channel"], "cycle", "x", 4).select("channel", "cycle", r6(F.col("smooth")).alias("smooth"))


@query(f"with {SER}, s as (select *, {SMOOTH.format(w=5, b=2, a=2)} as smooth from ser), g as (select channel, count(*) as n, coalesce(max(case when not coalesce(smooth <= 0.15, false) then cycle end), 0) as l from s group by channel) select channel, n, n - l as trailing, n - l >= 2 as converged, case when n - l >= 2 then l end as settled_at from g")
def convergence_run(spark, sf):
    return C.converged(_series(spark, sf), ["channel"], "cycle", "x", tol=0.15, patience=2)


CD = A.CYCLES_SQL + """, ends as (select vec_id, min_by(i, struct_pack(v := v, i := i)) as lo, max_by(i, struct_pack(v := v, i := -i)) as hi from cyc group by vec_id),
 up as (select vec_id, label, i, cur from cyc join ends using (vec_id) where i between lo and hi),
 o as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as k from (select distinct vec_id, label from up)), pr as (select label, vec_id, k, lag(vec_id) over (partition by label order by k) as p from o)"""


def _cycle_series(spark, sf):
    d = V.anodic(A.cycles(spark, sf), "current")
    return d.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).withColumn("in_round", F.col("k") % 6).withColumn("round", F.floor(F.col("k") / 6))


@query(f"with {CD} select pr.label, pr.vec_id, round(sqrt(sum((a.cur - b.cur) ** 2)) / sqrt(sum(a.cur ** 2)), 6) as drift from pr join up a on a.vec_id = pr.vec_id join up b on b.vec_id = pr.p and b.i = a.i where k % 6 not in (0, 1) group by pr.label, pr.vec_id")
def cycle_drift(spark, sf):
    d = C.cycle_drift(_cycle_series(spark, sf), ["label"], "vec_id", "current", "in_round")
    return d.select("label", "vec_id", r6(F.col("drift")).alias("drift"))


@query(
    f"""with {CD}, rm as (select o.label, cast(floor(k / 6) as bigint) as round, i, avg(cur) as c from o join up on up.vec_id = o.vec_id group by all)
select a.label, a.round, round(sqrt(sum((a.c - b.c) ** 2)) / sqrt(sum(a.c ** 2)), 6) as drift from rm a join rm b on a.label = b.label and b.round = a.round - 1 and a.i = b.i group by a.label, a.round"""
)
def round_drift(spark, sf):
    m = C.round_means(_cycle_series(spark, sf), ["label"], "round", "current")
    return C.cycle_drift(m, ["label"], "round", "current").select("label", "round", r6(F.col("drift")).alias("drift"))


XS = A.FEATURES
COV = ", ".join(f"avg({c}) as m_{c}" for c in XS) + ", " + ", ".join(f"covar_samp({a}, {b}) as c_{a}_{b}" for i, a in enumerate(XS) for b in XS[i:])
SQUARES = ", ".join(f"{1 if a == b else 2} * (b.c_{a}_{b} - r.c_{a}_{b}) ** 2" for i, a in enumerate(XS) for b in XS[i:])
DIST = f"sqrt(list_sum([{SQUARES}])) + sqrt(list_sum([{', '.join(f'(b.m_{c} - r.m_{c}) ** 2' for c in XS)}]))"
#: Numbers with few binary digits, so that any order of summing gives the same.
CENTRES, COEFFICIENTS = [i / 64 for i in range(len(XS))], [((7 * i) % 11 - 5) / 4 for i in range(len(XS))]


@query(f"with {A.MATRIX_SQL}, r as (select {COV} from mat where timepoint < 3), b as (select count(*) as n, {COV} from mat where timepoint >= 3) select n, round({DIST}, 6) as distance from b, r")
def coral_distance(spark, sf):
    d = M.coral_distance(A.matrix(spark, sf), XS, F.expr("timepoint < 3"), F.expr("timepoint >= 3"))
    return d.select("n", r6(F.col("distance")).alias("distance"))


@query(f"with {A.MATRIX_SQL}, r as (select {COV} from mat where timepoint = 0), b as (select timepoint, count(*) as n, {COV} from mat group by timepoint) select timepoint, n, round({DIST}, 6) as distance, case when {DIST} > 0.05 then 'EXTRAPOLATING' else 'ok' end as flag from b, r")
def drift_path(spark, sf):
    d = M.coral_distance(A.matrix(spark, sf), XS, F.expr("timepoint = 0"), F.lit(True), ["timepoint"])
    return M.flag_extrapolation(d, 0.05).select("timepoint", "n", r6(F.col("distance")).alias("distance"), "flag")


@query(f"with {A.MATRIX_SQL} select vec_id, round({' + '.join(f'({c} - {m}::double) * {w}::double' for c, m, w in zip(XS, CENTRES, COEFFICIENTS, strict=True))} + 4, 6) as score from mat")
def linear_score(spark, sf):
    return M.linear_score(A.matrix(spark, sf), XS, CENTRES, COEFFICIENTS, 4.0).select("vec_id", r6(F.col("score")).alias("score"))


COND = "co as (select p_brand as condition, substr(p_brand, 1, 7) as batch, round(avg(p_retailprice), 6) as rmsep from part group by all)"


def _conditions(spark, sf):
    return A.table(spark, sf, "part").groupBy(F.col("p_brand").alias("condition"), F.substring("p_brand", 1, 7).alias("batch")).agg(F.round(F.avg("p_retailprice"), 6).alias("rmsep"))


@query(f"with {COND} select condition, round(rmsep, 4) as rmsep, row_number() over (order by rmsep nulls last, condition) as rank from co")
def rank_conditions(spark, sf):
    return C.rank_conditions(_conditions(spark, sf)).select("condition", F.round("rmsep", 4).alias("rmsep"), "rank")


@query("select p_type as feature, round(avg(p_size / 50.0::double), 6) as mean_frequency, count(*) filter (where p_size / 50.0 > 0) as n_conditions from part group by p_type")
def feature_ranking(spark, sf):
    f = C.feature_ranking(A.table(spark, sf, "part").select(F.col("p_type").alias("feature"), (F.col("p_size") / 50.0).alias("frequency")))
    return f.select("feature", r6(F.col("mean_frequency")).alias("mean_frequency"), "n_conditions")


@query(f"with {COND} select condition, batch, rmsep > 1.01 * min(rmsep) over (partition by batch) as dominated from co")
def auto_flag(spark, sf):
    return C.auto_flag(_conditions(spark, sf), "batch", factor=1.01).select("condition", "batch", "dominated")


@query(f"with {A.OBS_SQL} select {KK}, concentration, dense_rank() over (order by device, channel) - 1 as sensor_id from obs")
def sensor_index(spark, sf):
    o = A.observations(spark, sf)
    ids = o.select("device", "channel").distinct()
    return o.join(ids.withColumn("sensor_id", (F.dense_rank().over(W.orderBy("device", "channel")) - 1).cast("long")), ["device", "channel"]).select(*K3, "concentration", "sensor_id")


@query(f"with {A.OBS_SQL}, l as (select {KK}, concentration, response, row_number() over (partition by {KK} order by concentration) - 1 as k, count(*) over (partition by {KK}) as n from obs), s as (select * from l where concentration >= 500), j as (select s.device, s.channel, s.timepoint, row_number() over (partition by s.device, s.channel, s.timepoint order by s.concentration) - 1 as idx, s.response as live from s) select j.device, j.channel, j.timepoint, j.idx, round(j.live, 6) as live, round(l.response, 6) as spectrum from j join l on l.device = j.device and l.channel = j.channel and l.timepoint = j.timepoint and l.k = least(j.idx, 0)")
def ordinal_join(spark, sf):
    """k-th live cycle with the k-th spectrum, the last one reused when there are fewer."""
    o = A.observations(spark, sf)
    w = W.partitionBy(*K3).orderBy("concentration")
    spectra = o.withColumn("k", F.row_number().over(w) - 1).where("k = 0").select(*K3, "k", F.col("response").alias("spectrum"))
    live = o.where("concentration >= 500").withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    n = spectra.groupBy(*K3).agg(F.max("k").alias("last"))
    j = live.join(n, K3).withColumn("k", F.least("idx", "last")).join(spectra, [*K3, "k"])
    return j.select(*K3, "idx", r6(F.col("response")).alias("live"), r6(F.col("spectrum")).alias("spectrum"))
