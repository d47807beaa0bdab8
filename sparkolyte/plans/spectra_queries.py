"""Queries over spectra and waveforms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import rounded as r6
from ..operators import spectra as S
from ..operators import waveforms as V
from ..sources import adapters as A
from .registry import query

BAND = (2.0, 2e5)
INB = A.SPECTRA_SQL + ", b as (select * from pts where f between 2 and 200000)"
MAG = INB + ", m as (select *, sqrt(zr * zr + zi * zi) as mag, lag(sqrt(zr * zr + zi * zi)) over (partition by vec_id order by f) as prev from b)"
QUAL = MAG + """, q as (select vec_id, min(label) as label, count(*) as n_in_band, bool_and(zi < 0) as eis_a, max((mag - prev) / greatest(prev, 1e-12)) as z_rise_max,
  max((mag - prev) / greatest(prev, 1e-12)) <= 0.05 as eis_b, bool_and(zr > 0) as eis_c from m group by vec_id)"""


@query(f"with {QUAL} select vec_id, n_in_band, eis_a, eis_b, eis_c, eis_a and eis_b and eis_c as eis_valid, round(z_rise_max, 6) as z_rise_max from q")
def eis_quality_flags(spark, sf):
    q = S.quality(A.spectra(spark, sf), BAND)
    return q.select("vec_id", "n_in_band", "eis_a", "eis_b", "eis_c", "eis_valid", r6(F.col("z_rise_max")).alias("z_rise_max"))


@query(f"with {A.SPECTRA_SQL} select vec_id, round(min(case when zi >= 0 then f end), 3) as onset from pts group by vec_id")
def inductive_onset(spark, sf):
    return A.spectra(spark, sf).select("vec_id", r6(S.inductive_onset(F.col("freq"), F.col("z_imag")), 3).alias("onset"))


@query(f"with {INB} select vec_id, count(*) as n, round(min(f), 4) as f_min, round(max(f), 2) as f_max, round(sum(zr), 3) as sum_real from b group by vec_id")
def band_filter(spark, sf):
    d = S.in_band(A.spectra(spark, sf), BAND)
    total = F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["zr"])
    f = F.transform("pts", lambda p: p["f"])
    return d.select("vec_id", F.size("pts").cast("long").alias("n"), r6(F.array_min(f), 4).alias("f_min"), r6(F.array_max(f), 2).alias("f_max"), r6(total, 3).alias("sum_real"))


@query(
    f"""with {QUAL}, g as (select label, min(vec_id) as ref from q where eis_a and eis_b and eis_c group by label),
  s as (select *, case when vec_id % 5 = 0 then f * 1.01 else f end as f2 from b),
  r as (select g.label, b.i, b.f as gf from g join b on b.vec_id = g.ref)
select s.vec_id, bool_and(abs(s.f2 - r.gf) <= 1e-8 + 1e-3 * abs(r.gf)) as on_grid from s join r on s.label = r.label and s.i = r.i group by s.vec_id"""
)
def ref_grid_gate(spark, sf):
    d = A.spectra(spark, sf)
    grid = S.reference_grid(d, ["label"], ["vec_id"], BAND)
    f = F.transform("pts", lambda p: F.when(F.col("vec_id") % 5 == 0, p["f"] * 1.01).otherwise(p["f"]))
    return S.in_band(d, BAND).withColumn("f2", f).join(grid, "label").select("vec_id", S.on_grid(F.col("f2"), F.col("grid")).alias("on_grid"))


@query(
    f"""with {A.SPECTRA_SQL}, o as (select vec_id, min(case when zi >= 0 then f end) as onset from pts group by vec_id), t as (select quantile_cont(onset, 0.1) as threshold from o)
select 10.0::double as lo, round((select max(f) from pts, t where f < threshold), 3) as hi, round(threshold, 3) as threshold from t"""
)
def recommended_band(spark, sf):
    b = S.recommended_band(A.spectra(spark, sf))
    return b.select("lo", r6(F.col("hi"), 3).alias("hi"), r6(F.col("threshold"), 3).alias("threshold"))


UPPERS = [1e3, 1e4, 5e4, 1e5, 2e5, 1e6]


@query(
    f"""with {A.SPECTRA_SQL}, o as (select vec_id, min(case when zi >= 0 then f end) as onset from pts group by vec_id),
  u as (select unnest([{', '.join(f'{u:g}::double' for u in UPPERS)}]) as upper), c as (select upper, count(*) filter (where onset <= upper) as dropped, count(*) as n from u, o group by upper)
select upper, dropped, n - dropped as kept, dropped - min(dropped) over () as dropped_vs_lowest, round((n - dropped) / n, 3) as kept_frac from c"""
)
def band_retention(spark, sf):
    return S.band_retention(A.spectra(spark, sf), UPPERS)


POINT = INB + """, w as (select *, 2 * pi() * f as w, zr * zr + zi * zi as z2, log10(f) as x from b),
 ft as (select *, zr as R_s, z2 / nullif(zr, 0) as R_p, -1 / nullif(w * zi, 0) as C_s, -zi / nullif(w * z2, 0) as C_p, zi * zi / nullif(z2, 0) as ideality_C, -zi / nullif(w * zr, 0) as tau from w)"""


@query(f"with {POINT} select vec_id, i, round(R_s, 4) as R_s, round(R_p, 3) as R_p, round(C_s * 1e9, 3) as C_s_nF, round(C_p * 1e9, 3) as C_p_nF, round(ideality_C, 6) as ideality_C, round(tau * 1e6, 3) as tau_us from ft")
def eis_point_features(spark, sf):
    d = S.with_features(A.spectra(spark, sf), BAND).select("vec_id", F.posexplode("feats").alias("pos", "p"))
    i = F.round((F.col("p.x") * 63 / 6)).cast("long").alias("i")
    p = lambda n: F.col(f"p.{n}")
    return d.select("vec_id", i, r6(p("R_s"), 4).alias("R_s"), r6(p("R_p"), 3).alias("R_p"), r6(p("C_s") * 1e9, 3).alias("C_s_nF"), r6(p("C_p") * 1e9, 3).alias("C_p_nF"), r6(p("ideality_C")).alias("ideality_C"), r6(p("tau") * 1e6, 3).alias("tau_us"))


GRADIENT = """z as (select *, lag(x1) over w as x0, lead(x1) over w as x2, lag(y1) over w as y0, lead(y1) over w as y2 from y window w as (partition by vec_id order by f)),
 n as (select vec_id, i, f, -case when x0 is null then (y2 - y1) / (x2 - x1) when x2 is null then (y1 - y0) / (x1 - x0)
   else ((x1-x0)**2 * y2 + ((x2-x1)**2 - (x1-x0)**2) * y1 - (x2-x1)**2 * y0) / ((x1-x0) * (x2-x1) * (x2-x0)) end as local_n from z)"""
GRAD = INB + ", y as (select vec_id, i, f, log10(f) as x1, log10(sqrt(zr * zr + zi * zi)) as y1 from b), " + GRADIENT


@query(f"with {GRAD} select vec_id, i - min(i) over (partition by vec_id) as pos, round(local_n, 6) as local_n from n")
def eis_local_n_raw(spark, sf):
    d = S.local_n(A.spectra(spark, sf), BAND).select("vec_id", F.posexplode("local_n").alias("pos", "local_n"))
    return d.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("local_n")).alias("local_n"))


@query(
    f"""with {POINT}, l as (select vec_id, x - lag(x) over w as dx, {', '.join(f'({c} + lag({c}) over w) / 2 as {c}' for c in ('R_s', 'R_p', 'C_s', 'C_p'))} from ft window w as (partition by vec_id order by f))
select vec_id, round(sum(R_s * dx), 3) as R_s_integral, round(sum(R_p * dx), 2) as R_p_integral, round(sum(C_s * dx) * 1e9, 2) as C_s_integral, round(sum(C_p * dx) * 1e9, 2) as C_p_integral from l group by vec_id"""
)
def eis_integrals(spark, sf):
    d = S.integrals(A.spectra(spark, sf), BAND)
    return d.select("vec_id", r6(F.col("R_s_integral"), 3).alias("R_s_integral"), r6(F.col("R_p_integral"), 2).alias("R_p_integral"), r6(F.col("C_s_integral") * 1e9, 2).alias("C_s_integral"), r6(F.col("C_p_integral") * 1e9, 2).alias("C_p_integral"))


@query(
    f"""with {POINT}, {GRAD.split(', ', 1)[1].split('b as (select * from pts where f between 2 and 200000), ')[1]}
select ft.vec_id, {', '.join(f"round(avg(case when ft.f >= {lo} and ft.f < {hi} then {c} end), 6) as {n}_{b}" for b, (lo, hi) in S.BANDS.items() for c, n in (('ideality_C', 'ideality_C_band'), ('local_n', 'n_band')))}
from ft join n on ft.vec_id = n.vec_id and ft.i = n.i group by ft.vec_id"""
)
def eis_band_means(spark, sf):
    d = S.band_means(A.spectra(spark, sf), BAND)
    names = [f"{n}_{b}" for b in S.BANDS for n in ("ideality_C_band", "n_band")]
    return d.select("vec_id", *[r6(F.col(n)).alias(n) for n in names])


@query(
    f"""with {POINT}, l as (select vec_id, f, x, ideality_C - 0.21 as y, ideality_C, lag(x) over w as px, lag(ideality_C - 0.21) over w as py from ft window w as (partition by vec_id order by f)),
 c as (select vec_id, min_by(px + (x - px) * (-py) / (y - py), f) as cross_x from l where sign(y) != sign(py) group by vec_id),
 a as (select vec_id, avg(ideality_C) as m, max(f) as hi, min(f) as lo from ft group by vec_id)
select a.vec_id, round(coalesce(10.0::double ** cross_x, case when m > 0.21 then hi else lo end), 3) as f_ideality_crossover from a left join c using (vec_id)"""
)
def eis_crossover(spark, sf):
    d = A.spectra(spark, sf)
    return S.crossover(d, 0.21, BAND).select("vec_id", r6(F.col("f_ideality_crossover"), 3).alias("f_ideality_crossover"))


@query(f"with {POINT} select vec_id, round(min_by(tau, f) / nullif(max_by(tau, f), 0), 3) as tau_ratio from ft group by vec_id")
def eis_tau_ratio(spark, sf):
    return S.tau_ratio(A.spectra(spark, sf), BAND).select("vec_id", r6(F.col("tau_ratio"), 3).alias("tau_ratio"))


@query(f"with {A.SPECTRA_SQL} select vec_id, round(min(-degrees(atan2(zi, zr))), 6) as min_neg_phase, round(coalesce(min(case when zi >= 0 then f end), max(f)), 3) as inductive_onset_hz from pts group by vec_id")
def eis_phase_onset(spark, sf):
    d = S.phase_and_onset(A.spectra(spark, sf))
    return d.select("vec_id", r6(F.col("min_neg_phase")).alias("min_neg_phase"), r6(F.col("inductive_onset_hz"), 3).alias("inductive_onset_hz"))


@query(
    f"""with {A.SPECTRA_SQL}, k as (select label, i, min_by(f, vec_id) as f, avg(zr) as zr, avg(zi) as zi from pts where vec_id % 10 != 3 group by label, i)
select label, i, round(f, 4) as f, round(zr, 5) as z_real, round(zi, 5) as z_imag from k"""
)
def eis_replicate_mean(spark, sf):
    d = A.spectra(spark, sf).where("vec_id % 10 != 3").withColumn("rep", F.col("vec_id"))
    m = S.average_replicates(d, ["label"])
    m = m.select("label", F.posexplode(F.arrays_zip("freq", "z_real", "z_imag")).alias("i", "p"))
    return m.select("label", F.col("i").cast("long").alias("i"), r6(F.col("p.freq"), 4).alias("f"), r6(F.col("p.z_real"), 5).alias("z_real"), r6(F.col("p.z_imag"), 5).alias("z_imag"))


SUB = A.CYCLES_SQL + """, ends as (select vec_id, min_by(i, struct_pack(v := v, i := i)) as lo, max_by(i, struct_pack(v := v, i := -i)) as hi from cyc group by vec_id),
  up as (select vec_id, label, i, v, cur, bg, cur - bg as y from cyc join ends using (vec_id) where i between lo and hi)"""


def _up(spark, sf):
    return V.subtract_background(V.anodic(A.cycles(spark, sf), "current", "background"))


@query(f"with {SUB} select vec_id, count(*) as n, round(min(v), 6) as v_min, round(max(v), 6) as v_max, round(sum(cur), 6) as total from up group by vec_id")
def anodic_slice(spark, sf):
    d = V.anodic(A.cycles(spark, sf), "current")
    total = F.aggregate("current", F.lit(0.0), lambda a, x: a + x)
    return d.select("vec_id", F.size("voltage").cast("long").alias("n"), r6(F.array_min("voltage")).alias("v_min"), r6(F.array_max("voltage")).alias("v_max"), r6(total).alias("total"))


WIN = SUB + ", win as (select * from up where v between 0.4 and 1.0)"
PK = WIN + ", pk as (select vec_id, max_by(struct_pack(i := i, v := v, y := y, bg := bg), struct_pack(y := y, k := -i)) as p from win group by vec_id having count(*) >= 2)"


@query(f"with {PK} select vec_id, cast(p.i as bigint) as idx, round(p.v, 6) as v_ox, round(p.y, 6) as height, round(p.y / nullif(p.bg, 0), 6) as norm_ipeak from pk")
def peak_direct(spark, sf):
    p = V.locate_peak(_up(spark, sf))
    return p.select("vec_id", F.col("peak.idx").cast("long").alias("idx"), r6(F.col("peak.v_ox")).alias("v_ox"), r6(F.col("peak.height")).alias("height"), r6(F.col("peak.norm_ipeak")).alias("norm_ipeak"))


@query(
    f"""with {WIN}, e as (select vec_id, min_by(v, i) as v0, max_by(v, i) as v1, min_by(y, i) as y0, max_by(y, i) as y1 from win group by vec_id),
  s as (select win.*, y - (y0 + (y1 - y0) / nullif(v1 - v0, 0) * (v - v0)) as s from win join e using (vec_id)),
  pk as (select vec_id, max_by(struct_pack(i := i, y := y), struct_pack(s := s, k := -i)) as p from s group by vec_id)
select vec_id, cast(p.i as bigint) as idx, round(p.y, 6) as height from pk"""
)
def peak_chord(spark, sf):
    p = V.locate_peak(_up(spark, sf), method="chord")
    return p.select("vec_id", F.col("peak.idx").cast("long").alias("idx"), r6(F.col("peak.height")).alias("height"))


@query(f"with {SUB} select vec_id, round(sqrt(avg(((cur - bg) / bg) ** 2)), 6) as noise_floor from up where v between 0 and 0.3 and bg != 0 group by vec_id")
def noise_floor(spark, sf):
    return V.noise_floor(_up(spark, sf)).select("vec_id", r6(F.col("noise_floor")).alias("noise_floor"))


@query(
    f"""with {PK}, e as (select vec_id, min_by(y, i) as y0, max_by(y, i) as y1 from win group by vec_id)
select vec_id, p.v <= 0.4 + 0.03 or p.v >= 1.0 - 0.03 as at_edge, y0 >= 0.5 * p.y or y1 >= 0.5 * p.y as clipped from pk join e using (vec_id)"""
)
def peak_edge_flags(spark, sf):
    d = V.peak_edge_clipped(V.locate_peak(_up(spark, sf)))
    return d.select("vec_id", V.peak_at_edge(F.col("peak.v_ox")).alias("at_edge"), F.col("peak_edge_clipped").alias("clipped"))


@query(
    f"""with {PK}, l as (select up.vec_id, max(up.i) filter (where up.i < p.i and y <= p.y / 2) as l, min(up.i) filter (where up.i > p.i and y <= p.y / 2) as r, any_value(p.y / 2) as half from up join pk using (vec_id) group by up.vec_id),
  x as (select l.vec_id, half, a.y as ay, a.v as av, b.y as by_, b.v as bv, c.y as cy, c.v as cv, d.y as dy, d.v as dv from l
    left join up a on a.vec_id = l.vec_id and a.i = l.l left join up b on b.vec_id = l.vec_id and b.i = l.l + 1
    left join up c on c.vec_id = l.vec_id and c.i = l.r left join up d on d.vec_id = l.vec_id and d.i = l.r - 1)
select vec_id, round((cv + (half - cy) / nullif(dy - cy, 0) * (dv - cv)) - (av + (half - ay) / nullif(by_ - ay, 0) * (bv - av)), 5) as fwhm from x where half > 0 union all select vec_id, null from x where not half > 0"""
)
def peak_fwhm(spark, sf):
    d = V.peak_shape(V.locate_peak(_up(spark, sf)))
    return d.select("vec_id", r6(F.col("peak_fwhm"), 5).alias("fwhm"))


@query(f"with {WIN}, l as (select vec_id, (greatest(y, 0) + lag(greatest(y, 0)) over w) / 2 * (v - lag(v) over w) as a from win window w as (partition by vec_id order by i)) select vec_id, round(sum(a), 6) as area from l group by vec_id")
def peak_area(spark, sf):
    d = V.peak_shape(V.locate_peak(_up(spark, sf)))
    return d.select("vec_id", r6(F.col("peak_area")).alias("area"))


@query(
    f"""with {SUB}, r as (select vec_id, regr_slope(y, v) as b, regr_intercept(y, v) as a from up where v between -0.1 and 0.2 group by vec_id)
select up.vec_id, round(sum((y - a - b * v) ** 2), 5) as energy from up join r using (vec_id) group by up.vec_id"""
)
def baseline_detrend(spark, sf):
    d = V.detrend(_up(spark, sf))
    return d.select("vec_id", r6(F.aggregate("bg_sub", F.lit(0.0), lambda a, x: a + x * x), 5).alias("energy"))
