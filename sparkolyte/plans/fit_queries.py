"""Queries for numerical fits and models; they are checked against NumPy in the tests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import _hat
from ..functions.stats import rounded as r6
from ..operators import discovery as R
from ..operators import evaluation as E
from ..operators import fits as T
from ..operators import models as M
from ..operators import normalize as Z
from ..operators import spectra as S
from ..operators import waveforms as V
from ..sources import adapters as A
from .dose_queries import _with_snr
from .registry import query
from .spectra_queries import BAND, GRADIENT, INB

K3 = ["device", "channel", "timepoint"]


@query()
def langmuir_fit(spark, sf):
    return T.curve_fit(A.observations(spark, sf), K3, "langmuir")


@query()
def hill_fit(spark, sf):
    return T.curve_fit(_with_snr(spark, sf), K3, "hill", "snr")


def _hat_sql(window: int) -> str:
    """Rows (r, k, w): the weight of the window's value k in the smoothed value at its place r."""
    rows = ", ".join(f"({r}, {k}, {w!r}::double)" for r, row in enumerate(_hat(window, 2).tolist()) for k, w in enumerate(row))
    return f"hat as (select * from (values {rows}) h(r, k, w))"


def _smooth_sql(table: str, keys: str, value: str, window: int) -> str:
    """Smoothed values of table, whose rows have keys, their place i and their number n, by weights of window."""
    half = window // 2
    place = f"case when a.i < {half} then a.i when a.i >= a.n - {half} then {window} - (a.n - a.i) else {half} end"
    start = f"least(greatest(a.i - {half}, 0), a.n - {window})"
    return f"""smooth as (select a.{keys}, a.i, sum(hat.w * b.{value}) as y from {table} a join hat on hat.r = {place}
    join {table} b on b.{keys} = a.{keys} and b.i = {start} + hat.k group by a.{keys}, a.i)"""


# Samples of each sweep: those between the first lowest and the first highest voltage, both included.
SWEEP_SQL = (
    A.CYCLES_SQL
    + """,
ends as (select vec_id, min_by(i, (v, i)) as lo, min_by(i, (-v, i)) as hi from cyc group by vec_id),
swept as (select cyc.*, i between least(lo, hi) and greatest(lo, hi) as own, hi as turn from cyc join ends using (vec_id))"""
)


@query(f"with {A.CYCLES_SQL}, w as (select *, 64 as n from c0), {_hat_sql(11)}, {_smooth_sql('w', 'vec_id', 'cur', 11)} select vec_id, i as pos, round(y, 6) as smooth from smooth")
def savgol_smooth(spark, sf):
    d = A.cycles(spark, sf).select("vec_id", F.posexplode(T.smoothed(F.col("current"))).alias("pos", "smooth"))
    return d.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("smooth")).alias("smooth"))


@query(
    f"""with {SWEEP_SQL}, b as (select vec_id, own, v * 0.98::double as bv, bg, lead(v * 0.98::double) over w as bv2, lead(bg) over w as bg2 from swept window w as (partition by vec_id, own order by v)),
 edge as (select vec_id, own, min_by(bg, bv) as low, max_by(bg, bv) as high, min(bv) as lo, max(bv) as hi from b group by all)
select s.vec_id, s.i as pos, round(case when s.v <= lo then low when s.v >= hi then high else b.bg + (b.bg2 - b.bg) * (s.v - b.bv) / (b.bv2 - b.bv) end, 6) as aligned
from swept s join edge using (vec_id, own) left join b on b.vec_id = s.vec_id and b.own = s.own and b.bv <= s.v and s.v < b.bv2"""
)
def background_align(spark, sf):
    c = A.cycles(spark, sf)
    shifted = F.transform("voltage", lambda v: v * 0.98)
    d = c.select("vec_id", F.posexplode(T.aligned_background(F.col("voltage"), shifted, F.col("background"))).alias("pos", "aligned"))
    return d.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("aligned")).alias("aligned"))


@query(
    f"""with {SWEEP_SQL}, up as (select vec_id, i, v, bg, lag(v) over w as v0, lag(bg) over w as bg0 from swept where i <= turn and v between 0.4 and 1.0 window w as (partition by vec_id order by i)),
 back as (select vec_id, v as bv, bg, lead(v) over w as bv2, lead(bg) over w as bg2 from swept where i >= turn window w as (partition by vec_id order by i desc)),
 gap as (select up.vec_id, avg(abs(up.bg - (back.bg + (back.bg2 - back.bg) * (up.v - back.bv) / (back.bv2 - back.bv)))) / 2 as cap
   from up join back on up.vec_id = back.vec_id and back.bv <= up.v and up.v < back.bv2 group by all),
 area as (select vec_id, sum((v - v0) * (bg + bg0) / 2) as charge from up group by all)
select s.vec_id, round(s.bg, 6) as bg_switch, round(charge, 6) as bg_charge, round(cap, 6) as bg_cap
from swept s join area using (vec_id) join gap using (vec_id) where s.i = s.turn"""
)
def background_features(spark, sf):
    d = A.cycles(spark, sf).select("vec_id", T.background_features(F.col("voltage"), F.col("background")).alias("b")).select("vec_id", "b.*")
    return d.select("vec_id", *[r6(F.col(c)).alias(c) for c in ("bg_switch", "bg_charge", "bg_cap")])


@query(
    f"""with {INB}, w as (select vec_id, f, log10(f) as x1, log10(sqrt(zr * zr + zi * zi)) as y0, row_number() over k - 1 as i, count(*) over (partition by vec_id) as n from b window k as (partition by vec_id order by f)),
 {_hat_sql(7)}, {_smooth_sql('w', 'vec_id', 'y0', 7)}, y as (select w.vec_id, w.i, w.f, w.x1, smooth.y as y1 from w join smooth on smooth.vec_id = w.vec_id and smooth.i = w.i), {GRADIENT}
select vec_id, i as pos, round(local_n, 6) as local_n from n"""
)
def eis_local_n_smooth(spark, sf):
    d = S.local_n(A.spectra(spark, sf), BAND, smooth=True).select("vec_id", F.posexplode("local_n").alias("pos", "local_n"))
    return d.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("local_n")).alias("local_n"))


@query(
    f"""with {SWEEP_SQL}, s as (select vec_id, v, cur, lead(v) over w as v2, lead(cur) over w as cur2 from swept where own window w as (partition by vec_id order by i))
select vec_id, round(cur + (cur2 - cur) * (0.7::double - v) / (v2 - v), 6) as i_target from s where v <= 0.7 and 0.7 < v2"""
)
def current_at_target(spark, sf):
    return A.cycles(spark, sf).select("vec_id", r6(T.current_at(F.col("voltage"), F.col("current"))).alias("i_target"))


@query()
def settle_time(spark, sf):
    """Series that settle at a label's own rate, scaled by whole waveforms."""
    c = V.anodic(A.cycles(spark, sf), "current")
    size = F.aggregate("current", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("current")
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    d = c.withColumn("k", place).select("label", "k", (size * F.exp(-F.col("k") / (3 + F.col("label"))) + 0.001).alias("x"))
    return T.settle_tau(d, ["label"], "k", "x")


def _discover(spark, sf, conditions):
    return R.run_conditions(A.matrix(spark, sf), A.FEATURES, "y", conditions, min_train_times=3)


@query()
def pls_fit_predict(spark, sf):
    return _discover(spark, sf, [R.Condition("linear", "linear", k_grid=(1, 2, 3))]).drop("selected", "threshold", "predictions")


_Z = """tt as (select timepoint as t_test from (select timepoint, row_number() over (order by timepoint) - 1 as k from (select distinct timepoint from mat)) where k >= 3),
 tr as (select t_test, long.* from long join tt on timepoint <= t_test),
 st as (select t_test, feature, median(value) filter (where timepoint < t_test) as med from tr group by all),
 fi as (select tr.*, coalesce(value, med) as v from tr join st using (t_test, feature)),
 sc as (select t_test, feature, avg(v) filter (where timepoint < t_test) as m, stddev_pop(v) filter (where timepoint < t_test) as sd, avg(y) filter (where timepoint < t_test) as my from fi group by all),
 z as (select fi.t_test, feature, vec_id, sensor, timepoint, y, my, (v - m) / sd as z from fi join sc using (t_test, feature)),
 cv as (select t_test, feature, sum(z * (y - my)) as c from z where timepoint < t_test group by all),
 sco as (select t_test, vec_id, any_value(sensor) as sensor, any_value(timepoint) as timepoint, any_value(y) as y, any_value(my) as my, sum(z * c) as t from z join cv using (t_test, feature) group by all),
 q as (select t_test, sum(t * (y - my)) / sum(t * t) as q from sco where timepoint < t_test group by all)"""


@query(
    f"""with {A.MATRIX_LONG_SQL}, {_Z}
select sensor as channel, t_test, count(*) as n_test, round(sum((y - my - q.q * t) ** 2), 5) as sse, round(sum((y - my) ** 2), 5) as tss
from sco join q using (t_test) where timepoint = t_test group by all"""
)
def pls_one_component(spark, sf):
    """Every fold of a linear model with one component, which has a closed form."""
    d = _discover(spark, sf, [R.Condition("one", k_grid=(1,))])
    return d.select("channel", F.col("t_test").cast("long").alias("t_test"), "n_test", r6(F.col("sse"), 5).alias("sse"), r6(F.col("tss"), 5).alias("tss"))


@query(
    f"""with {A.MATRIX_LONG_SQL}, st as (select feature, median(value) as med from long where timepoint < 4 group by all),
 fi as (select long.*, coalesce(value, med) as v from long join st using (feature)),
 sc as (select feature, median(v) filter (where timepoint < 4) as m, (quantile_cont(v, 0.75) filter (where timepoint < 4)) - (quantile_cont(v, 0.25) filter (where timepoint < 4)) as iqr from fi group by all),
 z as (select vec_id, timepoint, y, feature, (v - m) / iqr as z from fi join sc using (feature)),
 av as (select feature, avg(z) as mz, avg(y) as my from z where timepoint < 4 group by all),
 cv as (select feature, sum((z - mz) * (y - my)) as c from z join av using (feature) where timepoint < 4 group by all),
 sco as (select vec_id, any_value(timepoint) as timepoint, any_value(y) as y, any_value(my) as my, sum((z - mz) * c) as t from z join cv using (feature) join av using (feature) group by vec_id),
 q as (select sum(t * (y - my)) / sum(t * t) as q from sco where timepoint < 4)
select vec_id, round(my + q.q * t, 6) as score from sco, q where timepoint >= 4"""
)
def freeze_one_component(spark, sf):
    """A model of one component frozen on early rows and applied to later ones."""
    m = A.matrix(spark, sf)
    model = R.freeze(m.where("timepoint < 4"), A.FEATURES, "y", R.Condition("frozen"), 1)
    return R.recalibrate(model, m.where("timepoint >= 4")).select("vec_id", r6(F.col("score")).alias("score"))


def _selected(name):
    def run(spark, sf):
        r = _discover(spark, sf, [R.Condition(name, "linear", selector=name, k_grid=(2, 3))])
        return R.selection_frequency(r)

    run.__name__ = f"{name.replace('+', '_')}_select"
    return run


for _name in ("vip", "sr", "smc", "mi", "icc", "cars", "icc+cars"):
    query()(_selected(_name))


def positive_matrix(spark, sf):
    """The matrix with positive features and responses, doses and repeatabilities, as the whole queue needs them."""
    m = A.matrix(spark, sf).withColumns({c: F.exp(F.col(c) / 4) for c in [*A.FEATURES, "y"]})
    return m.withColumn("concentration", F.lit(100.0) * (1 + F.col("vec_id") % 5)).withColumn("repeatability_snr", (1 + F.col("vec_id") % 7).cast("double"))


@query()
def discovery_ranking(spark, sf):
    """All conditions of the baseline queue."""
    return R.summarize(R.run_conditions(positive_matrix(spark, sf), A.FEATURES, "y", R.baseline_queue()))


@query()
def random_track(spark, sf):
    return E.pooled(_discover(spark, sf, [R.Condition("random", track="random")]), ["condition", "track"])


@query()
def fold_predictions(spark, sf):
    c = [R.Condition("channel", track="channel", k_grid=(1, 2)), R.Condition("universal", track="universal")]
    return R.predictions(_discover(spark, sf, c)).drop("concentration")


@query()
def ridge_loo(spark, sf):
    return R.grouped_cv(A.matrix(spark, sf), A.FEATURES, "y", [["sensor"]], "timepoint", "ridge").drop("pred")


@query()
def hierarchical_cv(spark, sf):
    """Devices of two sensors each, and sensors within them."""
    m = A.matrix(spark, sf).withColumn("device", F.expr("sensor div 2"))
    p = R.grouped_cv(m, A.FEATURES, "y", [["device"], ["device", "sensor"]], "timepoint", "ridge")
    r, b, n = ((F.col("y") - F.col(c)) for c in ("pred", "base_pred", "train_mean"))
    return p.agg(
        (1 - F.sum(r * r) / F.sum(n * n)).alias("q2"),
        (1 - F.sum(b * b) / F.sum(n * n)).alias("q2_fixed"),
        F.sqrt(F.avg(r * r)).alias("rmsep"),
        F.sqrt(F.avg(n * n)).alias("naive"),
    )


@query()
def drift_classifier_cv(spark, sf):
    m = A.matrix(spark, sf).withColumn("drifting", (F.col("y") > 1).cast("double"))
    p = R.grouped_cv(m, A.FEATURES, "drifting", [["sensor"]], "timepoint", "logistic")
    return E.auc(p, F.col("y") == 1, "pred").crossJoin(E.balanced_accuracy(p, F.col("y"), (F.col("pred") >= 0.5).cast("double")))


@query()
def freeze_and_recalibrate(spark, sf):
    m = A.matrix(spark, sf)
    model = R.freeze(m.where("timepoint < 4"), A.FEATURES, "y", R.Condition("frozen"), 3)
    return R.recalibrate(model, m.where("timepoint >= 4")).select("vec_id", "y", "score")


@query()
def coral_transform(spark, sf):
    filled = Z.scale(A.matrix(spark, sf), A.FEATURES, F.expr("timepoint < 3"), "impute")
    m = R.coral_transform(filled, A.FEATURES, F.expr("timepoint < 3"), F.expr("timepoint >= 3"))
    return m.select("vec_id", *A.FEATURES)


ARCHITECTURES = tuple(M.ARCHITECTURES)
