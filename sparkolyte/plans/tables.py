"""Review tables: what figures of a featureset, of raw exports and of stabilization runs would show, as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..functions.stats import clean
from ..operators import diagnostics as G
from ..operators import dose as D
from ..operators import fits as T
from ..operators import quality_control as C
from ..operators import spectra as S
from ..operators import waveforms as V
from ..sources import raw
from ..sources.artifacts import AnalysisConfig
from . import extract as X
from . import review

VISIT = ["device", "channel", "timepoint"]
#: Rows that an alignment needs at least.
LEAST = 4


def label(timepoint: Column) -> Column:
    """D and the whole number of days."""
    return F.concat(F.lit("D"), timepoint.cast("long").cast("string"))


def feature_kind(feature: Column) -> Column:
    return F.regexp_replace(feature, r"_f\d+$", "")


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, feature, value."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keep, features, "feature", "value")


# ---- featuresets


def constant_per_visit(df: DataFrame, features: list[str], visit: list[str] = VISIT) -> DataFrame:
    """feature, constant: whether it has one value at most, a missing one counting as none, at every visit."""
    long = long_form(df, features, visit)
    per = long.groupBy("feature", *visit).agg((F.min(clean(F.col("value"))) < F.max(clean(F.col("value")))).alias("varies"))
    return per.groupBy("feature").agg((~F.coalesce(F.bool_or("varies"), F.lit(False))).alias("constant"))


def samples(df: DataFrame, features: list[str], visit: list[str] = VISIT) -> DataFrame:
    """feature, unit, value: a row per visit for features that are constant there, else per row of df."""
    long = long_form(df, features, visit)
    flags = constant_per_visit(df, features, visit)
    once = long.groupBy("feature", *visit).agg(F.max(clean(F.col("value"))).alias("value")).join(flags.where("constant"), "feature")
    rows = long.join(flags.where("not constant"), "feature")
    pick = lambda d, unit: d.select("feature", F.lit(unit).alias("unit"), clean(F.col("value")).alias("value"))
    return pick(once, "visits").unionByName(pick(rows, "rows")).where("value is not null")


def distributions(rows: DataFrame, bins: int = 40) -> DataFrame:
    """feature, unit, n, mean, median, sd and counts of bins of equal width from the least to the largest value."""
    keys = ["feature", "unit"]
    g = rows.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.stddev_pop("value").alias("sd"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    return g.join(histograms(rows, bins).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("bins")), keys)


def histograms(rows: DataFrame, bins: int = 40, keys: tuple[str, ...] = ("feature", "unit")) -> DataFrame:
    """keys, bin (from 0), count of the bins that hold something."""
    ends = rows.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    at = F.floor(F.try_divide(F.col("value") - F.col("_low"), F.col("_high") - F.col("_low")) * bins)
    d = rows.join(ends, list(keys)).withColumn("bin", F.coalesce(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("long"))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))


def spread_out(n: int, most: int = 6) -> list[int]:
    """At most so many of n positions, evenly from the first to the last."""
    return sorted({round(x) for x in np.linspace(0, n - 1, min(n, most)).tolist()}) if n else []


def points(df: DataFrame, feature: str) -> DataFrame:
    """device, channel, timepoint, concentration, value of one feature."""
    return df.select("device", "channel", "timepoint", "concentration", clean(F.col(feature)).alias("value")).where("value is not null")


def drift_by_type(drift: DataFrame) -> DataFrame:
    """type, n, median_R_drift, median_snr, the most reliable first. drift: feature, R_drift, snr."""
    g = drift.where("R_drift is not null").groupBy(feature_kind(F.col("feature")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.median("R_drift").alias("median_R_drift"), F.median("snr").alias("median_snr")
    )
    return g.orderBy(F.col("median_R_drift").desc(), "type")


def quality_map(drift: DataFrame, alignment: DataFrame, shares: DataFrame) -> DataFrame:
    """feature, type, R_drift, alignment, within_time: is the drift real, does it follow the response, how much is it."""
    d = drift.where("R_drift is not null").select("feature", "R_drift").join(alignment.where("alignment is not null").select("feature", "alignment"), "feature")
    d = d.join(shares.select("feature", "within_time"), "feature", "left")
    return d.select("feature", feature_kind(F.col("feature")).alias("type"), "R_drift", "alignment", F.coalesce("within_time", F.lit(0.0)).alias("within_time"))


def rank_targets(table: DataFrame) -> DataFrame:
    """target_admissibility's rows, admissible ones first, then by cv, missing last."""
    return table.orderBy(F.col("admissible").desc_nulls_last(), F.col("cv").desc_nulls_last(), "target")


def response_modes(df: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """response, level, shares of variance and, with noise (feature, sigma2_meas), the drift's reliability.

    Response columns row by row, and slope, intercept and curvature of each sensor's visits.
    """
    named = df.withColumn("sensor", F.concat_ws(":", F.col("device").cast("string"), F.col("channel").cast("string")))
    own = [c for c in ("NormIpeak", "peak_height", "mean_Ibg", "peak_area", "peak_fwhm") if c in df.columns]
    per_dose = long_form(named, own, ["sensor", "timepoint"]).withColumn("level", F.lit("dose"))
    curves = D.sensitivity(named.withColumnRenamed("NormIpeak", "response"), ["sensor", "timepoint"])
    curves = curves.select("sensor", "timepoint", F.col("slope").alias("sensitivity"), F.col("intercept").alias("sensitivity_intercept"), F.col("curvature").alias("sensitivity_curvature"))
    per_visit = long_form(curves, ["sensitivity", "sensitivity_intercept", "sensitivity_curvature"], ["sensor", "timepoint"]).withColumn("level", F.lit("visit"))
    rows = per_dose.unionByName(per_visit).where(clean(F.col("value")).isNotNull())
    level = rows.groupBy("feature").agg(F.max("level").alias("level"), F.count(F.lit(1)).alias("n")).where("level = 'dose' or n >= 3")
    table = level.join(G.variance_hierarchy(rows.drop("level")), "feature")
    drift = spark_empty_drift(df) if noise is None else G.drift_reliability(per_dose.drop("level"), noise)
    table = table.join(drift.select("feature", "R_drift", "snr"), "feature", "left")
    return table.select(F.col("feature").alias("response"), "level", "between_channel", "within_time", F.col("residual").alias("within_dose"), "R_drift", F.col("snr").alias("drift_snr"))


def spark_empty_drift(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "feature string, R_drift double, snr double")


def bandwidth(eis: DataFrame, rows: DataFrame, method: str = "pearson") -> tuple[DataFrame, DataFrame]:
    """What a band's upper edge costs and gives: (upper, kept...), and (type, frequency, alignment, n_groups).

    eis: replicate-averaged spectra (device, channel, timepoint, freq, z_real, z_imag); rows: device, channel,
    timepoint, concentration, NormIpeak. Frequencies are matched by their place on the commonest grid.
    """
    grid = eis.groupBy("freq").count().orderBy(F.col("count").desc(), F.size("freq").desc()).first()
    freqs = sorted(grid.freq) if grid else []
    wide = (min(freqs, default=0.0), max(freqs, default=0.0))
    on = eis.where(S.on_grid(F.array_sort("freq"), F.array(*[F.lit(f) for f in freqs]))) if freqs else eis.limit(0)
    full = S.local_n(S.with_features(on, wide), wide, smooth=True)
    zipped = F.zip_with("feats", "local_n", lambda p, n: F.struct(p.alias("p"), n.alias("local_n")))
    long = full.select(*VISIT, F.posexplode(zipped).alias("i", "z"))
    values = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"z.p.{t}").alias("value")) for t in X.TYPES[:-1]], F.struct(F.lit("local_n").alias("type"), F.col("z.local_n").alias("value")))
    long = long.select(*VISIT, "i", F.col("z.p.f").alias("frequency"), F.inline(values))
    sensor = F.concat_ws(":", F.col("device").cast("string"), F.col("channel").cast("string"))
    joined = rows.select(*VISIT, "concentration", F.col("NormIpeak").alias("response"), sensor.alias("sensor")).join(long, VISIT, "left").where("i is not null")
    joined = joined.withColumn("feature", F.concat_ws("@", "type", "i"))
    finite = joined.where(clean(F.col("value")).isNotNull() & clean(F.col("response")).isNotNull())
    enough = finite.groupBy("feature", "type", "i").agg(F.count(F.lit(1)).alias("n"), F.min("frequency").alias("frequency")).where(F.col("n") >= LEAST)
    aligned = G.drift_alignment(finite, method=method).join(enough, "feature")
    return S.band_retention(eis, freqs), aligned.select("type", F.col("i").cast("long").alias("i"), "frequency", "alignment", "n_groups")


def verdict(shares: DataFrame, drift: DataFrame, alignment: DataFrame) -> list[str]:
    """Lines that sum up the tables of a featureset."""
    s = shares.agg(*[F.median(c).alias(c) for c in ("between_channel", "within_time", "residual")]).first()
    d = drift.agg(F.avg((F.col("R_drift") > 0.5).cast("double")).alias("real"), F.avg((F.col("snr") > 1).cast("double")).alias("above")).first()
    a = alignment.agg(F.max(F.abs("alignment")).alias("top"), F.count("alignment").alias("n")).first()
    show = lambda x: "n/a" if x is None else f"{x:.2f}"
    return [
        f"median shares: between sensors {show(s.between_channel)}, within time {show(s.within_time)}, within dose {show(s.residual)}",
        f"drift above noise: R_drift > 0.5 for {show(d.real)}, signal over noise > 1 for {show(d.above)} of the features",
        f"largest |alignment| of {a.n} features: {show(a.top)}; {'a feature follows' if (a.top or 0) > 0.5 else 'no feature follows'} the response",
    ]


# ---- raw exports

_REPLICATE = (
    "device string, date date, channel int, concentration double, rep int, v_peak double, raw_ipeak double, bgsub_ipeak double, "
    "normipeak double, voltage array<double>, bgsub array<double>, norm array<double>"
)


def _replicates(config: AnalysisConfig):
    """Every replicate of every dose against the session's background: peak readouts and traces."""
    columns = [c.split()[0] for c in _REPLICATE.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        smooth = lambda i: N.savgol(i, config.smooth_window, config.smooth_poly) if config.smooth_window else np.asarray(i, float)
        background = X._mean_cycles(pdf[pdf.dose_nm == 0], config.max_reps)
        rows = []
        if background is None:
            return pd.DataFrame(columns=columns)
        bg = background[0], smooth(background[1])
        for (dose, rep), c in pdf[pdf.dose_nm > 0].sort_values(["dose_nm", "rep"]).groupby(["dose_nm", "rep"]):
            v, i = np.asarray(c.voltage.iloc[0], float), smooth(c.current.iloc[0])
            b = N.align_background(v, *bg)
            x, y, b, i = N.anodic(v, i - b, b, i)
            p = X._peak(x, y, b, config) or {}
            at = int(np.argmin(np.abs(x - p["mean_Vpeak"]))) if p else -1
            with np.errstate(divide="ignore", invalid="ignore"):
                norm = np.where(b != 0, y / b, np.nan)
            own = [pdf.device.iloc[0], pdf.date.iloc[0], pdf.channel.iloc[0], float(dose), int(rep)]
            rows.append([*own, p.get("mean_Vpeak"), float(i[at]) if p else None, p.get("peak_height"), p.get("NormIpeak"), x, y, norm])
        return pd.DataFrame(rows, columns=columns)

    return run


class RawReview:
    """Tables over a raw tree's signal sessions; each method gives rows that can be filtered by device and timepoint."""

    def __init__(self, spark: SparkSession, root: str, config: AnalysisConfig | None = None, devicetypes: list[str] | None = None):
        self.config = config or AnalysisConfig()
        self.files = raw.signal_sessions(raw.session_files(spark, root), devicetypes)
        # The first file by path where a session has several of a kind.
        kind = ["device", "date", "signaltype", "dose_nm", "token"]
        self.files = self.files.withColumn("_k", F.row_number().over(W.partitionBy(*kind).orderBy("path"))).where("_k = 1").drop("_k")
        eis, fscv = raw.tables(raw.once(raw.read_blocks(spark, root, files=self.files)))
        when = self.files.select("path", "timepoint")
        self.eis, self.fscv = eis.join(when, "path"), fscv.join(when, "path")

    def describe(self) -> str:
        c = self.config
        return f"band {c.band}, peak {c.peak_method}, smoothing {c.smooth_window}/{c.smooth_poly}, replicates {c.max_reps}, SNR from {c.min_norm_snr}"

    def select(self, df: DataFrame, devices: list[str] | None = None, timepoints: list[int] | None = None) -> DataFrame:
        df = df.where(F.col("device").isin(devices)) if devices else df
        return df.where(F.col("timepoint").isin(timepoints)) if timepoints else df

    def available(self) -> DataFrame:
        """devicetype, device, date, timepoint, sorted channels with spectra and with waveforms, doses."""
        keys = ["devicetype", "device", "date", "timepoint"]
        a = self.eis.groupBy(*keys).agg(F.array_sort(F.collect_set("channel")).alias("eis_channels"))
        b = self.fscv.groupBy(*keys).agg(F.array_sort(F.collect_set("channel")).alias("fscv_channels"), F.array_sort(F.collect_set("dose_nm")).alias("doses"))
        return a.join(b, keys, "full_outer").withColumn("label", label(F.col("timepoint")))

    def channels(self, kind: str) -> DataFrame:
        """device, timepoint, channel with spectra ("eis") or waveforms ("fscv")."""
        return {"eis": self.eis, "fscv": self.fscv}[kind].select("device", "timepoint", "channel").distinct()

    def doses(self, zero: bool = False) -> DataFrame:
        d = self.fscv.where("dose_nm is not null").select("device", F.col("dose_nm").alias("concentration")).distinct()
        return d if zero else d.where("concentration > 0")

    def eis_full(self) -> DataFrame:
        """Replicate-averaged spectra over all frequencies."""
        return S.average_replicates(self.eis, ["devicetype", "device", "date", "timepoint", "channel"])

    def replicates(self) -> DataFrame:
        """Peak readouts and traces of every replicate and dose."""
        cycles = self.fscv.where("dose_nm is not null").select("device", "date", "channel", "dose_nm", "rep", "voltage", "current")
        found = cycles.groupBy("device", "date", "channel").applyInPandas(_replicates(self.config), _REPLICATE)
        return found.join(self.files.select("device", "date", "timepoint", "devicetype").distinct(), ["device", "date"])

    def onset_table(self) -> DataFrame:
        """The first inductive frequency of each averaged spectrum."""
        onset = S.inductive_onset(F.col("freq"), F.col("z_imag"))
        return self.eis_full().select("devicetype", "device", "date", label(F.col("timepoint")).alias("timepoint"), "channel", onset.alias("inductive_onset_hz"))

    def eis_spread_table(self, frequencies: list[float] | None = None) -> DataFrame:
        """Mean and spread of the replicates at each frequency; with frequencies given, those as columns."""
        point = F.arrays_zip(F.col("freq").alias("f"), F.col("z_real").alias("r"), F.col("z_imag").alias("i"))
        keys = ["device", "date", label(F.col("timepoint")).alias("timepoint"), "channel"]
        long = self.eis.select(*keys, F.explode(point).alias("p")).select("device", "date", "timepoint", "channel", F.round("p.f", 3).alias("frequency"), "p.r", "p.i")
        names = ["device", "date", "timepoint", "channel"]
        stats = {"zr_mean": (F.avg, "r", 2), "zr_std": (F.stddev_pop, "r", 3), "zi_mean": (F.avg, "i", 2), "zi_std": (F.stddev_pop, "i", 3)}
        if frequencies is None:
            return long.groupBy(*names, "frequency").agg(*[F.round(f(c), d).alias(n) for n, (f, c, d) in stats.items()])
        at = lambda c, f: F.when(F.col("frequency") == round(f, 3), F.col(c))
        return long.groupBy(*names).agg(*[F.round(g(at(c, f)), d).alias(f"{n}_{f:g}") for f in frequencies for n, (g, c, d) in stats.items()])

    def dose_stats_table(self) -> DataFrame:
        """Mean and spread over replicates of peak voltage, raw, subtracted and normalized peak current."""
        of = {"v_peak": 3, "raw_ipeak": 3, "bgsub_ipeak": 3, "normipeak": 4}
        d = self.replicates().where(clean(F.col("normipeak")).isNotNull())
        aggs = [F.round(f(c), n).alias(f"{c}_{s}") for c, n in of.items() for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
        return d.groupBy("device", "date", "timepoint", "channel", "concentration").agg(*aggs).withColumn("timepoint", label(F.col("timepoint")))

    def edge_pinning_table(self) -> DataFrame:
        """Per dose, how many channels' mean peak lies at the lower or upper end of the window, and which."""
        return edge_pinning(self.replicates().where("v_peak is not null").groupBy("device", "channel", "timepoint", "concentration").agg(F.avg("v_peak").alias("v_peak")), self.config.edge_tol)

    def over_time(self, kind: str = "norm") -> DataFrame:
        """device, channel, concentration, timepoint, mean, std, n of the normalized peak, its voltage, or its SNR."""
        value = {"norm": "normipeak", "vpeak": "v_peak", "snr": "normipeak"}[kind]
        keys = ["device", "channel", "concentration", "timepoint"]
        g = self.replicates().where(clean(F.col(value)).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
        if kind == "snr":
            return g.where("n >= 2 and std > 0").select(*keys, (F.col("mean") / F.col("std")).alias("snr"))
        return g


def edge_pinning(peaks: DataFrame, tol: float = V.EDGE_TOL, window: tuple[float, float] = V.PEAK_WINDOW) -> DataFrame:
    """concentration, n, counts and percentages at either end, and the channels there. peaks: VISIT, concentration, v_peak."""
    low, high = F.col("v_peak") <= window[0] + tol, F.col("v_peak") >= window[1] - tol
    name = F.concat_ws(" ", F.col("device").cast("string"), F.concat(F.lit("ch"), F.col("channel").cast("string")), label(F.col("timepoint")))
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    return peaks.groupBy("concentration").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(low).alias("n_lower"),
        share(low).alias("lower_pct"),
        F.count_if(high).alias("n_upper"),
        share(high).alias("upper_pct"),
        F.count_if(low | high).alias("n_any"),
        share(low | high).alias("any_pct"),
        F.array_sort(F.collect_list(F.when(low | high, name))).alias("where"),
    )


# ---- stabilization

#: Phases, the one that tells most first.
PHASES = ("full", "end", "start")


class StabilizationReview:
    """Tables over a raw tree's stabilization runs."""

    def __init__(self, spark: SparkSession, root: str, target: float = 0.7, cycles_per_round: int = 20, tol: float = 0.01, patience: int = 10, smooth: int = 5, drop_cold: bool = True):
        self.target, self.cycles_per_round, self.tol, self.patience, self.smooth, self.drop_cold = target, cycles_per_round, tol, patience, smooth, drop_cold
        self.traces = raw.once(review.stabilization(spark, root, target, cycles_per_round))
        first = raw.session_files(spark, root).groupBy("device").agg(F.min("date").alias("d0"))
        self.when = first

    def describe(self) -> str:
        return f"current at {self.target} V, {self.cycles_per_round} cycles a round, tolerance {self.tol} for {self.patience} rounds, smoothed over {self.smooth}"

    def _timed(self, df: DataFrame) -> DataFrame:
        return df.join(self.when, "device").withColumn("timepoint", label(F.datediff("date", "d0"))).drop("d0")

    def available(self) -> DataFrame:
        """device, date, timepoint, phases."""
        g = self.traces.groupBy("device", "date").agg(F.concat_ws(", ", F.array_sort(F.collect_set("phase"))).alias("phases"))
        return self._timed(g)

    def chosen(self) -> DataFrame:
        """Traces to show: the full run where there is one, else its end and its start."""
        full = F.max(F.col("phase") == "full").over(W.partitionBy("device", "date"))
        return self.traces.withColumn("_full", full).where((F.col("phase") == "full") | ~F.col("_full")).drop("_full")

    def at_target(self) -> DataFrame:
        """device, date, phase, channel, cycle, i_target."""
        return self.chosen().select("device", "date", "phase", "channel", "cycle", "i_target")

    def round_edges(self) -> DataFrame:
        """The last cycle of the first round and of the last round of each channel, with its number from 1 on."""
        order = F.when(F.col("phase") == "end", 1).otherwise(0)
        d = self.chosen().withColumn("_o", order)
        keys = ["device", "date", "channel"]
        first = F.min(F.struct("_o", "round")).over(W.partitionBy(*keys))
        last = F.max(F.struct("_o", "round")).over(W.partitionBy(*keys))
        d = d.withColumn("_first", first).withColumn("_last", last).withColumn("_at", F.struct("_o", "round"))
        edge = F.when(F.col("_at") == F.col("_first"), "first").when(F.col("_at") == F.col("_last"), "last")
        d = d.withColumn("edge", edge).where("edge is not null")
        keep = F.row_number().over(W.partitionBy(*keys, "edge").orderBy(F.col("in_round").desc()))
        return d.withColumn("_k", keep).where("_k = 1").select(*keys, "phase", "edge", "round", (F.col("cycle") + 1).alias("cycle_no"), "voltage", "current")

    def round_drift(self) -> DataFrame:
        """device, date, phase, channel, round, drift between the rounds' mean waveforms."""
        keys = ["device", "date", "phase", "channel"]
        d = self.chosen()
        d = d.where("in_round > 0") if self.drop_cold else d
        return C.cycle_drift(C.round_means(d, keys, "round", "current"), keys, "round", "current")

    def convergence_table(self) -> DataFrame:
        """device, date, timepoint, channel, phase, settle_tau, final_drift, n_stable, converged."""
        keys = ["device", "date", "phase", "channel"]
        drift = self.round_drift()
        settled = C.converged(drift, keys, "round", "drift", self.tol, self.patience, self.smooth)
        smooth = C.moving_average(drift, keys, "round", "drift", self.smooth).groupBy(*keys).agg(F.max_by("smooth", "round").alias("final_drift"))
        tau = T.settle_tau(drift, keys, "round", "drift")
        d = settled.join(smooth, keys).join(tau, keys, "left")
        rank = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
        best = F.row_number().over(W.partitionBy("device", "date", "channel").orderBy(F.when(rank == 0, 99).otherwise(rank)))
        d = d.withColumn("_k", best).where("_k = 1")
        return self._timed(d).select("device", "date", "timepoint", "channel", "phase", F.round("tau", 1).alias("settle_tau"), F.round("final_drift", 5).alias("final_drift"), F.col("trailing").alias("n_stable"), "converged")
