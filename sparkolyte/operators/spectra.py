"""Impedance spectra as array columns (freq, z_real, z_imag): gates, band choice and features, without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bind, clean, savgol

# Frequency sub-bands in Hz, half-open.
BANDS = {"LF": (10.0, 300.0), "MF": (300.0, 3000.0), "HF": (3000.0, 100000.0)}
BAND = (10.0, 1e5)


def in_band(df: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """freq, z_real, z_imag restricted to lo..hi and sorted by frequency, as an array of structs `pts`."""
    lo, hi = band
    zipped = F.arrays_zip(F.col("freq").alias("f"), F.col("z_real").alias("zr"), F.col("z_imag").alias("zi"))
    kept = F.filter(zipped, lambda p: (p["f"] >= lo) & (p["f"] <= hi))
    return df.withColumn("pts", F.array_sort(kept))


def _mag(p: Column) -> Column:
    return F.sqrt(p["zr"] * p["zr"] + p["zi"] * p["zi"])


def _steps(pts: Column) -> Column:
    """Pairs (a, b) of neighbours."""
    n = F.size(pts)
    return F.zip_with(F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def quality(df: DataFrame, band: tuple[float, float] = BAND, mono_tol: float = 0.05) -> DataFrame:
    """n_in_band, eis_a (capacitive), z_rise_max, eis_b (magnitude falls), eis_c (positive real part), eis_valid."""
    d = in_band(df, band)
    n = F.size("pts")
    rise = F.array_max(F.transform(_steps(F.col("pts")), lambda s: (_mag(s["b"]) - _mag(s["a"])) / F.greatest(_mag(s["a"]), F.lit(1e-12))))
    d = d.withColumn("n_in_band", n.cast("long")).withColumn("z_rise_max", rise)
    enough = F.col("n_in_band") >= 2
    d = (
        d.withColumn("eis_a", enough & F.forall("pts", lambda p: p["zi"] < 0))
        .withColumn("eis_b", enough & F.coalesce(F.col("z_rise_max") <= mono_tol, F.lit(False)))
        .withColumn("eis_c", enough & F.forall("pts", lambda p: p["zr"] > 0))
    )
    return d.withColumn("eis_valid", F.col("eis_a") & F.col("eis_b") & F.col("eis_c")).drop("pts")


def inductive_onset(freq: Column, z_imag: Column) -> Column:
    """The lowest frequency with a non-negative imaginary part, else NULL."""
    hit = F.filter(F.arrays_zip(freq.alias("f"), z_imag.alias("zi")), lambda p: p["zi"] >= 0)
    return F.array_min(F.transform(hit, lambda p: p["f"]))


def on_grid(freq: Column, grid: Column, rtol: float = 1e-3, atol: float = 1e-8) -> Column:
    """Same length and close to the reference grid everywhere."""
    near = F.zip_with(freq, grid, lambda f, g: F.abs(f - g) <= atol + rtol * F.abs(g))
    return (F.size(freq) == F.size(grid)) & F.forall(near, lambda x: x)


def reference_grid(df: DataFrame, by: list[str], order: list[str], band=BAND, mono_tol: float = 0.05) -> DataFrame:
    """by, grid: the frequencies of the first passing spectrum in order."""
    good = quality(df, band, mono_tol).where("eis_valid")
    good = in_band(good, band).withColumn("_grid", F.transform("pts", lambda p: p["f"]))
    return good.groupBy(*by).agg(F.min_by("_grid", F.struct(*order)).alias("grid"))


def recommended_band(df: DataFrame, lo: float = 10.0, default_hi: float = 1e5, percentile: float = 10.0) -> DataFrame:
    """One row (lo, hi, threshold): hi is the largest measured frequency below the onsets' percentile."""
    onset = df.withColumn("_on", inductive_onset(F.col("freq"), F.col("z_imag")))
    stat = F.min("_on") if percentile == 0 else F.percentile("_on", percentile / 100)
    threshold = onset.agg(stat.alias("threshold"))
    below = (
        df.select(F.explode("freq").alias("f"))
        .join(F.broadcast(threshold), F.col("f") < F.col("threshold"))
        .agg(F.max("f").alias("hi"))
    )
    # Two one-row tables.
    return threshold.crossJoin(below).select(
        F.lit(lo).alias("lo"),
        F.when(F.col("threshold").isNull(), F.lit(default_hi)).otherwise(F.coalesce("hi", "threshold")).alias("hi"),
        "threshold",
    )


def band_retention(df: DataFrame, uppers: list[float]) -> DataFrame:
    """Per upper edge: spectra dropped (onset at or below it), kept, kept share, and drop against the lowest edge."""
    onset = inductive_onset(F.col("freq"), F.col("z_imag"))
    edges = sorted(uppers)
    one = df.select(onset.alias("_on")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("_on") <= u).alias(f"d{i}") for i, u in enumerate(edges)],
    )
    rows = F.array(*[F.struct(F.lit(u).alias("upper"), F.col(f"d{i}").alias("dropped")) for i, u in enumerate(edges)])
    return one.select("n", F.col("d0").alias("_low"), F.inline(rows)).select(
        "upper",
        "dropped",
        (F.col("n") - F.col("dropped")).alias("kept"),
        (F.col("dropped") - F.col("_low")).alias("dropped_vs_lowest"),
        F.round(F.try_divide(F.col("n") - F.col("dropped"), F.col("n")), 3).alias("kept_frac"),
    )


def point_features(p: Column) -> dict[str, Column]:
    """Features of one point (f, zr, zi)."""
    w = 2 * math.pi * p["f"]
    z2 = p["zr"] * p["zr"] + p["zi"] * p["zi"]
    return {
        "R_s": p["zr"],
        "R_p": F.try_divide(z2, p["zr"]),
        "C_s": F.try_divide(F.lit(-1.0), w * p["zi"]),
        "C_p": F.try_divide(-p["zi"], w * z2),
        "ideality_C": F.try_divide(p["zi"] * p["zi"], z2),
        "tau": F.try_divide(-p["zi"], w * p["zr"]),
    }


def with_features(df: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Adds feats: an array of structs (f, zr, zi, R_s, R_p, C_s, C_p, ideality_C, tau, x = log10 f)."""
    d = in_band(df, band)
    return d.withColumn(
        "feats",
        F.transform(
            "pts",
            lambda p: F.struct(
                p["f"].alias("f"), p["zr"].alias("zr"), p["zi"].alias("zi"), F.log10(p["f"]).alias("x"), *[c.alias(n) for n, c in point_features(p).items()]
            ),
        ),
    )


def local_n(df: DataFrame, band: tuple[float, float] = BAND, smooth: bool = False) -> DataFrame:
    """Adds local_n: minus the gradient of log10 magnitude over log10 frequency, second order inside, one-sided at the ends.

    smooth: over 7 points at most, from 5 on, before the gradient.
    """
    d = in_band(df, band)
    level = F.transform("pts", lambda p: F.log10(_mag(p)))
    level = savgol(level, 7, 2, 5) if smooth else level
    points = F.zip_with("pts", level, lambda p, y: F.struct(F.log10(p["f"]).alias("x"), y.alias("y")))

    def gradient(q: Column) -> Column:
        n = F.size(q)

        def slope(p: Column, i: Column) -> Column:
            before, after = F.get(q, i - 1), F.get(q, i + 1)
            hs, hd = p["x"] - before["x"], after["x"] - p["x"]
            inner = (hs * hs * after["y"] + (hd * hd - hs * hs) * p["y"] - hd * hd * before["y"]) / (hs * hd * (hd + hs))
            ends = F.when(i == 0, (after["y"] - p["y"]) / hd).when(i == n - 1, (p["y"] - before["y"]) / hs)
            return -ends.otherwise(inner)

        return F.when(n >= 2, F.transform(q, slope)).otherwise(F.array().cast("array<double>"))

    return d.withColumn("local_n", bind(points, gradient))


def _trapezoid(name: str) -> Column:
    parts = F.transform(_steps(F.col("feats")), lambda s: (s["a"][name] + s["b"][name]) / 2 * (s["b"]["x"] - s["a"]["x"]))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def integrals(df: DataFrame, band=BAND) -> DataFrame:
    """R_s, R_p, C_s, C_p integrated over log10 frequency."""
    d = with_features(df, band)
    return d.withColumns({f"{n}_integral": _trapezoid(n) for n in ("R_s", "R_p", "C_s", "C_p")}).drop("pts", "feats")


def _mean(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def _between(lo: float, hi: float):
    return lambda p: (p["f"] >= lo) & (p["f"] < hi)


def band_means(df: DataFrame, band=BAND, smooth: bool = False) -> DataFrame:
    """Mean ideality_C and local_n in each sub-band, NULL where it is empty."""
    d = local_n(df, band, smooth)
    points = F.zip_with("pts", "local_n", lambda p, n: F.struct(p["f"].alias("f"), point_features(p)["ideality_C"].alias("c"), n.alias("n")))
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("c"), F.lit(0.0).alias("n"))

    def means(z: Column) -> Column:
        out = []
        for name, (lo, hi) in BANDS.items():
            inside = F.filter(z, _between(lo, hi))
            add = lambda s, p: F.struct((s["k"] + 1).alias("k"), (s["c"] + p["c"]).alias("c"), (s["n"] + p["n"]).alias("n"))
            one = lambda s: F.struct(F.try_divide(s["c"], s["k"]).alias("c"), F.try_divide(s["n"], s["k"]).alias("n"))
            out.append(F.aggregate(inside, start, add, one).alias(name))
        return F.struct(*out)

    d = d.withColumn("_means", bind(points, means))
    cols = {}
    for name in BANDS:
        cols[f"ideality_C_band_{name}"] = F.col(f"_means.{name}.c")
        cols[f"n_band_{name}"] = F.col(f"_means.{name}.n")
    return d.withColumns(cols).drop("pts", "local_n", "_means")


def crossover(df: DataFrame, level: float = 0.5, band=BAND) -> DataFrame:
    """f_ideality_crossover: first change of sign of ideality_C - level, on log frequency; without one the top or bottom frequency."""
    d = with_features(df, band)
    y = lambda p: p["ideality_C"] - level
    first = F.get(F.filter(_steps(F.col("feats")), lambda s: F.signum(y(s["a"])) != F.signum(y(s["b"]))), F.lit(0))
    at = first["a"]["x"] + (first["b"]["x"] - first["a"]["x"]) * F.try_divide(-y(first["a"]), y(first["b"]) - y(first["a"]))
    mean = _mean(F.transform("feats", lambda p: p["ideality_C"]))
    freqs = F.transform("feats", lambda p: p["f"])
    none = F.when(mean > level, F.array_max(freqs)).otherwise(F.array_min(freqs))
    return d.withColumn("_first", first).withColumn("f_ideality_crossover", F.when(F.col("_first").isNotNull(), F.pow(F.lit(10.0), at)).otherwise(none)).drop("pts", "feats", "_first")


def tau_ratio(df: DataFrame, band=BAND) -> DataFrame:
    d = with_features(df, band)
    return d.withColumn("tau_ratio", F.try_divide(F.get("feats", F.lit(0))["tau"], F.try_element_at("feats", F.lit(-1))["tau"])).drop("pts", "feats")


def phase_and_onset(df: DataFrame) -> DataFrame:
    """min_neg_phase over the whole spectrum and inductive_onset_hz, the top frequency where there is none."""
    zipped = F.arrays_zip(F.col("z_imag").alias("zi"), F.col("z_real").alias("zr"))
    phase = F.array_min(F.transform(zipped, lambda p: -F.degrees(F.atan2(p["zi"], p["zr"]))))
    onset = F.coalesce(inductive_onset(F.col("freq"), F.col("z_imag")), F.array_max("freq"))
    return df.withColumn("min_neg_phase", phase).withColumn("inductive_onset_hz", onset)


def average_replicates(df: DataFrame, keys: list[str], rep: str = "rep") -> DataFrame:
    """Element-wise mean over replicates on the first replicate's grid."""
    first = df.groupBy(*keys).agg(F.min_by("freq", rep).alias("freq"))
    long = df.select(*keys, F.posexplode(F.arrays_zip("z_real", "z_imag")).alias("pos", "z")).groupBy(*keys, "pos")
    means = long.agg(F.avg("z.z_real").alias("zr"), F.avg("z.z_imag").alias("zi"))
    arrays = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "zr", "zi"))).alias("m"))
    return first.join(arrays, keys).select(*keys, "freq", F.col("m.zr").alias("z_real"), F.col("m.zi").alias("z_imag"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL inside the arrays."""
    return df.withColumns({c: F.transform(c, clean) for c in ("freq", "z_real", "z_imag")})
