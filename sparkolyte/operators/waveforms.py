"""Voltammograms as array columns (voltage, current, background): sweeps, peaks, noise and shape, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Voltage windows and tolerances.
DA_WINDOW = (0.6, 0.8)
PEAK_WINDOW = (0.4, 1.0)
NONFARADAIC = (0.0, 0.3)
BASELINE = (-0.1, 0.2)
EDGE_TOL = 0.03
CLIP = 0.5
SAVGOL_WINDOW, SAVGOL_POLY = 11, 2


def _arg(values: Column, best) -> Column:
    """Index of the first extreme value, from 0."""
    return F.array_position(values, best(values)).cast("int") - 1


def anodic(df: DataFrame, *columns: str, voltage: str = "voltage") -> DataFrame:
    """The arrays cut to the part between the voltage's minimum and maximum, rising."""
    i, j = _arg(F.col(voltage), F.array_min), _arg(F.col(voltage), F.array_max)
    d = df.withColumn("_i", i).withColumn("_j", j)
    size = F.abs(F.col("_i") - F.col("_j")) + 1
    for c in (voltage, *columns):
        piece = F.slice(c, F.least("_i", "_j") + 1, size)
        d = d.withColumn(f"_{c}", F.when(F.col("_i") > F.col("_j"), F.reverse(piece)).otherwise(piece))
    return d.drop(voltage, *columns, "_i", "_j").withColumnsRenamed({f"_{c}": c for c in (voltage, *columns)})


def subtract_background(df: DataFrame) -> DataFrame:
    """Adds bg_sub for signals on the background's own grid; see numerics.align_background for others."""
    return df.withColumn("bg_sub", F.zip_with("current", "background", lambda s, b: s - b))


def detrend(df: DataFrame, window: tuple[float, float] = BASELINE) -> DataFrame:
    """bg_sub less the least-squares line over the window; unchanged with fewer than two points."""
    inside = F.filter(F.arrays_zip(F.col("voltage").alias("v"), F.col("bg_sub").alias("y")), lambda p: (p["v"] >= window[0]) & (p["v"] <= window[1]))
    d = df.withColumn("_w", inside)
    total = lambda f: F.aggregate(F.transform("_w", f), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("_n", F.size("_w")).withColumn("_sx", total(lambda p: p["v"])).withColumn("_sy", total(lambda p: p["y"]))
    d = d.withColumn("_sxx", total(lambda p: p["v"] * p["v"])).withColumn("_sxy", total(lambda p: p["v"] * p["y"]))
    slope = F.try_divide(F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx"))
    d = d.withColumn("_b", slope).withColumn("_a", F.try_divide(F.col("_sy") - F.col("_b") * F.col("_sx"), F.col("_n")))
    line = F.zip_with("bg_sub", "voltage", lambda y, v: y - F.col("_a") - F.col("_b") * v)
    return d.withColumn("bg_sub", F.when((F.col("_n") >= 2) & F.col("_b").isNotNull(), line).otherwise(F.col("bg_sub"))).drop("_w", "_n", "_sx", "_sy", "_sxx", "_sxy", "_a", "_b")


def _window(window: tuple[float, float]) -> Column:
    zipped = F.arrays_zip(F.col("voltage").alias("v"), F.col("bg_sub").alias("y"), F.col("background").alias("b"))
    indexed = F.transform(zipped, lambda p, i: F.struct(i.alias("i"), p["v"].alias("v"), p["y"].alias("y"), p["b"].alias("b")))
    return F.filter(indexed, lambda p: (p["v"] >= window[0]) & (p["v"] <= window[1]))


def locate_peak(df: DataFrame, window: tuple[float, float] = PEAK_WINDOW, method: str = "direct", require_interior: bool = False) -> DataFrame:
    """Adds peak (idx, v_ox, height, i_bgd, norm_ipeak): the first maximum in the window, of the current or above its chord."""
    if method not in ("direct", "chord"):
        raise ValueError(f"unknown peak method {method!r}")
    d = df.withColumn("_w", _window(window))
    n = F.size("_w")
    if method == "chord":
        a, b = F.get("_w", F.lit(0)), F.get("_w", n - 1)
        rise = F.try_divide(b["y"] - a["y"], b["v"] - a["v"])
        score = lambda p: p["y"] - (a["y"] + F.coalesce(rise, F.lit(0.0)) * (p["v"] - a["v"]))
    else:
        score = lambda p: p["y"]
    best = F.array_max(F.transform("_w", lambda p: F.struct(score(p).alias("s"), (-p["i"]).alias("k"))))
    d = d.withColumn("_k", F.when(n >= 2, -best["k"]))
    if require_interior:
        edge = (F.col("_k") == F.get("_w", F.lit(0))["i"]) | (F.col("_k") == F.get("_w", n - 1)["i"])
        d = d.withColumn("_k", F.when(~edge, F.col("_k")))
    height, bg = F.get("bg_sub", F.col("_k")), F.get("background", F.col("_k"))
    peak = F.struct(
        F.col("_k").alias("idx"),
        F.get("voltage", F.col("_k")).alias("v_ox"),
        height.alias("height"),
        bg.alias("i_bgd"),
        F.try_divide(height, bg).alias("norm_ipeak"),
    )
    return d.withColumn("peak", F.when(F.col("_k").isNotNull(), peak)).drop("_w", "_k")


def peak_at_edge(v_ox: Column, window: tuple[float, float] = PEAK_WINDOW, tol: float = EDGE_TOL) -> Column:
    return F.coalesce((v_ox <= window[0] + tol) | (v_ox >= window[1] - tol), F.lit(False))


def peak_edge_clipped(df: DataFrame, window: tuple[float, float] = PEAK_WINDOW, clip: float = CLIP) -> DataFrame:
    """Adds peak_edge_clipped: an end of the window reaches half the peak's height."""
    d = df.withColumn("_w", _window(window))
    ends = (F.get("_w", F.lit(0))["y"], F.get("_w", F.size("_w") - 1)["y"])
    hit = (ends[0] >= clip * F.col("peak.height")) | (ends[1] >= clip * F.col("peak.height"))
    return d.withColumn("peak_edge_clipped", F.coalesce(hit, F.lit(False))).drop("_w")


def noise_floor(df: DataFrame, window: tuple[float, float] = NONFARADAIC) -> DataFrame:
    """Adds noise_floor: RMS of the relative difference from the background over the window, zero backgrounds left out."""
    zipped = F.arrays_zip(F.col("voltage").alias("v"), F.col("current").alias("s"), F.col("background").alias("b"))
    kept = F.filter(zipped, lambda p: (p["v"] >= window[0]) & (p["v"] <= window[1]) & (p["b"] != 0))
    square = F.transform(kept, lambda p: F.pow(F.try_divide(p["s"] - p["b"], p["b"]), F.lit(2.0)))
    d = df.withColumn("_q", square)
    total = F.aggregate("_q", F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("noise_floor", F.when(F.size("_q") > 0, F.sqrt(total / F.size("_q")))).drop("_q")


def peak_shape(df: DataFrame, window: tuple[float, float] = PEAK_WINDOW) -> DataFrame:
    """Adds peak_area (positive lobe over the window) and peak_fwhm (NULL unless the peak is positive and both sides fall to half its height)."""
    d = df.withColumn("_w", _window(window))
    n = F.size("_w")
    lobes = F.zip_with(
        F.slice("_w", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("_w", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: (F.greatest(a["y"], F.lit(0.0)) + F.greatest(b["y"], F.lit(0.0))) / 2 * (b["v"] - a["v"]),
    )
    area = F.when(n >= 2, F.aggregate(lobes, F.lit(0.0), lambda a, x: a + x))
    d = d.withColumn("peak_area", area).withColumn("_half", F.col("peak.height") / 2).withColumn("_k", F.col("peak.idx"))
    index = F.sequence(F.lit(0), F.size("bg_sub") - 1)
    low = lambda i: F.get("bg_sub", i) <= F.col("_half")
    d = d.withColumn("_l", F.array_max(F.filter(index, lambda i: (i < F.col("_k")) & low(i))))
    d = d.withColumn("_r", F.array_min(F.filter(index, lambda i: (i > F.col("_k")) & low(i))))

    def cross(i: Column, j: Column) -> Column:
        y0, y1, v0, v1 = F.get("bg_sub", i), F.get("bg_sub", j), F.get("voltage", i), F.get("voltage", j)
        return v0 + F.coalesce(F.try_divide(F.col("_half") - y0, y1 - y0), F.lit(0.0)) * (v1 - v0)

    width = cross(F.col("_r"), F.col("_r") - 1) - cross(F.col("_l"), F.col("_l") + 1)
    return d.withColumn("peak_fwhm", F.when((F.col("_half") > 0) & F.col("_l").isNotNull() & F.col("_r").isNotNull(), width)).drop("_w", "_half", "_k", "_l", "_r")
