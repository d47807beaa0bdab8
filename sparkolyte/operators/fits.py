"""Grouped fits and waveform kernels that need NumPy, as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..functions.stats import savgol
from ..functions.tasks import dealt


#: Curves that are fitted at once.
CURVES = 2_000


def curve_fit(df: DataFrame, keys: list[str], how: str, weight: str | None = None) -> DataFrame:
    """keys and ymax, k_half (and exponent for "hill") per group; NULL where the doses don't allow a fit.

    A group's points are gathered into a row, and rows are fitted by the thousand.
    """
    names = {"langmuir": ["ymax", "k_half"], "hill": ["ymax", "k_half", "exponent"]}[how]
    fit = {"langmuir": N.langmuirs, "hill": N.hills}[how]
    d = df.where("concentration > 0").where(F.col("response").isNotNull() & ~F.isnan("response"))
    point = F.struct(F.col("concentration").cast("double").alias("c"), F.col("response").cast("double").alias("y"), (F.col(weight) if weight else F.lit(None)).cast("double").alias("w"))
    points = d.select(*keys, point.alias("_p")).groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_p"))

    def sigma(w: np.ndarray) -> np.ndarray | None:
        good = np.isfinite(w) & (w > 0)
        return 1 / np.maximum(np.where(good, w, w[good].min()), 1e-9) if good.any() else None

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(c: pd.Series, y: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(c), CURVES):
            conc, value, weights = ([np.asarray(v, float) for v in s[i : i + CURVES]] for s in (c, y, w))
            out.append(fit(conc, value, [sigma(v) for v in weights] if weight else None))
        return pd.DataFrame(np.concatenate(out) if out else np.empty((0, len(names))), columns=names)

    out = dealt(points, keys).select(*keys, run("_p.c", "_p.y", "_p.w").alias("_f")).select(*keys, "_f.*")
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def _arrays(f):
    """A scalar function over array columns as an Arrow-batched one."""

    @F.pandas_udf("array<double>")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*(np.asarray(x, float) for x in row)) for row in zip(*columns, strict=True)])

    return run


def smoothed(values: Column, window: int = 11, poly: int = 2) -> Column:
    return savgol(values, window, poly)


def aligned_background(voltage: Column, bg_voltage: Column, bg_current: Column) -> Column:
    return _arrays(N.align_background)(voltage, bg_voltage, bg_current)


def background_features(voltage: Column, current: Column) -> Column:
    """Struct bg_switch, bg_charge, bg_cap."""

    @F.pandas_udf("bg_switch double, bg_charge double, bg_cap double")
    def run(v: pd.Series, i: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([N.background_features(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(v, i, strict=True)])

    return run(voltage, current)


def current_at(voltage: Column, current: Column, target: float = 0.7) -> Column:
    """The rising half's current at a voltage, clamped at its ends."""

    @F.pandas_udf("double")
    def run(v: pd.Series, i: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(v, i, strict=True):
            x, y = N.anodic(np.asarray(a, float), np.asarray(b, float))
            out.append(float(np.interp(target, x, y)))
        return pd.Series(out)

    return run(voltage, current)


def settle_tau(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, tau of the series' exponential settling."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("s"))

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([N.settle_tau(np.asarray(x, float)) for x in s])

    tau = run(F.col(f"s.{value}"))
    return g.select(*keys, tau.alias("tau")).withColumn("tau", F.when(~F.isnan("tau"), F.col("tau")))
