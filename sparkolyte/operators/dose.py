"""Dose-response operators: monotonicity, slopes, curve parameters, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import centred, in_order, ordered_mean, parabola, pearson, weighted_line

KEY = ["device", "channel", "timepoint"]


def finite_doses(df: DataFrame, value: str = "response", conc: str = "concentration") -> DataFrame:
    """Rows with a positive dose and a finite value."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (F.col(conc) > 0))


def distinct_doses(conc: str = "concentration") -> Column:
    """How many doses a group has. Doses of a group are few, so their set needs no shuffle of its own."""
    return F.size(F.collect_set(conc)).cast("long")


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks within keys, ties sharing their mean rank."""
    low = F.rank().over(W.partitionBy(*keys).orderBy(value))
    return low + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def dose_response(df: DataFrame, keys: list[str] = KEY, value: str = "response", conc: str = "concentration", method: str = "pearson") -> DataFrame:
    """keys, n_conc, r: correlation of the value with log dose, NULL under three distinct doses or without spread."""
    d = finite_doses(df, value, conc)
    if method == "spearman":
        d = d.withColumn("_x", average_rank(conc, keys)).withColumn("_y", average_rank(value, keys))
    else:
        d = d.withColumn("_x", F.log10(conc)).withColumn("_y", F.col(value))
    return d.groupBy(*keys).agg(
        distinct_doses(conc).alias("n_conc"),
        pearson(F.col("_x"), F.col("_y"), 3).alias("_r"),
        (F.max(value) - F.min(value)).alias("range"),
    ).select(*keys, "n_conc", F.when(F.col("n_conc") >= 3, F.col("_r")).alias("r"), "range")


def dose_monotone(df: DataFrame, r_min: float = 0.6, keys: list[str] = KEY) -> DataFrame:
    """Groups with three doses at least whose correlation with log dose reaches r_min, with the line's parameters."""
    d = finite_doses(df).withColumn("_x", F.log10("concentration"))
    return (
        d.groupBy(*keys)
        .agg(
            distinct_doses().alias("n_conc"),
            pearson(F.col("_x"), F.col("response"), 3).alias("r"),
            F.regr_slope("response", "_x").alias("slope"),
            F.regr_intercept("response", "_x").alias("intercept"),
        )
        .where((F.col("n_conc") >= 3) & (F.col("r") >= r_min))
    )


def sigma_weights(df: DataFrame, weight: str, keys: list[str] = KEY) -> DataFrame:
    """Adds _w = weight, where bad and infinite ones become the smallest valid one of the group; 1 without any."""
    w = F.col(weight).cast("double")
    valid = F.when((w > 0) & (w < float("inf")), w)
    least = F.min(valid).over(W.partitionBy(*keys))
    return df.withColumn("_w", F.greatest(F.coalesce(valid, least, F.lit(1.0)), F.lit(1e-9)))


def sensitivity(df: DataFrame, keys: list[str] = KEY, weight: str | None = None, min_conc: int = 3) -> DataFrame:
    """Slope, intercept, curvature (from four doses on) and unweighted r of the value on log dose.

    The fit multiplies unsquared residuals by the squared weight, so squares enter with its fourth power.
    """
    d = finite_doses(df).withColumn("_x", F.log10("concentration"))
    d = sigma_weights(d, weight, keys) if weight else d.withColumn("_w", F.lit(1.0))
    w = F.pow("_w", F.lit(4.0))
    x, y = F.col("_x"), F.col("response").cast("double")
    d = centred(d, keys, w, x=x, y=y)
    slope, intercept = weighted_line(w)
    n = distinct_doses()
    return (
        d.groupBy(*keys)
        .agg(
            n.alias("n_conc"),
            slope.alias("slope"),
            intercept.alias("intercept"),
            F.when(n >= 4, parabola(w)).alias("curvature"),
            pearson(x, y, 3).alias("dose_response_r"),
        )
        .where(F.col("n_conc") >= min_conc)
    )


def power_law(df: DataFrame, keys: list[str] = KEY, weight: str | None = None) -> DataFrame:
    """amplitude and exponent of value = amplitude * dose ** exponent over positive points with three doses."""
    d = finite_doses(df).where("response > 0")
    if weight:
        raw = F.col(weight).cast("double")
        d = d.withColumn("_w", F.when((raw > 0) & (raw < float("inf")), raw).otherwise(0.0))
    else:
        d = d.withColumn("_w", F.lit(1.0))
    w = F.col("_w") * F.col("_w")
    d = centred(d, keys, w, x=F.ln("concentration"), y=F.ln("response"))
    slope, intercept = weighted_line(w)
    return (
        d.groupBy(*keys)
        .agg(distinct_doses().alias("n_conc"), slope.alias("exponent"), F.exp(intercept).alias("amplitude"))
        .where("n_conc >= 3")
    )


def accept(
    df: DataFrame,
    how: str,
    keys: list[str] = KEY,
    min_snr: float = 1.0,
    r_min: float = 0.6,
    method: str = "pearson",
    min_range: float | None = None,
    drop_negative: bool = True,
) -> DataFrame:
    """Rows accepted: "snr" by row, "none" all, "monotonic" whole groups, "monotonic+snr" both."""
    if how not in ("snr", "none", "monotonic", "monotonic+snr"):
        raise ValueError(f"unknown acceptance {how!r}")
    v = F.col("response")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if drop_negative:
        rows = rows.where("response >= 0")
    if how.startswith("monotonic"):
        good = dose_response(rows, keys, method=method).where(F.col("r") >= r_min)
        if min_range is not None:
            good = good.where(F.col("range") >= min_range)
        rows = rows.join(good.select(*keys), keys, "left_semi")
    if how.endswith("snr"):
        snr = F.col("snr")
        rows = rows.where(snr.isNotNull() & ~F.isnan(snr) & (F.abs(snr) < float("inf")) & (snr >= min_snr))
    return rows


def repeatability(reps: DataFrame, keys: list[str], value: str = "value", order: str | None = None) -> DataFrame:
    """mean, rep_std (population), n and snr = mean / scatter over finite replicates: infinity without scatter, NULL below two.

    With order, the mean comes from a sum in that order.
    """
    v = F.col(value)
    ok = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    d = reps.withColumn("_ok", ok)
    mean = F.avg("_ok")
    if order is not None:
        d, mean = in_order(d, keys, "_ok", order), ordered_mean("_ok", order)
    g = d.groupBy(*keys).agg(F.count("_ok").alias("n"), mean.alias("mean"), F.stddev_pop("_ok").alias("rep_std"))
    snr = F.when(F.col("rep_std") > 0, F.try_divide("mean", "rep_std")).otherwise(F.lit(float("inf")))
    return g.withColumn("snr", F.when(F.col("n") >= 2, snr))


def dose_curve(df: DataFrame, doses: list[float], keys: list[str] = KEY, least: int = 3) -> DataFrame:
    """One row per group, one column per dose with its mean; groups with at least `least` doses."""
    d = finite_doses(df)
    wide = d.groupBy(*keys).agg(*[F.avg(F.when(F.col("concentration") == c, F.col("response"))).alias(f"dose_{c:g}") for c in doses])
    present = sum((F.col(f"`dose_{c:g}`").isNotNull().cast("int") for c in doses), F.lit(0))
    return wide.where(present >= least)
