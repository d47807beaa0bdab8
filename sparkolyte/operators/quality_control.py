"""Channel roster, gates, reports and stabilization series as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roster(eis: DataFrame, fscv: DataFrame, keys: list[str]) -> DataFrame:
    """keys, has_eis, has_fscv, complete: the channels of either side."""
    a = eis.select(*keys).distinct().withColumn("has_eis", F.lit(True))
    b = fscv.select(*keys).distinct().withColumn("has_fscv", F.lit(True))
    d = a.join(b, keys, "full_outer").select(
        *keys, F.coalesce("has_eis", F.lit(False)).alias("has_eis"), F.coalesce("has_fscv", F.lit(False)).alias("has_fscv")
    )
    return d.withColumn("complete", F.col("has_eis") & F.col("has_fscv"))


def snr_flags(rows: DataFrame, keys: list[str], doses: list[float], least: float) -> DataFrame:
    """keys and one column fscv_snr_<dose> per dose: whether its SNR reaches least, false where missing."""
    ok = F.coalesce(F.col("snr") >= least, F.lit(False))
    return rows.groupBy(*keys).agg(*[F.coalesce(F.bool_or((F.col("concentration") == c) & ok), F.lit(False)).alias(f"fscv_snr_{c:g}") for c in doses])


def gate(df: DataFrame, gates: list[str], name: str = "overall_valid") -> DataFrame:
    """Adds name: all gates hold, missing ones failing."""
    out = F.lit(True)
    for g in gates:
        out = out & F.coalesce(F.col(f"`{g}`"), F.lit(False))
    return df.withColumn(name, out)


def fail_reasons(gates: dict[str, str]) -> Column:
    """The reasons of the gates that fail, joined by "; "."""
    return F.concat_ws("; ", *[F.when(~F.coalesce(F.col(f"`{g}`"), F.lit(False)), F.lit(reason)) for g, reason in gates.items()])


def valid_lists(df: DataFrame, keys: list[str], channel: str = "channel", valid: str = "overall_valid") -> DataFrame:
    """keys, sorted lists of valid and invalid channels, valid_pct."""
    v = F.col(valid)
    return df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(v, F.col(channel)))).alias("valid_channels"),
        F.array_sort(F.collect_list(F.when(~v, F.col(channel)))).alias("invalid_channels"),
        F.round(100 * F.avg(v.cast("double")), 1).alias("valid_pct"),
    )


def gate_impact(df: DataFrame, gates: list[str]) -> DataFrame:
    """gate, total, failed, failed_pct."""
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~F.coalesce(F.col(f"`{g}`"), F.lit(False))).alias(f"n{i}") for i, g in enumerate(gates)])
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"n{i}").alias("failed")) for i, g in enumerate(gates)])
    d = one.select("total", F.inline(rows))
    return d.select("gate", "total", "failed", F.round(F.try_divide(100.0 * F.col("failed"), F.col("total")), 1).alias("failed_pct"))


def threshold_sweep(df: DataFrame, column: str, thresholds: list[float], at_least: bool = True) -> DataFrame:
    """threshold, kept: one pass whatever the number of thresholds."""
    c = F.col(column)
    keep = (lambda t: c >= t) if at_least else (lambda t: c <= t)
    one = df.agg(*[F.count_if(keep(t)).alias(f"k{i}") for i, t in enumerate(thresholds)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("kept")) for i, t in enumerate(thresholds)])))


def channel_survival(df: DataFrame, total: int = 16) -> DataFrame:
    g = df.groupBy("device", "timepoint").agg(F.countDistinct("channel").alias("n_channels"))
    return g.withColumn("fraction", F.col("n_channels") / total)


def quality_filtering(df: DataFrame, valid: str) -> DataFrame:
    g = df.groupBy("device", "timepoint").agg(F.countDistinct("channel").alias("n_channels"), F.countDistinct(F.when(F.col(valid), F.col("channel"))).alias("n_valid"))
    return g.withColumn("rejected", F.col("n_channels") - F.col("n_valid"))


def mad_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, sd (sample, 0 for one): without values over 3 scaled MADs from the median; sd stands in for MAD 0."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_m"), F.stddev(value).alias("_sd"))
    d = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = d.groupBy(*keys).agg((1.4826 * F.median("_d")).alias("_mad"))
    width = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.coalesce("_sd", F.lit(0.0)))
    kept = d.join(mad, keys).withColumn("_w", width).where((F.col("_w") <= 0) | (F.col("_d") <= 3 * F.col("_w")))
    return kept.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev(value), F.lit(0.0)).alias("sd"))


def missing_sessions(sessions: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions that gave no row."""
    return sessions.join(rows.select(*keys).distinct(), keys, "left_anti")


def row_count_check(pinned: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pinned, n_found, status: ok, changed, missing or new."""
    d = pinned.withColumnRenamed("n", "n_pinned").join(found.withColumnRenamed("n", "n_found"), keys, "full_outer")
    status = (
        F.when(F.col("n_pinned").isNull(), "new").when(F.col("n_found").isNull(), "missing").when(F.col("n_pinned") == F.col("n_found"), "ok").otherwise("changed")
    )
    return d.select(*keys, "n_pinned", "n_found", status.alias("status"))


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, window: int) -> DataFrame:
    """Adds smooth: the window's sum over its full width, zeros beyond the ends; the value itself for short series."""
    before, after = window // 2, (window - 1) // 2
    w = W.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    smooth = F.sum(value).over(w.rowsBetween(-before, after)) / window
    return df.withColumn("smooth", F.when((n < window) | F.lit(window <= 1), F.col(value)).otherwise(smooth))


def converged(df: DataFrame, keys: list[str], order: str, value: str, tol: float = 0.01, patience: int = 10, smooth: int = 5) -> DataFrame:
    """keys, n, trailing run of smoothed values within tol, converged, settled_at (order of the run's start)."""
    d = moving_average(df, keys, order, value, smooth)
    w = W.partitionBy(*keys).orderBy(order)
    d = d.withColumn("_i", F.row_number().over(w))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(~F.coalesce(F.col("smooth") <= tol, F.lit(False)), F.col("_i"))), F.lit(0)).alias("_last"))
    g = g.withColumn("trailing", F.col("n") - F.col("_last"))
    return g.select(*keys, "n", "trailing", (F.col("trailing") >= patience).alias("converged"), F.when(F.col("trailing") >= patience, F.col("_last").cast("long")).alias("settled_at"))


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cycle_drift(df: DataFrame, keys: list[str], order: str, current: str, round_: str | None = None) -> DataFrame:
    """keys, order, drift = |c_k - c_(k-1)| / |c_k|; steps onto or off a round's first cycle are left out if round_ is given."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_p", F.lag(current).over(w))
    diff = F.zip_with(current, "_p", lambda a, b: a - b)
    d = d.withColumn("drift", F.try_divide(_norm(diff), _norm(F.col(current))))
    keep = F.col("_p").isNotNull()
    if round_:
        cold = F.col(round_) == 0
        keep = keep & ~cold & ~F.coalesce(F.lag(round_).over(w) == 0, F.lit(False))
        d = d.withColumn("_keep", keep).where("_keep").drop("_keep")
    else:
        d = d.where(keep)
    return d.select(*keys, order, "drift")


def round_means(df: DataFrame, keys: list[str], round_: str, current: str) -> DataFrame:
    """keys, round, current: element-wise mean over a round's cycles."""
    long = df.select(*keys, round_, F.posexplode(current).alias("pos", "x")).groupBy(*keys, round_, "pos").agg(F.avg("x").alias("x"))
    g = long.groupBy(*keys, round_).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("a"))
    return g.select(*keys, round_, F.col("a.x").alias(current))


def rank_conditions(df: DataFrame, score: str = "rmsep") -> DataFrame:
    """Adds rank by score, missing scores last, ties by condition."""
    s = F.when(~F.isnan(score), F.col(score))
    return df.withColumn("rank", F.row_number().over(W.orderBy(s.asc_nulls_last(), "condition")).cast("long"))


def feature_ranking(df: DataFrame) -> DataFrame:
    """feature, mean_frequency, n_conditions (frequency over 0)."""
    return df.groupBy("feature").agg(F.avg("frequency").alias("mean_frequency"), F.count_if(F.col("frequency") > 0).alias("n_conditions"))


def auto_flag(df: DataFrame, batch: str, score: str = "rmsep", factor: float = 1.5) -> DataFrame:
    """Adds best (of the batch) and dominated: the score passes factor times the best."""
    best = F.min(score).over(W.partitionBy(batch))
    return df.withColumn("best", best).withColumn("dominated", F.coalesce(F.col(score) > factor * F.col("best"), F.lit(True)))
