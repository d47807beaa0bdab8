"""Variance shares, reliability and drift alignment, for all features at once in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clean, pearson
from .dose import average_rank


def variance_hierarchy(long: DataFrame, sensor: str = "sensor", time: str = "timepoint", feature: str = "feature", value: str = "value") -> DataFrame:
    """feature, between_channel, within_time, residual: shares of the total sum of squares, 0 for a constant feature.

    Sums of squares come from counts and sums per (feature, sensor, time), so rows are aggregated once.
    """
    v = clean(F.col(value))
    cell = long.groupBy(feature, sensor, time).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    cell = cell.where("n > 0").withColumn("c", F.col("s") * F.col("s") / F.col("n"))
    mid = cell.groupBy(feature, sensor).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("c").alias("c"))
    mid = mid.withColumn("b", F.col("s") * F.col("s") / F.col("n"))
    top = mid.groupBy(feature).agg(*[F.sum(x).alias(x) for x in ("n", "s", "q", "c", "b")])
    mean = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - mean
    share = lambda x: F.when(total > 1e-12, F.greatest(x, F.lit(0.0)) / total).otherwise(0.0)
    return top.select(
        feature,
        share(F.col("b") - mean).alias("between_channel"),
        share(F.col("c") - F.col("b")).alias("within_time"),
        share(F.col("q") - F.col("c")).alias("residual"),
        F.col("n").alias("n_rows"),
    )


def measurement_reliability(reps: DataFrame, keys: list[str], value: str = "value", by: list[str] | None = None) -> DataFrame:
    """sigma2_meas (pooled within), sigma2_obs (of means, sample), sigma2_signal, n_rep (mean) and R, per `by` or in all."""
    by = by or []
    v = clean(F.col(value))
    obs = reps.groupBy(*by, *keys).agg(F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("ss"))
    two = F.col("n") >= 2
    g = obs.where("n > 0").groupBy(*by).agg(
        F.try_divide(F.sum(F.when(two, F.col("ss"))), F.sum(F.when(two, F.col("n") - 1))).alias("sigma2_meas"),
        F.var_samp("m").alias("sigma2_obs"),
        F.avg("n").alias("n_rep"),
        F.count(F.lit(1)).alias("n_obs"),
    )
    signal = F.greatest(F.lit(0.0), F.col("sigma2_obs") - F.col("sigma2_meas") / F.col("n_rep"))
    g = g.withColumn("sigma2_signal", signal)
    return g.withColumn("R", F.try_divide("sigma2_signal", F.col("sigma2_signal") + F.col("sigma2_meas")))


def drift_reliability(long: DataFrame, noise: DataFrame, sensor: str = "sensor", time: str = "timepoint") -> DataFrame:
    """feature, sigma2_drift (variance of time means within sensors), sigma2_noise, snr, R_drift; noise has feature, sigma2_meas."""
    v = clean(F.col("value"))
    means = long.groupBy("feature", sensor, time).agg(F.avg(v).alias("m")).where("m is not null")
    drift = means.groupBy("feature", sensor).agg(F.count("m").alias("k"), (F.var_pop("m") * F.count("m")).alias("ss"))
    drift = drift.groupBy("feature").agg(F.try_divide(F.sum("ss"), F.sum("k")).alias("sigma2_drift"))
    d = drift.join(noise.select("feature", F.col("sigma2_meas").alias("sigma2_noise")), "feature")
    return d.withColumn("snr", F.try_divide("sigma2_drift", "sigma2_noise")).withColumn(
        "R_drift", F.try_divide("sigma2_drift", F.col("sigma2_drift") + F.col("sigma2_noise"))
    )


def drift_alignment(rows: DataFrame, sensor: str = "sensor", time: str = "timepoint", dose: str = "concentration", method: str = "pearson") -> DataFrame:
    """feature, alignment, n_groups: Fisher mean over (sensor, dose) of the correlation over time of value and response."""
    x, y = clean(F.col("value")), clean(F.col("response"))
    keys = ["feature", sensor, dose]
    both = rows.where(x.isNotNull() & y.isNotNull())
    means = both.groupBy(*keys, time).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    if method == "spearman":
        means = means.withColumn("x", average_rank("x", keys)).withColumn("y", average_rank("y", keys))
    g = means.groupBy(*keys).agg(pearson(F.col("x"), F.col("y"), 3).alias("r"))
    z = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("r"))))
    return g.groupBy("feature").agg(F.tanh(F.avg(z)).alias("alignment"), F.count("r").alias("n_groups"))


def absolute_alignment(rows: DataFrame, dose: str = "concentration", least: int = 5) -> DataFrame:
    """feature, alignment: Fisher mean over doses of the correlation across sensors and times."""
    x, y = clean(F.col("value")), clean(F.col("response"))
    g = rows.groupBy("feature", dose).agg(pearson(x, y, least).alias("r"))
    z = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("r"))))
    return g.groupBy("feature").agg(F.tanh(F.avg(z)).alias("alignment"), F.count("r").alias("n_groups"))


def clean_trend_channels(df: DataFrame, value: str, ids: list[str], time: str = "timepoint", least_r: float = 0.6, min_times: int = 4) -> DataFrame:
    """ids, spearman of the groups whose value follows time closely."""
    d = df.where(clean(F.col(value)).isNotNull())
    d = d.withColumn("_x", average_rank(time, ids)).withColumn("_y", average_rank(value, ids))
    g = d.groupBy(*ids).agg(F.countDistinct(time).alias("n_times"), pearson(F.col("_x"), F.col("_y"), 3).alias("spearman"))
    return g.where((F.col("n_times") >= min_times) & (F.abs("spearman") >= least_r))


def component_summary(shares: DataFrame, columns: list[str]) -> DataFrame:
    """component, n, mean, median, std (population), min, q25, q75, max over features."""
    long = shares.unpivot(["feature"], columns, "component", "x")
    return long.groupBy("component").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.median("x").alias("median"),
        F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"),
        F.percentile("x", 0.25).alias("q25"),
        F.percentile("x", 0.75).alias("q75"),
        F.max("x").alias("max"),
    )


def target_admissibility(df: DataFrame, targets: dict[str, bool], r: str, ident: float = 0.7, least_cv: float = 0.15) -> DataFrame:
    """Per target: share present, invertible, sd, cv = sd / mean |v|, median r over present rows, admissible."""
    long = df.unpivot([r], list(targets), "target", "v")
    v = clean(F.col("v"))
    flags = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    g = long.groupBy("target").agg(
        F.avg(v.isNotNull().cast("double")).alias("identifiable"),
        F.stddev_pop(v).alias("sd"),
        F.try_divide(F.stddev_pop(v), F.avg(F.abs(v))).alias("cv"),
        F.median(F.when(v.isNotNull(), F.col(r))).alias("median_r"),
    )
    g = g.withColumn("invertible", F.element_at(flags, F.col("target")))
    return g.withColumn("admissible", (F.col("identifiable") >= ident) & F.col("invertible") & (F.col("cv") >= least_cv))


def by_type(shares: DataFrame, columns: list[str], how: str = "avg") -> DataFrame:
    """type, n_features and the columns' mean or median over a type's features."""
    f = {"avg": F.avg, "median": F.median}[how]
    kind = F.regexp_replace("feature", r"_f?\d+$", "")
    return shares.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n_features"), *[f(c).alias(c) for c in columns])


def strongest(table: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n features with the largest absolute value, ties by name."""
    return table.where(F.col(column).isNotNull()).orderBy(F.abs(column).desc(), "feature").limit(n)


def before_and_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """feature, before, after, change: what a normalization did to a diagnostic."""
    d = before.select("feature", F.col(column).alias("before")).join(after.select("feature", F.col(column).alias("after")), "feature")
    return d.withColumn("change", F.col("after") - F.col("before"))


def rescued(pearson_table: DataFrame, spearman_table: DataFrame, keys: list[str], cut: float) -> DataFrame:
    """pearson_ok, spearman_ok, n: groups that one correlation accepts and the other doesn't."""
    ok = lambda c: F.coalesce(F.col(c) >= cut, F.lit(False))
    a = pearson_table.select(*keys, F.col("r").alias("_p"))
    b = spearman_table.select(*keys, F.col("r").alias("_s"))
    d = a.join(b, keys)
    return d.groupBy(ok("_p").alias("pearson_ok"), ok("_s").alias("spearman_ok")).agg(F.count(F.lit(1)).alias("n"))


def alignment_verdict(drift: DataFrame, absolute: DataFrame, margin: float = 0.1) -> DataFrame:
    """One row: the largest absolute drift and cross-sensor alignment, and which of them leads by the margin."""
    a = drift.agg(F.max(F.abs("alignment")).alias("max_drift"))
    b = absolute.agg(F.max(F.abs("alignment")).alias("max_absolute"))
    lead = F.col("max_drift") - F.col("max_absolute")
    # Two one-row tables.
    return a.crossJoin(b).withColumn("verdict", F.when(lead > margin, "drift").when(lead < -margin, "absolute").otherwise("undecided"))
