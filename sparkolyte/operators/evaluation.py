"""Forward-chained folds, metrics and model-free controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def forward_folds(df: DataFrame, channel: str = "channel", time: str = "timepoint", min_train_times: int = 3) -> DataFrame:
    """(channel, t_test) for each time with enough earlier times of any channel; training rows are all those earlier."""
    times = df.select(time).distinct().withColumn("_n", F.dense_rank().over(W.orderBy(time)) - 1)
    return df.select(channel, time).distinct().join(times, time).where(F.col("_n") >= min_train_times).select(F.col(channel).alias("channel"), F.col(time).alias("t_test"))


def fold_sizes(df: DataFrame, folds: DataFrame, y: str, channel: str = "channel", time: str = "timepoint", leave_channel_out: bool = False) -> DataFrame:
    """channel, t_test, n_train, train_mean, n_test, sse of the training mean: from running sums per time, not a row join."""
    per_time = df.groupBy(time).agg(F.count(y).alias("n"), F.sum(y).alias("s"))
    per_cell = df.groupBy(channel, time).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    before = W.orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    run = per_time.select(F.col(time).alias("t_test"), F.sum("n").over(before).alias("n_all"), F.sum("s").over(before).alias("s_all"))
    own_before = W.partitionBy(channel).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    cells = per_cell.select(
        F.col(channel).alias("channel"),
        F.col(time).alias("t_test"),
        "n",
        "s",
        "q",
        F.coalesce(F.sum("n").over(own_before), F.lit(0)).alias("n_own"),
        F.coalesce(F.sum("s").over(own_before), F.lit(0.0)).alias("s_own"),
    )
    d = folds.join(cells, ["channel", "t_test"]).join(run, "t_test")
    own = 1 if leave_channel_out else 0
    d = d.withColumn("n_train", F.col("n_all") - own * F.col("n_own")).withColumn("_s", F.col("s_all") - own * F.col("s_own"))
    d = d.withColumn("train_mean", F.try_divide("_s", "n_train"))
    m = F.col("train_mean")
    return d.select("channel", "t_test", "n_train", "train_mean", F.col("n").alias("n_test"), (F.col("q") - 2 * m * F.col("s") + F.col("n") * m * m).alias("sse"))


def inner_validation_time(df: DataFrame, folds: DataFrame, time: str = "timepoint", channel: str | None = None) -> DataFrame:
    """Adds t_val, the latest training time before each fold's t_test (of the channel, if given), and has_inner."""
    keys = [channel] if channel else []
    times = df.select(*keys, F.col(time).alias("t_test")).distinct()
    w = W.partitionBy(*keys).orderBy("t_test") if keys else W.orderBy("t_test")
    prev = times.withColumn("t_val", F.lag("t_test").over(w)).withColumn("_p", F.lag("t_test", 2).over(w))
    d = folds.join(prev, [*keys, "t_test"], "left")
    return d.withColumn("has_inner", F.col("_p").isNotNull()).drop("_p")


def random_folds(df: DataFrame, n_splits: int = 5, seed: int = 0, channel: str = "channel", time: str = "timepoint") -> DataFrame:
    """Whole (channel, time) units dealt to splits by a seeded hash."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), channel, time), F.lit(n_splits)))


def fold_results(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sse, n_test, tss against the training mean, from rows (y, pred, train_mean)."""
    r, t = F.col("y") - F.col("pred"), F.col("y") - F.col("train_mean")
    return predictions.groupBy(*keys).agg(F.sum(r * r).alias("sse"), F.count(F.lit(1)).alias("n_test"), F.sum(t * t).alias("tss"))


def pooled(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_folds, n_test, rmsep (micro), macro_rmsep, q2, fold_sd (sample), fold_iqr."""
    own = F.sqrt(F.col("sse") / F.col("n_test"))
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.sum("n_test").alias("n_test"),
        F.sqrt(F.try_divide(F.sum("sse"), F.sum("n_test"))).alias("rmsep"),
        F.avg(own).alias("macro_rmsep"),
        (1 - F.try_divide(F.sum("sse"), F.sum("tss"))).alias("q2"),
        F.stddev_samp(own).alias("fold_sd"),
        (F.percentile(own, 0.75) - F.percentile(own, 0.25)).alias("fold_iqr"),
    )


#: Cumulative probabilities of a Poisson(1).
POISSON = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991684]


def bootstrap_ci(results: DataFrame, n_boot: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """lo, hi of the pooled RMSEP over n_boot resamples of folds.

    Every fold draws its count in each resample from a Poisson(1), so resamples need no join of folds with folds.
    """
    reps = F.sequence(F.lit(0), F.lit(n_boot - 1))
    u = (F.pmod(F.xxhash64("_fold", "b", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    draw = sum((u > e).cast("int") for e in POISSON)
    d = results.withColumn("_fold", F.xxhash64(*results.columns)).withColumn("b", F.explode(reps)).withColumn("k", draw)
    each = d.groupBy("b").agg(F.sqrt(F.try_divide(F.sum(F.col("k") * F.col("sse")), F.sum(F.col("k") * F.col("n_test")))).alias("r"))
    tail = (1 - level) / 2
    return each.agg(F.percentile("r", tail).alias("lo"), F.percentile("r", 1 - tail).alias("hi"), F.count("r").alias("n_boot"))


def bootstrap_by(results: DataFrame, by: list[str], n_boot: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """by, lo, hi: bootstrap_ci of each group."""
    reps = F.sequence(F.lit(0), F.lit(n_boot - 1))
    u = (F.pmod(F.xxhash64("_fold", "b", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    draw = sum((u > e).cast("int") for e in POISSON)
    d = results.withColumn("_fold", F.xxhash64(*results.columns)).withColumn("b", F.explode(reps)).withColumn("k", draw)
    each = d.groupBy(*by, "b").agg(F.sqrt(F.try_divide(F.sum(F.col("k") * F.col("sse")), F.sum(F.col("k") * F.col("n_test")))).alias("r"))
    tail = (1 - level) / 2
    return each.groupBy(*by).agg(F.percentile("r", tail).alias("lo"), F.percentile("r", 1 - tail).alias("hi"))


def history(df: DataFrame, y: str, group: list[str], time: str = "timepoint") -> DataFrame:
    """Adds own_n, own_mean, own_slope over the group's earlier times, and all_n, all_mean over everyone's."""
    # Times and values from the group's mean time and value on, so that the slope loses no digits to either.
    own = W.partitionBy(*group)
    d = df.withColumn("_mt", F.avg(F.col(time).cast("double")).over(own)).withColumn("_my", F.avg(y).over(own))
    t, v = F.col(time) - F.col("_mt"), F.col(y) - F.col("_my")
    cell = d.groupBy(*group, time, "_mt", "_my").agg(F.count(y).alias("n"), F.sum(v).alias("s"), F.sum(v * t).alias("st"))
    before = W.partitionBy(*group).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(before)
    n, s, st = total(F.col("n")), total(F.col("s")), total(F.col("st"))
    x, xx = total(F.col("n") * t), total(F.col("n") * t * t)
    own = cell.select(
        *group,
        time,
        F.coalesce(n, F.lit(0)).alias("own_n"),
        (F.try_divide(s, n) + F.col("_my")).alias("own_mean"),
        F.try_divide(n * st - x * s, n * xx - x * x).alias("own_slope"),
        (F.try_divide(x, n) + F.col("_mt")).alias("own_age"),
    )
    every = df.groupBy(time).agg(F.count(y).alias("n"), F.sum(y).alias("s"))
    w = W.orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    every = every.select(time, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("all_n"), F.try_divide(F.sum("s").over(w), F.sum("n").over(w)).alias("all_mean"))
    return df.join(own, [*group, time]).join(every, time)


def channel_controls(df: DataFrame, y: str, group: list[str], time: str = "timepoint", shrink: float = 1.0, min_train: int = 8) -> DataFrame:
    """Rows with train_mean, mean_pred (shrunk own mean) and trend_pred (with the own slope) where min_train earlier rows are there."""
    h = history(df, y, group, time).where(F.col("all_n") >= min_train)
    weight = F.col("own_n") / (F.col("own_n") + shrink)
    mean = F.col("all_mean") + weight * F.coalesce(F.col("own_mean") - F.col("all_mean"), F.lit(0.0))
    trend = mean + weight * F.coalesce(F.col("own_slope") * (F.col(time) - F.col("own_age")), F.lit(0.0))
    return h.select(*group, time, F.col(y).alias("y"), F.col("all_mean").alias("train_mean"), mean.alias("mean_pred"), trend.alias("trend_pred"))


def time_only(df: DataFrame, y: str, group: list[str], time: str = "timepoint", min_train: int = 8) -> DataFrame:
    """Rows with train_mean and pred: a line in age fitted on all earlier times."""
    aged = df.withColumn("age", (F.col(time) - F.min(time).over(W.partitionBy(*group))).cast("double"))
    a, v = F.col("age"), F.col(y)
    cell = aged.groupBy(time).agg(F.count(y).alias("n"), F.sum(a).alias("x"), F.sum(v).alias("s"), F.sum(a * a).alias("xx"), F.sum(a * v).alias("xy"))
    w = W.orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    c = {k: F.sum(k).over(w) for k in ("n", "x", "s", "xx", "xy")}
    slope = F.try_divide(c["n"] * c["xy"] - c["x"] * c["s"], c["n"] * c["xx"] - c["x"] * c["x"])
    line = cell.select(time, c["n"].alias("_n"), slope.alias("_b"), F.try_divide(c["s"], c["n"]).alias("train_mean"), F.try_divide(c["x"], c["n"]).alias("_m"))
    d = aged.join(line, time).where(F.col("_n") >= min_train)
    pred = F.col("train_mean") + F.coalesce(F.col("_b"), F.lit(0.0)) * (a - F.col("_m"))
    return d.select(*group, time, v.alias("y"), "train_mean", pred.alias("pred"))


#: Ranges of the score that a global ranking is cut into.
RANGES = 256


def running_count(df: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """Adds before: the sum of n over the rows of by with a lower value of order, which is unique within by.

    Approximate quantiles cut the values into ranges; totals of the ranges are summed over a table of at most
    RANGES rows per group and the rest within each range, so no task orders all rows.
    """
    cuts = df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    value = F.col(order)
    d = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < value))).drop("_cuts")
    total = d.groupBy(*by, "_range").agg(F.sum(n).alias("_n"))
    lower = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*by, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"))
    inside = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(total, [*by, "_range"])
    return d.withColumn("before", F.col("_lower") + F.col("_inside")).drop("_range", "_inside", "_lower")


def auc(df: DataFrame, label: Column, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks, NULL for a single class; equal scores are grouped first."""
    by = by or []
    g = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(label.cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    g = running_count(g, by, score, "n").withColumn("_rank", F.col("before") + (F.col("n") + 1) / 2)
    g = g.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("t"), F.sum(F.col("pos") * F.col("_rank")).alias("r"))
    n = F.col("t") - F.col("p")
    return g.withColumn("auc", F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * n)).select(*by, F.col("p").alias("n_pos"), n.alias("n_neg"), "auc")


def balanced_accuracy(df: DataFrame, label: Column, guess: Column) -> DataFrame:
    tp, tn = F.avg(F.when(label == 1, (guess == 1).cast("double"))), F.avg(F.when(label == 0, (guess == 0).cast("double")))
    return df.agg(((tp + tn) / 2).alias("balanced_accuracy"), F.avg(label.cast("double")).alias("base_rate"))


def calibration_slices(predictions: DataFrame, by: str) -> DataFrame:
    r = F.col("y") - F.col("pred")
    return predictions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.stddev_samp("pred").alias("sd_pred"), F.sqrt(F.avg(r * r)).alias("rmse")
    )




def effective_min_train_times(n_times: int, wanted: int = 3) -> int:
    """The wanted number of training times, or one less than there are."""
    return max(1, min(wanted, n_times - 1))


def mean_over_seeds(metrics: DataFrame, keys: list[str], kept: tuple[str, ...] = ("n_folds", "n_test")) -> DataFrame:
    """Finite metrics averaged over seeds; counts and everything that is no number come from the first seed."""
    first = F.min("seed").over(W.partitionBy(*keys))
    d = metrics.withColumn("_first", F.col("seed") == first)
    aggs = []
    for n, t in metrics.dtypes:
        if n in keys or n == "seed":
            continue
        if t in ("double", "float") and n not in kept:
            aggs.append(F.avg(F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n))).alias(n))
        else:
            aggs.append(F.max(F.when(F.col("_first"), F.col(n))).alias(n))
    return d.groupBy(*keys).agg(*aggs)


def stratify_by_drift(predictions: DataFrame, drifted: Column) -> DataFrame:
    """stratum (all, has_drifted, still_flat), n, q2, rmsep, target_std of rows (y, pred, train_mean)."""
    flag = F.when(drifted, "has_drifted").otherwise("still_flat")
    d = predictions.withColumn("stratum", F.explode(F.array(F.lit("all"), flag)))
    r, t = F.col("y") - F.col("pred"), F.col("y") - F.col("train_mean")
    return d.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.sum(r * r), F.sum(t * t))).alias("q2"),
        F.sqrt(F.avg(r * r)).alias("rmsep"),
        F.stddev_pop("y").alias("target_std"),
    )
