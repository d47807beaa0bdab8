"""Baseline normalization and leakage-safe scaling over (key..., feature, value) rows or wide columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import clean

# Feature types whose baseline is subtracted; all others are divided by it.
ADDITIVE = ("ideality_C", "local_n", "ideality_C_band", "n_band", "f_ideality_crossover", "min_neg_phase", "mean_Vpeak")
LOG_FLOOR = 1e-12


def normalization_kind(name: str) -> str:
    """additive or multiplicative, by the feature's type."""
    base = re.sub(r"_f\d+$", "", name)
    base = re.sub(r"^(ideality_C_band|n_band)_?.*$", r"\1", base)
    return "additive" if base in ADDITIVE else "multiplicative"


def d0_normalize(df: DataFrame, columns: list[str], group: list[str], time: str = "timepoint", log: bool = False, kinds: dict[str, str] | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """Each column against the mean over its group's rows at the first time; pinned (group..., columns) overrides it.

    Additive: x - d0. Multiplicative: x / d0, NULL for d0 = 0; with log, ln x - ln d0.
    """
    w = W.partitionBy(*group)
    d = df.withColumn("_t0", F.min(time).over(w))
    base = {c: F.avg(F.when(F.col(time) == F.col("_t0"), clean(F.col(c)))).over(w) for c in columns}
    d = d.withColumns({f"_d0_{c}": e for c, e in base.items()})
    if pinned is not None:
        pins = pinned.select(*group, *[F.col(c).alias(f"_pin_{c}") for c in columns], F.lit(True).alias("_pinned"))
        d = d.join(pins, group, "left")
        d = d.withColumns({f"_d0_{c}": F.when(F.col("_pinned"), F.col(f"_pin_{c}")).otherwise(F.col(f"_d0_{c}")) for c in columns})
    out = {}
    for c in columns:
        x, d0 = F.col(c), F.col(f"_d0_{c}")
        kind = (kinds or {}).get(c) or normalization_kind(c)
        if kind == "additive":
            out[c] = x - d0
        elif log:
            out[c] = F.ln(x) - F.ln(d0)
        else:
            out[c] = F.try_divide(x, d0)
    return d.withColumns(out).select(*df.columns)


def baselines(df: DataFrame, columns: list[str], group: list[str], time: str = "timepoint") -> DataFrame:
    """group and each column's mean over the group's rows at its first time."""
    d = df.withColumn("_t0", F.min(time).over(W.partitionBy(*group))).where(F.col(time) == F.col("_t0"))
    return d.groupBy(*group).agg(*[F.avg(clean(F.col(c))).alias(c) for c in columns])


def to_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(max(x, 1e-12)) on multiplicative columns."""
    return df.withColumns({c: F.ln(F.greatest(clean(F.col(c)), F.lit(LOG_FLOOR))) for c in columns if normalization_kind(c) == "multiplicative"})


def train_statistics(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """One row with mean_, sd_, median_, iqr_ of each column over the training rows; spread 0 becomes 1, no values median 0.

    Worked out in long form, so each column's values are gathered in a task of its own.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), clean(F.col(c)).alias("v")) for i, c in enumerate(columns)]))
    per = df.where(train).select(each.alias("e")).groupBy("e.i").agg(
        F.avg("e.v").alias("mean"), F.stddev_pop("e.v").alias("sd"), F.percentile("e.v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")
    )
    aggs = []
    for i, c in enumerate(columns):
        of = lambda x, i=i: F.max(F.when(F.col("i") == i, x))
        sd, iqr = of(F.col("sd")), of(F.get("q", F.lit(2)) - F.get("q", F.lit(0)))
        aggs += [
            of(F.col("mean")).alias(f"mean_{c}"),
            F.when(sd > 0, sd).otherwise(1.0).alias(f"sd_{c}"),
            F.coalesce(of(F.get("q", F.lit(1))), F.lit(0.0)).alias(f"median_{c}"),
            F.when(iqr > 0, iqr).otherwise(1.0).alias(f"iqr_{c}"),
        ]
    return per.agg(*aggs)


def scale(df: DataFrame, columns: list[str], train: Column, how: str) -> DataFrame:
    """how: "zscore", "robust" or "impute", fitted on the training rows alone."""
    stats = train_statistics(df, columns, train)
    # One row of statistics.
    d = df.crossJoin(F.broadcast(stats))
    new = {
        "zscore": lambda c: (clean(F.col(c)) - F.col(f"mean_{c}")) / F.col(f"sd_{c}"),
        "robust": lambda c: (clean(F.col(c)) - F.col(f"median_{c}")) / F.col(f"iqr_{c}"),
        "impute": lambda c: F.coalesce(clean(F.col(c)), F.col(f"median_{c}")),
    }[how]
    return d.withColumns({c: new(c) for c in columns}).select(*df.columns)


def first_value(value: str, ids: list[str], time: str) -> Column:
    """The first non-null value by time within ids."""
    w = W.partitionBy(*ids).orderBy(time).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return F.first(clean(F.col(value)), ignorenulls=True).over(w)


def drift_magnitude(df: DataFrame, value: str, ids: list[str], time: str = "timepoint") -> Column:
    """|v - first| / |first|, NULL for a first value of nearly 0."""
    base = first_value(value, ids, time)
    return F.when(F.abs(base) >= 1e-12, F.abs(clean(F.col(value)) - base) / F.abs(base))


def degraded(df: DataFrame, value: str, ids: list[str], time: str = "timepoint", frac: float = 0.5) -> Column:
    """1 where the drift passes frac, 0 where it doesn't or the value is missing, NULL without a usable first value."""
    base = first_value(value, ids, time)
    moved = F.coalesce(F.abs(clean(F.col(value)) - base) / F.abs(base) > frac, F.lit(False))
    return F.when(F.abs(base) >= 1e-12, moved.cast("long"))


def within_temporal_share(long: DataFrame, sensor: str = "sensor", time: str = "timepoint") -> DataFrame:
    """feature, temporal_fraction: the part of the variance between times within sensors."""
    from .diagnostics import variance_hierarchy

    return variance_hierarchy(long, sensor, time).select("feature", F.col("within_time").alias("temporal_fraction"))
