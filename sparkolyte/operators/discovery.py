"""Model evaluation under forward-chained folds, freezing and recalibration.

Rows meet the test times that come after theirs by an equal join on time, once for all channels: channels that share
training rows share the fits, and one task fits the plain conditions of a test time together, a costly one by itself.
Where a channel's own rows are left out of its training (the universal track) a task is one channel's fold. Nothing of
the matrix is collected to the driver; a task holds the rows up to its test time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import centred, parabola, weighted_line
from ..functions.tasks import dealt
from . import blocks as B
from . import domain
from . import models as M
from .evaluation import effective_min_train_times, mean_over_seeds, pooled
from .normalize import to_log

# Outer folds and inner validation rows of each track.
TRACKS = {"channel": ("forward", "channel"), "global": ("forward", "all"), "universal": ("others", "all"), "random": ("random", "random")}
#: Selectors whose result depends on a seed, and conditions that are dear enough for tasks of their own.
SEEDED = ("mi", "cars", "icc+cars")
LOG_FLOOR = 1e-12


@dataclass(frozen=True)
class Condition:
    """One row of an experiment. selector: none, vip, sr, smc, mi, icc, cars or icc+cars."""

    name: str
    architecture: str = "linear"
    track: str = "global"
    selector: str = "none"
    k_grid: tuple[int, ...] = (2,)
    thresholds: tuple[float, ...] = ()
    weighted_by: str | None = None
    transform: str = "linear"

    def __post_init__(self) -> None:
        if self.track not in TRACKS:
            raise ValueError(f"unknown track {self.track!r}")
        if self.weighted_by not in (None, "concentration", "repeatability_snr"):
            raise ValueError(f"unknown weights {self.weighted_by!r}")
        if self.transform == "log" and self.architecture == "log":
            raise ValueError("the log transform and the log architecture would both take logarithms")

    @property
    def has_threshold(self) -> bool:
        return self.selector in ("vip", "sr", "smc", "mi", "icc", "icc+cars")

    @property
    def batch(self) -> int:
        """The number before the point in names like baselines_1.2_x, else 0."""
        found = re.match(r"[^_]*_(\d+)", self.name)
        return int(found[1]) if found else 0


# The baseline experiment. Name, architecture, track, selector, components tried, thresholds tried,
# weights, transform.
QUEUE = (
    ("baselines_1.1_linearPLSR", "linear", "global", "none", (2,), (), None, "linear"),
    ("baselines_1.2_linearPLSR", "linear", "global", "none", (2, 3), (), None, "linear"),
    ("baselines_1.3_linearPLSR_log", "linear", "global", "none", (2, 3), (), None, "log"),
    ("baselines_1.4_weightedPLSR", "weighted", "global", "none", (2, 3), (), "concentration", "linear"),
    ("baselines_1.4_weightedPLSR_log", "weighted", "global", "none", (2, 3), (), "concentration", "log"),
    ("baselines_1.5_orthogonalPLSR", "orthogonal", "global", "none", (2, 3), (), None, "linear"),
    ("baselines_1.6_nonlinearPLSR", "nonlinear", "global", "none", (2, 3), (), None, "linear"),
    ("baselines_1.7_snrWeightedPLSR", "weighted", "global", "none", (2, 3), (), "repeatability_snr", "linear"),
    ("channelspecific_2.1_linearPLSR", "linear", "channel", "none", (2, 3), (), None, "linear"),
    ("pNproblem_3.1_SR", "linear", "global", "sr", (2, 3), (0.5, 1.0), None, "linear"),
    ("pNproblem_3.1_VIP", "linear", "global", "vip", (2, 3), (0.5, 1.0), None, "linear"),
    ("pNproblem_3.1_sMC", "linear", "global", "smc", (2, 3), (2.0, 6.0), None, "linear"),
    ("pNproblem_3.2_CARS", "linear", "global", "cars", (2, 3), (), None, "linear"),
    ("newchannels_4.1_CARS", "linear", "universal", "cars", (2, 3), (), None, "linear"),
)


def baseline_queue() -> list[Condition]:
    return [Condition(*row) for row in QUEUE]


@dataclass
class Rows:
    """Rows of one task: x holds all of the task's, at says which; t is the time, or in random folds the fold."""

    x: np.ndarray
    at: np.ndarray
    y: np.ndarray
    t: np.ndarray
    sensor: np.ndarray
    time: np.ndarray
    conc: np.ndarray
    snr: np.ndarray
    logged: tuple[int, ...] = ()

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.x, *(getattr(self, f)[at] for f in ("at", "y", "t", "sensor", "time", "conc", "snr")), self.logged)

    def scaled(self) -> B.Scaled:
        return B.Scaled(self.x, self.at, self.logged, LOG_FLOOR)


def sample_weights(c: Condition, rows: Rows) -> np.ndarray | None:
    """1 / dose from one on, or the repeatability with infinite ones at the largest finite one; None without weights."""
    if c.weighted_by == "concentration":
        return 1 / np.maximum(np.nan_to_num(rows.conc, nan=1.0), 1.0)
    if c.weighted_by == "repeatability_snr":
        finite = np.isfinite(rows.snr)
        w = np.maximum(np.where(finite, rows.snr, rows.snr[finite].max() if finite.any() else 1.0), 0)
        return w if w.sum() > 0 else None
    return None


def _prepare(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Training medians for missing values, then z-scores."""
    median = np.nanmedian(np.where(np.isfinite(train).any(axis=0), np.where(np.isfinite(train), train, np.nan), 0.0), axis=0)
    filled = [np.where(np.isfinite(x), x, median) for x in (train, *others)]
    return M.zscore(*filled)


def _select(c: Condition, threshold: float | None, x: B.Scaled, rows: Rows, k: int, seed: int, cars: dict) -> np.ndarray:
    if c.selector.startswith("icc"):
        kept = B.temporal_select(x, rows.sensor, rows.time, threshold)
        return kept[B.cars(x.only(kept), rows.y, seed=seed, **cars)] if c.selector == "icc+cars" else kept
    if c.selector == "cars":
        return B.cars(x, rows.y, seed=seed, **cars)
    return B.select(c.selector, x, rows.y, threshold, k, seed)


def _fitted(c: Condition, k: int, x: B.Scaled, rows: Rows) -> M.PLS:
    y = np.log(np.maximum(rows.y, LOG_FLOOR)) if c.transform == "log" else rows.y
    return B.fit(c.architecture, k, x, y, sample_weights(c, rows) if c.architecture == "weighted" else None)


def _predicted(c: Condition, model: M.PLS, x: B.Scaled) -> np.ndarray:
    p = x.apply(lambda z: np.ravel(model.predict(z)))
    # Far beyond any response, and short of overflow.
    return np.exp(np.clip(p, -50, 50)) if c.transform == "log" else p


def _inner_split(c: Condition, train: Rows, fold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which training rows fit and which validate: the last time, or in random folds a quarter."""
    if c.track == "random":
        order = np.random.default_rng(int(fold)).permutation(len(train.y))
        cut = max(1, round(0.75 * len(order)))
        return np.sort(order[:cut]), np.sort(order[cut:])
    last = train.t.max() if len(train.t) else np.nan
    return np.flatnonzero(train.t < last), np.flatnonzero(train.t == last)


def evaluate_folds(c: Condition, train: Rows, test: Rows, seed: int, cars: dict, fold: float = 0.0) -> Iterator[dict]:
    """Results of each fold of the test rows' channels (of all test rows together in random folds).

    Threshold and number of components are those with the least error on the inner validation rows, in the order they
    are given; they are fitted again on all training rows. Folds that can't be fitted are left out.
    """
    inner, outer = _inner_split(c, train, fold)
    if not len(inner) or not len(outer):
        return
    early, late = train.take(inner), train.take(outer)
    a = early.scaled().fitted()
    b = late.scaled().like(a)
    errors: dict[tuple, np.ndarray] = {}
    for threshold in (c.thresholds if c.has_threshold and c.thresholds else (None,)):
        try:
            kept = _select(c, threshold, a, early, max(c.k_grid), seed, cars)
        except (ValueError, np.linalg.LinAlgError):
            continue
        for k in c.k_grid:
            k = min(k, len(early.y) - 1, len(kept))
            if k < 1 or len(early.y) < 2 * k:
                continue
            try:
                errors.setdefault((threshold, k), (late.y - _predicted(c, _fitted(c, k, a.only(kept), early), b.only(kept))) ** 2)
            except (ValueError, np.linalg.LinAlgError):
                continue
    ta = train.scaled().fitted()
    tb = test.scaled().like(ta)
    fits: dict[tuple, tuple | None] = {}
    guesses: dict[tuple, np.ndarray] = {}
    for channel in ([None] if c.track == "random" else dict.fromkeys(test.sensor.tolist())):
        mine = np.ones(len(test.y), bool) if channel is None else test.sensor == channel
        judged = late.sensor == channel if TRACKS[c.track][1] == "channel" else np.ones(len(late.y), bool)
        if not errors or not judged.any():
            continue
        best = min(errors, key=lambda g: errors[g][judged].mean())
        threshold, k = best
        if best not in fits:
            fits[best] = None
            if len(train.y) >= 2 * k:
                try:
                    kept = _select(c, threshold, ta, train, k, seed, cars)
                    fits[best] = kept, _fitted(c, min(k, len(train.y) - 1, len(kept)), ta.only(kept), train)
                except (ValueError, np.linalg.LinAlgError):
                    pass
        if fits[best] is None:
            continue
        kept, model = fits[best]
        if best not in guesses:
            guesses[best] = _predicted(c, model, tb.only(kept))
        y, p = test.y[mine], guesses[best][mine]
        coef, intercept = model.linear()
        yield {
            "condition": c.name,
            "track": c.track,
            "seed": seed,
            "channel": channel,
            "k": model.k_used,
            "threshold": threshold,
            "kept": kept,
            "sse": float(((y - p) ** 2).sum()),
            "n_test": len(y),
            "tss": float(((y - train.y.mean()) ** 2).sum()),
            "coef": coef,
            "intercept": intercept,
            "predictions": (test.conc[mine], y, p),
        }


_FOLD = (
    "k int, threshold double, n_features int, selected array<string>, sse double, n_test long, tss double, "
    "coef array<double>, intercept double, predictions array<struct<concentration:double,y:double,pred:double>>"
)


def run_conditions(
    df: DataFrame,
    features: list[str],
    y: str,
    conditions: list[Condition],
    sensor: str = "sensor",
    time: str = "timepoint",
    conc: str = "concentration",
    snr: str = "repeatability_snr",
    min_train_times: int = 3,
    cap_min_train_times: bool = True,
    seeds: tuple[int, ...] = (0,),
    n_splits: int = 5,
    fold_seed: int = 0,
    cars: dict | None = None,
) -> DataFrame:
    """A row per condition, seed and fold: condition, track, seed, channel, t_test, k, threshold, n_features, selected, sse,
    n_test, tss, the fold's model as coef and intercept on its scaled features, and its predictions.

    Conditions without a seeded selector run for the first seed alone. Doses and repeatabilities that df lacks weigh 1.
    The random track's folds have channel null and the fold's number as t_test.
    """
    column = lambda name: (F.col(name) if name in df.columns else F.lit(None)).cast("double")
    kind = dict(df.dtypes)[sensor]
    rows = df.select(
        F.col(sensor).alias("_sensor"),
        F.col(time).cast("double").alias("_t"),
        F.col(y).cast("double").alias("_y"),
        column(conc).alias("_conc"),
        column(snr).alias("_snr"),
        *[F.col(c).cast("double").alias(c) for c in features],
    ).where("_y is not null and not isnan(_y)")
    if any(c.transform == "log" for c in conditions) and not rows.where("_y <= 0").isEmpty():
        raise ValueError("the log transform needs a target above zero throughout")
    times = rows.select("_t").distinct()
    if cap_min_train_times:
        min_train_times = effective_min_train_times(times.count(), min_train_times)
    # One row per time: the test times from it on that have enough times before them.
    ranked = times.withColumn("_n", F.row_number().over(W.orderBy("_t")) - 1)
    later = F.collect_list(F.when(F.col("_n") >= min_train_times, F.col("_t"))).over(W.orderBy("_t").rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("_later", later).select("_t", F.explode("_later").alias("t_test"))

    def jobs(track: str) -> dict[str, list[tuple[Condition, int]]]:
        """Conditions and seeds that one task runs together."""
        out: dict[str, list[tuple[Condition, int]]] = {}
        for c in conditions:
            if c.track == track or (c.track, track) == ("channel", "global"):
                for s in seeds if c.selector in SEEDED else seeds[:1]:
                    dear = c.selector in SEEDED or c.architecture == "nonlinear"
                    out.setdefault(f"{c.name}/{s}" if dear else "plain", []).append((c, s))
        return out

    schema = f"condition string, track string, seed int, channel {kind}, t_test double, {_FOLD}"
    found = []
    for track in ("global", "universal", "random"):
        todo = jobs(track)
        if not todo:
            continue
        keys = ["_job", "t_test"]
        if track == "random":
            joined = rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(fold_seed), "_sensor", "_t"), F.lit(n_splits)).cast("double"))
            joined = joined.withColumn("t_test", F.explode(F.array(*[F.lit(float(k)) for k in range(n_splits)])))
            joined = joined.withColumn("_test", F.col("_fold") == F.col("t_test")).drop("_fold")
        else:
            joined = rows.join(ranked, "_t").withColumn("_test", F.col("_t") == F.col("t_test"))
        if track == "universal":
            tested = rows.select(F.col("_sensor").alias("channel"), F.col("_t").alias("t_test")).distinct()
            joined = joined.join(tested, "t_test").where(F.col("_test") == F.col("_sensor").eqNullSafe(F.col("channel")))
            keys.append("channel")
        joined = joined.withColumn("_job", F.explode(F.array(*[F.lit(j) for j in todo])))
        task = _task(todo, track, features, cars or {}, to_log_columns(features))
        found.append(dealt(joined, keys).groupBy(*keys).applyInArrow(task, schema))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def to_log_columns(features: list[str]) -> list[int]:
    """Positions of the features that the log transform takes logarithms of."""
    from .normalize import normalization_kind

    return [i for i, f in enumerate(features) if normalization_kind(f) == "multiplicative"]


def _task(todo: dict, track: str, features: list[str], cars: dict, logged: list[int]):
    numbers = ["_t", "_y", "_conc", "_snr", "_test"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, found, coded, first = B.read(batches, features, numbers, "_sensor")
        if not first:
            return
        t, y, conc, snr, test = found
        job, t_test = first["_job"], float(first["t_test"])
        names = coded.dictionary.to_pylist() + [None]
        # Numbers of the sensors in their order, missing ones last.
        ranked = sorted(range(len(names) - 1), key=names.__getitem__) + [len(names) - 1]
        place = np.empty(len(names), int)
        place[ranked] = np.arange(len(names))
        sensor = place[np.asarray(coded.indices.fill_null(len(names) - 1))]
        kind = coded.type.value_type
        every = Rows(x, np.arange(len(t)), y, t, sensor, t, conc, snr)
        order = np.lexsort((y, sensor, t, test))
        n = int((test == 0).sum())
        train, tested = every.take(order[:n]), every.take(order[n:])
        for c, seed in todo[job]:
            log = tuple(logged) if c.transform == "log" else ()
            for r in evaluate_folds(c, replace(train, logged=log), replace(tested, logged=log), seed, cars, t_test):
                yield _row(r, t_test, features, None if r["channel"] is None else names[ranked[r["channel"]]], kind)

    return run


def _row(r: dict, t_test: float, features: list[str], channel, kind: pa.DataType) -> pa.RecordBatch:
    """One result; its predictions go over as arrays."""
    kept = [features[i] for i in r["kept"]]
    points = [pa.array(np.asarray(v, float), pa.float64(), from_pandas=True) for v in r["predictions"]]
    found = pa.ListArray.from_arrays(pa.array([0, r["n_test"]], pa.int32()), pa.StructArray.from_arrays(points, ["concentration", "y", "pred"]))
    double = lambda v: pa.array([v], pa.float64(), from_pandas=True)
    columns = {
        "condition": pa.array([r["condition"]]),
        "track": pa.array([r["track"]]),
        "seed": pa.array([r["seed"]], pa.int32()),
        "channel": pa.array([channel], kind),
        "t_test": double(t_test),
        "k": pa.array([r["k"]], pa.int32()),
        "threshold": double(r["threshold"]),
        "n_features": pa.array([len(kept)], pa.int32()),
        "selected": pa.array([kept], pa.list_(pa.string())),
        "sse": double(r["sse"]),
        "n_test": pa.array([r["n_test"]], pa.int64()),
        "tss": double(r["tss"]),
        "coef": pa.array([r["coef"]], pa.list_(pa.float64())),
        "intercept": double(r["intercept"]),
        "predictions": found,
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def summarize(results: DataFrame) -> DataFrame:
    """condition, track and pooled metrics, averaged over seeds, best first."""
    keys = ["condition", "track"]
    return mean_over_seeds(pooled(results, [*keys, "seed"]), keys).orderBy(F.col("rmsep").asc_nulls_last(), "condition")


def per_channel(results: DataFrame) -> DataFrame:
    """Pooled metrics of each channel of the channel track's conditions."""
    return pooled(results.where("track = 'channel'"), ["condition", "channel"])


def predictions(results: DataFrame) -> DataFrame:
    """condition, seed, sensor, t_test, concentration, y, pred, residual: a row per test row."""
    return results.select("condition", "seed", F.col("channel").alias("sensor"), "t_test", F.inline("predictions")).withColumn("residual", F.col("pred") - F.col("y"))


def selection_frequency(results: DataFrame, features: list[str] | None = None) -> DataFrame:
    """condition, feature, frequency over folds and seeds; with features given, those never selected too, at 0."""
    n = results.groupBy("condition").agg(F.count(F.lit(1)).alias("n"))
    found = results.select("condition", F.explode("selected").alias("feature")).groupBy("condition", "feature").agg(F.count(F.lit(1)).alias("k"))
    if features is not None:
        every = n.select("condition", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
        found = every.join(found, ["condition", "feature"], "left")
    return found.join(n, "condition").select("condition", "feature", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("frequency"))


def feature_ranking(frequencies: DataFrame) -> DataFrame:
    """feature, mean_selection_frequency, n_conditions_selected over all conditions, most selected first."""
    g = frequencies.groupBy("feature").agg(
        F.avg("frequency").alias("mean_selection_frequency"), F.sum((F.col("frequency") > 0).cast("long")).alias("n_conditions_selected")
    )
    return g.orderBy(F.col("mean_selection_frequency").desc(), "feature")


_MODEL = "condition string, features array<string>, center array<double>, iqr array<double>, median array<double>, x_mean array<double>, coef array<double>, intercept double, k int, log boolean"


def freeze(df: DataFrame, features: list[str], y: str, condition: Condition, k: int) -> DataFrame:
    """One row: a linear model fitted on all rows, with its imputation and robust scaling.

    Quantiles are worked out per feature, products of the scaled features by aggregates over blocks of rows, so the
    driver gets numbers of features by features alone, however many rows there are. Missing values take the median,
    which the centre and the quartiles are of the filled values.
    """
    if condition.architecture not in ("linear", "weighted", "log"):
        raise ValueError("only models linear in the features can be frozen as coefficients")
    rows = df.select(F.col(y).cast("double").alias("_y"), *[_clean(c).alias(c) for c in features], _weight(df, condition).alias("_w")).where("_y is not null")
    if condition.transform == "log":
        rows = to_log(rows, features)
    log = condition.transform == "log" or condition.architecture == "log"
    if log:
        rows = rows.withColumn("_y", F.ln(F.greatest("_y", F.lit(LOG_FLOOR))))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(features)])).alias("p")).select("p.*")
    median = {r.i: r.m or 0.0 for r in long.groupBy("i").agg(F.median("v").alias("m")).collect()}
    median = [float(median.get(i, 0.0)) for i in range(len(features))]
    filled = rows.select("_y", "_w", *[F.coalesce(F.col(c), F.lit(m)).alias(c) for c, m in zip(features, median, strict=True)])
    long = filled.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(features)])).alias("p")).select("p.*")
    found = {r.i: r.q for r in long.groupBy("i").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    center = [float(found[i][1]) for i in range(len(features))]
    iqr = [float(found[i][2] - found[i][0]) or 1.0 for i in range(len(features))]
    scaled = filled.select("_w", "_y", *[((F.col(c) - m) / s).alias(c) for c, m, s in zip(features, center, iqr, strict=True)])
    gram, n = domain.gramian(scaled, [*features, "_y"], "_w")
    model = M.PLS(k).fit_gramian(gram, n)
    row = (condition.name, features, center, iqr, median, model.x_mean.tolist(), model.coef[:, 0].tolist(), float(model.y_mean[0]), model.k_used, log)
    return df.sparkSession.createDataFrame([row], _MODEL)


def _clean(name: str):
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _weight(df: DataFrame, c: Condition):
    if c.architecture == "weighted" and "concentration" in df.columns:
        return 1 / F.greatest(F.coalesce(F.col("concentration").cast("double"), F.lit(1.0)), F.lit(1.0))
    return F.lit(1.0)


def freeze_top(df: DataFrame, features: list[str], y: str, results: DataFrame, queue: list[Condition], name: str | None = None, stability_min: float = 0.5) -> DataFrame:
    """The best condition of a run (or the one named) fitted on all rows.

    Its commonest number of components, and the features selected in stability_min of its folds; if there are none, the
    3 k (5 at least) most selected. The summaries that the driver gets have a row per condition or feature.
    """
    ranked = [r for r in summarize(results).collect() if r.rmsep is not None and np.isfinite(r.rmsep)]
    if not ranked:
        raise ValueError("no condition with a finite error in this run")
    name = name or ranked[0].condition
    chosen = {c.name: c for c in queue}.get(name)
    if chosen is None or name not in {r.condition for r in ranked}:
        raise ValueError(f"condition {name!r} is not in this run")
    own = results.where(F.col("condition") == name)
    k = own.groupBy("k").count().orderBy(F.col("count").desc(), "k").first().k
    kept = features
    if chosen.selector != "none":
        frequency = {r.feature: r.frequency for r in selection_frequency(own).collect()}
        kept = [f for f in features if frequency.get(f, 0) >= stability_min]
        if not kept:
            top = sorted(frequency, key=lambda f: (-frequency[f], f))[: max(3 * k, 5)]
            kept = [f for f in features if f in set(top)]
    return freeze(df, kept, y, chosen, k)


def recalibrate(model: DataFrame, df: DataFrame) -> DataFrame:
    """Adds score: frozen imputation, scaling and coefficients as column expressions. model has one row."""
    m = model.first()
    missing = [f for f in m.features if f not in df.columns]
    if missing:
        raise ValueError(f"missing model features: {missing}")
    d = df.withColumns({f"_z_{f}": (F.coalesce(F.when(~F.isnan(F.col(f)), F.col(f)), F.lit(md)) - c) / s for f, c, s, md in zip(m.features, m.center, m.iqr, m.median, strict=True)})
    names = [f"_z_{f}" for f in m.features]
    return domain.linear_score(d, names, list(m.x_mean), list(m.coef), m.intercept, m.log).drop(*names)


def coral_transform(df: DataFrame, columns: list[str], reference, batch, eps: float = 1e-6) -> DataFrame:
    """batch rows whitened by their own covariance and coloured by the reference's; moments come from one pass each."""
    p = len(columns)

    def root(c: np.ndarray, power: float) -> np.ndarray:
        values, vectors = np.linalg.eigh(c + eps * np.eye(p))
        return vectors @ np.diag(np.maximum(values, eps) ** power) @ vectors.T

    ref, target, _ = domain.mean_and_covariance(df.where(reference), columns)
    own, source, _ = domain.mean_and_covariance(df.where(batch), columns)
    a = root(source, -0.5) @ root(target, 0.5)
    centred = F.array(*[F.col(c).cast("double") - float(m) for c, m in zip(columns, own, strict=True)])
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in a[:, j]]) for j in range(p)])
    product = F.transform(weights, lambda w: F.aggregate(F.zip_with(w, F.col("_centred"), lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x))
    moved = df.where(batch).withColumn("_centred", centred).withColumn("_moved", product)
    return moved.withColumns({c: F.get("_moved", F.lit(j)) + float(ref[j]) for j, c in enumerate(columns)}).drop("_centred", "_moved")


def grouped_cv(
    df: DataFrame,
    predictors: list[str],
    y: str,
    groups: list[list[str]],
    time: str,
    kind: str,
    ids: list[str] | None = None,
    min_train: int = 8,
    min_train_times: int = 3,
    k_intercept: float = 2.0,
    k_slope: float = 4.0,
) -> DataFrame:
    """Rows (group, time, y, pred, base_pred, train_mean) per forward fold in time.

    groups: the columns of each level, outer to inner; group is the last one. The age, the time since the first of the
    row's ids (the last level's columns if None), is a predictor too. kind "ridge": leave-one-out ridge, then for each
    level offsets and age slopes of what is left, shrunk by n / (n + k_intercept) and n / (n + k_slope). kind
    "logistic": probabilities of y = 1; base_pred is the training share.
    """
    ids = ids or groups[-1]
    age = F.col(time).cast("double") - F.min(F.col(time).cast("double")).over(W.partitionBy(*ids))
    name = lambda level: F.concat_ws("|", *[F.col(c).cast("string") for c in level])
    levels = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(
        *[name(g).alias(n) for g, n in zip(groups, levels, strict=True)],
        F.col(time).cast("double").alias("_t"),
        F.col(y).cast("double").alias("_y"),
        age.alias("_age"),
        *[F.col(c).cast("double").alias(c) for c in predictors],
    ).where("_y is not null and not isnan(_y)")
    ranked = rows.select("_t").distinct().withColumn("_n", F.row_number().over(W.orderBy("_t")) - 1)
    later = F.collect_list(F.when(F.col("_n") >= min_train_times, F.col("_t"))).over(W.orderBy("_t").rowsBetween(0, W.unboundedFollowing))
    joined = rows.join(ranked.withColumn("_later", later).select("_t", F.explode("_later").alias("t_test")), "_t")

    def effects(g: np.ndarray, t: np.ndarray, r: np.ndarray) -> dict:
        """Shrunk offset, shrunk age slope and mean age of each group."""
        out = {}
        for k in np.unique(g):
            here = g == k
            n, own = int(here.sum()), r[here]
            moved = t[here] - t[here].mean()
            spread = moved @ moved
            slope = moved @ (own - own.mean()) / spread * n / (n + k_slope) if spread > 0 else 0.0
            out[k] = own.mean() * n / (n + k_intercept), slope, t[here].mean()
        return out

    # A row's groups of all levels as one value, of which there are as many as groups of the last level.
    names, mark = [*predictors, "_age"], ""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, found, coded, first = B.read(batches, names, ["_t", "_y"], "_groups")
        if not first:
            return
        t, target = found
        test = t == first["t_test"]
        if (~test).sum() < min_train or not test.any() or (kind == "logistic" and len(set(target[~test])) < 2):
            return
        labels = [tuple(v.split(mark)) for v in coded.dictionary.to_pylist()]
        codes = np.asarray(coded.indices)
        place = np.empty(len(labels), int)
        place[sorted(range(len(labels)), key=labels.__getitem__)] = np.arange(len(labels))
        order = np.lexsort((target, place[codes], t, test))
        n = int((~test).sum())
        train, tested = order[:n], order[n:]
        old, y = x[:, -1], target[train]
        a = B.Scaled(x, train).fitted(impute=False)
        b = B.Scaled(x, tested).like(a)
        mean = y.mean()
        if kind == "logistic":
            w, c = B.logistic(a, y)
            pred = b.apply(lambda z: 1 / (1 + np.exp(-(z @ w + c))))
            base = np.full(len(tested), mean)
        else:
            m = B.ridge_loo(a, y)
            base = b.apply(m.predict)
            pred, left = base.copy(), y - a.apply(m.predict)
            for i in range(len(levels)):
                number = np.unique([v[i] for v in labels], return_inverse=True)[1]
                g = number[codes]
                # Offset, slope and mean age by the group's number, 0 for those without training rows.
                known = np.zeros((number.max() + 1, 3))
                for key, effect in effects(g[train], old[train], left).items():
                    known[key] = effect
                own, extra = known[g[train]], known[g[tested]]
                left = left - own[:, 0] - own[:, 1] * (old[train] - own[:, 2])
                pred += extra[:, 0] + extra[:, 1] * (old[tested] - extra[:, 2])
        last = pa.array([v[-1] for v in labels], pa.string()).take(pa.array(codes[tested]))
        columns = [last, *(pa.array(v, pa.float64(), from_pandas=True) for v in (t[tested], target[tested], pred, base, np.full(len(tested), mean)))]
        yield pa.RecordBatch.from_arrays(columns, ["group", "time", "y", "pred", "base_pred", "train_mean"])

    rows = joined.select("t_test", "_t", "_y", *names, F.concat_ws(mark, *levels).alias("_groups"))
    return dealt(rows, ["t_test"]).groupBy("t_test").applyInArrow(one, "group string, time double, y double, pred double, base_pred double, train_mean double")


def condition_config(c: Condition) -> dict:
    return asdict(c)


def _batches(queue: list[Condition]) -> list[list[Condition]]:
    return [[c for c in queue if c.batch == b] for b in dict.fromkeys(c.batch for c in queue)]


def run_queue(df: DataFrame, features: list[str], y: str, queue: list[Condition], gate=None, batch_gate=None, **kw) -> list[tuple[Condition, dict]]:
    """Conditions batch by batch (Condition.batch), best first.

    gate(condition, metrics) may stop by returning False; batch_gate(results, rest) may replace the rest of the queue.
    Without gates all conditions are one job.
    """
    if gate is None and batch_gate is None:
        groups = [queue]
    else:
        groups = _batches(queue)
    done: list[tuple[Condition, dict]] = []
    while groups:
        batch = groups.pop(0)
        # A few rows: one per condition.
        rows = {r.condition: r.asDict() for r in summarize(run_conditions(df, features, y, batch, **kw)).collect()}
        for c in batch:
            done.append((c, rows.get(c.name, {})))
            if gate is not None and gate(c, rows.get(c.name, {})) is False:
                groups = []
                break
        if batch_gate is not None and groups:
            rest = batch_gate(done, [c for g in groups for c in g])
            if rest is not None:
                groups = _batches(rest)
    return sorted(done, key=lambda x: x[1].get("rmsep") or float("inf"))


def _with_later_times(rows: DataFrame, time: str) -> DataFrame:
    """rows once for each time t_test from theirs on, by an equal join on time."""
    every = F.collect_list("_u").over(W.orderBy("_u").rowsBetween(0, W.unboundedFollowing))
    times = rows.select(F.col(time).cast("double").alias("_u")).distinct().withColumn("_later", every).select("_u", F.explode("_later").alias("t_test"))
    return rows.withColumn("_u", F.col(time).cast("double")).join(times, "_u").drop("_u")


def _fold_statistics(rows: DataFrame, predictors: list[str]) -> dict[float, dict]:
    """Per test time: training rows n, median log dose, and fill, mean and deviation of each predictor.

    A row per test time comes to the driver. Medians of predictors are worked out only where values are missing.
    """
    train = F.col("timepoint") < F.col("t_test")
    finite = {c: _clean(c) for c in predictors}

    def collected(values: dict) -> list:
        aggs = [F.count(F.when(train, 1)).alias("n"), F.median(F.when(train, F.col("_x"))).alias("middle")]
        for i, v in enumerate(values.values()):
            own = F.when(train, v)
            aggs += [F.avg(own).alias(f"mean{i}"), F.stddev_pop(own).alias(f"sd{i}"), (F.max(own) > F.min(own)).alias(f"varies{i}"), F.count_if(v.isNull()).alias(f"gaps{i}")]
        return _with_later_times(rows, "timepoint").groupBy("t_test").agg(*aggs).collect()

    found = collected(finite)
    fill: dict[float, list[float]] = {r.t_test: [0.0] * len(predictors) for r in found}
    gaps = [i for i in range(len(predictors)) if any(r[f"gaps{i}"] for r in found)]
    if gaps:
        medians = [F.median(F.when(train, finite[predictors[i]])).alias(f"m{i}") for i in gaps]
        for r in _with_later_times(rows, "timepoint").groupBy("t_test").agg(*medians).collect():
            for i in gaps:
                fill[r.t_test][i] = float(r[f"m{i}"] or 0.0)
        table = F.create_map(*[F.lit(v) for t, f in fill.items() for v in (t, F.array(*[F.lit(m) for m in f]))])
        found = collected({c: F.coalesce(v, F.get(F.element_at(table, F.col("t_test")), F.lit(i))) for i, (c, v) in enumerate(finite.items())})
    out = {}
    for r in found:
        sd = [float(r[f"sd{i}"]) if r[f"varies{i}"] and r[f"sd{i}"] > 0 else 1.0 for i in range(len(predictors))]
        mean = [float(r[f"mean{i}"] or 0.0) for i in range(len(predictors))]
        out[float(r.t_test)] = {"n": r.n, "middle": r.middle, "fill": np.array(fill[r.t_test]), "mean": np.array(mean), "sd": np.array(sd)}
    return out


def _scaled(x: np.ndarray, s: dict) -> np.ndarray:
    return (np.where(np.isfinite(x), x, s["fill"]) - s["mean"]) / s["sd"]


def _curves(rows: DataFrame, predictors: list[str], keys: list[str]) -> DataFrame:
    """keys, predictors, _doses and the coefficients _l1, _l0 of a line and _q2, _q1, _q0 of a parabola through each group."""
    d = centred(rows.dropna(subset=keys), keys, F.lit(1.0), x=F.col("_x"), y=F.col("_y"))
    x, y = F.col("_c_x"), F.col("_c_y")
    slope, intercept = weighted_line(F.lit(1.0))
    sums = {"s0": F.count(F.lit(1)), "s2": F.sum(x * x), "s3": F.sum(x * x * x), "t1": F.sum(x * y), "mx": F.max("_m_x"), "my": F.max("_m_y")}
    g = d.groupBy(*keys).agg(
        F.size(F.collect_set("_x")).alias("_doses"),
        *[F.min_by(c, "concentration").alias(c) for c in predictors],
        slope.alias("_l1"),
        intercept.alias("_l0"),
        parabola(F.lit(1.0)).alias("_q2"),
        *[v.alias(f"_{n}") for n, v in sums.items()],
    )
    # About the mean dose y = my + top (x^2 - s2 / s0) + tilt x.
    top, mx = F.col("_q2"), F.col("_mx")
    tilt = F.try_divide(F.col("_t1") - top * F.col("_s3"), F.col("_s2"))
    level = F.col("_my") - top * F.col("_s2") / F.col("_s0")
    return g.withColumns({"_q1": tilt - 2 * top * mx, "_q0": level - tilt * mx + top * mx * mx})


def _nearest_root(coefs: np.ndarray, value: np.ndarray, middle: float) -> np.ndarray:
    """The real root of polynomials (a row each, highest power first, second degree at most) less value that is nearest middle."""
    c, b = coefs[:, -1] - value, coefs[:, -2]
    a = coefs[:, 0] if coefs.shape[1] == 3 else np.zeros(len(b))
    with np.errstate(all="ignore"):
        line = np.where(b != 0, -c / b, np.nan)
        disc = b * b - 4 * a * c
        # Without cancellation; pairs whose imaginary part is rounding count as one real root.
        q = -(b + np.where(b < 0, -1.0, 1.0) * np.sqrt(np.maximum(disc, 0))) / 2
        roots = np.stack([q / a, np.where(q != 0, c / q, 0.0)])
        away = np.abs(roots - middle)
        best = np.where(~(away[1] < away[0]), roots[0], roots[1])
        flat = np.sqrt(np.maximum(-disc, 0)) / (2 * np.abs(a))
        best = np.where(disc >= 0, best, np.where(flat < 1e-9, -b / (2 * a), np.nan))
    return np.where(a != 0, best, line)


def target_framings(df: DataFrame, predictors: list[str], keys: list[str], min_train: int = 8, k: int = 2) -> DataFrame:
    """framing, n, rmsep and log_conc_rmse of four ways to the response at a dose, under forward folds in time.

    current: the response itself; sensitivity: slope and intercept on log dose, predicted per sensor and time;
    quadratic: three curve coefficients; interaction: predictors times log dose. Doses are recovered by inverting the
    predicted curve, at the root nearest the training median.

    Curves are fitted once for all folds; models come from sums of products per fold, so no task holds a fold's rows.
    """
    rows = df.select(*[F.col(c).alias(c) for c in keys], "concentration", "response", *predictors).where("concentration > 0 and response is not null")
    rows = rows.withColumns({"_x": F.log10("concentration"), "_y": F.col("response").cast("double")})
    stats = {t: s for t, s in _fold_statistics(rows, predictors).items() if s["n"] >= min_train}
    p = len(predictors)
    values = ["t_test", *predictors]

    def products(d: DataFrame, columns: list[str], design, by: str) -> dict:
        d = d.where(F.col("timepoint") < F.col("t_test")).where(F.col("t_test").isin([float(t) for t in stats]))
        # Sums per test time: their number of rows is that of times.
        return {r.by: (np.frombuffer(r.blob), r.n) for r in domain._products(d, columns, design, None, by).collect()} if stats else {}

    def by_row(v):
        a, x, y = _scaled(v[:, 1 : 1 + p], stats[v[0, 0]]), v[:, 1 + p], v[:, 2 + p]
        return np.column_stack([np.ones(len(v)), a, x, a * x[:, None], y])

    def by_curve(v):
        return np.column_stack([np.ones(len(v)), _scaled(v[:, 1 : 1 + p], stats[v[0, 0]]), v[:, 1 + p :]])

    def fitted(gram, n, design, responses):
        """The model of the design's columns on the responses', None without a column that varies."""
        at = [0, *design, *responses]
        try:
            return M.PLS(max(1, min(k, len(design), n - 1))).fit_gramian(gram[np.ix_(at, at)], n, len(responses))
        except ValueError:
            return None

    models: dict[float, dict] = {t: {} for t in stats}
    for t, (blob, n) in products(_with_later_times(rows, "timepoint"), [*values, "_x", "_y"], by_row, "t_test").items():
        gram = blob.reshape(2 * p + 3, -1)
        models[t]["current"] = fitted(gram, n, range(1, p + 2), [2 * p + 2])
        models[t]["interaction"] = fitted(gram, n, range(1, 2 * p + 2), [2 * p + 2])
    degree = {"sensitivity": ("_l1", "_l0"), "quadratic": ("_q2", "_q1", "_q0")}
    named = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(c)).alias("size"), *[(F.col(c[i]) if i < len(c) else F.lit(0.0)).alias(f"_p{i}") for i in range(3)]) for name, c in degree.items()])
    curves = _with_later_times(_curves(rows, predictors, keys), "timepoint").select("*", F.explode(named).alias("_f")).select("*", "_f.*")
    curves = curves.where("_doses >= size").withColumn("_by", F.concat_ws("|", "name", F.col("t_test").cast("string")))
    for key, (blob, n) in products(curves, [*values, "_p0", "_p1", "_p2"], by_curve, "_by").items():
        name, t = key.split("|")
        gram = blob.reshape(p + 4, -1)
        models[float(t)][name] = fitted(gram, n, range(1, p + 1), range(p + 1, p + 1 + len(degree[name]))) if n >= 3 else None

    def judged(batches):
        for batch in batches:
            v = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns], axis=1)
            out = []
            for t in np.unique(v[:, 0]):
                here = v[v[:, 0] == t]
                b, x, y = _scaled(here[:, 1 : 1 + p], stats[t]), here[:, 1 + p], here[:, 2 + p]
                for name, m in models[t].items():
                    if m is None:
                        continue
                    if name in degree:
                        c = m.predict(b)
                        pred, back = sum(c[:, -1 - i] * x**i for i in range(c.shape[1])), _nearest_root(c, y, stats[t]["middle"])
                    else:
                        more = [b * x[:, None]] if name == "interaction" else []
                        pred = m.predict(np.column_stack([b, x, *more]))
                        slope = m.coef[p, 0] + (b @ m.coef[p + 1 :, 0] if more else np.zeros(len(b)))
                        back = np.where(np.abs(slope) > 1e-12, x + (y - pred) / np.where(slope == 0, 1, slope), np.nan)
                    e, g = y - pred, x - back
                    e, g = e[~np.isnan(e)], g[~np.isnan(g)]
                    out.append((name, len(here), float(e @ e), len(e), float(g @ g), len(g)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["framing", "n", "ee", "ne", "gg", "ng"])

    tested = rows.withColumn("t_test", F.col("timepoint").cast("double")).where(F.col("t_test").isin([float(t) for t in stats]))
    got = tested.select(*values, "_x", "_y").mapInArrow(judged, "framing string, n long, ee double, ne long, gg double, ng long")
    mean = lambda s, n: F.sqrt(F.try_divide(F.sum(s), F.sum(n)))
    return got.groupBy("framing").agg(F.sum("n").alias("n"), mean("ee", "ne").alias("rmsep"), mean("gg", "ng").alias("log_conc_rmse"))


def dose_curve_cv(df: DataFrame, predictors: list[str], responses: list[str], sensor: str, time: str, k: int = 2, min_train: int = 8) -> DataFrame:
    """t_test, response, n, sse: whole dose curves predicted at once by a model with several responses."""
    rows = df.select(F.col(sensor).alias("_s"), F.col(time).cast("double").alias("_t"), *[F.col(f"`{c}`").cast("double").alias(c) for c in [*predictors, *responses]])
    joined = _with_later_times(rows, "_t")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_s"], kind="stable")
        test = (pdf._t == pdf.t_test).to_numpy()
        y = pdf[responses].to_numpy(float)
        whole = np.isfinite(y).all(axis=1)
        train = ~test & whole
        columns = ["t_test", "response", "n", "sse"]
        if train.sum() < min_train:
            return pd.DataFrame(columns=columns)
        x = pdf[predictors].to_numpy(float)
        a, b = _prepare(x[train], x[test])
        if not (np.ptp(a, axis=0) > 0).any():
            return pd.DataFrame(columns=columns)
        p = M.PLS(max(1, min(k, a.shape[1], len(a) - 1))).fit(a, y[train]).predict(b).reshape(test.sum(), -1)
        error = np.where(np.isfinite(y[test]), (y[test] - p) ** 2, np.nan)
        return pd.DataFrame([[pdf.t_test.iloc[0], c, int(np.isfinite(error[:, j]).sum()), float(np.nansum(error[:, j]))] for j, c in enumerate(responses)], columns=columns)

    return dealt(joined, ["t_test"]).groupBy("t_test").applyInPandas(one, "t_test double, response string, n long, sse double")


def monitor(model: DataFrame, new: DataFrame, reference: DataFrame, by: str = "timepoint", limit: float = 3.0) -> DataFrame:
    """by, n, mean score, distance and flag of a batch per timepoint against the reference rows."""
    names = list(model.first().features)
    scored = recalibrate(model, new).groupBy(by).agg(F.avg("score").alias("mean_score"))
    both = new.select(by, *names, F.lit(False).alias("_ref")).unionByName(reference.select(F.lit(None).cast(dict(new.dtypes)[by]).alias(by), *names, F.lit(True).alias("_ref")))
    d = domain.coral_distance(both, names, F.col("_ref"), ~F.col("_ref"), [by])
    return domain.flag_extrapolation(scored.join(d, by), limit)
