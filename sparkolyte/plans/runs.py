"""Discovery runs with their records: tables of folds, predictions and rankings, settings, a log and a report."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery as R
from ..operators import evaluation as E
from ..sources import artifacts

_KEYS = ["condition", "track"]


@dataclass(frozen=True)
class Profile:
    """How long a run may take: seeds, bootstrap resamples, training times and the schedule of CARS."""

    seeds: tuple[int, ...] = (0,)
    n_boot: int = 2000
    min_train_times: int = 3
    cars: dict = field(default_factory=dict)


FULL = Profile(seeds=(0, 1, 2))
FAST = Profile(n_boot=200, cars={"k_max": 3, "generations": 12, "n_folds": 3, "patience": 4})
PROFILES = {"full": FULL, "default": Profile(), "fast": FAST}


def run_discovery(
    spark: SparkSession,
    df: DataFrame,
    features: list[str],
    target: str,
    out: str,
    queue: list[R.Condition] | None = None,
    profile: Profile = PROFILES["default"],
    pin: artifacts.Pin | None = None,
    **kw,
) -> DataFrame:
    """Run a queue and write its records under out; the ranking is returned.

    folds (a directory per condition, with each fold's model), predictions, metrics, feature_stability, summary,
    report/condition_ranking, report/feature_ranking, report/discovery_summary.md, run_config.json, conditions.json and
    logs/run.log. Tables are written first and read again, so a condition is fitted once.
    """
    queue = R.baseline_queue() if queue is None else queue
    log = [_stamp(f"START {len(queue)} conditions, {len(features)} features, target {target}")]
    found = R.run_conditions(
        df, features, target, queue, min_train_times=profile.min_train_times, seeds=profile.seeds, cars=profile.cars, **kw
    )
    artifacts.write_table(found, f"{out}/folds", ["condition"])
    folds = load_folds(spark, out)
    artifacts.write_table(R.predictions(folds), f"{out}/predictions", ["condition"])
    artifacts.write_table(R.selection_frequency(folds, features), f"{out}/feature_stability", ["condition"])
    artifacts.write_table(folds.drop("coef", "intercept", "predictions", "selected"), f"{out}/summary")
    ranking = R.summarize(folds)
    interval = E.bootstrap_by(folds.select("condition", "channel", "t_test", "seed", "sse", "n_test"), ["condition"], profile.n_boot)
    ranking = ranking.join(interval, "condition", "left").orderBy(F.col("rmsep").asc_nulls_last(), "condition")
    artifacts.write_table(ranking, f"{out}/report/condition_ranking")
    artifacts.write_table(R.per_channel(folds), f"{out}/metrics_per_channel")
    stability = artifacts.read_table(spark, f"{out}/feature_stability")
    artifacts.write_table(R.feature_ranking(stability), f"{out}/report/feature_ranking")
    # A row per condition.
    ranked = artifacts.read_table(spark, f"{out}/report/condition_ranking").orderBy(F.col("rmsep").asc_nulls_last(), "condition")
    rows = ranked.collect()
    log += [_stamp(f"DONE  {r.condition}: rmsep {_number(r.rmsep)} over {r.n_folds} folds") for r in rows]
    done = {r.condition for r in rows}
    log += [_stamp(f"NONE  {c.name}: no usable fold") for c in queue if c.name not in done]
    artifacts.write_json(spark, f"{out}/conditions.json", {"conditions": [R.condition_config(c) for c in queue]})
    record = {
        "target": target,
        "profile": asdict(profile),
        "conditions": [c.name for c in queue],
        "dataset": {"n_samples": df.count(), "n_features": len(features)},
        "extraction": asdict(pin) if pin else None,
    }
    artifacts.write_json(spark, f"{out}/run_config.json", record)
    artifacts.write_text(spark, f"{out}/logs/run.log", "\n".join(log) + "\n")
    artifacts.write_text(spark, f"{out}/report/discovery_summary.md", report(rows))
    return ranked


def _stamp(text: str) -> str:
    return f"[{dt.datetime.now():%H:%M:%S}] {text}"


def _number(x: float | None) -> str:
    return "n/a" if x is None or x != x else f"{x:.3f}"


def report(rows: list) -> str:
    """A ranked table of conditions, as Markdown."""
    lines = ["# Discovery summary", "", "Conditions by pooled error with bootstrap intervals: candidates to validate, not a final model.", ""]
    lines += ["| rank | condition | track | RMSEP | 95 % interval | Q2 | folds |", "|-|-|-|-|-|-|-|"]
    for i, r in enumerate(rows, 1):
        interval = f"{_number(r.lo)} to {_number(r.hi)}" if r.lo is not None else "n/a"
        lines.append(f"| {i} | {r.condition} | {r.track} | {_number(r.rmsep)} | {interval} | {_number(r.q2)} | {r.n_folds} |")
    return "\n".join(lines) + "\n"


def load_folds(spark: SparkSession, out: str, condition: str | None = None) -> DataFrame:
    """Fold results with their models; of one condition its directory alone is read."""
    folds = artifacts.read_table(spark, f"{out}/folds").withColumn("condition", F.col("condition").cast("string"))
    return folds if condition is None else folds.where(F.col("condition") == condition)


def predictions_of(spark: SparkSession, out: str, condition: str) -> DataFrame:
    """sensor, t_test, concentration, y, pred and residual of a condition, with device and channel apart."""
    d = artifacts.read_table(spark, f"{out}/predictions").where(F.col("condition") == condition)
    parts = F.split(F.col("sensor").cast("string"), ":")
    return d.withColumn("device", F.when(F.size(parts) > 1, F.get(parts, F.lit(0)))).withColumn("channel", F.element_at(parts, -1))


def fold_names(spark: SparkSession, out: str, condition: str) -> DataFrame:
    """channel, t_test, seed and name of a condition's folds."""
    name = F.concat(F.lit("ch"), F.coalesce(F.col("channel").cast("string"), F.lit("-")), F.lit("_t"), F.col("t_test").cast("long").cast("string"))
    return load_folds(spark, out, condition).select("channel", "t_test", "seed", name.alias("name"))


def load_fold(spark: SparkSession, out: str, condition: str, channel, t_test: float, seed: int = 0):
    """One fold's row, or None: filters on its keys reach the files."""
    d = load_folds(spark, out, condition).where((F.col("t_test") == float(t_test)) & (F.col("seed") == seed))
    return d.where(F.col("channel").eqNullSafe(F.lit(channel))).first()


def run_record(spark: SparkSession, out: str) -> dict:
    return artifacts.read_json(spark, f"{out}/run_config.json")


def run_label(spark: SparkSession, out: str) -> str:
    """The run's name from its sweep manifest, or marked as unverified without one."""
    path = f"{out}/sweep_manifest.json"
    name = out.rstrip("/").rsplit("/", 1)[-1]
    return str(artifacts.read_json(spark, path).get("label", name)) if artifacts.exists(spark, path) else f"unverified-{name}"


def fold_spread(folds: DataFrame) -> DataFrame:
    """condition, n_folds, quartiles and extremes of the folds' own errors, by median."""
    own = F.sqrt(F.col("sse") / F.col("n_test"))
    q = F.percentile(own, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = folds.groupBy("condition").agg(F.count(F.lit(1)).alias("n_folds"), F.min(own).alias("low"), q.alias("q"), F.max(own).alias("high"))
    d = g.select("condition", "n_folds", "low", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"), "high")
    return d.orderBy("median", "condition")


def conditions_table(spark: SparkSession, queue: list[R.Condition]) -> DataFrame:
    """A row per condition with its settings and batch."""
    rows = [(c.name, c.batch, c.architecture, c.track, c.selector, list(c.k_grid), list(c.thresholds), c.weighted_by, c.transform) for c in queue]
    schema = "condition string, batch int, architecture string, track string, selector string, k_grid array<int>, thresholds array<double>, weighted_by string, transform string"
    return spark.createDataFrame(rows, schema)


def baseline_run(df: DataFrame, features: list[str], target: str, k: int = 2, min_train_times: int = 3) -> DataFrame:
    """Folds of the plain linear model with k components and no choice to make."""
    return R.run_conditions(df, features, target, [R.Condition("linear", k_grid=(k,))], min_train_times=min_train_times)
