"""Command line: extract, discover, freeze, freeze-top, deploy, features. Named errors end with status 2."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .operators import discovery as R
from .operators import domain
from .operators import dose as D
from .operators import fits as T
from .plans import catalog, runs
from .plans import extract as X
from .sources import artifacts, demo

# Columns that are never predictors.
RESERVED = {
    "device", "date", "channel", "sensor", "devicetype", "timepoint", "time_index", "concentration", "NormIpeak", "noise_floor",
    "rep_std", "repeatability_snr", "snr", "rms_snr", "peak_height", "peak_area", "peak_fwhm", "mean_Ibg", "peak_at_edge",
    "peak_area_clipped", "dose_response_r", "n_conc",
}
# Targets made from a sensor's dose curve at each visit.
CURVE_TARGETS = ("sensitivity", "sensitivity_intercept", "sensitivity_curvature", "sat_imax", "sat_kd", "sat_logkd", "hill_imax", "hill_kd", "hill_n", "power_a", "power_beta")


def predictors(df: DataFrame) -> list[str]:
    """Numeric columns that aren't reserved and hold a value."""
    kinds = ("double", "float", "int", "bigint")
    names = [n for n, t in df.dtypes if n not in RESERVED and n not in CURVE_TARGETS and not n.startswith("_") and t in kinds]
    counts = df.agg(*[F.count(n).alias(n) for n in names]).first() if names else {}
    return [n for n in names if counts[n]]


def with_sensor(df: DataFrame) -> DataFrame:
    return df.withColumn("sensor", F.concat_ws(":", F.col("device").cast("string"), F.col("channel").cast("string")))


def curve_targets(df: DataFrame) -> DataFrame:
    """A row per visit (device, channel, timepoint): all dose-curve parameters and the predictors' means over its rows."""
    keys = ["device", "channel", "timepoint"]
    d = df.withColumnRenamed("NormIpeak", "response")
    weight = "repeatability_snr" if "repeatability_snr" in df.columns else None
    curve = D.sensitivity(d, keys).select(
        *keys, "n_conc", F.col("slope").alias("sensitivity"), F.col("intercept").alias("sensitivity_intercept"), F.col("curvature").alias("sensitivity_curvature")
    )
    sat = T.curve_fit(d, keys, "langmuir").select(*keys, F.col("ymax").alias("sat_imax"), F.col("k_half").alias("sat_kd"), F.log10("k_half").alias("sat_logkd"))
    hill = T.curve_fit(d, keys, "hill", weight).select(*keys, F.col("ymax").alias("hill_imax"), F.col("k_half").alias("hill_kd"), F.col("exponent").alias("hill_n"))
    power = D.power_law(d, keys).select(*keys, F.col("amplitude").alias("power_a"), F.col("exponent").alias("power_beta"))
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in predictors(df)])
    return means.join(curve, keys).join(sat, keys, "left").join(hill, keys, "left").join(power, keys, "left")


def load(spark: SparkSession, source: str, target: str = "NormIpeak", **extraction) -> DataFrame:
    """A featureset by name or path, reframed for targets of the dose curve."""
    df = demo.load_frame(spark, source, **extraction)
    return curve_targets(df) if target in CURVE_TARGETS else df


def band(text: str):
    """auto, or lowest and highest frequency."""
    if text == "auto":
        return text
    parts = text.split(",")
    if len(parts) != 2:
        raise argparse.ArgumentTypeError("band is 'auto' or 'lo,hi'")
    return float(parts[0]), float(parts[1])


def seeds(text: str) -> tuple[int, ...]:
    try:
        found = tuple(int(x) for x in text.split(",") if x.strip())
    except ValueError:
        raise argparse.ArgumentTypeError(f"seeds are whole numbers with commas between, got {text!r}") from None
    if not found:
        raise argparse.ArgumentTypeError("at least one seed is needed")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkolyte")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract", help="raw tree to featureset")
    e.add_argument("root", help="a raw tree, or demo")
    e.add_argument("out")
    e.add_argument("--acceptance")
    e.add_argument("--device-types", nargs="+")
    e.add_argument("--pin", help="take what an earlier run derived")
    e.add_argument("--pin-mode", default="reproduce")
    e.add_argument("--pin-out", help="write what this run derived")
    e.add_argument("--on-empty", default="warn")
    d = sub.add_parser("discover", help="rank model conditions")
    d.add_argument("data", help="a featureset, a raw tree, synthetic or demo")
    d.add_argument("out")
    d.add_argument("--min-train-times", type=int)
    d.add_argument("--profile", choices=sorted(runs.PROFILES), default="default")
    d.add_argument("--seeds", type=seeds)
    d.add_argument("--conditions", nargs="+", help="names of conditions to run, all if left out")
    f = sub.add_parser("freeze", help="fit one condition on all rows")
    f.add_argument("data")
    f.add_argument("out")
    f.add_argument("-k", type=int, default=2)
    t = sub.add_parser("freeze-top", help="fit a run's best condition on all rows")
    t.add_argument("run")
    t.add_argument("data")
    t.add_argument("out")
    t.add_argument("--condition")
    t.add_argument("--stability-min", type=float, default=0.5)
    for s in (d, f, t):
        s.add_argument("--target", default="NormIpeak")
    for s in (e, d, f, t):
        s.add_argument("--band", type=band)
    g = sub.add_parser("deploy", help="score new rows with a frozen model")
    g.add_argument("model")
    g.add_argument("data")
    g.add_argument("reference")
    g.add_argument("out")
    g.add_argument("--flag-distance", type=float, default=3.0)
    h = sub.add_parser("features", help="the feature catalogue")
    h.add_argument("data", nargs="?")
    return p


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "extract":
        root = demo.demo_input() if a.root == "demo" else demo.validate_raw_root(spark, a.root)
        config = artifacts.load_config(spark, artifacts.config_path(root), band=a.band, acceptance=a.acceptance)
        rows = X.extract(spark, root, config, a.device_types, on_empty=a.on_empty, pin=a.pin, pin_mode=a.pin_mode, pin_out=a.pin_out)
        artifacts.write_table(rows, a.out)
        return
    if a.command == "features":
        if a.data:
            catalog.feature_dictionary(spark, artifacts.read_table(spark, a.data).columns).show(100, truncate=False)
        else:
            catalog.catalog(spark).show(100, truncate=False)
        return
    if a.command == "deploy":
        model, new, ref = (artifacts.read_table(spark, x) for x in (a.model, a.data, a.reference))
        artifacts.write_table(R.recalibrate(model, new), a.out)
        names = list(model.first().features)
        both = new.select(*names, F.lit(False).alias("_ref")).unionByName(ref.select(*names, F.lit(True).alias("_ref")))
        domain.flag_extrapolation(domain.coral_distance(both, names, F.col("_ref"), ~F.col("_ref")), a.flag_distance).show()
        return
    config = artifacts.AnalysisConfig().with_overrides(band=a.band)
    df = load(spark, a.data, a.target, config=config) if a.band else load(spark, a.data, a.target)
    names = predictors(df)
    if a.command == "discover":
        profile = runs.PROFILES[a.profile]
        given = {k: v for k, v in {"seeds": a.seeds, "min_train_times": a.min_train_times}.items() if v is not None}
        queue = [c for c in R.baseline_queue() if not a.conditions or c.name in a.conditions]
        if not queue:
            raise ValueError(f"no condition is called {a.conditions}")
        runs.run_discovery(spark, with_sensor(df), names, a.target, a.out, queue, runs.replace(profile, **given))
    elif a.command == "freeze":
        artifacts.write_table(R.freeze(df, names, a.target, R.Condition("frozen"), a.k), a.out)
    else:
        found = runs.load_folds(spark, a.run)
        queue = [R.Condition(**{**c, "k_grid": tuple(c["k_grid"]), "thresholds": tuple(c["thresholds"])}) for c in artifacts.read_json(spark, f"{a.run}/conditions.json")["conditions"]]
        artifacts.write_table(R.freeze_top(df, names, a.target, found, queue, a.condition, a.stability_min), a.out)


NAMED = (
    errors.FormatError, errors.PathNotFound, errors.NotAFilesystemPath, errors.NoSessionFolders, errors.NoSignalSessions,
    errors.PinMismatch, errors.EmptySessionError, errors.DemoTreeNotFound, ValueError,
)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        _run(spark or SparkSession.builder.appName("sparkolyte").config("spark.executorEnv.OMP_NUM_THREADS", "1").getOrCreate(), a)
    except NAMED as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
