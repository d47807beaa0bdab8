"""Reports over raw session trees: inventory, channel quality, replicate reliability, stabilization, feature catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NoStabilizationFiles
from ..operators import diagnostics as G
from ..operators import dose as D
from ..operators import fits as T
from ..operators import quality_control as C
from ..operators import spectra as S
from ..sources import raw
from ..sources.artifacts import AnalysisConfig
from . import extract as X
from .catalog import feature_dictionary

KEY = ["device", "date", "channel"]

def inventory(spark: SparkSession, root: str, config: AnalysisConfig | None = None) -> DataFrame:
    """A row per file and channel with its replicates, and for spectra the gates of the first replicate."""
    config = config or AnalysisConfig()
    blocks = raw.once(raw.read_blocks(spark, root).where("error is null"))
    keys = ["device", "date", "testtype", "devicetype", "signaltype", "dose_nm", "token", "kind", "channel"]
    counts = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_replicates"))
    first = blocks.where("kind = 'eis' and rep = 0").select(*keys, F.col("a").alias("freq"), F.col("b").alias("z_real"), F.col("c").alias("z_imag"))
    gates = S.quality(first, config.band, 0.05).select(*keys, "eis_a", "eis_b", "eis_c", "eis_valid")
    same = [counts[k].eqNullSafe(gates[k]) for k in keys]
    joined = counts.join(gates, same, "left").select(*[counts[k] for k in keys], "n_replicates", "eis_a", "eis_b", "eis_c", "eis_valid")
    d0 = joined.where("testtype = 'signal'").groupBy("device").agg(F.min("date").alias("d0"))
    return joined.join(d0, "device", "left").withColumn("timepoint", F.datediff("date", "d0")).drop("d0")


def channel_quality(spark: SparkSession, root: str, config: AnalysisConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Every channel with its gates and reasons, and every dose with its readouts; nothing is left out.

    fscv_noise (every dose reaches the SNR) and fscv_peak_inwindow (under half of the doses have their peak at an edge)
    are told but don't gate; both are false without doses.
    """
    config = config or AnalysisConfig()
    files = raw.signal_sessions(raw.session_files(spark, root))
    eis, fscv = raw.tables(raw.once(raw.read_blocks(spark, root, files=files)))
    mean = S.average_replicates(eis, KEY)
    gates = S.quality(mean, config.band, config.mono_tol).select(*KEY, "eis_a", "eis_b", "eis_c")
    doses = fscv.where("dose_nm is not null").select(*KEY, "dose_nm", "rep", "voltage", "current").groupBy(*KEY).applyInPandas(X.readout(config), X._READ)
    rising = D.dose_response(doses.withColumnRenamed("NormIpeak", "response").where("response >= 0"), KEY)
    checks = doses.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_conc_read"),
        F.bool_and(F.coalesce(F.col("repeatability_snr") >= config.min_norm_snr, F.lit(False))).alias("fscv_noise"),
        (F.avg(F.col("peak_at_edge").cast("double")) < 0.5).alias("fscv_peak_inwindow"),
    )
    table = C.roster(eis, fscv.where("dose_nm = 0"), KEY).join(gates, KEY, "left").join(rising, KEY, "left").join(checks, KEY, "left")
    table = table.withColumn("fscv_monotonic", F.coalesce(F.col("r") >= config.monotonic_r_min, F.lit(False)))
    reported = ("fscv_noise", "fscv_peak_inwindow")
    table = table.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in reported})
    checks = {"complete": "incomplete", "eis_a": "inductive", "eis_b": "magnitude rises", "eis_c": "negative resistance", "fscv_monotonic": "not monotonic"}
    return C.gate(table, list(checks)).withColumn("fail_reasons", C.fail_reasons(checks)), doses


def replicate_reliability(spark: SparkSession, root: str, config: AnalysisConfig | None = None) -> DataFrame:
    """feature, sigma2_meas, n_rep, n_obs, R from the replicate spectra of all signal sessions."""
    config = config or AnalysisConfig()
    files = raw.signal_sessions(raw.session_files(spark, root))
    eis, _ = raw.tables(raw.read_blocks(spark, root, files=files))
    d = S.phase_and_onset(S.tau_ratio(S.crossover(S.band_means(S.integrals(eis, config.band), config.band, smooth=True), band=config.band), config.band))
    names = [c for c in d.columns if c not in {*eis.columns}]
    long = d.unpivot([*KEY, "rep"], [F.col(n) for n in names], "feature", "value")
    return G.measurement_reliability(long, KEY, by=["feature"])


def stabilization(spark: SparkSession, root: str, target: float = 0.7, cycles_per_round: int = 20) -> DataFrame:
    """device, date, phase, channel, cycle, round, in_round, i_target of all stabilization files, in the order of measurement."""
    files = raw.session_files(spark, root).where("token like 'stabilization%'")
    if files.isEmpty():
        raise NoStabilizationFiles(root)
    _, fscv = raw.tables(raw.read_blocks(spark, root, files=files))
    phase = F.when(F.col("token").contains("-"), F.substring_index("token", "-", -1)).otherwise("end")
    keys = ["device", "date", "phase", "channel"]
    d = fscv.withColumn("phase", phase)
    scanned = F.max(F.col("scan").isNotNull()).over(W.partitionBy(*keys))
    d = d.withColumn("_s", F.when(scanned, F.coalesce("bracket", F.lit(0)))).withColumn("_t", F.when(scanned, F.col("scan")).otherwise(F.col("rep")))
    d = d.withColumn("cycle", F.row_number().over(W.partitionBy(*keys).orderBy("_s", "_t", "rep")) - 1)
    d = d.withColumn("round", F.coalesce(F.col("_s"), F.floor(F.col("cycle") / cycles_per_round).cast("int")))
    d = d.withColumn("in_round", F.row_number().over(W.partitionBy(*keys, "round").orderBy("cycle")) - 1)
    return d.select(*keys, "cycle", "round", "in_round", T.current_at(F.col("voltage"), F.col("current"), target).alias("i_target"), "voltage", "current")


def available(files: DataFrame) -> DataFrame:
    """device, date, sorted doses and tokens of each session."""
    return files.groupBy("device", "date").agg(F.array_sort(F.collect_set("dose_nm")).alias("doses"), F.array_sort(F.collect_set("token")).alias("tokens"))
