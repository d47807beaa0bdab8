"""What every column of a featureset is, and predictors over time that can be added to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.normalize import normalization_kind
from ..sources.artifacts import feature_type

# Type, unit, role and what it is.
CATALOG = (
    ("R_s", "Ohm", "predictor", "series resistance, the real part"),
    ("R_p", "Ohm", "predictor", "parallel resistance"),
    ("C_s", "F", "predictor", "series capacitance"),
    ("C_p", "F", "predictor", "parallel capacitance"),
    ("ideality_C", "", "predictor", "share of the impedance that is capacitive, 1 for a capacitor"),
    ("tau", "s", "predictor", "time constant"),
    ("local_n", "", "predictor", "local slope of log magnitude, 1 for a capacitor"),
    ("R_s_integral", "Ohm dec", "predictor", "series resistance over log frequency"),
    ("R_p_integral", "Ohm dec", "predictor", "parallel resistance over log frequency"),
    ("C_s_integral", "F dec", "predictor", "series capacitance over log frequency"),
    ("C_p_integral", "F dec", "predictor", "parallel capacitance over log frequency"),
    ("f_ideality_crossover", "Hz", "predictor", "frequency where ideality crosses one half"),
    ("ideality_C_band_LF/MF/HF", "", "predictor", "mean ideality in the low, middle and high sub-band"),
    ("n_band_LF/MF/HF", "", "predictor", "mean local slope in the low, middle and high sub-band"),
    ("tau_ratio", "", "predictor", "time constant at the lowest over that at the highest frequency"),
    ("min_neg_phase", "deg", "predictor", "least negative phase of the whole spectrum"),
    ("inductive_onset_hz", "Hz", "predictor", "first inductive frequency of the whole spectrum"),
    ("mean_Vpeak", "V", "predictor", "voltage of the oxidation peak"),
    ("mean_Ibg", "A", "predictor", "background current at the peak"),
    ("bg_charge", "A V", "predictor", "area under the background's way up, within the peak window"),
    ("bg_cap", "A", "predictor", "half the gap between the background's ways up and back"),
    ("bg_switch", "A", "predictor", "background current at the turning voltage"),
    ("NormIpeak", "", "target", "peak current over background current: the response"),
    ("peak_height", "A", "target", "peak current less background"),
    ("peak_area", "A V", "target", "area of the peak's positive lobe"),
    ("peak_fwhm", "V", "target", "width of the peak at half height"),
    ("sensitivity", "", "target", "slope of the response on log dose"),
    ("sensitivity_intercept", "", "target", "intercept of the response on log dose"),
    ("sensitivity_curvature", "", "target", "quadratic coefficient of the response on log dose"),
    ("sat_imax", "", "target", "ceiling of a saturation curve"),
    ("sat_kd", "nM", "target", "dose of half the ceiling"),
    ("sat_logkd", "", "target", "its decimal logarithm"),
    ("hill_imax", "", "target", "ceiling of a Hill curve"),
    ("hill_kd", "nM", "target", "dose of half its ceiling"),
    ("hill_n", "", "target", "its exponent"),
    ("power_beta", "", "target", "exponent of a power law"),
    ("power_a", "", "target", "factor of a power law"),
    ("noise_floor", "", "metadata", "relative noise away from the peak"),
    ("snr", "", "metadata", "the response over its noise, as the gate takes it"),
    ("rms_snr", "", "metadata", "the response over the noise floor"),
    ("repeatability_snr", "", "metadata", "the response over its spread in replicates"),
    ("rep_std", "", "metadata", "spread of the response in replicates"),
    ("dose_response_r", "", "metadata", "correlation of the response with log dose"),
    ("peak_at_edge", "", "metadata", "the peak lies at an end of its window"),
    ("peak_area_clipped", "", "metadata", "an end of the window cuts the peak"),
    ("n_conc", "", "metadata", "doses of a channel and timepoint"),
    ("device", "", "metadata", "device of the row"),
    ("channel", "", "metadata", "channel of the row"),
    ("timepoint", "days", "metadata", "days since the device's first session"),
    ("concentration", "nM", "metadata", "dose of the row"),
    ("time_since_baseline", "days", "predictor", "days since the sensor's first row; added by with_history"),
    ("<feature>__lag1", "", "predictor", "a predictor at the time before, per sensor and dose; added by with_history"),
    ("<feature>__delta", "", "predictor", "its change since; added by with_history"),
)


def representative(kind: str) -> str:
    """A column of the type, by which its normalization is known."""
    return kind.replace("_LF/MF/HF", "_LF")


def catalog(spark: SparkSession) -> DataFrame:
    """type, unit, role, description, d0_kind."""
    rows = [(t, u, r, d, normalization_kind(representative(t))) for t, u, r, d in CATALOG]
    return spark.createDataFrame(rows, "type string, unit string, role string, description string, d0_kind string")


def feature_dictionary(spark: SparkSession, columns: list[str]) -> DataFrame:
    """The catalogue with present: whether a featureset with these columns has the type."""
    here = {feature_type(c)[0] for c in columns}
    bands = {c.rsplit("_", 1)[0] for c in columns if c.endswith(("_LF", "_MF", "_HF"))}
    later = {"<feature>__lag1" if c.endswith("__lag1") else "<feature>__delta" for c in columns if c.endswith(("__lag1", "__delta"))}
    found = [t in here or t.replace("_LF/MF/HF", "") in bands or t in later for t, *_ in CATALOG]
    present = spark.createDataFrame([(t[0], p) for t, p in zip(CATALOG, found, strict=True)], "type string, present boolean")
    return catalog(spark).join(present, "type")


def with_history(df: DataFrame, features: list[str], sensor: list[str], dose: str = "concentration", time: str = "timepoint") -> DataFrame:
    """Adds time_since_baseline and, for each feature, its value at the sensor and dose's time before and the change."""
    w = W.partitionBy(*sensor, dose).orderBy(time)
    d = df.withColumn("time_since_baseline", F.col(time) - F.min(time).over(W.partitionBy(*sensor)))
    d = d.withColumns({f"{f}__lag1": F.lag(f).over(w) for f in features})
    return d.withColumns({f"{f}__delta": F.col(f) - F.col(f"{f}__lag1") for f in features})
