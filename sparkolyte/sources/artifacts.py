"""Readers and writers of tables, JSON side-cars and pins."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PinMismatch

SCHEMA_VERSION = 2


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or CSV by suffix."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Parquet; a failure is an error, never another format."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, indent=1, default=str))


def read_json(spark: SparkSession, path: str) -> dict:
    # One file, one row.
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


@dataclass(frozen=True)
class AnalysisConfig:
    """Settings shared by all steps. band: lowest and highest frequency, or "auto"."""

    band: tuple[float, float] | str = (10.0, 1e5)
    mono_tol: float = 0.10
    min_norm_snr: float = 1.0
    monotonic_r_min: float = 0.6
    acceptance: str = "monotonic+snr"
    mono_method: str = "pearson"
    min_dose_range: float | None = None
    drop_negative: bool = True
    max_reps: int = 3
    smooth_window: int = 11
    smooth_poly: int = 2
    peak_method: str = "direct"
    require_interior: bool = False
    edge_tol: float = 0.03
    detrend: bool = False
    baseline_window: tuple[float, float] = (-0.1, 0.2)

    def with_overrides(self, **given) -> AnalysisConfig:
        """The settings given, those that are None aside."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def check(self) -> None:
        """Raises ValueError for settings that aren't among the known ones."""
        known = {
            "acceptance": ("snr", "monotonic", "monotonic+snr", "none"),
            "peak_method": ("direct", "chord"),
            "mono_method": ("pearson", "spearman"),
        }
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}, got {getattr(self, name)!r}")
        if isinstance(self.band, str) and self.band != "auto":
            raise ValueError(f"band must be a pair of frequencies or 'auto', got {self.band!r}")


def config_path(root: str) -> str:
    return f"{root.rstrip('/')}/analysis_config.json"


def qc_stats_path(root: str) -> str:
    return f"{root.rstrip('/')}/qc_stats.json"


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def load_config(spark: SparkSession, path: str | None, **overrides) -> AnalysisConfig:
    """The file's settings over the defaults, which stand alone if it is absent; overrides that are given win.

    Keys that aren't known are ignored.
    """
    stored = read_json(spark, path) if path and exists(spark, path) else {}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in stored.items() if k in AnalysisConfig.__dataclass_fields__}
    return AnalysisConfig(**known).with_overrides(**overrides)


def save_config(spark: SparkSession, path: str, config: AnalysisConfig) -> None:
    write_json(spark, path, asdict(config))


def save_qc_stats(spark: SparkSession, path: str, stats: DataFrame, **extra) -> None:
    """A summary table of few rows (a row per check or dose) with further facts, as JSON."""
    write_json(spark, path, {**extra, "rows": [r.asDict(recursive=True) for r in stats.collect()]})


def load_qc_stats(spark: SparkSession, path: str) -> dict:
    """The stored statistics, or none if the file is absent."""
    return read_json(spark, path) if exists(spark, path) else {}


def provenance(spark: SparkSession, root: str) -> list[str]:
    """Lines that say which settings and statistics a root holds."""
    config, stats = config_path(root), qc_stats_path(root)
    lines = [f"settings: {config if exists(spark, config) else 'defaults'}"]
    lines += [f"  {k} = {v}" for k, v in asdict(load_config(spark, config)).items()]
    held = load_qc_stats(spark, stats)
    return [*lines, f"statistics: {stats if held else 'none'}", *[f"  {k} = {v}" for k, v in held.items() if k != "rows"]]


#: The grid that stands for all device types in older pins.
ANY_DEVICE_TYPE = "*"


@dataclass
class Pin:
    """What a run derived from all its sessions, so that later runs of a part give the same rows.

    Baselines, a row per sensor, lie beside the JSON file as a table.
    """

    band: tuple[float, float]
    device_d0: dict[str, str]
    grids: dict[str, list[float]]
    feature_columns: list[str]
    session_rows: dict[str, int]
    device_types: list[str] | None = None
    band_source: str = "explicit"
    params: dict = field(default_factory=dict)
    baselines: str | None = None
    version: int = SCHEMA_VERSION


def session_key(device: str, date) -> str:
    return f"{device}|{date}"


def save_pin(spark: SparkSession, path: str, pin: Pin, baselines: DataFrame | None = None) -> None:
    """The pin as JSON, and its baselines (device, channel, columns) as a table whose place the pin names."""
    if baselines is not None:
        pin.baselines = f"{path}.baselines"
        write_table(baselines, pin.baselines)
    write_json(spark, path, {"extraction": asdict(pin)})


def load_pin(spark: SparkSession, pin: str | dict | Pin) -> Pin:
    """A pin from a path, a dict or a run record that holds one."""
    if isinstance(pin, Pin):
        return pin
    if not isinstance(pin, (str, dict)):
        raise TypeError(f"a pin is a path, a dict or a Pin, not {type(pin).__name__}")
    d = read_json(spark, pin) if isinstance(pin, str) else dict(pin)
    d = d.get("extraction", d)
    missing = {"band", "device_d0", "grids", "feature_columns", "session_rows"} - set(d)
    if missing:
        raise PinMismatch(f"pin lacks {sorted(missing)}")
    if d.get("version", 1) > SCHEMA_VERSION:
        raise PinMismatch(f"pin version {d['version']} is newer than {SCHEMA_VERSION}")
    return Pin(**{k: tuple(v) if k == "band" else v for k, v in d.items() if k in Pin.__dataclass_fields__})


def load_baselines(spark: SparkSession, pin: Pin) -> DataFrame | None:
    return read_table(spark, pin.baselines) if pin.baselines else None


def check_sessions(pin: Pin, sessions: list[tuple[str, str]]) -> None:
    """Raises PinMismatch for sessions (device, day) of unknown devices or before the pinned first day."""
    for device, day in sessions:
        if device not in pin.device_d0:
            raise PinMismatch(f"device {device} isn't pinned")
        if str(day) < pin.device_d0[device]:
            raise PinMismatch(f"device {device} has a session on {day}, before {pin.device_d0[device]}")


def check_columns(pin: Pin, columns: list[str]) -> None:
    if set(columns) != set(pin.feature_columns):
        raise PinMismatch(f"feature columns differ: {sorted(set(columns) ^ set(pin.feature_columns))}")


def check_row_counts(pin: Pin, sessions: dict[str, int], extend: bool = False) -> None:
    """Raises PinMismatch for other row counts and for sessions that aren't pinned; with extend those are let in, but
    none of the pinned may be missing.
    """
    for key, n in sessions.items():
        if key not in pin.session_rows:
            if not extend:
                raise PinMismatch(f"session {key} isn't pinned")
        elif pin.session_rows[key] != n:
            raise PinMismatch(f"session {key}: {n} rows, pinned {pin.session_rows[key]}")
    if extend and (gone := sorted(set(pin.session_rows) - set(sessions))):
        raise PinMismatch(f"pinned sessions are missing: {gone[:5]}")


def check_pin(pin: Pin, sessions: dict[str, int], columns: list[str], first_days: dict[str, str], extend: bool = False) -> None:
    """All checks at once."""
    check_sessions(pin, list(first_days.items()))
    check_columns(pin, columns)
    check_row_counts(pin, sessions, extend)


_ARRAYS = "name string, shape array<long>, values array<double>"


def save_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], manifest: dict | None = None) -> None:
    """Named arrays as a table of a row each, and a manifest beside them; nothing that runs code when read."""
    rows = [(n, [int(k) for k in np.shape(a)], np.asarray(a, float).ravel().tolist()) for n, a in arrays.items()]
    write_table(spark.createDataFrame(rows, _ARRAYS), path)
    write_json(spark, f"{path.rstrip('/')}.json", manifest or {})


def load_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays, or those named, and the manifest."""
    d = read_table(spark, path)
    if names is not None:
        d = d.where(F.col("name").isin(names))
    manifest = f"{path.rstrip('/')}.json"
    return {r.name: np.array(r["values"], float).reshape(r["shape"]) for r in d.collect()}, read_json(spark, manifest) if exists(spark, manifest) else {}


def feature_type(name: str) -> tuple[str, int | None]:
    """<type>_fNN as type and index."""
    m = re.fullmatch(r"(.*)_f(\d+)", name)
    return (m[1], int(m[2])) if m else (name, None)
