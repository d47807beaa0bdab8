"""Raw exports to a featureset: one parse, anchors as aggregates, joins, one Arrow function per waveform."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EmptySessionError, EmptySessionWarning, PinMismatch
from ..functions import numerics as N
from ..functions.tasks import dealt
from ..operators import dose as D
from ..operators import normalize as Z
from ..operators import spectra as S
from ..operators import waveforms as V
from ..sources import artifacts, raw
from ..sources.artifacts import AnalysisConfig, Pin

KEY = ["device", "date", "channel"]
TYPES = ("R_s", "R_p", "C_s", "C_p", "ideality_C", "tau", "local_n")
_READ = (
    "device string, date date, channel int, concentration double, NormIpeak double, mean_Vpeak double, mean_Ibg double, "
    "peak_height double, peak_area double, peak_fwhm double, peak_at_edge boolean, peak_area_clipped boolean, "
    "noise_floor double, rep_std double, repeatability_snr double, rms_snr double, bg_switch double, bg_charge double, bg_cap double"
)


def _mean_cycles(rows: pd.DataFrame, most: int | None = 3) -> tuple[np.ndarray, np.ndarray] | None:
    rows = rows.sort_values("rep").head(most) if most else rows.sort_values("rep")
    n = min((len(v) for v in rows["current"]), default=0)
    if not n:
        return None
    return np.asarray(rows["voltage"].iloc[0][:n], float), np.mean([c[:n] for c in rows["current"]], axis=0)


def _peak(v, y, bg, config: AnalysisConfig, window=V.PEAK_WINDOW) -> dict | None:
    """Readout of the peak in the window, or None without one."""
    if config.detrend:
        flat = (v >= config.baseline_window[0]) & (v <= config.baseline_window[1])
        y = y - np.polyval(np.polyfit(v[flat], y[flat], 1), v) if flat.sum() >= 2 else y
    inside = np.flatnonzero((v >= window[0]) & (v <= window[1]))
    if len(inside) < 2:
        return None
    score = y[inside]
    if config.peak_method == "chord":
        a, b = inside[0], inside[-1]
        score = score - (y[a] + (y[b] - y[a]) / ((v[b] - v[a]) or np.inf) * (v[inside] - v[a]))
    k = inside[int(np.argmax(score))]
    if config.require_interior and k in (inside[0], inside[-1]):
        return None
    height = float(y[k])
    half, width = height / 2, np.nan
    left, right = np.flatnonzero(y[:k] <= half), k + 1 + np.flatnonzero(y[k + 1 :] <= half)
    if height > 0 and len(left) and len(right):
        i, j = left[-1], right[0]
        a = v[i] + (half - y[i]) / (y[i + 1] - y[i]) * (v[i + 1] - v[i])
        b = v[j] + (half - y[j]) / (y[j - 1] - y[j]) * (v[j - 1] - v[j])
        width = float(b - a)
    return {
        "NormIpeak": height / bg[k] if bg[k] else np.nan,
        "mean_Vpeak": float(v[k]),
        "mean_Ibg": float(bg[k]),
        "peak_height": height,
        "peak_area": float(np.trapezoid(np.maximum(y[inside], 0), v[inside])),
        "peak_fwhm": width,
        "peak_at_edge": bool(v[k] <= window[0] + config.edge_tol or v[k] >= window[1] - config.edge_tol),
        "peak_area_clipped": bool(max(y[inside[0]], y[inside[-1]]) >= V.CLIP * height),
    }


def readout(config: AnalysisConfig):
    """One channel of one session: every dose against the session's own background."""
    columns = [c.split()[0] for c in _READ.split(", ")]

    def swept(v, i, bg):
        """The rising sweep's voltage, signal less background, background and signal."""
        b = N.align_background(v, *bg)
        smooth = N.savgol(i, config.smooth_window, config.smooth_poly) if config.smooth_window else np.asarray(i, float)
        return N.anodic(v, smooth - b, b, smooth)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        background = _mean_cycles(pdf[pdf.dose_nm == 0], config.max_reps)
        rows = []
        if background is not None:
            bg = background[0], (N.savgol(background[1], config.smooth_window, config.smooth_poly) if config.smooth_window else background[1])
            extra = N.background_features(*bg)
            for dose, cycles in pdf[pdf.dose_nm > 0].groupby("dose_nm"):
                mean = _mean_cycles(cycles, config.max_reps)
                if mean is None:
                    continue
                x, y, b, signal = swept(*mean, bg)
                p = _peak(x, y, b, config)
                if p is None:
                    continue
                quiet = (x >= V.NONFARADAIC[0]) & (x <= V.NONFARADAIC[1]) & (b != 0)
                some = cycles.sort_values("rep").head(config.max_reps)
                reps = [swept(np.asarray(v, float), np.asarray(c, float), bg) for v, c in zip(some["voltage"], some["current"], strict=True)]
                peaks = [q["NormIpeak"] for q in (_peak(*r[:3], config) for r in reps) if q is not None]
                peaks = [q for q in peaks if np.isfinite(q)]
                spread = float(np.std(peaks)) if len(peaks) >= 2 else np.nan
                snr = np.nan if np.isnan(spread) else (p["NormIpeak"] / spread if spread else np.inf)
                floor = float(np.sqrt(np.mean(((signal[quiet] - b[quiet]) / b[quiet]) ** 2))) if quiet.any() else np.nan
                rms = p["NormIpeak"] / floor if floor and not np.isnan(floor) else np.nan
                own = {"device": pdf.device.iloc[0], "date": pdf.date.iloc[0], "channel": pdf.channel.iloc[0], "concentration": float(dose)}
                rows.append({**own, **p, "noise_floor": floor, "rep_std": spread, "repeatability_snr": snr, "rms_snr": rms, **extra})
        return pd.DataFrame(rows, columns=columns)

    return run


def _spectrum_features(eis: DataFrame, band: tuple[float, float]) -> DataFrame:
    return S.phase_and_onset(S.tau_ratio(S.crossover(S.band_means(S.integrals(eis, band), band, smooth=True), band=band), band))


def resolve_band(spark: SparkSession, eis: DataFrame, band: tuple[float, float] | str) -> tuple[float, float]:
    """The band as given, or for "auto" the one below the onsets of all replicate-averaged spectra."""
    if band != "auto":
        if isinstance(band, str):
            raise ValueError(f"band must be a pair of frequencies or 'auto', got {band!r}")
        return float(band[0]), float(band[1])
    found = S.recommended_band(eis).first()
    return float(found.lo), float(found.hi)


def _checked(config: AnalysisConfig, pin: Pin | None, pin_mode: str, on_empty: str, devicetypes: list[str] | None) -> tuple[AnalysisConfig, list[str] | None]:
    """The arguments against each other and the pin; the pin's band and device types where none are given."""
    config.check()
    if on_empty not in ("warn", "raise", "ignore"):
        raise ValueError(f"on_empty must be warn, raise or ignore, got {on_empty!r}")
    if pin_mode not in ("reproduce", "extend"):
        raise ValueError(f"pin_mode must be reproduce or extend, got {pin_mode!r}")
    if pin is None:
        if pin_mode != "reproduce":
            raise ValueError("pin_mode needs a pin")
        return config, devicetypes
    if devicetypes is not None and sorted(devicetypes) != pin.device_types:
        raise PinMismatch(f"device types {sorted(devicetypes)} are not the pinned {pin.device_types}")
    given = config.band if config.band != AnalysisConfig().band else None
    if given not in (None, "auto") and tuple(map(float, given)) != tuple(pin.band):
        raise PinMismatch(f"band {given} is not the pinned {pin.band}")
    return replace(config, band=tuple(pin.band)), pin.device_types


def extract(
    spark: SparkSession,
    root: str,
    config: AnalysisConfig | None = None,
    devicetypes: list[str] | None = None,
    n_grid: int | None = None,
    on_empty: str = "warn",
    devices: list[str] | None = None,
    timepoints: list[float] | None = None,
    keep: DataFrame | None = None,
    normalize: bool = True,
    pin: str | dict | Pin | None = None,
    pin_mode: str = "reproduce",
    pin_out: str | None = None,
) -> DataFrame:
    """device, channel, timepoint, concentration, responses and d0-normalized features of all signal sessions.

    devicetypes decide, before anything is derived, which sessions count at all. devices, timepoints and keep (device,
    channel, timepoint) choose rows afterwards. pin takes band, first days, grids, baselines and columns from an earlier
    run and checks sessions and their row counts against it; pin_out writes this run's.
    """
    config = config or AnalysisConfig()
    pin = artifacts.load_pin(spark, pin) if pin is not None else None
    config, devicetypes = _checked(config, pin, pin_mode, on_empty, devicetypes)
    files = raw.signal_sessions(raw.session_files(spark, root), devicetypes)
    if pin is not None:
        artifacts.check_sessions(pin, [(r.device, str(r.date)) for r in files.select("device", "date").distinct().collect()])
        first = F.create_map(*[x for d, day in pin.device_d0.items() for x in (F.lit(d), F.lit(day))])
        files = files.withColumn("d0", F.get(F.array(F.try_element_at(first, F.col("device"))), F.lit(0)).cast("date"))
        files = files.withColumn("timepoint", F.datediff("date", "d0"))
    blocks = raw.once(raw.read_blocks(spark, root, files=files))
    eis, fscv = raw.tables(blocks)
    eis = eis.join(files.select("path", "timepoint"), "path")
    mean = S.average_replicates(eis, [*KEY, "devicetype", "timepoint"])
    band = resolve_band(spark, mean, config.band)
    good = S.quality(mean, band, config.mono_tol).where("eis_valid")
    if pin is None:
        grid = S.reference_grid(good, ["devicetype"], ["device", "date", "channel"], band, config.mono_tol)
    else:
        kinds = [r.devicetype for r in files.select("devicetype").distinct().collect()]
        held = [(t, pin.grids.get(t, pin.grids.get(artifacts.ANY_DEVICE_TYPE))) for t in kinds]
        grid = spark.createDataFrame([h for h in held if h[1]], "devicetype string, grid array<double>")
    on = S.in_band(good, band).withColumn("_f", F.transform("pts", lambda p: p["f"])).join(grid, "devicetype")
    on = on.where(S.on_grid(F.col("_f"), F.col("grid"))).select(*KEY, "devicetype", "timepoint", "freq", "z_real", "z_imag")
    full = S.local_n(S.with_features(_spectrum_features(on, band), band), band, smooth=True)
    # The longest grid: a number per device type.
    size = n_grid or (grid.agg(F.max(F.size("grid"))).first()[0] or 0)
    scalars = [c for c in full.columns if c not in {*KEY, "devicetype", "timepoint", "freq", "z_real", "z_imag", "pts", "feats", "local_n"}]
    wide = [F.get("feats", F.lit(i))[n].alias(f"{n}_f{i:02d}") for n in TYPES[:-1] for i in range(size)]
    wide += [F.get("local_n", F.lit(i)).alias(f"local_n_f{i:02d}") for i in range(size)]
    features = full.select(*KEY, "timepoint", *scalars, *wide)
    cycles = fscv.where("dose_nm is not null").select(*KEY, "dose_nm", "rep", "voltage", "current")
    read = dealt(cycles, KEY).groupBy(*KEY).applyInPandas(readout(config), _READ)
    rows = read.join(features, KEY).withColumn("response", F.col("NormIpeak")).withColumn("snr", F.col("repeatability_snr"))
    if config.drop_negative:
        rows = rows.where("response >= 0")
    r = D.dose_response(rows.where(~F.isnan("response")), KEY, method=config.mono_method).select(*KEY, F.col("r").alias("dose_response_r"))
    accepted = D.accept(
        rows, config.acceptance, KEY, config.min_norm_snr, config.monotonic_r_min, config.mono_method, config.min_dose_range, config.drop_negative
    )
    accepted = accepted.drop("response").join(r, KEY, "left")
    _report_empty(files, accepted, on_empty)
    names = ["bg_charge", "bg_cap", "bg_switch", *scalars, *(f"{n}_f{i:02d}" for n in TYPES for i in range(size))]
    predictors = [*names, "mean_Vpeak"]
    if pin is not None or pin_out:
        accepted = raw.once(accepted)
    counts = None
    if pin is not None:
        artifacts.check_columns(pin, accepted.columns)
        counts = _session_rows(files, accepted)
        artifacts.check_row_counts(pin, counts, pin_mode == "extend")
        accepted = accepted.select(*pin.feature_columns)
    base = Z.baselines(accepted, predictors, ["device", "channel"]) if normalize else None
    held = artifacts.load_baselines(spark, pin) if pin is not None and normalize else None
    if pin_out:
        days = {r.device: str(r.d0) for r in files.select("device", "d0").distinct().collect()}
        grids = {r.devicetype: list(r.grid) for r in grid.collect()}
        counts = counts or _session_rows(files, accepted)
        record = Pin(band, days, grids, accepted.columns, counts, sorted(devicetypes) if devicetypes else None, str(config.band == "auto" and "auto" or "explicit"), asdict(config))
        kept = held.unionByName(base.join(held, ["device", "channel"], "left_anti")) if held is not None else base
        artifacts.save_pin(spark, pin_out, record, kept)
    out = Z.d0_normalize(accepted, predictors, ["device", "channel"], pinned=held) if normalize else accepted
    if devices:
        out = out.where(F.col("device").isin(devices))
    if timepoints is not None:
        out = out.where(F.col("timepoint").isin(list(timepoints)))
    if keep is not None:
        out = out.join(keep.select("device", "channel", "timepoint").distinct(), ["device", "channel", "timepoint"], "left_semi")
    return out


def _session_rows(files: DataFrame, rows: DataFrame) -> dict[str, int]:
    """Rows of each session, those without any included. As many entries as sessions."""
    n = rows.groupBy("device", "date").agg(F.count(F.lit(1)).alias("n"))
    found = files.select("device", "date").distinct().join(n, ["device", "date"], "left").collect()
    return {artifacts.session_key(r.device, r.date): int(r.n or 0) for r in found}


def _report_empty(files: DataFrame, rows: DataFrame, how: str) -> None:
    if how == "ignore":
        return
    empty = files.select("device", "date").distinct().join(rows.select("device", "date").distinct(), ["device", "date"], "left_anti").head(5)
    if not empty:
        return
    text = f"sessions without rows: {[tuple(map(str, r)) for r in empty]}"
    if how == "raise":
        raise EmptySessionError(text)
    warnings.warn(text, EmptySessionWarning, stacklevel=3)


def invivo(spark: SparkSession, root: str, config: AnalysisConfig | None = None) -> DataFrame:
    """One row per live cycle: the k-th cycle with the k-th spectrum, the last spectrum reused, and its background's features."""
    config = config or AnalysisConfig()
    files = raw.session_files(spark, root).where("token in ('baseline', 'live')")
    first = files.groupBy("device").agg(F.min("date").alias("d0"))
    files = files.join(first, "device").withColumn("timepoint", F.datediff("date", "d0"))
    blocks = raw.read_blocks(spark, root, files=files)
    eis, fscv = raw.tables(blocks)
    token = files.select("path", F.col("token").alias("period"), "timepoint")
    eis = eis.join(token, "path").where("period = 'live'")
    live = fscv.join(token, "path").where("period = 'live'")
    base = fscv.join(token.drop("timepoint"), "path").where("period = 'baseline'")
    base = base.groupBy(*KEY).agg(F.min_by(F.struct("voltage", "current"), "rep").alias("bg"))
    last = eis.groupBy(*KEY).agg(F.max("rep").alias("last"))
    joined = live.select(*KEY, "timepoint", F.col("rep").alias("time_index"), "voltage", "current").join(last, KEY).withColumn("rep", F.least("time_index", "last"))
    joined = joined.join(eis.select(*KEY, "rep", "freq", "z_real", "z_imag"), [*KEY, "rep"]).join(base, KEY)
    features = _spectrum_features(joined, resolve_band(spark, eis, config.band))
    schema = f"{features.drop('voltage', 'current', 'bg', 'freq', 'z_real', 'z_imag', 'last', 'rep')._jdf.schema().toDDL()}, NormIpeak DOUBLE, mean_Ibg DOUBLE, bg_switch DOUBLE, bg_charge DOUBLE, bg_cap DOUBLE"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for v, i, bg in zip(pdf.voltage, pdf.current, pdf.bg, strict=True):
                v, i = np.asarray(v, float), np.asarray(i, float)
                bg_v, bg_i = np.asarray(bg["voltage"], float), N.savgol(np.asarray(bg["current"], float), V.SAVGOL_WINDOW, V.SAVGOL_POLY)
                b = N.align_background(v, bg_v, bg_i)
                x, y, b = N.anodic(v, N.savgol(i, V.SAVGOL_WINDOW, V.SAVGOL_POLY) - b, b)
                p = _peak(x, y, b, config) or {}
                rows.append({"NormIpeak": p.get("NormIpeak"), "mean_Ibg": p.get("mean_Ibg"), **N.background_features(bg_v, bg_i)})
            keep = pdf.drop(columns=["voltage", "current", "bg", "freq", "z_real", "z_imag", "last", "rep"]).reset_index(drop=True)
            yield pd.concat([keep, pd.DataFrame(rows)], axis=1)

    return features.mapInPandas(read, schema)


def recalibrate_invivo(spark: SparkSession, model: DataFrame, root: str, reference: DataFrame, config: AnalysisConfig | None = None, limit: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Scored rows of an in-vivo tree, and per timepoint n, mean score, distance from the reference rows and flag.

    Features are set against each sensor's own first in-vivo rows; those of the model that the tree lacks count as missing.
    """
    from ..operators import discovery as R

    rows = invivo(spark, root, config)
    names = list(model.first().features)
    have = [n for n in names if n in rows.columns]
    if not have:
        raise ValueError("the tree gives none of the model's features")
    rows = Z.d0_normalize(rows, have, ["device", "channel"])
    rows = rows.withColumns({n: F.lit(None).cast("double") for n in names if n not in have})
    scored = R.recalibrate(model, rows)
    summary = R.monitor(model, rows, reference, "timepoint", limit)
    return scored, scored.groupBy("timepoint").agg(F.count("score").alias("n_scored")).join(summary, "timepoint", "left")
