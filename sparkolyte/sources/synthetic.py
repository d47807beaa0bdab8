"""Seeded synthetic exports and featuresets, for demonstrations and tests."""

from __future__ import annotations

from pathlib import Path

import numpy as np


def triangle(n: int = 170, low: float = -0.4, high: float = 1.3) -> np.ndarray:
    up = np.linspace(low, high, n)
    return np.concatenate([up, up[::-1]])


def randles(freq: np.ndarray, rs: float, rct: float, cdl: float) -> np.ndarray:
    return rs + rct / (1 + 2j * np.pi * freq * rct * cdl)


def eis_text(channels: list[int], reps: int, rng: np.random.Generator, drift: float = 0.0) -> str:
    freq = np.logspace(6, 0, 37)
    lines = ["Date and time:,2026-07-15 10:00:00", "Notes:", ",,,,", "Measurement:,EIS"]
    for ch in channels:
        for _ in range(reps):
            z = randles(freq, 500 * (1 + 0.05 * ch), 2e4 * (1 + drift), 2e-7) * (1 + 1e-4 * rng.standard_normal(37))
            lines += [f"CH {ch}: Fixed at 37 freqs", "freq / Hz,neg. Phase / deg,Idc / uA,Z / Ohm,Z' / Ohm,Z'' / Ohm,Cs / F"]
            lines += [f"{f:.6g},{-np.degrees(np.angle(x)):.6g},0,{abs(x):.8g},{x.real:.8g},{-x.imag:.8g},0" for f, x in zip(freq, z, strict=True)]
    return "\n".join(lines) + "\n"


def fscv_text(channels: list[int], reps: int, dose: float, rng: np.random.Generator, gain: float = 0.05) -> str:
    v = triangle()
    rise = np.arange(len(v)) < len(v) // 2
    cells, data = [], []
    for ch in channels:
        for r in range(reps):
            base = np.where(rise, 2.0, -2.0) * (1 + 0.02 * ch) + 0.4 * v
            peak = gain * np.log10(1 + dose) * np.exp(-(((v - 0.7) / 0.08) ** 2)) * rise
            cells += [f"Fast Cyclic Voltammetry: FCV i vs E Channel {ch}" + (f" [{r + 1}]" if r else ""), ""]
            data.append(np.column_stack([v, base + peak + 2e-4 * rng.standard_normal(len(v))]))
    body = np.concatenate(data, axis=1)
    head = ["Date and time:,2026-07-15 10:00:00", "Notes:", ",,,,", ",".join(cells), ",".join(["2026-07-15", ""] * len(data)), ",".join(["V", "uA"] * len(data))]
    return "\n".join([*head, *(",".join(f"{x:.7g}" for x in r) for r in body)]) + "\n"


def write_tree(root: str, devices: dict[str, list[str]] | None = None, channels=(3, 5), doses=(0, 100, 500, 1000), reps: int = 3, seed: int = 0) -> Path:
    """A tree of signal sessions in UTF-16, as instruments write it."""
    rng = np.random.default_rng(seed)
    devices = devices or {"2-2": ["20260715", "20260722"], "2-3": ["20260722"]}
    for device, dates in devices.items():
        for k, date in enumerate(dates):
            folder = Path(root) / f"{date}_ca_signal"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{device}_eis_0 nM.csv").write_text(eis_text(list(channels), 2, rng, 0.2 * k), encoding="utf-16")
            for dose in doses:
                (folder / f"{device}_fscv_{dose} nM.csv").write_text(fscv_text(list(channels), reps, dose, rng, 0.05 * (1 + 0.2 * k)), encoding="utf-16")
    return Path(root)


def paired_text(channels: list[int], cycles: int, rng: np.random.Generator, drift: float, dose: float = 300.0) -> str:
    """An export with waveforms and spectra of the same channels."""
    waves = fscv_text(channels, cycles, dose, rng, 0.05 * (1 - 0.3 * drift)).rstrip("\n")
    spectra = eis_text(channels, cycles, rng, drift).split("Measurement:,EIS\n", 1)[1]
    return f"{waves}\nMeasurement:,EIS\n{spectra}"


def write_invivo_tree(root: str, devices: dict[str, list[str]] | None = None, channels=(3, 5), cycles: int = 4, seed: int = 1) -> Path:
    """A tree of sessions with a baseline and a live file that holds waveforms and spectra."""
    rng = np.random.default_rng(seed)
    for device, dates in (devices or {"4-1": ["20260801", "20260808"]}).items():
        for k, date in enumerate(dates):
            folder = Path(root) / f"{date}_ca_invivo"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{device}_fscv_baseline.csv").write_text(fscv_text(list(channels), 2, 0, rng), encoding="utf-16")
            (folder / f"{device}_paired_live.csv").write_text(paired_text(list(channels), cycles, rng, 0.2 * k), encoding="utf-16")
    return Path(root)


def write_stabilization(folder: Path, device: str, channels, cycles: int, seed: int = 2, phase: str = "start") -> Path:
    """A stabilization export whose current settles."""
    rng = np.random.default_rng(seed)
    folder.mkdir(parents=True, exist_ok=True)
    lines = fscv_text(list(channels), cycles, 0, rng).split("\n")
    body = np.array([[float(x) for x in r.split(",")] for r in lines[6:] if r])
    settle = 1 + 0.5 * np.exp(-np.arange(cycles) / 3)
    body[:, 1::2] *= np.tile(settle, len(channels))
    path = folder / f"{device}_fscv_stabilization-{phase}.csv"
    path.write_text("\n".join([*lines[:6], *(",".join(f"{x:.7g}" for x in r) for r in body)]) + "\n", encoding="utf-16")
    return path


def invivo_drift(x: np.ndarray, timepoints=(0, 7, 21, 42), rate: float = 0.15, seed: int = 1) -> dict[int, np.ndarray]:
    """The rows of x at each time, spread out and moved along one direction in proportion to the time."""
    rng = np.random.default_rng(seed)
    way, last = rng.normal(size=x.shape[1]), max(timepoints) or 1
    return {t: x * (1 + rate * t / last) + rate * t / last * way + rng.normal(0, 0.05 * t / last + 1e-6, x.shape) for t in timepoints}


def featureset(n_channels: int = 7, timepoints=(0, 1, 7, 20), concentrations=(100, 250, 500, 1000, 5000), n_features: int = 24, informative: int = 8, drop: float = 0.36, seed: int = 0):
    """A pandas featureset in which a few features carry each sensor's sensitivity; day-0 rows are all kept."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    weight = rng.normal(0, 0.1, informative)
    rows = []
    for ch in range(n_channels):
        base = rng.normal(0, 1, n_features)
        for t in timepoints:
            x = base + 0.05 * t * rng.normal(0, 1, n_features) + 0.1 * rng.normal(0, 1, n_features)
            slope = 0.3 + abs(x[:informative] @ weight)
            for c in concentrations:
                if t != timepoints[0] and rng.random() < drop:
                    continue
                y = slope * np.log10(c) * (1 + 0.02 * rng.normal())
                rows.append([f"d{ch % 3}", ch, float(t), float(c), max(y, 1e-6), *x])
    return pd.DataFrame(rows, columns=["device", "channel", "timepoint", "concentration", "NormIpeak", *[f"feat_{i:02d}" for i in range(n_features)]])
