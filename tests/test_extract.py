"""Extraction with its options, and pins: a pinned part of a tree gives the rows of the whole."""

import shutil

import numpy as np
import pandas as pd
import pytest

from sparkolyte import errors
from sparkolyte.plans import extract as X
from sparkolyte.sources import artifacts, raw, synthetic
from sparkolyte.sources.artifacts import AnalysisConfig

DAYS = ["20260715", "20260722"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    synthetic.write_tree(str(root), {"2-2": DAYS, "2-3": DAYS[1:]}, channels=(3,), doses=(0, 100, 500, 1000), reps=2)
    return root


@pytest.fixture(scope="module")
def whole(spark, tree, tmp_path_factory):
    pin = str(tmp_path_factory.mktemp("pin") / "run.json")
    rows = X.extract(spark, str(tree), n_grid=3, pin_out=pin)
    return pin, pd.DataFrame([r.asDict() for r in rows.collect()])


def rows_of(df):
    return pd.DataFrame([r.asDict() for r in df.collect()]).sort_values(["device", "date", "concentration"]).reset_index(drop=True)


def test_pinned_part_gives_the_rows_of_the_whole(spark, tree, whole, tmp_path):
    pin, every = whole
    assert len(every) == 9 and set(every.timepoint) == {0, 7}
    shutil.copytree(tree / f"{DAYS[1]}_ca_signal", tmp_path / f"{DAYS[1]}_ca_signal")
    got = rows_of(X.extract(spark, str(tmp_path), n_grid=3, pin=pin))
    want = every[every.date == got.date[0]].sort_values(["device", "date", "concentration"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)
    # Without the pin the first day, and with it every baseline, moves.
    moved = rows_of(X.extract(spark, str(tmp_path), n_grid=3))
    assert set(moved.timepoint) == {0} and not np.allclose(moved.R_s_integral, want.R_s_integral)
    held = artifacts.load_pin(spark, pin)
    assert held.session_rows == {"2-2|2026-07-15": 3, "2-2|2026-07-22": 3, "2-3|2026-07-22": 3}
    assert artifacts.load_baselines(spark, held).count() == 2


def test_pins_refuse_what_they_do_not_know(spark, tree, whole, tmp_path):
    pin, _ = whole
    root = tmp_path / "t"
    shutil.copytree(tree, root)
    (root / f"{DAYS[1]}_ca_signal" / "2-3_fscv_500 nM.csv").unlink()
    with pytest.raises(errors.PinMismatch, match="rows"):
        X.extract(spark, str(root), n_grid=3, pin=pin)
    later = tmp_path / "later"
    synthetic.write_tree(str(later), {"2-2": ["20260801"]}, channels=(3,), doses=(0, 100, 500, 1000), reps=2)
    with pytest.raises(errors.PinMismatch, match="isn't pinned"):
        X.extract(spark, str(later), n_grid=3, pin=pin)
    with pytest.raises(errors.PinMismatch, match="missing"):
        X.extract(spark, str(later), n_grid=3, pin=pin, pin_mode="extend")
    shutil.copytree(later / "20260801_ca_signal", root / "20260801_ca_signal")
    shutil.copy(tree / f"{DAYS[1]}_ca_signal" / "2-3_fscv_500 nM.csv", root / f"{DAYS[1]}_ca_signal")
    grown = rows_of(X.extract(spark, str(root), n_grid=3, pin=pin, pin_mode="extend"))
    assert set(grown.timepoint) == {0, 7, 17} and len(grown) == 12
    other = tmp_path / "other"
    synthetic.write_tree(str(other), {"9-9": ["20260722"]}, channels=(3,), doses=(0, 100, 500, 1000), reps=2)
    with pytest.raises(errors.PinMismatch, match="9-9"):
        X.extract(spark, str(other), n_grid=3, pin=pin)


def test_conflicts_are_named(spark, tree, whole):
    pin, _ = whole
    root = str(tree)
    for kw in ({"pin_mode": "extend"}, {"pin_mode": "x", "pin": pin}, {"on_empty": "x"}, {"config": AnalysisConfig(peak_method="x")}, {"config": AnalysisConfig(acceptance="x")}, {"config": AnalysisConfig(band="wide")}):
        with pytest.raises(ValueError):
            X.extract(spark, root, **kw)
    for kw in ({"config": AnalysisConfig(band=(10.0, 900.0))}, {"devicetypes": ["other"]}):
        with pytest.raises(errors.PinMismatch):
            X.extract(spark, root, pin=pin, **kw)
    with pytest.raises(errors.NoSignalSessions):
        X.extract(spark, root, devicetypes=["none"])
    with pytest.raises(TypeError):
        artifacts.load_pin(spark, 7)


def test_rows_are_chosen(spark, tree):
    got = rows_of(X.extract(spark, str(tree), AnalysisConfig(band="auto"), n_grid=2, devices=["2-2"], timepoints=[7]))
    assert set(got.device) == {"2-2"} and set(got.timepoint) == {7} and len(got) == 3
    keep = spark.createDataFrame([("2-3", 3, 0)], "device string, channel int, timepoint int")
    got = rows_of(X.extract(spark, str(tree), AnalysisConfig(acceptance="none", smooth_window=0), n_grid=2, keep=keep, normalize=False))
    assert set(got.device) == {"2-3"} and (got.rms_snr > 1).all() and not got.peak_at_edge.any() and (got.dose_response_r > 0.9).all()
    assert got.R_s_f00.iloc[0] > 100


def test_peaks_by_definition():
    v = np.linspace(0, 1.2, 241)
    bg = 2 + 0 * v
    y = np.exp(-(((v - 0.7) / 0.05) ** 2)) + 5 * v
    config = AnalysisConfig()
    direct = X._peak(v, y, bg, config)
    assert direct["mean_Vpeak"] == pytest.approx(1.0) and direct["peak_at_edge"] and direct["peak_area_clipped"]
    assert X._peak(v, y, bg, AnalysisConfig(require_interior=True)) is None
    chord = X._peak(v, y, bg, AnalysisConfig(peak_method="chord"))
    assert chord["mean_Vpeak"] == pytest.approx(0.7, abs=0.01) and chord["NormIpeak"] == pytest.approx((1 + 3.5) / 2, abs=0.02)
    flat = X._peak(v, y, bg, AnalysisConfig(detrend=True, baseline_window=(0.0, 0.4)))
    assert flat["mean_Vpeak"] == pytest.approx(0.7) and flat["peak_height"] == pytest.approx(1, abs=1e-6)


def test_only_wanted_files_are_opened(spark, tree):
    files = raw.session_files(spark, str(tree)).where("signaltype = 'eis' and device = '2-3'")
    blocks = raw.read_blocks(spark, str(tree), files=files)
    assert len(blocks.inputFiles()) and all("2-3" in p or not p.endswith(".csv") for p in spark.read.format("binaryFile").load([r.path for r in files.collect()]).inputFiles())
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "content" in plan and blocks.count() == 2
    # A file that would not parse is not touched.
    bad = tree / f"{DAYS[1]}_ca_signal" / "2-3_fscv_7 nM.csv"
    bad.write_bytes(b"\xff\xfe\x00")
    try:
        assert raw.read_blocks(spark, str(tree), files=files).where("error is not null").count() == 0
    finally:
        bad.unlink()
    assert raw.read_blocks(spark, str(tree), "device = 'none'").count() == 0


def test_configuration_files(spark, tmp_path):
    path = artifacts.config_path(str(tmp_path))
    assert artifacts.load_config(spark, path) == AnalysisConfig()
    artifacts.save_config(spark, path, AnalysisConfig(band=(2.0, 2000.0), mono_tol=0.3))
    assert artifacts.load_config(spark, path, mono_tol=0.2) == AnalysisConfig(band=(2.0, 2000.0), mono_tol=0.2)
    stats = artifacts.qc_stats_path(str(tmp_path))
    assert artifacts.load_qc_stats(spark, stats) == {}
    artifacts.save_qc_stats(spark, stats, spark.createDataFrame([("eis_a", 3)], "gate string, failed long"), sessions=4)
    assert artifacts.load_qc_stats(spark, stats) == {"sessions": 4, "rows": [{"gate": "eis_a", "failed": 3}]}
    text = "\n".join(artifacts.provenance(spark, str(tmp_path)))
    assert "mono_tol = 0.3" in text and "sessions = 4" in text
