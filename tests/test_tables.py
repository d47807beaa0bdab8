"""Review tables against plain computations on small trees and featuresets."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkolyte import errors
from sparkolyte.operators import diagnostics as G
from sparkolyte.plans import catalog, tables
from sparkolyte.sources import artifacts, demo, synthetic
from sparkolyte.sources.artifacts import AnalysisConfig


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    synthetic.write_tree(str(root), {"2-2": ["20260715", "20260722"]}, channels=(3, 5), doses=(0, 100, 1000), reps=3)
    synthetic.write_stabilization(root / "20260722_ca_signal", "2-2", [3, 5], 30)
    synthetic.write_stabilization(root / "20260715_ca_signal", "2-2", [3], 12, phase="end")
    return str(root)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    rows = []
    for d in range(3):
        for t in range(5):
            impedance = 5 + d + 0.3 * t + 0.1 * rng.normal()
            for c in (100.0, 500.0, 1000.0, 5000.0):
                y = 0.2 * np.log10(c) * (1 + 0.1 * t) + 0.01 * rng.normal()
                rows.append([f"d{d}", d, t, c, y, impedance, rng.normal(), 2 * y, None if c == 100 else float(t)])
    return pd.DataFrame(rows, columns=["device", "channel", "timepoint", "concentration", "NormIpeak", "R_s_f00", "noise_f01", "peak_height", "half"])


def test_distributions(spark, frame):
    df = spark.createDataFrame(frame)
    flags = {r.feature: r.constant for r in tables.constant_per_visit(df, ["R_s_f00", "noise_f01", "half"]).collect()}
    assert flags == {"R_s_f00": True, "noise_f01": False, "half": True}
    got = {r.feature: r for r in tables.distributions(tables.samples(df, ["R_s_f00", "noise_f01"]), 8).collect()}
    visits, rows = frame.drop_duplicates(["device", "channel", "timepoint"]).R_s_f00, frame.noise_f01
    for name, values, unit in (("R_s_f00", visits, "visits"), ("noise_f01", rows, "rows")):
        r = got[name]
        assert (r.unit, r.n) == (unit, len(values)) and r.mean == pytest.approx(values.mean()) and r["median"] == pytest.approx(values.median())
        assert r.sd == pytest.approx(values.std(ddof=0))
        counts = np.zeros(8)
        for b in r.bins:
            counts[b["bin"]] = b["count"]
        assert counts.tolist() == np.histogram(values, 8)[0].tolist()
    assert tables.spread_out(20) == [0, 4, 8, 11, 15, 19] and tables.spread_out(3) == [0, 1, 2] and tables.spread_out(0) == []
    assert tables.points(df, "half").count() == 45


def test_quality_map_and_modes(spark, frame):
    df = spark.createDataFrame(frame).withColumn("sensor", F.col("device"))
    long = tables.long_form(df.withColumn("response", F.col("NormIpeak")), ["R_s_f00", "noise_f01"], ["sensor", "timepoint", "concentration", "response"])
    noise = spark.createDataFrame([("R_s_f00", 0.01), ("noise_f01", 1.0), ("NormIpeak", 1e-4)], "feature string, sigma2_meas double")
    drift, shares, align = G.drift_reliability(long, noise), G.variance_hierarchy(long), G.drift_alignment(long)
    got = {r.feature: r for r in tables.quality_map(drift, align, shares).collect()}
    assert got["R_s_f00"].type == "R_s" and got["R_s_f00"].R_drift > 0.8 and got["R_s_f00"].alignment > 0.8 and got["noise_f01"].R_drift < 0.6
    assert [r.type for r in tables.drift_by_type(drift).collect()] == ["R_s", "noise"]
    modes = {r.response: r for r in tables.response_modes(df, noise).collect()}
    assert set(modes) == {"NormIpeak", "peak_height", "sensitivity", "sensitivity_intercept", "sensitivity_curvature"}
    for m in modes.values():
        assert m.between_channel + m.within_time + m.within_dose == pytest.approx(1)
    assert modes["NormIpeak"].level == "dose" and modes["NormIpeak"].R_drift > 0.9 and modes["peak_height"].R_drift is None
    assert modes["sensitivity"].within_time > 0.8 and tables.response_modes(df).count() == 5
    text = "\n".join(tables.verdict(shares, drift, align))
    assert "a feature follows" in text
    ranked = tables.rank_targets(spark.createDataFrame([("a", False, 9.0), ("b", True, None), ("c", True, 0.2)], "target string, admissible boolean, cv double"))
    assert [r.target for r in ranked.collect()] == ["c", "b", "a"]


def test_raw_tables(spark, tree):
    r = tables.RawReview(spark, tree)
    have = {x.timepoint: x for x in r.available().collect()}
    assert have[7].label == "D7" and have[0].eis_channels == [3, 5] and have[0].doses == [0, 100, 1000]
    assert r.channels("fscv").count() == 4 and r.doses().count() == 2 and "direct" in r.describe()
    onset = r.onset_table().collect()
    assert len(onset) == 4 and {x.timepoint for x in onset} == {"D0", "D7"} and all(x.inductive_onset_hz is None for x in onset)
    long = r.eis_spread_table()
    assert long.count() == 4 * 37
    some = sorted(x.frequency for x in long.select("frequency").distinct().collect())[3:5]
    one = r.eis_spread_table(some).where("channel = 3 and timepoint = 'D0'").first()
    same = long.where((F.col("channel") == 3) & (F.col("timepoint") == "D0") & (F.col("frequency") == some[0])).first()
    assert one[f"zr_mean_{some[0]:g}"] == same.zr_mean and one[f"zi_std_{some[0]:g}"] == same.zi_std
    reps = r.replicates().where("channel = 3 and timepoint = 0 and concentration = 1000").collect()
    assert len(reps) == 3 and all(x.v_peak == pytest.approx(0.7, abs=0.03) for x in reps)
    stats = r.dose_stats_table().where("channel = 3 and timepoint = 'D0' and concentration = 1000").first()
    assert stats.normipeak_mean == pytest.approx(np.mean([x.normipeak for x in reps]), abs=1e-4)
    assert stats.v_peak_std == pytest.approx(np.std([x.v_peak for x in reps]), abs=1e-3)
    x = reps[0]
    at = int(np.argmin(np.abs(np.array(x.voltage) - x.v_peak)))
    assert x.bgsub[at] == pytest.approx(x.bgsub_ipeak) and x.norm[at] == pytest.approx(x.normipeak)
    assert r.over_time("norm").count() == 8 and r.over_time("vpeak").where("n != 3").count() == 0 and r.over_time("snr").where("snr <= 1").count() == 0
    assert r.select(r.eis_full(), ["2-2"], [7]).count() == 2
    assert {x.n for x in r.edge_pinning_table().collect()} == {4}


def test_edges_are_counted(spark):
    rows = [("d", 1, 0, 100.0, 0.41), ("d", 2, 0, 100.0, 0.7), ("d", 3, 7, 100.0, 0.98), ("d", 1, 0, 500.0, 0.7)]
    got = {r.concentration: r for r in tables.edge_pinning(spark.createDataFrame(rows, "device string, channel int, timepoint int, concentration double, v_peak double")).collect()}
    assert (got[100].n_lower, got[100].n_upper, got[100].any_pct, list(got[100]["where"])) == (1, 1, 66.7, ["d ch1 D0", "d ch3 D7"])
    assert got[500].n_any == 0 and list(got[500]["where"]) == []


def test_bandwidth(spark):
    freqs = np.logspace(0, 5, 12)
    eis, rows = [], []
    for t in range(6):
        for ch in (1, 2):
            z = 100 * (1 + 0.2 * t) + 1 / (2j * np.pi * freqs * 1e-6)
            zi = z.imag.copy()
            if ch == 2 and t > 3:
                zi[-2:] = 1.0
            eis.append(("d", ch, t, freqs.tolist(), z.real.tolist(), zi.tolist()))
            rows += [("d", ch, t, c, 0.1 * t + c / 1e4) for c in (100.0, 500.0)]
    e = spark.createDataFrame(eis, "device string, channel int, timepoint int, freq array<double>, z_real array<double>, z_imag array<double>")
    r = spark.createDataFrame(rows, "device string, channel int, timepoint int, concentration double, NormIpeak double")
    kept, aligned = tables.bandwidth(e, r)
    kept = {round(x.upper, 3): x.kept for x in kept.collect()}
    assert kept[1.0] == 12 and kept[round(float(freqs[-1]), 3)] == 10
    got = {(x.type, x.i): x.alignment for x in aligned.collect()}
    assert got["R_s", 0] > 0.99 and len({i for _, i in got}) == 12


def test_stabilization_tables(spark, tree):
    s = tables.StabilizationReview(spark, tree, cycles_per_round=3, patience=2, smooth=1, tol=0.02)
    assert {(str(x.date), x.timepoint, x.phases) for x in s.available().collect()} == {("2026-07-22", "D7", "start"), ("2026-07-15", "D0", "end")}
    table = s.convergence_table().collect()
    assert len(table) == 3 and all(x.converged and x.final_drift < 0.02 for x in table if x.timepoint == "D7")
    assert s.at_target().count() == 72 and "0.7 V" in s.describe()
    edges = {(str(x.date), x.channel, x.edge): x.cycle_no for x in s.round_edges().collect()}
    assert len(edges) == 6 and all(edges[k[0], k[1], "first"] < edges[k[0], k[1], "last"] for k in edges)
    assert s.round_drift().where("drift < 0").count() == 0


def test_catalogue_and_history(spark):
    d = tables_of = catalog.catalog(spark)
    assert tables_of.count() == len(catalog.CATALOG) == 53 and d.where("role = 'predictor'").count() > 20
    kinds = {r.type: r.d0_kind for r in d.collect()}
    assert kinds["ideality_C_band_LF/MF/HF"] == "additive" and kinds["R_s"] == "multiplicative"
    got = {r.type: r.present for r in catalog.feature_dictionary(spark, ["R_s_f00", "n_band_HF", "tau_ratio", "x__lag1"]).collect()}
    assert [t for t, p in got.items() if p and t != "tau"] and got["R_s"] and got["n_band_LF/MF/HF"] and got["<feature>__lag1"] and not got["hill_n"] and not got["tau"]
    rows = [("a", 1.0, t, v) for t, v in ((0, 1.0), (3, 4.0), (9, 2.0))]
    h = catalog.with_history(spark.createDataFrame(rows, "sensor string, concentration double, timepoint int, x double"), ["x"], ["sensor"])
    assert [(r.time_since_baseline, r.x__lag1, r.x__delta) for r in h.orderBy("timepoint").collect()] == [(0, None, None), (3, 1.0, 3.0), (9, 4.0, -2.0)]


def test_demo_sources(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv(demo.VARIABLE, raising=False)
    if demo.find_demo_tree() is None:
        with pytest.raises(errors.DemoTreeNotFound):
            demo.demo_input(synthesize=False)
    at = tmp_path / "demo" / "in_vitro" / "input" / "20260715_ca_signal"
    at.mkdir(parents=True)
    (at / "2-2_eis_0 nM.csv").write_text("x")
    assert Path(demo.demo_input()) == at.parent
    monkeypatch.setenv(demo.VARIABLE, str(tmp_path / "demo"))
    assert demo.find_demo_tree() == at.parent
    with pytest.raises(ValueError):
        demo.find_demo_tree("other")
    with pytest.raises(errors.DemoTreeNotFound):
        demo.demo_input(user_path=str(tmp_path / "none"))
    for path, error in ((str(at), errors.NoSessionFolders), (str(at.parent.parent), errors.NoSessionFolders), ("https://x.org/y", errors.NotAFilesystemPath), (str(tmp_path / "no"), errors.PathNotFound)):
        with pytest.raises(error):
            demo.validate_raw_root(spark, path)
    assert demo.validate_raw_root(spark, str(at.parent)) and demo.load_frame(spark, "synthetic").count() > 100
    made = Path(demo.demo_input("in_vivo", cycles=2, channels=(3,)))
    assert any(made.glob("*_invivo/*_paired_live.csv"))


def test_arrays_are_kept(spark, tmp_path):
    arrays = {"coef": np.arange(6.0).reshape(2, 3), "y": np.array([1.5])}
    artifacts.save_arrays(spark, str(tmp_path / "m"), arrays, {"k": 2})
    got, manifest = artifacts.load_arrays(spark, str(tmp_path / "m"))
    assert manifest == {"k": 2} and all(np.array_equal(got[n], a) for n, a in arrays.items())
    assert list(artifacts.load_arrays(spark, str(tmp_path / "m"), ["y"])[0]) == ["y"]
    x = synthetic.invivo_drift(np.random.default_rng(0).normal(size=(200, 3)))
    assert [np.std(x[t]) for t in x] == sorted(np.std(x[t]) for t in x)
    assert AnalysisConfig().acceptance == "monotonic+snr"
