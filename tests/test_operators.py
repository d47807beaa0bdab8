import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkolyte.functions import names as N
from sparkolyte.operators import discovery as R
from sparkolyte.operators import dose as D
from sparkolyte.operators import evaluation as E
from sparkolyte.operators import normalize as Z
from sparkolyte.operators import quality_control as C
from sparkolyte.operators import spectra as S
from sparkolyte.operators import waveforms as V


def test_slopes_are_recovered(spark):
    rows = [(f"d{d}", d, float(t), c, 0.1 + s * float(np.log10(c))) for d in (1, 2) for t, s in ((0, 0.02), (1, 0.05)) for c in (100.0, 500.0, 1000.0, 5000.0)]
    rows += [("d3", 3, 0.0, 100.0, 1.0), ("d3", 3, 0.0, 500.0, 2.0)]
    df = spark.createDataFrame(rows, "device string, channel int, timepoint double, concentration double, response double")
    got = {(r.device, r.timepoint): r for r in D.sensitivity(df).collect()}
    assert len(got) == 4
    assert got["d1", 1.0].slope == pytest.approx(0.05) and got["d1", 1.0].intercept == pytest.approx(0.1)
    assert got["d2", 0.0].curvature == pytest.approx(0, abs=1e-6)


def test_infinite_weights_become_the_smallest(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("inf")), ("a", 3.0), ("b", float("nan"))], "g string, w double")
    got = sorted((r.g, r._w) for r in D.sigma_weights(df, "w", ["g"]).collect())
    assert got == [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 1.0)]


def test_names(spark):
    df = spark.createDataFrame([("2-2_fscv_500 nM.csv",), ("2-2_EIS_stabilization-end.csv",), ("odd.csv",), ("x_fscv_1.2.3 nM.csv",)], "n string")
    got = [r.p for r in df.select(N.parse_filename(F.col("n")).alias("p")).collect()]
    assert got[0].dose_nm == 500 and got[0].token is None
    assert got[1].signaltype == "eis" and got[1].token == "stabilization-end"
    assert got[2].device is None and got[3].dose_nm is None
    f = spark.createDataFrame([("20260715_ca_v2_Signal",), ("20261399_ca_signal",)], "n string").select(N.parse_folder(F.col("n")).alias("p")).collect()
    assert (str(f[0].p.date), f[0].p.devicetype, f[0].p.testtype) == ("2026-07-15", "ca_v2", "signal") and f[1].p.date is None


def test_circuit_passes_all_gates(spark):
    freq = np.logspace(1, 5, 15)
    z = 100 + 1 / (2j * np.pi * freq * 1e-6)
    df = spark.createDataFrame([(1, freq.tolist(), z.real.tolist(), z.imag.tolist()), (2, freq.tolist(), z.real.tolist(), (-z.imag).tolist()), (3, [20.0], [1.0], [-1.0])], "id int, freq array<double>, z_real array<double>, z_imag array<double>")
    got = {r.id: r for r in S.quality(df).collect()}
    assert got[1].eis_valid and not got[2].eis_a and not got[3].eis_valid
    c = S.with_features(df.where("id = 1")).select(F.col("feats")[3]["C_s"]).first()[0]
    assert c == pytest.approx(1e-6)


def test_gaussian_peak(spark):
    v = np.linspace(-0.4, 1.3, 400)
    y = np.exp(-(((v - 0.7) / 0.05) ** 2))
    df = spark.createDataFrame([(v.tolist(), (y + 2).tolist(), np.full(400, 2.0).tolist())], "voltage array<double>, current array<double>, background array<double>")
    got = V.peak_shape(V.locate_peak(V.subtract_background(V.anodic(df, "current", "background")))).first()
    assert got.peak.v_ox == pytest.approx(0.7, abs=0.005) and got.peak.norm_ipeak == pytest.approx(0.5, abs=0.01)
    assert got.peak_fwhm == pytest.approx(0.05 * 2 * np.sqrt(np.log(2)), rel=0.02)
    assert got.peak_area == pytest.approx(0.05 * np.sqrt(np.pi), rel=0.02)


def test_first_maximum_wins(spark):
    df = spark.createDataFrame([([0.5, 0.6, 0.7], [1.0, 3.0, 3.0], [1.0, 1.0, 1.0])], "voltage array<double>, current array<double>, background array<double>")
    assert V.locate_peak(V.subtract_background(df)).first().peak.idx == 1


def test_folds_never_see_the_future(spark):
    rows = [(c, t, float(c + t)) for c in range(2) for t in (0, 1, 7, 20)]
    df = spark.createDataFrame(rows, "channel int, timepoint int, y double")
    folds = E.forward_folds(df)
    assert {(r.channel, r.t_test) for r in folds.collect()} == {(0, 20), (1, 20)}
    sizes = E.fold_sizes(df, folds, "y").collect()
    assert all(r.n_train == 6 for r in sizes)
    assert all(r.n_train == 3 for r in E.fold_sizes(df, folds, "y", leave_channel_out=True).collect())


def test_training_mean_has_no_skill(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 2.0), (1, 3.0, 2.0, 2.0)], "k int, y double, pred double, train_mean double")
    r = E.pooled(E.fold_results(df, ["k"])).first()
    assert r.q2 == 0 and r.rmsep == 1


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert E.auc(df, F.col("y") == 1, "s").first().auc == pytest.approx(0.875)
    assert E.auc(df.where("y = 1"), F.col("y") == 1, "s").first().auc is None


def test_pinned_baseline_overrides(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 6.0)], "g string, timepoint int, x double")
    pin = spark.createDataFrame([("a", 4.0)], "g string, x double")
    assert sorted(r.x for r in Z.d0_normalize(df, ["x"], ["g"]).collect()) == [1, 3]
    assert sorted(r.x for r in Z.d0_normalize(df, ["x"], ["g"], pinned=pin).collect()) == [0.5, 1.5]


def test_decaying_drift_converges(spark):
    rows = [("s", i, float(0.5 * np.exp(-i / 8) + 0.001)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    assert C.converged(df, ["k"], "i", "x").first().converged
    assert not C.converged(df.withColumn("x", F.col("x") + 0.1), ["k"], "i", "x").first().converged


def test_missing_scores_rank_last(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 2.0), ("c", 1.0)], "condition string, rmsep double")
    assert [(r.condition) for r in C.rank_conditions(df).orderBy("rank").collect()] == ["c", "b", "a"]


def test_model_finds_a_signal_and_none_without(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(8):
        for t in range(6):
            x = rng.normal(size=3)
            rows.append((s, t, float(x[0] * 2 + 0.05 * rng.normal()), float(rng.normal()), *map(float, x)))
    df = spark.createDataFrame(rows, "sensor int, timepoint int, y double, noise double, f0 double, f1 double, f2 double")
    q2 = lambda y: E.pooled(R.run_conditions(df, ["f0", "f1", "f2"], y, [R.Condition("c")])).first().q2
    assert q2("y") > 0.95 and q2("noise") < 0.5
    model = R.freeze(df, ["f0", "f1", "f2"], "y", R.Condition("c"), 3)
    scored = R.recalibrate(model, df).select(F.corr("y", "score")).first()[0]
    assert scored > 0.99
    with pytest.raises(ValueError):
        R.recalibrate(model, df.drop("f1"))


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "device string, channel int, timepoint double, concentration double, response double, snr double")
    for how in ("snr", "none", "monotonic", "monotonic+snr"):
        assert D.accept(df, how).count() == 0
    assert D.sensitivity(df).count() == 0
    with pytest.raises(ValueError):
        D.accept(df, "other")
