"""Models, folds, freezing and recalibration against plain versions of their rules."""

import argparse

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkolyte import cli
from sparkolyte.functions import numerics as N
from sparkolyte.operators import discovery as R
from sparkolyte.operators import domain
from sparkolyte.operators import evaluation as E
from sparkolyte.operators import models as M
from sparkolyte.plans import extract as X
from sparkolyte.plans import runs
from sparkolyte.sources import artifacts, synthetic

NAMES = [f"f{i}" for i in range(6)]


def frame(seed=0, sensors=4, times=6, doses=(100.0, 500.0, 1000.0)):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sensors):
        for t in range(times):
            if (s, t) == (1, 3):
                continue
            base = rng.normal(size=6)
            for c in doses:
                x = np.exp(0.2 * (base + 0.1 * rng.normal(size=6)))
                y = 1.5 + 0.8 * x[0] - 0.4 * x[1] + 0.1 * s + 0.05 * t + 0.05 * rng.normal()
                row = {"sensor": f"d{s // 2}:{s}", "device": f"d{s // 2}", "timepoint": t * 3, "concentration": c, "repeatability_snr": float(rng.integers(1, 9)) if rng.random() > 0.1 else np.inf, "y": y}
                row.update({n: (np.nan if rng.random() < 0.05 else v) for n, v in zip(NAMES, x, strict=True)})
                rows.append(row)
    return pd.DataFrame(rows)


def plain_pls(x, y, k):
    """Coefficients by deflation, one response."""
    a, b = x - x.mean(0), y - y.mean()
    ws, ps, qs = [], [], []
    for _ in range(k):
        w = a.T @ b / np.linalg.norm(a.T @ b)
        t = a @ w
        p, q = a.T @ t / (t @ t), b @ t / (t @ t)
        a, b = a - np.outer(t, p), b - q * t
        ws.append(w)
        ps.append(p)
        qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    coef = w @ np.linalg.solve(p.T @ w, np.array(qs))
    return lambda z: (z - x.mean(0)) @ coef + y.mean()


def plain_folds(df, track, k_grid, weights=None, log=False, min_times=3):
    """sse, tss, n_test and k of each fold."""
    x, y, t, s = df[NAMES].to_numpy(), df.y.to_numpy(), df.timepoint.to_numpy(float), df.sensor.to_numpy()
    x = np.log(np.maximum(x, 1e-12)) if log else x
    target = np.log(np.maximum(y, 1e-12)) if log else y

    def fit(train, rows, k):
        median = np.nanmedian(x[train], axis=0)
        fill = lambda z: np.where(np.isnan(z), median, z)
        mean, sd = fill(x[train]).mean(0), fill(x[train]).std(0)
        a, b = (fill(x[train]) - mean) / sd, (fill(x[rows]) - mean) / sd
        if weights is None:
            p = plain_pls(a, target[train], k)(b)
        else:
            w = weights(df[train])
            root = np.sqrt(w / w.mean())[:, None]
            mx, my = np.average(a, axis=0, weights=w), np.average(target[train], weights=w)
            inner = plain_pls_raw((a - mx) * root, (target[train] - my) * root[:, 0], k)
            p = (b - mx) @ inner + my
        return np.exp(np.clip(p, -50, 50)) if log else p

    out = {}
    times = np.unique(t)
    for c in np.unique(s):
        for i, u in enumerate(times):
            test = (s == c) & (t == u)
            train = (t < u) & ((s != c) if track == "universal" else True)
            if i < min_times or not test.any():
                continue
            last = t[train].max()
            early, late = train & (t < last), train & (t == last) & ((s == c) if track == "channel" else True)
            if not late.any():
                continue
            errors = {k: np.mean((y[late] - fit(early, late, k)) ** 2) for k in k_grid}
            k = min(errors, key=errors.get)
            p = fit(train, test, k)
            out[c, u] = (k, int(test.sum()), ((y[test] - p) ** 2).sum(), ((y[test] - y[train].mean()) ** 2).sum())
    return out


def plain_pls_raw(a, b, k):
    ws, ps, qs = [], [], []
    for _ in range(k):
        w = a.T @ b / np.linalg.norm(a.T @ b)
        t = a @ w
        p, q = a.T @ t / (t @ t), b @ t / (t @ t)
        a, b = a - np.outer(t, p), b - q * t
        ws.append(w)
        ps.append(p)
        qs.append(q)
    w, p = np.array(ws).T, np.array(ps).T
    return w @ np.linalg.solve(p.T @ w, np.array(qs))


def snr_weights(rows):
    v = rows.repeatability_snr.to_numpy()
    return np.where(np.isfinite(v), v, v[np.isfinite(v)].max())


CASES = [
    (R.Condition("plain", k_grid=(1, 2, 3)), {}),
    (R.Condition("channel", track="channel", k_grid=(1, 2, 3)), {}),
    (R.Condition("universal", track="universal", k_grid=(1, 2)), {}),
    (R.Condition("log", k_grid=(2,), transform="log"), {"log": True}),
    (R.Condition("dose", "weighted", k_grid=(2,), weighted_by="concentration"), {"weights": lambda d: 1 / np.maximum(d.concentration.to_numpy(), 1)}),
    (R.Condition("snr", "weighted", k_grid=(1, 2), weighted_by="repeatability_snr"), {"weights": snr_weights}),
]


def test_folds_by_brute_force(spark):
    df = frame()
    got = R.run_conditions(spark.createDataFrame(df), NAMES, "y", [c for c, _ in CASES]).collect()
    for c, how in CASES:
        want = plain_folds(df, c.track, c.k_grid, **how)
        rows = {(r.channel, r.t_test): (r.k, r.n_test, r.sse, r.tss) for r in got if r.condition == c.name}
        assert rows.keys() == want.keys(), c.name
        for key, w in want.items():
            assert rows[key][:2] == w[:2] and rows[key][2:] == pytest.approx(w[2:], rel=1e-6), (c.name, key)
    assert all(len(r.predictions) == r.n_test for r in got)


def test_random_folds_hold_out_whole_units(spark):
    df = spark.createDataFrame(frame())
    got = R.run_conditions(df, NAMES, "y", [R.Condition("r", track="random")], n_splits=4)
    assert got.agg(F.sum("n_test")).first()[0] == df.count() and {r.t_test for r in got.collect()} <= {0.0, 1.0, 2.0, 3.0}
    assert got.where("channel is not null").count() == 0


def test_whole_queue_runs_and_is_ranked(spark):
    df = spark.createDataFrame(frame())
    queue = R.baseline_queue()
    assert len(queue) == 14 and [c.batch for c in queue[:3]] == [1, 1, 1] and queue[-1].batch == 4
    found = R.run_conditions(df, NAMES, "y", queue, seeds=(0, 1), cars={"generations": 6, "n_folds": 3})
    found = spark.createDataFrame(found.collect(), found.schema)
    ranked = R.summarize(found).collect()
    assert {r.condition for r in ranked} == {c.name for c in queue}
    assert [r.rmsep for r in ranked] == sorted(r.rmsep for r in ranked)
    seeds = {(r.condition, r.seed) for r in found.collect()}
    assert sum("CARS" in c for c, _ in seeds) == 4 and len(seeds) == 16
    assert R.per_channel(found).count() == 4 and R.predictions(found).where("residual is null").count() == 0
    every = R.selection_frequency(found, NAMES)
    assert every.count() == 14 * 6 and R.feature_ranking(every).first().feature in NAMES
    model = R.freeze_top(df, NAMES, "y", found, queue, "pNproblem_3.2_CARS").first()
    assert set(model.features) <= set(NAMES) and model.condition == "pNproblem_3.2_CARS"
    few = R.freeze_top(df, NAMES, "y", found, queue, "pNproblem_3.2_CARS", stability_min=1.1).first()
    assert len(few.features) >= 5
    with pytest.raises(ValueError):
        R.freeze_top(df, NAMES, "y", found, queue, "none such")


def test_log_needs_positive_targets(spark):
    df = spark.createDataFrame(frame().assign(y=lambda d: d.y - d.y.mean()))
    with pytest.raises(ValueError):
        R.run_conditions(df, NAMES, "y", [R.Condition("log", transform="log")])
    for bad in ({"track": "other"}, {"weighted_by": "x"}, {"architecture": "log", "transform": "log"}):
        with pytest.raises(ValueError):
            R.Condition("bad", **bad)


def test_gates_stop_and_edit_the_queue(spark):
    df = spark.createDataFrame(frame())
    queue = [R.Condition("a_1.1"), R.Condition("a_1.2", k_grid=(1,)), R.Condition("a_2.1", k_grid=(3,))]
    seen = []
    done = R.run_queue(df, NAMES, "y", queue, gate=lambda c, m: seen.append(c.name) or c.name != "a_1.2")
    assert seen == ["a_1.1", "a_1.2"] and len(done) == 2
    done = R.run_queue(df, NAMES, "y", queue, batch_gate=lambda done, rest: [R.Condition("b_7.1", k_grid=(1,))] if len(done) == 2 else None)
    assert {c.name for c, _ in done} == {"a_1.1", "a_1.2", "b_7.1"}


def test_products_give_the_fit_of_the_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 3
    x[:, 4] = 2.0
    y = x[:, 0] - 2 * x[:, 1] + rng.normal(size=300)
    w = rng.uniform(0.5, 2, 300)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y, w]), columns=[*"abcde", "y", "w"])).repartition(5)
    for weight, own in ((None, None), ("w", w)):
        gram, n = domain.gramian(df, [*"abcde", "y"], weight)
        for k in (1, 2, 4):
            one, two = M.PLS(k).fit(x, y, own), M.PLS(k).fit_gramian(gram, n)
            assert np.allclose(one.predict(x), two.predict(x), atol=1e-8) and np.allclose(one.vip(), two.vip(), atol=1e-8)


def test_frozen_model_by_brute_force(spark):
    df = frame(2)
    x = df[NAMES].to_numpy()
    median = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), median, x)
    center, iqr = np.median(x, axis=0), np.subtract(*np.percentile(x, [75, 25], axis=0))
    want = plain_pls((x - center) / iqr, df.y.to_numpy(), 3)((x - center) / iqr)
    rows = spark.createDataFrame(df).withColumn("n", F.monotonically_increasing_id())
    model = R.freeze(rows, NAMES, "y", R.Condition("c"), 3)
    got = [r.score for r in R.recalibrate(model, rows).orderBy("n").collect()]
    assert np.allclose(got, want) and model.first().k == 3
    plan = rows.select("y")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_orthogonal_filter(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 7)) @ rng.normal(size=(7, 7))
    y = x[:, 0] + 0.1 * rng.normal(size=80)
    for n in (1, 2):
        m = M.OrthogonalPLS(2)
        m.n_orth = n
        m.fit(x, y)
        a, b = x - x.mean(0), y - y.mean()
        for _ in range(n):
            w = a.T @ b / np.linalg.norm(a.T @ b)
            t = a @ w
            p = a.T @ t / (t @ t)
            o = p - (w @ p) * w
            s = a @ (o / np.linalg.norm(o))
            assert abs(s @ b) < 1e-8 * np.linalg.norm(s) * np.linalg.norm(b)
            a = a - np.outer(s, a.T @ s / (s @ s))
        assert np.allclose((x - x.mean(0)) @ m._filter, a, atol=1e-8)
        coef, intercept = m.linear()
        assert np.allclose(x @ np.array(coef) + intercept, m.predict(x)) and np.allclose(m.predict(x), plain_pls(a, y, 2)(a))


def test_selectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 12))
    y = 2 * x[:, 3] - 3 * x[:, 7] + 0.1 * rng.normal(size=120)
    for seed in (0, 1):
        kept = M.cars(x, y, seed=seed)
        assert {3, 7} <= set(kept.tolist()) and len(kept) < 12 and (np.diff(kept) > 0).all()
    assert np.array_equal(M.cars(x, y), M.cars(x, y)) and np.array_equal(M.cars(x[:, :2], y), [0, 1])
    assert {3, 7} <= set(M.cars_consensus(x, y).tolist())
    # One predictor: the statistic of a line, p from the t test's tail.
    one = x[:, 3:4]
    f = M.smc_scores(one, y, 1)[0]
    assert M.smc_significance(one, y, 1)[0] == pytest.approx(-np.log10(max(1e-300, N.f_tail(f, 1, 118))))
    assert M.select("smc", x, y, 2.0).tolist() == [i for i, v in enumerate(M.smc_significance(x, y, 2)) if v >= 2]
    sensor, time = np.repeat(np.arange(4), 30), np.tile(np.repeat(np.arange(3), 10), 4)
    z = np.column_stack([time + 0.01 * rng.normal(size=120), sensor.astype(float), rng.normal(size=120)])
    assert M.temporal_select(z, sensor, time, 0.5).tolist() == [0]


def test_information_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=300), rng.normal(size=300)
    whole = N.mutual_information(x, x + y)
    monkeypatch.setattr(N, "MI_BLOCK", 7)
    assert N.mutual_information(x, x + y) == pytest.approx(whole) and whole > 0.2


def plain_nested(df, levels, min_times=3, ki=2.0, ks=4.0):
    x, y, t = df[NAMES].to_numpy(), df.y.to_numpy(), df.timepoint.to_numpy(float)
    age = t - df.groupby(levels[-1]).timepoint.transform("min").to_numpy(float)
    x = np.column_stack([x, age])
    out = []
    for i, u in enumerate(np.unique(t)):
        train, test = t < u, t == u
        if i < min_times or train.sum() < 8:
            continue
        m, s = np.nanmean(x[train], axis=0), np.nanstd(x[train], axis=0)
        z = np.nan_to_num((x - m) / np.where(s > 0, s, 1))
        model = M.ridge_loo(z[train], y[train])
        left, pred = y[train] - model.predict(z[train]), model.predict(z[test])
        for level in levels:
            g = df[level].agg("|".join, axis=1).to_numpy() if len(level) > 1 else df[level[0]].to_numpy()
            moved = left.copy()
            for k in np.unique(g[train]):
                a = g[train] == k
                n, c = a.sum(), age[train][a] - age[train][a].mean()
                offset = left[a].mean() * n / (n + ki)
                slope = (c @ (left[a] - left[a].mean())) / (c @ c) * n / (n + ks) if c @ c > 0 else 0
                moved[a] -= offset + slope * c
                b = g[test] == k
                pred[b] += offset + slope * (age[test][b] - age[train][a].mean())
            left = moved
        out += list(zip(y[test], pred, strict=True))
    return sorted(out)


@pytest.mark.parametrize("levels", [[["sensor"]], [["device"]], [["device"], ["device", "sensor"]]])
def test_nested_levels_by_brute_force(spark, levels):
    df = frame(6)
    got = R.grouped_cv(spark.createDataFrame(df), NAMES, "y", levels, "timepoint", "ridge").collect()
    assert np.allclose(sorted((r.y, r.pred) for r in got), plain_nested(df, levels))


def test_ridge_by_brute_force():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 4))
    y = x @ [1, 0, -1, 2] + rng.normal(size=30)
    errors = {}
    for alpha in M.ALPHAS:
        left = []
        for i in range(30):
            keep = np.arange(30) != i
            a, b = x[keep] - x[keep].mean(0), y[keep] - y[keep].mean()
            coef = np.linalg.solve(a.T @ a + alpha * np.eye(4), a.T @ b)
            left.append(y[i] - y[keep].mean() - (x[i] - x[keep].mean(0)) @ coef)
        errors[alpha] = np.mean(np.square(left))
    m = M.ridge_loo(x, y)
    assert m.alpha == min(errors, key=errors.get)
    a = x - x.mean(0)
    assert np.allclose(m.coef, np.linalg.solve(a.T @ a + m.alpha * np.eye(4), a.T @ (y - y.mean())))


def test_covariance_of_moved_rows_is_the_references(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(400, 3)) @ rng.normal(size=(3, 3)) + 5, rng.normal(size=(300, 3)) * [1, 2, 3]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=[*"abc"]).assign(new=[False] * 400 + [True] * 300)).repartition(4)
    moved = R.coral_transform(df, [*"abc"], ~F.col("new"), F.col("new")).select(*"abc").toPandas().to_numpy()
    assert np.allclose(np.cov(moved.T), np.cov(x[:400].T), rtol=1e-4, atol=1e-4) and np.allclose(moved.mean(0), x[:400].mean(0))
    d = domain.coral_distance(df, [*"abc"], ~F.col("new"), F.col("new")).first()
    want = np.linalg.norm(np.cov(x[:400].T) - np.cov(x[400:].T)) + np.linalg.norm(x[:400].mean(0) - x[400:].mean(0))
    assert d.n == 300 and d.distance == pytest.approx(want)


def test_distance_per_group(spark):
    rng = np.random.default_rng(9)
    df = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"]).assign(g=[None if i % 5 == 0 else i % 5 for i in range(200)], ref=[i < 80 for i in range(200)])
    df.loc[3, "a"] = np.nan
    rows = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)], "a double, b double, g double, ref boolean")
    got = {r.g: (r.n, r.distance) for r in domain.coral_distance(rows, ["a", "b"], F.col("ref"), ~F.col("ref"), ["g"]).collect()}
    ref = df[df.ref]
    for g, part in df[~df.ref].groupby("g", dropna=False):
        want = np.linalg.norm(part[["a", "b"]].cov() - ref[["a", "b"]].cov()) + np.linalg.norm(part[["a", "b"]].mean() - ref[["a", "b"]].mean())
        assert got[None if pd.isna(g) else g] == (len(part), pytest.approx(want))
    assert E.effective_min_train_times(2) == 1


def test_run_records(spark, tmp_path):
    out = str(tmp_path / "run")
    df = spark.createDataFrame(frame())
    queue = [R.Condition("baselines_1.1_a", k_grid=(1,)), R.Condition("channel_2.1_b", track="channel", k_grid=(1, 2)), R.Condition("vip_3.1_c", selector="vip", thresholds=(0.5, 1.0))]
    ranked = runs.run_discovery(spark, df, NAMES, "y", out, queue, runs.FAST)
    rows = ranked.collect()
    assert {r.condition for r in rows} == {c.name for c in queue} and all(r.lo <= r.rmsep <= r.hi for r in rows)
    folds = runs.load_folds(spark, out)
    assert runs.predictions_of(spark, out, "channel_2.1_b").count() == folds.where("condition = 'channel_2.1_b'").agg(F.sum("n_test")).first()[0]
    first = runs.fold_names(spark, out, "baselines_1.1_a").orderBy("t_test", "channel").first()
    one = runs.load_fold(spark, out, "baselines_1.1_a", first.channel, first.t_test)
    assert one.k == 1 and len(one.coef) == 6 and runs.load_fold(spark, out, "baselines_1.1_a", "none", 0) is None
    spread = runs.fold_spread(folds).collect()
    assert [r["median"] for r in spread] == sorted(r["median"] for r in spread)
    assert runs.run_record(spark, out)["dataset"] == {"n_samples": df.count(), "n_features": 6}
    text = (tmp_path / "run" / "report" / "discovery_summary.md").read_text()
    assert text.count("\n| ") == 4 and rows[0].condition in text.split("\n")[6]
    assert (tmp_path / "run" / "logs" / "run.log").read_text().count("DONE") == 3
    assert runs.run_label(spark, out) == "unverified-run"
    (tmp_path / "run" / "sweep_manifest.json").write_text('{"label": "first"}')
    assert runs.run_label(spark, out) == "first"
    assert runs.conditions_table(spark, queue).where("batch = 3").first().thresholds == [0.5, 1.0]
    assert E.pooled(runs.baseline_run(df, NAMES, "y")).first().rmsep > 0


def test_commands(spark, tmp_path):
    out = str(tmp_path / "o")
    names = ["baselines_1.1_linearPLSR", "pNproblem_3.1_VIP"]
    assert cli.main(["discover", "synthetic", out, "--profile", "fast", "--seeds", "0", "--conditions", *names], spark) == 0
    data = str(tmp_path / "data")
    spark.createDataFrame(synthetic.featureset(n_channels=4, n_features=6, informative=3, drop=0.0)).write.parquet(data)
    assert cli.main(["discover", data, out + "2", "--profile", "fast", "--conditions", names[1]], spark) == 0
    assert cli.main(["freeze-top", out + "2", data, str(tmp_path / "top")], spark) == 0
    model = spark.read.parquet(str(tmp_path / "top")).first()
    assert model.condition == names[1] and model.k in (2, 3)
    assert cli.main(["freeze-top", out + "2", data, str(tmp_path / "top2"), "--condition", "none"], spark) == 2
    assert cli.main(["discover", data, out + "3", "--conditions", "none"], spark) == 2
    curves = cli.curve_targets(spark.read.parquet(data))
    assert set(cli.CURVE_TARGETS) <= set(curves.columns) and curves.count() == 16
    assert curves.where("sensitivity is null or sat_imax is null").count() == 0
    assert cli.main(["freeze", data, str(tmp_path / "s"), "--target", "sensitivity"], spark) == 0
    assert cli.band("2,2000") == (2.0, 2000.0) and cli.band("auto") == "auto" and cli.seeds("0, 1") == (0, 1)
    for f, bad in ((cli.band, "1"), (cli.seeds, "a"), (cli.seeds, ",")):
        with pytest.raises(argparse.ArgumentTypeError):
            f(bad)


def test_models_from_their_arrays(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=(60, 4)), np.full(60, 2.0)])
    y = np.exp(0.3 * x[:, 0] + 0.1 * x[:, 1] ** 2)
    for name in ("linear", "log", "weighted", "orthogonal", "nonlinear"):
        model = M.build(name, 2).fit(x, y)
        arrays, manifest = M.to_arrays(model)
        artifacts.save_arrays(spark, str(tmp_path / name), arrays, manifest)
        back = artifacts.load_arrays(spark, str(tmp_path / name))
        assert np.allclose(M.predict_from_arrays(*back, x), np.ravel(model.predict(x))), name


def test_invivo_rows_are_scored(spark, tmp_path):
    root = synthetic.write_invivo_tree(str(tmp_path / "live"), channels=(3,), cycles=3)
    rows = X.invivo(spark, str(root))
    names = ["R_s_integral", "R_p_integral", "bg_cap"]
    assert rows.count() == 6 and set(names) <= set(rows.columns) and {r.timepoint for r in rows.collect()} == {0, 7}
    rng = np.random.default_rng(0)
    ref = spark.createDataFrame(pd.DataFrame({n: 1 + 0.1 * rng.normal(size=80) for n in [*names, "other"]}).assign(y=lambda d: d.R_s_integral))
    model = R.freeze(ref, [*names, "other"], "y", R.Condition("c"), 2)
    scored, summary = X.recalibrate_invivo(spark, model, str(root), ref)
    assert scored.where("score is null").count() == 0
    got = {r.timepoint: r for r in summary.collect()}
    assert got[0].n_scored == 3 and set(got) == {0, 7} and {r.flag for r in got.values()} <= {"ok", "EXTRAPOLATING", None}
