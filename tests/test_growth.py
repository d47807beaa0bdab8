"""Steps that must not hold a fold's rows in one task or take a loop per row, against plain versions of their rules."""

import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkolyte.functions import numerics as N
from sparkolyte.operators import blocks as B
from sparkolyte.operators import discovery as R
from sparkolyte.operators import dose as D
from sparkolyte.operators import fits as T
from sparkolyte.operators import models as M
from sparkolyte.sources import adapters as A

K3 = ["device", "channel", "timepoint"]


def plan(df):
    return df._jdf.queryExecution().toString()


def doses(seed=3, channels=9, times=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(channels):
        for t in range(times):
            a, b = rng.normal(size=2)
            for dose in rng.permutation([100.0, 250.0, 500.0, 1000.0, 5000.0])[: rng.integers(2, 6)]:
                x = np.log10(dose)
                rows.append((c % 3, c, t * 7, dose, 10 + a + (3 + b) * x + 0.2 * b * x * x + rng.normal() / 5, None if (c, t) == (2, 1) else a, b))
    return pd.DataFrame(rows, columns=[*K3, "concentration", "response", "p", "q"])


def plain_framings(df, k=2, min_train=8):
    got = []
    for t in sorted(df.timepoint.unique()):
        train, test = df[df.timepoint < t], df[df.timepoint == t]
        if len(train) < min_train:
            continue
        a, b = R._prepare(train[["p", "q"]].to_numpy(float), test[["p", "q"]].to_numpy(float))
        x, y, xt, yt = (np.log10(d.concentration.to_numpy()) if c else d.response.to_numpy() for d in (train, test) for c in (1, 0))
        fit = lambda d, z: M.PLS(min(k, d.shape[1], len(d) - 1)).fit(d, z)
        m = fit(np.column_stack([a, x]), y)
        p = m.predict(np.column_stack([b, xt]))
        got += [("current", yt[i] - p[i], -(yt[i] - p[i]) / m.coef[2, 0]) for i in range(len(yt))]
        m = fit(np.column_stack([a, x, a * x[:, None]]), y)
        p = m.predict(np.column_stack([b, xt, b * xt[:, None]]))
        slope = m.coef[2, 0] + b @ m.coef[3:, 0]
        got += [("interaction", yt[i] - p[i], -(yt[i] - p[i]) / slope[i]) for i in range(len(yt))]
        for name, degree in (("sensitivity", 1), ("quadratic", 2)):
            at = [i for i in train.groupby(K3).indices.values() if len(i) > degree]
            m = fit(np.array([a[i[0]] for i in at]), np.array([np.polyfit(x[i], y[i], degree) for i in at]))
            for c, u, v in zip(m.predict(b), xt, yt, strict=True):
                roots = np.roots(np.append(c[:-1], c[-1] - v))
                roots = roots[np.abs(roots.imag) < 1e-9].real
                got.append((name, v - np.polyval(c, u), u - roots[np.argmin(np.abs(roots - np.median(x)))] if len(roots) else np.nan))
    g = pd.DataFrame(got, columns=["framing", "e", "g"]).groupby("framing")
    return {n: (len(d), np.sqrt((d.e**2).mean()), np.sqrt((d.g**2).mean())) for n, d in g}


def test_framings_by_sums_of_products(spark):
    df = doses()
    got = R.target_framings(spark.createDataFrame(df), ["p", "q"], K3)
    assert "FlatMapGroups" not in plan(got)
    rows = {r.framing: (r.n, r.rmsep, r.log_conc_rmse) for r in got.collect()}
    want = plain_framings(df)
    assert rows.keys() == want.keys() and len(want) == 4
    for name, w in want.items():
        assert rows[name] == pytest.approx(w, rel=1e-6), name
    assert R.target_framings(spark.createDataFrame(df).where(F.lit(False)), ["p", "q"], K3).count() == 0


@pytest.mark.parametrize("how", ["langmuir", "hill"])
def test_curves_are_fitted_together(spark, how):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        top, half, n = rng.uniform(2, 9), rng.uniform(150, 900), rng.uniform(0.7, 2) if how == "hill" else 1.0
        for c in [100.0, 250.0, 500.0, 1000.0, 5000.0][: 5 if g % 10 else 2]:
            rows.append((g, c, top * c**n / (half**n + c**n), top, half, n, float(rng.integers(0, 4))))
    df = pd.DataFrame(rows, columns=["g", "concentration", "response", "top", "half", "n", "snr"])
    got = T.curve_fit(spark.createDataFrame(df).orderBy(F.rand(1)), ["g"], how, "snr")
    assert "FlatMapGroups" not in plan(got)
    found = {r.g: (r.ymax, r.k_half, *((r.exponent,) if how == "hill" else ())) for r in got.collect()}
    assert len(found) == 60
    for g, d in df.groupby("g"):
        want = [d.top.iloc[0], d.half.iloc[0], d.n.iloc[0]][: len(found[g])]
        assert found[g] == (pytest.approx(want, rel=1e-3) if g % 10 else tuple([None] * len(want))), g
    # A curve's fit doesn't depend on those beside it, however long they are.
    c, y = df[df.g == 1].concentration.to_numpy(), df[df.g == 1].response.to_numpy()
    one = getattr(N, how)(c, y)
    both = getattr(N, f"{how}s")([np.tile(c, 3), c], [np.tile(y, 3) + 1, y])
    assert both[1] == pytest.approx(one, rel=1e-9)


@pytest.mark.parametrize("kind", ["apart", "alike", "steps", "tails", "filled"])
def test_nearest_neighbours_without_all_pairs(kind):
    rng = np.random.default_rng(7)
    for n in (5, 40, 700):
        x, y = rng.normal(size=n), rng.normal(size=n)
        if kind == "alike":
            y = x + 1e-3 * y
        if kind == "steps":
            x = np.round(x)
        if kind == "tails":
            x, y = rng.standard_cauchy(n), rng.standard_cauchy(n)
        if kind == "filled":
            x, y = np.where(rng.random(n) < 0.7, 0, x), np.where(rng.random(n) < 0.3, 0, y)
        far = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        np.fill_diagonal(far, np.inf)
        assert np.array_equal(N.neighbour_radius(x, y, 3), np.sort(far, axis=1)[:, 2])


def test_mutual_information_of_many_rows_takes_seconds():
    rng = np.random.default_rng(8)
    x, began = rng.normal(size=60_000), time.process_time()
    assert N.mutual_information(x, x + rng.normal(size=60_000)) == pytest.approx(np.log(2) / 2, abs=0.02)
    assert time.process_time() - began < 20


def test_means_are_summed_in_the_order_of_the_events(spark, tmp_path):
    """Equal means must be equal and thresholds meet to the bit, however the events lie in files."""
    rng = np.random.default_rng(9)
    e = pd.DataFrame({"event_id": np.arange(2400), "user_id": np.arange(2400) % 300, "value": np.round(rng.uniform(0, 500, 2400), 2)})
    e.loc[rng.random(2400) < 0.05, "value"] = None
    table = spark.createDataFrame(e).select("event_id", F.lit("2024-01-01").cast("timestamp").alias("ts"), "user_id", F.lit("click").alias("event_type"), F.expr("nanvl(value, null)").alias("value"), F.lit("{}").alias("props"))
    table.repartition(11, F.hash("event_id")).sortWithinPartitions(F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for user, values in e.dropna().groupby("user_id").value:
        total = 0.0
        for v in values:
            total += v
        want[user] = total / len(values)
    found = A.observations(spark, str(tmp_path)).collect()
    assert {r.channel: r.response for r in found if r.response is not None} == want
    found = D.repeatability(A.replicates(spark, str(tmp_path)), [*K3, "concentration"], order="event_id").collect()
    assert {r.channel: r["mean"] for r in found if r["mean"] is not None} == want


def gappy(n=900, p=12, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.uniform(0.5, 4, p) + rng.normal(size=p)
    x[:, 3] = 2.5
    x[rng.random((n, p)) < 0.05] = np.nan
    y = 9 + np.nan_to_num(x[:, 0]) - 0.5 * np.nan_to_num(x[:, 1]) + 0.3 * rng.normal(size=n)
    return x, np.exp(y / 8), np.sort(rng.permutation(n)[: n - 50])


def test_models_and_selectors_of_blocks_are_those_of_rows(monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 64)
    x, y, at = gappy()
    s = B.Scaled(x, at).fitted()
    z, y = R._prepare(x[at])[0], y[at]
    assert np.allclose(s.apply(lambda v: v), z, atol=1e-12)
    for name in M.ARCHITECTURES:
        for k in (1, 3):
            w = np.linspace(1, 3, len(y)) if name == "weighted" else None
            a, b = M.build(name, k).fit(z, y, w), B.fit(name, k, s, y, w)
            assert np.allclose(a.predict(z), s.apply(b.predict), rtol=1e-8), name
    for name in ("vip", "sr", "smc", "mi"):
        assert np.array_equal(M.select(name, z, y), B.select(name, s, y, None, 2, 0)), name
    for seed in (0, 1):
        assert np.array_equal(M.cars(z, y, seed=seed), B.cars(s, y, seed=seed))
    sensor, time_ = at % 5, at % 4
    assert np.array_equal(M.temporal_select(z, sensor, time_, 0.01), B.temporal_select(s, sensor, time_, 0.01))


def test_a_fold_is_held_once(spark):
    n, p = 20_000, 64
    names = [f"f{i}" for i in range(p)]
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, p))
    y = x[:, 0] + rng.normal(size=n)
    rows = {"_job": ["plain"] * n, "t_test": np.full(n, 3.0), "_sensor": np.arange(n) % 7, "_t": (np.arange(n) % 4).astype(float), "_y": y, "_conc": np.full(n, np.nan), "_snr": np.full(n, np.nan), "_test": np.arange(n) % 4 == 3}
    table = pa.table({**rows, **dict(zip(names, x.T, strict=True))})
    job = {"plain": [(R.Condition("a", k_grid=(1, 2)), 0), (R.Condition("b", selector="cars"), 0)]}
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in R._task(job, "global", names, {"generations": 4}, [])(iter(table.to_batches(1000))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 14 and peak < 2 * x.nbytes


def test_ridge_and_logistic_of_blocks_are_those_of_rows(monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 64)
    x, y, at = gappy()
    s = B.Scaled(x, at).fitted(impute=False)
    z, y = M.zscore(x[at])[0], y[at]
    assert np.allclose(s.apply(lambda v: v), z, atol=1e-12)
    a, b = M.ridge_loo(z, y), B.ridge_loo(s, y)
    assert a.alpha == b.alpha and np.allclose(a.predict(z), s.apply(b.predict), rtol=1e-9)
    label = (y > np.median(y)).astype(float)
    (u, c), (v, d) = M.logistic(z, label), B.logistic(s, label)
    assert np.allclose(u, v, atol=1e-8) and c == pytest.approx(d, abs=1e-8)
