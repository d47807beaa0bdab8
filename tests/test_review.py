import numpy as np
import pytest

from sparkolyte import cli, errors
from sparkolyte.plans import review
from sparkolyte.sources import raw, synthetic


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    synthetic.write_tree(str(root), {"2-2": ["20260715"]}, channels=(3,), doses=(0, 100, 500, 1000), reps=2)
    rng = np.random.default_rng(0)
    (root / "20260715_ca_signal" / "2-2_fscv_stabilization-start.csv").write_text(synthetic.fscv_text([3], 6, 0, rng))
    return str(root)


def test_inventory(spark, tree):
    rows = review.inventory(spark, tree).collect()
    assert {(r.signaltype, r.dose_nm) for r in rows} == {("eis", 0.0), ("fscv", 0.0), ("fscv", 100.0), ("fscv", 500.0), ("fscv", 1000.0), ("fscv", None)}
    assert all(r.eis_valid for r in rows if r.kind == "eis") and all(r.timepoint == 0 for r in rows)


def test_channel_quality(spark, tree):
    channels, doses = review.channel_quality(spark, tree)
    got = channels.select("overall_valid", "fail_reasons").collect()
    assert [(r.overall_valid, r.fail_reasons) for r in got] == [(True, "")]
    assert doses.count() == 3


def test_replicates_are_reliable(spark, tree):
    assert {"tau_ratio", "R_s_integral"} <= {r.feature for r in review.replicate_reliability(spark, tree).collect()}


def test_stabilization_in_order(spark, tree, tmp_path):
    rows = review.stabilization(spark, tree).select("phase", "cycle", "round", "in_round").orderBy("cycle").collect()
    assert [r.cycle for r in rows] == list(range(6)) and {r.phase for r in rows} == {"start"}
    synthetic.write_tree(str(tmp_path), {"2-2": ["20260715"]}, channels=(3,), doses=(0,), reps=1)
    with pytest.raises(errors.NoStabilizationFiles):
        review.stabilization(spark, str(tmp_path))
    assert review.available(raw.session_files(spark, tree)).count() == 1


def test_command_line(spark, tmp_path):
    assert cli.main(["extract", str(tmp_path / "none"), str(tmp_path / "out")], spark) == 2
    rows = spark.createDataFrame(synthetic.featureset(n_channels=4, n_features=6, informative=3, drop=0.0))
    data = str(tmp_path / "data")
    rows.write.parquet(data)
    assert cli.main(["freeze", data, str(tmp_path / "m"), "-k", "3"], spark) == 0
    assert cli.main(["deploy", str(tmp_path / "m"), data, data, str(tmp_path / "scored")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "scored")).where("score is null").count() == 0
    assert cli.main(["features", data], spark) == 0
    assert cli.predictors(rows) == [f"feat_{i:02d}" for i in range(6)]
