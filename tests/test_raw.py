import warnings

import numpy as np
import pytest

from sparkolyte import errors
from sparkolyte.functions.names import UnknownFileSuffix
from sparkolyte.plans import extract
from sparkolyte.sources import artifacts, raw, synthetic
from sparkolyte.streaming import sessions


def test_quoted_lines_parse_alike():
    text = synthetic.fscv_text([3, 5], 2, 100, np.random.default_rng(0)) + synthetic.eis_text([3], 2, np.random.default_rng(0))
    quoted = "\n".join('"' + x.replace('"', '""') + '"' if i % 2 else x for i, x in enumerate(text.splitlines()))
    a, b = raw.parse_export(text), raw.parse_export(quoted)
    assert a[0] == b[0] == "2026-07-15 10:00:00"
    assert [(x["kind"], x["channel"], x["rep"]) for x in a[1]] == [("fscv", 3, 0), ("fscv", 3, 1), ("fscv", 5, 0), ("fscv", 5, 1), ("eis", 3, 0), ("eis", 3, 1)]
    assert all(np.array_equal(x["b"], y["b"]) for x, y in zip(a[1], b[1], strict=True))
    assert (a[1][4]["c"] < 0).all()


def test_unreadable_exports():
    with pytest.raises(errors.FormatError):
        raw.parse_export("Date and time:,x\n")
    with pytest.raises(errors.FormatError, match="column"):
        raw.parse_export("CH 3: Fixed at 1 freqs\nfreq / Hz,other\n1,2\n")
    assert raw.decode("a".encode("utf-16")) == "a" and raw.decode(b"\xef\xbb\xbfa") == "a"


def test_paths(spark, tmp_path):
    with pytest.raises(errors.NotAFilesystemPath):
        raw.session_files(spark, "https://example.org/x")
    with pytest.raises(errors.PathNotFound):
        raw.session_files(spark, str(tmp_path / "none"))
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.csv").write_text("x")
    with pytest.raises(errors.NoSessionFolders):
        raw.session_files(spark, str(tmp_path))
    folder = tmp_path / "20260715_ca_signal"
    folder.mkdir()
    (folder / "2-2_fscv_100 nM_other.csv").write_text("x")
    with pytest.raises(UnknownFileSuffix):
        raw.session_files(spark, str(tmp_path))


def test_redone_files_stand_in(spark, tmp_path):
    folder = tmp_path / "20260715_ca_signal"
    folder.mkdir()
    for n in ("2-2_fscv_100 nM.csv", "2-2_fscv_100 nM_redo.csv", "2-2_fscv_500 nM.csv"):
        (folder / n).write_text("x")
    with pytest.warns(errors.PartialRedoWarning):
        names = {r.name for r in raw.session_files(spark, str(tmp_path)).collect()}
    assert names == {"2-2_fscv_100 nM_redo.csv", "2-2_fscv_500 nM.csv"}


def test_tree_to_featureset(spark, tmp_path):
    synthetic.write_tree(str(tmp_path / "t"), {"2-2": ["20260715"]}, channels=(3,), doses=(0, 100, 500, 1000), reps=2)
    rows = extract.extract(spark, str(tmp_path / "t"), n_grid=3).select("concentration", "NormIpeak", "R_s_f00").collect()
    assert sorted(r.concentration for r in rows) == [100, 500, 1000]
    peaks = [r.NormIpeak for r in sorted(rows, key=lambda r: r.concentration)]
    assert peaks == sorted(peaks) and all(r.R_s_f00 == pytest.approx(1) for r in rows)


def test_stream_reads_each_file_once(spark, tmp_path):
    synthetic.write_tree(str(tmp_path / "t"), {"2-2": ["20260715"]}, channels=(3,), doses=(0, 100), reps=1)
    for _ in range(2):
        sessions.append_blocks(spark, str(tmp_path / "t"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_pins(spark, tmp_path):
    pin = artifacts.Pin((10.0, 1e5), {"a": "2026-07-15"}, {"*": [1.0]}, ["x"], {"a|2026-07-15": 3})
    artifacts.save_pin(spark, str(tmp_path / "pin.json"), pin)
    back = artifacts.load_pin(spark, str(tmp_path / "pin.json"))
    assert back.session_rows == pin.session_rows and back.band == pin.band
    artifacts.check_pin(back, {"a|2026-07-15": 3}, ["x"], {"a": "2026-07-15"})
    for bad in (({"a|2026-07-15": 2}, ["x"], {}), ({"b|2026-07-15": 3}, ["x"], {}), ({}, ["y"], {}), ({}, ["x"], {"b": "2026-07-15"}), ({}, ["x"], {"a": "2026-07-01"})):
        with pytest.raises(errors.PinMismatch):
            artifacts.check_pin(back, *bad)
    with pytest.raises(errors.PinMismatch):
        artifacts.load_pin(spark, {"band": [1, 2]})
    assert artifacts.load_config(spark, None, mono_tol=0.2).mono_tol == 0.2


def test_no_warnings_for_plain_trees(spark, tmp_path):
    synthetic.write_tree(str(tmp_path), {"2-2": ["20260715"]}, channels=(3,), doses=(0,), reps=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error", errors.UnparsedFileWarning)
        assert raw.session_files(spark, str(tmp_path)).count() == 2
