"""Featuresets and raw trees by name: synthetic, demo, a raw tree, or a table."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DemoTreeNotFound, NoSessionFolders, NotAFilesystemPath, PathNotFound
from ..functions.names import parse_folder
from . import artifacts, raw, synthetic

#: Environment variable that names a folder with demonstration trees.
VARIABLE = "SPARKOLYTE_DEMO"
KINDS = {"in_vitro": synthetic.write_tree, "in_vivo": synthetic.write_invivo_tree}


def candidate_roots() -> list[Path]:
    """Folders that may hold a demo folder: the variable's, the current one and those above, the package's."""
    named = [Path(os.environ[VARIABLE]), Path(os.environ[VARIABLE]).parent] if os.environ.get(VARIABLE) else []
    here = Path.cwd()
    return list(dict.fromkeys([*named, here, *here.parents, Path(__file__).resolve().parents[2]]))


def find_demo_tree(kind: str = "in_vitro") -> Path | None:
    """The first demo/<kind>/input or <kind>/input with something in it."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(KINDS)}")
    for root in candidate_roots():
        for at in (root / "demo" / kind / "input", root / kind / "input"):
            if at.is_dir() and any(at.iterdir()):
                return at
    return None


def require_dir(path: str, what: str = "folder") -> str:
    if not Path(path).is_dir():
        raise DemoTreeNotFound(f"no {what} at {Path(path).resolve()}")
    return str(Path(path).resolve())


def demo_input(kind: str = "in_vitro", user_path: str | None = None, synthesize: bool = True, **kw) -> str:
    """The path given, a demonstration tree that is there, or a new one."""
    if user_path is not None:
        return require_dir(user_path, f"{kind} tree")
    found = find_demo_tree(kind)
    if found is not None:
        return str(found)
    if not synthesize:
        raise DemoTreeNotFound(f"no demo/{kind}/input or {kind}/input under {[str(r) for r in candidate_roots()]}")
    return str(KINDS[kind](tempfile.mkdtemp(prefix=f"demo-{kind}-"), **kw))


def validate_path(spark: SparkSession, path: str) -> str:
    if raw.looks_like_url(path):
        raise NotAFilesystemPath(f"{path} is a URL; fetch or mount it first")
    if not artifacts.exists(spark, path):
        raise PathNotFound(f"{path} does not exist")
    return path


def session_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under root that are sessions; a driver's listing of one folder."""
    at, fs = artifacts._file(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
    if not names:
        return []
    d = spark.createDataFrame([(n,) for n in names], "name string").where(parse_folder(F.col("name"))["date"].isNotNull())
    return sorted(r.name for r in d.collect())


def validate_raw_root(spark: SparkSession, root: str) -> str:
    """root, if it holds sessions; otherwise an error that says where they are, one level up or down."""
    validate_path(spark, root)
    if session_folders(spark, root):
        return root
    at, fs = artifacts._file(spark, root)
    if at.getParent() is not None and session_folders(spark, f"{at.getParent()}") and parse_ok(spark, at.getName()):
        raise NoSessionFolders(f"{root} is a session itself; give the folder above it")
    for child in fs.listStatus(at):
        if child.isDirectory() and session_folders(spark, child.getPath().toString()):
            raise NoSessionFolders(f"{root} holds no session; {child.getPath().getName()} below it does")
    raise NoSessionFolders(f"{root} holds no session folder")


def parse_ok(spark: SparkSession, name: str) -> bool:
    return spark.createDataFrame([(name,)], "n string").where(parse_folder(F.col("n"))["date"].isNotNull()).count() > 0


def is_table(path: str) -> bool:
    return path.lower().endswith((".parquet", ".csv"))


def load_frame(spark: SparkSession, source: str, **extraction) -> DataFrame:
    """A featureset: "synthetic", "demo", a raw tree (extracted with the given options) or a table."""
    if source == "synthetic":
        return spark.createDataFrame(synthetic.featureset())
    if source == "demo":
        source = demo_input()
    validate_path(spark, source)
    at, fs = artifacts._file(spark, source)
    if not is_table(source) and fs.getFileStatus(at).isDirectory() and not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source, "_SUCCESS")):
        from ..plans.extract import extract

        return extract(spark, validate_raw_root(spark, source), **extraction)
    return artifacts.read_table(spark, source)
