"""Raw instrument exports: one scan of the files, one parse, two tables of blocks.

Folder and file names are columns, so sessions are filtered by name before any file is opened.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError, NoSessionFolders, NoSignalSessions, NotAFilesystemPath, PartialRedoWarning, PathNotFound, UnparsedFileWarning
from ..functions.names import UnknownFileSuffix, parse_filename, parse_folder, partial_redo, resolve_redo

_FAST = re.compile(r"Fast Cyclic.*Channel\s+(\d+)", re.I)
_BLOCK = re.compile(r"CH\s+(\d+):.*Fixed at\s+(\d+)\s+freqs", re.I)
BLOCKS = (
    "path string, kind string, channel int, rep int, scan int, bracket int, a array<double>, b array<double>, c array<double>, "
    "export_date string, error string"
)


def decode(content: bytes) -> str:
    """UTF-16 with a byte order mark, else UTF-8."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16")
    return content.decode("utf-8-sig", errors="replace")


def split_line(line: str) -> list[str]:
    """Cells of a line; a pair of quotes around the whole line goes, doubled quotes inside it become single."""
    line = line.strip("\r\n")
    if len(line) >= 2 and line[0] == line[-1] == '"':
        line = line[1:-1].replace('""', '"')
    return [c.strip() for c in line.replace("﻿", "").split(",")]


def _number(cell: str) -> float:
    try:
        return float(cell)
    except ValueError:
        return float("nan")


def parse_export(text: str) -> tuple[str | None, list[dict]]:
    """Export date and blocks; a block has kind, channel, rep, scan, bracket and its arrays a, b, c.

    fscv: voltage, current. eis: frequency, real part, imaginary part (the file holds minus the imaginary part).
    """
    rows = [split_line(x) for x in text.splitlines()]
    date = next((r[1] for r in rows if len(r) > 1 and r[0].startswith("Date and time:")), None)
    blocks = _fast(rows) + _impedance(rows)
    if not blocks:
        raise FormatError("neither voltammograms nor impedance blocks found")
    return date, blocks


def _fast(rows: list[list[str]]) -> list[dict]:
    at = next((i for i, r in enumerate(rows) if any("Fast Cyclic" in c for c in r)), None)
    if at is None:
        return []
    cells = [(k, m) for k, c in enumerate(rows[at]) if (m := _FAST.search(c))]
    if not cells:
        return []
    end = next((i for i in range(at + 1, len(rows)) if rows[i][0].startswith("Measurement:") or _BLOCK.search(rows[i][0])), len(rows))
    body = [r for r in rows[at + 3 : end] if np.isfinite(_number(r[0]))]
    if not body:
        raise FormatError("voltammogram headers without samples")
    seen: dict[int, int] = {}
    out = []
    for k, m in cells:
        channel = int(m[1])
        tags = re.findall(r"\[(\d+)\]", rows[at][k])
        pairs = [(_number(r[k]), _number(r[k + 1])) for r in body if len(r) > k + 1]
        v, i = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0), np.zeros(0))
        ok = np.isfinite(v) & np.isfinite(i)
        out.append(
            {
                "kind": "fscv",
                "channel": channel,
                "rep": seen.get(channel, 0),
                "scan": int(tags[0]) if len(tags) > 1 else None,
                "bracket": int(tags[-1]) if tags else None,
                "a": v[ok],
                "b": i[ok],
                "c": np.zeros(0),
            }
        )
        seen[channel] = seen.get(channel, 0) + 1
    return out


def _impedance(rows: list[list[str]]) -> list[dict]:
    out, seen = [], {}
    for i, r in enumerate(rows):
        m = _BLOCK.search(r[0]) if r else None
        if not m:
            continue
        channel, count = int(m[1]), int(m[2])
        head = rows[i + 1] if i + 1 < len(rows) else []
        place = {}
        for name, prefix in (("freq", "freq"), ("real", "Z' "), ("imag", "Z'' ")):
            k = next((k for k, c in enumerate(head) if (c + " ").startswith(prefix)), None)
            if k is None:
                raise FormatError(f"channel {channel}: no column {prefix.strip()!r}")
            place[name] = k
        body = [[_number(x[k]) if k < len(x) else float("nan") for k in place.values()] for x in rows[i + 2 : i + 2 + count]]
        block = np.array(body, float).reshape(-1, 3)
        block = block[np.isfinite(block).all(axis=1)]
        out.append({"kind": "eis", "channel": channel, "rep": seen.get(channel, 0), "scan": None, "bracket": None, "a": block[:, 0], "b": block[:, 1], "c": -block[:, 2]})
        seen[channel] = seen.get(channel, 0) + 1
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in BLOCKS.split(", ")]
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                date, blocks = parse_export(decode(content))
                rows += [{"path": path, "export_date": date, "error": None, **b} for b in blocks]
            except FormatError as e:
                rows.append({"path": path, "error": str(e)})
        out = pd.DataFrame(rows, columns=columns)
        for c in ("channel", "rep", "scan", "bracket"):
            out[c] = out[c].astype("Int32")
        yield out.astype(object).where(out.notna(), None)


def looks_like_url(path: str) -> bool:
    return bool(re.match(r"^(https?|ftp)://", path.strip(), re.I))


def session_files(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, name and their parsed parts; nothing is opened. Redone files stand for their originals.

    Raises for URLs, missing roots, unknown suffixes and roots without session folders; warns of names that don't
    parse and of devices redone in part.
    """
    if looks_like_url(root):
        raise NotAFilesystemPath(root)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise PathNotFound(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(root).select("path")
    files = files.withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = files.withColumn("f", parse_folder(F.col("folder"))).where("f.date is not null")
    if files.isEmpty():
        raise NoSessionFolders(root)
    suffix = F.regexp_extract("name", r"(?i)_\d[\d.]*\s*nM_(\w+)\.csv$", 1)
    bad = files.where((suffix != "") & (F.lower(suffix) != "redo")).select("name").head(3)
    if bad:
        raise UnknownFileSuffix(", ".join(r.name for r in bad))
    partial = partial_redo(files).head(3)
    if partial:
        warnings.warn(f"redone in part: {[tuple(r) for r in partial]}", PartialRedoWarning, stacklevel=2)
    one = resolve_redo(files).withColumn("p", parse_filename(F.concat("stem", F.lit(".csv"))))
    odd = one.where("p.device is null").select("name").head(3)
    if odd:
        warnings.warn(f"not understood: {[r.name for r in odd]}", UnparsedFileWarning, stacklevel=2)
    return one.where("p.device is not null").select("path", "folder", "name", "f.*", "p.*")


def read_blocks(spark: SparkSession, root: str, where: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Blocks of the files with their session's columns. where filters files by name; no other file is opened."""
    files = session_files(spark, root) if files is None else files
    if where:
        files = files.where(where)
    # The reader's own file list, which the driver holds too, cut to the files that are wanted.
    paths = [r.path for r in files.select("path").distinct().collect()]
    if not paths:
        content = spark.createDataFrame([], "path string, content binary")
    else:
        content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return content.mapInPandas(_parse, BLOCKS).join(files, "path")


def once(df: DataFrame) -> DataFrame:
    """df worked out once where several tables are made of it: checkpointed if the session has a shared folder for that."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=False) if sc._jsc.sc().getCheckpointDir().isDefined() else df


def tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """eis_spectra and fscv_cycles of parsed blocks. Files that couldn't be read are in `blocks` with their error."""
    keys = ["path", "device", "devicetype", "testtype", "date", "channel", "rep"]
    good = blocks.where("error is null")
    eis = good.where("kind = 'eis'").select(*keys, F.col("a").alias("freq"), F.col("b").alias("z_real"), F.col("c").alias("z_imag"))
    fscv = good.where("kind = 'fscv'").select(*keys, "dose_nm", "token", "scan", "bracket", F.col("a").alias("voltage"), F.col("b").alias("current"))
    return eis, fscv


def signal_sessions(files: DataFrame, devicetypes: str | list[str] | None = None) -> DataFrame:
    """Files of signal sessions with the device's first day and the timepoint in days."""
    d = files.where("testtype = 'signal'")
    if devicetypes:
        d = d.where(F.col("devicetype").isin([devicetypes] if isinstance(devicetypes, str) else list(devicetypes)))
    if d.isEmpty():
        raise NoSignalSessions("no signal session")
    first = d.groupBy("device").agg(F.min("date").alias("d0"))
    return d.join(first, "device").withColumn("timepoint", F.datediff("date", "d0"))
