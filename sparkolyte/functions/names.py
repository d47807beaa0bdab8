"""Session folder and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Protocol tokens that stand in a dose's place.
KNOWN_TOKENS = ("stabilization", "bgd", "baseline", "live")
SIGNALS = ("eis", "fscv", "paired")


def parse_filename(name: Column) -> Column:
    """Struct device, signaltype, dose_nm, token of `<device>_<signal>_<dose>.csv`; NULL device where it doesn't parse."""
    stem = F.regexp_replace(name, r"(?i)\.csv$", "")
    parts = F.split(stem, "_")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    signal = F.lower(F.get(parts, n - 2))
    ok = (n >= 3) & signal.isin(*SIGNALS)
    dose = F.when(last.rlike(r"^[0-9.]+\s*n[mM]$"), F.regexp_extract(last, r"^([0-9.]+)", 1).try_cast("double"))
    return F.struct(
        F.when(ok, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "_")).alias("device"),
        F.when(ok, signal).alias("signaltype"),
        F.when(ok, dose).alias("dose_nm"),
        F.when(ok & dose.isNull(), F.lower(last)).alias("token"),
    )


def parse_folder(name: Column) -> Column:
    """Struct date, devicetype, testtype of `<YYYYMMDD>_<devicetype>_<testtype>`; NULLs where the date is none."""
    date = F.try_to_date(F.regexp_extract(name, r"^(\d{8})_", 1), "yyyyMMdd")
    middle = F.regexp_extract(name, r"^\d{8}_(?:(.*)_)?([^_]*)$", 1)
    last = F.lower(F.regexp_extract(name, r"^\d{8}_(?:(.*)_)?([^_]*)$", 2))
    return F.struct(
        date.alias("date"),
        F.when(date.isNotNull(), middle).alias("devicetype"),
        F.when(date.isNotNull(), last).alias("testtype"),
    )


class UnknownFileSuffix(ValueError):
    """A file name ends in a suffix other than _redo."""


def split_redo(name: Column) -> tuple[Column, Column]:
    """Lower-cased stem without _redo, and whether it was there."""
    stem = F.lower(F.regexp_replace(name, r"(?i)\.csv$", ""))
    return F.regexp_replace(stem, r"_redo$", ""), stem.endswith("_redo")


def resolve_redo(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """One file per folder and stem: the redone one (the last by name), else the first of case variants."""
    stem, redo = split_redo(F.col(name))
    w = W.partitionBy(folder, "stem").orderBy(
        F.desc("is_redo"), F.when(F.col("is_redo"), F.col(name)).desc_nulls_last(), F.col(name)
    )
    return (
        files.withColumn("stem", stem)
        .withColumn("is_redo", redo)
        .withColumn("_rank", F.row_number().over(w))
        .where("_rank = 1")
        .drop("_rank")
    )


def partial_redo(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Devices of a folder that have redone and original numeric doses side by side."""
    one = resolve_redo(files, folder, name)
    parsed = one.withColumn("p", parse_filename(F.concat("stem", F.lit(".csv"))))
    return (
        parsed.where("p.dose_nm is not null")
        .groupBy(folder, F.col("p.device").alias("device"))
        .agg(F.bool_or("is_redo").alias("redone"), F.bool_or(~F.col("is_redo")).alias("original"))
        .where("redone and original")
        .select(folder, "device")
    )
