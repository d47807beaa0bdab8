"""Covariance distance between a reference and a batch, and scoring by frozen coefficients."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the partitions' products before the driver does.
ADDERS = 32


def _products(df: DataFrame, values: list[str], design: Callable[[np.ndarray], np.ndarray], weight: str | None, by: str | None) -> DataFrame:
    """by, blob, n: sums over rows of design(row)' design(row), weighted, per value of by.

    A partition adds up its own rows; a partition's sums have a fixed size, so no task holds rows.
    """
    kind = dict(df.dtypes)[by] if by else "int"
    picked = df.select((F.col(by) if by else F.lit(0)).alias("by"), (F.col(weight) if weight else F.lit(1.0)).alias("w"), *values)
    columns = len(values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        by_type = None
        for batch in batches:
            by_type = batch.column(0).type
            group = batch.column(0).to_pylist()
            w = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), float)
            x = np.stack([np.asarray(batch.column(2 + i).to_numpy(zero_copy_only=False), float) for i in range(columns)], axis=1)
            at: dict = {}
            for i, g in enumerate(group):
                at.setdefault(g, []).append(i)
            for g, rows in at.items():
                z = design(x[rows])
                old = sums.get(g)
                new = z.T @ (z * w[rows, None])
                sums[g] = (new, len(rows)) if old is None else (old[0] + new, old[1] + len(rows))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), by_type), pa.array([m.tobytes() for m, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())],
                ["by", "blob", "n"],
            )

    def add(found: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b.as_buffer()) for b in found.column("blob")], axis=0)
        return pa.table({"by": found.column("by")[:1], "blob": pa.array([total.tobytes()], pa.binary()), "n": pa.array([sum(found.column("n").to_pylist())], pa.int64())})

    schema = f"by {kind}, blob binary, n long"
    parts = picked.mapInArrow(partial, schema).withColumn("_adder", F.pmod(F.spark_partition_id(), F.lit(ADDERS)))
    return parts.groupBy("by", "_adder").applyInArrow(add, schema).groupBy("by").applyInArrow(add, schema)


def gramian(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """Weighted sums of products of (1, columns) over all rows, and the number of rows. No value may be missing."""
    found = _products(df, columns, lambda x: np.column_stack([np.ones(len(x)), x]), weight, None).first()
    size = len(columns) + 1
    return (np.frombuffer(found.blob).reshape(size, size), found.n) if found else (np.zeros((size, size)), 0)


def _clean(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _present(x: np.ndarray) -> np.ndarray:
    """Values with 0 for missing ones, and which are there."""
    there = np.isfinite(x)
    return np.column_stack([np.where(there, x, 0.0), there])


def _pairwise(products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means, and sample covariances over the rows where both values are there (NaN under two)."""
    p = len(products) // 2
    xx, xm, mm = products[:p, :p], products[:p, p:], products[p:, p:]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = np.where(mm >= 2, (xx - xm * xm.T / mm) / (mm - 1), np.nan)
        return np.diag(xm) / np.diag(mm), cov


def moments(df: DataFrame, columns: list[str], by: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """by, blob and n per value of by, and the shift that the values were moved by to keep digits."""
    first = df.agg(*[F.avg(_clean(c)) for c in columns]).first()
    shift = np.array([m or 0.0 for m in first], float)
    moved = df.select(*([by] if by else []), *[(_clean(c) - float(m)).alias(f"_v{i}") for i, (c, m) in enumerate(zip(columns, shift, strict=True))])
    return _products(moved, [f"_v{i}" for i in range(len(columns))], _present, None, by), shift


def mean_and_covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of all rows, as numbers of features by features."""
    sums, shift = moments(df, columns)
    found = sums.first()
    if found is None:
        return np.full(len(columns), np.nan), np.full((len(columns), len(columns)), np.nan), 0
    mean, cov = _pairwise(np.frombuffer(found.blob).reshape(2 * len(columns), -1))
    return mean + shift, cov, found.n


def coral_distance(df: DataFrame, columns: list[str], reference: Column, batch: Column, by: list[str] | None = None) -> DataFrame:
    """distance = Frobenius norm of the covariance difference + length of the mean difference, per `by`; NULL under two rows.

    Sample covariances over pairs of values that are there; an epsilon on both diagonals would cancel out.
    """
    ref_mean, ref_cov, _ = mean_and_covariance(df.where(reference), columns)
    rows = df.where(batch)
    if by:
        rows = rows.withColumn("_by", F.struct(*by))
        index = rows.select("_by").distinct().withColumn("_key", F.to_json("_by", {"ignoreNullFields": "false"}))
        rows = rows.withColumn("_key", F.to_json("_by", {"ignoreNullFields": "false"}))
    sums, shift = moments(rows, columns, "_key" if by else None)
    size = 2 * len(columns)
    kind = "string" if by else "int"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blob, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mean, cov = _pairwise(np.frombuffer(blob).reshape(size, size))
                d = np.linalg.norm(cov - ref_cov) + np.linalg.norm(mean + shift - ref_mean)
                out.append(float(d) if n >= 2 and np.isfinite(d) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.float64())], ["by", "n", "distance"])

    found = sums.mapInArrow(measure, f"by {kind}, n long, distance double")
    if not by:
        return found.select("n", "distance")
    return index.join(found, F.col("_key") == F.col("by")).select("_by.*", "n", "distance")


def linear_score(df: DataFrame, columns: list[str], means: list[float], coefficients: list[float], intercept: float, log: bool = False) -> DataFrame:
    """Adds score = (x - means) . coefficients + intercept, through exp with clipping at 50 when log."""
    s = F.lit(float(intercept))
    for c, m, w in zip(columns, means, coefficients, strict=True):
        s = s + (F.col(c) - m) * w
    if log:
        s = F.exp(F.least(F.greatest(s, F.lit(-50.0)), F.lit(50.0)))
    return df.withColumn("score", s)


def flag_extrapolation(distances: DataFrame, limit: float) -> DataFrame:
    return distances.withColumn("flag", F.when(F.col("distance") > limit, "EXTRAPOLATING").otherwise("ok"))
