"""The registered queries and their SQL."""

from __future__ import annotations

from . import dose_queries, fit_queries, model_free_queries, review_queries, spectra_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
