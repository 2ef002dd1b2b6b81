"""Header repair and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def normalize_columns(df: DataFrame, lower: bool = False) -> DataFrame:
    """Trim column names (and a stray byte-order mark); optionally lower-case them."""
    names = [c.strip("﻿").strip() for c in df.columns]
    return df.toDF(*[n.lower() if lower else n for n in names])


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; found {df.columns}")
    return df
