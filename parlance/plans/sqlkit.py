"""Small helpers that both sides of a query use: rounding, and fragments of DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, and no negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def bal(pos: str, neg: str) -> str:
    return f"(({pos} - {neg}) / ({pos} + {neg} + 1.0::DOUBLE))"
