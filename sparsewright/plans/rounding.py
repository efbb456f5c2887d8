"""Rounding of results for comparison between engines."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, without negative zeros."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """What ``rounded`` makes of an array, for rows that Python makes: half up by the shortest decimal of each double, without negative zeros."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(x) * 10.0**digits
        whole = np.floor(y)
        share = y - whole
        out = np.copysign((whole + (share >= 0.5)) / 10.0**digits, x) + 0.0
        # a product's error can cross the middle
        close = np.flatnonzero((np.abs(share - 0.5) <= 1e-15 * y) | (y >= 1e15))
    for i in close:
        v = float(x.flat[i])
        if np.isfinite(v):
            out.flat[i] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(v) < 1e15 else v
    return out
