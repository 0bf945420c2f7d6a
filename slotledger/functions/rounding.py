"""Rounding that agrees with correctly rounded, ties-to-even decimal rounding of binary doubles.

``functions.round`` rounds the shortest decimal text half up, so 1.005 gives 1.01 although the
stored double is below the tie. The reports here round the stored value instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITTER = 134217729.0  # 2**27 + 1 cuts a double into two 26-bit halves
EXACT_LIMIT = 4503599627370496.0  # 2**52, above which a double has no fraction


def round_stored(x: Column, digits: int) -> Column:
    """Round to ``digits`` decimals on the exact binary value, ties to even.

    Pass a plain column: ``x`` appears several times in the result.
    """
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    product = x * scale
    high = x * SPLITTER - (x * SPLITTER - x)
    # what the product lost to rounding; both halves times the scale are exact
    lost = (high * scale - product) + (x - high) * scale
    below = F.floor(product)
    past_tie = (product - below - 0.5) + lost
    step = F.when((past_tie > 0) | ((past_tie == 0) & (below % 2 != 0)), 1).otherwise(0)
    return F.when(F.abs(product) >= EXACT_LIMIT, x).otherwise((below + step) / scale)


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Replace columns by their rounded values."""
    return df.withColumns({name: round_stored(F.col(name), places) for name, places in digits.items()})


def to_nearest(x: Column, unit: int) -> Column:
    """Nearest multiple of ``unit`` as a whole number, ties to the even multiple."""
    return (F.rint(x / float(unit)) * unit).cast("long")


def up_to_multiple(x: Column, unit: int) -> Column:
    return F.ceil(x / unit) * unit
