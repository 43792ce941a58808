"""Values at a rank, by refined histograms: no sort, and no window over all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_at_offset(table: DataFrame, value: str, share: float, cells: int = 1024) -> float | None:
    """The value at descending offset floor(n * share) among the n rows whose value is positive (NaN is not); None if there is none.

    Each round counts the values in ``cells`` equal parts of the range that still holds the rank, with the least and greatest value of each
    part, and descends into one of them, until a single value is left: a few rounds, each one scan with partial counts.
    """
    rows = table.select(F.col(value).cast("double").alias("v")).filter((F.col("v") > 0) & ~F.isnan("v"))
    n, low, high = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    offset, above = math.floor(n * share), 0
    while low < high:
        width = high / 2 - low / 2  # halves do not overflow
        cell = F.least(F.lit(cells - 1), F.floor((F.col("v") / 2 - low / 2) / F.lit(width) * cells))
        found = rows.filter(F.col("v").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for part in sorted(found, key=lambda r: -r.cell):  # at most ``cells`` rows
            if above + part.n > offset:
                low, high = part.low, part.high
                break
            above += part.n
    return high
