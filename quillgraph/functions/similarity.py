"""Text similarity for linking: token-set ratio on longest common subsequences.

Spark has edit distance, which isn't this measure, so it is a pandas function over Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: a row is one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return (full & ~row).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common character."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of comparing the shared words with either side's shared and other words; 0 for an empty side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    one, two = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = indel_ratio(one, two)
    return max(best, indel_ratio(both, one), indel_ratio(both, two)) if both else best


@F.pandas_udf(DoubleType())
def token_set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """T6 on columns that are normalised for linking; null counts as empty."""
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
