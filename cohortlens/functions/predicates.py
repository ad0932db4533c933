"""SQL LIKE predicates with the reference's three-valued semantics.

``col.like(p)`` is used as written: Catalyst rewrites wildcard-free
patterns to equality and ``'x%'`` to StartsWith, both pushed to the
Parquet scan; ``_`` stays a one-character wildcard.  NULL inputs make
the predicate NULL, so ``NOT LIKE`` drops NULL rows, as in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_all_not(c: str, patterns) -> Column:
    """``c NOT LIKE p1 AND c NOT LIKE p2 ...`` (TRUE when no patterns)."""
    preds = [~F.col(c).like(p) for p in patterns]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def like_any(c: str, patterns) -> Column:
    preds = [F.col(c).like(p) for p in patterns]
    return reduce(lambda a, b: a | b, preds)


def organic_group(channels, sub_channel: str) -> Column:
    """``channel LIKE 'Organic' OR sub_channel LIKE 'Organic' OR channel LIKE 'Not available'``."""
    first, *rest = channels
    pred = F.col("acquisition_channel").like(first) | F.col("acquisition_sub_channel").like(sub_channel)
    for ch in rest:
        pred = pred | F.col("acquisition_channel").like(ch)
    return pred
