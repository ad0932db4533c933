"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup side is broadcast only when its estimated size is within this bound.
# For written tables the estimate is the size of the (compressed) files; in
# memory a side can be several times larger, which the bound leaves room for.
BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def _plan_size_bound(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan, in bytes.

    For scans, filters and projections (the lookup tables used here)
    the estimate is the input size scaled by row width, an upper bound
    on the real size.  ``None`` when unavailable.
    """
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001  (e.g. Spark Connect: no plan access)
        return None


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the plan of ``df`` is bounded to ``max_bytes`` (default ``BROADCAST_MAX_BYTES``).  No job runs."""
    size = _plan_size_bound(df)
    return size is not None and size <= (BROADCAST_MAX_BYTES if max_bytes is None else max_bytes)


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast only for a side whose plan is bounded to ``max_bytes``.

    No job runs.  Beyond the bound the side is returned unhinted and AQE
    chooses from runtime shuffle sizes (sort-merge join with skew
    splitting, or a broadcast if it turns out small).
    """
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df
