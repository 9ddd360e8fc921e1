"""Seeded pseudo-random order that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *keys: str | Column) -> Column:
    """``md5(seed:key[:key...])``: a uniform, reproducible order over rows with unique keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
