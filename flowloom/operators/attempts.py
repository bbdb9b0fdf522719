"""Retries, isolation and timing over recorded attempts: one row per attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(attempts: DataFrame, key: str, order: str, failed: Column, transient: Column, max_attempts: int = 3) -> DataFrame:
    """Per key: the attempt that counts, by order, and whether it succeeded.

    Attempts stop at the first success, at the first failure that isn't transient, and after
    max_attempts. `order` numbers a key's attempts from 0. One aggregation.
    """
    stops = ~failed | ~transient | (F.col(order) >= max_attempts - 1)
    first = F.min(F.when((F.col(order) < max_attempts) & stops, F.struct(F.col(order).alias("attempt"), failed.alias("failed"))))
    last = F.max(F.when(F.col(order) < max_attempts, F.struct(F.col(order).alias("attempt"), failed.alias("failed"))))
    g = attempts.groupBy(key).agg(F.coalesce(first, last).alias("_o"))
    return g.select(key, F.col("_o.attempt").alias("attempt"), (~F.col("_o.failed")).alias("succeeded"))


def isolated(rows: DataFrame, failed: Column, degraded: dict[str, Column]) -> DataFrame:
    """Failing rows with degraded values; `isolated` marks them."""
    return rows.withColumns({**{c: F.when(failed, v).otherwise(F.col(c)) for c, v in degraded.items()}, "isolated": failed})
