"""Batch registry as an append log with latest-wins reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_entries(log: DataFrame) -> DataFrame:
    """The newest entry per (firm, batch); a rebuild replaces its predecessor."""
    rest = [c for c in log.columns if c not in ("firm_id", "batch_id")]
    best = log.groupBy("firm_id", "batch_id").agg(
        F.max_by(F.struct(*rest), "recorded_at").alias("e"))
    return best.select("firm_id", "batch_id", "e.*")


def ready_batches(log: DataFrame, firm_id: str, limit: int | None = None,
                  ready_only: bool = True) -> DataFrame:
    """A firm's batches, newest first; all of them, or the first ``limit``."""
    rows = latest_entries(log.where(F.col("firm_id") == firm_id))
    if ready_only:
        rows = rows.where(F.col("status") == "ready")
    rows = rows.orderBy(F.desc("timestamp"), F.desc("batch_id"))
    return rows if limit is None else rows.limit(limit)


def latest_ready(log: DataFrame) -> DataFrame:
    """The newest ready batch of every firm."""
    ready = latest_entries(log).where(F.col("status") == "ready")
    rest = [c for c in ready.columns if c != "firm_id"]
    best = ready.groupBy("firm_id").agg(
        F.max_by(F.struct(*rest), F.struct("timestamp", "batch_id")).alias("e"))
    return best.select("firm_id", "e.*")
