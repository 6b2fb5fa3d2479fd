"""Retention over objects (object_id, size_bytes, refcount, created_at, last_accessed): what goes, and what stays with its references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import age, expired


def sweep(objs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Objects without references or past their time."""
    return objs.where((F.col("refcount") == 0) | expired(now, ttl_seconds))


def prune(objs: DataFrame, now: Column, max_age_seconds: int = 0, max_idle_seconds: int = 0) -> DataFrame:
    """Objects that are too old or too long unread; 0 switches a limit off."""
    old = age(now, F.col("created_at")) > max_age_seconds if max_age_seconds else F.lit(False)
    idle = age(now, F.col("last_accessed")) > max_idle_seconds if max_idle_seconds else F.lit(False)
    return objs.where(old | idle)


def evict_lru(objs: DataFrame, target_bytes: int, slice_seconds: int = 3600) -> DataFrame:
    """The longest unread referenced objects, until at most target_bytes are left.

    Sizes are summed by time slice, so only the slices' totals are ranked in one task; objects are ranked within their slice.
    """
    live = objs.where("refcount > 0").withColumn("_slice", F.floor(F.unix_timestamp(F.col("last_accessed").cast("timestamp")) / slice_seconds))
    w = Window.partitionBy("_slice").orderBy("last_accessed", "object_id").rowsBetween(Window.unboundedPreceding, -1)
    within = live.withColumn("_before", F.coalesce(F.sum("size_bytes").over(w), F.lit(0)))
    sizes = live.groupBy("_slice").agg(F.sum("size_bytes").alias("_size"))
    base = sizes.select("_slice", F.coalesce(F.sum("_size").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    total = objs.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("_total"))  # one row
    out = within.join(base, "_slice").crossJoin(F.broadcast(total))
    return out.where(F.col("_total") - F.col("_base") - F.col("_before") > target_bytes).drop("_slice", "_before", "_base", "_total")


def eviction_target(max_bytes: int, ratio: float = 0.8) -> int:
    return int(max_bytes * ratio)


def cascade(refs: DataFrame, objs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and objects without those that go: no key is left without its object."""
    ids = gone.select("object_id").distinct()
    return refs.join(ids, "object_id", "left_anti"), objs.join(ids, "object_id", "left_anti")
