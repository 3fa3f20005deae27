"""Metadata that arrive late: which files lack them, filling from a first and a fallback source, and the overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["volume", "file_id"]
#: The record number of a 64-bit id.
RECORD = (1 << 48) - 1


def pending(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("is_dir") & ~F.col("deleted") & (F.col("size") == 0))


def pending_parents(entries: DataFrame) -> DataFrame:
    """Directories that hold a pending file."""
    return entries.filter("is_dir").join(pending(entries).select("volume", F.col("parent_id").alias("file_id")), KEY, "left_semi")


def backfill(entries: DataFrame, first: DataFrame, fallback: DataFrame) -> DataFrame:
    """Overlay rows (volume, file_id, size, mtime, ctime) of pending files: from `first`, and what it lacks from `fallback`."""
    want = pending(entries).select(*KEY)
    hit = want.join(first.dropDuplicates(KEY), KEY)
    rest = want.join(first.select(*KEY), KEY, "left_anti").join(fallback.dropDuplicates(KEY), KEY)
    return hit.select(*KEY, "size", "mtime", "ctime").unionByName(rest.select(*KEY, "size", "mtime", "ctime"))


def remainder(entries: DataFrame, overlay: DataFrame) -> DataFrame:
    return pending(entries).join(overlay.select(*KEY), KEY, "left_anti")


def with_overlay(entries: DataFrame, overlay: DataFrame) -> DataFrame:
    o = overlay.select(*KEY, *(F.col(c).alias(f"_{c}") for c in ("size", "mtime", "ctime")))
    return entries.join(o, KEY, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("size", "mtime", "ctime") else F.col(c) for c in entries.columns))


def join_by_record(raw: DataFrame, metadata: DataFrame) -> DataFrame:
    """Raw records with metadata by record number (the id without its sequence)."""
    m = metadata.select("volume", F.col("file_id").bitwiseAND(F.lit(RECORD)).alias("record"), *(F.col(c).alias(f"_{c}") for c in ("size", "mtime_ft", "ctime_ft"))).dropDuplicates(["volume", "record"])
    out = raw.withColumn("record", F.col("file_id").bitwiseAND(F.lit(RECORD))).join(m, ["volume", "record"], "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("size", "mtime_ft", "ctime_ft") else F.col(c) for c in raw.columns))
