"""Indexing several volumes at once, with a progress file, and what a fast scan lacks."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import CatalogError
from . import build

#: Fixed value: the attribute bit of directories that stand for other places (links, cloud placeholders).
REPARSE = 0x400


def volume_list(volume: str | None = None, volumes: list[str] | None = None, found: list[str] = ()) -> list[str]:
    """The volumes to index: `volumes`, or `volume`, or those found on the machine, or C:."""
    if volumes is not None:
        return list(volumes) or [volume or "C:"]
    return [volume] if volume else sorted(found) or ["C:"]


class Progress:
    """A small JSON file that tells where the build is; it goes when the build is done."""

    def __init__(self, spark: SparkSession, path: str, total: int):
        self.spark, self.total, self.done, self.entries = spark, total, 0, 0
        self.file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/indexing.json")
        self.fs = self.file.getFileSystem(spark._jsc.hadoopConfiguration())
        self.lock = threading.Lock()

    def tell(self, phase: str, **more) -> None:
        state = {"phase": phase, "volumes_total": self.total, "volumes_completed": self.done, "entries_indexed": self.entries}
        out = self.fs.create(self.file, True)
        out.write(bytearray(json.dumps(state | more).encode()))
        out.close()

    def scanned(self, volume: str, entries: int) -> None:
        with self.lock:
            self.done, self.entries = self.done + 1, self.entries + entries
            self.tell("scanning", current_volume=volume)

    def finish(self) -> None:
        self.fs.delete(self.file, False)


def index_volumes(spark: SparkSession, read: Callable[[str], DataFrame], volumes: list[str], path: str, excluded: list[str] = (), threads: int = 4) -> str:
    """Saves the catalogue of all volumes under `path`.  read: raw records of a volume, at most `threads` volumes at a time.

    Any volume that fails ends the build, and what was saved under `path` before stays current; the progress file tells of it.
    """
    progress = Progress(spark, path, len(volumes))
    progress.tell("starting")

    def scan(volume: str) -> DataFrame:
        seen = Observation()
        try:
            raw = build.stored(read(volume).observe(seen, F.count(F.lit(1)).alias("n")), "scan")
        except Exception as e:
            raise CatalogError(f"volume {volume} can't be scanned: {e}") from e
        progress.scanned(volume, seen.get["n"])
        return raw

    try:
        with ThreadPoolExecutor(max(1, min(threads, len(volumes)))) as pool:
            parts = list(pool.map(scan, volumes))
    except CatalogError as e:
        progress.tell("failed", message=str(e))
        raise
    progress.tell("merging")
    tagged = [p.withColumn("_at", F.lit(i)) for i, p in enumerate(parts)]
    raw = build.keep_last(reduce(DataFrame.unionByName, tagged), "_at").drop("_at") if len(parts) > 1 else parts[0]
    entries = build.catalogue(raw, excluded)
    progress.tell("writing")
    name = build.save(entries, path, excluded)
    progress.finish()
    return name


def reparse_directories(raw: DataFrame) -> DataFrame:
    """Directories whose contents a scan of the file table may lack."""
    return raw.filter(F.col("is_dir") & (F.col("attrs").bitwiseAND(F.lit(REPARSE)) != 0))


def supplemented(raw: DataFrame, walked: DataFrame) -> DataFrame:
    """raw and the records of a walk below reparse directories that it lacks, each once."""
    new = walked.dropDuplicates(build.KEY).join(raw.select(*build.KEY), build.KEY, "left_anti")
    return raw.unionByName(new.select(raw.columns))
