"""Keeping a catalogue fresh from a stream of changes.

State (one row for each key, with parents by id, not by path) is a base table and deltas of touched rows, the latest of a
key counts; each micro-batch adds a delta and every COMPACT batches they become a new base.  A version file names the
folders that hold at a time, so that readers see whole batches only and a batch that is replayed changes nothing.

refresh() derives the searchable snapshot: paths follow from the parents as they are now, so that directories may be
created in any order and moved; what lies in deleted or excluded directories is marked as deleted.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalise_directory, unix_to_filetime
from ..operators import build, changes as C

KEY = ["volume", "file_id"]
SCHEMA = "volume string, file_id long, parent_id long, name string, size long, mtime long, ctime long, attrs int, is_dir boolean, deleted boolean"
STATE = [x.split()[0] for x in SCHEMA.split(", ")]
VOLUMES = "volume string, journal_id long, last_usn long"


class Catalogue:
    """The state of volumes and their last usn, under `path`; the searchable snapshot is under `path`/search."""

    #: Deltas that are read beside the base, at most; and versions that are kept for their readers.
    COMPACT, KEEP = 10, 3

    def __init__(self, path: str, excluded: list[str] = ()):
        self.path, self.excluded = path, sorted(p for p in map(normalise_directory, excluded) if p)

    def _publish(self, spark: SparkSession, base: str, deltas: list[str], volumes: str) -> None:
        build.publish(spark, self.path, {"folders": [base, *deltas, volumes], "base": base, "deltas": deltas, "volumes": volumes})
        build.retire(spark, self.path, self.KEEP)

    def _written(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def write(self, state: DataFrame, volumes: DataFrame) -> None:
        """A new base, for example after a scan."""
        self._publish(state.sparkSession, self._written(state.select(STATE), "base"), [], self._written(volumes, "volumes"))

    def read(self, spark: SparkSession, now: dict | None = None) -> tuple[DataFrame, DataFrame]:
        now = now or build.version(spark, self.path)
        base = spark.read.schema(SCHEMA).parquet(f"{self.path}/{now['base']}")
        volumes = spark.read.schema(VOLUMES).parquet(f"{self.path}/{now['volumes']}")
        if not now["deltas"]:
            return base, volumes
        parts = [spark.read.schema(SCHEMA).parquet(f"{self.path}/{d}").withColumn("_at", F.lit(i)) for i, d in enumerate(now["deltas"])]
        newest = build.keep_last(reduce(DataFrame.unionByName, parts), "_at").drop("_at")
        return C.merged(base, newest), volumes

    def apply(self, batch: DataFrame, _id: int = 0) -> None:
        """Replaying a batch changes nothing: its events are not after the last usn."""
        spark = batch.sparkSession
        now = build.version(spark, self.path)
        state, volumes = self.read(spark, now)
        C.check_journal(volumes, batch)
        new = build.stored(C.fresh(batch, volumes), "events")
        last = new.groupBy("volume").agg(F.max("usn").alias("_last"))
        volumes = volumes.join(last, "volume", "left").select("volume", "journal_id", F.coalesce("_last", "last_usn").alias("last_usn"))
        if self.excluded and build.versions(spark, f"{self.path}/search"):
            known, _ = build.load(spark, f"{self.path}/search")
            new = C.under_exclusions(new, self.excluded, known.filter("is_dir").select("volume", F.col("file_id").alias("parent_id"), F.col("full_path_lc").alias("parent_full_lc")))
        # rows of other keys can't matter
        mine = state.join(new.select(*KEY).distinct(), KEY, "left_semi")
        delta, kept = self._written(C.apply_changes(mine, new).select(STATE), "delta"), self._written(volumes, "volumes")
        deltas = [*now["deltas"], delta]
        self._publish(spark, now["base"], deltas, kept)
        if len(deltas) >= self.COMPACT:
            state, _ = self.read(spark)
            self._publish(spark, self._written(state, "base"), [], kept)

    def entries(self, spark: SparkSession) -> DataFrame:
        """The catalogue of the state as it is; a directory counts its living children."""
        state, _ = self.read(spark)
        gone = F.coalesce("deleted", F.lit(False))
        raw = build.stored(state.select(*KEY, "parent_id", "name", "size", unix_to_filetime(F.col("mtime")).alias("mtime_ft"), unix_to_filetime(F.col("ctime")).alias("ctime_ft"), F.lit(0).alias("attrs"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), gone.alias("gone"), F.coalesce("attrs", F.lit(0)).alias("packed")), "state")
        living = raw.filter("not gone").groupBy("volume", F.col("parent_id").alias("file_id")).agg(F.count(F.lit(1)).alias("living"))
        own = raw.select(*KEY, "gone", "packed").join(living, KEY, "left")
        e = build.catalogue(raw.drop("gone", "packed")).join(own, KEY)
        e = e.withColumns({"child_count": F.when(F.col("is_dir"), F.coalesce("living", F.lit(0))), "attrs": F.col("packed").bitwiseOR(F.col("attrs")), "deleted": F.col("gone")}).drop("gone", "packed", "living")
        return C.cascade(build.stored(build.exclude(e, self.excluded), "entries"))

    def refresh(self, spark: SparkSession) -> str:
        """Derives the searchable snapshot; Engine.load reads it from the path that is returned."""
        at = f"{self.path}/search"
        build.save(self.entries(spark), at, self.excluded)
        build.retire(spark, at, self.KEEP)
        return at

    def follow(self, stream: DataFrame, checkpoint: str, interval: str | None = None, refresh_every: int = 0) -> StreamingQuery:
        """Applies a stream's micro-batches, and derives the searchable snapshot after every `refresh_every` of them."""

        def each(batch: DataFrame, number: int) -> None:
            self.apply(batch, number)
            if refresh_every and (number + 1) % refresh_every == 0:
                self.refresh(batch.sparkSession)

        w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()
