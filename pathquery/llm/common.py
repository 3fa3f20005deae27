"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python code in slices of about this many bytes, whatever Arrow's batches hold.
SLICE_BYTES = 2_000_000
#: The planner's sizes from here on are no estimates, but stand for unknown ones.
UNKNOWN_BYTES = 1 << 55


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; the id null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode (tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints/pathquery"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage is cut and a lost executor loses nothing."""
    spark, out = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


_spread = np.random.Generator(np.random.PCG64(3)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse, n or more of each."""
    if not _powers or len(_powers[0]) < n:
        base, size = 0x9E3779B97F4A7C15, max(n, 1 << 21)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 2**64))]
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def run_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run values[begin:end], by sums of powers."""
    power, inverse = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)])])
    return mixed((total[end] - total[begin]) * inverse[begin])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (between spaces) of all texts, the upper bits the better ones, and each text's number of words."""
    a = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = a == 32
    change = np.flatnonzero(space[1:] != space[:-1]) + 1  # a starts and ends with a space
    begin, end = change[::2], change[1::2]
    edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return run_hashes(_spread[a], begin, end), np.diff(np.searchsorted(begin, edges))


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def map_slices(df: DataFrame, cols: list, text_col: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices: make() builds, once a task, the function from a slice to its columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        f = make()
        for batch in batches:
            for part in slices(batch, text_col, limit):
                yield pa.RecordBatch.from_pydict(f(part), schema=kinds)

    return df.select(*cols).mapInArrow(run, schema)


def block_count(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """How many blocks of about `bytes_each` bytes the planner sees in df's files; spark.sql.shuffle.partitions where it can't tell (rows that aren't from files)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(1 << 20, -(-size // bytes_each)))


class LongMap:
    """Distinct longs (never -1) to values: open addressing in numpy, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, vals: np.ndarray, missing):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask, self.missing, self.probes = np.uint64(64 - bits), (1 << bits) - 1, missing, 0
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, vals.dtype)
        k, v = keys.astype(np.int64), vals
        slot = self._slot(k)
        while len(k):
            at = (slot + self.probes) & self.mask
            free = self.keys[at] == -1
            self.keys[at[free]] = k[free]
            placed = self.keys[at] == k
            self.vals[at[placed]] = v[placed]
            k, v, slot = k[~placed], v[~placed], slot[~placed]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.vals[slot], self.missing)
        todo = np.flatnonzero((there != keys) & (there != -1))
        k, slot = keys[todo], slot[todo]
        for probe in range(1, self.probes):
            if not len(todo):
                break
            at = (slot + probe) & self.mask
            there = self.keys[at]
            hit = there == k
            out[todo[hit]] = self.vals[at[hit]]
            rest = ~hit & (there != -1)
            todo, k, slot = todo[rest], k[rest], slot[rest]
        return out
