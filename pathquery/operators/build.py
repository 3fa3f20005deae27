"""Building the catalogue (one row for each file or directory) from raw scan records.

Paths are resolved by pointer doubling: after k rounds a directory knows the path of 2^k ancestors, so that a tree of
any size takes as many joins as the logarithm of its depth.  Everything is keyed by (volume, file_id).
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import CatalogError
from ..functions import text as T

RAW = "volume string, file_id long, parent_id long, name string, size long, mtime_ft long, ctime_ft long, attrs int, is_dir boolean"
ROUNDS = 14  # directories up to 2^14 levels deep
KEY = ["volume", "file_id"]


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise CatalogError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/checkpoints/pathquery"
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    out = fresh_path(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def keep_last(raw: DataFrame, order: str) -> DataFrame:
    """Of records with one key, that with the greatest `order`."""
    w = Window.partitionBy(*KEY).orderBy(F.col(order).desc())
    return raw.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_volume_root(raw: DataFrame, volume: str, root_id: int) -> DataFrame:
    """Adds the nameless root directory of a volume if the scan lacks it."""
    spark = raw.sparkSession
    root = spark.createDataFrame([(volume, root_id, 0, "", 0, 0, 0, 0x10, True)], RAW)
    return raw.unionByName(root.join(raw.select(*KEY), KEY, "left_anti"), allowMissingColumns=True)


def directory_paths(raw: DataFrame) -> DataFrame:
    """(volume, file_id, path_lc) of every directory; a root is one without a known parent directory.

    A chain that never ends (a cycle) raises CatalogError.
    """
    dirs = raw.filter("is_dir").select("volume", "file_id", "parent_id", F.when(F.col("name") == "", F.lit("")).otherwise(F.concat(F.lit("\\"), T.ascii_lower(F.col("name")))).alias("path"))
    ids = dirs.select("volume", F.col("file_id").alias("parent_id"), F.lit(True).alias("known"))
    at = dirs.join(ids, ["volume", "parent_id"], "left").select("volume", "file_id", F.when(F.col("known") & (F.col("parent_id") != F.col("file_id")), F.col("parent_id")).alias("up"), "path")
    for _ in range(ROUNDS):
        at = stored(at, "paths")
        if at.filter("up is not null").limit(1).count() == 0:
            return at.select("volume", "file_id", F.col("path").alias("path_lc"))
        above = at.select("volume", F.col("file_id").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        at = at.join(above, ["volume", "up"], "left").select("volume", "file_id", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.lit("")), F.col("path")).alias("path"))
    raise CatalogError("the directory tree has a cycle or is too deep")


def orphans(raw: DataFrame) -> DataFrame:
    """Records below a directory that the scan lacks; catalogue() hangs them below their volume's root."""
    known = raw.filter("is_dir").select("volume", F.col("file_id").alias("parent_id"))
    return raw.filter("parent_id <> 0").join(known, ["volume", "parent_id"], "left_anti").select(raw.columns)


def catalogue(raw: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Entries of raw records: paths, folded names, extension, depth, child counts, and `deleted` for what lies in excluded directories.

    Records whose parent is unknown hang below their volume's root.
    """
    paths = stored(directory_paths(raw), "directories")
    parents = paths.select("volume", F.col("file_id").alias("parent_id"), F.col("path_lc").alias("parent_path_lc"))
    children = raw.filter(F.col("file_id") != F.col("parent_id")).groupBy("volume", F.col("parent_id").alias("file_id")).agg(F.count(F.lit(1)).alias("children"))
    e = raw.join(parents, ["volume", "parent_id"], "left").join(children, KEY, "left")
    return columns(e, excluded)


def columns(e: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """The derived columns, from parent_path_lc and children."""
    e = e.withColumn("parent_path_lc", F.coalesce("parent_path_lc", F.lit(""))).withColumn("name_lc", T.ascii_lower(F.col("name")))
    full = F.concat(T.ascii_lower(F.col("volume")), F.lit(":"), F.col("parent_path_lc"), F.lit("\\"), F.col("name_lc"))
    out = e.select(
        F.xxhash64(*KEY).alias("entry_id") if "entry_id" not in e.columns else F.col("entry_id"),
        "volume", "file_id", "parent_id", "name", "is_dir",
        F.when(F.col("is_dir"), F.lit(0)).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("size"),
        T.filetime_to_unix(F.col("mtime_ft")).alias("mtime"), T.filetime_to_unix(F.col("ctime_ft")).alias("ctime"),
        T.packed_attributes(F.col("attrs")).bitwiseOR(F.when(F.col("is_dir"), F.lit(T.DIR)).otherwise(F.lit(0))).alias("attrs"),
        "name_lc", T.extension(F.col("name")).alias("ext_lc"), F.char_length("name").cast("int").alias("name_len"),
        "parent_path_lc", full.alias("full_path_lc"),
        F.concat("volume", F.lit(":"), F.col("parent_path_lc"), F.lit("\\"), F.when(F.col("is_dir"), F.col("name_lc")).otherwise(F.col("name"))).alias("display_path"),
        T.depth(F.col("parent_path_lc")).alias("depth"), F.when(F.col("is_dir"), F.coalesce("children", F.lit(0))).cast("long").alias("child_count"),
    )
    return out.withColumn("deleted", in_directories(F.col("full_path_lc"), excluded))


def in_directories(full_path: Column, excluded) -> Column:
    """Whether a lower-case path is one of the directories or below one."""
    ex = [p for p in map(T.normalise_directory, excluded) if p]
    return reduce(lambda a, p: a | (full_path == p) | full_path.startswith(p + "\\"), ex, F.lit(False))


def exclude(entries: DataFrame, excluded: list[str]) -> DataFrame:
    return entries.withColumn("deleted", F.col("deleted") | in_directories(F.col("full_path_lc"), excluded))


def merge_volumes(*catalogues: DataFrame) -> DataFrame:
    """Catalogues of several volumes as one; a key that occurs again is kept from the last."""
    tagged = [c.withColumn("_at", F.lit(i)) for i, c in enumerate(catalogues)]
    return keep_last(reduce(DataFrame.unionByName, tagged), "_at").drop("_at")


def publish(spark: SparkSession, path: str, record: dict) -> int:
    """A new version of what lies under `path`: a file that appears whole, by a rename, under the next number."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    number = max(versions(spark, path), default=0) + 1
    while not (name := jvm.org.apache.hadoop.fs.Path(folder, f"v{number:012d}")) or fs.exists(name) or not fs.rename(draft, name):
        number += 1  # another writer was first
    return number


def versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{12}", n))


def version(spark: SparkSession, path: str, number: int | None = None) -> dict:
    """The record of a version, the last one if not given."""
    number = number or max(versions(spark, path), default=0)
    if not number:
        raise CatalogError(f"nothing has been saved under {path}")
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/v{number:012d}")
    fs = file.getFileSystem(spark._jsc.hadoopConfiguration())
    data = fs.open(file)
    try:
        return json.loads(bytes(data.readAllBytes()).decode())
    finally:
        data.close()


def retire(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Deletes versions but the last `keep`, and the folders that only these name."""
    numbers = versions(spark, path)
    held = {x for n in numbers[-keep:] for x in version(spark, path, n)["folders"]}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in numbers[:-keep]:
        for x in set(version(spark, path, n)["folders"]) - held:
            fs.delete(hadoop(f"{path}/{x}"), True)
        fs.delete(hadoop(f"{path}/versions/v{n:012d}"), False)


def save(entries: DataFrame, path: str, excluded: list[str] = (), compression: str = "zstd") -> str:
    """A new snapshot under `path`, clustered for pruning, then a version that names it; readers see whole versions only."""
    spark, name = entries.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    entries.sortWithinPartitions("volume", "ext_lc").write.option("compression", compression).partitionBy("volume").parquet(f"{path}/{name}")
    publish(spark, path, {"folders": [name], "excluded_dirs": sorted(p for p in map(T.normalise_directory, excluded) if p)})
    return name


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The current snapshot and its excluded directories."""
    now = version(spark, path)
    at = f"{path}/{now['folders'][0]}"
    return spark.read.option("basePath", at).parquet(at), now["excluded_dirs"]


def status(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_dir").alias("directories"), F.count_if("deleted").alias("deleted"))


def deleted_share(entries: DataFrame) -> DataFrame:
    """The part of all entries that are marked as deleted; a snapshot with many is worth writing anew.  Null without entries."""
    return entries.agg(F.avg(F.col("deleted").cast("int")).alias("deleted_share"))
