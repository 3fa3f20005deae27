"""Groups of files with equal content: by size, then a quick signature, then a full hash; each stage only sees what the one before left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .build import stored

EDGE = 64 << 10


def duplicate_groups(entries: DataFrame, contents: DataFrame, min_size: int = 1 << 20, max_groups: int = 1000, files_per_group: int = 400) -> DataFrame:
    """(group_id, size, file_count, total_bytes, reclaimable, files), most reclaimable first.

    max_groups and files_per_group bound the report (files are the first by id), not the search.
    """
    files = entries.filter(~F.col("is_dir") & ~F.col("deleted") & (F.col("size") >= min_size)).select("entry_id", "volume", "file_id", "size")
    repeat = lambda df, *k: df.join(df.groupBy(*k).count().filter("count > 1").drop("count"), list(k), "left_semi")
    sized = repeat(files, "size").join(contents, ["volume", "file_id"])
    data = F.col("content").cast("binary")
    quick = stored(sized.select("entry_id", "volume", "file_id", "size", F.xxhash64(F.substring(data, 1, EDGE), F.substring(data, -EDGE, EDGE)).alias("quick")), "quick")
    full = stored(repeat(quick, "size", "quick").join(contents, ["volume", "file_id"]).select("entry_id", "size", F.sha2(data, 256).alias("group_id")), "full")
    sums = full.groupBy("size", "group_id").agg(F.count(F.lit(1)).alias("file_count")).filter("file_count > 1")
    sums = sums.withColumns({"total_bytes": F.col("size") * F.col("file_count"), "reclaimable": F.col("size") * (F.col("file_count") - 1)})
    top = sums.orderBy(F.desc("reclaimable"), F.desc("file_count"), "group_id").limit(max_groups)
    from pyspark.sql import Window

    members = full.join(top.select("size", "group_id"), ["size", "group_id"]).withColumn("rn", F.row_number().over(Window.partitionBy("group_id").orderBy("entry_id"))).filter(F.col("rn") <= files_per_group)
    lists = members.groupBy("group_id").agg(F.array_sort(F.collect_list("entry_id")).alias("files"))
    return top.join(lists, "group_id").orderBy(F.desc("reclaimable"), F.desc("file_count"), "group_id")
