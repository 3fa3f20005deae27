"""Scan sources: a directory tree of any store that Spark reads, and file contents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import EPOCH

RAW = "volume string, file_id long, parent_id long, name string, size long, mtime_ft long, ctime_ft long, attrs int, is_dir boolean"


class _Walk(DataSourceReader):
    def __init__(self, options):
        self.root, self.volume = options["path"], options.get("volume", "C")

    def partitions(self):
        """The root's own records, and one part for each of its directories."""
        with os.scandir(self.root) as it:
            tops = sorted(d.path for d in it if d.is_dir(follow_symlinks=False))
        return [InputPartition(("", self.root)), *(InputPartition((d, d)) for d in tops)]

    def read(self, partition):
        below, top = partition.value
        todo = [top]
        while todo:
            at = todo.pop()
            parent = 0 if at == self.root else os.stat(at).st_ino
            with os.scandir(at) as it:
                for d in it:
                    s, folder = d.stat(follow_symlinks=False), d.is_dir(follow_symlinks=False)
                    ft = [int((t + EPOCH) * 10_000_000) for t in (s.st_mtime, s.st_ctime)]
                    yield self.volume, s.st_ino, parent, d.name, 0 if folder else s.st_size, *ft, 0x10 if folder else 0, folder
                    if folder and below:
                        todo.append(d.path)


class TreeSource(DataSource):
    """spark.read.format("filetree").option("volume", "C").load(folder): raw records of a mounted folder that all executors see."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return RAW

    def reader(self, schema):
        return _Walk(self.options)


def scan(spark: SparkSession, path: str, volume: str = "C") -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("filetree").option("volume", volume).load(path)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, content) of the files below a path of any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), "content")
