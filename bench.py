"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]: median seconds after a warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pathquery.operators import build, changes as C, search as S  # noqa: E402
from pathquery.sources import adapters as A  # noqa: E402

#: Searches over the flat catalogue: extension, rare word, common word, both, and a sorted page.
CASES = {"ext": "ext:pdf count:500", "rare_word": "item_59_ count:500", "common_word": "item count:500", "ext_and_word": "ext:txt 77 count:500", "sort_size_top100": "item sort:size:desc count:100", "substring_top20": "_1 count:20"}
RUNS = 5
#: Entries of the generated catalogue that is as large as the one the published figures are for.
ENTRIES = 8_500_000


def noise(spark: SparkSession, n: int):
    i, zero = F.col("id"), F.lit(0).cast("long")
    name = F.concat(F.when(i % 5000 == 0, "rare_marker_doc_").otherwise("noise_"), F.lpad(i.cast("string"), 8, "0"), F.lit(".txt"))
    raw = spark.range(n).select(F.lit("C").alias("volume"), (i + 10000).alias("file_id"), zero.alias("parent_id"), name.alias("name"), (i % 4096).alias("size"), i.alias("mtime_ft"), zero.alias("ctime_ft"), F.lit(0).alias("attrs"), F.lit(False).alias("is_dir"), F.lit("").alias("parent_path_lc"), F.lit(0).alias("children"))
    return raw.withColumn("entry_id", F.col("file_id"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}

    def timed(name: str, f, runs: int = RUNS) -> None:
        f()
        seconds = []
        for _ in range(runs):
            t = time.perf_counter()
            f()
            seconds.append(time.perf_counter() - t)
        out[name] = round(statistics.median(seconds), 4)

    def build_bulk() -> None:
        """All line items: names, extensions, paths and times, written as a table and counted."""
        A._kept.clear()
        A.bulk(spark, sf).count()

    timed("build_bulk", build_bulk, 1)
    bulk = A.bulk(spark, sf).cache()
    bulk.count()
    timed("build_tree", lambda: build.catalogue(A.tree_raw(spark, sf)).write.format("noop").mode("overwrite").save(), 1)
    at = build.fresh_path(spark, "bench")
    build.save(bulk, at)
    timed("load", lambda: build.load(spark, at)[0].agg({"size": "sum", "name_lc": "max"}).collect())
    events = A.changes(spark, sf).orderBy("usn").limit(10_000).cache()  # one batch
    state = A.tree(spark, sf).select("volume", "file_id", "parent_id", "name", "size", "mtime", "ctime", "attrs", "is_dir", "deleted").cache()
    state.count(), events.count()
    timed("changes_10k", lambda: C.apply_changes(state.join(events.select("volume", "file_id").distinct(), ["volume", "file_id"], "left_semi"), C.fresh(events)).write.format("noop").mode("overwrite").save())
    for name, text in CASES.items():
        timed(name, lambda text=text: S.search(bulk, text).select("entry_id", "name", "size").collect())
    timed("total", lambda: S.total(bulk, "ext:pdf"))
    bulk.unpersist()
    wide = build.columns(noise(spark, ENTRIES)).select("entry_id", "name", "name_lc", "display_path", "size", "mtime", "is_dir", "deleted", "ext_lc").cache()
    wide.count()
    for name, text in {"rare_word": "rare_marker count:500", "common_word": "noise count:500", "one_letter": "n count:500"}.items():
        timed(f"{name}_8.5m", lambda text=text: S.search(wide, text).select("entry_id", "name", "size").collect())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
