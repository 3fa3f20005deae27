"""Benchmark tables as catalogues: a directory tree of regions, nations and customers with an order as each file; documents; line items; events as changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EPOCH
from ..operators import build
from ..plans.literals import GROUPS

#: All extensions of the extension groups, and one of none.
TYPED = [*(x for g in GROUPS.values() for x in g.split()), "other"]
_kept: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filetime(seconds):
    return ((seconds + F.lit(EPOCH)) * F.lit(10_000_000)).cast("long")


def tree_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    volume = lambda k: F.when(k % 2 == 0, "C").otherwise("D")
    folder = [F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ft"), F.lit(0).cast("long").alias("ctime_ft"), F.lit(0x10).alias("attrs"), F.lit(True).alias("is_dir")]
    rn = n.select("n_nationkey", "n_name", "n_regionkey")
    rc = c.join(rn.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey").select("c_custkey", "c_name", "c_nationkey", "n_regionkey")
    regions = r.select(volume(F.col("r_regionkey")).alias("volume"), (F.col("r_regionkey") + 1000).cast("long").alias("file_id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"), *folder)
    nations = rn.select(volume(F.col("n_regionkey")).alias("volume"), (F.col("n_nationkey") + 10000).cast("long").alias("file_id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name"), *folder)
    customers = rc.select(volume(F.col("n_regionkey")).alias("volume"), (F.col("c_custkey") + 1000000).alias("file_id"), (F.col("c_nationkey") + 10000).cast("long").alias("parent_id"), F.col("c_name").alias("name"), *folder)
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("pdf", "PDF", "txt", "md", "jpg", "mp3")))
    name = F.concat(F.lit("Order_"), k.cast("string"), F.when(k % 7 < 6, F.concat(F.lit("."), F.try_element_at(kinds, (k % 7 + 1).cast("int")))).otherwise(F.lit("")))
    m = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    attrs = F.when(k % 2 == 1, 1).otherwise(0) + F.when(k % 32 >= 16, 0x20).otherwise(0) + F.when(k % 4 >= 2, 2).otherwise(0)
    files = o.join(rc, o["o_custkey"] == rc["c_custkey"]).select(volume(F.col("n_regionkey")).alias("volume"), (k + 1000000000).alias("file_id"), (F.col("o_custkey") + 1000000).alias("parent_id"), name.alias("name"), F.floor("o_totalprice").cast("long").alias("size"), filetime(m).alias("mtime_ft"), filetime(m - (k % 30) * 86400).alias("ctime_ft"), attrs.cast("int").alias("attrs"), F.lit(False).alias("is_dir"))
    return regions.unionByName(nations).unionByName(customers).unionByName(files)


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A catalogue is built once for each application and input, and then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = build.stored(make(), name)
    return _kept[key]


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "tree", lambda: build.catalogue(tree_raw(spark, sf_dir)).withColumn("entry_id", F.col("file_id")))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files of every extension group and of sizes up to some GB; nations as directories, five of them without files."""
    n, li = table(spark, sf_dir, "nation"), table(spark, sf_dir, "lineitem")
    zero, k = F.lit(0).cast("long"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    exts = F.array(*map(F.lit, TYPED))
    name = F.concat(F.lit("File_"), k.cast("string"), F.lit("."), F.get(exts, (k % len(TYPED)).cast("int")))
    size = F.when(k % 11 == 0, 0).otherwise(F.floor("l_extendedprice") * F.element_at(F.array(*(F.lit(1 << 4 * i) for i in range(5))), (k % 5 + 1).cast("int"))).cast("long")
    folders = n.select(F.lit("T").alias("volume"), (F.col("n_nationkey") + 100).cast("long").alias("file_id"), zero.alias("parent_id"), F.col("n_name").alias("name"), zero.alias("size"), zero.alias("mtime_ft"), zero.alias("ctime_ft"), F.lit(0x10).alias("attrs"), F.lit(True).alias("is_dir"))
    files = li.select(F.lit("T").alias("volume"), (k + 1000).alias("file_id"), (k % 20 + 100).alias("parent_id"), name.alias("name"), size.alias("size"), zero.alias("mtime_ft"), zero.alias("ctime_ft"), F.lit(0).alias("attrs"), F.lit(False).alias("is_dir"))
    return kept(spark, sf_dir, "typed", lambda: build.catalogue(folders.unionByName(files)).withColumn("entry_id", F.col("file_id")))


def docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and contents of documents."""
    d = table(spark, sf_dir, "documents")
    e = d.select(F.lit("E").alias("volume"), F.col("doc_id").alias("file_id"), F.lit(0).cast("long").alias("parent_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("n_chars", F.lit(0)).alias("size"), F.lit(0).cast("long").alias("mtime_ft"), F.lit(0).cast("long").alias("ctime_ft"), F.lit(0).alias("attrs"), F.lit(False).alias("is_dir"), F.concat(F.lit("\\docs\\"), F.col("lang"), F.lit("\\"), F.col("source")).alias("parent_path_lc"), F.lit(0).alias("children"))
    return build.columns(e).withColumn("entry_id", F.col("file_id")), d.select(F.lit("E").alias("volume"), F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat catalogue of line items."""
    li = table(spark, sf_dir, "lineitem")
    ext = F.when(F.col("l_returnflag") == "R", "pdf").when(F.col("l_linestatus") == "O", "txt").otherwise("jpg")
    e = li.select(F.lit("F").alias("volume"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), F.lit(0).cast("long").alias("parent_id"), F.concat(F.lit("Item_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit("."), ext).alias("name"), F.floor("l_extendedprice").cast("long").alias("size"), filetime(F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("mtime_ft"), F.lit(0).cast("long").alias("ctime_ft"), F.lit(0).alias("attrs"), F.lit(False).alias("is_dir"), F.lit("\\items").alias("parent_path_lc"), F.lit(0).alias("children"))
    return kept(spark, sf_dir, "bulk", lambda: build.columns(e).withColumn("entry_id", F.col("file_id")))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    op = F.when(t == "signup", "create").when(t == "error", "delete").when(t == "view", "rename").otherwise("modify")
    null = lambda kind: F.lit(None).cast(kind)
    return ev.select(F.lit("C").alias("volume"), F.col("event_id").alias("usn"), F.lit(1).cast("long").alias("journal_id"), F.col("user_id").alias("file_id"), op.alias("op"), F.when(t.isin("signup", "view"), F.col("user_id") % 7).alias("parent_id"), F.when(t.isin("signup", "view"), F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("name"), F.when(t.isin("signup", "purchase"), F.floor(F.col("value") * 100).cast("long")).alias("size"), F.when(t.isin("signup", "click"), F.col("event_id") + 5).alias("mtime"), F.when(t == "signup", F.col("event_id")).alias("ctime"), F.when(t == "signup", F.lit(0)).otherwise(null("int")).alias("attrs"), F.when(t == "signup", F.lit(False)).otherwise(null("boolean")).alias("is_dir"))
