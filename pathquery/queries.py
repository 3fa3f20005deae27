"""The registered queries of the search engine, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from datetime import datetime, timezone

from .api import Engine
from .operators import backfill as B
from .operators import build, changes as C, duplicates as D, search as S, volumes as V
from .plans.literals import GROUPS
from .sources import adapters as A
from .streaming.apply import SCHEMA, STATE, VOLUMES, Catalogue

#: The tree catalogue in SQL; chr(92) is a backslash.
TREE = """
WITH d0 AS (
    SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'C' ELSE 'D' END AS volume, CAST(r_regionkey + 1000 AS BIGINT) AS file_id, CAST(0 AS BIGINT) AS parent_id, r_name AS name, '' AS pp FROM region
), d1 AS (
    SELECT d0.volume, CAST(n_nationkey + 10000 AS BIGINT) AS file_id, d0.file_id AS parent_id, n_name AS name, pp || chr(92) || {lc_d0} AS pp FROM nation JOIN d0 ON d0.file_id = n_regionkey + 1000
), d2 AS (
    SELECT d1.volume, CAST(c_custkey + 1000000 AS BIGINT) AS file_id, d1.file_id AS parent_id, c_name AS name, pp || chr(92) || {lc_d1} AS pp FROM customer JOIN d1 ON d1.file_id = c_nationkey + 10000
), f AS (
    SELECT d2.volume, CAST(o_orderkey + 1000000000 AS BIGINT) AS file_id, d2.file_id AS parent_id,
        'Order_' || CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' WHEN 4 THEN '.jpg' WHEN 5 THEN '.mp3' ELSE '' END AS name,
        pp || chr(92) || {lc_d2} AS pp, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(epoch(o_orderdate) AS BIGINT) AS mtime,
        CAST(epoch(o_orderdate) AS BIGINT) - (o_orderkey % 30) * 86400 AS ctime,
        CASE WHEN o_orderkey % 2 = 1 THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 32 >= 16 THEN 16 ELSE 0 END + CASE WHEN o_orderkey % 4 >= 2 THEN 2 ELSE 0 END AS attrs
    FROM orders JOIN d2 ON d2.file_id = o_custkey + 1000000
), u AS (
    SELECT volume, file_id, parent_id, name, pp, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime, CAST(0 AS BIGINT) AS ctime, 1 AS attrs, true AS is_dir FROM d0
    UNION ALL SELECT volume, file_id, parent_id, name, pp, 0, 0, 0, 1, true FROM d1
    UNION ALL SELECT volume, file_id, parent_id, name, pp, 0, 0, 0, 1, true FROM d2
    UNION ALL SELECT volume, file_id, parent_id, name, pp, size, mtime, ctime, attrs, false FROM f
), k AS (SELECT parent_id AS pid, count(*) AS n FROM u GROUP BY 1
), e AS (
    SELECT u.*, file_id AS entry_id, {lc_u} AS name_lc, nullif({lc_x}, '') AS ext_lc,
        lower(volume) || ':' || pp || chr(92) || {lc_u} AS full_lc,
        volume || ':' || pp || chr(92) || CASE WHEN is_dir THEN {lc_u} ELSE name END AS path,
        length(pp) - length(replace(pp, chr(92), '')) + 1 AS depth, CASE WHEN is_dir THEN coalesce(n, 0) END AS child_count
    FROM u LEFT JOIN k ON pid = file_id
)
""".format(**{k: f"translate({v}, '{T.UPPER}', '{T.LOWER}')" for k, v in {"lc_d0": "d0.name", "lc_d1": "d1.name", "lc_d2": "d2.name", "lc_u": "name", "lc_x": "regexp_extract(name, '[.]([^.]+)$', 1)"}.items()})
COLUMNS = ("entry_id", "name", "path", "size", "mtime")
BS = "' || chr(92) || '"


def sec(day: str) -> str:
    return f"CAST(epoch(TIMESTAMP '{day}') AS BIGINT)"


#: name: (query text, predicate in SQL[, order in SQL, limit, offset])
SEARCHES: dict[str, tuple] = {
    "q_name_substring": ("rder_12", "name_lc LIKE '%rder_12%' ESCAPE '~'"),
    "q_multi_term_and": ("order 77", "contains(name_lc, 'order') AND contains(name_lc, '77')"),
    "q_or_union": ("ext:md | customer#0000000", "ext_lc = 'md' OR contains(name_lc, 'customer#0000000')"),
    "q_not": ("order !1 !.pdf", "contains(name_lc, 'order') AND NOT contains(name_lc, '1') AND NOT contains(name_lc, '.pdf')"),
    "q_case_sensitive": ("case:1 .PDF", "contains(name, '.PDF')"),
    "q_only_files": ("file: 99", "NOT is_dir AND contains(name_lc, '99')"),
    "q_only_dirs": ("folder:", "is_dir"),
    "q_ext_list": ("ext:pdf;md", "ext_lc IN ('pdf', 'md')"),
    "q_size_gt": ("size:>200kb", "size >= 204800"),
    "q_size_lt": ("file: size:<=20kb", "NOT is_dir AND size <= 20480"),
    "q_size_range": ("size:100kb..150kb", "size BETWEEN 102400 AND 153600"),
    "q_dm_day": ("dm:1996-03-13", f"mtime BETWEEN {sec('1996-03-13')} AND {sec('1996-03-14')} - 1"),
    "q_dm_month": ("dm:1995-02", f"mtime BETWEEN {sec('1995-02-01')} AND {sec('1995-03-01')} - 1"),
    "q_dm_range": ("dm:1996-01-05..1996-03-09", f"mtime BETWEEN {sec('1996-01-05')} AND {sec('1996-03-10')} - 1"),
    "q_dm_gt": ("dm:>1998-01-01", f"mtime >= {sec('1998-01-01')}"),
    "q_dm_lt": ("file: dm:<1995-02-28", f"NOT is_dir AND mtime <= {sec('1995-03-01')} - 1"),
    "q_dc_range": ("dc:1995-03-01..1995-06-30", f"ctime BETWEEN {sec('1995-03-01')} AND {sec('1995-07-01')} - 1"),
    "q_attrib": ("attrib:rh", "attrs & 10 = 10"),
    "q_path": ("path:asia", "contains(full_lc, 'asia')"),
    "q_nopath": ("nopath:1 path:77", "contains(name_lc, '77')"),
    "q_nowfn": ("nowfn:1 path:88", "contains(name_lc, '88')"),
    "q_parent_exact": ("parent:d:\\america", f"volume = 'D' AND pp = '{BS}america'"),
    "q_parent_contains": ("parentcontains:europe", "contains(pp, 'europe')"),
    "q_drive": ("d: ext:txt", "volume = 'D' AND ext_lc = 'txt'"),
    "q_path_prefix": ("c:\\asia ext:md", f"volume = 'C' AND starts_with(full_lc, 'c:{BS}asia{BS}') AND ext_lc = 'md'"),
    "q_startwith": ("startwith:order_1", "starts_with(name_lc, 'order_1')"),
    "q_endwith": ("endwith:7.pdf", "suffix(name_lc, '7.pdf')"),
    "q_len_exact": ("len:11", "length(name) = 11"),
    "q_len_range": ("len:5..9", "length(name) BETWEEN 5 AND 9"),
    "q_wholeword": ("wholeword: east", "regexp_matches(name_lc, '(^|[^A-Za-z0-9_])east([^A-Za-z0-9_]|$)')"),
    "q_wfn": ("wfn: order_13", "name_lc = 'order_13'"),
    "q_regex": ("regex:^Order_[0-9]{2}\\.", "regexp_matches(name, '^Order_[0-9]{2}[.]')"),
    "q_glob_star": ("Order_1*.pdf", "regexp_matches(name, '^Order_1.*[.]pdf$')"),
    "q_glob_question": ("Order_9?.*", "regexp_matches(name, '^Order_9.[.].*$')"),
    "q_depth": ("depth:2..3", "depth BETWEEN 2 AND 3"),
    "q_child_exact": ("child:5", "is_dir AND child_count = 5"),
    "q_nonempty_dir": ("empty:0", "is_dir AND child_count > 0"),
    "q_sizedupe": ("sizedupe:", "NOT is_dir AND size IN (SELECT size FROM e WHERE NOT is_dir GROUP BY size HAVING count(*) > 1)"),
    "q_sizedupe_or": ("ext:mp3 sizedupe: | wfn: order_13", "(ext_lc = 'mp3' AND size IN (SELECT size FROM e WHERE ext_lc = 'mp3' GROUP BY size HAVING count(*) > 1)) OR name_lc = 'order_13'"),
    "q_sort_size_desc_topk": ("ext:pdf size:>100kb order sort:size:desc count:20", "ext_lc = 'pdf' AND size >= 102400 AND contains(name_lc, 'order')", "size DESC, entry_id", 20),
    "q_sort_path": ("ext:txt sort:path count:50", "ext_lc = 'txt'", "path, entry_id", 50),
    "q_sort_name_default": ("order_1 count:40", "contains(name_lc, 'order_1')", "name, entry_id", 40),
    "q_sort_mtime": ("order sort:modified:d count:30", "contains(name_lc, 'order')", "mtime DESC, entry_id", 30),
    "q_sort_ctime": ("ext:jpg sort:created count:30", "ext_lc = 'jpg'", "ctime, entry_id", 30),
    "q_offset_page": ("order sort:size count:25", "contains(name_lc, 'order')", "size, entry_id", 25, 50),
}

#: Line items as files of all groups and sizes, in SQL.
TYPED = f"""
WITH f AS (
    SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS k, l_extendedprice FROM lineitem
), e AS (
    SELECT k + 1000 AS entry_id, k % 20 + 100 AS parent_id, [{', '.join(f"'{x}'" for x in A.TYPED)}][k % {len(A.TYPED)} + 1] AS ext, false AS is_dir,
        CASE WHEN k % 11 = 0 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) * [1, 16, 256, 4096, 65536][k % 5 + 1] END AS size FROM f
    UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), 0, NULL, true, 0 FROM nation
)
"""
#: The same, over files of all groups and sizes.
TYPED_SEARCHES = {f"q_macro_{name}": (f"{macro}:", f"ext IN ({', '.join(repr(x) for x in GROUPS[macro].split())})") for name, macro in {"image": "pic", "audio": "audio", "doc": "doc", "video": "video", "zip": "zip", "exe": "exe"}.items()}
for _kind, _bounds in {"empty": "size = 0", "tiny": "size <= 16384", "small": "size BETWEEN 16384 AND 1048576", "medium": "size BETWEEN 1048576 AND 33554432", "large": "size BETWEEN 33554432 AND 134217728", "huge": "size BETWEEN 134217728 AND 1073741824", "gigantic": "size >= 1073741824"}.items():
    TYPED_SEARCHES[f"q_size_bucket_{_kind}"] = (f"size:{_kind}", _bounds)
TYPED_SEARCHES["q_empty_dir"] = ("empty:1", "is_dir AND entry_id NOT IN (SELECT parent_id FROM e)")
TYPED_SEARCHES["q_macro_and_size"] = ("video: size:>1mb !7", "ext IN ({}) AND size >= 1048576 AND NOT contains(CAST(entry_id - 1000 AS VARCHAR) || '.' || ext, '7')".format(", ".join(repr(x) for x in GROUPS["video"].split())))
#: Days that depend on the clock: (query text, the clock, predicate in SQL).
CLOCK = datetime(1996, 4, 10, 15, 30, tzinfo=timezone.utc)
DATED = {
    "q_dm_today": ("dm:today", f"mtime >= {sec('1996-04-10')}"),
    "q_dm_yesterday": ("dm:yesterday", f"mtime BETWEEN {sec('1996-04-09')} AND {sec('1996-04-10')} - 1"),
    "q_dm_lastweek": ("dm:lastweek", f"mtime BETWEEN {sec('1996-04-01')} AND {sec('1996-04-08')} - 1"),
    "q_dm_lastmonth": ("dm:lastmonth", f"mtime BETWEEN {sec('1996-03-01')} AND {sec('1996-04-01')} - 1"),
    "q_dm_lastyear": ("dm:lastyear", f"mtime BETWEEN {sec('1995-01-01')} AND {sec('1996-01-01')} - 1"),
}


def searching(text: str, *page):
    def run(spark, sf_dir) -> DataFrame:
        e = A.tree(spark, sf_dir)
        if page:
            return S.search(e, text, offset=page[2] if len(page) > 2 else 0).select(*COLUMNS)
        return S.hits(e, text).select("entry_id", "name", F.col("display_path").alias("path"), "size", "mtime")

    return run


QUERIES = {k: searching(v[0], *v[2:]) for k, v in SEARCHES.items()}
ORACLES = {k: f"{TREE} SELECT {', '.join(COLUMNS)} FROM e WHERE {v[1]}" + (f" ORDER BY {v[2]} LIMIT {v[3]}" + (f" OFFSET {v[4]}" if len(v) > 4 else "") if len(v) > 2 else "") for k, v in SEARCHES.items()}


QUERIES |= {k: lambda spark, sf_dir, text=v[0]: S.hits(A.typed(spark, sf_dir), text).select("entry_id", "size") for k, v in TYPED_SEARCHES.items()}
ORACLES |= {k: f"{TYPED} SELECT entry_id, CAST(size AS BIGINT) AS size FROM e WHERE {v[1]}" for k, v in TYPED_SEARCHES.items()}
QUERIES |= {k: lambda spark, sf_dir, text=v[0]: S.hits(A.tree(spark, sf_dir), text, now=CLOCK).select("entry_id", "mtime") for k, v in DATED.items()}
ORACLES |= {k: f"{TREE} SELECT entry_id, mtime FROM e WHERE {v[1]}" for k, v in DATED.items()}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id AS entry_id, n_chars AS size FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'token =')")
def q_content(spark, sf_dir):
    entries, contents = A.docs(spark, sf_dir)
    return S.hits(entries, 'content:"Token ="', contents).select("entry_id", "size")


@query(TREE + f"SELECT entry_id, path FROM e WHERE NOT (full_lc = 'c:{BS}asia' OR starts_with(full_lc, 'c:{BS}asia{BS}'))")
def q_exclude_dirs(spark, sf_dir):
    return build.exclude(A.tree(spark, sf_dir), ["C:/Asia/"]).filter("not deleted").select("entry_id", F.col("display_path").alias("path"))


@query(TREE + "SELECT count(*) AS total FROM e WHERE ext_lc = 'pdf'")
def q_total(spark, sf_dir):
    return S.hits(A.tree(spark, sf_dir), "ext:pdf").agg(F.count(F.lit(1)).alias("total"))


@query(TREE + "SELECT count(*) AS entries, count(*) FILTER (is_dir) AS directories, CAST(0 AS BIGINT) AS deleted FROM e")
def q_status(spark, sf_dir):
    return build.status(A.tree(spark, sf_dir))


@query(TREE + "SELECT ext_lc AS ext, count(*) AS n FROM e WHERE NOT is_dir GROUP BY 1")
def q_ext_histogram(spark, sf_dir):
    return A.tree(spark, sf_dir).filter("not is_dir").groupBy(F.col("ext_lc").alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query(TREE + "SELECT entry_id, child_count AS n FROM e WHERE is_dir")
def q_child_counts(spark, sf_dir):
    return A.tree(spark, sf_dir).filter("is_dir").select("entry_id", F.col("child_count").alias("n"))


@query(TREE + "SELECT entry_id, full_lc AS path_lc, depth FROM e WHERE is_dir")
def q_paths_recursive(spark, sf_dir):
    return A.tree(spark, sf_dir).filter("is_dir").select("entry_id", F.col("full_path_lc").alias("path_lc"), F.col("depth").cast("long").alias("depth"))


@query(TREE + "SELECT volume, count(*) AS n FROM e GROUP BY 1")
def q_merge_volumes(spark, sf_dir):
    e = A.tree(spark, sf_dir)
    return build.merge_volumes(e.filter("volume = 'C'"), e.filter("volume = 'D'"), e.filter("volume = 'D' and is_dir")).groupBy("volume").agg(F.count(F.lit(1)).alias("n"))


def overlay(e: DataFrame) -> DataFrame:
    return e.filter("not is_dir and file_id % 3 = 0").select("volume", "file_id", (F.col("size") + 1).alias("size"), (F.col("mtime") + 2).alias("mtime"), F.lit(None).cast("long").alias("ctime"))


@query(TREE + "SELECT entry_id, CASE WHEN NOT is_dir AND file_id % 3 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN NOT is_dir AND file_id % 3 = 0 THEN mtime + 2 ELSE mtime END AS mtime, ctime FROM e")
def q_overlay_coalesce(spark, sf_dir):
    e = A.tree(spark, sf_dir)
    return B.with_overlay(e, overlay(e)).select("entry_id", "size", "mtime", "ctime")


def unsized(e: DataFrame) -> DataFrame:
    """Every fifth file without its size yet."""
    return e.withColumn("size", F.when(F.col("file_id") % 5 == 0, F.lit(0)).otherwise(F.col("size")))


@query(TREE + "SELECT volume, count(*) AS pending FROM e WHERE NOT is_dir AND (file_id % 5 = 0 OR size = 0) GROUP BY 1")
def q_backfill_pending(spark, sf_dir):
    return B.pending(unsized(A.tree(spark, sf_dir))).groupBy("volume").agg(F.count(F.lit(1)).alias("pending"))


@query(TREE + "SELECT entry_id FROM e WHERE NOT is_dir AND (file_id % 5 = 0 OR size = 0) AND file_id % 3 <> 0")
def q_backfill_remainder(spark, sf_dir):
    e = A.tree(spark, sf_dir)
    return B.remainder(unsized(e), overlay(e)).select("entry_id")


@query(TREE + "SELECT entry_id FROM e WHERE is_dir AND file_id IN (SELECT parent_id FROM e WHERE NOT is_dir AND (file_id % 5 = 0 OR size = 0))")
def q_backfill_parents(spark, sf_dir):
    return B.pending_parents(unsized(A.tree(spark, sf_dir))).select("entry_id")


EVENTS = """
WITH c AS (
    SELECT user_id AS file_id, event_id AS usn, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'rename' ELSE 'modify' END AS op,
        CASE WHEN event_type IN ('signup', 'view') THEN user_id % 7 END AS parent_id, CASE WHEN event_type IN ('signup', 'view') THEN 'n' || CAST(event_id AS VARCHAR) END AS name,
        CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(floor(value * 100) AS BIGINT) END AS size, CASE WHEN event_type IN ('signup', 'click') THEN event_id + 5 END AS mtime, CASE WHEN event_type = 'signup' THEN event_id END AS ctime
    FROM events
), a AS (
    SELECT *, max(CASE WHEN op = 'create' THEN 1 END) OVER w AS alive FROM c WINDOW w AS (PARTITION BY file_id ORDER BY usn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), b AS (
    SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'delete') THEN op = 'delete' END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY usn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dead FROM a WHERE alive = 1
), t AS (
    SELECT file_id, arg_max(parent_id, usn) FILTER (op = 'create' OR (op = 'rename' AND NOT dead)) AS parent_id, arg_max(name, usn) FILTER (op = 'create' OR (op = 'rename' AND NOT dead)) AS name,
        arg_max(size, usn) FILTER (size IS NOT NULL AND op IN ('create', 'modify')) AS size, arg_max(mtime, usn) FILTER (mtime IS NOT NULL AND op IN ('create', 'modify')) AS mtime,
        arg_max(ctime, usn) FILTER (ctime IS NOT NULL AND op IN ('create', 'modify')) AS ctime, arg_max(op = 'delete', usn) FILTER (op IN ('create', 'delete')) AS deleted
    FROM b GROUP BY file_id
)
"""


def latest(spark, sf_dir) -> DataFrame:
    none = spark.createDataFrame([], "volume string, file_id long, parent_id long, name string, size long, mtime long, ctime long, attrs int, is_dir boolean, deleted boolean")
    return C.apply_changes(none, C.fresh(A.changes(spark, sf_dir)))


@query(EVENTS + "SELECT file_id, parent_id, name, size, mtime, ctime, deleted FROM t")
def q_changes_latest(spark, sf_dir):
    return latest(spark, sf_dir).select("file_id", "parent_id", "name", "size", "mtime", "ctime", "deleted")


@query(EVENTS + "SELECT file_id FROM t WHERE deleted")
def q_changes_tombstones(spark, sf_dir):
    return latest(spark, sf_dir).filter("deleted").select("file_id")


@query("""
    WITH g AS (SELECT n_chars AS size, sha256(text) AS group_id, count(*) AS file_count FROM documents WHERE n_chars >= 1 GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT group_id, size, file_count, size * file_count AS total_bytes, size * (file_count - 1) AS reclaimable FROM g ORDER BY reclaimable DESC, file_count DESC, group_id LIMIT 1000
""")
def q_duplicate_groups(spark, sf_dir):
    return D.duplicate_groups(*A.docs(spark, sf_dir), min_size=1).select("group_id", "size", "file_count", "total_bytes", "reclaimable")


@query(TREE + "SELECT entry_id, volume FROM (SELECT entry_id, volume, row_number() OVER (PARTITION BY volume ORDER BY entry_id) AS rn FROM e) ORDER BY rn, volume LIMIT 21")
def q_round_robin(spark, sf_dir):
    return S.round_robin(A.tree(spark, sf_dir), 21).select("entry_id", "volume")


@query("SELECT user_id AS file_id, max(event_id) AS usn FROM events GROUP BY 1")
def q_pk_keep_last(spark, sf_dir):
    return build.keep_last(A.changes(spark, sf_dir), "usn").select("file_id", "usn")


@query(TREE + "SELECT count(*) FILTER (is_dir) AS folders, count(*) FILTER (NOT is_dir) AS files FROM e WHERE contains(name_lc, '1')")
def q_folder_file_totals(spark, sf_dir):
    return S.hits(A.tree(spark, sf_dir), "1").agg(F.count_if("is_dir").alias("folders"), F.count_if(~F.col("is_dir")).alias("files"))


@query(TREE + "SELECT entry_id, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' ELSE CAST(h // 100 AS VARCHAR) || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || CASE WHEN size < 1048576 THEN ' KB' ELSE ' MB' END END AS text FROM (SELECT *, CASE WHEN size < 1048576 THEN (size * 100 + 512) // 1024 ELSE (size * 100 + 524288) // 1048576 END AS h FROM e)")
def q_format_size(spark, sf_dir):
    return A.tree(spark, sf_dir).select("entry_id", T.format_size(F.col("size")).alias("text"))


@query("SELECT o_orderkey + 281474976710656 * (o_orderkey % 3) AS file_id, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders")
def q_mft_masked_join(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    raw = o.select(F.lit("C").alias("volume"), (F.col("o_orderkey") + (F.col("o_orderkey") % 3) * (1 << 48)).alias("file_id"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ft"), F.lit(0).cast("long").alias("ctime_ft"))
    meta = o.select(F.lit("C").alias("volume"), F.col("o_orderkey").alias("file_id"), F.floor("o_totalprice").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ft"), F.lit(1).cast("long").alias("ctime_ft"))
    return B.join_by_record(raw, meta).select("file_id", "size")


@query("SELECT CAST(o_orderkey + 1000000000 AS BIGINT) AS file_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def q_orphans(spark, sf_dir):
    raw = A.tree_raw(spark, sf_dir).filter("not is_dir or file_id < 1000000 or file_id % 2 = 0")
    return build.orphans(raw).select("file_id")


@query(TREE + "SELECT avg(CASE WHEN starts_with(full_lc, 'c:" + BS + "asia') THEN 1 ELSE 0 END) AS deleted_share FROM e")
def q_deleted_share(spark, sf_dir):
    return build.deleted_share(build.exclude(A.tree(spark, sf_dir), ["C:/Asia/"]))


@query(TREE + "SELECT CAST(entry_id AS BIGINT) AS file_id, name, CAST(CASE WHEN NOT is_dir AND file_id % 3 <> 0 THEN size + 1 ELSE size END AS BIGINT) AS size FROM e")
def q_reparse_supplement(spark, sf_dir):
    """A scan that lacks two files of three, and a walk that finds them, and others that are known, several times."""
    raw = A.tree_raw(spark, sf_dir)
    walked = raw.filter("not is_dir").withColumn("size", F.col("size") + 1)
    return V.supplemented(raw.filter("is_dir or file_id % 3 = 0"), walked.union(walked)).select("file_id", "name", "size")


@query(TREE + f"SELECT volume, count(*) AS n, count(*) FILTER (NOT is_dir AND ext_lc = 'pdf') AS pdfs, CAST(sum(depth) AS BIGINT) AS depths FROM e WHERE NOT starts_with(full_lc, 'c:{BS}asia') GROUP BY 1")
def q_index_volumes(spark, sf_dir):
    """Both volumes scanned at once, saved, and read as Engine does."""
    raw, path = build.stored(A.tree_raw(spark, sf_dir), "raw"), build.fresh_path(spark, "volumes")
    V.index_volumes(spark, lambda v: raw.filter(F.col("volume") == v), V.volume_list(volumes=["C", "D"]), path, ["C:/Asia"])
    e = Engine.load(spark, path).entries.filter("not deleted")
    return e.groupBy("volume").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_dir") & (F.col("ext_lc") == "pdf")).alias("pdfs"), F.sum("depth").alias("depths"))


#: Requests in the client's numbers: (text, search flags, sort, offset, at most, predicate, order in SQL).
CLIENT = {
    "q_client_regex": ("^Order_[0-9]{2}\\.pdf$", 1, 1, 0, 8192, "regexp_matches(name, '^Order_[0-9]{2}[.]pdf$')", "name, entry_id"),
    "q_client_case_word": ("PDF", 2 | 4, 6, 0, 100, "regexp_matches(name, '(^|[^A-Za-z0-9_])PDF([^A-Za-z0-9_]|$)')", "size DESC, entry_id"),
    "q_client_page": ("ext:txt", 8, 14, 10, 25, "ext_lc = 'txt'", "mtime DESC, entry_id"),
    "q_client_sort_by_name": ("ext:md sort:size", 0, 8, 0, 40, "ext_lc = 'md'", "name DESC, entry_id"),
}
for _name, (_text, _flags, _sort, _offset, _most, _where, _order) in CLIENT.items():
    QUERIES[_name] = lambda spark, sf_dir, a=(_text, _flags, _sort, _offset, _most): S.client_search(A.tree(spark, sf_dir), *a, 1 | 4 | 16 | 64)
    ORACLES[_name] = f"{TREE} SELECT entry_id, name, path AS full_path, size, mtime FROM e WHERE {_where} ORDER BY {_order} LIMIT {_most} OFFSET {_offset}"


@query(TREE + "SELECT entry_id, row_number() OVER (ORDER BY lower(name) DESC, entry_id) AS place FROM (SELECT * FROM e WHERE contains(name_lc, '7') ORDER BY size DESC, entry_id LIMIT 60)")
def q_page_resorted(spark, sf_dir):
    from pyspark.sql import Window

    page = S.resorted(S.search(A.tree(spark, sf_dir), "7 sort:size:desc", limit=60), "name", True)
    # one window over one page
    return page.select("entry_id", F.row_number().over(Window.orderBy(F.lower("name").desc(), "entry_id")).cast("long").alias("place"))


@query(TREE + "SELECT entry_id, name, path, regexp_extract(name, '^.+[.]([^.]*)$', 1) AS extension, size, CAST(0 AS BIGINT) AS created_unix, mtime AS modified_unix, is_dir AS is_directory FROM e WHERE contains(name_lc, '12') ORDER BY size DESC, entry_id LIMIT 200")
def q_form_rows(spark, sf_dir):
    return S.form_rows(S.search(A.tree(spark, sf_dir), "12 sort:size:desc", limit=200)).drop("name_highlight")


@query("""
    WITH r AS (SELECT *, [512, 256, 8192, 4096, 2, 4, 32768, 1, 512 + 256, 8192 + 4096, 4096 + 2, 2147483648][event_id % 12 + 1] AS reason FROM events),
    o AS (SELECT *, CASE event_id % 12 WHEN 0 THEN 'delete' WHEN 8 THEN 'delete' WHEN 1 THEN 'create' WHEN 2 THEN 'create' WHEN 9 THEN 'create' WHEN 3 THEN 'rename' WHEN 10 THEN 'rename' WHEN 4 THEN 'modify' WHEN 5 THEN 'modify' WHEN 6 THEN 'modify' END AS op FROM r)
    SELECT event_id AS usn, user_id AS file_id, op, CASE WHEN op IN ('create', 'rename') THEN 'n' || CAST(event_id AS VARCHAR) END AS name,
        CASE WHEN op IN ('create', 'modify') AND user_id % 3 <> 0 THEN user_id * 10 END AS size, CASE WHEN op = 'create' THEN user_id % 2 = 0 END AS is_dir
    FROM o WHERE op IS NOT NULL AND (op <> 'create' OR user_id % 3 <> 0)
""")
def q_journal_events(spark, sf_dir):
    """Journal records of all reasons; a third of the files can't be read any more."""
    e, k = A.table(spark, sf_dir, "events"), F.col("user_id")
    reasons = F.array(*(F.lit(x).cast("long") for x in (512, 256, 8192, 4096, 2, 4, 32768, 1, 512 + 256, 8192 + 4096, 4096 + 2, 2147483648)))
    records = e.select(F.lit("C").alias("volume"), F.lit(1).cast("long").alias("journal_id"), F.col("event_id").cast("long").alias("usn"), k.cast("long").alias("file_id"), F.lit(0).cast("long").alias("parent_id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), F.get(reasons, (F.col("event_id") % 12).cast("int")).alias("reason"), F.lit(0).alias("attrs"), (k % 2 == 0).alias("is_dir"))
    time = F.lit(1).cast("long")
    read = e.filter("user_id % 3 <> 0").select(F.lit("C").alias("volume"), k.cast("long").alias("file_id"), (k * 10).cast("long").alias("size"), time.alias("mtime"), time.alias("ctime")).distinct()
    return C.events(records, read).select("usn", "file_id", "op", "name", "size", "is_dir")


@query(TREE + "SELECT entry_id, name, volume || ':' || pp AS path, coalesce(ext_lc, '') AS extension, size, CAST(attrs AS BIGINT) AS attributes FROM e WHERE ext_lc = 'md'")
def q_flag_projection(spark, sf_dir):
    return S.projected(S.hits(A.tree(spark, sf_dir), "ext:md"), 1 | 2 | 8 | 16 | 256).withColumn("attributes", F.col("attributes").cast("long"))


@query(TREE + "SELECT entry_id FROM e WHERE volume = 'C' AND (full_lc = 'c:" + BS + "asia' OR starts_with(full_lc, 'c:" + BS + "asia" + BS + "'))")
def q_cascade_delete(spark, sf_dir):
    e = A.tree(spark, sf_dir)
    return C.cascade(e.withColumn("deleted", F.col("full_path_lc") == "c:\\asia")).filter("deleted").select("entry_id")


@query(TREE + """SELECT entry_id, name, '[[0,5],[' || CAST(strpos(name_lc, '11') - 1 AS VARCHAR) || ',' || CAST(strpos(name_lc, '11') + 1 AS VARCHAR) || ']]' AS marks
    FROM e WHERE contains(name_lc, 'order') AND length(name) - length(replace(name, '11', '')) = 2 AND NOT contains(name, '111')""")
def q_highlight(spark, sf_dir):
    """Names with the needle 11 once, so that SQL can tell the place."""
    found = S.search(A.tree(spark, sf_dir), "order 11", limit=1 << 30).filter("length(name) - length(replace(name, '11', '')) = 2 and not contains(name, '111')")
    return found.select("entry_id", "name", F.to_json("name_highlight").alias("marks"))


@query(TREE + "SELECT entry_id, '[[0,9]]' AS marks FROM e WHERE regexp_matches(name, '^Order_[0-9]{2}[.]')")
def q_highlight_regex(spark, sf_dir):
    return S.search(A.tree(spark, sf_dir), "regex:^Order_[0-9]{2}\\.", limit=1 << 30).select("entry_id", F.to_json("name_highlight").alias("marks"))


@query("SELECT doc_id AS entry_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'token =')")
def q_content_binary(spark, sf_dir):
    """Contents as bytes with a byte order mark, by turns in UTF-16 and UTF-8."""
    entries, contents = A.docs(spark, sf_dir)
    wide = F.concat(F.lit(b"\xff\xfe"), F.encode("content", "UTF-16LE"))
    narrow = F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("content", "UTF-8"))
    raw = contents.select("volume", "file_id", F.when(F.col("file_id") % 2 == 0, wide).otherwise(narrow).alias("content"))
    return S.hits(entries, 'content:"Token ="', raw).select("entry_id")


def chinese(spark) -> DataFrame:
    i = F.col("id")
    name = F.concat(F.when(i % 1000 == 0, "北京_").when(i % 500 == 0, "上海_").otherwise("中文噪声_"), F.lpad(i.cast("string"), 8, "0"), F.lit(".txt"))
    zero = F.lit(0).cast("long")
    raw = spark.range(10_000).select(F.lit("C").alias("volume"), (i + 10000).alias("file_id"), zero.alias("parent_id"), name.alias("name"), zero.alias("size"), zero.alias("mtime_ft"), zero.alias("ctime_ft"), F.lit(0).alias("attrs"), F.lit(False).alias("is_dir"), F.lit("").alias("parent_path_lc"), F.lit(0).alias("children"))
    return build.columns(raw)


@query("SELECT CAST(i + 10000 AS BIGINT) AS file_id FROM range(10000) r(i) WHERE i % 1000 = 0")
def q_pinyin_full(spark, sf_dir):
    return S.hits(chinese(spark), "beijing", pinyin=True).select("file_id")


@query("SELECT CAST(i + 10000 AS BIGINT) AS file_id FROM range(10000) r(i) WHERE i % 500 = 0 AND i % 1000 <> 0")
def q_pinyin_initials(spark, sf_dir):
    return S.hits(chinese(spark), "sh;py").select("file_id")


@query("""
    SELECT CAST(n_nationkey AS BIGINT) AS file_id, n_nationkey % 5 = 2 AS marked FROM nation WHERE n_nationkey % 5 IN (0, 2, 3)
""")
def q_pinyin_names(spark, sf_dir):
    """Names of further characters, by full and mixed spelling; marks of the first two characters."""
    n = A.table(spark, sf_dir, "nation")
    name = F.element_at(F.array(*map(F.lit, ("重庆", "长沙", "杭州", "绿色", "深圳"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    zero = F.lit(0).cast("long")
    raw = n.select(F.lit("C").alias("volume"), F.col("n_nationkey").cast("long").alias("file_id"), zero.alias("parent_id"), F.concat(name, F.lit("_"), "n_name").alias("name"), zero.alias("size"), zero.alias("mtime_ft"), zero.alias("ctime_ft"), F.lit(0).alias("attrs"), F.lit(False).alias("is_dir"), F.lit("").alias("parent_path_lc"), F.lit(0).alias("children"))
    e = build.columns(raw).withColumn("entry_id", F.col("file_id"))
    return S.search(e, "hangz;py", limit=1000).select(F.col("entry_id").alias("file_id"), (F.to_json("name_highlight") == "[[0,2]]").alias("marked")).union(S.hits(e, "chongq;py | lvse;py").select("file_id", F.lit(False)))


def streamed(spark, state: DataFrame, batches: list[DataFrame], excluded=()) -> DataFrame:
    """Batches of changes through a catalogue's state to its searchable snapshot, as Engine reads it."""
    c = Catalogue(build.fresh_path(spark, "stream"), excluded)
    c.write(state, spark.createDataFrame([("C", 1, -1), ("D", 1, -1)], VOLUMES))
    c.refresh(spark)
    for batch in batches:
        c.apply(batch)
    return Engine.load(spark, c.refresh(spark)).entries


@query(EVENTS + "SELECT file_id, 'C:' || chr(92) || name AS path, coalesce(size, 0) AS size FROM t WHERE NOT deleted AND contains(name, '1')")
def q_stream_search(spark, sf_dir):
    ev = A.changes(spark, sf_dir).withColumn("is_dir", F.lit(False))
    middle = F.lit(ev.agg(F.expr("percentile_approx(usn, 0.5)")).first()[0])
    found = streamed(spark, spark.createDataFrame([], SCHEMA), [ev.filter(F.col("usn") <= middle), ev.filter(F.col("usn") > middle), ev])
    return S.hits(found, "1").select("file_id", F.col("display_path").alias("path"), "size")


@query(TREE + f"""SELECT entry_id, CASE WHEN starts_with(full_lc, 'c:{BS}asia') THEN 'C:{BS}europe2{BS}orient' || substr(path, 8) ELSE path END AS path FROM e
    WHERE NOT starts_with(full_lc, 'd:{BS}america') AND NOT starts_with(full_lc, 'c:{BS}africa') AND NOT starts_with(full_lc, 'd:{BS}europe')
    UNION ALL SELECT 7, 'C:{BS}europe2'""")
def q_stream_moved_dirs(spark, sf_dir):
    """A directory that is moved into one which the same batch makes after it, one that is deleted, and one that is excluded, each with all below."""
    t = A.tree(spark, sf_dir)
    state = t.select([c for c in STATE if c in t.columns])
    top = {r["name"]: r for r in t.filter("parent_id = 0").select("name", "volume", "file_id").collect()}  # regions
    kind = "volume string, usn long, journal_id long, op string, file_id long, parent_id long, name string, size long, mtime long, ctime long, attrs int, is_dir boolean"
    none = (None,) * 5
    events = [("C", 1, 1, "rename", top["ASIA"].file_id, 7, "ORIENT", *none), ("C", 2, 1, "create", 7, 0, "Europe2", 0, 0, 0, 1, True)]
    events += [(top[n].volume, 3 + i, 1, "delete", top[n].file_id, None, None, *none) for i, n in enumerate(x for x in ("AFRICA", "EUROPE") if x in top)]
    return streamed(spark, state, [spark.createDataFrame(events, kind)], ["D:/America"]).filter("not deleted").select(F.when(F.col("file_id") == 7, F.lit(7)).otherwise(F.col("file_id")).alias("entry_id"), F.col("display_path").alias("path"))
