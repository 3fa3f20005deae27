"""Running a query: filter, alternatives, sort, page, total."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import binary_contains, text_contains
from ..functions.text import EPOCH, all_highlights, highlights
from ..plans.compile import predicate
from ..plans.syntax import SORTS as SORT_COLUMNS
from ..plans.syntax import Branch, Query, flagged, low, parse


def alone(b: Branch) -> bool:
    """Whether a row alone decides."""
    return not b.size_dupe and b.content is None


def hits(entries: DataFrame, query: Query | str, contents: DataFrame | None = None, pinyin: bool = False, metadata_ready: bool = True, now: datetime | None = None) -> DataFrame:
    """All entries that match, in no order.  contents: (volume, file_id, content) for content:, text or binary of any encoding."""
    q = parse(query, now) if isinstance(query, str) else query
    plain = [predicate(b, pinyin, metadata_ready) for b in q.branches if alone(b)]
    parts = [entries.filter(reduce(or_, plain))] if plain else []
    for b in q.branches:
        if not alone(b):
            found = entries.filter(predicate(b, pinyin, metadata_ready))
            if b.content is not None:
                if contents is None:
                    raise ValueError("content: needs a table of contents")
                holds = binary_contains if contents.schema["content"].dataType.simpleString() == "binary" else text_contains
                found = found.filter("not is_dir").join(contents.filter(holds(F.col("content"), b.content)).select("volume", "file_id"), ["volume", "file_id"], "left_semi")
            if b.size_dupe:  # files only; the sizes that repeat among the hits
                found = found.filter("not is_dir")
                found = found.join(found.groupBy("size").count().filter("count > 1").select("size"), "size", "left_semi").select(entries.columns)
            parts.append(found)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).dropDuplicates(["entry_id"])


def ordered(found: DataFrame, q: Query, metadata_ready: bool = True) -> list:
    sort = q.sort if metadata_ready or q.sort not in ("size", "mtime", "ctime") else "name"
    c = F.col(sort)
    return [c.desc() if q.descending else c.asc(), F.col("entry_id")]


def paged(entries: DataFrame, q: Query, limit: int, offset: int = 0, **options) -> DataFrame:
    """The entries of a page of hits, sorted; ties go by entry_id."""
    page = hits(entries, q, **options).orderBy(*ordered(entries, q, options.get("metadata_ready", True)))
    return page.offset(offset).limit(limit) if offset else page.limit(limit)


def search(entries: DataFrame, query: Query | str, limit: int = 1000, offset: int = 0, **options) -> DataFrame:
    """A page of hits, sorted, with the query's own count: in preference to `limit`; ties go by entry_id."""
    q = parse(query, options.get("now")) if isinstance(query, str) else query
    page = paged(entries, q, limit if q.limit is None else q.limit, offset, **options)
    needles, regexes = [t.text for b in q.branches for t in b.terms], [r for b in q.branches for r in b.regexes]
    latin = [low(t.text) for b in q.branches for t in b.terms if re.fullmatch("[a-z]+", low(t.text)) and t.mode != "en" and (options.get("pinyin") or t.mode == "py")]
    marks = all_highlights(F.col("name"), needles, regexes, latin) if regexes or latin else highlights("name", needles)
    return page.select(F.expr("*"), marks.alias("name_highlight")).selectExpr("entry_id", "name", "display_path as path", "size", "mtime", f"if(mtime > 0, (mtime + {EPOCH}) * 10000000, 0L) as mtime_ft", "is_dir as is_directory", "name_highlight")


def total(entries: DataFrame, query: Query | str, **options) -> int:
    """How many match, before any limit."""
    return hits(entries, query, **options).count()


def round_robin(found: DataFrame, limit: int) -> DataFrame:
    """The first hits of each volume in turn."""
    from pyspark.sql import Window

    top = found.withColumn("rn", F.row_number().over(Window.partitionBy("volume").orderBy("entry_id"))).filter(F.col("rn") <= limit)
    return top.orderBy("rn", "volume").limit(limit)


#: Sort numbers of the client protocol; those of columns that the catalogue lacks sort by name, ascending if odd.
SORTS = {1: "name", 2: "name:d", 3: "path", 4: "path:d", 5: "size", 6: "size:d", 11: "created", 12: "created:d", 13: "modified", 14: "modified:d", 21: "modified", 22: "modified:d"}


def sort_of(number: int) -> str:
    """The value of sort: that a client's number stands for."""
    return SORTS.get(number, "name:d" if 2 <= number <= 26 and number % 2 == 0 else "name")


#: Request flags of the client protocol and their columns.
FLAGS = {1: "name", 2: "path", 4: "full_path", 8: "extension", 16: "size", 32: "ctime", 64: "mtime", 128: "atime", 256: "attributes", 1024: "run_count"}


def projected(found: DataFrame, flags: int) -> DataFrame:
    cols = {
        "name": F.col("name"), "path": F.concat("volume", F.lit(":"), F.col("parent_path_lc")), "full_path": F.col("display_path"), "extension": F.coalesce("ext_lc", F.lit("")), "size": F.col("size"),
        "ctime": F.col("ctime"), "mtime": F.col("mtime"), "atime": F.lit(0).cast("long"), "attributes": F.col("attrs"), "run_count": F.lit(0).cast("long"),
    }
    return found.select("entry_id", *(cols[c].alias(c) for bit, c in FLAGS.items() if flags & bit))


#: Fixed value: hits that a client's request may reach, its offset included.
CLIENT_HITS = 8192


def client_search(entries: DataFrame, text: str, search_flags: int = 0, sort: int = 1, offset: int = 0, maximum: int = CLIENT_HITS, request_flags: int = 1 | 2, **options) -> DataFrame:
    """A request in the numbers of the client protocol: a page in the order of `sort`, with the columns of `request_flags`.

    An empty text finds nothing; the sort: and count: of the text give way to the request's; romanised names are matched.
    """
    by, _, way = sort_of(sort).partition(":")
    q = replace(flagged(parse(text, options.get("now")), search_flags), sort=SORT_COLUMNS[by], descending=way == "d")
    reach = max(min(offset + maximum, CLIENT_HITS) - offset, 0) if text.strip() else 0
    return projected(paged(entries, q, reach, offset, **({"pinyin": True} | options)), request_flags)


def resorted(page: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """A page that was fetched in the order of one of its columns, names and paths regardless of case; ties go by entry_id."""
    c = F.lower(by) if by in ("name", "path") else F.col(by)
    return page.orderBy(c.desc() if descending else c.asc(), "entry_id")


def form_rows(page: DataFrame) -> DataFrame:
    """A page as the search form shows it: with the extension as it is written (none for names such as .profile), times in Unix seconds, no time of creation."""
    modified = F.greatest(F.floor(F.col("mtime_ft") / 10_000_000).cast("long") - EPOCH, F.lit(0))
    return page.select("entry_id", "name", "path", F.regexp_extract("name", r"^.+\.([^.]*)$", 1).alias("extension"), "size", F.lit(0).cast("long").alias("created_unix"), modified.cast("long").alias("modified_unix"), "is_directory", "name_highlight")
