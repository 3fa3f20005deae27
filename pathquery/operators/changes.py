"""Applying a batch of change events to the rows they touch; plain window functions and one aggregation.

Rules: an unknown key only comes alive by a create; create overwrites and revives (a directory's times of 0 keep the old
ones); rename is ignored while deleted; modify patches what is not null and revives nothing; delete marks.  Order is
that of usn; events at or before a volume's last usn, and repeats, are skipped, so that a batch may be replayed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import CatalogError
from .build import in_directories

KEY = ["volume", "file_id"]
#: Reason bits of journal records, by what they mean.
REASONS = {"delete": 0x200, "create": 0x100 | 0x2000, "rename": 0x1000, "modify": 0x2 | 0x4 | 0x8000}


def operation(reason) -> "F.Column":
    """The event that a journal record's reasons stand for, the first that holds of REASONS, or null.

    The new name of a rename is a create (its metadata are read anew), the old name a rename to what the record says.
    """
    return F.coalesce(*(F.when(reason.bitwiseAND(F.lit(bits)) != 0, F.lit(op)) for op, bits in REASONS.items()))


def events(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Change events of journal records (volume, journal_id, usn, file_id, parent_id, name, reason, attrs, is_dir).

    metadata: (volume, file_id, size, mtime, ctime) as read now, one row a key.  A create without metadata goes (the file is
    gone by now); a modify without them changes nothing.  Records that stand for no event go.
    """
    ev = records.withColumn("op", operation(F.col("reason"))).filter("op is not null")
    ev = ev.join(metadata.select(*KEY, "size", "mtime", "ctime", F.lit(True).alias("_read")), KEY, "left").filter("op <> 'create' or _read")
    valued, named, made = F.col("op").isin("create", "modify"), F.col("op").isin("create", "rename"), F.col("op") == "create"
    own = {"parent_id": named, "name": named, "size": valued, "mtime": valued, "ctime": valued, "attrs": made, "is_dir": made}
    return ev.select(*KEY, "usn", "journal_id", "op", *(F.when(cond, F.col(c)).alias(c) for c, cond in own.items()))


def check_journal(volumes: DataFrame, changes: DataFrame) -> None:
    """A volume whose journal was made anew needs a new scan."""
    bad = changes.select("volume", "journal_id").distinct().join(volumes.select("volume", F.col("journal_id").alias("known")), "volume").filter("journal_id <> known").limit(1).count()
    if bad:
        raise CatalogError("the change journal is a new one: scan the volume again")


def fresh(changes: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    if volumes is not None:
        changes = changes.join(volumes.select("volume", "last_usn"), "volume", "left").filter(F.col("usn") > F.coalesce("last_usn", F.lit(-1))).drop("last_usn")
    return changes.dropDuplicates(["volume", "usn"])


def under_exclusions(changes: DataFrame, excluded: list[str], parents: DataFrame) -> DataFrame:
    """Creates in excluded directories go; renames into them become deletes.  parents: (volume, parent_id, parent_full_lc)."""
    from ..functions.text import ascii_lower

    full = F.concat(F.col("parent_full_lc"), F.lit("\\"), ascii_lower(F.col("name")))
    inside = F.coalesce(in_directories(full, excluded), F.lit(False))
    c = changes.join(parents, ["volume", "parent_id"], "left").withColumn("_in", inside & F.col("op").isin("create", "rename"))
    return c.filter(~F.col("_in") | (F.col("op") == "rename")).withColumn("op", F.when(F.col("_in"), "delete").otherwise(F.col("op"))).select(changes.columns)


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Touched rows (volume, file_id, parent_id, name, size, mtime, ctime, attrs, is_dir, deleted) after the batch.

    current: rows with the same columns.  changes: volume, file_id, usn, op (create, delete, rename, modify) and the
    nullable parent_id, name, size, mtime, ctime, attrs, is_dir.
    """
    fields = ["parent_id", "name", "size", "mtime", "ctime", "attrs", "is_dir", "deleted"]
    base = current.select(*KEY, *(F.col(c).alias(f"b_{c}") for c in fields), F.lit(True).alias("known"))
    ev = changes.join(base, KEY, "left")
    w = Window.partitionBy(*KEY).orderBy("usn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ev = ev.withColumn("alive", F.col("known").isNotNull() | (F.max(F.when(F.col("op") == "create", 1)).over(upto) == 1)).filter("alive")
    ev = ev.withColumn("dead_before", F.coalesce(F.last(F.when(F.col("op").isin("create", "delete"), F.col("op") == "delete"), ignorenulls=True).over(before), "b_deleted", F.lit(False)))
    create, named = F.col("op") == "create", (F.col("op") == "create") | ((F.col("op") == "rename") & ~F.col("dead_before"))
    valued = F.col("op").isin("create", "modify")
    folder = F.coalesce("is_dir", "b_is_dir", F.lit(False))
    when = lambda c, cond: F.max_by(F.col(c), F.when(cond, F.col("usn")))
    last = {c: when(c, named) for c in ("parent_id", "name")} | {c: when(c, create) for c in ("attrs", "is_dir")}
    for c in ("size", "mtime", "ctime"):
        last[c] = when(c, valued & F.col(c).isNotNull() & ~(folder & (F.col(c) == 0) & create))
    ev = ev.withColumn("gone", F.col("op") == "delete")
    last["deleted"] = when("gone", F.col("op").isin("create", "delete"))
    out = ev.groupBy(*KEY).agg(*(v.alias(c) for c, v in last.items()), *(F.first(f"b_{c}").alias(f"b_{c}") for c in fields))
    zero = {"size": 0, "mtime": 0, "ctime": 0, "deleted": False}
    return out.select(*KEY, *(F.coalesce(c, f"b_{c}", *([F.lit(zero[c])] if c in zero else [])).alias(c) for c in fields))


def merged(current: DataFrame, touched: DataFrame) -> DataFrame:
    return current.join(touched.select(*KEY), KEY, "left_anti").unionByName(touched.select(current.columns))


def cascade(entries: DataFrame) -> DataFrame:
    """Everything below a deleted directory is deleted as well."""
    gone = entries.filter("is_dir and deleted").select("volume", F.col("full_path_lc").alias("top"))
    # a path meets its ancestors by equality, one row for each, rather than by prefix with every deleted directory
    parts = entries.filter("not deleted").select("entry_id", "volume", F.split("full_path_lc", r"\\").alias("p"))
    up = parts.select("entry_id", "volume", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.array_join(F.slice("p", F.lit(1), i), "\\"))).alias("top"))
    below = up.join(gone, ["volume", "top"], "left_semi").select("entry_id").distinct().withColumn("_below", F.lit(True))
    return entries.join(below, "entry_id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("_below", F.lit(False))).select(entries.columns)
