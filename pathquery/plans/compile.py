"""From the tree of a query to one Catalyst predicate over the catalogue's stored columns, cheapest parts first."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.pinyin import pinyin_contains
from .literals import glob_to_regex
from .syntax import Branch, low


def between(c: Column, bounds) -> list[Column]:
    a, b = bounds
    if a is not None and a == b:
        return [c == a]
    return ([c >= a] if a is not None else []) + ([c <= b] if b is not None else [])


def predicate(b: Branch, pinyin: bool = False, metadata_ready: bool = True) -> Column:
    """What a row alone decides; sizedupe: and content: need other rows or tables and are added by the search."""
    col = F.col
    p: list[Column] = [~col("deleted")]
    if b.drive:
        p.append(col("volume") == b.drive)
    if b.is_dir is not None:
        p.append(col("is_dir") if b.is_dir else ~col("is_dir"))
    if b.exts is not None:
        p.append(col("ext_lc").isin(*b.exts) if b.exts else F.lit(False))
    if b.attributes:
        p.append(col("attrs").bitwiseAND(F.lit(b.attributes)) == b.attributes)
    if metadata_ready:
        p += between(col("size"), b.size)
    p += between(col("mtime"), b.mtime) + between(col("ctime"), b.ctime) + between(col("name_len"), b.length) + between(col("depth"), b.depth)
    if b.child is not None:
        p += [col("is_dir"), col("child_count") == b.child]
    if b.empty is not None:
        p += [col("is_dir"), col("child_count") == 0 if b.empty else col("child_count") > 0]
    if b.parent is not None:
        drive, path = b.parent
        p += ([col("volume") == drive] if drive else []) + [col("parent_path_lc") == path, col("name") != ""]  # a volume's root is nobody's child
    if b.prefix:
        full = f"{(b.drive or '').lower()}:{b.prefix}"
        p.append((col("full_path_lc") == full) | col("full_path_lc").startswith(full + "\\"))
    fold = (lambda s: s) if b.case else low
    name = col("name") if b.case else col("name_lc")
    if b.starts is not None:
        p.append(name.startswith(fold(b.starts)))
    if b.ends is not None:
        p.append(name.endswith(fold(b.ends)))
    if b.parent_contains:
        p.append(col("parent_path_lc").contains(b.parent_contains))
    if b.path:
        p.append((col("name_lc") if b.no_path or b.no_wfn else col("full_path_lc")).contains(b.path))
    for t in b.terms:
        w = fold(t.text)
        if b.whole_name:
            p.append(name == w)
        elif b.whole_word:
            p.append(name.rlike(rf"(^|[^A-Za-z0-9_]){re.escape(w)}([^A-Za-z0-9_]|$)"))
        else:
            literal = name.contains(w)
            latin = bool(re.fullmatch(r"[a-z]+", low(t.text))) and t.mode != "en" and (pinyin or t.mode == "py")
            p.append(pinyin_contains(col("name"), low(t.text)) if latin and t.mode == "py" else literal | pinyin_contains(col("name"), low(t.text)) if latin else literal)
    p += [~name.contains(fold(n)) for n in b.negatives]
    p += [col("name").rlike(glob_to_regex(g)) for g in b.globs] + [col("name").rlike(r) for r in b.regexes]
    return reduce(and_, p)
