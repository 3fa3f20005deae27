"""Column functions on names, paths, sizes, times and attributes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seconds from 1601 to 1970.
EPOCH = 11_644_473_600
#: Attribute bits of the catalogue, and of the raw scan they come from.
DIR, HIDDEN, SYSTEM, READONLY, ARCHIVE = 1, 2, 4, 8, 16
RAW_BITS = {0x1: READONLY, 0x2: HIDDEN, 0x4: SYSTEM, 0x20: ARCHIVE, 0x10: DIR}


def ascii_lower(c: Column) -> Column:
    """Only A-Z are lowered; lower() would fold more."""
    return F.translate(c, UPPER, LOWER)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot, null without one."""
    return F.nullif(ascii_lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), F.lit(""))


def filetime_to_unix(ft: Column) -> Column:
    """Whole seconds since 1970; unknown (0 or before 1970) is 0, more than 32 bits saturate."""
    return F.least(F.greatest(F.floor(ft / F.lit(10_000_000)) - F.lit(EPOCH), F.lit(0)), F.lit(2**32 - 1)).cast("long")


def unix_to_filetime(s: Column) -> Column:
    return F.when(s > 0, (s + F.lit(EPOCH)) * F.lit(10_000_000)).otherwise(F.lit(0)).cast("long")


def packed_attributes(raw: Column) -> Column:
    out = F.lit(0)
    for bit, ours in RAW_BITS.items():
        out = out.bitwiseOR(F.when(raw.bitwiseAND(F.lit(bit)) != 0, F.lit(ours)).otherwise(F.lit(0)))
    return out.cast("int")


def depth(parent_path: Column) -> Column:
    """1 for children of a volume's root."""
    return (F.length(parent_path) - F.length(F.replace(parent_path, F.lit("\\"), F.lit(""))) + 1).cast("int")


def parent_of(path: Column) -> Column:
    """The path up to its last backslash."""
    return F.regexp_replace(path, r"\\[^\\]*$", "")


def format_size(size: Column) -> Column:
    """B whole; KB, MB and GB with two decimals."""

    def scaled(n: int, unit: str) -> Column:
        h = F.floor((size * 100 + n // 2) / F.lit(n)).cast("long")  # hundredths, halves up
        return F.concat(F.floor(h / 100).cast("string"), F.lit("."), F.lpad((h % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))

    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, scaled(1 << 10, "KB")).when(size < 1 << 30, scaled(1 << 20, "MB")).otherwise(scaled(1 << 30, "GB"))


def format_time(seconds: Column) -> Column:
    """YYYY-MM-DD HH:MM in the session's zone, - when unknown."""
    return F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")).otherwise(F.lit("-"))


def ext_bucket(ext: str) -> int:
    """The 8-bit FNV-1a bucket of an extension."""
    h = 0x811C9DC5
    for b in ext.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h & 0xFF


def normalise_directory(path: str) -> str | None:
    """Backslashes, lower case, no blanks around and no closing backslash; None for nothing or a bare drive."""
    p = path.strip().replace("/", "\\").translate(str.maketrans(UPPER, LOWER)).rstrip("\\")
    return None if not p or (len(p) == 2 and p[1] == ":") else p


def highlights(name: str, needles: list[str], fold: bool = True) -> Column:
    """Sorted, merged [start, end) ranges of all, also overlapping, occurrences of the needles in a column.

    One SQL text: it takes one call where the same of Column objects takes hundreds, which is a search's latency.
    """
    table = str.maketrans(UPPER, LOWER)
    found = list(dict.fromkeys(n.translate(table) if fold else n for n in needles if n))
    if not found:
        return F.expr("cast(array() as array<array<int>>)")
    hay = f"translate(`{name}`, '{UPPER}', '{LOWER}')" if fold else f"`{name}`"
    starts = "array_sort(concat(" + ", ".join(f"transform(filter(sequence(1, greatest(length({hay}) - {len(n) - 1}, 1)), i -> substr({hay}, i, {len(n)}) = '{quoted(n)}'), i -> struct(i - 1 as s, i + {len(n) - 1} as e))" for n in found) + "))"
    last = "element_at(acc, -1)"
    joined = f"concat(slice(acc, 1, size(acc) - 1), array(array({last}[0], greatest({last}[1], r.e))))"
    return F.expr(f"aggregate({starts}, cast(array() as array<array<int>>), (acc, r) -> if(size(acc) > 0 and r.s <= try_element_at(acc, -1)[1], {joined}, concat(acc, array(array(r.s, r.e)))))")


def quoted(text: str) -> str:
    """A text inside single quotes of SQL."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def all_highlights(name: Column, needles: list[str], regexes: list[str], romanised: list[str]) -> Column:
    """Sorted, merged [start, end) ranges of needles, of what regular expressions match, and of names by romanised spelling; for a page of hits."""
    from .pinyin import matches, readings

    table = readings() if romanised else {}
    kinds = [re.compile(re.escape(n), re.IGNORECASE | re.ASCII) for n in needles if n] + [re.compile(r) for r in regexes]

    @F.pandas_udf("array<array<int>>")
    def run(names: pd.Series) -> pd.Series:
        def one(n):
            spans = [m.span() for k in kinds for m in k.finditer(n or "") if m.end() > m.start()]
            spans += [x for r in romanised if (x := matches(n or "", r, table))]
            out: list[list[int]] = []
            for s, e in sorted(spans):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            return out

        return names.map(one)

    return run(name)
