"""Finding Chinese names by their romanised spelling.

A needle of Latin letters matches a run of characters if it is a mix of, for each character, its full reading, its
initial letter, or the character itself.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Further readings of characters that have several.
READINGS = {
    "朝": ("chao", "zhao"), "行": ("xing", "hang"), "长": ("chang", "zhang"), "重": ("zhong", "chong"), "乐": ("le", "yue"), "音": ("yin",),
    "都": ("du", "dou"), "会": ("hui", "kuai"), "单": ("dan", "shan"), "曾": ("zeng", "ceng"), "还": ("hai", "huan"), "调": ("diao", "tiao"),
}
FIRST, LAST = 0x4E00, 0x9FFF
_tables: dict[str, dict[str, tuple[str, ...]]] = {}


def readings() -> dict[str, tuple[str, ...]]:
    """Readings of all characters of the main block, without tones, from the transliterator (Unicode's data, in ICU) that Spark ships; a u with dots is u or v."""
    if "all" not in _tables:
        from pyspark.sql import SparkSession

        jvm = SparkSession.active()._jvm
        chars = [chr(c) for c in range(FIRST, LAST + 1)]
        latin = jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin").transliterate("\n".join(chars)).split("\n")
        out = {}
        for c, r in zip(chars, latin):
            plain = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", r.strip().lower()) if not unicodedata.combining(x) or x == "\u0308"))
            found = [plain.replace("ü", "u"), plain.replace("ü", "v"), *READINGS.get(c, ())]
            out[c] = tuple(dict.fromkeys(x for x in found if re.fullmatch("[a-z]+", x)))
        _tables["all"] = out
    return _tables["all"]


def ends(name: str, needle: str, start: int, table: dict) -> set[int]:
    """Ends of matches of the whole needle that begin at a place of the (lower-case) name."""
    states = {0: {start}}
    out: set[int] = set()
    todo = [(start, 0)]
    while todo:
        at, used = todo.pop()
        if used == len(needle):
            out.add(at)
            continue
        if at == len(name):
            continue
        c = name[at]
        for r in (c, *(x for full in table.get(c, ()) for x in (full, full[0]))):
            nxt = (at + 1, used + len(r))
            if needle.startswith(r, used) and nxt[0] not in states.setdefault(nxt[1], set()):
                states[nxt[1]].add(nxt[0])
                todo.append(nxt)
    return out


def matches(name: str, needle: str, table: dict | None = None) -> tuple[int, int] | None:
    """The leftmost match (its longest) of a lower-case needle."""
    low, table = name.lower(), readings() if table is None else table
    for start in range(len(low)):
        if found := ends(low, needle, start, table):
            return start, max(found)
    return None


def pinyin_contains(name: Column, needle: str) -> Column:
    """Python sees only names with Chinese characters."""
    table = readings()

    @F.pandas_udf("boolean")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: n is not None and matches(n, needle, table) is not None)

    return F.when(name.rlike("[\\u4e00-\\u9fff]"), run(name)).otherwise(F.lit(False))
