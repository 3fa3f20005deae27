"""Searching file contents, whatever their encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger contents are never searched.
CONTENT_LIMIT = 100 << 20


def encoding_of(data: bytes) -> str | None:
    """utf-8, utf-16-le, utf-16-be, latin-1 or None (binary): by byte order mark, then by where zero bytes are, then by control bytes."""
    head = data[:4096]
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    if head.startswith(b"\xff\xfe"):
        return "utf-16-le"
    if head.startswith(b"\xfe\xff"):
        return "utf-16-be"
    even, odd = head[::2].count(0), head[1::2].count(0)
    if even + odd > len(head) // 5:
        return "utf-16-le" if odd > 4 * even else "utf-16-be" if even > 4 * odd else None
    if sum(b < 9 or 13 < b < 32 for b in head) > len(head) // 10:
        return None
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin-1"


def text_contains(content: Column, needle: str) -> Column:
    """A text column contains the needle; A-Z fold."""
    from .text import LOWER, UPPER, ascii_lower

    return (F.octet_length(content) <= CONTENT_LIMIT) & ascii_lower(content).contains(needle.translate(str.maketrans(UPPER, LOWER)))


def binary_contains(content: Column, needle: str, encoding: str | None = None) -> Column:
    """A binary column contains the needle in its own encoding (sniffed if not given); A-Z fold."""
    from .text import LOWER, UPPER

    fold = str.maketrans(UPPER, LOWER)
    low = needle.translate(fold)

    @F.pandas_udf("boolean")
    def run(datas: pd.Series) -> pd.Series:
        def one(d):
            kind = d is not None and (encoding or encoding_of(d))
            return bool(kind) and low in d.decode(kind, "replace").translate(fold)

        return datas.map(one)

    return F.when(F.octet_length(content) <= CONTENT_LIMIT, run(content)).otherwise(F.lit(False))
