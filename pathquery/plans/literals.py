"""Values of the query language: sizes, dates, attributes, ranges, globs and extension groups."""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from .. import QueryError
from ..functions.text import ARCHIVE, DIR, HIDDEN, READONLY, SYSTEM

#: Extensions of each group.
GROUPS = {
    "audio": "mp3 wav flac aac ogg wma m4a",
    "video": "mp4 mkv avi mov wmv flv webm mpeg mpg",
    "pic": "jpg jpeg png gif bmp webp tif tiff ico heic",
    "doc": "doc docx pdf txt md rtf xls xlsx ppt pptx csv",
    "zip": "zip rar 7z tar gz bz2 xz cab",
    "exe": "exe msi bat cmd",
}
#: Bounds of named sizes, both inclusive.
SIZES = {
    "empty": (0, 0), "tiny": (0, 16 << 10), "small": (16 << 10, 1 << 20), "medium": (1 << 20, 32 << 20), "large": (32 << 20, 128 << 20),
    "huge": (128 << 20, 1 << 30), "gigantic": (1 << 30, None),
}
UNITS = {"": 1, "b": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}
ATTRIBUTES = {"r": READONLY, "h": HIDDEN, "s": SYSTEM, "a": ARCHIVE, "d": DIR}
Bounds = tuple[int | None, int | None]


def parse_bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in UNITS:
        raise QueryError(f"not a size: {text!r}")
    return min(int(m[1]) * UNITS[m[2]], 2**63 - 1)


def bounds(text: str, low, high, bare) -> Bounds:
    """>x, >=x, <x, <=x (all inclusive), a..b with either side open, or a bare value."""
    t = text.strip()
    if ".." in t:
        a, b = t.split("..", 1)
        if not a and not b:
            raise QueryError(f"not a range: {text!r}")
        return (low(a) if a else None), (high(b) if b else None)
    for op in (">=", "<=", ">", "<"):
        if t.startswith(op):
            v = t[len(op) :]
            return (low(v), None) if op[0] == ">" else (None, high(v))
    return bare(t)


def parse_size(text: str) -> Bounds:
    if text.lower() in SIZES:
        return SIZES[text.lower()]
    return bounds(text, parse_bytes, parse_bytes, lambda t: (parse_bytes(t), None))


def whole(text: str) -> int:
    if not re.fullmatch(r"\d+", text.strip()):
        raise QueryError(f"not a number: {text!r}")
    return int(text)


def parse_number(text: str) -> Bounds:
    return bounds(text, whole, whole, lambda t: (whole(t), whole(t)))


def day_span(text: str, zone: ZoneInfo) -> tuple[int, int]:
    """First and last second of YYYY-MM-DD, YYYY-MM or YYYY."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", text.strip())
    try:
        a = date(int(m[1]), int(m[2] or 1), int(m[3] or 1))
    except (TypeError, ValueError):
        raise QueryError(f"not a date: {text!r}") from None
    b = a + timedelta(1) if m[3] else date(a.year + (a.month == 12), a.month % 12 + 1, 1) if m[2] else date(a.year + 1, 1, 1)
    return seconds(a, zone), seconds(b, zone) - 1


def seconds(d: date, zone: ZoneInfo) -> int:
    return int(datetime.combine(d, time(), zone).timestamp())


def parse_date(text: str, now: datetime) -> Bounds:
    """Relative words are resolved by the given clock and its zone."""
    zone, today = now.tzinfo, now.date()
    week, month = today - timedelta(today.weekday()), today.replace(day=1)
    before = (month - timedelta(1)).replace(day=1)
    at = lambda d: seconds(d, zone)
    words = {
        "today": (today, None), "yesterday": (today - timedelta(1), today), "thisweek": (week, today + timedelta(1)), "lastweek": (week - timedelta(7), week),
        "thismonth": (month, None), "lastmonth": (before, month), "thisyear": (today.replace(month=1, day=1), None), "lastyear": (date(today.year - 1, 1, 1), date(today.year, 1, 1)),
    }
    if (t := text.strip().lower()) in words:
        a, b = words[t]
        return at(a), None if b is None else at(b) - 1
    return bounds(text, lambda v: day_span(v, zone)[0], lambda v: day_span(v, zone)[1], lambda v: day_span(v, zone))


def parse_attributes(text: str) -> int:
    """Unknown letters are ignored."""
    return sum({ATTRIBUTES[c] for c in text.lower() if c in ATTRIBUTES})


def glob_to_regex(glob: str) -> str:
    """The whole name; * any run, ? one character, [..] and [!..] sets."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" if body[0] == "!" else "") + re.sub(r"[\\\[\]^&]", r"\\\g<0>", body.removeprefix("!")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def parse_regex(text: str) -> str:
    """A pattern of the subset that look-around-free engines share."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", text):
        raise QueryError("look-around and back-references aren't supported")
    try:
        re.compile(text)
    except re.error as e:
        raise QueryError(f"bad pattern {text!r}: {e}") from None
    return text
