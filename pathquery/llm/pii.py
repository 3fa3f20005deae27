"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, digits, plus signs before a digit, schemes and cue words); a local parser
for each kind of anchor then expands to the left and right, and validates.  Kinds:

base    email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (a plus, 9 to 15 digits)
added   iban (after its cue; mod 97), account (digits after a cue), secret (a value assigned to a token, password or key),
        login (user:password@ after a scheme), tel (digits after tel:)

Spans of a kind never overlap; those of different kinds may.  Offsets are code points, ends exclusive.  Defined results:
null text counts as the empty text (no spans); repeated rows are each searched; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices

#: The order of kinds in joined spans.
KINDS = ("email", "ip", "card", "phone", "iban", "account", "secret", "login", "tel")
BASE = KINDS[:4]
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[\s:#.-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|num|id))?\.?[\s:#=]{1,3}([0-9]{6,17})(?![0-9])", re.I)
SECRET = re.compile(r"[\"']?\s?[=:]\s?[\"']?([^\s\"']{8,})[\"']?")
LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@")
TEL = re.compile(r"(\+?[0-9](?:[\x20().-]?[0-9]){6,14})")
CUES = {"iban": ("iban",), "account": ("account", "acct", "konto", "ssn"), "secret": ("token", "password", "passwd", "api_key", "apikey", "secret"), "tel": ("tel:",)}
DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Finder:
    def __init__(self):
        a = ahocorasick.Automaton()
        for d in DIGITS:
            a.add_word(d, ("digit", 1))
            a.add_word("+" + d, ("phone", 2))
        a.add_word("@", ("at", 1))
        a.add_word("://", ("scheme", 3))
        for kind, cues in CUES.items():
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    a.add_word(form, (kind, len(form)))
        a.make_automaton()
        self.anchors = a

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all kinds, by start and then by KINDS."""
        out: list[tuple[int, int, str]] = []
        if not text:
            return out
        past = dict.fromkeys(KINDS, 0)
        for last, (kind, n) in self.anchors.iter(text):
            at = last + 1 - n
            if kind == "digit":
                if at >= past["ip"]:
                    self._ips(text, at, out, past)
                if at >= past["card"] and (m := CHAIN.match(text, at)):
                    past["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), "card"))
            elif kind == "at":
                start, least = at, past["email"]
                while start > least and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    out.append((start, m.end(), "email"))
                    past["email"] = m.end()
            elif kind == "phone":
                if at >= past["phone"] and (m := PHONE.match(text, at)):
                    past["phone"] = m.end()
                    if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                        out.append((at, m.end(), "phone"))
            else:
                self._cue(text, kind, at, last + 1, out, past)
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    @staticmethod
    def _ips(text, at, out, past) -> None:
        """A chain of dotted numbers, four at a time."""
        m = DOTTED.match(text, at)
        past["ip"] = m.end()
        parts, place = m[0].split("."), at
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((place, end, "ip"))
            place = end + 1

    @staticmethod
    def _cue(text, kind, at, end, out, past) -> None:
        if kind == "scheme":
            kind, m = "login", LOGIN.match(text, end)
            ok = bool(m)
        elif kind == "iban":
            m = IBAN.match(text, end)
            ok = bool(m) and mod97(m[1])
        elif kind == "account":
            m = ACCOUNT.match(text, end)
            ok = bool(m)
        elif kind == "secret":
            m = SECRET.match(text, end)
            ok = bool(m) and any(c in DIGITS for c in m[1])
        else:
            m = TEL.match(text, end)
            ok = bool(m)
        if ok and m.start(1) >= past[kind]:
            past[kind] = m.end(1)
            out.append((m.start(1), m.end(1), kind))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str | None, spans) -> str | None:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    if not spans:
        return text
    runs: list[list] = []
    for s, e, k in spans:
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e, k])
    out, at = [], 0
    for s, e, k in runs:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), mask: bool = False) -> DataFrame:
    """Counts of base kinds, base_sha256, base_spans and spans of every text; with `mask`, the masked text as well.

    keep: further columns of df that the result carries along.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kind[c]}" for c in (id_col, *keep)) + ", " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, base_spans string, spans string" + f", {text_col} string" * mask

    def make():
        finder = Finder()

        def run(part: pa.RecordBatch) -> dict:
            texts = part.column(text_col).to_pylist()
            found = [finder.spans(t) for t in texts]
            base = [[s for s in x if s[2] in BASE] for x in found]
            out = {c: part.column(c) for c in (id_col, *keep)}
            out |= {f"n_{k}": [sum(s[2] == k for s in x) for x in base] for k in BASE}
            out["base_spans"] = [joined(x) for x in base]
            out["base_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out["base_spans"]]
            out["spans"] = [joined(x) for x in found]
            return out | ({text_col: [masked(t, x) for t, x in zip(texts, found)]} if mask else {})

        return run

    return map_slices(df, [id_col, *keep, text_col], text_col, schema, make)
