"""One object for a catalogue: search, count, status and JSON requests."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from . import PathQueryError
from .operators import build, search as S


class Engine:
    def __init__(self, entries: DataFrame, contents: DataFrame | None = None, metadata_ready: bool = True):
        self.entries, self.contents, self.metadata_ready = entries, contents, metadata_ready

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> "Engine":
        entries, excluded = build.load(spark, path)
        return cls(build.exclude(entries, excluded), **options)

    def _options(self, pinyin: bool, now: datetime | None) -> dict:
        return {"contents": self.contents, "pinyin": pinyin, "metadata_ready": self.metadata_ready, "now": now}

    def search(self, query: str, limit: int = 500, offset: int = 0, pinyin: bool = False, now: datetime | None = None) -> DataFrame:
        return S.search(self.entries, query, limit, offset, **self._options(pinyin, now))

    def client(self, text: str, search_flags: int = 0, sort: int = 1, offset: int = 0, maximum: int = S.CLIENT_HITS, request_flags: int = 1 | 2) -> DataFrame:
        """A request in the numbers of the client protocol."""
        return S.client_search(self.entries, text, search_flags, sort, offset, maximum, request_flags, contents=self.contents, metadata_ready=self.metadata_ready)

    def count(self, query: str, pinyin: bool = False, now: datetime | None = None) -> int:
        return S.total(self.entries, query, **self._options(pinyin, now))

    def status(self) -> dict:
        return build.status(self.entries).first().asDict() | {"metadata_ready": self.metadata_ready}

    def handle(self, request: str) -> str:
        """A JSON request (search, status or ping) to a JSON reply; failures are replies of type error."""
        try:
            r = json.loads(request)
            if r["type"] == "ping":
                return json.dumps({"type": "pong"})
            if r["type"] == "status":
                return json.dumps({"type": "status_result"} | self.status())
            if r["type"] != "search":
                raise PathQueryError(f"unknown request {r['type']!r}")
            rows = self.search(r.get("query", ""), r.get("limit") or 500, r.get("offset", 0), r.get("pinyin", False)).collect()  # a page
            return json.dumps({"type": "search_result", "total": self.count(r.get("query", ""), r.get("pinyin", False)), "hits": [x.asDict(True) for x in rows]}, ensure_ascii=False)
        except (PathQueryError, KeyError, ValueError) as e:
            return json.dumps({"type": "error", "message": str(e)})
