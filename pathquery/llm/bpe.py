"""Byte-level BPE encoding and decoding by length-bucketed padded matrices.

The pre-tokens of a slice of texts that are not yet known are laid out in numpy matrices, one for each bucket of
lengths; in each round every row merges its leftmost pair of minimum rank, ranks come from a hashed pair table, and rows
that have no pair left go (compaction).  Pre-tokens longer than MAX_WIDTH bytes take a heap instead: the same merges in
the same order without a matrix as wide as the text.

Defined results: null text counts as the empty text (no tokens); repeated rows are encoded each; an empty table gives an
empty table; other columns than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import LongMap, map_slices

NONE = np.int32(2**31 - 1)
MAX_WIDTH = 256
#: Pre-tokens that a task remembers; beyond that it starts anew.
CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PairTable:
    """(left id, right id) -> id of the merged token, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, vals = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(rank)
        self.map = LongMap(np.array(keys, np.int64), np.array(vals, np.int32), NONE)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where the pair is unknown or a side is padding (negative)."""
        out = np.full(left.shape, NONE, np.int32)
        real = (left >= 0) & (right >= 0)
        out[real] = self.map.find(left[real].astype(np.int64) << 32 | right[real].astype(np.int64))
        return out


class ByteBPE:
    """Encodes pre-tokens to ids and ids back to bytes; a merged pair's id is its rank, as in tiktoken."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.tokens = {i: t for t, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ids: dict[str, tuple[int, ...]] = {}
        self.text: dict[str, str] = {}

    def _matrix(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width), -1, np.int32)
        ids[np.arange(width) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        out: list = [None] * len(words)
        row = np.arange(len(words))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1)  # the first, so the leftmost, of equal ranks
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for r, x in zip(row[done].tolist(), ids[done].tolist()):
                    out[r] = tuple(x[: x.index(-1)] if x[-1] < 0 else x)
                go = ~done
                row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    break
                wide = int((ids >= 0).sum(axis=1).max())
                ids, rank = ids[:, :wide], rank[:, : wide - 1]
            n, w = ids.shape
            r, pad = np.arange(n), np.full((n, 1), -1, np.int32)
            later = np.arange(w) > at[:, None]
            ids = np.where(later, np.hstack([ids[:, 1:], pad]), ids)
            ids[r, at] = best
            rank = np.where(later[:, : w - 1], np.hstack([rank[:, 1:], pad * 0 + NONE]), rank)
            right = np.where(at + 1 < w, ids[r, np.minimum(at + 1, w - 1)], -1)
            inside = at < w - 1
            rank[r[inside], at[inside]] = self.pairs.find(best, right)[inside]
            left = at > 0
            rank[r[left], at[left] - 1] = self.pairs.find(ids[r[left], at[left] - 1], best[left])
        return out

    def _heap(self, word: bytes) -> tuple[int, ...]:
        """One long pre-token: a heap of (rank, place) over a linked list of parts."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        n, ids = len(ids), ids.tolist()
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(int(k), i) for i, k in enumerate(first) if k != NONE]
        heapq.heapify(heap)
        token, ranks = self.tokens, self.ranks

        def rank(i: int):
            return ranks.get(token[ids[i]] + token[ids[after[i]]]) if i >= 0 and after[i] < n else None

        while heap:
            k, i = heapq.heappop(heap)
            if not live[i] or rank(i) != k:
                continue
            j = after[i]
            ids[i], live[j], after[i] = k, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if (k := rank(x)) is not None:
                    heapq.heappush(heap, (k, x))
        return tuple(x for x, on in zip(ids, live) if on)

    def learn(self, words, few: int = 0) -> None:
        """Encodes the pre-tokens that aren't known; up to `few` of them without matrices."""
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.text.clear()
        new = [w for w in words if w not in self.ids]
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            b = w.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.ids[w] = (whole,)
            elif len(b) > MAX_WIDTH or len(new) <= few:
                self.ids[w] = self._heap(b)
            else:
                buckets.setdefault(1 << (len(b) - 1).bit_length(), []).append((w, b))
        for width, pairs in buckets.items():
            for at in range(0, len(pairs), step := max(1, (1 << 20) // width)):
                part = pairs[at : at + step]
                self.ids.update(zip((w for w, _ in part), self._matrix([b for _, b in part], width)))
        self.text.update((w, " ".join(map(str, self.ids[w]))) for w in new)

    def encode_all(self, texts: list[str | None]):
        """For each text its pre-tokens and ids, as lists."""
        split = [self.split.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        known = self.ids
        for words in split:
            yield words, list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: What encode_decode() can return of each text.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs=("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encodes every text and decodes its ids again; returns the id and the chosen OUTPUTS.

    The rank file is read by the driver and sent along (its size is that of the vocabulary).
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def make():
        coder = ByteBPE(ranks.value, pattern)

        def run(part: pa.RecordBatch) -> dict:
            out = {c: [] for c in outputs}
            for words, ids in coder.encode_all(part.column(1).to_pylist()):
                raw = coder.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
                for c, put in out.items():
                    put.append(len(ids) if c == "n_tokens" else ids if c == "ids" else raw if c == "decoded" else sha(raw) if c == "decoded_sha256" else sha(" ".join(map(coder.text.__getitem__, words)).encode()))
            return {id_col: part.column(0)} | out

        return run

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df, [id_col, text_col], text_col, f"{id_col} {kind}, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs), make)
