"""Benchmark decontamination by latent semantic retrieval.

Words (A-Z lowered, ASCII punctuation dropped) are hashed to FEATURES features; texts are cut into halves of HALF words,
and two neighbouring halves are a passage.  Three passes over all texts:

1. document frequencies of features (idf);
2. a distributed randomised SVD of the TF-IDF matrix A of all passages: each task adds up its rows' share of A'(A R) for
   a random R (sparse signs: SIGNS of them for a feature), and the driver, which only ever holds FEATURES x RANK numbers, gets singular values and vectors from
   A'A ~ Y (R'Y)^-1 Y' (Nystroem);
3. each item is placed at the beginning of each half: the longest common subsequence of the item's words and of the text
   from one half before to three halves behind that place decides, with an answer check: the item's last sentence.  Only
   regions that share too few words with the item for that subsequence (words counted with repeats, which is an upper
   bound of it) skip it, so that no pair is lost.  Passages and parts of the item there are projected to whitened latent
   vectors; their highest cosine is reported and excludes nothing (a cosine of 0.4 as a condition lost a fifth of the pairs).

A text contains an item if LCS / item words is at least SURE, or at least LIKELY and the answer's words are there by the
same measure of at least ANSWER.  Benchmark items are the stated query set: they are taken in blocks of ITEMS, each sent
to all tasks.

Defined results: null and empty texts and items contain nothing and match nothing; repeated rows are each reported; an
empty benchmark or an empty table gives an empty result; items of fewer words than SHORT must be there in full.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_slices, slices, word_hashes

FEATURES, HALF, RANK, SIGNS = 1 << 13, 12, 64, 4
SURE, LIKELY, ANSWER, SHORT = 0.7, 0.5, 0.8, 8
ITEMS = 2_000
#: Rows of Y to a message between tasks.
CHUNK = 256
#: Texts whose features are marked, and words that are added up at a time in the first two passes.
TEXTS, ROWS = 256, 8_192
#: Slots for the hashes of items' words, and counts of words in halves that are held at a time.
SLOTS, CELLS = 1 << 20, 1 << 24
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz     ")
_drop = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def cleaned(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_lower, _drop)


def words(text: str | None) -> list[bytes]:
    return cleaned(text).split()


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all words of cleaned texts, and each text's number of words."""
    h, counts = word_hashes(texts)
    return (h >> np.uint64(32)).astype(np.int64), counts


def halves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half begins in the words of all texts, and how many halves each text has (none without words), of numbers of words."""
    n = -(-counts // HALF)
    first = np.cumsum(n) - n
    return np.repeat(np.cumsum(counts) - counts, n) + (np.arange(n.sum()) - np.repeat(first, n)) * HALF, n


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    kinds = arrow_schema("feature long, n long")

    def count(batches):
        n, docs = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for part in slices(batch, text_col, 1_000_000):
                for i in range(0, part.num_rows, TEXTS):
                    h, counts = hashed([cleaned(t) for t in part.column(0).slice(i, TEXTS).to_pylist()])
                    there = np.zeros((len(counts), FEATURES), bool)
                    there[np.repeat(np.arange(len(counts)), counts), h % FEATURES] = True
                    n += there.sum(axis=0)
                    docs += len(counts)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], docs))], schema=kinds)

    rows = df.select(text_col).mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES, np.int64)
    own = rows.feature >= 0
    out[rows.feature[own]] = rows.n[own]
    return out, int(rows.n[~own].sum())


def right_vectors(df: DataFrame, text_col: str, idf: np.ndarray) -> np.ndarray:
    """FEATURES x RANK: whitened right singular vectors of the TF-IDF matrix of all passages, times idf."""
    rng = np.random.Generator(np.random.PCG64(11))
    column, sign = rng.integers(0, RANK, (SIGNS, FEATURES)), rng.choice([-1.0, 1.0], (SIGNS, FEATURES))
    r = np.zeros((FEATURES, RANK))
    for k in range(SIGNS):
        np.add.at(r, (np.arange(FEATURES), column[k]), sign[k])
    sent = df.sparkSession.sparkContext.broadcast((column, sign, idf))
    schema = "chunk long, sum binary"
    kinds = arrow_schema(schema)

    def add(batches):
        column, sign, weight = sent.value
        y = np.zeros((FEATURES, RANK))
        for batch in batches:
            for part in slices(batch, text_col, 1_000_000):
                h, n_words = hashed([cleaned(t) for t in part.column(0).to_pylist()])
                if not len(h):
                    continue
                f, (starts, counts) = h % FEATURES, halves(n_words)
                # passages that don't overlap: halves 0+1, 2+3, ... of each text
                first = np.cumsum(counts) - counts
                begin = starts[(np.arange(len(starts)) - np.repeat(first, counts)) % 2 == 0]
                n = len(begin)
                mine = np.repeat(np.arange(n), np.diff(np.append(begin, len(f))))
                w = weight[f]
                w = w / np.sqrt(np.add.reduceat(w * w, begin))[mine]
                p = sum(np.bincount(mine * RANK + column[k][f], w * sign[k][f], n * RANK) for k in range(SIGNS)).reshape(n, RANK).astype(np.float32)
                # words in the order of their features, so that a run of rows adds up to a row of y
                order = np.argsort(f.astype(np.int16), kind="stable")
                f, w, mine = f[order], w[order].astype(np.float32), mine[order]
                for at in range(0, len(f), ROWS):
                    own = f[at : at + ROWS]
                    x = p[mine[at : at + ROWS]]
                    x *= w[at : at + ROWS, None]
                    runs = np.flatnonzero(np.diff(own, prepend=-1))
                    y[own[runs]] += np.add.reduceat(x, runs, axis=0)
        for c in range(0, FEATURES, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([y[c : c + CHUNK].astype(np.float32)[: FEATURES - c].tobytes()])], schema=kinds)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, np.float32)
                sums[c] = sums[c] + x if c in sums else x.astype(np.float64)
        for c, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([x.astype(np.float32).tobytes()])], schema=kinds)

    parts = df.select(text_col).mapInArrow(add, schema)
    # two levels, so that no task adds up what all tasks have sent
    wide = parts.repartition(max(32, df.sparkSession.sparkContext.defaultParallelism), "chunk", F.spark_partition_id() % 16).mapInArrow(total, schema)
    got = wide.repartition(FEATURES // CHUNK, "chunk").mapInArrow(total, schema).collect()
    y = np.zeros((FEATURES, RANK))
    for c, data in got:
        x = np.frombuffer(bytes(data), np.float32).reshape(-1, RANK)
        y[c : c + len(x)] = x
    out = np.zeros((FEATURES, RANK), np.float32)
    if not y.any():
        return out
    small = r.T @ y
    val, vec = np.linalg.eigh((small + small.T) / 2)
    keep = val > val.max() * 1e-9
    b = y @ (vec[:, keep] / np.sqrt(val[keep]))
    u, s, _ = np.linalg.svd(b, full_matrices=False)
    good = s > s[0] * 1e-5
    out[:, : good.sum()] = u[:, good] / s[good]
    return out * idf[:, None].astype(np.float32)


def places(a: list[bytes]) -> dict[bytes, int]:
    """Where each word is, as bits."""
    out: dict[bytes, int] = {}
    for i, w in enumerate(a):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(a: list[bytes], b: list[bytes], at: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; at: places(a), if they are known."""
    full = (1 << len(a)) - 1
    row = full
    for m in map((places(a) if at is None else at).get, b):
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence."""
    for s in reversed(re.split(r"(?<=[.!?])\s+", text.strip())):
        if ws := words(s):
            return ws
    return []


def windows(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of `width` neighbours, at each place of a row of cells."""
    out, at, size, n = None, 0, 1, len(x) - width + 1
    while True:
        if width & size:
            out = x[at : at + n].copy() if out is None else np.add(out, x[at : at + n], out=out)
            at += size
        size *= 2
        if size > width:
            return out
        x = x[: -size // 2] + x[size // 2 :]


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str], vectors: np.ndarray):
        self.ids, self.words, self.answers = ids, [words(t) for t in texts], [answer_of(t) for t in texts]
        self.places = [places(ws) for ws in self.words]
        self.vectors = vectors
        self.length = np.array([len(ws) for ws in self.words], np.int64)
        self.least = np.where(self.length < SHORT, self.length, np.ceil(LIKELY * self.length)).astype(np.int64)
        # words of items by their slots, and how often each is in an item; words that share a slot count as one, which only raises a bound
        h, _ = hashed([cleaned(t) for t in texts])
        cut = np.split(h, np.cumsum(self.length)[:-1])
        slots = np.unique(h % SLOTS)
        self.row = np.full(SLOTS, len(slots), np.int32)
        self.row[slots] = np.arange(len(slots), dtype=np.int32)
        self.rows = len(slots)
        self.own = []  # an item's rows; and which of them it has a second, third, ... time
        for x in cut:
            rows, n = np.unique(self.row[x % SLOTS], return_counts=True)
            more = [(j, k) for j, m in enumerate(n.tolist()) for k in range(2, m + 1)]
            self.own.append((rows, np.array([j for j, _ in more], np.int64), np.array([k for _, k in more], np.int64)))
        self.end = 3 + -(-self.length // HALF)  # halves from a place's own to behind its region
        step = 2 * HALF
        self.parts = [np.array(sorted({*range(0, max(1, n - step + 1), step), max(0, n - step)})) for n in self.length.tolist()]
        self.queries = [unit(np.stack([vectors[x[at : at + step] % FEATURES].sum(axis=0) for at in o.tolist()])) for x, o in zip(cut, self.parts)]

    def near(self, h: np.ndarray, starts: np.ndarray):
        """(half, item) arrays of places whose regions share enough words with the item, counted with repeats: no common subsequence is longer than that.

        Regions are widened to whole halves, and run on into the next text: that only raises the bound, so that nothing is lost.
        """
        row = self.row[h % SLOTS]
        half = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        known = np.flatnonzero(row < self.rows)
        row, half, after = row[known].astype(np.int64), half[known], int(self.end.max())
        block = max(64, CELLS // self.rows)
        for at in range(0, len(starts), block):
            size = min(block, len(starts) - at)
            wide = size + after + 1  # with the half before
            lo, hi = np.searchsorted(half, (at - 1, at - 1 + wide))
            cells, n = np.unique(row[lo:hi] * wide + half[lo:hi] - (at - 1), return_counts=True)
            there = np.zeros((self.rows, wide), np.uint8)
            there.ravel()[cells] = n
            found = []
            for i, (rows, more, often) in enumerate(self.own):
                kind = np.uint8 if (self.end[i] + 1) * HALF < 256 else np.uint32
                x = there[rows].astype(kind, copy=False)
                # all rows at once; sums that run on into the next row are behind the places that count
                x.ravel()[: x.size - self.end[i]] = windows(x.ravel(), int(self.end[i]) + 1)
                total = np.add.reduce((x[:, :size] > 0).view(np.uint8), axis=0, dtype=kind)
                if len(more):
                    total += np.add.reduce((x[more, :size] >= often.astype(kind)[:, None]).view(np.uint8), axis=0, dtype=kind)
                p = np.flatnonzero(total >= self.least[i])
                found.append((p + at, np.full(len(p), i)))
            yield tuple(np.concatenate(x) for x in zip(*found))

    def cosine(self, f: np.ndarray, i: int, begins: list[int]) -> float:
        """The highest cosine in the latent space of item i's parts and the passages that they would be at, with the item beginning at the words `begins` of a text with features f."""
        best = -1.0
        for q, o in zip(self.queries[i], self.parts[i].tolist()):
            for at in {max(0, b + o) // HALF * HALF for b in begins}:
                z = self.vectors[f[at : at + 2 * HALF]].sum(axis=0)
                best = max(best, float(q @ z) / max(1e-30, float(np.linalg.norm(z))))
        return best

    def search(self, texts: list[str | None]):
        """(text number, item number, cosine, LCS share, answer share, first word) of what is contained."""
        clean = [cleaned(t) for t in texts]
        h, lengths = hashed(clean)
        if not len(h):
            return
        starts, counts = halves(lengths)
        text, begin = np.repeat(np.arange(len(counts)), counts), np.cumsum(lengths) - lengths
        best: dict[tuple[int, int], list[int]] = {}
        for p, i in self.near(h, starts):
            d = text[p]
            for *key, at in zip(d.tolist(), i.tolist(), (starts[p] - begin[d]).tolist()):
                best.setdefault(tuple(key), []).append(at)
        split: dict[int, list[bytes]] = {}
        for (d, i), shifts in sorted(best.items()):
            item, top = self.words[i], None
            if d not in split:
                split = {d: clean[d].split()}
            for shift in sorted(shifts):
                lo = max(0, shift - HALF)
                region = split[d][lo : shift + len(item) + 3 * HALF]
                share = common_subsequence(item, region, self.places[i]) / len(item)
                answer = common_subsequence(self.answers[i], region) / max(1, len(self.answers[i])) if share >= LIKELY else 0.0
                contained = share >= (1.0 if len(item) < SHORT else SURE) or len(item) >= SHORT and share >= LIKELY and answer >= ANSWER
                if contained and (top is None or share > top[0]):
                    top = (share, answer, lo)
            if top is not None:
                f = h[begin[d] : begin[d] + lengths[d]] % FEATURES
                yield d, i, self.cosine(f, i, shifts), *top


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, cosine, lcs_share, answer_share, first_word) for each text and benchmark item that it contains."""
    spark = df.sparkSession
    seen, docs = document_frequencies(df, text_col)
    idf = np.log((1 + docs) / (1 + seen)) + 1
    vectors = right_vectors(df, text_col, idf)
    kind = df.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {item_kind}, cosine double, lcs_share double, answer_share double, first_word long"
    items = benchmark.select(F.col(item_col), F.col(item_text_col)).filter(F.length(F.trim(F.col(item_text_col))) > 0)
    n_blocks = max(1, -(-items.count() // ITEMS))
    out = spark.createDataFrame([], schema)
    for block in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(n_blocks)) == block).orderBy(item_col, item_text_col).collect()
        rows = [r for r in rows if words(r[1])]
        if rows:
            sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], vectors))  # ITEMS items, about

            def make(sent=sent):
                def run(part: pa.RecordBatch) -> dict:
                    found = list(sent.value.search(part.column(1).to_pylist()))
                    ids = part.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                    return {id_col: ids, item_col: [sent.value.ids[x[1]] for x in found], "cosine": [x[2] for x in found], "lcs_share": [x[3] for x in found], "answer_share": [x[4] for x in found], "first_word": [x[5] for x in found]}

                return run

            out = out.union(map_slices(df, [id_col, text_col], text_col, schema, make, 1_000_000)) if block else map_slices(df, [id_col, text_col], text_col, schema, make, 1_000_000)
    return out
