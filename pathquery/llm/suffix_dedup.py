"""Removal of long repeated byte strings with a sorted sample of suffixes.

Every byte that a string of LENGTH bytes covers goes, if that string also starts anywhere else (same text included).

A window of LENGTH bytes is owned by its anchor: the leftmost least of its K-byte hashes.  Equal windows own equal
anchors at equal places, so that only windows of anchors with equal K bytes need comparing, and one suffix for each
anchor (two for every LENGTH - K + 1 bytes of text) stands for all windows that it owns, with their joint text, the
segment, to its left and right.

1. Segments are counted by (anchor hash, segment hash).  Windows of segments that occur twice are repeated.  Segments that
   have over 1 / SHARES of all rows (hence fewer than SHARES) are broadcast to their rows, the others are joined to them.
2. Of anchors with several different segments, one of each is compared.  Their suffixes (from the anchor on) are sorted
   where their text is, into runs that are front-coded (length of the prefix shared with the one before, and the rest),
   and exchanged by anchor; a loser tree merges the runs of a partition.  It keeps with each loser the length of the
   prefix it shares with the winner that beat it, decides unequal lengths without looking at text, and compares equal
   ones from there on, so that no known prefix is compared again.
3. In a group of suffixes with equal K bytes, shared prefixes are minima of neighbours' in the sorted order, and likewise
   to the left in the order of reversed left parts; a pair with left + right >= LENGTH repeats windows, and the furthest
   such left and right bound what goes.
4. Anchors with more than HOT different segments (a passage that a third of all texts share, between different
   neighbours) skip 2 and 3: hashes of all windows of their segments are counted, with a combine before the exchange.

Defined results: null text counts as the empty text; texts under LENGTH bytes lose nothing; repeated rows lose everything
from LENGTH bytes on; rows that repeat an id are told apart by their text; ids may have any type; texts of 2^PLACE bytes
and more are read in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import arrow_schema, block_count, slices, written

LENGTH, K = 400, 32
#: Different segments of an anchor up to which suffixes are sorted and compared in one task.
HOT = 4096
#: A segment with more than this part of all rows is hot, and so are at most as many segments.
SHARES = 4096
#: Bits of places in a slice of texts; the hashes that choose anchors have the rest.
PLACE = 28
#: Segments to a sorted run, at most.
RUN = 20_000
_spread = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


def kmer_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each place on, by doubling."""
    h, size, m = _spread[a], 1, 0x9E3779B97F4A7C15
    while size < K:
        h = h[:-size] * np.uint64(m | 1) + h[size:]
        size, m = size * 2, (m * 0xD6E8FEB86659FD93 + 1) % 2**64
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes]):
    """(text number, anchor, first and last owned window, anchor hash) arrays; places are within the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if sizes.sum() >= 1 << PLACE:  # one very long text: blocks of its windows
        step, out = (1 << PLACE) - LENGTH, []
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text) - LENGTH + 1), step):
                _, *places, h = anchors([text[at : at + step + LENGTH - 1]])
                out.append([np.full(len(h), i), *(x + at for x in places), h])
        return [np.concatenate(x) for x in zip(*out)]
    long_ = np.flatnonzero(sizes >= LENGTH)
    if not len(long_):
        return [np.zeros(0, np.int64)] * 5
    a = np.frombuffer(b"".join(texts[i] for i in long_.tolist()), np.uint8)
    h = kmer_hashes(a)
    mask = np.uint64((1 << PLACE) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    span, size = LENGTH - K + 1, 1
    while size * 2 <= span:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(a) - LENGTH + 1], low[span - size : span - size + len(a) - LENGTH + 1])
    owner = (low & mask).astype(np.int64)
    ends = np.cumsum(sizes[long_])
    starts = ends - sizes[long_]
    text = np.repeat(np.arange(len(long_)), sizes[long_])[: len(owner)]
    valid = np.arange(len(owner)) + LENGTH <= ends[text]
    at = np.flatnonzero(valid)
    own, doc = owner[at], text[at]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])
    d, shift = doc[new], starts[doc[new]]
    return long_[d], own[new] - shift, at[new] - shift, at[last] - shift, h[own[new]].view(np.int64)


ANCHOR = "d long, th long, pos long, kmer long, seg long"
#: pos packs the first owned window, how far the anchor and the last owned window are from it.
LOW = (1 << 9) - 1


def unpack(pos: int) -> tuple[int, int, int]:
    """First owned window, anchor, end of the segment."""
    p = pos >> 18
    return p, p + (pos >> 9 & LOW), p + (pos & LOW) + LENGTH


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`."""
    n = min(len(a), len(b))
    step = 64
    while at < n and a[at : at + step] == b[at : at + step]:
        at = min(n, at + step)
    while at < n and step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at = min(n, at + step)
    return at


def front_coded(run: list[tuple[bytes, bytes, tuple]]) -> bytes:
    """A sorted run of (suffix, left part, what it belongs to), packed."""
    before, shared, rest, lefts, ids = b"", [], [], [], []
    for suffix, left, own in run:
        k = lcp(before, suffix)
        shared.append(k)
        rest.append(suffix[k:])
        lefts.append(left)
        ids.append(own)
        before = suffix
    head = np.array([len(run)], np.int64).tobytes() + np.array(ids, np.int64).tobytes()
    sizes = np.array([shared, [len(x) for x in rest], [len(x) for x in lefts]], np.int32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + sizes + b"".join(rest) + b"".join(lefts))


def run_of(data: bytes):
    """(shared, suffix, left part, what it belongs to) of a packed run, in order."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    ids = np.frombuffer(raw, np.int64, n * 4, 8).reshape(n, 4).tolist()
    shared, rest, lefts = np.frombuffer(raw, np.int32, n * 3, 8 + n * 32).reshape(3, n).tolist()
    at, before = 8 + n * 44, b""
    left_at = at + sum(rest)
    for k, r, m, own in zip(shared, rest, lefts, ids):
        before = before[:k] + raw[at : at + r]
        yield k, before, raw[left_at : left_at + m], own
        at, left_at = at + r, left_at + m


def merged(runs: list):
    """The items of sorted runs in order, each with the length of the prefix it shares with the item before."""
    size = 1 << max(0, (len(runs) - 1).bit_length())
    heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size  # of each head, with the last winner that it met
    loser = [0] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser)."""
        if heads[x] is None or heads[y] is None:
            return (x, y) if heads[y] is None else (y, x)
        if shared[x] != shared[y]:
            return (x, y) if shared[x] > shared[y] else (y, x)
        a, b = heads[x][1], heads[y][1]
        k = lcp(a, b, shared[x])
        x, y = (x, y) if a[k : k + 1] <= b[k : k + 1] else (y, x)
        shared[y] = k
        return x, y

    winners = [*[0] * size, *range(size)]
    for node in range(size - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if size > 1 else 0
    while heads[w] is not None:
        yield shared[w], heads[w]
        heads[w] = next(runs[w], None)
        shared[w] = heads[w][0] if heads[w] else 0
        node = (size + w) >> 1
        while node:
            w, loser[node] = play(w, loser[node])
            node >>= 1


def outward(shared: np.ndarray, i: int) -> np.ndarray:
    """Shared prefix lengths of item i with all items of a sorted group; shared[j] is that of items j - 1 and j."""
    out = np.empty(len(shared), np.int64)
    out[i] = 1 << 40
    out[i + 1 :] = np.minimum.accumulate(shared[i + 1 :])
    out[:i] = np.minimum.accumulate(shared[i:0:-1])[::-1]
    return out


def repeats(group: list):
    """(what it belongs to, start, end) of what goes, for segments that occur once, of a group with equal first K bytes."""
    n = len(group)
    if n < 2 or all(own[3] > 1 for _, _, _, own in group):
        return
    right = np.array([g[0] for g in group], np.int64)
    back = [g[2][::-1] for g in group]
    order = sorted(range(n), key=back.__getitem__)
    left = np.array([0] + [lcp(back[order[j - 1]], back[order[j]]) for j in range(1, n)], np.int64)
    order = np.array(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for i in range(n):
        own = group[i][3]
        if own[3] > 1:
            continue
        r, l = outward(right, i), outward(left, int(rank[i]))[rank]
        r[i] = l[i] = -1
        good = l + r >= LENGTH
        if good.any():
            anchor = unpack(own[2])[1]
            yield own, anchor - int(l[good].max()), anchor + int(r[good].max())


SPAN = "d long, th long, start long, end long"


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key that tells rows of one id apart: d (the id), th (a hash of the text and of whether the id is null)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = F.col(id_col).cast("long") if isinstance(df.schema[id_col].dataType, IntegralType) else F.xxhash64(id_col)
    return df.select(F.col(id_col).alias("id"), F.coalesce(d, F.lit(0)).alias("d"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), text.cast("binary").alias("text"))


def squeezed(rows: DataFrame, kind: str) -> DataFrame:
    """Texts compressed, for an exchange."""
    schema = f"id {kind}, d long, th long, z binary"
    kinds = arrow_schema(schema)

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "d", "th")), pa.array([c.compress(t) for t in b.column("text").to_pylist()], pa.binary())], schema=kinds)

    return rows.mapInArrow(run, schema)


def opened(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, start, end) of byte ranges that go; they may overlap."""
    rows = keyed(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    kinds, spans = arrow_schema(ANCHOR), arrow_schema(SPAN)

    def find(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                i, a, p, q, kmer = anchors(texts)
                digest = xxhash.xxh3_64_intdigest
                seg = np.fromiter((digest(texts[x][y : z + LENGTH]) for x, y, z in zip(i.tolist(), p.tolist(), q.tolist())), np.uint64, len(i))
                yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(i)), part.column("th").take(pa.array(i)), pa.array(p << 18 | (a - p) << 9 | (q - p)), pa.array(kmer), pa.array(seg.view(np.int64))], schema=kinds)

    found = written(rows.select("d", "th", "text").mapInArrow(find, ANCHOR), "anchors")
    classes = found.groupBy("kmer", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "th", "pos")).alias("one"))
    classes = written(classes, "segments")
    kmers = classes.groupBy("kmer").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).filter("m > 1 and least = 1").drop("least")

    # 1: segments that occur twice
    most = max(64, (classes.agg(F.sum("n")).first()[0] or 0) // SHARES)
    hot = df.sparkSession.createDataFrame(classes.filter(F.col("n") > most).select("kmer", "seg").collect(), "kmer long, seg long")  # fewer than SHARES
    some = classes.filter((F.col("n") > 1) & (F.col("n") <= most)).select("kmer", "seg")
    twice = found.join(F.broadcast(hot), ["kmer", "seg"], "left_anti").join(some, ["kmer", "seg"]).unionByName(found.join(F.broadcast(hot), ["kmer", "seg"]))
    first = F.shiftright("pos", 18)
    out = twice.select("d", "th", first.alias("start"), (first + F.col("pos").bitwiseAND(LOW) + LENGTH).alias("end"))

    # 2: one of each different segment of an anchor, with its text
    compared = classes.join(kmers, "kmer").select("one.*", "n", "m", "kmer")
    compared = compared.groupBy("d", "th").agg(F.collect_list(F.struct("pos", "n", "m", "kmer")).alias("of"))  # at most one for each anchor of a text
    held = squeezed(rows, kind).drop("id").join(compared.hint("shuffle_hash"), ["d", "th"])
    parts = block_count(df, 16 << 20, 8)
    schema = "target long, payload binary, d long, th long, pos long, start long, h1 long, h2 long"
    routes = arrow_schema(schema)

    def cut(batches):
        """Runs of segments for their targets; of hot anchors, hashes of all windows."""
        by: dict[int, list] = defaultdict(list)
        size = 0

        def runs():
            for target, run in by.items():
                run.sort(key=lambda x: x[0])
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([front_coded(run)]), *(pa.nulls(1, f.type) for f in list(routes)[2:])], schema=routes)
            by.clear()

        for batch in batches:
            for d, th, z, of in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "z", "of"))):
                text = opened(z)
                for x in of:
                    p, a, e = unpack(x["pos"])
                    if x["m"] <= HOT:
                        by[(x["kmer"] & (2**63 - 1)) % parts].append((text[a:e], text[p:a], (d, th, x["pos"], x["n"])))
                        size += 1
                    else:
                        h = window_hashes(text[p:e])
                        m = len(h[0])
                        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array([d] * m), pa.array([th] * m), pa.array([x["pos"]] * m), pa.array(np.arange(p, p + m)), *map(pa.array, h)], schema=routes)
                if size >= RUN:
                    yield from runs()
                    size = 0
        yield from runs()

    routed = written(held.mapInArrow(cut, schema), "runs")

    # 3: merge and compare
    def compare(batches):
        by: dict[int, list] = defaultdict(list)
        for b in batches:
            for target, data in zip(b.column("target").to_pylist(), b.column("payload").to_pylist()):
                by[target].append(data)
        for datas in by.values():
            put: list = []
            group: list = []
            seen: set = set()
            for shared, (_, suffix, left, own) in merged([run_of(x) for x in datas]):
                if shared < K:
                    put += repeats(group)
                    group, seen = [], set()
                if (key := tuple(own[:3])) not in seen:  # rows that repeat a whole row
                    seen.add(key)
                    group.append((shared, suffix, left, own))
            put += repeats(group)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o, _, _ in put], pa.int64()), pa.array([o[1] for o, _, _ in put], pa.int64()), pa.array([s for _, s, _ in put], pa.int64()), pa.array([e for _, _, e in put], pa.int64())], schema=spans)

    runs = routed.filter("target is not null").select("target", "payload").repartition(parts, "target")
    out = out.union(runs.mapInArrow(compare, SPAN))

    # 4: windows of hot anchors
    windows = routed.filter("target is null").select("d", "th", "start", "h1", "h2")
    again = windows.distinct().groupBy("h1", "h2").count().filter("count > 1").drop("count")
    hot = windows.join(again, ["h1", "h2"]).select("d", "th", "start", (F.col("start") + LENGTH).alias("end"))
    return out.union(hot)


def window_hashes(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of a segment."""
    a = np.frombuffer(segment, np.uint8)
    out = []
    for base, salt in ((0x9E3779B97F4A7C15, 1), (0xD6E8FEB86659FD93, 2)):
        power = np.cumprod(np.full(len(a), base, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_spread[a] ^ np.uint64(salt * 0x5851F42D4C957F2D)) * power)])
        inverse = np.cumprod(np.full(len(a) - LENGTH + 1, pow(base, -1, 2**64), np.uint64))
        h = (total[LENGTH:] - total[:-LENGTH]) * inverse
        out.append(((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return out[0], out[1]


#: What remove_repeats() can return of each text; `text` is `kept` as a string, where a cut character's bytes are U+FFFD.
OUTPUTS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "n_kept": "long", "kept": "binary", "text": "string", "spans": "array<struct<start:long,end:long>>"}


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs=("n_bytes", "n_removed", "n_spans", "kept", "spans")) -> DataFrame:
    """The id and the chosen OUTPUTS of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    spans = repeated_spans(df, id_col, text_col)
    # every span is LENGTH bytes long or longer, so that spans that start in the same LENGTH bytes overlap
    spans = spans.groupBy("d", "th", F.floor(F.col("start") / LENGTH).alias("at")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by = spans.groupBy("d", "th").agg(F.collect_list(F.struct("start", "end")).alias("of"))  # one for each LENGTH bytes of a text at most
    rows = squeezed(keyed(df, id_col, text_col), kind).join(by.hint("shuffle_hash"), ["d", "th"], "left")
    schema = f"{id_col} {kind}, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out: dict = {c: [] for c in outputs}
                for z, of in zip(part.column("z").to_pylist(), part.column("of").to_pylist()):
                    text, gone = opened(z), []
                    for s, e in sorted((x["start"], x["end"]) for x in of or ()):
                        if gone and s <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], e)
                        else:
                            gone.append([s, e])
                    edges = [0, *(x for g in gone for x in g), len(text)]
                    kept = b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                    got = {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(gone), "n_kept": len(kept), "kept": kept, "spans": gone}
                    for c in outputs:
                        out[c].append(hashlib.sha256(kept).hexdigest() if c == "kept_sha256" else kept.decode("utf-8", "replace") if c == "text" else [{"start": s, "end": e} for s, e in gone] if c == "spans" else got[c])
                yield pa.RecordBatch.from_pydict({id_col: part.column("id")} | out, schema=kinds)

    return rows.select("id", "z", "of").mapInArrow(run, schema)
