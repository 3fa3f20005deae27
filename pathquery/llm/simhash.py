"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits.  Its embedding is the vector of segment popcounts, held as a
thermometer code (0: 00, 1: 01, 2: 11) so that bit_count(x ^ y) of two codes is their Manhattan distance, which is never
above the Hamming distance of the fingerprints.  The segments form `groups` blocks.  Two embeddings within `bits` under
Manhattan distance agree on all but `bits` blocks, so that a grid cell for each choice of groups - bits blocks holds
every pair; pairs of a cell pass the Manhattan bound and are then verified on the fingerprints.

Cells with more than DENSE fingerprints take another exact way, without pairs: for bits <= 2, two fingerprints are within
2 bits exactly if some point is within one bit of both, so that every fingerprint of a dense cell goes to its 65 such
points and each point links what it has to its least member.

With `similarity`, texts link instead whose sets of shingles have that Jaccard similarity or more.  The grid's pairs of
fingerprints are then candidates that are checked on the shingles, and give the first components.  Similar texts may be
further apart than `bits`, so that the rest takes an exact way: a text of which too many shingles occur in no other text is
similar to none; the others meet across components by a prefix filter on their shingles, the rarest first, each with
one other of a shingle before all do, and pairs whose sizes, places in the prefix or parities of hashed shingles exclude that similarity are left out.  Equal texts are
collapsed first, and no shingle pairs texts of the largest component that has it.

Defined results: null text is the empty text; texts without words have fingerprint zero and are linked like any other;
ids that are null have a fingerprint and a component but never name one, unless no id of the component is set (null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, block_count, map_slices, mixed, run_hashes, word_hashes, written
from .components import components

SEED = 42
DENSE = 64
#: Longs of a set's parities, and bytes of text whose tested shingles meet in one block.
PARITIES = 8
BLOCK_BYTES = 16_000_000
_words = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n\t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz     ")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Words end at ASCII white space; A-Z are lowered; shingles count as often as they occur."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, SEED) for s in shingles])
    n = len(raw) // 8
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, keep: tuple = ()) -> DataFrame:
    """id, the columns `keep` and fp (the fingerprint as a signed long) of every text."""
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))

    def make():
        def run(part: pa.RecordBatch) -> dict:
            fp = np.array([fingerprint(t, words) for t in part.column(1).to_pylist()], np.uint64)
            return {id_col: part.column(0), **{c: part.column(c) for c in keep}, "fp": fp.view(np.int64)}

        return run

    return map_slices(df, [id_col, text_col, *keep], text_col, f"{kinds}fp long", make)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp):
    """The thermometer code of the segment popcounts."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    some, all_ = fp.bitwiseOR(high).bitwiseAND(odd), fp.bitwiseAND(high).bitwiseAND(odd)
    return some.bitwiseOR(F.shiftleft(all_, 1))


def block_masks(groups: int, bits: int) -> list[int]:
    """A mask of code bits for each choice of groups - bits blocks of segments."""
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    blocks = [sum(3 << 2 * s for s in range(edges[i], edges[i + 1])) for i in range(groups)]
    return [sum(c) for c in combinations(blocks, groups - bits)]


def links(fps: DataFrame, bits: int = 2, groups: int = 5) -> DataFrame:
    """Edges (a, b) that join all of the distinct longs in fps.fp within `bits` bits, in the sense of reachability."""
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    masks = F.array(*(F.lit(signed(m)) for m in block_masks(groups, bits)))
    coded = fps.select("fp", embedded(F.col("fp")).alias("code"))
    cells = coded.select("fp", "code", F.posexplode(masks).alias("choice", "mask")).select("fp", "code", "choice", F.col("mask").bitwiseAND(F.col("code")).alias("cell"))
    full = cells.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = written(cells.join(full, ["choice", "cell"]), "cells")
    light = placed.filter(F.col("n") <= DENSE).select("choice", "cell", "fp", "code")
    x, y = light.alias("x"), light.alias("y")
    near = F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= bits
    same = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits
    pairs = x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & near & same)
    pairs = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    dense = placed.filter(F.col("n") > DENSE).select("fp").distinct()
    flips = F.array(F.lit(0), *(F.lit(signed(1 << i)) for i in range(64))) if bits == 2 else F.array(*(F.lit(signed(1 << i)) for i in range(64)))
    if bits < 2:  # within one bit: neighbours are points themselves
        star = dense.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR("f").alias("b")).join(dense.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b").filter("a < b")
        return pairs.union(star) if bits else pairs.limit(0)
    at = dense.select("fp", F.explode(flips).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("point"))
    star = at.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 members at most
    star = star.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.union(star)


def shingled(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, how many each text has (of a text with fewer words, one of all), and a hash of each text's words."""
    h, counts = word_hashes([(t or "").encode("utf-8", "replace").translate(_words) for t in texts])
    first = np.cumsum(counts) - counts
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(np.repeat(counts, n), words)
    whole = run_hashes(h, first, first + counts) ^ mixed(counts.astype(np.uint64))
    return mixed(run_hashes(h, begin, begin + size) ^ size.astype(np.uint64)), n, whole


def tested(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Which shingles are looked for in other texts: by their hashes, twice as many as a text may have alone."""
    return shingles <= np.uint64(min(1.0, 2 * (1 - similarity)) * (2**64 - 2049))


def prints(df: DataFrame, id_col: str, text_col: str, words: int, keep: tuple, similarity: float) -> DataFrame:
    """id, the columns `keep`, fp (a hash of the text's words), sim (its fingerprint), its number of different shingles n and of tested ones m."""
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))

    def make():
        def run(part: pa.RecordBatch) -> dict:
            texts = part.column(1).to_pylist()
            shingles, n, whole = shingled(texts, words)
            sets = [np.unique(x) for x in np.split(shingles, np.cumsum(n)[:-1])]
            sim = np.array([fingerprint(t, words) for t in texts], np.uint64)
            return {id_col: part.column(0), **{c: part.column(c) for c in keep}, "fp": whole.view(np.int64), "sim": sim.view(np.int64), "n": [len(x) for x in sets], "m": [int(tested(x, similarity).sum()) for x in sets]}

        return run

    return map_slices(df, [id_col, text_col, *keep], text_col, f"{kinds}fp long, sim long, n int, m int", make)


def met(df: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """(fp, met): how many of a text's tested shingles other texts have; texts without such may be missing."""
    blocks = block_count(df.select(text_col), BLOCK_BYTES, least=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def make():
        def run(part: pa.RecordBatch) -> dict:
            shingles, n, whole = shingled(part.column(0).to_pylist(), words)
            some = tested(shingles, similarity)
            s, fp = shingles[some], np.repeat(whole, n)[some]
            block = ((s >> np.uint64(8)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            s, fp, block = s[order], fp[order], block[order]
            first = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(first[1:], len(s))
            return {"block": block[first], "s": [s[i:j].tobytes() for i, j in zip(first, ends)], "fps": [fp[i:j].tobytes() for i, j in zip(first, ends)]}

        return run

    def counted(block: pa.Table) -> pa.Table:
        s, fp = (np.frombuffer(b"".join(block.column(c).to_pylist()), np.int64) for c in ("s", "fps"))
        order = np.lexsort((fp, s))
        s, fp = s[order], fp[order]
        new = np.append(True, (s[1:] != s[:-1]) | (fp[1:] != fp[:-1]))
        s, fp = s[new], fp[new]
        same = s[1:] == s[:-1]
        fps, n = np.unique(fp[np.append(same, False) | np.append(False, same)], return_counts=True)
        return pa.table({"fp": fps, "met": n.astype(np.int64)})

    dealt = map_slices(df, [text_col], text_col, "block long, s binary, fps binary", make)
    return dealt.groupBy("block").applyInArrow(counted, "fp long, met long").groupBy("fp").agg(F.sum("met").alias("met"))


def alone(n, similarity: float):
    """So many shingles of n, or more, that no other text has, and a text is similar to none; also the length of its prefix."""
    return n - F.ceil(F.lit(similarity) * n - 1e-9) + 1


def shingle_sets(df: DataFrame, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(fp, shingles, parities) of the texts whose fp is in wanted.fp, one of each."""

    def squeeze():
        c = zstandard.ZstdCompressor(level=1)

        def run(part: pa.RecordBatch) -> dict:
            texts = part.column(0).to_pylist()
            return {"fp": shingled(texts, words)[2].view(np.int64), "z": [c.compress((t or "").encode()) for t in texts]}

        return run

    kinds = arrow_schema("fp long, shingles array<long>, parities array<long>")

    size = 64 * PARITIES

    def split(batches):
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                shingles, n, _ = shingled([d.decompress(z).decode() for z in part.column(1).to_pylist()], words)
                sets = [np.unique(x) for x in np.split(shingles, np.cumsum(n)[:-1])]
                odd = [np.packbits(np.bincount((x % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], schema=kinds)

    # equal texts are combined before they are exchanged
    texts = map_slices(df, [text_col], text_col, "fp long, z binary", squeeze).groupBy("fp").agg(F.first("z").alias("z"))
    return texts.join(wanted, "fp", "left_semi").select("fp", "z").mapInArrow(split, "fp long, shingles array<long>, parities array<long>")


def similar_roots(df: DataFrame, nodes: DataFrame, text_col: str, words: int, similarity: float, bits: int, groups: int) -> DataFrame:
    """(node, root) of the texts in nodes.fp that a similarity of their shingles links."""
    heads = written(nodes.groupBy("sim").agg(F.min("fp").alias("head")), "heads")
    head = lambda c: heads.select(F.col("sim").alias(f"{c}_sim"), F.col("head").alias(c))
    near = links(heads.select(F.col("sim").alias("fp")), bits, groups).toDF("a_sim", "b_sim").distinct()
    near = near.join(head("a"), "a_sim").join(head("b"), "b_sim").select("a", "b")
    near = near.union(nodes.join(heads, "sim").filter("fp != head").select("head", "fp"))

    some = nodes.join(met(df, text_col, words, similarity), "fp", "left").filter(F.col("m") - F.coalesce("met", F.lit(0)) < alone(F.col("n"), similarity)).filter("n > 0")
    sets = written(shingle_sets(df, text_col, words, some.select("fp")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a")
        both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.filter(F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b")

    def grown(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        more = written(verified(pairs), "more")
        return written(components(more.union(roots.select("node", "root"))), "roots")

    roots = written(components(verified(near)), "roots")
    first = written(prefixes(sets, similarity), "prefixes")
    roots = grown(neighbours(rooted(first, roots)), roots)
    return grown(across(rooted(first, roots), similarity), roots)


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, place, fp, n, parities) of the shingles in the prefix of each set that other sets have too.

    Of two similar sets of n and m shingles, each has one of the common ones among the n - ceil(similarity n) + 1 that
    come first in any order that holds for all; here the rarest come first.
    """
    each = sets.select("fp", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    times = each.groupBy("s").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    by = Window.partitionBy("fp")
    # shingles of one set only come first of all
    placed = each.join(times, "s").withColumn("place", F.row_number().over(by.orderBy("times", "s")) + F.col("n") - F.count(F.lit(1)).over(by))
    first = placed.filter(F.col("place") <= alone(F.col("n"), similarity)).select("fp", "n", "s", "place")
    return first.join(sets.select("fp", *(F.col("parities")[i].alias(f"p{i}") for i in range(PARITIES))), "fp")


def rooted(first: DataFrame, roots: DataFrame) -> DataFrame:
    """first with the root of each fp and the size of its component."""
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    found = first.join(roots, first["fp"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))
    return found.join(sizes, "root", "left").withColumn("size", F.coalesce("size", F.lit(1)))


def neighbours(first: DataFrame) -> DataFrame:
    """(a, b): each set with one other of each shingle of its prefix, in an order that is another one for each shingle, if their components differ."""
    order = Window.partitionBy("s").orderBy(F.xxhash64("fp", "s"), "fp")
    met = first.select("fp", "root", F.lag("fp").over(order).alias("other"), F.lag("root").over(order).alias("other_root")).filter("root != other_root")
    return met.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def across(first: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all pairs of sets of different components that may be similar.

    The parities of two sets' hashed shingles differ in no more places than the sets have different shingles.
    """
    tops = first.groupBy("s").agg(F.max(F.struct("size", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    both = first.join(tops.select("s", F.col("top.root").alias("top")), "s")
    x, y = both.filter("root != top").alias("x"), both.alias("y")
    total = F.col("x.n") + F.col("y.n")
    fits = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9
    # true of the first shingle that both prefixes have, if the sets are similar
    left = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= similarity / (1 + similarity) * total - 1e-6
    apart = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(PARITIES)), F.lit(0))
    close = apart <= (1 - similarity) / (1 + similarity) * total + 1e-6
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.fp") < F.col("y.fp"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & once & fits & left & close)
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 2, groups: int = 5, keep: tuple = (), similarity: float | None = None) -> DataFrame:
    """id, fp, component_id (the least id reachable) of every row; with `keep` also these columns and root (the component's least fp).

    similarity: link by the similarity of shingle sets, of pairs within `bits` bits first; fp is then a hash of the text's words.
    """
    if similarity is None:
        fps = written(fingerprints(df, id_col, text_col, words, keep), "fingerprints")
        nodes = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
        roots = components(links(nodes.select("fp"), bits, groups))
    else:
        fps = written(prints(df, id_col, text_col, words, keep, similarity), "prints")
        nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least"), *(F.first(c).alias(c) for c in ("sim", "n", "m"))), "nodes")
        roots = similar_roots(df, nodes, text_col, words, similarity, bits, groups)
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select(id_col, "fp", "component_id", *((*keep, "root") if keep else ()))
