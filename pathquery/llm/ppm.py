"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to ORDER bytes with the counts of the bytes that follow, taken from all
training texts; each text is preceded by ORDER PAD bytes and ends with END (neither occurs in UTF-8).  A byte seen in its
longest context has probability n / (N + d), with N the context's count and d its distinct bytes (escape method C); the
escape has d / (N + d), and the next shorter context is then asked with all bytes of the longer one excluded, down to an
even share of the bytes that no context has.  A text's score is the sum of log10 probabilities of its bytes and its end.

Distribution.  Neither the trie nor the vocabulary has a size bound, so nothing of them is broadcast but contexts of two
bytes and less (at most 256^3 counts).  Texts are taken in blocks; each block names its distinct (context, byte) grams
and words once, with their training counts.  Grams meet by the last three bytes of their contexts, where all longer
contexts that end in them are together and probabilities can be worked out; words meet by word.  The answers go back to their block and
score its texts.  What moves besides one exchange of the texts is the distinct grams and words of each block, packed by block and target partition.

Beside it runs a unigram base: tokens are words that end at ASCII white space (A-Z lowered) and one end for each text,
with log10((c + 0.5) / (N + 0.5 (V + 1))).

Defined results: null text counts as the empty text (its end is scored); repeated rows are scored each; with no training
text every byte has the even share and the base is log10(1) for each token; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LongMap, arrow_schema, block_count, slices, written

ORDER = 5
#: Grams meet by the last so many bytes of their contexts; longer contexts are then all there, shorter ones are the Trie's.
TOGETHER = 3
PAD, END = 0xFE, 0xFF
SYMBOLS = 255
#: Bytes of a block in df's files, about.
BLOCK_BYTES = 16 << 20
#: The end token among words; no word is empty.
END_TOKEN = b""
#: Words held for a block before they are handed on (they may then be handed on twice).
HELD_WORDS = 1_500_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of each byte and end as ORDER + 1 packed bytes, and where each text's begin."""
    a = np.frombuffer(b"".join(x for t in texts for x in (b"\xfe" * ORDER, t, b"\xff")), np.uint8)
    key = np.zeros(max(0, len(a) - ORDER), np.int64)
    for i in range(ORDER + 1):
        key <<= 8
        key |= a[i : len(a) - ORDER + i]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    return key[(key & 0xFF) != PAD], starts.astype(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def by_context(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the contexts of sorted keys begin, and the number of each key's context."""
    ctx = keys >> 8
    new = np.concatenate([[True], ctx[1:] != ctx[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


class Trie:
    """Counts of contexts of two bytes and less."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.level = {2: summed(keys, n)}
        for k in (1, 0):
            key, n = self.level[k + 1]
            self.level[k] = summed(key & ((1 << 8 * (k + 1)) - 1), n)


def escaped(keys: np.ndarray, n: np.ndarray, k: int, trie: Trie) -> np.ndarray:
    """log10 P(byte | escape from its context of k bytes) of keys with n = 0; other entries have no meaning.

    keys: sorted (context, byte) of all bytes that follow the contexts, and the asked ones with n = 0.
    """
    out = np.zeros(len(keys))
    if not len(keys):
        return out
    if k == 0:
        return out - np.log10(max(1, SYMBOLS - int((n > 0).sum())))
    low = keys & ((1 << 8 * k) - 1)
    zero = np.zeros(len(low), np.int64)
    # down to TOGETHER bytes all longer contexts are at hand, and so their sums; below, the trie has them
    lk, ln = summed(low, n) if k > TOGETHER else summed(np.concatenate([trie.level[k - 1][0], low]), np.concatenate([trie.level[k - 1][1], zero]))
    at = np.searchsorted(lk, low)
    starts, group = by_context(lk)
    total, kinds = np.add.reduceat(ln, starts)[group], np.add.reduceat((ln > 0).astype(np.int64), starts)[group]
    nl, seen = ln[at], n > 0
    starts, group = by_context(keys)
    left = total[at] - np.add.reduceat(np.where(seen, nl, 0), starts)[group]
    more = kinds[at] - np.add.reduceat(seen.astype(np.int64), starts)[group]
    base = np.maximum(left + more, 1)
    deeper = escaped(lk, ln, k - 1, trie)[at]
    return np.where(nl > 0, np.log10(np.maximum(nl, 1) / base), np.where(more > 0, np.log10(np.maximum(more, 1) / base), 0.0) + deeper)


def log_probabilities(keys: np.ndarray, n: np.ndarray, trie: Trie) -> np.ndarray:
    """log10 P(byte | context) of sorted distinct keys; all keys whose contexts end in the same TOGETHER bytes must be there."""
    if not len(keys):
        return np.zeros(0)
    starts, group = by_context(keys)
    total, kinds = np.add.reduceat(n, starts)[group], np.add.reduceat((n > 0).astype(np.int64), starts)[group]
    base = np.maximum(total + kinds, 1)
    return np.where(n > 0, np.log10(np.maximum(n, 1) / base), np.where(kinds > 0, np.log10(np.maximum(kinds, 1) / base), 0.0) + escaped(keys, n, ORDER, trie))


def words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


#: kind: g grams, w words, both packed for a target partition; t counts of contexts of two bytes (key, n), unpacked.
VOCABULARY = "kind string, target long, block long, payload binary, key long, n long"
ANSWERS = "block long, kind string, payload binary, total long, distinct long"


def packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p)))


def unpacked(data: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=0).tobytes()


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.int64))


def rows(kinds: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(x) for x in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)


def vocabulary(batches, kinds: pa.Schema, parts: int):
    """Of (block, text, train) rows: each block's distinct grams and words with their counts in training texts."""
    held_grams: dict[int, list] = defaultdict(list)
    held_words: dict[int, Counter] = defaultdict(Counter)

    def out(block):
        got = held_grams.pop(block)
        keys, n = summed(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))
        low, m = summed(keys & 0xFFFFFF, n)
        yield rows(kinds, kind=["t"] * int((m > 0).sum()), key=low[m > 0], n=m[m > 0])
        context = ((keys >> 8) & ((1 << 8 * TOGETHER) - 1)).view(np.uint64)
        target = ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(target, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(target[order])) + 1])
        for at in np.split(order, cuts[1:]):
            yield rows(kinds, kind=["g"], target=[target[at[0]]], block=[block], payload=[packed(steps(keys[at]), n[at].tobytes())])
        by: dict[int, list] = defaultdict(list)
        for item in sorted(held_words.pop(block).items()):
            by[zlib.crc32(item[0]) % parts].append(item)
        for t, items in by.items():
            yield rows(kinds, kind=["w"], target=[t], block=[block], payload=[packed(b"\n".join(w for w, _ in items), np.array([c for _, c in items], np.int64).tobytes())])

    for batch in batches:
        for part in slices(batch, "text", 4_000_000):
            block, train = part.column("block").to_numpy(), part.column("train").to_numpy(zero_copy_only=False)
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            for b in np.unique(block).tolist():
                mine = block == b
                for flag in (True, False):
                    own = [texts[i] for i in np.flatnonzero(mine & (train == flag)).tolist()]
                    if own:
                        keys, n = np.unique(grams(own)[0], return_counts=True)
                        held_grams[b].append((keys, n * flag))
                        c = held_words[b]
                        for t in own:
                            if flag:
                                c.update(words(t))
                            else:
                                for w in words(t):
                                    c.setdefault(w, 0)
                        c[END_TOKEN] += len(own) * flag
            if sum(map(len, held_words.values())) > HELD_WORDS:
                for b in list(held_grams):
                    yield from out(b)
    for b in list(held_grams):
        yield from out(b)


def solved_grams(batches, kinds: pa.Schema, trie: Trie):
    """Of a partition's packed grams: each block's again, with log10 probabilities."""
    by: dict[int, list] = defaultdict(list)
    for batch in batches:
        for target, block, data in zip(*(batch.column(c).to_pylist() for c in ("target", "block", "payload"))):
            keys, n = unpacked(data)
            by[target].append((block, keys_of(keys), np.frombuffer(n, np.int64)))
    for got in by.values():
        keys, sums = summed(np.concatenate([k for _, k, _ in got]), np.concatenate([n for _, _, n in got]))
        value = log_probabilities(keys, sums, trie).astype(np.float32)
        for block, k, _ in got:
            yield rows(kinds, block=[block], kind=["g"], payload=[packed(steps(k), value[np.searchsorted(keys, k)].tobytes())])


def counted_words(batches, kinds: pa.Schema):
    """Of a partition's packed words: each block's again, with counts in all training texts; and the partition's totals."""
    by: dict[int, list] = defaultdict(list)
    for batch in batches:
        for target, block, data in zip(*(batch.column(c).to_pylist() for c in ("target", "block", "payload"))):
            by[target].append((block, data))
    for got in by.values():
        count: Counter = Counter()
        for _, data in got:
            w, n = unpacked(data)
            for x, c in zip(w.split(b"\n"), np.frombuffer(n, np.int64).tolist()):
                count[x] += c
        yield rows(kinds, kind=["n"], total=[sum(count.values())], distinct=[sum(c > 0 for c in count.values())])
        for block, data in got:
            w, _ = unpacked(data)
            c = np.fromiter(map(count.__getitem__, w.split(b"\n")), np.int64)
            yield rows(kinds, block=[block], kind=["w"], payload=[packed(w, c.tobytes())])


def blocks(df: DataFrame, id_col: str, text_col: str, by_file: bool) -> Column:
    """A block of each row: a part of a file's split, or with by_file false a share of ids."""
    if not by_file:
        return F.pmod(F.xxhash64(id_col, text_col), F.lit(block_count(df, BLOCK_BYTES)))
    split = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64(F.col(id_col)), F.lit(max(1, -(-split // BLOCK_BYTES)))))


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", by_file: bool = True) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every text; the model is learned from rows where `train` holds.

    by_file: df is read straight from files, whose splits then are the blocks; otherwise rows are exchanged once more.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), blocks(df, id_col, text_col, by_file).alias("block"))
    told = source.select("block", "text", "train")
    told = told if by_file else told.repartition(block_count(df, BLOCK_BYTES), "block")
    parts = block_count(df, BLOCK_BYTES, 8)
    named, replies = arrow_schema(VOCABULARY), arrow_schema(ANSWERS)
    vocab = written(told.mapInArrow(lambda batches: vocabulary(batches, named, parts), VOCABULARY), "vocabulary")

    # contexts of two bytes and less: 256^3 counts at most
    low = vocab.filter("kind = 't'").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    trie = spark.sparkContext.broadcast(Trie(low["key"].to_numpy(np.int64), low["n"].to_numpy(np.int64)))

    def dealt(kind: str) -> DataFrame:
        return vocab.filter(F.col("kind") == kind).select("target", "block", "payload").repartition(parts, "target")

    solved = dealt("g").mapInArrow(lambda batches: solved_grams(batches, replies, trie.value), ANSWERS)
    counted = written(dealt("w").mapInArrow(lambda batches: counted_words(batches, replies), ANSWERS), "words")
    total, distinct = counted.filter("kind = 'n'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    answers = solved.union(counted.filter("kind = 'w'")).select("block", "kind", "payload")

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    result = arrow_schema(schema)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values, place, counts, size = [], [], {}, [], 0
        for is_word, data in zip((x == "w" for x in right.column("kind").to_pylist()), right.column("payload").to_pylist()):
            a, b = unpacked(data)
            if is_word:
                w = a.split(b"\n")
                place.update(zip(w, range(size, size + len(w))))
                counts.append(np.frombuffer(b, np.int64))
                size += len(w)
            else:
                keys.append(keys_of(a))
                values.append(np.frombuffer(b, np.float32))
        keys, at = np.unique(np.concatenate(keys), return_index=True)
        model = LongMap(keys, np.concatenate(values)[at], np.float32(np.nan))
        c = np.concatenate(counts)
        logs, known, end = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))), c > 0, place[END_TOKEN]
        out = {f.name: [] for f in result}
        for batch in left.to_batches():
            for part in slices(batch, "text"):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                keys, starts = grams(texts)
                out["score"].append(np.add.reduceat(model.find(keys).astype(np.float64), starts))
                for t in texts:
                    at = np.fromiter(map(place.__getitem__, words(t)), np.int64)
                    out["n_tokens"].append(len(at) + 1)
                    out["n_known"].append(int(known[at].sum() + known[end]))
                    out["base_score"].append(float(logs[at].sum() + logs[end]))
                    out["n_bytes"].append(len(t))
        n = left.num_rows
        out |= {"id": left.column("id"), "train": left.column("train"), "train_tokens": [total] * n, "score": np.concatenate(out["score"]) if n else []}
        return pa.Table.from_pydict(out, schema=result)

    # as many tasks as blocks, so that what a task reads doesn't grow with the table
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), block_count(df, BLOCK_BYTES))
    left, right = (x.repartition(tasks, "block").groupBy("block") for x in (source, answers))
    scored = left.cogroup(right).applyInArrow(answer, schema)
    return scored.withColumnRenamed("id", id_col)
