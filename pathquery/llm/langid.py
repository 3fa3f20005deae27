"""Language identification with language-bitmask n-gram filters.

Letter trigrams (words padded with a boundary) that are typical of a language go into that language's slice of one
bit-sliced Bloom filter: position p of the table holds one bit for each language, so that the AND of a trigram's few
positions gives all languages that contain it at once.  A text's count for a language is the number of its trigrams with
that bit (popcount by language), corrected for the false positives that the slice's fill makes expect; the highest count
decides, and the score is its share of all trigrams.

The filters are fitted on a bounded sample of labelled rows: about `sample` rows of each language, chosen by a hash of
the id.  Prediction reads whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; a text of whose trigrams none is known
gets the commonest learned language with score 0 (`und` where nothing was learned); ties go to the language first in
order; repeated rows are predicted each; an empty table gives an empty result.  Of more than MAX_LANGUAGES labels, the
commonest are learned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_slices, slices, written

#: Rows of a language that the filters are fitted on, about.
SAMPLE = 10_000
#: A trigram's least share of a language's trigrams (hence 1 / MIN_SHARE trigrams of a language at most), and of its largest share in any language.
MIN_SHARE, TYPICAL = 1e-5, 0.5
HASHES, BITS_EACH = 3, 24
#: The commonest languages that are learned, at most; 64 of them share a word of the filter.
MAX_LANGUAGES = 512
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of all texts in order, and where each text's begin (one more entry than texts)."""
    low = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in low], dtype=np.int64)
    letter = letters()[codes]
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before  # of a run of other characters, the first
    kept = np.concatenate([[0], np.cumsum(keep)])
    c = np.concatenate([[0], np.where(letter, codes, 0)[keep]]).astype(np.int64)
    c = np.concatenate([c, [0]])
    grams, real = c[:-2] << 42 | c[1:-1] << 21 | c[2:], c[1:-1] != 0
    count = np.concatenate([[0], np.cumsum(real)])
    return grams[real], count[kept[np.concatenate([[0], ends])]]


class Filters:
    """The bit-sliced Bloom filter of all languages."""

    def __init__(self, languages: list[str], common: int, sets: list[np.ndarray]):
        self.languages, self.common = languages, common
        bits = max(10, (BITS_EACH * max(map(len, sets), default=1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slices = np.zeros((max(1, -(-len(sets) // 64)), 1 << bits), np.uint64)
        for i, grams in enumerate(sets):
            for at in self._places(grams):
                np.bitwise_or.at(self.slices[i // 64], at, np.uint64(1 << i % 64))
        fill = [float(((self.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false = np.array([f**HASHES for f in fill])

    def _places(self, grams: np.ndarray):
        g = grams.view(np.uint64)
        for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)[:HASHES]:
            yield ((g ^ (g >> np.uint64(29))) * np.uint64(m)) >> self.shift

    def masks(self, grams: np.ndarray, word: int) -> np.ndarray:
        out = None
        for at in self._places(grams):
            out = self.slices[word][at] if out is None else out & self.slices[word][at]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        grams, edges = trigrams(texts)
        total = np.diff(edges)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        true = np.zeros((len(texts), len(self.languages)))
        for i, f in enumerate(self.false):
            if i % 64 == 0:
                masks = self.masks(grams, i // 64)
            hits = np.concatenate([[0], np.cumsum((masks >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
            true[:, i] = np.maximum(0, (np.diff(hits[edges]) - total * f) / (1 - f))
        best = np.where(true.any(axis=1), true.argmax(axis=1), self.common)
        score = np.minimum(1.0, true[np.arange(len(texts)), best] / np.maximum(1, total))
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), total.tolist())], score.tolist()


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from labelled rows; rows whose text or language is null teach nothing."""
    train = train.filter(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], 0, [])
    share = F.coalesce(F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))))[F.col(lang_col)], F.lit(0.0))
    unit = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    kinds = arrow_schema("lang string, gram long, n long")

    def count(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                lang = np.array(part.column(lang_col).to_pylist(), object)
                texts = np.array(part.column(text_col).to_pylist(), object)
                for k in set(lang):
                    grams, n = np.unique(trigrams(texts[lang == k].tolist())[0], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [k] * len(grams), "gram": grams, "n": n}, schema=kinds)

    parts = train.filter(unit < share).mapInArrow(count, "lang string, gram long, n long")
    counts = written(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    least = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(MIN_SHARE * totals.get(k, 0)))))[F.col("lang")]
    rows = counts.filter(F.col("n") >= least).toPandas()
    rows["share"] = rows.n / rows.lang.map(totals)
    rows = rows[rows.share >= TYPICAL * rows.groupby("gram").share.transform("max")]
    common = languages.index(max(languages, key=lambda k: (sizes[k], k)))
    return Filters(languages, common, [np.sort(rows.gram[rows.lang == k].to_numpy(np.int64)) for k in languages])


def identify(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of `keep`, lang_pred and score of every text; the text is only returned if `keep` has it."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    out_cols = list(dict.fromkeys((id_col, *keep)))
    shared = df.sparkSession.sparkContext.broadcast(filters)  # its size is bounded by 1 / MIN_SHARE trigrams of a language

    def make():
        f = shared.value

        def run(part: pa.RecordBatch) -> dict:
            lang, score = f.predict(part.column(text_col).to_pylist())
            return {c: part.column(c) for c in out_cols} | {"lang_pred": lang, "score": score}

        return run

    cols = list(dict.fromkeys((*out_cols, text_col)))
    return map_slices(df, cols, text_col, ", ".join(f"`{c}` {kind[c]}" for c in out_cols) + ", lang_pred string, score double", make)
