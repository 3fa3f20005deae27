"""A training-corpus pipeline of five operators: language, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns and hands it to the next.
Further columns of documents, whatever their names, are carried along.  An empty table gives an empty result.

1. language: rows whose language is `und` (no letter, null text), or whose share of known trigrams is under MIN_SCORE, go.
2. near_duplicates: of each group of near duplicates (SIMILARITY of their shingles of WORDS words) the row with the least
   doc_id stays (of rows that repeat it, one).
   Rows without a doc_id stay unless their group has one; rows that share a doc_id but are not near duplicates stay.
3. decontamination: rows that contain a benchmark item go, whatever their doc_id.
4. personal_data: personal data are replaced by the names of their kinds in brackets; n_chars follows.
5. tokens: token counts and digests of ids and of the decoded texts (equal to the texts by the operator's round trip).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathquery.llm import bpe, langid, lsi, pii, simhash
from pathquery.llm.common import fold, written

MIN_SCORE = 0.1
#: Near duplicates share this part of their shingles of so many words.
SIMILARITY, WORDS = 0.8, 5


class Own:
    """docs under names that clash with nothing an operator adds, and back."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.docs = docs.toDF(*(f"own_{i}" for i in range(len(self.columns))))
        self.id, self.text = self["doc_id"], self["text"]
        self.others = tuple(c for c in self.docs.columns if c not in (self.id, self.text))

    def __getitem__(self, name: str) -> str:
        return f"own_{self.columns.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(self.docs.columns).toDF(*self.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Own(docs)
    filters = langid.fit(own.docs.filter(fold(own.id) != 0), own.id, own.text, own["lang"])
    found = langid.identify(own.docs, filters, own.id, own.text, keep=tuple(own.docs.columns))
    return own.back(found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an id may be null or repeated: a row is known by its id and its text's hash
    own = Own(docs)
    keyed = own.docs.withColumn("row_hash", F.xxhash64(own.text))
    near = written(simhash.near_duplicates(keyed, own.id, own.text, words=WORDS, keep=("row_hash",), similarity=SIMILARITY), "near")
    first = near.filter(F.col(own.id) == F.col("component_id")).groupBy("root", F.col(own.id).alias("kept_id")).agg(F.min("row_hash").alias("kept_hash")).drop("root")
    kept = first.union(near.filter("component_id is null").select(own.id, "row_hash")).distinct()
    out = keyed.join(kept, keyed[own.id].eqNullSafe(kept["kept_id"]) & (keyed["row_hash"] == kept["kept_hash"]), "left_semi")
    named = F.col(own.id).isNotNull()
    if near.filter(named).groupBy(own.id, "row_hash").count().filter("count > 1").limit(1).count():
        out = out.filter(named).dropDuplicates([own.id, "row_hash"]).union(out.filter(~named))
    return own.back(out)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # what a text contains doesn't depend on its id, which may be null or repeated
    own = Own(docs)
    keyed = own.docs.withColumn("row_hash", F.sha2(own.text, 256))
    found = lsi.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_hash", text_col=own.text)
    return own.back(keyed.join(found.select("row_hash").distinct(), "row_hash", "left_anti"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Own(docs)
    out = pii.find_pii(own.docs, own.id, own.text, keep=own.others, mask=True)
    if "n_chars" in docs.columns:
        out = out.withColumn(own["n_chars"], F.length(own.text).cast(docs.schema["n_chars"].dataType))
    return own.back(out)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: The models of stages 1 to 3 are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
