"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, images, langid, lsi, pii, ppm, simhash, suffix_dedup, token_trees, warc
from .common import fold, fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ppm.score(table(spark, sf_dir, "documents"), fold() != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs.filter(fold() != 0)))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op4_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: each row of embeddings gives a texture and an edited crop of it."""
    return images.copies(images.rendered(table(spark, sf_dir, "embeddings")))


def op5_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsi.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stated_edits(doc_id, text: str):
    """Three edits that follow from the id and the text's length: a deletion, an insertion and a replacement."""
    n, k = len(text), zlib.crc32(str(doc_id).encode())
    a, b, c = (k * m % (n + 1) for m in (3, 5, 7))
    yield a, a + 40, None
    yield b, b, " edited 42's\n\n"
    yield c, c + 10, "Ünïcode  "


def op7_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_trees.edited_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, edits_of=stated_edits)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).drop("url")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES = {f.__name__: f for f in (op1_ppm, op2_suffix_dedup, op3_langid, op4_images, op5_lsi, op6_simhash, op7_token_trees, op8_warc, op9_bpe, op10_pii)}

ORACLES = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
