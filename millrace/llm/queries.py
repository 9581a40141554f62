"""The registered queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert_ann, html_text, jaccard_join, mixing, packing, quality, substring_dedup, token_counts, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The tree of ``op1``: domains group the sources, and every node's weight among its siblings.
MIX_LEVELS = ("domain", "lang", "source")
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 17


def with_domain(docs: DataFrame) -> DataFrame:
    """Domain of a source: its number modulo 4, or ``other``."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.when(number == "", "other").otherwise(F.concat(F.lit("d"), (F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS bigint)") % 4).cast("string"))))


def mix_weights() -> dict:
    return {
        "domain": F.expr("CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"),
        "lang": F.expr("CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"),
        "source": F.lit(1),
    }


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    docs = docs.select("doc_id", *MIX_LEVELS, mixing.byte_tokens(F.col("text")).alias("n_tokens"))
    return mixing.mix(docs, MIX_LEVELS, mix_weights(), share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


URL_RULES = (
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad when the label of the same id says low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    judged = url_filter.judge_urls(pages, outcomes, URL_RULES, threshold=0.3, z=1.0)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=75)


PACK_CAPACITY, PACK_END_ID = 1024, 2


def pack_tokenizer() -> packing.ByteBpe:
    """The vocabulary of ``byte_bpe_50k.json`` in rank form, with its one special token."""
    import public_tokenizers

    return packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, [PACK_END_ID])


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, pack_tokenizer, capacity=PACK_CAPACITY)


TOXIC_AT = 0.3


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learnt from three quarters of the ids; the held-out quarter is only scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    network = toxicity.train(*toxicity.training_sample(docs, labels, ~held_out))
    return toxicity.score(docs, network, TOXIC_AT).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_hilbert_ann": op7_hilbert_ann,
    "op8_url_filter": op8_url_filter,
    "op9_html_text": op9_html_text,
    "op10_jaccard_join": op10_jaccard_join,
}
