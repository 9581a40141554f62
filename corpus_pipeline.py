"""A corpus pipeline over ``documents``: each stage's result is written and read again by the next.

Stages take whatever their predecessor kept, change or drop rows, and return the columns of documents; the last
returns the packed pieces. Other columns go along, whatever their names. Null, empty and repeated rows are
handled as the operators say; see their docstrings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard_join, mixing, packing, quality, substring_dedup
from millrace.llm.common import settle, table
from millrace.llm.queries import MIX_LEVELS, MIX_SEED, PACK_CAPACITY, mix_weights, pack_tokenizer, with_domain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Mixing takes each document at most once here; this share of the tokens stays.
KEEP_SHARE, ONCE = 0.9, 1


def _only(docs: DataFrame, ids: DataFrame, *more: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``; a null id counts as an id.

    ``more``: SQL over rows that must agree with the columns of ``ids`` after the first, too.
    """
    taken = {c.lower() for c in docs.columns}
    names: list[str] = []
    for k in range(len(more) + 1):  # names that no column of docs has
        names.append(next(x for x in (f"_kept_{k}{'_' * n}" for n in range(len(taken) + 1)) if x not in taken))
    ids = ids.toDF(*names).distinct()
    on = docs["doc_id"].eqNullSafe(F.col(names[0]))
    for name, sql in zip(names[1:], more, strict=True):
        on = on & F.expr(sql).eqNullSafe(F.col(name))
    return docs.join(ids, on, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision verdict keeps; rows that share an id are told apart by their text."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    judged = quality.judge(rows, keep=("doc_id", "text_key"))
    return _only(docs, judged.where("kept").select("doc_id", "text_key"), "xxhash64(text)")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group that n-gram Jaccard links join."""
    linked = jaccard_join.link(docs.select("doc_id", "text"), percent=75)
    return _only(docs, linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; a text that loses all its words goes."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("_row"))
    clean = substring_dedup.remove_repeats(rows, carry="_row").where("n_removed = 0 OR n_removed < n_words")
    size = F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("kept"), "n_chars": size}
    return clean.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their group's share of the token budget."""
    sized = with_domain(docs.select("doc_id", "text", "lang", "source"))
    sized = sized.select("doc_id", *MIX_LEVELS, mixing.byte_tokens(F.col("text")).alias("n_tokens"))
    return _only(docs, mixing.mix(sized, MIX_LEVELS, mix_weights(), share=KEEP_SHARE, max_epochs=ONCE, seed=MIX_SEED).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), pack_tokenizer, capacity=PACK_CAPACITY)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed),
]

#: Token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
