"""Mixing sources to target weights: hierarchical token budgets over a tree of groups.

Weights run from the root through each level of the tree (for documents: domain, language, source). A
node's budget is shared among its children by weight; a child that cannot use its share (its supply is
its tokens times ``max_epochs``) passes the rest to its siblings, and only what a whole family cannot use
goes back to the siblings of its parent. That is one water-filling per family, from the root down, with
capacities summed from the leaves up; sorted by capacity over weight, the full children are a prefix, so
it is closed-form over window sums and needs no iteration.

Each leaf then takes the token-prefix of a stream of seeded epochs: every epoch holds all its documents in
an order hashed from seed, epoch, document id and size. Whole epochs become a repeat count; only the last one
needs an order. The running sum is taken in two levels (blocks of the hashed order, then rows within the
block that holds the boundary), so that a leaf with a third of all rows is not one task.

Only DataFrame functions are used.

Defined results: null group values form groups of their own; a null or empty text has ``min_tokens``
tokens; groups with weight 0 get nothing; ties in the hashed order go to the smaller document id, then the
shorter text; repeated rows stand one behind the other and each counts, so the end of the prefix may take some of
them; groups are told apart by their values, whatever characters these hold; an empty table gives an empty
result; columns other than the id, the levels and the size are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def byte_tokens(text: Column, bytes_per_token: int = 4, min_tokens: int = 1) -> Column:
    """A token estimate from UTF-8 bytes."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    return F.greatest(F.lit(min_tokens).cast("long"), F.ceil(n / F.lit(bytes_per_token)).cast("long"))


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, null being equal to null."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(right, on, how).drop(*[f"_right_{c}" for c in keys])


def budgets(leaves: DataFrame, levels: Sequence[str], total: int, max_epochs: int) -> DataFrame:
    """``leaves(*levels, w_<level>..., tokens)`` with ``quota``: tokens granted to each leaf.

    ``w_<level>`` is the integer weight of the node at that level among its siblings.
    """
    leaves = leaves.withColumn("_cap", F.col("tokens") * F.lit(max_epochs).cast("long"))
    nodes = [leaves.groupBy(*levels[: i + 1]).agg(F.sum("_cap").alias("cap"), F.max(f"w_{level}").alias("w")) for i, level in enumerate(levels)]
    granted: DataFrame | None = None
    for i, level in enumerate(levels):
        own, family = list(levels[: i + 1]), list(levels[:i])
        live = nodes[i].withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0).cast("long"))
        if granted is None:
            live = live.withColumn("amount", F.lit(total).cast("long"))
        else:
            live = _match(live, granted, family, "left").withColumn("amount", F.coalesce("amount", F.lit(0)).cast("long"))
        # order by capacity over weight: how soon a child is full
        soon = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0))
        order = [F.col("_soon"), *[F.col(c).asc_nulls_first() for c in own]]
        w_all = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
        before = w_all.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        live = live.withColumn("_soon", soon).withColumns(
            {
                "_cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                "_w_left": F.sum("w").over(w_all) - F.coalesce(F.sum("w").over(before), F.lit(0)),
            }
        )
        left = F.col("amount") - F.col("_cap_before")
        full = (F.col("w") > 0) & (left * F.col("w") >= F.col("cap") * F.col("_w_left"))
        live = live.withColumn("_full", full)
        # the unfilled ones share what the full ones leave
        sums = live.withColumns(
            {
                "_cap_full": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(w_all),
                "_w_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(w_all),
            }
        )
        share = F.when(F.col("_full"), F.col("cap")).when(F.col("w") <= 0, 0).otherwise(
            F.floor(F.greatest(F.lit(0), F.col("amount") - F.col("_cap_full")) * F.col("w") / F.col("_w_open"))
        )
        granted = sums.select(*own, F.least(share.cast("long"), F.col("cap")).alias("amount"))
    assert granted is not None
    return _match(leaves, granted, levels, "inner").select(*levels, "tokens", "rows", F.col("amount").alias("quota"))


def select_prefix(docs: DataFrame, quotas: DataFrame, levels: Sequence[str], seed: int, block_rows: int = 4000) -> DataFrame:
    """``docs(doc_id, *levels, n_tokens)`` with ``copies`` (times the document is taken) and ``take_tokens``.

    The last document of the prefix counts up to the quota; documents not taken at all are left out.
    """
    quotas = quotas.where(F.col("quota") > 0).select(
        *levels,
        F.floor(F.col("quota") / F.col("tokens")).cast("long").alias("_whole"),
        (F.col("quota") - F.floor(F.col("quota") / F.col("tokens")).cast("long") * F.col("tokens")).alias("_rest"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(block_rows))).cast("long").alias("_blocks"),
    )
    # null ids differ in size, so that they are spread, too
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("n_tokens").cast("string")))
    rows = _match(docs, quotas, levels, "inner").withColumn("_key", key)
    # the first 32 bits of the key, scaled to the leaf's number of blocks
    high = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_block", F.floor(high * F.col("_blocks") / F.lit(4294967296)).cast("long"))
    # dealt by block, or the running sums within blocks would stay where the join left them, a leaf in one task
    rows = rows.repartition(*levels, "_block")
    sums = rows.groupBy(*levels, "_block").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy(*levels).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*levels, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*levels, "_block").orderBy("_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_start") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))
    taken = _match(rows, sums, [*levels, "_block"], "inner").withColumn("_at", at)
    last = (F.col("_at") < F.col("_rest")).cast("long")
    out = taken.withColumn("copies", F.col("_whole") + last).where("copies > 0")
    part = F.when(F.col("_at") < F.col("_rest"), F.least(F.col("n_tokens"), F.col("_rest") - F.col("_at"))).otherwise(0)
    return out.select(
        *[c for c in docs.columns], "copies", (F.col("_whole") * F.col("n_tokens") + part).cast("long").alias("take_tokens")
    )


def mix(
    docs: DataFrame, levels: Sequence[str], weights: dict[str, Column], *, share: float, max_epochs: int, seed: int
) -> DataFrame:
    """Select from ``docs(doc_id, *levels, n_tokens)`` a budget of ``share`` times all its tokens.

    ``weights`` maps each level to an integer column over ``levels``.
    """
    docs = settle(docs.select("doc_id", *levels, "n_tokens"))  # texts are read once, for their sizes
    leaves = docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    leaves = leaves.withColumns({f"w_{c}": weights[c].cast("long") for c in levels})
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quotas = budgets(leaves, levels, int(total * share), max_epochs)
    return select_prefix(docs, quotas, levels, seed)
