"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, several times over with another rotation and shift, and each
projection is ordered along a Hilbert curve. The orderings are range-partitioned and sorted in Spark; a query's
candidates are the rows within a window of its place in each ordering. Windows are searched in blocks of the
order: a block's rows are compared with the queries whose window reaches into it, exactly and in double
precision, and only each query's best ``k`` leave the block; the blocks' lists are merged and ranked. Queries of a block
are dealt over as many groups as it takes to hold at most about ``block`` of them in each.

The projections are fitted on at most ``SAMPLE`` vectors (the smallest by hashed id): their principal axes and
ranges. Every vector is indexed. The window is ``rows`` rows and ``share`` of all rows on either side, at every size.
What recall that gives depends on the data and is measured in the tests and the README.

Defined results: vectors that are null or zero, or hold null or non-finite components, or differ in length
from the sample's usual length take no part; a query never finds its own row, but finds copies of it; ties go
to the smaller id; with fewer candidates than ``k`` all found are returned; an empty table gives an empty result;
rows that repeat an id are rows of their own: each is a candidate, and each query row has its own list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, settle, spread

SAMPLE = 4096
#: A curve runs through at most DIMENSIONS dimensions, with KEY_BITS bits for all of them together.
DIMENSIONS, KEY_BITS, MOST_BITS, AXES = 20, 60, 10, 64


def usable(embedding: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells, an array of (rows, dimensions)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return key


class Curves:
    """Projections, ranges and shifts of all orderings, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, orderings: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(0)
        _, _, axes = np.linalg.svd(sample - self.mean, full_matrices=False)
        axes = axes[: min(AXES, len(axes))]
        d = min(DIMENSIONS, len(axes))
        self.bits = min(MOST_BITS, KEY_BITS // d)
        self.projections = []
        for _ in range(orderings):
            turn, _ = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))
            p = turn[:d] @ axes
            at = (sample - self.mean) @ p.T
            low, wide = at.min(0), np.maximum(at.max(0) - at.min(0), 1e-12)
            # the box is half as large again, and where the data lies in it is drawn anew each time
            self.projections.append((p, low - rng.uniform(0, 0.5, d) * wide, 1.5 * wide))

    def keys(self, vectors: np.ndarray) -> list[np.ndarray]:
        out = []
        for p, low, wide in self.projections:
            cells = ((vectors - self.mean) @ p.T - low) / wide * (1 << self.bits)
            out.append(hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits))
        return out


_NONE = pd.DataFrame({"query": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's ``k`` nearest of the rows within its window; exact distances."""
    q, x = (np.stack(t["embedding"].to_numpy()).astype(np.float64) for t in (queries, rows))
    ids, own_rows, places = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["place"].to_numpy()
    found = []
    for at, own, low, high in zip(q, queries["query"], queries["low"], queries["high"], strict=True):
        there = np.flatnonzero((places >= low) & (places <= high) & (own_rows != own))
        if len(there):
            score = np.sqrt(((x[there] - at) ** 2).sum(1))
            top = np.lexsort((own_rows[there], ids[there], score))[:k]
            found.append(pd.DataFrame({"query": own, "row": own_rows[there][top], "vec_id": ids[there][top], "score": score[top]}))
    return pd.concat(found) if found else _NONE


def search(
    vectors: DataFrame, is_query: Column, *, k: int = 10, orderings: int = 16, rows: int = 50, share: float = 0.026, block: int = 2000, seed: int = 7
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: nearest found of ``vectors(vec_id, embedding)`` for the rows ``is_query``."""
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding", is_query.alias("asks"))
    good = settle(good.withColumn("row", F.monotonically_increasing_id()))  # numbered once: what follows reads the checkpoint
    sample = [r.embedding for r in good.orderBy(F.xxhash64("vec_id"), "vec_id", "row").select("embedding").limit(SAMPLE).collect()]
    if not sample:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths, counts = np.unique([len(v) for v in sample], return_counts=True)
    width = int(lengths[counts.argmax()])
    curves = Curves(np.array([v for v in sample if len(v) == width], dtype=np.float64), orderings, seed)
    good = good.where(F.size("embedding") == width)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                for o, key in enumerate(curves.keys(np.stack(part["embedding"].to_numpy()).astype(np.float64))):
                    yield pd.DataFrame({"ordering": np.int32(o), "key": key, "row": part["row"].to_numpy()})

    parts = spread(vectors.sparkSession)
    placed = ranked(good.select("row", "embedding").mapInPandas(place, "ordering int, key long, row long"), ["ordering", "key", "row"], parts)
    n, n_queries = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    window = rows + int(share * n)
    # places run on from one ordering to the next; a block never holds two
    placed = placed.withColumn("place", F.col("rank") - F.col("ordering") * F.lit(n)).select("ordering", "row", "place")
    placed = settle(placed.join(good, "row"))
    salts = max(1, -(-n_queries * min(n, 2 * window + block) // (n * block)))  # groups for the queries of a block
    blocks = placed.select("ordering", "row", "vec_id", "place", "embedding", F.floor(F.col("place") / block).alias("block"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    low, high = F.greatest(F.lit(0), F.col("place") - window), F.least(F.lit(n - 1), F.col("place") + window)
    asked = placed.where("asks").select("ordering", F.col("row").alias("query"), "embedding", low.alias("low"), high.alias("high"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)))

    def in_block(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return best(queries, rows, k) if len(queries) and len(rows) else _NONE

    by = ["ordering", "block", "salt"]
    found = asked.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(in_block, "query long, row long, vec_id long, score double")
    lists = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "vec_id", "row"))), 1, k).alias("best"))
    lists = lists.join(good.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return lists.select("query_id", F.posexplode("best")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score")
    )
