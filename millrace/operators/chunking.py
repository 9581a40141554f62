"""Cutting pages into chunks under a token budget.

Long texts become overlapping windows, long tables blocks of rows under their header; short pages and windows
are merged greedily in page order. Table chunks are numbered after all merged ones.

The greedy merge depends on its own past, so it runs as one fold for each job (``applyInArrow`` over sorted rows,
lengths only: the text never enters the fold); jobs are independent. Everything else is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TABLE_LINE, estimate_tokens, is_separator, is_table_text

MAX_TEXT_TOKENS, TABLE_ROWS, CHARS_PER_TOKEN = 2048, 80, 4
#: Slices in which the rows of sheets are numbered side by side.
SLICES = 64


def usable_tokens(context_window: int) -> int:
    return min(int(context_window * 0.3), MAX_TEXT_TOKENS)


def windows(text: Column, max_tokens: int, overlap: float) -> Column:
    """Array of windows of ``text``; the last may lie wholly in the one before."""
    width = CHARS_PER_TOKEN * max_tokens
    step = width - int(width * overlap)
    step = step if step > 0 else width
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def token_windows(docs: DataFrame, tokenizer: Callable[[], Any], max_tokens: int, overlap: float) -> DataFrame:
    """``(doc_id, part, text, n_tokens)`` of ``docs(doc_id, text)``: windows over a tokenizer's ids, decoded.

    ``tokenizer()`` is called once in each task and gives an object with ``encode`` and ``decode``. Empty texts have no window.
    """
    step = max_tokens - int(max_tokens * overlap)
    step = step if step > 0 else max_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = list(model.encode(text.as_py() or ""))
                parts = [ids[at : at + max_tokens] for at in range(0, len(ids), step)]
                columns = [pa.array([doc_id] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([model.decode(x) for x in parts], pa.string()), pa.array([len(x) for x in parts], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "text", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, part int, text string, n_tokens int")


_ROW, _LETTER = re.compile(TABLE_LINE), re.compile("[a-zA-Z]")


def split_table(text: str, rows: int = TABLE_ROWS) -> list[str]:
    """Blocks of a table's rows, each under header and separator; lines before the table go with the first block.

    The rows end at the first other text below them. A text without header, separator and rows stays whole.
    """
    lines = text.splitlines()
    kinds = ["other" if not _ROW.match(x) else "row" if _LETTER.search(x) else "separator" for x in lines]
    if "row" not in kinds:
        return [text]
    head = kinds.index("row")
    if "separator" not in kinds[head:]:
        return [text]
    sep = kinds.index("separator", head)
    data: list[str] = []
    for kind, line in zip(kinds[sep + 1 :], lines[sep + 1 :], strict=True):
        if kind == "row":
            data.append(line)
        elif kind == "other" and data and line.strip():
            break
    title = "\n".join(lines[: sep - 1]) + "\n\n" if sep > 1 else ""
    frame = f"{lines[head]}\n{lines[sep]}\n"
    return [(title if at == 0 else "") + frame + "\n".join(data[at : at + rows]) + "\n" for at in range(0, len(data), rows)] or [text]


def table_blocks(text: Column, rows: int = TABLE_ROWS) -> Column:
    """Array of table blocks; one linear pass in Python over Arrow batches, for long tables only."""
    return F.udf(lambda x: None if x is None else split_table(x, rows), "array<string>", useArrow=True)(text)


def _slice_of(x: Column, bounds: list[float], first: int = 0) -> Column:
    """How many of the sorted ``bounds`` are at most ``x``, by bisection; null counts none."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(x >= bounds[k], _slice_of(x, bounds[k + 1 :], first + k + 1)).otherwise(_slice_of(x, bounds[:k], first))


def row_blocks(table: DataFrame, keys: list[str], order: list[str], line: Column, head: str, rows: int = TABLE_ROWS) -> DataFrame:
    """``(keys, block, piece)``: the blocks of :func:`split_table` for each sheet of ``table``, whose rows give one ``line`` each.

    ``head`` is what stands above the rows, header and separator last. No sheet is put together: rows are numbered within
    slices of their sheet, cut at quantiles of the first of ``order`` (a number), and a slice starts where those before it
    end. Only a sheet all of separators is one piece, as it has nothing to cut.
    """
    probabilities = [i / SLICES for i in range(1, SLICES)]
    bounds = sorted(set(table.approxQuantile(order[0], probabilities, 0.25 / SLICES)))
    kept = table.select(*keys, *order, line.alias("_line"), _slice_of(F.col(order[0]), bounds).alias("_slice")).withColumn("_data", ~is_separator(F.col("_line")))
    sheet = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    counts = kept.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s")).agg(F.count_if("_data").alias("_n"))
    before = sheet.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(sheet)}).drop("_n")
    here = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = kept.withColumns({"_row": F.row_number().over(here), "_nth": F.count_if("_data").over(here)})
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = placed.join(starts, same).where("_data OR _total = 0")
    block = F.when(F.col("_total") > 0, F.floor((F.col("_start") + F.col("_nth") - 1) / rows)).otherwise(0).cast("int")
    parts = F.sort_array(F.collect_list(F.struct("_slice", "_row", "_line")))
    blocks = placed.groupBy(*keys, block.alias("block")).agg(F.array_join(F.transform(parts, lambda x: x["_line"]), "\n").alias("_body"), F.first("_total").alias("_total"))
    lines = head.splitlines()
    title = "\n".join(lines[:-2]) + "\n\n" if len(lines) > 2 else ""
    frame = "\n".join(lines[-2:]) + "\n"
    above = F.when(F.col("_total") == 0, head).when(F.col("block") == 0, title + frame).otherwise(frame)
    return blocks.select(*keys, "block", F.concat(above, "_body", F.lit("\n")).alias("piece"))


def segments(pages: DataFrame, max_tokens: int, overlap: float) -> DataFrame:
    """``(job_id, page_index, part, is_table, text, tokens)`` of ``pages(job_id, page_index, text)``."""
    text = F.col("text")
    long = estimate_tokens(text) > max_tokens
    pages = pages.where(text.isNotNull()).select("job_id", "page_index", "text")
    cut = lambda df, parts, table: df.select("job_id", "page_index", F.lit(table).alias("is_table"), F.posexplode(parts).alias("part", "text"))
    plain = cut(pages.where(~(long & is_table_text(text))), F.when(long, windows(text, max_tokens, overlap)).otherwise(F.array(text)), False)
    tables = cut(pages.where(long & is_table_text(text)), table_blocks(text), True)
    return plain.unionByName(tables).withColumn("tokens", estimate_tokens(F.col("text")))


def merge_numbers(parts: DataFrame, max_tokens: int) -> DataFrame:
    """Chunk of each of ``parts(job_id, page_index, part, tokens, chars)`` by the greedy merge, as ``chunk_index``."""
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("page_index", "ascending"), ("part", "ascending")])
        chunks, chunk, tokens, filled = [], 0, 0, False
        for size, chars in zip(table["tokens"].to_pylist(), table["chars"].to_pylist(), strict=True):
            if filled and tokens + size > max_tokens:
                chunk, tokens, filled = chunk + 1, 0, False
            tokens, filled = tokens + size, filled or chars > 0
            chunks.append(chunk)
        return table.select(["job_id", "page_index", "part", "tokens", "chars"]).append_column("chunk_index", pa.array(chunks, pa.int32()))

    schema = f"job_id {parts.schema['job_id'].dataType.simpleString()}, page_index {parts.schema['page_index'].dataType.simpleString()}, part int, tokens int, chars int, chunk_index int"
    return parts.select("job_id", "page_index", "part", "tokens", "chars").groupBy("job_id").applyInArrow(fold, schema)


def chunk_pages(pages: DataFrame, *, context_window: int = 32768, overlap: float = 0.1, with_text: bool = True) -> DataFrame:
    """``(job_id, chunk_index, source_pages, estimated_tokens[, text])`` of ``pages(job_id, page_index, text)``.

    A chunk's estimate is the sum of its segments' (joiners left out). A job whose texts are all empty has none.
    """
    budget = usable_tokens(context_window)
    cut = segments(pages, budget, overlap)
    plain = cut.where("NOT is_table").withColumn("chars", F.length("text"))
    merged = merge_numbers(plain, budget)
    if with_text:
        merged = merged.join(plain.select("job_id", "page_index", "part", "text"), ["job_id", "page_index", "part"])
    order = F.sort_array(F.collect_list(F.struct("page_index", "part", *(["text"] if with_text else []))))
    chunks = merged.groupBy("job_id", "chunk_index").agg(order.alias("_parts"), F.sum("tokens").cast("int").alias("estimated_tokens"), F.max("chars").alias("_chars")).where("_chars > 0")
    # joiners go between texts once one is not empty
    joined = F.regexp_replace(F.array_join("_parts.text", "\n\n"), r"^(\n\n)+", "")
    lead = F.aggregate("_parts.text", F.lit(0), lambda n, x: F.when(n < 0, n).when(x == "", n + 1).otherwise(-n - 1)) if with_text else None
    texts = [F.when(lead == -1, F.array_join("_parts.text", "\n\n")).otherwise(joined).alias("text")] if with_text else []
    chunks = chunks.select("job_id", "chunk_index", F.array_distinct("_parts.page_index").alias("source_pages"), "estimated_tokens", *texts)
    base = chunks.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("_base"))
    tables = cut.where("is_table").join(base, "job_id", "left")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("page_index", "part")) - 1
    tables = tables.select(
        "job_id", (F.coalesce("_base", F.lit(0)) + place).cast("int").alias("chunk_index"), F.array("page_index").alias("source_pages"),
        F.col("tokens").alias("estimated_tokens"), *(["text"] if with_text else []),
    )
    return chunks.unionByName(tables)
