"""Token counts by a sentencepiece model, in Arrow batches that return lengths only.

Texts are cut at safe boundaries into pieces of bounded size and encoded in batches of about equal bytes,
so neither one long text nor an uneven batch decides the memory or the pace of a task. A boundary is safe
at a single space between two characters that are neither space nor the model's space mark: the model
marks a word's space at its front, no piece of its vocabulary has that mark after another character, and
a piece of text gets the mark that the dropped space would have given. Models for which that does not hold
(see :func:`cuts_are_safe`) get their texts whole.

Defined results: null and empty texts have no tokens; special strings inside a text are ordinary text, as
the library does by default; a text without a safe boundary is encoded whole; repeated rows are counted
alike; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PIECE_CHARS, BATCH_BYTES = 8192, 1 << 20
_CUT = re.compile(rf"(?<=[^\s{MARK}]) (?=[^\s{MARK}])")


def cuts_are_safe(model) -> bool:
    """Whether counts of pieces cut at single spaces add up to the whole's."""
    inside = any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.vocab_size()))
    return not inside and model.encode(["a b", "a", "b", " a"], out_type=str)[:3] == [[MARK + "a", MARK + "b"], [MARK + "a"], [MARK + "b"]] and len(model.encode(" a")) == 2


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary after every ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def count_tokens(docs: DataFrame, model_path: str, limit: int, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs(doc_id, text)``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        safe = cuts_are_safe(model)
        for batch in batches:
            totals = np.zeros(batch.num_rows, dtype=np.int64)
            held: list[str] = []
            rows: list[int] = []
            size = 0

            def flush():
                np.add.at(totals, rows, [len(x) for x in model.encode(held, num_threads=1)])
                held.clear(), rows.clear()

            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                for piece in (pieces(text) if safe else (text,)) if text else ():
                    held.append(piece)
                    rows.append(i)
                    size += len(piece) if piece.isascii() else len(piece.encode())
                    if size >= batch_bytes:
                        flush()
                        size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals)], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
