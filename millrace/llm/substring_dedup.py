"""Removing long passages that an earlier document already holds.

A word goes when a window of ``span`` words covers it whose word sequence also starts in a document with a
smaller id; windows are judged on the input as it stands.

Anchors by difference cover: with ``D`` a difference cover modulo ``P``, any two places i and j have an offset
d < P for which both i + d and j + d fall in ``D`` modulo ``P``. So two equal windows of ``span`` words share
an anchor, a window of ``span - P + 1`` words at such a place, and it is enough to hash anchors at the places in
``D``: 6 of every 31. Four steps, none of which pairs documents:

1. Rows that repeat a smaller document word for word lose all their words at once; they are told by their id and
   the hash of their text, so that rows which only share the id keep theirs. Documents of which every row is such
   a copy take no further part.
2. Anchors are counted by hash (a document counts once); those counted once are dropped.
3. Documents with shared anchors extend them: every window of ``span`` words with a shared anchor among its
   first ``P`` places is hashed to 96 bits, and the smallest document id of each hash is found.
4. A document's windows with a smaller document elsewhere are marked, and the words they cover removed.

Anchors and windows are distinct within a document and pre-aggregated before each shuffle, so a passage in
a third of all documents is a count, not a group; the joins back are plain and split by adaptive execution.

Defined results: null and empty texts have no words; rows with the same id are one document to each other
(none removes from another); a null id comes last, and rows without one are one document; an empty table gives an empty result; ``kept`` joins the kept words by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .wordhash import Hasher, Slice, U, slices, unique_pairs

SPAN = 50
#: A perfect difference cover: every residue modulo 31 is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
SEEDS = (11, 12)
HASHERS = tuple(Hasher(s) for s in SEEDS)


def row_key() -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64("text")


def _anchors(part: Slice, words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the slice, hash) of the anchors of a slice."""
    size = span - PERIOD + 1
    owner = part.text_of_word()
    place = np.arange(len(words)) - np.repeat(part.bounds[:-1], part.counts)
    n = max(0, len(words) - size + 1)
    inside = part.inside(size) & np.isin(place[:n] % PERIOD, COVER)
    at = np.flatnonzero(inside)
    return owner[at], at, HASHERS[0].windows(words, size)[at].view(np.int64)


def anchors(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct ``(anchor, doc_id)``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for part in slices(batch.column("text")):
                words = HASHERS[0].words(part.data, part.starts, part.ends)
                owner, _, key = _anchors(part, words, span)
                owner, key = unique_pairs(owner, key)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[part.first + owner])], ["anchor", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(hashed, "anchor long, doc_id long")


def sequences(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, n, s1, s2)``: the hash of the row's text, how many words, and two hashes of their sequence."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                sums = [x.whole(x.words(part.data, part.starts, part.ends), part.bounds).view(np.int64) for x in HASHERS]
                given = [batch.column(c).slice(part.first, part.n) for c in ("doc_id", "row_key")]
                columns = [*given, pa.array(part.counts.astype(np.int64)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "n", "s1", "s2"])

    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(hashed, "doc_id long, row_key long, n long, s1 long, s2 long")


def copies(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``(doc_id, copied, all_copied)`` of documents with a row of at least ``span`` words that repeats a smaller one word for word.

    ``copied`` lists the keys of those rows; ``all_copied`` says whether the document has no other row of that length.
    """
    known = settle(sequences(docs).where(F.col("n") >= span))
    firsts = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last")).where("first_doc < _last")
    is_copy = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False))
    rows = known.join(firsts.drop("_last"), ["n", "s1", "s2"], "left").select("doc_id", "row_key", is_copy.alias("is_copy"))
    marked = rows.groupBy("doc_id").agg(F.collect_set(F.when(F.col("is_copy"), F.col("row_key"))).alias("copied"), F.min("is_copy").alias("all_copied"))
    return marked.where(F.size("copied") > 0)


def _windows(part: Slice, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every window of a slice, of 64 and 32 bits, and which windows lie within one text."""
    h = [x.windows(x.words(part.data, part.starts, part.ends), span) for x in HASHERS]
    return h[0].view(np.int64), (h[1] >> U(32)).astype(np.uint32).view(np.int32), part.inside(span)


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct ``(w1, w2, doc_id)`` of the windows around the shared anchors of ``docs(doc_id, text, anchors)``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(), batch.column("anchors")
            for part in slices(batch.column("text")):
                words = HASHERS[0].words(part.data, part.starts, part.ends)
                owner, at, key = _anchors(part, words, span)
                known = lists.slice(part.first, part.n)
                mine_owner = np.repeat(np.arange(part.n), np.diff(known.offsets.to_numpy()))
                hit = _member(owner, key, mine_owner, known.flatten().to_numpy(zero_copy_only=False))
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                # a window takes part if a shared anchor starts at one of its first PERIOD places
                np.add.at(mark, np.maximum(at[hit] - PERIOD + 1, 0), 1)
                np.add.at(mark, at[hit] + 1, -1)
                n = max(0, len(words) - span + 1)
                w1, w2, inside = _windows(part, span)
                chosen = np.flatnonzero((np.cumsum(mark)[:n] > 0) & inside)
                text = part.text_of_word()[chosen]
                order = np.lexsort((w2[chosen], w1[chosen], text))
                chosen, text = chosen[order], text[order]
                new = np.ones(len(chosen), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (w1[chosen[1:]] != w1[chosen[:-1]]) | (w2[chosen[1:]] != w2[chosen[:-1]])
                chosen, text = chosen[new], text[new]
                yield pa.RecordBatch.from_arrays([pa.array(w1[chosen]), pa.array(w2[chosen]), pa.array(ids[part.first + text])], ["w1", "w2", "doc_id"])

    return docs.select("doc_id", "text", "anchors").mapInArrow(hashed, "w1 long, w2 int, doc_id long")


def _member(owner: np.ndarray, key: np.ndarray, set_owner: np.ndarray, set_key: np.ndarray) -> np.ndarray:
    """Whether each (owner, key) is among the (set_owner, set_key)."""
    if not len(set_key) or not len(key):
        return np.zeros(len(key), dtype=bool)
    both_owner, both_key = np.concatenate([set_owner, owner]), np.concatenate([set_key, key])
    order = np.lexsort((both_key, both_owner))
    o, k = both_owner[order], both_key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    group = np.empty(len(k), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    listed = np.zeros(int(new.sum()), dtype=bool)
    listed[group[: len(set_key)]] = True
    return listed[group[len(set_key) :]]


def removed_words(docs: DataFrame, span: int = SPAN, carry: str | None = None) -> DataFrame:
    """``docs(doc_id, text, repeats, is_copy)`` to ``(doc_id, n_words, n_removed, kept_sha256)``.

    ``repeats`` lists the first hash of the document's windows that an earlier document holds. With ``carry``, that
    column goes along and so does ``kept``: the text, of kept words joined by one space if any went.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if carry:
        schema += f", kept string, {carry} {docs.schema[carry].dataType.simpleString()}"

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, whole = batch.column("doc_id"), batch.column("repeats"), batch.column("is_copy")
            for part in slices(batch.column("text")):
                known = lists.slice(part.first, part.n)
                cover = np.zeros(int(part.bounds[-1]) + 1, dtype=np.int64)
                if len(known.flatten()):
                    w1 = HASHERS[0].windows(HASHERS[0].words(part.data, part.starts, part.ends), span).view(np.int64)
                    at = np.flatnonzero(part.inside(span))
                    sizes = np.array([len(x) if x.is_valid else 0 for x in known])
                    hit = at[_member(part.text_of_word()[at], w1[at], np.repeat(np.arange(part.n), sizes), known.flatten().to_numpy(zero_copy_only=False))]
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + span, -1)
                copy = np.array([bool(x.as_py()) for x in whole.slice(part.first, part.n)])
                gone = (np.cumsum(cover)[:-1] > 0) | np.repeat(copy, part.counts)
                so_far = np.concatenate([[0], np.cumsum(gone)])
                removed = so_far[part.bounds[1:]] - so_far[part.bounds[:-1]]
                rows = []
                data = part.data.tobytes()
                for d in range(part.n):
                    lo, hi = part.bounds[d], part.bounds[d + 1]
                    if removed[d]:
                        keep = np.flatnonzero(~gone[lo:hi]) + lo
                        kept = b" ".join([data[s:e] for s, e in zip(part.starts[keep].tolist(), part.ends[keep].tolist(), strict=True)])
                    else:
                        kept = b" ".join(data[part.offsets[d] : part.offsets[d + 1]].split())
                    rows.append(kept)
                columns = [ids.slice(part.first, part.n), pa.array(part.counts.astype(np.int64)), pa.array(np.asarray(removed, dtype=np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if carry:
                    texts = batch.column("text").slice(part.first, part.n).to_pylist()
                    columns += [pa.array([x.decode() if n else text for x, n, text in zip(rows, removed, texts, strict=True)], pa.string()), batch.column(carry).slice(part.first, part.n)]
                    names += ["kept", carry]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text", "repeats", "is_copy", *([carry] if carry else [])).mapInArrow(cleaned, schema)


def remove_repeats(docs: DataFrame, *, span: int = SPAN, carry: str | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for each row of ``docs(doc_id, text)``; see :func:`removed_words`."""
    none = F.lit((1 << 63) - 1)
    given = docs.select(F.coalesce("doc_id", none).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([carry] if carry else []))
    docs = given.select("doc_id", "text")
    copied = settle(copies(docs, span))
    found = anchors(docs, span)
    common = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    per_doc = found.join(common, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")).join(copied.where("all_copied"), "doc_id", "left_anti")
    around = windows(docs.join(per_doc, "doc_id"), span)
    firsts = around.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = around.join(firsts, ["w1", "w2"]).where("doc_id > first_doc")
    nothing = F.lit(None).cast("array<long>")
    repeats = later.groupBy("doc_id").agg(F.collect_list("w1").alias("repeats")).withColumn("copied", nothing)
    # a document may have rows that are copies and others with repeated windows
    repeats = repeats.unionByName(copied.select("doc_id", nothing.alias("repeats"), "copied")).groupBy("doc_id")
    repeats = repeats.agg(F.first("repeats", True).alias("repeats"), F.first("copied", True).alias("copied"))
    is_copy = F.coalesce(F.array_contains("copied", row_key()), F.lit(False))
    out = removed_words(given.join(repeats, "doc_id", "left").withColumn("is_copy", is_copy), span, carry)
    return out.withColumn("doc_id", F.nullif("doc_id", none))
