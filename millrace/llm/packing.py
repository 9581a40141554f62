"""Packing documents into sequences of at most ``capacity`` tokens.

Every document's ids end with the tokenizer's ``end``; only documents longer than the capacity are cut, into full pieces
with a shorter piece first. How pieces are packed depends on their lengths alone, so the plan is made over
the histogram of lengths (at most ``capacity`` counts, however many documents there are):

1. Martello-Toth dominance reduction fixes sets that no better packing can need to break: a length that no
   other fits beside stays alone, two lengths that fill a sequence exactly are paired, and a length beside
   which at most one other piece fits is paired with the longest that does. Fixing shrinks the instance,
   so this repeats until nothing more is dominated.
2. Best fit in decreasing order takes the rest; sequences with equal free space are handled by the run.

The plan is a list of patterns with multiplicities (at most a few per length), small enough to send to every
task. Pieces are then ranked within their length and looked up in it. The rank is salted: a length that a
third of all pieces share is spread over many groups, whose counts are summed up first. Full pieces are
sequences of their own and need no rank.

Token ids are made once and cut off from the plan with a checkpoint; of them only lengths and checksums are
kept. Ids come from the byte-level vocabulary in rank form, with texts cut at single spaces between other
characters (the pre-tokenizer puts a boundary there, and the space goes with the word after it). Words are looked up
in a bounded cache, all new words of a slice of texts are encoded in one call, and the ids of the slice are gathered
from the cache at once; tests hold them equal to the tokenizers library's.

Defined results: null and empty texts have the end id alone; special strings inside a text become special
tokens, as the library does by default; repeated rows are packed each by itself; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, spread

#: The cache of words is emptied beyond so many words or ids. Texts are encoded in slices of so many characters.
CACHE_WORDS, CACHE_IDS, SLICE_CHARS = 400_000, 4_000_000, 1 << 19
#: Cache keys that no word is equal to, as words hold no space: a document's end, and no word at all before a space.
_END, _NO_HEAD = "  end", "  "


class _Numbers(dict):
    """Number of a word, in order of appearance; ``new`` lists those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class ByteBpe:
    """Ids of texts, each with the ids ``end`` after it, from a byte-level vocabulary in rank form."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int], end: Sequence[int] = ()):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special, self.end = tuple(special), list(end)
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.empty(0, dtype="<u4")
        self.begin = self.size = np.empty(0, dtype=np.int64)
        self.unsafe = np.empty(0, dtype=bool)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text, allowed_special="all"), dtype="<u4")

    def _learn(self) -> None:
        """Encode the new words: a key that starts with a space is a text's first word, others stand after a space."""
        new, self.numbers.new = self.numbers.new, []
        together = [i for i, word in enumerate(new) if word and word.strip() == word]
        text = " " + " ".join([new[i] for i in together])
        if any(x in text for x in self.special):
            together = [i for i in together if not any(x in new[i] for x in self.special)]
            text = " " + " ".join([new[i] for i in together])
        ids = np.array(self.model.encode_ordinary(text) if together else [], dtype="<u4")
        spaces = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == 32)[: len(together)]
        at = np.append(np.searchsorted(np.cumsum(self.token_bytes[ids]), spaces, side="right"), len(ids))
        begin, size, unsafe = (np.zeros(len(new), dtype=t) for t in (np.int64, np.int64, bool))
        begin[together], size[together] = at[:-1], np.diff(at)
        alone, made = [ids], len(ids)
        for i in set(range(len(new))).difference(together):
            word = new[i]
            if word == _END:
                alone.append(np.array(self.end, dtype="<u4"))
            elif word == _NO_HEAD or not word or word != " " and word[-1].isspace() or word[0] != " " and word[0].isspace():
                unsafe[i] = True
                continue
            else:
                alone.append(self.whole(word[1:] if word[0] == " " else " " + word))
            begin[i], size[i] = made, len(alone[-1])
            made += len(alone[-1])
        self.begin = np.concatenate([self.begin, len(self.flat) + begin])
        self.flat = np.concatenate([self.flat, *alone])
        self.size, self.unsafe = np.concatenate([self.size, size]), np.concatenate([self.unsafe, unsafe])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, followed by ``end``."""
        if len(self.numbers) > CACHE_WORDS or len(self.flat) > CACHE_IDS:
            self.forget()
        words: list[str] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            parts = text.split(" ")
            parts[0] = _NO_HEAD if not parts[0] and len(parts) > 1 else " " + parts[0]
            words += parts
            words.append(_END)
            counts[i] = len(parts) + 1
        numbers = np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))
        if self.numbers.new:
            self._learn()
        size = self.size[numbers]
        last = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[numbers] - last + size, size) + np.arange(last[-1])]
        upto = np.cumsum(counts)
        parts = np.split(ids, last[upto[:-1] - 1])
        for i in np.flatnonzero(np.logical_or.reduceat(self.unsafe[numbers], upto - counts)):
            parts[i] = np.concatenate([self.whole(texts[i]), np.array(self.end, dtype="<u4")])
        return parts


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``SLICE_CHARS`` characters, a longer text alone."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > SLICE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenize(docs: DataFrame, tokenizer, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``; ``tokenizer()`` makes a :class:`ByteBpe` on the worker."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for lo, hi in slices(texts):
                for doc_id, tokens in zip(ids[lo:hi], model.encode_all(texts[lo:hi]), strict=True):
                    for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(tokens[start : start + length])))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            columns[1] = columns[1].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """``times`` sequences that each hold ``pattern``: (length, count) pairs in order."""

    pattern: list[tuple[int, int]]
    times: int


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[Run]:
    """Fix dominating sets; ``counts`` (pieces by length) is left with the rest."""
    fixed: list[Run] = []

    def take(pattern: list[tuple[int, int]], times: int) -> None:
        fixed.append(Run(pattern, times))
        for length, n in pattern:
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]

    def smallest(but: int) -> tuple[int | None, int | None]:
        """The two shortest pieces besides one of length ``but``."""
        found: list[int] = []
        for length in sorted(counts):
            found += [length] * min(2, counts[length] - (length == but))
            if len(found) >= 2:
                break
        return (found + [None, None])[0], (found + [None, None])[1]

    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while j in counts:
                room = capacity - j
                one, two = smallest(j)
                if one is None or one > room:
                    take([(j, 1)], counts[j])
                elif room == j and counts[j] >= 2:
                    take([(j, 2)], counts[j] // 2)
                elif room != j and room in counts:
                    take([(j, 1), (room, 1)], min(counts[j], counts[room]))
                elif two is None or one + two > room:
                    partner = max(x for x in counts if x <= room and (x != j or counts[j] >= 2))
                    if partner == j:
                        take([(j, 2)], counts[j] // 2)
                    else:
                        take([(j, 1), (partner, 1)], min(counts[j], counts[partner]))
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit in decreasing order of length, a run of equal sequences at a time."""
    free: dict[int, list[Run]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = next((r for r in range(length, capacity) if free.get(r)), capacity)
            run = free[space].pop() if space < capacity else Run([], -(-left // (capacity // length)))
            each = min(space // length, left)
            whole = min(run.times, left // each)
            free[space - each * length].append(Run([*run.pattern, (length, each)], whole))
            left -= each * whole
            if run.times > whole:
                rest = Run(run.pattern, run.times - whole)
                if not left and space < capacity:
                    free[space].append(rest)
                elif left and space == capacity:
                    free[space - left * length].append(Run([(length, left)], 1))
                    left = 0
                elif left:
                    free[space].append(rest)
    return [run for runs in free.values() for run in runs if run.times]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Patterns that hold every piece shorter than the capacity."""
    counts = {length: n for length, n in counts.items() if n and length < capacity}
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(runs: list[Run]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, count in a sequence, first sequence, offset), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for run in runs:
        offset = 0
        for length, n in run.pattern:
            out[length].append((given[length], n, sequence, offset))
            given[length] += n * run.times
            offset += n * length
        sequence += run.times
    return dict(out)


def assign(ranked: DataFrame, where: dict[int, list[tuple[int, int, int, int]]]) -> DataFrame:
    """Sequence and offset of ``(doc_id, piece, start, length, ids_crc32, rank)``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {length: np.array(rows, dtype=np.int64).T for length, rows in where.items()}
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy().astype(np.int64)
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            found, at = np.unique(lengths[order], return_index=True)
            for length, rows in zip(found, np.split(order, at[1:]), strict=True):
                first, n, base, start = tables[int(length)]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                past = ranks[rows] - first[k]
                sequence[rows] = base[k] + past // n[k]
                offset[rows] = start[k] + past % n[k] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer, *, capacity: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for each piece of ``docs(doc_id, text)``."""
    pieces = settle(tokenize(docs, tokenizer, capacity))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = slots(plan(dict(counts), capacity))
    short, full = pieces.where(F.col("length") < capacity), pieces.where(F.col("length") == capacity)
    salts = max(2 * spread(docs.sparkSession), sum(counts.values()) // 20_000)
    short = short.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = short.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = short.withColumn("_rank", F.row_number().over(within)).join(starts, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_rank") - 1).alias("rank"))
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return assign(ranked, where).unionByName(alone)
