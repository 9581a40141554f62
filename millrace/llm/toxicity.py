"""Toxicity scores from a bidirectional gated recurrent network over words and characters.

A text's words (letters only, lower case) are read in overlapping windows. A run of more than ``LONGEST`` letters
(a clause in a script without spaces, words run together) is read whole, as pieces of that length that overlap by half. A word's input is its own vector, if
the training sample's vocabulary has it, beside the mean vector of its character trigrams, so unseen spellings
are read too. Both directions of a gated recurrent layer run over a window, attention pools their states, and
a logistic layer scores the window. A document's score is that of its most toxic window, all windows counted,
calibrated by a logistic curve to a probability.

Everything is numpy: training by back-propagation through time and Adam on the driver, over at most
``TRAIN_POSITIVE`` and ``TRAIN_NEGATIVE`` labelled documents (the smallest by hashed id, of up to ``SAMPLE_CHARS`` characters each); scoring in Arrow batches
on the executors. Documents are labelled as a whole, so training picks windows: at first those whose words
lean most towards the toxic class, then those that the network itself scores highest, and random ones.

Defined results: null, empty and wordless texts have one blank window; a null label is no label; with no labelled
documents, or of one class only, every score is the prior (0.05 without labels); repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_POSITIVE, TRAIN_NEGATIVE, SAMPLE_CHARS = 700, 1500, 20_000
VOCABULARY, TRIGRAMS = 4000, 4096
WORD, CHAR, HIDDEN, ATTENTION = 8, 8, 8, 8
WINDOW, STRIDE = 32, 16
CACHE_WORDS, BATCH = 400_000, 4096
STEPS = 100  # batches of training in each round, at least
LONGEST = 40  # letters of a word; longer runs are several
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    runs = _LETTERS.findall(text.lower()) if text else []
    if max(map(len, runs), default=0) <= LONGEST:
        return runs
    half = LONGEST // 2
    return [w[at : at + LONGEST] for w in runs for at in range(0, max(len(w) - half, 1), half)]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character trigrams, edges marked, and how many each word has."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    flat = ((a * 961 + b * 31 + c) * 2654435761 % 4294967296 % TRIGRAMS)[(a != 3) & (b != 3)]
    return flat.astype(np.int64), np.array([len(w) for w in words], dtype=np.int64)


def window_starts(n: int) -> range | list[int]:
    """Where the windows of ``n`` words start; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name; ``vocabulary`` maps a word to its row, row 0 is for all others."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: float = 1.0
    shift: float = 0.0
    prior: float | None = None

    def start(self, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"words": rng.normal(0, 0.3, (len(self.vocabulary) + 1, WORD)).astype(np.float32), "chars": rng.normal(0, 0.3, (TRIGRAMS, CHAR)).astype(np.float32)}
        self.p["words"][0] = 0
        for way in "fb":
            self.p |= {f"{way}_in": draw(WORD + CHAR, 3 * HIDDEN), f"{way}_bias": np.zeros(3 * HIDDEN, np.float32), f"{way}_gates": draw(HIDDEN, 2 * HIDDEN), f"{way}_new": draw(HIDDEN, HIDDEN)}
        self.p |= {"att": draw(2 * HIDDEN, ATTENTION), "att_bias": np.zeros(ATTENTION, np.float32), "att_out": draw(ATTENTION, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        return self

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words, and what their gradient needs."""
        rows = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        flat, sizes = trigrams(words)
        chars = np.add.reduceat(self.p["chars"][flat], np.cumsum(sizes) - sizes) / sizes[:, None] if len(words) else np.zeros((0, CHAR), np.float32)
        return np.concatenate([self.p["words"][rows], chars.astype(np.float32)], axis=1), (rows, flat, sizes)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions for distinct words: all of a word that a window needs."""
        return np.concatenate([x @ self.p["f_in"] + self.p["f_bias"], x @ self.p["b_in"] + self.p["b_bias"]], axis=1)

    def run(self, table: np.ndarray, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Window logits; ``ids`` (windows, WINDOW) index ``table``, the output of :meth:`project`."""
        n, steps = ids.shape
        mask = (np.arange(steps)[None, :] < lengths[:, None])[:, :, None].astype(np.float32)
        states = np.zeros((n, steps, 2 * HIDDEN), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for way, at, order in (("f", 0, range(steps)), ("b", 1, range(steps - 1, -1, -1))):
            gates_in, new_in = self.p[f"{way}_gates"], self.p[f"{way}_new"]
            h = np.zeros((n, HIDDEN), np.float32)
            mine = table[:, at * 3 * HIDDEN : (at + 1) * 3 * HIDDEN]
            for t in order:
                given = mine[ids[:, t]]
                gates = _sigmoid(given[:, : 2 * HIDDEN] + h @ gates_in)
                z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(given[:, 2 * HIDDEN :] + (r * h) @ new_in)
                moved = h + (z * (new - h)) * mask[:, t]
                if keep:
                    trace[way].append((t, h, z, r, new))
                h = moved
                states[:, t, at * HIDDEN : (at + 1) * HIDDEN] = h
        hidden = np.tanh(states @ self.p["att"] + self.p["att_bias"])
        weight = np.where(mask[:, :, 0] > 0, hidden @ self.p["att_out"], -30)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight = weight / weight.sum(1, keepdims=True) * mask[:, :, 0]
        pooled = (states * weight[:, :, None]).sum(1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (mask, states, trace, hidden, weight, pooled)) if keep else logit

    def gradients(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss over windows of ``words``."""
        x, (rows, flat, sizes) = self.inputs(words)
        logit, (mask, states, trace, hidden, weight, pooled) = self.run(self.project(x), ids, lengths, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((_sigmoid(logit) - labels) * weights / weights.sum()).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.p["out"]
        d_states = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = (states * d_pooled[:, None, :]).sum(2)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["att_out"] = np.einsum("nta,nt->a", hidden, d_score)
        d_hidden = d_score[:, :, None] * self.p["att_out"] * (1 - hidden**2)
        g["att"], g["att_bias"] = np.einsum("nth,nta->ha", states, d_hidden), d_hidden.sum((0, 1))
        d_states = d_states + d_hidden @ self.p["att"].T
        d_x = np.zeros_like(x)
        for way, at in (("f", 0), ("b", 1)):
            gates_in, new_in, w_in = self.p[f"{way}_gates"], self.p[f"{way}_new"], self.p[f"{way}_in"]
            d_table = np.zeros((len(words), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, r, new in reversed(trace[way]):
                d_h = carry + d_states[:, t, at * HIDDEN : (at + 1) * HIDDEN]
                m = mask[:, t]
                d_new = d_h * z * m * (1 - new**2)
                d_rh = d_new @ new_in.T
                d_gates = np.concatenate([d_h * (new - h) * m * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
                g[f"{way}_new"] += (r * h).T @ d_new
                g[f"{way}_gates"] += h.T @ d_gates
                np.add.at(d_table, ids[:, t], np.concatenate([d_gates, d_new], axis=1))
                carry = d_h * (1 - z * m) + d_rh * r + d_gates @ gates_in.T
            g[f"{way}_in"], g[f"{way}_bias"] = x.T @ d_table, d_table.sum(0)
            d_x += d_table @ w_in.T
        np.add.at(g["words"], rows, d_x[:, :WORD])
        g["words"][0] = 0
        np.add.at(g["chars"], flat, np.repeat(d_x[:, WORD:] / sizes[:, None], sizes, axis=0))
        return g

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return np.full(len(logit), self.prior) if self.prior is not None else _sigmoid(self.scale * logit + self.shift)


class _Index(dict):
    """Row of a word, from 1 in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        return row


class Reader:
    """Window and document logits of one network, with a bounded cache of words."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.table = self.network.project(np.zeros((1, WORD + CHAR), np.float32))

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int32, count=len(words))

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, logit) of every window of texts given as word rows."""
        if len(self.index) >= len(self.table):
            fresh = list(self.index)[len(self.table) - 1 :]
            self.table = np.concatenate([self.table, self.network.project(self.network.inputs(fresh)[0])])
        owners, places, rows, lengths = [], [], [], []
        for i, ids in enumerate(texts):
            starts = window_starts(len(ids))
            owners += [i] * len(starts)
            places += starts
            if len(ids) <= WINDOW:
                rows.append(np.pad(ids, (0, WINDOW - len(ids)))[None, :])
                lengths.append(len(ids))
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[np.asarray(starts)])
                lengths += [WINDOW] * len(starts)
        ids, sizes = np.concatenate(rows), np.array(lengths)
        logits = [self.network.run(self.table, ids[at : at + BATCH], sizes[at : at + BATCH]) for at in range(0, len(ids), BATCH)]
        return np.array(owners), np.array(places), np.concatenate(logits)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest window logit of each text."""
        out = np.full(len(texts), -np.inf, dtype=np.float64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def run() -> None:
            if held:
                at, _, logit = self.windows(held)
                np.maximum.at(out, np.array(owners)[at], logit)
                held.clear(), owners.clear()

        size = 0
        for i, text in enumerate(texts):
            ids = self.ids(words_of(text))
            for piece in self.pieces(ids):  # a long text's windows may fill several batches
                held.append(piece)
                owners.append(i)
                size += len(piece) // STRIDE + 1
                if size >= BATCH:
                    run()
                    size = 0
            if len(self.index) > CACHE_WORDS:
                run()
                self.forget()
        run()
        return out

    @staticmethod
    def pieces(ids: np.ndarray) -> Iterator[np.ndarray]:
        """Parts that share a window's overlap, so that together they have exactly the text's windows."""
        step = STRIDE * BATCH
        at = 0
        while len(ids) - at > step + WINDOW:
            yield ids[at : at + step - STRIDE + WINDOW]
            at += step
        yield ids[at:]


def train(texts: list[str | None], labels: list[int], *, seed: int = 5, rounds: int = 3, epochs: int = 3, rate: float = 0.02) -> Network:
    """A network from labelled texts; the same input gives the same network."""
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Network({}, prior=float(y.mean()) if len(y) else 0.05).start(seed)
    docs = [words_of(t) for t in texts]
    seen = [Counter(), Counter()]
    for words, label in zip(docs, labels, strict=True):
        seen[label].update(set(words))
    total = seen[0] + seen[1]
    common = sorted((w for w, n in total.items() if n >= 2), key=lambda w: (-total[w], w))[:VOCABULARY]
    net = Network({w: i + 1 for i, w in enumerate(common)}).start(seed)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    lean = {w: np.log((seen[1][w] + 0.2) / (n1 + 1)) - np.log((seen[0][w] + 0.2) / (n0 + 1)) for w in total}
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        # each document gives its most telling window, negatives more of them, and a random one
        chosen: list[tuple[list[str], int]] = []
        reader = Reader(net)
        owner, place, logit = reader.windows([reader.ids(words) for words in docs])
        first = np.searchsorted(owner, np.arange(len(docs) + 1))
        for i, (words, label) in enumerate(zip(docs, labels, strict=True)):
            starts = place[first[i] : first[i + 1]].tolist()
            told = logit[first[i] : first[i + 1]] if turn else [max([lean[w] for w in words[s : s + WINDOW]], default=0.0) for s in starts]
            top = np.argsort(told)[::-1][: 1 if label else 2]
            for s in {*(starts[j] for j in top), *((starts[rng.integers(len(starts))],) if not label else ())}:
                chosen.append((words[s : s + WINDOW], label))
        for _ in range(max(epochs, -(-STEPS * 128 // len(chosen)))):
            order = rng.permutation(len(chosen))
            for at in range(0, len(order), 128):
                batch = [chosen[i] for i in order[at : at + 128]]
                distinct = sorted({w for words, _ in batch for w in words}) or ["a"]
                index = {w: i for i, w in enumerate(distinct)}
                ids = np.zeros((len(batch), WINDOW), dtype=np.int64)
                for i, (words, _) in enumerate(batch):
                    ids[i, : len(words)] = [index[w] for w in words]
                lengths = np.array([len(words) for words, _ in batch])
                target = np.array([label for _, label in batch], dtype=np.float32)
                step += 1
                pace = rate * (0.3 if turn == rounds - 1 else 1.0)
                for k, g in net.gradients(distinct, ids, lengths, target, np.ones(len(batch), np.float32)).items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    # calibrate document scores: logistic regression on one input, by Newton's method with a little ridge
    x = Reader(net).score(texts)
    a, b = 1.0, 0.0
    for _ in range(30):
        q = _sigmoid(a * x + b)
        s = np.maximum(q * (1 - q), 1e-6)
        grad = np.array([((q - y) * x).sum() + 1e-2 * (a - 1), (q - y).sum()])
        hess = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-2]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
    net.scale, net.shift = float(max(a, 1e-3)), float(b)
    return net


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, positive: int = TRAIN_POSITIVE, negative: int = TRAIN_NEGATIVE) -> tuple[list, list]:
    """Texts and labels of a bounded sample; ``labels(doc_id, label)`` says 1 or 0."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    picked = None
    for label, most in ((1, positive), (0, negative)):
        some = known.where(F.col("label") == label).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    # at most positive + negative ids: small enough to send to every task, whatever the corpus. Of rows that share an
    # id one is learnt from; texts over SAMPLE_CHARS characters are not learnt from, only scored
    text = F.coalesce("text", F.lit(""))
    found = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", text.alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r.label))
    return [r.text for r in rows], [int(r.label) for r in rows]


def score(docs: DataFrame, network: Network, cut: float) -> DataFrame:
    """``(doc_id, score, predicted)`` for each row of ``docs(doc_id, text)``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = network.probability(reader.score(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, predicted int")
