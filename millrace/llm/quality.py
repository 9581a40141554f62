"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Votes are counted by pattern (at most
3 to the number of rules, however many documents there are), and expectation-maximisation over those counts
estimates how often each rule votes bad on good and on bad documents, and the share of good documents.
A document is kept when its posterior probability of being good reaches ``keep_at``; no rule alone decides.

Every fault has two rules, a strict and a mild one: rules for different faults seldom agree, so it is the agreement
within a fault that tells EM which votes go together, and so which class is which. All rules start alike, and one
prior holds for them all (``SLIP``, ``CATCH``, ``GOOD``, worth ``WEIGHT`` of the documents): it keeps rates off 0 and 1 and leaves
the rest to the votes. A rule whose votes agree with no other comes out as telling nothing, however strict.

The whole of it is DataFrame and SQL functions: features by array functions within a row (no shuffle of
texts), one grouped count, and the iterations as one ``aggregate`` over the array of patterns. One row with
the estimated rates comes back to the driver.

Defined results: a null text counts as empty and has no words; an empty table gives an empty result (the
starting rates are used); repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, settle, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else good where ``good`` holds, else no vote. SQL over feature columns."""

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.expr(f"CASE WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END")


RULES: tuple[Rule, ...] = (
    Rule("length", "n_words < 10", "n_words >= 30"),
    Rule("some_length", "n_words < 20", "n_words >= 50"),
    Rule("symbols", "10 * n_symbols > 3 * n_words", "20 * n_symbols <= n_words"),
    Rule("some_symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("some_lines", "10 * n_dup_lines > n_lines", "n_dup_lines = 0"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    Rule("some_repeats", "20 * n_repeat_words > n_words", "n_repeat_words = 0"),
    Rule("shouting", "2 * n_upper > word_chars OR 10 * n_shouts > 3 * n_words", "5 * n_upper < word_chars AND 20 * n_shouts <= n_words"),
    Rule("some_shouting", "5 * n_upper > word_chars OR 10 * n_shouts > n_words", "10 * n_upper < word_chars AND 50 * n_shouts <= n_words"),
    Rule("word_size", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    Rule("some_word_size", "word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 8 * n_words"),
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")


def features(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` and the features of its ``text``; one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: line.rlike(f"[^{SPACE}]")
    size = lambda a: F.size(a).cast("long")
    without = lambda chars: F.length(F.translate(text, chars, ""))
    base = docs.select(
        *[F.col(c) for c in keep],
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("_hashes"),
        F.filter(F.split(text, "\n"), has_word).alias("_lines"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - without("!")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )
    windows = F.expr(
        f"CASE WHEN size(_hashes) >= {WINDOW} THEN transform(sequence(0, size(_hashes) - {WINDOW}), "
        f"i -> xxhash64({', '.join(f'_hashes[i + {k}]' for k in range(WINDOW))})) ELSE cast(array() AS array<bigint>) END"
    )
    base = base.withColumn("_windows", windows)
    # only texts that repeat a window need its positions: windows sorted with their place, and the places
    # of those equal to a neighbour; each place covers the words up to the next place, five at most
    placed = F.expr(
        "CASE WHEN size(_windows) > size(array_distinct(_windows)) "
        "THEN sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'p', i))) END"
    )
    again = F.expr(
        "sort_array(transform(filter(_placed, (x, i) -> (i > 0 AND x.h = _placed[i - 1].h) "
        "OR (i < size(_placed) - 1 AND x.h = _placed[i + 1].h)), x -> x.p))"
    )
    base = base.withColumn("_placed", placed).withColumn("_again", again)
    covered = F.expr(
        f"CASE WHEN _again IS NULL OR size(_again) = 0 THEN 0L ELSE aggregate(transform(_again, (p, i) -> "
        f"CASE WHEN i = size(_again) - 1 THEN {WINDOW} ELSE least({WINDOW}, _again[i + 1] - p) END), 0L, (a, x) -> a + x) END"
    )
    return base.select(
        *[F.col(c) for c in keep],
        size(F.col("_hashes")).alias("n_words"),
        "word_chars",
        "n_symbols",
        (size(F.col("_lines")) - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        size(F.col("_lines")).alias("n_lines"),
        "n_upper",
        "n_shouts",
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


#: The prior, which is also where EM starts: how often a rule votes bad on good and on bad documents, and the share of
#: good ones. It counts like WEIGHT of the documents, at every table size.
SLIP, CATCH, GOOD, WEIGHT = 0.01, 0.2, 0.8, 0.01
ROUNDS = 40


def estimate(voted: DataFrame, rules: Sequence[Rule], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Share of good documents and each rule's rate of bad votes on good and on bad ones, from ``votes``."""
    each = f"sequence(0, {len(rules) - 1})"
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"), F.sum("n").alias("total"))
    # chance of being good, by pattern
    good = (
        f"transform(pats, p -> 1D / (1D + exp(-(ln(s.pi / (1D - s.pi)) + aggregate({each}, 0D, (a, j) -> a + CASE p.votes[j] "
        "WHEN -1 THEN ln(s.g[j] / s.b[j]) WHEN 1 THEN ln((1D - s.g[j]) / (1D - s.b[j])) ELSE 0D END)))))"
    )
    sums = lambda of, where: f"aggregate(zip_with(pats, q, (p, c) -> CASE WHEN {where} THEN p.n * {of} ELSE 0D END), 0D, (a, x) -> a + x)"
    prior = f"{WEIGHT}D * total"
    rate = lambda of, start: f"({sums(of, 'p.votes[j] = -1')} + {prior} * {start}D) / ({sums(of, 'p.votes[j] <> 0')} + {prior})"
    step = (
        f"transform(array({good}), q -> named_struct('pi', ({sums('c', 'true')} + {prior} * {GOOD}D) / (total + {prior}), "
        f"'g', transform({each}, j -> {rate('c', SLIP)}), 'b', transform({each}, j -> {rate('(1D - c)', CATCH)})))[0]"
    )
    start = f"named_struct('pi', {GOOD}D, 'g', array_repeat({SLIP}D, {len(rules)}), 'b', array_repeat({CATCH}D, {len(rules)}))"
    row = one.where("total > 0").select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (s, r) -> {step})").alias("s")).first()
    if row is None:
        return GOOD, [SLIP] * len(rules), [CATCH] * len(rules)
    return row.s.pi, list(row.s.g), list(row.s.b)


def posterior(votes: Column, rates: tuple[float, list[float], list[float]]) -> Column:
    """Probability that a document is good, given its votes."""
    pi, g, b = rates
    odds = F.log(F.lit(pi) / (1 - F.lit(pi)))
    for j in range(len(g)):
        odds = odds + F.when(votes[j] == -1, F.log(F.lit(g[j]) / F.lit(b[j]))).when(
            votes[j] == 1, F.log((1 - F.lit(g[j])) / (1 - F.lit(b[j])))
        ).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES, keep_at: float = 0.5) -> DataFrame:
    """``keep`` columns, the features, ``base_failed``, ``p_good`` and ``kept`` of each row of ``docs``.

    Features are made once and cut off by a checkpoint, so ``keep`` should be small columns, without the text.
    """
    votes = F.array(*[r.vote() for r in rules])
    rows = settle(features(docs, keep=keep)).withColumn("_votes", votes)
    rates = estimate(rows.select(F.col("_votes").alias("votes")), rules)
    rows = rows.withColumns({"p_good": posterior(F.col("_votes"), rates), "base_failed": base_failed()})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at)).drop("_votes")
