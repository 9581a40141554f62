"""Document operators: SQL, brute force and odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import jaccard_join, mixing, packing, quality, substring_dedup, token_counts, toxicity
from millrace.llm.oracles import ORACLE_SQL
from millrace.llm.queries import QUERIES
from tests.llm.conftest import prose
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], sf) == []


@pytest.mark.parametrize("name", ["op3_quality", "op1_mixing"])
def test_odd_documents_agree_with_sql(spark, odd_docs, folder, name):
    d = folder(documents=odd_docs)
    assert compare(spark, QUERIES[name], ORACLE_SQL[name], d) == []


@pytest.mark.parametrize("name", ["op1_mixing", "op2_token_counts", "op3_quality", "op5_substring_dedup", "op6_packing", "op10_jaccard_join"])
def test_empty_table(spark, odd_docs, folder, name):
    assert QUERIES[name](spark, folder(documents=odd_docs.limit(0))).count() == 0


def test_token_counts(spark, odd_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.cuts_are_safe(model)
    for r in token_counts.count_tokens(odd_docs, path, 4096, batch_bytes=500).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(model.encode(r.text or "")), len((r.text or "").encode()), len(model.encode(r.text or "")) > 4096)


def test_long_texts_are_cut_without_change():
    text = prose(9, 5000)
    parts = list(token_counts.pieces(text, 100))
    assert len(parts) > 100 and " ".join(parts) == text
    assert list(token_counts.pieces("x" * 9000, 100)) == ["x" * 9000]


def test_byte_bpe_equals_the_library():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    from millrace.llm.queries import pack_tokenizer

    fast = pack_tokenizer()
    for x in ["", " a", "a ", "a  b", "a \nb", "a\n b c", "<|endoftext|> a b<|endoftext|>", "é ü 漢字 1 2's", "a\u00a0 b", "a\x1c b c", prose(1, 300)]:
        assert fast.encode_all([x])[0].tolist() == [*slow.encode(x, add_special_tokens=False).ids, 2], x


def check_packing(rows, want: dict[int, list[list[int]]], capacity: int) -> int:
    """Pieces round-trip to the documents' ids, fill their sequences without gaps; returns how many sequences."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, mine in pieces.items():
        for ids in want[i]:
            at = 0
            for k in range(sum(r.piece == 0 for r in mine) and len(mine) // len(want[i])):
                same = [r for r in mine if r.piece == k]
                assert len({(r.start, r.length, r.ids_crc32) for r in same}) == 1 and same[0].start == at
                assert same[0].ids_crc32 == zlib.crc32(np.array(ids[at : at + same[0].length], dtype="<u4").tobytes())
                assert k == 0 or same[0].length == capacity
                at += same[0].length
            assert at == len(ids)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, odd_docs, folder):
    d = folder(documents=odd_docs)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: dict = {}
    for r in odd_docs.collect():
        want.setdefault(r.doc_id, []).append([*slow.encode(r.text or "", add_special_tokens=False).ids, 2])
    rows = QUERIES["op6_packing"](spark, d).collect()
    n = check_packing(rows, want, 1024)
    assert n <= sum(r.length for r in rows) / 1024 + 2


def test_plans_hold_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(400):
        capacity = int(rng.choice([10, 16, 100]))
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, capacity, 12), rng.integers(1, 40, 12))}
        runs = packing.plan(dict(counts), capacity)
        held: dict[int, int] = {}
        for run in runs:
            assert sum(n * k for k, n in run.pattern) <= capacity and run.times > 0
            for k, n in run.pattern:
                held[k] = held.get(k, 0) + n * run.times
        assert held == counts
        assert sum(r.times for r in runs) <= 1.25 * sum(k * n for k, n in counts.items()) / capacity + max(counts.values()) * 2


def test_reduction_fixes_what_dominates():
    counts = {9: 2, 7: 3, 3: 3, 5: 2}
    fixed = packing.reduce_dominated(counts, 10)
    assert not counts and sorted((r.pattern, r.times) for r in fixed) == [([(5, 2)], 1), ([(7, 1), (3, 1)], 3), ([(9, 1)], 2)]


def brute_dedup(rows, span=50):
    docs = [(i, WORD.findall(x or "")) for i, x in rows]
    first: dict = {}
    for i, words in docs:
        for k in range(len(words) - span + 1):
            w = tuple(words[k : k + span])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - span + 1):
            if first[tuple(words[k : k + span])] < i:
                gone.update(range(k, k + span))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_on_odd_and_shared_texts(spark, odd_docs):
    shared = [prose(100 + k, 50 + k) for k in range(4)]
    more = [(100 + i, " ".join([prose(i, i % 40), shared[i % 4], prose(50 + i, i % 33), shared[(i * 7) % 4][3:]])) for i in range(40)]
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id IS NOT NULL").collect() if r.doc_id not in (5, 6)] + more + [(5, prose(1, 3000)), (6, prose(1, 3000))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(rows)


def test_copies_do_not_take_rows_that_share_their_id(spark):
    """Null ids and one id with two texts: only the row that is a copy goes, the others are judged by their windows."""
    last = (1 << 63) - 1
    one, two, three, four = (prose(400 + k, 70) for k in range(4))
    rows = [(1, one), (5, one), (5, two), (last, one), (last, three), (last, prose(410, 60) + " " + two), (last, None), (7, two + " end"), (7, one), (8, four), (8, "few words"), (9, four), (9, "few words")]
    docs = spark.createDataFrame([(None if i == last else i, x) for i, x in rows], "doc_id long, text string")
    got = [(last if r.doc_id is None else r.doc_id, *r[1:]) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == brute_dedup(rows)


def test_cover_meets_every_pair_of_offsets():
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_difference_prefixes_meet_for_every_link():
    """Linked sets that are not both linked to the pivot share a key at whose place enough of both differences is left."""
    rng = np.random.default_rng(11)
    linked = seen = 0
    for _ in range(4000):
        p = np.unique(rng.integers(0, 400, int(rng.integers(20, 120))).astype(np.uint64))
        other = np.arange(1000, 1030, dtype=np.uint64)
        core = np.union1d(rng.choice(p, int(len(p) * rng.uniform(0.5, 1)), replace=False), rng.choice(other, int(rng.integers(0, 25)), replace=False))
        x, y = (np.union1d(rng.choice(core, max(1, int(len(core) * rng.uniform(0.8, 1))), replace=False), rng.choice(other, int(rng.integers(0, 4)))) for _ in range(2))
        close = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        if not close(x, y) or close(x, p) and close(y, p):
            continue
        linked += 1
        sides = []
        for z in (x, y):
            g, changed, found = jaccard_join.difference_prefixes(z, p, 75)
            sides.append((g, {(one, two, int(v)): len(changed) - i for one, two, size in found for i, v in enumerate(changed[:size])}))
        (g1, one), (g2, two) = sides
        assert any(g1 + g2 <= 350 * min(one[k], two[k]) for k in one.keys() & two.keys())
        seen += 1
    assert linked == seen > 300


@pytest.mark.parametrize(("few", "many"), [(64, 512), (3, 5)])
def test_jaccard_components_against_all_pairs(spark, odd_docs, few, many):
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in odd_docs.where("doc_id IS NOT NULL").distinct().collect() if r.doc_id not in (5, 6)]
    base = [prose(200 + k, int(rng.integers(8, 150))).split() for k in range(6)]
    for i in range(400):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 1 + len(words) // 12))):
            words[int(rng.integers(len(words)))] = f"edit{int(rng.integers(9))}"
        rows.append((1000 + i, " ".join(words)))
    sets = {i: shingles(x) for i, x in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), few=few, many=many).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in ids}


def passage_group(n, seed=3, every=15):
    """Texts with one passage in common, some without its ends or with an edit in it, and words of their own around it."""
    rng = np.random.default_rng(seed)
    passage, rows = [f"p{k}" for k in range(50)], []
    for i in range(n):
        a, b = (0, 50) if i % 10 else (int(rng.integers(0, 6)), 50 - int(rng.integers(0, 6)))
        words = passage[a:b]
        if i % every == 0:
            words[int(rng.integers(len(words)))] = f"edit{int(rng.integers(3))}"
        before, after = (int(x) for x in rng.integers(2, 15, 2))
        rows.append((i, " ".join([f"a{i}w{k}" for k in range(before)] + words + [f"b{i}w{k}" for k in range(after)])))
    return rows


@pytest.mark.parametrize(("few", "many", "every", "most"), [(4, 8, 15, 3), (4, 1000, 15, 3), (4, 2, 1, 7)])
def test_texts_with_a_passage_in_common_end_in_few_rounds(spark, monkeypatch, few, many, every, most):
    """Their differences from a pivot share all that the pivot has besides; each pivot used to settle a few texts only.

    With an edit in each passage there are many lots, and the rounds are as few as the doublings of ``many``.
    """
    rows = passage_group(600, every=every)
    sets = {i: shingles(x) for i, x in rows}
    comp = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp |= {i: low for i, c in comp.items() if c == high}
    assert 100 < len(set(comp.values())) < 599
    rounds, made = [], jaccard_join.difference_keys

    def counted(*given):
        rounds.append(0)
        assert len(rounds) <= most
        return made(*given)

    monkeypatch.setattr(jaccard_join, "difference_keys", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"), few=few, many=many).collect()}
    assert got == comp and rounds


def test_frequent_shingles_go_by_pairs(spark, monkeypatch):
    """With every shared shingle frequent, links still come out whole."""
    rows = [(i, prose(7, 90) + f" {i} " + prose(300 + i, 6)) for i in range(60)]
    monkeypatch.setattr(jaccard_join, "RARE", 1)
    got = {r.component_id for r in jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def test_null_id_is_a_node_of_its_own(spark, odd_docs):
    rows = jaccard_join.link(odd_docs).where("doc_id IS NULL").collect()
    assert len(rows) == 1 and rows[0].component_id is None


def test_quality_separates_junk(spark, sf):
    kept = QUERIES["op3_quality"](spark, sf).select("doc_id", "kept")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in kept.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) <= 0.1 * n[0, False] and n[1, False] <= 0.1 * n[1, True]


def test_estimated_rates_outvote_a_strict_rule(spark, sf):
    """Rates are no hand-set values, and a vote of a strict rule that agrees with no other is outvoted."""
    rows = quality.features(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    voted = rows.select("doc_id", "n_words", "n_symbols", F.array(*[r.vote() for r in quality.RULES]).alias("votes"))
    pi, g, b = quality.estimate(voted.select("votes"), quality.RULES)
    assert 0.5 < pi < 0.95 and all(x not in (quality.SLIP, quality.CATCH) for x in (*g, *b))
    names = [r.name for r in quality.RULES]
    for fault in ("symbols", "lines", "repeats", "shouting"):
        assert b[names.index(fault)] > 10 * g[names.index(fault)]
    votes = lambda **bad: F.array(*[F.lit(-1 if n in bad else 1) for n in names])
    one = spark.range(1)
    p = lambda **bad: one.select(quality.posterior(votes(**bad), (pi, g, b))).first()[0]
    assert p(length=1) > 0.5 > p(symbols=1, some_symbols=1) and p() > 0.9


def test_groups_are_told_apart_by_value(spark):
    """Separators and stand-ins for null inside group values; equal rows count one by one."""
    rows = [(i, a, b, 4) for i, (a, b) in enumerate([("p\x1fq", "r"), ("p", "q\x1fr"), (None, "x"), ("\x00", "x"), ("", "x")] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, a string, b string, n_tokens long")
    got = mixing.mix(docs, ["a", "b"], {"a": F.lit(1), "b": F.lit(1)}, share=1.0, max_epochs=1, seed=1).collect()
    assert sorted((r.doc_id, r.a, r.b, r.n_tokens) for r in got) == sorted(rows, key=lambda r: r[0]) and all(r.copies == 1 for r in got)
    same = spark.createDataFrame([(7, "a", "b", 4)] * 6, docs.schema)
    got = mixing.mix(same, ["a", "b"], {"a": F.lit(1), "b": F.lit(1)}, share=0.5, max_epochs=1, seed=1).collect()
    assert len(got) == 3 and sum(r.take_tokens for r in got) == 12


def test_no_python_in_native_plans(spark, sf):
    for name in ("op1_mixing", "op3_quality", "op8_url_filter"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_budgets_go_to_siblings_first(spark):
    rows = [("a", "x", 10, 1), ("a", "y", 1000, 1), ("b", "z", 1000, 1)]
    leaves = spark.createDataFrame(rows, "d string, s string, tokens long, rows long").withColumns({"w_d": F.lit(1), "w_s": F.lit(1)})
    got = {r.s: r.quota for r in mixing.budgets(leaves, ["d", "s"], 400, 1).collect()}
    assert got == {"x": 10, "y": 190, "z": 200}
    got = {r.s: r.quota for r in mixing.budgets(leaves, ["d", "s"], 2000, 1).collect()}
    assert got["x"] == 10 and got["y"] == 990 and got["z"] == 1000


def test_epochs_repeat_whole_leaves(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(20)], "doc_id long, d string, n_tokens long")
    got = mixing.mix(docs, ["d"], {"d": F.lit(1)}, share=1.55, max_epochs=3, seed=1).collect()
    assert sum(r.take_tokens for r in got) == 310 and sorted({r.copies for r in got}) == [1, 2] and len(got) == 20


def test_toxicity_holds_out_and_learns(spark, sf):
    rows = QUERIES["op4_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    toxic = dict(connect(sf).sql("SELECT doc_id, toxic FROM labels").fetchall())
    out = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, y in out if y], [s for s, y in out if not y]
    assert sum(a > b for a in good for b in bad) > 0.7 * len(good) * len(bad)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    words = ["aa", "the", "house", "bad", "xx", "yyy"]
    net = toxicity.Network({w: i + 1 for i, w in enumerate(words[:4])}).start(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, sizes, y = rng.integers(0, 6, (5, toxicity.WINDOW)), np.array([32, 3, 10, 0, 20]), np.array([1, 0, 1, 0, 1.0])

    def loss():
        p = toxicity._sigmoid(net.run(net.project(net.inputs(words)[0].astype(np.float64)), ids, sizes))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(words, ids, sizes, y, np.ones(5))
    for k, v in net.p.items():
        if k in ("words", "chars"):
            continue
        i = tuple(int(rng.integers(s)) for s in v.shape)
        old, e = v[i], 1e-3
        v[i] = old + e
        up = loss()
        v[i] = old - e
        down = loss()
        v[i] = old
        assert abs((up - down) / 2 / e - g[k][i]) < 2e-3


def test_toxicity_windows_cover_long_texts():
    net = toxicity.train(["bad words here"] * 5 + ["good text now"] * 5, [1] * 5 + [0] * 5, rounds=1)
    ids = np.arange(toxicity.STRIDE * toxicity.BATCH + 500) % 50
    whole = [(0 + s) for s in toxicity.window_starts(len(ids))]
    at, seen = 0, []
    for piece in toxicity.Reader.pieces(ids):
        seen += [at + s for s in toxicity.window_starts(len(piece))]
        at += toxicity.STRIDE * toxicity.BATCH
    assert seen == whole
    p = net.probability(toxicity.Reader(net).score([None, "", "bad words", "good text"]))
    assert p[0] == p[1] and p[2] > p[3]
    assert toxicity.train([], []).probability(np.zeros(2)).tolist() == [0.05, 0.05]


def test_toxicity_scores_against_a_plain_loop(spark, odd_docs):
    """Every word and every window by itself, step by step in double precision."""
    net = toxicity.train(["bad words here " * 6] * 8 + ["good text now " * 6] * 8, [1] * 8 + [0] * 8, rounds=1)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def window(words):
        x = []
        for w in words:
            marked = [ord(c) for c in f"\x02{w}\x03"]
            grams = [(a * 961 + b * 31 + c) * 2654435761 % 4294967296 % toxicity.TRIGRAMS for a, b, c in zip(marked, marked[1:], marked[2:])]
            x.append(np.concatenate([p["words"][net.vocabulary.get(w, 0)], p["chars"][grams].mean(0)]))
        states = np.zeros((len(x), 2 * toxicity.HIDDEN))
        for way, at, order in (("f", 0, range(len(x))), ("b", toxicity.HIDDEN, range(len(x) - 1, -1, -1))):
            h = np.zeros(toxicity.HIDDEN)
            for t in order:
                given = x[t] @ p[f"{way}_in"] + p[f"{way}_bias"]
                z, r = np.split(sigmoid(given[: 2 * toxicity.HIDDEN] + h @ p[f"{way}_gates"]), 2)
                h = h + z * (np.tanh(given[2 * toxicity.HIDDEN :] + (r * h) @ p[f"{way}_new"]) - h)
                states[t, at : at + toxicity.HIDDEN] = h
        weight = np.exp(np.tanh(states @ p["att"] + p["att_bias"]) @ p["att_out"])
        return (weight / weight.sum()) @ states @ p["out"] + p["bias"][0]

    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.text and len(r.text) < 5000] + [(50, "good text now " * 40 + "bad words here " * 9 + "fine " * 70)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), net, 0.3).collect()}
    seen = 0
    for i, text in rows:
        words = toxicity.words_of(text)
        if words:
            logit = max(window(words[s : s + toxicity.WINDOW]) for s in toxicity.window_starts(len(words)))
            assert abs(got[i] - sigmoid(net.scale * logit + net.shift)) < 1e-4, i
            seen += 1
    assert seen > 8


def test_toxicity_without_rows(spark, odd_docs, folder):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert QUERIES["op4_toxicity"](spark, folder(documents=odd_docs.limit(0), labels=labels)).count() == 0


def test_toxicity_of_odd_rows(spark, odd_docs, folder):
    """One labelled id on many rows, null texts, no labels of one class: every row has a score, equal rows the same."""
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (9, 0, 1), (None, 0, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 4"))
    rows = QUERIES["op4_toxicity"](spark, folder(documents=docs, labels=labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    texts, y = toxicity.training_sample(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("label")), F.lit(True))
    assert len(texts) == 2 and sorted(y) == [0, 1]


def test_toxicity_reads_long_runs_whole():
    """A run of letters is cut into overlapping pieces; what stands after the 40th letter counts."""
    run = "".join(chr(0x4E00 + k) for k in range(203))
    pieces = toxicity.words_of(f"short {run} end")
    assert pieces[0] == "short" and pieces[-1] == "end" and max(map(len, pieces)) == toxicity.LONGEST
    assert all(any(run[k : k + 20] in p for p in pieces) for k in range(len(run) - 19))
    assert toxicity.words_of("a" * 40 + " " + "b" * 41) == ["a" * 40, "b" * 40, "b" * 21]
    calm = "".join(chr(0x5000 + k) for k in range(60))
    bad, good = (x * 4 for x in ("bad words here ", "good text now "))
    net = toxicity.train([bad] * 20 + [good] * 20, [1] * 20 + [0] * 20, rounds=1)
    p = toxicity.Reader(net).score([calm + "badwordsherebadwordshere", calm, calm + "goodtextnowgoodtextnow"])
    assert p[0] > p[1] and p[0] > p[2]


def test_toxicity_windows_overlap_by_half():
    """Every span of 17 words lies in one window."""
    for n in (1, 32, 33, 500):
        starts = list(toxicity.window_starts(n))
        assert all(any(s <= k and k + 17 <= s + toxicity.WINDOW for s in starts) for k in range(n - 16))


def test_quality_rates_without_documents(spark, odd_docs):
    empty = quality.features(odd_docs.limit(0)).select(F.array(*[r.vote() for r in quality.RULES]).alias("votes"))
    assert quality.estimate(empty, quality.RULES)[0] == quality.GOOD
