"""Linking documents whose word shingles overlap: n-gram Jaccard join by token-combination prefixes.

A document's set is its distinct shingles of five words (A-Z folded; a shorter text is one shingle). Two documents
link when ``100 * intersection >= 75 * union``; the result names each document's component of links.

1. Equal sets are one class, represented by its smallest document (a set's signature is two 64-bit sums).
2. Shingles have one global order: those of a sampled part of hash space by document frequency, then the rest
   by hash. In that order similar sets x and y share at least k shingles within their prefixes of
   ``n - ceil(0.75 n) + k`` (the extended prefix). Only the sampled part, somewhat more than a prefix, is
   counted; shingles of one document only come first and are never indexed, so most documents need no index.
3. Shingles in at most ``RARE`` documents are indexed alone. Frequent ones are indexed by pairs: with
   k = G + 1 and G groups by hash, if no shared prefix shingle is rare, two of the shared ones fall in one group.
   G follows the size class of the set (similar sets are in the same class or the next; each set is indexed
   for both), so a set of n shingles has on the order of n keys, however frequent they are.
4. Documents under one key are compared with its most connected member, the pivot; keys with the same pivot become one
   group, and linked documents are merged into components. Small groups that still hold several components are
   compared pair by pair. A large one is indexed anew by what its members do not share: x and y link when
   ``|x ^ y|`` is small, and ``|x ^ y| = |x ^ p| + |y ^ p| - 2 |(x ^ p) & (y ^ p)|`` for the pivot p, so two members that are
   not both linked to p must share a large part of their differences from p. Prefixes of these differences (what a
   member adds to p, then what it lacks) are indexed, and a pair is made only where enough of both differences is
   left from the shared shingle on. Under a shingle that is lacked, each member is compared only with the one that adds
   least of each lot of members which lack the same of p: if x and y link and add nothing in common, then x links with
   the first of y's lot (no larger than y, and with as much of p in common), y with the first of x's, and these two
   with each other. So texts that have only a passage in common, all of which lack the rest of p, cost one comparison
   each. Keys of very many members (lacked: lots) go to a pivot again. Nothing is capped. A key's pivot comes before its
   other members in one fixed order, so pivots move on, and each round takes keys of twice as many members by pairs,
   so the rounds are few even where no pivot settles much. Pairs are verified exactly.

Defined results: null, empty and blank texts have an empty set and their own component; rows with one id
are one node; a null id is a node that comes last; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .wordhash import Hasher, Slice, U, _mix, slices, unique_pairs

SHINGLE = 5
HASHER = Hasher(21, lower=True)
#: The sampled part of hash space: SAMPLED of 16. Prefixes take 25 % and a few more, so a set whose shared
#: shingles are fewer than about two in five has none of them in its prefix.
SAMPLED = 7
RARE = 256
#: Classes of members of a group, by their difference from its pivot: each is as wide as 1 / CLASSES of the pivot's shingles.
CLASSES = 64
CLASS_BASE = 1.334  # a little over 4/3, so that similar sets are at most one class apart


def size_classes(n: np.ndarray) -> np.ndarray:
    """Size class of each set size (of empty sets: 0)."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(CLASS_BASE)).astype(np.int64)


def groups_of(cls: np.ndarray) -> np.ndarray:
    """G of size classes: one group for 32 shingles or fewer."""
    return np.maximum(1, np.floor(CLASS_BASE ** (cls + 1)).astype(np.int64) // 32)


def prefix_lengths(n: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Length of the extended prefix of sets of ``n`` when indexed for ``cls``."""
    return n + (-3 * n) // 4 + groups_of(cls) + 1


def sets_of(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of a slice, distinct, sorted by text and shingle."""
    words = HASHER.words(part.data, part.starts, part.ends)
    inside = part.inside(SHINGLE)
    owner, key = part.text_of_word()[: len(inside)][inside], HASHER.windows(words, SHINGLE)[inside]
    short_owner, short_key = [owner], [key]
    for k in range(1, SHINGLE):
        texts = np.flatnonzero(part.counts == k)
        if len(texts):
            short_owner.append(texts)
            short_key.append(_mix(HASHER.windows(words, k)[part.bounds[texts]] + U(k)))
    return unique_pairs(np.concatenate(short_owner), np.concatenate(short_key))


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, m, s1, s2)``: set size, how many are in the sampled part, signature."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                owner, key = sets_of(part)
                n = np.bincount(owner, minlength=part.n)
                m = np.bincount(owner[(key & U(15)) < U(SAMPLED)], minlength=part.n)
                at = np.searchsorted(owner, np.arange(part.n + 1))
                sums = [np.concatenate([[U(0)], np.cumsum(x)]) for x in (_mix(key), _mix(key ^ U(0x5851F42D4C957F2D)))]
                s1, s2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
                ids = batch.column("doc_id").slice(part.first, part.n)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, m, s1, s2))], ["doc_id", "n", "m", "s1", "s2"])

    return docs.mapInArrow(made, "doc_id long, n long, m long, s1 long, s2 long")


def prefix_tokens(docs: DataFrame) -> DataFrame:
    """``(h, doc_id, late)``: the sampled shingles of each document (``late`` 0) and, where those are fewer than its
    prefix, the next ones in hash order with their place in the prefix."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for part in slices(batch.column("text")):
                owner, key = sets_of(part)
                early = (key & U(15)) < U(SAMPLED)
                n, m = (np.bincount(x, minlength=part.n) for x in (owner, owner[early]))
                need = prefix_lengths(n, size_classes(n) + 1)
                rest_owner, rest_key = owner[~early], key[~early]
                first = np.searchsorted(rest_owner, np.arange(part.n))
                place = np.arange(len(rest_owner)) - first[rest_owner] + 1 + m[rest_owner]
                wanted = place <= need[rest_owner]
                columns = (
                    np.concatenate([key[early], rest_key[wanted]]).view(np.int64),
                    ids[part.first + np.concatenate([owner[early], rest_owner[wanted]])],
                    np.concatenate([np.zeros(int(early.sum()), dtype=np.int32), place[wanted].astype(np.int32)]),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc_id", "late"])

    return docs.mapInArrow(made, "h long, doc_id long, late int")


def _key(cls: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(_mix(cls.astype(U) + U(7)) ^ a.view(U)) + b.view(U))


def index_keys(lists: DataFrame) -> DataFrame:
    """``(key, doc_id)`` of ``lists(doc_id, n, m, tokens)``; tokens are (df, h, late) in global order, shared ones only."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            lists = batch.column("tokens")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            df, h, late = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("df", "h", "late"))
            n, m, ids = (batch.column(c).to_numpy() for c in ("n", "m", "doc_id"))
            owner = np.repeat(np.arange(len(n)), sizes)
            alone = m - np.bincount(owner[late == 0], minlength=len(n))
            place = np.where(late == 0, alone[owner] + 1 + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner], late)
            keys, owners = [], []
            for cls in (size_classes(n), size_classes(n) + 1):
                mine = place <= prefix_lengths(n, cls)[owner]
                single = mine & (df <= RARE)
                keys.append(_key(cls[owner[single]], h[single], np.zeros(int(single.sum()), dtype=np.int64)))
                owners.append(owner[single])
                pair = np.flatnonzero(mine & (df > RARE))
                group = (h[pair] >> 8) % groups_of(cls)[owner[pair]]
                order = np.lexsort((h[pair], group, owner[pair]))
                pair, group = pair[order], group[order]
                cut = np.flatnonzero((np.diff(owner[pair]) != 0) | (np.diff(group) != 0)) + 1
                for members in np.split(pair, cut):
                    if len(members) > 1:
                        i, j = np.triu_indices(len(members), 1)
                        who = np.repeat(owner[members[0]], len(i))
                        keys.append(_key(cls[who], h[members[i]], h[members[j]]))
                        owners.append(who)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids[np.concatenate(owners)])], ["key", "doc_id"])

    return lists.mapInArrow(made, "key long, doc_id long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, shingles)``: sorted 64-bit shingles as bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                owner, key = sets_of(part)
                at = np.searchsorted(owner, np.arange(part.n + 1))
                sets = pa.array([key[a:b].tobytes() for a, b in itertools.pairwise(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, part.n), sets], ["doc_id", "shingles"])

    return docs.mapInArrow(made, "doc_id long, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=U), np.frombuffer(y.as_py(), dtype=U)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").mapInArrow(checked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``(doc_id, component)`` of every node of ``links(a, b)``: the smallest reachable id, by hooking and jumping."""
    both = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("doc_id")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("doc_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("doc_id").alias("component"), F.col("component").alias("far"))
        step = labels.join(near, "doc_id").join(jump, "component", "left")
        new = settle(step.select("doc_id", F.least("component", "near", "far").alias("component"), F.col("component").alias("old")))
        labels = new.select("doc_id", "component")
        if new.where("component < old").isEmpty():
            return labels


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with ``ca`` and ``cb``, the components of both, where these differ."""
    one = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a").join(two, "b").where("ca <> cb")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links; only the components that these join are worked on."""
    ends = settle(across(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if ends.isEmpty():
        return labels
    new = components(ends).select(F.col("doc_id").alias("component"), F.col("component").alias("_new"))
    return settle(labels.join(new, "component", "left").select("doc_id", F.coalesce("_new", "component").alias("component")))


def all_tokens(sets: DataFrame) -> DataFrame:
    """``(h, doc_id, late)`` of every shingle of ``sets(doc_id, shingles)``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys = [np.frombuffer(x.as_py(), dtype=np.int64) for x in part.column("shingles")]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids), pa.array(np.zeros(len(ids), dtype=np.int32))], ["h", "doc_id", "late"])

    return sets.mapInArrow(made, "h long, doc_id long, late int")


def several(postings: DataFrame) -> DataFrame:
    """``(key, doc_id, size)`` of ``postings(key, doc_id)`` under keys that several documents have.

    Keys that list the same documents are one; a set of documents is told by its size and two sums of hashes.
    """
    told = [F.sum(F.xxhash64("doc_id", F.lit(i)).cast("decimal(20,0)")).alias(f"t{i}") for i in (1, 2)]
    keys = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *told).where("size > 1")
    return postings.join(keys.groupBy("size", "t1", "t2").agg(F.min("key").alias("key")).select("key", "size"), "key")


def shared_keys(tokens: DataFrame, reps: DataFrame) -> DataFrame:
    """``(key, doc_id, size)``: the index keys of ``reps(doc_id, n, m)`` that several documents have."""
    tokens = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("df > 1")
    lists = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct((F.col("late") > 0).alias("is_late"), "df", "h", "late"))).alias("tokens"))
    return several(settle(index_keys(lists.join(reps, "doc_id"))))


def difference_prefixes(x: np.ndarray, p: np.ndarray, percent: int) -> tuple[int, np.ndarray, list[tuple[int, int, int]]]:
    """``g, x ^ p, [(class, class, prefix length)]``: one prefix for each class of partners, the smaller class first.

    Sets link when ``wide |x ^ y| <= close (|x| + |y|)`` with wide = 100 + percent and close = 100 - percent. With a = |x ^ p| and
    b = |y ^ p| the differences then share at least t = (g(x) + g(y)) / 2 wide, where g(x) = wide a - close |x|, and so
    their prefixes of a - t + 1 and b - t + 1 meet. g is cut into classes, and x has a prefix for each class that a
    partner can be of: t <= a and t <= b bound g(y), and of two sets that are both linked to p, g <= close |p|, the
    pair needs no key.
    """
    close, wide = 100 - percent, 100 + percent
    changed = np.concatenate([np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)])
    a, n = len(changed), len(x)
    g, step = wide * a - close * n, max(1, 2 * wide * len(p) // CLASSES)
    low, high = g - 2 * close * (100 * n // percent), wide * a + close * n
    if g <= close * len(p):
        low = max(low, close * len(p) + 1)
    out = []
    for partner in range(low // step, high // step + 1):
        t = max(1, -(-(g + max(partner * step, low)) // (2 * wide)))
        if t <= a:
            out.append((min(partner, g // step), max(partner, g // step), a - t + 1))
    return g, changed, out


def difference_keys(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(key, doc_id, g, rest, lot)``: the members of ``stars(pivot, doc_id)`` indexed by their differences from the pivot.

    ``rest`` is how much of the difference is left from the key's shingle on, that one included. Under a shingle that
    the member lacks, it is all that the member lacks, and ``lot`` tells that set; else ``lot`` is 0.
    """
    one = sets.select("doc_id", F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("p"))
    names = ["key", "doc_id", "g", "rest", "lot"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, rests, lots, gs, counts = [np.empty(0, dtype=U)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=U)], [], []
                for pivot, x, p in zip(part.column("pivot").to_pylist(), part.column("x"), part.column("p"), strict=True):
                    x, p = np.frombuffer(x.as_py(), dtype=U), np.frombuffer(p.as_py(), dtype=U)
                    g, changed, found = difference_prefixes(x, p, percent)
                    added = (len(changed) + len(x) - len(p)) // 2
                    lot = np.zeros(len(changed), dtype=U)
                    lot[added:] = _mix(changed[added:]).sum(dtype=U) | U(1)
                    rest = len(changed) - np.minimum(np.arange(len(changed)), added)
                    place = _mix(np.array([(pivot, one, two) for one, two, _ in found], dtype=np.int64).reshape(-1, 3).view(U))
                    place = _mix(_mix(place[:, 0] + place[:, 1] * U(3)) + place[:, 2])
                    sizes = [size for *_, size in found]
                    keys += [_mix(changed[:size] ^ here) for here, size in zip(place, sizes, strict=True)]
                    rests += [rest[:size] for size in sizes]
                    lots += [lot[:size] for size in sizes]
                    gs.append(g)
                    counts.append(sum(sizes))
                ids, gs = (np.repeat(np.array(c, dtype=np.int64), counts) for c in (part.column("doc_id").to_numpy(), gs))
                columns = (np.concatenate(keys).view(np.int64), ids, gs, np.concatenate(rests), np.concatenate(lots).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return stars.join(one, "doc_id").join(two, "pivot").mapInArrow(made, "key long, doc_id long, g long, rest long, lot long")


def led(keyed: DataFrame) -> DataFrame:
    """``(key, doc_id, g, rest, lead, wide)``: of two documents under a key, one must be a ``lead``; ``wide`` counts the leads.

    Where the key's shingle is lacked, leads are the documents that add least of each lot; elsewhere all are.
    """
    lots = keyed.where("lot <> 0").groupBy("key", "lot").agg(F.min(F.struct("g", "doc_id")).alias("first"))
    wide = lots.groupBy("key").agg(F.count(F.lit(1)).alias("lots"))
    rows = keyed.join(lots.select("key", "lot", F.col("first.doc_id").alias("first")), ["key", "lot"], "left").join(wide, "key", "left")
    return rows.select("key", "doc_id", "g", "rest", F.expr("lot = 0 OR doc_id = first").alias("lead"), F.coalesce("lots", "size").alias("wide"))


def link(docs: DataFrame, *, percent: int = 75, few: int = 64, many: int = 512) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs(doc_id, text)``.

    Groups of up to ``few`` documents are compared pair by pair, and keys of differences with up to ``many`` leads lead by
    member where the place of the shared shingle allows it; ``many`` doubles with each round.
    """
    if percent < 75:
        raise ValueError("prefixes are laid out for similarities of 0.75 and more")
    none = F.lit((1 << 63) - 1)
    docs = docs.select(F.coalesce("doc_id", none).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = settle(describe(docs))
    classes = known.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    named = known.join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", "m", F.coalesce("rep", "doc_id").alias("rep"))
    reps = classes.join(known, ["n", "s1", "s2"]).where("doc_id = rep").where("n > 1").select("doc_id", "n", "m").distinct()

    # first over the sampled part of hash space; then over all shingles, but of the documents that have a key in
    # common with another: in the full order rare shingles fill the prefix, and few documents are left
    active = settle(shared_keys(prefix_tokens(docs), reps))
    sets = settle(shingle_sets(docs.join(active.select("doc_id").distinct(), "doc_id", "left_semi")))
    kept = settle(shared_keys(all_tokens(sets), reps.withColumn("m", F.col("n"))))
    # pivots are the documents most in common with others: in a group of copies its original, which links them all
    weight = settle(kept.groupBy("doc_id").agg((-F.sum("size")).alias("w")))
    labels = settle(weight.select("doc_id", F.col("doc_id").alias("component")))

    def compared(rows: DataFrame, on: str, allowed: str = "true") -> DataFrame:
        """``labels`` after the pairs of a lead and another of ``rows(on, doc_id, lead, ...)`` with the same ``on``; columns of the second: _name."""
        rows = rows.join(labels, "doc_id")
        other = rows.withColumnsRenamed({c: f"_{c}" for c in rows.columns if c != on})
        pairs = rows.where("lead").join(other, on).where(f"component <> _component AND (doc_id < _doc_id OR NOT _lead) AND {allowed}")
        pairs = pairs.select(F.least("doc_id", "_doc_id").alias("a"), F.greatest("doc_id", "_doc_id").alias("b")).distinct()
        return merged(labels, similar(pairs, sets, percent))

    keyed = kept
    while True:
        heads = keyed.join(weight, "doc_id").groupBy("key").agg(F.min(F.struct("w", "doc_id")).alias("head"))
        stars = keyed.join(heads, "key").select(F.col("head.doc_id").alias("pivot"), "doc_id").where("pivot <> doc_id").distinct()
        stars = settle(stars)
        pairs = stars.select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
        labels = merged(labels, similar(across(pairs, labels).select("a", "b"), sets, percent))
        groups = stars.join(labels, "doc_id").groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        members = settle(stars.join(groups.where("low < high").select("pivot", "size"), "pivot"))
        labels = compared(members.where(F.col("size") <= few).select("pivot", "doc_id", F.lit(True).alias("lead")), "pivot")
        large = members.where(F.col("size") > few).select("pivot", "doc_id")
        if large.isEmpty():
            break
        postings = settle(difference_keys(large, sets, percent))
        keys = postings.join(labels, "doc_id").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        keyed = settle(led(settle(postings.join(keys.where("low < high").select("key", "size"), "key"))))
        labels = compared(keyed.where(F.col("wide") <= many).drop("wide"), "key", f"g + _g <= {2 * (100 + percent)} * least(rest, _rest)")
        keyed = keyed.where(F.col("wide") > many).select("key", "doc_id")
        if keyed.isEmpty():
            break
        many *= 2  # rounds that settle little are as many as the doublings up to the largest key, not as its members
    out = named.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
    return out.select(F.nullif("doc_id", none).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "rep"), none).alias("component_id"))
