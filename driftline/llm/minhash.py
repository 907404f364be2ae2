"""MinHash near-duplicates with sequential Bayesian verification.

One pass over the texts gives each document its shingle set (64-bit hashes) and its signature.
Documents with equal sets are one class from then on; everything below is about one representative
a class.  Representatives that share a band of the signature meet in that band's group.  Groups with
the same members are looked at once.  Inside a group, pairs are compared batch by batch of their
signatures and dropped as soon as the posterior chance of reaching the threshold falls under the
miss probability.  Of the pairs that survive, a spanning forest goes on to be verified on the full
sets, as a group's links need not all be known to know who is reachable.  Where a forest's pair
fails, the whole group is looked at again with the full sets at hand.

A group larger than a block is first compared with a few of its members, which puts most of a group
of near copies into one component.  What stays outside is then compared with all of the group, block
against block in as many tasks: pairs within the one component are the only ones that nobody looks
at, and they can connect nothing new.  So no task holds a group of any size, no link between
components is lost, and the work follows the group's size wherever it is what it seems.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Forest, components, cut, joined, mix64, sifted, trimmed

#: Bands and rows of a band.  A pair at similarity 0.8 shares none of the bands with chance (1 - 0.8^6)^40 = 5e-6.
BANDS, ROWS = 40, 6
#: Signature values compared between two looks at the posterior.
BATCH = 40
#: A pair is pruned when similarity >= threshold has a posterior chance under this.
MISS = 1e-6
#: Members of a group that one task compares with as many others.
BLOCK = 2048
SEED = 20_011


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class WordHashes(dict):
    """A number for each word met and its hash under that number; all are forgotten at once when there are too many."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most, self.store = most, array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.store.append(word_hash(word))
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.store = array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return np.frombuffer(self.store, np.uint64)[at]


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D.  With fewer words
    than ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = words.of(own)
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(min(width, len(h))), np.uint64)
        for k in range(min(width, len(h))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


@lru_cache(maxsize=4)
def permutations(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n 32-bit minima of the hashes' high halves, each under its own linear map; pieces fit the processor's cache."""
    a, b = permutations(n)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 192):
        part = x[k : k + 192, None] * a
        part += b
        np.minimum(best, part.min(0), out=best)
    return best


@lru_cache(maxsize=16)
def cutoffs(threshold: float, n: int, batch: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(values compared, matches needed to go on) for each batch.

    With a uniform prior the similarity after m matches of t values is Beta(m + 1, t - m + 1); the
    least m with P(similarity >= threshold) >= miss is needed.  A match of values' low bytes by
    chance only raises m, so it never prunes more.
    """
    grid = np.linspace(0, 1, 4001)[1:-1]
    out = []
    for t in [*range(batch, n, batch), n]:
        for m in range(t + 1):
            log = m * np.log(grid) + (t - m) * np.log1p(-grid) + lgamma(t + 2) - lgamma(m + 1) - lgamma(t - m + 1)
            if np.exp(log)[grid >= threshold].sum() / 4000 >= miss:
                out.append((t, m))
                break
    return tuple(out)


def survivors(sig: np.ndarray, other: np.ndarray | None, need: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, matches) of pairs that no batch prunes; within ``sig`` (i < j) or between it and ``other``."""
    rows_i, rows_j, found = [], [], []
    for i in range(len(sig)):
        right = sig[i + 1 :] if other is None else other
        at = np.arange(len(right))
        got = np.zeros(len(right), np.int64)
        lo = 0
        for t, m in need:
            got = got + (right[at, lo:t] == sig[i, lo:t]).sum(1) if len(at) < len(right) else got + (right[:, lo:t] == sig[i, lo:t]).sum(1)
            keep = got >= m
            at, got, lo = at[keep], got[keep], t
            if not len(at):
                break
        if len(at):
            rows_i.append(np.full(len(at), i))
            rows_j.append(at + (i + 1 if other is None else 0))
            found.append(got)
    if not rows_i:
        z = np.zeros(0, np.int64)
        return z, z, z
    return np.concatenate(rows_i), np.concatenate(rows_j), np.concatenate(found)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b|, for sorted distinct arrays."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band; equal values in different bands differ."""
    sig = sig.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
    return h.view(np.int64)


def class_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def profile(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """(key, n_shingles, class_key, sig, bands) per row, written; sig has the low byte of each signature value, enough to prune by."""
    n = bands * rows

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                size, cls, low, met = [], [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), width, words)
                    sig = signature(s, n) if len(s) else None
                    size.append(len(s))
                    cls.append(class_of(s))
                    low.append(None if sig is None else sig.astype(np.uint8).tobytes())
                    met.append(None if sig is None else band_hashes(sig, bands, rows))
                yield pa.RecordBatch.from_pydict({
                    "key": part.column(0), "n_shingles": pa.array(size, pa.int64()), "class_key": pa.array(cls, pa.binary()),
                    "sig": pa.array(low, pa.binary()), "bands": pa.array(met, pa.list_(pa.int64())),
                })

    two = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return cut(two.mapInArrow(lambda batches: trimmed(run(batches)), "key long, n_shingles long, class_key binary, sig binary, bands array<long>"), "minhash-profile")


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, shingles) of the wanted (node, class_key, member), made anew from the members' texts and written."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                sets = [shingle_set(t.as_py(), width, words) for t in part.column("text")]
                own = [class_of(s) == c for s, c in zip(sets, part.column("class_key").to_pylist(), strict=True)]  # a key may have several texts
                yield pa.RecordBatch.from_pydict({
                    "node": part.column("node").filter(pa.array(own)), "shingles": pa.array([s.tobytes() for s, o in zip(sets, own, strict=True) if o], pa.binary()),
                })

    texts = sifted(docs.select(F.col(key).cast("long").alias("member"), F.col(text).alias("text")), "member", wanted).join(wanted, "member")
    made = texts.select("node", "class_key", "text").mapInArrow(lambda batches: trimmed(run(batches)), "node long, shingles binary")
    return cut(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "minhash-sets")


def whole_groups(groups: DataFrame) -> DataFrame:
    """(group, i, j, own, member) rows of groups that a task may hold: all against all."""
    zero = F.lit(0)
    return groups.select("group", zero.alias("i"), zero.alias("j"), zero.alias("own"), "member")


def outsiders_against_all(big: DataFrame, reached: DataFrame, block: int, total: int) -> DataFrame:
    """(group, i, j, own, member) rows of large groups: blocks i of outsiders (own 0) against blocks j of all members (own 1).

    ``reached`` (node, component) has what links to the groups' leaders connect; a group's outsiders are
    its members beyond the component that holds most of them.  Without outsiders there is nothing to do.
    """
    seen = big.join(reached.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    counts = seen.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("n").alias("all"))
    marked = joined(seen, main.where("outside > 0").withColumn("n", F.col("all")), "group", total)
    parts = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("member"), n).cast("int")
    out = marked.where("component <> main").select("group", deal(parts("outside")).alias("i"), F.explode(F.sequence(F.lit(0), parts("all") - 1)).alias("j"), F.lit(0).alias("own"), "member")
    every = marked.select("group", F.explode(F.sequence(F.lit(0), parts("outside") - 1)).alias("i"), deal(parts("all")).alias("j"), F.lit(1).alias("own"), "member")
    return out.unionByName(every.select("group", "i", "j", "own", "member"))


def leaders(big: DataFrame, total: int) -> DataFrame:
    """(a, b): each member of a large group with up to four of its members, each pair once."""
    h = F.xxhash64("member")
    few = big.groupBy("group").agg(F.count("*").alias("n"), F.array_distinct(F.array(F.min("member"), F.max("member"), F.min_by("member", h), F.max_by("member", h))).alias("few"))
    pairs = joined(big.select("group", "member"), few, "group", total).select("member", F.explode("few").alias("leader")).where("member <> leader")
    return pairs.select(F.least("member", "leader").alias("a"), F.greatest("member", "leader").alias("b")).distinct()


def by_group(rows: DataFrame) -> DataFrame:
    """Rows of a (group, block pair) next to each other, its blocks one after the other."""
    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "own", "member")


def runs(batches, sets: bool):
    """(group, own, member, sig, shingles) of each run of equal (group, i, j), holding one run and one batch at a time."""
    held = None

    def split(table: pa.Table):
        group, i, j, own, member = (table.column(c).to_numpy() for c in ("group", "i", "j", "own", "member"))
        edges = np.flatnonzero((np.diff(group) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        return group, own, member, np.concatenate([[0], edges, [len(group)]])

    def give(table: pa.Table):
        group, own, member, edges = split(table)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        shingles = table.column("shingles").to_pylist() if sets else None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                yield int(group[a]), own[a:b], member[a:b], sig[a:b], shingles[a:b] if sets else None

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = int(split(held)[3][-2])
        if last:
            yield from give(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None:
        yield from give(held.combine_chunks())


def joined_up(batches, rows: int = 4096):
    """Small batches put together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def band_groups(classes: DataFrame) -> DataFrame:
    """(group, size, member) of the bands that two or more classes share, one of those with equal members."""
    met = classes.select(F.col("node").alias("member"), F.explode("bands").alias("band"))
    sizes = met.groupBy("band").agg(F.count("*").alias("size"), F.bit_xor("member").alias("x"), F.bit_xor(F.xxhash64("member")).alias("y")).where("size > 1")
    once = cut(sizes.groupBy("size", "x", "y").agg(F.min("band").alias("band")).select("band", "size", F.col("size").alias("n")), "minhash-bands")
    total = once.agg(F.sum("n")).first()[0] or 0
    return joined(met, once, "band", total).select(F.col("band").alias("group"), "size", "member")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100,
    bands: int = BANDS, rows: int = ROWS, miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row: documents linked where den * intersection >= num * union.

    component_id is the smallest key that links reach, the row's own included; kept: key is
    component_id.  Texts without words, null ones among them, have no shingles and link with nothing.
    Equal sets are linked.  Repeated rows are all returned, with the same component.  A null key takes
    the component of its equals, if these have a key.  No rows: an empty frame.  Other columns aren't
    read.  ``width`` words make a shingle.
    """
    rows_ = profile(docs, key, text, width, bands, rows)
    able = rows_.where("class_key is not null and key is not null")
    # one key may stand for several texts, so classes have numbers of their own; what all rows of a class share, any gives
    one = able.groupBy("class_key").agg(F.min("key").alias("member"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    one = cut(one.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    groups = cut(band_groups(one), "minhash-groups")
    need = cutoffs(num / den, bands * rows, min(BATCH, bands * rows), miss)
    low = one.select(F.col("node").alias("member"), "sig")

    def connected(batches, sets: bool):
        """(group, a, b) of a forest over each group's survivors, most alike first; with full sets, of verified pairs only."""
        for group, own, member, sig, shingles in runs(batches, sets):
            half = int((own == 0).sum())
            if not half:  # a block that no outsider was dealt to
                continue
            cross = half < len(own)
            x, y, got = survivors(sig[:half], sig[half:] if cross else None, need)
            y = y + half if cross else y
            if sets:
                shingles = [np.frombuffer(z, np.uint64) for z in shingles]
            f, out = Forest(), []
            for k in np.argsort(-got, kind="stable"):
                m, n = int(member[x[k]]), int(member[y[k]])
                if f.root(m) != f.root(n) and (not sets or similar(shingles[x[k]], shingles[y[k]], num, den)):
                    f.join(m, n)
                    out.append((min(m, n), max(m, n)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["group", "a", "b"]
                )

    def forest(batches):
        yield from trimmed(joined_up(connected(batches, False)))

    def whole(batches):
        yield from trimmed(joined_up(connected(batches, True)))

    def verify(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("sa", "sb")]
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array(ok, pa.bool_())})

    names = one.select("node", "class_key", "member")
    total = groups.count()

    def compared(wanted: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b, ok) of the wanted pairs, by their full sets."""
        both = wanted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        return cut(both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, ok boolean"), "minhash-checked")

    big = groups.where(F.col("size") > block)
    members, stars = whole_groups(groups.where(F.col("size") <= block)), None
    if not big.isEmpty():
        ends = big.select(F.col("member").alias("node")).distinct()
        stars = compared(leaders(big, total), full_sets(docs, names.join(ends, "node"), key, text, width)).where("ok").select("a", "b")
        members = members.unionByName(outsiders_against_all(big.select("group", "member"), components(stars), block, total))
    members = cut(members, "minhash-members")
    pairs = cut(by_group(members.join(low, "member")).mapInArrow(forest, "group long, a long, b long"), "minhash-pairs")
    distinct = pairs.select("a", "b").distinct()
    ends = distinct.select(F.col("a").alias("node")).union(distinct.select(F.col("b").alias("node"))).distinct()
    sets = full_sets(docs, names.join(ends, "node"), key, text, width)
    checked = compared(distinct, sets)
    links = checked.where("ok").select("a", "b")
    if stars is not None:
        links = links.unionByName(stars)
    # groups in which a pair failed: the full sets decide among all their survivors, which are ends of some forest's pairs
    failed = cut(pairs.join(checked.where("not ok").select("a", "b"), ["a", "b"]).select("group").distinct(), "minhash-failed")
    full = members.join(failed, "group", "left_semi")
    again = by_group(full.join(low, "member").join(sets.withColumnRenamed("node", "member"), "member")).mapInArrow(whole, "group long, a long, b long")
    reached = components(links.unionByName(again.select("a", "b")))

    by_class = one.select("node", "class_key", "member", "copies").join(reached, "node", "left").select("class_key", "member", "copies", F.coalesce("component", "node").alias("component"))
    least = by_class.groupBy("component").agg(F.min("member").alias("component_id"), F.count("*").alias("n"))
    found = joined(by_class, least, "component", one.count()).select("class_key", "component_id", F.col("copies").alias("n"))
    narrow_rows = rows_.select("key", "n_shingles", "class_key")
    # every row with words has a class, but for texts whose rows all have null keys
    known = narrow_rows.where("class_key is not null")
    lost = known.where("key is null").join(found.select("class_key"), "class_key", "left_anti").select("key", "n_shingles", F.col("key").alias("component_id"))
    out = joined(known, found, "class_key", known.count()).select("key", "n_shingles", F.coalesce("component_id", "key").alias("component_id")).unionByName(lost)
    empty = narrow_rows.where("class_key is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return out.unionByName(empty).select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
