"""Phrases of two to four words that occur often and hold together, by count tries.

A shard of documents counts its phrases in a trie of fixed depth (language, then up to four words),
kept level by level as sorted arrays.  Sorted, the trie is cut at the bounds of prefix ranges and
serialised, one segment a range; a segment brings the counts of its bound's ancestors along, also
where they have no descendant in the range.  A range's segments are merged level by level as sorted
runs, and what is rarer than the least count goes at once, with everything below it.  Walking up the
merged trie gives the counts of left parts.  Right parts come over suffix links: a phrase without its
first word is another node, which has its own right parts already, so each length is joined with the
one before.

Bounds come from a small sample of positions.  They decide where counts are added up, never what is
counted.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftline.llm.common import cut, joined, shuffle_parts, text_or_empty, trim

#: Words of a phrase at most, and levels of a trie: the language is the first.
WORDS, LEVELS = 4, 5
#: Bytes of text that a shard's trie is made of; a longer text is a shard of its own, of under 2^31 words.
SHARD_BYTES = 5_000_000
#: Bytes of text for a prefix range at least, the most ranges, and sampled positions for each.
RANGE_BYTES, RANGES, POINTS = 6_000_000, 20_000, 50
#: Bytes of text that the positions of one range are sampled from.
SAMPLE_BYTES = 20_000
#: Bounds are made of words of so many bytes at most.
BOUND_BYTES = 64
#: Language of texts without one.
NO_LANG = "und"

#: Bytes that split pieces, and bytes that split words.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(PIECE_ENDS)] = 2

SEGMENT = "part int, segment binary"
NODE = "lang string, m int, phrase string, a long, n long, lefts array<long>"


class Words:
    """Words of some texts in order: number in the vocabulary, language, and where each one's piece ends."""

    def __init__(self, texts: list[np.ndarray], langs: list[str]) -> None:
        data = _LOWER[np.concatenate(texts)] if texts else np.zeros(0, np.uint8)
        first = np.cumsum([0, *[len(t) for t in texts]])[:-1]
        kind = _KIND[data]
        word = kind == 0
        start = word.copy()
        start[1:] &= ~word[:-1]
        inside = first[first < len(data)]
        start[inside] = word[inside]
        starts = np.flatnonzero(start)
        self.n = len(starts)
        self.langs = sorted({x.encode() for x in langs})
        if not self.n:
            return
        sizes = np.add.reduceat(word.view(np.uint8), starts, dtype=np.int64)
        offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        if offsets[-1] < 2**31:
            column = pa.BinaryArray.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[word])])
        else:
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
        coded = column.dictionary_encode()
        self.vocab, rank = in_order(coded.dictionary)
        self.ids = rank[coded.indices.to_numpy()]
        per_text = np.diff(np.append(np.searchsorted(starts, first), self.n))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), per_text)
        ends = np.add.reduceat(kind == 2, starts) > 0
        ends[:-1] |= doc[1:] != doc[:-1]
        ends[-1] = True
        last = np.flatnonzero(ends)
        #: number of the first word behind each word's piece
        self.stop = np.repeat((last + 1).astype(np.int32), np.diff(np.append(-1, last)))
        number = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.array([number[x.encode()] for x in langs], np.int32)[doc]


def in_order(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values by their bytes, the place there of each value before)."""
    order = pc.sort_indices(values).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return values.take(pa.array(order)), rank


class Trie:
    """Levels of sorted nodes: ``up`` is a node's parent in the level above, ``word`` its word, ``n`` its count."""

    def __init__(self, words: Words) -> None:
        self.langs, self.words = words.langs, words.vocab
        width, at = len(words.vocab), np.arange(words.n, dtype=np.int32)
        n = np.bincount(words.lang, minlength=len(words.langs))
        self.up, self.word, self.n = [np.zeros(len(n), np.int32)], [np.arange(len(n), dtype=np.int32)], [n]
        node = words.lang
        for d in range(1, LEVELS):
            fits = at + d <= words.stop[at]
            at, node = at[fits], node[fits]
            key = node.astype(np.int64) * width + words.ids[at + d - 1]
            order = np.argsort(key, kind="stable") if d < LEVELS - 1 else None
            key = np.sort(key) if order is None else key[order]
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            self.up.append((key[begin] // width).astype(np.int32))
            self.word.append((key[begin] % width).astype(np.int32))
            self.n.append(np.diff(np.append(begin, len(key))).astype(np.int32))
            if order is not None:
                node = np.empty(len(key), np.int32)
                node[order] = np.cumsum(new, dtype=np.int32) - 1

    def place(self, bound: tuple[bytes, ...], langs: list[bytes], words: list[bytes]) -> tuple[list[int], list[bool]]:
        """Nodes of each level that come before ``bound``, and whether the last of them is an ancestor of it."""
        cuts, context = [], []
        lo, hi, here, before = 0, len(self.n[0]), True, 0
        for d in range(LEVELS):
            if not here or d >= len(bound):
                before = int(np.searchsorted(self.up[d], np.int32(before))) if d else before
                cuts.append(before)
                context.append(False)
                here = False
                continue
            if d:
                lo, hi = (int(x) for x in np.searchsorted(self.up[d], np.array([lo, lo + 1], np.int32)))
            names = words if d else langs
            rank = bisect.bisect_left(names, bound[d])
            p = lo + int(np.searchsorted(self.word[d][lo:hi], np.int32(rank)))
            same = rank < len(names) and names[rank] == bound[d] and p < hi and int(self.word[d][p]) == rank
            ancestor = same and d < len(bound) - 1
            cuts.append(p + ancestor)
            context.append(ancestor)
            here, lo, before = ancestor, p, p + ancestor
        return cuts, context

    def segments(self, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, bytes]]:
        """(range, serialised nodes of it) of the ranges that have any."""
        words = self.words.to_pylist()
        begin = ([0] * LEVELS, [False] * LEVELS)
        for part in range(len(bounds) + 1):
            end = self.place(bounds[part], self.langs, words) if part < len(bounds) else ([len(x) for x in self.n], None)
            lo = [c - k for c, k in zip(*begin, strict=True)]
            if any(b > a for a, b in zip(lo, end[0], strict=True)):
                yield part, self._packed(lo, end[0], begin[1])
            begin = end

    def _packed(self, lo: list[int], hi: list[int], context: list[bool]) -> bytes:
        word = [w[a:b] for w, a, b in zip(self.word, lo, hi, strict=True)]
        used, number = np.unique(np.concatenate(word[1:]), return_inverse=True)
        number = np.split(number, np.cumsum([len(w) for w in word[1:]])[:-1])
        names = self.words.take(pa.array(used))
        sizes, letters = pc.binary_length(names).to_numpy(), names.buffers()[2]
        langs = [self.langs[k] for k in word[0]]
        arrays = [np.array([len(x) for x in word] + [int(x) for x in context] + [len(used), len(langs)]), sizes, np.array([len(x) for x in langs])]
        for d in range(1, LEVELS):
            arrays += [np.diff(self.up[d][lo[d] : hi[d]] - lo[d - 1], prepend=0), number[d - 1]]
        raw = b"".join([x.astype(np.int32).tobytes() for x in arrays] + [self.n[d][lo[d] : hi[d]].astype(np.int32).tobytes() for d in range(LEVELS)] + langs + [letters.to_pybytes()[: int(sizes.sum(dtype=np.int64))] if letters else b""])
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


class Segment:
    """A serialised part of a trie, read again."""

    def __init__(self, blob: bytes) -> None:
        raw, at = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), 0

        def take(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, np.int32, n, at)
            at += out.nbytes
            return out

        head = take(2 * LEVELS + 2)
        count, self.context, n_words, n_langs = head[:LEVELS], head[LEVELS : 2 * LEVELS].astype(bool), int(head[-2]), int(head[-1])
        word_sizes, lang_sizes = take(n_words), take(n_langs)
        self.up, self.word = [np.zeros(n_langs, np.int32)], [np.arange(n_langs, dtype=np.int32)]
        for d in range(1, LEVELS):
            self.up.append(np.cumsum(take(count[d]), dtype=np.int32))
            self.word.append(take(count[d]))
        self.n = [take(count[d]) for d in range(LEVELS)]
        ends = at + np.cumsum(np.append(0, lang_sizes))
        self.langs = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        offsets = np.cumsum(np.append(0, word_sizes), dtype=np.int64)
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_words, [None, pa.py_buffer(offsets), pa.py_buffer(raw).slice(int(ends[-1]))])


def merged(blobs: list[bytes], least: int) -> pa.RecordBatch | None:
    """The phrases of one range that occur ``least`` times, from its segments of all shards."""
    segments = [Segment(b) for b in blobs]
    langs = sorted({x for s in segments for x in s.langs})
    number = {x: k for k, x in enumerate(langs)}
    coded = pa.chunked_array([s.words for s in segments], pa.large_binary()).combine_chunks().dictionary_encode()
    words, rank = in_order(coded.dictionary)
    rank = rank[coded.indices.to_numpy()] if len(words) else rank
    first = np.cumsum([0, *[len(s.words) for s in segments]])
    width = max(1, len(words))
    own: list[np.ndarray] = []  # merged node of each segment's nodes in the level above, -1 for rare ones
    up, word, n, context = [], [], [], []
    for d in range(LEVELS):
        sizes = [len(s.n[d]) for s in segments]
        if d:
            key = np.concatenate([np.where((p := own[k][s.up[d]]) < 0, -1, p.astype(np.int64) * width + rank[first[k] + s.word[d]]) for k, s in enumerate(segments)])
        else:
            key = np.concatenate([np.array([number[x] for x in s.langs], np.int64) for s in segments])
        count = np.concatenate([s.n[d] for s in segments])
        lead = np.zeros(len(key), bool)
        lead[[b for b, s, k in zip(np.cumsum([0, *sizes])[:-1], segments, sizes, strict=True) if k and s.context[d]]] = True
        # segments are sorted runs, which a stable sort merges
        order = np.argsort(key, kind="stable")
        order = order[np.searchsorted(key[order], 0) :]
        key_, total = key[order], np.zeros(0, np.int64)
        begin = np.flatnonzero(np.append(True, key_[1:] != key_[:-1])) if len(key_) else np.zeros(0, np.int64)
        node = np.full(len(key), -1, np.int32)
        if len(begin):
            total = np.add.reduceat(count[order], begin, dtype=np.int64)
            enough = total >= least
            renumbered = np.where(enough, np.cumsum(enough) - 1, -1).astype(np.int32)
            node[order] = np.repeat(renumbered, np.diff(np.append(begin, len(key_))))
            up.append(key_[begin][enough] // width if d else np.zeros(int(enough.sum()), np.int64))
            word.append(key_[begin][enough] % width if d else key_[begin][enough])
            n.append(total[enough])
            context.append(np.logical_or.reduceat(lead[order], begin)[enough])
        else:
            up.append(total)
            word.append(total)
            n.append(total)
            context.append(np.zeros(0, bool))
        own = np.split(node, np.cumsum(sizes)[:-1])
    out = [b for d in range(1, LEVELS) if (b := _level(d, langs, words, up, word, n, context)) is not None]
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def _level(d: int, langs: list[bytes], words: pa.Array, up, word, n, context) -> pa.RecordBatch | None:
    """A level's own nodes, those that are no ancestors of a bound, with what a walk to the root finds."""
    at = np.flatnonzero(~context[d])
    if not len(at):
        return None
    a, parts, counts = n[d][at], [], []
    for k in range(d, 0, -1):
        parts.insert(0, words.take(pa.array(word[k][at])))
        counts.insert(0, n[k][at])
        at = up[k][at]
    lefts = np.stack(counts[:-1], 1).ravel() if d > 1 else np.zeros(0, np.int64)
    phrase = parts[0] if d == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([x.decode() for x in langs]).take(pa.array(word[0][at])), "m": pa.array(np.full(len(a), d), pa.int32()), "phrase": phrase.cast(pa.large_string()).cast(pa.string()),
        "a": pa.array(a, pa.int64()), "n": pa.array(n[0][at], pa.int64()), "lefts": pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * (d - 1), pa.int32()), pa.array(lefts, pa.int64())),
    })


def shards(batches) -> Iterator[Words]:
    """Words of (text, lang) rows, in shards."""
    texts, langs, size = [], [], 0
    for batch in batches:
        column, names = batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        for k, name in enumerate(names):
            own = data[offsets[k] : offsets[k + 1]]
            if size and size + len(own) > SHARD_BYTES:
                yield Words(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(own)
            langs.append(name)
            size += len(own)
        texts = [t.copy() for t in texts]  # not the whole batch
    if texts:
        yield Words(texts, langs)


def bounds(docs: DataFrame, ranges: int, total: int) -> list[tuple[bytes, ...]]:
    """Paths that divide the nodes into about even ranges, from sampled positions of sampled texts; at most ``RANGES * POINTS`` reach the driver."""
    if ranges < 2 or not total:
        return []
    share = min(1.0, ranges * SAMPLE_BYTES / total)
    every = max(1, int(total * share / 6 / (ranges * POINTS)))

    def paths(batches):
        for w in shards(batches):
            if not w.n:
                continue
            at = np.arange(every // 2, w.n, every)
            names = w.vocab
            out = []
            for i in at:
                path = [w.langs[w.lang[i]]]
                for x in w.ids[i : min(i + WORDS, w.stop[i])]:
                    if len(x := names[int(x)].as_py()) > BOUND_BYTES:
                        break
                    path.append(x)
                out.append(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array(out, pa.list_(pa.binary()))})

    drawn = sorted(tuple(bytes(x) for x in r[0]) for r in docs.sample(share, 7).mapInArrow(paths, "path array<binary>").collect())
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def frequent(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, m, phrase, a, n, lefts): phrases of m = 1 to 4 words with their count a of at least ``least``, their language's number of words n and the counts of their proper beginnings."""
    spark = docs.sparkSession
    own = docs.select(text_or_empty(text).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(RANGES, max(shuffle_parts(spark), total // RANGE_BYTES))
    at = bounds(own, ranges, total)
    told = spark.sparkContext.broadcast(at)  # at most RANGES short paths

    def count(batches):
        for words in shards(batches):
            trie = Trie(words) if words.n else None
            del words  # only one shard at a time
            if trie:
                part, segment = zip(*trie.segments(told.value), strict=True)
                del trie
                trim()
                yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "segment": pa.array(segment, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        batch = merged(table.column("segment").to_pylist(), least)
        trim()
        return pa.Table.from_batches([batch]) if batch is not None else EMPTY.slice(0, 0)

    return own.mapInArrow(count, SEGMENT).groupBy("part").applyInArrow(merge, NODE)


EMPTY = pa.table({
    "lang": pa.array([], pa.string()), "m": pa.array([], pa.int32()), "phrase": pa.array([], pa.string()), "a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
    "lefts": pa.array([], pa.list_(pa.int64())),
})


def _rest(c: str = "phrase") -> Column:
    """A phrase without its first word."""
    return F.expr(f"substr({c}, instr({c}, ' ') + 1)")


def linked(nodes: DataFrame) -> DataFrame:
    """Phrases of two words and more with ``rights``: counts of what is left without the first word, the first two, ...; over the suffix links."""
    spark = nodes.sparkSession
    one = nodes.where("m = 1").select("lang", F.col("phrase").alias("_rest"), F.array("a").alias("_rights"))
    found = []
    for m in range(2, WORDS + 1):
        own = nodes.where(F.col("m") == m).withColumn("_rest", _rest())
        # a suffix is the target of as many links as there are words before it, so links to hot ones stay where they are
        many = own.groupBy("lang", "_rest").agg(F.count("*").alias("n"))
        table = many.join(one, ["lang", "_rest"]).withColumn("_key", F.struct("lang", "_rest")).select("_key", "n", "_rights")
        rows = own.withColumn("_key", F.struct("lang", "_rest")).withColumnRenamed("n", "words")
        got = cut(joined(rows, table, "_key", own.count()).drop("_key", "_rest").withColumnRenamed("_rights", "rights").withColumnRenamed("words", "n"), f"phrases-{m}")
        found.append(got)
        one = got.select("lang", F.col("phrase").alias("_rest"), F.concat(F.array("a"), "rights").alias("_rights"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def scored(phrases: DataFrame) -> DataFrame:
    """:func:`linked` phrases with the l, r and score of their weakest cut; ties go to the first one."""
    times = F.lit(2_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("m") - 1),
        lambda k: F.struct(F.element_at("lefts", k).alias("l"), F.element_at("rights", k).alias("r"), k.alias("k")),
    )
    flat = phrases.withColumn("_c", cuts).withColumn("_t", times)
    rated = F.transform("_c", lambda c: F.struct(F.call_function("div", F.col("_t"), c["l"].cast("decimal(20,0)") + c["r"].cast("decimal(20,0)")).cast("long").alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    return flat.withColumn("_w", F.array_min(rated)).select("lang", "m", "phrase", "a", "n", F.col("_w.l").alias("l"), F.col("_w.r").alias("r"), F.col("_w.score").alias("score"))


def standing(phrases: DataFrame, share: int) -> DataFrame:
    """``phrases`` without those that a longer one holds with at least ``share`` percent of their count."""
    words = F.split("phrase", " ")
    parts = lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    inside = F.when(F.col("m") == 4, F.concat(parts(3), parts(2))).otherwise(parts(2))
    most = (
        phrases.where("m > 2").select("lang", F.col("a").alias("_longer"), F.explode(F.array_distinct(inside)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    )
    held = F.col("_longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share
    return phrases.join(most, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False))).drop("_longer")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    Texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends into pieces and at blanks and tabs
    into words; a phrase lies within a piece.  A null text is an empty one, a null language is ``und``.
    Repeated rows count as often as they come.  An empty table, or one without frequent phrases, gives
    no rows.  Other columns, whatever their names, are not looked at.  Ties in score go to the larger
    count, then to the phrase first in order of its bytes, so ranks have no ties.
    """
    nodes = cut(frequent(docs, least, text, lang), "phrases")
    good = standing(scored(linked(nodes)), share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = good.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
