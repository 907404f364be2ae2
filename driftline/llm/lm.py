"""Masked pseudo-likelihood: a network over a window on both sides predicts every token of a text.

Words are tokens.  The most frequent of the whole corpus have ids of their own; all others share ids
by hash, and within such an id each has its share of the id's occurrences, from the counts of all
words of the corpus.  So every word has a probability of its own.

The network adds up the contributions of the two tokens on either side, applies tanh and predicts the
id by a hierarchical softmax: the most frequent ids and groups of the others first, then the id within
its group.  It starts from the ids' counts and is trained in numpy: every token of every document is a
training window, once.  Windows come in pieces of a text; equal pieces are one piece with a weight, and
pieces are dealt into shards by their own hash.  Shards train copies of the network, which are averaged;
the second half of the shards goes on from the average of the first.

A document's score is the sum over its tokens of the log probability given both sides.  The network is
rounded to a grid on which its sums are exact in single precision, so that neither training nor scores
depend on how rows are dealt into files, partitions or batches.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, trim, trimmed

#: First softmax: DIRECT ids and GROUPS groups; second: OWN words and HASHED shared ids of a group.
DIRECT, GROUPS, OWN, HASHED = 64, 64, 96, 32
WIDTH = OWN + HASHED
#: Words with ids of their own, ids that the others share, and all ids with 0, which stands outside the text.
FREQUENT, SHARED = DIRECT + GROUPS * OWN, GROUPS * HASHED
VOCAB = 1 + DIRECT + GROUPS * WIDTH
#: Tokens of context on either side, width of an embedding and of the hidden layer.
SIDE, EMBED, HIDDEN = 2, 8, 15
OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]
#: Tokens of a training piece at most.
PIECE = 1024
#: Bytes of pieces among which a task looks for equal ones.
HELD = 32_000_000
#: Windows of a shard, about, shards at least, and rounds of averaging, each with its share of the shards.
SHARD, SHARDS, ROUNDS = 2_000_000, 8, 2
#: Parts of 1 that a network is rounded to for averaging, and windows that weigh 1 there: whole numbers, so that sums don't depend on their order.
PARTS_SUM, WINDOWS_SUM = 1 << 18, 1000
#: Rows of a training step: a shard takes about so many steps, of STEP rows at least and at most.
STEPS, STEP = 400, (64, 4096)
RATE, SEED = 0.2, 3
#: A block of documents is scored at once and is complete with so many tokens.
BLOCK = 2_000_000
#: Bytes of text that are split into words at once.
SPLIT = 1_000_000
#: Rows put through the network at once: their logits stay in a core's cache.
CHUNK = 2048
#: Parts of 1 that hidden values and weights are rounded to, and bound of the weights: products of both add up to less than 2^24 parts.
PARTS_H, PARTS_W, BOUND_W = 512, 128, 7.99


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z): runs of bytes other than space and 0x09-0x0D."""
    return (text or "").encode().lower().split()


def own_id(rank: int) -> int:
    """Id of a word by its rank: the first have places in the first softmax, the others are dealt into the groups in turn."""
    if rank < DIRECT:
        return 1 + rank
    return 1 + DIRECT + (rank - DIRECT) % GROUPS * WIDTH + (rank - DIRECT) // GROUPS


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word) % SHARED


def shared_id(bucket: int) -> int:
    """Id of a bucket of words without ids of their own."""
    return 1 + DIRECT + bucket % GROUPS * WIDTH + OWN + bucket // GROUPS


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(:func:`words_of` all texts one after the other, words of each text)."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    parts = pc.ascii_split_whitespace(bare)
    words, some = parts.flatten(), pc.binary_length(bare).to_numpy() > 0
    if not some.all():  # a text without words is split into one empty word
        words = words.filter(pc.greater(pc.binary_length(words), 0))
    return words.cast(pa.binary()), np.where(some, pc.list_value_length(parts).to_numpy(), 0)


def stretches(texts: pa.Array) -> list[tuple[int, int]]:
    """(first row, rows) of stretches of some SPLIT bytes of text, of one row at least."""
    place = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // SPLIT
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
    return [(a, b - a) for a, b in pairwise(edges) if a < b]


def buckets_of(words: pa.Array) -> np.ndarray:
    """:func:`bucket_of` each word."""
    _, offsets, data = words.buffers()
    data, ends = (data or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    return (np.fromiter((zlib.crc32(data[a:b]) for a, b in pairwise(ends)), np.uint32, len(words)) % SHARED).astype(np.int16)


def listed(values) -> pa.Array:
    """A column of one row that lists all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Vocabulary(list):
    """The words with ids of their own, by frequency.

    ``counts`` (word, n) has all other words of the corpus, written; ``own`` the occurrences of the
    words with ids, ``behind`` those of the words behind each bucket.
    """

    def __init__(self, words: list[bytes], own: list[int], counts: DataFrame, behind: np.ndarray) -> None:
        super().__init__(words)
        self.own, self.counts, self.behind = own, counts, behind

    def ids(self) -> dict[bytes, int]:
        return {w: own_id(k) for k, w in enumerate(self)}

    def occurrences(self) -> np.ndarray:
        """Occurrences of each id."""
        out = np.zeros(VOCAB)
        out[[own_id(k) for k in range(len(self))]] = self.own
        out[[shared_id(b) for b in range(SHARED)]] = self.behind
        return out


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as blocks of word numbers, written: (block, keys, n, numbers, words, counts, buckets).

    A block is a run of rows of one task.  ``n`` has the tokens of each document, ``numbers`` all their
    words as int32 places in the block's list of distinct ``words``, beside which stand their
    occurrences in the block and their buckets.
    """
    two = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = two.schema["key"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number, task = 0, TaskContext.get().partitionId()

        def block(keys, words, n):
            told = pa.concat_arrays(words).dictionary_encode()
            numbers, own = told.indices.to_numpy(), told.dictionary
            return pa.RecordBatch.from_arrays([
                pa.array([task << 32 | number], pa.int64()), listed(pa.concat_arrays(keys)), listed(pa.array(np.concatenate(n), pa.int64())), pa.array([numbers.tobytes()], pa.binary()),
                listed(own), listed(pa.array(np.bincount(numbers, minlength=len(own)), pa.int64())), pa.array([buckets_of(own).tobytes()], pa.binary()),
            ], names=["block", "keys", "n", "numbers", "words", "counts", "buckets"])

        keys, words, n, held = [], [], [], 0
        for batch in batches:
            for first, rows in stretches(batch.column(1)):
                w, k = split(batch.column(1).slice(first, rows))
                keys.append(batch.column(0).slice(first, rows))
                words.append(w)
                n.append(k)
                held += len(w) + 10 * rows
                if held >= BLOCK:
                    yield block(keys, words, n)
                    number += 1
                    keys, words, n, held = [], [], [], 0
        if keys:
            yield block(keys, words, n)

    shape = f"block long, keys array<{kind}>, n array<long>, numbers binary, words array<binary>, counts array<long>, buckets binary"
    return cut(two.mapInArrow(lambda batches: trimmed(run(batches)), shape), "lm-blocks")


def frequent(blocks: DataFrame) -> Vocabulary:
    """The most frequent words of all blocks, by count and then by bytes, and the counts of all words; only the former and a sum a bucket leave the executors."""
    parts = blocks.select(F.inline(F.arrays_zip("words", "counts")).alias("word", "n"))
    totals = cut(parts.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    top = totals.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words, own = [bytes(r["word"]) for r in top], [r["n"] for r in top]
    # what comes behind the last frequent word in that order
    rest = totals.where((F.col("n") < own[-1]) | ((F.col("n") == own[-1]) & (F.col("word") > F.lit(words[-1])))) if top else totals
    behind = np.zeros(SHARED, np.int64)
    for r in rest.groupBy((F.crc32("word") % SHARED).alias("k")).agg(F.sum("n").alias("n")).collect():
        behind[r["k"]] = r["n"]
    return Vocabulary(words, own, rest, behind)


@dataclass
class Net:
    embed: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def start(cls, occurrences: np.ndarray | None = None, seed: int = SEED) -> Net:
        """A network that knows how often each id occurs, and nothing of contexts."""
        r = np.random.default_rng(seed)
        n, k = 2 * SIDE * EMBED, DIRECT + GROUPS
        often = np.ones(VOCAB) if occurrences is None else occurrences + 0.5
        groups = often[1 + DIRECT :].reshape(GROUPS, WIDTH)
        one = np.log(np.concatenate([often[1 : 1 + DIRECT], groups.sum(1)]))
        two = np.log(groups)
        made = (
            r.normal(0, 0.3, (VOCAB, EMBED)), r.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), np.concatenate([np.zeros((HIDDEN, k)), (one - one.mean())[None]]),
            np.concatenate([np.zeros((GROUPS, HIDDEN, WIDTH)), (two - two.mean(1, keepdims=True))[:, None]], 1),
        )
        return cls(*(x.astype(np.float32) for x in made))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.inner, self.inner_bias, self.first, self.second]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Net:
        return cls(*views(flat.astype(np.float32)))

    def train(self, rows: np.ndarray, weight: np.ndarray | None = None) -> None:
        """One pass of Adagrad over rows of (context, id), each of which stands for ``weight`` equal ones."""
        # parameters, gradients and moments each lie in one array, so that a step is few operations; the last hidden value is a constant, whose weights are the biases
        flat = self.flat()
        grad, moments, spare = np.zeros_like(flat), np.full_like(flat, 1e-8), np.empty_like(flat)
        embed, inner, inner_bias, first, second = views(flat)
        g_embed, g_inner, g_inner_bias, g_first, g_second = views(grad)
        logits = np.empty((CHUNK, DIRECT + GROUPS), np.float32)
        size = min(max(len(rows) // STEPS, STEP[0]), STEP[1])
        for lo in range(0, len(rows), size):
            part = rows[lo : lo + size]
            share = np.full(len(part), 1 / len(part), np.float32) if weight is None else (weight[lo : lo + size] / weight[lo : lo + size].sum()).astype(np.float32)
            # by group, the ids of the first softmax ahead: then a group's rows are a stretch
            place = part[:, -1].astype(np.int32) - (1 + DIRECT)
            group = np.where(place < 0, -1, place // WIDTH).astype(np.int16)
            order = group.argsort(kind="stable")
            part, share, place, group = part[order], share[order], place[order], group[order]
            context = part[:, :-1].ravel()
            x = embed.take(context, 0).reshape(len(part), -1)
            h = np.ones((len(part), HIDDEN + 1), np.float32)
            np.tanh(x @ inner + inner_bias, out=h[:, :-1])
            dh = np.empty_like(h)
            target = np.where(group < 0, place + DIRECT, DIRECT + group)
            g_first[:] = 0
            for a in range(0, len(part), CHUNK):
                b = min(a + CHUNK, len(part))
                z = logits[: b - a]
                np.matmul(h[a:b], first, out=z)
                by = slopes(z, target[a:b], share[a:b])
                g_first += (h[a:b] * by).T @ z
                np.matmul(z, first.T, out=dh[a:b])
                dh[a:b] *= by
            edges = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
            g_second[:] = 0
            for groups in runs(edges):
                a, b = edges[groups[0]], edges[groups[-1] + 1]
                z, back = np.empty((b - a, WIDTH), np.float32), np.empty((b - a, HIDDEN + 1), np.float32)
                own = [(g, h[edges[g] : edges[g + 1]], z[edges[g] - a : edges[g + 1] - a], edges[g] - a, edges[g + 1] - a) for g in groups]
                for g, hg, zg, _, _ in own:
                    np.matmul(hg, second[g], out=zg)
                by = slopes(z, place[a:b] % WIDTH, share[a:b])
                weighed = h[a:b] * by
                for g, _, zg, i, j in own:
                    np.matmul(zg, second[g].T, out=back[i:j])
                    np.matmul(weighed[i:j].T, zg, out=g_second[g])
                back *= by
                dh[a:b] += back
            # nothing comes back from the constant, whose slope is 0
            dh *= 1 - h * h
            dh = np.ascontiguousarray(dh[:, :-1])
            np.matmul(x.T, dh, out=g_inner)
            dh.sum(0, out=g_inner_bias)
            dx = np.ascontiguousarray((dh @ inner.T).reshape(-1, EMBED).T, np.float64)
            for k in range(EMBED):
                g_embed[:, k] = np.bincount(context, dx[k], VOCAB)
            np.multiply(grad, grad, out=spare)
            moments += spare
            np.sqrt(moments, out=spare)
            np.divide(grad, spare, out=spare)
            spare *= RATE
            flat -= spare
        self.embed, self.inner, self.inner_bias, self.first, self.second = views(flat)

    def rounded(self) -> Scorer:
        return Scorer(self)


def views(flat: np.ndarray) -> list[np.ndarray]:
    """The arrays of a network within its flat form."""
    k = DIRECT + GROUPS
    shapes = [(VOCAB, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN + 1, k), (GROUPS, HIDDEN + 1, WIDTH)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]


def slopes(z: np.ndarray, target: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Turns logits in place into the slopes of each row's loss but for a factor, which it returns: the row's share by its sum."""
    if z.max() > 60:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z[np.arange(len(z)), target] -= total
    return (share / total)[:, None]


def runs(edges: list[int]) -> list[list[int]]:
    """Runs of groups that have rows between their ``edges``, of some CHUNK rows each or of one group."""
    out, start = [], None
    for g, (a, b) in enumerate(pairwise(edges)):
        if a == b:
            continue
        if start is None or b - start > CHUNK:
            out.append([])
            start = a
        out[-1].append(g)
    return out


class Scorer:
    """A network with hidden values and weights rounded to parts of 1, whose products' sums are exact whatever their order."""

    def __init__(self, net: Net) -> None:
        weights = lambda w: np.rint(np.clip(w, -BOUND_W, BOUND_W) * PARTS_W).astype(np.float32) / np.float32(PARTS_W)
        self.sides = [np.rint(net.embed.astype(np.float64) @ net.inner[k * EMBED : (k + 1) * EMBED].astype(np.float64) * 4096).astype(np.float32) / np.float32(4096) for k in range(2 * SIDE)]
        self.sides[0] = self.sides[0] + np.rint(net.inner_bias * 4096).astype(np.float32) / np.float32(4096)
        self.first, self.second = weights(net.first[:-1]), weights(net.second[:, :-1])
        self.first_bias, self.second_bias = net.first[-1], net.second[:, -1]

    def log_probs(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the id at each position given both sides.

        All positions are put in order of their ids' groups first, so that products are few and large; sums
        are exact in any order, so nothing depends on that.
        """
        out = np.empty(len(at), np.float64)
        place = flat[at].astype(np.int32) - (1 + DIRECT)
        group = np.where(place < 0, -1, place // WIDTH).astype(np.int16)
        order = group.argsort(kind="stable")
        one, two = np.empty((CHUNK, DIRECT + GROUPS), np.float32), np.empty((CHUNK, WIDTH), np.float32)
        for lo in range(0, len(at), CHUNK):
            mine = order[lo : lo + CHUNK]
            out[mine] = self._log_probs(flat, at[mine], place[mine], group[mine], one[: len(mine)], two[: len(mine)])
        return out

    def _log_probs(self, flat: np.ndarray, p: np.ndarray, place: np.ndarray, group: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = self.sides[0].take(flat[p + OFFSETS[0]], 0)
        for t, k in zip(self.sides[1:], OFFSETS[1:], strict=True):
            h += t.take(flat[p + k], 0)
        np.tanh(h, out=h)
        h *= PARTS_H
        np.rint(h, out=h)
        h /= PARTS_H
        np.matmul(h, self.first, out=one)
        one += self.first_bias
        own = log_of(one, np.where(group < 0, place + DIRECT, DIRECT + group))
        low = max(0, int(group[0]))
        edges = np.searchsorted(group, np.arange(low, int(group[-1]) + 2)).tolist()
        if edges[0] < len(p):
            for g, (a, b) in enumerate(pairwise(edges), low):
                if a < b:
                    np.matmul(h[a:b], self.second[g], out=two[a:b])
                    two[a:b] += self.second_bias[g]
            own[edges[0] :] += log_of(two[edges[0] :], place[edges[0] :] % WIDTH)
        return own


def log_of(z: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its column; ``z`` is used up."""
    own = z[np.arange(len(z)), column].astype(np.float64)
    top = z.max()
    if top > 60:  # by rows alone, so that a row's result is its own
        rest = z.max(1) * (z.max(1) > 60)
        z -= rest[:, None]
        own -= rest
    np.exp(z, out=z)
    return own - np.log(np.einsum("ij->i", z).astype(np.float64))


def blocks_of(batches):
    """(batch, row, n, numbers, words, buckets) of each block."""
    for batch in batches:
        n, numbers, words, buckets = (batch.column(c) for c in ("n", "numbers", "words", "buckets"))
        for k in range(batch.num_rows):
            yield batch, k, n[k].values.to_numpy(), np.frombuffer(numbers[k].as_buffer(), np.int32), words[k].values, np.frombuffer(buckets[k].as_buffer(), np.int16)


def ids_of(words: pa.Array, buckets: np.ndarray, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a block's words, whether they are their own); ``own`` has the words with ids by rank."""
    rank = pc.index_in(words, value_set=pa.array(own, pa.binary())).fill_null(-1).to_numpy()
    ids = np.append(np.array([own_id(k) for k in range(len(own))], np.int32), 0)[rank]
    return np.where(rank >= 0, ids, shared_id(buckets.astype(np.int32))).astype(np.uint16), rank >= 0


def padded(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with SIDE zeros before, between and behind the texts, position of each text's first token)."""
    starts = np.cumsum(n) - n + SIDE * np.arange(1, len(n) + 1)
    flat = np.zeros(len(ids) + SIDE * (len(n) + 1), np.uint16)
    flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return flat, starts


def pieces(blocks: DataFrame, vocab: Vocabulary, shards: int) -> DataFrame:
    """(shard, hash, weight, flat): training pieces, written, equal ones put together as far as a task sees them.

    A piece has up to PIECE tokens of a text and SIDE ids, 0 outside the text, on either side.  Pieces
    start at fixed places of a text and are dealt by their own hash.
    """

    def out(held):
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([int.from_bytes(h[:8], "little") % shards for h in held], pa.int64()), "hash": pa.array(list(held), pa.binary()),
            "weight": pa.array([w for w, _ in held.values()], pa.int64()), "flat": pa.array([x for _, x in held.values()], pa.binary()),
        })

    own = list(vocab)

    def run(batches):
        held, size = {}, 0
        for _, _, n, numbers, words, buckets in blocks_of(batches):
            flat, starts = padded(ids_of(words, buckets, own)[0][numbers], n)
            for a, k in zip(starts.tolist(), n.tolist(), strict=True):
                for lo in range(0, k, PIECE):
                    x = flat[a + lo - SIDE : a + min(k, lo + PIECE) + SIDE].tobytes()
                    h = hashlib.blake2b(x, digest_size=16).digest()
                    if h in held:
                        held[h] = (held[h][0] + 1, x)
                    else:
                        held[h] = (1, x)
                        size += len(x) + 100
                if size > HELD:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    made = blocks.select("n", "numbers", "words", "buckets").mapInArrow(lambda batches: trimmed(run(batches)), "shard long, hash binary, weight long, flat binary")
    return cut(made, "lm-pieces")


def rows_of(flat: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of context and id, their weights) of pieces."""
    ids = [np.frombuffer(x, np.uint16) for x in flat]
    n = np.array([len(x) for x in ids], np.int64) - 2 * SIDE
    ends = np.cumsum(n + 2 * SIDE)
    at = np.repeat(ends - SIDE - np.cumsum(n), n) + np.arange(int(n.sum()))
    whole = np.concatenate(ids)
    return np.stack([whole[at + k] for k in [*OFFSETS, 0]], 1), np.repeat(weight, n).astype(np.float32)


def trainer(start: np.ndarray):
    """What trains one shard from the flat network ``start``."""

    def trained(t: pa.Table) -> pa.Table:
        t = t.group_by("hash").aggregate([("weight", "sum"), ("flat", "min")]).sort_by("hash")
        rows, weight = rows_of(t["flat_min"].to_pylist(), t["weight_sum"].to_numpy())
        mixed = np.random.default_rng(SEED).permutation(len(rows))
        own = Net.from_flat(start)
        own.train(rows[mixed], weight[mixed])
        share = 1 + int(weight.sum(dtype=np.float64)) // WINDOWS_SUM
        net = np.rint(own.flat().astype(np.float64) * PARTS_SUM).astype(np.int64) * share
        del rows, weight, t
        trim()
        return pa.table({"n": pa.array([share], pa.int64()), "net": pa.array([net.tobytes()], pa.binary())})

    return trained


def added(batches):
    """The sum of a task's networks."""
    n, net = 0, np.zeros(0, np.int64)
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("net"), strict=True):
            own = np.frombuffer(x.as_buffer(), np.int64)
            n, net = n + k, own + net if n else own.copy()
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "net": pa.array([net.tobytes()], pa.binary())})


def train(blocks: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Net:
    """The network from all tokens of :func:`numbered` documents.

    Shards hold about SHARD windows, so there are as many as the corpus asks for.  Their networks are
    summed up where they are made and then in four tasks; what comes to the driver is four.
    """
    occurrences = vocab.occurrences()
    net, total = Net.start(occurrences), int(occurrences.sum())
    shards = max(SHARDS, -(-total // SHARD))
    kind, made = "n long, net binary", pieces(blocks, vocab, shards)
    for turn in range(rounds):
        each = made.where(F.col("shard") % rounds == turn).groupBy("shard").applyInArrow(trainer(net.flat()), kind)
        got = each.mapInArrow(added, kind).repartition(4).mapInArrow(added, kind).collect()
        if got:
            whole = sum(np.frombuffer(r["net"], np.int64) for r in got)
            net = Net.from_flat(whole / (PARTS_SUM * float(sum(r["n"] for r in got))))
    return net


def fit(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, Net]:
    """(vocabulary, network) from all documents.

    Null texts and texts without words give nothing.  Repeated rows, and equal stretches of texts, weigh
    as often as they come.  Neither keys nor other columns are read.  No rows: no words and the network
    that training starts from.
    """
    blocks = numbered(docs, text, text)
    vocab = frequent(blocks)
    return vocab, train(blocks, vocab)


def score(docs: DataFrame, vocab: Vocabulary, net: Net, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, pll, pll_per_token) per row, over the whole text.

    pll sums the log probabilities of all tokens given the tokens on both sides.  A null text or one
    without words has no tokens, pll 0 and null per token.  Repeated rows score alike.  No rows: an
    empty frame.  Other columns aren't read.
    """
    return scored(numbered(docs, key, text), vocab, net).withColumnRenamed("key", key)


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`score` of ``docs`` under :func:`fit` of the same, which reads the texts once instead of twice."""
    blocks = numbered(docs, key, text)
    vocab = frequent(blocks)
    return scored(blocks, vocab, train(blocks, vocab)).withColumnRenamed("key", key)


def scored(blocks: DataFrame, vocab: Vocabulary, net: Net) -> DataFrame:
    """:func:`score` of :func:`numbered` documents.

    Blocks are put through the network; their distinct words meet the counts by word, and the words'
    shares of their ids return to the block by position.
    """
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    rounded, behind, own = net.rounded(), np.log(vocab.behind + 1.0), list(vocab)

    def run(batches):
        for batch, k, n, numbers, words, buckets in blocks_of(batches):
            ids, theirs = ids_of(words, buckets, own)
            flat, _ = padded(ids[numbers], n)
            pll, rest = sums(rounded.log_probs(flat, np.flatnonzero(flat)), n), ~theirs[numbers]
            row = batch.slice(k, 1)
            yield pa.RecordBatch.from_arrays([
                row.column("block"), row.column("keys"), row.column("n"), listed(pa.array(pll)),
                listed(pa.array(sums(rest, n).astype(np.int64))), pa.array([numbers[rest].tobytes()], pa.binary()), row.column("buckets"),
            ], names=["block", "keys", "n", "pll", "n_rest", "rest", "buckets"])

    shape = f"block long, keys array<{kind}>, n array<long>, pll array<double>, n_rest array<long>, rest binary, buckets binary"
    through = blocks.select("block", "keys", "n", "numbers", "words", "buckets").mapInArrow(lambda batches: trimmed(run(batches)), shape)
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("pos", "word"))
    # what isn't told of has a count of 1; the counts are far fewer than the askers, so only they are put into tables
    counts = asked.join(vocab.counts.where("n > 1").hint("shuffle_hash"), "word").select("of", "pos", F.col("n").alias("count"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        share = -behind[np.frombuffer(left.column("buckets")[0].as_py(), np.int16)]
        share[right.column("pos").to_numpy()] += np.log(right.column("count").to_numpy())
        keys, n, pll, n_rest = (left.column(c).combine_chunks().flatten() for c in ("keys", "n", "pll", "n_rest"))
        pll = pll.to_numpy() + sums(share[np.frombuffer(left.column("rest")[0].as_py(), np.int32)], n_rest.to_numpy())
        mean = [round(p / k, 6) if k else None for p, k in zip(pll.tolist(), n.to_pylist(), strict=True)]
        return pa.table({"key": keys, "n_tokens": n, "pll": pa.array(np.round(pll, 4) + 0.0), "pll_per_token": pa.array(mean, pa.float64())})

    return through.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(finish, f"key {kind}, n_tokens long, pll double, pll_per_token double")


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values each; a run's sum depends on its values alone."""
    out = np.zeros(len(n))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.float64, copy=False), (np.cumsum(n) - n)[some])
    return out
