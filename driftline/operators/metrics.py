"""Distances between text sets: token frequencies, and kernel mean discrepancy of vectors.

Every metric takes long rows with a group column, so that several comparisons share one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import words
from driftline.session import cut

#: Vectors of a block, and bytes of vectors on each side of a tile.
BLOCK, TILE_BYTES = 1024, 32_000_000
#: Blocks on each side of a tile at most, as a tile's work grows with their product; tiles for each core at least, where blocks allow.
TILE_BLOCKS, TILES_A_CORE = 32, 4
#: Rows and columns of distances that are made at a time, as many as a core's cache holds.
STRIP = 256
#: Partitions of tiles at most.
MOST_PARTS = 10_000
#: Values among which the median is looked up at last; looks go by so many bits of the values, the first ones first.
FEW, BITS = 200_000, (20, 16, 16, 12)
#: Bins of the values between two ends.
BINS = 1 << 16


def token_counts(rows: DataFrame, by: list[str], text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(by..., tok, n): pooled counts of 1-grams; ``tokens`` is an array column, by default runs without white space."""
    return rows.select(*by, F.explode(words(text) if tokens is None else tokens).alias("tok")).groupBy(*by, "tok").agg(F.count("*").alias("n"))


def token_l2(rows: DataFrame, by: list[str], side: str = "side", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(by..., token_l2, vocab_size) from rows with side ``a`` or ``b``.

    The distance between both sides' frequencies over their joint vocabulary; a side without tokens is
    the zero vector.  Without any token the distance is 0 over an empty vocabulary.  As a difference of
    sums of squares it is good to about 1e-9.
    """
    counts = token_counts(rows, [*by, side], text, tokens)
    one = counts.groupBy(*by, "tok").agg(*[F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in "ab"])
    # with sums of squares and products no second pass over the counts is needed for the totals
    sums = one.groupBy(*by).agg(
        F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.sum(F.col("na").cast("double") ** 2).alias("aa"),
        F.sum(F.col("nb").cast("double") ** 2).alias("bb"), F.sum(F.col("na").cast("double") * F.col("nb")).alias("ab"), F.count("*").alias("vocab_size"),
    )
    found = sums.select(*by, _distance().alias("token_l2"), "vocab_size")
    if by:
        groups = rows.select(*by).distinct()
        found = groups.join(found, by, "left")
    return found.select(*by, F.coalesce("token_l2", F.lit(0.0)).alias("token_l2"), F.coalesce("vocab_size", F.lit(0)).cast("long").alias("vocab_size"))


def vector_problems(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, n, empty, not_finite, dim_min, dim_max) a set of vectors."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(v.isNull() | (F.size(v) == 0)).alias("empty"), F.count_if(odd).alias("not_finite"),
        F.min(F.when(F.size(v) > 0, F.size(v))).alias("dim_min"), F.max(F.when(F.size(v) > 0, F.size(v))).alias("dim_max"),
    )


def blocks(rows: DataFrame, group: str, side: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(g, b, s, v): vectors of a group, with what ``side`` says of each, packed into written blocks of about ``block`` rows.

    Rows are dealt by number, not by what is in them, so blocks stay even whatever keys or vectors repeat.
    """
    kind = rows.select(vector).schema[0].dataType
    # single precision moves as such; tasks reckon in double precision
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    flat = rows.select(F.col(group).alias("g"), F.col(side).alias("s"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    numbered = cut(flat.withColumn("k", F.monotonically_increasing_id()), "vectors")
    sizes = numbered.groupBy("g").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    dealt = numbered.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    # a block is bounded, so it may be one row
    packed = dealt.groupBy("g", "b").agg(F.sort_array(F.collect_list(F.struct("k", "s", "v"))).alias("rows"))
    return cut(packed.select("g", "b", F.col("rows.s").alias("s"), F.col("rows.v").alias("v")), "vector-blocks")


def tiles(made: DataFrame, tile_bytes: int | None = None) -> DataFrame:
    """(g, i, j, b, s, v): each block beside those that it meets, on the upper half of a grid of tiles (i, j), i <= j.

    The kernel is a sum over all pairs of vectors, so all of them are needed.  A group's blocks are dealt
    to bands; band i and band j meet in tile (i, j).  So a block moves once for each band, not once for
    each other block.  Bands hold at most TILE_BLOCKS blocks and TILE_BYTES of vectors, so no tile takes
    longer as the input grows, and fewer where there would be too few tiles for all cores; with
    ``tile_bytes`` as many as these bytes hold.  There are as many partitions as tiles.  ``made`` is read
    several times and should be written.
    """
    each = made.groupBy("g").agg((F.max("b") + 1).alias("n"), F.max(F.size("v") * F.size(F.col("v")[0]) * 8).alias("width"))
    found = each.agg(F.max("width"), F.sum(F.col("n").cast("double") * (F.col("n") + 1) / 2)).first()
    width, met = found[0] or 1, found[1] or 0.0
    side = max(1, (tile_bytes or TILE_BYTES) // width)
    if tile_bytes is None:
        side = max(1, min(side, TILE_BLOCKS, int((met / TILES_A_CORE / made.sparkSession.sparkContext.defaultParallelism) ** 0.5)))
    bands = each.select("g", F.ceil(F.col("n") / F.lit(side)).cast("int").alias("bands"))
    parts = bands.agg(F.sum(F.col("bands").cast("long") * (F.col("bands") + 1) / 2)).first()[0] or 1
    own = made.join(bands, "g").withColumn("_band", F.col("b") % F.col("bands"))
    other = F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("_other")
    dealt = own.select("g", "b", "s", "v", "_band", other).select(
        "g", F.least("_band", "_other").alias("i"), F.greatest("_band", "_other").alias("j"), "_band", "b", "s", "v"
    )
    return dealt.repartition(int(min(parts, MOST_PARTS)), "g", "i", "j")


def _stack(scalar) -> np.ndarray:
    """The rows of a list of lists of one length."""
    rows = scalar.values
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), -1)


def block_pairs(tile: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(squared distances, what is said of the rows, of the columns, whether rows are columns) of each pair of a tile's blocks, once.

    Blocks of more than STRIP rows come in strips, of a block with itself those on and above the diagonal.
    The distances' memory is used again for the next ones.
    """
    i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
    rows, columns, room = [], [], np.empty(STRIP * STRIP)
    for r in range(tile.num_rows):
        band, b, v, s = tile.column("_band")[r].as_py(), tile.column("b")[r].as_py(), _stack(tile.column("v")[r]), np.array(tile.column("s")[r].as_py())
        square, one = (v * v).sum(1)[:, None], np.ones((len(v), 1))
        # one product of these gives |v|^2 + |w|^2 - 2 vw
        if band == i:
            rows.append((b, np.hstack([-2.0 * v, square, one]), s))
        if band == j:
            columns.append((b, np.hstack([v, one, square]), s))
    for b, v, s in rows:
        for c, w, t in columns:
            if i == j and b > c:
                continue
            same = i == j and b == c
            for x in range(0, len(v), STRIP):
                for y in range(x if same else 0, len(w), STRIP):
                    p, q = v[x : x + STRIP], w[y : y + STRIP]
                    d = np.matmul(p, q.T, out=room[: len(p) * len(q)].reshape(len(p), len(q)))
                    yield np.maximum(d, 0.0, out=d), s[x : x + STRIP], t[y : y + STRIP], same and x == y


def _distances(tile: pa.Table) -> Iterator[np.ndarray]:
    for d, _, _, same in block_pairs(tile):
        yield d[np.triu_indices(len(d), 1)] if same else d.ravel()


def over_tiles(made: DataFrame, run: Callable[[pa.Table], pa.Table], kind: str) -> DataFrame:
    return made.groupBy("g", "i", "j").applyInArrow(run, kind)


def bracket(written: DataFrame) -> tuple[float, float] | None:
    """Two values that have the median squared distance of all pairs between them, nearly always; none for too few vectors.

    The vectors of a block are a random part of their group, so neighbours in it are pairs that have
    nothing to do with each other.  A sketch of their distances is taken where the blocks are; the
    bracket is five standard errors wide to either side.
    """
    n = written.agg(F.sum(F.floor(F.size("v") / 2))).first()[0] or 0
    if n < 100:
        return None

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                v = _stack(batch.column(0)[r])
                x, y = v[0 : len(v) // 2 * 2 : 2], v[1::2]
                yield pa.RecordBatch.from_pydict({"d": pa.array(((x - y) ** 2).sum(1), pa.float64())})

    wide = min(0.5, 2.5 / n**0.5)
    ends = written.select("v").mapInArrow(run, "d double").agg(F.percentile_approx("d", F.array(F.lit(0.5 - wide), F.lit(0.5 + wide)), 10_000)).first()[0]
    return (ends[0], ends[1]) if 0 < ends[0] < ends[1] else None


def bandwidth(made: DataFrame, ends: tuple[float, float] | None = None) -> float:
    """Square root of the median squared distance of all pairs of :func:`tiles`; of those above 0 if the median is 0.

    Exact at any size.  With ``ends`` that have the median between them, as :func:`bracket` finds them,
    two passes over the pairs do: one counts what is below, and what is inside in fine bins, the other
    fetches the values of the median's bin.  Without, or if the bracket misses, counts by the first bits
    of the numbers lead to those that the median begins with, whose next bits are the next look's, until
    the values left are few enough to be sorted.
    """
    if ends is not None and (found := _within(made, *ends)) is not None:
        return found
    seen: dict = {}
    first = _counts(made, 0, None, seen)
    n, zeros = sum(first.values()), first.get(-1, 0)
    if not n:
        raise ValueError("a bandwidth needs two vectors")
    if zeros == n:
        raise ValueError("all vectors coincide, so there is no bandwidth")
    positive = n - zeros
    ranks = (zeros + (positive - 1) // 2, zeros + positive // 2) if zeros > n // 2 else ((n - 1) // 2, n // 2)
    return float(np.sqrt(sum(_value_at(made, r, seen) for r in ranks) / 2))


def _within(made: DataFrame, lo: float, hi: float) -> float | None:
    """:func:`bandwidth` from the values between two ends; none if they don't hold the median, or too many values as one."""

    def bins(d: np.ndarray) -> np.ndarray:
        # never falls as d rises, so bins are in order of their values
        return np.clip(np.floor((d - lo) / (hi - lo) * BINS).astype(np.int64), 0, BINS - 1)

    def inside(d: np.ndarray) -> np.ndarray:
        return d[(d >= lo) & (d <= hi)]

    def count(tile: pa.Table) -> pa.Table:
        total = np.zeros(BINS + 2, np.int64)
        for d in _distances(tile):
            below, held = np.count_nonzero(d < lo), inside(d)
            total[0] += below
            total[-1] += d.size - below - held.size
            np.add.at(total, bins(held) + 1, 1)
        at = np.flatnonzero(total)
        return pa.table({"bin": pa.array(at - 1, pa.int32()), "n": pa.array(total[at], pa.int64())})

    got = sorted((r[0], r[1]) for r in over_tiles(made, count, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect())
    n, held, before = sum(m for _, m in got), {}, 0
    ranks = (n - 1) // 2, n // 2
    for k, m in got:
        for r in ranks:
            if before <= r < before + m:
                held[r] = k, r - before, m
        before += m
    if not n or any(k in (-1, BINS) or m > FEW for k, _, m in held.values()):
        return None
    wanted = sorted({k for k, _, _ in held.values()})

    def fetch(tile: pa.Table) -> pa.Table:
        parts = [(d[i := np.isin(at := bins(d), wanted)], at[i]) for d in map(inside, _distances(tile))]
        d, at = (np.concatenate([p[x] for p in parts]) if parts else np.zeros(0) for x in (0, 1))
        return pa.table({"bin": pa.array(at, pa.int32()), "d": pa.array(d, pa.float64())})

    values = over_tiles(made, fetch, "bin int, d double").groupBy("bin", "d").agg(F.count("*").alias("n")).collect()
    by = {k: _spread([(r["d"], r["n"]) for r in values if r["bin"] == k]) for k in wanted}
    return float(np.sqrt(sum(by[k][at] for k, at, _ in (held[r] for r in ranks)) / 2))


def _spread(counted: list[tuple[float, int]]) -> np.ndarray:
    """Values in order, each as often as it comes."""
    counted = sorted(counted)
    return np.repeat([d for d, _ in counted], [n for _, n in counted])


def _bits(d: np.ndarray) -> np.ndarray:
    """Numbers that are not negative as whole numbers in the same order."""
    return d.astype(np.float64, copy=False).view(np.int64)


def _shift(look: int) -> int:
    return 64 - sum(BITS[: look + 1])


def _counts(made: DataFrame, look: int, prefix: int | None, seen: dict) -> dict[int, int]:
    """Squared distances by their first bits, as many as the look goes by: those that begin with ``prefix``; 0 counts as -1."""
    if (look, prefix) in seen:
        return seen[look, prefix]

    def run(tile: pa.Table) -> pa.Table:
        total: dict[int, int] = {}
        for d in _distances(tile):
            key = _bits(d)
            if prefix is not None:
                key = key[key >> _shift(look - 1) == prefix]
            elif zero := int((key == 0).sum()):
                total[-1] = total.get(-1, 0) + zero
                key = key[key != 0]
            at, n = np.unique(key >> _shift(look), return_counts=True)
            for k, m in zip(at.tolist(), n.tolist(), strict=True):
                total[k] = total.get(k, 0) + m
        return pa.table({"key": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    got = {r[0]: r[1] for r in over_tiles(made, run, "key long, n long").groupBy("key").agg(F.sum("n")).collect()}
    return seen.setdefault((look, prefix), got)


def _value_at(made: DataFrame, rank: int, seen: dict) -> float:
    """The value at a rank among the squared distances."""
    prefix, before = None, 0
    for look in range(len(BITS)):
        counts = _counts(made, look, prefix, seen)
        for key in sorted(counts):
            if rank < before + counts[key]:
                break
            before += counts[key]
        if key == -1:
            return 0.0
        prefix = key
        if counts[key] <= FEW:
            for d, n in _values(made, look, prefix, seen):
                if rank < before + n:
                    return d
                before += n
    return float(np.int64(prefix).view(np.float64))


def _values(made: DataFrame, look: int, prefix: int, seen: dict) -> list[tuple[float, int]]:
    """(value, times) of the squared distances that begin with ``prefix``, in order."""

    def run(tile: pa.Table) -> pa.Table:
        d = np.concatenate([x[_bits(x) >> _shift(look) == prefix] for x in _distances(tile)] or [np.zeros(0)])
        d, n = np.unique(d, return_counts=True)
        return pa.table({"d": pa.array(d, pa.float64()), "n": pa.array(n, pa.int64())})

    if ("values", look, prefix) not in seen:
        seen["values", look, prefix] = sorted((r[0], r[1]) for r in over_tiles(made, run, "d double, n long").groupBy("d").agg(F.sum("n")).collect())
    return seen["values", look, prefix]


def _kernel(d: np.ndarray, sigma: float, same: bool) -> np.ndarray:
    """Values of the kernel in place of squared distances; of rows with themselves each pair once."""
    np.multiply(d, -0.5 / (sigma * sigma), out=d)
    np.exp(d, out=d)
    return np.triu(d, 1) if same else d


def kernel_sums(made: DataFrame, sigma: float) -> DataFrame:
    """(g, x, y, total): sums of the Gaussian kernel over pairs of different vectors of :func:`tiles`, by their sides, x <= y; each pair once."""
    group = made.schema["g"].dataType

    def run(tile: pa.Table) -> pa.Table:
        names = np.array(sorted(pc.unique(pc.list_flatten(tile.column("s"))).to_pylist()))
        total = np.zeros((len(names), len(names)))
        for d, s, t, same in block_pairs(tile):
            k = _kernel(d, sigma, same)
            total += (s[:, None] == names).T.astype(float) @ (k @ (t[:, None] == names).astype(float))
        sums = {(str(names[x]), str(names[y])): float(total[x, y] + (total[y, x] if x < y else 0.0)) for x in range(len(names)) for y in range(x, len(names))}
        g = pa.array([tile.column("g")[0].as_py()] * len(sums), tile.schema.field("g").type)
        return pa.table({"g": g, "x": pa.array([p[0] for p in sums], pa.string()), "y": pa.array([p[1] for p in sums], pa.string()), "total": pa.array(list(sums.values()), pa.float64())})

    return over_tiles(made, run, f"g {group.simpleString()}, x string, y string, total double").groupBy("g", "x", "y").agg(F.sum("total").alias("total"))


def mmd2(rows: DataFrame, group: str, side: str, vector: str, key: str, sigma: float | None = None, block: int = BLOCK, tile_bytes: int | None = None) -> DataFrame:
    """(group, mmd2, bandwidth, n, m): unbiased squared discrepancy of sides ``a`` and ``b`` in each group.

    Diagonal terms are left out, so the value may be below 0.  Without ``sigma`` the bandwidth is the
    median over the pool; then there must be one group.  A group with under two vectors on a side, or
    with invalid ones, is an error.  Blocks of vectors meet tile by tile; no task holds a set.  ``key``
    names the rows; repeated and null ones are rows of their own.
    """
    if sigma is not None and sigma <= 0:
        raise ValueError(f"a bandwidth must be positive, not {sigma}")
    written = blocks(rows.withColumn(side, F.col(side).cast("string")), group, side, vector, block)  # read by every look and by the kernel
    made = tiles(written, tile_bytes)
    if sigma is None:
        if written.select("g").distinct().count() > 1:
            raise ValueError("one bandwidth for several groups must be given")
        sigma = bandwidth(made, bracket(written))
    sizes = rows.groupBy(F.col(group).alias("g")).agg(*[F.count_if(F.col(side) == s).alias(n) for s, n in (("a", "n"), ("b", "m"))])
    sums = kernel_sums(made, sigma).groupBy("g").agg(
        *[F.coalesce(F.sum(F.when((F.col("x") == x) & (F.col("y") == y), F.col("total"))), F.lit(0.0)).alias(x + y) for x, y in ("aa", "bb", "ab")]
    )
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return sizes.join(sums, "g").select(
        F.col("g").alias(group), F.when((n < 2) | (m < 2), _few()).otherwise(_unbiased(n, m)).alias("mmd2"), F.lit(sigma).alias("bandwidth"), F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m")
    )


def _few() -> Column:
    return F.raise_error(F.lit("a discrepancy needs two vectors on either side")).cast("double")


def _unbiased(n: Column, m: Column) -> Column:
    """From sums over pairs, each once."""
    return 2 * F.col("aa") / (n * (n - 1)) + 2 * F.col("bb") / (m * (m - 1)) - 2 * F.col("ab") / (n * m)


# --- many splits of one set


def split_marks(halves: DataFrame, splits: int, split: str, key: str) -> DataFrame:
    """(key, marks): what each split makes of a row, from (split, key, half): 1 for ``a``, 2 for ``b``, 0 for a row that it leaves out.  Splits are numbered from 0."""
    side = F.when(F.col("half") == "a", 1).when(F.col("half") == "b", 2).otherwise(0).cast("byte")
    own = halves.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(split).cast("int"), side))).alias("_m"))
    return own.select(key, F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda k: F.coalesce(F.col("_m")[k], F.lit(0).cast("byte"))).alias("marks"))


def mmd2_of_splits(rows: DataFrame, vector: str, splits: int, sigma: float, marks: str = "marks", block: int = BLOCK, tile_bytes: int | None = None) -> DataFrame:
    """(split, mmd2, n, m): the unbiased discrepancy of both halves of every split of one set, by :func:`split_marks`.

    All splits share one pass: a kernel value is computed once, and a block of them is folded into the
    sums of all splits by products with the halves' indicator matrices.
    """
    made = tiles(blocks(rows.withColumn("_g", F.lit(0)), "_g", marks, vector, block), tile_bytes)

    def run(tile: pa.Table) -> pa.Table:
        sums = np.zeros((3, splits))
        for d, s, t, same in block_pairs(tile):
            k = _kernel(d, sigma, same)
            a, b = k @ (t == 1).astype(float), k @ (t == 2).astype(float)
            sums += [(a * (s == 1)).sum(0), (b * (s == 2)).sum(0), (b * (s == 1)).sum(0) + (a * (s == 2)).sum(0)]
        return pa.table({"split": pa.array(range(splits), pa.int32()), "aa": sums[0], "bb": sums[1], "ab": sums[2]})

    sums = over_tiles(made, run, "split int, aa double, bb double, ab double").groupBy("split").agg(*[F.sum(c).alias(c) for c in ("aa", "bb", "ab")])
    sizes = rows.select(F.posexplode(marks).alias("split", "_s")).groupBy("split").agg(F.count_if(F.col("_s") == 1).alias("n"), F.count_if(F.col("_s") == 2).alias("m"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return sizes.join(sums, "split").select("split", F.when((n < 2) | (m < 2), _few()).otherwise(_unbiased(n, m)).alias("mmd2"), "n", "m")


def token_l2_of_splits(rows: DataFrame, splits: int, text: str = "text", marks: str = "marks", tokens: Column | None = None) -> DataFrame:
    """(split, token_l2, vocab_size): :func:`token_l2` of both halves of every split.  Tokens are made and shuffled once, with their counts in all halves."""
    flat = rows.select(marks, F.explode(words(text) if tokens is None else tokens).alias("tok"))
    ones = [F.sum((F.col(marks)[k] == v).cast("long")).alias(f"{x}{k}") for k in range(splits) for x, v in (("a", 1), ("b", 2))]
    counts = flat.groupBy("tok").agg(*ones)
    per = []
    for k in range(splits):
        a, b = F.col(f"a{k}").cast("double"), F.col(f"b{k}").cast("double")
        per.append(F.struct(
            F.lit(k).alias("split"), F.sum(a).alias("ta"), F.sum(b).alias("tb"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"), F.count_if((a > 0) | (b > 0)).alias("vocab_size")
        ))
    one = counts.agg(F.array(*per).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return one.select("split", F.coalesce(_distance(), F.lit(0.0)).alias("token_l2"), "vocab_size")


def _distance() -> Column:
    """From sums (ta, tb), sums of squares (aa, bb) and products (ab) of counts."""
    part = lambda x, y, z: F.when((F.col(y) > 0) & (F.col(z) > 0), F.col(x) / F.col(y) / F.col(z)).otherwise(0.0)
    return F.sqrt(F.greatest(part("aa", "ta", "ta") + part("bb", "tb", "tb") - 2 * part("ab", "ta", "tb"), F.lit(0.0)))
