"""What the operators of this subpackage share: durable cuts, table access, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import cut, fresh_path, shared_dir, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is only ever opened by Spark's reader."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """``name``, or a name like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give memory that a task no longer uses back to the system; workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(batches):
    """``batches``, and :func:`trim` behind them."""
    yield from batches
    trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Forest:
    """Union-find over hashable keys; the smallest key of a set is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        if x not in up:
            up[x] = x
            return x
        r = x
        while up[r] != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


#: Most nodes that count as hubs at a time, and fewest edges of one: narrow rows that any task takes at once.
HUBS, HUB_EDGES = 1 << 16, 50_000


def most_rows(total: int) -> int:
    """Rows of a key beyond which it is hot: of ``total`` rows, at most HUBS keys have so many."""
    return max(HUB_EDGES, total // HUBS)


def joined(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``table`` (key, n, ...), which has one row a key and says how many of the ``total`` rows the key has.

    An inner join that no hot key lands in one task of: for keys with more rows than :func:`most_rows`,
    of which there are at most HUBS, the table's rows are broadcast and the rows stay where they are.
    """
    most, cols = most_rows(total), [c for c in table.columns if c not in (key, "n")]
    if total <= most:  # no key can have more
        return rows.join(table.select(key, *cols), key).select(*rows.columns, *cols)
    hot = table.where(F.col("n") > most).select(key, F.struct(*cols).alias("_hot"))
    told = rows.join(F.broadcast(hot), key, "left")
    rest = told.where("_hot is null").drop("_hot").join(table.where(F.col("n") <= most).select(key, *cols), key)
    return rest.unionByName(told.where("_hot is not null").select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in cols]))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; the number
    of rounds grows with the logarithm of the graph, and more than ``max_rounds`` are an error.  Each
    round is two joins against per-node minima, which are pre-aggregated before they are shuffled;
    a hub's edges are gathered neither into a row nor into a task.  Every round is written to the shared
    folder.  Nodes without an edge are absent.  No links: an empty frame.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if not state[0]:
            break
        # neither step makes more edges than there are, and each edge counts at both ends
        total = 2 * state[0]
        # large star: every larger neighbour of u moves to u's smallest neighbour
        sym = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.first("u")).alias("m"))
        large = joined(sym.where("v > u"), low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, moves to u's smallest neighbour
        low = large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        small = (
            joined(large, low, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        links = cut(small, "links")
        was, state = state, links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == state:
            break
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Bits of :func:`sifted`'s map: 65,536 rows of 64, whatever the tables hold.
SIFT_BITS = 22


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't among ``wanted``'s, for a join that would otherwise shuffle them all.

    A map of hash bits, of a fixed size and so broadcast, lets all wanted rows through and others by
    chance; with very many wanted keys it lets everything through, which costs nothing but the saving.
    """
    h = lambda: F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << SIFT_BITS))
    bits = wanted.select(h().alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_h % 64 as int)))").alias("_bits"))
    own = rows.withColumn("_h", h()).join(F.broadcast(bits), F.shiftright("_h", 6) == F.col("_word"))
    return own.where(F.expr("bit_get(_bits, cast(_h % 64 as int)) = 1")).select(*rows.columns)


#: Rows that one array lists when rows are repeated.
REPEAT = 1 << 16


def repeated(rows: DataFrame, times: str, nth: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 0 in ``nth``; no array is longer than REPEAT, however often a row comes."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEAT))).alias("_part")
    first = F.col("_part") * REPEAT
    return rows.where(F.col(times) > 0).select("*", part).withColumn(nth, F.explode(F.sequence(first, F.least(first + REPEAT, F.col(times)) - 1))).drop("_part")


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)
