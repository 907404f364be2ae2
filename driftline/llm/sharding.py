"""Shards of near equal bytes by multiway Karmarkar-Karp differencing, in cells.

Rows with equal texts form a group that isn't divided.  Groups are dealt into cells by content hash,
and each cell differences its groups.  Differencing only ever looks at partial partitions, so a cell
may start from one: its part of what the shards hold already, to whose subsets its own are tied.  The
last cell starts from all that the shards hold and so evens out what the others have left.

A group larger than a cell's even share can't be evened out within a cell.  Such groups, of which
there are fewer than k a cell, are differenced before the others, in cells of their own if they are many.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import cut, joined, repeated

#: Groups that one cell differences in memory, and rows that are numbered in one task, about.
CELL_GROUPS, RUN_ROWS = 40_000, 1_000_000


def difference(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Combine n partial partitions (rows of k sums) into one.

    Returns (place, totals): place[i, j] is the final subset of row i's j-th sum; totals has the k
    sums, largest first.  The two partial partitions with the largest spread are combined oppositely
    ordered, largest sum with smallest, until one is left; ties go to the earlier one.
    """
    n = len(sums)
    if n == 0:
        return np.zeros((0, k), np.int64), np.zeros(k, np.int64)
    order = np.argsort(-sums, axis=1, kind="stable")
    ranked = np.take_along_axis(sums, order, 1)
    # slots: leaves first, then two children for each slot made later
    left = np.full(k * (2 * n - 1), -1, np.int64)
    right = left.copy()
    heap = [(-int(r[0] - r[-1]), i, r.tolist(), (i * k + o).tolist()) for i, (r, o) in enumerate(zip(ranked, order, strict=True))]
    heapq.heapify(heap)
    free, made = n * k, n
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        both = sorted(((x + y, -s, s, t) for x, y, s, t in zip(a, reversed(b), at, reversed(bt), strict=True)), reverse=True)
        slots = list(range(free, free + k))
        for slot, (_, _, s, t) in zip(slots, both, strict=True):
            left[slot], right[slot] = s, t
        free += k
        total = [x[0] for x in both]
        heapq.heappush(heap, (total[-1] - total[0], made, total, slots))
        made += 1
    _, _, total, slots = heap[0]
    subset = np.full(len(left), -1, np.int64)
    subset[slots] = np.arange(k)
    for slot in range(free - 1, n * k - 1, -1):
        subset[left[slot]] = subset[right[slot]] = subset[slot]
    return subset[: n * k].reshape(n, k), np.array(total, np.int64)


def divided(groups: DataFrame, base: np.ndarray, cell_groups: int) -> tuple[DataFrame, np.ndarray]:
    """((digest, size, shard) of groups, the shards' sums with ``base``, what they hold already).

    Large groups come first, by the same rule among themselves.  Then come the cells but the last, each
    from its part of what the shards hold, and at last the last cell from all that they hold by then,
    so that it evens out what the others have left.  Only the shards' sums come to the driver.
    """
    k = len(base)
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells = max(1, -(-count // cell_groups))

    def partial(start: np.ndarray, rest: int | None):
        start = start - start.min()

        def run(batch: pa.Table) -> pa.Table:
            batch = batch.sort_by([("size", "descending"), ("digest", "ascending")])
            size = batch["size"].to_numpy()
            sums = np.zeros((batch.num_rows + 1, k), np.int64)
            # shards that hold the same take turns, so that cells don't all leave the same ones ahead
            turn = np.random.default_rng(batch["cell"][0].as_py()).permutation(k)
            sums[0] = np.rint(start[turn] * (1.0 if rest is None else float(size.sum()) / rest))
            sums[1:, 0] = size
            place, _ = difference(sums, k)
            tied = turn[np.argsort(place[0])]  # the subset of the j-th first sum is shard turn[j]
            return pa.table({"digest": batch["digest"], "size": batch["size"], "shard": pa.array(tied[place[1:, 0]], pa.int32())})

        return run

    kind = "digest binary, size long, shard int"

    def placed(some: DataFrame, start: np.ndarray, rest: int | None) -> tuple[DataFrame, np.ndarray]:
        out = cut(some.groupBy("cell").applyInArrow(partial(start, rest), kind), "shard-parts")
        sums = start.copy()
        for r in out.groupBy("shard").agg(F.sum("size").alias("size")).collect():
            sums[r["shard"]] += r["size"]
        return out, sums

    dealt = groups.withColumn("cell", (F.pmod(F.xxhash64("digest"), F.lit(cells)) if cells > 1 else F.lit(0)).cast("int"))
    if cells == 1:
        return placed(dealt, base, None)
    large = F.col("size") * (k * cells) > total
    first, held, rest = None, base, total
    if not groups.where(large).isEmpty():
        first, held = divided(groups.where(large), base, cell_groups)
        rest = max(1, total - int(held.sum() - base.sum()))
    most, held = placed(dealt.where(~large & (F.col("cell") > 0)), held, rest)
    last, held = placed(dealt.where(~large & (F.col("cell") == 0)), held, None)
    out = most.unionByName(last)
    return (out.unionByName(first) if first is not None else out), held


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", cell_groups: int = CELL_GROUPS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``.

    size: UTF-8 bytes of the text plus 1; a null text has size 1, no CRC and forms one group with the
    other null texts, apart from empty ones.  The law is ``bytes``: rows with equal texts share a
    shard, and the shards' bytes are as near equal as differencing gets them (a group larger than an
    even share can't be evened out, as it is never divided).  slot counts the rows of a shard from 0
    without gaps, by hash of the key; repeated rows get neighbouring slots.  grown_shard is null, as
    growing is a feature of the ``key`` law.  No rows: an empty frame.  Other columns aren't read.
    """
    rows = cut(
        docs.select(
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            # no digest is empty, so that is the null texts'
            F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"")).alias("digest"),
        ),
        "shard-rows",
    )
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    where = divided(groups, np.zeros(shards, np.int64), cell_groups)[0].select("digest", "shard").join(groups.select("digest", "n"), "digest")
    total = groups.agg(F.sum("n")).first()[0] or 0

    # equal rows are one with a count, so that neither a key nor a text puts many into one task
    same = joined(rows, where, "digest", total).groupBy("key", "text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    # counts of (shard, run) give each run its first slot, so no shard is numbered in one task
    run = F.pmod(F.xxhash64("key", "text_crc32"), F.lit(8 * max(1, -(-total // RUN_ROWS)))).cast("int")
    out = cut(same.withColumn("run", run), "shard-out")
    before = Window.partitionBy("shard").orderBy("run")
    first = out.groupBy("shard", "run").agg(F.sum("n").alias("n")).select("shard", "run", (F.sum("n").over(before) - F.col("n")).alias("first"))
    inside = Window.partitionBy("shard", "run").orderBy("key", "text_crc32", "size")
    placed = out.withColumn("at", F.sum("n").over(inside) - F.col("n")).join(first, ["shard", "run"])
    return repeated(placed, "n", "nth").select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("at") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
