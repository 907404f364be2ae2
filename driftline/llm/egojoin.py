"""Embedding near-duplicates by an epsilon grid order join.

Vectors of length 1 are at most epsilon apart when their cosine reaches the threshold.  They are
projected on their leading principal directions and put in grid order: by label, then by the grid
cells of side epsilon in these directions, the first one first.  Stretches of the order are blocks.
Blocks of one label meet if their cells come within one of each other in every direction, which a
projection can't hide.  A pair of blocks is joined by halving both intervals again and again,
skipping halves that are provably further apart than epsilon, down to small products in double
precision.  A pair of blocks returns each vector's number of links and a spanning forest of them,
never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Forest, components, cut

#: Leading principal directions of the grid.
DIRECTIONS = 4
#: Vectors of a block.
BLOCK = 2048
#: Intervals of so few vectors are multiplied out.
LEAF = 256
#: Cosines this near to the threshold are computed once more, with exactly rounded sums.
NEAR = 1e-9


def directions(vectors: DataFrame, k: int = DIRECTIONS) -> np.ndarray:
    """(k, dim) leading principal directions of all vectors, from moments summed in two steps."""

    def moments(batches):
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            x = unit(matrix(batch.column("v")))
            n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([np.concatenate([first, second.ravel()]).tobytes()], pa.binary())})

    def added(batches):
        n, m = 0, 0.0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            m = m + sum(np.frombuffer(b, np.float64) for b in batch.column("m").to_pylist())
        if n:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64()), "m": pa.array([m.tobytes()], pa.binary())})

    kind = "slot int, n long, m binary"
    got = vectors.mapInArrow(moments, kind).repartition(8).mapInArrow(added, kind).collect()
    if not got:
        return np.zeros((k, 0))
    n, m = sum(r["n"] for r in got), sum(np.frombuffer(r["m"], np.float64) for r in got)
    dim = int((np.sqrt(4 * len(m) + 1) - 1) / 2)
    mean = m[:dim] / n
    _, axes = np.linalg.eigh(m[dim:].reshape(dim, dim) / n - np.outer(mean, mean))
    out = axes[:, ::-1][:, :k].T
    return np.round(out, 12)


def matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.float64).reshape(len(blobs), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    from math import fsum, sqrt

    return fsum(a * b) / (sqrt(fsum(a * a)) * sqrt(fsum(b * b)))


def join_blocks(a: dict, b: dict, threshold: float, eps: float) -> tuple[np.ndarray, np.ndarray, Forest]:
    """(links of a's rows, links of b's rows, forest) between two blocks, or within one if they are the same object."""
    same = a is b
    na, nb = np.zeros(len(a["id"]), np.int64), np.zeros(len(b["id"]), np.int64)
    if same:
        nb = na
    forest = Forest()

    def far(i, j, p, q) -> bool:
        """No point of the one stretch is within epsilon of any of the other, by their boxes."""
        x, y = a["at"][i:j], b["at"][p:q]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        return float(gap @ gap) > eps * eps

    def go(i, j, p, q):
        if far(i, j, p, q):
            return
        if j - i <= LEAF and q - p <= LEAF:
            cos = a["unit"][i:j] @ b["unit"][p:q].T
            if same and i == p:
                np.fill_diagonal(cos, -2)
            for r, c in zip(*np.nonzero(np.abs(cos - threshold) < NEAR), strict=True):
                cos[r, c] = exact_cosine(a["raw"][i + r], b["raw"][p + c])
            hit = cos >= threshold
            if not hit.any():
                return
            na[i:j] += hit.sum(1)
            if not (same and i == p):
                nb[p:q] += hit.sum(0)
            linked(hit, i, p)
        elif same and (i, j) == (p, q):
            m = (i + j) // 2
            go(i, m, i, m)
            go(m, j, m, j)
            go(i, m, m, j)
        elif j - i >= q - p:
            m = (i + j) // 2
            go(i, m, p, q)
            go(m, j, p, q)
        else:
            m = (p + q) // 2
            go(i, j, p, m)
            go(i, j, m, q)

    def linked(hit, i, p):
        """Each component of a small product, found by widening from its first row, becomes a star."""
        left = hit.any(1)
        while left.any():
            rows = np.zeros(len(left), bool)
            rows[left.argmax()] = True
            while True:
                cols = hit[rows].any(0)
                wider = hit[:, cols].any(1)
                if (wider == rows).all():
                    break
                rows = wider
            left &= ~rows
            ids = np.concatenate([a["id"][i + np.flatnonzero(rows)], b["id"][p + np.flatnonzero(cols)]]).tolist()
            for x in ids[1:]:
                forest.join(ids[0], x)

    go(0, len(na), 0, len(nb))
    return na, nb, forest


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, k: int = DIRECTIONS,
) -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``vectors``.

    Rows of the same non-null label are linked when the cosine of their vectors, in double precision,
    is at least ``threshold`` (which must be positive).  n_links counts the other rows linked directly;
    component_id is the smallest key that links reach, the row's own included; kept: key is
    component_id.  Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do rows with a null label or key; vectors of different lengths aren't linked.
    Repeated rows each count as a row, linked with their copies; all rows of a key share a component.
    No rows: an empty frame.  Other columns aren't read.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    eps = float(np.sqrt(2 - 2 * threshold)) * (1 + 1e-9)
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("tag", F.xxhash64("label", "v"))
    able = rows.where(good & F.col("label").isNotNull() & F.col("key").isNotNull())

    def packed(batches):
        for batch in batches:
            v = batch.column("v")
            off, flat = v.offsets.to_numpy(), v.values.to_numpy()
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "tag": batch.column("tag"), "label": batch.column("label"), "dim": pa.array(np.diff(off), pa.int32()), "v": pa.array([flat[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)], pa.binary())})

    flat = able.mapInArrow(packed, "key long, tag long, label string, dim int, v binary")
    # several dimensions would need several grids; each is a label of its own, and the directions pad with zeros
    dims = sorted(r["dim"] for r in flat.select("dim").distinct().collect())
    axes = {d: directions(flat.where(F.col("dim") == d), k) for d in dims}

    def placed(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            cell = np.zeros((len(dim), k), np.int64)
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                x = unit(matrix(batch.column("v").take(pa.array(own))))
                at = x @ axes[int(d)].T
                cell[own, : at.shape[1]] = np.floor(at / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, c]) for c in range(k))], names=[*batch.schema.names, *(f"c{c}" for c in range(k))])

    order = ["label", "dim", *(f"c{c}" for c in range(k)), "key", "tag"]
    grid = flat.mapInArrow(placed, "key long, tag long, label string, dim int, v binary, " + ", ".join(f"c{c} long" for c in range(k)))
    kind = "id string, label string, dim int, n int, " + ", ".join(f"lo{c} long, hi{c} long" for c in range(k)) + ", keys binary, v binary"

    def blocks(batches):
        """Stretches of one label of at most ``block`` rows, in grid order."""
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None

        def close(t: pa.Table):
            nonlocal number
            number += 1
            row = {"id": [f"{part}-{number}"], "label": [t["label"][0].as_py()], "dim": [t["dim"][0].as_py()], "n": [t.num_rows]}
            for c in range(k):
                cells = t[f"c{c}"].to_numpy()
                row |= {f"lo{c}": [int(cells.min())], f"hi{c}": [int(cells.max())]}
            row |= {"keys": [np.stack([t["key"].to_numpy(), t["tag"].to_numpy()]).tobytes()], "v": [b"".join(t["v"].to_pylist())]}
            return pa.RecordBatch.from_pydict(row, schema=shape)

        shape = pa.schema([("id", pa.string()), ("label", pa.string()), ("dim", pa.int32()), ("n", pa.int32())] + [(f"{e}{c}", pa.int64()) for c in range(k) for e in ("lo", "hi")] + [("keys", pa.binary()), ("v", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held is not None and held.num_rows:
                tag = np.array(held["label"].to_pylist(), object)
                d = held["dim"].to_numpy()
                change = np.flatnonzero((tag[1:] != tag[:-1]) | (d[1:] != d[:-1]))
                n = min(block, int(change[0]) + 1 if len(change) else held.num_rows)
                if n == held.num_rows and n < block:
                    break
                yield close(held.slice(0, n))
                held = held.slice(n)
        if held is not None and held.num_rows:
            yield close(held)

    made = cut(grid.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, kind), "ego-blocks")

    # intervals of the order meet when their cells do, in the first direction by equal cells
    narrow = made.drop("keys", "v")
    a = narrow.select(*[F.col(c).alias(f"a_{c}") for c in narrow.columns], F.explode(F.sequence(F.col("lo0") - 1, F.col("hi0") + 1)).alias("strip"))
    b = narrow.select(*[F.col(c).alias(f"b_{c}") for c in narrow.columns], F.explode(F.sequence("lo0", "hi0")).alias("strip"))
    meet = (F.col("a_label") == F.col("b_label")) & (F.col("a_dim") == F.col("b_dim")) & (a["strip"] == b["strip"]) & (F.col("a_id") <= F.col("b_id"))
    for c in range(1, k):
        meet &= (F.col(f"a_lo{c}") <= F.col(f"b_hi{c}") + 1) & (F.col(f"b_lo{c}") <= F.col(f"a_hi{c}") + 1)
    pairs = a.join(b, meet).select("a_id", "b_id").distinct()
    one = made.select("id", "dim", "keys", "v")
    left = one.select(F.col("id").alias("a_id"), F.col("dim"), F.col("keys").alias("ka"), F.col("v").alias("va"))
    right = one.select(F.col("id").alias("b_id"), F.col("keys").alias("kb"), F.col("v").alias("vb"))
    work = pairs.join(left, "a_id").join(right, "b_id").select("a_id", "b_id", "dim", "ka", "va", "kb", "vb")

    def joined(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                g = {c: batch.column(c)[r].as_py() for c in batch.schema.names}

                def load(keys, v, d=g["dim"]):
                    raw = np.frombuffer(v, np.float64).reshape(-1, d)
                    u = unit(raw)
                    ids, tags = np.frombuffer(keys, np.int64).reshape(2, -1)
                    return {"id": ids, "tag": tags, "raw": raw, "unit": u, "at": u @ axes[d].T}

                x = load(g["ka"], g["va"])
                y = x if g["a_id"] == g["b_id"] else load(g["kb"], g["vb"])
                na, nb, forest = join_blocks(x, y, threshold, eps)
                sides = [(x, na)] if x is y else [(x, na), (y, nb)]
                ids, tags, n = (np.concatenate(z) for z in zip(*[(q["id"], q["tag"], m) for q, m in sides], strict=True))
                hit = np.flatnonzero(n)
                if len(hit):
                    yield pa.RecordBatch.from_pydict({"key": pa.array(ids[hit]), "tag": pa.array(tags[hit]), "n": pa.array(n[hit]), "root": pa.array([forest.root(int(i)) for i in ids[hit]], pa.int64())})

    found = cut(work.mapInArrow(joined, "key long, tag long, n long, root long"), "ego-links")
    comp = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    copies = able.groupBy("key", "tag").agg(F.count("*").alias("copies"))
    links = found.groupBy("key", "tag").agg(F.sum("n").alias("n")).join(copies, ["key", "tag"]).select("key", "tag", (F.col("n") / F.col("copies")).cast("long").alias("n"))
    out = rows.select("key", "tag").join(links, ["key", "tag"], "left").join(comp.withColumnRenamed("node", "key"), "key", "left")
    return out.select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("component_id"),
        F.coalesce("component", "key").eqNullSafe(F.col("key")).alias("kept"),
    )
