"""Language identification with hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1.  An n-gram is bound from its letters' vectors, each
rotated by its place and multiplied; a text bundles (adds up) its n-grams; a language bundles its
training texts.  A text belongs to the language whose prototype has the largest cosine with it.
Bundles are linear, so a batch of texts is one product of a count matrix with the n-gram vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import trimmed

#: Dimensions of a vector.
DIM = 1024
GRAM = 3
#: Letters other than a-z share so many vectors, chosen by code point.
OTHER = 229
#: Languages at most: each has a prototype that every task holds.
LABELS = 4096
SEED = 5
UNKNOWN = "und"
#: Sums of directions are whole multiples of 1 / GRAIN, so they are the same in whatever order tasks are added up.
GRAIN = float(1 << 32)
#: n-grams whose vectors a worker keeps; others are bound anew in each batch.
KEPT_GRAMS = 8_000


@lru_cache(maxsize=1)
def slots() -> np.ndarray:
    """Slot of each code point: 0 for what is no letter, 1-26 for a-z, one of OTHER for the rest."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = c - 96 if "a" <= ch <= "z" else 27 + c % OTHER
    return out


@lru_cache(maxsize=2)
def letters(dim: int, seed: int) -> np.ndarray:
    """(place, slot, dim): each slot's vector, rotated by its place in the n-gram."""
    base = np.random.default_rng(seed).integers(0, 2, (27 + OTHER, dim)).astype(np.int8) * 2 - 1
    return np.stack([np.roll(base, k, axis=1) for k in range(GRAM)])


@dataclass
class Profiler:
    """Turns texts into bundles; keeps the vectors of n-grams it has met."""

    dim: int = DIM
    seed: int = SEED
    rows: dict[int, int] = field(default_factory=dict)
    kept: np.ndarray | None = None

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        table, s = letters(self.dim, self.seed), 27 + OTHER
        return (table[0][grams // (s * s)] * table[1][grams // s % s] * table[2][grams % s]).astype(np.float32)

    def remembered(self, grams: np.ndarray) -> np.ndarray:
        """As :meth:`vectors`, out of memory where possible."""
        if self.kept is None:
            self.kept = np.zeros((KEPT_GRAMS, self.dim), np.float32)
        at = np.fromiter((self.rows.get(g, -1) for g in grams.tolist()), np.int64, len(grams))
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out = np.empty((len(grams), self.dim), np.float32)
        out[old] = self.kept[at[old]]
        if len(new):
            out[new] = self.vectors(grams[new])
            have = len(self.rows)
            take = new[: KEPT_GRAMS - have]
            self.kept[have : have + len(take)] = out[take]
            self.rows.update({g: have + k for k, g in enumerate(grams[take].tolist())})
        return out

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, counts) of a text's lower-cased words, with one boundary between words and at either end."""
        low = text.lower()
        x = slots()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        keep = (x > 0) | np.concatenate([[True], x[:-1] > 0])
        x = np.concatenate([[0], x[keep], [0]])
        if not x.any():
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        s = 27 + OTHER
        g = x[:-2] * (s * s) + x[1:-1] * s + x[2:]
        return np.unique(g[x[1:-1] > 0], return_counts=True)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """One row a text; zero for a text without letters."""
        parts = [self.grams(t) if t else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for t in texts]
        own = np.unique(np.concatenate([g for g, _ in parts])) if parts else np.zeros(0, np.int32)
        out = np.zeros((len(texts), self.dim), np.float32)
        step = 4096
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            counts = np.zeros((len(texts), len(some)), np.float32)
            for k, (g, n) in enumerate(parts):
                a, b = np.searchsorted(g, [some[0], some[-1] + 1])
                counts[k, np.searchsorted(some, g[a:b])] = n[a:b]
            out += counts @ self.remembered(some)
        return out


def training_rows(docs: DataFrame, key: str, text: str, lang: str, rows: int | None, seed: int) -> DataFrame:
    """(lang, text): of each language all labelled rows, or, if a caller says so, about ``rows`` of them by hash of key and text."""
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    have = labelled.groupBy("lang").count().limit(LABELS + 1).collect()
    if len(have) > LABELS:
        raise ValueError(f"more than {LABELS} languages")
    if not have or rows is None:
        return labelled.select("lang", "text")
    share = F.create_map(*[F.lit(x) for r in have for x in (r["lang"], min(1.0, rows / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < share[F.col("lang")]).select("lang", "text")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int | None = None, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes of length 1) from all rows with a text and a label.

    Texts stay where they are; each task adds up its own, and what comes to the driver is one vector a
    language.  With ``rows`` a language that has more labelled rows is trained on about so many, chosen
    by hash of key and text, so null keys do no harm and repeated rows are chosen together.  Texts
    without letters teach nothing.  No labelled rows: no languages; more than LABELS languages are an error.
    """
    chosen = training_rows(docs, key, text, lang, rows, seed)

    def run(batches):
        prof, sums = Profiler(dim, seed), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for k, v in zip(part.column(0).to_pylist(), prof.bundles(part.column(1).to_pylist()), strict=True):
                    norm = float(np.linalg.norm(v))
                    if norm:
                        sums[k] = sums.get(k, 0) + v.astype(np.float64) / norm
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([np.rint(x * GRAIN).astype(np.int64).tobytes() for x in sums.values()], pa.binary())})

    def add(own: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.int64) for x in own.column("v").to_pylist())
        return pa.table({"lang": own.column("lang")[:1], "v": pa.array([v.tobytes()], pa.binary())})

    kind = "lang string, v binary"
    found = chosen.mapInArrow(lambda batches: trimmed(run(batches)), kind).groupBy("lang").applyInArrow(add, kind).collect()
    total = {r["lang"]: np.frombuffer(r["v"], np.int64) / GRAIN for r in found}
    names = sorted(total)
    made = np.stack([total[k] / np.linalg.norm(total[k]) for k in names]) if names else np.zeros((0, dim))
    return names, np.round(made, 7).astype(np.float32)


#: Labelled texts that a class of lengths needs for a limit of its own, and deviations below the mean that the limit lies.
LEAST_ROWS, DEVIATIONS = 30, 5.0


def size_class(text: Column) -> Column:
    """Class of a text's length in code points: its logarithm to base 2, rounded down."""
    return F.floor(F.log2(F.greatest(F.char_length(text), F.lit(1)))).cast("int")


def limits(docs: DataFrame, names: list[str], prototypes: np.ndarray, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int | None = None, dim: int = DIM, seed: int = SEED) -> list[float]:
    """The least score of each class of lengths that is no surprise in a learned language; one row a class comes to the driver.

    The scores of all rows that :func:`train` reads, by their lengths: DEVIATIONS standard deviations
    below their mean, and 0 where that is negative.  A class with too few rows takes the limit of the next
    shorter one that has enough, and 0 if there is none.  No rows: no limits.
    """
    scores = predict(training_rows(docs, key, text, lang, rows, seed).select("text"), names, prototypes, "text", dim, seed)
    found = scores.where(F.col("lang_pred") != UNKNOWN).groupBy(size_class(F.col("text")).alias("c")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd")).collect()
    by = {r["c"]: max(0.0, r["mean"] - DEVIATIONS * r["sd"]) for r in found if r["n"] >= LEAST_ROWS}
    out: list[float] = []
    for c in range(32):
        out.append(by.get(c, out[-1] if out else 0.0))
    return out if found else []


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text", dim: int = DIM, seed: int = SEED, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with ``pred`` and ``score``, both from the whole text alone.

    score is the cosine with the nearest prototype, 0 where that is negative.  A text that is null or
    has no letter gets ``und`` and 0; so does every text if there is no prototype.  Ties go to the
    language first in order.  Columns of the same names are replaced; other columns and all rows stay.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = [c for c in docs.columns if c not in (pred, score)]
    rows = docs.select(*kept)
    schema = StructType([*rows.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])

    def run(batches):
        prof = Profiler(dim, seed)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                h = prof.bundles(part.column(text).to_pylist())
                norm = np.linalg.norm(h, axis=1)
                cos = (h @ prototypes.T) / np.maximum(norm, 1e-9)[:, None] if len(names) else np.zeros((len(h), 1))
                best = cos.argmax(1)
                known = (norm > 0) & bool(names)
                values = np.where(known, np.clip(cos.max(1), 0, 1), 0).astype(np.float64)
                labels = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(np.round(values, 6))], names=[*part.schema.names, pred, score])

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), schema)
