"""Stand-ins for models: zero-argument factories, so that workers make their own clients.

Real clients go in the same places: a factory that gives a callable.
"""

from __future__ import annotations

import hashlib
import inspect
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_factory(x) -> Callable:
    """A class or a function without parameters is a factory; anything else is a client that each worker gets a copy of."""
    if inspect.isclass(x):
        return x
    if inspect.isfunction(x) and not inspect.signature(x).parameters:
        return x
    return lambda: x


#: Calls that a task has under way at a time.
IN_FLIGHT = 4


class Pace:
    """At most ``per_second`` starts a second, over all threads of a task; none without a rate."""

    def __init__(self, per_second: float | None) -> None:
        self.gap, self.next, self.lock = (1.0 / per_second if per_second else 0.0), 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - now))


def in_flight(call: Callable, items: Iterable, workers: int = IN_FLIGHT, per_second: float | None = None) -> Iterator:
    """``call`` of each item, in the items' order, with up to ``workers`` calls under way and as many results waiting.

    What waits is bounded, however many items there are.  A call that raises ends the iteration where
    its result would come; calls that haven't begun by then are not made.
    """
    pace, waiting = Pace(per_second), deque()

    def paced(item):
        pace.wait()
        return call(item)

    with ThreadPoolExecutor(workers) as pool:
        try:
            for item in items:
                waiting.append(pool.submit(paced, item))
                if len(waiting) >= 2 * workers:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for f in waiting:
                f.cancel()


def stub_prompter() -> Callable[[str, str, str], str]:
    return lambda document, instruction, model: f"Write about: {' '.join(document.split()[:8])}"


def stub_drafter() -> Callable[[str, float, float, int], str]:
    return lambda prompt, temperature, top_p, seed: f"{prompt} [draft {seed % 1000}]"


def stub_rewriter() -> Callable[[str, int], str]:
    return lambda text, k: f"{text} [r{k}]"


def stub_judge() -> Callable[[str, str], str]:
    return lambda prompt, model: "A" if hashlib.md5(prompt.encode()).digest()[0] < 128 else "B"  # noqa: S324


def stub_detector() -> Callable[[str], float]:
    return lambda text: int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") / 2**32  # noqa: S324


def stub_embedding(text: str | Column = "text", dim: int = 8) -> Column:
    """A vector in [0, 1) from a text's hash, 16 bits a component."""
    h = F.md5((F.col(text) if isinstance(text, str) else text).cast("binary"))
    return F.array(*[F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("double") / 65536.0 for k in range(dim)])


def embedded(texts: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 8) -> DataFrame:
    """(content_sha256, vector) of (content_sha256, text), in batches; vectors that aren't finite rows of one length are an error."""

    def run(frames):
        client, dim = factory(), None
        for pdf in frames:
            parts = []
            for lo in range(0, len(pdf), batch):
                v = np.asarray(client(pdf["text"].iloc[lo : lo + batch].tolist()), np.float32)
                if v.ndim != 2 or not np.isfinite(v).all() or (dim is not None and v.shape[1] != dim) or len(v) != len(pdf.iloc[lo : lo + batch]):
                    raise ValueError("an embedder must give one finite vector of one length for each text")
                dim = v.shape[1]
                parts += v.tolist()
            yield pdf[["content_sha256"]].assign(vector=parts)

    return texts.select("content_sha256", "text").mapInPandas(run, T.StructType([T.StructField("content_sha256", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))]))


def stub_embedder() -> Callable[[list[str]], np.ndarray]:
    return lambda texts: np.array([np.frombuffer(hashlib.md5(t.encode()).digest(), ">u2") / 65536 for t in texts], np.float32)  # noqa: S324


def no_embedder() -> Callable[[list[str]], np.ndarray]:
    """For runs that must find everything in the cache."""

    def refuse(texts: list[str]) -> np.ndarray:
        raise RuntimeError(f"{len(texts)} texts are not in the cache")

    return refuse


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the tokens' vectors that the mask keeps."""
    m = mask[:, :, None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)
