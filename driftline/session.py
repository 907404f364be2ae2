"""Sessions, and the package's own code on executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; an own one only where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="driftline-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def intermediate_path(spark: SparkSession, name: str) -> str:
    """A :func:`fresh_path` for what is no result; see :func:`intermediates`."""
    _MADE.append(path := fresh_path(spark, name))
    return path


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Remove what is cut in the block as it ends; frames that are read from it must be done with by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in _MADE[before:]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        del _MADE[before:]


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """The session with other settings (dots written as two underscores) until the block ends."""
    before = {}
    try:
        for k, v in wanted.items():
            key = k.replace("__", ".")
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, v)
        yield
    finally:
        for key, v in before.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def state_on_disk(spark: SparkSession) -> dict[str, str]:
    """:func:`settings` of streams whose keyed state grows: on disk, in no more parts than keep all cores busy, as each part is a store of its own."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return {
        "spark__sql__streaming__stateStore__providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark__sql__shuffle__partitions": str(parts),
    }


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy ends the lineage, is computed once however often it is read, and outlives any
    executor.  Unlike a cached or locally checkpointed frame it cannot be half lost.
    """
    spark = df.sparkSession
    path = intermediate_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def build_session(master: str = "local[*]", parts: int = 8, memory: str = "4g") -> SparkSession:
    """A session with adaptive execution, UTC and as many shuffle partitions as asked for."""
    return (
        SparkSession.builder.master(master).appName("driftline")
        .config("spark.sql.shuffle.partitions", str(parts)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory).getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Have this package on every executor, once for each application."""
    sc = spark.sparkContext
    mark = f"{sc.applicationId} {sc.startTime}"  # local applications share an id
    if mark not in _SHIPPED:
        _SHIPPED.add(mark)
        here = Path(__file__).resolve().parent
        d = tempfile.mkdtemp(prefix="driftline-pack-")  # the driver's file server reads it as long as the application lives
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        shutil.copytree(here, f"{d}/pack/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{d}/driftline_{sc.startTime}", "zip", f"{d}/pack"))
    return spark
