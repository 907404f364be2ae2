"""What the jobs share: configuration files, logging, the command line's session."""

from __future__ import annotations

import contextlib
import json
import logging
import sys
from collections.abc import Iterator
from dataclasses import fields
from typing import Any

from pyspark import SparkConf
from pyspark.sql import SparkSession

from driftline.session import build_session

log = logging.getLogger("driftline.jobs")


def configured(kind: type, raw: dict[str, Any]) -> Any:
    """A job's configuration from JSON; a key that the job doesn't have is an error."""
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(raw) - known):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**raw)


def read_config(spark: SparkSession, kind: type, path: str | None) -> Any:
    """The configuration file at ``path``, which may be remote; without one all is as the job has it."""
    if path is None:
        return kind()
    return configured(kind, json.loads(spark.read.text(path, wholetext=True).first()[0]))


@contextlib.contextmanager
def session(name: str) -> Iterator[SparkSession]:
    """The command line's session, as a launcher configures it or else local; it ends with the block."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    launched = SparkConf().get("spark.master", "")
    spark = SparkSession.builder.appName(name).getOrCreate() if launched else build_session()
    try:
        yield spark
    finally:
        spark.stop()
