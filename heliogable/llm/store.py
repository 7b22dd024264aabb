"""The shared folder of a run: intermediate tables, and files that tasks write.

Executors and the driver share no local disk, so everything that a later task
reads goes below ``spark.checkpoint.dir``.  The setting is read from the
session; a folder of our own is set only where it is unset (tests).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import IO
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one call of an operator, below the shared one."""
    base = spark.conf.get(KEY, None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="heliogable-")
        spark.conf.set(KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and go on from the copy: what follows has no longer a lineage than a scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextlib.contextmanager
def create(uri: str) -> Iterator[IO[bytes]]:
    """A new file that appears under its name only when it is whole, so that a repeated task does no harm."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as out:
                yield out
            os.replace(part, path)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(part)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, at)


@contextlib.contextmanager
def opened(uri: str) -> Iterator[IO[bytes]]:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as source:
            yield source
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_file(at) as source:
        yield source
