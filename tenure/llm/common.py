"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tenure.session import checkpoint_dir, cut_lineage

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from that copy."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, as a URI."""
    d = checkpoint_dir(spark)
    if not d:  # a local folder would be another one on every machine
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if "://" not in d and not d.startswith("file:"):
        d = "file://" + os.path.abspath(d)
    return f"{d.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow filesystem, path on it) of a URI, usable on driver and executors."""
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Bytes of an Arrow batch handed to Python, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` unchanged; its session's Arrow batches are limited to BATCH_BYTES if they have no limit.

    Spark counts rows only by default: ten thousand long texts would be one
    batch.  With the limit a Python worker's memory doesn't depend on how long
    the texts are (one text is never divided).
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df
