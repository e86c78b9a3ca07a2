"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

import ternweave


#: Bytes of an Arrow batch, in place of Spark's default: a task and its Python worker hold some batches each.
ARROW_BYTES = 16 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors (once per application), and bound Arrow batches unless the session has a bound of its own."""
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == f"{64 << 20}b":
        spark.conf.set(size, ARROW_BYTES)
    if getattr(sc, "_ternweave_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(ternweave.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ternweave-"), "ternweave.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("ternweave", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._ternweave_shipped = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``.  Where it is unset, a temporary one on a local
    master; on a cluster that is an error, for executors don't share local folders."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
