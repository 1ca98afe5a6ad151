"""Scratch tables and files that every executor and the driver can read.

Lineage is cut by writing a table below ``spark.checkpoint.dir``, read from the
session. Where the setting is absent, a session that runs in this process alone
(master local) gets a folder under /tmp; on a cluster that is an error. What is
written goes with ``drop``, ``keep`` or ``remove``, or at the latest when the
driver process ends.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import time
import uuid

from py4j.protocol import Py4JError
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints/condensa"


def shared_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as a URI."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs(LOCAL_FALLBACK, exist_ok=True)
        root = "file://" + LOCAL_FALLBACK
    return root if re.match(r"[a-z][a-z0-9+.-]*:", root) else "file://" + os.path.abspath(root)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI, and the path inside it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class Scratch:
    """A folder of its own below the shared root, for one call of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.uri = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        atexit.register(self.remove)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back: the plan above starts from the files."""
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def folder(self, name: str) -> str:
        handle, path = filesystem(self.path(name))
        handle.create_dir(path, recursive=True)
        return self.path(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        self._delete(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all other tables: what reads them must have been written."""
        for name in self.names - set(names):
            self.drop(name)

    def _delete(self, uri: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark drop the shuffle files of finished jobs now rather than at the driver's next garbage collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self) -> None:
        atexit.unregister(self.remove)
        try:
            self._delete(self.uri)
        except (OSError, AttributeError, TypeError, Py4JError):
            pass  # the session has ended; its shared folder goes with the cluster's


def read_with_retries(action, attempts: int = 3, pause: float = 0.2):
    """Run a read of one member again on I/O errors; the last error is raised."""
    for attempt in range(attempts):
        try:
            return action()
        except (OSError, EOFError):
            if attempt + 1 == attempts:
                raise
            time.sleep(pause * (attempt + 1))
