"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a parquet table instead of keeping
blocks on executors: a lost executor then costs a re-read, not a recomputation. The
folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests on one
machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_counter = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only if there is none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sievemark-")
    atexit.register(shutil.rmtree, made, True)
    context.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def parts_for(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Tasks for so many rows of a shuffle: each reads about what the session calls a good partition, and no core is idle."""
    said = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    good = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said)
    return max(spark.sparkContext.defaultParallelism, min(200_000, -(-rows * row_bytes // max(1 << 20, good))))


class Workspace:
    """Tables of one operator run, written to the shared folder.

    ``keep`` writes a frame and returns a frame that reads it back; ``drop`` deletes a
    table that no later step reads. What remains is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def keep(self, frame: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{next(_counter):05d}-{label}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._kept_at = path
        return back

    def drop(self, frame: DataFrame | None) -> None:
        """Deletes the table behind a frame that ``keep`` returned; other frames have none."""
        path = None if frame is None else frame.__dict__.pop("_kept_at", None)
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Deletes what is left, on whatever file system the shared folder is."""
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; a local folder can still be removed
            local = self.root.removeprefix("file:")
            if local.startswith("/"):
                shutil.rmtree("/" + local.lstrip("/"), ignore_errors=True)
