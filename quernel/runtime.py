"""Session-level helpers shared by every operator: shipping code, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as text) that a side may have to be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python operators import it there whatever their path is."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quernel-"), "quernel_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs in one process.

    What this application leaves there goes when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is None and held.isDefined():
        found = held.get()
    if found is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("no shared folder for intermediate tables: set spark.checkpoint.dir to one that all executors reach")
        found = tempfile.mkdtemp(prefix="quernel-checkpoint-")
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(found)
        _delete_at_exit(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return found


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan has fewer parts than the session has cores, else as it is."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, on the shared checkpoint folder, and go on from there. Survives lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")  # the shuffle files behind a finished checkpoint are of no more use
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


class Stored:
    """A table in the shared checkpoint folder, kept as Parquet until drop() or the end of the driver."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/quernel/{name}-{uuid.uuid4().hex}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(key, before)
        _delete_at_exit(self.spark, self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and BROADCAST_BYTES, both measured here, else as it is."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
