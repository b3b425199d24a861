"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Folder of written tables by application and shared folder.
_ROOTS: dict[tuple[str, str], str] = {}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the engine is written for to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


#: Bytecode of a method up to which the JVM compiles it; longer ones stay interpreted.
JIT_LIMIT = 8000


def compiled_methods(spark: SparkSession) -> None:
    """Keep Spark from fusing a stage into a method that the JVM won't compile.

    Spark's default admits methods of 65,535 bytes; parsing fills such ones, which then run
    interpreted, several times slower than the same expressions in methods of their own.  A limit
    that the session states itself is left alone.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) == 65_535:
        spark.conf.set(name, JIT_LIMIT)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a cluster
    executors would not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallybook-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table.

    All tables of one application lie in one folder, which the file system removes when
    the driver ends.
    """
    context = spark.sparkContext
    key = (context.applicationId, shared_dir(spark))
    if key not in _ROOTS:
        root = f"{key[1]}/tables/{key[0]}-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[key] = root
    return f"{_ROOTS[key]}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, cutting its lineage.

    Later branches then see one fixed set of rows, also after an executor is lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "part")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` (short) rows.

    Made for tables whose size Spark cannot know in advance, such as planned
    questions.  Counting stops after ``max_rows``; a larger table joins by shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
