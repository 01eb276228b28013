"""Where intermediate tables go, and how a reused table is kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is named and driver and
    executors are one process, a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytecodes of a method beyond which the JVM (HotSpot) interprets it for good.
COMPILED_METHOD = 8000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Let plans whose generated method the JVM would not compile run as many small
    methods instead; a lower limit that the session has stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > COMPILED_METHOD:
        spark.conf.set(name, str(COMPILED_METHOD))


def allow_checkpoints(spark: SparkSession) -> None:
    """Let fits of many rounds cut their lineage in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{shared_folder(spark).rstrip('/')}/{context.applicationId}/rounds")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below the application's own name, so
    that all of a run's tables can be cleared at once."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from the files, so that a
    lost executor costs a file read instead of the whole plan before it."""
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
