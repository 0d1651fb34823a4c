"""Session helpers: lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts, as named by ``spark.checkpoint.dir``.

    Only a local-mode session that names none (tests) gets a folder of its own: a machine-local
    path would not be readable by the other executors of a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="voxfield-")
    return _LOCAL_DIR[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, and carries true file sizes, so the
    planner's own broadcast decision is a checked one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(*cuts: DataFrame) -> None:
    """Delete the folders behind results of ``cut`` that nothing reads any more."""
    for df in cuts:
        path = getattr(df, "_cut_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def spread(df: DataFrame) -> DataFrame:
    """Rebalance an input that comes in fewer files than there are cores, before rows multiply.

    Large tables have more files than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df
