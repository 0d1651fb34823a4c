"""Byte-range reading of single large files, so that no file passes through one task.

Files and their lengths are listed without reading them; each range becomes a row, and tasks read their own
range through the Arrow file system of the path (local, HDFS, object stores).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 32 << 20


def open_file(path: str):
    """Random-access handle and size of a path as listed by Spark."""
    from pyarrow import fs

    if re.match(r"^file:/+", path):
        where, name = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    elif "://" in path:
        where, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    else:
        where, name = fs.LocalFileSystem(), path
    return where.open_input_file(name)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of the files under ``path``; contents are not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length")


def ranges(files: DataFrame, total: str, size: int, *keep: str) -> DataFrame:
    """One row per range of at most ``size`` units of each file: (path, chunk, start, stop) and ``keep``."""
    n = F.ceil(F.col(total) / F.lit(size)).cast("bigint")
    parts = files.filter(F.col(total) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    start = F.col("chunk") * F.lit(size)
    parts = parts.select("path", "chunk", start.alias("start"), F.least(start + size, F.col(total)).alias("stop"), *keep)
    return parts.repartition("path", "chunk")


def text_lines(spark: SparkSession, path: str, glob: str | None = None, size: int = CHUNK) -> DataFrame:
    """(path, line, value): every line with its number from 0 in its file.

    A first pass counts the lines that start in each range, a running sum over the ranges of a file gives the
    first number of each, and the second pass reads the lines.
    """
    parts = ranges(list_files(spark, path, glob), "length", size)

    def count(batches):
        for pdf in batches:
            counts = []
            for name, start, stop in zip(pdf["path"], pdf["start"], pdf["stop"]):
                with open_file(name) as f:
                    f.seek(max(start - 1, 0))
                    data = f.read(int(stop - max(start - 1, 0)))
                # A line starts at the file's start and after every newline but a final one.
                counts.append(data[:-1].count(b"\n") + (1 if start == 0 else 0))
            yield pdf.assign(n=np.array(counts, dtype=np.int64))[["path", "chunk", "start", "stop", "n"]]

    counted = parts.mapInPandas(count, "path string, chunk bigint, start bigint, stop bigint, n bigint")
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counted = counted.filter("n > 0").repartition("path", "chunk")

    def read(batches):
        for pdf in batches:
            for name, start, stop, n, first in zip(pdf["path"], pdf["start"], pdf["stop"], pdf["n"], pdf["first"]):
                with open_file(name) as f:
                    f.seek(max(start - 1, 0))
                    data = f.read(int(stop - max(start - 1, 0)))
                    while not data.endswith(b"\n"):
                        more = f.read(1 << 16)
                        if not more:
                            break
                        end = more.find(b"\n")
                        data += more if end < 0 else more[: end + 1]
                if start > 0:
                    data = data[data.index(b"\n") + 1 :]
                rows = data.split(b"\n")[: int(n)]
                text = [r.decode("utf-8", "replace").rstrip("\r") for r in rows]
                yield pd.DataFrame({"path": name, "line": np.arange(first, first + len(text)), "value": text})

    return counted.mapInPandas(read, "path string, line bigint, value string")
