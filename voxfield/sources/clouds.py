"""Point clouds and triangle meshes: PLY (ascii, binary little/big endian), NPY and PCD.

Headers are read per file (a few kilobytes); bodies are read in ranges of records by many tasks.
"""

from __future__ import annotations

import ast
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.session import cut
from voxfield.sources.chunks import list_files, open_file, ranges, text_lines

RECORDS = 1 << 20
HEAD = 1 << 16

# PLY scalar type names.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
HEADER = (
    "path string, kind string, order string, n bigint, stride int, fields array<string>, offsets array<int>, types array<string>, "
    "body bigint, lines bigint, faces bigint, face_count string, face_index string"
)


def _ply_header(path: str, head: bytes) -> dict:
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise ValueError(f"not a PLY file: {path}")
    body = head.index(b"\n", end) + 1
    text = head[:body].decode("ascii").splitlines()
    order = next(t.split()[1] for t in text if t.startswith("format"))
    n = faces = 0
    fields, types, element = [], [], ""
    count = index = ""
    for t in text:
        word = t.split()
        if word[:1] == ["element"]:
            element = word[1]
            n, faces = (int(word[2]), faces) if element == "vertex" else (n, int(word[2]) if element == "face" else faces)
        elif word[:1] == ["property"] and element == "vertex":
            fields.append(word[2])
            types.append(PLY_TYPES[word[1]])
        elif word[:2] == ["property", "list"] and element == "face":
            count, index = PLY_TYPES[word[2]], PLY_TYPES[word[3]]
    if not {"x", "y", "z"} <= set(fields):
        raise ValueError(f"no x, y, z in {path}")
    sizes = [int(t[1:]) for t in types]
    return dict(
        path=path, kind="ply_ascii" if order == "ascii" else "binary", order=">" if "big" in order else "<", n=n, stride=sum(sizes),
        fields=fields, offsets=np.cumsum([0, *sizes[:-1]]).tolist(), types=types, body=body, lines=len(text), faces=faces,
        face_count=count, face_index=index,
    )


def _npy_header(path: str, head: bytes) -> dict:
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"not an NPY file: {path}")
    wide = head[6] > 1
    size = int.from_bytes(head[8 : 12 if wide else 10], "little")
    body = (12 if wide else 10) + size
    info = ast.literal_eval(head[12 if wide else 10 : body].decode("latin1"))
    shape, kind = info["shape"], np.dtype(info["descr"])
    if len(shape) != 2 or shape[1] != 3 or info["fortran_order"]:
        raise ValueError(f"expected (N, 3) points in {path}, found {shape}")
    types = [f"{kind.kind}{kind.itemsize}"] * 3
    return dict(
        path=path, kind="binary", order=">" if kind.byteorder == ">" else "<", n=shape[0], stride=3 * kind.itemsize, fields=list("xyz"),
        offsets=[0, kind.itemsize, 2 * kind.itemsize], types=types, body=body, lines=0, faces=0, face_count="", face_index="",
    )


def _pcd_header(path: str, head: bytes) -> dict:
    at = re.search(rb"^DATA (\w+)\r?\n", head, re.M)
    if not at:
        raise ValueError(f"not a PCD file: {path}")
    text = head[: at.end()].decode("ascii").splitlines()
    info = {t.split()[0]: t.split()[1:] for t in text if t and not t.startswith("#")}
    data = info["DATA"][0]
    if data not in ("ascii", "binary"):
        raise ValueError(f"unsupported PCD data: {data}")
    fields, sizes = info["FIELDS"], [int(s) for s in info["SIZE"]]
    counts = [int(c) for c in info.get("COUNT", ["1"] * len(fields))]
    types = [{"F": "f", "I": "i", "U": "u"}[t] + str(s) for t, s in zip(info["TYPE"], sizes)]
    if not {"x", "y", "z"} <= set(fields):
        raise ValueError(f"no x, y, z in {path}")
    steps = [s * c for s, c in zip(sizes, counts)]
    return dict(
        path=path, kind="ply_ascii" if data == "ascii" else "binary", order="<", n=int(info["POINTS"][0]), stride=sum(steps), fields=fields,
        offsets=np.cumsum([0, *steps[:-1]]).tolist(), types=types, body=at.end(), lines=len(text), faces=0, face_count="", face_index="",
    )


PARSERS = {"ply": _ply_header, "npy": _npy_header, "pcd": _pcd_header}


def headers(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One header row per file; an unknown extension or a bad header is an error."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for name in pdf["path"]:
                kind = name.rsplit(".", 1)[-1].lower()
                if kind not in PARSERS:
                    raise ValueError(f"unsupported point file: {name}")
                with open_file(name) as f:
                    rows.append(PARSERS[kind](name, f.read(HEAD)))
            yield pd.DataFrame(rows)

    return list_files(spark, path, glob).mapInPandas(parse, HEADER)


def read_points(spark: SparkSession, path: str, glob: str | None = None, records: int = RECORDS) -> DataFrame:
    """(path, pt_id, x, y, z) of every point of the files, numbered from 0 in file order."""
    head = cut(headers(spark, path, glob))
    out = []
    if not head.filter("kind = 'binary'").isEmpty():
        parts = ranges(head.filter("kind = 'binary'"), "n", records, "order", "stride", "fields", "offsets", "types", "body")

        def read(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    with open_file(r.path) as f:
                        f.seek(int(r.body + r.start * r.stride))
                        data = f.read(int((r.stop - r.start) * r.stride))
                    names = list(r.fields)
                    picks = [names.index(a) for a in "xyz"]
                    kind = np.dtype(
                        {"names": list("xyz"), "formats": [r.order + r.types[p] for p in picks], "offsets": [int(r.offsets[p]) for p in picks], "itemsize": int(r.stride)}
                    )
                    rows = np.frombuffer(data, kind)
                    cols = {a: rows[a].astype(float) for a in "xyz"}
                    yield pd.DataFrame({"path": r.path, "pt_id": np.arange(r.start, r.start + len(rows)), **cols})

        out.append(parts.mapInPandas(read, "path string, pt_id bigint, x double, y double, z double"))
    plain = head.filter("kind = 'ply_ascii'")
    if not plain.isEmpty():
        lines = text_lines(spark, path, glob).join(plain.select("path", "lines", "n", "fields"), "path")
        rows = lines.withColumn("pt_id", F.col("line") - F.col("lines")).filter("pt_id >= 0 AND pt_id < n")
        words = F.split(F.trim("value"), r"\s+")
        at = [F.get(words, F.array_position("fields", a).cast("int") - 1).cast("double").alias(a) for a in "xyz"]
        out.append(rows.select("path", "pt_id", *at))
    if not out:
        raise ValueError(f"no point files under {path}")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def read_scans(spark: SparkSession, path: str, glob: str = "*.ply", pattern: str = r"(\d+)\.\w+$") -> DataFrame:
    """S3: a directory with one cloud per frame: (frame_id, pt_id, x, y, z), frame id from the file name."""
    points = read_points(spark, path, glob)
    return points.select(F.regexp_extract("path", pattern, 1).cast("bigint").alias("frame_id"), "pt_id", "x", "y", "z")


def read_mesh(spark: SparkSession, path: str, records: int = RECORDS) -> tuple[DataFrame, DataFrame]:
    """PLY meshes as vertices (path, vid, x, y, z) and triangles (path, fid, a, b, c). Faces must be triangles.

    Ids begin at 0 in every file; ascii and binary files may be mixed.
    """
    head = cut(headers(spark, path))
    vertices = read_points(spark, path, records=records).select("path", F.col("pt_id").alias("vid"), "x", "y", "z")
    out = []
    plain = head.filter("kind = 'ply_ascii'")
    if not plain.isEmpty():
        lines = text_lines(spark, path).join(plain.select("path", "lines", "n", "faces"), "path")
        rows = lines.withColumn("fid", F.col("line") - F.col("lines") - F.col("n")).filter("fid >= 0 AND fid < faces")
        words = F.split(F.trim("value"), r"\s+")
        corners = [
            F.when(F.get(words, 0) == "3", F.get(words, i).cast("bigint")).otherwise(F.raise_error(F.lit("faces must be triangles")).cast("bigint")).alias(c)
            for i, c in ((1, "a"), (2, "b"), (3, "c"))
        ]
        out.append(rows.select("path", "fid", *corners))
    binary = head.filter("kind = 'binary'")
    if binary.isEmpty():
        return vertices, out[0]
    start = F.col("body") + F.col("n") * F.col("stride")
    parts = ranges(binary.withColumn("base", start), "faces", records, "order", "face_count", "face_index", "base")

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                kind = np.dtype([("n", r.order + r.face_count), ("v", r.order + r.face_index, 3)])
                with open_file(r.path) as f:
                    f.seek(int(r.base + r.start * kind.itemsize))
                    rows = np.frombuffer(f.read(int((r.stop - r.start) * kind.itemsize)), kind)
                if (rows["n"] != 3).any():
                    raise ValueError("faces must be triangles")
                v = rows["v"].astype(np.int64)
                yield pd.DataFrame({"path": r.path, "fid": np.arange(r.start, r.start + len(rows)), "a": v[:, 0], "b": v[:, 1], "c": v[:, 2]})

    out.append(parts.mapInPandas(read, "path string, fid bigint, a bigint, b bigint, c bigint"))
    return vertices, out[0] if len(out) == 1 else out[0].unionByName(out[1])
