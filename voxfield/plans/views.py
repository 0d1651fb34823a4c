"""Spatial views over the driver tables, in Spark and as SQL text.

``pts`` and ``pts_k`` are points, ``surface`` a reference cloud, ``rays`` posed rays, ``scans``/``poses`` two
time series per user, ``traj`` a trajectory per user, ``vecs`` points that are not aligned to any grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RES = 2.0
DEPTH = 8
OFFSET = 1 << (DEPTH - 1)


def r6(col) -> F.Column:
    """Round to 6 places; the nudge keeps exact decimal ties from depending on the last bit of a sum."""
    return F.round(col + F.lit(1e-9), 6)


def r6_sql(expr: str) -> str:
    return f"round(({expr}) + 1e-9::DOUBLE, 6)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("scene"),
        F.col("l_suppkey").alias("frame_id"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 2000.0).alias("y"),
        (F.col("l_discount") * 100.0).alias("z"),
    )


PTS = """pts AS (SELECT l_returnflag AS scene, l_suppkey AS frame_id, l_quantity AS x,
  l_extendedprice / 2000.0::DOUBLE AS y, l_discount * 100.0::DOUBLE AS z FROM lineitem)"""


def pts_k(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pt_id"),
        F.pmod(F.col("o_custkey"), F.lit(64)).alias("frame_id"),
        (F.col("o_totalprice") / 10000.0).alias("x"),
        (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 20.0).alias("y"),
        (F.pmod(F.col("o_custkey") * 104729, F.lit(200)) / 20.0).alias("z"),
    )


PTS_K = """pts_k AS (SELECT o_orderkey AS pt_id, o_custkey % 64 AS frame_id, o_totalprice / 10000.0::DOUBLE AS x,
  ((o_orderkey * 7919) % 1000) / 20.0::DOUBLE AS y, ((o_custkey * 104729) % 200) / 20.0::DOUBLE AS z FROM orders)"""


def surface(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("dst_id"),
        F.col("p_size").cast("double").alias("x"),
        ((F.col("p_retailprice") - 900.0) / 2.0).alias("y"),
        F.pmod(F.col("p_partkey"), F.lit(11)).cast("double").alias("z"),
    )


SURFACE = """surface AS (SELECT p_partkey AS dst_id, p_size::DOUBLE AS x, (p_retailprice - 900.0::DOUBLE) / 2.0::DOUBLE AS y,
  (p_partkey % 11)::DOUBLE AS z FROM part)"""


def rays(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        key.alias("ray_id"),
        F.pmod(F.col("o_custkey"), F.lit(64)).alias("frame_id"),
        (F.pmod(key * 7919, F.lit(2003)) / 1001.5 - 1.0).alias("_x"),
        (F.pmod(key * 104729, F.lit(1999)) / 999.5 - 1.0).alias("_y"),
        (F.pmod(key * 31337, F.lit(997)) / 498.5 - 1.0).alias("_z"),
        (F.col("o_totalprice") / 10000.0).alias("depth"),
    )
    norm = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    raw = raw.withColumn("_n", norm)
    return raw.select(
        "ray_id",
        "frame_id",
        F.lit(25.0).alias("ox"),
        F.lit(25.0).alias("oy"),
        F.lit(5.0).alias("oz"),
        *[(F.col(f"_{a}") / F.col("_n")).alias(f"d{a}") for a in "xyz"],
        "depth",
    )


RAYS = f"""raw AS (SELECT o_orderkey AS ray_id, o_custkey % 64 AS frame_id,
  ((o_orderkey * 7919) % 2003) / 1001.5::DOUBLE - 1.0::DOUBLE AS rx, ((o_orderkey * 104729) % 1999) / 999.5::DOUBLE - 1.0::DOUBLE AS ry,
  ((o_orderkey * 31337) % 997) / 498.5::DOUBLE - 1.0::DOUBLE AS rz, o_totalprice / 10000.0::DOUBLE AS depth FROM orders),
rays AS (SELECT ray_id, frame_id, 25.0::DOUBLE AS ox, 25.0::DOUBLE AS oy, 5.0::DOUBLE AS oz,
  rx / sqrt(rx * rx + ry * ry + rz * rz) AS dx, ry / sqrt(rx * rx + ry * ry + rz * rz) AS dy,
  rz / sqrt(rx * rx + ry * ry + rz * rz) AS dz, depth FROM raw)"""


def micros(ts: str) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").filter(F.col("event_type") == "view")
    return ev.select(F.col("user_id").alias("key"), F.col("event_id").alias("scan_id"), micros("ts").alias("t"))


def poses(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").filter(F.col("event_type") == "click")
    return ev.select(F.col("user_id").alias("key"), F.col("event_id").alias("pose_id"), micros("ts").alias("t"), "value")


SCANS = """scans AS (SELECT user_id AS key, event_id AS scan_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
poses AS (SELECT user_id AS key, event_id AS pose_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'click')"""


def traj(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("scene"),
        F.col("event_id").alias("frame_id"),
        F.col("value").alias("x"),
        F.pmod(F.col("event_id"), F.lit(50)).cast("double").alias("y"),
        F.lit(0.0).alias("z"),
    )


TRAJ = """traj AS (SELECT user_id AS scene, event_id AS frame_id, value AS x, (event_id % 50)::DOUBLE AS y, 0.0::DOUBLE AS z FROM events)"""


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        "label",
        *[F.get(F.col("embedding"), i).cast("double").alias(a) for i, a in enumerate("xyz")],
    )


VECS = """vecs AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""

KEYED = f"""keyed AS (SELECT *, floor(x / {RES}::DOUBLE)::BIGINT + {OFFSET} AS kx, floor(y / {RES}::DOUBLE)::BIGINT + {OFFSET} AS ky,
  floor(z / {RES}::DOUBLE)::BIGINT + {OFFSET} AS kz FROM pts)"""


def morton_sql(kx: str, ky: str, kz: str | None = None, bits: int = DEPTH) -> str:
    """Bit-by-bit Morton code, an independent statement of the table-driven one."""
    axes = [kx, ky] if kz is None else [kx, ky, kz]
    n = len(axes)
    return "(" + " + ".join(
        f"((({k} >> {b}) & 1) << {n * b + a})" for b in range(bits) for a, k in enumerate(axes)
    ) + ")"


def code_sql(kx: str = "kx", ky: str = "ky", kz: str | None = "kz", depth: int = DEPTH) -> str:
    n = 2 if kz is None else 3
    return f"({1 << (n * depth)} + {morton_sql(kx, ky, kz, depth)})"


#: Occupied leaves of ``pts`` and all their ancestors, as (node, level).
LEAVES = f"leaves AS (SELECT DISTINCT {code_sql()} AS node FROM keyed)"
NODES = f"""nodes AS (SELECT DISTINCT node >> (3 * l)::INTEGER AS node, l::BIGINT AS level FROM leaves, range({DEPTH + 1}) r(l))"""
