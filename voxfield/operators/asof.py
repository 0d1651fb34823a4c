"""Time-nearest joins and ordered numbering that do not depend on any group being small.

A window over one key would put a hot key into one task. Every operator here works in two levels: inside
blocks of the order column, whose size is bounded by their width because the rows were made distinct on
(key, order) first, and across block summaries, of which there is one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.session import cut

#: Block width for microsecond stamps: at most 2^24 distinct stamps per block, 2^24 blocks per 9 years.
TIME_BLOCK = 1 << 24
#: Block width for dense ids.
ID_BLOCK = 1 << 16


def _neighbours(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str], width: int, inclusive: bool
) -> DataFrame:
    """For each distinct (keys, order) of ``left``: the right rows at or before (``_prev``) and at or after (``_next``)."""
    best = F.struct(F.col(order).alias("t"), *[F.col(c) for c in payload])
    rights = right.groupBy(*keys, order).agg(F.min(best).alias("_r"))
    # Right rows sort before left ones at the same stamp, or after them if an equal stamp is not "before".
    lefts = left.select(*keys, order).distinct().withColumn("_r", F.lit(None).cast(rights.schema["_r"].dataType))
    both = lefts.withColumn("_side", F.lit(1) if inclusive else F.lit(0)).unionByName(
        rights.withColumn("_side", F.lit(0) if inclusive else F.lit(1))
    )
    both = both.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    inner = Window.partitionBy(*keys, "_block").orderBy(order, "_side")
    tail = Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc(), F.col("_side"))
    local = both.select(
        *keys,
        order,
        "_block",
        "_side",
        F.last("_r", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias("_back"),
        F.last("_r", ignorenulls=True).over(tail.rowsBetween(Window.unboundedPreceding, 0)).alias("_fore"),
    )
    is_left = F.col("_side") == (1 if inclusive else 0)
    blocks = both.groupBy(*keys, "_block").agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = blocks.select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    out = local.filter(is_left).join(carried, [*keys, "_block"], "left")
    return out.select(
        *keys,
        order,
        F.coalesce("_back", "_before").alias("_prev"),
        F.coalesce("_fore", "_after").alias("_next"),
    )


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: str = "t",
    payload: Sequence[str] = (),
    tolerance: int | None = None,
    width: int = TIME_BLOCK,
) -> DataFrame:
    """For each left row the right row nearest in ``order``; a tie goes to the earlier one.

    Rows with no right row within ``tolerance`` (inclusive) are dropped. Adds the payload columns and
    ``dt`` (right - left). Of several right rows at one stamp the smallest payload counts.
    """
    near = _neighbours(left, right, keys, order, payload, width, True)
    back = F.col(order) - F.col("_prev.t")
    fore = F.col("_next.t") - F.col(order)
    pick = F.when(F.col("_next").isNull() | (back <= fore), F.col("_prev")).otherwise(F.col("_next"))
    near = near.select(*keys, order, pick.alias("_p"))
    near = near.select(*keys, order, (F.col("_p.t") - F.col(order)).alias("dt"), *[F.col(f"_p.{c}").alias(c) for c in payload])
    near = near.filter(F.abs("dt") <= tolerance) if tolerance is not None else near.filter(F.col("dt").isNotNull())
    return left.join(near, [*keys, order])


def asof_latest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: str = "t",
    payload: Sequence[str] = (),
    max_age: int | None = None,
    width: int = TIME_BLOCK,
    allow_exact: bool = True,
) -> DataFrame:
    """For each left row the latest right row at or before it (strictly before without
    ``allow_exact``), at most ``max_age`` old."""
    near = _neighbours(left, right, keys, order, payload, width, allow_exact)
    near = near.filter(F.col("_prev").isNotNull()).select(
        *keys, order, (F.col("_prev.t") - F.col(order)).alias("dt"), *[F.col(f"_prev.{c}").alias(c) for c in payload]
    )
    if max_age is not None:
        near = near.filter(-F.col("dt") <= max_age)
    return left.join(near, [*keys, order])


def asof_bracket(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: str = "t", payload: Sequence[str] = (), width: int = TIME_BLOCK
) -> DataFrame:
    """Both neighbours of each left row as structs ``prev`` and ``next`` (t and payload), NULL where absent."""
    near = _neighbours(left, right, keys, order, payload, width, True)
    near = near.withColumnsRenamed({"_prev": "prev", "_next": "next"})
    return left.join(near, [*keys, order])


def lerp_transform(bracketed: DataFrame, order: str = "t") -> DataFrame:
    """Position by linear and orientation by spherical interpolation between ``prev`` and ``next``.

    Rows without both neighbours are dropped, as a failed lookup drops the frame. Payload: x, y, z, qx, qy, qz, qw.
    """
    both = bracketed.filter(F.col("prev").isNotNull() & F.col("next").isNotNull())
    span = F.col("next.t") - F.col("prev.t")
    both = both.withColumn("_f", F.coalesce(F.try_divide(F.col(order) - F.col("prev.t"), span), F.lit(0.0)).cast("double"))
    q = ["qx", "qy", "qz", "qw"]
    cosine = sum((F.col(f"prev.{c}") * F.col(f"next.{c}") for c in q[1:]), F.col("prev.qx") * F.col("next.qx"))
    both = both.withColumn("_c", cosine)
    # The shorter way round; nearly equal orientations interpolate linearly.
    both = both.withColumn("_sign", F.when(F.col("_c") < 0, -1.0).otherwise(1.0))
    both = both.withColumn("_a", F.acos(F.least(F.lit(1.0), F.abs("_c"))))
    close = F.sin("_a") < 1e-6
    w0 = F.when(close, 1 - F.col("_f")).otherwise(F.try_divide(F.sin((1 - F.col("_f")) * F.col("_a")), F.sin("_a")))
    w1 = F.when(close, F.col("_f")).otherwise(F.try_divide(F.sin(F.col("_f") * F.col("_a")), F.sin("_a")))
    place = [(F.col(f"prev.{c}") + F.col("_f") * (F.col(f"next.{c}") - F.col(f"prev.{c}"))).alias(c) for c in "xyz"]
    turn = [(w0 * F.col(f"prev.{c}") + w1 * F.col("_sign") * F.col(f"next.{c}")).alias(c) for c in q]
    rest = [c for c in bracketed.columns if c not in ("prev", "next")]
    return both.select(*rest, *place, *turn)


def pair_once(
    left: DataFrame, right: DataFrame, keys: Sequence[str], slop: int, left_id: str, right_id: str, order: str = "t", width: int = TIME_BLOCK
) -> DataFrame:
    """One-to-one pairs of two streams within ``slop``, each message used at most once.

    Closest pairs first (ties: earlier left, then earlier right). Each round keeps the pairs that are each
    other's nearest message, which are exactly the pairs the greedy order would take, and takes both ends
    out of the pool; no list of all pairs within the slop is ever formed. Messages of one stream with equal
    stamps are taken in order of their ids, as many at once as the other side has. Equal rows count once.
    """
    lefts = cut(left.select(*keys, F.col(order).alias("_lt"), F.col(left_id).alias("_l")).distinct())
    rights = cut(right.select(*keys, F.col(order).alias("_rt"), F.col(right_id).alias("_r")).distinct())
    done: DataFrame | None = None
    while True:
        l_at, r_at = lefts.select(*keys, F.col("_lt").alias("t")).distinct(), rights.select(*keys, F.col("_rt").alias("t")).distinct()
        stamp = F.col("t").alias("_at")
        to_right = asof_nearest(l_at, r_at.select("*", stamp), keys, "t", ("_at",), slop, width).select(*keys, F.col("t").alias("_lt"), F.col("_at").alias("_rt"))
        to_left = asof_nearest(r_at, l_at.select("*", stamp), keys, "t", ("_at",), slop, width).select(*keys, F.col("_at").alias("_lt"), F.col("t").alias("_rt"))
        mutual = cut(to_right.join(to_left, [*keys, "_lt", "_rt"]))
        if mutual.isEmpty():
            break
        rank = lambda at, name: F.row_number().over(Window.partitionBy(*keys, at).orderBy(name)).alias("_i")
        mine = lefts.join(mutual, [*keys, "_lt"]).select("*", rank("_lt", "_l"))
        yours = rights.join(mutual.select(*keys, "_rt"), [*keys, "_rt"], "left_semi").select("*", rank("_rt", "_r"))
        best = cut(mine.join(yours, [*keys, "_rt", "_i"]).select(*keys, "_l", "_r", F.abs(F.col("_rt") - F.col("_lt")).alias("gap")))
        done = best if done is None else done.unionByName(best)
        lefts = cut(lefts.join(best.select(*keys, "_l"), [*keys, "_l"], "left_anti"))
        rights = cut(rights.join(best.select(*keys, "_r"), [*keys, "_r"], "left_anti"))
    if done is None:
        none = lefts.join(rights, list(keys)).select(*keys, "_l", "_r", (F.col("_rt") - F.col("_lt")).alias("gap"))
        done = none.filter(F.lit(False))
    return done.select(*keys, F.col("_l").alias(left_id), F.col("_r").alias(right_id), "gap")


# -- two-level numbering, lag and running sums ---------------------------------------------------


def block_offsets(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Running total of ``value`` before each block: (keys, _block, _before). One row per block."""
    sums = df.groupBy(*keys, "_block").agg(F.sum(value).alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_block") if keys else Window.orderBy("_block")
    before = F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, "_block", F.coalesce(before, F.lit(0)).alias("_before"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "rn") -> DataFrame:
    """Row number (from 1) per ``keys`` in ``order``; ``block`` must grow with the order columns."""
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(inner))
    offsets = block_offsets(df, keys, F.lit(1).cast("bigint"))
    out = df.join(offsets, [*keys, "_block"])
    return out.withColumn(name, F.col("_before") + F.col("_rn")).drop("_block", "_rn", "_before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows (exclusive) per ``keys`` in ``order``."""
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_run", F.coalesce(F.sum(value).over(inner), F.lit(0.0)))
    out = df.join(block_offsets(df, keys, F.col(value)), [*keys, "_block"])
    return out.withColumn(name, F.col("_before") + F.col("_run")).drop("_block", "_run", "_before")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], width: int = ID_BLOCK) -> DataFrame:
    """Struct ``prev`` (order and values) of the preceding row per ``keys``; (keys, order) must be unique."""
    df = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    this = F.struct(order, *values)
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    df = df.withColumn("_lag", F.lag(this).over(inner))
    ends = df.groupBy(*keys, "_block").agg(F.max(this).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.select(*keys, "_block", F.lag("_end").over(across).alias("_carry"))
    out = df.join(ends, [*keys, "_block"])
    return out.withColumn("prev", F.coalesce("_lag", "_carry")).drop("_block", "_lag", "_carry")
