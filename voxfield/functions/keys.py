"""Voxel keys, Morton codes and location codes as column expressions.

A node of the voxel hierarchy is named by its location code ``(1 << dims*d) | morton(key >> level)``
with ``d = depth - level``: the parent is ``node >> dims``, the children are ``(node << dims) | 0..2^dims-1``
and the root is 1, so hierarchy steps are arithmetic and never a lookup. ``dims=2`` gives the planar forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")

#: Bits per key that a code can hold (60-bit codes stay positive in a bigint).
MAX_DEPTH = {2: 30, 3: 20}
#: Bits per table step of the encoder.
CHUNK = 8


def _table(values: list[int]) -> Column:
    """A lookup array that the optimizer folds to a single literal."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _spread_table(dims: int) -> Column:
    return _table([sum((v >> b & 1) << (dims * b) for b in range(CHUNK)) for v in range(1 << CHUNK)])


def _gather_table(dims: int, bits: int) -> Column:
    """Inverse of the spread for code chunks that hold ``bits`` bits of every axis."""
    return _table([sum((v >> (dims * b) & 1) << b for b in range(bits)) for v in range(1 << dims * bits)])


#: Face directions W, E, S, N, bottom, top as (axis, step).
FACES = {
    "west": (0, -1),
    "east": (0, 1),
    "south": (1, -1),
    "north": (1, 1),
    "bottom": (2, -1),
    "top": (2, 1),
}


def _spread(x: Column, dims: int, bits: int) -> Column:
    """Put bit b of x at bit dims*b. A table step per few bits keeps the expression small, so that codes
    can be nested in predicates without blowing up the generated code."""
    table = _spread_table(dims)
    x = x.cast("bigint")
    out = None
    for low in range(0, bits, CHUNK):
        part = F.shiftright(x, low) if low else x
        part = F.get(table, part.bitwiseAND(F.lit((1 << min(CHUNK, bits - low)) - 1)).cast("int"))
        part = F.shiftleft(part, dims * low) if low else part
        out = part if out is None else out.bitwiseOR(part)
    return out


def _gather(code: Column, dims: int, bits: int) -> Column:
    step = 6 // dims
    table = _gather_table(dims, step)
    out = None
    for low in range(0, bits, step):
        part = F.shiftright(code, dims * low) if low else code
        part = F.get(table, part.bitwiseAND(F.lit((1 << dims * step) - 1)).cast("int"))
        part = F.shiftleft(part, low) if low else part
        out = part if out is None else out.bitwiseOR(part)
    return out


def morton(keys: Sequence[Column], bits: int | None = None) -> Column:
    """Interleave 2 or 3 non-negative keys of ``bits`` bits; bit 0 is x, bit 1 is y, bit 2 is z."""
    dims = len(keys)
    bits = bits or MAX_DEPTH[dims]
    code = _spread(keys[0], dims, bits)
    for axis in range(1, dims):
        code = code.bitwiseOR(F.shiftleft(_spread(keys[axis], dims, bits), axis))
    return code


def morton_decode(code: Column, dims: int = 3, bits: int | None = None) -> list[Column]:
    bits = bits or MAX_DEPTH[dims]
    return [_gather(F.shiftright(code, axis) if axis else code, dims, bits) for axis in range(dims)]


def point_key(x: Column, res: float, depth: int) -> Column:
    """Voxel key of one coordinate: floor(x / res) + 2^(depth-1)."""
    return F.floor(x / F.lit(float(res))) + F.lit(1 << (depth - 1))


def checked_key(key: Column, depth: int) -> Column:
    """The key, or NULL outside [0, 2^depth)."""
    return F.when(key.between(0, (1 << depth) - 1), key)


def with_keys(df: DataFrame, res: float, depth: int, dims: int = 3, checked: bool = True) -> DataFrame:
    """Add kx, ky(, kz); with ``checked`` points outside the key range are dropped."""
    cols = {f"k{a}": point_key(F.col(a), res, depth) for a in AXES[:dims]}
    df = df.withColumns(cols)
    if checked:
        for a in AXES[:dims]:
            df = df.filter(F.col(f"k{a}").between(0, (1 << depth) - 1))
    return df


def key_columns(dims: int = 3) -> list[Column]:
    return [F.col(f"k{a}") for a in AXES[:dims]]


def location_code(keys: Sequence[Column], depth: int, level: int = 0) -> Column:
    """Location code of the ancestor at ``level`` of a leaf key (level 0 is the leaf)."""
    dims = len(keys)
    leaf = morton(keys, depth).bitwiseOR(F.lit(1 << (dims * depth)))
    return F.shiftright(leaf, dims * level) if level else leaf


def ancestor(node: Column, up: int | Column, dims: int = 3) -> Column:
    """The ancestor ``up`` steps above a node."""
    if isinstance(up, int):
        return F.shiftright(node, dims * up)
    return F.call_function("shiftright", node, (up * F.lit(dims)).cast("int"))


def children(node: Column, dims: int = 3) -> Column:
    """Array of the 2^dims children of a node."""
    base = F.shiftleft(node, dims)
    return F.array(*[base.bitwiseOR(F.lit(i).cast("bigint")) for i in range(1 << dims)])


def node_depth(node: Column, dims: int = 3) -> Column:
    """Steps below the root. The small constant guards log2 of exact powers of two."""
    return F.floor((F.log2(node) + F.lit(1e-6)) / F.lit(float(dims))).cast("int")


def node_keys(node: Column, depth: int, dims: int = 3) -> list[Column]:
    """Lowest leaf key covered by a node, per axis."""
    at = node_depth(node, dims)
    code = node - F.call_function("shiftleft", F.lit(1).cast("bigint"), (at * F.lit(dims)).cast("int"))
    level = (F.lit(depth) - at).cast("int")
    return [F.call_function("shiftleft", k, level) for k in morton_decode(code, dims, depth)]


def leaf_keys(leaf: Column, depth: int, dims: int = 3) -> list[Column]:
    """Keys of a leaf code (all at level 0)."""
    return morton_decode(leaf.bitwiseXOR(F.lit(1 << (dims * depth))), dims, depth)


def level_key(key: Column, level: int | Column) -> Column:
    """Centre key at a level: ((k >> L) << L) + 2^(L-1); level 0 leaves the key unchanged."""
    key = key.cast("bigint")
    if isinstance(level, int):
        if level == 0:
            return key
        return F.shiftleft(F.shiftright(key, level), level) + F.lit(1 << (level - 1))
    level = level.cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", key, level), level)
    half = F.shiftright(F.call_function("shiftleft", F.lit(1).cast("bigint"), level), 1)
    return low + half


def voxel_centre(key: Column, level: int | Column, res: float, depth: int) -> Column:
    """Centre coordinate: (k - off + 0.5)*res at level 0, (k - off)*res for the centre key above."""
    off = 1 << (depth - 1)
    centre = level_key(key, level) - F.lit(off)
    half = F.when(F.lit(level) == 0 if isinstance(level, int) else level == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return (centre + half) * F.lit(float(res))


def corner_coord(key: Column, res: float, depth: int) -> Column:
    return (key - F.lit(1 << (depth - 1))) * F.lit(float(res))


def node_size(level: Column, res: float) -> Column:
    """Metric edge length res * 2^level."""
    return F.lit(float(res)) * F.pow(F.lit(2.0), level)


def discrete_size(level: Column) -> Column:
    """Discrete voxel size 2^level, -1 where there is no voxel."""
    one = F.lit(1).cast("bigint")
    return F.coalesce(F.call_function("shiftleft", one, level.cast("int")), F.lit(-1).cast("bigint"))


def neighbour_offsets(dims: int = 3, full: bool = False) -> list[tuple[int, ...]]:
    """2*dims face offsets, or all 3^dims - 1 offsets."""
    import itertools

    steps = [s for s in itertools.product((-1, 0, 1), repeat=dims) if any(s)]
    return steps if full else [s for s in steps if sum(map(abs, s)) == 1]


def explode_neighbours(
    df: DataFrame, depth: int, dims: int = 3, full: bool = False, size: Column | None = None
) -> DataFrame:
    """One row per in-range neighbour key: nx, ny(, nz). ``size`` is the step (default one leaf)."""
    step = F.lit(1).cast("bigint") if size is None else size.cast("bigint")
    names = [f"n{a}" for a in AXES[:dims]]
    options = F.array(
        *[
            F.struct(*[(k.cast("bigint") + step * F.lit(o)).alias(n) for k, o, n in zip(key_columns(dims), off, names)])
            for off in neighbour_offsets(dims, full)
        ]
    )
    out = df.withColumn("_n", F.explode(options))
    out = out.select("*", *[F.col(f"_n.{n}").alias(n) for n in names]).drop("_n")
    for n in names:
        out = out.filter(F.col(n).between(0, (1 << depth) - 1))
    return out


def face_neighbour(keys: Sequence[Column], face: str, depth: int, size: int = 1) -> list[Column]:
    """Key of the neighbour across a named face; NULL on every axis at the border."""
    axis, step = FACES[face]
    moved = checked_key(keys[axis] + F.lit(step * size), depth)
    return [moved if a == axis else F.when(moved.isNotNull(), k) for a, k in enumerate(keys)]


def common_ancestor(a: Column, b: Column, dims: int = 3) -> Column:
    """Deepest node above two nodes: level both, XOR, and shift past the highest differing bit."""
    da, db = node_depth(a, dims), node_depth(b, dims)
    low = F.least(da, db)
    a, b = ancestor(a, da - low, dims), ancestor(b, db - low, dims)
    diff = a.bitwiseXOR(b)
    # Bits are counted, not taken from a logarithm: the XOR may lie just below a power of two.
    steps = F.when(diff == 0, F.lit(0)).otherwise(F.ceil(F.length(F.bin(diff)) / F.lit(dims)))
    return ancestor(a, steps.cast("int"), dims)
