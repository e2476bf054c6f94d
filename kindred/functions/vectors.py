"""Column expressions over dense vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kindred.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def l2_normalise(v: Column, eps: float = 0.0) -> Column:
    """Unit vector in DOUBLE. With ``eps = 0`` a zero vector stays zero; otherwise divide by norm + eps."""

    def scale(norm: Column) -> Column:
        if eps:
            return F.transform(v, lambda x: x.cast("double") / (norm + F.lit(eps)))
        safe = F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)
        return F.transform(v, lambda x: x.cast("double") / safe)

    return let(F.sqrt(squared_norm(v)), scale)


def rows(flat: Column, count: int, width: int) -> Column:
    """Reshape a flat array to ``count`` rows of ``width`` values."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.slice(flat, i * F.lit(width) + F.lit(1), F.lit(width)),
    )


def split_frame(vec: Column, joints: int = 22) -> Column:
    """Name the parts of one motion feature vector of ``12 * joints - 1`` values (a longer tail is ignored).

    Order: root rotation velocity, root linear velocity (2), root height, relative joint positions
    (joints - 1 by 3), joint rotations (joints - 1 by 6), joint velocities (joints by 3), foot contacts (4).
    """
    layout = [("ric", joints - 1, 3), ("rot6d", joints - 1, 6), ("local_vel", joints, 3)]
    parts = [
        F.get(vec, F.lit(0)).alias("root_rot_vel"),
        F.slice(vec, 2, 2).alias("root_lin_vel"),
        F.get(vec, F.lit(3)).alias("root_y"),
    ]
    start = 5
    for name, count, width in layout:
        parts.append(rows(F.slice(vec, start, count * width), count, width).alias(name))
        start += count * width
    parts.append(F.slice(vec, start, 4).alias("foot_contact"))
    return F.struct(*parts)


def root_relative(positions: Column) -> Column:
    """Positions of joints 1.. minus the position of joint 0, in DOUBLE."""
    return F.transform(
        F.slice(positions, F.lit(2), F.size(positions) - F.lit(1)),
        lambda p: F.zip_with(
            p, F.get(positions, F.lit(0)), lambda a, b: a.cast("double") - b.cast("double")
        ),
    )


def mean_squared_difference(a: Column, b: Column) -> Column:
    """Mean of the squared differences of two equally shaped arrays of rows."""
    squares = F.zip_with(
        F.flatten(a), F.flatten(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x, lambda acc: acc) / F.size(
        F.flatten(a)
    )
