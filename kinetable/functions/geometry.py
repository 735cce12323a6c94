"""Camera geometry as column expressions. A rotation is a list of nine columns by rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def norm(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def rotate(r: Vector, p: Vector) -> Vector:
    return [dot(r[3 * i : 3 * i + 3], p) for i in range(3)]


def transform_point(r: Vector, t: Vector, p: Vector) -> Vector:
    """World to camera: R p + t."""
    return [x + y for x, y in zip(rotate(r, p), t, strict=True)]


def rigid_inverse(r: Vector, t: Vector) -> tuple[Vector, Vector]:
    """Transposed rotation, and the translation that undoes the given one."""
    back = [r[3 * j + i] for i in range(3) for j in range(3)]
    return back, [-x for x in rotate(back, t)]


def quaternion_rotation(w: Column, x: Column, y: Column, z: Column) -> Vector:
    """Rotation of a quaternion that needn't be of unit length."""
    n = w * w + x * x + y * y + z * z
    two = lambda v: 2 * v / n
    return [
        1 - two(y * y + z * z), two(x * y - z * w), two(x * z + y * w),
        two(x * y + z * w), 1 - two(x * x + z * z), two(y * z - x * w),
        two(x * z - y * w), two(y * z + x * w), 1 - two(x * x + y * y),
    ]


def look_at(forward: Vector, up: tuple[float, float, float] = (0.0, 1.0, 0.0)) -> Vector:
    """Right, down and forward axes of a camera; null if it looks along ``up``."""
    size = F.nullif(F.when(norm(forward) < 1e-6, 0.0).otherwise(norm(forward)), F.lit(0.0))
    f = [x / size for x in forward]
    side = cross(f, [F.lit(v) for v in up])
    n = norm(side)
    side = [F.when(n >= 1e-6, x / n) for x in side]
    return [*side, *cross(f, side), *f]


def pinhole(p: Vector, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a point in camera space; depth is at least 1e-6."""
    z = F.greatest(p[2], F.lit(1e-6))
    return fx * p[0] / z + cx, fy * p[1] / z + cy


def lift(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Vector:
    """Point in camera space of a pixel with a depth."""
    return [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]


def fisheye(p: Vector, f: float, cx: float, cy: float, k: list[float]) -> tuple[Column, Column]:
    """Radial fisheye projection: the angle to the axis times a polynomial in its square."""
    r = F.sqrt(p[0] * p[0] + p[1] * p[1])
    angle = F.atan2(r, p[2])
    square, poly = angle * angle, F.lit(0.0)
    for c in reversed(k):
        poly = (poly + c) * square
    scale = F.when(r > 1e-12, angle * (1 + poly) / r).otherwise(F.lit(1.0))
    return f * scale * p[0] + cx, f * scale * p[1] + cy


def quantize(v: Column, scale: int = 1000) -> Column:
    """Fixed point, halves to even."""
    return F.rint(v * scale).cast("long")


def collage_cell(index: Column, columns: int, width: Column, height: Column) -> tuple[Column, Column]:
    """Left and top of a frame in a grid."""
    return (index % columns) * width, F.floor(index / columns).cast("long") * height


def l2(a: Column, b: Column) -> Column:
    """Distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def clip01(v: Column, fill: float = 0.5) -> Column:
    """Between 0 and 1; what isn't a number becomes ``fill``."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(v, F.lit(fill))))


def ceil_to(v: Column, n: int) -> Column:
    return (F.ceil(v / n) * n).cast("long")


def picture_share(pixel: Column, size: Column) -> Column:
    """A pixel's place as a share of the picture's side, kept within 0 and 1; what isn't a number
    is the middle."""
    share = F.when(pixel.isNotNull() & ~F.isnan(pixel), pixel / size).otherwise(0.5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def inverse4(m: Vector) -> Vector:
    """Inverse of a 4 by 4 matrix (sixteen columns by rows) by cofactors; null if it has none."""

    def minor(r: int, c: int) -> Column:
        rows, cols = [i for i in range(4) if i != r], [j for j in range(4) if j != c]
        a = [[m[4 * i + j] for j in cols] for i in rows]
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    cofactor = [[minor(r, c) * (1 if (r + c) % 2 == 0 else -1) for c in range(4)] for r in range(4)]
    det = sum((m[c] * cofactor[0][c] for c in range(1, 4)), m[0] * cofactor[0][0])
    return [F.try_divide(cofactor[c][r], det) for r in range(4) for c in range(4)]


def product4(a: Vector, b: Vector) -> Vector:
    return [dot([a[4 * i + k] for k in range(4)], [b[4 * k + j] for k in range(4)]) for i in range(4) for j in range(4)]


def bilinear(grid: Column, height: int, width: int, x: Column, y: Column) -> Column:
    """Value of a flat grid at a place between its cells' centres, the edge's beyond them."""
    cx, cy = F.least(F.lit(width - 1.0), F.greatest(F.lit(0.0), x)), F.least(F.lit(height - 1.0), F.greatest(F.lit(0.0), y))
    x0, y0 = F.floor(cx).cast("int"), F.floor(cy).cast("int")
    x1, y1 = F.least(F.lit(width - 1), x0 + 1), F.least(F.lit(height - 1), y0 + 1)
    at = lambda r, c: F.get(grid, r * width + c).cast("double")
    fx, fy = cx - x0, cy - y0
    return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy


def resized(grid: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """A flat grid in another size, by straight lines between cells' centres."""
    place = F.sequence(F.lit(0), F.lit(new_height * new_width - 1))
    x = lambda k: (k % new_width + 0.5) * width / float(new_width) - 0.5
    y = lambda k: (F.floor(k / new_width) + 0.5) * height / float(new_height) - 0.5
    return F.transform(place, lambda k: bilinear(grid, height, width, x(k), y(k)))


def surface_point(kind: Column, size: Vector, u: Column, v: Column, w: Column) -> Vector:
    """A point on a body's surface from three uniform numbers, uniform by area (but on an
    ellipsoid, which is a stretched sphere). Sizes: radius of a sphere; half sides of a box;
    radius and half height of a cylinder or capsule (its cylinder's); half axes of an ellipsoid."""
    turn, up = 2 * math.pi * u, 2 * v - 1
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - up * up))
    ball = [ring * F.cos(turn), ring * F.sin(turn), up]
    a, b, c = size
    # box: one of three pairs of faces by area, then a place on it
    xy, yz, xz = a * b, b * c, a * c
    face = w * (xy + yz + xz)
    side = F.when((w * 1024) % 2 < 1, 1.0).otherwise(-1.0)
    p, q = 2 * u - 1, 2 * v - 1
    pick = lambda one, two, three: F.when(face < xy, one).when(face < xy + yz, two).otherwise(three)
    box = [pick(p * a, side * a, p * a), pick(q * b, p * b, side * b), pick(side * c, q * c, q * c)]
    # cylinder: side or one of two ends, by area
    wall, end = 2 * b, a / 2
    on = w * (wall + 2 * end)
    out = F.when(on < wall, 1.0).otherwise(F.sqrt(v))
    tube = [a * out * F.cos(turn), a * out * F.sin(turn), F.when(on < wall, q * b).when(on < wall + end, b).otherwise(-b)]
    # capsule: side, or a ball whose halves are moved apart
    on2 = w * (2 * b + 2 * a)
    moved = a * up + F.when(up >= 0, b).otherwise(-b)
    capsule = [F.when(on2 < 2 * b, a * F.cos(turn)).otherwise(a * ball[0]), F.when(on2 < 2 * b, a * F.sin(turn)).otherwise(a * ball[1]), F.when(on2 < 2 * b, q * b).otherwise(moved)]
    by = lambda k: F.when(kind == "sphere", a * ball[k]).when(kind == "box", box[k]).when(kind == "cylinder", tube[k]).when(kind == "capsule", capsule[k]).otherwise(size[k] * ball[k])
    return [by(k) for k in range(3)]


def triangle_point(corners: list[Vector], u: Column, v: Column) -> Vector:
    """A point of a triangle, uniform by area."""
    s = F.sqrt(u)
    share = [1 - s, s * (1 - v), s * v]
    return [sum((share[i] * corners[i][k] for i in range(1, 3)), share[0] * corners[0][k]) for k in range(3)]


def triangle_area(corners: list[Vector]) -> Column:
    a, b = ([q - p for p, q in zip(corners[0], corners[i], strict=True)] for i in (1, 2))
    return norm(cross(a, b)) / 2


def to_480p(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """A pixel's place, halves to even, and the width in a picture of 480 lines and even width."""
    new = (F.rint(width * 480.0 / height / 2) * 2).cast("long")
    return F.rint(x * new / width).cast("long"), F.rint(y * 480.0 / height).cast("long"), new


def warped(x: Column, y: Column, f: float, cx: float, cy: float, k: list[float]) -> tuple[Column, Column]:
    """A pixel of a plain picture through the pinhole to a ray, and through the fisheye to a pixel;
    both cameras share f, cx and cy."""
    return fisheye([(x - cx) / f, (y - cy) / f, F.lit(1.0)], f, cx, cy, k)


def warp_map(spark, width: int, height: int, f: float, cx: float, cy: float, k: list[float]):
    """(x, y, map_x, map_y) of each pixel of a plain picture."""
    p = spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).cast("long").alias("y"))
    u, v = warped(F.col("x"), F.col("y"), f, cx, cy, k)
    return p.select("x", "y", u.alias("map_x"), v.alias("map_y"))
