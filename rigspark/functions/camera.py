"""Camera geometry as expressions on a row that holds a camera's columns and a point or pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far away a point at infinity is placed.
NEAR_INFINITY = 1e6


def _item(name: str, i: int) -> Column:
    return F.col(name)[i]


def unfolded(name: str, i: int) -> Column:
    """A camera's number as :func:`unfold` names it."""
    return F.col(f"__{name}{i}")


def unfold(cameras: DataFrame) -> DataFrame:
    """Adds each number of the cameras' arrays, and the threshold of their field of view, as a column.

    For joins with many rows: expressions over plain columns compile to a fraction of the code.
    """
    sizes = {"origin": 3, "right": 3, "up": 3, "forward": 3, "focal": 2, "principal": 2, "resolution": 2, "distortion": 2}
    return cameras.withColumns({f"__{c}{i}": F.col(c)[i] for c, n in sizes.items() for i in range(n)} | {"__threshold": fov_threshold()})


def _v(name: str, get=_item) -> tuple[Column, Column, Column]:
    return tuple(get(name, i) for i in range(3))


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def in_camera(point: tuple[Column, Column, Column], get=_item) -> tuple[Column, Column, Column]:
    """A world point in the camera's axes: right, up, backward."""
    d = tuple(p - o for p, o in zip(point, _v("origin", get), strict=True))
    return dot(_v("right", get), d), dot(_v("up", get), d), -dot(_v("forward", get), d)


def distort(r: Column, get=_item) -> Column:
    """Radius on the sensor of an undistorted radius."""
    r2 = r * r
    return r * (1 + r2 * (get("distortion", 0) + r2 * get("distortion", 1)))


def undistort(r: Column, steps: int = 10, probe: float = 1e-6) -> Column:
    """Newton's method on :func:`distort` with a numeric derivative and a fixed number of steps."""
    d0, d1 = F.col("distortion")[0], F.col("distortion")[1]
    f = lambda x: x * (1 + x * x * (d0 + x * x * d1))

    def step(x: Column, _: Column) -> Column:
        slope = (f(x + probe) - f(x)) / probe
        return F.when(F.abs(f(x) - r) < 1e-12, x).otherwise(x - (f(x) - r) / F.when(slope == 0, 1.0).otherwise(slope))

    return F.when((d0 == 0) & (d1 == 0), r).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), r, step))


def project(point: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Pixel of a world point.  A point on the axis falls on the principal point; one exactly
    beside a flat camera has no image: null."""
    x, y, z = in_camera(point)
    n = F.sqrt(x * x + y * y)
    fisheye = F.when(n == 0, 0.0).otherwise(distort(F.atan2(n, -z)) / n)
    depth = F.nullif(z, F.lit(0.0))
    q2 = (x * x + y * y) / (depth * depth)
    flat = (1 + q2 * (F.col("distortion")[0] + q2 * F.col("distortion")[1])) / -depth
    scale = F.when(F.col("type") == "FTHETA", fisheye).otherwise(flat)
    return x * scale * F.col("focal")[0] + F.col("principal")[0], y * scale * F.col("focal")[1] + F.col("principal")[1]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def projected(point: tuple[Column, Column, Column]) -> Column:
    """:func:`project` as a struct ``(u, v)``, with every part computed once.

    For plans that project several times for a row, where the expanded expression would not fit
    into compiled code.
    """
    names = ("x", "y", "z")
    world = F.struct(*(c.cast("double").alias(n) for c, n in zip(point, names, strict=True)))

    def seen(w: Column) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(in_camera(tuple(w[n] for n in names)), names, strict=True)))

    def scaled(c: Column) -> Column:
        n = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
        fisheye = F.when(n == 0, 0.0).otherwise(distort(F.atan2(n, -c["z"])) / n)
        depth = F.nullif(c["z"], F.lit(0.0))
        q2 = (c["x"] * c["x"] + c["y"] * c["y"]) / (depth * depth)
        flat = (1 + q2 * (F.col("distortion")[0] + q2 * F.col("distortion")[1])) / -depth
        k = F.when(F.col("type") == "FTHETA", fisheye).otherwise(flat)
        return _let(k, lambda k: F.struct((c["x"] * k * F.col("focal")[0] + F.col("principal")[0]).alias("u"), (c["y"] * k * F.col("focal")[1] + F.col("principal")[1]).alias("v")))

    return _let(_let(world, seen), scaled)


def with_projected(df: DataFrame, point: tuple[Column, Column, Column], u: str = "px", v: str = "py", get=_item) -> DataFrame:
    """Adds the pixel of :func:`project`, its parts computed as columns one after the other.

    For plans over many rows: every part is compiled code, which the lambdas of :func:`projected` are not.
    """
    kept = [c for c in df.columns if c not in (u, v)]
    x, y, z, n, k = (F.col(f"__{c}") for c in ("cx", "cy", "cz", "cn", "ck"))
    rows = df.withColumns({f"__c{a}": c for a, c in zip("xyz", in_camera(tuple(c.cast("double") for c in point), get), strict=True)})
    rows = rows.withColumn("__cn", F.sqrt(x * x + y * y))
    fisheye = F.when(n == 0, 0.0).otherwise(distort(F.atan2(n, -z), get) / n)
    depth = F.nullif(z, F.lit(0.0))
    q2 = (x * x + y * y) / (depth * depth)
    flat = (1 + q2 * (get("distortion", 0) + q2 * get("distortion", 1))) / -depth
    rows = rows.withColumn("__ck", F.when(F.col("type") == "FTHETA", fisheye).otherwise(flat))
    pixel = (x * k * get("focal", 0) + get("principal", 0)).alias(u), (y * k * get("focal", 1) + get("principal", 1)).alias(v)
    return rows.select(*kept, *pixel)


def unproject(px: Column, py: Column) -> tuple[Column, Column, Column]:
    """Direction of the world ray through a pixel; the principal point looks along the axis."""
    sx, sy = (px - F.col("principal")[0]) / F.col("focal")[0], (py - F.col("principal")[1]) / F.col("focal")[1]
    n = F.sqrt(sx * sx + sy * sy)
    r = undistort(n)
    angle = F.when(F.col("type") == "FTHETA", r).otherwise(F.atan(r))
    k = F.when(n == 0, 0.0).otherwise(F.sin(angle) / n)
    u = (k * sx, k * sy, -F.cos(angle))
    right, up, forward = _v("right"), _v("up"), _v("forward")
    return tuple(right[i] * u[0] + up[i] * u[1] - forward[i] * u[2] for i in range(3))


def near_infinity(px: Column, py: Column) -> tuple[Column, Column, Column]:
    return tuple(o + NEAR_INFINITY * d for o, d in zip(_v("origin"), unproject(px, py), strict=True))


def fov_threshold() -> Column:
    """cos(fov) * |cos(fov)|; without a fov -1 for fisheye (sees all) and 0 for flat (in front)."""
    c = F.cos(F.col("fov"))
    return F.when(F.col("fov").isNotNull(), c * F.abs(c)).when(F.col("type") == "FTHETA", -1.0).otherwise(0.0)


def fov_of(threshold: Column) -> Column:
    """The half field of view that a threshold stands for."""
    return F.acos(F.signum(threshold) * F.sqrt(F.abs(threshold)))


def is_behind(point) -> Column:
    return in_camera(point)[2] >= 0


def outside_fov(point, get=_item) -> Column:
    v = tuple(p - o for p, o in zip(point, _v("origin", get), strict=True))
    d = dot(_v("forward", get), v)
    return d * F.abs(d) <= (fov_threshold() if get is _item else F.col("__threshold")) * dot(v, v)


def in_frame(px: Column, py: Column, get=_item) -> Column:
    return (px >= 0) & (px < get("resolution", 0)) & (py >= 0) & (py < get("resolution", 1))


def sees(point) -> Column:
    return ~outside_fov(point) & in_frame(*project(point))


def rescale_camera(factor: float) -> dict[str, Column]:
    """Intrinsics for images resized by ``factor``."""
    return {c: F.transform(c, lambda v: v * F.lit(factor)) for c in ("resolution", "principal", "focal")}


def axis_distance() -> Column:
    """How far from the rig's centre the camera's axis passes."""
    o, f = _v("origin"), _v("forward")
    t = dot(o, f)
    d = tuple(a - t * b for a, b in zip(o, f, strict=True))
    return F.sqrt(dot(d, d))


def approx_fov(horizontal: bool) -> Column:
    """Half field of view: angle between the axis and the ray through the middle of an edge."""
    px = F.lit(0.0) if horizontal else F.col("principal")[0]
    py = F.col("principal")[1] if horizontal else F.lit(0.0)
    return F.acos(F.least(F.greatest(dot(_v("forward"), unproject(px.cast("double"), py.cast("double"))), F.lit(-1.0)), F.lit(1.0)))


def rotation_rows(a: tuple[Column, Column, Column]) -> list[tuple[Column, Column, Column]]:
    """Rotation matrix of an angle-axis vector, by rows; the zero vector gives the identity."""
    n = F.sqrt(dot(a, a))
    k = tuple(F.when(n == 0, 1.0 if i == 0 else 0.0).otherwise(c / n) for i, c in enumerate(a))
    c, s = F.cos(n), F.sin(n)
    skew = ((F.lit(0.0), -k[2], k[1]), (k[2], F.lit(0.0), -k[0]), (-k[1], k[0], F.lit(0.0)))
    return [tuple((c if i == j else F.lit(0.0)) + (1 - c) * k[i] * k[j] + s * skew[i][j] for j in range(3)) for i in range(3)]


def angle_axis(rows) -> tuple[Column, Column, Column]:
    """Angle-axis vector of a rotation, with an angle of at most pi."""
    trace = rows[0][0] + rows[1][1] + rows[2][2]
    angle = F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0)))
    v = (rows[2][1] - rows[1][2], rows[0][2] - rows[2][0], rows[1][0] - rows[0][1])
    n = F.sqrt(dot(v, v))
    return tuple(F.when(n < 1e-12, 0.0).otherwise(angle * x / n) for x in v)


def midpoint(a_from, a_to, b_from, b_to) -> tuple[Column, Column, Column]:
    """The point nearest to two rays: the middle between their closest points.

    Parallel rays and rays that meet behind an origin give the points far along both.
    """
    pa, pb, va, vb = a_from, b_from, a_to, b_to
    d = tuple(x - y for x, y in zip(pa, pb, strict=True))
    aa, ab, bb, ad, bd = dot(va, va), dot(va, vb), dot(vb, vb), dot(va, d), dot(vb, d)
    det = aa * bb - ab * ab
    ta, tb = (ab * bd - bb * ad) / F.nullif(det, F.lit(0.0)), (aa * bd - ab * ad) / F.nullif(det, F.lit(0.0))
    good = ta.isNotNull() & tb.isNotNull() & (ta >= 0) & (tb >= 0)
    ta, tb = F.when(good, ta).otherwise(NEAR_INFINITY), F.when(good, tb).otherwise(NEAR_INFINITY)
    return tuple((p + ta * v + q + tb * w) / 2 for p, v, q, w in zip(pa, va, pb, vb, strict=True))


def equirect_direction(x: Column, y: Column, cols: float, rows: float) -> tuple[Column, Column, Column]:
    """Direction of the centre of an equirectangular cell: theta around z, phi from the zenith."""
    theta, phi = (x + 0.5) * (2 * math.pi / cols), (y + 0.5) * (math.pi / rows)
    return F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)


def cube_to_equirect(face: str, x: Column, y: Column, cols: float, rows: float, fov: float = math.pi) -> tuple[Column, Column]:
    """Source cell of a cube face's cell; x and y run from -0.5 to 0.5 over the face."""
    z = F.lit(0.5)
    #: How each face turns (x, y, 0.5).
    d = {"back": (x, z, -y), "left": (-z, x, -y), "top": (x, y, z), "bottom": (x, -y, -z), "front": (-x, -z, -y), "right": (z, -x, -y)}[face]
    theta = F.atan2(d[1], d[0])
    theta = F.when(theta < 0, theta + 2 * math.pi).otherwise(theta)
    phi = F.acos(d[2] / F.sqrt(dot(d, d)))
    return cols * theta / (2 * math.pi), rows * F.least(phi, F.lit(fov)) / fov
