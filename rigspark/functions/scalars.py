"""Scalar expressions of the sensor, color, blend and table operators (Column in, Column out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Num = Column | float | int


def _c(v: Num | str) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


# Scalar helpers.
def clamp(v: Num, lo: Num, hi: Num) -> Column:
    return F.least(F.greatest(_c(v), _c(lo)), _c(hi))


def ramp(v: Num, a: Num, b: Num) -> Column:
    """0 up to ``a``, 1 from ``b``, linear between."""
    return clamp((_c(v) - _c(a)) / (_c(b) - _c(a)), 0.0, 1.0)


def reflect(v: Num, n: Num) -> Column:
    """Index outside 0..n-1 mirrored at the border cells."""
    v, n = _c(v), _c(n)
    return F.when(v < 0, -v).when(v >= n, 2 * n - v - 2).otherwise(v)


def wrap(v: Num, n: Num) -> Column:
    """Index one period off brought back into 0..n-1."""
    v, n = _c(v), _c(n)
    return F.when(v < 0, v + n).when(v >= n, v - n).otherwise(v)


def lerp(a: Num, b: Num, t: Num) -> Column:
    return _c(a) * (1 - _c(t)) + _c(b) * _c(t)


def bilerp(v00: Num, v10: Num, v01: Num, v11: Num, tx: Num, ty: Num) -> Column:
    return lerp(lerp(v00, v10, tx), lerp(v01, v11, tx), ty)


def radians_of(deg: Num) -> Column:
    return _c(deg) * (math.pi / 180)


# Sensor values.
def widen8(v: Num) -> Column:
    """8 to 16 bits: the byte stands in both halves."""
    return F.shiftleft(_c(v), 8).bitwiseOR(_c(v))


def unpack12(b0: Num, b1: Num, b2: Num) -> tuple[Column, Column]:
    """Two 12-bit pixels of three bytes, widened to 16 bits by repeating their top bits."""
    first = F.shiftleft(_c(b0), 4).bitwiseOR(_c(b1).bitwiseAND(F.lit(15)))
    second = F.shiftleft(_c(b2), 4).bitwiseOR(F.shiftright(_c(b1), 4))
    wide = lambda v: F.shiftleft(v, 4).bitwiseOR(F.shiftright(v, 8))
    return wide(first), wide(second)


#: Channel at (row even, column even), (even, odd), (odd, even), (odd, odd).
BAYER = {"RGGB": (0, 1, 1, 2), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1), "BGGR": (2, 1, 1, 0)}


def bayer_channel(y: Num, x: Num, pattern: str | Column = "GBRG") -> Column:
    """0 red, 1 green, 2 blue at a pixel of the mosaic; the pattern may differ by row."""
    if isinstance(pattern, Column):
        return F.coalesce(*(F.when(pattern == p, bayer_channel(y, x, p)) for p in BAYER))
    at = BAYER[pattern]
    even = F.when(_c(x) % 2 == 0, at[0]).otherwise(at[1])
    odd = F.when(_c(x) % 2 == 0, at[2]).otherwise(at[3])
    return F.when(_c(y) % 2 == 0, even).otherwise(odd)


def black_level(v: Num, level: Num) -> Column:
    """Subtract and rescale so that 1 stays 1; saturated values are not touched."""
    v, level = _c(v), _c(level)
    return F.when(v < 1.0, (v - level) / (1 - level)).otherwise(v)


def bezier(control: list[float] | list[Column], t: Num) -> Column:
    """Bezier curve of any order as a Bernstein sum."""
    n, t = len(control) - 1, _c(t)
    power = lambda b, k: F.lit(1.0) if k == 0 else F.pow(b, F.lit(float(k)))
    return sum((_c(p) * float(math.comb(n, i)) * power(1 - t, n - i) * power(t, i) for i, p in enumerate(control)), F.lit(0.0))


def vignette_gain(h: list[float], v: list[float], x: Num, y: Num, longest: Num) -> Column:
    """Separable surface over coordinates divided by the longer side."""
    return bezier(h, _c(x) / _c(longest)) * bezier(v, _c(y) / _c(longest))


def white_balance(v: Num, gain: Num, clamped: bool = True) -> Column:
    out = _c(v) * _c(gain)
    return clamp(out, 0.0, 1.0) if clamped else out


def clamp_stretch(v: Num, lo: Num, hi: Num) -> Column:
    return (clamp(v, lo, hi) - _c(lo)) / (_c(hi) - _c(lo))


def piecewise_linear(v: Num, points: list[tuple[float, float]]) -> Column:
    """Linear between the points; the first and the last segment continue outside."""
    v, out = _c(v), None
    segments = list(zip(points, points[1:], strict=False))
    for i, ((x0, y0), (x1, y1)) in enumerate(segments):
        line = F.lit(float(y0)) + (v - float(x0)) * ((y1 - y0) / (x1 - x0))
        if i == len(segments) - 1:
            return line if out is None else out.otherwise(line)
        out = F.when(v < float(x1), line) if out is None else out.when(v < float(x1), line)
    raise ValueError("a curve needs two points")


def piecewise_curve(v: Num, points: Num | str) -> Column:
    """``piecewise_linear`` with the points ``array<array<double>>`` (x, y, ...) of each row."""
    v, points = _c(v), _c(points)
    last = F.size(points) - 1
    # The segment that begins at the last point not above the value, the outer ones continued.
    i = F.greatest(F.least(F.size(F.filter(points, lambda p: p[0] <= v)), last), F.lit(1))
    a, b = F.element_at(points, i), F.element_at(points, i + 1)
    return a[1] + (v - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))


# Color.
#: Color transforms, row by row.
RGB_TO_YUV = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))
YUV_TO_RGB = ((1.0, 0.0, 1.13983), (1.0, -0.39465, -0.58060), (1.0, 2.03211, 0.0))
RGB_TO_DEC = tuple((3**-0.5, b, c) for b, c in ((2**-0.5, 6**-0.5), (0.0, -2 * 6**-0.5), (-(2**-0.5), 6**-0.5)))
#: White points and RGB to XYZ matrices of the two illuminants.
WHITE = {"D50": (0.96422, 1.0, 0.82521), "D65": (0.95047, 1.0, 1.08883)}
RGB_TO_XYZ = {
    "D50": ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733)),
    "D65": ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)),
}


def matrix3(m, r: Num, g: Num, b: Num) -> tuple[Column, Column, Column]:
    return tuple(row[0] * _c(r) + row[1] * _c(g) + row[2] * _c(b) for row in m)


def rgb_to_yuv(r: Num, g: Num, b: Num):
    return matrix3(RGB_TO_YUV, r, g, b)


def yuv_to_rgb(y: Num, u: Num, v: Num):
    return matrix3(YUV_TO_RGB, y, u, v)


def rgb_to_dec(r: Num, g: Num, b: Num):
    return matrix3(RGB_TO_DEC, r, g, b)


def to_lab(r: Num, g: Num, b: Num, illuminant: str = "D50") -> tuple[Column, Column, Column]:
    def curve(x: Column) -> Column:
        return F.when(x > 0.008856, F.pow(x, F.lit(1 / 3))).otherwise(7.787 * x + 16 / 116)

    scaled = tuple(tuple(v / w for v in row) for row, w in zip(RGB_TO_XYZ[illuminant], WHITE[illuminant], strict=True))
    x, y, z = (curve(v) for v in matrix3(scaled, r, g, b))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def color_matrix(ccm, saturation: float, scale: float = 1.0):
    """Color correction, saturation and table scale folded into one matrix on the driver."""
    import numpy as np

    sat = np.array(YUV_TO_RGB) @ np.diag([1, saturation, saturation]) @ np.array(RGB_TO_YUV)
    return (np.array(ccm, float).T @ sat * scale).tolist()


def color_correct(r: Num, g: Num, b: Num, ccm, saturation: float, bins: int = 4096) -> tuple[Column, Column, Column]:
    """Bins of the tone table: the matrix row times the pixel, clamped and truncated."""
    return tuple(clamp(v, 0.0, float(bins - 1)).cast("int") for v in matrix3(color_matrix(ccm, saturation, bins - 1), r, g, b))


def apply_color_params(r: Num, g: Num, b: Num, black: list[float], illumination: Num, m, illuminant: str = "D50"):
    """Linear color model: black level, illumination, 3 x 3 matrix, then Lab."""
    lit = [(_c(v) - k) / (1 - k) * _c(illumination) for v, k in zip((r, g, b), black, strict=True)]
    return to_lab(*matrix3(m, *lit), illuminant)


def clamped_flag(v: Num, lo: Num = 0, hi: Num = 255) -> Column:
    return F.when(_c(v) <= _c(lo), "low").when(_c(v) >= _c(hi), "high").otherwise("normal")


def flow_polar(fx: Num, fy: Num) -> dict[str, Column]:
    """Size, hue (degrees from 0) and brightness of a displacement."""
    size = F.sqrt(_c(fx) * _c(fx) + _c(fy) * _c(fy))
    angle = F.degrees(F.atan2(_c(fy), _c(fx)))
    return {"magnitude": size, "hue": F.when(angle < 0, angle + 360).otherwise(angle), "brightness": clamp(size, 0.0, 1.0)}


def normalize_minmax(v: Num, keys: list[str]) -> Column:
    """To [0, 1] over all rows of the keys; one value becomes 0."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(_c(v)).over(w), F.max(_c(v)).over(w)
    return F.when(hi > lo, (_c(v) - lo) / (hi - lo)).otherwise(0.0)


# Masks on (y, x).
def alpha_circle(y: Num, x: Num, rows: Num, cols: Num, radius: Num) -> Column:
    dx, dy = _c(x) - _c(cols) / 2, _c(y) - _c(rows) / 2
    return F.when(F.sqrt(dx * dx + dy * dy) < _c(radius), 1.0).otherwise(0.0)


def alpha_radial(alpha: Num, y: Num, x: Num, rows: Num, cols: Num) -> Column:
    dx, dy = _c(x) - _c(cols) / 2, _c(y) - _c(rows) / 2
    return _c(alpha) * F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / (F.least(_c(rows), _c(cols)) / 2))


def alpha_topdown(alpha: Num, y: Num, rows: Num) -> Column:
    return _c(alpha) * _c(y) / _c(rows)


def alpha_colorkey(alpha: Num, r: Num, g: Num, b: Num, key: tuple[float, float, float]) -> Column:
    return F.when((_c(r) == key[0]) & (_c(g) == key[1]) & (_c(b) == key[2]), 0.0).otherwise(_c(alpha))


def alpha_edge(alpha: Num, y: Num, rows: Num, feather: Num) -> Column:
    """Ramp over the last ``feather`` rows."""
    return _c(alpha) * ramp(_c(rows) - _c(y), 0.0, feather)


# Response curves as tables.
def _bell(x: Column, lo: float, hi: float) -> Column:
    """Two cubic pieces that stand for a Gaussian over [lo, hi]; 1 in the middle, 0 at the ends."""
    scale = 1 / (2 * (math.sqrt(2) * 0.21) ** 2)
    e = math.exp(scale / 4)
    near = (1.0, 0.0, -(-2 * scale + 12 * e - 12) / e, (-4 * scale + 16 * e - 16) / e)
    far = ((2 * scale - 4) / e, -(8 * scale - 24) / e, (10 * scale - 36) / e, -(4 * scale - 16) / e)
    p = F.abs((x - lo) * (2 / (hi - lo)) - 1)
    cubic = lambda k: k[0] + p * (k[1] + p * (k[2] + p * k[3]))
    return F.when(p < 0.5, cubic(near)).when(p < 1.0, cubic(far)).otherwise(0.0)


def curve_table(spark: SparkSession, kind: str, n: int, lo: float, hi: float, **par: float) -> DataFrame:
    """``(bin, x, v)`` of a response curve at n equal steps from lo to hi.

    Kinds: power (p), butterworth (cutoff, order), sinc, bell, scurve (y_lo, y_hi).
    """
    df = spark.range(n).select(F.col("id").alias("bin"), (F.lit(lo) + F.col("id") * ((hi - lo) / (n - 1))).alias("x"))
    x = F.col("x")
    if kind == "power":
        v = F.pow(x, F.lit(par["p"]))
    elif kind == "butterworth":
        v = 1 / (1 + F.pow(x / par["cutoff"], F.lit(2.0 * par["order"])))
    elif kind == "sinc":
        v = F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))
    elif kind == "bell":
        v = _bell(x, lo, hi)
    elif kind == "scurve":
        run = F.sum(_bell(x, lo, hi)).over(Window.orderBy("bin"))
        v = run / F.sum(_bell(x, lo, hi)).over(Window.partitionBy()) * (par["y_hi"] - par["y_lo"]) + par["y_lo"]
    else:
        raise ValueError(kind)
    return df.withColumn("v", v)


def lut_bin(x: Num, n: int, lo: float, hi: float) -> Column:
    """Bin of a value in a table of n entries from lo to hi, truncated and clamped."""
    return clamp(((_c(x) - lo) / (hi - lo) * (n - 1)).cast("int"), 0, n - 1)


def tone(x: Num, gamma: Num = 1.0, low_key: Num = 0.0, high_key: Num = 0.0, contrast: Num = 1.0) -> Column:
    """Tone of a value in [0, 1]: gamma, Bezier boosts of the dark and the bright half, contrast."""
    x, slope = F.pow(_c(x), _c(gamma)), F.tan(_c(contrast) * (math.pi / 4))
    low = bezier([0.0, clamp(_c(low_key) + 0.1666, 0.0, 1.0), 0.3333, 0.5], 2 * x)
    high = bezier([0.5, 0.6666, clamp(_c(high_key) + 0.8333, 0.0, 1.0), 1.0], 2 * (x - 0.5))
    return clamp(slope * F.when(x <= 0.5, low).otherwise(high) + 0.5 * (1 - slope), 0.0, 1.0)


def tone_curve(spark: SparkSession, gamma: float = 1.0, low_key: float = 0.0, high_key: float = 0.0, contrast: float = 1.0, out_bits: int = 8, bins: int = 4096) -> DataFrame:
    """``(bin, v)``: gamma, low and high key Bezier boost, contrast, scaled to the output range."""
    v = tone(F.col("id") / float(bins - 1), gamma, low_key, high_key, contrast)
    return spark.range(bins).select(F.col("id").alias("bin"), (v * (2.0**out_bits - 1)).alias("v"))


# Vectors and names.
def dist_l1(a: Num | str, b: Num | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dist_l2sq(a: Num | str, b: Num | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def path_parts(path: Num | str) -> dict[str, Column]:
    """Parent folder and file name without its ending."""
    name = F.substring_index(_c(path), "/", -1)
    return {"parent": F.regexp_extract(_c(path), "^(.*)/[^/]*$", 1), "stem": F.regexp_replace(name, r"\.[^.]*$", "")}


def first_int(text: Num | str) -> Column:
    """The first run of digits as a number, null without one."""
    return F.nullif(F.regexp_extract(_c(text), "([0-9]+)", 1), F.lit("")).cast("long")


def zero_pad(v: Num | str, width: int = 6) -> Column:
    return F.lpad(_c(v).cast("string"), width, "0")
