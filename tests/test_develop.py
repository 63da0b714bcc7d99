"""Development of mosaics against a plain version on small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark.functions import scalars as S
from rigspark.plans.isp import develop

ISP = "serial long, black_level array<double>, white_balance array<double>, clamp_min array<double>, clamp_max array<double>, gamma array<double>, sharpening array<double>, low_key array<double>, high_key array<double>, saturation double, contrast double, noise_core double, stuck_threshold int, stuck_radius int, stuck_darkness double, bayer string, ccm array<array<double>>, companding array<array<double>>, vignette_h array<array<double>>, vignette_v array<array<double>>"
ONE = [[float(i == j) for j in range(3)] for i in range(3)]


def setting(serial, **own):
    base = dict(black_level=[0.0] * 3, white_balance=[1.0] * 3, clamp_min=[0.0] * 3, clamp_max=[1.0] * 3, gamma=[1.0] * 3, sharpening=[0.0] * 3, low_key=[0.0] * 3, high_key=[0.0] * 3)
    base |= dict(saturation=1.0, contrast=1.0, noise_core=1000.0, stuck_threshold=0, stuck_radius=0, stuck_darkness=0.0, bayer="GBRG", ccm=ONE, companding=[[0.0] * 3, [1.0] * 3], vignette_h=[[1.0] * 3], vignette_v=[[1.0] * 3])
    return (serial, *(base | own).values())


def developed(spark, image, settings, **how):
    h, w = image.shape
    px = spark.createDataFrame([(1, 0, y, x, float(image[y, x])) for y in range(h) for x in range(w)], "serial long, frame_no long, y long, x long, v double")
    rows = develop(px, spark.createDataFrame(settings, ISP), h, w, **how).collect()
    assert len(rows) == h * w
    out = np.full((h, w, 3), np.nan)
    for r in rows:
        out[r.y, r.x] = r.r, r.g, r.b
    return out


def toned(x, gamma, low, high, contrast):
    x = (math.floor(min(max(x, 0), 1) * 4095) / 4095) ** gamma
    p, t = ([0, 0.1666 + low, 0.3333, 0.5], 2 * x) if x <= 0.5 else ([0.5, 0.6666, 0.8333 + high, 1.0], 2 * x - 1)
    v = sum(math.comb(3, i) * c * t**i * (1 - t) ** (3 - i) for i, c in enumerate(p))
    slope = math.tan(math.pi / 4 * contrast)
    return min(max(slope * v + 0.5 * (1 - slope), 0), 1)


@pytest.mark.parametrize("pattern", sorted(S.BAYER))
def test_flat_color(spark, pattern):
    """A field of one color, in the sensor's own pattern, keeps it through the mosaic."""
    color, at = (0.3, 0.5, 0.7), S.BAYER[pattern]
    image = np.array([[color[at[2 * (y % 2) + x % 2]] for x in range(6)] for y in range(6)])
    ccm = [[1.2, 0.1, -0.1], [-0.1, 0.9, 0.1], [0.05, -0.05, 1.0]]
    got = developed(spark, image, [setting(1, bayer=pattern, ccm=ccm, gamma=[0.8, 1.0, 1.2], low_key=[0.05] * 3, high_key=[-0.04] * 3, contrast=1.1, black_level=[0.1] * 3)])
    sensor = [(c - 0.1) / 0.9 for c in color]
    want = [toned(sum(ccm[j][i] * sensor[j] for j in range(3)), g, 0.05, -0.04, 1.1) for i, g in enumerate((0.8, 1.0, 1.2))]
    assert np.abs(got - want).max() < 2e-3


def test_no_settings(spark):
    image = np.full((4, 4), 0.4)
    got = developed(spark, image, [setting(2, gamma=[3.0] * 3)])
    # The fixed color transforms are no exact inverses: a value may fall into the bin beside.
    assert np.abs(got - toned(0.4, 1, 0, 0, 1)).max() < 1.01 / 4095


def test_stuck_pixel_goes_by_own_settings(spark):
    image = np.full((8, 8), 0.05)
    image[4, 4] = 0.9
    kept = developed(spark, image, [setting(1)], fast=True)
    gone = developed(spark, image, [setting(1, stuck_threshold=1, stuck_radius=1, stuck_darkness=0.3)], fast=True)
    bright = developed(spark, image, [setting(1, stuck_threshold=1, stuck_radius=1, stuck_darkness=0.1)], fast=True)
    assert kept.max() > 0.5 and bright.max() > 0.5 and gone.max() < 0.06


def lowpass(a, alpha):
    """Along the last axis, forward then backward, mirrored by one cell."""
    a, n = a.copy(), a.shape[-1]
    buf, v = np.zeros_like(a), a[..., 0]
    for j in range(1, n + 1):
        v = v * alpha + a[..., j if j < n else n - 2] * (1 - alpha)
        buf[..., j - 1] = v
    out, v = np.zeros_like(a), buf[..., n - 1]
    for j in range(n - 2, -2, -1):
        v = v * alpha + buf[..., j if j >= 0 else 1] * (1 - alpha)
        out[..., j + 1] = v
    return out


def test_sharpening(spark):
    image = np.full((8, 8), 0.3)
    image[:, 4:] = 0.6
    soft = developed(spark, image, [setting(1)])
    got = developed(spark, image, [setting(1, sharpening=[0.5, 0.25, 0.5], noise_core=0.01)])
    for c, amount in enumerate((0.5, 0.25, 0.5)):
        lp = lowpass(lowpass(soft[..., c], 0.25**0.25).T, 0.25**0.25).T
        hp = soft[..., c] - lp
        assert np.abs(got[..., c] - np.clip(lp + hp * (1 - np.exp(-hp * hp * 0.01 * 255**2)) * (1 + amount), 0, 1)).max() < 1e-9
    none = developed(spark, image, [setting(1, sharpening=[0.5, 0.0, 0.5])])
    assert np.abs(none - soft).max() < 1e-12


def test_companding(spark):
    image = np.full((4, 4), 0.25)
    curve = [[0.0, 0.0, 0.0], [0.5, 0.8, 0.0], [1.0, 1.0, 0.0]]
    on, off = (developed(spark, image, [setting(1, companding=curve)], fast=True, companded=c) for c in (True, False))
    assert np.abs(on - toned(0.4, 1, 0, 0, 1)).max() < 1e-3 and np.abs(off - toned(0.25, 1, 0, 0, 1)).max() < 1e-3


def test_curve_of_points(spark):
    points = [(0.0, 0.1), (0.2, 0.5), (0.7, 0.6), (1.0, 1.0)]
    rows = spark.createDataFrame([(v / 10,) for v in range(-5, 16)], "v double").withColumn("p", F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in points)))
    for r in rows.select("v", S.piecewise_curve("v", "p").alias("a"), S.piecewise_linear(F.col("v"), points).alias("b")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-12)
