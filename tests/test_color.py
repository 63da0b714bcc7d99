import numpy as np
from pyspark.sql import functions as F

from rigspark.functions.scalars import RGB_TO_XYZ, WHITE
from rigspark.operators import fit as FT
from rigspark.plans import calibration as CAL

MATRIX = np.array([[1.3, -0.15, -0.05], [-0.1, 1.15, 0.05], [0.02, -0.2, 1.4]])
BLACK = np.array([0.03, 0.04, 0.02])


def seen_colors(black, matrix, light):
    """What a sensor with this black level and matrix makes of the chart, under a light for each patch."""
    lab = np.array(CAL.CHART_D50)
    fy = (lab[:, 0] + 16) / 116
    f = np.stack([fy + lab[:, 1] / 500, fy, fy - lab[:, 2] / 200], 1)
    x = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787)
    to_xyz = np.array(RGB_TO_XYZ["D50"]) / np.array(WHITE["D50"])[:, None]
    linear = x @ np.linalg.inv(to_xyz).T @ np.linalg.inv(matrix).T
    return (linear * (1 - black) + black) / light[:, None]


def places():
    return np.array([[i % 6, i // 6] for i in range(24)], float)


def light_of(x, y):
    t, u = places()[:, 0] / 5, places()[:, 1] / 3
    return (FT._bernstein(t) @ np.r_[1.0, x]) * (FT._bernstein(u) @ np.r_[1.0, y])


def test_inverse_of_the_chart_is_exact():
    p = np.r_[BLACK, MATRIX.ravel()]
    assert np.allclose(FT._lab(p, seen_colors(BLACK, MATRIX, np.ones(24)), "D50"), CAL.CHART_D50, atol=1e-8)


def test_light_black_level_and_matrix_are_found_together(spark):
    lights = {1: ([1.05, 1.1, 1.1, 1.2], [1.0, 1.05, 1.1, 1.1]), 2: ([1.0] * 4, [1.0] * 4), 3: ([0.95, 0.9, 0.9, 0.85], [1.05, 1.1, 1.15, 1.25])}
    rows = []
    for cam, (x, y) in lights.items():
        rgb = seen_colors(BLACK * cam / 2, MATRIX + 0.02 * cam * np.eye(3), light_of(x, y))
        rows += [(cam, i, *map(float, (40 + 30 * p[0], 10 + 25 * p[1], *c))) for i, (p, c) in enumerate(zip(places(), rgb))]
    patches = spark.createDataFrame(rows, "cam int, patch int, cx double, cy double, r double, g double, b double")
    ref = CAL.chart_reference(spark).select("patch", F.col("l").alias("l0"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    flat = {r.cam: r for r in FT.fit_color(patches.join(ref, "patch"), ["cam"], steps=8).collect()}
    got = {r.cam: r for r in FT.fit_color(patches.join(ref, "patch"), ["cam"], steps=25, place=("cx", "cy")).collect()}
    for cam, (x, y) in lights.items():
        r = got[cam]
        assert r.error < 0.05 and (cam == 2 or r.error < flat[cam].error / 10)
        assert np.allclose(r.params[:3], BLACK * cam / 2, atol=2e-3)
        assert np.allclose(np.array(r.params[3:]).reshape(3, 3), MATRIX + 0.02 * cam * np.eye(3), atol=0.02)
        surface = (FT._bernstein(places()[:, 0] / 5) @ r.light_x) * (FT._bernstein(places()[:, 1] / 3) @ r.light_y)
        assert np.allclose(surface, light_of(x, y), atol=0.01)
