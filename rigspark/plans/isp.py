"""Raw frames to developed color images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigspark.functions import scalars as S
from rigspark.operators import grid as GD
from rigspark.operators.joins import small

#: Settings of a sensor that has none.
SETTINGS = {"gamma": 1.0, "low_key": 0.0, "high_key": 0.0, "sharpening": 0.0}
SCALARS = {"saturation": 1.0, "contrast": 1.0, "noise_core": 1000.0}


def sensor_values(v: Column, black: float | Column, vignette: Column, gain: float | Column, lo: float | Column, hi: float | Column) -> Column:
    """The steps before the mosaic is resolved: black level, vignette, white balance, clamp and stretch."""
    return S.clamp_stretch(S.white_balance(S.black_level(v, black) * vignette, gain), lo, hi)


def color_and_tone(r: Column, g: Column, b: Column, ccm, saturation: Column, gamma, low_key, high_key, contrast: Column, bins: int = 4096) -> list[Column]:
    """Saturation, color matrix and tone of a pixel, each channel in [0, 1].

    ``ccm(i, j)`` gives the matrix, ``gamma``, ``low_key`` and ``high_key`` one column a channel.
    The tone is read at the bin below the value, as from a table of ``bins`` entries.
    """
    y, u, v = S.rgb_to_yuv(r, g, b)
    rgb = S.yuv_to_rgb(y, u * saturation, v * saturation)
    out = [S.clamp(sum(ccm(i, j) * c for j, c in enumerate(rgb)), 0.0, 1.0) for i in range(3)]
    return [S.tone(F.floor(c * (bins - 1)) / (bins - 1), gamma[i], low_key[i], high_key[i], contrast) for i, c in enumerate(out)]


def _curve(points: Column, t: Column, ch: Column) -> Column:
    """Bezier through the control points of this pixel's channel, of any number."""
    step = lambda acc, _: F.transform(F.sequence(F.lit(1), F.size(acc) - 1), lambda i: F.element_at(acc, i) * (1 - t) + F.element_at(acc, i + 1) * t)
    values = F.transform(points, lambda p: F.get(p, ch))
    return F.element_at(F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), values, step)).otherwise(values), 1)


def develop(pixels: DataFrame, isp: DataFrame, rows: int, cols: int, fast: bool = False, bins: int = 4096, out_bits: int = 8, companded: bool = False) -> DataFrame:
    """Mosaics ``(serial, frame_no, y, x, v)``, v in [0, 1], to ``(serial, frame_no, y, x, r, g, b)``.

    In order: companding curve (only if ``companded``), black level, vignette, white balance, clamp
    and stretch, stuck pixels, demosaic, saturation and color matrix, tone (gamma, key boosts,
    contrast), sharpening with its noise core (not if ``fast``, and only where all three amounts
    are set).  Settings come from ``isp`` by serial; sensors without settings are developed with
    the defaults.  Results are in [0, 1]; the noise core counts in steps of ``out_bits`` output.
    """
    keys, cell = ["serial", "frame_no"], ["serial", "frame_no", "y", "x"]
    settings = small(isp)
    rows_ = pixels.select(*cell, "v").join(settings, "serial", "left").withColumn("bayer", F.coalesce("bayer", F.lit("GBRG")))
    ch = S.bayer_channel("y", "x", F.col("bayer"))
    at = lambda c, default: F.coalesce(F.get(F.col(c), ch), F.lit(default))
    flat, longest = F.array(F.array(*[F.lit(1.0)] * 3)), float(max(rows, cols))
    gain = _curve(F.coalesce("vignette_h", flat), F.col("x") / longest, ch) * _curve(F.coalesce("vignette_v", flat), F.col("y") / longest, ch)
    raw = F.when(F.size("companding") > 1, S.piecewise_curve("v", "companding")).otherwise(F.col("v")) if companded else F.col("v")
    v = sensor_values(raw, at("black_level", 0.0), gain, at("white_balance", 1.0), at("clamp_min", 0.0), at("clamp_max", 1.0))
    stuck = {"__threshold": F.coalesce("stuck_threshold", F.lit(0)), "__radius": 2 * F.coalesce("stuck_radius", F.lit(0)), "__dark": F.coalesce("stuck_darkness", F.lit(0.0))}
    mosaic = rows_.select(*cell, "bayer", v.alias("v"), *(c.alias(n) for n, c in stuck.items()))
    checked = (F.col("__threshold") > 0) & (F.col("__radius") > 0)
    clean = GD.repair_stuck(mosaic.where(checked), keys, F.col("__threshold"), F.col("__dark"), F.col("__radius"))
    mosaic = mosaic.where(~checked).unionByName(clean.select(mosaic.columns)).drop(*stuck)
    rgb = GD.demosaic_bilinear(mosaic, keys, F.col("bayer")).join(settings, "serial", "left")
    of = {c: [F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(default)) for i in range(3)] for c, default in SETTINGS.items()}
    one = {c: F.coalesce(F.col(c), F.lit(default)) for c, default in SCALARS.items()}
    ccm = lambda i, j: F.coalesce(F.col("ccm")[j][i], F.lit(float(i == j)))
    toned = color_and_tone(F.col("r"), F.col("g"), F.col("b"), ccm, one["saturation"], of["gamma"], of["low_key"], of["high_key"], one["contrast"], bins)
    image = rgb.select(*cell, *(c.alias(n) for n, c in zip("rgb", toned, strict=True)), F.array(*of["sharpening"]).alias("__amount"), (one["noise_core"] * (2.0**out_bits - 1) ** 2).alias("__core"))
    if fast:
        return image.drop("__amount", "__core")
    # The channels are rows here, so that one pass along each axis serves all three.
    long = image.select(*cell, "__amount", "__core", F.posexplode(F.array(*"rgb")).alias("ch", "v"))
    low = GD.iir_lowpass(long, [*keys, "ch"], "y", "x", "v", 0.25)
    low = GD.iir_lowpass(low, [*keys, "ch"], "x", "y", "lp", 0.25).select(*cell, "ch", "lp")
    hp = F.col("v") - F.col("lp")
    sharp = S.clamp(F.col("lp") + hp * (1 - F.exp(-hp * hp * F.col("__core"))) * (1 + F.get("__amount", "ch")), 0.0, 1.0)
    long = long.join(low, [*cell, "ch"]).withColumn("v", F.when(F.exists("__amount", lambda a: a == 0), F.col("v")).otherwise(sharp))
    return long.groupBy(*cell).agg(*(F.max(F.when(F.col("ch") == i, F.col("v"))).alias(n) for i, n in enumerate("rgb")))
