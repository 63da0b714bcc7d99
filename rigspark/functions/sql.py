"""The closed forms as temporary SQL functions, and frames unpacked by a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from rigspark.sources.footage import unpack_payload

#: Parameters and body of each function; bodies are the expressions of ``functions/scalars.py``.
FUNCTIONS = {
    "rig_clamp": ("v double, lo double, hi double", "double", "least(greatest(v, lo), hi)"),
    "rig_ramp": ("v double, a double, b double", "double", "least(greatest((v - a) / (b - a), 0D), 1D)"),
    "rig_reflect": ("v bigint, n bigint", "bigint", "case when v < 0 then -v when v >= n then 2 * n - v - 2 else v end"),
    "rig_wrap": ("v bigint, n bigint", "bigint", "case when v < 0 then v + n when v >= n then v - n else v end"),
    "rig_lerp": ("a double, b double, t double", "double", "a * (1 - t) + b * t"),
    "rig_widen8": ("v int", "int", "shiftleft(v, 8) | v"),
    "rig_black_level": ("v double, level double", "double", "case when v < 1D then (v - level) / (1 - level) else v end"),
    "rig_white_balance": ("v double, gain double", "double", "least(greatest(v * gain, 0D), 1D)"),
    "rig_clamp_stretch": ("v double, lo double, hi double", "double", "(least(greatest(v, lo), hi) - lo) / (hi - lo)"),
    "rig_bezier": (
        "control array<double>, t double",
        "double",
        "element_at(aggregate(sequence(1, greatest(size(control) - 1, 1)), control, (a, i) -> case when size(a) > 1 then transform(sequence(1, size(a) - 1), j -> element_at(a, j) * (1 - t) + element_at(a, j + 1) * t) else a end), 1)",
    ),
    "rig_bayer_channel": (
        "y bigint, x bigint, pattern string",
        "int",
        "case substring(pattern, cast(2 * pmod(y, 2) + pmod(x, 2) + 1 as int), 1) when 'R' then 0 when 'G' then 1 when 'B' then 2 end",
    ),
}


@udtf(returnType="y bigint, x bigint, v int")
class UnpackPixels:
    """A row for each pixel of a frame's payload: ``rig_unpack_pixels(payload, bpp, width, height)``.

    A null payload has no pixels; what a payload holds beyond width times height is not read.
    """

    def eval(self, payload: bytes, bpp: int, width: int, height: int) -> Iterator[tuple[int, int, int]]:
        if payload is None:
            return
        v = unpack_payload(payload, bpp)[: width * height]
        at = np.arange(len(v))
        yield from zip((at // width).tolist(), (at % width).tolist(), v.tolist(), strict=True)


def register(spark: SparkSession) -> list[str]:
    """Make all of them known to this session's SQL; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udtf.register("rig_unpack_pixels", UnpackPixels)
    return [*FUNCTIONS, "rig_unpack_pixels"]
