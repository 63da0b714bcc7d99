"""Readers and writers of rigs, sensor settings, matches, samples, flow and frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from rigspark.scratch import small

_CAMERA = "struct<version:int,type:string,id:string,group:string,origin:array<double>,forward:array<double>,up:array<double>,right:array<double>,resolution:array<double>,principal:array<double>,focal:array<double>,distortion:array<double>,fov:double>"


def read_rig(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a rig file, in file order, with defaults for what is missing.

    A version below 1, an axis set that is not orthonormal, or a vector of a wrong length is an
    error.
    """
    raw = spark.read.schema(f"cameras array<{_CAMERA}>").json(path, multiLine=True)
    c = raw.select(F.posexplode("cameras").alias("ordinal", "c")).select("ordinal", "c.*").withColumnRenamed("group", "grp")
    dot = lambda a, b: sum((F.col(a)[i] * F.col(b)[i] for i in range(1, 3)), F.col(a)[0] * F.col(b)[0])
    axes = ("right", "up", "forward")
    bad = F.col("version").isNull() | (F.col("version") < 1)
    for i, a in enumerate(axes):
        bad = bad | (F.abs(dot(a, a) - 1) > 1e-6) | (F.size(a) != 3)
        for b in axes[:i]:
            bad = bad | (F.abs(dot(a, b)) > 1e-6)
    half = F.transform("resolution", lambda v: v / 2)
    return c.select(
        F.when(bad, F.raise_error(F.concat(F.lit("bad camera "), "id")).cast("int")).otherwise(F.col("ordinal")).alias("ordinal"),
        "id", F.coalesce("grp", F.lit("")).alias("grp"), "type", "origin", "forward", "up", "right", "focal", "fov",
        F.coalesce("principal", half).alias("principal"), "resolution", F.coalesce("distortion", F.array(F.lit(0.0), F.lit(0.0))).alias("distortion"), "version",
    )


def write_calibration(df: DataFrame, path: str, session: str, defaults: dict[str, Column] | None = None) -> None:
    """Append a calibration table under its session; values equal to their default become null."""
    for c, default in (defaults or {}).items():
        df = df.withColumn(c, F.nullif(F.col(c), default))
    df.withColumn("session", F.lit(session)).write.mode("append").partitionBy("session").parquet(path)


#: What a sensor setting is where its file does not say.
ISP_DEFAULTS = {
    "bits": 8, "black_level": [0.0, 0.0, 0.0], "white_balance": [1.0, 1.0, 1.0], "clamp_min": [0.0, 0.0, 0.0], "clamp_max": [1.0, 1.0, 1.0],
    "gamma": [1.0, 1.0, 1.0], "sharpening": [0.0, 0.0, 0.0], "low_key": [0.0, 0.0, 0.0], "high_key": [0.0, 0.0, 0.0],
    "saturation": 1.0, "contrast": 1.0, "noise_core": 1000.0, "stuck_threshold": 0, "stuck_radius": 0, "stuck_darkness": 0.0, "bayer": "GBRG",
}
_ISP_KEYS = {
    "bits": ("bitsPerPixel", "int"), "black_level": ("blackLevel", "array<double>"), "white_balance": ("whiteBalanceGain", "array<double>"), "clamp_min": ("clampMin", "array<double>"), "clamp_max": ("clampMax", "array<double>"),
    "gamma": ("gamma", "array<double>"), "sharpening": ("sharpening", "array<double>"), "low_key": ("lowKeyBoost", "array<double>"), "high_key": ("highKeyBoost", "array<double>"),
    "saturation": ("saturation", "double"), "contrast": ("contrast", "double"), "noise_core": ("noiseCore", "double"), "stuck_threshold": ("stuckPixelThreshold", "int"), "stuck_radius": ("stuckPixelRadius", "int"), "stuck_darkness": ("stuckPixelDarknessThreshold", "double"), "bayer": ("bayerPattern", "string"),
}


def read_isp_configs(spark: SparkSession, path: str) -> DataFrame:
    """Sensor settings, one file per serial (the number in its name), with defaults.

    A vector that does not have three numbers is an error.
    """
    fields = ",".join(f"{key}:{kind}" for key, kind in _ISP_KEYS.values())
    raw = spark.read.schema(f"CameraIsp struct<{fields},ccm:array<array<double>>,compandingLut:array<array<double>>,vignetteRollOffH:array<array<double>>,vignetteRollOffV:array<array<double>>>").json(path, multiLine=True)
    out = [F.regexp_extract(F.input_file_name(), "([0-9]+)[^/0-9]*$", 1).cast("long").alias("serial")]
    for name, (key, kind) in _ISP_KEYS.items():
        default = ISP_DEFAULTS[name]
        v = F.col(f"CameraIsp.{key}")
        c = F.coalesce(v, F.array(*map(F.lit, default)) if isinstance(default, list) else F.lit(default))
        if kind == "array<double>":
            c = F.when(F.size(c) == 3, c).otherwise(F.raise_error(F.lit(f"{key} needs three numbers")).cast("array<double>"))
        out.append(c.alias(name))
    one = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    flat = F.array(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    curves = {"ccm": ("ccm", one), "companding": ("compandingLut", F.array(F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(1.0)] * 3))), "vignette_h": ("vignetteRollOffH", flat), "vignette_v": ("vignetteRollOffV", flat)}
    return raw.select(*out, *(F.coalesce(F.col(f"CameraIsp.{key}"), default).alias(n) for n, (key, default) in curves.items()))


def read_matches(spark: SparkSession, path: str, cameras: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``keypoints`` and ``matches`` of a match file; images of unknown cameras are skipped.

    An image's camera is its parent folder.
    """
    schema = "images map<string,array<struct<x:double,y:double,scale:double,orientation:double>>>, all_matches array<struct<image1:string,image2:string,matches:array<struct<idx1:int,idx2:int>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    kp = raw.select(F.explode("images").alias("image", "k")).select("image", F.posexplode("k").alias("kp_idx", "k")).select("image", "kp_idx", "k.*")
    m = raw.select(F.explode("all_matches").alias("m")).select(F.col("m.image1").alias("image0"), F.col("m.image2").alias("image1"), F.explode("m.matches").alias("p")).select("image0", F.col("p.idx1").alias("idx0"), "image1", F.col("p.idx2").alias("idx1"))
    if cameras is not None:
        known = small(cameras.select(F.col("id").alias("__id")))
        camera = lambda c: F.element_at(F.split(c, "/"), -2)
        kp = kp.join(known, camera("image") == F.col("__id"), "left_semi")
        for c in ("image0", "image1"):
            m = m.join(known, camera(c) == F.col("__id"), "left_semi")
    return kp, m


#: Fixed value: the modulus that pairs of image ids are packed with.
PAIR_MODULUS = 2147483647


def pair_id(i: Column, j: Column) -> Column:
    """Smaller id times the modulus plus the larger."""
    return F.least(i, j).cast("long") * PAIR_MODULUS + F.greatest(i, j)


def split_pair_id(pair: Column) -> tuple[Column, Column]:
    second = pair % PAIR_MODULUS
    return ((pair - second) / PAIR_MODULUS).cast("long"), second


def features_to_matches(images: DataFrame, keypoints: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keypoints and matches of a feature database: blobs of four floats, of two integers.

    Rows without data are dropped.
    """
    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for image, data in zip(f["image_id"], f["data"], strict=True):
                a = np.frombuffer(bytes(data), "<f4").reshape(-1, 4).astype(float)
                yield pd.DataFrame({"image_id": image, "kp_idx": range(len(a)), "x": a[:, 0], "y": a[:, 1], "scale": a[:, 2], "orientation": a[:, 3]})

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for pair, data in zip(f["pair_id"], f["data"], strict=True):
                a = np.frombuffer(bytes(data), "<u4").reshape(-1, 2).astype(np.int64)
                yield pd.DataFrame({"pair_id": pair, "idx0": a[:, 0], "idx1": a[:, 1]})

    names = small(images.select("image_id", "name"))
    kp = keypoints.where("data is not null").mapInPandas(points, "image_id long, kp_idx int, x double, y double, scale double, orientation double").join(names, "image_id").drop("image_id").withColumnRenamed("name", "image")
    m = matches.where("data is not null").mapInPandas(pairs, "pair_id long, idx0 long, idx1 long")
    i, j = split_pair_id(F.col("pair_id"))
    m = m.withColumn("i", i).withColumn("j", j)
    for side, c in ((0, "i"), (1, "j")):
        m = m.join(names.select(F.col("image_id").alias(c), F.col("name").alias(f"image{side}")), c)
    return kp, m.select("image0", "idx0", "image1", "idx1")


def read_vignette_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image_id string, location array<double>, rgbmedian array<double>").json(path)


def write_vignette_samples(df: DataFrame, path: str) -> None:
    df.select("image_id", "location", "rgbmedian").write.json(path)


def save_flow(df: DataFrame, path: str) -> None:
    """Flow fields by frame, values as floats."""
    df.withColumn("fx", F.col("fx").cast("float")).withColumn("fy", F.col("fy").cast("float")).write.mode("append").partitionBy("frame_no").parquet(path)


def read_flow(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """Flow fields; only the partitions of the frames asked for are read."""
    df = spark.read.parquet(path)
    return df.where(F.col("frame_no").isin(frames)) if frames is not None else df


def camera_and_frame(path: Column) -> tuple[Column, Column]:
    """Camera (the parent folder's name) and frame (the file's name without its ending)."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(path, "([^/]+)/[^/]*$", 1), F.regexp_replace(name, r"\.[^.]*$", "")


def read_images(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Images ``<root>/<camera>/<frame>.<ending>``; hidden and other files are skipped."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    camera, frame = camera_and_frame(F.col("image.origin"))
    rows = raw.select(camera.alias("camera"), frame.alias("frame"), "image.*")
    return rows.where(~F.col("frame").startswith(".") & ~F.col("camera").startswith("."))


def write_frames(df: DataFrame, path: str, frame: str = "frame_no") -> None:
    """Frames below one folder per serial, with a six-digit key."""
    df.withColumn("frame_key", F.lpad(F.col(frame).cast("string"), 6, "0")).write.mode("append").partitionBy("serial").parquet(path)
