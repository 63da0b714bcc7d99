import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspark import bindings as B
from rigspark.sources import footage as S
from rigspark.sources import tables as T


def write(path, index, cameras, frames, bpp, width=16, height=8, magic=S.MAGIC):
    rng = np.random.default_rng(index)
    size, out, payloads = width * height * bpp // 8, bytearray(), []
    out += struct.pack(S.HEADER, magic, 1_500_000_000, index, 2, width, height, bpp, cameras) + bytes(S.PAGE - 32)
    for _ in range(frames):
        for c in range(cameras):
            p = bytearray(rng.integers(0, 256, size, np.uint8).tobytes())
            p[:8] = struct.pack("<II", size, 4000 + 10 * index + c)
            payloads.append(bytes(p))
            out += p
    path.write_bytes(out)
    return payloads


@pytest.mark.parametrize("bpp", [8, 12])
def test_footage_round_trip(spark, tmp_path, bpp):
    want = [write(tmp_path / f"{i}.bin", i, n, 4, bpp) for i, n in ((0, 3), (1, 2))]
    got = S.read_footage(spark, str(tmp_path / "*.bin")).orderBy("file", "frame_no", "camera_ordinal").collect()
    assert [bytes(r.payload) for r in got] == want[0] + want[1]
    assert {r.serial for r in got} == {4000, 4001, 4002, 4010, 4011}
    part = S.read_footage(spark, str(tmp_path / "0.bin"), 1, 2).collect()
    assert {r.frame_no for r in part} == {1, 2} and len(part) == 6
    with pytest.raises(Exception, match="past the end"):
        S.read_footage(spark, str(tmp_path / "0.bin"), 9).collect()
    px = S.unpack_pixels(S.read_footage(spark, str(tmp_path / "0.bin"), 0, 1)).where("serial = 4000").orderBy("y", "x").collect()
    assert [r.v for r in px] == S.unpack_payload(want[0][0], bpp).tolist() and len(px) == 128
    head = S.frame_count(S.footage_header(spark, str(tmp_path / "*.bin")))
    assert sorted((r.file_index, r.n_cameras, r.n_frames, r.bpp) for r in head.collect()) == [(0, 3, 4, bpp), (1, 2, 4, bpp)]
    assert S.validate_footage(head).count() == 0


def test_footage_violations(spark, tmp_path):
    write(tmp_path / "0.bin", 0, 1, 1, 8)
    write(tmp_path / "1.bin", 1, 1, 1, 8, width=32, magic=7)
    bad = {(r.file[-5:], r.rule) for r in S.validate_footage(S.footage_header(spark, str(tmp_path / "*.bin"))).collect()}
    assert bad == {("1.bin", "magic"), ("0.bin", "width"), ("1.bin", "width")}
    with pytest.raises(Exception, match="not a capture file"):
        S.read_footage(spark, str(tmp_path / "*.bin")).collect()


def test_header_of_a_large_file(spark, tmp_path):
    """A sparse file of 3 GB, more than one value of a row may hold; a file shorter than a header."""
    write(tmp_path / "0.bin", 0, 2, 1, 8, 1024, 512)
    with open(tmp_path / "0.bin", "r+b") as f:
        f.truncate(3 << 30)
    (tmp_path / "1.bin").write_bytes(b"abc")
    head = S.frame_count(S.footage_header(spark, f"file://{tmp_path}/*.bin")).orderBy("file").collect()
    assert (head[0].file, head[0].file_bytes, head[0].n_frames) == (f"file://{tmp_path}/0.bin", 3 << 30, ((3 << 30) - S.PAGE) // (1 << 20))
    assert head[1].magic != S.MAGIC and head[1].file_bytes == 3 and str(head[0].ts)[:4] == "2017"
    part = S.read_footage(spark, f"file://{tmp_path}/0.bin", 2000, 3)
    assert part.count() == 6 and {r.frame_no for r in part.select("frame_no").collect()} == {2000, 2001, 2002}
    with pytest.raises(Exception, match="none.bin"):
        S.footage_header(spark, str(tmp_path / "none.bin")).collect()
    assert S.footage_header(spark, str(tmp_path / "*.none")).count() == S.read_footage(spark, str(tmp_path / "*.none")).count() == 0


def test_growing_files_stream_each_frame_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = write(tmp_path / "whole", 0, 2, 40, 8)
    whole = (tmp_path / "whole").read_bytes()
    size = 2 * 16 * 8

    def run():
        q = S.stream_footage(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.file[-5:], r.frame_no, r.camera_ordinal, bytes(r.payload)) for r in got)

    # Half of the first page, then three frames and a part, then all and another file.
    (tmp_path / "in" / "0.bin").write_bytes(whole[:2000])
    (tmp_path / "in" / "1.bin").write_bytes(whole[: S.PAGE + size])
    first = [("1.bin", 0, c, want[c]) for c in (0, 1)]
    assert run() == first
    (tmp_path / "in" / "0.bin").write_bytes(whole[: S.PAGE + 3 * size + 50])
    assert run() == [("0.bin", i // 2, i % 2, want[i]) for i in range(6)] + first
    (tmp_path / "in" / "0.bin").write_bytes(whole)
    assert run() == [("0.bin", i // 2, i % 2, p) for i, p in enumerate(want)] + first
    assert run() == [("0.bin", i // 2, i % 2, p) for i, p in enumerate(want)] + first


def test_rig_and_settings(spark, tmp_path):
    cam = {"version": 1, "type": "FTHETA", "id": "c", "origin": [0, 0, 1], "forward": [0, 0, 1], "up": [0, 1, 0], "right": [-1, 0, 0], "resolution": [20, 10], "focal": [5, -5]}
    (tmp_path / "rig.json").write_text(json.dumps({"cameras": [cam, cam | {"id": "d", "fov": 1.5, "distortion": [0.1, 0]}]}))
    a, b = T.read_rig(spark, str(tmp_path / "rig.json")).orderBy("ordinal").collect()
    assert (a.principal, a.distortion, a.fov, a.grp, b.fov, b.distortion) == ([10.0, 5.0], [0.0, 0.0], None, "", 1.5, [0.1, 0.0])
    (tmp_path / "bad.json").write_text(json.dumps({"cameras": [cam | {"up": [0, 1, 1]}]}))
    with pytest.raises(Exception, match="bad camera"):
        T.read_rig(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "isp").mkdir()
    (tmp_path / "isp" / "777.json").write_text(json.dumps({"CameraIsp": {"blackLevel": [1, 2, 3], "saturation": 1.2}}))
    [r] = T.read_isp_configs(spark, str(tmp_path / "isp")).collect()
    assert (r.serial, r.black_level, r.saturation, r.bayer, r.contrast) == (777, [1.0, 2.0, 3.0], 1.2, "GBRG", 1.0)
    T.write_calibration(B.rig(spark), str(tmp_path / "cal"), "s1", {"fov": F.lit(1.61443)})
    assert spark.read.parquet(str(tmp_path / "cal")).where("fov is not null").count() == 0


def test_feature_database_and_matches(spark, tmp_path):
    kp = np.arange(8, dtype="<f4").tobytes()
    images = spark.createDataFrame([(1, "cam1/0.png"), (2, "cam2/0.png")], "image_id long, name string")
    keypoints = spark.createDataFrame([(1, kp), (2, kp), (2, None)], "image_id long, data binary")
    matches = spark.createDataFrame([(1 * T.PAIR_MODULUS + 2, np.array([0, 1, 1, 0], "<u4").tobytes())], "pair_id long, data binary")
    k, m = T.features_to_matches(images, keypoints, matches)
    assert k.count() == 4 and sorted((r.image0, r.idx0, r.image1, r.idx1) for r in m.collect()) == [("cam1/0.png", 0, "cam2/0.png", 1), ("cam1/0.png", 1, "cam2/0.png", 0)]
    (tmp_path / "m.json").write_text(json.dumps({"images": {"a/cam1/0": [{"x": 1, "y": 2, "scale": 3, "orientation": 4}], "a/zz/0": []}, "all_matches": [{"image1": "a/cam1/0", "image2": "a/cam2/0", "matches": [{"idx1": 0, "idx2": 5}]}, {"image1": "a/zz/0", "image2": "a/cam2/0", "matches": [{"idx1": 0, "idx2": 0}]}]}))
    k, m = T.read_matches(spark, str(tmp_path / "m.json"), B.rig(spark))
    assert k.count() == 1 and [(r.idx0, r.idx1) for r in m.collect()] == [(0, 5)]


def test_flow_samples_and_frames(spark, tmp_path):
    flow = spark.createDataFrame([(0, f, 1, 2, 0.5, -0.5) for f in range(3)], "pair_id int, frame_no long, y int, x int, fx double, fy double")
    T.save_flow(flow, str(tmp_path / "flow"))
    assert T.read_flow(spark, str(tmp_path / "flow"), [1]).count() == 1
    s = spark.createDataFrame([("i", [0.1, 0.2], [1.0, 2.0, 3.0])], "image_id string, location array<double>, rgbmedian array<double>")
    T.write_vignette_samples(s, str(tmp_path / "s"))
    assert T.read_vignette_samples(spark, str(tmp_path / "s")).collect() == s.collect()
    T.write_frames(flow.withColumn("serial", F.lit(7)), str(tmp_path / "frames"))
    assert {r.frame_key for r in spark.read.parquet(str(tmp_path / "frames")).collect()} == {"000000", "000001", "000002"}
