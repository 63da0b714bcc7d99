"""Fixed-stride capture files as a Spark data source, their headers, and pixel unpacking."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed values of the file format.
MAGIC, PAGE, HEADER = 0xFACEB00C, 4096, "<8I"
HEADER_FIELDS = ("magic", "ts", "file_index", "file_count", "width", "height", "bpp", "n_cameras")
#: Frames that one task reads.
FRAMES_PER_TASK = 16
#: Headers that one task reads.
FILES_PER_TASK = 64

HEADER_SCHEMA = "file string, magic long, ts timestamp, file_index int, file_count int, width int, height int, bpp int, n_cameras int, file_bytes long"
FRAME_SCHEMA = "file string, frame_no long, camera_ordinal int, serial long, width int, height int, bpp int, payload binary"


def footage_header(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Headers of capture files: ``HEADER_SCHEMA``.  Of each file its first 32 bytes are read, in tasks."""
    spark.dataSource.register(HeaderSource)
    out = spark.read.format("footage_header").load(_joined(paths))
    return out.withColumn("ts", F.timestamp_seconds("ts")).select(*(f.split()[0] for f in HEADER_SCHEMA.split(", ")))


def frame_count(header: DataFrame) -> DataFrame:
    """Adds ``frame_bytes`` and ``n_frames``: whole frames of all cameras after the header page; null where a header tells no size."""
    rows = header.withColumn("frame_bytes", (F.col("width") * F.col("height") * F.col("bpp") / 8).cast("long"))
    return rows.withColumn("n_frames", F.floor((F.col("file_bytes") - PAGE) / F.nullif(F.col("frame_bytes") * F.col("n_cameras"), F.lit(0))))


def validate_footage(header: DataFrame) -> DataFrame:
    """Violations ``(file, rule)``: a wrong magic, or files of one session that do not agree."""
    same = ("ts", "file_count", "width", "height", "bpp")
    facts = header.agg(*(F.count_distinct(c).alias(f"n_{c}") for c in same), F.count(F.lit(1)).alias("n"), F.count_distinct("file_index").alias("n_index"))
    rows = header.crossJoin(F.broadcast(facts))
    rules = [F.when(F.col("magic") != MAGIC, "magic"), *(F.when(F.col(f"n_{c}") > 1, c) for c in same), F.when(F.col("n_index") < F.col("n"), "file_index"), F.when(F.col("file_count") != F.col("n"), "missing_file")]
    return rows.select("file", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"))


def _joined(paths: str | list[str]) -> str:
    return ",".join([paths] if isinstance(paths, str) else paths)


def file_system(path: str):
    """File system of a path and the path within it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def list_files(pattern: str) -> list[tuple[str, int]]:
    """Files and their sizes; the last part of a path may hold wildcards.  A folder stands for its files."""
    import fnmatch

    from pyarrow import fs

    system, path = file_system(pattern)
    prefix = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    folder, _, last = path.rpartition("/")
    if not any(c in last for c in "*?["):
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(pattern, info.size)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(pattern)
        folder, last = path, "*"
    found = system.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, last))


def read_range(path: str, offset: int, size: int) -> bytes:
    """A part of a file; nothing else of it is asked for."""
    system, name = file_system(path)
    with system.open_input_file(name) as f:
        return f.read_at(size, offset)


def read_head(path: str) -> tuple:
    raw = read_range(path, 0, struct.calcsize(HEADER))
    if len(raw) < struct.calcsize(HEADER) or (head := struct.unpack(HEADER, raw))[0] != MAGIC:
        raise ValueError(f"{path}: not a capture file")
    return head


def whole_frames(head: tuple, file_bytes: int) -> int:
    """Frames of which all cameras are in the file."""
    size = head[4] * head[5] * head[6] // 8 * head[7]
    return max(file_bytes - PAGE, 0) // size if size else 0


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        files = [f for p in self.paths for f in list_files(p)]
        return [_Files(files[at : at + FILES_PER_TASK]) for at in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, part: _Files) -> Iterator[tuple]:
        for file, size in part.files:
            raw = read_range(file, 0, struct.calcsize(HEADER))
            yield file, *struct.unpack(HEADER, raw.ljust(struct.calcsize(HEADER), b"\0")), size


class HeaderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "footage_header"

    def schema(self) -> str:
        return HEADER_SCHEMA.replace("ts timestamp", "ts long")

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options)


class _Frames(InputPartition):
    def __init__(self, file: str, first: int, count: int, head: tuple) -> None:
        self.file, self.first, self.count, self.head = file, first, count, head


def _runs(file: str, head: tuple, start: int, end: int) -> list[InputPartition]:
    return [_Frames(file, at, min(FRAMES_PER_TASK, end - at), head) for at in range(start, end, FRAMES_PER_TASK)]


def _frames(part: _Frames) -> Iterator[tuple]:
    """The frames of a run, in one ranged read after another."""
    _, _, _, _, width, height, bpp, cameras = part.head
    size = width * height * bpp // 8
    system, name = file_system(part.file)
    with system.open_input_file(name) as f:
        f.seek(PAGE + part.first * cameras * size)
        for frame in range(part.first, part.first + part.count):
            for camera in range(cameras):
                payload = f.read(size)
                # The first bytes of a payload were overwritten with its size and serial.
                yield part.file, frame, camera, struct.unpack_from("<I", payload, 4)[0], width, height, bpp, payload


class _FootageReader(DataSourceReader):
    """Plans one partition per run of frames; a task seeks to its first frame and reads on."""

    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.start, self.frames = int(options.get("start_frame", 0)), int(options.get("frame_count", 0))

    def partitions(self) -> list[InputPartition]:
        out = []
        for file, size in (f for p in self.paths for f in list_files(p)):
            head = read_head(file)
            there = whole_frames(head, size)
            if self.start and self.start >= there:
                raise ValueError(f"{file}: start frame {self.start} is past the end ({there} frames)")
            out += _runs(file, head, self.start, min(there, self.start + self.frames) if self.frames else there)
        return out

    def read(self, part: _Frames | None) -> Iterator[tuple]:
        # Without partitions Spark asks for one that is None.
        return iter(()) if part is None else _frames(part)


class _FootageStreamReader(DataSourceStreamReader):
    """An offset maps each file, as ``path``, to the frames of it that are complete.

    A batch is what files gained since the last one; its partitions are runs of frames, so a lost
    task reads its run again.  Offsets hold one number a file of a session.
    """

    def __init__(self, options: dict) -> None:
        self.paths, self.heads = options["path"].split(","), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # A file whose first page is not complete yet has no frames.
        return {file: whole_frames(self.head(file), size) for p in self.paths for file, size in list_files(p) if size >= PAGE}

    def head(self, file: str) -> tuple:
        if file not in self.heads:
            self.heads[file] = read_head(file)
        return self.heads[file]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [run for file, there in sorted(end.items()) for run in _runs(file, self.head(file), start.get(file, 0), there)]

    def read(self, part: _Frames) -> Iterator[tuple]:
        return _frames(part)


class FootageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "footage"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FootageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FootageStreamReader(self.options)


def read_footage(spark: SparkSession, paths: str | list[str], start_frame: int = 0, frame_count: int = 0) -> DataFrame:
    """Frames of capture files: ``FRAME_SCHEMA``.

    Paths are local ones, or URIs of any file system that Arrow knows (``file``, ``hdfs``, ``s3``,
    ``gs``), with wildcards in their last part.
    ``frame_count`` 0 reads to the end; more than there are reads what is there; a start past
    the end, and a file without the magic, are errors.
    """
    spark.dataSource.register(FootageSource)
    return spark.read.format("footage").option("start_frame", start_frame).option("frame_count", frame_count).load(_joined(paths))


def stream_footage(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same frames as a stream over files that grow and files that come: each frame once it is complete."""
    spark.dataSource.register(FootageSource)
    return spark.readStream.format("footage").load(_joined(paths))


def unpack_payload(payload: bytes, bpp: int) -> np.ndarray:
    """16-bit pixels of a payload: bytes repeated in both halves, or 12 bits widened."""
    raw = np.frombuffer(payload, np.uint8).astype(np.uint16)
    if bpp == 8:
        return raw * 257
    b = raw[: len(raw) // 3 * 3].reshape(-1, 3)
    two = np.stack([b[:, 0] << 4 | b[:, 1] & 15, b[:, 2] << 4 | b[:, 1] >> 4], 1).reshape(-1)
    return two << 4 | two >> 8


def unpack_pixels(frames: DataFrame) -> DataFrame:
    """``(file, frame_no, serial, y, x, v)``: a row for each pixel, v in 0..65535."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v = unpack_payload(r["payload"], r["bpp"])[: r["width"] * r["height"]]
                n, at = len(v), np.arange(len(v))
                yield pa.RecordBatch.from_pydict({"file": pa.array([r["file"]] * n), "frame_no": np.full(n, r["frame_no"], np.int64), "serial": np.full(n, r["serial"], np.int64), "y": at // r["width"], "x": at % r["width"], "v": v.astype(np.int32)})

    return frames.mapInArrow(run, "file string, frame_no long, serial long, y long, x long, v int")
