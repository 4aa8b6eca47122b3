"""Headers of MP4 files and of NumPy archives, read from bytes in Arrow batches."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """(type, body) of each box; sizes may be 64-bit, or 0 for 'to the end'."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            raise ValueError("a box reaches beyond its parent")
        yield kind, data[at + head : at + size]
        at += size


def inside(data: memoryview, *path: bytes) -> Iterator[memoryview]:
    """Bodies of all boxes with this path of types."""
    if not path:
        yield data
        return
    for kind, body in boxes(data):
        if kind == path[0]:
            yield from inside(body, *path[1:])


def video_header(content: bytes) -> tuple[int, int, int, float] | None:
    """(width, height, frames, seconds) of the first video track; None for broken files."""
    data = memoryview(content)
    try:
        seconds = None
        for body in inside(data, b"moov", b"mvhd"):
            wide = body[0] == 1
            scale, length = struct.unpack_from(">IQ" if wide else ">II", body, 20 if wide else 12)
            seconds = length / scale if scale else None
        for track in inside(data, b"moov", b"trak"):
            handlers = [bytes(b[8:12]) for b in inside(track, b"mdia", b"hdlr")]
            if b"vide" not in handlers:
                continue
            width, height = (struct.unpack(">II", b[-8:]) for b in inside(track, b"tkhd")).__next__()
            tables = [*inside(track, b"mdia", b"minf", b"stbl", b"stsz"), *inside(track, b"mdia", b"minf", b"stbl", b"stz2")]
            (frames,) = struct.unpack_from(">I", tables[0], 8)
            header = (width >> 16, height >> 16, frames)
            return (*header, seconds) if min(header) > 0 else None
    except (ValueError, struct.error, IndexError, StopIteration):
        return None
    return None


def video_headers(spark: SparkSession, folder: str) -> DataFrame:
    """path, width, height, frames and seconds of the MP4 files of a folder tree."""

    @F.pandas_udf("width int, height int, frames int, seconds double")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = [video_header(bytes(c)) or (None,) * 4 for c in content]
        return pd.DataFrame(rows, columns=["width", "height", "frames", "seconds"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(folder)
    return files.select("path", read("content").alias("h")).select("path", "h.*")


def array_shapes(content: bytes) -> list[tuple[str, str]]:
    """(name, shape and type) of the arrays of an .npz archive, without reading their data."""
    from numpy.lib import format as npy

    found = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in archive.namelist():
            with archive.open(name) as f:
                version = npy.read_magic(f)
                read = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
                shape, _, kind = read(f)
                found.append((name.removesuffix(".npy"), f"{'x'.join(map(str, shape))} {kind}"))
    return found
