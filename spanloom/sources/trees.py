"""A data source over directory trees of episodes, and reads of byte ranges.

A tree has a folder for each dataset and in it Parquet files for each episode, as ``dataset=a/episode=7/...`` or
``a/episode_000007.parquet``, or for each range of episodes, as ``dataset=a/episodes=0-4095/...`` with an
``episode`` column in the files (``write_ranges``), which keeps the number of files in line with the rows.  Folders
are listed when the query is planned: filters on ``dataset`` and ``episode`` are pushed into the source, datasets and
ranges that they rule out aren't even listed, and each episode or range that is left is an input partition.  Files are opened by pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.pandas.types import from_arrow_schema

from .media import inside, video_header

_EPISODE = re.compile(r"episode[=_](\d+)(?:\.parquet)?$")
_RANGE = re.compile(r"episodes=(\d+)-(\d+)$")
_RULES = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, StringStartsWith: lambda x, v: x.startswith(v),
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Episode(InputPartition):
    dataset: str
    episode: int | None  # None: a range of episodes, told by the files
    files: tuple[str, ...]

    def __post_init__(self):
        super().__init__((self.dataset, self.episode))


class TreeReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.kept = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the two columns that the tree itself tells stay here, all others are Spark's."""
        for f in filters:
            of_tree = getattr(f, "attribute", None) in (("dataset",), ("episode",))
            if of_tree and isinstance(f, IsNotNull):
                continue  # neither is ever null
            if of_tree and type(f) in _RULES:
                self.kept.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _fits(self, column: str, value) -> bool:
        return all(_RULES[kind](value, limit) for name, kind, limit in self.kept if name == column)

    def _touches(self, low: int, high: int) -> bool:
        """Whether an episode from low to high may fit; rows are checked when they are read."""
        for name, kind, limit in self.kept:
            if name != "episode":
                continue
            if kind is EqualTo and not low <= limit <= high or kind is In and not any(low <= x <= high for x in limit):
                return False
            if kind in (GreaterThan, GreaterThanOrEqual) and not _RULES[kind](high, limit) or kind in (LessThan, LessThanOrEqual) and not _RULES[kind](low, limit):
                return False
        return True

    def partitions(self) -> list[Episode]:
        system, root = opened(self.path)
        found: dict[tuple, list[str]] = {}
        for folder in system.get_file_info(fs.FileSelector(root)):
            dataset = folder.base_name.removeprefix("dataset=")
            if folder.type != fs.FileType.Directory or folder.base_name[:1] in "._" or not self._fits("dataset", dataset):
                continue
            for entry in system.get_file_info(fs.FileSelector(folder.path)):
                ends = _RANGE.search(entry.base_name)
                if ends:
                    if self._touches(int(ends[1]), int(ends[2])):
                        own = system.get_file_info(fs.FileSelector(entry.path))
                        found[dataset, entry.base_name] = [f.path for f in own if f.path.endswith(".parquet")]
                    continue
                match = _EPISODE.search(entry.base_name)
                if not match or not self._fits("episode", int(match[1])):
                    continue
                own = [entry] if entry.type == fs.FileType.File else system.get_file_info(fs.FileSelector(entry.path))
                found.setdefault((dataset, int(match[1])), []).extend(f.path for f in own if f.path.endswith(".parquet"))
        if not found:  # Spark reads a source without partitions with None
            return [Episode("", 0, ())]
        number = lambda e: e if isinstance(e, int) else None
        return [Episode(d, number(e), tuple(sorted(files))) for (d, e), files in sorted(found.items(), key=lambda x: (x[0][0], str(x[0][1]).zfill(40)))]

    def read(self, partition: Episode) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        names = [f.name for f in self.schema if f.name not in ("dataset", "episode")]
        for path in partition.files:
            with pq.ParquetFile(system.open_input_file(path)) as file:
                ranged = partition.episode is None
                for batch in file.iter_batches(columns=[*names, "episode"] if ranged else names):
                    if ranged:
                        fits = [x is not None and self._fits("episode", x) for x in batch.column("episode").to_pylist()]
                        batch = batch.filter(pa.array(fits, pa.bool_()))
                    n = batch.num_rows
                    episode = batch.column("episode").cast(pa.int64()) if ranged else pa.array([partition.episode] * n, pa.int64())
                    columns = {"dataset": pa.array([partition.dataset] * n, pa.string()), "episode": episode}
                    columns |= {c: batch.column(c) for c in names}
                    yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema], names=self.schema.names)


class EpisodeTree(DataSource):
    """Options: ``path``, and ``columns``, a list of the columns to read, separated by commas (else all)."""

    @classmethod
    def name(cls) -> str:
        return "episode_tree"

    def schema(self) -> T.StructType:
        """Two columns from the tree, and those of the first file."""
        first = TreeReader(self.options["path"], T.StructType()).partitions()[0]
        own = T.StructType()
        if first.files:
            system, _ = opened(self.options["path"])
            with system.open_input_file(first.files[0]) as file:
                own = from_arrow_schema(pq.read_schema(file))
                own = T.StructType([f for f in own if f.name != "episode"])  # in the files of a range
        wanted = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else own.names
        return T.StructType([T.StructField("dataset", T.StringType()), T.StructField("episode", T.LongType()), *(own[c] for c in wanted)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TreeReader(self.options["path"], schema)


def write_ranges(rows: DataFrame, path: str, width: int = 4096) -> None:
    """Write rows (dataset, episode, ...) as a tree with a folder for each ``width`` episodes, numbered from 0."""
    low = F.col("episode") - F.col("episode") % width
    rows = rows.withColumn("episodes", F.concat_ws("-", low, low + (width - 1)))
    rows.repartition("dataset", "episodes").write.partitionBy("dataset", "episodes").parquet(path)


def episode_tree(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """The rows of a tree of episodes, with ``dataset`` and ``episode``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpisodeTree)
    reader = spark.read.format("episode_tree").option("path", path)
    return (reader.option("columns", columns) if columns else reader).load()


def catalogue(episodes: DataFrame, finished: DataFrame) -> DataFrame:
    """(dataset, episodes, first_unfinished) of (dataset, episode): the least episode that ``finished`` doesn't
    have, null where none is left."""
    known = finished.select("dataset", "episode").distinct().withColumn("_done", F.lit(True))
    both = episodes.select("dataset", "episode").distinct().join(known, ["dataset", "episode"], "left")
    return both.groupBy("dataset").agg(F.count(F.lit(1)).alias("episodes"), F.min(F.when(F.col("_done").isNull(), F.col("episode"))).alias("first_unfinished"))


#: Largest movie header that is read.
HEADER = 64 << 20


def ranged_header(file, size: int) -> tuple[tuple | None, float | None, int]:
    """(video header, seconds, bytes read) of an MP4 file: the sizes of its top boxes are read in turn, and only
    the movie box as a whole, wherever it stands; samples are skipped."""
    at, taken = 0, 0
    while at + 8 <= size:
        file.seek(at)
        head = file.read(min(16, size - at))
        taken += len(head)
        length, kind, start = int.from_bytes(head[:4]), head[4:8], 8
        if length == 1:
            if len(head) < 16:
                return None, None, taken
            length, start = int.from_bytes(head[8:16]), 16
        length = length or size - at
        if length < start or at + length > size:
            return None, None, taken
        if kind == b"moov":
            if length > HEADER:
                return None, None, taken
            file.seek(at)
            body = file.read(length)
            taken += len(body)
            return video_header(body), _seconds(body), taken
        at += length
    return None, None, taken


def _seconds(movie: bytes) -> float | None:
    try:
        for body in inside(memoryview(movie), b"moov", b"mvhd"):
            wide = body[0] == 1
            scale, length = struct.unpack_from(">IQ" if wide else ">II", body, 20 if wide else 12)
            return length / scale if scale else None
    except (ValueError, struct.error, IndexError):
        return None
    return None


def ranged_video_headers(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, width, height, frames, seconds and bytes_read of the MP4 files of a folder tree; the content
    column isn't read, and of each file only the ranges that hold its headers.  Spark lists no empty files."""

    def read(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                system, where = opened(path)
                with system.open_input_file(where) as file:
                    header, seconds, taken = ranged_header(file, length)
                rows.append((path, length, *(header[:3] if header else (None,) * 3), seconds, taken))
            yield pd.DataFrame(rows, columns=["path", "length", "width", "height", "frames", "seconds", "bytes_read"]).astype({c: "Int32" for c in ("width", "height", "frames")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(folder)
    schema = "path string, length long, width int, height int, frames int, seconds double, bytes_read long"
    return files.select("path", "length").mapInPandas(read, schema)
