"""Readers and writers of the engine's tables: strict schemas, verified and idempotent writes."""

from __future__ import annotations

import hashlib
import io
import tarfile
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Temporary folders of local sessions without spark.checkpoint.dir, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir; a local
    session without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spanloom-")
        found = _own[app]
    return found.rstrip("/")


def saved(df: DataFrame, name: str = "table", compression: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, *, whole_files: bool = False, strict: bool = True) -> DataFrame:
    """JSON lines, or one document a file.  Strict: a bad row fails the query; else it is kept
    with its text in _corrupt_record."""
    reader = spark.read.option("multiLine", whole_files)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return reader.schema(with_bad).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns strings; a byte order mark in front of the header goes."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))


def discovered(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files in a folder tree, in natural order of their paths."""
    from ..functions.text import natural_key

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy(natural_key(F.col("path")))


def unverified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256) without a file of that hash."""
    return manifest.join(files.select("path", "sha256"), ["path", "sha256"], "left_anti")


def write_new(df: DataFrame, path: str) -> None:
    """Fails if the table exists."""
    df.write.mode("errorifexists").parquet(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write, or check that the table has just these rows; True if it was written."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        write_new(df, path)
        return True
    if not df.exceptAll(there).isEmpty() or not there.exceptAll(df).isEmpty():
        raise ValueError(f"{path} exists with other rows")
    return False


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; undefined numbers (NaN) as empty fields."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    clean = df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats})
    clean.write.option("header", True).csv(path)


def union_of_columns(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of tables with different columns; columns in first-seen order."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def export_jsonl(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.partitionBy(split).json(path)


def markdown_table(df: DataFrame) -> str:
    """A report table of all rows; numbers with four digits, nulls as N/A.  For reports: the
    text is one string on the driver."""
    show = lambda f: F.when(F.col(f.name).isNotNull(), F.format_string("%.4f", f.name)) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast("string")
    text = df.select(*(F.coalesce(show(f), F.lit("N/A")).alias(f.name) for f in df.schema))
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in text.toLocalIterator())])


def export_portable(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines by split, with a manifest of every file's name, length and SHA-256."""
    df.write.partitionBy(split).json(f"{path}/data")
    files = _portable_files(df.sparkSession, path)
    files.coalesce(1).write.option("header", True).csv(f"{path}/manifest")  # a row for each file


def _portable_files(spark: SparkSession, path: str) -> DataFrame:
    found = discovered(spark, f"{path}/data", "*.json")
    return found.withColumn("path", F.regexp_extract("path", r"/data/(.*)$", 1)).select("path", "length", "sha256")


def read_portable(
    spark: SparkSession, path: str, schema: str | T.StructType, key: str, split: str = "split", derived: dict[str, Column] | None = None
) -> DataFrame:
    """The rows of a portable export.  Fails if files are missing, unlisted or changed, if a key is
    there twice or in two splits, or if a column isn't what its expression in ``derived`` gives for the row (null
    equals null): a target that was edited after it was rendered."""
    manifest = read_csv(spark, f"{path}/manifest")
    files = _portable_files(spark, path)
    if not unverified(files, manifest).isEmpty() or not unverified(manifest, files).isEmpty():
        raise ValueError(f"{path}: files don't agree with the manifest")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/data")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: {key} isn't unique")
    if derived:
        edited = (F.max(~F.col(name).eqNullSafe(value)).alias(name) for name, value in derived.items())
        if wrong := [name for name, bad in rows.agg(*edited).first().asDict().items() if bad]:
            raise ValueError(f"{path}: {', '.join(wrong)} isn't what it is derived from")
    return rows


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table in one step: the rows are written as a new version, and then one row in the
    list of versions makes them current.  Readers see the old rows or the new ones, whole."""
    folder = f"{path}/data-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    spark = df.sparkSession
    listed = spark.createDataFrame([(_current(spark, path)[0] + 1, folder)], _VERSIONS)
    listed.coalesce(1).write.mode("append").parquet(f"{path}/versions")


_VERSIONS = "version long, folder string"


def _current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    try:
        versions = spark.read.schema(_VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    return tuple(versions.agg(F.max("version"), F.max_by("folder", "version")).first())


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version that ``replace_table`` made current."""
    folder = _current(spark, path)[1]
    if folder is None:
        raise ValueError(f"{path} has no version")
    return spark.read.parquet(folder)


def tar_archives(members: DataFrame, name: str, content: str, archives: int) -> DataFrame:
    """(archive, content): members packed into tar archives, dealt by the hash of their names, in
    order of names and with no times or owners, so that equal members give equal bytes.  Choose
    ``archives`` so that one fits a task; a binary value has at most 2 GB."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
            for member, data in sorted(zip(pdf["name"], pdf["content"], strict=True)):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"archive": [int(pdf["archive"].iloc[0])], "content": [out.getvalue()]})

    dealt = F.pmod(F.xxhash64(name), F.lit(archives)).alias("archive")
    rows = members.select(dealt, F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.groupBy("archive").applyInPandas(pack, "archive long, content binary")


def tar_members(archives: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """(archive, name, length, sha256, content) of the files in tar archives, a row each, streamed an
    archive at a time; ``archives`` may be such a table or a scan in the binaryFile format.  An
    archive that ends early, or has a member that is no plain file, fails."""
    names = archives.schema[archive].dataType.simpleString()

    def unpack(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for where, data in zip(pdf["a"], pdf["c"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(data), mode="r|") as tar:
                    for member in tar:
                        if not member.isreg():
                            raise ValueError(f"{where}: {member.name} is no plain file")
                        body = tar.extractfile(member).read()
                        if len(body) != member.size:
                            raise ValueError(f"{where}: {member.name} ends early")
                        rows.append((where, member.name, len(body), hashlib.sha256(body).hexdigest(), body))
                yield pd.DataFrame(rows, columns=["archive", "name", "length", "sha256", "content"])

    schema = f"archive {names}, name string, length long, sha256 string, content binary"
    return archives.select(F.col(archive).alias("a"), F.col(content).alias("c")).mapInPandas(unpack, schema)


def tar_faults(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, fault) where members and a manifest (name, length, sha256) disagree: missing, extra,
    repeated, length or sha256."""
    found = members.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("_l"), F.first("sha256").alias("_s"))
    both = found.join(manifest.select("name", "length", "sha256", F.lit(True).alias("_listed")), "name", "full")
    fault = (
        F.when(F.col("n").isNull(), "missing").when(F.col("_listed").isNull(), "extra").when(F.col("n") > 1, "repeated")
        .when(F.col("_l") != F.col("length"), "length").when(F.col("_s") != F.col("sha256"), "sha256")
    )
    return both.select("name", fault.alias("fault")).where("fault is not null")
