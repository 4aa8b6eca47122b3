"""Merkle fixity audit of WARC replicas.

Records are laid out in files by ranges of ids, in order, each with its offset and
length; every replica has a layout of its own.  A leaf hashes the lengths and SHA-256
of an id's records; a node hashes its up to FANOUT children, which are ranges of ids,
with the bytes that they cover.  So a lost record changes only the nodes above it,
though it moves all later ones of its file.  Files have a root each, and a tree over
the files' roots gives the replica's root.  An audit compares the roots and then only
the children of nodes that differ, level by level, down to the records.

Hashing runs in Spark's own functions.  A level is a table FANOUT times smaller
than the one below; only rows of hashes move, never records.

Cases: a null payload is an empty one; a null id counts as -1; rows with the same
id lie next to each other, by their digests, and are compared as a multiset; a record
that one replica lacks is reported as missing or extra; an empty table has no root and
no findings; other columns are ignored; a very long record is hashed whole, by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

FANOUT = 16
#: Ids whose records share a file.
FILE_IDS = 4096
NODE = ("file", "position", "bytes", "hash")


def warc_record(record_id: F.Column, url: F.Column, payload: F.Column) -> F.Column:
    """A WARC/1.0 resource record as text."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        record_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def with_offsets(records: DataFrame) -> DataFrame:
    """(id, length, digest, ...) plus file, position in the file and offset."""
    order = Window.partitionBy("file").orderBy("id", "digest")
    return (
        records.withColumn("file", F.shiftright("id", FILE_IDS.bit_length() - 1))
        .withColumn("position", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    )


def leaves(index: DataFrame, digest: str = "digest") -> DataFrame:
    """A replica's records below its tree: their place and what is hashed of them."""
    return index.select("file", "id", "position", "offset", "length", F.col(digest).alias("digest"))


def _leaf_level(records: DataFrame) -> DataFrame:
    """Level 0 of a replica's tree: a node for each id, at its place in the file's range of ids."""
    held = F.array_sort(F.collect_list(F.concat_ws("|", "length", "digest")))  # one, unless an id repeats
    return (
        records.groupBy("file", F.col("id").bitwiseAND(FILE_IDS - 1).alias("position"))
        .agg(F.sum("length").alias("bytes"), held.alias("held"))
        .select("file", "position", "bytes", F.sha2(F.concat_ws("|", "held"), 256).alias("hash"))
    )


def _above(level: DataFrame) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct("position", "hash")))  # FANOUT at most
    hashes = F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["position"], c["hash"])))
    return (
        level.groupBy("file", F.floor(F.col("position") / FANOUT).alias("position"))
        .agg(F.sum("bytes").alias("bytes"), children.alias("children"))
        .withColumn("hash", F.sha2(F.concat_ws("|", "bytes", hashes), 256))
        .select(*NODE)
    )


def _height(most: int) -> int:
    """Levels above one of positions 0 to ``most`` until one node is left."""
    height = 0
    while most > 0:
        most //= FANOUT
        height += 1
    return height


def tree(records: DataFrame, height: int, first_file: int, files_height: int) -> list[DataFrame]:
    """Saved levels from the leaves to the root; levels above the files' roots have file 0."""
    levels = [saved(_leaf_level(records), "merkle")]
    for _ in range(height):
        levels.append(saved(_above(levels[-1]), "merkle"))
    roots = levels[-1].select(
        F.lit(0).cast("long").alias("file"), (F.col("file") - first_file).alias("position"), "bytes", "hash"
    )
    for _ in range(files_height):
        roots = saved(_above(roots), "merkle")
        levels.append(roots)
    return levels


def _record_findings(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records of ids that differ: equal ones leave, the others are paired within their id."""
    same = Window.partitionBy("file", "id", "length", "digest").orderBy("position")
    left, right = (r.withColumn("copy", F.row_number().over(same)) for r in (one, two))
    equal = ["file", "id", "length", "digest", "copy"]
    rest = Window.partitionBy("file", "id").orderBy("digest", "length", "copy")
    left, right = (
        x.join(y.select(*equal), equal, "left_anti").select(
            "file", "id", F.row_number().over(rest).alias("copy"), F.struct("position", "offset", "length").alias(side)
        )
        for x, y, side in ((left, right, "one"), (right, left, "two"))
    )
    kind = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("changed")
    place = F.coalesce("one", "two")
    return left.join(right, ["file", "id", "copy"], "full_outer").select(
        "file", place["position"].alias("position"), F.col("id").alias("record_id"),
        place["offset"].alias("record_offset"), place["length"].alias("record_length"), kind.alias("kind"),
    )


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records that differ between replicas, and how: changed, missing, extra.

    Places are those in the first replica, for extra records those in the second.
    """
    files = one.select("file").union(two.select("file")).agg(F.min("file"), F.max("file")).first()
    first_file, last_file = files[0] or 0, files[1] or 0
    height, files_height = _height(FILE_IDS - 1), max(1, _height(last_file - first_file))
    left, right = (tree(x, height, first_file, files_height) for x in (one, two))
    suspects = None
    for depth in range(len(left) - 1, -1, -1):
        a, b = left[depth], right[depth]
        if suspects is not None:
            # only the children of nodes that differ are read on
            if depth == height:
                parents = suspects.select(F.col("position").alias("parent"))
                key = [F.floor((F.col("file") - first_file) / FANOUT) == F.col("parent")]
            elif depth > height:
                parents = suspects.select(F.col("position").alias("parent"))
                key = [F.floor(F.col("position") / FANOUT) == F.col("parent")]
            else:
                parents = suspects.select(F.col("file").alias("in_file"), F.col("position").alias("parent"))
                key = [F.col("file") == F.col("in_file"), F.floor(F.col("position") / FANOUT) == F.col("parent")]
            a, b = a.join(parents, key, "left_semi"), b.join(parents, key, "left_semi")
        a = a.select("file", "position", F.col("hash").alias("hash_one"))
        b = b.select("file", "position", F.col("hash").alias("hash_two"))
        suspects = a.join(b, ["file", "position"], "full_outer").where(
            ~F.col("hash_one").eqNullSafe(F.col("hash_two"))
        )
        suspects = saved(suspects, "suspects")
        if suspects.isEmpty():
            break
    ids = suspects.select("file", F.col("position").alias("leaf"))
    key = ["file", "leaf"]
    one, two = (x.withColumn("leaf", F.col("id").bitwiseAND(FILE_IDS - 1)).join(ids, key, "left_semi") for x in (one, two))
    return _record_findings(one, two)


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' archive against a replica with damage of known places.

    In the replica, records with id % 97 = 13 have another last payload byte, and those
    with id % 389 = 7 are gone.  It is a table of records of its own, and its layout and
    hashes come from that table alone.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page_id = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    archive = pages.select(page_id.alias("id"), warc_record(page_id, F.col("url"), F.col("html")).alias("record"))
    damaged = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("\x00\r\n\r\n"))
    replica = archive.where("id % 389 <> 7").select(
        "id", F.when(F.col("id") % 97 == 13, damaged).otherwise(F.col("record")).alias("record")
    )
    one, two = (leaves(_indexed(records)) for records in (archive, saved(replica, "warc-replica")))
    return audit(one, two).select(
        F.col("record_id").alias("page_id"), "file", F.col("record_offset").alias("offset"),
        F.col("record_length").alias("length"), "kind",
    )


def _indexed(records: DataFrame) -> DataFrame:
    """The saved layout of a replica's records (id, record)."""
    index = records.select(
        "id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest")
    )
    return saved(with_offsets(index), "warc-index")


OP2_SQL = """
    with r as (
        select page_id, strlen(concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10),
            'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''),
            chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10),
            coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))) as length
        from pages
    ), o as (
        select page_id, page_id // 4096 as file, length,
            cast(sum(length) over (partition by page_id // 4096 order by page_id) as bigint) - length as "offset"
        from r
    )
    select page_id, file, "offset", length,
        case when page_id % 389 = 7 then 'missing' else 'changed' end as kind
    from o where page_id % 97 = 13 or page_id % 389 = 7
"""
