"""Fixity of web archives: Merkle trees over records and ordered offset ranges, compared between replicas.

A manifest has a row per record: file, place in it, offset, length and hash. Every ``FAN`` neighbouring records of a file, in the order of
their offsets, form a range whose hash is that of its children's hashes and of the bytes it spans, and so on up to one root per
file. Replicas are compared from the roots down, and only children of ranges that differ are looked at, so the
work after the roots follows the damage and not the archive.

A null url or page counts as empty. Pages with equal ids are records of their own, ordered by what they hold.
An empty table has no files, and no records that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brisa.llm.common import stored
from brisa.llm.ranks import ranked

#: Records in a file, and children of a range.
FILE_RECORDS = 1000
FAN = 16


def record(url: Column, page_id: Column, page: Column) -> Column:
    """A response record as its bytes stand in the file."""
    body = F.coalesce(page, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, *more: str) -> DataFrame:
    """(file, record_no, offset, length, sha256, page_id) of an archive of all pages in the order of their ids.

    ``more`` names columns of the pages that their records carry along.
    """
    whole = record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(whole).cast("long").alias("length"), F.sha2(whole, 256).alias("sha256"), *more)
    placed = ranked(rows.withColumn("archive", F.lit(0)), "archive", ["page_id", "sha256"], "place")
    placed = placed.withColumn("file", F.floor(F.col("place") / FILE_RECORDS)).withColumn(
        "record_no", F.col("place") % FILE_RECORDS
    )
    # A file has a bounded number of records.
    before = Window.partitionBy("file").orderBy("record_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select("file", "record_no", "offset", "length", "sha256", "page_id", *more)


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of (file, node, start, end, hash) from single records up to the roots."""
    leaf = F.sha2(F.concat_ws("|", "offset", "length", "sha256"), 256)
    level = records.select(
        "file", F.col("record_no").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), leaf.alias("hash")
    )
    levels = [stored(level, "merkle")]
    for _ in range(depth):
        children = F.array_sort(F.collect_list(F.struct("node", "start", "end", "hash")))  # FAN at most
        up = levels[-1].groupBy("file", F.floor(F.col("node") / FAN).alias("node")).agg(
            F.min("start").alias("start"), F.max("end").alias("end"), children.alias("children")
        )
        text = F.array_join(F.transform("children", lambda c: F.concat_ws("|", c["node"], c["start"], c["end"], c["hash"])), ";")
        levels.append(stored(up.select("file", "node", "start", "end", F.sha2(text, 256).alias("hash")), "merkle"))
    return levels


def depth_of(*manifests: DataFrame) -> int:
    """Levels above the records so that every file has one root."""
    largest = max((m.agg(F.max("record_no").alias("n")).first()["n"] or 0) for m in manifests)
    depth = 0
    while FAN**depth <= largest:
        depth += 1
    return depth


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, node, status) of the records that differ between two trees, found by descending from the roots."""
    suspects = None
    for mine, other in zip(reversed(ours), reversed(theirs)):
        if suspects is not None:
            parent = [F.col("file") == F.col("_file"), F.floor(F.col("node") / FAN) == F.col("_node")]
            wanted = suspects.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
            mine, other = (level.join(wanted, parent, "left_semi") for level in (mine, other))
        a = mine.select("file", "node", F.col("hash").alias("a"))
        b = other.select("file", "node", F.col("hash").alias("b"))
        both = a.join(b, ["file", "node"], "full").where("NOT (a <=> b)")
        status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unknown").otherwise("changed")
        suspects = stored(both.select("file", "node", status.alias("status")), "suspects")
    return suspects


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records of which a replica differs: (file, record_no, offset, length, page_id, status).

    "changed" records have other bytes or another place in the replica, "missing" ones are not there, and
    "unknown" ones are only there.
    """
    depth = depth_of(primary, replica)
    found = differing(tree(primary, depth), tree(replica, depth)).withColumnRenamed("node", "record_no")
    known = primary.unionByName(replica.join(primary.select("file", "record_no"), ["file", "record_no"], "left_anti"))
    return found.join(known, ["file", "record_no"]).select("file", "record_no", "offset", "length", "page_id", "status")
