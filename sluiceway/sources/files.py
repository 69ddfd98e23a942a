"""Directories as tables: listings with attributes, contents, batch directories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluiceway.operators.sequence import lookup

# Default name filter and time layout of file attributes.
DEFAULT_FILE_FILTER = r"[^\.].*"
ATTRIBUTE_TIME = "yyyy-MM-dd'T'HH:mm:ssZ"


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def _relative_dir(path: Column, root: str) -> Column:
    """Directory of ``path`` below ``root``, without slashes at its ends."""
    base = urlsplit(root).path.rstrip("/")
    if base.startswith("/"):
        # the root is taken off once, at the start; its name may come again below
        below = F.regexp_replace(path, rf"\A(?:[A-Za-z][\w+.-]*:)?(?://[^/]*)?\Q{base}\E/", "")
    else:
        below = F.substring_index(path, base + "/", -1)
    return F.regexp_replace(below, r"/?[^/]*\z", "")


def scan_files(
    spark: SparkSession,
    root: str,
    file_filter: str = DEFAULT_FILE_FILTER,
    path_filter: str | None = None,
    recurse: bool = True,
    min_size: int = 0,
    max_size: int | None = None,
    min_age_secs: float = 0,
    max_age_secs: float | None = None,
) -> DataFrame:
    """Files below ``root`` that pass the filters, with attributes and content.

    Select only the columns in need: content is not read unless it is used.
    Spark lists neither hidden files (leading ``.`` or ``_``) nor empty ones.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = (
        files.withColumn("filename", F.substring_index("path", "/", -1))
        .withColumn("relative_dir", _relative_dir(F.col("path"), root))
    )
    keep = _matches(F.col("filename"), file_filter) & (F.col("length") >= min_size)
    if max_size is not None:
        keep = keep & (F.col("length") <= max_size)
    if not recurse:
        keep = keep & (F.col("relative_dir") == "")
    elif path_filter is not None:
        keep = keep & ((F.col("relative_dir") == "") | _matches(F.col("relative_dir"), path_filter))
    if min_age_secs or max_age_secs is not None:
        age = F.unix_millis(F.current_timestamp()) - F.unix_millis("modificationTime")
        keep = keep & (age >= int(min_age_secs * 1000))
        if max_age_secs is not None:
            keep = keep & (age <= int(max_age_secs * 1000))
    return files.where(keep)


def file_attributes(files: DataFrame) -> DataFrame:
    """The attributes a file carries into the flow."""
    return files.select(
        "filename",
        F.concat("relative_dir", F.lit("/")).alias("path"),
        F.concat(F.regexp_replace("path", r"[^/]*\z", "")).alias("absolute_path"),
        F.col("length").alias("size"),
        F.date_format("modificationTime", ATTRIBUTE_TIME).alias("last_modified"),
    )


LISTED = "directory string, filename string, path string, length bigint, modification_time timestamp"


def scan_dirs_from_table(
    root: str, directories: DataFrame, column: str = "directory", file_filter: str = DEFAULT_FILE_FILTER
) -> DataFrame:
    """Files that lie directly in a directory below ``root`` that a row of ``directories`` names.

    The tasks list the directories, one at a time; the root is never listed. A directory that does not exist
    holds no files.
    """
    keep = re.compile(rf"(?:{file_filter})\Z").match

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for directory in batch["directory"].to_pylist():
                where = f"{base}/{directory.strip('/')}".rstrip("/")
                found = [
                    i for i in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if i.is_file and keep(i.base_name)
                ]
                yield pa.RecordBatch.from_arrays([
                    pa.array([directory] * len(found), pa.string()), pa.array([i.base_name for i in found], pa.string()),
                    pa.array([i.path for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()),
                    pa.array([i.mtime for i in found], pa.timestamp("us", "UTC")),
                ], ["directory", "filename", "path", "length", "modification_time"])

    wanted = directories.select(F.col(column).alias("directory")).dropna().distinct()
    return wanted.mapInArrow(listed, LISTED)


def blob_download(root: str, names: DataFrame, column: str = "filename", slice_bytes: int = 8 << 20) -> DataFrame:
    """(filename, position, content) of the files below ``root`` that a row of ``names`` names, in slices.

    The tasks open the files by name; nothing is listed. A repeated name counts once, a file that does not exist has
    no row, an empty one has one.
    """
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch["filename"].to_pylist():
                info = fs.get_file_info(f"{base}/{name}")
                if not info.is_file:
                    continue
                with fs.open_input_stream(info.path) as file:
                    at, content = 0, file.read(slice_bytes)
                    while content or not at:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name]), pa.array([at], pa.int64()), pa.array([content], pa.binary())],
                            ["filename", "position", "content"],
                        )
                        if not content:
                            break
                        at, content = at + len(content), file.read(slice_bytes)

    wanted = names.select(F.col(column).alias("filename")).dropna().distinct()
    return wanted.mapInArrow(opened, "filename string, position bigint, content binary")


def numbered_lines(spark: SparkSession, root: str, value: str = "value") -> DataFrame:
    """(line_no, line) of the text files below ``root``, numbered from 1 through all files in the order of their names.

    Files are read in splits. A line's number is its place in its split after the lines of all splits before it, so
    only a count for each split is ever summed in one place.
    """
    lines = spark.read.text(root).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    # ids grow in the order of reading; the same files are planned the same way twice
    splits = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lookup(lines, splits, ["_file", "_block"]).select(
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), F.col("value").alias(value)
    )


def read_dir_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(file name, whole content) of the files below ``root``."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
        .select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))
    )


def read_batch_dirs(
    spark: SparkSession, root: str, requests: DataFrame, batch: str = "batch_id"
) -> DataFrame:
    """Rows of the requested batch directories ``<root>/<batch>=…``.

    The batch is a partition column, so directories nobody asked for are not read.
    """
    return asked_batches(spark.read.parquet(root), requests, batch)


def asked_batches(stored: DataFrame, requests: DataFrame, batch: str) -> DataFrame:
    """Rows of a table partitioned by ``batch`` that belong to a requested batch.

    The range of the requests prunes partitions when the plan is made; being a
    condition on both sides of the join, it also lets Spark prune the partitions
    in between when the requests are known.
    """
    wanted = requests.select(F.col(batch).cast(stored.schema[batch].dataType).alias(batch)).distinct()
    low, high = wanted.agg(F.min(batch), F.max(batch)).first()
    return lookup(stored.where(F.col(batch).between(low, high)), wanted, batch, "left_semi")


def read_batch_table(store: DataFrame, requests: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Stored rows of each requested batch id."""
    return lookup(store, requests.select(batch).distinct(), batch, "left_semi")


def read_jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table behind JDBC; filters on it are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
