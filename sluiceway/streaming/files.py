"""Directories as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def stream_files(
    spark: SparkSession,
    root: str,
    kind: str = "text",
    schema: T.StructType | str | None = None,
    batch_files: int = 10,
    file_filter: str | None = None,
    recurse: bool = True,
    keep_source: bool = True,
    archive: str | None = None,
    max_age: str | None = None,
) -> DataFrame:
    """New files below ``root``, at most ``batch_files`` per trigger, each once.

    The checkpoint remembers what was taken. Sources are kept, deleted after
    their batch, or moved to ``archive``. ``file_filter`` is a glob.
    """
    options = {"maxFilesPerTrigger": batch_files, "recursiveFileLookup": str(recurse).lower()}
    if file_filter:
        options["pathGlobFilter"] = file_filter
    if max_age:
        options["maxFileAge"] = max_age
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    elif not keep_source:
        options["cleanSource"] = "delete"
    reader = spark.readStream.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(root)
