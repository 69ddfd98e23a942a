"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
SETTINGS = {
    **STATE_STORE,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "sluiceway", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine, as in tests
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluiceway-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder every executor can reach."""
    return f"{_shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query_id(rows: DataFrame) -> str:
    """The id of the streaming query that hands ``rows`` to ``foreachBatch``.

    It is kept in the query's checkpoint: a restart has the same id, a new checkpoint a new one.
    """
    found = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("not called by a streaming query")
    return found


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Used where two branches of a plan must see the very same rows although the
    rows come from a sampling aggregate; survives the loss of any executor.
    """
    root = _shared_root(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        # only the driver reads this folder; Spark hands the file to the executors
        target = Path(tempfile.mkdtemp(prefix="sluiceway-")) / here.name
        spark.sparkContext.addPyFile(
            shutil.make_archive(str(target), "zip", root_dir=here.parent, base_dir=here.name)
        )
        _shipped.add(app)
