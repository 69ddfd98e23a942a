"""Replace missing readings by the mean of the sensor's last readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.sequence import HOT_ROWS, with_lookback


def impute_mean(
    df: DataFrame,
    field: str,
    window: int,
    sensor: str = "taxi_identifier",
    order: Sequence[str] = ("msg_id",),
    output: str | None = None,
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Fill ``field`` with the mean of its last ``window`` readings of that sensor.

    A sensor without history stays missing; ``window=0`` switches the operator off.
    ``sizes`` (sensor, rows) saves counting the rows of a costly plan.
    """
    output = output or field
    if window == 0:
        return df.withColumn(output, F.col(field))
    rows, by = with_lookback(
        df, [sensor], order, window, F.col(field).isNotNull(), hot_rows, sizes
    )
    # one shuffle for both windows below, whose partitions differ
    rows = rows.repartition(*by)
    missing = F.col(field).isNull()
    recent = Window.partitionBy(*by, missing).orderBy(*order).rowsBetween(1 - window, 0)
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_mean", F.when(~missing, F.avg(field).over(recent)))
        .withColumn("_mean", F.last("_mean", ignorenulls=True).over(so_far))
        .where(~F.col("_halo"))
        .withColumn(output, F.coalesce(field, "_mean"))
        .drop("_mean", "_halo", "_chunk")
    )
