"""Statistics and predictions over sensor readings."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.operators.sequence import (
    HOT_ROWS,
    chunked,
    lookup,
    same_key,
    side_by_side,
    with_lookback,
    with_position,
)
from sluiceway.session import pin

# The configured parameters.
BLOCK_SIZE = 5
PROCESS_NOISE = 0.125
SENSOR_NOISE = 0.32
INITIAL_ERROR = 30.0
TRAIN_WINDOW = 10
PREDICT_AHEAD = 10
RETRAIN_EVERY = 300
TRIP_CLASSES = ("BAD", "GOOD", "VERYGOOD", "EXCELLENT")


def approx_distinct(df: DataFrame, field: str, by: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """Estimated distinct values per group, from a mergeable sketch."""
    return distinct_merge(distinct_sketch(df, field, by, lg_k), by)


def distinct_sketch(df: DataFrame, field: str, by: Sequence[str] = (), lg_k: int = 12) -> DataFrame:
    """Partial sketches that can be stored and merged later."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(field, lg_k).alias("sketch"))


def distinct_merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate")
    )


def block_aggregate(
    df: DataFrame,
    aggregates: Sequence[Column],
    size: int = BLOCK_SIZE,
    sensor: str = "taxi_identifier",
    order: Sequence[str] = ("msg_id",),
    partial: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Tumbling count windows of ``size`` readings per sensor.

    An unfinished last block is left out unless ``partial``.
    """
    rows, _ = with_position(df, [sensor], order, hot_rows)
    blocks = (
        rows.withColumn("block", F.floor((F.col("_pos") - 1) / size))
        .groupBy(sensor, "block")
        .agg(F.count("*").alias("_n"), *aggregates)
    )
    return (blocks if partial else blocks.where(F.col("_n") == size)).drop("_n")


def second_moment(df: DataFrame, field: str) -> DataFrame:
    """Sum over distinct values of their squared frequency, exactly."""
    count = F.col("n").cast("decimal(19,0)")
    return (
        df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n"))
        .agg(F.sum(count * count).alias("second_moment"))
    )


class _Gains:
    """Kalman gains depend on the step alone.

    With process noise they settle; the steps before are found as they are asked for. Without it
    they fall for ever, as 1 / (step + 1 + sensor noise / initial error).
    """

    def __init__(self, q: float, r: float, p0: float) -> None:
        self.q, self.r, self.p0, self.p = q, r, p0, p0
        self.steps = array("d")
        self.settled: float | None = None

    def at(self, step: int) -> float:
        if self.q == 0:
            return 1 / (step + 1 + self.r / self.p0) if self.p0 else 0.0
        while self.settled is None and step >= len(self.steps):
            p = self.p + self.q
            gain = p / (p + self.r)
            self.p = p * (1 - gain)
            if gain in self.steps[-2:]:  # the last digit may go to and fro
                self.settled = gain
            else:
                self.steps.append(gain)
        return self.steps[step] if step < len(self.steps) else self.settled

    def constant(self, step: int) -> bool:
        """Whether all gains from ``step`` on are the same."""
        self.at(step)
        return self.settled is not None and step >= len(self.steps)


def _averaged(values, step: int, x: float | None, gains: _Gains) -> list[float]:
    """The same without process noise: with gains 1 / (k + 1 + r / p0), (k + 1 + r / p0) times the estimate is a
    running sum of the readings."""
    values = np.asarray(values, dtype="float64")
    if not len(values):
        return []
    if not gains.p0:  # no doubt about the first reading
        return [float(values[0]) if x is None else x] * len(values)
    prior = gains.r / gains.p0
    sums = values.copy()
    sums[0] = (step + 1 + prior) * values[0] if x is None else (step + prior) * x + values[0]
    return (np.cumsum(sums) / (np.arange(step, step + len(values)) + 1 + prior)).tolist()


def _smooth(values, step: int, x: float | None, gains: _Gains) -> list[float]:
    """Estimates for consecutive readings, of which ``step`` came before."""
    if gains.q == 0:
        return _averaged(values, step, x, gains)
    out: list[float] = []
    n = len(values)
    i = 0
    while i < n and (x is None or not gains.constant(step + i)):
        z = values[i]
        x = z if x is None else x + gains.at(step + i) * (z - x)
        out.append(x)
        i += 1
    if i < n:
        # constant gain from here on: exponential smoothing seeded with x
        rest = pd.Series([x, *values[i:]]).ewm(alpha=gains.settled, adjust=False).mean()
        out.extend(rest.iloc[1:])
    return out


def kalman(
    df: DataFrame,
    field: str,
    sensor: str = "taxi_identifier",
    order: Sequence[str] = ("msg_id",),
    process_noise: float = PROCESS_NOISE,
    sensor_noise: float = SENSOR_NOISE,
    initial_error: float = INITIAL_ERROR,
    output: str = "estimate",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Scalar Kalman filter per sensor in time order, starting at its first reading.

    A row without a reading has the estimate of the row before it, NULL before the first reading. Partitions are streamed in sorted order. A chunk of a hot sensor is an affine
    map of the estimate it starts from, so chunks run in parallel: their maps are
    found first, chained per sensor, and each chunk then starts from its own.
    """
    gains = _Gains(process_noise, sensor_noise, initial_error)
    cut = chunked(df, [sensor], order, hot_rows)
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])
    columns = df.columns
    rows = cut.rows.withColumn("_step", F.lit(0).cast("bigint")).withColumn(
        "_x", F.lit(None).cast("double")
    )
    if cut.hot:
        rows = lookup(cut.rows, pin(_chunk_starts(cut, field, gains)), cut.by, "left").withColumn(
            "_step", F.coalesce("_step", F.lit(0))
        )
    group = ["_chunk", sensor]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, step, x = None, 0, None
        for batch in batches:
            # only what the filter reads becomes pandas; the columns pass as they are
            read = batch.select([*group, "_step", "_x", field]).to_pandas()
            estimates: list[float] = []
            for key, part in read.groupby(group, sort=False, dropna=False):
                if not same_key(key, open_key):
                    open_key, step = key, int(part["_step"].iloc[0])
                    x = None if pd.isna(part["_x"].iloc[0]) else float(part["_x"].iloc[0])
                values = part[field].astype("float64")
                there = values.notna().to_numpy()
                smooth = _smooth(values.to_numpy()[there], step, x, gains)
                carried = np.array([np.nan if x is None else x, *smooth])[np.cumsum(there)]
                estimates.extend(None if np.isnan(c) else c for c in carried.tolist())
                if smooth:
                    step, x = step + len(smooth), smooth[-1]
            out = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(estimates, pa.float64())], names=[*columns, output]
            )

    # always by (sensor, chunk): ordinary sensors have the one chunk -1
    return side_by_side(rows, group, order).mapInArrow(run, schema)


def _chunk_starts(cut, field: str, gains: _Gains) -> DataFrame:
    """(sensor, chunk) -> readings before the chunk and the estimate it starts from."""
    sensor, order = cut.keys[0], list(cut.order)
    kind = cut.rows.schema[sensor].dataType.simpleString()
    earlier = Window.partitionBy(sensor).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    steps = cut.hot_rows.groupBy(sensor, "_chunk").agg(F.count(field).alias("_n")).select(
        sensor, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_step")
    )

    def affine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # estimate after the chunk = keep * estimate before + add
        open_key, step, keep, add = None, 0, 1.0, None
        for frame in frames:
            done = []
            for key, part in frame.groupby([sensor, "_chunk"], sort=False, dropna=False):
                if not same_key(key, open_key):
                    if open_key is not None:
                        done.append((*open_key, keep, add))
                    open_key, step = key, int(part["_step"].iloc[0])
                    keep, add = (0.0, None) if step == 0 else (1.0, 0.0)
                values = part[field].dropna().to_numpy("float64")
                if gains.q == 0 and gains.p0:
                    prior = gains.r / gains.p0
                    keep *= (step + prior) / (step + len(values) + prior) if keep else 0.0
                else:
                    for i in range(len(values)):
                        if keep == 0.0:
                            break
                        keep *= 1 - gains.at(step + i)
                if len(values):
                    add = _smooth(values, step, add, gains)[-1]
                step += len(values)
            if done:
                yield pd.DataFrame(done, columns=[sensor, "_chunk", "keep", "add"])
        if open_key is not None:
            yield pd.DataFrame([(*open_key, keep, add)], columns=[sensor, "_chunk", "keep", "add"])

    steps = pin(steps)
    readings = cut.hot_rows.select(sensor, "_chunk", *[c for c in order if c != sensor], field)
    maps = side_by_side(
        lookup(readings, steps, [sensor, "_chunk"]), [sensor, "_chunk"], order
    ).mapInPandas(affine, f"{sensor} {kind}, _chunk bigint, keep double, add double")

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        # one row per chunk of a sensor, a number bounded by rows / hot_rows
        frame = frame.sort_values("_chunk")
        x, starts = None, []
        for keep, add in zip(frame["keep"], frame["add"]):
            starts.append(x)
            # a chunk before the first reading says nothing
            x = x if pd.isna(add) else add if x is None else keep * x + add
        return frame[[sensor, "_chunk"]].assign(_x=pd.Series(starts, index=frame.index, dtype="float64"))

    starts = maps.groupBy(sensor).applyInPandas(chain, f"{sensor} {kind}, _chunk bigint, _x double")
    return steps.join(starts, [sensor, "_chunk"])


def sliding_regression(
    df: DataFrame,
    field: str,
    sensor: str = "taxi_identifier",
    order: Sequence[str] = ("msg_id",),
    train: int = TRAIN_WINDOW,
    ahead: int = PREDICT_AHEAD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Line through a sensor's last ``train`` readings and its value ``ahead`` steps on.

    NULL until a sensor has two readings, and in rows without one.
    """
    blank = df.where(F.col(field).isNull()).withColumns({c: F.lit(None).cast("double") for c in ("slope", "forecast")})
    rows, by = with_lookback(
        df.where(F.col(field).isNotNull()), [sensor], order, train - 1, hot_rows=hot_rows
    )
    w = Window.partitionBy(*by).orderBy(*order)
    recent = w.rowsBetween(1 - train, 0)
    rows = rows.withColumn("_x", F.row_number().over(w).cast("double"))
    return (
        rows.withColumn("slope", F.regr_slope(field, "_x").over(recent))
        .withColumn(
            "forecast",
            F.avg(field).over(recent)
            + F.col("slope") * (F.col("_x") + ahead - F.avg("_x").over(recent)),
        )
        .where(~F.col("_halo"))
        .drop("_x", "_halo", "_chunk")
        .unionByName(blank)
    )


def train_linear(df: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Least squares from the moment matrix, gathered in one pass."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"),
        LinearRegression(
            featuresCol="_features", labelCol=label, predictionCol="prediction",
            solver="normal", regParam=0.0,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Predictions for every row; NULL where a feature is missing."""
    hidden = ("_features", "_label", "_raw", "_probability")
    assembler = model.stages[0]
    whole = PipelineModel([assembler.copy({assembler.handleInvalid: "keep"}), *model.stages[1:]])
    out = whole.transform(df).drop(*hidden)
    missing = F.lit(False)
    for feature in assembler.getInputCols():
        missing = missing | F.col(feature).isNull() | F.isnan(F.col(feature).cast("double"))
    made = [c for c in out.columns if c not in df.columns]
    return out.withColumns({c: F.when(~missing, F.col(c)) for c in made})


def retrained_regression(
    df: DataFrame,
    features: tuple[str, str],
    label: str,
    position: str = "msg_id",
    every: int = RETRAIN_EVERY,
) -> DataFrame:
    """Predict each block of ``every`` messages with the plane fitted to the block before.

    All blocks are fitted at once from the centred moments of their complete rows. A block whose
    predecessor is missing or degenerate gets NULL.
    """
    a, b = features
    block = F.floor(F.col(position) / every)
    whole = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(label).isNotNull()
    fitted = df.where(whole).groupBy(block.alias("_block")).agg(
        F.covar_pop(a, a).alias("aa"), F.covar_pop(b, b).alias("bb"), F.covar_pop(a, b).alias("ab"),
        F.covar_pop(a, label).alias("ay"), F.covar_pop(b, label).alias("by"),
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(label).alias("my"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    # features on one line leave only rounding
    det = F.when(F.abs(det) > 1e-12 * F.col("aa") * F.col("bb"), det)
    planes = fitted.select(
        (F.col("_block") + 1).alias("_block"),
        F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det).alias("_ca"),
        F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det).alias("_cb"),
        "ma", "mb", "my",
    )
    guess = F.col("my") + F.col("_ca") * (F.col(a) - F.col("ma")) + F.col("_cb") * (F.col(b) - F.col("mb"))
    return (
        df.withColumn("_block", block).join(planes, "_block", "left")
        .withColumn("prediction", guess)
        .drop("_block", "_ca", "_cb", "ma", "mb", "my")
    )


def train_tree(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: Sequence[str] = TRIP_CLASSES,
    depth: int = 5,
) -> PipelineModel:
    """Decision tree; ``class_index`` counts the classes in the given order."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"),
        StringIndexerModel.from_labels(list(classes), inputCol=label, outputCol="_label"),
        DecisionTreeClassifier(
            featuresCol="_features", labelCol="_label", predictionCol="class_index",
            rawPredictionCol="_raw", probabilityCol="_probability", maxDepth=depth, seed=1,
        ),
    ]
    return Pipeline(stages=stages).fit(df)


def _binned(df: DataFrame, features: Sequence[str], bins: int) -> DataFrame:
    """``_bins``: the bin of each feature between the ``_lo`` and ``_hi`` of its block."""
    def place(i: int, feature: str) -> Column:
        lo, hi = F.get("_lo", F.lit(i)), F.get("_hi", F.lit(i))
        at = F.floor((F.col(feature).cast("double") - lo) / (hi - lo) * bins)
        return F.when(hi > lo, F.least(at, F.lit(bins - 1))).otherwise(F.lit(0)).cast("bigint")

    return df.withColumn("_bins", F.array(*[place(i, f) for i, f in enumerate(features)]))


def _descend(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows one level down, where their node is split."""
    went = F.when(F.get("_bins", F.col("_feature")) <= F.col("_bin"), 1).otherwise(2)
    return lookup(rows, splits, ["_block", "_node"], "left").withColumn(
        "_node", F.when(F.col("_feature").isNotNull(), 2 * F.col("_node") + went).otherwise(F.col("_node"))
    ).drop("_feature", "_bin")


def retrained_tree(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classes: Sequence[str] = TRIP_CLASSES,
    position: str = "msg_id",
    every: int = RETRAIN_EVERY,
    depth: int = 2,
    bins: int = 16,
    output: str = "predicted",
) -> DataFrame:
    """Classify each block of ``every`` messages by the decision tree grown from the block before.

    All trees grow at once, a level by a histogram: rows are counted per (block, node, feature, bin) and class, and the
    cut with the least Gini impurity splits the node (ties: first feature, lowest bin), if it lowers it. Bins divide
    the range of the block's complete rows evenly; a leaf is its commonest class (ties: first). Rows without a feature,
    and blocks without a predecessor, get NULL; rows without a known class train nothing.
    """
    whole = F.col(label).isin(*classes)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    block = F.floor(F.col(position) / every)
    # only what the trees read
    rows = df.where(whole).select(block.alias("_block"), F.lit(0).cast("bigint").alias("_node"), F.col(label).alias("_label"), *features)
    ranges = rows.groupBy("_block").agg(
        F.array(*[F.min(F.col(f).cast("double")) for f in features]).alias("_lo"),
        F.array(*[F.max(F.col(f).cast("double")) for f in features]).alias("_hi"),
    )
    rows = _binned(rows.join(ranges, "_block"), features, bins).select("_block", "_node", "_label", "_bins")
    counts = [F.count_if(F.col("_label") == c).alias(f"_n{i}") for i, c in enumerate(classes)]
    names = [f"_n{i}" for i in range(len(classes))]

    def purity(cells: Sequence[Column]) -> Column:
        # the larger, the purer: squares of the counts over their sum
        squares, total = cells[0] * cells[0], cells[0]
        for c in cells[1:]:
            squares, total = squares + c * c, total + c
        return F.try_divide(squares.cast("double"), total.cast("double"))

    levels = []
    for _ in range(depth):
        cells = rows.select("_block", "_node", "_label", F.posexplode("_bins").alias("_feature", "_bin")).groupBy(
            "_block", "_node", "_feature", "_bin"
        ).agg(*counts)
        whole_node = Window.partitionBy("_block", "_node", "_feature")
        so_far = whole_node.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        left = [F.sum(n).over(so_far).alias(f"_l{i}") for i, n in enumerate(names)]
        total = [F.sum(n).over(whole_node).alias(f"_t{i}") for i, n in enumerate(names)]
        cuts = cells.select("_block", "_node", "_feature", "_bin", *left, *total)
        ls = [F.col(f"_l{i}") for i in range(len(classes))]
        ts = [F.col(f"_t{i}") for i in range(len(classes))]
        cuts = cuts.withColumn("_score", purity(ls) + purity([t - x for t, x in zip(ts, ls)])).where(
            F.col("_score") > purity(ts) + 1e-9
        )
        best = cuts.groupBy("_block", "_node").agg(F.max_by(
            F.struct("_feature", "_bin"), F.struct("_score", -F.col("_feature"), -F.col("_bin"))
        ).alias("_cut")).select("_block", "_node", "_cut.*")
        # a level is read by the next level and by the predictions
        levels.append(pin(best))
        rows = _descend(rows, levels[-1])
    most = F.array_max(F.array(*[F.struct(F.col(n).alias("n"), F.lit(-i).alias("first")) for i, n in enumerate(names)]))["first"]
    leaves = rows.groupBy("_block", "_node").agg(*counts).select(
        "_block", "_node", F.get(F.array(*[F.lit(c) for c in classes]), -most).alias(output)
    )
    asked = df.withColumn("_block", block - 1).withColumn("_node", F.lit(0).cast("bigint"))
    asked = _binned(lookup(asked, ranges, "_block", "left"), features, bins)
    for level in levels:
        asked = _descend(asked, level)
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    return lookup(asked, leaves, ["_block", "_node"], "left").withColumn(output, F.when(known, F.col(output))).drop(
        "_block", "_node", "_lo", "_hi", "_bins"
    )


def table_range(
    df: DataFrame, partition: str, value: object, row_key: str, start: int, end: int
) -> DataFrame:
    """Rows of one partition key with a row key in [start, end]; reaches the scan."""
    return df.where((F.col(partition) == value) & F.col(row_key).between(start, end))


def xml_parse(df: DataFrame, schema: str, column: str = "xml") -> DataFrame:
    """XML documents to columns."""
    kept = [c for c in df.columns if c != column]
    return df.withColumn("_doc", F.from_xml(column, schema)).select(*kept, "_doc.*")


def csv_parse(df: DataFrame, schema: T.StructType, column: str = "line") -> DataFrame:
    """CSV lines to typed columns; ``null`` and empty fields are NULL."""
    kept = [c for c in df.columns if c != column]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv(column, ddl, {"nullValue": "null"})
    return df.withColumn("_row", parsed).select(*kept, "_row.*")
