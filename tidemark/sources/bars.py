"""Bars: sources in the canonical schema symbol, timeframe, ts, open, high, low, close, volume."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume")

#: The same bars as SQL for DuckDB, from a view ``events``.
EVENT_BARS_SQL = """SELECT event_type AS symbol, 'H1' AS timeframe, date_trunc('hour', ts) AS ts,
 min_by(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
 max_by(value, struct_pack(a := ts, b := event_id)) AS close, CAST(count(*) AS double) AS volume
 FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3"""


def tick_bars(ticks: DataFrame, symbol: str, ts: str, value: str, order: str, unit: str = "hour", timeframe: str = "H1") -> DataFrame:
    """OHLC bars of ticks by wall-clock unit; volume counts ticks. One partial aggregate and one shuffle."""
    at = F.struct(ts, order)
    return (
        ticks.filter(F.col(value).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), F.date_trunc(unit, ts).alias("ts"))
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id", F.col("value").cast("double").alias("value"))
    return tick_bars(events, "event_type", "ts", "value", "event_id")


def read_ohlcv_csv(spark: SparkSession, path: str, symbol: str, timeframe: str = "D1", ts: str | None = None) -> DataFrame:
    """OHLCV from CSV with ``#`` comment lines; columns are found by their names, or by a word of them (``Adj Close``, ``trade_date``).

    open, high, low and close are mandatory; without a volume it is 0. Whole names go before words, and
    earlier columns before later ones. Without a time column the bars are numbered in file order as seconds.
    """
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True)

    def find(*parts: str) -> str | None:
        words = {c: re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", c).lower()) for c in raw.columns}
        whole = (c for p in parts for c in raw.columns if c.strip().lower() == p)
        return next(whole, None) or next((c for p in parts for c in raw.columns if p in words[c]), None)

    names = {k: find(k) for k in ("open", "high", "low", "close")}
    missing = [k for k, v in names.items() if v is None]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    ts = ts or find("datetime", "timestamp", "date", "time", "ts")
    volume = find("volume", "vol")
    if ts is None:
        raw = number_rows(raw, "_row")
    when = F.col(ts).cast("timestamp") if ts else F.timestamp_seconds("_row")
    cols = [F.col(v).cast("double").alias(k) for k, v in names.items()]
    return raw.select(F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), when.alias("ts"), *cols, (F.coalesce(F.col(volume).cast("double"), F.lit(0.0)) if volume else F.lit(0.0)).alias("volume"))


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Adds the number of each row, from 0, in the order of partitions and rows: counts per partition, one row each, are summed and joined back."""
    marked = df.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return marked.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)).drop("_part", "_id", "_before")


def check_unique(bars: DataFrame) -> DataFrame:
    """``bars``, or an error at run time if (symbol, timeframe, ts) repeats."""
    counted = bars.groupBy("symbol", "timeframe", "ts").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in bars.columns if c not in ("symbol", "timeframe", "ts")])
    checked = F.when(F.col("n") == 1, F.col("close")).otherwise(F.raise_error(F.lit("repeated bar")).cast("double"))
    return counted.withColumn("close", checked).select(*bars.columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in all double columns: Spark orders NaN above every number, the engine's missing value is NULL."""
    return df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def resample(bars: DataFrame, every: str, timeframe: str, origin: str = "0 seconds") -> DataFrame:
    """Bars of a longer wall-clock bucket: first open, highest high, lowest low, last close, summed volume.

    A symbol's bars in a bucket must be of one timeframe, for those of two would count twice: else it is an error at run time.
    """
    w = F.window("ts", every, every, origin)
    return (
        bars.groupBy("symbol", w.alias("w"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.min("timeframe").alias("t0"), F.max("timeframe").alias("t1"))
        .withColumn("close", F.when(F.col("t0").eqNullSafe(F.col("t1")), F.col("close")).otherwise(F.raise_error(F.lit("bars of two timeframes in one bucket")).cast("double")))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
