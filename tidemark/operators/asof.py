"""Time alignment: exact, and as-of the last closed value at or before each time.

The as-of join is a union, one window and a filter: no range join, no pair of rows but those asked for.
A hot key's rows stream through one ordered window; ``bucket`` splits them by time, with the last value
before each bucket carried in from a small table of bucket ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts", bucket: str | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of the same keys and a ts at or before its own.

    Of rows of ``right`` with equal keys and ts the greatest by values counts; a row of NULLs is a value
    like any other. bucket: a unit of date_trunc by which each key's rows are split.
    """
    carried = F.struct(*values)
    r = right.groupBy(*keys, ts).agg(F.max(carried).alias("a_v"))
    part = [*keys]
    le = left.select(*keys, ts, F.struct(*left.columns).alias("a_row"), F.lit(None).cast(r.schema["a_v"].dataType).alias("a_v"), F.lit(1).alias("a_side"))
    re = r.select(*keys, ts, F.lit(None).cast(le.schema["a_row"].dataType).alias("a_row"), "a_v", F.lit(0).alias("a_side"))
    both = le.unionByName(re)
    if bucket:
        both = both.withColumn("a_b", F.date_trunc(bucket, ts))
        part = [*keys, "a_b"]
        ends = both.groupBy(*part).agg(F.max_by("a_v", F.when(F.col("a_v").isNotNull(), F.col(ts))).alias("a_end"))
        before = F.last("a_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("a_b").rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.withColumn("a_before", before).drop("a_end")
        both = both.join(ends, part)
    run = Window.partitionBy(*part).orderBy(ts, "a_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("a_v", ignorenulls=True).over(run)
    filled = both.withColumn("a_got", F.coalesce(last, F.col("a_before")) if bucket else last).filter("a_side = 1")
    return filled.select("a_row.*", *[F.col(f"a_got.{v}").alias(v) for v in values])


def exact(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """``left`` with the ``values`` of the row of ``right`` at the same keys and ts, if there is one."""
    r = right.groupBy(*keys, ts).agg(F.max(F.struct(*values)).alias("a_v")).select(*keys, ts, "a_v.*")
    return left.join(r, [*keys, ts], "left")
