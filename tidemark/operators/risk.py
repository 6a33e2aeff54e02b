"""Risk and performance of return series, as aggregates by series.

Order statistics and moments are one partial-aggregable pass; the drawdown is a running maximum over the
series' order. Degenerate ratios are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def returns(prices: DataFrame, by: str, order: str, price: str) -> DataFrame:
    """Adds ret, the simple one-period return; NULL on the first row and after a price of zero."""
    before = F.lag(price).over(Window.partitionBy(by).orderBy(order))
    return prices.withColumn("ret", F.when(F.abs(before) > 1e-15, F.col(price) / before - 1))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-15, a / b).otherwise(F.lit(0.0))


def performance(rows: DataFrame, by: str, annualize: int = 252, confidence: float = 0.95, mar: float = 0.0) -> DataFrame:
    """Per series of ret: moments, volatilities, Sharpe, Sortino, omega, tail ratio, value at risk, expected shortfall.

    Historical value at risk is the loss at rank floor((1 - confidence) * n) of the ascending returns, and
    the shortfall the mean loss up to there.
    """
    r = F.col("ret")
    rows = rows.filter(r.isNotNull())
    rank = F.row_number().over(Window.partitionBy(by).orderBy("ret"))
    n = F.count("*").over(Window.partitionBy(by))
    cut = F.floor((1 - confidence) * n + 1e-9)
    ranked = rows.withColumn("at", rank).withColumn("cut", cut)
    scale = float(annualize) ** 0.5
    mean, std = F.avg(r), F.stddev_samp(r)
    down = F.sqrt(F.avg(F.pow(F.least(r - mar, F.lit(0.0)), 2)))
    up = F.sqrt(F.avg(F.pow(F.greatest(r - mar, F.lit(0.0)), 2)))
    gain, loss = F.sum(F.greatest(r - mar, F.lit(0.0))), F.sum(F.greatest(mar - r, F.lit(0.0)))
    return ranked.groupBy(by).agg(
        F.count("*").alias("n"), mean.alias("mean_return"), (std * scale).alias("volatility"), (down * scale).alias("downside_volatility"), (up * scale).alias("upside_volatility"),
        (_ratio(mean - mar, std) * scale).alias("sharpe"), (_ratio(mean - mar, down) * scale).alias("sortino"), _ratio(gain, loss).alias("omega"),
        _ratio(F.abs(F.percentile(r, F.lit(0.95))), F.abs(F.percentile(r, F.lit(0.05)))).alias("tail_ratio"),
        F.skewness(r).alias("skewness"), F.kurtosis(r).alias("excess_kurtosis"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        (-F.max(F.when(F.col("at") == F.col("cut") + 1, r))).alias("var_historical"),
        (-F.avg(F.when(F.col("at") <= F.greatest(F.col("cut"), F.lit(1)), r))).alias("cvar"),
    )


def drawdowns(prices: DataFrame, by: str, order: str, price: str) -> DataFrame:
    """Per series: the greatest drawdown of a price from its running maximum (positive), and where it ends."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = prices.withColumn("peak", F.max(price).over(so_far)).withColumn("dd", 1 - F.col(price) / F.col("peak"))
    return rows.groupBy(by).agg(F.max("dd").alias("max_drawdown"), F.min_by(order, F.struct((-F.col("dd")).alias("dd"), F.col(order).alias("at"))).alias("trough"))
