"""Panel studies over (date, asset, factor, price): forward returns, buckets, information coefficients, turnover, portfolios.

Every step is a window or an aggregate by date or by asset; horizons are counted in the panel's own
dates, so an asset that misses the exact date has no return. Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dated(panel: DataFrame) -> DataFrame:
    """Adds d, the number of the date among the panel's dates (a table of one row a date, small enough to number in one task)."""
    dates = panel.select("date").distinct().withColumn("d", F.row_number().over(Window.orderBy("date")))
    return panel.join(dates, "date")


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE arithmetic has it: infinity or NaN where b is 0, for Spark's own division gives NULL or an error there."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def forward_returns(panel: DataFrame, horizons: tuple[int, ...], ieee: bool = False) -> DataFrame:
    """Adds fwd_<h>: price h dates later over price, less 1. One window over the asset's dates.

    A price of 0 has no return, or with ``ieee`` the infinity or NaN of the plain division.
    """
    by = Window.partitionBy("asset").orderBy("d")
    out = panel
    for h in horizons:
        later = F.max("price").over(by.rangeBetween(h, h))
        value = ratio(later, F.col("price")) - 1 if ieee else F.when(F.abs("price") > 1e-15, later / F.col("price") - 1)
        out = out.withColumn(f"fwd_{h}", value)
    return out


def average_rank(x: Column | str, *by: str) -> Column:
    """Rank with ties averaged among the non-NULL values of a group, from 1."""
    x = F.col(x) if isinstance(x, str) else x
    whole = Window.partitionBy(*by, x.isNull())
    return F.when(x.isNotNull(), F.rank().over(whole.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2)


def percentile_rank(x: str, *by: str) -> Column:
    """(average rank - 1) / (n - 1); 0.5 where there is one value."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(F.col(x).isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise((average_rank(x, *by) - 1) / (n - 1)))


def with_quantiles(panel: DataFrame, q: int, factor: str = "factor") -> DataFrame:
    """Adds quantile, 1 to q by percentile rank within the date."""
    ranked = panel.withColumn("pct", percentile_rank(factor, "date"))
    return ranked.withColumn("quantile", F.least(F.floor(F.col("pct") * q) + 1, F.lit(q)).cast("int")).drop("pct")


def correlation(a: str, b: str, least: int = 3, ieee: bool = False) -> Column:
    """Pearson's coefficient as an aggregate; NULL without variance (with ``ieee`` NaN there) or under ``least`` rows. Spark's own fails without variance."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    enough = F.count("*") >= least
    if ieee:
        return F.when(enough, F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / spread))
    return F.when(enough & (F.var_pop(a) > 1e-15) & (F.var_pop(b) > 1e-15), F.covar_pop(a, b) / spread)


def information_coefficients(panel: DataFrame, returns: str, factor: str = "factor", least: int = 3, ieee: bool = False) -> DataFrame:
    """By date: n, ic (Pearson) and rank_ic (Spearman) over rows with both values; see ``correlation`` for dates without variance or of few rows."""
    both = panel.filter(F.col(factor).isNotNull() & F.col(returns).isNotNull())
    ranked = both.withColumn("rx", average_rank(factor, "date")).withColumn("ry", average_rank(returns, "date"))
    ic, rank_ic = correlation(factor, returns, least, ieee), correlation("rx", "ry", least, ieee)
    return ranked.groupBy("date").agg(F.count("*").alias("n"), ic.alias("ic"), rank_ic.alias("rank_ic"))


def ic_summary(ics: DataFrame, ieee: bool = False) -> DataFrame:
    """Mean, sample deviation, ratio and t statistic of the coefficients; without deviation no ratio, or with ``ieee`` that of the plain division."""
    parts = []
    for c in ("ic", "rank_ic"):
        m, s, n = F.avg(c), F.stddev_samp(c), F.count(c)
        ir = ratio(m, s) if ieee else F.when(s > 1e-15, m / s)
        parts += [m.alias(f"{c}_mean"), s.alias(f"{c}_std"), ir.alias(f"{c}_ir"), (ir * F.sqrt(n)).alias(f"{c}_t"), F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_hit")]
    return ics.agg(*parts)


def quantile_returns(panel: DataFrame, returns: str, demean: bool = False) -> DataFrame:
    """Mean forward return by date and quantile, of the date's mean if asked."""
    rows = panel.filter(F.col("quantile").isNotNull() & F.col(returns).isNotNull())
    value = F.col(returns) - (F.avg(returns).over(Window.partitionBy("date")) if demean else F.lit(0.0))
    return rows.withColumn("value", value).groupBy("date", "quantile").agg(F.avg("value").alias("mean_return"), F.count("*").alias("n"))


def quantile_turnover(panel: DataFrame, lag: int = 1) -> DataFrame:
    """By date and quantile: the share of assets that were not in the quantile ``lag`` dates before."""
    by = Window.partitionBy("asset").orderBy("d")
    before = F.max("quantile").over(by.rangeBetween(-lag, -lag))
    rows = panel.withColumn("before", before).filter("quantile is not null")
    fresh = F.avg((~F.coalesce(F.col("before") == F.col("quantile"), F.lit(False))).cast("double"))
    return rows.filter(F.col("d") > lag).groupBy("date", "quantile").agg(fresh.alias("turnover"))


def rank_autocorrelation(panel: DataFrame, lag: int = 1, factor: str = "factor") -> DataFrame:
    """By date: the correlation of ranks with those of ``lag`` dates before, over assets with both."""
    ranked = panel.withColumn("r", average_rank(factor, "date"))
    before = F.max("r").over(Window.partitionBy("asset").orderBy("d").rangeBetween(-lag, -lag))
    both = ranked.withColumn("r0", before).filter("r is not null and r0 is not null")
    return both.groupBy("date").agg(correlation("r", "r0").alias("autocorrelation"))


def factor_weights(panel: DataFrame, factor: str = "factor", group: str | None = None, ieee: bool = False) -> DataFrame:
    """Adds weight: the factor less its mean (by group if given), over the date's gross sum; NULL weighs 0.

    Without a gross sum all weigh 0, or with ``ieee`` the NaN of the plain division.
    """
    by = Window.partitionBy("date", *([group] if group else []))
    centred = F.col(factor) - F.avg(factor).over(by)
    if group:
        own = F.sum(F.abs("centred")).over(by)
        rows = panel.withColumn("centred", centred).withColumn("centred", F.when(own > 1e-15, F.col("centred") / own))
    else:
        rows = panel.withColumn("centred", centred)
    gross = F.sum(F.abs("centred")).over(Window.partitionBy("date"))
    share = ratio(F.col("centred"), gross) if ieee else F.when(gross > 1e-15, F.col("centred") / gross)
    return rows.withColumn("weight", F.coalesce(share, F.lit(0.0))).drop("centred")


def portfolio_returns(panel: DataFrame, returns: str) -> DataFrame:
    """By date: the weighted sum of forward returns."""
    return panel.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce(returns, F.lit(0.0))).alias("portfolio_return"))


def winsorize(panel: DataFrame, column: str, low: float, high: float, *by: str) -> DataFrame:
    """Clamps a column to linear quantiles of its group."""
    bounds = panel.groupBy(*by).agg(F.percentile(column, F.lit(low)).alias("w_lo"), F.percentile(column, F.lit(high)).alias("w_hi"))
    return panel.join(bounds, list(by)).withColumn(column, F.greatest("w_lo", F.least("w_hi", column))).drop("w_lo", "w_hi")


def neutralize(panel: DataFrame, column: str, exposure: str, *by: str) -> DataFrame:
    """Adds residual: a column less its least-squares line on one exposure, by group, with an intercept."""
    w = Window.partitionBy(*by)
    both = F.col(column).isNotNull() & F.col(exposure).isNotNull()
    y, x = F.when(both, F.col(column)), F.when(both, F.col(exposure))
    rows = panel.withColumn("n_y", y).withColumn("n_x", x)
    rows = rows.withColumn("n_my", F.avg("n_y").over(w)).withColumn("n_mx", F.avg("n_x").over(w)).withColumn("n_v", F.var_pop("n_x").over(w)).withColumn("n_c", F.covar_pop("n_y", "n_x").over(w))
    slope = F.when(F.col("n_v") > 1e-15, F.col("n_c") / F.col("n_v")).otherwise(F.lit(0.0))
    return rows.withColumn("residual", F.col("n_y") - F.col("n_my") - slope * (F.col("n_x") - F.col("n_mx"))).drop("n_y", "n_x", "n_my", "n_mx", "n_v", "n_c")
