"""Rolling financial and operational analytics.

Row-frame measures expect one row per entity and day (a price or report series), which the
calendar bounds; for longer series pass ``chunks``, which cuts them into overlapping pieces. Day-frame
measures first add up to one row per key and day, so a busy key costs a map-side sum and not a large
window; ``chunk_days`` cuts what is left into pieces that overlap by the reach of the frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from starwright.operators.indicators import (
    TRADING_DAYS, along, indicators, percent_return, reach, series_window, trailing,
)
from starwright.operators.ordered import Chunks, chunked_ranges


def day_number(date: Column | str) -> Column:
    """Days since 1970-01-01, for range frames."""
    return F.unix_date((F.col(date) if isinstance(date, str) else date).cast("date"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)))


def with_return(df: DataFrame, entity: str, order: str, price: str, name: str = "__ret") -> DataFrame:
    """Fractional return from the row before."""
    return add_return(df, series_window(entity, order), price, name)


def add_return(df: DataFrame, w: WindowSpec, price: str, name: str = "__ret") -> DataFrame:
    return df.withColumn(name, percent_return(F.col(price), F.lag(price, 1).over(w)) / 100)


def along_days(df: DataFrame, by: Sequence[str], date: str,
               calculate: Callable[[DataFrame, WindowSpec], DataFrame],
               days: int, chunk_days: int | None) -> DataFrame:
    """``calculate(df, window)`` with range frames of at most ``days`` days, whole or by chunks of days."""
    if chunk_days is None:
        return calculate(df, Window.partitionBy(*by).orderBy(day_number(date)))
    return chunked_ranges(df, by, day_number(date), calculate, days, max(chunk_days, days))


def sharpe_ratio(df: DataFrame, entity: str, order: str, price: str = "close",
                 risk_free_rate: float = 0.045, window: int = 252,
                 chunks: Chunks | None = None) -> DataFrame:
    """Annualised excess return over annualised deviation of the last rows."""
    def moments(d: DataFrame, w: WindowSpec) -> DataFrame:
        frame = trailing(w, window)
        return add_return(d, w, price).withColumns({
            "__mean": F.avg("__ret").over(frame), "__sd": F.stddev_samp("__ret").over(frame)})

    out = along(df, entity, order, moments, window, chunks)
    sharpe = ratio(F.col("__mean") * TRADING_DAYS - risk_free_rate,
                   F.col("__sd") * math.sqrt(TRADING_DAYS))
    return out.select(entity, order, sharpe.alias("sharpe_ratio"))


def drawdown(df: DataFrame, entity: str, order: str, price: str = "close",
             window: int = 252, chunks: Chunks | None = None) -> DataFrame:
    """Fall from the highest price of the last rows."""
    out = along(df, entity, order, lambda d, w: d.withColumn(
        "peak_price", F.max(price).over(trailing(w, window))), window, chunks)
    return out.select(entity, order, (ratio(F.col(price), F.col("peak_price")) - 1)
                      .alias("drawdown"), "peak_price")


def with_benchmark(df: DataFrame, entity: str, order: str, column: str, benchmark: str,
                   name: str) -> DataFrame:
    """Add the benchmark entity's value of the same day (one row per day)."""
    bench = df.filter(F.col(entity) == benchmark).select(
        F.col(order).alias("__bench_day"), F.col(column).alias(name))
    return df.join(bench, F.col(order) == F.col("__bench_day"), "inner").drop("__bench_day")


def rolling_beta(df: DataFrame, entity: str, order: str, benchmark: str, price: str = "close",
                 window: int = 252, chunks: Chunks | None = None) -> DataFrame:
    """Covariance with the benchmark's return over its variance.

    The frames count days that the benchmark has too, so chunks are cut again after its join.
    """
    returns = along(df, entity, order, lambda d, w: add_return(d, w, price), 1, chunks)
    joined = with_benchmark(returns, entity, order, "__ret", benchmark, "__market")
    market = F.when(F.col("__ret").isNotNull(), F.col("__market"))

    def moments(d: DataFrame, w: WindowSpec) -> DataFrame:
        frame = trailing(w, window)
        return d.withColumns({
            "__cov": F.covar_samp("__ret", "__market").over(frame),
            "__var": F.var_samp(market).over(frame)})

    out = along(joined, entity, order, moments, window, chunks)
    return out.select(entity, order, ratio(F.col("__cov"), F.col("__var")).alias("beta"))


def momentum_score(df: DataFrame, entity: str, order: str, price: str = "close",
                   weights: Mapping[str, float] | None = None,
                   chunks: Chunks | None = None) -> DataFrame:
    """Weighted mix of RSI, MACD and price trend, each brought to -1…1."""
    wt = {"rsi": 0.3, "macd": 0.3, "price_trend": 0.4, **(weights or {})}
    specs = {
        "rsi": {"indicator": "rsi", "period": 14, "source": price},
        "sma_50": {"indicator": "sma", "period": 50, "source": price},
        "ema_12": {"indicator": "ema", "period": 12, "source": price},
        "ema_26": {"indicator": "ema", "period": 26, "source": price},
        "macd": {"indicator": "macd_line"},
    }
    halo = max(reach(name, specs, df.columns) for name in specs)
    out = along(df, entity, order, lambda d, w: indicators(d, specs, w), halo, chunks)

    def clamp(c: Column) -> Column:
        return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))

    out = out.withColumns({
        "rsi_norm": (F.col("rsi") - 50) / 50,
        "macd_norm": clamp(ratio(F.col("macd"), F.col(price)) * 100),
        "price_trend_norm": clamp((ratio(F.col(price), F.col("sma_50")) - 1) * 10),
    })
    score = (F.col("rsi_norm") * wt["rsi"]
             + F.coalesce(F.col("macd_norm"), F.lit(0.0)) * wt["macd"]
             + F.coalesce(F.col("price_trend_norm"), F.lit(0.0)) * wt["price_trend"])
    return out.select(entity, order, score.alias("momentum_score"),
                      "rsi_norm", "macd_norm", "price_trend_norm")


def volatility_regime(df: DataFrame, entity: str, order: str, price: str = "close",
                      short: int = 20, long: int = 60, low: float = 0.8,
                      high: float = 1.2, chunks: Chunks | None = None) -> DataFrame:
    """LOW / NORMAL / HIGH by the ratio of short to long annualised deviation."""
    year = math.sqrt(TRADING_DAYS)

    def deviations(d: DataFrame, w: WindowSpec) -> DataFrame:
        return add_return(d, w, price).withColumns({
            "vol_short_ann": F.stddev_samp("__ret").over(trailing(w, short)) * year,
            "vol_long_ann": F.stddev_samp("__ret").over(trailing(w, long)) * year})

    out = along(df, entity, order, deviations, max(short, long), chunks).withColumn("vol_ratio", ratio(F.col("vol_short_ann"), F.col("vol_long_ann")))
    regime = (F.when(F.col("vol_ratio").isNull(), None)
              .when(F.col("vol_ratio") < low, "LOW")
              .when(F.col("vol_ratio") > high, "HIGH").otherwise("NORMAL"))
    return out.select(entity, order, "vol_short_ann", "vol_long_ann", "vol_ratio",
                      regime.alias("regime"))


def relative_strength(df: DataFrame, entity: str, order: str, benchmark: str,
                      price: str = "close", window: int = 20,
                      chunks: Chunks | None = None) -> DataFrame:
    """Return over the last rows less that of the benchmark."""
    back = along(df, entity, order, lambda d, w: d.withColumn(
        "__cum", ratio(F.col(price), F.lag(price, window).over(w)) - 1), window, chunks)
    joined = with_benchmark(back, entity, order, "__cum", benchmark, "__bench")
    strength = F.col("__cum") - F.col("__bench")
    return joined.select(entity, order, strength.alias("relative_strength"),
                         (strength > 0).alias("outperforming"))


def net_present_value(df: DataFrame, by: Sequence[str], amount: str, date: str,
                      rate: float = 0.05) -> DataFrame:
    """Amounts discounted to the earliest date of the group.

    Amounts are summed per group and day first; the base date then joins on days only.
    """
    daily = df.groupBy(*by, day_number(date).alias("__day")).agg(F.sum(amount).alias("__amt"))
    base = Window.partitionBy(*by)
    aged = daily.withColumn("__age", F.col("__day") - F.min("__day").over(base))
    return aged.groupBy(*by).agg(
        F.sum(F.col("__amt") / F.pow(F.lit(1 + rate), F.col("__age") / 365.0)).alias("npv"))


def spending_velocity(df: DataFrame, by: Sequence[str], amount: str, date: str,
                      windows: Sequence[int] = (30, 90, 365),
                      chunk_days: int | None = None) -> DataFrame:
    """Trailing-day totals per key and day, and the trend of short against long rate."""
    daily = df.groupBy(*by, F.col(date).cast("date").alias("date")).agg(
        F.sum(amount).alias("__amt"))

    def spent(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({
            f"spend_{n}d": F.sum("__amt").over(w.rangeBetween(-(n - 1), 0)) for n in windows})

    short, long = min(windows), max(windows)
    pace = ratio(F.col(f"spend_{short}d") / short, F.col(f"spend_{long}d") / long)
    out = along_days(daily, by, "date", spent, long - 1, chunk_days)
    return out.withColumn("trend", pace - 1).drop("__amt")


def cagr(df: DataFrame, by: Sequence[str], amount: str, date: str) -> DataFrame:
    """Compound annual growth in percent between the first and the last period."""
    periods = df.groupBy(*by, F.col(date).cast("date").alias("__d")).agg(
        F.sum(amount).alias("__amt"))
    ends = periods.groupBy(*by).agg(
        F.min_by("__amt", "__d").alias("__a"), F.max_by("__amt", "__d").alias("__b"),
        (F.datediff(F.max("__d"), F.min("__d")) / 365.25).alias("__years"))
    growth = F.when((F.col("__a") > 0) & (F.col("__b") > 0) & (F.col("__years") > 0),
                    (F.pow(F.col("__b") / F.col("__a"), 1 / F.col("__years")) - 1) * 100)
    return ends.select(*by, growth.alias("cagr_pct"))


def yoy_growth(df: DataFrame, by: Sequence[str], amount: str, year: str) -> DataFrame:
    """Growth on the amount of exactly one year before, per key."""
    yearly = df.groupBy(*by, year).agg(F.sum(amount).alias("amount"))
    w = Window.partitionBy(*by).orderBy(year)
    prior = F.max("amount").over(w.rangeBetween(-1, -1))
    return yearly.withColumn("prior_amount", prior).withColumn(
        "yoy_growth_pct",
        ratio(F.col("amount") - F.col("prior_amount"), F.abs("prior_amount")) * 100)


def budget_variance(df: DataFrame, by: Sequence[str], amount: str, report_type: str,
                    budget: str = "budget", actual: Sequence[str] = ("annual", "quarterly"),
                    ) -> DataFrame:
    """Budgeted against actual amounts of the same key."""
    kind = F.col(report_type)
    sums = df.groupBy(*by).agg(
        F.sum(F.when(kind == budget, F.col(amount)).otherwise(0.0)).alias("budget_amount"),
        F.sum(F.when(kind.isin(*actual), F.col(amount)).otherwise(0.0)).alias("actual_amount"))
    diff = F.col("actual_amount") - F.col("budget_amount")
    return sums.withColumn("variance", diff).withColumn(
        "variance_pct", ratio(F.col("variance"), F.col("budget_amount")) * 100)


def dividend_yield(prices: DataFrame, dividends: DataFrame, entity: str, order: str,
                   price: str = "close", amount: str = "amount", days: int = 365,
                   chunk_days: int | None = None) -> DataFrame:
    """Dividends of the trailing days over the price, per price row."""
    paid = dividends.groupBy(entity, F.col(order).cast("date").alias("__d")).agg(
        F.sum(amount).alias("__paid"))
    both = prices.select(entity, F.col(order).cast("date").alias("__d"),
                         F.col(price).alias("price"), F.lit(True).alias("__is_price"),
                         F.lit(0.0).alias("__paid")).unionByName(
        paid, allowMissingColumns=True)
    out = along_days(both, [entity], "__d", lambda d, w: d.withColumn(
        "trailing_dividends", F.sum("__paid").over(w.rangeBetween(-(days - 1), 0))),
        days - 1, chunk_days).filter("__is_price")
    return out.select(
        entity, F.col("__d").alias(order), "trailing_dividends", "price",
        (ratio(F.col("trailing_dividends"), F.col("price")) * 100).alias("dividend_yield_pct"))


def split_adjusted_return(prices: DataFrame, splits: DataFrame, entity: str, order: str,
                          price: str = "close", factor: str = "split_factor") -> DataFrame:
    """Return since the first row, raw and multiplied by the splits since then."""
    events = splits.groupBy(entity, F.col(order).cast("date").alias("__d")).agg(
        F.sum(F.ln(factor)).alias("__log"))
    both = prices.select(entity, F.col(order).cast("date").alias("__d"),
                         F.col(price).alias("__p"), F.lit(True).alias("__is_price"),
                         F.lit(0.0).alias("__log")).unionByName(events, allowMissingColumns=True)
    w = Window.partitionBy(entity).orderBy(day_number("__d"))
    out = both.withColumns({
        "__cum": F.sum("__log").over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "__first": F.first("__p", ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)),
    }).filter("__is_price")
    out = out.withColumn("split_factor_cum", F.exp("__cum"))
    raw = ratio(F.col("__p"), F.col("__first")) - 1
    return out.select(
        entity, F.col("__d").alias(order), raw.alias("raw_return"), "split_factor_cum",
        (ratio(F.col("__p") * F.col("split_factor_cum"), F.col("__first")) - 1)
        .alias("adjusted_return"))


def eps_trend(df: DataFrame, entity: str, order: str, eps: str, rows: int = 8) -> DataFrame:
    """Growth on the report before and four before, and the slope of the last rows."""
    w = series_window(entity, order)
    out = df.withColumns({
        "__q": F.lag(eps, 1).over(w), "__y": F.lag(eps, 4).over(w),
        "__n": F.row_number().over(w).cast("double")})
    slope = F.regr_slope(F.col(eps), F.col("__n")).over(trailing(w, rows))
    return out.withColumn("eps_trend_slope", slope).select(
        entity, order,
        ratio(F.col(eps) - F.col("__q"), F.abs("__q")).alias("eps_qoq_growth"),
        ratio(F.col(eps) - F.col("__y"), F.abs("__y")).alias("eps_yoy_growth"),
        "eps_trend_slope")


def estimate_accuracy(df: DataFrame, entity: str, order: str, actual: str, estimate: str,
                      rows: int = 8) -> DataFrame:
    """Mean absolute error, bias and accuracy of the last estimates."""
    frame = trailing(series_window(entity, order), rows)
    error = F.col(actual) - F.col(estimate)
    out = df.withColumns({
        "mae": F.avg(F.abs(error)).over(frame), "bias": F.avg(error).over(frame),
        "__size": F.avg(F.abs(actual)).over(frame)})
    accuracy = F.greatest(F.lit(0.0), 1 - ratio(F.col("mae"), F.col("__size"))) * 100
    return out.select(entity, order, "mae", "bias",
                      F.when(F.col("__size") != 0, accuracy).alias("accuracy_pct"))


def compliance_trend(df: DataFrame, by: str, date: str, passed: str | Column,
                     days: int = 365, flat: float = 0.0,
                     chunk_days: int | None = None) -> DataFrame:
    """Pass rate of the trailing days per key and day, with the slope of that rate."""
    test = F.expr(passed) if isinstance(passed, str) else passed
    daily = df.groupBy(by, F.col(date).cast("date").alias("date")).agg(
        F.sum(F.when(test, 1.0).otherwise(0.0)).alias("__pass"),
        F.count(F.lit(1)).alias("__all"))

    def sloped(d: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rangeBetween(-(days - 1), 0)
        rated = d.withColumn(
            "rolling_pass_rate", F.sum("__pass").over(frame) / F.sum("__all").over(frame) * 100)
        slope = F.regr_slope(F.col("rolling_pass_rate"), day_number("date").cast("double")).over(frame)
        return rated.withColumn("trend_slope", slope)

    # a slope over rates that look back themselves: twice the reach
    out = along_days(daily, [by], "date", sloped, 2 * (days - 1), chunk_days)
    direction = (F.when(F.col("trend_slope").isNull(), None)
                 .when(F.col("trend_slope") > flat, "improving")
                 .when(F.col("trend_slope") < -flat, "declining").otherwise("stable"))
    return out.select(by, "date", "rolling_pass_rate", direction.alias("trend_direction"),
                      "trend_slope")


def repeat_offender(df: DataFrame, by: str, date: str, failed: str | Column, as_of: str | Column,
                    lookback_days: int = 730, decay: float = 0.9, period_days: int = 30,
                    ) -> DataFrame:
    """Decayed count of failures per key within the lookback up to ``as_of``."""
    test = F.expr(failed) if isinstance(failed, str) else failed
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    age = F.datediff(day, F.col(date).cast("date"))
    recent = df.filter(test).withColumn("__age", age).filter(
        (F.col("__age") >= 0) & (F.col("__age") <= lookback_days))
    return recent.groupBy(by).agg(
        F.sum(F.pow(F.lit(decay), F.col("__age") / float(period_days))).alias("risk_score"),
        F.count(F.lit(1)).alias("failure_count"),
        F.min("__age").alias("days_since_last_failure"))


# -- weighted indices ------------------------------------------------------------------

WEIGHTINGS = ("equal", "volume", "market_cap", "price", "volume_deviation", "volatility")


def weighted_index(df: DataFrame, entity: str, order: str, value: str = "close",
                   weighting: str = "equal", volume: str = "volume",
                   market_cap: str = "market_cap", rows: int = 20) -> DataFrame:
    """Weighted average of a value per date under one of the weightings."""
    frame = trailing(series_window(entity, order), rows)
    if weighting == "equal":
        out = df.withColumn("__w", F.lit(1.0))
    elif weighting in ("volume", "price", "market_cap"):
        out = df.withColumn("__w", F.col({"volume": volume, "price": value,
                                          "market_cap": market_cap}[weighting]).cast("double"))
    elif weighting == "volume_deviation":
        mean = F.avg(volume).over(frame)
        out = df.withColumn("__m", mean).withColumn(
            "__w", F.abs(ratio(F.col(volume) - F.col("__m"), F.col("__m"))))
    elif weighting == "volatility":
        out = with_return(df, entity, order, value).withColumn(
            "__sd", F.stddev_samp("__ret").over(frame)).withColumn(
            "__w", ratio(F.lit(1.0), F.col("__sd")))
    else:
        raise ValueError(f"unknown weighting {weighting!r}")
    used = out.filter(F.col("__w").isNotNull() & F.col(value).isNotNull())
    return used.groupBy(order).agg(
        ratio(F.sum(F.col("__w") * F.col(value)), F.sum("__w")).alias("index_value"),
        F.count(F.lit(1)).alias("members"))
