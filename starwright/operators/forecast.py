"""Forecasts per entity and their accuracy.

Each entity's series is cut to its last rows (Spark limits it on the map side). Models are least
squares by normal equations: products of the columns are added up per entity, so a series is
one row of sums, and the equations are eliminated in array columns. No row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwright.operators.indicators import forecast_features

MIN_ROWS, HISTORY_ROWS, HORIZON = 60, 252, 30
SEASONAL_ROWS = 1095  # history of the seasonal model
ORDER = 5
YEAR_DAYS, YEAR_TERMS, YEARLY_FROM_DAYS = 365.25, 3, 730
NORMAL_90 = 1.6448536269514722  # two-sided 90 % quantile of the normal distribution
SINGULAR = 1e-10  # of a column's square, below which what is left of it counts as nothing
TOO_SHORT = "too_short"


def recent_history(df: DataFrame, entity: str, date: str, value: str,
                   rows: int = HISTORY_ROWS) -> DataFrame:
    """The last rows of each entity as (entity, day, y)."""
    w = Window.partitionBy("entity").orderBy(F.desc("day"), F.desc("y"))
    picked = df.select(F.col(entity).cast("string").alias("entity"),
                       F.col(date).cast("date").alias("day"),
                       F.col(value).cast("double").alias("y"))
    return (picked.filter(F.col("y").isNotNull())
            .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= rows).drop("rn"))


def normal_equations(columns: Sequence[Column], target: Column) -> Column:
    """Aggregate: the matrix of summed products of the columns, each row ending with the target."""
    sums = {}

    def product(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        if (i, j) not in sums:
            sums[i, j] = F.coalesce(F.sum(columns[i] * columns[j]), F.lit(0.0))
        return sums[i, j]

    size = range(len(columns))
    return F.array(*[F.array(*[product(i, j) for j in size], F.coalesce(F.sum(columns[i] * target), F.lit(0.0)))
                     for i in size])


def cell(matrix: Column, i: Column, j: Column) -> Column:
    return F.element_at(F.element_at(matrix, i), j)


def eliminated(matrix: Column, size: int) -> Column:
    """The matrix with every column eliminated from all rows but its own.

    A column that depends on those before leaves next to nothing of its own square; it is passed over.
    """
    def step(m: Column, k: Column) -> Column:
        pivot = F.element_at(m, k)
        whole = F.element_at(pivot, k)
        usable = whole > F.lit(SINGULAR) * cell(matrix, k, k)
        return F.transform(m, lambda row, i: F.when((i + 1 == k) | ~usable, row).otherwise(F.zip_with(
            row, pivot, lambda a, b: a - F.element_at(row, k) / whole * b)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), matrix, step)


def coefficients(matrix: Column, solved: Column, size: int) -> Column:
    """The solution; 0 for columns that were passed over."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.when(
        cell(solved, k, k) > F.greatest(F.lit(SINGULAR) * cell(matrix, k, k), F.lit(0.0)),
        cell(solved, k, F.lit(size + 1)) / cell(solved, k, k)).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def recursion(weights: Column, past: Column, steps: int, order: int) -> Column:
    """The next values of a linear recursion; ``past`` has the latest value first."""
    start = F.struct(past.alias("past"), F.array().cast("array<double>").alias("made"))

    def step(state: Column, _: Column) -> Column:
        value = F.array(dot(weights, state["past"]))
        return F.struct(F.concat(value, F.slice(state["past"], 1, order - 1)).alias("past"),
                        F.concat(state["made"], value).alias("made"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["made"]


def _forecast_rows(df: DataFrame, level: Column, spread: Column, model: str) -> DataFrame:
    """Rows of the result from rows with ``entity, last, horizon``; series that are too short get one row without values."""
    fits = F.col("horizon").isNotNull()
    return df.select(
        "entity", F.date_add("last", F.col("horizon")).alias("forecast_date"),
        F.col("horizon").alias("horizon_days"), F.when(fits, level).alias("predicted_close"),
        F.when(fits, level - NORMAL_90 * spread).alias("predicted_low"),
        F.when(fits, level + NORMAL_90 * spread).alias("predicted_high"),
        F.when(fits, F.lit(model)).otherwise(TOO_SHORT).alias("model_type"))


def residual_spread(matrix: Column, beta: Column, squares: Column, n: Column, size: int) -> Column:
    """Deviation of the residuals, from the sums alone."""
    explained = dot(beta, F.transform(matrix, lambda row: F.element_at(row, size + 1)))
    return F.sqrt(F.greatest(squares - explained, F.lit(0.0)) / F.greatest(n - size, F.lit(1)))


def autoregressive(history: DataFrame, horizon: int, min_rows: int, order: int = ORDER) -> DataFrame:
    """AR on first differences, 90 % interval from its impulse response."""
    series = Window.partitionBy("entity").orderBy("day", "y")
    moves = history.withColumn("d", F.col("y") - F.lag("y").over(series))
    moves = moves.withColumns({f"d{k}": F.lag("d", k).over(series) for k in range(1, order + 1)})
    lags = [F.col(f"d{k}") for k in range(1, order + 1)]
    known = lags[-1].isNotNull()
    usable = [F.when(known, c) for c in lags]
    last = F.struct("day", "y")
    fitted = moves.groupBy("entity").agg(
        F.count(F.lit(1)).alias("rows"), F.max("day").alias("last"), F.max_by("y", last).alias("level"),
        F.max_by(F.array("d", *lags[:-1]), last).alias("past"),
        normal_equations(usable, F.col("d")).alias("matrix"),
        F.sum(F.when(known, F.col("d") * F.col("d"))).alias("squares"), F.count(F.when(known, 1)).alias("n"))
    fitted = fitted.withColumn("solved", eliminated(F.col("matrix"), order))
    fitted = fitted.withColumn("phi", coefficients(F.col("matrix"), F.col("solved"), order))
    fitted = fitted.withColumn("sigma", residual_spread(F.col("matrix"), F.col("phi"), F.col("squares"), F.col("n"), order))
    first = F.array(F.lit(1.0), *[F.lit(0.0)] * (order - 1))
    enough = (F.col("rows") >= min_rows) & (F.size("past") == order)
    fitted = fitted.select("entity", "last", "level", "sigma", F.when(enough, F.arrays_zip(
        recursion(F.col("phi"), F.col("past"), horizon, order).alias("move"),
        F.concat(F.array(F.lit(1.0)), recursion(F.col("phi"), first, horizon - 1, order) if horizon > 1
                 else F.array().cast("array<double>")).alias("psi"))).alias("ahead"))
    each = fitted.select("entity", "last", "level", "sigma", F.posexplode_outer("ahead").alias("at", "step"))
    each = each.withColumn("horizon", F.col("at") + 1)
    upto = Window.partitionBy("entity").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"moved": F.sum("step.move").over(upto), "response": F.sum("step.psi").over(upto)})
    each = each.withColumn("power", F.sum(F.col("response") * F.col("response")).over(upto))
    return _forecast_rows(each, F.col("level") + F.col("moved"), F.col("sigma") * F.sqrt("power"), f"ar_{order}_1_0")


def seasonal_columns(day: Column, start: Column, yearly: Column, terms: int = YEAR_TERMS) -> list[Column]:
    """Level, trend in years, six weekdays, and waves of the year where ``yearly``."""
    number = F.unix_date(day).cast("double")
    age = (number - F.unix_date(start)) / F.lit(YEAR_DAYS)
    week = [F.when(F.weekday(day) == k, 1.0).otherwise(0.0) for k in range(1, 7)]
    turn = number * F.lit(2 * 3.141592653589793 / YEAR_DAYS)
    waves = [F.when(yearly, wave(turn * k)).otherwise(0.0) for k in range(1, terms + 1) for wave in (F.sin, F.cos)]
    return [F.lit(1.0), age, *week, *waves]


def trend_weekday(history: DataFrame, horizon: int, min_rows: int) -> DataFrame:
    """Linear trend, weekday effects and, for series of two years or more, waves of the year."""
    whole = Window.partitionBy("entity")
    rows = history.withColumns({"start": F.min("day").over(whole), "last": F.max("day").over(whole)})
    rows = rows.withColumn("yearly", F.datediff("last", "start") >= YEARLY_FROM_DAYS)
    columns = seasonal_columns(F.col("day"), F.col("start"), F.col("yearly"))
    size = len(columns)
    rows = rows.select("entity", "start", "last", "yearly", "y", *[c.alias(f"x{i}") for i, c in enumerate(columns)])
    fitted = rows.groupBy("entity", "start", "last", "yearly").agg(
        normal_equations([F.col(f"x{i}") for i in range(size)], F.col("y")).alias("matrix"),
        F.sum(F.col("y") * F.col("y")).alias("squares"), F.count(F.lit(1)).alias("n"))
    fitted = fitted.withColumn("solved", eliminated(F.col("matrix"), size))
    fitted = fitted.withColumn("beta", coefficients(F.col("matrix"), F.col("solved"), size))
    fitted = fitted.withColumn("sigma", residual_spread(F.col("matrix"), F.col("beta"), F.col("squares"), F.col("n"), size))
    each = fitted.select("entity", "start", "last", "yearly", "beta", "sigma", F.explode_outer(
        F.when(F.col("n") >= min_rows, F.sequence(F.lit(1), F.lit(horizon)))).alias("horizon"))
    ahead = F.array(*seasonal_columns(F.date_add("last", F.col("horizon")), F.col("start"), F.col("yearly")))
    return _forecast_rows(each, dot(F.col("beta"), ahead), F.col("sigma"), "trend_weekday")


MODELS = {"ar": (autoregressive, HISTORY_ROWS), "trend_weekday": (trend_weekday, SEASONAL_ROWS)}


def forecast(df: DataFrame, entity: str, date: str, value: str, model: str = "ar",
             horizon: int = HORIZON, min_rows: int = MIN_ROWS, history_rows: int | None = None) -> DataFrame:
    """Forecast of every entity: ``entity, forecast_date, horizon_days, predicted_close, predicted_low,
    predicted_high, model_type``, one row per day ahead.

    An entity with fewer than ``min_rows`` values has one row of model type ``too_short`` without values.
    """
    fit, rows = MODELS[model]
    return fit(recent_history(df, entity, date, value, history_rows or rows), horizon, max(min_rows, ORDER + 2))


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (),
             tolerance: float = 0.05) -> DataFrame:
    """MAPE, R² and share within the tolerance. R² from sums, in one pass."""
    a, p = F.col(actual), F.col(predicted)
    off = F.abs(F.try_divide(a - p, F.nullif(a, F.lit(0.0))))
    n = F.count(a - p)
    spread = F.var_pop(F.when(p.isNotNull(), a)) * n
    aggs = [
        F.avg(off * 100).alias("mape"),
        (1 - F.try_divide(F.sum((a - p) * (a - p)), F.nullif(spread, F.lit(0.0)))).alias("r2"),
        F.avg(F.when(off <= tolerance, 1.0).when(off.isNotNull(), 0.0) * 100).alias("within_pct"),
        n.alias("points"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def random_forest(df: DataFrame, entity: str, date: str, value: str, trees: int = 100,
                  depth: int = 10, train_share: float = 0.8, seed: int = 42):
    """Random forest on lag, rolling and weekday features.

    Returns (model, metrics frame): error, R², rows of both shares, and the error of the value before as the
    forecast. The split is by a digest of the row key, so it is the same on every run, can be
    told in SQL and needs no shuffle.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    featured = forecast_features(df.select(entity, date, value), entity, date, value)
    names = [c for c in featured.columns if c not in (entity, date, value)]
    clean = featured.dropna()
    digest = F.md5(F.concat(F.col(entity).cast("string"), F.lit("|"), F.col(date).cast("string"), F.lit(f"|{seed}")))
    slot = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 1000
    train, test = (clean.filter(slot < train_share * 1000),
                   clean.filter(slot >= train_share * 1000))
    model = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features"),
        RandomForestRegressor(labelCol=value, featuresCol="features", numTrees=trees,
                              maxDepth=depth, seed=seed),
    ]).fit(train)
    scored = model.transform(test).select(
        F.col(value).alias("a"), F.col("prediction").alias("p"), F.col("lag_1").alias("before"))
    sse = F.sum((F.col("a") - F.col("p")) ** 2)
    metrics = scored.agg(
        F.sqrt(sse / F.count(F.lit(1))).alias("rmse"),
        (1 - F.try_divide(sse, F.var_pop("a") * F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg((F.col("a") - F.col("before")) ** 2)).alias("naive_rmse"),
        F.count(F.lit(1)).alias("test_rows"))
    return model, metrics.withColumn("train_rows", F.lit(train.count()).cast("long"))
