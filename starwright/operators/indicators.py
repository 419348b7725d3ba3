"""Technical indicators over price series.

All columns of a call share one (entity, order) window, so a series is shuffled and sorted
once. A series of one row per entity and day is short; for longer ones pass the same specs
through :func:`long_indicators`, which cuts the series into chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from starwright.operators.ordered import Chunks, chunked_windows

TRADING_DAYS = 252


def trailing(w: WindowSpec, period: int) -> WindowSpec:
    """The last ``period`` rows up to the current one; shorter at the start."""
    return w.rowsBetween(-(period - 1), 0)


def sma(source: str, period: int, w: WindowSpec) -> Column:
    return F.avg(source).over(trailing(w, period))


def ema_weights(period: int) -> list[float]:
    """Normalised weights of the last 3·period values, oldest first."""
    alpha = 2.0 / (period + 1)
    raw = [alpha * (1 - alpha) ** age for age in range(3 * period)]
    return [x / sum(raw) for x in reversed(raw)]


def ema_frame(source: str, period: int, w: WindowSpec) -> Column:
    """The values an EMA folds; structs, so that a NULL keeps its place."""
    return F.collect_list(F.struct(F.col(source).alias("v"))).over(trailing(w, 3 * period))


def ema_fold(frame: Column, period: int) -> Column:
    """Weighted sum of a frame; NULL until 3·period rows exist or if one value is NULL."""
    weights = F.array(*[F.lit(x) for x in ema_weights(period)])
    terms = F.zip_with(frame, weights, lambda s, k: s["v"] * k)
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(frame) == 3 * period, total)


def with_emas(df: DataFrame, emas: Mapping[str, tuple[str, int]], w: WindowSpec) -> DataFrame:
    """``{name: (source, period)}`` in one window pass and one projection."""
    if not emas:
        return df
    frames = {f"__f_{n}": ema_frame(src, p, w) for n, (src, p) in emas.items()}
    out = df.withColumns(frames).withColumns(
        {n: ema_fold(F.col(f"__f_{n}"), p) for n, (_, p) in emas.items()})
    return out.drop(*frames)


def percent_return(value: Column, previous: Column) -> Column:
    """Percent change from the row before; NULL where that is NULL or 0."""
    return F.try_divide(value - previous, F.nullif(previous, F.lit(0))) * 100


def rsi_of(avg_gain: Column, avg_loss: Column) -> Column:
    """Relative strength index; 50 when there is no loss."""
    strength = F.try_divide(avg_gain, F.nullif(avg_loss, F.lit(0)))
    return F.coalesce(100 - F.try_divide(F.lit(100.0), 1 + strength), F.lit(50.0))


def frame_rows(spec: Mapping[str, object]) -> tuple[int, list[str]]:
    """Rows before its own that an indicator's frame holds, and the columns it is made of."""
    kind = spec["indicator"]
    if kind == "ema":
        return 3 * int(spec["period"]) - 1, [spec["source"]]
    if kind == "sma":
        return int(spec["period"]) - 1, [spec["source"]]
    if kind == "bollinger":
        return int(spec["period"]) - 1, [spec.get("source", "adjusted_close")]
    if kind in ("rsi", "volatility"):  # over differences, which need one row more
        return int(spec["period"]), [spec["source"]]
    if kind == "atr":
        return int(spec["period"]), ["high", "low", "close"]
    if kind == "macd_line":
        return 0, [f"ema_{spec.get('fast', 12)}", f"ema_{spec.get('slow', 26)}"]
    if kind == "macd_signal":
        return 3 * int(spec.get("signal", 9)) - 1, [spec.get("macd_col", "macd")]
    if kind == "macd_histogram":
        return 0, [spec.get("macd_col", "macd"), spec.get("signal_col", "macd_signal")]
    if kind == "volume_ratio":
        return 0, ["volume", spec.get("sma_col", "volume_sma_20")]
    raise ValueError(f"unknown indicator {kind!r}")


def reach(
    column: str, specs: Mapping[str, Mapping[str, object]], inputs: Sequence[str], above: Sequence[str] = (),
) -> int:
    """Rows before its own that a column depends on: its frame, and what the longest source needs on top."""
    if column not in specs or column in above:
        if column not in inputs:
            raise ValueError(f"source {column!r} is neither a column nor an indicator of this call")
        return 0
    own, sources = frame_rows(specs[column])
    return own + max(reach(s, specs, inputs, [*above, column]) for s in sources)


def indicators(
    df: DataFrame, specs: Mapping[str, Mapping[str, object]], w: WindowSpec,
) -> DataFrame:
    """Add the indicator columns ``{name: {indicator, period, source, …}}``.

    Kinds: sma, ema, rsi, atr, bollinger (band upper/middle/lower), volatility, macd_line,
    macd_signal, macd_histogram, volume_ratio. Later kinds refer to earlier columns by name.
    """
    known = {"sma", "ema", "rsi", "atr", "bollinger", "volatility",
             "macd_line", "macd_signal", "macd_histogram", "volume_ratio"}
    for name, spec in specs.items():
        if spec["indicator"] not in known:
            raise ValueError(f"unknown indicator {spec['indicator']!r} for {name}")

    def of(*kinds: str) -> list[tuple[str, Mapping[str, object]]]:
        return [(n, s) for n, s in specs.items() if s["indicator"] in kinds]

    sources = {s["source"] for _, s in of("rsi", "volatility")} | ({"close"} if of("atr") else set())
    temps = {f"__prev_{c}": F.lag(c, 1).over(w) for c in sources}
    out = df.withColumns(temps) if temps else df

    row_level: dict[str, Column] = {}
    for _, s in of("rsi"):
        change = F.col(s["source"]) - F.col(f"__prev_{s['source']}")
        row_level[f"__gain_{s['source']}"] = F.when(change > 0, change).otherwise(0.0)
        row_level[f"__loss_{s['source']}"] = F.when(change < 0, -change).otherwise(0.0)
    for _, s in of("volatility"):
        row_level[f"__ret_{s['source']}"] = percent_return(
            F.col(s["source"]), F.col(f"__prev_{s['source']}"))
    if of("atr"):
        before = F.col("__prev_close")
        row_level["__range"] = F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - before),
            F.abs(F.col("low") - before))
    if row_level:
        out = out.withColumns(row_level)

    framed: dict[str, Column] = {}
    for n, s in of("sma"):
        framed[n] = sma(s["source"], s["period"], w)
    for n, s in of("rsi"):
        frame = trailing(w, s["period"])
        framed[f"__ag_{n}"] = F.avg(f"__gain_{s['source']}").over(frame)
        framed[f"__al_{n}"] = F.avg(f"__loss_{s['source']}").over(frame)
    for n, s in of("atr"):
        framed[n] = F.avg("__range").over(trailing(w, s["period"]))
    for n, s in of("bollinger"):
        source, frame = s.get("source", "adjusted_close"), trailing(w, s["period"])
        framed[f"__mid_{n}"] = F.avg(source).over(frame)
        if s["band"] != "middle":
            framed[f"__sd_{n}"] = F.stddev_samp(source).over(frame)
    for n, s in of("volatility"):
        framed[n] = F.stddev_samp(f"__ret_{s['source']}").over(trailing(w, s["period"])) \
            * math.sqrt(TRADING_DAYS)
    if framed:
        out = out.withColumns(framed)

    final: dict[str, Column] = {}
    for n, _ in of("rsi"):
        final[n] = rsi_of(F.col(f"__ag_{n}"), F.col(f"__al_{n}"))
    for n, s in of("bollinger"):
        side = {"upper": 1, "lower": -1, "middle": 0}[s["band"]]
        mid = F.col(f"__mid_{n}")
        final[n] = mid if side == 0 else \
            mid + F.lit(side * float(s.get("std_dev", 2.0))) * F.col(f"__sd_{n}")
    for n, s in of("volume_ratio"):
        base = F.col(s.get("sma_col", "volume_sma_20"))
        final[n] = F.try_divide(F.col("volume").cast("double"), F.nullif(base, F.lit(0)))
    if final:
        out = out.withColumns(final)

    out = with_emas(out, {n: (s["source"], s["period"]) for n, s in of("ema")}, w)
    for n, s in of("macd_line"):
        out = out.withColumn(
            n, F.col(f"ema_{s.get('fast', 12)}") - F.col(f"ema_{s.get('slow', 26)}"))
    out = with_emas(out, {n: (s.get("macd_col", "macd"), s.get("signal", 9))
                          for n, s in of("macd_signal")}, w)
    for n, s in of("macd_histogram"):
        out = out.withColumn(
            n, F.col(s.get("macd_col", "macd")) - F.col(s.get("signal_col", "macd_signal")))
    return out.drop(*[c for c in out.columns if c.startswith("__") and c not in df.columns])


def series_window(entity: Sequence[str] | str, order: Sequence[str] | str) -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    by = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*by)


def along(
    df: DataFrame, entity: str, order: str, calculate: Callable[[DataFrame, WindowSpec], DataFrame],
    reach: int, chunks: Chunks | None = None,
) -> DataFrame:
    """``calculate(df, window)`` along each series: whole, or cut into chunks that overlap by ``reach`` rows."""
    if chunks is None:
        return calculate(df, series_window(entity, order))
    return chunked_windows(df, [entity], [order], chunks.coarse, calculate, reach, max(chunks.rows, reach))


def add_indicators(
    df: DataFrame, specs: Mapping[str, Mapping[str, object]], entity: Sequence[str] | str,
    order: Sequence[str] | str,
) -> DataFrame:
    """Indicators over series of bounded length, such as one row per entity and day."""
    return indicators(df, specs, series_window(entity, order))


def long_indicators(
    df: DataFrame, specs: Mapping[str, Mapping[str, object]], entity: Sequence[str],
    order: Sequence[str], coarse: Column, chunk_rows: int = 100_000,
) -> DataFrame:
    """The same over series of any length, cut into chunks (see ``chunked_windows``).

    Chunks overlap by the longest chain of frames, such as the signal of a MACD of EMAs.
    """
    halo = max((reach(n, specs, df.columns) for n in specs), default=0)
    return chunked_windows(df, entity, order, coarse,
                           lambda d, w: indicators(d, specs, w), halo, chunk_rows)


def technicals_specs(price: str) -> dict[str, dict[str, object]]:
    """The standard set on one price column."""
    return {
        **{f"sma_{n}": {"indicator": "sma", "period": n, "source": price} for n in (20, 50, 200)},
        "rsi_14": {"indicator": "rsi", "period": 14, "source": price},
        **{f"volatility_{n}d": {"indicator": "volatility", "period": n, "source": price}
           for n in (20, 60)},
        **{f"bollinger_{b}": {"indicator": "bollinger", "band": b, "period": 20, "source": price}
           for b in ("upper", "middle", "lower")},
        "volume_sma_20": {"indicator": "sma", "period": 20, "source": "volume"},
        "volume_ratio": {"indicator": "volume_ratio", "sma_col": "volume_sma_20"},
    }


def add_technicals(
    df: DataFrame, entity: str, order: str, price: str = "adjusted_close",
) -> DataFrame:
    """Daily return and the standard set; falls back to ``close`` as the price."""
    price = price if price in df.columns else "close"
    return _technicals(df, series_window(entity, order), price)


def long_technicals(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], coarse: Column,
    price: str = "adjusted_close", chunk_rows: int = 100_000,
) -> DataFrame:
    """:func:`add_technicals` over series of any length, cut into chunks."""
    price = price if price in df.columns else "close"
    specs = technicals_specs(price)
    halo = max(reach(n, specs, df.columns) for n in specs)
    return chunked_windows(df, entity, order, coarse, lambda d, w: _technicals(d, w, price), halo, chunk_rows)


def _technicals(df: DataFrame, w: WindowSpec, price: str) -> DataFrame:
    with_return = df.withColumn(
        "daily_return", percent_return(F.col(price), F.lag(price, 1).over(w)))
    return indicators(with_return, technicals_specs(price), w)


def window_column(
    df: DataFrame, partition: Sequence[str], order: Sequence[str], expr: str, alias: str,
) -> DataFrame:
    """Any SQL window expression over (partition, order).

    Without a partition one task would sort the whole table, so that is refused: lags, running
    sums and ranks along a whole table are those of :class:`~starwright.operators.ordered.GlobalOrder`.
    """
    if not partition:
        raise ValueError("a window needs a partition; use GlobalOrder for the order of a whole table")
    return df.withColumn(alias, F.expr(expr).over(Window.partitionBy(*partition).orderBy(*order)))


def changes(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """Change and percent change from the row before; each first row is dropped."""
    w = series_window(entity, order)
    prev = F.lag(value, 1).over(w)
    return (
        df.withColumn("previous", prev)
        .filter(F.col("previous").isNotNull())
        .withColumn("change", F.col(value) - F.col("previous"))
        .withColumn("pct_change", percent_return(F.col(value), F.col("previous")))
    )


def forward_return(df: DataFrame, entity: str, order: str, value: str, rows: int = 30) -> DataFrame:
    """Return to the row ``rows`` later; NULL in the last rows."""
    ahead = F.lead(value, rows).over(series_window(entity, order))
    return df.withColumn(f"forward_return_{rows}", F.try_divide(ahead, F.col(value)) - 1)


def forecast_features(
    df: DataFrame, entity: str, order: str, value: str,
    lags: Sequence[int] = (1, 2, 3, 5, 7, 14), frames: Sequence[int] = (5, 10, 20),
    chunks: Chunks | None = None,
) -> DataFrame:
    """Lags, rolling mean and deviation over full frames, weekday columns."""
    def features(d: DataFrame, w: WindowSpec) -> DataFrame:
        cols: dict[str, Column] = {f"lag_{n}": F.lag(value, n).over(w) for n in lags}
        for n in frames:
            frame = trailing(w, n)
            full = F.count(value).over(frame) == n
            cols[f"rolling_mean_{n}"] = F.when(full, F.avg(value).over(frame))
            cols[f"rolling_std_{n}"] = F.when(full, F.stddev_samp(value).over(frame))
        return d.withColumns(cols)

    monday_first = F.weekday(order)
    return along(df, entity, order, features, max([*lags, *frames], default=0), chunks).withColumns({
        "day_of_week": monday_first,
        "is_monday": (monday_first == 0).cast("int"),
        "is_friday": (monday_first == 4).cast("int")})


def rank_by_total(df: DataFrame, entity: str, value: str, total: str, rank: str) -> DataFrame:
    """Totals per entity with the dense rank of the total, descending."""
    from starwright.operators.ordered import GlobalOrder

    sums = df.groupBy(entity).agg(F.sum(value).alias(total))
    return GlobalOrder(sums, [F.desc(total), F.asc(entity)]).dense_rank(rank, total).result()


def top_ranked(
    df: DataFrame, entity: str, score: str, n: int,
) -> DataFrame:
    """The n best rows with row number and percent rank among all rows.

    Only n rows are ranked in one task: a rank depends on better rows alone, and the
    percent rank needs just the number of rows besides.
    """
    best = df.orderBy(F.desc_nulls_last(score), entity).limit(n)
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    w = Window.orderBy(F.desc_nulls_last(score), entity)
    ties = Window.orderBy(F.desc_nulls_last(score))
    return (
        best.withColumn("rank_no", F.row_number().over(w))
        .withColumn("__rank", F.rank().over(ties))
        .withColumn("percentile", F.coalesce(
            F.try_divide((F.col("__rank") - 1).cast("double"), F.nullif(total - 1, F.lit(0))),
            F.lit(0.0)) * 100)
        .drop("__rank")
    )
