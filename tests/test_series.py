from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from starwright.operators import forecast, indicators, rolling
from starwright.operators.ordered import GlobalOrder, chunked_windows, numbered


def prices(spark, values, entity="A", extra=()):
    day = dt.date(2024, 1, 1)
    recs = [(entity, day + dt.timedelta(days=i), v, (v or 0.0) + 1, (v or 0.0) - 1, 10.0 * (i % 3))
            for i, v in enumerate(values)]
    return spark.createDataFrame([*recs, *extra],
                                 "ticker string, trade_date date, close double, high double, low double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("trade_date").collect()]


def add(df, **specs):
    return indicators.add_indicators(df, specs, "ticker", "trade_date")


def test_sma_has_partial_frames(spark):
    out = add(prices(spark, [1.0, 2.0, 3.0, 4.0]), s={"indicator": "sma", "period": 3, "source": "close"})
    assert column(out, "s") == [1.0, 1.5, 2.0, 3.0]
    assert set(out.columns) == {"ticker", "trade_date", "close", "high", "low", "volume", "s"}


def test_ema_against_the_definition(spark):
    values = [float((i * 7) % 11) for i in range(12)]
    out = column(add(prices(spark, values), e={"indicator": "ema", "period": 2, "source": "close"}), "e")
    alpha = 2 / 3
    w = [alpha * (1 - alpha) ** i for i in range(6)]
    want = [None] * 5 + [sum(values[t - i] * w[i] for i in range(6)) / sum(w) for t in range(5, 12)]
    assert out[:5] == want[:5] and out[5:] == pytest.approx(want[5:])


def test_ema_null_inside_the_frame(spark):
    values = [1.0] * 4 + [None] + [1.0] * 8
    out = column(add(prices(spark, values), e={"indicator": "ema", "period": 1, "source": "close"}), "e")
    assert [v is None for v in out] == [True] * 2 + [False] * 2 + [True] * 3 + [False] * 6


def test_rsi_of_flat_rising_and_single(spark):
    spec = {"indicator": "rsi", "period": 3, "source": "close"}
    assert column(add(prices(spark, [5.0] * 4), r=spec), "r") == [50.0] * 4
    assert column(add(prices(spark, [1.0, 2.0, 3.0]), r=spec), "r") == [50.0] * 3
    assert column(add(prices(spark, [5.0]), r=spec), "r") == [50.0]
    assert column(add(prices(spark, [2.0, 1.0, 3.0]), r=spec), "r")[-1] == pytest.approx(100 - 100 / 3)


def test_atr_bollinger_volatility(spark):
    out = add(prices(spark, [10.0, 13.0, 12.0]), a={"indicator": "atr", "period": 2},
              u={"indicator": "bollinger", "band": "upper", "period": 2, "source": "close"},
              v={"indicator": "volatility", "period": 3, "source": "close"})
    assert column(out, "a") == [2.0, 3.0, 3.0]
    assert column(out, "u")[0] is None
    assert column(out, "u")[1] == pytest.approx(11.5 + 2 * np.std([10, 13], ddof=1))
    assert column(out, "v")[2] == pytest.approx(np.std([30.0, -100 / 13], ddof=1) * math.sqrt(252))


def test_volume_ratio_zero_and_unknown(spark):
    out = add(prices(spark, [1.0, 2.0]), volume_sma_20={"indicator": "sma", "period": 20, "source": "volume"},
              q={"indicator": "volume_ratio"})
    assert column(out, "q") == [None, 2.0]
    with pytest.raises(ValueError):
        add(prices(spark, [1.0]), x={"indicator": "nope"})


def test_long_series_equal_plain_windows(spark):
    df = spark.range(600).select(
        F.when(F.col("id") < 500, "hot").otherwise("cold").alias("ticker"),
        (F.col("id") / 7).cast("int").alias("day"), "id",
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("close"))
    specs = {"rsi": {"indicator": "rsi", "period": 14, "source": "close"},
             "sma": {"indicator": "sma", "period": 9, "source": "close"},
             "ema_3": {"indicator": "ema", "period": 3, "source": "close"},
             "ema_5": {"indicator": "ema", "period": 5, "source": "close"},
             "macd": {"indicator": "macd_line", "fast": 3, "slow": 5},
             "sig": {"indicator": "macd_signal", "signal": 4, "slow": 5}}
    plain = indicators.add_indicators(df, specs, "ticker", "id")
    cut = indicators.long_indicators(df, specs, ["ticker"], ["id"], F.col("day"), chunk_rows=40)
    assert cut.count() == 600
    a = {r["id"]: r.asDict() for r in plain.collect()}
    for r in cut.collect():
        for n in specs:
            want = a[r["id"]][n]
            assert (r[n] is None and want is None) or r[n] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        chunked_windows(df, ["ticker"], ["id"], F.col("day"), lambda d, w: d, halo_rows=50, chunk_rows=10)


def same_columns(plain, cut, names):
    a = {r["id"]: r.asDict() for r in plain.collect()}
    got = cut.collect()
    assert len(got) == len(a)
    for r in got:
        for n in names:
            want = a[r["id"]][n]
            assert (r[n] is None and want is None) or r[n] == pytest.approx(want, abs=1e-9), (n, r["id"])


def test_long_chained_indicators_equal_plain_windows(spark):
    df = spark.range(400).select(
        F.lit("a").alias("ticker"), (F.col("id") / 7).cast("int").alias("day"), "id",
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("close"), F.col("id").cast("double").alias("volume"))
    specs = {"avg": {"indicator": "sma", "period": 9, "source": "close"},
             "smooth": {"indicator": "ema", "period": 4, "source": "avg"},
             "ema_3": {"indicator": "ema", "period": 3, "source": "close"},
             "ema_13": {"indicator": "ema", "period": 13, "source": "close"},
             "macd": {"indicator": "macd_line", "fast": 3, "slow": 13},
             "macd_signal": {"indicator": "macd_signal", "signal": 5},
             "hist": {"indicator": "macd_histogram"}}
    assert indicators.reach("smooth", specs, df.columns) == 8 + 11
    assert indicators.reach("hist", specs, df.columns) == 14 + 38
    same_columns(indicators.add_indicators(df, specs, "ticker", "id"), indicators.long_indicators(
        df, specs, ["ticker"], ["id"], F.col("day"), chunk_rows=55), specs)
    plain = indicators.add_technicals(df, "ticker", "id")
    same_columns(plain, indicators.long_technicals(df, ["ticker"], ["id"], F.col("day"), chunk_rows=210),
                 ["daily_return", "sma_200", "rsi_14", "volatility_60d", "bollinger_upper", "volume_ratio"])
    with pytest.raises(ValueError):
        indicators.long_indicators(df, {"macd": specs["macd"]}, ["ticker"], ["id"], F.col("day"))


def test_numbered(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    out = numbered(df, ["k"], ["id"], F.floor(F.col("id") / 9), "pos")
    assert all(r.pos == r.id // 2 for r in out.collect())


def test_global_order_equals_one_window(spark):
    df = spark.range(400).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20).alias("v"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    order = [F.desc("v"), F.asc("id")]
    w = Window.orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    by_value = Window.orderBy(F.desc("v"))
    want = df.select("id", F.lag("n").over(w).alias("lag"), F.sum("n").over(upto).alias("run"),
                     F.dense_rank().over(by_value).alias("dr"), F.rank().over(by_value).alias("rk"),
                     F.row_number().over(w).alias("rn"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g = GlobalOrder(df, order)
        assert g.rows.select("__part").distinct().count() > 2
        got = (g.add({"lag": ("lag", "n"), "run": ("sum", "n")}).dense_rank("dr", "v").rank("rk", "v")
               .row_number("rn").result().select("id", "lag", "run", "dr", "rk", "rn"))
        assert rows(got) == rows(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_top_ranked_percent_rank_of_all(spark):
    df = spark.range(11).select("id", (F.col("id") * 1.0).alias("s"))
    got = indicators.top_ranked(df, "id", "s", 3).collect()
    assert [(r.id, r.rank_no, r.percentile) for r in got] == [(10, 1, 0.0), (9, 2, 10.0), (8, 3, 20.0)]


def test_forecast_continues_a_line(spark):
    n = 80
    df = prices(spark, [100.0 + 2 * i for i in range(n)], extra=[
        ("B", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 1.0)])
    for model in forecast.MODELS:
        out = forecast.forecast(df, "ticker", "trade_date", "close", model, horizon=5).orderBy("horizon_days").collect()
        short, *out = out
        assert tuple(short) == ("B", None, None, None, None, None, "too_short")  # one row is too few
        assert len(out) == 5 and {r.entity for r in out} == {"A"}
        for h, r in enumerate(out, 1):
            assert r.predicted_close == pytest.approx(100 + 2 * (n - 1 + h), abs=1e-6)
            assert r.predicted_low <= r.predicted_close <= r.predicted_high
            assert r.forecast_date == dt.date(2024, 1, 1) + dt.timedelta(days=n - 1 + h)


def test_forecast_interval_widens(spark):
    rng = np.random.default_rng(1)
    df = prices(spark, (np.cumsum(rng.normal(size=120)) + 50).tolist())
    out = forecast.forecast(df, "ticker", "trade_date", "close", horizon=10).orderBy("horizon_days").collect()
    width = [r.predicted_high - r.predicted_low for r in out]
    assert all(b >= a for a, b in zip(width, width[1:]))


def test_history_is_cut_before_grouping(spark):
    df = prices(spark, [float(i) for i in range(300)])
    out = forecast.recent_history(df, "ticker", "trade_date", "close")
    assert out.count() == 252 and out.agg(F.min("y")).first()[0] == 48.0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_accuracy(spark):
    df = spark.createDataFrame([(100.0, 100.0), (200.0, 180.0), (0.0, 1.0), (50.0, None)], "a double, p double")
    r = forecast.accuracy(df, "a", "p").first()
    assert r.mape == pytest.approx(5.0) and r.within_pct == 50.0 and r.points == 3
    assert r.r2 == pytest.approx(1 - 401 / 20000)


def test_npv_and_velocity(spark):
    df = spark.createDataFrame([("e", dt.date(2020, 1, 1), 100.0), ("e", dt.date(2020, 12, 31), 105.0)],
                               "k string, d date, amt double")
    assert rolling.net_present_value(df, ["k"], "amt", "d").first()["npv"] == pytest.approx(200.0)
    v = rolling.spending_velocity(df, ["k"], "amt", "d", [30, 366]).orderBy("date").collect()
    assert [x["spend_30d"] for x in v] == [100.0, 105.0] and v[1]["spend_366d"] == 205.0


def test_repeat_offender_and_compliance(spark):
    df = spark.createDataFrame([("f", dt.date(2024, 1, 1), "FAIL"), ("f", dt.date(2024, 1, 31), "FAIL"),
                                ("f", dt.date(2020, 1, 1), "FAIL"), ("f", dt.date(2024, 1, 31), "PASS")],
                               "k string, d date, r string")
    r = rolling.repeat_offender(df, "k", "d", "r = 'FAIL'", "2024-01-31").first()
    assert (r.risk_score, r.failure_count, r.days_since_last_failure) == (pytest.approx(1.9), 2, 0)
    c = rolling.compliance_trend(df, "k", "d", "r = 'PASS'").orderBy("date").collect()
    assert [x.rolling_pass_rate for x in c] == [0.0, 0.0, pytest.approx(100 / 3)]


def test_unknown_weighting(spark):
    with pytest.raises(ValueError):
        rolling.weighted_index(prices(spark, [1.0]), "ticker", "trade_date", weighting="luck")


def test_autoregression_equals_least_squares(spark):
    """Coefficients and interval against numpy on the same rows."""
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=300)) * 3 + 100
    out = forecast.forecast(prices(spark, y.tolist()), "ticker", "trade_date", "close", horizon=7).orderBy("horizon_days").collect()
    y = y[-252:]
    d = np.diff(y)
    x = np.column_stack([d[5 - k:len(d) - k] for k in range(1, 6)])
    phi = np.linalg.lstsq(x, d[5:], rcond=None)[0]
    noise = d[5:] - x @ phi
    sigma = np.sqrt(noise @ noise / (len(noise) - 5))
    past, psi, level = list(d[::-1][:5]), [1.0], y[-1]
    for h, r in enumerate(out):
        step = float(phi @ past)
        past, level = [step, *past[:-1]], level + step
        spread = sigma * np.sqrt(np.sum(np.cumsum(psi) ** 2))
        assert r.predicted_close == pytest.approx(level, abs=1e-7)
        assert r.predicted_high - level == pytest.approx(forecast.NORMAL_90 * spread, rel=1e-7)
        psi.append(sum(phi[k] * psi[len(psi) - k - 1] for k in range(min(5, len(psi)))))


def test_seasonal_model_finds_the_year(spark):
    """Trend, weekday and waves of the year that the data were made of come back."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(1000)]
    turn = lambda day: 2 * np.pi * (day - dt.date(1970, 1, 1)).days / 365.25
    value = lambda day: float(50 + 0.02 * (day - days[0]).days + 5 * np.sin(turn(day)) - 2 * np.cos(2 * turn(day))
                              + (4 if day.weekday() == 5 else 0))
    df = spark.createDataFrame([("A", day, value(day)) for day in days], "ticker string, trade_date date, close double")
    for r in forecast.forecast(df, "ticker", "trade_date", "close", "trend_weekday").collect():
        assert r.predicted_close == pytest.approx(value(r.forecast_date), abs=1e-5)


def test_chunked_ranges_equal_plain_windows(spark):
    """Day frames over chunks, with gaps, days before 1970, ties and NULL days."""
    from pyspark.sql import Window

    from starwright.operators.ordered import chunked_ranges

    days = [-40, -39, -7, -1, 0, 3, 3, 9, 10, 11, 29, 30, 31, 64, 65, 200, None, None]
    df = spark.createDataFrame([(e, d, float(i)) for e in ("a", "b") for i, d in enumerate(days)],
                               "e string, d int, v double")

    def total(frame, w):
        return frame.withColumn("s", F.sum("v").over(w.rangeBetween(-10, 0)))

    want = rows(total(df, Window.partitionBy("e").orderBy("d")))
    for chunk in (10, 11, 1000):
        assert rows(chunked_ranges(df, ["e"], F.col("d"), total, 10, chunk)) == want
    with pytest.raises(ValueError):
        chunked_ranges(df, ["e"], F.col("d"), total, 11, 10)


def test_rolling_long_forms_equal_the_plain_ones(spark):
    """Chunks of one frame's length, and a benchmark that lacks days."""
    import random

    from starwright.operators import indicators, rolling
    from starwright.operators.ordered import Chunks

    rng = random.Random(5)
    df = spark.createDataFrame(
        [(t, i, 50 + 20 * rng.random()) for t in ("x", "m") for i in range(150)
         if not (t == "m" and i % 7 == 3)], "t string, i int, close double")
    cut = Chunks(F.floor(F.col("i") / 13), 1)

    def same(call, *options, **named):
        plain = call(df, "t", "i", *options, **named)
        long = call(df, "t", "i", *options, **named, chunks=cut)
        numbers = [c for c, k in plain.dtypes if k == "double"]
        short = [f.withColumns({c: F.round(c, 8) + 0.0 for c in numbers}) for f in (plain, long)]
        assert short[0].columns == short[1].columns
        assert rows(short[0]) == rows(short[1])

    same(rolling.sharpe_ratio, window=20)
    same(rolling.drawdown, window=20)
    same(rolling.rolling_beta, "m", window=20)
    same(rolling.momentum_score)
    same(rolling.volatility_regime, short=5, long=20)
    same(rolling.relative_strength, "m", window=10)
    dated = df.withColumn("i", F.expr("date_add(DATE '2024-01-01', i)"))
    plain = indicators.forecast_features(dated, "t", "i", "close")
    long = indicators.forecast_features(dated, "t", "i", "close", chunks=Chunks(F.trunc("i", "month"), 1))
    exact = [c for c, k in plain.dtypes if not c.startswith("rolling")]
    assert rows(plain.select(exact)) == rows(long.select(exact))


def test_window_without_a_partition_is_refused(spark):
    from starwright.operators import indicators

    with pytest.raises(ValueError):
        indicators.window_column(spark.range(3), [], ["id"], "rank()", "r")


def test_dividend_yield_by_chunks_of_days(spark, data):
    from starwright.workload.star import daily_bars

    paid = data.lineitem.select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").alias("trade_date"),
                                F.col("l_tax").alias("amount"))

    def rounded(**named):
        out = rolling.dividend_yield(daily_bars(data), paid, "ticker", "trade_date", **named)
        return rows(out.withColumns({c: F.round(c, 6) for c in ("trailing_dividends", "dividend_yield_pct")}))

    whole = rounded()
    assert whole and rounded(chunk_days=400) == whole
