"""Indicators and rolling analytics over price and event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.operators import indicators as I
from starwright.operators import rolling
from starwright.operators.ordered import Chunks
from starwright.workload.aggregates import r
from starwright.workload.registry import SQL, Data, query
from starwright.workload.star import BARS_SQL, daily_bars, star

W = "WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)"


def frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING)"


def bars_with(data: Data, specs: dict, digits: int = 6):
    out = I.add_indicators(daily_bars(data), specs, "ticker", "trade_date")
    return r(out.select("ticker", "trade_date", *specs), **{n: digits for n in specs})


def ema_sql(column: str, period: int, source: str, name: str) -> str:
    """CTE members ``name`` with the EMA of a column of ``source``: weights a(1 - a)^age, a = 2 / (period + 1),
    over the last 3 periods, made to add up to 1."""
    n = 3 * period
    weights = f"list_transform(range({n}), lambda i: pow(1 - 2.0::DOUBLE / {period + 1}, {n - 1} - i))"
    return f"""
{name}_l AS (
  SELECT *, list({column}) OVER (PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING) AS l,
         count({column}) OVER (PARTITION BY ticker ORDER BY trade_date ROWS {n - 1} PRECEDING) AS n
  FROM {source}),
{name} AS (
  SELECT * EXCLUDE (l, n), CASE WHEN n = {n} THEN
           list_inner_product(list_transform(l, lambda v: coalesce(v, 0))::DOUBLE[],
           {weights}) / list_sum({weights}) END AS {name} FROM {name}_l)"""


@query("w1_sma", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, round(avg(close) OVER {frame(20)}, 6) AS sma_20,
       round(avg(close) OVER {frame(200)}, 6) AS sma_200 FROM bars""")
def sma(data: Data):
    return bars_with(data, {f"sma_{n}": {"indicator": "sma", "period": n, "source": "close"}
                            for n in (20, 200)})


@query("w2_ema", f"""
WITH {BARS_SQL}, {ema_sql('close', 12, 'bars', 'ema_12')}
SELECT ticker, trade_date, round(ema_12, 6) AS ema_12 FROM ema_12""")
def ema(data: Data):
    return bars_with(data, {"ema_12": {"indicator": "ema", "period": 12, "source": "close"}})


RSI_SQL = f"""
moves AS (SELECT *, close - lag(close) OVER w AS chg FROM bars {W}),
gains AS (
  SELECT *, avg(CASE WHEN chg > 0 THEN chg ELSE 0 END) OVER {frame(14)} AS ag,
         avg(CASE WHEN chg < 0 THEN -chg ELSE 0 END) OVER {frame(14)} AS al FROM moves),
rsi AS (SELECT *, coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50) AS rsi_14 FROM gains)"""


@query("w3_rsi", f"""
WITH {BARS_SQL}, {RSI_SQL}
SELECT ticker, trade_date, round(rsi_14, 6) AS rsi_14 FROM rsi""")
def rsi(data: Data):
    return bars_with(data, {"rsi_14": {"indicator": "rsi", "period": 14, "source": "close"}})


@query("w4_atr", f"""
WITH {BARS_SQL},
t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
      FROM bars {W})
SELECT ticker, trade_date, round(avg(tr) OVER {frame(14)}, 6) AS atr_14 FROM t""")
def atr(data: Data):
    return bars_with(data, {"atr_14": {"indicator": "atr", "period": 14}})


@query("w5_bollinger", f"""
WITH {BARS_SQL}, b AS (
  SELECT *, avg(close) OVER {frame(20)} AS m, stddev_samp(close) OVER {frame(20)} AS s FROM bars)
SELECT ticker, trade_date, round(m + 2 * s, 5) AS upper, round(m, 5) AS middle,
       round(m - 2 * s, 5) AS lower FROM b""")
def bollinger(data: Data):
    return bars_with(data, {b: {"indicator": "bollinger", "band": b, "period": 20, "source": "close"}
                            for b in ("upper", "middle", "lower")}, 5)


VOLATILITY_SQL = f"""
rets AS (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS ret
         FROM bars {W})"""


@query("w6_volatility", f"""
WITH {BARS_SQL}, {VOLATILITY_SQL}
SELECT ticker, trade_date, round(stddev_samp(ret) OVER {frame(20)} * sqrt(252), 5) AS vol FROM rets""")
def volatility(data: Data):
    return bars_with(data, {"vol": {"indicator": "volatility", "period": 20, "source": "close"}}, 5)


MACD_SQL = f"""{ema_sql('close', 12, 'bars', 'ema_12')}, {ema_sql('close', 26, 'ema_12', 'ema_26')},
line AS (SELECT *, ema_12 - ema_26 AS macd FROM ema_26), {ema_sql('macd', 9, 'line', 'macd_signal')}"""


@query("w7_w8_w9_macd", f"""
WITH {BARS_SQL}, {MACD_SQL}
SELECT ticker, trade_date, round(macd, 5) AS macd, round(macd_signal, 5) AS macd_signal,
       round(macd - macd_signal, 5) AS macd_histogram FROM macd_signal""")
def macd(data: Data):
    specs = {
        "ema_12": {"indicator": "ema", "period": 12, "source": "close"},
        "ema_26": {"indicator": "ema", "period": 26, "source": "close"},
        "macd": {"indicator": "macd_line"}, "macd_signal": {"indicator": "macd_signal", "signal": 9},
        "macd_histogram": {"indicator": "macd_histogram"}}
    return bars_with(data, specs, 5).drop("ema_12", "ema_26")


@query("w10_volume_ratio", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, round(volume / nullif(avg(volume) OVER {frame(20)}, 0), 6) AS ratio FROM bars""")
def volume_ratio(data: Data):
    return bars_with(data, {
        "volume_sma_20": {"indicator": "sma", "period": 20, "source": "volume"},
        "ratio": {"indicator": "volume_ratio"}}).drop("volume_sma_20")


@query("w11_technicals", f"""
WITH {BARS_SQL}, {RSI_SQL},
t AS (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) * 100 AS daily_return
      FROM rsi {W})
SELECT ticker, trade_date, round(daily_return, 5) AS daily_return,
       round(avg(close) OVER {frame(20)}, 5) AS sma_20, round(avg(close) OVER {frame(50)}, 5) AS sma_50,
       round(avg(close) OVER {frame(200)}, 5) AS sma_200, round(rsi_14, 5) AS rsi_14,
       round(stddev_samp(daily_return) OVER {frame(20)} * sqrt(252), 5) AS volatility_20d,
       round(stddev_samp(daily_return) OVER {frame(60)} * sqrt(252), 5) AS volatility_60d,
       round(avg(close) OVER {frame(20)} + 2 * stddev_samp(close) OVER {frame(20)}, 5) AS bollinger_upper,
       round(avg(close) OVER {frame(20)}, 5) AS bollinger_middle,
       round(avg(close) OVER {frame(20)} - 2 * stddev_samp(close) OVER {frame(20)}, 5) AS bollinger_lower,
       round(avg(volume) OVER {frame(20)}, 5) AS volume_sma_20,
       round(volume / nullif(avg(volume) OVER {frame(20)}, 0), 5) AS volume_ratio FROM t""")
def technicals(data: Data):
    out = I.add_technicals(daily_bars(data), "ticker", "trade_date")
    names = [c for c in out.columns if c not in ("open", "high", "low", "close", "volume")]
    return r(out.select(*names), **{n: 5 for n in names[2:]})


EVENT_FRAME = "(PARTITION BY event_type ORDER BY ts ROWS {} PRECEDING)"


@query("w11_long_series", f"""
WITH m AS (SELECT *, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS chg FROM events),
g AS (SELECT *, avg(CASE WHEN chg > 0 THEN chg ELSE 0 END) OVER {EVENT_FRAME.format(13)} AS ag,
             avg(CASE WHEN chg < 0 THEN -chg ELSE 0 END) OVER {EVENT_FRAME.format(13)} AS al FROM m)
SELECT event_id, round(avg(value) OVER {EVENT_FRAME.format(19)}, 7) AS sma_20,
       round(coalesce(100 - 100 / (1 + ag / nullif(al, 0)), 50), 6) AS rsi_14,
       round(avg(value) OVER {EVENT_FRAME.format(19)} + 2 * stddev_samp(value) OVER {EVENT_FRAME.format(19)}, 6) AS upper
FROM g""")
def long_series(data: Data):
    """Series of all events of a type, cut into chunks with overlap, counted by the minute."""
    specs = {
        "sma_20": {"indicator": "sma", "period": 20, "source": "value"},
        "rsi_14": {"indicator": "rsi", "period": 14, "source": "value"},
        "upper": {"indicator": "bollinger", "band": "upper", "period": 20, "source": "value"}}
    events = data.events.select("event_id", "event_type", "ts", "value")
    out = I.long_indicators(events, specs, ["event_type"], ["ts"], F.date_trunc("minute", "ts"),
                            chunk_rows=1_000)
    return r(out.select("event_id", *specs), sma_20=7, rsi_14=6, upper=6)


@query("w12_window_column", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, CAST(rank() OVER (PARTITION BY ticker, date_trunc('month', trade_date)
       ORDER BY close) AS INTEGER) AS place FROM bars""")
def window_column(data: Data):
    bars = daily_bars(data).withColumn("month", F.trunc("trade_date", "month"))
    return I.window_column(bars, ["ticker", "month"], ["close"], "rank()", "place").select(
        "ticker", "trade_date", "place")


@query("w13_latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders) WHERE n = 1""")
def latest_per_key(data: Data):
    from starwright.operators.setops import latest_per_key as latest

    return latest(data.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("w14_ranked_top", """
SELECT c_custkey, market_cap, rank_no, round(percentile, 6) AS percentile FROM (
  SELECT c_custkey, market_cap,
         CAST(row_number() OVER (ORDER BY market_cap DESC, c_custkey) AS INTEGER) AS rank_no,
         percent_rank() OVER (ORDER BY market_cap DESC) * 100 AS percentile
  FROM (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, c_nationkey * 100.0)::DOUBLE
               AS market_cap FROM customer))
WHERE rank_no <= 50""")
def ranked_top(data: Data):
    cap = F.coalesce(F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")), F.col("c_nationkey") * 100.0)
    out = I.top_ranked(data.customer.select("c_custkey", cap.alias("market_cap")),
                       "c_custkey", "market_cap", 50)
    return r(out, percentile=6)


@query("w15_dense_rank", """
SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS volume,
       dense_rank() OVER (ORDER BY sum(l_quantity) DESC) AS place FROM lineitem GROUP BY 1""")
def dense_rank(data: Data):
    out = I.rank_by_total(data.lineitem, "l_partkey", "l_quantity", "volume", "place")
    return out.withColumn("volume", F.col("volume").cast("long"))


@query("w16_moving_average", f"""
WITH {BARS_SQL} SELECT ticker, trade_date, round(avg(close) OVER {frame(5)}, 6) AS ma_5 FROM bars""")
def moving_average(data: Data):
    return bars_with(data, {"ma_5": {"indicator": "sma", "period": 5, "source": "close"}})


@query("w17_changes", f"""
WITH {BARS_SQL}
SELECT * FROM (
  SELECT ticker, trade_date, close - lag(close) OVER w AS change,
         (close - lag(close) OVER w) / lag(close) OVER w * 100 AS pct_change FROM bars {W})
WHERE change IS NOT NULL""")
def changes(data: Data):
    return I.changes(daily_bars(data), "ticker", "trade_date", "close").select(
        "ticker", "trade_date", "change", "pct_change")


@query("w19_forward_return", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, lead(close, 30) OVER w / close - 1 AS forward_return_30 FROM bars {W}""")
def forward_return(data: Data):
    return I.forward_return(daily_bars(data), "ticker", "trade_date", "close").select(
        "ticker", "trade_date", "forward_return_30")


@query("w20_forecast_features", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, lag(close, 1) OVER w AS lag_1, lag(close, 2) OVER w AS lag_2,
       lag(close, 3) OVER w AS lag_3, lag(close, 5) OVER w AS lag_5, lag(close, 7) OVER w AS lag_7,
       lag(close, 14) OVER w AS lag_14,
""" + ",\n".join(f"""
       round(CASE WHEN count(close) OVER {frame(n)} = {n} THEN avg(close) OVER {frame(n)} END, 6) AS rolling_mean_{n},
       round(CASE WHEN count(close) OVER {frame(n)} = {n} THEN stddev_samp(close) OVER {frame(n)} END, 5) AS rolling_std_{n}"""
                 for n in (5, 10, 20)) + f""",
       CAST((isodow(trade_date) - 1) AS INTEGER) AS day_of_week,
       (isodow(trade_date) = 1)::INTEGER AS is_monday, (isodow(trade_date) = 5)::INTEGER AS is_friday
FROM bars {W}""")
def forecast_features(data: Data):
    out = I.forecast_features(daily_bars(data).select("ticker", "trade_date", "close"),
                              "ticker", "trade_date", "close").drop("close")
    return r(out, **{f"rolling_{k}_{n}": d for n in (5, 10, 20) for k, d in (("mean", 6), ("std", 5))})


# -- rolling analytics -----------------------------------------------------------------

FRACTIONS = f"""
rets AS (SELECT *, (close - lag(close) OVER w) / nullif(lag(close) OVER w, 0) AS ret FROM bars {W})"""


@query("w21_sharpe", f"""
WITH {BARS_SQL}, {FRACTIONS}
SELECT ticker, trade_date, round((avg(ret) OVER {frame(252)} * 252 - 0.045)
       / nullif(stddev_samp(ret) OVER {frame(252)} * sqrt(252), 0), 6) AS sharpe_ratio FROM rets""")
def sharpe(data: Data):
    return r(rolling.sharpe_ratio(daily_bars(data), "ticker", "trade_date"), sharpe_ratio=6)


@query("w22_drawdown", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, close / max(close) OVER {frame(252)} - 1 AS drawdown,
       max(close) OVER {frame(252)} AS peak_price FROM bars""")
def drawdown(data: Data):
    return rolling.drawdown(daily_bars(data), "ticker", "trade_date")


BENCH_SQL = f"""{FRACTIONS},
both_ AS (SELECT r.*, b.ret AS market FROM rets r JOIN rets b
          ON r.trade_date = b.trade_date AND b.ticker = 'N')"""


@query("w23_beta", f"""
WITH {BARS_SQL}, {BENCH_SQL}
SELECT ticker, trade_date, round(covar_samp(ret, market) OVER {frame(252)}
  / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN market END) OVER {frame(252)}, 0), 6) AS beta
FROM both_""")
def beta(data: Data):
    return r(rolling.rolling_beta(daily_bars(data), "ticker", "trade_date", "N"), beta=6)


@query("w24_momentum", f"""
WITH {BARS_SQL}, {RSI_SQL}, {ema_sql('close', 12, 'rsi', 'ema_12')},
{ema_sql('close', 26, 'ema_12', 'ema_26')},
n AS (
  SELECT ticker, trade_date, (rsi_14 - 50) / 50 AS a,
         greatest(-1, least(1, (ema_12 - ema_26) / nullif(close, 0) * 100)) AS b0, ema_26,
         greatest(-1, least(1, (close / nullif(avg(close) OVER {frame(50)}, 0) - 1) * 10)) AS c FROM ema_26),
m AS (SELECT *, CASE WHEN ema_26 IS NULL THEN NULL ELSE b0 END AS b FROM n)
SELECT ticker, trade_date, round(a, 6) AS rsi_norm, round(b, 6) AS macd_norm, round(c, 6) AS price_trend_norm,
       round(a * 0.3 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.4, 6) AS momentum_score FROM m""")
def momentum(data: Data):
    out = rolling.momentum_score(daily_bars(data), "ticker", "trade_date")
    return r(out, momentum_score=6, rsi_norm=6, macd_norm=6, price_trend_norm=6)


@query("w25_regime", f"""
WITH {BARS_SQL}, {FRACTIONS}, v AS (
  SELECT ticker, trade_date, stddev_samp(ret) OVER {frame(20)} * sqrt(252) AS s,
         stddev_samp(ret) OVER {frame(60)} * sqrt(252) AS l FROM rets)
SELECT ticker, trade_date, round(s, 6) AS vol_short_ann, round(l, 6) AS vol_long_ann,
       round(s / nullif(l, 0), 6) AS vol_ratio,
       CASE WHEN s / nullif(l, 0) IS NULL THEN NULL WHEN s / l < 0.8 THEN 'LOW'
            WHEN s / l > 1.2 THEN 'HIGH' ELSE 'NORMAL' END AS regime FROM v""")
def regime(data: Data):
    return r(rolling.volatility_regime(daily_bars(data), "ticker", "trade_date"),
             vol_short_ann=6, vol_long_ann=6, vol_ratio=6)


@query("w26_relative_strength", f"""
WITH {BARS_SQL}, c AS (SELECT *, close / lag(close, 20) OVER w - 1 AS cum FROM bars {W})
SELECT a.ticker, a.trade_date, a.cum - b.cum AS relative_strength, a.cum - b.cum > 0 AS outperforming
FROM c a JOIN c b ON a.trade_date = b.trade_date AND b.ticker = 'N'""")
def relative_strength(data: Data):
    return rolling.relative_strength(daily_bars(data), "ticker", "trade_date", "N")


def npv_sql(keys: str, source: str, amount: str, date: str) -> str:
    return f"""
WITH b AS (SELECT *, min({date}::DATE) OVER (PARTITION BY {keys}) AS d0 FROM {source})
SELECT {keys}, round(sum({amount} / pow(1.05, ({date}::DATE - d0) / 365.0)), 3) AS npv FROM b GROUP BY {keys}"""


@query("w27_npv", npv_sql("o_custkey, o_orderstatus", "orders", "o_totalprice", "o_orderdate"))
def npv(data: Data):
    return r(rolling.net_present_value(
        data.orders, ["o_custkey", "o_orderstatus"], "o_totalprice", "o_orderdate"), npv=3)


@query("w28_velocity", """
WITH d AS (SELECT o_orderstatus, o_orderdate::DATE AS date, sum(o_totalprice) AS amt FROM orders GROUP BY 1, 2),
s AS (SELECT *, sum(amt) OVER (PARTITION BY o_orderstatus ORDER BY date RANGE INTERVAL 29 DAYS PRECEDING) AS a,
             sum(amt) OVER (PARTITION BY o_orderstatus ORDER BY date RANGE INTERVAL 89 DAYS PRECEDING) AS b,
             sum(amt) OVER (PARTITION BY o_orderstatus ORDER BY date RANGE INTERVAL 364 DAYS PRECEDING) AS c FROM d)
SELECT o_orderstatus, date, round(a, 2) AS spend_30d, round(b, 2) AS spend_90d, round(c, 2) AS spend_365d,
       round((a / 30) / nullif(c / 365, 0) - 1, 6) AS trend FROM s""")
def velocity(data: Data):
    out = rolling.spending_velocity(data.orders, ["o_orderstatus"], "o_totalprice", "o_orderdate")
    return r(out, spend_30d=2, spend_90d=2, spend_365d=2, trend=6)


@query("w29_npv_by_category", npv_sql(
    "o_custkey, p_type", "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey "
    "JOIN orders ON l_orderkey = o_orderkey) x", "l_extendedprice", "l_shipdate"))
def npv_by_category(data: Data):
    from starwright.operators.joins import star_join

    c = star(data)
    df = star_join(c.tables, c.edges, ["fact_lineitem", "fact_orders", "dim_part"])
    return r(rolling.net_present_value(df, ["o_custkey", "p_type"], "l_extendedprice", "l_shipdate"), npv=3)


@query("w30_cagr", """
WITH d AS (SELECT o_custkey, o_orderdate::DATE AS d, sum(o_totalprice) AS amt FROM orders GROUP BY 1, 2),
e AS (SELECT o_custkey, arg_min(amt, d) AS a, arg_max(amt, d) AS b, (max(d) - min(d)) / 365.25 AS y FROM d GROUP BY 1)
SELECT o_custkey, CASE WHEN a > 0 AND b > 0 AND y > 0 THEN round((pow(b / a, 1 / y) - 1) * 100, 4) END AS cagr_pct
FROM e""")
def cagr(data: Data):
    return r(rolling.cagr(data.orders, ["o_custkey"], "o_totalprice", "o_orderdate"), cagr_pct=4)


@query("w31_yoy", """
WITH y AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, a.year, round(a.amount, 2) AS amount, round(b.amount, 2) AS prior_amount,
       round((a.amount - b.amount) / nullif(abs(b.amount), 0) * 100, 5) AS yoy_growth_pct
FROM y a LEFT JOIN y b ON a.o_custkey = b.o_custkey AND b.year = a.year - 1""")
def yoy(data: Data):
    df = data.orders.withColumn("year", F.year("o_orderdate"))
    return r(rolling.yoy_growth(df, ["o_custkey"], "o_totalprice", "year"),
             amount=2, prior_amount=2, yoy_growth_pct=5)


@query("w32_budget_variance", """
WITH b AS (
  SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS bud,
         sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice ELSE 0 END) AS act FROM orders GROUP BY 1)
SELECT o_custkey, round(bud, 2) AS budget_amount, round(act, 2) AS actual_amount,
       round(act - bud, 2) AS variance, round((act - bud) / nullif(bud, 0) * 100, 5) AS variance_pct FROM b""")
def budget_variance(data: Data):
    return r(rolling.budget_variance(data.orders, ["o_custkey"], "o_totalprice", "o_orderstatus", "P", ["F", "O"]),
             budget_amount=2, actual_amount=2, variance=2, variance_pct=5)


@query("w33_dividend_yield", f"""
WITH {BARS_SQL},
paid AS (SELECT l_returnflag AS ticker, l_shipdate::DATE AS d, sum(l_tax) AS amt FROM lineitem
         GROUP BY 1, 2),
u AS (SELECT ticker, trade_date AS d, close, 0 AS amt FROM bars
      UNION ALL SELECT ticker, d, NULL, amt FROM paid),
t AS (SELECT *, sum(amt) OVER (PARTITION BY ticker ORDER BY d RANGE INTERVAL 364 DAYS PRECEDING) AS tr FROM u)
SELECT ticker, d AS trade_date, round(tr, 4) AS trailing_dividends, close AS price,
       round(tr / close * 100, 6) AS dividend_yield_pct FROM t WHERE close IS NOT NULL""")
def dividend_yield(data: Data):
    paid = data.lineitem.select(
        F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").alias("trade_date"),
        F.col("l_tax").alias("amount"))
    return r(rolling.dividend_yield(daily_bars(data), paid, "ticker", "trade_date"),
             trailing_dividends=4, dividend_yield_pct=6)


@query("w34_split_adjusted", f"""
WITH {BARS_SQL},
splits AS (SELECT DISTINCT ticker, trade_date AS d, 2.0 AS f FROM bars
           WHERE day(trade_date) = 1 AND month(trade_date) = 1),
u AS (SELECT ticker, trade_date AS d, close, 0.0 AS lf FROM bars UNION ALL SELECT ticker, d, NULL, ln(f) FROM splits),
t AS (SELECT *, exp(sum(lf) OVER (PARTITION BY ticker ORDER BY d)) AS cum FROM u),
f AS (SELECT ticker, arg_min(close, trade_date) AS c0 FROM bars GROUP BY 1)
SELECT t.ticker, d AS trade_date, close / c0 - 1 AS raw_return, round(cum, 6) AS split_factor_cum,
       round(close * cum / c0 - 1, 6) AS adjusted_return FROM t JOIN f USING (ticker) WHERE close IS NOT NULL""")
def split_adjusted(data: Data):
    bars = daily_bars(data)
    splits = bars.filter("dayofmonth(trade_date) = 1 AND month(trade_date) = 1").select(
        "ticker", "trade_date", F.lit(2.0).alias("split_factor"))
    return r(rolling.split_adjusted_return(bars, splits, "ticker", "trade_date"),
             split_factor_cum=6, adjusted_return=6)


QUARTERS_SQL = """
q AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, sum(o_totalprice) AS eps,
             sum(o_totalprice) * 0.9 + 10000 AS est FROM orders GROUP BY 1, 2)"""
QF = "(PARTITION BY o_custkey ORDER BY quarter ROWS 7 PRECEDING)"


def quarters(data: Data):
    q = data.orders.groupBy(
        "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter")
    ).agg(F.sum("o_totalprice").alias("eps"))
    return q.withColumn("est", F.col("eps") * 0.9 + 10000)


@query("w35_eps_trend", f"""
WITH {QUARTERS_SQL}, n AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY quarter) AS i,
         lag(eps) OVER (PARTITION BY o_custkey ORDER BY quarter) AS p1,
         lag(eps, 4) OVER (PARTITION BY o_custkey ORDER BY quarter) AS p4 FROM q),
s AS (SELECT *, regr_slope(eps, i) OVER {QF} AS slope FROM n)
SELECT o_custkey, quarter, round((eps - p1) / nullif(abs(p1), 0), 5) AS eps_qoq_growth,
       round((eps - p4) / nullif(abs(p4), 0), 5) AS eps_yoy_growth,
       round(CASE WHEN NOT isnan(slope) THEN slope END, 6) AS eps_trend_slope FROM s""")
def eps_trend(data: Data):
    return r(rolling.eps_trend(quarters(data), "o_custkey", "quarter", "eps"),
             eps_qoq_growth=5, eps_yoy_growth=5, eps_trend_slope=6)


@query("w36_estimate_accuracy", f"""
WITH {QUARTERS_SQL}, m AS (
  SELECT o_custkey, quarter, avg(abs(eps - est)) OVER {QF} AS mae, avg(eps - est) OVER {QF} AS bias,
         avg(abs(eps)) OVER {QF} AS size FROM q)
SELECT o_custkey, quarter, round(mae, 7) AS mae, round(bias, 7) AS bias,
       round(CASE WHEN size <> 0 THEN greatest(0, 1 - mae / size) * 100 END, 5) AS accuracy_pct FROM m""")
def estimate_accuracy(data: Data):
    return r(rolling.estimate_accuracy(quarters(data), "o_custkey", "quarter", "eps", "est"),
             mae=7, bias=7, accuracy_pct=5)


@query("w37_compliance", """
WITH d AS (SELECT o_orderpriority, o_orderdate::DATE AS date, sum((o_orderstatus = 'F')::INT) AS p, count(*) AS n
           FROM orders GROUP BY 1, 2),
a AS (SELECT *, sum(p) OVER w / sum(n) OVER w * 100 AS rate FROM d
      WINDOW w AS (PARTITION BY o_orderpriority ORDER BY date RANGE INTERVAL 364 DAYS PRECEDING)),
s AS (SELECT *, regr_slope(rate, date - DATE '1970-01-01') OVER
        (PARTITION BY o_orderpriority ORDER BY date RANGE INTERVAL 364 DAYS PRECEDING) AS raw FROM a),
b AS (SELECT *, CASE WHEN NOT isnan(raw) THEN raw END AS slope FROM s)
SELECT o_orderpriority, date, round(rate, 6) AS rolling_pass_rate, round(slope, 6) AS trend_slope,
       CASE WHEN slope IS NULL THEN NULL WHEN slope > 0.001 THEN 'improving' WHEN slope < -0.001 THEN 'declining'
            ELSE 'stable' END AS trend_direction FROM b""")
def compliance(data: Data):
    out = rolling.compliance_trend(data.orders, "o_orderpriority", "o_orderdate", "o_orderstatus = 'F'", flat=0.001)
    return r(out, rolling_pass_rate=6, trend_slope=6)


@query("w38_repeat_offender", """
SELECT o_custkey, round(sum(pow(0.9, age / 30.0)), 6) AS risk_score, count(*) AS failure_count,
       CAST(min(age) AS INTEGER) AS days_since_last_failure
FROM (SELECT o_custkey, DATE '2000-12-31' - o_orderdate::DATE AS age FROM orders WHERE o_orderstatus = 'F')
WHERE age BETWEEN 0 AND 730 GROUP BY 1""")
def repeat_offender(data: Data):
    out = rolling.repeat_offender(data.orders, "o_custkey", "o_orderdate", "o_orderstatus = 'F'", "2000-12-31")
    return r(out, risk_score=6)


# -- the same over series cut into chunks -----------------------------------------------

def monthly(rows: int) -> Chunks:
    return Chunks(F.trunc("trade_date", "month"), rows)


@query("w20_features_chunked", SQL["w20_forecast_features"])
def features_chunked(data: Data):
    out = I.forecast_features(daily_bars(data).select("ticker", "trade_date", "close"),
                              "ticker", "trade_date", "close", chunks=monthly(100)).drop("close")
    return r(out, **{f"rolling_{k}_{n}": d for n in (5, 10, 20) for k, d in (("mean", 6), ("std", 5))})


@query("w21_sharpe_chunked", SQL["w21_sharpe"])
def sharpe_chunked(data: Data):
    return r(rolling.sharpe_ratio(daily_bars(data), "ticker", "trade_date", chunks=monthly(500)), sharpe_ratio=6)


@query("w23_beta_chunked", SQL["w23_beta"])
def beta_chunked(data: Data):
    return r(rolling.rolling_beta(daily_bars(data), "ticker", "trade_date", "N", chunks=monthly(500)), beta=6)


@query("w24_momentum_chunked", SQL["w24_momentum"])
def momentum_chunked(data: Data):
    out = rolling.momentum_score(daily_bars(data), "ticker", "trade_date", chunks=monthly(200))
    return r(out, momentum_score=6, rsi_norm=6, macd_norm=6, price_trend_norm=6)


@query("w28_velocity_chunked", SQL["w28_velocity"])
def velocity_chunked(data: Data):
    out = rolling.spending_velocity(data.orders, ["o_orderstatus"], "o_totalprice", "o_orderdate", chunk_days=400)
    return r(out, spend_30d=2, spend_90d=2, spend_365d=2, trend=6)


@query("w37_compliance_chunked", SQL["w37_compliance"])
def compliance_chunked(data: Data):
    out = rolling.compliance_trend(data.orders, "o_orderpriority", "o_orderdate", "o_orderstatus = 'F'",
                                   flat=0.001, chunk_days=800)
    return r(out, rolling_pass_rate=6, trend_slope=6)
