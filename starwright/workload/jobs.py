"""Recipes, forecasts, model accuracy and name matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from starwright.operators import forecast as fc
from starwright.operators import matching
from starwright.plans import recipes
from starwright.session import scratch_path
from starwright.workload.aggregates import r
from starwright.workload.registry import SQL, Data, query
from starwright.workload.star import BARS_SQL, daily_bars


@query("u1_recipe", """
SELECT p_brand, CAST(sum(l_quantity) AS BIGINT) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 5 AND l_returnflag = 'N' GROUP BY 1""")
def recipe(data: Data):
    out = recipes.Recipe().run(data.lineitem, [
        {"op": "filter", "conditions": ["l_quantity > 5", "l_returnflag = 'N'"]},
        {"op": "derive", "expressions": {"net": "l_extendedprice * (1 - l_discount)"}},
        {"op": "enrich", "params": {"table": data.part, "join": ["l_partkey=p_partkey"], "columns": ["p_brand"]}},
        {"op": "no_such_step"},
        {"op": "select", "columns": ["p_brand", "l_quantity", "net"]},
        {"op": "aggregate", "params": {"group_by": ["p_brand"], "aggs": [
            {"func": "SUM", "col": "l_quantity", "alias": "qty"}, {"func": "sum", "col": "net", "alias": "net"}]}},
    ])
    return r(out.withColumn("qty", F.col("qty").cast("long")), net=2)


@query("u1_recipe_reshape", """
SELECT o_orderstatus, round(max(v) FILTER (WHERE k = 'a'), 2) AS a, round(max(v) FILTER (WHERE k = 'b'), 2) AS b FROM (
  SELECT o_orderstatus, 'a' AS k, o_totalprice AS v FROM orders
  UNION ALL SELECT o_orderstatus, 'b', o_totalprice * 2 FROM orders) GROUP BY 1""")
def recipe_reshape(data: Data):
    out = recipes.Recipe().run(data.orders, [
        {"op": "select", "columns": {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus",
                                     "a": "o_totalprice", "b": "o_totalprice * 2"}},
        {"op": "dedup", "keys": ["o_orderkey"]},
        {"op": "unpivot", "params": {"id_cols": ["o_orderkey", "o_orderstatus"], "value_cols": ["a", "b"],
                                     "var_name": "k", "val_name": "v"}},
        {"op": "drop", "columns": ["o_orderkey"]},
        {"op": "pivot", "params": {"rows": ["o_orderstatus"], "cols": ["k"], "measures": [["v", "v", "max"]]}},
    ])
    return r(out, a=2, b=2)


@query("u2_custom_step", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 10")
def custom_step(data: Data):
    book = recipes.Recipe().register("count_by", lambda df, p: df.groupBy(*p["keys"]).agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > p["above"]))
    return book.run(data.customer, [{"op": "count_by", "keys": ["c_mktsegment"], "above": 10}])


@query("u3_function_step", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def function_step(data: Data):
    return recipes.Recipe().run(data.customer, [
        {"op": "hook", "fn": "starwright.operators.filters.where_all", "conditions": ["c_acctbal > 0"]},
        {"op": "select", "columns": ["c_custkey", "c_acctbal"]}])


@query("u1_indicator_table", f"""
WITH {BARS_SQL}
SELECT ticker, trade_date, ticker || '_' || strftime(trade_date, '%Y%m%d') AS bar_code,
       round(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 9 PRECEDING), 6) AS sma_10 FROM bars""")
def indicator_table(data: Data):
    out = recipes.indicator_table(daily_bars(data), [
        ["ticker", "string"], ["trade_date", "date"],
        ["bar_code", "string", False, "", {"derived": "concat(ticker, '_', date_format(trade_date, 'yyyyMMdd'))"}],
        ["sma_10", "double", True, "", {"indicator": "sma", "period": 10, "source": "close"}],
    ], "ticker", "trade_date")
    return r(out, sma_10=6)


def solve_sql(size: int) -> str:
    """CTE members: the equations ``gram (entity, m)`` eliminated column by column, and their solution ``beta``."""
    return f"""
solve(entity, k, m, diagonal) AS (
  SELECT entity, 0, m, list_transform(range(1, {size + 1}), lambda i: m[i][i]) FROM gram
  UNION ALL
  SELECT entity, k + 1, CASE WHEN m[k + 1][k + 1] > 1e-10 * diagonal[k + 1] THEN list_transform(m, lambda line, i:
      CASE WHEN i = k + 1 THEN line ELSE list_transform(line, lambda v, j: v - line[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END)
      ELSE m END, diagonal FROM solve WHERE k < {size}),
beta AS (SELECT entity, list_transform(range(1, {size + 1}), lambda i: CASE WHEN m[i][i] > greatest(1e-10 * diagonal[i], 0)
    THEN m[i][{size + 1}] / m[i][i] ELSE 0 END) AS beta FROM solve WHERE k = {size})"""


def gram_sql(columns: list[str], target: str) -> str:
    return "[" + ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in [*columns, target]) + "]" for a in columns) + "]"


def ar_sql(bars: str) -> str:
    """AR(5) on first differences of the last 252 rows of ``bars (entity, day, y)``, 30 steps by recursion."""
    lags = [f"d{k}" for k in range(1, 6)]
    return f"""
WITH RECURSIVE {bars},
cut AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM bars_y QUALIFY back <= 252),
moves AS (SELECT *, y - lag(y) OVER (PARTITION BY entity ORDER BY day) AS d FROM cut),
lagged AS (SELECT *, {", ".join(f"lag(d, {k}) OVER (PARTITION BY entity ORDER BY day) AS d{k}" for k in range(1, 6))} FROM moves),
ends AS (SELECT entity, day AS last, y AS level, [d, d1, d2, d3, d4] AS past FROM lagged WHERE back = 1),
sizes AS (SELECT entity, count(*) AS n FROM cut GROUP BY 1),
gram AS (SELECT entity, {gram_sql(lags, "d")} AS m, sum(d * d) AS squares, count(*) AS n FROM lagged
  WHERE d5 IS NOT NULL GROUP BY 1),{solve_sql(5)},
fit AS (SELECT entity, beta, last, level, past,
    sqrt(greatest(squares - list_inner_product(beta, list_transform(m, lambda line: line[6])), 0) / greatest(gram.n - 5, 1)) AS sigma
  FROM beta JOIN gram USING (entity) JOIN ends USING (entity) JOIN sizes USING (entity) WHERE sizes.n >= 60),
ahead(entity, h, past, moved, pulse, response, power) AS (
  SELECT entity, 0, past, 0.0::DOUBLE, [0.0, 0, 0, 0, 0]::DOUBLE[], 0.0::DOUBLE, 0.0::DOUBLE FROM fit
  UNION ALL
  SELECT entity, h + 1, [step] || past[1:4], moved + step, [psi] || pulse[1:4], response + psi, power + (response + psi) ** 2
  FROM (SELECT a.*, list_inner_product(beta, a.past) AS step,
               CASE WHEN h = 0 THEN 1.0 ELSE list_inner_product(beta, pulse) END AS psi
        FROM ahead a JOIN fit USING (entity) WHERE h < 30))
SELECT entity, last + h AS forecast_date, h::INTEGER AS horizon_days, round(level + moved, 3) AS predicted_close,
       round(level + moved - 1.6448536269514722 * sigma * sqrt(power), 3) AS predicted_low,
       round(level + moved + 1.6448536269514722 * sigma * sqrt(power), 3) AS predicted_high, 'ar_5_1_0' AS model_type
FROM ahead JOIN fit USING (entity) WHERE h > 0
UNION ALL SELECT entity, NULL, NULL, NULL, NULL, NULL, 'too_short' FROM sizes WHERE n < 60"""


def seasonal_sql(bars: str) -> str:
    """Trend, weekdays and waves of the year over the last 1095 rows of ``bars (entity, day, y)``."""
    def columns(day: str) -> list[str]:
        number = f"date_diff('day', DATE '1970-01-01', {day})"
        turn = f"({number} * {2 * 3.141592653589793 / 365.25!r})"
        return ["1.0::DOUBLE", f"(date_diff('day', start, {day}) / 365.25)",
                *[f"(isodow({day}) = {k})::INTEGER::DOUBLE" for k in range(2, 8)],
                *[f"CASE WHEN yearly THEN {f}({turn} * {k}) ELSE 0 END" for k in (1, 2, 3) for f in ("sin", "cos")]]

    size = len(columns("day"))
    names = [f"x{i}" for i in range(size)]
    return f"""
WITH RECURSIVE {bars},
cut AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS back FROM bars_y QUALIFY back <= 1095),
ends AS (SELECT entity, min(day) AS start, max(day) AS last, date_diff('day', min(day), max(day)) >= 730 AS yearly,
         count(*) AS n FROM cut GROUP BY 1),
x AS (SELECT entity, y, {", ".join(f"{c} AS x{i}" for i, c in enumerate(columns("day")))} FROM cut JOIN ends USING (entity)),
gram AS (SELECT entity, {gram_sql(names, "y")} AS m, sum(y * y) AS squares FROM x GROUP BY 1),{solve_sql(size)},
fit AS (SELECT ends.*, beta,
    sqrt(greatest(squares - list_inner_product(beta, list_transform(m, lambda line: line[{size + 1}])), 0)
         / greatest(n - {size}, 1)) AS sigma
  FROM beta JOIN gram USING (entity) JOIN ends USING (entity) WHERE n >= 60),
ahead AS (SELECT *, (last + h::INTEGER)::DATE AS day FROM fit, range(1, 31) AS r(h)),
made AS (SELECT *, list_inner_product(beta, [{", ".join(columns("day"))}]::DOUBLE[]) AS p FROM ahead)
SELECT entity, day AS forecast_date, h::INTEGER AS horizon_days, round(p, 3) AS predicted_close,
       round(p - 1.6448536269514722 * sigma, 3) AS predicted_low, round(p + 1.6448536269514722 * sigma, 3) AS predicted_high,
       'trend_weekday' AS model_type FROM made
UNION ALL SELECT entity, NULL, NULL, NULL, NULL, NULL, 'too_short' FROM ends WHERE n < 60"""


CLOSES_SQL = f"{BARS_SQL}, bars_y AS (SELECT ticker AS entity, trade_date AS day, close AS y FROM bars)"
REVENUE_SQL = """bars_y AS (
  SELECT 's' || l_suppkey AS entity, l_shipdate::DATE AS day, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'p' || l_partkey, l_shipdate::DATE, sum(l_extendedprice) FROM lineitem GROUP BY 1, 2)"""


def revenue(data: Data):
    """Daily revenue of every supplier, a long series, and of every part, a short one."""
    def of(prefix: str, key: str):
        return data.lineitem.groupBy(F.concat(F.lit(prefix), F.col(key)).alias("entity"),
                                     F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_extendedprice").alias("y"))

    return of("s", "l_suppkey").unionByName(of("p", "l_partkey"))


PREDICTED = {"predicted_close": 3, "predicted_low": 3, "predicted_high": 3}


@query("u4_forecast_ar", ar_sql(CLOSES_SQL))
def forecast_ar(data: Data):
    return r(fc.forecast(daily_bars(data), "ticker", "trade_date", "close", "ar"), **PREDICTED)


@query("u4_forecast_many", ar_sql(REVENUE_SQL))
def forecast_many(data: Data):
    """Series that are too short are told, not dropped."""
    return r(fc.forecast(revenue(data), "entity", "day", "y", "ar"), **PREDICTED)


@query("u5_forecast_trend_weekday", seasonal_sql(CLOSES_SQL))
def forecast_trend_weekday(data: Data):
    return r(fc.forecast(daily_bars(data), "ticker", "trade_date", "close", "trend_weekday"), **PREDICTED)


@query("u5_forecast_many", seasonal_sql(REVENUE_SQL))
def forecast_seasonal_many(data: Data):
    return r(fc.forecast(revenue(data), "entity", "day", "y", "trend_weekday"), **PREDICTED)


@query("u4_history_cut", f"""
WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS i FROM bars)
SELECT ticker AS entity, count(*) AS n, min(trade_date) AS first_day, max(trade_date) AS last_day
FROM n WHERE i <= 252 GROUP BY 1""")
def history_cut(data: Data):
    return fc.recent_history(daily_bars(data), "ticker", "trade_date", "close").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("u6_random_forest", f"""
WITH {BARS_SQL}, lagged AS (
  SELECT *, lag(close, 14) OVER w AS oldest, count(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING) AS n,
         lag(close) OVER w AS before FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
split AS (SELECT *, ('0x' || substr(md5(ticker || '|' || trade_date::VARCHAR || '|42'), 1, 6))::BIGINT % 1000 >= 800 AS test
  FROM lagged WHERE n = 20 AND oldest IS NOT NULL)
SELECT count(*) FILTER (WHERE test) AS test_rows, count(*) FILTER (WHERE NOT test) AS train_rows,
       round(sqrt(avg((close - before) ** 2) FILTER (WHERE test)), 4) AS naive_rmse, true AS better_than_naive FROM split""")
def random_forest(data: Data):
    """Rows of both shares, and whether the forest beats the value of the day before."""
    _, metrics = fc.random_forest(daily_bars(data), "ticker", "trade_date", "close")
    return r(metrics.select("test_rows", "train_rows", "naive_rmse",
                            (F.col("rmse") < F.col("naive_rmse")).alias("better_than_naive")), naive_rmse=4)


@query("u7_accuracy", f"""
WITH {BARS_SQL}, p AS (SELECT ticker, close AS a, lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS p FROM bars)
SELECT ticker, round(avg(abs((a - p) / nullif(a, 0)) * 100), 6) AS mape,
       round(1 - sum((a - p) * (a - p)) / (var_pop(CASE WHEN p IS NOT NULL THEN a END) * count(a - p)), 8) AS r2,
       round(avg(CASE WHEN abs((a - p) / nullif(a, 0)) <= 0.05 THEN 100.0 WHEN p IS NOT NULL THEN 0 END), 6) AS within_pct,
       count(a - p) AS points FROM p GROUP BY 1""")
def accuracy(data: Data):
    """The price of the day before taken as the forecast."""
    from starwright.operators.indicators import series_window

    naive = daily_bars(data).withColumn("p", F.lag("close").over(series_window("ticker", "trade_date")))
    return r(fc.accuracy(naive, "close", "p", ["ticker"]), mape=6, r2=8, within_pct=6)


@query("u8_resolve_names", """
WITH canon AS (SELECT DISTINCT p_name AS c FROM part), n AS (SELECT count(*) AS n FROM canon),
names AS (SELECT DISTINCT name FROM (
  SELECT upper(p_name) AS name FROM part
  UNION ALL SELECT p_name || ' ' || lower(p_type) FROM part
  UNION ALL SELECT p_brand FROM part)),
master AS (SELECT name, min(c) AS m FROM names JOIN canon ON lower(trim(name)) = lower(trim(c)) GROUP BY 1),
open AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM master)),
words AS (
  SELECT 'c' AS side, c AS k, ' ' || unnest(string_split(lower(c), ' ')) || ' ' AS w FROM canon
  UNION ALL SELECT 'n', name, ' ' || unnest(string_split(lower(name), ' ')) || ' ' FROM open),
grams AS (
  SELECT side, k, substr(w, i, s) AS g, count(*) AS tf FROM words, (VALUES (2), (3), (4)) z(s), range(1, 100) t(i)
  WHERE i + s - 1 <= length(w) GROUP BY 1, 2, 3),
idf AS (SELECT g, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM grams WHERE side = 'c' GROUP BY 1),
x AS (SELECT side, k, g, tf * idf AS x FROM grams JOIN idf USING (g)),
v AS (SELECT side, k, g, x / sqrt(sum(x * x) OVER (PARTITION BY side, k)) AS w FROM x),
sim AS (SELECT a.k AS name, b.k AS c, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.g = b.g AND a.side = 'n' AND b.side = 'c'
        GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8),
best AS (SELECT name, arg_min(c, (round(-s, 9), c)) AS c, max(s) AS s FROM sim GROUP BY 1)
SELECT names.name, coalesce(m, best.c, names.name) AS canonical,
       round(CASE WHEN m IS NOT NULL THEN 1 ELSE coalesce(s, 0) END, 6) AS confidence,
       CASE WHEN m IS NOT NULL THEN 'MASTER' WHEN best.c IS NOT NULL THEN 'COSINE' ELSE 'UNMATCHED' END AS method
FROM names LEFT JOIN master ON names.name = master.name LEFT JOIN best ON names.name = best.name""")
def resolve_names(data: Data):
    raw = data.part.select(F.upper("p_name").alias("raw")).unionByName(
        data.part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("raw"))).unionByName(
        data.part.select(F.col("p_brand").alias("raw")))
    return r(matching.resolve_names(raw, "raw", data.part, "p_name", threshold=0.8), confidence=6)


@query("u8_learned_aliases", f"""
SELECT name, canonical, confidence,
       CASE WHEN method = 'COSINE' AND name NOT LIKE 'Brand#%' THEN 'ALIAS' ELSE method END AS method
FROM ({SQL["u8_resolve_names"]}) resolved""")
def learned_aliases(data: Data):
    """A first load teaches the aliases; the second holds its names again, and new ones."""
    path = scratch_path(data.spark, "u8-aliases")
    first = data.part.select(F.upper("p_name").alias("raw")).unionByName(
        data.part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("raw")))
    second = first.unionByName(data.part.select(F.col("p_brand").alias("raw")))
    for raw in (first, second):
        out = matching.resolve_and_learn(raw, "raw", data.part, "p_name", path, threshold=0.8)
    return r(out, confidence=6)


@query("u8_match_texts", """
WITH texts AS (SELECT DISTINCT 'c' AS side, md5(text) AS k, text AS t FROM benchmark
               UNION ALL SELECT DISTINCT 'n', md5(text), text FROM documents),
n AS (SELECT count(*) AS n FROM texts WHERE side = 'c'),
words AS (SELECT side, k, unnest(regexp_split_to_array(lower(trim(t)), '\\s+')) AS w FROM texts),
counted AS (SELECT side, k, ' ' || w || ' ' AS w, count(*) AS times FROM words WHERE w <> '' GROUP BY 1, 2, 3),
vocabulary AS (SELECT w, substr(w, i, s) AS g FROM (SELECT DISTINCT w FROM counted),
               (VALUES (2), (3), (4)) z(s), range(1, 200) t(i) WHERE i + s - 1 <= length(w)),
grams AS (SELECT side, k, g, sum(times) AS tf FROM counted JOIN vocabulary USING (w) GROUP BY 1, 2, 3),
idf AS (SELECT g, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM grams WHERE side = 'c' GROUP BY 1),
x AS (SELECT side, k, g, tf * idf AS x FROM grams JOIN idf USING (g)),
norms AS (SELECT side, k, sqrt(sum(x * x)) AS l FROM x GROUP BY 1, 2),
v AS (SELECT side, k, g, x / l AS w FROM x JOIN norms USING (side, k))
SELECT a.k AS document, b.k AS item, round(sum(a.w * b.w), 6) AS similarity
FROM v a JOIN v b ON a.g = b.g AND a.side = 'n' AND b.side = 'c' GROUP BY a.k, b.k HAVING sum(a.w * b.w) >= 0.85""")
def match_texts(data: Data):
    """Documents against the benchmark items over their whole texts."""
    pairs = matching.cosine_matches(data.documents, "text", data.benchmark, "text", 0.85)
    return r(pairs.select(F.md5("name").alias("document"), F.md5("canonical").alias("item"), "similarity"),
             similarity=6)
