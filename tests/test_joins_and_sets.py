from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from starwright.functions import measures as M
from starwright.operators import joins, quality, setops
from starwright.operators.quantiles import exact_percentiles
from starwright.plans.catalog import Catalog

EDGES = [
    joins.edge("fact_prices", "dim_stock", "security_id"),
    joins.edge("dim_stock", "dim_company", "company_id=id"),
    joins.edge("fact_prices", "dim_calendar", "date_id"),
]


@pytest.fixture(scope="module")
def star(spark):
    return {
        "fact_prices": spark.createDataFrame([(1, 10, 5.0), (2, 10, 6.0), (9, 11, 7.0)],
                                             "security_id int, date_id int, close double"),
        "dim_stock": spark.createDataFrame([(1, 100, "A"), (2, None, "B")],
                                           "security_id int, company_id int, ticker string"),
        "dim_company": spark.createDataFrame([(100, "Acme")], "id int, name string"),
        "dim_calendar": spark.createDataFrame([(10, 2020), (11, 2021)], "date_id int, year int"),
    }


def test_join_paths():
    path = joins.join_path(EDGES, "fact_prices", "dim_company")
    assert [e.right for e in path] == ["dim_stock", "dim_company"]
    assert [e.right for e in joins.join_path(EDGES, "dim_company", "dim_calendar")] == [
        "dim_stock", "fact_prices", "dim_calendar"]
    assert joins.join_path(EDGES, "dim_stock", "dim_stock") == []
    assert joins.join_path(EDGES, "dim_stock", "nowhere") is None
    domains = {"dim_stock": "stocks", "dim_company": "corporate"}
    assert joins.join_path(EDGES, "fact_prices", "dim_company", {"stocks"}, domains) is None
    assert joins.reachable_domains(["a"], {"a": ["b"], "b": ["c", "a"]}) == {"a", "b", "c"}


def test_star_join_adds_intermediate_tables(star):
    df = joins.star_join(star, EDGES, ["fact_prices", "dim_company"])
    assert rows(df.select("close", "name")) == [(5.0, "Acme")]


def test_optional_edges_keep_rows(star):
    edges = [joins.edge("fact_prices", "dim_stock", "security_id", optional=True)]
    df = joins.star_join(star, edges, ["fact_prices", "dim_stock"])
    assert rows(df.select("fact_prices.security_id", "ticker")) == [(1, "A"), (2, "B"), (9, None)]


def test_all_key_pairs_count(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "x int, y int")
    df = joins.star_join({"a": a, "b": a}, [joins.edge("a", "b", "x=x", "y=y")])
    assert df.count() == 2


def test_cross_join_only_when_allowed(star):
    apart = {"a": star["dim_company"], "b": star["dim_calendar"]}
    with pytest.raises(ValueError):
        joins.star_join(apart, [])
    assert joins.star_join(apart, [], allow_cross=True).count() == 2


def test_enrich_keeps_unmatched(star):
    out = joins.enrich(star["fact_prices"], star["dim_stock"], ["security_id"], ["ticker"])
    assert rows(out.select("security_id", "ticker")) == [(1, "A"), (2, "B"), (9, None)]


def test_fan_out(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (1,), (2,)], "k int")
    got = joins.fan_out(left, right, ("k", "k")).first().asDict()
    assert got == {"rows_before": 3, "rows_after": 4, "max_matches": 3, "explodes": True}


def test_field_resolution(spark, star):
    c = Catalog()
    c.add("securities", "dim_security", star["dim_stock"])
    c.add("securities.stocks", "fact_prices", star["fact_prices"], {"price": "close"})
    assert c.resolve("securities.stocks.price").column == "close"
    assert c.resolve("securities.ticker").table == "dim_security"
    assert c.resolve("securities.stocks.fact_prices.date_id").table == "fact_prices"
    assert c.find("securities.nothing") is None


def test_keep_one(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "z"), (1, 2, "a"), (2, 9, None)], "k int, o int, v string")
    assert rows(setops.keep_one(df, ["k"], ["o"])) == [(1, 2, "a"), (2, 9, None)]
    assert rows(setops.keep_one(df, ["k"], ["o"], latest=True)) == [(1, 3, "c"), (2, 9, None)]
    assert setops.keep_one(df, []).count() == 4


def test_keep_one_with_maps(spark):
    df = spark.createDataFrame([(1, {"a": 2}), (1, {"a": 1}), (2, None)], "k int, m map<string,int>")
    assert rows(setops.keep_one(df, ["k"])) == [(1, {"a": 1}), (2, None)]


def test_unpivot_pivot_identity(spark):
    df = spark.createDataFrame([(1, 1.5, 2.5), (2, None, 4.0)], "id int, a double, b double")
    long = setops.unpivot_coded(df, {"a": "A", "b": "B"})
    assert rows(long) == [(1, "A", 1.5), (1, "B", 2.5), (2, "B", 4.0)]
    back = long.groupBy("id").pivot("line_item_code", ["A", "B"]).agg(F.max("value"))
    assert rows(back) == rows(df)


def test_union_sources_skips_missing(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id int")
    out = setops.union_sources([{"df": df, "event_type": "x"},
                                {"df": lambda: spark.read.parquet(str(tmp_path / "none"))}])
    assert rows(out) == [(1, "x")]
    with pytest.raises(ValueError):
        setops.union_sources([{"df": lambda: spark.read.parquet(str(tmp_path / "none"))}])


def test_measures_zero_denominators(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    out = M.aggregate(df, [], [["x", "b", "sum"], ["y", "a", "sum"], ["r", {"fn": "divide", "a": "x", "b": "y"}],
                               ["p", {"fn": "rate", "events": "x", "exposed": "y"}]])
    assert rows(out) == [(1.0, 0.0, None, None)]
    with pytest.raises(ValueError):
        M.aggregate(df, [], [["x", "b", "sum"], ["z", {"fn": "power", "a": "x"}]])


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], [5.0] * 50 + [1.0], list(map(float, range(101))),
                                    [float(i * i % 37) for i in range(500)]])
def test_exact_percentiles(spark, values):
    import numpy as np

    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), (None, 3.0)], "k string, v double")
    got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", probs, list("uvwxyz"), accuracy=50).collect()}
    assert [got["a"][c] for c in "uvwxyz"] == pytest.approx(list(np.quantile(values, probs)))
    assert got[None]["x"] == 3.0 and "b" not in got


def test_exact_percentiles_on_a_hot_group(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(5_000)).cast("double").alias("v"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("m")).collect()}
    got = {r.k: r.p50 for r in exact_percentiles(df, ["k"], "v", [0.5], accuracy=200).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("groups", [0, 50_000])
def test_exact_percentiles_move_no_raw_rows(spark, monkeypatch, threshold, groups):
    """Neither a cartesian product nor a shuffle of the facts by their group, with many groups or few."""
    from starwright.operators import quantiles

    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", groups)
    frames, order = [], quantiles.GlobalOrder
    monkeypatch.setattr(quantiles, "GlobalOrder", lambda df, by: (frames.append(df), order(df, by))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.range(3_000).select((F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"))
        for by in (["k"], []):
            frames.clear()
            got = sorted(tuple(r) for r in exact_percentiles(df, by, "v", [0.9, 0.25], accuracy=300).collect())
            want = df.groupBy(*by).agg(F.percentile("v", 0.9).alias("a"), F.percentile("v", 0.25).alias("b"))
            assert got == sorted(tuple(r) for r in want.collect())
            plan = frames[-1]._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
            if by and groups:
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert exact_percentiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_quality_statistics_of_all_numeric_columns(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (3, 9.0, "y")], "a int, b double, e string")
    got = {r.item: r.value for r in quality.report(df, quality.Checks(numeric=["a", "b", "e"])).collect()
           if r.kind == "metric"}
    assert (got["a_mean"], got["b_mean"], got["a_max"], got["b_min"]) == (2.0, 7.0, 3.0, 5.0)
    assert "e_max" not in got and "b_std" in got


def test_quality_report(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, None, "y"), (3, 50.0, "y")], "id int, v double, e string")
    checks = quality.Checks(required=["id", "v"], optional=["w"], numeric=["v", "e"], ranges={"v": (6, 40)},
                            null_shares={"v": 0.1}, min_rows=5, entity="e")
    rep = quality.report(df, checks)
    issues = {(r.level, r.category, r.item) for r in rep.filter("kind = 'issue'").collect()}
    assert issues == {("error", "coverage", "rows"), ("error", "type", "e"), ("warning", "column", "w"),
                      ("warning", "range", "v"), ("warning", "quality", "v")}
    assert quality.is_valid(rep).first()["valid"] is False
    ok = quality.report(df.filter("v = 5"), quality.Checks(required=["id", "v"], numeric=["v"], ranges={"v": (1, None)}))
    assert quality.is_valid(ok).first()["valid"] is True


def test_repaired_keys_and_parents(spark):
    fact = spark.createDataFrame([("a", 0), ("z", 0)], "nat string, key int")
    dim = spark.createDataFrame([("a", 7)], "n string, id int")
    assert rows(joins.repair_key(fact, dim, ("nat", "n"), "key", "id").select("nat", "key")) == [("a", 7), ("z", None)]


def test_checked_broadcast(spark):
    small, unknown = spark.range(3), spark.createDataFrame([(1,)], "id long")

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString()

    assert hinted(joins.broadcast_if_small(small))
    assert not hinted(joins.broadcast_if_small(small, 0))
    assert not hinted(joins.broadcast_if_small(unknown))  # a size nobody knows is too large
