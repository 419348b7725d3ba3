from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from starwright.operators.pivot import PivotSpec, pivot, pivot_labels, pivot_long, pivot_pages, pivot_plain
from starwright.plans import recipes

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([
        ("N", "x", 2020, 1.0), ("N", "y", 2020, 2.0), ("N", "y", 2021, 4.0), ("S", "x", 2021, 8.0),
        (None, "x", 2020, 16.0), ("S", "x", None, 32.0)], "r string, c string, y int, v double")


def test_total_and_null_row_keys_stay_apart(sales):
    out = pivot(sales, PivotSpec({"r": "r"}, [["v", "v", "sum"]], row_totals=True))
    assert [tuple(x) for x in out.collect()] == [("N", 7.0), ("S", 40.0), (None, 16.0), ("TOTAL", 63.0)]


def test_subtotals(sales):
    out = pivot(sales, PivotSpec({"r": "r", "c": "c"}, [["n", "*", "count"]], row_totals=True))
    got = rows(out)
    assert ("N", "TOTAL", 3) in got and ("TOTAL", "TOTAL", 6) in got and len(got) == 8


def test_null_column_values_make_no_column(sales):
    out = pivot(sales, PivotSpec({"r": "r"}, [["v", "v", "sum"], ["n", "*", "count"]], {"y": "y"}))
    assert out.columns == ["r", "v||2020", "v||2021", "n||2020", "n||2021"]
    assert [tuple(x) for x in out.collect()] == [
        ("N", 3.0, 4.0, 2, 1), ("S", None, 8.0, 0, 1), (None, 16.0, None, 1, 0)]


def test_column_order_by_layout(sales):
    spec = lambda layout: PivotSpec({"r": "r"}, [["v", "v", "sum"], ["n", "*", "count"]],
                                    {"c": "c", "y": "y"}, layout)
    assert pivot(sales, spec("by_column")).columns[1:4] == ["x||2020||v", "x||2020||n", "x||2021||v"]
    assert pivot(sales, spec("by_measure")).columns[1:4] == ["v||x||2020", "v||x||2021", "v||y||2020"]
    labels = pivot_labels(spec("by_measure"), pivot(sales, spec("by_measure")).columns)
    assert labels[1] == {"key": "v||x||2020", "format": None, "label": "x | 2020", "group": "V"}


def test_windows_skip_totals(sales):
    out = pivot(sales, PivotSpec({"c": "c"}, [["v", "v", "sum"]], row_totals=True,
                                 windows=[["d", "v", "diff"], ["p", "v", "pct_change"], ["s", "v", "running_sum"],
                                          ["k", "v", "rank"]]))
    assert [tuple(x) for x in out.collect()] == [
        ("x", 57.0, None, None, 57.0, 2), ("y", 6.0, -51.0, -0.8947, 63.0, 1), ("TOTAL", 63.0, None, None, None, None)]


def test_refusals(spark, sales):
    with pytest.raises(ValueError):
        pivot(sales, PivotSpec({"r": "r"}, [["v", "v", "sum"]], windows=[["z", "v", "median"]]))
    with pytest.raises(ValueError):
        pivot(sales, PivotSpec({"r": "r"}, [["v", "v", "sum"]], layout="round"))
    wide = spark.range(201).selectExpr("id AS k", "1 AS one")
    with pytest.raises(ValueError):
        pivot(wide, PivotSpec({"one": "one"}, [["n", "*", "count"]], {"k": "k"}, max_columns=200))


def test_no_column_values_gives_row_keys_only(sales):
    out = pivot(sales.filter("y IS NULL"), PivotSpec({"r": "r"}, [["n", "*", "count"]], {"y": "y"}))
    assert out.columns == ["r"] and out.count() == 0


def test_sorts(sales):
    by = lambda sort, **kw: [x[0] for x in pivot(
        sales, PivotSpec({"r": "r"}, [["v", "v", "sum"]], sort=sort, **kw)).collect()]
    assert by({"by": "v", "order": "desc"}) == ["S", None, "N"]
    assert by({"field": "v", "dir": "desc"}) == [None, "S", "N"]
    assert by({"values": ["S"]}, row_totals=True) == ["S", "N", None, "TOTAL"]
    assert by({"by": "v", "where": 2021, "order": "desc"}, cols={"y": "y"}) == ["S", "N", None]
    assert by({"rows": {"by": "v", "order": "desc"}}) == ["S", None, "N"]
    both = pivot(sales, PivotSpec({"r": "r"}, [["v", "v", "sum"]], {"y": "y"},
                                  sort={"rows": {"values": ["S"]}, "cols": {"order": "desc"}}))
    assert both.columns == ["r", "v||2021", "v||2020"] and both.first()["r"] == "S"


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(-50, 50)), min_size=1, max_size=25))
def test_totals_are_sums_of_details(spark, recs):
    df = spark.createDataFrame(recs, "r string, c string, v long")
    out = pivot(df, PivotSpec({"r": "r", "c": "c"}, [["v", "v", "sum"], ["m", "v", "avg"]], row_totals=True)).collect()
    details = [x for x in out if "TOTAL" not in (x.r, x.c)]
    grand = [x for x in out if x.r == "TOTAL"]
    assert len(grand) == 1 and grand[0].v == sum(x.v for x in details) == sum(v for *_, v in recs)
    assert grand[0].m == pytest.approx(sum(v for *_, v in recs) / len(recs))


def test_recipe_registers_and_rejects(spark, sales):
    book = recipes.Recipe().register("double", lambda df, p: df.withColumn(p["c"], df[p["c"]] * 2))
    out = book.run(sales, [{"op": "double", "c": "v"}, {"op": "filter", "conditions": ["v > 30"]}])
    assert rows(out.select("v")) == [(32.0,), (64.0,)]
    assert {"filter", "join", "hook", "double"} <= set(book.names())
    with pytest.raises(Exception):
        book.run(sales, [{"op": "hook", "fn": "no.such.module"}])


def test_standard_table(spark, sales):
    names = spark.createDataFrame([("N", "North")], "code string, name string")
    out = recipes.standard_table(
        sales, ["y = 2020"], [{"table": names, "on": ["r=code"], "columns": ["name"]}],
        {"r": "r", "name": "name", "v": "v"}, {"w": "v * 2"}, ["r"], ["v"], ["v"])
    assert rows(out) == [("N", "North", 2.0), (None, None, 32.0)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_any_aggregate_reads_the_facts_once(spark, data):
    """Distinct counts and deviations come from the staged groups: no second scan, no copies of raw rows."""
    out = pivot(data.lineitem, PivotSpec(
        {"f": "l_returnflag"}, [["p", "l_partkey", "count_distinct"], ["s", "l_suppkey", "count_distinct"],
                                ["d", "l_quantity", "stddev"]], {"c": "l_linestatus"}, row_totals=True, col_totals=True))
    assert "FileScan" not in plan_of(out) and "Expand" in plan_of(out)  # only the groups are rolled up


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", None]),
                          st.one_of(st.none(), st.integers(0, 4))), max_size=14))
def test_distinct_counts_by_hand(spark, made):
    df = spark.createDataFrame(made, "r string, c string, v int")
    got = pivot(df, PivotSpec({"r": "r"}, [["d", "v", "count_distinct"], ["n", "*", "count"]], {"c": "c"},
                              row_totals=True, col_totals=True)).collect()
    if not any(c for _, c, _ in made):
        assert got == []
        return
    shown = sorted({c for _, c, _ in made if c})

    def count(r, c, whole=False):
        return len({v for rr, cc, v in made if (whole or rr == r) and (c is None or cc == c) and v is not None})

    want = [(r, *[count(r, c) for c in shown], count(r, None)) for r in sorted({r for r, _, _ in made}, key=repr)]
    want.append(("TOTAL", *[count(None, c, True) for c in shown], count(None, None, True)))
    names = [f"d||{c}" for c in [*shown, "TOTAL"]]
    assert sorted([(x["r"], *[x[n] for n in names]) for x in got], key=repr) == sorted(want, key=repr)


def test_deviations_of_far_values_are_stable(spark):
    df = spark.range(4000).selectExpr("id % 4 AS r", "id % 7 AS c", "1e9 + id % 10 AS v")
    out = pivot(df, PivotSpec({"r": "r"}, [["sd", "v", "stddev"], ["var", "v", "variance"]], {"c": "c"}, col_totals=True))
    for x, y in zip(out.collect(), df.groupBy("r").agg({"v": "stddev"}).orderBy("r").collect()):
        # a mean of 1e9 is known to about 1e-7; plain sums of squares would be off by hundreds
        assert abs(x["sd||TOTAL"] - y[1]) < 1e-6 and abs(x["var||TOTAL"] - y[1] ** 2) < 1e-6


def test_approximate_counts_merge(spark):
    df = spark.range(30_000).selectExpr("id % 3 AS r", "id % 2 AS c", "id % 9000 AS v")
    x = pivot(df, PivotSpec({"r": "r"}, [["d", "v", "approx_count_distinct"]], {"c": "c"}, col_totals=True)).first()
    assert abs(x["d||TOTAL"] - 3000) < 150 and abs(x["d||0"] - 1500) < 90


def test_more_columns_than_a_frame_is_good_for(spark):
    df = spark.range(24_000).selectExpr("id % 2 AS r", "id % 12000 AS c", "1 AS v")
    long = pivot_long(df, PivotSpec({"r": "r"}, [["n", "*", "count"], ["d", "v", "count_distinct"]], {"c": "c"}))
    assert long.count() == 12_000 and long.agg({"n": "sum"}).first()[0] == 24_000
    pages = list(pivot_pages(df.filter("c < 250"), PivotSpec({"r": "r"}, [["n", "*", "count"]], {"c": "c"}), 100))
    assert [len(p.columns) for p in pages] == [101, 101, 51] and pages[2].columns[1] == "n||200"
    assert len(pivot(df.filter("c < 230"), PivotSpec({"r": "r"}, [["n", "*", "count"]], {"c": "c"})).columns) == 231


def test_plain_pivot_takes_all_fields(sales):
    out = pivot_plain(sales, ["r"], ["c", "y"], [["v", "v", "sum"]])
    assert out.columns == ["r", "x||2020", "x||2021", "y||2020", "y||2021"]
    assert ("S", None, 8.0, None, None) in rows(out)
