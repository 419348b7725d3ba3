from __future__ import annotations

import pathlib
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import starwright
from conftest import rows
from starwright import session
from starwright.functions import measures as M
from starwright.operators import setops
from starwright.operators.joins import edge
from starwright.plans import requests as R
from starwright.plans import views
from starwright.plans.catalog import Catalog


@pytest.fixture(scope="module")
def catalog(spark):
    c = Catalog()
    c.add("events", "fact_events", spark.createDataFrame(
        [("e1", "A", 10.0, 2023, "l1"), ("e2", "A", 20.0, 2024, "l1"), ("e3", "B", 30.0, 2023, "l2"),
         ("e4", "B", 40.0, 2024, "l9"), ("e5", "C", 50.0, 2024, None)],
        "event_id string, category string, value double, year int, location_id string"))
    c.add("places", "dim_location", spark.createDataFrame(
        [("l1", "Loop"), ("l2", "Uptown")], "location_id string, name string"))
    c.add("remote", "dim_other", spark.createDataFrame([("x",)], "code string"))
    c.depends_on["events"] = ["places"]
    return c.link(edge("fact_events", "dim_location", "location_id"))


def test_chart_defaults_to_average_in_x_order(catalog):
    out = R.chart(catalog, "events.year", "events.value")
    assert [tuple(r) for r in out.collect()] == [(2023, 20.0), (2024, pytest.approx(110 / 3))]


def test_chart_groups_over_a_join(catalog):
    out = R.chart(catalog, "events.year", "events.value", "places.name", "sum")
    assert rows(out) == [(2023, "Loop", 10.0), (2023, "Uptown", 30.0), (2024, "Loop", 20.0)]


def test_series_parts(catalog):
    points = R.chart(catalog, "events.year", "events.value", "events.category", "sum")
    out = R.series(points, "year", "value", "category", max_points=1).orderBy("series", "part").collect()
    assert [(r.series, r.part, [tuple(p) for p in r.points]) for r in out][:2] == [
        ("A", 0, [(2023, 10.0)]), ("A", 1, [(2024, 20.0)])]


def test_filters_out_of_reach_are_skipped(catalog):
    out = R.kpi(catalog, [["n", "events.event_id", "count"]], [
        {"field": "remote.code", "value": "zzz"}, {"field": "no.where", "value": 1},
        {"field": "events.year", "op": "eq", "value": 2024}])
    assert out.first()["n"] == 3


def test_unreachable_table_is_an_error(catalog):
    with pytest.raises(ValueError):
        R.flat_table(catalog, [["a", "events.value"], ["b", "remote.code"]])
    with pytest.raises(ValueError):
        R.flat_table(catalog, [["a", "events.nothing"]])


def test_flat_table_groups_plain_columns(catalog):
    out = R.flat_table(catalog, [["c", "events.category"], ["v", "events.value", "max"]],
                       sort={"by": "v", "order": "desc"})
    assert [tuple(r) for r in out.collect()] == [("C", 50.0), ("B", 40.0), ("A", 20.0)]


def test_value_lists(catalog):
    assert [r.value for r in R.value_list(catalog, "events.category").collect()] == ["A", "B", "C"]
    assert [r.value for r in R.value_list(catalog, "events.category", "events.value").collect()] == ["C", "B", "A"]
    ctx = R.value_list(catalog, "events.category", context=[("events.year", [2023])])
    assert [r.value for r in ctx.collect()] == ["A", "B"]
    assert R.value_list(catalog, "events.category", limit=2).count() == 2


def test_pivot_request_by_field(catalog):
    out = R.pivot_request(catalog, ["events.category"], [["v", "events.value", "sum"]], ["events.year"],
                          row_totals=True, sort={"field": "events.value", "dir": "desc"})
    assert [tuple(r) for r in out.collect()] == [
        ("C", None, 50.0), ("B", 30.0, 40.0), ("A", 10.0, 20.0), ("TOTAL", 40.0, 110.0)]


def test_box_summary(catalog):
    got = R.box_summary(R.box(catalog, "events.year", "events.value"), ["year"], "value").orderBy("year").first()
    assert tuple(got) == (2023, 10.0, 15.0, 20.0, 25.0, 30.0, 2)


def test_response_caps(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("é" * 50), F.lpad("id", 4, "0")).alias("t"))
    assert R.response(df).count() == 1000
    assert [x.id for x in R.response(df, [F.desc("id")], max_rows=3).collect()] == [999, 998, 997]
    # 100 bytes of é, 4 digits, '{"id":N,"t":""}' of 14 characters and N's, and a line end
    lines = [100 + 4 + 14 + len(str(i)) + 1 for i in range(1000)]
    cap = 10 * 1024
    fit = next(n for n in range(1000) if sum(lines[:n + 1]) > cap)
    assert sorted(x.id for x in R.response(df, ["id"], max_mb=cap / 2**20).collect()) == list(range(fit))
    for limit in ({"max_rows": 1}, {"max_mb": 1.0}):
        with pytest.raises(ValueError):
            R.response(df, **limit)


def test_byte_cap_edges(spark):
    """The row that passes the cap ends the report, ties and repeated rows are cut alike, NULLs count."""
    df = spark.createDataFrame([(1, "a"), (2, "b" * 100), (3, "c"), (1, "a"), (None, None)], "k int, t string")
    ten = len('{"k":1,"t":"a"}') + 1
    nothing = len("{}") + 1  # NULL comes first in ascending order
    assert setops.capped_by_bytes(df, nothing + 2 * ten, ["k"]).count() == 3
    assert setops.capped_by_bytes(df, nothing + 2 * ten - 1, ["k"]).count() == 2
    assert setops.capped_by_bytes(df, nothing + 2 * ten + 50, ["k"]).count() == 3  # 3 would fit, 2 does not
    assert setops.capped_by_bytes(df, 0, ["k"]).count() == 0
    assert setops.capped_by_bytes(df.limit(0), 100, ["k"]).count() == 0
    assert setops.capped_by_bytes(df, 10, ["k"], ["k"]).columns == ["k"]
    with pytest.raises(ValueError):
        setops.capped_by_bytes(df, 100, [])


def test_series_without_a_group_goes_on_in_parts(spark):
    points = spark.range(25).select("id", (F.col("id") * 2).alias("v"))
    got = {s.part: [p.x for p in s.points] for s in R.series(points, "id", "v", max_points=10).collect()}
    assert got == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}


def test_views(spark):
    base = spark.createDataFrame([("p", 100.0), ("q", 10.0)], "id string, v double")
    rates = spark.createDataFrame([("p", 1.2)], "id string, factor double")
    out = views.derived_view(base, {"e": "v * factor"}, rates, ["id"], {"factor": 1.0})
    assert rows(out.select("id", "e")) == [("p", 120.0), ("q", 10.0)]
    wide = views.wide_subsets({"a": base, "b": rates}, "kind").withColumn("v", F.lit(1.0))
    assert rows(views.subset_violations(wide, "kind", {"a": ["v"], "b": ["factor"]})) == [("a", 0), ("b", 1)]


def test_cluster_needs_a_shared_folder():
    context = SimpleNamespace(
        getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)


def test_library_keeps_data_on_the_cluster():
    """No local checkpoints, pandas copies or collected tables in the library."""
    root = pathlib.Path(starwright.__file__).parent
    for path in root.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text and ".toPandas(" not in text and ".rdd" not in text, path
        if re.search(r"\.collect\(\)", text):
            # the columns of a wide pivot, bounded training samples, a number per shard, a block of queries
            assert path.name in ("pivot.py", "mil_quality.py", "string_kernel.py", "balanced_shards.py", "lemp.py"), path


def test_daily_bars_do_not_depend_on_row_order(data):
    from starwright.workload.registry import Data
    from starwright.workload.star import daily_bars

    mixed = Data(data.spark, data.folder, {"lineitem": data.lineitem.repartition(5, F.rand(3))})
    names = ["ticker", "trade_date", "open", "high", "low", "close"]
    assert rows(daily_bars(mixed).select(*names)) == rows(daily_bars(data).select(*names))


def test_date_bounds_that_cannot_be_read_raise():
    from starwright.operators.filters import to_date_key

    assert to_date_key("2024-02-03") == to_date_key("2024/02/03T01:00") == to_date_key("20240203") == 20240203
    for bad in ("soon", "2024-13-01", ""):
        with pytest.raises(ValueError):
            to_date_key(bad)


def small_star(spark):
    catalog = Catalog()
    catalog.add("s", "fact_sale", spark.createDataFrame(
        [(1, 10, 1.0), (1, 10, 2.0), (1, 11, None), (2, 11, 8.0), (3, 10, 16.0), (None, 11, 32.0)], "buyer int, seller int, v double"))
    catalog.add("p", "dim_person", spark.createDataFrame(
        [(1, "x"), (2, "x"), (3, "y"), (10, "x"), (11, "y"), (11, "z")], "id int, town string"))
    catalog.add("p", "dim_buyer", spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "buyer int, person int"))
    catalog.add("p", "dim_seller", spark.createDataFrame([(10, 10), (11, 11)], "seller int, person int"))
    catalog.depends_on["s"] = ["p"]
    return catalog.link(
        edge("fact_sale", "dim_buyer", "buyer", optional=True), edge("fact_sale", "dim_seller", "seller"),
        edge("dim_buyer", "dim_person", "person=id", optional=True), edge("dim_seller", "dim_person", "person=id"))


def test_one_table_in_two_roles(spark):
    out = R.flat_table(small_star(spark), [["b", "p.town@dim_buyer"], ["s", "p.town@dim_seller"], ["v", "s.v", "sum"]])
    assert rows(out) == sorted([("x", "x", 3.0), ("x", "y", 8.0), ("x", "z", 8.0), ("y", "x", 16.0),
                                (None, "y", 32.0), (None, "z", 32.0)], key=repr)
    only = R.flat_table(small_star(spark), [["s", "p.town@dim_seller"], ["n", "p.id@dim_seller", "count"]])
    assert rows(only) == [("x", 1), ("y", 1), ("z", 1)]
    with pytest.raises(ValueError):
        small_star(spark).resolve("p.town@nowhere")
    assert R.short("p.town@dim_buyer") == "dim_buyer_town"


@pytest.mark.parametrize("agg", ["sum", "avg", "min", "max", "count"])
def test_early_groups_equal_late_ones(spark, agg):
    """Also where a join repeats rows, drops them or finds nothing."""
    catalog = small_star(spark)
    keys = {"b": "p.town@dim_buyer", "s": "p.town@dim_seller"}
    measures = [M.Measure("m", "s.v", agg), M.Measure("n", "*", "count")]
    filters = [{"field": "s.v", "op": "lte", "value": 16.0}, {"field": "p.town@dim_seller", "op": "in", "value": ["x", "y"]}]
    for some in ([], filters):
        early, late = (catalog.aggregated(keys, measures, some, early=e) for e in (True, False))
        assert rows(early) == rows(late)
    total = [catalog.aggregated({}, measures, filters, early=e) for e in (True, False)]
    assert rows(total[0]) == rows(total[1])


def test_rows_are_grouped_below_joins_with_large_tables(spark, data):
    """By default only where a table of the join is over the broadcast threshold."""
    from starwright.workload.star import star

    def plan():
        out = R.chart(star(data), "parties.c_mktsegment", "sales.o_totalprice", aggregation="sum")
        return out._jdf.queryExecution().optimizedPlan().toString()

    assert plan().count("Aggregate") == 1
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        text = plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("Aggregate") == 2 and text.index("Join") < text.rindex("Aggregate")
