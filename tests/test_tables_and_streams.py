from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from starwright.session import scratch_path
from starwright.sinks import tables as sink
from starwright.sources import csv_files, json_files
from starwright.sources.tables import path_exists, read_many, scan
from starwright.streaming import loads

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BATCH = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 99)), min_size=1, max_size=12)


def put(folder, name, value):
    (folder / name).write_text(json.dumps(value))


def test_nested_map_fields_of_all_records(spark, tmp_path):
    put(tmp_path, "A.json", {"response": {"data": {
        "2020-01-01": {"close": "1"}, "2020-01-02": {"close": "2", "split": "2.0"}}}})
    put(tmp_path, "B.json", {"response": {"data": {"2020-01-01": {"volume": "9"}}}})
    df = json_files.read_nested_map(spark, str(tmp_path / "*.json"), "data")
    assert df.columns[2:] == ["close", "split", "volume"]
    assert rows(df.drop("ticker")) == sorted([("2020-01-01", "1", None, None), ("2020-01-02", "2", "2.0", None),
                                              ("2020-01-01", None, None, "9")], key=repr)


def test_nested_map_files(spark, tmp_path):
    for t, days in (("AAA", {"2024-01-02": {"1. open": "1.5", "4. close": "2"}}),
                    ("BRK-B", {"2024-01-02": {"1. open": "7", "4. close": "8"},
                               "2024-01-03": {"1. open": "x", "4. close": None}})):
        put(tmp_path, f"{t}.json", {"response": {"Meta Data": {"2. Symbol": t}, "Time Series (Daily)": days}})
    put(tmp_path, "NONE.json", {"response": {"Note": "limit reached"}})
    schema = T.StructType([T.StructField("1. open", T.StringType()), T.StructField("4. close", T.StringType())])
    want = [("AAA", "2024-01-02", "1.5", "2"), ("BRK-B", "2024-01-02", "7", "8"), ("BRK-B", "2024-01-03", "x", None)]
    for given_schema in (schema, None):
        df = json_files.read_nested_map(spark, str(tmp_path / "*.json"), "Time Series (Daily)", given_schema)
        assert rows(df.select("ticker", "trade_date", "`1. open`", "`4. close`")) == want


def test_object_files(spark, tmp_path):
    put(tmp_path, "AAA.json", {"_meta": {"ticker": "AAA"}, "response": {"Name": "Acme", "Cap": "12"}})
    put(tmp_path, "BBB.json", {"response": {"Name": "Bolt", "Cap": None}})
    df = json_files.read_objects(spark, str(tmp_path / "*.json"))
    assert rows(df.select("ticker", "Name", "Cap")) == [("AAA", "Acme", "12"), ("BBB", "Bolt", None)]


def test_array_files(spark, tmp_path):
    put(tmp_path, "AAA.json", {"_meta": {"ticker": "AAA"}, "response": [{"amount": "1"}, {"amount": "2"}]})
    put(tmp_path, "BBB.json", {"_meta": {"ticker": "BBB"}, "response": []})
    assert rows(json_files.read_arrays(spark, str(tmp_path / "*.json"))) == [("AAA", "1"), ("AAA", "2")]
    nested = tmp_path / "nested"
    nested.mkdir()
    put(nested, "CCC.json", {"_meta": {"ticker": "CCC"}, "response": {"data": [{"amount": "3"}]}})
    assert rows(json_files.read_arrays(spark, str(nested))) == [("CCC", "3")]


def test_report_files(spark, tmp_path):
    put(tmp_path, "AAA.json", {"_meta": {"ticker": "AAA"}, "response": {
        "symbol": "AAA", "annualReports": [{"end": "2023", "eps": "4"}], "quarterlyReports": [{"end": "2023-Q4"}]}})
    df = json_files.read_reports(spark, str(tmp_path))
    assert rows(df.select("ticker", "report_type", "end", "eps")) == [
        ("AAA", "annual", "2023", "4"), ("AAA", "quarterly", "2023-Q4", None)]


def test_csv_with_quoted_newline(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Case Number,Incident Date,X Coordinate\n1,"January 05 2020",7\n2,bad,"a\nb"\n')
    df = csv_files.read_csv(spark, str(tmp_path / "a.csv"), [
        {"name": "case_number", "type": "long"}, {"name": "day", "type": "date", "source": "incident_date"},
        {"name": "x_coordinate", "type": "string"}, {"name": "gone", "type": "int"}], year_from="day")
    assert rows(df) == [(1, dt.date(2020, 1, 5), "7", None, 2020), (2, None, "a\nb", None, None)]
    assert csv_files.snake_case("  FBI Code (x)! ") == "fbi_code_x"


def test_read_many_unions_by_name(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "y1"))
    spark.createDataFrame([(2, "x")], "a int, b string").write.parquet(str(tmp_path / "y2"))
    df = read_many([str(tmp_path / "y1"), str(tmp_path / "y2")], spark.read.parquet)
    assert rows(df) == [(1, None), (2, "x")]


def kv(spark, pairs):
    return spark.createDataFrame(pairs, "k int, v int")


@FEW
@given(BATCH, BATCH)
def test_append_keeps_one_row_per_key_and_the_first(spark, a, b):
    path = scratch_path(spark, "append")
    for batch in (a, b, b):
        sink.append_immutable(kv(spark, batch), path, ["k"])
    got = dict(scan(spark, path).collect())
    first = {k: min(v for kk, v in a if kk == k) for k, _ in a}
    assert set(got) == {k for k, _ in a + b} and scan(spark, path).count() == len(got)
    assert all(got[k] == v for k, v in first.items())


@FEW
@given(BATCH, BATCH)
def test_upsert_is_idempotent_and_new_wins(spark, a, b):
    path = scratch_path(spark, "upsert")
    for batch in (a, b, b):
        sink.upsert(kv(spark, batch), path, ["k"])
    want = {k: min(v for kk, v in a if kk == k) for k, _ in a}
    want.update({k: min(v for kk, v in b if kk == k) for k, _ in b})
    assert dict(scan(spark, path).collect()) == want and scan(spark, path).count() == len(want)


def test_append_date_range_prunes(spark):
    path = scratch_path(spark, "dated")
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=300 * i)
    base = spark.createDataFrame([(i, day(i), day(i).year) for i in range(6)], "k int, d date, year int")
    sink.append_immutable(base, path, ["k"], ["year"], "d")
    sink.append_immutable(base.filter("k >= 4").withColumn("k", F.when(F.col("k") == 4, 4).otherwise(99)),
                          path, ["k"], ["year"], "d", year_column="year")
    assert sorted(r.k for r in scan(spark, path).collect()) == [0, 1, 2, 3, 4, 5, 99]
    assert sink.append_immutable(base.limit(0), path, ["k"], ["year"], "d") == path


def test_upsert_takes_the_winning_row_whole(spark):
    path = scratch_path(spark, "wide")
    sink.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, old string"), path, ["k"])
    sink.upsert(spark.createDataFrame([(2, 5), (3, 6)], "k int, fresh int"), path, ["K"])
    assert rows(scan(spark, path).select("k", "old", "fresh")) == [(1, "a", None), (2, None, 5), (3, None, 6)]
    with pytest.raises(ValueError):
        sink.upsert(kv(spark, [(1, 1)]), path, ["nope"])


def test_interrupted_swap_is_finished(spark):
    path = scratch_path(spark, "swap")
    sink.write(kv(spark, [(1, 1)]), path)
    sink._rename(spark, path, f"{path}__old")  # as if the job died between the renames
    assert not path_exists(spark, path)
    sink.upsert(kv(spark, [(2, 2)]), path, ["k"])
    assert rows(scan(spark, path)) == [(1, 1), (2, 2)]


def test_upsert_reduces_stored_duplicates_and_late_rows_lose(spark):
    path = scratch_path(spark, "upsert-late")
    sink.write(kv(spark, [(1, 20), (1, 20), (2, 5), (None, 3), (None, 4)]), path)
    sink.upsert(kv(spark, [(1, 10), (2, 7)]), path, ["K"], order=["v"])
    assert rows(scan(spark, path)) == [(1, 20), (2, 7), (None, 4)]
    sink.upsert(kv(spark, [(1, 30), (3, 1)]), path, ["k"], update_existing=False, order=["v"])
    assert rows(scan(spark, path)) == [(1, 20), (2, 7), (3, 1), (None, 4)]


@pytest.mark.parametrize("moved", [0, 1])
def test_interrupted_partition_rewrite_is_finished(spark, monkeypatch, moved):
    path = scratch_path(spark, "parts")
    base = spark.createDataFrame([(1, 1, "x", 1), (2, 1, "y", 2), (3, 2, "x", 3), (4, 3, "z", 4)],
                                 "k int, a int, b string, v int")
    sink.write(base, path, partitions=["a", "b"])
    change = base.filter("a < 3").withColumn("v", F.col("v") * 10)
    with monkeypatch.context() as patch:
        patch.setattr(sink, "_finish_swap", lambda *_: None)  # the job dies right after the commit
        sink.upsert(change, path, ["k", "a", "b"], ["a", "b"])
    if moved:  # or while it moves: one partition is in place, the old one of another is gone
        sink._remove(spark, f"{path}/a=1/b=x")
        sink._rename(spark, f"{path}__swap/a=1/b=x", f"{path}/a=1/b=x")
        sink._remove(spark, f"{path}/a=2/b=x")
    want = [(1, 10), (2, 20), (3, 30), (4, 4)]
    assert rows(sink.open_table(spark, path).select("k", "v")) == want
    assert not path_exists(spark, f"{path}__swap")
    sink.upsert(change, path, ["k", "a", "b"], ["a", "b"])
    assert rows(scan(spark, path).select("k", "v")) == want


def test_overwrite_drops_an_unfinished_rewrite(spark, monkeypatch):
    path = scratch_path(spark, "over")
    base = spark.createDataFrame([(1, 1, 1)], "k int, a int, v int")
    sink.write(base, path, partitions=["a"])
    with monkeypatch.context() as patch:
        patch.setattr(sink, "_finish_swap", lambda *_: None)
        sink.upsert(base, path, ["k", "a"], ["a"])
    sink.write(base.withColumn("v", F.lit(7)), path, partitions=["a"])
    assert rows(sink.open_table(spark, path).select("k", "v")) == [(1, 7)]


def test_delete_keeps_null_rows(spark):
    path = scratch_path(spark, "delete")
    sink.write(kv(spark, [(1, 1), (2, None), (3, 9)]), path)
    assert sink.delete_where(spark, path, "v > 5", dry_run=True) == 1 and scan(spark, path).count() == 3
    assert sink.delete_where(spark, path, "v > 5") == 1
    assert rows(scan(spark, path)) == [(1, 1), (2, None)]


def test_cluster_sorts_and_splits_a_hot_value(spark):
    path = scratch_path(spark, "cluster")
    df = spark.range(5_000).select("id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("c"))
    sink.write(df, path)
    sink.cluster(spark, path, ["c"], files=4)
    parts = scan(spark, path).groupBy(F.input_file_name()).count().collect()
    assert scan(spark, path).count() == 5_000 and max(p["count"] for p in parts) < 2_500


@pytest.mark.parametrize("limit, zorder", [("CLUSTER_ROWS", False), ("CLUSTER_ROWS", True), ("CLUSTER_BYTES", False)])
def test_clustered_files_are_bounded(spark, monkeypatch, limit, zorder):
    """More rows than the files may hold make a multiple of them, each still a range of its own."""
    path = scratch_path(spark, "cluster")
    sink.write(spark.range(5_000).select("id", (F.col("id") * 7 % 5_000).alias("c")), path)
    monkeypatch.setattr(sink, limit, 600 if limit == "CLUSTER_ROWS" else 4_000)
    sink.cluster(spark, path, ["c"], files=4, zorder=zorder)
    parts = scan(spark, path).groupBy(F.input_file_name().alias("f")).agg(
        F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("low").collect()
    assert sum(p["n"] for p in parts) == 5_000 == scan(spark, path).distinct().count()
    assert len(parts) >= 8 and max(p["n"] for p in parts) < 1_000
    assert zorder or all(a["high"] <= b["low"] for a, b in zip(parts, parts[1:]))


def test_merge_without_insert_and_star_layout(spark):
    path = scratch_path(spark, "merge")
    sink.write(kv(spark, [(1, 1), (2, 2)]), path)
    sink.merge(kv(spark, [(2, 20), (3, 30)]), path, ["k"], update={"v": "s.v + t.v"}, insert={})
    assert rows(scan(spark, path)) == [(1, 1), (2, 22)]
    paths = sink.write_star({"fact_a": kv(spark, [(1, 1)]), "dim_b": kv(spark, [(2, 2)])}, scratch_path(spark, "star"))
    assert list(paths) == ["dim_b", "fact_a"] and "/dims/dim_b" in paths["dim_b"] and "/facts/" in paths["fact_a"]


def test_stream_loads_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, batch in enumerate(([(1, 1), (2, 2)], [(2, 20), (3, 30)], [(3, 300)])):
        kv(spark, batch).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: loads.file_stream(
        spark, source, kv(spark, [(0, 0)]).schema, files_per_trigger=1)
    run = lambda w: w.start().awaitTermination()
    kept, merged, plain = (scratch_path(spark, n) for n in ("s1", "s2", "s3"))
    state = scratch_path(spark, "state")
    run(loads.append_stream(stream(), kept, ["k"], state + "1"))
    run(loads.upsert_stream(stream(), merged, ["k"], state + "2"))
    run(loads.refill_stream(stream(), plain, state + "3"))
    assert sorted(r.k for r in scan(spark, kept).collect()) == [1, 2, 3]
    assert sorted(r.k for r in scan(spark, merged).collect()) == [1, 2, 3]
    assert {r.k: r.v for r in scan(spark, kept).collect()}[1] == 1
    assert scan(spark, plain).count() == 5 and loads.loaded_rows(spark, plain).count() == 3


def test_repeated_batch_changes_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    kv(spark, [(1, 1)]).write.parquet(source)
    path = scratch_path(spark, "again")
    for i in range(2):  # a new state folder replays the batch
        stream = loads.file_stream(spark, source, kv(spark, [(0, 0)]).schema)
        loads.refill_stream(stream, path, scratch_path(spark, "state")).start().awaitTermination()
    assert scan(spark, path).count() == 1


def test_append_null_dates_and_keys(spark, tmp_path):
    path = str(tmp_path / "nulls")
    kinds = "k int, d date, v string"
    day = dt.date(2024, 1, 1)
    first = spark.createDataFrame([(1, day, "a"), (None, day, "b"), (3, None, "c")], kinds)
    for keys in (["k"], ["k", "d"]):
        at = path + str(len(keys))
        for batch in (first, first, spark.createDataFrame([(4, None, "d"), (3, None, "x")], kinds)):
            sink.append_immutable(batch, at, keys, date_column="d")
        got = sorted(((r["k"], r["v"]) for r in scan(spark, at).collect()), key=repr)
        assert got == [(1, "a"), (3, "c"), (4, "d"), (None, "b")]


def test_append_key_that_moves_its_date(spark, tmp_path):
    path = str(tmp_path / "moved")
    for day in (1, 20):
        batch = spark.createDataFrame([(7, dt.date(2024, 1, day), str(day))], "k int, d date, v string")
        sink.append_immutable(batch, path, ["k"], date_column="d")
    assert [r["v"] for r in scan(spark, path).collect()] == ["1"]


NULLABLE = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from(["a", "b", ""])),
                              st.integers(0, 99)), min_size=1, max_size=10)


@FEW
@given(NULLABLE, NULLABLE)
def test_no_stored_key_disappears_under_nulls(spark, a, b):
    """Upserts keep every key, whatever is NULL, and give each once; empty partition values are NULL."""
    kind = "k int, p string, v int"
    path = scratch_path(spark, "null-keys")
    sink.upsert(spark.createDataFrame(a, kind), path, ["k", "p"], ["p"])
    sink.upsert(spark.createDataFrame(b, kind), path, ["k", "p"], ["p"])
    got = [(r["k"], r["p"]) for r in scan(spark, path).select("k", "p").collect()]
    assert sorted(got, key=repr) == sorted({(k, p or None) for k, p, _ in a + b}, key=repr)
    sink.append_immutable(spark.createDataFrame(a, kind), path, ["k", "p"], ["p"])
    assert scan(spark, path).count() == len(got)


def test_one_null_rule_for_merges(spark):
    path = scratch_path(spark, "null-merge")
    rows_of = lambda *r: spark.createDataFrame(r, "k int, v int")
    sink.write(rows_of((None, 1), (1, 1)), path)
    for _ in range(2):
        sink.merge(rows_of((None, 7), (2, 7)), path, ["k"])
    assert rows(scan(spark, path)) == sorted([(None, 7), (1, 1), (2, 7)], key=repr)
    sink.merge_delete(rows_of((None, 0), (2, 0)), path, ["k"])
    assert rows(scan(spark, path)) == [(1, 1)]


def files_met(spark, path, column, low, high):
    """How many files hold a value of the range by their own bounds."""
    ends = scan(spark, path).groupBy(F.input_file_name()).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.filter((F.col("a") <= high) & (F.col("b") >= low)).count()


def test_z_order_skips_files_on_every_column(spark):
    path = scratch_path(spark, "zorder")
    made = spark.range(40_000).select(
        (F.xxhash64("id") % 1000).alias("x"), (F.xxhash64("id", F.lit(1)) % 1000).alias("y"),
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("z"))
    sink.write(made, path)
    sink.cluster(spark, path, ["x", "y"], files=16)
    before = files_met(spark, path, "y", 0, 20)
    sink.cluster(spark, path, ["x", "y"], files=16, zorder=True)
    # the range straddles the middle, where both halves of the highest bit meet
    assert files_met(spark, path, "y", 0, 20) <= before * 10 // 16 and files_met(spark, path, "x", 0, 20) <= 10
    assert scan(spark, path).exceptAll(made).isEmpty() and scan(spark, path).count() == 40_000


def test_z_order_of_other_types(spark):
    path = scratch_path(spark, "zorder-types")
    made = spark.createDataFrame(
        [(None, None, None, True), ("a", dt.date(2020, 1, 1), dt.datetime(2020, 1, 1), False), ("é", None, None, None)] * 9,
        "s string, d date, t timestamp, b boolean")
    sink.write(made, path)
    sink.cluster(spark, path, ["s", "d", "t", "b"], files=3, zorder=True)
    assert rows(scan(spark, path)) == rows(made)
    sink.write(made.limit(0), path)
    sink.cluster(spark, path, ["s", "d"], files=3, zorder=True)
    assert scan(spark, path).isEmpty()


def test_hot_partition_value_spans_tasks(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("p"), "id")
    spread = sink.spread_for_write(df, ["p"], tasks=8)
    tasks = spread.filter("p = 'hot'").select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks >= 4


def test_csv_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Name\n1,x\n")
    (tmp_path / "b.csv").write_text("Name,Id\ny,2\n")
    (tmp_path / "c.csv").write_text("Id,Town\n3,z\n")
    (tmp_path / "d.csv").write_text("")
    fields = [{"name": "id", "type": "long"}, {"name": "name", "type": "string"}, {"name": "town", "type": "string"}]
    want = [(1, "x", None), (2, "y", None), (3, None, "z")]
    for path in (str(tmp_path), str(tmp_path / "*.csv"), [str(tmp_path / f"{n}.csv") for n in "abcd"]):
        assert rows(csv_files.read_csv(spark, path, fields)) == want
