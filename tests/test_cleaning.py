from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from starwright.functions import clean
from starwright.operators import filters, projection
from starwright.sources import tables


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_mixed_dates(spark):
    df = texts(spark, "2025-02-26T00:00:00.000", "1/6/2025", "October 01 2019", "2020", " 2024-05-06 ",
               "None", "0000-00-00", "", None, "13/45/2020", "Foo 1 2020")
    assert one(df, clean.to_date_any("t")) == [
        date(2025, 2, 26), date(2025, 1, 6), date(2019, 10, 1), date(2020, 1, 1), date(2024, 5, 6),
        None, None, None, None, None, None]


def test_mixed_timestamps(spark):
    df = texts(spark, "2025-02-26T14:30:00.000", "01/16/2025", "2025-02-26", "2020", "2022 03:39:00 AM-07", "")
    assert one(df, clean.to_timestamp_any("t")) == [
        datetime(2025, 2, 26, 14, 30), datetime(2025, 1, 16), datetime(2025, 2, 26), datetime(2020, 1, 1),
        None, None]


def test_numbers(spark):
    df = texts(spark, "12", "12.7", "NaN", "x", None, "99999999999")
    assert one(df, clean.to_integer("t")) == [12, 12, None, None, None, None]
    assert one(df, clean.to_number("t", "int"))[:2] == [12.0, 12.7]


def test_blank_tokens(spark):
    assert one(texts(spark, " a ", "N/A", "-", "  ", None), clean.blank_to_null("t")) == ["a", None, None, None, None]


def test_keys(spark):
    df = texts(spark, "a", "b", None)
    keys = one(df, clean.surrogate_key("t"))
    assert keys[0] != keys[1] and keys[2] is None and all(k >= 0 for k in keys[:2])
    assert all(k is None or k >= 0 for k in one(df, clean.surrogate_key("t", bits=32)))
    with pytest.raises(ValueError):
        clean.surrogate_key("t", bits=16)
    parts = spark.createDataFrame(
        [("a", None, "b"), ("a", "b", None), ("a_b", None, None), (None, None, None)], "x string, y string, z string")
    keys = one(parts, clean.surrogate_key("x", "y", "z"))
    assert len(set(keys)) == 4 and keys[3] is None


def test_date_key_round_trip(spark):
    df = spark.createDataFrame([(date(2020, 2, 9),), (None,)], "d date")
    out = df.select(clean.date_key("d").alias("k")).withColumn("back", clean.date_of_key("k"))
    assert rows(out) == sorted([(20200209, date(2020, 2, 9)), (None, None)], key=repr)


def test_epoch(spark):
    df = spark.createDataFrame([(86399,), (86400,), (-1,)], "s long")
    assert one(df, clean.epoch_date("s")) == [date(1970, 1, 1), date(1970, 1, 2), date(1969, 12, 31)]


def test_band_and_category(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (20.0,), (None,)], "v double")
    assert one(df, clean.band("v", [5, 15], ["cold", "mild", "warm"])) == ["cold", "mild", "warm", None]
    assert one(df, clean.category([("v < 2", "low")], "rest")) == ["low", "rest", "rest", "rest"]


def test_display(spark):
    df = spark.createDataFrame([(1234567.891,)], "v double")
    got = {code: one(df, clean.display("v", code))[0] for code in clean.DISPLAY_FORMATS}
    assert got["$"] == "$1,234,568" and got["$2"] == "$1,234,567.89" and got["$K"] == "$1,234.6K"
    assert got["$M"] == "$1.2M" and got["number"] == "1,234,568" and got["decimal2"] == "1234567.89"
    assert clean.display_code("a", "$", {"a": {"format": "%"}}) == "%"
    assert clean.display_code("a", "$", {}) == "$"


def test_select_map_sees_input_only(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows(projection.select_map(df, {"a": "b", "b": "a"})) == [(2, 1)]


def test_conform(spark):
    df = spark.createDataFrame([("7", 1)], "b string, x int")
    out = projection.conform(df, [("a", "decimal(18,2)"), ("b", "int")])
    assert out.columns == ["a", "b"] and out.schema["a"].dataType.simpleString() == "decimal(18,2)"
    assert rows(out) == [(None, 7)]


def test_rename_and_existing(spark):
    df = spark.createDataFrame([(None, 2)], "a int, b int")
    assert projection.rename_present(df, {"a": "x", "no": "y"}).columns == ["x", "b"]
    assert one(df, clean.coalesce_existing(df.columns, ["no", "a", "b"])) == [2]
    assert one(df, clean.first_existing(df.columns, ["no", "b"])) == [2]


def test_seed_types_and_derived(spark):
    df = tables.seed(spark, [{"code": "x", "rate": None}], [
        ["id", "long", False, "key", {"derived": "length(code) * 10"}], ["code", "string", False, ""],
        ["rate", "decimal(5,4)", True, ""]])
    assert df.schema["rate"].dataType.simpleString() == "decimal(5,4)"
    assert rows(df) == [(10, "x", None)]
    assert tables.seed(spark, [], [["a", "int", True, ""]]).count() == 0


def test_calendar_edges(spark):
    df = tables.calendar(spark, "2024-02-28", "2024-03-01", 7)
    assert len(df.columns) == 28
    got = {r["date_str"]: r for r in df.collect()}
    assert got["2024-02-29"]["is_month_end"] and got["2024-02-29"]["fiscal_year"] == 2023
    assert got["2024-02-29"]["fiscal_quarter"] == 3 and got["2024-02-29"]["fiscal_month"] == 8
    assert got["2024-03-01"]["is_month_start"] and got["2024-03-01"]["day_of_week_name"] == "Friday"


# -- filters ---------------------------------------------------------------------------


def test_filter_forms(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(9)], "n int, s string")
    run = lambda *specs: [r.n for r in filters.apply_specs(df, specs).collect()]
    assert run({"field": "s", "value": "a"}) == [0, 3, 6]
    assert run({"field": "s", "op": "in", "value": []}) == list(range(9))
    assert run({"field": "n", "op": "between", "value": {"from": 7}}) == [7, 8]
    assert run({"field": "n", "op": "between", "value": {"from": 2, "to": 3}}) == [2, 3]
    assert run({"field": "n", "op": "between", "value": {}}) == list(range(9))
    with pytest.raises(ValueError):
        run({"field": "n", "op": "near", "value": 1})


def test_period_overlap_is_brute_force(spark):
    periods = [(a, b) for a in range(20200101, 20200111, 3) for b in range(a, 20200115, 4)]
    df = spark.createDataFrame(periods, "period_start_date_id int, period_end_date_id int")
    for low, high in ((20200103, 20200105), (20200108, None), (None, 20200102)):
        want = [(a, b) for a, b in periods
                if (high is None or a <= high) and (low is None or b >= low)]
        got = filters.apply_dict(df, {"date": {k: str(v) for k, v in (("start", low), ("end", high)) if v}})
        assert rows(got) == sorted(want, key=repr)


def test_date_expressions(spark):
    df = spark.range(1)
    got = df.select(filters.date_value("current_date") == F.current_date(),
                    filters.date_value("current_date - 3") == F.date_sub(F.current_date(), 3),
                    filters.date_value("year_start") == F.trunc(F.current_date(), "year")).first()
    assert tuple(got) == (True, True, True)
    assert filters.date_value(None) is None


def test_predicate_text():
    assert filters.predicate_text({"t": ["A", "B"], "v": {"min": 3}, "x": None}) == "t IN ('A', 'B') AND v >= 3"
    assert filters.predicate_text({"n": "O'Hare"}) == "n = 'O''Hare'"
    assert filters.predicate_text({}) == "1=1"
