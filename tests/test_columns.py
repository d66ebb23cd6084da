"""Column functions on hand-written edge values."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.functions import columns as C
from tallyhouse.functions import text as X
from tallyhouse.functions import vocab


def values(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", expr.alias("v")).orderBy("i").select("v").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("02/21/2018 06:20", dt.date(2018, 2, 21)),
        ("2018-05-04 11:52", dt.date(2018, 5, 4)),
        ("2018-05-04 11:52:59", dt.date(2018, 5, 4)),
        ("02/21/2018 06:20:01", dt.date(2018, 2, 21)),
        ("2018-05-04", dt.date(2018, 5, 4)),
        ("02/21/2018", dt.date(2018, 2, 21)),
        ("2020-02-29", dt.date(2020, 2, 29)),
        ("2019-02-29", None),
        ("21/02/2018", None),
        ("2018-05-04 25:00", None),
        ("2018-05-04 11:5", None),
        ("2018-5-4", None),
        ("2018-05-04 trailing", None),
        ("2018-05-4T", None),
        ("not a date", None),
        ("", None),
        (None, None),
    ],
)
def test_order_dates(spark, text, expected):
    assert values(spark, [text], C.parse_date("t", vocab.ORDER_DATE_FORMATS)) == [expected]


def test_return_and_iso_dates(spark):
    texts = ["2018-05-04", "04-05-2018", "05/04/2018", "NULL", " null ", "2018-05-04 10:00", None]
    day = dt.date(2018, 5, 4)
    assert values(spark, texts, C.return_date("t")) == [day, day, day, None, None, None, None]
    iso = ["2016-04-01T23:59:01Z", "2016-04-01", "2016-04-01T23:59:61Z"]
    assert values(spark, iso, C.parse_date("t", [vocab.ISO_UTC_FORMAT])) == [dt.date(2016, 4, 1), None, None]


@settings(max_examples=25, deadline=None)
@given(day=st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2999, 12, 31)))
def test_every_format_round_trips(spark, day):
    shapes = ["%m/%d/%Y 06:20", "%Y-%m-%d 06:20", "%Y-%m-%d 06:20:30", "%m/%d/%Y 06:20:30", "%Y-%m-%d", "%m/%d/%Y"]
    found = values(spark, [day.strftime(s) for s in shapes], C.parse_date("t", vocab.ORDER_DATE_FORMATS))
    assert found == [day] * len(shapes)


def test_discount_money_and_numbers(spark):
    assert values(spark, ["40%", "0.4", "1.5", "?", "x%", None], C.percent_or_fraction("t")) == [0.4, 0.4, 1.5, None, None, None]
    assert values(spark, ["$1,130.65", "130.65", "abc", None], C.money("t")) == [1130.65, 130.65, None, None]
    assert values(spark, ["5", "5.5", "?", "", None], C.number("t", "int")) == [5, None, None, None, None]
    assert values(spark, ["NaN"], C.number("t")) == [None]
    assert values(spark, ["NaN", "1"], C.nan_to_null(C.number("t"))) == [None, 1.0]


def test_names_and_garbage(spark):
    assert values(spark, ["CONS", "Cosumer", "CORP", "HO", "VIP", None], C.normalise("t", vocab.SEGMENTS)) == [
        "Consumer", "Consumer", "Corporate", "Home Office", "VIP", None,
    ]
    modes = C.normalise("t", vocab.SHIP_MODES, default=F.initcap(F.trim("t")))
    assert values(spark, ["1st Class", " same day ", "Std Class", None], modes) == ["First Class", "Same Day", "Standard Class", None]
    assert values(spark, ["?", " Damaged ", "null", "N/A", "none", None], C.garbage_to_null("t")) == [None, "Damaged", None, None, None, None]
    narrow = C.garbage_to_null("t", vocab.GARBAGE_NARROW)
    assert values(spark, ["?", "N/A", "NULL"], narrow) == [None, "N/A", None]


def test_city_and_state_are_swapped_back(spark):
    rows = spark.createDataFrame([("Texas", "Houston"), ("Houston", "Texas"), (None, "Ohio")], "city string, state string")
    city, state = C.swap_if_state("city", "state")
    assert [tuple(r) for r in rows.select(city, state).collect()] == [("Houston", "Texas"), ("Houston", "Texas"), (None, "Ohio")]


def test_sizes(spark):
    texts = ["Extra Large, X-Small, 10 M, http://x, 9.5, 9.5", "small,Medium , LARGE", "2X,3X,156E, 8.5W", "n/a", "", None]
    assert values(spark, texts, C.size_list("t")) == ["XL,XS,10M,9.5", "S,M,L", "2X,3X,156E,8.5W", "One Size", "One Size", "One Size"]


def test_categories_and_weights(spark):
    assert values(spark, ["Womens Shoes", "Men Shoes", "Shoe care", "kids clothing", "Desk", None], C.category_of("t")) == [
        "Women", "Men", "Shoes", "Clothing", "Other", "Other",
    ]
    assert values(spark, ["1.5 KG", "500 g", "2 lbs", "3 oz", "1.2.3 kg", None], C.kilograms("t")) == [1.5, 0.5, 0.907184, None, None, None]


def test_rescued_keys_are_case_sensitive(spark):
    texts = ['{"Order_ID":"A"}', '{"Order_id":"B"}', '{"order_id":"C"}', None]
    assert values(spark, texts, C.rescued_any(["Order_ID", "Order_id"], "t")) == ["A", "B", None, None]


def test_text_rendering(spark):
    assert values(spark, ["1234567.891", "0.005", "-3.4", "0"], X.fixed2(C.number("t"))) == ["1234567.89", "0.01", "-3.40", "0.00"]
    assert values(spark, ["x", None], X.fill("<{a}> and {b}", a=F.col("t"), b=F.lit(3))) == ["<x> and 3", "<null> and 3"]
    content = ['[{"type":"reasoning","text":"no"},{"type":"text","text":" yes "}]', "[]", "broken", None]
    assert values(spark, content, X.first_text_item("t")) == ["yes", None, None, None]
    assert values(spark, ["", "ok"], X.valid_text("t")) == [None, "ok"]


def test_sums_do_not_depend_on_order(spark):
    rows = [(0.1 * i,) for i in range(2000)]
    one = spark.createDataFrame(rows, "v double").repartition(7).agg(C.exact_sum("v")).first()[0]
    two = spark.createDataFrame(rows[::-1], "v double").repartition(3).agg(C.exact_sum("v")).first()[0]
    assert one == two == 199900.0


def test_amounts_are_finite_and_sums_do_not_saturate(spark):
    texts = spark.createDataFrame([("NaN",), ("Infinity",), ("-inf",), ("1.5",), ("x",)], "t string")
    for f in (C.number, C.money, C.percent_or_fraction):
        assert [r[0] for r in texts.select(f("t")).collect()] == [None, None, None, 1.5, None]
    good = spark.createDataFrame([(1.25,), (None,), (-3.0,)], "x double")
    assert good.select(C.exact_sum("x")).first()[0] == -1.75
    for wrong in (float("nan"), float("inf"), 1e15):
        with pytest.raises(Exception, match="cannot add up"):
            spark.createDataFrame([(1.0,), (wrong,)], "x double").select(C.exact_sum("x")).collect()
