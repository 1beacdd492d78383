"""The fixture tables of FIXTURES.md and the results they must give."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.operators.correlation import DropCorrelated, correlations
from martloom.operators.encoding import Encode
from martloom.operators.filters import DropConstant, DropHighCardinality, DropNullHeavy
from martloom.operators.narrowing import Narrow, fit_narrowing
from martloom.operators.plan import Identity
from martloom.sources.contract import PENGUINS, ContractError

# -- contract -----------------------------------------------------------------

PENGUIN_SCHEMA = (
    "species string, island string, bill_length_mm double, bill_depth_mm double, flipper_length_mm double, "
    "body_mass_g double, sex string, year int"
)
GOOD = ("Adelie", "Dream", 39.1, 18.7, 181.0, 3750.0, "male", 2007)
EDGE = ("Gentoo", "Biscoe", 59.6, 13.1, 172.0, 6300.0, "female", 2009)
GAPS = ("Chinstrap", "Torgersen", None, None, None, None, None, 2008)


def penguins(spark, *rows):
    return spark.createDataFrame(list(rows), PENGUIN_SCHEMA)


def test_contract_passes_bounds_and_allowed_nulls(spark):
    df = penguins(spark, GOOD, EDGE, GAPS)
    assert PENGUINS.validate(df) is df
    assert PENGUINS.report(df).where("n_bad > 0").count() == 0


@pytest.mark.parametrize(
    "position, value, check",
    [(0, "Emu", "isin"), (1, "Java", "isin"), (2, 60.0, "le"), (2, 32.0, "ge"), (3, 13.0, "ge"), (4, 232.0, "le"),
     (5, 2699.0, "ge"), (6, "m", "isin"), (7, 2010, "le"), (0, None, "not_null"), (7, None, "not_null")],
)
def test_contract_finds_each_violation(spark, position, value, check):
    bad = list(GOOD)
    bad[position] = value
    df = penguins(spark, GOOD, tuple(bad))
    column = PENGUIN_SCHEMA.split(", ")[position].split()[0]
    found = [(r["column"], r["check"], r["n_bad"], r["n_rows"]) for r in PENGUINS.report(df).where("n_bad > 0").collect()]
    assert found == [(column, check, 1, 2)]
    with pytest.raises(ContractError):
        PENGUINS.validate(df)
    kept, quarantined = PENGUINS.split(df)
    assert (kept.count(), quarantined.count()) == (1, 1)


def test_contract_checks_presence_and_type_but_not_extra_columns(spark):
    df = penguins(spark, GOOD)
    assert PENGUINS.validate(df.withColumn("note", F.lit("x"))).count() == 1
    with pytest.raises(ContractError) as e:
        PENGUINS.validate(df.drop("sex").withColumn("body_mass_g", F.lit("3750")))
    assert {(c, k) for c, k, _ in e.value.violations} == {("sex", "present"), ("body_mass_g", "type")}


# -- type narrowing -----------------------------------------------------------


def mixed(spark):
    rows = [
        (1.0, 1.0, "2021-01-01", "apple", None),
        (2.0, 2.5, "2022-02-02", "banana", None),
        (3.0, 3.8, "2023-03-03", "orange", None),
    ]
    return spark.createDataFrame(rows, "A double, B double, C string, D string, E void")


def test_narrow(spark):
    out = Narrow().fit(mixed(spark)).apply(mixed(spark))
    assert [f.dataType for f in out.schema.fields] == [
        T.ShortType(), T.FloatType(), T.DateType(), T.StringType(), T.FloatType()
    ]
    assert [f.metadata["ref_type"] for f in out.schema.fields] == ["uint8", "float32", "date", "categorical", "float32"]
    assert out.schema["D"].metadata["logical"] == "categorical"
    assert [r["C"] for r in out.orderBy("A").collect()][0] == datetime.date(2021, 1, 1)


def test_narrow_pandas_flavour(spark):
    out = Narrow(flavour="pandas").fit(mixed(spark)).apply(mixed(spark))
    assert [f.metadata["ref_type"] for f in out.schema.fields] == [
        "uint8", "float16", "datetime64", "category", "float16"
    ]
    assert out.schema["C"].dataType == T.TimestampNTZType()


def test_narrow_ranges(spark):
    cases = {
        "uint8": [0, 255], "uint16": [0, 256], "uint32": [0, 65536], "uint64": [0, 2**32],
        "int8": [-128, 127], "int16": [-129, 0], "int32": [-1, 2**31 - 1], "int64": [-1, 2**31],
    }
    df = spark.createDataFrame(list(zip(*cases.values())), ", ".join(f"{n} bigint" for n in cases))
    plan = fit_narrowing(df)
    assert {n.name: n.logical for n in plan.columns} == {n: n for n in cases}
    assert [tuple(r) for r in plan.apply(df).collect()] == [tuple(r) for r in df.collect()]


def test_narrow_wide_and_odd_numbers(spark):
    rows = [(1e39, float("nan"), float("inf"), 1.5, 2.0), (0.5, 7.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "big double, gap double, endless double, part double, whole double")
    types = {n.name: n.logical for n in fit_narrowing(df).columns}
    assert types == {"big": "float64", "gap": "uint8", "endless": "float64", "part": "float32", "whole": "uint8"}
    # With a missing value a float column is not integral for the pandas flavour.
    assert {n.name: n.logical for n in fit_narrowing(df, flavour="pandas").columns}["whole"] == "float16"


def test_narrow_dates_of_all_formats_and_bad_ones(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2024/03/01",), ("02-03-2024",), ("03/03/2024",), (None,)], "d string")
    out = [r["d"] for r in fit_narrowing(df).apply(df).collect()]
    assert out[:4] == [datetime.date(2024, 2, 29), *[datetime.date(2024, 3, d) for d in (1, 2, 3)]]
    bad = spark.createDataFrame([("2024-02-29",), ("2023-02-29",)], "d string")
    with pytest.raises(ValueError, match="no format"):
        fit_narrowing(bad)
    # The search is not anchored, so a date inside other text counts as one.
    words = spark.createDataFrame([("on 2024-02-29",), ("none",)], "d string")
    assert fit_narrowing(words).columns[0].logical == "categorical"


def test_narrow_all_null_text_is_a_date_and_no_rows_is_identity(spark):
    df = spark.createDataFrame([(None,), (None,)], "d string")
    assert fit_narrowing(df).columns[0].logical == "date"
    assert isinstance(fit_narrowing(df.limit(0)), Identity)


# -- encodings ----------------------------------------------------------------


def test_encodings(spark):
    rows = [("A", "2023-01-01"), ("B", "2023-02-01"), ("C", "2023-03-01")]
    df = spark.createDataFrame(rows, "category_col string, date_col string")
    df = Narrow().fit(df).apply(df)
    out = Encode(("weekday", "day_of_month", "day_of_year", "unix")).fit(df)
    out = out.apply(df)
    assert out.columns == [
        "category_col_A", "category_col_B", "category_col_C",
        "date_col_weekday", "date_col_day_of_month", "date_col_day_of_year", "date_col_unix",
    ]
    first = out.orderBy("date_col_unix").first()
    assert tuple(first) == (1, 0, 0, 7, 1, 1, 19358)


# -- column filters -----------------------------------------------------------


def test_null_heavy(spark):
    rows = [(None, None, 1, 1), (None, None, 2, 2), (None, 3, 3, None), (None, 4, 4, None)]
    df = spark.createDataFrame(rows, "col1 void, col2 bigint, col3 bigint, col4 bigint")
    for stage in (DropNullHeavy(), DropNullHeavy(threshold=0.5), DropNullHeavy(ignore=("col2",))):
        assert stage.fit(df).apply(df).columns == ["col2", "col3", "col4"]


def test_one_value(spark):
    rows = [(1, None, "A", "A"), (1, None, "A", "B"), (1, None, "A", "C"), (1, None, "A", "D")]
    df = spark.createDataFrame(rows, "col1 bigint, col2 void, col3 string, col4 string")
    assert DropConstant().fit(df).apply(df).columns == ["col2", "col4"]
    assert DropConstant(ignore=("col3",)).fit(df).apply(df).columns == ["col2", "col3", "col4"]


def test_category_count(spark):
    rows = [("A", "A", "A"), ("B", "B", "B"), ("C", "C", "C"), ("D", "C", "A")]
    df = spark.createDataFrame(rows, "col1 string, col2 string, col3 string")
    df = Narrow().fit(df).apply(df)
    assert DropHighCardinality(threshold=4).fit(df).apply(df).columns == ["col2", "col3"]
    # Null counts as a value.
    more = df.unionByName(spark.createDataFrame([(None, None, "A")], df.schema))
    assert DropHighCardinality(threshold=4).fit(more).apply(more).columns == ["col3"]


def test_correlated(spark):
    rows = [(1, 1, 1), (2, 2, 2), (3, None, 3), (4, 4, 4), (None, 5, 5)]
    df = spark.createDataFrame(rows, "col1 bigint, col2 bigint, col3 bigint")
    found = {(r["col1"], r["col2"]): r["corr"] for r in correlations(df).collect()}
    assert found == {("col1", "col2"): pytest.approx(1), ("col1", "col3"): pytest.approx(1), ("col2", "col3"): pytest.approx(1)}
    assert DropCorrelated().fit(df).apply(df).columns == ["col2"]
    assert DropCorrelated(prefer="fewest_nulls").fit(df).apply(df).columns == ["col3"]


def test_negative_correlation_counts_only_on_request(spark):
    df = spark.createDataFrame([(1, -1), (2, -2), (3, -3)], "a int, b int")
    assert DropCorrelated().fit(df).apply(df).columns == ["a", "b"]
    assert DropCorrelated(absolute=True).fit(df).apply(df).columns == ["b"]
