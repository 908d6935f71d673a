from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelcast.functions.dates import AUTO, DateTokens, iso_text, parse_date
from panelcast.operators.clean import (
    FORMATS,
    best_format,
    clean_for_analysis,
    clean_for_training,
    date_parts,
    format_counts,
    guess_roles,
    plan_cleaning,
    role_profile,
    token_parts,
)
from panelcast.sources.files import from_records, preview, read_csv, read_records, with_date_cell
from panelcast.spec import SeriesSpec

SPEC = SeriesSpec("d", "y")


def texts(spark, values, name="d"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize(
    "values, order, fmt",
    [
        (["13/01/2020", "02/01/2020"], "DMY", "d/M/yyyy"),
        (["01/13/2020", "02/01/2020"], "MDY", "M/d/yyyy"),
        (["01/02/2020", "02/01/2020"], "MDY", "M/d/yyyy"),
        (["13.1.2020", "1.2.2020"], "DMY", "d.M.yyyy"),
        (["2020-01-13", "2020-02-01"], "DMY", "yyyy-M-d"),
        (["2020-01-13 10:00:00", "2020-02-01 11:30:00"], "DMY", AUTO),
        ([" 5-6-2020 ", None, ""], "MDY", "M-d-yyyy"),
    ],
)
def test_format_choice(spark, values, order, fmt):
    counts = format_counts(texts(spark, values), "d").first().asDict()
    assert counts["order"] == order
    assert best_format(counts["order"], counts, "d") == fmt


def date_texts():
    """Texts of all lengths and separators, right, wrong and odd."""
    rng = random.Random(3)
    texts = ["", " ", "/", "//", "--", "1//2020", "1/2/", "/1/2020", "2020-02-29", "2021-02-29", "29/02/1900", "29/02/2000", "0000-01-01", "01/01/0000",
             "2020/1/5", "2020/01/05 10:00", "2020-01-05T10:00:00.5", "5-6-2020 7:30", "5/6/2020 25:00", "2020-13-01", "99999999999/1/2020", "1 / 2 / 2020",
             "+1/2/2020", "-1-2-2020", "1/2-2020", "1.2/2020", "1.2.2020.", "1/2/2020/", "٣/٤/٢٠٢٠", "1/2/2020:", "2020-1-5:", "1\n/2/2020", "2020-01-05\n", "31.04.2021"]
    for _ in range(12000):
        parts = [rng.choice([str(rng.randint(0, 33)), f"{rng.randint(0, 13):02d}", str(rng.randint(1890, 2110)), f"{rng.randint(0, 120):04d}"]) for _ in range(3)]
        if rng.random() < 0.7:
            parts = rng.choice([[parts[0], parts[1], "2024"], ["1999", parts[1], parts[0]]])
        a = rng.choice("/.-")
        texts.append(a.join(parts) if rng.random() < 0.8 else parts[0] + a + parts[1] + rng.choice("/.- ") + parts[2])
        if rng.random() < 0.2:
            texts[-1] += rng.choice([" 10:15", "T1:00", " ", "x", " 10:15:61", "  10:15"])
    return [*texts, None]


def test_tokens_read_what_patterns_read(spark):
    cut, tokens = DateTokens.add(texts(spark, date_texts(), "_dated").repartition(4), F.col("_dated"))
    wrong = F.lit(False)
    for fmt in FORMATS:
        want = parse_date(F.col("_dated"), fmt)
        wrong = wrong | ~tokens.reads(fmt).eqNullSafe(want.isNotNull())
    for got, want in zip(token_parts(tokens), date_parts(F.col("_dated"))):
        wrong = wrong | ~got.eqNullSafe(want)
    assert [r["_dated"] for r in cut.filter(wrong).collect()] == []
    assert cut.filter(tokens.reads("d/M/yyyy")).count() > 100


def test_a_text_is_cut_once(spark):
    """The optimizer keeps the cut apart from the formats that use it."""
    cut, tokens = DateTokens.add(texts(spark, ["1/2/2020"]), F.col("d"))
    plan = cut.select(*[tokens.reads(fmt).alias(fmt) for fmt in FORMATS if fmt != AUTO])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("btrim(") <= 2 and "rlike" not in plan.lower()


def test_columns_named_like_tokens(spark):
    df = spark.createDataFrame([("13/01/2020", 1.0, 5, "6")], "d string, y double, _datetext int, `_date_number0` string")
    row = clean_for_training(df, SPEC).first()
    assert row["d"] == datetime(2020, 1, 13) and row["_datetext"] == 5 and row["_date_number0"] == 6.0


def test_late_rows_decide_the_order(spark):
    """All rows are read, not only the first hundred."""
    values = ["01/02/2020"] * 500 + ["25/12/2020"]
    assert format_counts(texts(spark, values), "d").first()["order"] == "DMY"


def test_one_format_for_the_column(spark):
    df = spark.createDataFrame([("13/01/2020", 1.0), ("14/01/2020", 2.0), ("2020-01-15", 3.0)], "d string, y double")
    assert [r["y"] for r in clean_for_training(df, SPEC).orderBy("d").collect()] == [1.0, 2.0]


@pytest.mark.parametrize("text", ["2020", "1/2/20", "2020-01-02 junk", "31/02/2020", "00/01/2020", "1/13/2020 x", ""])
def test_not_a_date(spark, text):
    row = texts(spark, [text]).select(*[parse_date(F.col("d"), f).alias("p") for f in ("d/M/yyyy", "M/d/yyyy", "yyyy-M-d", AUTO)]).first()
    assert all(v is None for v in row)


def test_no_readable_date(spark):
    df = spark.createDataFrame([("soon", 1.0)], "d string, y double")
    with pytest.raises(ValueError, match="Could not parse date column 'd'"):
        clean_for_training(df, SPEC)


def test_no_row_left(spark):
    df = spark.createDataFrame([("2020-01-01", None)], "d string, y double")
    with pytest.raises(ValueError, match="No valid data rows after cleaning"):
        clean_for_training(df, SPEC)
    assert clean_for_analysis(df, SPEC).count() == 1
    with pytest.raises(ValueError, match="No valid data after parsing"):
        clean_for_analysis(df.limit(0).withColumn("d", F.lit(None).cast("timestamp_ntz")), SPEC)


def test_midnight_in_a_daylight_saving_gap(spark):
    """The session's zone skips this hour; zone-free dates do not."""
    df = spark.createDataFrame([("2017-10-15", "1")], "d string, y string")
    row = clean_for_training(df, SPEC).withColumn("t", iso_text(F.col("d"))).first()
    assert row["d"] == datetime(2017, 10, 15) and row["t"] == "2017-10-15T00:00:00"


@pytest.mark.parametrize(
    "values, numbers",
    [
        (["?12", "$3.5", " 7 ", "-2", "1e5", None], [12.0, 3.5, 7.0, -2.0, 15.0, None]),
        (["12", "3.5x", "4.5", "1,000", "8 9"], [12.0, 3.5, 4.5, 1000.0, 89.0]),
        (["12", "n/a", "1.2.3", "1d"], [12.0, None, None, None]),
        (["12", "", "$5"], [12.0, None, None]),
    ],
)
def test_target_text(spark, values, numbers):
    """One text that cleaning cannot read makes the whole column a plain cast."""
    df = spark.createDataFrame([(f"2020-01-{i + 1:02d}", v) for i, v in enumerate(values)], "d string, y string")
    got = [r["y"] for r in clean_for_analysis(df, SPEC).orderBy("d").collect()]
    assert got == numbers


def test_failures_without_a_date_do_not_count(spark):
    df = spark.createDataFrame([("2020-01-01", "$5"), ("later", "n/a")], "d string, y string")
    plan = plan_cleaning(df, SPEC)
    assert plan.strip_target and plan.dated_rows == plan.valid_rows == 1


def test_numeric_target_is_left_alone(spark):
    df = spark.createDataFrame([("2020-01-01", 1e16)], "d string, y double")
    assert clean_for_training(df, SPEC).first()["y"] == 1e16


def test_other_columns(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0, True, " 3 ", "x", 4)], "d string, y double, flag boolean, n string, s string, i int")
    row = clean_for_training(df, SPEC).first()
    assert (row["flag"], row["n"], row["s"], row["i"]) == (1.0, 3.0, None, 4)


def test_roles(spark):
    df = spark.createDataFrame([("x", "2020-01-01", "5"), ("y", "2020-01-02", "6")], "name string, order_date string, amount string")
    assert guess_roles(df) == ("order_date", "amount")
    assert guess_roles(df.withColumnRenamed("order_date", "when")) == ("when", "amount")
    assert guess_roles(df.select("name")) == ("name", "name")
    assert role_profile(df).count() == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("date,value,note\n2023-01-01,100,a\n\n2023-01-02,105.5,\n ,1,b\n")
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"date": "string", "value": "double", "note": "string"}
    kept = with_date_cell(df, "date")
    assert sorted(r["value"] for r in preview(kept, ("date",)).collect()) == [100.0, 105.5]
    typed = read_csv(spark, str(path), "date string, value decimal(10,2), note string")
    assert dict(typed.dtypes)["value"] == "decimal(10,2)"


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('date,note,v\n2024-01-01,"a ""x"", b",1\n2024-01-02,"c, d",2\n')
    assert [tuple(r) for r in read_csv(spark, str(path)).orderBy("v").collect()] == [("2024-01-01", 'a "x", b', 1), ("2024-01-02", "c, d", 2)]
    path.write_text('date,note,v\n2024-01-01,"two\nlines",1\n')
    assert read_csv(spark, str(path), multi_line=True).first()["note"] == "two\nlines"
    path.write_text("date,note,v\n2024-01-01,a,1\n2024-01-02,b\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_csv(spark, str(path), "date string, note string, v int").select("date").collect()


def test_records(spark, tmp_path):
    df = from_records(spark, [{"date": "2023-01-01", "value": 1}, {"date": "2023-01-02", "other": 2.5}])
    assert df.columns == ["date", "value", "other"] and df.count() == 2
    path = tmp_path / "records.json"
    path.write_text('{"date": "2023-01-01", "value": 1}\n{"date": "2023-01-02", "value": 2.5}\n')
    assert dict(read_records(spark, str(path)).dtypes)["value"] == "double"
