"""Sources, column roles, date and number parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.dates import iso_text
from panelcast.operators.clean import (
    FORMATS,
    apply_cleaning,
    clean_for_analysis,
    clean_for_training,
    coerce_columns,
    format_counts,
    plan_cleaning,
)
from panelcast.operators.clean import role_profile as profile_roles
from panelcast.plans.lineage import new_path
from panelcast.sources.files import preview as first_rows
from panelcast.sources.files import CSV, read_csv, read_records, with_date_cell
from panelcast.spec import SeriesSpec

from .panels import DAILY, daily, table
from .registry import query


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,"
       " strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The orders, written as CSV and read back with types found by the reader."""
    path = new_path(spark, "orders-csv")
    orders = table(spark, sf, "orders").withColumn("o_orderdate", iso_text(F.col("o_orderdate")))
    orders.write.option("header", True).csv(path)
    back = read_csv(spark, path)
    return back.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


@query("SELECT event_id, event_type, props FROM events")
def csv_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """The events, whose JSON text is full of quotes and commas, written as CSV and read back."""
    path = new_path(spark, "events-csv")
    table(spark, sf, "events").select("event_id", "event_type", "props").write.options(**CSV).csv(path)
    return read_csv(spark, path).withColumn("event_id", F.col("event_id").cast("long"))


@query("""SELECT event_id, user_id, event_type, value, props,
         CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts FROM events""")
def record_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The events, written as JSON records and read back."""
    path = new_path(spark, "events-json")
    table(spark, sf, "events").withColumn("ts", iso_text(F.col("ts"))).write.json(path)
    return read_records(spark, path).select("event_id", "user_id", "event_type", "value", "props", "ts")


@query("""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS order_day, o_orderstatus AS status,
                  CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS price_text, o_totalprice AS price FROM orders)
  SELECT 'o_orderkey' AS name, 0 AS position, false AS name_hint, COUNT(*) AS filled, CAST(0 AS BIGINT) AS as_date, COUNT(o_orderkey) AS as_number FROM t
  UNION ALL SELECT 'order_date', 1, true, COUNT(*), COUNT(try_strptime(order_day, '%d/%m/%Y')), CAST(0 AS BIGINT) FROM t
  UNION ALL SELECT 'status', 2, false, COUNT(*), CAST(0 AS BIGINT), COUNT(TRY_CAST(status AS DOUBLE)) FROM t
  UNION ALL SELECT 'price_text', 3, false, COUNT(*), CAST(0 AS BIGINT), COUNT(TRY_CAST(price_text AS DOUBLE)) FROM t
  UNION ALL SELECT 'price', 4, false, COUNT(*), CAST(0 AS BIGINT), COUNT(price) FROM t""")
def role_profile(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return profile_roles(
        table(spark, sf, "orders").select(
            "o_orderkey",
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"),
            F.col("o_orderstatus").alias("status"),
            F.bround(price).cast("long").cast("string").alias("price_text"),
            price.alias("price"),
        )
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS order_day FROM orders
  WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def nonblank_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Date cells are blank for one status and null for one priority."""
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    cell = F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderstatus") == "P", " ").otherwise(text)
    return with_date_cell(table(spark, sf, "orders").select("o_orderkey", cell.alias("order_day")), "order_day")


@query(f"WITH {DAILY} SELECT * FROM daily ORDER BY ds, o_orderpriority LIMIT 5")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return first_rows(daily(spark, sf), ("ds", "o_orderpriority"))


# --- dates --------------------------------------------------------------------------------------

# The text form of order dates in each variant, for Spark and for the SQL.
TEXT_FORMS = {"day_first": ("dd/MM/yyyy", "%d/%m/%Y"), "month_first": ("MM-dd-yyyy", "%m-%d-%Y"), "iso": ("yyyy-MM-dd", "%Y-%m-%d"), "dots": ("d.M.yyyy", "%-d.%-m.%Y")}
SEPARATORS = {"day_first": "/", "month_first": "-", "iso": "-", "dots": "."}
# SQL patterns of the formats.
SQL_FORMATS = {
    "d/M/yyyy": "%d/%m/%Y",
    "d-M-yyyy": "%d-%m-%Y",
    "d.M.yyyy": "%d.%m.%Y",
    "yyyy-M-d": "%Y-%m-%d",
    "M/d/yyyy": "%m/%d/%Y",
    "M-d-yyyy": "%m-%d-%Y",
}


def _order_sql(form: str) -> str:
    first = f"TRY_CAST(split_part(strftime(o_orderdate, '{TEXT_FORMS[form][1]}'), '{SEPARATORS[form]}', 1) AS INT)"
    return f"SELECT '{form}' AS form, CASE WHEN MAX({first}) > 12 THEN 'DMY' ELSE 'MDY' END AS date_order FROM orders"


@query(" UNION ALL ".join(map(_order_sql, TEXT_FORMS)))
def date_order(spark: SparkSession, sf: str) -> DataFrame:
    """Order of day and month for four text forms of the same dates."""
    orders, found = table(spark, sf, "orders"), None
    for form, (pattern, _) in TEXT_FORMS.items():
        text = orders.select(F.date_format("o_orderdate", pattern).alias("t"))
        one = format_counts(text, "t").select(F.lit(form).alias("form"), F.col("order").alias("date_order"))
        found = one if found is None else found.unionByName(one)
    return found


_MIXED_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN '2-HIGH' THEN strftime(o_orderdate, '%m-%d-%Y') WHEN '3-MEDIUM' THEN '  ' || strftime(o_orderdate, '%Y-%m-%d') || ' '
  WHEN '5-LOW' THEN 'unknown' ELSE strftime(o_orderdate, '%-d.%-m.%Y') END"""


@query(f"WITH t AS (SELECT trim({_MIXED_SQL}) AS d FROM orders)"
       + " UNION ALL ".join(
           f" SELECT '{fmt}' AS format, COUNT(try_strptime(d, '{sql}')) AS read FROM t" for fmt, sql in SQL_FORMATS.items())
       + " UNION ALL SELECT 'auto', COUNT(TRY_CAST(d AS DATE)) FROM t")
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each date format reads, on a column that mixes forms."""
    day, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    mixed = (
        F.when(priority == "1-URGENT", F.date_format(day, "dd/MM/yyyy"))
        .when(priority == "2-HIGH", F.date_format(day, "MM-dd-yyyy"))
        .when(priority == "3-MEDIUM", F.concat(F.lit("  "), F.date_format(day, "yyyy-MM-dd"), F.lit(" ")))
        .when(priority == "5-LOW", "unknown")
        .otherwise(F.date_format(day, "d.M.yyyy"))
    )
    counts = format_counts(table(spark, sf, "orders").select(mixed.alias("d")), "d")
    listed = F.array(*[F.struct(F.lit(fmt).alias("format"), F.col(f"`{fmt}`").alias("read")) for fmt in FORMATS])
    return counts.select(F.inline(listed))


@query("""SELECT event_id, DATE_TRUNC('second', ts) AS ts, value FROM events WHERE event_type <> 'error'""")
def date_auto(spark: SparkSession, sf: str) -> DataFrame:
    """Text with a time of day is read by the automatic form; rows without a readable date go."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    cell = F.when(F.col("event_type") == "error", "n/a").otherwise(text)
    events = table(spark, sf, "events").select("event_id", cell.alias("ts"), "value")
    spec = SeriesSpec("ts", "value")
    return apply_cleaning(events, spec, plan_cleaning(events, spec))


# --- numbers ------------------------------------------------------------------------------------

_DIRTY_SQL = """CASE o_orderstatus WHEN 'F' THEN '$' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
  WHEN 'P' THEN ' ?-' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
  ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || '.5 ' END"""
_CLEANED_SQL = r"TRY_CAST(regexp_replace(regexp_replace(trim({}), '^\?', ''), '[^\d.\-]', '') AS DOUBLE)"
_ORDERS_SPEC = SeriesSpec("o_orderdate", "price", (), ("o_orderkey",))


def _dirty_price():
    whole = F.bround("o_totalprice").cast("long").cast("string")
    status = F.col("o_orderstatus")
    return F.when(status == "F", F.concat(F.lit("$"), whole)).when(status == "P", F.concat(F.lit(" ?-"), whole)).otherwise(F.concat(whole, F.lit(".5 ")))


@query(f"WITH t AS (SELECT o_orderkey, o_orderdate, {_DIRTY_SQL} AS price FROM orders)"
       f" SELECT o_orderkey, o_orderdate, {_CLEANED_SQL.format('price')} AS price FROM t")
def clean_target(spark: SparkSession, sf: str) -> DataFrame:
    """Currency signs, question marks and blanks go; every value reads as a number."""
    dirty = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", _dirty_price().alias("price"))
    return apply_cleaning(dirty, _ORDERS_SPEC, plan_cleaning(dirty, _ORDERS_SPEC))


@query(f"WITH t AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey = 7 THEN 'n/a' ELSE {_DIRTY_SQL} END AS price FROM orders)"
       r" SELECT o_orderkey, o_orderdate, CASE WHEN regexp_matches(price, '^[+-]?\d+\.?\d*$') THEN CAST(price AS DOUBLE) END AS price FROM t")
def clean_target_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """One value that no cleaning reads makes the whole column fall back to a plain cast; the target stays null."""
    price = F.when(F.col("o_orderkey") == 7, "n/a").otherwise(_dirty_price())
    dirty = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", price.alias("price"))
    return apply_cleaning(dirty, _ORDERS_SPEC, plan_cleaning(dirty, _ORDERS_SPEC), drop_null_target=False)


_RAW_SQL = f"""raw AS (SELECT o_orderkey, o_orderpriority,
    CASE WHEN o_orderdate < TIMESTAMP '1995-03-01' THEN 'unknown' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS day,
    CASE WHEN o_custkey < 20 THEN NULL ELSE {_DIRTY_SQL} END AS price,
    o_totalprice > 100000 AS large, ' ' || CAST(o_custkey AS VARCHAR) || ' ' AS customer, o_orderstatus AS status
  FROM orders)"""
RAW_SPEC = SeriesSpec("day", "price", ("o_orderpriority",), ("o_orderkey",))


def raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a user might bring them: text dates and prices with errors, flags and text numbers."""
    day = F.when(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz"), "unknown")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        day.otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"),
        F.when(F.col("o_custkey") >= 20, _dirty_price()).alias("price"),
        (F.col("o_totalprice") > 100000).alias("large"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("customer"),
        F.col("o_orderstatus").alias("status"),
    )


@query(f"""WITH {_RAW_SQL} SELECT o_orderkey, o_orderpriority, try_strptime(day, '%d/%m/%Y') AS day,
    {_CLEANED_SQL.format('price')} AS price, CAST(large AS DOUBLE) AS large, TRY_CAST(trim(customer) AS DOUBLE) AS customer,
    TRY_CAST(status AS DOUBLE) AS status
  FROM raw WHERE try_strptime(day, '%d/%m/%Y') IS NOT NULL AND price IS NOT NULL""")
def clean_panel(spark: SparkSession, sf: str) -> DataFrame:
    return clean_for_training(raw_orders(spark, sf), RAW_SPEC)


@query(f"""WITH {_RAW_SQL} SELECT o_orderkey, o_orderpriority, day, price, CAST(large AS DOUBLE) AS large,
    TRY_CAST(trim(customer) AS DOUBLE) AS customer, TRY_CAST(status AS DOUBLE) AS status FROM raw""")
def coerce_exog(spark: SparkSession, sf: str) -> DataFrame:
    return coerce_columns(raw_orders(spark, sf), RAW_SPEC.reserved)


@query("""SELECT 'no date' AS case_name, 'Could not parse date column ''day''' AS message, COUNT(*) AS n FROM orders
  UNION ALL SELECT 'no target', 'No valid data rows after cleaning', COUNT(*) FROM orders
  UNION ALL SELECT 'no row', 'No valid data after parsing', 0""")
def cleaning_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of which nothing is left after cleaning: the error as a row, with the rows that were read."""
    orders = table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice").alias("price")
    day, bad, blank = F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.lit("n/a").alias("day"), F.lit(None).cast("string").alias("price")
    cases = {
        "no date": (orders.select(key, bad, price), clean_for_training),
        "no target": (orders.select(key, day, blank), clean_for_training),
        "no row": (orders.filter(key.isNull()).select(key, F.col("o_orderdate").alias("day"), price), clean_for_analysis),
    }
    rows = []
    for name, (df, clean) in cases.items():
        message = None
        try:
            clean(df, SeriesSpec("day", "price", (), ("o_orderkey",)))
        except ValueError as error:
            message = str(error)
        rows.append(df.agg(F.lit(name).alias("case_name"), F.lit(message).alias("message"), F.count(F.lit(1)).alias("n")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
