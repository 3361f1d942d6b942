"""How the given tables play the roles of a transaction-risk dataset, once as
DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.operators.joins import enrich_one_to_one
from txrisk.session import materialise
from txrisk.sources.tables import read_table, spread


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: the transaction table."""
    orders = read_table(spark, sf, "orders")
    customer = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"),
        F.unix_timestamp("o_orderdate").alias("sec"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("label"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_custkey").alias("card"),
        F.col("c_nationkey").cast("long").alias("addr"),
        F.pmod("o_orderkey", F.lit(30)).alias("age"),
        F.col("o_orderpriority").alias("product"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


FACTS = """facts AS (
  SELECT o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS sec,
    CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS label,
    o_totalprice AS amount, o_custkey AS card, CAST(c_nationkey AS BIGINT) AS addr,
    o_orderkey % 30 AS age, o_orderpriority AS product, c_acctbal AS balance,
    c_mktsegment AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Side table: one row per order with returned lines."""
    lines = read_table(
        spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    )
    return (
        lines.filter(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("r_lines"),
            F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("r_qty"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("r_value"),
        )
    )


RETURNS = """returns AS (
  SELECT l_orderkey AS id, count(*) AS r_lines,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS r_qty,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS r_value
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)"""


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    """A second side table: orders with lines of more than 40 units."""
    lines = read_table(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_discount"])
    return (
        lines.filter(F.col("l_quantity") > 40)
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.count(F.lit(1)).alias("b_lines"), F.max("l_discount").alias("b_discount"))
    )


BULK = """bulk AS (
  SELECT l_orderkey AS id, count(*) AS b_lines, max(l_discount) AS b_discount
  FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey)"""


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with both side tables; each leaves its own null pattern."""
    joined = enrich_one_to_one(facts(spark, sf), returns(spark, sf), "id", "has_returns")
    wide = enrich_one_to_one(joined, bulk(spark, sf), "id", "has_bulk")
    return wide.select(
        "id", "sec", "label", "amount", "card", "addr", "age", "product", "balance", "segment",
        "r_lines", "r_qty", "r_value", F.col("has_returns").cast("long").alias("has_returns"),
        "b_lines", "b_discount", F.col("has_bulk").cast("long").alias("has_bulk"),
    )


ENRICHED = f"""{FACTS}, {RETURNS}, {BULK}, enriched AS (
  SELECT f.*, r.r_lines, r.r_qty, r.r_value,
    CAST(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_returns,
    b.b_lines, b.b_discount,
    CAST(CASE WHEN b.id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS has_bulk
  FROM facts f LEFT JOIN returns r ON f.id = r.id LEFT JOIN bulk b ON f.id = b.id)"""

# Spark type of every enriched column.
ENRICHED_TYPES = {
    "id": "bigint",
    "sec": "bigint",
    "label": "bigint",
    "amount": "double",
    "card": "bigint",
    "addr": "bigint",
    "age": "bigint",
    "product": "string",
    "balance": "double",
    "segment": "string",
    "r_lines": "bigint",
    "r_qty": "double",
    "r_value": "double",
    "has_returns": "bigint",
    "b_lines": "bigint",
    "b_discount": "double",
    "has_bulk": "bigint",
}


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a scored table: the value is both score and amount."""
    events = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return events.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("entity"),
        "event_type",
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("label"),
        F.col("value").alias("score"),
        F.col("value").alias("amount"),
    )


SCORED = """scored AS (
  SELECT event_id AS id, ts, user_id AS entity, event_type,
    CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS label,
    value AS score, value AS amount
  FROM events)"""

# Score order, riskiest first, the lower id on ties.
RANKED = """ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k,
    CAST(sum(label) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS caught,
    CAST(sum(label * CAST(amount AS DECIMAL(18,4)))
      OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS caught_value
  FROM scored), totals AS (
  SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS p,
    CAST(sum(label * CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS v FROM scored)"""

# Prices 4 / 25 / 1 and 90% recovery; 1 - 0.9 is written as the double it is.
CURVE = f"""{SCORED}, {RANKED}, points AS (
  SELECT k, score AS threshold, caught, caught_value FROM ranked
  UNION ALL SELECT 0, CAST('Infinity' AS DOUBLE), 0, CAST(0 AS DOUBLE)),
priced AS (
  SELECT k AS n_flagged, k / CAST(n AS DOUBLE) AS review_rate, threshold,
    CAST(caught AS DOUBLE) AS positives_caught, CAST(p - caught AS DOUBLE) AS positives_missed,
    CAST(k - caught AS DOUBLE) AS false_alarms, caught / CAST(p AS DOUBLE) AS recall,
    CASE WHEN k = 0 THEN CAST(0 AS DOUBLE) ELSE caught / CAST(k AS DOUBLE) END AS precision,
    (v - caught_value) + (p - caught) * CAST(25 AS DOUBLE) AS cost_missed,
    caught * CAST(4 AS DOUBLE) + CAST('0.09999999999999998' AS DOUBLE)
      * (caught_value + caught * CAST(25 AS DOUBLE)) AS cost_caught,
    (k - caught) * CAST(5 AS DOUBLE) AS cost_false_alarm,
    v + p * CAST(25 AS DOUBLE) AS nothing
  FROM points, totals),
curve AS (
  SELECT * EXCLUDE (nothing), cost_missed + cost_caught + cost_false_alarm AS total_cost,
    nothing - (cost_missed + cost_caught + cost_false_alarm) AS savings FROM priced)"""


def lines_by_year(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Shipped lines before 1999 (the reference) and after, by year.

    Monitoring passes over the features several times, so they are written
    first, as the feature stage does; later filters are pushed to that table.
    """
    lines = read_table(
        spark, sf, "lineitem",
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"],
    )
    year = F.year("l_shipdate")
    features = lines.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        # a feature that goes missing: prices of returned lines are blank later
        F.when((F.col("l_returnflag") != "R") | (year < 1999), F.col("l_extendedprice")).alias("price_known"),
        # a feature that collapses onto one value
        F.when((F.col("l_returnflag") == "A") & (year >= 2000), F.lit(1.0))
        .otherwise(F.col("l_quantity")).alias("quantity_stuck"),
        year.cast("string").alias("period"),
    )
    table = materialise(spread(features), "features")
    return table.filter(F.col("period") < "1999"), table.filter(F.col("period") >= "1999")


DRIFT_FEATURES = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_known", "quantity_stuck",
]
LINES = """lines AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax,
    CASE WHEN NOT (l_returnflag = 'R' AND year(l_shipdate) >= 1999) THEN l_extendedprice END
      AS price_known,
    CASE WHEN l_returnflag = 'A' AND year(l_shipdate) >= 2000 THEN CAST(1 AS DOUBLE)
      ELSE l_quantity END AS quantity_stuck,
    strftime(l_shipdate, '%Y') AS period
  FROM lineitem)"""


def stack_sql(table: str, columns: list[str], kind: str = "VARCHAR", extra: str = "") -> str:
    """(column, value) rows of a table, column by column."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS {kind}) AS value{extra} FROM {table}" for c in columns
    )
