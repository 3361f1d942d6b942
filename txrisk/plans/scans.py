"""Sources, sinks and schema decisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.operators import joins, profile
from txrisk.plans.inputs import ENRICHED, ENRICHED_TYPES, FACTS, SCORED, enriched, facts, scored
from txrisk.plans.registry import query, round_double
from txrisk.session import materialise, scratch_path
from txrisk.sources import tables, typing
from txrisk.sources.tables import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
COLUMN_COUNTS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
    "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2,
    "labels": 3, "conversations": 4,
}


@query(
    "scan_csv",
    """SELECT o_orderpriority, count(*) AS n,
         round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total
       FROM orders GROUP BY 1""",
)
def scan_csv(spark, sf):
    path = scratch_path(spark, "orders-csv")
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    tables.write_csv(orders, path)
    back = tables.read_csv(spark, path, orders.schema)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return back.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), round_double(total, 2).alias("total")
    )


@query(
    "parquet_roundtrip",
    f"""WITH {FACTS} SELECT CASE WHEN sec <= 852076800 THEN 'early' ELSE 'late' END AS split,
          count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM facts GROUP BY 1""",
)
def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "facts")
    split = F.when(F.col("sec") <= 852076800, "early").otherwise("late")
    tables.write_parquet(facts(spark, sf).withColumn("split", split), path, ["split"])
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives")
    )


@query(
    "rename_by_pattern",
    """SELECT user_id AS "id_01", CAST(max(event_id) AS BIGINT) AS "id_02", count(*) AS "id-3",
         CAST(3 AS BIGINT) - 1 AS renamed
       FROM events GROUP BY user_id""",
)
def rename_by_pattern(spark, sf):
    raw = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("id-01")).agg(
        F.max("event_id").alias("id-02"), F.count(F.lit(1)).alias("id-3")
    )
    renamed, n = tables.rename_by_pattern(raw, r"id-\d{2}", "-", "_")
    return renamed.withColumn("renamed", F.lit(n).cast("long"))


_PINNED = {"id": "int", "sec": "int", "label": "tinyint", "amount": "double"}


def _narrow_sql() -> str:
    parts = []
    for c, t in ENRICHED_TYPES.items():
        if c in _PINNED:
            parts.append(f"SELECT '{c}' AS \"column\", '{t}' AS current_type, '{_PINNED[c]}' AS narrow_type, false AS is_category")
        elif t == "bigint":
            parts.append(
                f"""SELECT '{c}', '{t}', CASE WHEN min({c}) IS NULL THEN 'tinyint'
                  WHEN min({c}) >= -128 AND max({c}) < 128 THEN 'tinyint'
                  WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint'
                  WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int'
                  ELSE 'bigint' END, false FROM enriched"""
            )
        elif t == "double":
            parts.append(
                f"""SELECT '{c}', '{t}', CASE WHEN bool_and({c} = round({c})) AND max(abs({c})) >= 16777216
                  THEN 'double' ELSE 'float' END, false FROM enriched"""
            )
        else:
            parts.append(
                f"""SELECT '{c}', '{t}', '{t}',
                  count(DISTINCT coalesce({c}, '(null)')) / CAST(count(*) AS DOUBLE) < 0.5 FROM enriched"""
            )
    return f"WITH {ENRICHED} " + " UNION ALL ".join(parts)


@query("type_narrowing_plan", _narrow_sql())
def type_narrowing_plan(spark, sf):
    return typing.narrowing_plan(materialise(enriched(spark, sf), "joined"), _PINNED)


_COERCED = ["o_orderpriority", "price_text", "key_text"]


@query(
    "numeric_coercion_plan",
    """WITH t AS (SELECT o_orderpriority, CAST(o_totalprice AS VARCHAR) AS price_text,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS key_text
       FROM orders), lost AS (
       SELECT count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL) AS a,
         count(*) FILTER (WHERE price_text IS NOT NULL AND try_cast(price_text AS DOUBLE) IS NULL) AS b,
         count(*) FILTER (WHERE key_text IS NOT NULL AND try_cast(key_text AS DOUBLE) IS NULL) AS c FROM t),
       rows AS (SELECT 'o_orderpriority' AS "column", a AS values_lost FROM lost
         UNION ALL SELECT 'price_text', b FROM lost UNION ALL SELECT 'key_text', c FROM lost)
       SELECT *, CASE WHEN values_lost = 0 THEN 'double' ELSE 'string' END AS target_type FROM rows""",
)
def numeric_coercion_plan(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    texts = orders.select(
        "o_orderpriority",
        F.col("o_totalprice").cast("string").alias("price_text"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).alias("key_text"),
    )
    return typing.numeric_coercion_plan(texts, _COERCED)


@query(
    "json_to_columns",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         CAST(NULL AS VARCHAR) AS absent FROM events""",
)
def json_to_columns(spark, sf):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("absent", T.StringType())])
    return tables.json_to_columns(read_table(spark, sf, "events", ["event_id", "props"]), "props", schema)


@query(
    "table_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, CAST({COLUMN_COUNTS[t]} AS BIGINT) AS columns, "
        f"true AS columns_match FROM {t}"
        for t in TABLES
    ),
)
def table_inventory(spark, sf):
    return tables.table_inventory({t: read_table(spark, sf, t) for t in TABLES}, COLUMN_COUNTS)


@query(
    "report_bundle_json",
    f"""WITH {FACTS}, {SCORED},
        hourly AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS rows,
          CAST(sum(label) AS BIGINT) AS positives FROM scored GROUP BY 1),
        balance AS (SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS positives FROM facts),
        parts AS (
          SELECT 'balance' AS name, '[' || string_agg('{{"total":' || total || ',"positives":' || positives || '}}', ',') || ']' AS records FROM balance
          UNION ALL SELECT 'hourly', '[' || string_agg('{{"hour":' || hour || ',"rows":' || rows || ',"positives":' || positives || '}}', ',' ORDER BY hour) || ']' FROM hourly)
        SELECT '{{' || string_agg('"' || name || '":' || records, ',' ORDER BY name) || '}}' AS bundle FROM parts""",
)
def report_bundle_json(spark, sf):
    hourly = profile.hourly_rate(scored(spark, sf), "ts", "label").drop("rate")
    balance = profile.class_balance(facts(spark, sf), "label").select("total", "positives")
    return tables.report_bundle({"hourly": (hourly, ["hour"]), "balance": (balance, ["total"])})


@query("union_tables", """SELECT kind, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM (
    SELECT 'order' AS kind, o_orderkey AS key FROM orders
    UNION ALL SELECT 'event', event_id FROM events
    UNION ALL SELECT 'line', l_orderkey FROM lineitem) GROUP BY kind""")
def union_tables(spark, sf):
    parts = [
        read_table(spark, sf, t, [c]).select(F.lit(k).alias("kind"), F.col(c).alias("key"))
        for k, t, c in (("order", "orders", "o_orderkey"), ("event", "events", "event_id"), ("line", "lineitem", "l_orderkey"))
    ]
    return joins.union_tables(parts).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys")
    )


@query(
    "key_intersect",
    "SELECT o_orderkey AS key FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'",
)
def key_intersect(spark, sf):
    lines = read_table(spark, sf, "lineitem", ["l_orderkey", "l_returnflag"]).filter("l_returnflag = 'R'")
    orders = read_table(spark, sf, "orders", ["o_orderkey"])
    return orders.select(F.col("o_orderkey").alias("key")).intersect(lines.select(F.col("l_orderkey").alias("key")))


@query(
    "key_except",
    "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def key_except(spark, sf):
    urgent = read_table(spark, sf, "orders", ["o_custkey", "o_orderpriority"]).filter("o_orderpriority = '1-URGENT'")
    customer = read_table(spark, sf, "customer", ["c_custkey"])
    return customer.select(F.col("c_custkey").alias("key")).subtract(urgent.select(F.col("o_custkey").alias("key")))
