"""Row-level expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions import scalar as X
from txrisk.plans.inputs import FACTS, facts
from txrisk.plans.registry import query, rounded
from txrisk.sources.tables import read_table
from txrisk.streaming.scoring import quarantine

_LABEL = "coalesce(CAST(CAST(round({0}, 6) AS DOUBLE) AS VARCHAR), '(missing)')"


@query(
    "label_text",
    f"""SELECT o_orderkey AS id, {_LABEL.format('o_totalprice')} AS price,
          coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR) END, '(missing)') AS card,
          o_orderpriority AS product FROM orders""",
)
def label_text(spark, sf):
    o = read_table(spark, sf, "orders")
    card = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        X.label_of(o, "o_totalprice").alias("price"),
        X.label_text(card, T.LongType()).alias("card"),
        X.label_of(o, "o_orderpriority").alias("product"),
    )


@query(
    "uid_key",
    f"""WITH {FACTS} SELECT CAST(CAST(card AS DOUBLE) AS VARCHAR) || '_' ||
          coalesce(CAST(CAST(addr AS DOUBLE) AS VARCHAR), '(missing)') || '_' ||
          CAST(CAST(floor(sec / 86400.0) - age AS DOUBLE) AS VARCHAR) AS uid, count(*) AS rows
        FROM facts GROUP BY 1""",
)
def uid_key(spark, sf):
    f = facts(spark, sf)
    return f.groupBy(X.entity_key(f, "card", "addr", "sec", "age").alias("uid")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "time_features",
    """SELECT event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24 AS hour,
         CAST(floor(epoch(ts) / 86400) AS BIGINT) % 7 AS day_of_week FROM events""",
)
def time_features(spark, sf):
    sec = F.unix_timestamp("ts")
    return read_table(spark, sf, "events", ["event_id", "ts"]).select(
        "event_id", X.hour_of(sec).alias("hour"), X.day_of_week(sec).alias("day_of_week")
    )


@query(
    "amount_features",
    """SELECT o_orderkey AS id, round(ln(1 + o_totalprice), 6) AS amount_log,
         round(o_totalprice - floor(o_totalprice), 4) AS amount_cents,
         CAST(CASE WHEN round(o_totalprice - floor(o_totalprice), 4) = 0 THEN 1 ELSE 0 END AS BIGINT) AS amount_is_round
       FROM orders""",
)
def amount_features(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return rounded(o.select(F.col("o_orderkey").alias("id"), *X.amount_parts("o_totalprice")))


_HOST = "split_part(split_part(url, '/', 3), ':', 1)"


@query(
    "domain_split",
    f"""SELECT page_id, split_part({_HOST}, '.', 1) AS provider,
          CASE WHEN strpos({_HOST}, '.') > 0 THEN substr({_HOST}, strpos({_HOST}, '.') + 1)
            ELSE '(missing)' END AS suffix FROM pages""",
)
def domain_split(spark, sf):
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    provider, suffix = X.domain_parts(host)
    return read_table(spark, sf, "pages", ["page_id", "url"]).select(
        "page_id", provider.alias("provider"), suffix.alias("suffix")
    )


@query(
    "dimension_parse",
    """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_brand
         ELSE CAST(p_size * 40 AS VARCHAR) || 'x' || CAST(p_size * 30 AS VARCHAR) END AS s FROM part)
       SELECT p_partkey, try_cast(split_part(s, 'x', 1) AS DOUBLE) AS width,
         try_cast(nullif(split_part(s, 'x', 2), '') AS DOUBLE) AS height,
         try_cast(split_part(s, 'x', 1) AS DOUBLE) * try_cast(nullif(split_part(s, 'x', 2), '') AS DOUBLE) AS area
       FROM t""",
)
def dimension_parse(spark, sf):
    text = F.when(F.col("p_partkey") % 11 == 0, F.col("p_brand")).otherwise(
        F.concat_ws("x", F.col("p_size") * 40, F.col("p_size") * 30)
    )
    part = read_table(spark, sf, "part", ["p_partkey", "p_brand", "p_size"]).withColumn("s", text)
    width, height, area = X.dimension_parts("s")
    return part.select("p_partkey", width.alias("width"), height.alias("height"), area.alias("area"))


@query(
    "first_token",
    """SELECT p_partkey, lower(split_part(split_part(p_name, ' ', 1), '/', 1)) AS name_token,
         lower(split_part(split_part(p_brand || '/v' || CAST(p_size AS VARCHAR), ' ', 1), '/', 1)) AS brand_token
       FROM part""",
)
def first_token(spark, sf):
    brand = F.concat(F.col("p_brand"), F.lit("/v"), F.col("p_size").cast("string"))
    return read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand", "p_size"]).select(
        "p_partkey", X.first_token("p_name").alias("name_token"), X.first_token(brand).alias("brand_token")
    )


@query(
    "row_match_counts",
    """WITH t AS (SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'T' ELSE 'F' END AS M1,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_totalprice > 250000 THEN 'T' ELSE 'F' END AS M2,
         CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'M' || CAST(o_custkey % 3 AS VARCHAR) END AS M4 FROM orders)
       SELECT id, CAST(coalesce(CAST(M1 = 'T' AS INT), 0) + coalesce(CAST(M2 = 'T' AS INT), 0) AS BIGINT) AS true_count,
         CAST((M1 IS NULL)::INT + (M2 IS NULL)::INT + (M4 IS NULL)::INT AS BIGINT) AS missing_count FROM t""",
)
def row_match_counts(spark, sf):
    flag = lambda c: F.when(c, "T").otherwise("F")
    key = F.col("o_orderkey")
    t = read_table(spark, sf, "orders").select(
        key.alias("id"),
        F.when(key % 5 != 0, flag(F.col("o_orderstatus") == "F")).alias("M1"),
        F.when(key % 3 != 0, flag(F.col("o_totalprice") > 250000)).alias("M2"),
        F.when(key % 2 != 0, F.concat(F.lit("M"), (F.col("o_custkey") % 3).cast("string"))).alias("M4"),
    )
    hits, blanks = X.match_counts(t, [f"M{i}" for i in range(1, 10)])
    return rounded(t.select("id", hits.alias("true_count"), blanks.alias("missing_count")))


@query(
    "domains_match",
    f"""WITH t AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '(missing)' ELSE {_HOST} END AS a,
          CASE WHEN page_id % 5 = 0 THEN '(missing)' WHEN page_id % 3 = 0 THEN {_HOST} ELSE 'example.com' END AS b FROM pages)
        SELECT page_id, CASE WHEN a <> '(missing)' AND b <> '(missing)' THEN CAST(a = b AS DOUBLE) END AS same FROM t""",
)
def domains_match(spark, sf):
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    pid = F.col("page_id")
    t = read_table(spark, sf, "pages", ["page_id", "url"]).select(
        "page_id",
        F.when(pid % 4 == 0, "(missing)").otherwise(host).alias("a"),
        F.when(pid % 5 == 0, "(missing)").when(pid % 3 == 0, host).otherwise("example.com").alias("b"),
    )
    return t.select("page_id", X.domains_match("a", "b").alias("same"))


@query(
    "derive_time",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS BIGINT) AS hour,
         CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week,
         CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day_index,
         strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' ||
           strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
         strftime(ts, '%Y-%m') AS month FROM events""",
)
def derive_time(spark, sf):
    events = read_table(spark, sf, "events", ["event_id", "ts"])
    cols = X.time_columns(F.unix_timestamp("ts"))
    t = events.select("event_id", "ts", *cols)
    return rounded(
        t.select(
            "event_id",
            F.date_format("date", "yyyy-MM-dd").alias("day"),
            "hour",
            "day_of_week",
            "day_index",
            X.week_label("ts").alias("week"),
            X.month_label("timestamp").alias("month"),
        )
    )


@query(
    "decision",
    "SELECT event_id, CASE WHEN value >= 20.15 THEN 'review' ELSE 'pass' END AS decision FROM events",
)
def decision(spark, sf):
    return read_table(spark, sf, "events", ["event_id", "value"]).select(
        "event_id", X.decision("value", 20.15).alias("decision")
    )


@query(
    "quarantine_invalid",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS amount,
         CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_custkey END AS card FROM orders)
       SELECT o_orderkey, concat_ws(', ', CASE WHEN amount IS NULL THEN 'amount' END,
         CASE WHEN card IS NULL THEN 'card' END) AS missing_fields FROM t WHERE amount IS NULL OR card IS NULL""",
)
def quarantine_invalid(spark, sf):
    key = F.col("o_orderkey")
    t = read_table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 10 != 0, F.col("o_totalprice")).alias("amount"),
        F.when(key % 15 != 0, F.col("o_custkey")).alias("card"),
    )
    _, refused = quarantine(t, ["o_orderkey", "amount", "card"])
    return refused.select("o_orderkey", F.array_join("missing_fields", ", ").alias("missing_fields"))


@query(
    "drift_band",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_discount * 4 IS NULL OR l_linenumber = 7 THEN 'unknown'
         WHEN l_discount * 4 < 0.10 THEN 'stable' WHEN l_discount * 4 < 0.25 THEN 'moderate'
         ELSE 'significant' END AS band FROM lineitem""",
)
def drift_band(spark, sf):
    psi = F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 4)
    return rounded(
        read_table(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", X.drift_band(psi).alias("band")
        )
    )
