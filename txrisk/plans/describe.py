"""Enrichment joins, profiling and column selection over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.operators import joins, ordering, profile, selection
from txrisk.operators.encoding import split_summary as summarise_split
from txrisk.operators.encoding import time_split as split_by_time
from txrisk.plans.inputs import (
    ENRICHED,
    ENRICHED_TYPES,
    FACTS,
    RETURNS,
    SCORED,
    enriched,
    facts,
    returns,
    scored,
    stack_sql,
)
from txrisk.plans.registry import query, rounded
from txrisk.session import materialise
from txrisk.settings import Scale
from txrisk.sources import tables
from txrisk.sources.tables import read_table

# ----------------------------------------------------------------------- joins


@query("enrich_left_join", f"WITH {ENRICHED} SELECT * FROM enriched")
def enrich_left_join(spark, sf):
    return enriched(spark, sf)


@query(
    "join_contract",
    f"""WITH {FACTS}, {RETURNS}, m AS (SELECT f.id FROM facts f LEFT JOIN returns r ON f.id = r.id),
        c AS (SELECT count(*) AS actual_rows, CAST(14 AS BIGINT) AS actual_columns,
          (SELECT count(*) FROM orders) AS expected_rows, CAST(14 AS BIGINT) AS expected_columns,
          count(*) - count(DISTINCT id) AS duplicate_keys FROM m)
        SELECT *, actual_rows = expected_rows AS rows_match, actual_columns = expected_columns AS columns_match,
          duplicate_keys = 0 AS keys_unique,
          actual_rows = expected_rows AND actual_columns = expected_columns AND duplicate_keys = 0 AS passed FROM c""",
)
def join_contract(spark, sf):
    base = facts(spark, sf)
    merged = joins.enrich_one_to_one(base, returns(spark, sf), "id", "has_returns")
    rows = read_table(spark, sf, "orders", ["o_orderkey"]).agg(F.count(F.lit(1))).scalar()
    return joins.join_contract(merged, "id", rows, len(base.columns) + 4)


@query(
    "key_coverage",
    f"""WITH {RETURNS}, k AS (SELECT o_orderkey, r.id FROM orders LEFT JOIN returns r ON o_orderkey = r.id)
        SELECT count(*) AS left_keys, (SELECT count(*) FROM returns) AS right_keys,
          count(id) AS shared_keys, round(count(id) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM k""",
)
def key_coverage(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "id")
    return rounded(joins.key_coverage(orders, returns(spark, sf), "id"))


@query(
    "key_missing_anti",
    "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def key_missing_anti(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "id")
    lines = read_table(spark, sf, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "id")
    return joins.missing_keys(orders, lines, "id")


@query(
    "key_uniqueness",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, count(DISTINCT {k}) AS unique_keys, "
        f"count(*) - count(DISTINCT {k}) AS duplicate_keys FROM {t}"
        for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "user_id"))
    ),
)
def key_uniqueness(spark, sf):
    return joins.union_tables(
        [
            joins.key_uniqueness(read_table(spark, sf, t, [k]), k, t)
            for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "user_id"))
        ]
    )


# ----------------------------------------------------------------------- rates


@query(
    "class_balance",
    """SELECT 'orders' AS source, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS positives,
         count(*) FILTER (WHERE o_orderstatus <> 'F') AS negatives,
         round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS positive_rate,
         round(count(*) FILTER (WHERE o_orderstatus <> 'F') / CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE), 6) AS ratio
       FROM orders
       UNION ALL SELECT 'documents', count(*), CAST(sum(toxic) AS BIGINT), count(*) - CAST(sum(toxic) AS BIGINT),
         round(sum(toxic) / CAST(count(*) AS DOUBLE), 6),
         round((count(*) - sum(toxic)) / CAST(sum(toxic) AS DOUBLE), 6)
       FROM documents JOIN labels USING (doc_id)""",
)
def class_balance(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id"]).join(read_table(spark, sf, "labels"), "doc_id")
    parts = {"orders": (facts(spark, sf), "label"), "documents": (docs, "toxic")}
    return rounded(
        joins.union_tables(
            [profile.class_balance(t, y).select(F.lit(n).alias("source"), "*") for n, (t, y) in parts.items()]
        )
    )


_FLAG_COLUMNS = """count(*) FILTER (WHERE has_returns = 0) AS rows_without,
    CAST(coalesce(sum(label) FILTER (WHERE has_returns = 0), 0) AS BIGINT) AS positives_without,
    count(*) FILTER (WHERE has_returns = 1) AS rows_with,
    CAST(coalesce(sum(label) FILTER (WHERE has_returns = 1), 0) AS BIGINT) AS positives_with"""
_FLAG_RATES = """round(positives_without / CAST(rows_without AS DOUBLE), 6) AS rate_without,
    round(positives_with / CAST(rows_with AS DOUBLE), 6) AS rate_with,
    round((positives_with / CAST(rows_with AS DOUBLE)) / (positives_without / CAST(rows_without AS DOUBLE)), 6) AS lift"""


@query(
    "rate_by_flag",
    f"WITH {ENRICHED}, g AS (SELECT {_FLAG_COLUMNS} FROM enriched) SELECT *, {_FLAG_RATES} FROM g",
)
def rate_by_flag(spark, sf):
    return rounded(profile.rate_by_flag(enriched(spark, sf), "has_returns", "label"))


@query(
    "stratified_lift",
    f"""WITH {ENRICHED}, g AS (SELECT product, {_FLAG_COLUMNS} FROM enriched GROUP BY product)
        SELECT *, {_FLAG_RATES} FROM g WHERE rows_with > 0 AND rows_without > 0""",
)
def stratified_lift(spark, sf):
    return rounded(profile.rate_by_flag(enriched(spark, sf), "has_returns", "label", ["product"]))


@query(
    "crosstab_share",
    f"""WITH {ENRICHED} SELECT product,
          round_even(count(*) FILTER (WHERE has_returns = 0) / CAST(count(*) AS DOUBLE) * 100, 1) AS share_0,
          round_even(count(*) FILTER (WHERE has_returns = 1) / CAST(count(*) AS DOUBLE) * 100, 1) AS share_1
        FROM enriched GROUP BY product""",
)
def crosstab_share(spark, sf):
    return profile.crosstab_share(enriched(spark, sf), "product", "has_returns")


@query(
    "rate_by_category",
    f"""WITH {FACTS} SELECT coalesce(CASE WHEN product = '5-LOW' THEN NULL ELSE product END, '(missing)') AS category,
          count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
          round(sum(label) / CAST(count(*) AS DOUBLE), 6) AS rate
        FROM facts GROUP BY 1 HAVING count(*) >= 500""",
)
def rate_by_category(spark, sf):
    f = facts(spark, sf).withColumn("product", F.when(F.col("product") != "5-LOW", F.col("product")))
    return rounded(profile.rate_by_category(f, "product", "label"))


@query(
    "time_range",
    """WITH e AS (SELECT 'orders' AS label, CAST(epoch(min(o_orderdate)) AS BIGINT) AS lo, CAST(epoch(max(o_orderdate)) AS BIGINT) AS hi FROM orders
         UNION ALL SELECT 'events', CAST(floor(epoch(min(ts))) AS BIGINT), CAST(floor(epoch(max(ts))) AS BIGINT) FROM events)
       SELECT label, lo AS min_seconds, hi AS max_seconds, round_even((hi - lo) / CAST(86400 AS DOUBLE), 1) AS span_days,
         strftime(make_timestamp(lo * 1000000), '%Y-%m-%d') AS start_date,
         strftime(make_timestamp(hi * 1000000), '%Y-%m-%d') AS end_date,
         round_even((lo - lag(hi) OVER (ORDER BY lo, label)) / CAST(86400 AS DOUBLE), 1) AS gap_days FROM e""",
)
def time_range(spark, sf):
    orders = read_table(spark, sf, "orders", ["o_orderdate"]).select(F.unix_timestamp("o_orderdate").alias("sec"))
    events = read_table(spark, sf, "events", ["ts"]).select(F.unix_timestamp("ts").alias("sec"))
    return profile.time_range({"orders": orders, "events": events}, "sec")


# --------------------------------------------------------------------- columns

_FAMILIES = {"id": "identifier", "label": "target", "sec": "time", "amount": "amount", "card": "card"}
_PATTERNS = [(r"^r_\w+$", "returns"), (r"^b_\w+$", "bulk"), (r"^has_\w+$", "engineered")]
_FAMILY_SQL = """CASE WHEN "column" = 'id' THEN 'identifier' WHEN "column" = 'label' THEN 'target'
    WHEN "column" = 'sec' THEN 'time' WHEN "column" = 'amount' THEN 'amount' WHEN "column" = 'card' THEN 'card'
    WHEN "column" LIKE 'r\\_%' ESCAPE '\\' THEN 'returns' WHEN "column" LIKE 'b\\_%' ESCAPE '\\' THEN 'bulk'
    WHEN "column" LIKE 'has\\_%' ESCAPE '\\' THEN 'engineered' ELSE 'unmapped' END"""


def _profile_sql() -> str:
    parts = []
    for c, t in ENRICHED_TYPES.items():
        ends = (
            f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)"
            if t != "string"
            else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
        )
        parts.append(
            f"SELECT '{c}', '{t}', count(*) - count({c}), round_even((count(*) - count({c})) * 100.0e0 / count(*), 2), "
            f"count(DISTINCT {c}), {ends} FROM enriched"
        )
    body = " UNION ALL ".join(parts)
    return f"""{ENRICHED}, raw("column", dtype, missing_count, missing_pct, unique_count, min_value, max_value) AS ({body}),
      prof AS (SELECT *, {_FAMILY_SQL} AS family FROM raw)"""


_PROFILE = _profile_sql()


def _profile(spark, sf):
    joined = materialise(enriched(spark, sf), "joined")  # read once per pass below
    return profile.column_profile(joined, _FAMILIES, _PATTERNS)


@query("column_profile", f"WITH {_PROFILE} SELECT * FROM prof")
def column_profile(spark, sf):
    return _profile(spark, sf)


_SKETCHED = ["product", "card", "amount", "b_discount"]


@query(
    "distinct_sketches",
    f"""WITH {ENRICHED} {" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT product) + max(CASE WHEN product IS NULL THEN 1 ELSE 0 END) AS parts,
          count({c}) AS rows, count(DISTINCT {c}) AS unique_count, true AS within_bounds FROM enriched"""
        for c in _SKETCHED)}""",
)
def distinct_sketches(spark, sf):
    """Sketches of each product's rows, stored, merged and held against exact counts."""
    work = materialise(enriched(spark, sf).select(*_SKETCHED), "sketched")
    stored = materialise(profile.distinct_sketches(work, _SKETCHED, F.col("product")), "sketches")
    merged = profile.merged_distinct(stored, errors=5.0)
    exact = profile.column_profile(work, _FAMILIES, _PATTERNS).select("column", "unique_count")
    inside = F.col("unique_count").between(F.col("unique_low"), F.col("unique_high"))
    return merged.join(exact, "column").select(
        "column", "parts", "rows", "unique_count", inside.alias("within_bounds")
    )


@query(
    "missing_profile",
    f"""WITH {_PROFILE} SELECT "column", family, missing_pct,
          (SELECT count(*) FROM prof WHERE missing_pct = 0) AS columns_complete,
          (SELECT count(*) FROM prof WHERE missing_pct > 90) AS columns_nearly_empty
        FROM prof ORDER BY missing_pct DESC, "column" LIMIT 25""",
)
def missing_profile(spark, sf):
    return profile.missing_profile(_profile(spark, sf), 25)


@query(
    "family_summary",
    f"""WITH {_PROFILE} SELECT family, count(*) AS columns, round_even(avg(missing_pct), 2) AS mean_missing_pct,
          round_even(max(missing_pct), 2) AS max_missing_pct FROM prof GROUP BY family""",
)
def family_summary(spark, sf):
    return profile.family_summary(_profile(spark, sf))


_MASKED = [c for c in ENRICHED_TYPES if c not in ("id",)]


@query(
    "null_pattern_blocks",
    f"""WITH {ENRICHED}, s AS ({' UNION ALL '.join(
        f"SELECT {i} AS place, '{c}' AS name, id, {c} IS NULL AS gone FROM enriched" for i, c in enumerate(_MASKED))}),
        prints AS (SELECT place, name, count(*) FILTER (WHERE gone) AS nulls, count(*) AS n,
          md5(coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE gone), '')) AS mask FROM s GROUP BY place, name),
        blocks AS (SELECT count(*) AS n_columns, min(place) AS place, round_even(max(nulls) * 100.0e0 / max(n), 2) AS missing_pct,
          string_agg(name, ', ' ORDER BY place) AS columns FROM prints GROUP BY mask)
        SELECT row_number() OVER (ORDER BY n_columns DESC, place) AS group_id, n_columns, missing_pct, columns FROM blocks""",
)
def null_pattern_blocks(spark, sf):
    return profile.null_pattern_blocks(enriched(spark, sf), "id", _MASKED)


_CANDIDATES = ["constant", "mostly_none", "product", "has_returns", "rare_urgent", "b_discount", "r_lines"]


def _candidates(spark, sf):
    """Columns of every kind: constant, all null, nearly constant, varied."""
    return enriched(spark, sf).select(
        "label",
        F.lit("same").alias("constant"),
        F.lit(None).cast("string").alias("all_null"),
        F.when(F.col("id") % 251 == 0, F.col("product")).alias("mostly_none"),
        "product",
        "has_returns",
        # rare values that follow the label
        F.when((F.col("label") == 1) & (F.col("id") % 53 == 0), "yes").otherwise("no").alias("rare_urgent"),
        "b_discount",
        "r_lines",
    )


_CANDIDATE_SQL = f"""{ENRICHED}, t AS (SELECT label, 'same' AS constant, CAST(NULL AS VARCHAR) AS all_null,
    CASE WHEN id % 251 = 0 THEN product END AS mostly_none, product, has_returns,
    CASE WHEN label = 1 AND id % 53 = 0 THEN 'yes' ELSE 'no' END AS rare_urgent, b_discount, r_lines FROM enriched)"""


@query("constant_columns", f"WITH {_CANDIDATE_SQL} SELECT unnest(['constant', 'all_null']) AS \"column\" FROM (SELECT count(*) AS n FROM t) WHERE n > 0")
def constant_columns(spark, sf):
    return selection.constant_columns(_candidates(spark, sf), [*_CANDIDATES, "all_null"])


_COUNTS_SQL = f"""{_CANDIDATE_SQL}, long AS ({stack_sql('t', _CANDIDATES, extra=', label')}),
    counts AS (SELECT "column", value, count(*) AS n, CAST(sum(label) AS BIGINT) AS y FROM long GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS nth,
      CAST(sum(n) OVER (PARTITION BY "column") AS BIGINT) AS rows,
      CAST(sum(y) OVER (PARTITION BY "column") AS BIGINT) AS y_rows FROM counts)"""


@query(
    "dominant_value",
    f"""WITH {_COUNTS_SQL} SELECT "column", value AS dominant_value,
          round(n / CAST(rows AS DOUBLE), 6) AS dominant_share, rows, n AS dominant_rows FROM best WHERE nth = 1""",
)
def dominant_value(spark, sf):
    work = _candidates(spark, sf).select(*_CANDIDATES)
    return rounded(selection.dominant_by_bounds(work, _CANDIDATES).drop("is_constant"))


_RESCUE_ROWS = 40


@query(
    "near_constant_rescue",
    f"""WITH {_COUNTS_SQL}, m AS (SELECT "column", value AS dominant_value, n / CAST(rows AS DOUBLE) AS share,
          rows - n AS rare_rows, (y_rows - y) / CAST(nullif(rows - n, 0) AS DOUBLE) AS rare,
          ((y_rows - y) / CAST(nullif(rows - n, 0) AS DOUBLE)) / (y_rows / CAST(rows AS DOUBLE)) AS l
        FROM best WHERE nth = 1)
        SELECT "column", dominant_value, round_even(share, 5) AS dominant_share, rare_rows,
          CASE WHEN share >= 0.99 AND rare_rows >= {_RESCUE_ROWS} THEN round_even(rare, 5) END AS rare_rate,
          CASE WHEN share >= 0.99 AND rare_rows >= {_RESCUE_ROWS} THEN round_even(l, 3) END AS lift,
          CASE WHEN share < 0.99 OR (rare_rows >= {_RESCUE_ROWS} AND (l >= 2 OR l <= 0.5)) THEN 'keep' ELSE 'drop' END AS decision,
          CASE WHEN share < 0.99 THEN 'not near-constant'
            WHEN rare_rows < {_RESCUE_ROWS} THEN 'near-constant, only ' || rare_rows || ' rare rows'
            WHEN l >= 2 OR l <= 0.5 THEN 'rescued: rare values linked to the label'
            ELSE 'near-constant, rare values unremarkable' END AS reason FROM m""",
)
def near_constant_rescue(spark, sf):
    frame = _candidates(spark, sf).select("label", *_CANDIDATES)
    return selection.near_constant_rescue(frame, "label", _CANDIDATES, min_rare_rows=_RESCUE_ROWS)


_DIMS = 64
_WIDE = [f"V{i + 1}" for i in range(_DIMS)]


def _wide_vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_WIDE)]
    )


@query(
    "block_correlation",
    f"""WITH x AS (SELECT vec_id, unnest(range(1, {_DIMS + 1})) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
        SELECT 'V' || a.i AS column_a, 'V' || b.i AS column_b, round(corr(a.v, b.v), 6) AS r
        FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2""",
)
def block_correlation(spark, sf):
    return rounded(selection.block_correlation(_wide_vectors(spark, sf), _WIDE))


# Measures that repeat each other, in two blocks with their own null rows.
_BLOCKS = [["r_lines", "r_qty", "r_value"], ["b_lines", "b_discount"], ["amount", "amount_tenths"]]


def _pairs_sql() -> str:
    """Correlations, null rows and distinct counts the greedy pass needs."""
    return f"""{ENRICHED}, t AS (SELECT *, floor(amount / 10) AS amount_tenths FROM enriched)"""


@query(
    "block_reduce",
    f"""WITH {_pairs_sql()}, r AS (SELECT corr(r_lines, r_qty) AS ab, corr(r_lines, r_value) AS ac, corr(r_qty, r_value) AS bc,
          count(DISTINCT r_lines) AS na, count(DISTINCT r_qty) AS nb, count(DISTINCT r_value) AS nc
          FROM t WHERE r_lines IS NOT NULL),
        b AS (SELECT corr(b_lines, b_discount) AS ab, count(DISTINCT b_lines) AS na, count(DISTINCT b_discount) AS nb
          FROM t WHERE b_lines IS NOT NULL),
        m AS (SELECT corr(amount, amount_tenths) AS ab, count(DISTINCT amount) AS na, count(DISTINCT amount_tenths) AS nb FROM t)
        SELECT CAST(1 AS BIGINT) AS block, CAST(1 AS BIGINT) AS cluster,
          CASE WHEN nc > nb THEN 'r_value' ELSE 'r_qty' END AS kept_column, CAST(3 AS BIGINT) AS n_represented,
          'r_lines, r_qty, r_value' AS represents FROM r WHERE ab >= 0.75 AND ac >= 0.75
        UNION ALL SELECT 1, 1, CASE WHEN nb > na THEN 'r_qty' ELSE 'r_lines' END, 2, 'r_lines, r_qty' FROM r WHERE ab >= 0.75 AND ac < 0.75
        UNION ALL SELECT 1, 2, 'r_value', 1, 'r_value' FROM r WHERE ab >= 0.75 AND ac < 0.75
        UNION ALL SELECT 2, 1, 'b_lines', 1, 'b_lines' FROM b WHERE abs(ab) < 0.75
        UNION ALL SELECT 2, 2, 'b_discount', 1, 'b_discount' FROM b WHERE abs(ab) < 0.75
        UNION ALL SELECT 2, 1, CASE WHEN nb > na THEN 'b_discount' ELSE 'b_lines' END, 2, 'b_lines, b_discount' FROM b WHERE abs(ab) >= 0.75
        UNION ALL SELECT 3, 1, CASE WHEN nb > na THEN 'amount_tenths' ELSE 'amount' END, 2, 'amount, amount_tenths' FROM m WHERE ab >= 0.75""",
)
def block_reduce(spark, sf):
    wide = enriched(spark, sf).withColumn("amount_tenths", F.floor(F.col("amount") / 10))
    listed = spark.createDataFrame([(", ".join(b),) for b in _BLOCKS], "columns string")
    blocks = [r["columns"] for r in tables.block_members(listed).collect()]
    return selection.block_reduce(wide, blocks)[1]


# ------------------------------------------------------------------------ time


@query(
    "daily_volume",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM events GROUP BY 1",
)
def daily_volume(spark, sf):
    return profile.daily_volume(scored(spark, sf), "ts")


@query(
    "daily_rate",
    f"""WITH {SCORED} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
          round(sum(label) / CAST(count(*) AS DOUBLE), 6) AS rate,
          round((SELECT sum(label) / CAST(count(*) AS DOUBLE) FROM scored), 6) AS overall_rate FROM scored GROUP BY 1""",
)
def daily_rate(spark, sf):
    return rounded(profile.daily_rate(scored(spark, sf), "ts", "label"))


@query(
    "hourly_rate",
    f"""WITH {SCORED} SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
          round(sum(label) / CAST(count(*) AS DOUBLE), 6) AS rate FROM scored GROUP BY 1""",
)
def hourly_rate(spark, sf):
    return rounded(profile.hourly_rate(scored(spark, sf), "ts", "label"))


@query(
    "amount_histogram",
    f"""WITH {FACTS}, x AS (SELECT label AS g, log10(greatest(amount, 0.01)) AS v FROM facts),
        ends AS (SELECT g, min(v) AS lo, max(v) AS hi FROM x GROUP BY g),
        b AS (SELECT g, lo, (hi - lo) / 60 AS w, least(CAST(floor((v - lo) / ((hi - lo) / 60)) AS BIGINT) + 1, 60) AS bin
          FROM x JOIN ends USING (g))
        SELECT g AS "group", bin, round(lo + (bin - 1) * w, 6) AS edge, count(*) AS rows,
          round(count(*) / (sum(count(*)) OVER (PARTITION BY g) * w), 6) AS density FROM b GROUP BY g, lo, w, bin""",
)
def amount_histogram(spark, sf):
    return rounded(profile.density_histogram(facts(spark, sf), profile.log_amount("amount"), "label", 60))


@query(
    "box_stats",
    f"""WITH {FACTS}, x AS (SELECT label AS g, log10(greatest(amount, 0.01)) AS v FROM facts),
        q AS (SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY g)
        SELECT g AS "group", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          round(min(v), 6) AS whisker_low, round(max(v), 6) AS whisker_high
        FROM x JOIN q USING (g) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY g, q1, median, q3""",
)
def box_stats(spark, sf):
    return rounded(profile.box_stats(facts(spark, sf), profile.log_amount("amount"), "label"))


# ------------------------------------------------------------------ time split


@query(
    "time_split",
    f"""WITH {FACTS} SELECT id, CASE WHEN sec <= (SELECT quantile_cont(sec, 0.8) FROM facts) THEN 'train' ELSE 'valid' END AS split FROM facts""",
)
def time_split(spark, sf):
    return split_by_time(facts(spark, sf), "sec")[0].select("id", "split")


@query(
    "split_summary",
    f"""WITH {FACTS}, s AS (SELECT *, CASE WHEN sec <= (SELECT quantile_cont(sec, 0.8) FROM facts) THEN 'train' ELSE 'valid' END AS split FROM facts)
        SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS positive_rate,
          strftime(make_timestamp(min(sec) * 1000000), '%Y-%m-%d') AS "start",
          strftime(make_timestamp(max(sec) * 1000000), '%Y-%m-%d') AS "end" FROM s GROUP BY split""",
)
def split_summary(spark, sf):
    return rounded(summarise_split(split_by_time(facts(spark, sf), "sec")[0], "sec", "label"))


@query(
    "hash_sample",
    """SELECT event_id, event_type, value FROM events
       ORDER BY ('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 15))::BIGINT, event_id LIMIT 500""",
)
def hash_sample(spark, sf):
    return ordering.hash_sample(read_table(spark, sf, "events", ["event_id", "event_type", "value"]), "event_id", 500)


@query(
    "quantile_edges",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, unnest(range(0, 11)) AS place,
          unnest(quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM lineitem"""
        for c in ("l_quantity", "l_discount", "l_extendedprice")
    ).join(["SELECT feature, place, round(edge, 6) AS edge FROM (", ")"]),
)
def quantile_edges(spark, sf):
    columns = ["l_quantity", "l_discount", "l_extendedprice"]
    found = ordering.exact_quantiles(
        read_table(spark, sf, "lineitem", columns), columns, [i / 10 for i in range(11)]
    )
    rows = [(c, i, v) for (_, c), vs in found.items() for i, v in enumerate(vs)]
    return rounded(spark.createDataFrame(rows, "feature string, place long, edge double"))


@query(
    "quantiles_by_nullable_group",
    """WITH g AS (SELECT CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag, l_quantity, l_extendedprice FROM lineitem)
    SELECT flag, 'l_quantity' AS feature, round(quantile_cont(l_quantity, 0.3), 6) AS p30,
      round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM g GROUP BY flag
    UNION ALL SELECT flag, 'l_extendedprice', round(quantile_cont(l_extendedprice, 0.3), 6),
      round(quantile_cont(l_extendedprice, 0.9), 6) FROM g GROUP BY flag""",
)
def quantiles_by_nullable_group(spark, sf):
    """Quantiles of groups, one of which has no name, in the distributed way."""
    columns = ["l_quantity", "l_extendedprice"]
    lines = read_table(spark, sf, "lineitem", ["l_returnflag", *columns])
    frame = lines.select(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"), *columns)
    found = ordering.exact_quantiles(frame, columns, [0.3, 0.9], by="flag", scale=Scale(single_task_rows=1000))
    rows = [(g, c, *vs) for (g, c), vs in found.items()]
    return rounded(spark.createDataFrame(rows, "flag string, feature string, p30 double, p90 double"))
