"""Profiles of the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profiling
from plumbline.plans.registry import query
from plumbline.sources.tables import read_tables

AS_OF = "2002-01-01 00:00:00"

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
CUSTOMER = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}
DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
EVENTS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
    "props": "string",
}
#: Columns whose category follows from name and type alone; for the others it depends on the data.
CATEGORY = {
    "l_extendedprice": "amount", "l_linestatus": "status", "l_shipdate": "date",
    "doc_id": "id", "event_id": "id", "ts": "date", "user_id": "id", "event_type": "status", "value": "amount",
}


def _category_sql(c: str, numeric: bool) -> str:
    if c in CATEGORY:
        return f"'{CATEGORY[c]}'"
    if numeric:
        return f"CASE WHEN count(DISTINCT {c}) <= 15 THEN 'categorical' ELSE 'measure' END"
    return (
        f"CASE WHEN round(count(DISTINCT {c}) * 100.0 / nullif(count({c}), 0), 2) >= 98 THEN 'id' "
        f"WHEN count(DISTINCT {c}) <= 30 THEN 'categorical' ELSE 'text' END"
    )


def profile_sql(table: str, columns: dict[str, str]) -> str:
    """One SELECT per column."""
    parts = []
    for i, (c, kind) in enumerate(columns.items(), 1):
        numeric, text = kind in ("bigint", "int", "double"), kind == "string"
        category = _category_sql(c, numeric)
        parts.append(
            f"""SELECT '{table}' AS "table", '{c}' AS "column", {i} AS ordinal, '{kind}' AS data_type,
            {category} AS category, count(*) AS total, count({c}) AS non_null, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct,
            count(DISTINCT {c}) AS distinct_count,
            round(count(DISTINCT {c}) * 100.0 / nullif(count({c}), 0), 2) AS distinct_pct,
            CAST((SELECT count(*) FROM (SELECT {c} FROM {table} WHERE {c} IS NOT NULL
                  GROUP BY {c} HAVING count(*) > 1)) AS BIGINT) AS duplicate_values,
            {f"CAST(min({c}) AS VARCHAR)" if not numeric else "CAST(NULL AS VARCHAR)"} AS min_value,
            {f"CAST(max({c}) AS VARCHAR)" if not numeric else "CAST(NULL AS VARCHAR)"} AS max_value,
            {f"CAST(min({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"} AS min_number,
            {f"CAST(max({c}) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"} AS max_number,
            {f"round(avg({c}), 4)" if numeric else "CAST(NULL AS DOUBLE)"} AS avg_value,
            {f"round(stddev_samp({c}), 4)" if numeric else "CAST(NULL AS DOUBLE)"} AS stddev,
            {f"round(avg(length({c})), 4)" if text else "CAST(NULL AS DOUBLE)"} AS avg_length,
            {f"max(length({c}))" if text else "CAST(NULL AS BIGINT)"} AS max_length,
            {f"round(epoch(TIMESTAMP '{AS_OF}' - max({c})) / 86400.0, 1)" if kind == "timestamp_ntz"
             else "CAST(NULL AS DOUBLE)"} AS freshness_days,
            {f"coalesce(stddev_samp({c}) > 0 AND abs(max({c}) - avg({c})) > 4 * stddev_samp({c}), false)"
             if numeric else "false"} AS outlier_hint
            FROM {table}"""
        )
    return " UNION ALL ".join(parts)


def checked(profile: DataFrame) -> DataFrame:
    """Profile columns in the form the SQL gives them: numbers as numbers, rounded."""
    numeric = F.col("min_number").isNotNull()
    return profile.select(
        "table", "column", "ordinal", "data_type", "category", "total", "non_null", "null_count", "null_pct",
        "distinct_count", "distinct_pct", "duplicate_values",
        F.when(~numeric, F.col("min_value")).alias("min_value"),
        F.when(~numeric, F.col("max_value")).alias("max_value"),
        "min_number", "max_number",
        F.round("avg_value", 4).alias("avg_value"), F.round("stddev", 4).alias("stddev"),
        F.round("avg_length", 4).alias("avg_length"), "max_length", "freshness_days", "outlier_hint",
    )


def profile_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return profiling.profile_columns(read_tables(spark, sf_dir, [table])[table], table, AS_OF)


@query("profile_lineitem", profile_sql("lineitem", LINEITEM))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(profile_of(spark, sf_dir, "lineitem"))


@query("profile_customer", profile_sql("customer", CUSTOMER))
def profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(profile_of(spark, sf_dir, "customer"))


@query("profile_documents", profile_sql("documents", DOCUMENTS))
def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(profile_of(spark, sf_dir, "documents"))


@query("profile_events", profile_sql("events", EVENTS))
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(profile_of(spark, sf_dir, "events"))


def _frequencies_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table}
            WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in columns
    )


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
_LETTERS = ["l_returnflag", "l_linestatus"]


def _few_values_sql(most: int, direction: str) -> str:
    """Extreme values of the columns with at most ``most`` distinct values."""
    return f"""WITH f AS ({_frequencies_sql("lineitem", _NUMBERS + _LETTERS)}),
        small AS (SELECT "column" FROM f GROUP BY 1 HAVING count(*) <= {most})
        SELECT "column", value, n, CAST(rank AS INTEGER) AS rank FROM (
          SELECT f.*, row_number() OVER (PARTITION BY "column" ORDER BY n {direction}, value) AS rank
          FROM f JOIN small USING ("column")) WHERE rank <= 5"""


@query("top_values_lineitem", _few_values_sql(15, "DESC"))
def top_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_tables(spark, sf_dir, ["lineitem"])["lineitem"]
    return profiling.top_values(lineitem, profile_of(spark, sf_dir, "lineitem"))


@query("bottom_values_lineitem", _few_values_sql(200, "ASC"))
def bottom_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_tables(spark, sf_dir, ["lineitem"])["lineitem"]
    return profiling.tail_values(lineitem, profile_of(spark, sf_dir, "lineitem"))


@query(
    "duplicate_value_counts",
    """SELECT 'l_orderkey' AS "column", count(*) AS distinct_count,
              count(*) FILTER (WHERE n > 1) AS duplicate_values,
              CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_rows
       FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1)
       UNION ALL
       SELECT 'l_partkey', count(*), count(*) FILTER (WHERE n > 1),
              CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT)
       FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1)""",
)
def duplicate_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_tables(spark, sf_dir, ["lineitem"])["lineitem"]
    return profiling.distinct_statistics(lineitem, ["l_orderkey", "l_partkey"])


@query(
    "value_sample",
    "SELECT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY o_orderkey LIMIT 200",
)
def value_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    return profiling.value_sample(orders, "o_orderpriority", 200, ["o_orderkey"])


@query(
    "null_summary",
    """SELECT 'quality' AS "column", count(*) AS total, count(quality) AS non_null,
              round((count(*) - count(quality)) * 100.0 / count(*), 1) AS null_pct
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def null_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_tables(spark, sf_dir, ["documents", "labels"])
    return profiling.null_summary(t["documents"].join(t["labels"], "doc_id", "left"), "quality")


@query(
    "filtered_row_sample",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_totalprice > 100000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20""",
)
def filtered_row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    return profiling.row_sample(
        orders, ["o_orderkey", "o_custkey", "o_totalprice"], "o_totalprice > 100000 AND o_orderstatus = 'F'",
        order_by=["o_orderkey"],
    )


_CONTACT = r"regexp_extract(text, '([A-Za-z0-9._%+-]+@[^[:space:]]+)', 1)"


@query(
    "pattern_match_share",
    f"""WITH c AS (SELECT nullif({_CONTACT}, '') AS contact_email FROM documents)
        SELECT 'contact_email' AS "column", 'email' AS category, count(contact_email) AS non_null,
               round(avg(CASE WHEN regexp_matches(trim(contact_email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
                              THEN 1.0 ELSE 0.0 END) FILTER (WHERE contact_email IS NOT NULL) * 100, 1)
                 AS pattern_match_pct
        FROM c""",
)
def pattern_match_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_tables(spark, sf_dir, ["documents"])["documents"]
    address = F.regexp_extract("text", r"([A-Za-z0-9._%+-]+@[^ \t\n\r\f\x0B]+)", 1)
    contacts = documents.select(F.nullif(address, F.lit("")).alias("contact_email"))
    return profiling.profile_columns(contacts, "contacts").select(
        "column", "category", "non_null", "pattern_match_pct"
    )


@query(
    "column_categories",
    " UNION ALL ".join(
        f"""SELECT "table", "column", category FROM ({profile_sql(t, c)})"""
        for t, c in (("lineitem", LINEITEM), ("customer", CUSTOMER), ("documents", DOCUMENTS), ("events", EVENTS))
    ),
)
def column_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [profile_of(spark, sf_dir, t) for t in ("lineitem", "customer", "documents", "events")]
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.select("table", "column", "category")


_SIGNALS = """
    SELECT "table", "column", category, unnest(list_filter([
        CASE WHEN null_pct >= 30 THEN 'high_null_rate' END,
        CASE WHEN outlier_hint THEN 'numeric_outlier' END,
        CASE WHEN category = 'id' AND duplicate_values > 0 THEN 'duplicate_key' END,
        CASE WHEN freshness_days > 7 THEN 'stale_data' END], lambda x: x IS NOT NULL)) AS signal
    FROM ({profile})"""


@query(
    "anomaly_signals",
    _SIGNALS.format(profile=profile_sql("events", EVENTS) + " UNION ALL " + profile_sql("lineitem", LINEITEM)),
)
def anomaly_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = profile_of(spark, sf_dir, "events").unionByName(profile_of(spark, sf_dir, "lineitem"))
    return profiling.anomaly_signals(both)


@query(
    "key_candidates",
    """SELECT 'event_log' AS "table", 'EVENT_KEY' AS "column", count(*) AS total, count(event_id) AS non_null,
              count(DISTINCT event_id) AS distinct_count, count(DISTINCT event_id) >= count(event_id) AS is_unique,
              greatest(count(event_id) - count(DISTINCT event_id), 0) AS duplicate_rows FROM events
       UNION ALL
       SELECT 'event_log', 'USER_KEY', count(*), count(user_id), count(DISTINCT user_id),
              count(DISTINCT user_id) >= count(user_id), greatest(count(user_id) - count(DISTINCT user_id), 0)
       FROM events""",
)
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_tables(spark, sf_dir, ["events"])["events"]
    named = events.select(
        F.col("event_id").alias("EVENT_KEY"), F.col("user_id").alias("USER_KEY"), F.col("value").alias("AMOUNT")
    )
    return profiling.key_candidates(profiling.profile_columns(named, "event_log"))


_SET_COLUMNS = ["o_orderstatus", "o_orderpriority"]


@query(
    "closed_sets",
    f"""SELECT "column", count(*) AS distinct_count, string_agg(value, ', ' ORDER BY value) AS "values"
        FROM ({_frequencies_sql("orders", _SET_COLUMNS)}) GROUP BY 1""",
)
def closed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    sets = profiling.closed_sets(orders, profile_of(spark, sf_dir, "orders"))
    return sets.withColumn("values", F.array_join("values", ", "))


@query(
    "freshness_signals",
    f"""SELECT 'freshness:o_orderdate' AS signal_id, 'orders' AS "table", 'o_orderdate' AS "column",
               'timestamp_ntz' AS data_type, max(o_orderdate) AS newest,
               round(epoch(TIMESTAMP '{AS_OF}' - max(o_orderdate)) / 86400.0, 1) AS freshness_days
        FROM orders""",
)
def freshness_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.freshness_signals(profile_of(spark, sf_dir, "orders"))


@query(
    "table_summary",
    f"""WITH p AS ({profile_sql("lineitem", LINEITEM)} UNION ALL {profile_sql("customer", CUSTOMER)})
        SELECT "table", max(total) AS row_count, count(*) AS column_count,
               array_to_string(list_filter(['id', 'date', 'amount', 'measure', 'status', 'categorical', 'email',
                                            'phone', 'text'], lambda c: list_contains(list(category), c)), ', ')
                 AS categories
        FROM p GROUP BY 1""",
)
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = profile_of(spark, sf_dir, "lineitem").unionByName(profile_of(spark, sf_dir, "customer"))
    return profiling.table_summary(both).withColumn("categories", F.array_join("categories", ", "))


@query(
    "grounded_values",
    """WITH s AS (SELECT list(DISTINCT o_orderstatus) AS v FROM orders)
       SELECT 'o_orderstatus' AS "column", array_to_string(list_filter(['F', 'O', 'X'], lambda x: list_contains(v, x)), ', ')
                AS "values", array_to_string(list_filter(['F', 'O', 'X'], lambda x: NOT list_contains(v, x)), ', ') AS dropped
       FROM s
       UNION ALL SELECT 'o_comment', 'a', ''""",
)
def grounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_tables(spark, sf_dir, ["orders"])["orders"]
    sets = profiling.closed_sets(orders, profile_of(spark, sf_dir, "orders"))
    proposed = spark.createDataFrame(
        [("o_orderstatus", ["F", "O", "X"]), ("o_comment", ["a"])], "column string, values array<string>"
    )
    return profiling.grounded_values(proposed, sets).select(
        "column", F.array_join("values", ", ").alias("values"), F.array_join("dropped", ", ").alias("dropped")
    )
