"""Every operator applied to the provided tables, next to reference SQL for the same result.

`digits` names the floating-point columns of a result and the decimals both sides keep.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import humanize as humanize_column
from tallyglass.operators import clean as C
from tallyglass.operators import forecast as FC
from tallyglass.operators import insights as I
from tallyglass.operators import narratives as N
from tallyglass.operators import profile as P
from tallyglass.operators import query as Q
from tallyglass.operators import questions as QU
from tallyglass.operators import roles as R
from tallyglass.operators import semantic as M
from tallyglass.operators import series as S
from tallyglass.operators import stats as A
from tallyglass.plans.staging import new_path, stage
from tallyglass.sources import catalog as CT
from tallyglass.sources import files as FI
from workload import sql as W
from workload import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Query, sql: str | None = None, digits: dict[str, int] | None = None) -> None:
    digits = digits or {}

    def rounded(spark: SparkSession, folder: str) -> DataFrame:
        # Adding zero turns a rounded -0.0 into 0.0.
        return run(spark, folder).withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})

    assert name not in QUERIES, name
    QUERIES[name] = rounded
    if sql is not None:
        if digits:
            cells = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items())
            sql = f"SELECT * REPLACE ({cells}) FROM (\n{sql}\n)"
        ORACLES[name] = sql


def staged_sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The wanted columns of `sales`: these operators read their input several times, so the stored columns behind
    them are written once, and the rest is computed from those at each reading."""
    wanted = dict.fromkeys(columns)
    stored = dict.fromkeys(c for name in wanted for c in V.SALES_STORED[name])
    return V.computed_sales(stage(V.stored_sales(spark, folder).select(*stored), "sales"), *wanted)


def with_sales(body: str) -> str:
    return f"WITH {W.SALES}\n{body}"


def with_dirty(body: str) -> str:
    return f"WITH {W.DIRTY}\n{body}"


# --- Sources and sinks -------------------------------------------------------------------------

EVENT_COLUMNS = "event_id, ts, user_id, event_type, value, props"

add(
    "preview",
    lambda s, d: FI.preview(V.events(s, d), 100, V.EVENT_ORDER),
    f"SELECT {EVENT_COLUMNS} FROM events ORDER BY ts, event_id LIMIT 100",
)


def _read_csv(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "csv")
    FI.write_table(V.events(s, d), path)
    return FI.read_csv(s, path)


add("read_csv", _read_csv, f"SELECT {EVENT_COLUMNS} FROM events")


def _write_table(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "parquet")
    FI.write_table(V.events_dirty(s, d), path, "parquet")
    return s.read.parquet(path)


add("write_table", _write_table, with_dirty("SELECT * FROM dirty"))


def _register(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "csv")
    FI.write_table(V.table(s, d, "customer"), path)
    FI.register(s, {"registered_customer": path, "registered_nowhere": path + "-missing"})
    return Q.count_by(s.table("registered_customer"), "c_mktsegment")


add("register", _register, "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1")


def _catalog(s: SparkSession) -> CT.Catalog:
    """The sales catalog, by way of its JSON file."""
    path = new_path(s, "catalog")
    text = json.dumps(asdict(V.CATALOG))
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return CT.load_catalog(s, path)


def _save_result(s: SparkSession, d: str) -> DataFrame:
    folder = new_path(s, "results")
    question = "Total revenue by region"
    key = FI.save_result(Q.aggregate(V.sales(s, d), "revenue", "sum", "region"), folder, question, text="by region")
    dropped = FI.save_result(Q.count_by(V.events(s, d), "event_type"), folder, "Count by event type")
    FI.drop_result(s, folder, dropped)
    card = FI.saved_results(s, folder).select("key", "title")
    return FI.load_result(s, folder, key).withColumn("key", F.lit(key)).join(card, "key")


add(
    "save_result",
    _save_result,
    with_sales(
        "SELECT region, sum(revenue) AS revenue, substr(md5('Total revenue by region'), 1, 8) AS key, "
        "'Insight: Total revenue by region' AS title FROM sales GROUP BY region"
    ),
    {"revenue": 4},
)


def _schema_summary(s: SparkSession, d: str) -> DataFrame:
    out = FI.schema_summary(V.events_dirty(s, d))
    lists = ("columns", "numeric_columns", "categorical_columns")
    return out.select(
        "total_rows", "total_columns", *[F.array_join(c, ",").alias(c) for c in lists], "date_column",
        F.col("data_quality.missing_cells").alias("missing_cells"), F.col("data_quality.overall").alias("overall"),
    )


DIRTY_TEXT = ("segment", "amount_text", "pct_text", "date_text", "empty_col")
DIRTY_MISSING = "(SELECT count(*) * 8 - count(event_id) - count(ts) - count(value) - count(segment) - count(amount_text) - count(pct_text) - count(date_text) - count(empty_col) FROM dirty)"
add(
    "schema_summary",
    _schema_summary,
    with_dirty(
        f"""SELECT count(*) AS total_rows, 8 AS total_columns,
          'event_id,ts,value,segment,amount_text,pct_text,date_text,empty_col' AS columns,
          'event_id,value' AS numeric_columns, 'segment,amount_text,pct_text,date_text,empty_col' AS categorical_columns,
          'ts' AS date_column, {DIRTY_MISSING} AS missing_cells,
          (count(*) * 8 - {DIRTY_MISSING}) * 100.0 / (count(*) * 8) * 0.4
            + (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) * 100.0 / count(*) * 0.3 + 95 * 0.3 AS overall
        FROM dirty"""
    ),
    {"overall": 6},
)

# --- Cleaning ----------------------------------------------------------------------------------

add(
    "drop_empty_rows",
    lambda s, d: C.drop_empty_rows(V.events_dirty(s, d).select("value", "segment", "empty_col")),
    with_dirty("SELECT value, segment, empty_col FROM dirty WHERE value IS NOT NULL OR segment IS NOT NULL OR empty_col IS NOT NULL"),
)
add("drop_empty_columns", lambda s, d: C.drop_empty_columns(V.events_dirty(s, d)), with_dirty("SELECT * EXCLUDE (empty_col) FROM dirty"))
STRIPPED = ", ".join(f"trim(regexp_replace({c}, '[,₹%—]', '', 'g')) AS {c}" for c in DIRTY_TEXT)
add("strip_symbols", lambda s, d: C.strip_symbols(V.events_dirty(s, d)), with_dirty(f"SELECT * REPLACE ({STRIPPED}) FROM dirty"))
AS_NUMBERS = ", ".join(
    f"CAST(trim(regexp_replace({c}, '[,₹%—]', '', 'g')) AS BIGINT) AS {c}" for c in ("amount_text", "pct_text")
)
add(
    "promote_numeric",
    lambda s, d: C.promote_numeric(C.strip_symbols(V.events_dirty(s, d), ["amount_text", "pct_text", "segment"])),
    with_dirty(f"SELECT * REPLACE ({AS_NUMBERS}) FROM dirty"),
)
add(
    "promote_timestamp",
    lambda s, d: C.promote_timestamp(V.events_dirty(s, d)),
    with_dirty("SELECT * REPLACE (CAST(date_text AS TIMESTAMP) AS date_text) FROM dirty"),
)
add(
    "parse_named_dates",
    lambda s, d: C.parse_named_dates(V.events_dirty(s, d).select("event_id", "date_text", F.col("segment").alias("time_label"))),
    with_dirty("SELECT event_id, CAST(date_text AS TIMESTAMP) AS date_text, segment AS time_label FROM dirty"),
)
add(
    "clean_table",
    lambda s, d: C.clean_table(V.events_dirty(s, d)),
    with_dirty(f"SELECT * EXCLUDE (empty_col) REPLACE ({AS_NUMBERS}, CAST(date_text AS TIMESTAMP) AS date_text) FROM dirty"),
)

HOLED = ("event_id", "value", "segment")
HOLED_SQL = "SELECT event_id, {value} AS value, {segment} AS segment FROM dirty{where}"


def _impute(strategy: str) -> Query:
    return lambda s, d: C.impute(V.events_dirty(s, d).select(*HOLED), strategy)


MODE_VALUE = "(SELECT value FROM dirty WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)"
MODE_SEGMENT = "(SELECT segment FROM dirty WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)"
MEDIAN_VALUE = "(SELECT quantile_cont(value, 0.5) FROM dirty)"
for _strategy, _value, _segment, _where in (
    ("mean", "coalesce(value, (SELECT avg(value) FROM dirty))", "segment", ""),
    ("median", f"coalesce(value, {MEDIAN_VALUE})", "segment", ""),
    ("mode", f"coalesce(value, {MODE_VALUE})", f"coalesce(segment, {MODE_SEGMENT})", ""),
    ("drop", "value", "segment", " WHERE value IS NOT NULL AND segment IS NOT NULL"),
    ("zero", "coalesce(value, 0)", "segment", ""),
    (
        "auto",
        f"coalesce(value, CASE WHEN (SELECT abs(skewness(value)) FROM dirty) > 1 THEN {MEDIAN_VALUE} ELSE (SELECT avg(value) FROM dirty) END)",
        f"coalesce(segment, {MODE_SEGMENT})",
        "",
    ),
):
    add(
        f"impute_{_strategy}",
        _impute(_strategy),
        with_dirty(HOLED_SQL.format(value=_value, segment=_segment, where=_where)),
        {"value": 6},
    )
add(
    "impute_log",
    lambda s, d: C.impute_log(V.events_dirty(s, d).select(*HOLED, "empty_col"), "auto"),
    with_dirty(
        """SELECT 'value' AS "column", count(*) FILTER (value IS NULL) AS n_filled,
             CASE WHEN abs(skewness(value)) > 1 THEN 'median' ELSE 'mean' END AS method FROM dirty
           UNION ALL SELECT 'segment', count(*) FILTER (segment IS NULL), 'mode' FROM dirty
           UNION ALL SELECT 'empty_col', count(*) FILTER (empty_col IS NULL), 'constant' FROM dirty"""
    ),
)


def _fences(source: str, column: str, k: float = 1.5) -> str:
    return (
        f"(SELECT q1 - {k} * (q3 - q1) AS lower_bound, q3 + {k} * (q3 - q1) AS upper_bound FROM "
        f"(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}))"
    )


add(
    "remove_outliers_iqr",
    lambda s, d: C.remove_outliers(V.events_dirty(s, d).select("event_id", "value", "segment"), "iqr", 1.0, ["value", "event_id"]),
    with_dirty(
        f""", once AS (SELECT event_id, value, segment FROM dirty, {_fences('dirty', 'value', 1.0)}
             WHERE value BETWEEN lower_bound AND upper_bound)
            SELECT event_id, value, segment FROM once, {_fences('once', 'event_id', 1.0)}
            WHERE event_id BETWEEN lower_bound AND upper_bound"""
    ).replace("\n,", ","),
)
add(
    "remove_outliers_iqr_sales",
    lambda s, d: C.remove_outliers(
        staged_sales(s, d, "l_orderkey", "l_linenumber", "profit", "revenue"), "iqr", 0.5, ["profit", "revenue"]
    ),
    f"""WITH {W.SALES}, once AS (SELECT l_orderkey, l_linenumber, profit, revenue FROM sales, {_fences('sales', 'profit', 0.5)}
          WHERE profit BETWEEN lower_bound AND upper_bound)
        SELECT l_orderkey, l_linenumber, profit, revenue FROM once, {_fences('once', 'revenue', 0.5)}
        WHERE revenue BETWEEN lower_bound AND upper_bound""",
    {"profit": 4, "revenue": 4},
)
add(
    "remove_outliers_zscore",
    lambda s, d: C.remove_outliers(V.events_dirty(s, d).select("event_id", "value"), "zscore", 1.5, ["value"]),
    with_dirty(
        "SELECT event_id, value FROM dirty WHERE abs((value - (SELECT avg(value) FROM dirty)) / (SELECT stddev_pop(value) FROM dirty)) < 1.5"
    ),
)


def _outlier_log(s: SparkSession, d: str) -> DataFrame:
    before = V.events(s, d).select("event_id", "value")
    return C.outlier_log(before, C.remove_outliers(before, "iqr", 1.5, ["value"]), "iqr")


add(
    "outlier_log",
    _outlier_log,
    f"SELECT count(*) AS n_removed, 'iqr' AS method FROM events, {_fences('events', 'value')} WHERE NOT value BETWEEN lower_bound AND upper_bound",
)
add(
    "date_features",
    lambda s, d: C.date_features(V.sales(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "date")),
    with_sales(
        """SELECT l_orderkey, l_linenumber, l_partkey, date, year(date) AS year, month(date) AS month, monthname(date) AS month_name,
             isodow(date) - 1 AS day_of_week, dayname(date) AS day_name, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
             quarter(date) AS quarter, week(date) AS week_of_year FROM sales"""
    ),
)

# --- Column roles ------------------------------------------------------------------------------


def _detect_date(s: SparkSession, d: str) -> DataFrame:
    df = V.events_dirty(s, d).select("event_id", "segment", "amount_text", "date_text", "value")
    found = R.detect_date_column(df)
    return df.agg(F.lit(found).alias("date_column"), F.count(found).alias("n_values"), F.max(found).alias("latest"))


add(
    "detect_date_column",
    _detect_date,
    with_dirty("SELECT 'date_text' AS date_column, count(date_text) AS n_values, max(date_text) AS latest FROM dirty"),
)


def _role_rows(role: str, columns, source: str, start: int = 0) -> list[str]:
    return [f"SELECT {start + i} AS seq, '{role}' AS role, '{c}' AS \"column\", count({c}) AS n_values FROM {source}" for i, c in enumerate(columns)]


add(
    "numeric_columns",
    lambda s, d: R.role_table(V.events_dirty(s, d), R.Roles(tuple(R.numeric_columns(V.events_dirty(s, d))), (), None)),
    with_dirty(W.union(_role_rows("metric", ("event_id", "value"), "dirty"))),
)
add(
    "categorical_columns",
    lambda s, d: R.role_table(V.events_dirty(s, d), R.Roles((), tuple(R.categorical_columns(V.events_dirty(s, d))), None)),
    with_dirty(W.union(_role_rows("dimension", DIRTY_TEXT, "dirty"))),
)


def _resolve(s: SparkSession, d: str) -> DataFrame:
    df = V.sales(s, d)
    return R.role_table(df, R.resolve_schema(df, _catalog(s)))


add(
    "resolve_schema",
    _resolve,
    with_sales(
        W.union(
            _role_rows("metric", ("revenue", "profit", "discount"), "sales")
            + _role_rows("dimension", ("region", "category", "segment"), "sales", 3)
            + _role_rows("time", ("date",), "sales", 6)
        )
    ),
)

# --- Profiling and quality ---------------------------------------------------------------------

EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}
DIRTY_TYPES = {
    "event_id": "bigint", "ts": "timestamp_ntz", "value": "double", "segment": "string", "amount_text": "string",
    "pct_text": "string", "date_text": "string", "empty_col": "string",
}
SALES_TYPES = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint", "date": "timestamp_ntz",
    "sales": "double", "quantity": "double", "category": "string", "region": "string", "channel": "string",
    "segment": "string", "customer_id": "bigint", "profit_margin": "double", "discount": "double", "returns": "int",
    "satisfaction_score": "double", "profit": "double", "revenue": "double", "cost": "double",
}
NUMBERS = ("bigint", "int", "double")


def _rising(column: str, order: str, source: str) -> str:
    return (
        f"(SELECT coalesce(bool_and({column} IS NOT NULL AND (p IS NULL OR p <= {column})), TRUE) FROM "
        f"(SELECT {column}, lag({column}) OVER (ORDER BY {order}) AS p FROM {source}))"
    )


def _profile_sql(types: dict[str, str], source: str, order: str | None = None) -> str:
    parts = []
    for i, (c, kind) in enumerate(types.items()):
        number = kind in NUMBERS
        monotonic = "FALSE" if not number else ("CAST(NULL AS BOOLEAN)" if order is None else _rising(c, order, source))
        parts.append(
            f"SELECT {i} AS seq, '{c}' AS name, '{kind}' AS dtype, 1 - count({c}) / count(*) AS null_ratio, "
            f"count(DISTINCT {c}) / greatest(count(*), 1) AS unique_ratio, {number} AS is_numeric, "
            f"{kind == 'timestamp_ntz'} AS is_datetime, {f'var_samp({c})' if number else 'CAST(NULL AS DOUBLE)'} AS variance, "
            f"{monotonic} AS monotonic, count(DISTINCT {c}) AS unique_count FROM {source}"
        )
    return W.union(parts)


PROFILE_DIGITS = {"null_ratio": 8, "unique_ratio": 8, "variance": 2}
add("column_profile", lambda s, d: P.column_profile(V.events_dirty(s, d)), with_dirty(_profile_sql(DIRTY_TYPES, "dirty")), PROFILE_DIGITS)
add(
    "column_profile_ordered",
    lambda s, d: P.column_profile(V.events(s, d), order_by=V.EVENT_ORDER),
    _profile_sql(EVENT_TYPES, "events", "ts, event_id"),
    PROFILE_DIGITS,
)
add(
    "column_profile_sales",
    lambda s, d: P.column_profile(staged_sales(s, d, *V.SALES_COLUMNS)),
    with_sales(_profile_sql(SALES_TYPES, "sales")),
    {"null_ratio": 8, "unique_ratio": 8, "variance": 0},
)
add(
    "is_monotonic",
    lambda s, d: P.is_monotonic(V.events_dirty(s, d), ["event_id", "value"], ["ts", "event_id"]),
    with_dirty(
        W.union(f"SELECT '{c}' AS name, {_rising(c, 'ts, event_id', 'dirty')} AS monotonic" for c in ("event_id", "value"))
    ),
)


def _data_profile_sql(types: dict[str, str], source: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(types.items()):
        folds = ("avg({c})", "stddev_samp({c})", "CAST(min({c}) AS DOUBLE)", "CAST(max({c}) AS DOUBLE)", "skewness({c})", "kurtosis({c})")
        values = [f.format(c=c) if kind in NUMBERS else "CAST(NULL AS DOUBLE)" for f in folds]
        named = ", ".join(f'{v} AS "{n}"' for v, n in zip(values, ("mean", "std", "min", "max", "skewness", "kurtosis")))
        parts.append(
            f"SELECT {i} AS seq, '{c}' AS name, '{kind}' AS dtype, count(*) AS n_rows, {len(types)} AS n_columns, "
            f"count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*) * 100 AS null_pct, "
            f"count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) / count(*) * 100 AS unique_pct, {named} FROM {source}"
        )
    return W.union(parts)


add(
    "data_profile",
    lambda s, d: P.data_profile(V.events_dirty(s, d)),
    with_dirty(_data_profile_sql(DIRTY_TYPES, "dirty")),
    {"null_pct": 6, "unique_pct": 6, "mean": 4, "std": 4, "min": 4, "max": 4, "skewness": 6, "kurtosis": 6},
)


def _issues_sql() -> str:
    parts = []
    for i, (c, kind) in enumerate(DIRTY_TYPES.items()):
        if kind in NUMBERS:
            outside = f"(SELECT count(*) FROM dirty, {_fences('dirty', c)} WHERE {c} < lower_bound OR {c} > upper_bound)"
            parts.append(
                f"SELECT {i} AS seq, '{c}' AS name, 1 AS rule, 'skewness' AS issue_type, skewness({c}) AS value, "
                f"'High skewness in {c}' AS issue FROM dirty HAVING abs(skewness({c})) > 1"
            )
            share = f"{outside} / count(*) * 100"
            parts.append(
                f"SELECT {i}, '{c}', 2, 'outliers', {share}, {outside} || ' outliers in {c} (' || printf('%.1f', {share}) || '%)' "
                f"FROM dirty HAVING {outside} > count(*) * 0.03"
            )
        share = f"(count(*) - count({c})) / count(*) * 100"
        parts.append(
            f"SELECT {i}, '{c}', 3, 'missing', {share}, 'High missing values in {c} (' || printf('%.1f', {share}) || '%)' "
            f"FROM dirty HAVING {share} > 1"
        )
    return W.union(parts)


add("profile_issues", lambda s, d: P.profile_issues(V.events_dirty(s, d), 1.0, 0.03, 1.0), with_dirty(_issues_sql()), {"value": 6})


def _quality_sql(source: str, columns, consistency: float, band: bool = False) -> str:
    missing = f"count(*) * {len(columns)} - " + " - ".join(f"count({c})" for c in columns)
    extra = ", CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 70 THEN 'good' ELSE 'poor' END AS band" if band else ""
    return f"""SELECT *{extra} FROM (SELECT completeness * 0.4 + uniqueness * 0.3 + consistency * 0.3 AS overall, * FROM (
        SELECT (count(*) * {len(columns)} - ({missing})) / (count(*) * {len(columns)}) * 100 AS completeness,
          (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) / count(*) * 100 AS uniqueness,
          CAST({consistency} AS DOUBLE) AS consistency, {missing} AS missing_cells,
          count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_rows,
          count(*) AS total_rows, {len(columns)} AS total_columns FROM {source}))"""


QUALITY_DIGITS = {"overall": 6, "completeness": 6, "uniqueness": 6}
add(
    "quality_score",
    lambda s, d: P.quality_score(C.strip_symbols(V.events_dirty(s, d))),
    with_dirty(f", stripped AS (SELECT * REPLACE ({STRIPPED}) FROM dirty) " + _quality_sql("stripped", list(DIRTY_TYPES), 85)).replace("\n,", ","),
    QUALITY_DIGITS,
)
LINE_PARTS = ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
add(
    "quality_band",
    lambda s, d: P.quality_band(P.quality_score(V.table(s, d, "lineitem").select(*LINE_PARTS))),
    f"WITH parts AS (SELECT {', '.join(LINE_PARTS)} FROM lineitem) " + _quality_sql("parts", LINE_PARTS, 100, band=True),
    QUALITY_DIGITS,
)
add(
    "quick_stats",
    lambda s, d: P.quick_stats(V.sales(s, d)),
    with_sales(
        "SELECT count(*) AS n_rows, 19 AS n_columns, 14 AS n_numeric, 4 AS n_categories, "
        "strftime(min(date), '%Y-%m-%d') AS min_date, strftime(max(date), '%Y-%m-%d') AS max_date FROM sales"
    ),
)


def _context_sql() -> str:
    parts = []
    for i, (c, kind) in enumerate(DIRTY_TYPES.items()):
        number, date, text = kind in NUMBERS, c == "ts", kind == "string"
        none = "CAST(NULL AS DOUBLE)"
        listed = f"(SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT {c} AS c FROM dirty WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 10))"
        parts.append(
            f"SELECT {i} AS seq, '{c}' AS name, '{kind}' AS dtype, (count(*) - count({c})) / count(*) * 100 AS null_pct, "
            f'{f"CAST(min({c}) AS DOUBLE)" if number else none} AS "min", {f"CAST(max({c}) AS DOUBLE)" if number else none} AS "max", '
            f'{f"avg({c})" if number else none} AS "mean", '
            f"{f'CAST(min({c}) AS VARCHAR)' if date else 'NULL'} AS range_start, {f'CAST(max({c}) AS VARCHAR)' if date else 'NULL'} AS range_end, "
            f"{listed if text else 'NULL'} AS categories FROM dirty"
        )
    return W.union(parts)


add(
    "table_context",
    lambda s, d: P.table_context(V.events_dirty(s, d)).withColumn("categories", F.nullif(F.array_join("categories", ","), F.lit(""))),
    with_dirty(_context_sql()),
    {"null_pct": 6, "min": 4, "max": 4, "mean": 4},
)

# --- Semantic layer ----------------------------------------------------------------------------


def _classified(types: dict[str, str], source: str) -> str:
    return f"""SELECT *, CASE WHEN is_datetime OR contains(name, 'date') OR contains(name, 'time') THEN 'time'
          WHEN unique_ratio > 0.9 AND NOT is_numeric THEN 'identifier'
          WHEN contains(name, '%') OR contains(name, 'margin') OR contains(name, 'rate') THEN 'rate'
          WHEN is_numeric AND variance > 0 THEN 'measure' ELSE 'dimension' END AS role
        FROM ({_profile_sql(types, source)})"""


add(
    "classify_columns",
    lambda s, d: M.classify_columns(P.column_profile(staged_sales(s, d, *V.SALES_COLUMNS))).select("name", "role"),
    with_sales(f"SELECT name, role FROM ({_classified(SALES_TYPES, 'sales')})"),
)
add(
    "classify_columns_events",
    lambda s, d: M.classify_columns(P.column_profile(V.events_dirty(s, d))).select("name", "role"),
    with_dirty(f"SELECT name, role FROM ({_classified(DIRTY_TYPES, 'dirty')})"),
)
add(
    "discover_kpis",
    lambda s, d: M.discover_kpis(P.column_profile(staged_sales(s, d, *V.SALES_COLUMNS))).select("name", "unique_count"),
    with_sales(
        f"SELECT name, unique_count FROM ({_classified(SALES_TYPES, 'sales')}) WHERE role = 'measure' AND variance > 0 AND unique_count > 10 AND null_ratio < 0.5"
    ),
)


def _eligibility_sql(by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}n, mean, std, reason = 'Forecast eligible' AS eligible, reason FROM (
      SELECT *, CASE WHEN n < 15 THEN 'Insufficient historical data' WHEN mean = 0 THEN 'Zero mean series'
        WHEN std / nullif(mean, 0) > 2.5 THEN 'Highly volatile series' ELSE 'Forecast eligible' END AS reason
      FROM (SELECT {key}count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM events
            WHERE ts IS NOT NULL AND value IS NOT NULL {f'GROUP BY {by}' if by else ''}))"""


add("forecast_eligibility", lambda s, d: M.forecast_eligibility(V.events(s, d), "ts", "value"), _eligibility_sql(), {"mean": 6, "std": 6})
add(
    "forecast_eligibility_by_user",
    lambda s, d: M.forecast_eligibility(V.events(s, d), "ts", "value", ["user_id"]),
    _eligibility_sql("user_id"),
    {"mean": 6, "std": 6},
)


def _plain_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"Revenue": "revenue", "Profit": "profit", "Average Discount": "average_discount"})


GOVERNED = "sum(revenue) AS revenue, sum(profit) AS profit, avg(discount) AS average_discount"
GOVERNED_DIGITS = {"revenue": 4, "profit": 4, "average_discount": 8}
add(
    "governed_metrics",
    lambda s, d: _plain_names(M.governed_metrics(V.sales(s, d), _catalog(s))),
    with_sales(f"SELECT {GOVERNED} FROM sales"),
    GOVERNED_DIGITS,
)
add(
    "governed_metrics_by_grain",
    lambda s, d: _plain_names(M.governed_metrics(V.sales(s, d), V.CATALOG, ["region"], "month")),
    with_sales(f"SELECT region, CAST(date_trunc('month', date) AS TIMESTAMP) AS period, {GOVERNED} FROM sales GROUP BY 1, 2"),
    GOVERNED_DIGITS,
)
add(
    "drill_down",
    lambda s, d: _plain_names(M.drill_down(V.sales(s, d), V.CATALOG, "market")),
    with_sales(
        f"""SELECT region, segment, channel, CAST(3 - grouping(region) - grouping(segment) - grouping(channel) AS INTEGER) AS level,
        {GOVERNED} FROM sales GROUP BY ROLLUP (region, segment, channel)"""
    ),
    GOVERNED_DIGITS,
)


def _validate(s: SparkSession, d: str) -> DataFrame:
    """The sales catalog held against the raw events table, with how many rows each issue touches."""
    df = V.events(s, d)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    issues = CT.validate_catalog(df, V.CATALOG)
    return issues.withColumn("n_rows", F.lit(rows.first()[0]))


_ISSUES = [f"Metric '{n}' column '{c}' not found." for n, c in (("Revenue", "revenue"), ("Profit", "profit"), ("Average Discount", "discount"))]
_ISSUES += [f"Dimension '{c}' not found in dataset." for c in ("region", "category", "segment")] + ["Time column 'date' not found in dataset."]
add(
    "validate_catalog",
    _validate,
    W.union(f"SELECT {i} AS seq, {W.quoted(t)} AS issue, count(*) AS n_rows FROM events" for i, t in enumerate(_ISSUES)),
)

# --- Questions about a table -------------------------------------------------------------------

PICK = "l_orderkey, l_linenumber, l_partkey, region, segment, revenue"
PICKED = [c.strip() for c in PICK.split(",")]
add(
    "filter_in",
    lambda s, d: Q.filter_in(V.sales(s, d), {"region": ["ASIA", "EUROPE"], "segment": ["BUILDING"], "channel": []}).select(*PICKED),
    with_sales(f"SELECT {PICK} FROM sales WHERE region IN ('ASIA', 'EUROPE') AND segment IN ('BUILDING')"),
    {"revenue": 4},
)
add(
    "filter_eq_ci",
    lambda s, d: Q.filter_eq_ci(Q.filter_eq_ci(V.sales(s, d), "region", "aSiA"), "returns", "1").select(*PICKED),
    with_sales(f"SELECT {PICK} FROM sales WHERE lower(region) = 'asia' AND CAST(returns AS VARCHAR) = '1'"),
    {"revenue": 4},
)
add(
    "filter_cmp",
    lambda s, d: Q.filter_cmp(Q.filter_cmp(V.sales(s, d), "revenue", "greater", 50000), "quantity", "less", 10).select(*PICKED),
    with_sales(f"SELECT {PICK} FROM sales WHERE revenue > 50000 AND quantity < 10"),
    {"revenue": 4},
)
FOLDS = {
    "sum": "coalesce(sum({c}), 0)", "average": "avg({c})", "max": "max({c})", "min": "min({c})", "count": "count({c})",
    "median": "quantile_cont({c}, 0.5)",
}
_FOLD_DIGITS = {"sum": 4, "average": 6, "max": 4, "min": 4, "count": None, "median": 4}


def _value_digits(agg: str, column: str) -> dict[str, int]:
    return {} if _FOLD_DIGITS[agg] is None else {column: _FOLD_DIGITS[agg]}


for _agg, _fold in FOLDS.items():
    add(
        f"aggregate_{_agg}",
        (lambda agg: lambda s, d: Q.aggregate(
            staged_sales(s, d, "revenue") if agg == "median" else V.sales(s, d), "revenue", agg))(_agg),
        with_sales(f"SELECT {_fold.format(c='revenue')} AS revenue FROM sales"),
        _value_digits(_agg, "revenue"),
    )
    add(
        f"aggregate_{_agg}_by",
        (lambda agg: lambda s, d: Q.aggregate(V.events_dirty(s, d), "value", agg, "segment"))(_agg),
        with_dirty(f"SELECT segment, {_fold.format(c='value')} AS value FROM dirty WHERE segment IS NOT NULL GROUP BY segment"),
        _value_digits(_agg, "value"),
    )
add(
    "aggregate_median_by_customer",
    lambda s, d: Q.aggregate(staged_sales(s, d, "customer_id", "revenue"), "revenue", "median", "customer_id"),
    with_sales("SELECT customer_id, quantile_cont(revenue, 0.5) AS revenue FROM sales GROUP BY customer_id"),
    {"revenue": 5},
)
add(
    "aggregate_filtered",
    lambda s, d: Q.aggregate(V.sales(s, d), "profit", "average", ["category", "channel"], {"region": "asia"}),
    with_sales("SELECT category, channel, avg(profit) AS profit FROM sales WHERE lower(region) = 'asia' GROUP BY 1, 2"),
    {"profit": 6},
)
add(
    "aggregate_ordered",
    lambda s, d: Q.aggregate(V.sales(s, d), "revenue", "sum", "category", order="desc"),
    with_sales("SELECT category, sum(revenue) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1"),
    {"revenue": 4},
)
add(
    "top_n",
    lambda s, d: Q.aggregate(V.sales(s, d), "revenue", "sum", "customer_id", order="desc", limit=5),
    with_sales("SELECT customer_id, sum(revenue) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    {"revenue": 4},
)
add(
    "bottom_n",
    lambda s, d: Q.aggregate(V.sales(s, d), "revenue", "sum", "customer_id", order="asc", limit=5),
    with_sales("SELECT customer_id, sum(revenue) AS revenue FROM sales GROUP BY 1 ORDER BY 2, 1 LIMIT 5"),
    {"revenue": 4},
)
add(
    "count_by",
    lambda s, d: Q.count_by(V.events_dirty(s, d), "segment"),
    with_dirty("SELECT segment, count(*) AS count FROM dirty WHERE segment IS NOT NULL GROUP BY 1"),
)
add("row_count", lambda s, d: Q.row_count(V.sales(s, d)), with_sales("SELECT count(*) AS n_rows FROM sales"))
add(
    "leader_laggard",
    lambda s, d: Q.leader_laggard(V.sales(s, d), "revenue", "sum", "customer_id"),
    with_sales(
        """, g AS (SELECT customer_id AS k, sum(revenue) AS v FROM sales GROUP BY 1)
        SELECT b.k AS leader, b.v AS leader_value, w.k AS laggard, w.v AS laggard_value
        FROM (SELECT * FROM g ORDER BY v DESC, k LIMIT 1) b, (SELECT * FROM g ORDER BY v, k LIMIT 1) w"""
    ).replace("\n,", ","),
    {"leader_value": 4, "laggard_value": 4},
)
add(
    "category_breakdown",
    lambda s, d: Q.category_breakdown(V.sales(s, d), "category", "sales"),
    with_sales("SELECT category, sum(sales) AS sales FROM sales GROUP BY 1"),
    {"sales": 3},
)
add(
    "category_breakdown_share",
    lambda s, d: Q.category_breakdown(staged_sales(s, d, "category", "sales"), "category", "sales", share=True),
    with_sales("SELECT category, sum(sales) AS sales, sum(sales) / (SELECT sum(sales) FROM sales) AS share FROM sales GROUP BY 1"),
    {"sales": 3, "share": 9},
)
TAGS = "intent, aggregation, metric, metric2, groupby, filter_column, where_value AS filter_value, row_limit, sort_order"
add(
    "tag_questions",
    lambda s, d: QU.tag_questions(V.question_log(s, d), V.SALES_COLUMNS),
    f"WITH {W.QUESTIONS}, {W.tag_questions('questions', 'id', V.SALES_COLUMNS)} SELECT id, text, {TAGS} FROM answered".replace(
        "groupby, filter_column, where_value AS filter_value",
        "groupby, filter_column, CASE WHEN filter_column IS NOT NULL THEN where_value END AS filter_value",
    ),
)
TALK_COLUMNS = ["quantity", "date", "region", "profit"]
add(
    "tag_conversations",
    lambda s, d: QU.tag_questions(V.table(s, d, "conversations").select("conv_id", "turn", "text"), TALK_COLUMNS),
    f"WITH {W.tag_questions('conversations', 'conv_id, turn', TALK_COLUMNS)} SELECT conv_id, turn, text, {TAGS} FROM answered".replace(
        "groupby, filter_column, where_value AS filter_value",
        "groupby, filter_column, CASE WHEN filter_column IS NOT NULL THEN where_value END AS filter_value",
    ),
)


# Questions with comparisons over the orders: (Spark, SQL) differ only in who joins the pieces.
COMPARED = (
    ("Total revenue where quantity > ", " by region"),
    ("Show sales with profit greater than ", ".5 and cost under 900"),
    ("Average price for quantity <= ", " per segment"),
    ("List regions where revenue is above ", " or profit below 3"),
    ("How many orders have cost over ", "?"),
    ("Rows where segment is building and weather > ", ""),
)


def _compared(s: SparkSession, d: str) -> DataFrame:
    at = (F.col("o_orderkey") % len(COMPARED)).cast("int")
    before, after = (F.get(F.array(*[F.lit(x[k]) for x in COMPARED]), at) for k in (0, 1))
    asked = V.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(before, (F.col("o_orderkey") % 97).cast("string"), after).alias("text"))
    return QU.question_filters(asked, V.SALES_COLUMNS)


_COMPARED_SQL = "asked AS (SELECT o_orderkey AS id, CASE o_orderkey % {n} {cases} END AS text FROM orders)".format(
    n=len(COMPARED),
    cases=" ".join(f"WHEN {k} THEN {W.quoted(a)} || CAST(o_orderkey % 97 AS VARCHAR) || {W.quoted(b)}" for k, (a, b) in enumerate(COMPARED)),
)
add(
    "question_filters",
    _compared,
    f"WITH {_COMPARED_SQL}, {W.question_filters('asked', 'id', V.SALES_COLUMNS)} SELECT * FROM answered",
)

def _match_columns(s: SparkSession, d: str) -> DataFrame:
    words = V.question_log(s, d).select(F.explode(F.split("text", " ")).alias("term")).filter(F.col("term") != "")
    return QU.match_columns(words.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", V.SALES_COLUMNS)


add(
    "match_columns",
    _match_columns,
    f"""WITH {W.QUESTIONS}, words AS (SELECT unnest(string_split(text, ' ')) AS term FROM questions)
        SELECT term, count(*) AS n, {W.find_column('term', V.SALES_COLUMNS)} AS matched FROM words WHERE term <> '' GROUP BY term""",
)
add(
    "humanize",
    lambda s, d: V.events_dirty(s, d).select(
        "event_id", humanize_column(F.col("value")).alias("plain"), humanize_column(F.pow(F.col("value"), F.lit(5))).alias("large")
    ),
    with_dirty(
        "SELECT event_id, "
        + ", ".join(
            f"""CASE WHEN {v} IS NULL THEN 'N/A' WHEN abs({v}) >= 1e9 THEN printf('%.2fB', {v} / 1e9)
            WHEN abs({v}) >= 1e6 THEN printf('%.2fM', {v} / 1e6) WHEN abs({v}) >= 1e3 THEN printf('%.2fK', {v} / 1e3)
            ELSE format('{{:,.2f}}', {v}) END AS {n}"""
            for v, n in (("value", "plain"), ("pow(value, 5)", "large"))
        )
        + " FROM dirty"
    ),
)

# --- Series and comparisons by position --------------------------------------------------------

EVENT_SERIES = "points AS (SELECT ds, sum(value) AS y FROM (SELECT CAST(ts AS DATE) AS ds, value FROM events) GROUP BY ds)"
SHIP_SERIES = "points AS (SELECT date AS ds, sum(quantity) AS y FROM sales GROUP BY date)"


def daily_events(s: SparkSession, d: str) -> DataFrame:
    return V.events(s, d).withColumn("day", F.to_date("ts"))


add(
    "series_sum",
    lambda s, d: S.series(V.sales(s, d), "date", "revenue"),
    with_sales("SELECT date AS ds, sum(revenue) AS y FROM sales GROUP BY date"),
    {"y": 4},
)
add(
    "series_mean",
    lambda s, d: S.series(V.sales(s, d), "date", "quantity", "mean"),
    with_sales("SELECT date AS ds, avg(quantity) AS y FROM sales GROUP BY date"),
    {"y": 9},
)
add(
    "moving_average",
    lambda s, d: S.moving_average(S.series(daily_events(s, d), "day", "value", ordered=False)),
    f"WITH {EVENT_SERIES} SELECT ds, y, avg(y) OVER (ORDER BY ds ROWS 6 PRECEDING) AS ma FROM points",
    {"y": 3, "ma": 6},
)
add(
    "moving_average_adaptive",
    lambda s, d: S.moving_average(S.series(V.table(s, d, "lineitem"), "l_shipdate", "l_quantity", ordered=False), "adaptive"),
    """WITH points AS (SELECT l_shipdate AS ds, sum(l_quantity) AS y FROM lineitem GROUP BY 1)
    SELECT ds, y, avg(y) OVER (ORDER BY ds ROWS 6 PRECEDING) AS ma FROM points""",
    {"y": 3, "ma": 6},
)
add(
    "growth_first_last",
    lambda s, d: S.growth_first_last(S.series(daily_events(s, d), "day", "value", ordered=False)),
    f"""WITH {EVENT_SERIES}, ends AS (
      SELECT (SELECT avg(y) FROM (SELECT y FROM points ORDER BY ds LIMIT 7)) AS first_mean,
             (SELECT avg(y) FROM (SELECT y FROM points ORDER BY ds DESC LIMIT 7)) AS last_mean),
    grown AS (SELECT *, CASE WHEN first_mean <> 0 THEN (last_mean - first_mean) / first_mean * 100 ELSE 0 END AS growth_pct FROM ends)
    SELECT first_mean, last_mean, growth_pct, CASE WHEN growth_pct > 0 THEN 'increase' ELSE 'decrease' END AS direction,
      abs(growth_pct) > 20 AS significant FROM grown""",
    {"first_mean": 6, "last_mean": 6, "growth_pct": 6},
)

TREND_METRICS = ["sales", "quantity", "profit", "revenue"]
INSIGHT_DIGITS = {"value": 5}


def _trend_sql(metrics=TREND_METRICS, extra: str = "") -> str:
    parts = []
    for i, m in enumerate(metrics):
        parts.append(
            f"SELECT {i} AS seq, '{m}' AS metric, avg({m}) FILTER (pos <= CAST(floor(n * 0.2) AS BIGINT)) AS earlier, "
            f"avg({m}) FILTER (pos > n - CAST(floor(n * 0.2) AS BIGINT)) AS recent FROM placed"
        )
    return f"""trends AS (SELECT seq, 'trend' AS type,
        {W.names_case('metric', metrics)} || CASE WHEN value > 0 THEN ' Increased by ' ELSE ' Decreased by ' END || printf('%.1f', abs(value)) || '%' AS title,
        'Comparing recent 20% of data vs earliest 20%' AS description,
        CASE WHEN abs(value) > 20 THEN 'high' ELSE 'medium' END AS priority, metric, value, earlier, recent
      FROM (SELECT *, CASE WHEN earlier > 0 THEN (recent - earlier) / earlier * 100 END AS value FROM ({W.union(parts)}))
      WHERE abs(value) > 0)"""


def _momentum_sql(metrics=TREND_METRICS) -> str:
    parts = []
    for i, m in enumerate(metrics):
        parts.append(
            f"SELECT {i} AS seq, '{m}' AS metric, avg({m}) FILTER (pos > n - 7) AS recent, "
            f"avg({m}) FILTER (pos <= n - 7 AND pos > n - 14) AS earlier, max(n) AS n FROM placed"
        )
    return f"""momentum AS (SELECT seq, 'trend_weekly' AS type,
        'Week-over-Week: ' || {W.names_case('metric', metrics)} || CASE WHEN value > 0 THEN ' Up ' ELSE ' Down ' END || printf('%.1f', abs(value)) || '%' AS title,
        'Comparing last 7 days vs previous 7 days' AS description, 'medium' AS priority, metric, value, earlier, recent
      FROM (SELECT *, CASE WHEN earlier > 0 AND n >= 14 THEN (recent - earlier) / earlier * 100 END AS value FROM ({W.union(parts)}))
      WHERE abs(value) > 0)"""


def ordered_sales(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return staged_sales(s, d, *V.SALES_ORDER, *columns)


add(
    "trend_insight",
    lambda s, d: S.trend_insight(ordered_sales(s, d, *TREND_METRICS), TREND_METRICS, V.SALES_ORDER, min_abs=0.0),
    f"WITH {W.SALES}, {W.PLACED}, {_trend_sql()} SELECT * FROM trends",
    {"value": 6, "earlier": 6, "recent": 6},
)
add(
    "momentum_insight",
    lambda s, d: S.momentum_insight(ordered_sales(s, d, *TREND_METRICS), TREND_METRICS, V.SALES_ORDER, min_abs=0.0),
    f"WITH {W.SALES}, {W.PLACED}, {_momentum_sql()} SELECT * FROM momentum",
    {"value": 6, "earlier": 6, "recent": 6},
)
add(
    "momentum_insight_days",
    lambda s, d: S.momentum_insight(V.events(s, d), ["value"], V.EVENT_ORDER, min_abs=0.0, unit="days").select("metric", "value", "earlier", "recent"),
    """WITH aged AS (SELECT value, (SELECT max(CAST(ts AS DATE)) FROM events) - CAST(ts AS DATE) AS age FROM events),
    m AS (SELECT avg(value) FILTER (age < 7) AS recent, avg(value) FILTER (age >= 7 AND age < 14) AS earlier FROM aged)
    SELECT 'value' AS metric, (recent - earlier) / earlier * 100 AS value, earlier, recent FROM m""",
    {"value": 5, "earlier": 4, "recent": 4},
)


def _kpi_sql(mode: str, chosen) -> str:
    parts = []
    for i, (column, label, fold) in enumerate(chosen):
        now = f"{fold}({column})" if mode == "whole" else f"{fold}({column}) FILTER (pos > n // 2)"
        head = f"{fold}({column}) FILTER (pos <= n // 2)"
        parts.append(
            f"SELECT {i} AS seq, '{column}' AS metric, '{label}' AS label, {fold}({column}) AS value, "
            f"CASE WHEN {head} = 0 THEN 0 ELSE ({now} - {head}) / abs({head}) * 100 END AS delta FROM placed"
        )
    return f"WITH {W.SALES}, {W.PLACED} {W.union(parts)}"


add(
    "overview_kpis",
    lambda s, d: S.overview_kpis(ordered_sales(s, d, "sales", "revenue", "profit", "quantity"), V.SALES_ORDER, n=4),
    _kpi_sql("whole", [(c, W.title(c), "sum") for c in ("sales", "revenue", "profit", "quantity")]),
    {"value": 4, "delta": 7},
)
add(
    "overview_kpis_halves",
    lambda s, d: S.overview_kpis(ordered_sales(s, d, "revenue", "profit", "discount"), V.SALES_ORDER, V.CATALOG, n=4, mode="halves"),
    _kpi_sql("halves", [("revenue", "Revenue", "sum"), ("profit", "Profit", "sum"), ("discount", "Average Discount", "avg")]),
    {"value": 4, "delta": 7},
)


def _moves_sql(metrics, categories) -> str:
    """Largest rise and fall of a member's mean between the halves, per metric and category."""
    parts = []
    for m in metrics:
        for i, c in enumerate(categories):
            parts.append(
                f"SELECT '{m}' AS metric, {i} AS category_seq, '{c}' AS category, member, (b - a) / nullif(a, 0) * 100 AS change_pct FROM "
                f"(SELECT {c} AS member, avg({m}) FILTER (pos <= n // 2) AS a, avg({m}) FILTER (pos > n // 2) AS b FROM placed "
                f"WHERE {c} IS NOT NULL GROUP BY {c})"
            )
    return f"""changes AS (SELECT * FROM ({W.union(parts)}) WHERE change_pct IS NOT NULL),
    moves AS (SELECT *, row_number() OVER (PARTITION BY metric, category ORDER BY change_pct DESC, member) AS up_rank,
                     row_number() OVER (PARTITION BY metric, category ORDER BY change_pct, member) AS down_rank FROM changes)"""


DRIVER = "CASE WHEN change_pct > 0 THEN 'strong performance' ELSE 'underperformance' END || ' in ' || category || ' ''' || member || ''''"
for _name, _direction, _rank in (("change_drivers", 1, "up_rank"), ("change_drivers_down", -1, "down_rank")):
    add(
        _name,
        (lambda direction: lambda s, d: S.change_drivers(
            ordered_sales(s, d, "quantity", "category", "region"), "quantity", ["category", "region"], V.SALES_ORDER, direction, min_abs=0.0
        ))(_direction),
        f"""WITH {W.SALES}, {W.PLACED}, {_moves_sql(['quantity'], ['category', 'region'])}
        SELECT category_seq, category, member, change_pct, {DRIVER} AS driver FROM moves WHERE {_rank} = 1 AND abs(change_pct) > 0""",
        {"change_pct": 5},
    )


def _season_sql(metrics, source: str, date: str, cast: str = "") -> str:
    parts = []
    for i, m in enumerate(metrics):
        parts.append(
            f"SELECT {i} AS seq, '{m}' AS metric, corr(b, y) AS value, count(*) AS n_points FROM (SELECT y, lag(y, 7) OVER (ORDER BY ds) AS b FROM "
            f"(SELECT {date} AS ds, coalesce(sum({m}), 0) AS y FROM {source} WHERE {date} IS NOT NULL GROUP BY 1))"
        )
    return f"""seasons AS (SELECT seq, 'seasonality' AS type, 'Weekly Seasonality in ' || {W.names_case('metric', metrics)} AS title,
      'Autocorrelation at lag 7: ' || printf('%.3f', value) AS description, 'medium' AS priority, metric, value, n_points
      FROM ({W.union(parts)}) WHERE n_points >= 30 AND abs(value) > 0)"""


add(
    "seasonality_insight",
    lambda s, d: S.seasonality_insight(staged_sales(s, d, "date", "quantity", "returns"), "date", ["quantity", "returns"], min_abs=0.0),
    f"WITH {W.SALES}, {_season_sql(['quantity', 'returns'], 'sales', 'date')} SELECT * FROM seasons",
    {"value": 6},
)
add(
    "seasonality_insight_events",
    lambda s, d: S.seasonality_insight(daily_events(s, d), "day", ["value"], min_abs=0.0),
    f"WITH {_season_sql(['value'], 'events', 'CAST(ts AS DATE)')} SELECT * FROM seasons",
    {"value": 6},
)
