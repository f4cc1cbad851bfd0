"""Queries over inputs that are easily got wrong: many columns, text dates, constants, quoted line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import humanize
from tallyglass.operators import clean as C
from tallyglass.operators import forecast as FC
from tallyglass.operators import insights as I
from tallyglass.operators import profile as P
from tallyglass.operators import query as Q
from tallyglass.operators import roles as R
from tallyglass.operators import series as S
from tallyglass.operators import stats as A
from tallyglass.plans.staging import new_path
from tallyglass.sources import catalog as CT
from tallyglass.sources import files as FI
from workload import sql as W
from workload import views as V
from workload.queries import add

# Six numeric columns; the last ones carry the trend.
WIDE = """wide AS (SELECT ts, event_id, event_type, user_id, value, value * 2 + 1 AS double_value, 500 - value AS mirrored,
  CAST(event_id AS DOUBLE) AS late_one, CAST(event_id AS DOUBLE) * event_id AS late_two FROM events)"""
WIDE_NUMBERS = ("event_id", "user_id", "value", "double_value", "mirrored", "late_one", "late_two")


def wide(s: SparkSession, d: str) -> DataFrame:
    number = F.col("event_id").cast("double")
    return V.events(s, d).select(
        "ts", "event_id", "event_type", "user_id", "value", (F.col("value") * 2 + 1).alias("double_value"),
        (500 - F.col("value")).alias("mirrored"), number.alias("late_one"), (number * F.col("event_id")).alias("late_two"),
    )


def _trend_sql(names, min_abs: float) -> str:
    ends = W.union(
        f"SELECT '{m}' AS metric, avg({m}) FILTER (pos <= floor(n * 0.2)) AS earlier, avg({m}) FILTER (pos > n - floor(n * 0.2)) AS recent FROM placed"
        for m in names
    )
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM wide),
      ends AS ({ends}), trends AS (SELECT metric, (recent - earlier) / earlier * 100 AS value FROM ends WHERE earlier > 0
      AND abs((recent - earlier) / earlier * 100) > {min_abs})"""


add(
    "trend_insight_all_columns",
    lambda s, d: S.trend_insight(wide(s, d), None, V.EVENT_ORDER, min_abs=0.0).select("metric", "value"),
    f"WITH {WIDE}, {_trend_sql(WIDE_NUMBERS, 0)} SELECT * FROM trends",
    {"value": 5},
)
add(
    "all_insights_all_columns",
    lambda s, d: I.all_insights(wide(s, d), V.EVENT_ORDER, thresholds={"trend": 0.0}).filter("type = 'trend'").select("metric", "value"),
    f"WITH {WIDE}, {_trend_sql(WIDE_NUMBERS, 0)} SELECT * FROM trends",
    {"value": 5},
)


def _against_rest_sql(metrics) -> str:
    parts = W.union(
        f"""SELECT '{m}' AS measure, e.event_type AS group2, count(*) FILTER (w.event_type = e.event_type) AS n2,
        avg({m}) FILTER (w.event_type = e.event_type) AS mean2, avg({m}) FILTER (w.event_type <> e.event_type) AS mean1,
        var_samp({m}) FILTER (w.event_type = e.event_type) AS v2, var_samp({m}) FILTER (w.event_type <> e.event_type) AS v1,
        count(*) FILTER (w.event_type <> e.event_type) AS n1
        FROM wide w, (SELECT DISTINCT event_type FROM wide) e GROUP BY 1, 2"""
        for m in metrics
    )
    return f"""sides AS ({parts}) SELECT measure, group2, n1, n2,
      (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM sides"""


add(
    "ttest_against_rest",
    lambda s, d: A.ttest_against_rest(wide(s, d), "event_type", ["value", "mirrored"]).select("measure", "group2", "n1", "n2", "t"),
    f"WITH {WIDE}, {_against_rest_sql(['value', 'mirrored'])}",
    {"t": 5},
)
add(
    "correlation_matrix_constant",
    lambda s, d: A.correlation_matrix(
        V.events(s, d).select("value", F.lit(0.1).alias("a"), F.lit(0.7).alias("b"), (F.col("value") * 3).alias("tripled"))
    ).select("col1", "col2", "r"),
    """SELECT * FROM (VALUES ('value', 'a', CAST(NULL AS DOUBLE)), ('value', 'b', NULL), ('value', 'tripled', 1.0), ('a', 'b', NULL),
      ('a', 'tripled', NULL), ('b', 'tripled', NULL)) t(col1, col2, r)""",
    {"r": 9},
)

EDGES = ((999.999, "1,000.00"), (999.994, "999.99"), (-999.999, "-1,000.00"), (1000.0, "1.00K"), (999999.999, "1000.00K"), (5e12, "5000.00B"), (0.0, "0.00"))


def _humanize_edges(s: SparkSession, d: str) -> DataFrame:
    value = F.element_at(F.array(*[F.lit(v) for v, _ in EDGES]), (F.col("event_id") % len(EDGES) + 1).cast("int"))
    return V.events(s, d).select("event_id", humanize(value).alias("shown"))


add(
    "humanize_edges",
    _humanize_edges,
    f"SELECT event_id, CASE event_id % {len(EDGES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, (_, t) in enumerate(EDGES)) + " END AS shown FROM events",
)


def _late_text(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "MM/dd/yyyy")
    return V.events(s, d).select(
        "event_id", F.when(F.col("event_id") < 400, day).otherwise("not a date").alias("noise"), day.alias("day"), "value"
    )


def _detected(s: SparkSession, d: str) -> DataFrame:
    df = _late_text(s, d)
    name, fmt = R.detect_date(df)
    return R.with_dates(df, name, fmt).agg(F.lit(name).alias("date_column"), F.min(name).alias("first"), F.max(name).alias("last"))


add(
    "detect_date_late_text",
    _detected,
    "SELECT 'day' AS date_column, CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) AS first, CAST(max(CAST(ts AS DATE)) AS TIMESTAMP) AS last FROM events",
)
add(
    "quick_stats_text_date",
    lambda s, d: P.quick_stats(_late_text(s, d)),
    """SELECT count(*) AS n_rows, 4 AS n_columns, 2 AS n_numeric, 2 AS n_categories, strftime(min(ts), '%Y-%m-%d') AS min_date,
      strftime(max(ts), '%Y-%m-%d') AS max_date FROM events""",
)
add(
    "series_text_date",
    lambda s, d: S.series(_late_text(s, d), "day", "value"),
    "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ds, sum(value) AS y FROM events GROUP BY 1",
    {"y": 4},
)


def _quoted_breaks(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "csv")
    FI.write_table(V.table(s, d, "documents"), path)
    return FI.read_csv(s, path).select("doc_id", "text", "lang", "source", "n_chars")


add("read_csv_quoted_breaks", _quoted_breaks, "SELECT doc_id, text, lang, source, n_chars FROM documents")


def _dotted(s: SparkSession, d: str) -> DataFrame:
    df = V.events(s, d).withColumnsRenamed({"value": "u.value", "event_type": "u.type"})
    ranked = Q.aggregate(df, "u.value", "sum", "u.type", order="desc", limit=3)
    return ranked.toDF("kind", "total")


add(
    "aggregate_dotted_names",
    _dotted,
    "SELECT event_type AS kind, sum(value) AS total FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 3",
    {"total": 3},
)


def _catalog_defaults(s: SparkSession, d: str) -> DataFrame:
    """A catalog that leaves all it can to the defaults, joined to how many values its columns hold."""
    path = new_path(s, "catalog")
    text = '{"metrics": [{"name": "Value", "column": "value"}, {"column": "user_id", "aggregation": "avg"}], "dimensions": ["event_type"]}'
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    found = CT.load_catalog(s, path)
    events = V.events(s, d)
    rows = [
        F.struct(F.lit(m.name).alias("name"), F.lit(m.column).alias("column"), F.lit(m.aggregation).alias("aggregation"), F.lit(m.format).alias("format"), F.count(m.column).alias("n"))
        for m in found.metrics
    ]
    return events.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


add(
    "read_catalog",
    _catalog_defaults,
    """SELECT 'Value' AS name, 'value' AS "column", 'sum' AS aggregation, 'number' AS format, count(value) AS n FROM events
      UNION ALL SELECT 'user_id', 'user_id', 'avg', 'number', count(user_id) FROM events""",
)

# The frame of the wave fit; its numbers have no SQL form.
add(
    "forecast_fourier_frame",
    lambda s, d: FC.forecast_fourier(V.events(s, d), "ts", "value", periods=12, by=["event_type"], step="week").select("event_type", "ds", "y", "is_future"),
    """WITH days AS (SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ds, sum(value) AS y FROM events GROUP BY 1, 2)
      SELECT event_type, ds, y, FALSE AS is_future FROM days UNION ALL
      SELECT event_type, max(ds) + INTERVAL 7 DAY * k, NULL, TRUE FROM days, range(1, 13) r(k) GROUP BY event_type, k""",
    {"y": 3},
)
add(
    "forecast_monthly_steps",
    lambda s, d: FC.forecast(V.events(s, d), "ts", "value", periods=5, by=["event_type"], step="month").filter("is_future").select("event_type", "ds"),
    """SELECT event_type, CAST(date_trunc('month', max(CAST(ts AS DATE))) + INTERVAL 1 MONTH * k AS DATE) AS ds
      FROM events, range(1, 6) r(k) GROUP BY event_type, k""",
)
SPELLINGS = {
    "minutes": ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    "zoned": ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%S"),
    "named": ("d MMM yyyy", "%Y-%m-%d"),
    "halves": ("MM/dd/yyyy hh:mm a", "%Y-%m-%d %H:%M"),
}


def _spelt(s: SparkSession, d: str) -> DataFrame:
    texts = [F.date_format("ts", f).alias(c) for c, (f, _) in SPELLINGS.items()]
    return C.promote_timestamp(V.events(s, d).select("event_id", *texts))


add(
    "promote_timestamp_formats",
    _spelt,
    "SELECT event_id, "
    + ", ".join(f"strptime(strftime(ts, '{f}'), '{f}') AS {c}" for c, (_, f) in SPELLINGS.items())
    + " FROM events",
)
