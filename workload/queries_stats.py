"""Statistics, insights, recommendations and forecasts over the provided tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators import forecast as FC
from tallyglass.operators import insights as I
from tallyglass.operators import narratives as N
from tallyglass.operators import roles as R
from tallyglass.operators import series as S
from tallyglass.operators import stats as A
from tallyglass.operators.query import pivot_mean
from tallyglass.sources import files as FI
from workload import sql as W
from workload import views as V
from workload.queries import (
    TREND_METRICS,
    _fences,
    _momentum_sql,
    _moves_sql,
    _season_sql,
    _trend_sql,
    DRIVER,
    add,
    daily_events,
    ordered_sales,
    staged_sales,
    with_sales,
)

CATEGORIES = ["category", "region"]

# --- Statistics --------------------------------------------------------------------------------

add(
    "correlation",
    lambda s, d: A.correlation(V.sales(s, d), "sales", "profit"),
    with_sales(
        """SELECT 'sales' AS col1, 'profit' AS col2, r,
          CASE WHEN abs(r) > 0.8 THEN 'very strong' WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
          CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (SELECT corr(sales, profit) AS r FROM sales)"""
    ),
    {"r": 8},
)
MATRIX = ["sales", "quantity", "customer_id", "profit_margin", "discount", "returns", "satisfaction_score", "profit", "revenue", "cost"]


def _pairs_sql(names, source: str) -> str:
    return W.union(
        f"SELECT {i} AS i, {j} AS j, '{names[i]}' AS col1, '{names[j]}' AS col2, corr({names[i]}, {names[j]}) AS r FROM {source}"
        for i, j in combinations(range(len(names)), 2)
    )


add(
    "correlation_matrix",
    lambda s, d: A.correlation_matrix(staged_sales(s, d, *MATRIX), MATRIX),
    with_sales(_pairs_sql(MATRIX, "sales")),
    {"r": 7},
)
add(
    "correlation_matrix_with_gaps",
    lambda s, d: A.correlation_matrix(
        V.events_dirty(s, d).withColumn("position", F.col("event_id") % 1000).select("event_id", "position", "value"), full=True
    ),
    f"""WITH {W.DIRTY}, wide AS (SELECT event_id, event_id % 1000 AS position, value FROM dirty),
    half AS ({_pairs_sql(['event_id', 'position', 'value'], 'wide')})
    SELECT * FROM half UNION ALL SELECT j, i, col2, col1, r FROM half
    UNION ALL SELECT i, i, c, c, 1.0 FROM (VALUES (0, 'event_id'), (1, 'position'), (2, 'value')) v(i, c)""",
    {"r": 7},
)


def _correlations_sql(names=TREND_METRICS) -> str:
    return f"""correlations AS (SELECT i * {len(names)} + j AS seq, 'correlation' AS type,
        CASE WHEN abs(r) > 0.8 THEN 'Strong ' ELSE 'Moderate ' END || CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END || ' Correlation' AS title,
        {W.names_case('col1', names)} || ' ↔ ' || {W.names_case('col2', names)} || ' (r=' || printf('%.3f', r) || ')' AS description,
        CASE WHEN abs(r) > 0.8 THEN 'high' ELSE 'medium' END AS priority, col1 || '_vs_' || col2 AS metric, r AS value, col1, col2
      FROM ({_pairs_sql(names, 'sales')}) WHERE abs(r) > 0)"""


add(
    "correlation_insight",
    lambda s, d: A.correlation_insight(staged_sales(s, d, *TREND_METRICS), TREND_METRICS, 0.0),
    f"WITH {W.SALES}, {_correlations_sql()} SELECT * FROM correlations",
    {"value": 7},
)
add(
    "anomaly_rows",
    lambda s, d: A.anomaly_rows(V.events(s, d).select("event_id", "ts", "value"), "value"),
    f"SELECT event_id, ts, value, lower_bound, upper_bound FROM events, {_fences('events', 'value')} WHERE value < lower_bound OR value > upper_bound",
    {"lower_bound": 6, "upper_bound": 6},
)
add(
    "anomaly_rows_first",
    lambda s, d: A.anomaly_rows(V.events(s, d).select("event_id", "ts", "value"), "value", limit=20, order_by=V.EVENT_ORDER),
    f"SELECT event_id, ts, value, lower_bound, upper_bound FROM events, {_fences('events', 'value')} WHERE value < lower_bound OR value > upper_bound ORDER BY ts, event_id LIMIT 20",
    {"lower_bound": 6, "upper_bound": 6},
)


def _anomalies_sql(metrics, source: str) -> str:
    parts = [
        f"SELECT {i} AS seq, '{m}' AS metric, count(*) FILTER ({m} < lower_bound OR {m} > upper_bound) AS outliers, count(*) AS n FROM {source}, {_fences(source, m)}"
        for i, m in enumerate(metrics)
    ]
    return f"""anomalies AS (SELECT seq, 'anomaly' AS type, 'Anomalies Detected in ' || {W.names_case('metric', metrics)} AS title,
        format('{{:,}}', outliers) || ' outliers (' || printf('%.1f', value) || '% of data)' AS description,
        CASE WHEN value > 8 THEN 'high' ELSE 'medium' END AS priority, metric, value, outliers
      FROM (SELECT *, outliers / n * 100 AS value FROM ({W.union(parts)})) WHERE value > 0)"""


add(
    "anomaly_insight",
    lambda s, d: A.anomaly_insight(staged_sales(s, d, *TREND_METRICS), TREND_METRICS, min_pct=0.0),
    f"WITH {W.SALES}, {_anomalies_sql(TREND_METRICS, 'sales')} SELECT * FROM anomalies",
    {"value": 6},
)
add(
    "anomaly_insight_events",
    lambda s, d: A.anomaly_insight(V.events(s, d), ["value"]),
    f"WITH {_anomalies_sql(['value'], 'events')} SELECT * FROM anomalies WHERE value > 3",
    {"value": 6},
)
SHAPE = "CASE WHEN skewness > 0.5 THEN 'right-skewed' WHEN skewness < -0.5 THEN 'left-skewed' ELSE 'approximately normal' END AS shape"
add(
    "distribution_summary",
    lambda s, d: A.distribution_summary(V.events_dirty(s, d), "value"),
    f"""WITH {W.DIRTY} SELECT *, {SHAPE} FROM (SELECT 'value' AS metric, min(value) AS min, max(value) AS max, avg(value) AS mean,
        quantile_cont(value, 0.5) AS median, skewness(value) AS skewness FROM dirty)""",
    {"mean": 5, "median": 5, "skewness": 6},
)
add(
    "histogram",
    lambda s, d: A.histogram(staged_sales(s, d, "revenue"), "revenue"),
    f"""WITH {W.SALES}, b AS (SELECT min(revenue) AS lo, max(revenue) AS hi, (max(revenue) - min(revenue)) / 50 AS w, avg(revenue) AS mean,
          quantile_cont(revenue, 0.5) AS median FROM sales),
        placed AS (SELECT least(CAST(floor((revenue - lo) / w) AS INTEGER), 49) AS bin FROM sales, b),
        counts AS (SELECT bin, count(*) AS count FROM placed GROUP BY bin)
        SELECT CAST(r.bin AS INTEGER) AS bin, lo + r.bin * w AS bin_start, lo + (r.bin + 1) * w AS bin_end, coalesce(count, 0) AS count, mean, median
        FROM range(50) r(bin) CROSS JOIN b LEFT JOIN counts ON counts.bin = r.bin""",
    {"bin_start": 4, "bin_end": 4, "mean": 3, "median": 3},
)


def _skews_sql(metrics, source: str) -> str:
    parts = [
        f"SELECT {i} AS seq, '{m}' AS metric, skewness({m}) AS value, kurtosis({m}) AS kurtosis FROM {source}" for i, m in enumerate(metrics)
    ]
    return f"""skews AS (SELECT seq, 'distribution' AS type, {W.names_case('metric', metrics)} || ' is Heavily Skewed' AS title,
        'Skewness: ' || printf('%.2f', value) || ' (' || CASE WHEN value > 0 THEN 'right (positive)' ELSE 'left (negative)' END || ')' AS description,
        'low' AS priority, metric, value, kurtosis FROM ({W.union(parts)}) WHERE abs(value) > 0)"""


add(
    "distribution_insight",
    lambda s, d: A.distribution_insight(V.events(s, d), ["value", "user_id"], 0.0),
    f"WITH {_skews_sql(['value', 'user_id'], 'events')} SELECT * FROM skews",
    {"value": 5, "kurtosis": 5},
)


def _gaps_sql(categories=CATEGORIES, metrics=("sales", "quantity")) -> str:
    parts = []
    for i, c in enumerate(categories):
        for j, m in enumerate(metrics):
            parts.append(
                f"""SELECT {i * len(metrics) + j} AS seq, '{c}' AS category, '{m}' AS measure, n_groups, leader, leader_mean, laggard, laggard_mean FROM
                (SELECT count(*) OVER () AS n_groups, first_value(k) OVER (ORDER BY v DESC, k) AS leader, first_value(v) OVER (ORDER BY v DESC, k) AS leader_mean,
                   first_value(k) OVER (ORDER BY v, k) AS laggard, first_value(v) OVER (ORDER BY v, k) AS laggard_mean
                 FROM (SELECT {c} AS k, avg({m}) AS v FROM sales WHERE {c} IS NOT NULL GROUP BY 1) LIMIT 1)"""
            )
    plain = W.names_case("measure", metrics, lambda n: n.replace("_", " "))
    return f"""gaps AS (SELECT seq, 'performance_gap' AS type, 'Performance Gap: ' || {W.names_case('category', categories)} AS title,
        leader || ' outperforms ' || laggard || ' by ' || printf('%.1f', value) || '% in ' || {plain} AS description,
        CASE WHEN value > 50 THEN 'high' ELSE 'medium' END AS priority, category || '_' || measure AS metric, value,
        category, measure, leader, leader_mean, laggard, laggard_mean
      FROM (SELECT *, CASE WHEN n_groups >= 2 AND laggard_mean > 0 THEN (leader_mean - laggard_mean) / laggard_mean * 100 END AS value
            FROM ({W.union(parts)})) WHERE value > 0)"""


add(
    "performance_gap_insight",
    lambda s, d: A.performance_gap_insight(staged_sales(s, d, "sales", "quantity", *CATEGORIES), CATEGORIES, ["sales", "quantity"], 0.0),
    f"WITH {W.SALES}, {_gaps_sql()} SELECT * FROM gaps",
    {"value": 5, "leader_mean": 6, "laggard_mean": 6},
)


def _tests_sql(source: str, category: str, metrics, where: str = "") -> str:
    parts = [
        f"""SELECT {i} AS seq, '{category}' AS category, '{m}' AS measure, g1 AS group1, g2 AS group2,
          count({m}) FILTER ({category} = g1) AS n1, count({m}) FILTER ({category} = g2) AS n2,
          avg({m}) FILTER ({category} = g1) AS mean1, avg({m}) FILTER ({category} = g2) AS mean2,
          var_samp({m}) FILTER ({category} = g1) AS v1, var_samp({m}) FILTER ({category} = g2) AS v2
        FROM {source}, (SELECT min({category}) AS g1, min({category}) FILTER ({category} > (SELECT min({category}) FROM {source})) AS g2 FROM {source})
        GROUP BY g1, g2"""
        for i, m in enumerate(metrics)
    ]
    return f"""tests AS (SELECT seq, category, measure, group1, group2, n1, n2, mean1, mean2, t, dof, {W.t_p_value('t', 'dof')} AS p_value,
        coalesce((mean2 - mean1) / nullif(mean1, 0) * 100, 0) AS diff_pct
      FROM (SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS dof,
              (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t FROM ({W.union(parts)})))"""


TEST_DIGITS = {"mean1": 5, "mean2": 5, "t": 7, "p_value": 6, "diff_pct": 6}
add(
    "ttest_measures",
    lambda s, d: A.ttest_measures(V.events(s, d), "event_type", ["value", "user_id"]),
    f"WITH {_tests_sql('events', 'event_type', ['value', 'user_id'])} SELECT * FROM tests",
    TEST_DIGITS,
)


def _ttest_insight_sql(metrics) -> str:
    return f"""ttests AS (SELECT seq, 'statistical_test' AS type,
        'Statistically Significant Difference in ' || {W.names_case('measure', metrics)} AS title,
        group2 || ' vs ' || group1 || ': ' || printf('%.1f', abs(diff_pct)) || '% difference (p=' || printf('%.4f', p_value) || ')' AS description,
        CASE WHEN p_value < 0.01 THEN 'high' ELSE 'medium' END AS priority, category || '_' || measure || '_ttest' AS metric, p_value AS value,
        category, measure, group1, group2, t, dof, diff_pct FROM tests)"""


add(
    "ttest_insight",
    lambda s, d: A.ttest_insight(V.events(s, d), "event_type", ["value", "user_id"], "first two", alpha=1.1),
    f"WITH {_tests_sql('events', 'event_type', ['value', 'user_id'])}, {_ttest_insight_sql(['value', 'user_id'])} SELECT * FROM ttests",
    {"value": 6, "t": 7, "diff_pct": 6},
)
LINE_DIGITS = {"slope": 7, "intercept": 3, "r2": 8}
LINE = "regr_slope(profit, sales) AS slope, regr_intercept(profit, sales) AS intercept, regr_r2(profit, sales) AS r2, count(*) AS n"
add("ols_line", lambda s, d: A.ols_line(V.sales(s, d), "sales", "profit"), with_sales(f"SELECT {LINE} FROM sales"), LINE_DIGITS)
add(
    "ols_line_by",
    lambda s, d: A.ols_line(V.sales(s, d), "sales", "profit", "region"),
    with_sales(f"SELECT region, {LINE} FROM sales GROUP BY region"),
    LINE_DIGITS,
)
add(
    "pivot_mean",
    lambda s, d: pivot_mean(V.sales(s, d), "segment", "region", "profit"),
    with_sales("SELECT region, segment, avg(profit) AS profit FROM sales GROUP BY 1, 2"),
    {"profit": 6},
)
FLAGS = ("A", "N", "R")
add(
    "pivot_mean_wide",
    lambda s, d: pivot_mean(V.table(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", wide=True),
    "SELECT l_linestatus, "
    + ", ".join(f"avg(l_extendedprice) FILTER (l_returnflag = '{f}') AS \"{f}\"" for f in FLAGS)
    + " FROM lineitem GROUP BY 1",
    {f: 6 for f in FLAGS},
)

# --- Insights ----------------------------------------------------------------------------------

ROLES = R.Roles(tuple(TREND_METRICS), tuple(CATEGORIES), "date")
ZERO = {**dict.fromkeys(I.THRESHOLDS, 0.0), "ttest": 1.1}
LABEL = W.names_case("metric", TREND_METRICS)
ALL_NAMES = [*TREND_METRICS, *CATEGORIES]


def words(column: str) -> str:
    return W.names_case(column, ALL_NAMES, lambda n: n.replace("_", " "))


def label(column: str) -> str:
    return W.names_case(column, ALL_NAMES)


TREND_TEXT = f"""{LABEL} || ' has ' || CASE WHEN abs(value) > 25 THEN 'significantly' WHEN abs(value) > 10 THEN 'moderately' ELSE 'slightly' END
  || CASE WHEN value > 0 THEN ' increased' ELSE ' decreased' END || ' by ' || printf('%.1f', abs(value)) || '% between the earliest and the latest rows.'
  || coalesce(' Main drivers: ' || CASE WHEN value > 0 THEN up_drivers ELSE down_drivers END || '.', '')
  || CASE WHEN value < -15 THEN ' Look into the causes of this decline now.' WHEN value > 20 THEN ' Find out what worked and repeat it elsewhere.' ELSE '' END"""
CORRELATION_TEXT = f"""{label('col1')} || ' and ' || {label('col2')} || ' show a '
  || CASE WHEN abs(value) > 0.8 THEN 'very strong' WHEN abs(value) > 0.6 THEN 'strong' ELSE 'moderate' END
  || CASE WHEN value > 0 THEN ' positive' ELSE ' negative' END || ' correlation (r = ' || printf('%.3f', value) || '): when ' || {words('col1')}
  || ' rises, ' || {words('col2')} || CASE WHEN value > 0 THEN ' tends to rise too.' ELSE ' tends to fall.' END"""
ANOMALY_TEXT = f"""CASE WHEN value > 10 THEN 'A concerning' WHEN value > 5 THEN 'A notable' ELSE 'A minor' END
  || ' number of rows lie outside the usual range of ' || {LABEL} || ': ' || format('{{:,}}', outliers) || ' records (' || printf('%.1f', value)
  || '%). Check whether they are errors, one-off events or fraud.'"""
GAP_TEXT = f"""'Across ' || {label('category')} || ', ' || leader || ' leads in ' || {words('measure')} || ' and ' || laggard
  || ' comes last, a gap of ' || printf('%.1f', abs(value)) || '%. Carry over what the leader does differently.'"""
MOMENTUM_TEXT = f"""'Short-term momentum: ' || {words('metric')} || CASE WHEN value > 0 THEN ' is accelerating, a gain of ' ELSE ' is decelerating, a decline of ' END
  || printf('%.1f', abs(value)) || '% week over week.'"""
SKEW_TEXT = f"""{LABEL} || ' is skewed ' || CASE WHEN value > 0 THEN 'right (positive): mostly low values with some high outliers.'
  ELSE 'left (negative): mostly high values with some low outliers.' END || ' Prefer the median to the mean, or take logarithms.'"""
TEST_TEXT = f"""'The difference in ' || {words('measure')} || ' between ' || group2 || ' and ' || group1 || ' is significant (p-value: '
  || printf('%.4f', value) || '): a difference of ' || printf('%.1f', abs(diff_pct)) || '% is unlikely to be chance.'"""
SEASON_TEXT = f"""'Weekly pattern in ' || {words('metric')} || ' (autocorrelation ' || printf('%.3f', value)
  || '): values repeat on a 7-day cycle, which forecasts and staffing should reflect.'"""

DRIVERS_SQL = f"""drivers AS (SELECT metric,
    string_agg({DRIVER}, ', ' ORDER BY category_seq) FILTER (up_rank = 1 AND abs(change_pct) > 0) AS up_drivers,
    string_agg({DRIVER}, ', ' ORDER BY category_seq) FILTER (down_rank = 1 AND abs(change_pct) > 0) AS down_drivers
  FROM moves GROUP BY metric)"""

ANALYSES = ", ".join(
    [
        W.SALES,
        W.PLACED,
        _trend_sql(),
        _momentum_sql(),
        _moves_sql(TREND_METRICS, CATEGORIES),
        DRIVERS_SQL,
        _correlations_sql(),
        _anomalies_sql(TREND_METRICS, "sales"),
        _gaps_sql(),
        _skews_sql(TREND_METRICS[:3], "sales"),
        _tests_sql("sales", "category", TREND_METRICS[:2]),
        _ttest_insight_sql(TREND_METRICS[:2]),
        _season_sql(TREND_METRICS[:2], "sales", "date"),
    ]
)


def _told(source: str, text: str, place: str) -> str:
    return f"SELECT {place} AS place, type, title, description, {text} AS narrative, priority, metric, value FROM {source}"


INSIGHTS = f"""{ANALYSES}, insights AS (SELECT row_number() OVER (ORDER BY place) AS seq, * EXCLUDE (place) FROM (
  {W.union([
      _told('trends LEFT JOIN drivers USING (metric)', TREND_TEXT, '1000000 + seq * 2'),
      _told('momentum', MOMENTUM_TEXT, '1000001 + seq * 2'),
      _told('correlations', CORRELATION_TEXT, '2000000 + seq'),
      _told('anomalies', ANOMALY_TEXT, '3000000 + seq'),
      _told('gaps', GAP_TEXT, '4000000 + seq'),
      _told('skews', SKEW_TEXT, '5000000 + seq'),
      _told('ttests', TEST_TEXT, '6000000 + seq'),
      _told('seasons', SEASON_TEXT, '7000000 + seq'),
  ])}))"""


def insight_source(s: SparkSession, d: str) -> DataFrame:
    return ordered_sales(s, d, ROLES.date, *ROLES.numeric, *ROLES.categorical)


def insight_table(source: DataFrame) -> DataFrame:
    narrowed = {"distribution": TREND_METRICS[:3], "gap": TREND_METRICS[:2], "ttest": TREND_METRICS[:2], "seasonality": TREND_METRICS[:2]}
    return I.all_insights(
        source, V.SALES_ORDER, ROLES, ZERO, staged=False, drivers_min_abs=0.0, metrics=narrowed, ttest=("category", "first two")
    )


add("all_insights", lambda s, d: insight_table(insight_source(s, d)), f"WITH {INSIGHTS} SELECT * FROM insights", {"value": 5})


def _narrated(source: str, text: str) -> str:
    return f"SELECT metric, {text} AS narrative FROM {source}"


def _narrate_trend(s: SparkSession, d: str) -> DataFrame:
    data = ordered_sales(s, d, *TREND_METRICS, *CATEGORIES)
    trends = S.trend_insight(data, TREND_METRICS, V.SALES_ORDER, min_abs=0.0)
    return N.narrate_trend(trends, S.trend_drivers(data, TREND_METRICS, CATEGORIES, V.SALES_ORDER, 0.0)).select("metric", "narrative")


add(
    "narrate_trend",
    _narrate_trend,
    f"WITH {W.SALES}, {W.PLACED}, {_trend_sql()}, {_moves_sql(TREND_METRICS, CATEGORIES)}, {DRIVERS_SQL} "
    + _narrated("trends LEFT JOIN drivers USING (metric)", TREND_TEXT),
)
add(
    "narrate_correlation",
    lambda s, d: N.narrate_correlation(A.correlation_insight(staged_sales(s, d, *TREND_METRICS), TREND_METRICS, 0.0)).select("metric", "narrative"),
    f"WITH {W.SALES}, {_correlations_sql()} " + _narrated("correlations", CORRELATION_TEXT),
)
add(
    "narrate_anomaly",
    lambda s, d: N.narrate_anomaly(A.anomaly_insight(staged_sales(s, d, *TREND_METRICS), TREND_METRICS, min_pct=0.0)).select("metric", "narrative"),
    f"WITH {W.SALES}, {_anomalies_sql(TREND_METRICS, 'sales')} " + _narrated("anomalies", ANOMALY_TEXT),
)
add(
    "narrate_gap",
    lambda s, d: N.narrate_gap(
        A.performance_gap_insight(staged_sales(s, d, "sales", "quantity", *CATEGORIES), CATEGORIES, ["sales", "quantity"], 0.0)
    ).select("metric", "narrative"),
    f"WITH {W.SALES}, {_gaps_sql()} " + _narrated("gaps", GAP_TEXT),
)


def _narrate_other(s: SparkSession, d: str) -> DataFrame:
    data = ordered_sales(s, d, *TREND_METRICS, *CATEGORIES)
    tables = [
        S.momentum_insight(data, TREND_METRICS, V.SALES_ORDER, min_abs=0.0),
        A.distribution_insight(data, TREND_METRICS[:3], 0.0),
        A.ttest_insight(data, "category", TREND_METRICS[:2], "first two", alpha=1.1),
        S.seasonality_insight(data, "date", TREND_METRICS[:2], min_abs=0.0),
    ]
    told = [N.narrate_other(t).select("type", "metric", "narrative") for t in tables]
    return told[0].unionByName(told[1]).unionByName(told[2]).unionByName(told[3])


add(
    "narrate_other",
    _narrate_other,
    f"WITH {INSIGHTS} SELECT type, metric, narrative FROM insights WHERE type IN ('trend_weekly', 'distribution', 'statistical_test', 'seasonality')",
)
add(
    "critical_findings",
    lambda s, d: I.critical_findings(insight_table(insight_source(s, d)), 3).select("seq", "title", "priority", "metric"),
    f"WITH {INSIGHTS} SELECT seq, title, priority, metric FROM insights WHERE priority = 'high' ORDER BY seq LIMIT 3",
)
add(
    "insights_by_priority",
    lambda s, d: I.by_priority(insight_table(insight_source(s, d)), "medium").select("seq", "title", "metric"),
    f"WITH {INSIGHTS} SELECT seq, title, metric FROM insights WHERE priority = 'medium'",
)


# Fixed values, written out here so that the reference SQL stands on its own.
EXPECTED_ADVICE = {
    "trend": ("Investigate Declining Trend", "Schedule stakeholder meeting to review decline drivers", "high"),
    "correlation": ("Leverage Correlation for Prediction", "Develop regression model for forecasting", "medium"),
    "anomaly": ("Audit Anomalous Data", "Export anomalies for manual review", "high"),
    "performance_gap": ("Close Performance Gap", "Conduct best practices analysis", "high"),
    "forecast": ("Enable Time Series Forecasting", "Navigate to Predictions tab", "medium"),
    "segments": ("Perform Cross-Segment Analysis", "Use filters to compare segments", "low"),
}


def _advice_row(kind: str) -> str:
    title, action, priority = EXPECTED_ADVICE[kind]
    return f"'{title}' AS title, '{action}' AS action, '{priority}' AS priority"


ADVICE_CASES = {
    "trend": ("type = 'trend' AND value < -15", "'The ' || printf('%.1f', abs(value)) || '% decline in ' || replace(metric, '_', ' ') || ' needs attention: look for its cause.'"),
    "correlation": ("type = 'correlation' AND abs(value) > 0.7", "'The two columns move together, so one can be used to predict the other.'"),
    "anomaly": ("type = 'anomaly'", "'Review the ' || printf('%.1f', abs(value)) || '% of outlier records and tell errors from real exceptions.'"),
    "performance_gap": ("type = 'performance_gap'", "'Learn what sets the leaders apart and help the others catch up.'"),
}
RECOMMENDATIONS = f"""advice AS (
  {W.union(f"SELECT seq, {text} AS description, {_advice_row(k)} FROM (SELECT * FROM insights WHERE priority = 'high' ORDER BY seq LIMIT 5) WHERE {test}" for k, (test, text) in ADVICE_CASES.items())}
  UNION ALL SELECT 1000000, 'The history is long enough for a forecast with a confidence band.', {_advice_row('forecast')} FROM sales HAVING count(*) > 1000
  UNION ALL SELECT 1000001, 'Several dimensions are there: compare metrics across their combinations.', {_advice_row('segments')})"""


def _recommendations(s: SparkSession, d: str) -> DataFrame:
    data = insight_source(s, d)
    return I.recommendations(insight_table(data), data, ROLES, 5)


def _summary_facts(s: SparkSession, d: str) -> DataFrame:
    data = insight_source(s, d)
    return I.summary_facts(data, insight_table(data), "date", n_columns=len(V.SALES_COLUMNS))


add(
    "recommendations",
    _recommendations,
    f"WITH {INSIGHTS}, {RECOMMENDATIONS} SELECT * FROM advice",
)
add(
    "summary_facts",
    _summary_facts,
    f"""WITH {INSIGHTS} SELECT count(*) AS n_rows, 19 AS n_columns, strftime(min(date), '%B %d, %Y') AS min_date,
      strftime(max(date), '%B %d, %Y') AS max_date, (SELECT count(*) FROM insights WHERE priority = 'high') AS n_critical,
      (SELECT count(*) FROM insights) AS n_insights FROM sales""",
)
add(
    "insights_csv",
    lambda s, d: FI.insights_csv(insight_table(insight_source(s, d))).withColumnsRenamed({c: c.lower() for c in ("Type", "Priority", "Title", "Description", "Metric", "Value")}),
    f"WITH {INSIGHTS} SELECT type, priority, title, description, coalesce(metric, '') AS metric, value FROM insights",
    {"value": 5},
)

# --- Forecasts ---------------------------------------------------------------------------------

DAYS = {
    "": "days AS (SELECT CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1)",
    "event_type": "days AS (SELECT event_type, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY 1, 2)",
    "customer_id": "days AS (SELECT customer_id, CAST(date AS DATE) AS ds, sum(revenue) AS y FROM sales GROUP BY 1, 2)",
}


def _forecast_sql(by: str = "", periods: int = 30) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON TRUE"
    z = 1.959963984540054
    return f"""{DAYS[by]},
      starts AS (SELECT {key}min(ds) AS first_day, max(ds) AS last_day, avg(y) AS mean_y FROM days {group}),
      timed AS (SELECT days.*, first_day, last_day, mean_y, CAST(ds - first_day AS DOUBLE) AS t, isodow(ds) AS dow FROM days JOIN starts {on}),
      lines AS (SELECT {key}coalesce(regr_slope(y, t), 0) AS slope, avg(y) - coalesce(regr_slope(y, t), 0) * avg(t) AS level FROM timed {group}),
      rested AS (SELECT timed.*, slope, level, level + slope * t AS trend, y - (level + slope * t) AS rest FROM timed JOIN lines {on}),
      effects AS (SELECT {key}dow, avg(rest) AS weekly FROM rested GROUP BY {key}dow),
      known AS (SELECT rested.*, weekly FROM rested JOIN effects USING ({key}dow)),
      spreads AS (SELECT {key}coalesce(stddev_samp(rest - weekly), 0) AS spread FROM known {group}),
      ahead AS (SELECT {key}last_day + CAST(k AS INTEGER) AS ds, first_day FROM starts, range(1, {periods + 1}) r(k)),
      future AS (SELECT {key}ds, CAST(NULL AS DOUBLE) AS y, level + slope * CAST(ds - first_day AS DOUBLE) AS trend, coalesce(weekly, 0) AS weekly, TRUE AS is_future
        FROM (SELECT *, isodow(ds) AS dow FROM ahead) JOIN lines {on} LEFT JOIN effects USING ({key}dow)),
      everything AS (SELECT {key}ds, y, trend, weekly, FALSE AS is_future FROM known UNION ALL SELECT {key}ds, y, trend, weekly, is_future FROM future),
      forecast AS (SELECT {key}ds, trend + weekly AS yhat, trend + weekly - {z} * spread AS yhat_lower, trend + weekly + {z} * spread AS yhat_upper,
        trend, weekly, y, is_future FROM everything JOIN spreads {on})"""


FORECAST_DIGITS = {"yhat": 4, "yhat_lower": 4, "yhat_upper": 4, "trend": 4, "weekly": 4, "y": 3}
add(
    "forecast_input",
    lambda s, d: FC.forecast_input(V.events(s, d), "ts", "value", ["event_type"]),
    f"WITH {DAYS['event_type']} SELECT event_type, ds, y FROM days",
    {"y": 3},
)
add("forecast", lambda s, d: FC.forecast(V.events(s, d), "ts", "value"), f"WITH {_forecast_sql()} SELECT * FROM forecast", FORECAST_DIGITS)
add(
    "forecast_by_type",
    lambda s, d: FC.forecast(V.events(s, d), "ts", "value", by=["event_type"], periods=14),
    f"WITH {_forecast_sql('event_type', 14)} SELECT * FROM forecast",
    FORECAST_DIGITS,
)
SUMMARY_DIGITS = {"predicted_mean": 2, "predicted_min": 2, "predicted_max": 2, "confidence_interval": 2}
SUMMARY = """avg(yhat) AS predicted_mean, min(yhat_lower) AS predicted_min, max(yhat_upper) AS predicted_max,
  CASE WHEN arg_max(trend, ds) > arg_min(trend, ds) THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
  (avg(yhat_upper) - avg(yhat_lower)) / 2 AS confidence_interval"""
add(
    "forecast_summary",
    lambda s, d: FC.forecast_summary(FC.forecast(V.events(s, d), "ts", "value", by=["event_type"]), ["event_type"]),
    f"WITH {_forecast_sql('event_type')} SELECT event_type, {SUMMARY} FROM forecast WHERE is_future GROUP BY event_type",
    SUMMARY_DIGITS,
)
add(
    "forecast_summary_by_customer",
    lambda s, d: FC.forecast_summary(FC.forecast(V.sales(s, d), "date", "revenue", by=["customer_id"]), ["customer_id"]),
    f"WITH {W.SALES}, {_forecast_sql('customer_id')} SELECT customer_id, {SUMMARY} FROM forecast WHERE is_future GROUP BY customer_id",
    SUMMARY_DIGITS,
)
add(
    "forecast_components",
    lambda s, d: FC.forecast_components(FC.forecast(V.events(s, d), "ts", "value")),
    f"WITH {_forecast_sql()} SELECT ds, trend, weekly FROM forecast",
    {"trend": 3, "weekly": 3},
)
add(
    "forecast_export",
    lambda s, d: FI.forecast_export(FC.forecast(V.events(s, d), "ts", "value")).withColumnsRenamed(
        {"Date": "date", "Forecast": "forecast", "Lower": "lower", "Upper": "upper"}
    ),
    f"WITH {_forecast_sql()} SELECT ds AS date, yhat AS forecast, yhat_lower AS lower, yhat_upper AS upper FROM forecast",
    {"forecast": 3, "lower": 3, "upper": 3},
)
# Fitted by penalised least squares per series, which SQL does not express; unit tests recover known signals.
add("forecast_fourier", lambda s, d: FC.forecast_fourier(V.events(s, d), "ts", "value", by=["event_type"]))
add(
    "forecast_fourier_components",
    lambda s, d: FC.forecast_components(FC.forecast_fourier(V.sales(s, d), "date", "revenue", by=["region"]), ["region"]),
)
add(
    "forecast_fourier_weights",
    lambda s, d: FC.fourier_weights(V.events(s, d), "ts", "value", ["event_type"]).select(
        "event_type", "part", "place", (F.abs("gradient") < 1e-6).alias("at_the_least")
    ),
    """SELECT event_type, CASE WHEN place < 27 THEN 'trend' WHEN place < 47 THEN 'yearly' ELSE 'weekly' END AS part,
      CAST(place AS INTEGER) AS place, TRUE AS at_the_least FROM (SELECT DISTINCT event_type FROM events), range(53) r(place)""",
)
