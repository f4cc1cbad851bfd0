"""Shared pieces of the reference SQL: the views and generated column lookups."""

from __future__ import annotations

# Fixed values, written out here so that the reference SQL stands on its own.
SYNONYMS = {
    "revenue": ["sales", "income", "amount"],
    "profit": ["margin", "earnings", "gain"],
    "cost": ["expense", "spending", "price"],
    "quantity": ["count", "number", "volume", "qty"],
    "date": ["time", "day", "period", "when"],
    "category": ["type", "group", "segment", "class"],
    "region": ["area", "location", "territory", "zone"],
}

INSIGHT_PATTERNS = {
    "insight": r"\b(?:insights?|findings?|discover|analyze|tell me about|explain|why)\b",
    "summary": r"\b(?:summary|overview|describe|summarize|recap)\b",
    "key": r"\b(?:key|important|significant|main|critical)\b",
}
ANALYSIS_PATTERNS = {
    "trend": r"\b(?:trends?|over time|time series|growth|change|evolution)\b(?:\s+of)?(?:\s+(\w+))?",
    "correlation": r"\b(?:correlation|relationship|connection|link)\s+(?:between\s+)?(\w+)\s+(?:and|with)\s+(\w+)",
    "distribution": r"\b(?:distribution|spread|histogram|breakdown)\s+(?:of\s+)?(\w+)",
    "forecast": r"\b(?:forecast|predict|projection|future)\s+(?:of\s+)?(\w+)",
    "anomaly": r"\b(?:anomal(?:y|ies)|outliers?|unusual|abnormal)\b(?:\s+in)?(?:\s+(\w+))?",
}
AGGREGATE_PATTERNS = {
    "sum": r"\b(?:total|sum|aggregate|combined|overall)\s+(?:of\s+)?(\w+)",
    "average": r"\b(?:average|mean|avg|typical)\s+(?:of\s+)?(\w+)",
    "max": r"\b(?:max(?:imum)?|highest|largest|best|top|peak)\s+(\w+)",
    "min": r"\b(?:min(?:imum)?|lowest|smallest|worst|bottom)\s+(\w+)",
    "count": r"\b(?:count|number|how many|quantity)\b(?:\s+of)?(?:\s+(\w+))?",
    "median": r"\b(?:median|middle)\s+(?:of\s+)?(\w+)",
}
BY_PATTERN = r"\b(?:by|per|for each|grouped by|across|segmented by)\s+(\w+)"
COMPARE_PATTERN = r"\bcompare\s+(\w+)\s+(?:and|vs|versus|with|to)\s+(\w+)"
GREATER_PATTERN = r"\b(\w+)(?:\s+(?:is|are))?\s*(>=?|\bgreater than\b|\bmore than\b|\babove\b|\bover\b)\s*(\d+(?:\.\d+)?)"
LESS_PATTERN = r"\b(\w+)(?:\s+(?:is|are))?\s*(<=?|\bless than\b|\bunder\b|\bbelow\b)\s*(\d+(?:\.\d+)?)"
WHERE_PATTERN = (
    r"\b(?:where|when|if|for|in|with)\s+(\w+)\s*(?:\bis\b|==|=|\bequals?\b)\s*[\"']?"
    r"([^\"']+?)[\"']?(?:\s+(?:by|per|for each|grouped by|across|segmented by)\s.*)?$"
)
TOP_PATTERN = r"\b(?:top|first|best)\s+(\d+)"
BOTTOM_PATTERN = r"\b(?:bottom|last|worst)\s+(\d+)"
RANKED_PATTERN = r"\b(?:top|first|best|bottom|last|worst)\s+\d+\s+(\w+)"

SALES = """sales AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS date, l_extendedprice AS sales,
         l_quantity AS quantity, p_type AS category, r_name AS region, o_orderpriority AS channel,
         c_mktsegment AS segment, o_custkey AS customer_id,
         CAST(0.10 AS DOUBLE) + 3 * l_tax AS profit_margin, l_discount AS discount,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returns,
         CAST(3.0 AS DOUBLE) + CAST(p_size % 21 AS DOUBLE) / 10 AS satisfaction_score,
         l_extendedprice * (CAST(0.10 AS DOUBLE) + 3 * l_tax) AS profit,
         l_extendedprice * (1 - l_discount) AS revenue,
         l_extendedprice - l_extendedprice * (CAST(0.10 AS DOUBLE) + 3 * l_tax) AS cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""

DIRTY = """dirty AS (
  SELECT event_id, ts, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 33 = 0 THEN NULL ELSE event_type END AS segment,
         '₹' || CAST(user_id AS VARCHAR) || ',500 ' AS amount_text,
         CAST(event_id % 100 AS VARCHAR) || '%' AS pct_text,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS date_text, CAST(NULL AS VARCHAR) AS empty_col
  FROM events)"""

QUESTIONS = """questions AS (
  SELECT id, CASE id % 16
    WHEN 0 THEN 'Total sales by ' || dim
    WHEN 1 THEN 'Average profit by ' || dim
    WHEN 2 THEN 'Maximum quantity by month'
    WHEN 3 THEN 'Trend of sales over time'
    WHEN 4 THEN 'Show revenue growth'
    WHEN 5 THEN 'Compare sales and profit'
    WHEN 6 THEN 'Correlation between price and quantity'
    WHEN 7 THEN 'Total revenue where segment is ' || seg || ' by region'
    WHEN 8 THEN 'Top ' || num || ' products by revenue'
    WHEN 9 THEN 'Identify anomalies and outliers'
    WHEN 10 THEN 'What are the key insights from this data?'
    WHEN 11 THEN 'Monthly growth rate of sales'
    WHEN 12 THEN 'Show top performers and bottom performers'
    WHEN 13 THEN 'Bottom ' || num || ' regions by profit'
    WHEN 14 THEN 'Median cost per ' || dim
    ELSE 'Sales where channel = ''' || prio || '''' END AS text
  FROM (SELECT o_orderkey AS id, c_mktsegment AS seg, o_orderpriority AS prio,
               CAST(o_orderkey % 9 + 1 AS VARCHAR) AS num,
               CASE CAST(floor(o_orderkey / 16) AS BIGINT) % 4 WHEN 0 THEN 'region' WHEN 1 THEN 'category'
                    WHEN 2 THEN 'segment' ELSE 'channel' END AS dim
        FROM orders JOIN customer ON o_custkey = c_custkey))"""

SALES_ORDER = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey, sales"

# Row positions of `sales`, for the operators that compare early with late rows.
PLACED = f"placed AS (SELECT *, row_number() OVER (ORDER BY {SALES_ORDER}) AS pos, count(*) OVER () AS n FROM sales)"


def title(name: str) -> str:
    return name.replace("_", " ").title()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names_case(column: str, names, make=title) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(n)} THEN {quoted(make(n))}" for n in names) + " END"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def find_column(term: str, columns) -> str:
    """The column-matching rules over the expression `term`."""
    word = f"nullif(lower(trim({term})), '')"
    rules = []
    for c in columns:
        rules.append(f"WHEN {word} = {quoted(c.lower())} THEN {quoted(c)}")
    for c in columns:
        rules.append(f"WHEN contains({quoted(c.lower())}, {word}) OR contains({word}, {quoted(c.lower())}) THEN {quoted(c)}")
    for c in columns:
        words = ", ".join(quoted(w) for w in c.lower().replace("_", " ").split())
        rules.append(f"WHEN {word} IN ({words}) THEN {quoted(c)}")
    for key, listed in SYNONYMS.items():
        hit = next((c for c in columns if key in c.lower()), None)
        if hit:
            rules.append(f"WHEN {word} IN ({', '.join(quoted(w) for w in listed)}) THEN {quoted(hit)}")
    return f"CASE {' '.join(rules)} END"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def group(text: str, pattern: str, index: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, {index}), '')"


def tag_questions(source: str, keys: str, columns) -> str:
    q = "lower(text)"
    first = lambda patterns, make: "CASE " + " ".join(f"WHEN {matches(q, p)} THEN {make(n, p)}" for n, p in patterns.items()) + " END"
    insight = " OR ".join(matches(q, p) for p in INSIGHT_PATTERNS.values())
    return f"""tagged AS (
      SELECT {keys}, text, {insight} AS insight,
        {first(ANALYSIS_PATTERNS, lambda n, p: quoted(n))} AS analysis,
        {first(ANALYSIS_PATTERNS, lambda n, p: group(q, p))} AS analysis_term,
        {first(AGGREGATE_PATTERNS, lambda n, p: quoted(n))} AS agg,
        {first(AGGREGATE_PATTERNS, lambda n, p: group(q, p))} AS agg_term,
        {matches(q, COMPARE_PATTERN)} AS has_compare,
        {group(q, COMPARE_PATTERN)} AS compare1, {group(q, COMPARE_PATTERN, 2)} AS compare2,
        {group(q, ANALYSIS_PATTERNS['correlation'], 2)} AS corr2,
        {group(q, BY_PATTERN)} AS by_term, {group(q, RANKED_PATTERN)} AS ranked_term,
        {group(q, WHERE_PATTERN)} AS where_term, trim({group(q, WHERE_PATTERN, 2)}) AS where_value,
        try_cast({group(q, TOP_PATTERN)} AS INTEGER) AS top_n,
        try_cast({group(q, BOTTOM_PATTERN)} AS INTEGER) AS bottom_n
      FROM {source}),
    ruled AS (
      SELECT *, coalesce(bottom_n, top_n) AS row_limit,
        coalesce(bottom_n, top_n) IS NOT NULL AND by_term IS NOT NULL AS ranked,
        has_compare AND analysis IS NULL AND agg IS NULL AS compare
      FROM tagged),
    answered AS (
      SELECT {keys}, text,
        coalesce(analysis, CASE WHEN insight THEN 'insight' END, CASE WHEN compare THEN 'correlation' END,
                 CASE WHEN ranked OR agg IS NOT NULL THEN 'aggregate' END) AS intent,
        CASE WHEN ranked AND coalesce(agg IN ('max', 'min'), TRUE) THEN 'sum' ELSE agg END AS aggregation,
        {find_column("CASE WHEN ranked THEN by_term WHEN agg_term IS NOT NULL THEN agg_term WHEN compare THEN compare1 ELSE analysis_term END", columns)} AS metric,
        {find_column("CASE WHEN compare THEN compare2 WHEN analysis = 'correlation' THEN corr2 END", columns)} AS metric2,
        {find_column("CASE WHEN ranked THEN ranked_term ELSE by_term END", columns)} AS groupby,
        {find_column("where_term", columns)} AS filter_column, where_value, row_limit,
        CASE WHEN bottom_n IS NOT NULL THEN 'asc' ELSE 'desc' END AS sort_order
      FROM ruled)"""


def question_filters(source: str, keys: str, columns) -> str:
    q = "lower(text)"

    def compared(pattern: str, plain: str) -> str:
        words, signs, values = (f"unnest(regexp_extract_all({q}, {quoted(pattern)}, {g}))" for g in (1, 2, 3))
        return f"""SELECT {keys}, text, word, CASE WHEN sign = '{plain}=' THEN sign ELSE '{plain}' END AS operator, value
          FROM (SELECT {keys}, text, {words} AS word, {signs} AS sign, {values} AS value FROM {source})"""

    return f"""conditions AS (
      SELECT {keys}, text, {group(q, WHERE_PATTERN)} AS word, '=' AS operator, trim({group(q, WHERE_PATTERN, 2)}) AS value
      FROM {source} WHERE {matches(q, WHERE_PATTERN)}
      UNION ALL {compared(GREATER_PATTERN, '>')} UNION ALL {compared(LESS_PATTERN, '<')}),
    answered AS (
      SELECT * FROM (SELECT {keys}, text, {find_column('word', columns)} AS filter_column, operator, value FROM conditions)
      WHERE filter_column IS NOT NULL)"""


def t_p_value(t: str, dof: str, steps: int = 1000) -> str:
    """Share of the t curve beyond |t|, by Simpson's rule in the angle."""
    top = f"least(pi() / 2, 40.0 / sqrt({dof}))"
    start = f"atan(abs({t}) / sqrt({dof}))"

    def area(a: str, b: str) -> str:
        h = f"(({b}) - ({a})) / {steps}"
        cos2 = f"greatest(1 - pow(sin(({a}) + {h} * i), 2), 1e-300)"
        weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
        return f"(list_sum([{weight} * exp(({dof} - 1) * 0.5 * ln({cos2})) for i in range(0, {steps + 1})]) * {h} / 3)"

    return f"CASE WHEN {start} >= {top} THEN 0.0 ELSE {area(start, top)} / {area('0.0', top)} END"
