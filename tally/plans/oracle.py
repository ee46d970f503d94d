"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each entry re-states a query's meaning in plain SQL over the driver's
tables: fixture CTEs from ``fixture_sql``, FILTER-ed aggregates, window
functions. Money is summed as DECIMAL and cast to DOUBLE at the end, the
same as the Spark plans, so results compare exactly.
"""

from __future__ import annotations

from tally.operators.filters import ReportFilter, TxnFilter
from tally.plans import params as P
from tally.plans.fixture_sql import with_ledger

PERIOD_SQL = {
    "daily": "strftime(date, '%Y-%m-%d')",
    "weekly": ("strftime(date_trunc('week', date), '%Y-%m-%d') || '/' || "
               "strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d')"),
    "monthly": "strftime(date, '%Y-%m')",
    "quarterly": "CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR)",
    "yearly": "strftime(date, '%Y')",
}

INC = "COALESCE(SUM(amount) FILTER (WHERE amount > 0), 0)"
EXP = "abs(COALESCE(SUM(amount) FILTER (WHERE amount < 0), 0))"
ROW_COLS = ("l_orderkey, l_linenumber, date, CAST(amount AS DOUBLE) AS amount, "
            "description, merchant, category, account, notes")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ts(d: str) -> str:
    return f"TIMESTAMP '{d} 00:00:00'"


def rx(col: str, pattern: str) -> str:
    return f"COALESCE(regexp_matches({col}, {q('(?i)(?:' + pattern + ')')}), false)"


def in_list(col: str, values) -> str:
    return f"lower({col}) IN ({', '.join(q(v.lower()) for v in values)})"


def filter_where(f: ReportFilter | None) -> str:
    if f is None:
        return "TRUE"
    w = []
    if f.start_date:
        w.append(f"date >= {ts(f.start_date)}")
    if f.end_date:
        w.append(f"date < {ts(f.end_date)} + INTERVAL 1 DAY" if f.end_inclusive_day
                 else f"date <= {ts(f.end_date)}")
    if f.min_amount is not None:
        w.append(f"amount >= {f.min_amount!s}")
    if f.max_amount is not None:
        w.append(f"amount <= {f.max_amount!s}")
    if f.categories:
        w.append(in_list("category", f.categories))
    if f.exclude_categories:
        w.append(f"NOT COALESCE({in_list('category', f.exclude_categories)}, false)")
    if f.merchants:
        w.append(rx("merchant", "|".join(f.merchants)))
    if f.exclude_merchants:
        w.append(f"NOT {rx('merchant', '|'.join(f.exclude_merchants))}")
    if f.accounts:
        w.append(in_list("account", f.accounts))
    if f.description_contains:
        w.append(rx("description", f.description_contains))
    if f.notes_contains:
        w.append(rx("notes", f.notes_contains))
    return " AND ".join(w) if w else "TRUE"


def txn_where(f: TxnFilter) -> str:
    w = []
    if f.min_amount is not None:
        w.append(f"COALESCE(amount, 0) >= {f.min_amount!s}")
    if f.max_amount is not None:
        w.append(f"COALESCE(amount, 0) <= {f.max_amount!s}")
    if f.category:
        w.append(f"lower(COALESCE(category, '')) = {q(f.category.lower())}")
    if f.merchant:
        w.append(f"contains(lower(COALESCE(merchant, '')), {q(f.merchant.lower())})")
    if f.description:
        w.append(f"contains(lower(COALESCE(description, '')), {q(f.description.lower())})")
    return " AND ".join(w) if w else "TRUE"


def filtered(f: ReportFilter | None) -> str:
    return f"filtered AS (SELECT * FROM ledger WHERE {filter_where(f)})"


# ---------------------------------------------------------------- reports

def cash_flow_sql(grouping: str) -> str:
    return with_ledger(f"""
SELECT period,
       CAST(inflow AS DOUBLE) AS inflow,
       CAST(outflow AS DOUBLE) AS outflow,
       CAST(inflow - outflow AS DOUBLE) AS net_flow,
       CAST(SUM(inflow - outflow) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING
                                        AND CURRENT ROW) AS DOUBLE) AS running_balance,
       transaction_count
FROM (SELECT {PERIOD_SQL[grouping]} AS period, {INC} AS inflow, {EXP} AS outflow,
             COUNT(*) AS transaction_count
      FROM ledger WHERE date IS NOT NULL GROUP BY 1) per""")


def cash_flow_totals_sql(grouping: str) -> str:
    return with_ledger(f"""
SELECT {q(grouping)} AS grouping,
       COALESCE(min(period) || ' to ' || max(period), '') AS period,
       CAST(COALESCE(SUM(inflow), 0) AS DOUBLE) AS total_inflow,
       CAST(COALESCE(SUM(outflow), 0) AS DOUBLE) AS total_outflow,
       CAST(COALESCE(SUM(inflow), 0) - COALESCE(SUM(outflow), 0) AS DOUBLE) AS net_cash_flow,
       COUNT(*) AS period_count, (SELECT COUNT(*) FROM ledger WHERE date IS NULL) AS undated_count
FROM (SELECT {PERIOD_SQL[grouping]} AS period, {INC} AS inflow, {EXP} AS outflow
      FROM ledger WHERE date IS NOT NULL GROUP BY 1) per""")


def trend_sql(grouping: str, f: ReportFilter | None = None, cols: str | None = None) -> str:
    cols = cols or ("period, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses, "
                    "CAST(income - expenses AS DOUBLE) AS net, transaction_count, top_expense_category")
    return with_ledger(f"""
SELECT {cols}
FROM (SELECT {PERIOD_SQL[grouping]} AS period, {INC} AS income, {EXP} AS expenses,
             COUNT(*) AS transaction_count
      FROM filtered WHERE date IS NOT NULL GROUP BY 1) t
LEFT JOIN (
  SELECT period, category AS top_expense_category FROM (
    SELECT period, category,
           row_number() OVER (PARTITION BY period ORDER BY s ASC, category ASC) AS rn
    FROM (SELECT {PERIOD_SQL[grouping]} AS period, category, SUM(amount) AS s
          FROM filtered WHERE date IS NOT NULL AND amount < 0 AND category IS NOT NULL
          GROUP BY 1, 2) pc) r
  WHERE rn = 1) top USING (period)""", filtered(f))


def pnl_totals_sql(f: ReportFilter) -> str:
    from tally.functions.periods import period_description
    return with_ledger(f"""
SELECT {q(period_description(f.start_date, f.end_date))} AS period,
       CAST({INC} AS DOUBLE) AS total_income,
       CAST({EXP} AS DOUBLE) AS total_expenses,
       CAST({INC} - {EXP} AS DOUBLE) AS net_income,
       COUNT(*) AS transaction_count,
       COUNT(*) FILTER (WHERE amount > 0) AS income_transaction_count,
       COUNT(*) FILTER (WHERE amount < 0) AS expense_transaction_count
FROM filtered""", filtered(f))


def pnl_side_sql(f: ReportFilter, side: str) -> str:
    cond = "amount > 0" if side == "income" else "amount < 0"
    share = "percentage_of_income" if side == "income" else "percentage_of_expenses"
    return with_ledger(f"""
SELECT category, CAST(abs(s) AS DOUBLE) AS total, n AS count,
       abs(CAST(s AS DOUBLE) / n) AS average,
       CASE WHEN abs(tot) > 0 THEN abs(CAST(s AS DOUBLE)) / abs(CAST(tot AS DOUBLE)) * 100.0
            ELSE 0.0 END AS {share}
FROM (SELECT category, SUM(amount) AS s, COUNT(amount) AS n,
             SUM(SUM(amount)) OVER () AS tot
      FROM filtered WHERE {cond} GROUP BY category) g
WHERE category IS NOT NULL""", filtered(f))


STD = ("CASE WHEN n > 1 THEN sqrt(CAST(CAST(CAST(n AS DECIMAL(38,0)) * sq - s * s AS VARCHAR) AS DOUBLE)"
       " / (CAST(n AS DOUBLE) * CAST(n - 1 AS DOUBLE))) END")


def category_sql(f: ReportFilter | None, top_n: int | None) -> str:
    lim = f"QUALIFY row_number() OVER (ORDER BY s DESC, category ASC) <= {top_n}" if top_n else ""
    return with_ledger(f"""
SELECT category, CAST(s AS DOUBLE) AS total, n AS count,
       CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n END AS average,
       CAST(mn AS DOUBLE) AS min, CAST(mx AS DOUBLE) AS max,
       COALESCE({STD}, 0.0) AS std_dev,
       CASE WHEN g <> 0 THEN abs(CAST(s AS DOUBLE)) / abs(CAST(g AS DOUBLE)) * 100.0
            ELSE 0.0 END AS percentage_of_total
FROM (SELECT category, COALESCE(SUM(amount), 0) AS s, COUNT(amount) AS n,
             MIN(amount) AS mn, MAX(amount) AS mx, SUM(amount * amount) AS sq,
             SUM(COALESCE(SUM(amount), 0)) OVER () AS g
      FROM filtered GROUP BY category) c
WHERE category IS NOT NULL
{lim}""", filtered(f))


def category_totals_sql(f: ReportFilter | None, top_n: int | None) -> str:
    cnt = f"least(COUNT(DISTINCT category), {top_n})" if top_n else "COUNT(DISTINCT category)"
    return with_ledger(f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount, {cnt} AS category_count
FROM filtered""", filtered(f))


MODE_CTE = """modes AS (
  SELECT merchant, category AS primary_category FROM (
    SELECT merchant, category,
           row_number() OVER (PARTITION BY merchant ORDER BY COUNT(*) DESC, category ASC) AS rn
    FROM filtered WHERE merchant IS NOT NULL AND category IS NOT NULL
    GROUP BY merchant, category) x WHERE rn = 1)"""


def merchant_sql(f: ReportFilter | None, top_n: int | None) -> str:
    lim = f"QUALIFY row_number() OVER (ORDER BY abs(s) DESC, merchant ASC) <= {top_n}" if top_n else ""
    return with_ledger(f"""
SELECT m.merchant, CAST(s AS DOUBLE) AS total, n AS count,
       CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n END AS average,
       COALESCE(primary_category, '') AS primary_category,
       CASE WHEN g <> 0 THEN abs(CAST(s AS DOUBLE)) / abs(CAST(g AS DOUBLE)) * 100.0
            ELSE 0.0 END AS percentage_of_total
FROM (SELECT merchant, COALESCE(SUM(amount), 0) AS s, COUNT(amount) AS n,
             SUM(COALESCE(SUM(amount), 0)) OVER () AS g
      FROM filtered GROUP BY merchant) m
LEFT JOIN modes USING (merchant)
WHERE m.merchant IS NOT NULL
{lim}""", filtered(f), MODE_CTE)


def merchant_mode_sql() -> str:
    return with_ledger("""
SELECT d.merchant, COALESCE(primary_category, '') AS primary_category
FROM (SELECT DISTINCT merchant FROM filtered WHERE merchant IS NOT NULL) d
LEFT JOIN modes USING (merchant)""", filtered(None), MODE_CTE)


def account_sql(f: ReportFilter | None) -> str:
    return with_ledger(f"""
SELECT account, CAST(inc AS DOUBLE) AS income, CAST(exp AS DOUBLE) AS expenses,
       CAST(inc - exp AS DOUBLE) AS balance_change, transaction_count
FROM (SELECT account, {INC} AS inc, {EXP} AS exp, COUNT(*) AS transaction_count
      FROM filtered WHERE account IS NOT NULL GROUP BY account) a""", filtered(f))


def account_total_sql(f: ReportFilter | None) -> str:
    return with_ledger(f"""
SELECT CAST(COALESCE(SUM(inc - exp), 0) AS DOUBLE) AS total_balance_change,
       COUNT(*) AS account_count
FROM (SELECT account, {INC} AS inc, {EXP} AS exp
      FROM filtered WHERE account IS NOT NULL GROUP BY account) a""", filtered(f))


def custom_group_sql(f: ReportFilter | None, key: str) -> str:
    return with_ledger(f"""
SELECT {key}, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total, COUNT(amount) AS count,
       CASE WHEN COUNT(amount) > 0 THEN CAST(SUM(amount) AS DOUBLE) / COUNT(amount) END AS average,
       CAST(MIN(amount) AS DOUBLE) AS min, CAST(MAX(amount) AS DOUBLE) AS max
FROM filtered WHERE {key} IS NOT NULL GROUP BY {key}""", filtered(f))


def custom_totals_sql(f: ReportFilter | None) -> str:
    return with_ledger("""
SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
FROM filtered""", filtered(f))


def rows_sql(f: ReportFilter | None) -> str:
    return with_ledger(f"SELECT {ROW_COLS} FROM filtered", filtered(f))


def txn_rows_sql(f: TxnFilter) -> str:
    return with_ledger(f"SELECT {ROW_COLS} FROM ledger WHERE {txn_where(f)}")


def period_comparison_sql(periods) -> str:
    vals = ", ".join(f"({q(l)}, {q(s)}, {q(e)}, {ts(s)}, {ts(e)})" for l, s, e in periods)
    return with_ledger(f"""
SELECT p.label AS period, p.start_date, p.end_date,
       CAST({INC} AS DOUBLE) AS income, CAST({EXP} AS DOUBLE) AS expenses,
       CAST({INC} - {EXP} AS DOUBLE) AS net_income
FROM (VALUES {vals}) p(label, start_date, end_date, s_ts, e_ts)
LEFT JOIN ledger ON ledger.date >= p.s_ts AND ledger.date <= p.e_ts
GROUP BY p.label, p.start_date, p.end_date""")


def _interp(pct: float) -> str:
    """Exact percentile with linear interpolation between the values at
    floor/ceil of (n-1)·p, written as (hi-pos)·lo + (pos-lo)·hi."""
    return f"""(SELECT CASE WHEN ceil(pos) = floor(pos) OR xl = xh THEN xl
                     ELSE (ceil(pos) - pos) * xl + (pos - floor(pos)) * xh END
           FROM (SELECT pos,
                   (SELECT x FROM ranked WHERE i = CAST(floor(pos) AS BIGINT)) AS xl,
                   (SELECT x FROM ranked WHERE i = CAST(ceil(pos) AS BIGINT)) AS xh
                 FROM (SELECT CAST(n - 1 AS DOUBLE) * CAST({pct!r} AS DOUBLE) AS pos
                       FROM (SELECT COUNT(*) AS n FROM ranked) c) p) z)"""


RANKED_CTE = """ranked AS (
  SELECT CAST(amount AS DOUBLE) AS x, row_number() OVER (ORDER BY amount) - 1 AS i
  FROM ledger WHERE amount IS NOT NULL)"""


def summary_sql(where: str = "TRUE") -> str:
    return with_ledger(f"""
SELECT COUNT(*) AS total_transactions,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount,
       CASE WHEN COUNT(amount) > 0 THEN CAST(SUM(amount) AS DOUBLE) / COUNT(amount) END AS average_amount,
       CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount,
       {_interp(0.5)} AS median_amount
FROM ledger WHERE {where}""", RANKED_CTE.replace("amount IS NOT NULL", f"amount IS NOT NULL AND {where}"))


def describe_sql() -> str:
    return with_ledger(f"""
SELECT n AS count, CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n END AS mean,
       {STD} AS std, CAST(mn AS DOUBLE) AS min,
       {_interp(0.25)} AS p25, {_interp(0.5)} AS p50, {_interp(0.75)} AS p75,
       CAST(mx AS DOUBLE) AS max
FROM (SELECT COUNT(amount) AS n, SUM(amount) AS s, SUM(amount * amount) AS sq,
             MIN(amount) AS mn, MAX(amount) AS mx FROM ledger) a""", RANKED_CTE)


def summary_by_category_sql(limit: int | None = None) -> str:
    lim = f"QUALIFY row_number() OVER (ORDER BY total DESC, category ASC) <= {limit}" if limit else ""
    return with_ledger(f"""
SELECT category, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total, COUNT(*) AS count
FROM ledger WHERE category IS NOT NULL GROUP BY category
{lim}""")


def merchant_subtotal_sql(f: TxnFilter) -> str:
    return with_ledger(f"""
SELECT {q(f.merchant)} AS merchant_filter,
       CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total, COUNT(*) AS transaction_count
FROM ledger WHERE {txn_where(f)}""")


NUM = r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*"
ORDERED_ROWS = ("l_orderkey, l_linenumber, amount, description, merchant, category, account, notes")


def cur(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', {x}))"


def over(sql: str) -> str:
    """A full query (with its own WITH) as a derived table."""
    return f"({sql}) t"


# Ledger rows at an hour of their day; with amounts in ten-thousandths; difficult descriptions.
TIMED = "(SELECT * REPLACE (date + to_hours(l_orderkey % 24) AS date) FROM ledger)"
FINE = "(SELECT * REPLACE (CAST(amount * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,4)) AS amount) FROM ledger)"
DIFFICULT = """CASE l_orderkey % 8 WHEN 0 THEN 'He said "' || description || '", ok'
  WHEN 1 THEN description || chr(10) || 'second line' WHEN 2 THEN '  ' || description || ' '
  WHEN 3 THEN '\\N' WHEN 4 THEN '' WHEN 5 THEN 'back\\slash\\' WHEN 6 THEN NULL
  ELSE description || chr(13) || chr(10) END"""


def more_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    rows = rows_sql(None)
    sql["stream_cash_flow_daily"] = cash_flow_sql("daily")
    sql["store_pnl_totals"] = pnl_totals_sql(P.PNL_FILTER)
    sql["render_pnl_totals"] = f"""
SELECT 'Period: ' || period AS period_line,
       '  Total Income:    ' || {cur('total_income')} AS income_line,
       '  Total Expenses:  ' || {cur('total_expenses')} AS expense_line,
       CASE WHEN net_income >= 0 THEN 'NET INCOME' ELSE 'NET LOSS' END || ':       '
         || {cur('abs(net_income)')} AS net_line
FROM {over(pnl_totals_sql(P.PNL_FILTER))}"""
    sql["store_period_comparison"] = period_comparison_sql(P.PERIODS)
    sql["store_search_text"] = rows_sql(P.STORE_SEARCH)
    sql["store_merge_downloads"] = with_ledger("""
SELECT date, CAST(amount AS DOUBLE) AS amount, description, merchant, category, account, notes
FROM ledger, (VALUES (0), (1), (2)) c(copy) WHERE copy <= l_linenumber % 3""")
    sql["store_filter_categories"] = rows_sql(P.FILTERS["filter_categories_in"])
    sql["custom_group_absent_column"] = rows_sql(P.CUSTOM_FILTER)
    sql["period_comparison_many"] = period_comparison_sql(P.MANY_PERIODS).replace(
        "LEFT JOIN ledger ON ledger.date >= p.s_ts AND ledger.date <= p.e_ts",
        f"LEFT JOIN {TIMED} x ON x.date >= p.s_ts AND x.date <= p.e_ts")
    sql["spec_last_days_pnl"] = pnl_totals_sql(ReportFilter()).replace(
        "SELECT * FROM ledger WHERE TRUE",
        f"SELECT * FROM {TIMED} x WHERE date >= {ts(P.AS_OF)} - INTERVAL {P.LAST_DAYS} DAY AND date < {ts(P.AS_OF)} + INTERVAL 1 DAY")
    sql["txn_request_summary"] = summary_sql(f"({filter_where(P.EXPENSES_ONLY)}) AND ({txn_where(P.REQUEST_ROWS)})")
    unit = "CAST(amount * 10000 AS HUGEINT)"  # squares of four decimals are summed as integers
    sql["amount_describe_scale4"] = describe_sql().replace("FROM ledger", f"FROM {FINE} y").replace(
        STD, STD.replace("CAST(n AS DECIMAL(38,0)) * sq - s * s", "n * usq - us * us").replace(" END", " / 10000.0 END")).replace(
        "SUM(amount * amount) AS sq", f"SUM({unit} * {unit}) AS usq, SUM({unit}) AS us")
    sql["csv_difficult_text"] = sql["json_difficult_text"] = with_ledger(
        f"SELECT {ROW_COLS.replace('description', DIFFICULT + ' AS description')} FROM ledger")
    sql["json_array_ingest"] = rows
    for name, pattern in P.ACCENT_SQL.items():
        accented = f"translate(description, {q(P.ACCENTS[0])}, {q(P.ACCENTS[1])})"
        sql[name] = with_ledger(f"""
SELECT {ROW_COLS} FROM (SELECT * REPLACE ({accented} AS description) FROM ledger)
WHERE COALESCE(regexp_matches(description, {q(pattern)}), false)""")
    sql["report_json_document"] = f"""
SELECT 'Cash Flow' AS report_type, 'quarterly' AS grouping, t.period AS whole_period,
       t.total_inflow, t.total_outflow, t.net_cash_flow, p.*
FROM ({cash_flow_totals_sql('quarterly')}) t, ({cash_flow_sql('quarterly')}) p"""
    sql["ingest_normalize"] = rows
    sql["csv_roundtrip"] = rows
    sql["json_roundtrip"] = rows
    sql["ingest_coerce_dates"] = with_ledger("""
SELECT l_orderkey, l_linenumber, date AS date_text,
       CAST(try_strptime(date, '%Y-%m-%d') AS TIMESTAMP) AS date FROM raw""")
    sql["ingest_coerce_amounts"] = with_ledger(f"""
SELECT l_orderkey, l_linenumber, amount AS amount_text,
       CAST(CASE WHEN regexp_full_match(amount, '{NUM}')
                 THEN TRY_CAST(trim(amount) AS DECIMAL(18,2)) END AS DOUBLE) AS amount FROM raw""")
    sql["parse_currency_text"] = with_ledger(f"""
SELECT l_orderkey, l_linenumber, amount_text,
       CAST(COALESCE(CASE WHEN regexp_full_match(c, '{NUM}') THEN TRY_CAST(c AS DECIMAL(18,2)) END, 0)
            AS DOUBLE) AS amount
FROM (SELECT l_orderkey, l_linenumber, amount AS amount_text,
             trim(replace(replace(amount, '$', ''), ',', '')) AS c FROM raw) r""")
    sql["html_extract_transactions"] = with_ledger("""
SELECT l_orderkey AS page_id, date, CAST(amount AS DOUBLE) AS amount, description,
       description AS merchant, category, '' AS account, '' AS notes FROM txn""")
    sql["html_extract_accounts"] = """
SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS page_id, c_name AS name,
       CAST(c_custkey AS VARCHAR) AS id, CAST(0 AS DOUBLE) AS balance FROM customer"""
    sql["list_accounts"] = with_ledger("""
SELECT account, COUNT(*) AS transaction_count, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_amount
FROM ledger WHERE account IS NOT NULL GROUP BY account""")
    sql["list_categories"] = with_ledger(
        "SELECT DISTINCT category FROM ledger WHERE category IS NOT NULL")
    sql["acquire_last_n_days"] = with_ledger(f"""
SELECT {ROW_COLS} FROM ledger
WHERE date >= DATE '{P.AS_OF}' - INTERVAL {P.LAST_DAYS} DAY AND date < DATE '{P.AS_OF}' + INTERVAL 1 DAY""")
    sql["store_acquire"] = sql["acquire_last_n_days"]
    sql["acquire_default_ytd"] = with_ledger(f"""
SELECT {ROW_COLS} FROM ledger
WHERE date >= make_date(year(DATE '{P.AS_OF}'), 1, 1) AND date < DATE '{P.AS_OF}' + INTERVAL 1 DAY""")
    sql["acquire_by_account"] = with_ledger(
        f"SELECT {ROW_COLS} FROM ledger WHERE account = {q(P.ACCOUNT_ID)}")
    asc = ", ".join(f"{c} ASC NULLS LAST" for c in ORDERED_ROWS.split(", "))
    sql["preview_head"] = with_ledger(
        f"SELECT {ROW_COLS} FROM ledger ORDER BY date ASC NULLS LAST, {asc} LIMIT 5")
    rest = ", ".join(f"{c} ASC NULLS LAST" for c in ORDERED_ROWS.split(", ") if c != "amount")
    sql["limit_rows"] = with_ledger(
        f"SELECT {ROW_COLS} FROM ledger ORDER BY date DESC NULLS LAST, amount DESC NULLS LAST, {rest} "
        f"LIMIT {P.LIMIT_ROWS}")
    labels = ", ".join(f"{e} AS {g}" for g, e in PERIOD_SQL.items())
    sql["period_labels"] = with_ledger(
        f"SELECT date, {labels} FROM (SELECT DISTINCT date FROM ledger WHERE date IS NOT NULL) d")
    sql["format_currency"] = f"""
SELECT category, format('{{:<25}} {{:>15}} {{:>8}} {{:>15}} {{:>15}} {{:>15}} {{:>7.1f}}%', category,
       {cur('total')}, count, {cur('average')}, {cur('min')}, {cur('max')}, percentage_of_total) AS line
FROM {over(category_sql(None, None))}"""
    sql["render_cash_flow_lines"] = f"""
SELECT period, format('{{:<15}} {{:>15}} {{:>15}} {{:>15}} {{:>20}}', period, {cur('inflow')},
       {cur('outflow')}, {cur('net_flow')}, {cur('running_balance')}) AS line
FROM {over(cash_flow_sql('monthly'))}"""
    sql["render_pnl_lines"] = f"""
SELECT 'income' AS section, category,
       '    ' || format('{{:30}} {{:>15}} ({{:.1f}}%)', category, {cur('total')}, percentage_of_income) AS line
FROM {over(pnl_side_sql(P.PNL_FILTER, 'income'))}
UNION ALL
SELECT 'expenses' AS section, category,
       '    ' || format('{{:30}} {{:>15}} ({{:.1f}}%)', category, {cur('total')}, percentage_of_expenses) AS line
FROM ({pnl_side_sql(P.PNL_FILTER, 'expense')}) t2"""
    sql["render_merchant_lines"] = f"""
SELECT merchant, format('{{:<30}} {{:>15}} {{:>8}} {{:>15}} {{:<20}} {{:>7.1f}}%', left(merchant, 30),
       {cur('total')}, count, {cur('average')}, left(primary_category, 20), percentage_of_total) AS line
FROM {over(merchant_sql(None, P.MERCHANT_TOP_N))}"""
    sql["render_trend_lines"] = f"""
SELECT period, format('{{:<15}} {{:>15}} {{:>15}} {{:>15}} {{:>8}} {{:<25}}', period, {cur('income')},
       {cur('expenses')}, {cur('net')}, transaction_count,
       left(COALESCE(top_expense_category, 'N/A'), 25)) AS line
FROM {over(trend_sql('monthly', P.TREND_TOP_FILTER))}"""
    sql["render_account_lines"] = f"""
SELECT account, format('{{:<30}} {{:>15}} {{:>15}} {{:>15}} {{:>8}}', left(account, 30), {cur('income')},
       {cur('expenses')}, {cur('balance_change')}, transaction_count) AS line
FROM {over(account_sql(None))}"""
    sql["row_quality_split"] = with_ledger("""
SELECT CASE WHEN reason IS NULL THEN 'valid' ELSE 'quarantine' END AS quality, reason, COUNT(*) AS rows
FROM (SELECT CASE WHEN date IS NULL THEN 'date_missing'
                  WHEN amount IS NULL THEN 'amount_missing'
                  WHEN abs(amount) > 1000000000 THEN 'amount_range'
                  WHEN length(description) > 500 OR length(category) > 500 OR length(account) > 500
                       OR length(merchant) > 500 OR length(notes) > 500 THEN 'text_too_long'
             END AS reason FROM ledger) r
GROUP BY 1, 2""")
    return sql


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    for g in PERIOD_SQL:
        sql[f"cash_flow_{g}"] = cash_flow_sql(g)
        sql[f"trend_{g}"] = trend_sql(g)
    sql["cash_flow_totals"] = cash_flow_totals_sql("monthly")
    sql["trend_top_category"] = trend_sql("quarterly", P.TREND_TOP_FILTER,
                                          "period, top_expense_category")
    sql["pnl_totals"] = pnl_totals_sql(P.PNL_FILTER)
    sql["pnl_income_by_category"] = pnl_side_sql(P.PNL_FILTER, "income")
    sql["pnl_expenses_by_category"] = pnl_side_sql(P.PNL_FILTER, "expense")
    sql["pnl_selected_categories"] = pnl_totals_sql(P.PNL_CATEGORIES)
    sql["pnl_excluding_categories"] = pnl_totals_sql(P.PNL_EXCLUDING)
    sql["category_analysis"] = category_sql(None, None)
    sql["category_analysis_top_n"] = category_sql(P.EXPENSES_ONLY, P.TOP_N)
    sql["category_analysis_totals"] = category_totals_sql(P.EXPENSES_ONLY, P.TOP_N)
    sql["merchant_analysis"] = merchant_sql(None, P.MERCHANT_TOP_N)
    sql["merchant_analysis_all"] = sql["report_json_parts"] = merchant_sql(None, None)
    sql["merchant_primary_category"] = merchant_mode_sql()
    sql["account_summary"] = account_sql(None)
    sql["account_summary_total"] = account_total_sql(None)
    for key in ("category", "merchant", "account"):
        sql[f"custom_group_by_{key}"] = custom_group_sql(P.CUSTOM_FILTER, key)
    sql["custom_rows_sorted"] = rows_sql(P.CUSTOM_FILTER)
    sql["custom_totals"] = custom_totals_sql(P.CUSTOM_FILTER)
    sql["period_comparison"] = period_comparison_sql(P.PERIODS)
    sql["summary_stats"] = summary_sql()
    sql["summary_by_category"] = summary_by_category_sql()
    sql["summary_top_categories"] = summary_by_category_sql(5)
    sql["amount_describe"] = describe_sql()
    sql["merchant_subtotal"] = merchant_subtotal_sql(P.MERCHANT_SUBTOTAL)
    for name, f in P.FILTERS.items():
        sql[name] = rows_sql(f)
    for name, f in P.TXN_FILTERS.items():
        sql[name] = txn_rows_sql(f)
    sql.update(more_sql())
    return sql
