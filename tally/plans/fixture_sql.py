"""The fixtures of ``tally.sources.fixtures`` as DuckDB CTE text.

The oracle has only the driver's base tables as views, so every oracle
query inlines these definitions. They are written independently of the
Spark code (plain SQL joins and CASE expressions) and must stay
semantically equal to it.
"""

TXN_CTE = """txn AS (
  SELECT l.l_orderkey, l.l_linenumber,
         l.l_shipdate AS date,
         CAST(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice
                   ELSE -l.l_extendedprice END AS DECIMAL(18,2)) AS amount,
         p.p_name AS description, s.s_name AS merchant, p.p_type AS category,
         c.c_name AS account, o.o_orderpriority AS notes
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

RAW_CTE = TXN_CTE + """,
raw AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_orderkey % 29 = 0 THEN 'junk' ELSE strftime(date, '%Y-%m-%d') END AS date,
         CASE WHEN l_orderkey % 23 = 0 THEN '$12.50'
              WHEN l_orderkey % 31 = 0 THEN NULL
              WHEN l_orderkey % 13 = 0 THEN '0.00'
              ELSE CAST(amount AS VARCHAR) END AS amount,
         description,
         CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE merchant END AS merchant,
         CASE WHEN l_orderkey % 17 = 0 THEN NULL
              WHEN l_orderkey % 37 = 0 THEN ''
              WHEN l_orderkey % 2 = 0 THEN lower(category)
              ELSE category END AS category,
         account, notes
  FROM txn
)"""

LEDGER_CTE = RAW_CTE + r""",
ledger AS (
  SELECT l_orderkey, l_linenumber,
         CAST(try_strptime(date, '%Y-%m-%d') AS TIMESTAMP) AS date,
         description,
         CASE WHEN regexp_full_match(amount, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
              THEN TRY_CAST(trim(amount) AS DECIMAL(18,2)) END AS amount,
         category, account, merchant, notes
  FROM raw
)"""


def with_txn(body: str) -> str:
    return f"WITH {TXN_CTE}\n{body}"


def with_raw(body: str) -> str:
    return f"WITH {RAW_CTE}\n{body}"


def with_ledger(body: str, *more_ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in more_ctes)
    return f"WITH {LEDGER_CTE}{extra}\n{body}"
