"""Report parameters of the registered queries (shared by Spark and SQL).

These are the values a user would pass; they select by meaning (dates,
categories, patterns), never by row ids, and every query reads its whole
input tables.
"""

from tally.operators.custom import ReportSort
from tally.operators.filters import ReportFilter, TxnFilter

PNL_FILTER = ReportFilter(start_date="1997-01-01", end_date="1999-12-31")
EXPENSES_ONLY = ReportFilter(max_amount=-0.01)
TOP_N = 3
MERCHANT_TOP_N = 20
TREND_TOP_FILTER = ReportFilter(exclude_categories=["economy"])

FILTERS = {
    "filter_date_range": ReportFilter(start_date="1996-03-15", end_date="1997-06-30"),
    "filter_amount_range": ReportFilter(min_amount=-50000, max_amount=25000.5),
    "filter_expenses_only": EXPENSES_ONLY,
    "filter_categories_in": ReportFilter(categories=["Promo", "SMALL"]),
    "filter_categories_not_in": ReportFilter(exclude_categories=["economy", "LARGE"]),
    "filter_merchants_regex": ReportFilter(merchants=["Supplier#0000000[1-3]", "#00000009"]),
    "filter_merchants_exclude": ReportFilter(exclude_merchants=["[02468]$"]),
    "filter_accounts_in": ReportFilter(accounts=["customer#000000007", "Customer#000000100",
                                                 "CUSTOMER#000001234"]),
    "filter_description": ReportFilter(description_contains="bolt|^red"),
    "filter_notes": ReportFilter(notes_contains="urgent|high"),
    "filter_combined": ReportFilter(start_date="1995-06-01", end_date="2000-06-01",
                                    min_amount=-90000, max_amount=90000,
                                    categories=["promo", "standard", "small", "medium"],
                                    exclude_categories=["small"],
                                    merchants=["supplier#00000"],
                                    exclude_merchants=["7$"],
                                    description_contains="o",
                                    notes_contains="^[1-4]-"),
}

#: Letters of descriptions and what they become, and filters in Python's pattern
#: dialect on the result, each with the same search in the oracle's dialect.
ACCENTS = ("aeou", "áéöü")
ACCENT_FILTERS = {
    "filter_description_accents": ReportFilter(description_contains=r"\b\wÉ\w\b|(?P<my_x>l){2,} \w+t$"),
    "filter_description_not_word": ReportFilter(description_contains=r"^\w{,4}\W(?:[[&&é-ü]|g)"),
}
ACCENT_SQL = {
    "filter_description_accents": r"(?i)(?:^|[^\p{L}\p{N}_])[\p{L}\p{N}_]é[\p{L}\p{N}_](?:$|[^\p{L}\p{N}_])|ll+ [\p{L}\p{N}_]+t$",
    "filter_description_not_word": r"(?i)^[\p{L}\p{N}_]{0,4}[^\p{L}\p{N}_](?:[\[&é-ü]|g)",
}

TXN_FILTERS = {
    "txn_filter_amount": TxnFilter(min_amount=-1000, max_amount=50000),
    "txn_filter_category": TxnFilter(category="promo"),
    "txn_filter_merchant": TxnFilter(merchant="supplier#00000001"),
    "txn_filter_description": TxnFilter(description="red "),
}

#: The test tables hold each of these trigrams in every month, so all files are left there.
STORE_SEARCH = ReportFilter(merchants=["supplier#0+[13]$", "#000000007"], description_contains="^(red|blue) +bolt|widget", notes_contains="urgent|high")
MERCHANT_SUBTOTAL = TxnFilter(merchant="Supplier#00000004")

CUSTOM_FILTER = ReportFilter(min_amount=10000, notes_contains="urgent|high")
CUSTOM_SORT = ReportSort("amount", "desc")

# Four quarters of 1998 plus one range with no transactions.
PERIODS = [
    ("Q1 1998", "1998-01-01", "1998-03-31"),
    ("Q2 1998", "1998-04-01", "1998-06-30"),
    ("Q3 1998", "1998-07-01", "1998-09-30"),
    ("Q4 1998", "1998-10-01", "1998-12-31"),
    ("Empty 2030", "2030-01-01", "2030-12-31"),
]

# Every month of 1992 to 1998, more periods than one wide aggregate takes.
MANY_PERIODS = [(f"{y}-{m:02d}", f"{y}-{m:02d}-01", f"{y}-{m:02d}-28") for y in range(1992, 1999) for m in range(1, 13)] + \
    [("Backwards", "1998-02-01", "1998-01-01"), ("One day", "1995-05-05", "1995-05-05")]
# The list filter of a transactions request, beside a report filter.
REQUEST_ROWS = TxnFilter(category="promo", min_amount=-20000)

ACCOUNT_ID = "Customer#000000042"
AS_OF = "1998-12-31"
LAST_DAYS = 90
LIMIT_ROWS = 100
# Overlapping downloads into a store, the second one twice; the last also brings the rows without a date.
DOWNLOADS = [("1900-01-01", "1995-06-30"), ("1995-01-01", "1997-12-31"), ("1995-01-01", "1997-12-31"), ("1997-06-01", "2100-01-01")]
# Streaming: files arrive in no particular date order in the fixture export,
# so the watermark delay spans the fixture's date range.
STREAM_WATERMARK = "3650 days"
STREAM_FILE_ROWS = 10000
STREAM_TIMEOUT_S = 1800
#: Micro-batches of a backlog at most; it is taken in larger ones beyond that.
STREAM_BATCHES = 16
# Usage scenarios: P&L for chosen categories, and P&L without some categories.
PNL_CATEGORIES = ReportFilter(categories=["promo", "Standard"])
PNL_EXCLUDING = ReportFilter(exclude_categories=["economy", "SMALL"])
