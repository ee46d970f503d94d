"""Column names and types of the transaction and account records."""

from pyspark.sql import types as T

# Amounts are exact money: sums do not depend on task order.
AMOUNT_TYPE = T.DecimalType(18, 2)

# The seven scraped fields of a transaction record, in record order.
TXN_FIELDS = ["date", "description", "amount", "category", "account",
              "merchant", "notes"]
TEXT_FIELDS = ["description", "category", "account", "merchant", "notes"]
DATE_FIELDS = ["date", "postedDate", "transactionDate"]

TXN_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", AMOUNT_TYPE),
    T.StructField("category", T.StringType()),
    T.StructField("account", T.StringType()),
    T.StructField("merchant", T.StringType()),
    T.StructField("notes", T.StringType()),
])

# Text form, as scraped or read from CSV/JSON before coercion.
RAW_TXN_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in TXN_FIELDS])

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("balance", T.DoubleType()),
])

# Fixture lineage columns carried along every fixture row (not a key).
LINEAGE = ["l_orderkey", "l_linenumber"]
