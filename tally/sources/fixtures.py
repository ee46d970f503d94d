"""Transaction fixtures derived from the driver's star schema.

``transactions``      clean records: lineitem joined to orders, customer,
                      part and supplier (inner joins, no rows lost).
``transactions_raw``  the same rows as text with deterministic dirt keyed on
                      ``l_orderkey``, exercising every coercion/null rule.
``ledger``            ``normalize(transactions_raw)``: what a user's ingest
                      of scraped/exported text yields; most reports run on it.

The oracle SQL in ``tally.plans.oracle`` holds the same three definitions
as CTE text for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.operators.joins import prepare_broadcasts, sized_broadcast
from tally.schema import AMOUNT_TYPE, LINEAGE
from tally.sources.tables import read_table

FIXTURE_COLUMNS = LINEAGE + ["date", "amount", "description", "merchant",
                             "category", "account", "notes"]

# Fixture *plans* per session and folder: DataFrames are immutable lazy plans,
# and building one costs hundreds of eagerly analysed py4j calls (~0.5 s), so
# reports reuse the same plan object. No data is cached by this.
_PLANS: dict = {}


def _memo(kind: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    from tally.session import app_key
    key = (kind, id(spark), app_key(spark), sf_dir.rstrip("/"))
    df = _PLANS.get(key)
    if df is None:
        df = _PLANS[key] = build()
    return df


def clear_plans() -> None:
    _PLANS.clear()


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("transactions", spark, sf_dir, lambda: _transactions(spark, sf_dir))


def _transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean transactions (typed).

    Join order: orders ⋈ customer first, so the wide fact table is joined
    on l_orderkey once; part and supplier are joined on their own keys.
    Each dimension side is broadcast only after ``sized_broadcast`` measured
    it under the byte bound; otherwise the planner keeps shuffle joins (the case at large scale
    factors) and AQE may still switch at runtime.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey",
                    "l_suppkey", "l_linenumber", "l_extendedprice",
                    "l_returnflag", "l_shipdate")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey",
                   "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    tag = sf_dir.rstrip("/")
    oc = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderpriority", "c_name")
    prepare_broadcasts([(f"{tag}|orders*customer", oc, [o, c]), (f"{tag}|part", p, None),
                        (f"{tag}|supplier", s, None)])
    oc = sized_broadcast(oc, f"{tag}|orders*customer", [o, c])
    p = sized_broadcast(p, f"{tag}|part")
    s = sized_broadcast(s, f"{tag}|supplier")
    j = (li.join(oc, li.l_orderkey == oc.o_orderkey)
           .join(p, li.l_partkey == p.p_partkey)
           .join(s, li.l_suppkey == s.s_suppkey))
    signed = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")) \
              .otherwise(-F.col("l_extendedprice"))
    return j.select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("date"),
        signed.cast(AMOUNT_TYPE).alias("amount"),
        F.col("p_name").alias("description"),
        F.col("s_name").alias("merchant"),
        F.col("p_type").alias("category"),
        F.col("c_name").alias("account"),
        F.col("o_orderpriority").alias("notes"),
    )


def _mod(k: Column, m: int) -> Column:
    return (k % m) == 0


def dirty(df: DataFrame) -> DataFrame:
    """Turn clean records into text records with deterministic dirt.

    Fixed rules (first rule that hits a column wins, in this order):
    mod 29 date 'junk'; mod 23 amount '$12.50'; mod 31 amount null;
    mod 13 amount '0.00'; mod 17 category null; mod 19 merchant null;
    mod 37 category ''; mod 2 category lower case.
    """
    k = F.col("l_orderkey")
    date_txt = F.when(_mod(k, 29), F.lit("junk")) \
                .otherwise(F.date_format("date", "yyyy-MM-dd"))
    amount_txt = (F.when(_mod(k, 23), F.lit("$12.50"))
                   .when(_mod(k, 31), F.lit(None).cast("string"))
                   .when(_mod(k, 13), F.lit("0.00"))
                   .otherwise(F.col("amount").cast("string")))
    category = (F.when(_mod(k, 17), F.lit(None).cast("string"))
                 .when(_mod(k, 37), F.lit(""))
                 .when(_mod(k, 2), F.lower("category"))
                 .otherwise(F.col("category")))
    merchant = F.when(_mod(k, 19), F.lit(None).cast("string")).otherwise(F.col("merchant"))
    return df.select(
        "l_orderkey", "l_linenumber",
        date_txt.alias("date"), amount_txt.alias("amount"),
        "description", merchant.alias("merchant"), category.alias("category"),
        "account", "notes",
    )


def transactions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("raw", spark, sf_dir, lambda: dirty(transactions(spark, sf_dir)))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized transactions as ingest produces them from text."""
    from tally.sources.ingest import normalize
    return _memo("ledger", spark, sf_dir, lambda: normalize(transactions_raw(spark, sf_dir)))
