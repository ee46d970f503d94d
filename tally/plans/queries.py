"""Named queries: one per operator of the inventory, each (spark, sf_dir) → DataFrame.

Every query reads the driver's tables (through the fixtures) over their
whole extent; parameters are the report parameters a user would pass
(``tally.plans.params``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.functions.periods import GROUPINGS
from tally.operators.account import account_summary
from tally.operators.cash_flow import cash_flow
from tally.operators.category import category_analysis
from tally.operators.compare import period_comparison
from tally.operators.custom import custom_report
from tally.operators.merchant import merchant_analysis, merchant_category, primary_category
from tally.operators.pnl import profit_and_loss
from tally.operators.summary import describe_amounts, summary_statistics, top_categories
from tally.operators.trend import trend
from tally.operators import render as R
from tally.operators.export import (READ_BACK_FORMATS, cash_flow_document, export_csv, export_json,
                                    preview, read_exported_csv, text_schema)
from tally.operators.quality import quality_counts
from tally.plans import params as P
from tally.plans.spec import ReportSpec, Reports
from tally.session import scratch_dir, shuffles_removed
from tally.sources.acquire import acquire, by_account, list_accounts, list_categories
from tally.sources.fixtures import ledger, transactions, transactions_raw
from tally.sources.html import account_pages, extract_accounts, extract_transactions, transaction_pages
from tally.sources.ingest import coerce_amounts, coerce_dates, normalize, parse_currency_text, read_json
from tally.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

ROW_COLS = ["l_orderkey", "l_linenumber", "date", "amount", "description",
            "merchant", "category", "account", "notes"]


def rows_out(df: DataFrame) -> DataFrame:
    """Row-level output: amount as DOUBLE at the edge."""
    return df.select(*[F.col(c).cast("double").alias(c) if c == "amount" else F.col(c)
                       for c in ROW_COLS])


def _on_ledger(fn) -> Query:
    return lambda spark, sf: fn(ledger(spark, sf))


def build() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for g in GROUPINGS:
        q[f"cash_flow_{g}"] = _on_ledger(lambda d, g=g: cash_flow(d, grouping=g).details)
        q[f"trend_{g}"] = _on_ledger(lambda d, g=g: trend(d, grouping=g).details)
    q["cash_flow_totals"] = _on_ledger(lambda d: cash_flow(d, grouping="monthly").header)
    q["trend_top_category"] = _on_ledger(
        lambda d: trend(d, P.TREND_TOP_FILTER, "quarterly").details
        .select("period", "top_expense_category"))
    q["pnl_totals"] = _on_ledger(lambda d: profit_and_loss(d, P.PNL_FILTER).header)
    q["pnl_income_by_category"] = _on_ledger(
        lambda d: profit_and_loss(d, P.PNL_FILTER).sections["income_by_category"])
    q["pnl_expenses_by_category"] = _on_ledger(
        lambda d: profit_and_loss(d, P.PNL_FILTER).sections["expenses_by_category"])
    q["pnl_selected_categories"] = _on_ledger(lambda d: profit_and_loss(d, P.PNL_CATEGORIES).header)
    q["pnl_excluding_categories"] = _on_ledger(lambda d: profit_and_loss(d, P.PNL_EXCLUDING).header)
    q["category_analysis"] = _on_ledger(lambda d: category_analysis(d).details)
    q["category_analysis_top_n"] = _on_ledger(
        lambda d: category_analysis(d, P.EXPENSES_ONLY, P.TOP_N).details)
    q["category_analysis_totals"] = _on_ledger(
        lambda d: category_analysis(d, P.EXPENSES_ONLY, P.TOP_N).header)
    q["merchant_analysis"] = _on_ledger(
        lambda d: merchant_analysis(d, top_n=P.MERCHANT_TOP_N).details)
    q["merchant_analysis_all"] = _on_ledger(lambda d: merchant_analysis(d, top_n=None).details)
    q["merchant_primary_category"] = _on_ledger(lambda d: primary_category(merchant_category(d)))
    q["account_summary"] = _on_ledger(lambda d: account_summary(d).details)
    q["account_summary_total"] = _on_ledger(lambda d: account_summary(d).header)
    for key in ("category", "merchant", "account"):
        q[f"custom_group_by_{key}"] = _on_ledger(
            lambda d, key=key: custom_report(d, P.CUSTOM_FILTER, group_by=key).details)
    q["custom_rows_sorted"] = _on_ledger(
        lambda d: rows_out(custom_report(d, P.CUSTOM_FILTER, sort=P.CUSTOM_SORT).details))
    q["custom_totals"] = _on_ledger(lambda d: custom_report(d, P.CUSTOM_FILTER).header)
    q["period_comparison"] = _on_ledger(lambda d: period_comparison(d, P.PERIODS))
    q["summary_stats"] = _on_ledger(lambda d: summary_statistics(d).header)
    q["summary_by_category"] = _on_ledger(lambda d: summary_statistics(d).details)
    q["summary_top_categories"] = _on_ledger(lambda d: top_categories(d, 5))
    q["amount_describe"] = _on_ledger(lambda d: describe_amounts(d))
    q["merchant_subtotal"] = _on_ledger(
        lambda d: P.MERCHANT_SUBTOTAL.apply(d).agg(
            F.lit(P.MERCHANT_SUBTOTAL.merchant).alias("merchant_filter"),
            F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("total"),
            F.count(F.lit(1)).alias("transaction_count")))
    for name, f in P.FILTERS.items():
        q[name] = _on_ledger(lambda d, f=f: rows_out(f.apply(d)))
    for name, f in P.TXN_FILTERS.items():
        q[name] = _on_ledger(lambda d, f=f: rows_out(f.apply(d)))
    _more(q)
    return q


def _periods(d: DataFrame) -> DataFrame:
    from tally.functions.periods import period_label
    dates = d.select("date").where(F.col("date").isNotNull()).distinct()
    return dates.select("date", *[period_label(F.col("date"), g).alias(g) for g in GROUPINGS])


def _csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = export_csv(rows_out(ledger(spark, sf)).withColumn("amount", F.col("amount").cast("decimal(18,2)")),
                      scratch_dir(spark, "csv"))
    back = read_exported_csv(spark, path)
    return rows_out(normalize(back.withColumns({"l_orderkey": F.col("l_orderkey").cast("bigint"),
                                                "l_linenumber": F.col("l_linenumber").cast("int")}),
                              date_formats=READ_BACK_FORMATS))


def _json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = rows_out(ledger(spark, sf)).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    path = export_json(d, scratch_dir(spark, "json"))
    back = spark.read.schema(text_schema(["l_orderkey", "l_linenumber"])).json(path)
    return rows_out(normalize(back.withColumns({"l_orderkey": F.col("l_orderkey").cast("bigint"),
                                                "l_linenumber": F.col("l_linenumber").cast("int")}),
                              date_formats=READ_BACK_FORMATS))


def _stream_cash_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows exported as monthly parquet files, then consumed by the
    streaming cash flow, two files per micro-batch or as many as keep the
    micro-batches to ``P.STREAM_BATCHES``; result read from the sink."""
    from tally.schema import TXN_SCHEMA
    from tally.streaming.cash_flow_stream import read_cash_flow, start_cash_flow_stream
    base = scratch_dir(spark, "stream")
    src = f"{base}/source"
    led = ledger(spark, sf).select(*TXN_SCHEMA.fieldNames())
    (led.withColumn("m", F.date_format("date", "yyyy-MM"))
        .hint("rebalance", "m").drop("m")
        .write.option("maxRecordsPerFile", P.STREAM_FILE_ROWS).parquet(src))
    q = start_cash_flow_stream(spark, src, f"{base}/sink", f"{base}/checkpoint", TXN_SCHEMA,
                               watermark=P.STREAM_WATERMARK, max_files_per_trigger=2,
                               max_batches=P.STREAM_BATCHES)
    if not q.awaitTermination(P.STREAM_TIMEOUT_S):
        q.stop()
        raise TimeoutError("streaming cash flow did not finish")
    return read_cash_flow(spark, f"{base}/sink", "daily")


def _store_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """P&L totals over the month-partitioned store of the ledger; the date
    filter prunes partitions (see tally.sources.store)."""
    from tally.sources.store import read_store, write_store
    path = write_store(ledger(spark, sf), scratch_dir(spark, "store"))
    return profit_and_loss(read_store(spark, path), P.PNL_FILTER).header


def _on_store(fn) -> Query:
    """On the ledger written to the stored table and read back."""
    from tally.sources.store import read_store, write_store
    return lambda spark, sf: fn(read_store(spark, write_store(ledger(spark, sf), scratch_dir(spark, "store"))))


def _store_search(spark: SparkSession, sf: str) -> DataFrame:
    """Text searches on the stored table, with the files that its text index leaves."""
    from tally.sources.store import read_store, write_store
    from tally.sources.text_index import write_text_index
    path = write_store(ledger(spark, sf), scratch_dir(spark, "store"))
    write_text_index(spark, path)
    return rows_out(P.STORE_SEARCH.apply(read_store(spark, path, P.STORE_SEARCH)))


def _merged_downloads(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger without its keys, each row one to three times, brought into a
    store by overlapping downloads and read back."""
    from tally.schema import TXN_FIELDS
    from tally.sources.merge import merge_store
    from tally.sources.store import read_store, write_store
    source = scratch_dir(spark, "downloads")  # holds each row once, with its last copy's number
    ledger(spark, sf).select(*TXN_FIELDS, (F.col("l_linenumber") % 3).alias("last_copy")).write.parquet(source)
    rows = spark.read.parquet(source).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("last_copy")))).select(*TXN_FIELDS)
    path = scratch_dir(spark, "store")
    for i, (start, end) in enumerate(P.DOWNLOADS):
        window = F.col("date").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
        download = rows.where(window | F.col("date").isNull() if i == len(P.DOWNLOADS) - 1 else window)
        path = merge_store(spark, path, download) if i else write_store(download, path)
    return read_store(spark, path).select(*[F.col(c).cast("double").alias(c) if c == "amount" else F.col(c) for c in TXN_FIELDS])


def _with_times(d: DataFrame) -> DataFrame:
    """Ledger rows at an hour of their day (0 to 23, by order key)."""
    return d.withColumn("date", F.col("date") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int")))


def _difficult(d: DataFrame) -> DataFrame:
    """Ledger rows whose descriptions hold what delimited text trips over."""
    k, text = F.col("l_orderkey") % 8, F.col("description")
    return rows_out(d).withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("description", (
        F.when(k == 0, F.concat(F.lit('He said "'), text, F.lit('", ok')))
        .when(k == 1, F.concat(text, F.lit("\nsecond line"))).when(k == 2, F.concat(F.lit("  "), text, F.lit(" ")))
        .when(k == 3, F.lit("\\N")).when(k == 4, F.lit("")).when(k == 5, F.lit("back\\slash\\"))
        .when(k == 6, F.lit(None).cast("string")).otherwise(F.concat(text, F.lit("\r\n")))))


def _typed_keys(d: DataFrame) -> DataFrame:
    return rows_out(normalize(d.withColumns({"l_orderkey": F.col("l_orderkey").cast("bigint"),
                                             "l_linenumber": F.col("l_linenumber").cast("int")})))


def _difficult_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = export_csv(_difficult(ledger(spark, sf)), scratch_dir(spark, "csv"))
    return _typed_keys(read_exported_csv(spark, path))


def _difficult_json(spark: SparkSession, sf: str) -> DataFrame:
    path = export_json(_difficult(ledger(spark, sf)), scratch_dir(spark, "json"))
    return _typed_keys(read_json(spark, path))


#: Text of a document; the rows of a key block are cut evenly into as many documents as that takes.
_DOCUMENT_BYTES = 700_000


def _join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Array documents from sorted rows; holds the rows of one key block."""
    key, texts = None, []

    def documents() -> Iterator[pa.RecordBatch]:
        parts = -(-sum(map(len, texts)) // _DOCUMENT_BYTES)
        cuts = [len(texts) * i // parts for i in range(parts + 1)] if texts else []
        for lo, hi in zip(cuts, cuts[1:]):
            yield pa.RecordBatch.from_arrays([pa.array([b"[ " + b", ".join(texts[lo:hi]) + b" ]"]).cast(pa.string())], ["value"])

    for batch in batches:
        values = batch.column("value").cast(pa.binary()).to_pylist()
        for row in zip(batch.column("_doc").to_pylist(), batch.column("_lines").to_pylist(), values):
            if row[:2] != key:
                yield from documents()
                key, texts = row[:2], []
            texts.append(row[2])
    yield from documents()


def _array_documents(d: DataFrame) -> DataFrame:
    """Rows as pretty-printed array documents of at most 700 KB, one or more for 4,096 order keys and a block of
    32 line numbers; what a document holds depends on its rows only, so a task
    that runs again writes the same one. The fixture has a row for each line number
    of an order, so that bounds what a task holds. Rows travel once, typed, and become text behind the shuffle."""
    doc = {"_doc": F.shiftright("l_orderkey", 12), "_lines": F.shiftright("l_linenumber", 5)}
    rows = d.select(*ROW_COLS).repartition(*doc.values()).withColumns(doc).sortWithinPartitions(*doc, *ROW_COLS) \
        .withColumn("date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select(*doc, F.to_json(F.struct(*ROW_COLS), {"pretty": "true"}).alias("value")).mapInArrow(_join_rows, "value string")


def _array_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger written as array documents, a compressed file each, and read back."""
    path = scratch_dir(spark, "json-array")
    with shuffles_removed(spark):
        _array_documents(ledger(spark, sf)).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return _typed_keys(read_json(spark, path))


def _accented(d: DataFrame) -> DataFrame:
    """Ledger rows whose descriptions have accents on some letters."""
    return d.withColumn("description", F.translate("description", *P.ACCENTS))


def _from_document(doc: DataFrame) -> DataFrame:
    """Header fields and periods of a cash flow document, as typed columns."""
    kind = ("struct<report_type:string,grouping:string,period:string,total_inflow:double,total_outflow:double,net_cash_flow:double,"
            "periods:array<struct<period:string,inflow:double,outflow:double,net_flow:double,running_balance:double,transaction_count:bigint>>>")
    d = doc.select(F.from_json("document", kind).alias("d")).select("d.*", F.explode("d.periods").alias("p"))
    return d.select("report_type", "grouping", F.col("period").alias("whole_period"), "total_inflow", "total_outflow", "net_cash_flow", "p.*")


def _document_in_parts(d: DataFrame) -> DataFrame:
    """All merchants, read back from the parts of their document."""
    from tally.operators.document_parts import list_rows, write_report_json
    report = merchant_analysis(d, top_n=None)
    path = write_report_json(report, scratch_dir(d.sparkSession, "document"))
    return list_rows(d.sparkSession.read.text(path), report.details.schema)


def _pnl_totals_text(d: DataFrame) -> DataFrame:
    h = profit_and_loss(d, P.PNL_FILTER).header
    return h.select(F.concat(F.lit("Period: "), F.col("period")).alias("period_line"),
                    F.concat(F.lit("  Total Income:    "), R.cur(F.col("total_income"))).alias("income_line"),
                    F.concat(F.lit("  Total Expenses:  "), R.cur(F.col("total_expenses"))).alias("expense_line"),
                    R.net_label(F.col("net_income")).alias("net_line"))


def _html_transactions(spark: SparkSession, sf: str) -> DataFrame:
    recs = normalize(extract_transactions(transaction_pages(transactions(spark, sf))))
    return recs.select("page_id", "date", F.col("amount").cast("double").alias("amount"),
                       "description", "merchant", "category", "account", "notes")


def _more(q: dict) -> None:
    q["ingest_normalize"] = lambda spark, sf: rows_out(ledger(spark, sf))
    q["ingest_coerce_dates"] = lambda spark, sf: coerce_dates(
        transactions_raw(spark, sf).select("l_orderkey", "l_linenumber",
                                           F.col("date").alias("date_text"), "date"))
    q["ingest_coerce_amounts"] = lambda spark, sf: coerce_amounts(
        transactions_raw(spark, sf).select("l_orderkey", "l_linenumber",
                                           F.col("amount").alias("amount_text"), "amount")
    ).withColumn("amount", F.col("amount").cast("double"))
    q["parse_currency_text"] = lambda spark, sf: transactions_raw(spark, sf).select(
        "l_orderkey", "l_linenumber", F.col("amount").alias("amount_text"),
        parse_currency_text(F.col("amount")).cast("double").alias("amount"))
    q["html_extract_transactions"] = _html_transactions
    q["html_extract_accounts"] = lambda spark, sf: extract_accounts(
        account_pages(read_table(spark, sf, "customer", "c_custkey", "c_name"))).drop("row_no")
    q["list_accounts"] = _on_ledger(list_accounts)
    q["list_categories"] = _on_ledger(list_categories)
    q["acquire_last_n_days"] = _on_ledger(
        lambda d: rows_out(acquire(d, days=P.LAST_DAYS, as_of=P.AS_OF)))
    q["acquire_default_ytd"] = _on_ledger(lambda d: rows_out(acquire(d, as_of=P.AS_OF)))
    q["acquire_by_account"] = _on_ledger(lambda d: rows_out(by_account(d, P.ACCOUNT_ID)))
    q["preview_head"] = _on_ledger(lambda d: preview(rows_out(d), 5))
    q["limit_rows"] = _on_ledger(lambda d: rows_out(d).orderBy(
        F.col("date").desc_nulls_last(), F.col("amount").desc_nulls_last(),
        *[F.col(c).asc_nulls_last() for c in ROW_COLS if c not in ("date", "amount")]).limit(P.LIMIT_ROWS))
    q["period_labels"] = _on_ledger(_periods)
    q["format_currency"] = _on_ledger(lambda d: R.category_lines(category_analysis(d).details))
    q["render_cash_flow_lines"] = _on_ledger(lambda d: R.cash_flow_lines(cash_flow(d).details))
    q["render_pnl_lines"] = _on_ledger(lambda d: _pnl_lines(profit_and_loss(d, P.PNL_FILTER)))
    q["render_merchant_lines"] = _on_ledger(
        lambda d: R.merchant_lines(merchant_analysis(d, top_n=P.MERCHANT_TOP_N).details))
    q["render_trend_lines"] = _on_ledger(lambda d: R.trend_lines(trend(d, P.TREND_TOP_FILTER).details))
    q["render_account_lines"] = _on_ledger(lambda d: R.account_lines(account_summary(d).details))
    q["row_quality_split"] = _on_ledger(quality_counts)
    q["csv_roundtrip"] = _csv_roundtrip
    q["json_roundtrip"] = _json_roundtrip
    q["stream_cash_flow_daily"] = _stream_cash_flow
    q["store_pnl_totals"] = _store_pnl
    q["render_pnl_totals"] = _on_ledger(_pnl_totals_text)
    q["report_json_document"] = _on_ledger(lambda d: _from_document(cash_flow_document(d, grouping="quarterly")))
    q["report_json_parts"] = _on_ledger(_document_in_parts)
    q["csv_difficult_text"] = _difficult_csv
    q["json_difficult_text"] = _difficult_json
    q["json_array_ingest"] = _array_ledger
    for name, f in P.ACCENT_FILTERS.items():
        q[name] = _on_ledger(lambda d, f=f: rows_out(f.apply(_accented(d))))
    q["spec_last_days_pnl"] = _on_ledger(lambda d: ReportSpec(
        "profit_loss", last_days=P.LAST_DAYS, as_of=P.AS_OF).run(_with_times(d)).header)
    q["txn_request_summary"] = _on_ledger(lambda d: Reports(d).summary(P.EXPENSES_ONLY, rows=P.REQUEST_ROWS).header)
    q["period_comparison_many"] = _on_ledger(lambda d: period_comparison(_with_times(d), P.MANY_PERIODS))
    q["amount_describe_scale4"] = _on_ledger(lambda d: describe_amounts(
        d.withColumn("amount", (F.col("amount") * F.lit(Decimal("0.001"))).cast("decimal(18,4)"))))
    q["store_period_comparison"] = _on_store(lambda d: period_comparison(d, P.PERIODS))
    q["store_acquire"] = _on_store(lambda d: rows_out(acquire(d, days=P.LAST_DAYS, as_of=P.AS_OF)))
    q["store_search_text"] = _store_search
    q["store_merge_downloads"] = _merged_downloads
    q["store_filter_categories"] = _on_store(lambda d: rows_out(P.FILTERS["filter_categories_in"].apply(d)))
    q["custom_group_absent_column"] = _on_ledger(lambda d: rows_out(
        custom_report(d, P.CUSTOM_FILTER, sort=P.CUSTOM_SORT, group_by="no_such_column").details))


def _pnl_lines(rep) -> DataFrame:
    return R.pnl_category_lines(rep.sections["by_category"], "percentage", keep=("section",))
