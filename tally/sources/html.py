"""HTML pages → transaction and account records (scraper extraction).

Extraction runs in ``mapInArrow`` (accounts: ``mapInPandas``) over a pages frame
(page_id, html), so the work is spread over the page partitions with no shuffle.
Each task scans plainly written pages in one pass (``htmlrows``) and parses any
other with the standard-library DOM helper; both give the same cells. Only cell
texts leave Python; amounts and dates are parsed JVM-side afterwards.

Fixed selector alternatives (CSS, "first match in document order"):
  transaction rows  [data-transaction], .transaction-row, .transaction-item, tr.transaction
  date cell         .date, [data-date], td:nth-child(1)
  description cell  .description, .merchant, [data-description], td:nth-child(2)
  amount cell       .amount, [data-amount], td:nth-child(3)
  category cell     .category, [data-category], td:nth-child(4)
  account elements  [data-account], .account-item, .account-row
Record defaults: text '' , amount 0 (also when the amount text does not
parse); merchant repeats the description; account and notes stay ''.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.functions.money import format_currency
from tally.sources import htmldom as D
from tally.sources.htmlrows import RowScanner
from tally.sources.ingest import parse_currency_text

ROW_MATCH = D.any_of(D.has_attr("data-transaction"), D.has_class("transaction-row", "transaction-item"),
                     lambda e: e.tag == "tr" and "transaction" in e.classes)
CELLS = {
    "date": D.any_of(D.has_class("date"), D.has_attr("data-date"), D.tag_nth("td", 1)),
    "description": D.any_of(D.has_class("description", "merchant"), D.has_attr("data-description"),
                            D.tag_nth("td", 2)),
    "amount": D.any_of(D.has_class("amount"), D.has_attr("data-amount"), D.tag_nth("td", 3)),
    "category": D.any_of(D.has_class("category"), D.has_attr("data-category"), D.tag_nth("td", 4)),
}
ACCOUNT_MATCH = D.any_of(D.has_attr("data-account"), D.has_class("account-item", "account-row"))

CELL_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("row_no", T.IntegerType()),
    *[T.StructField(f"{k}_text", T.StringType()) for k in CELLS],
])
ACCOUNT_CELL_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("row_no", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("id", T.StringType()),
])


def row_cells(html: str | None) -> list[list[str | None]]:
    """Texts of the ``CELLS`` of each row element of a page, by its tree."""
    rows = []
    for row in (e for e in D.parse(html).elements() if ROW_MATCH(e)):
        found = row.first_of_each(CELLS)
        rows.append([found[k].get_text() if k in found else None for k in CELLS])
    return rows


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = RowScanner(ROW_MATCH, CELLS)
    types = [pa.int64(), pa.int32(), *[pa.string()] * len(CELLS)]
    names = ["page_id", "row_no", *[f"{k}_text" for k in CELLS]]
    for batch in batches:
        pages: list = []
        for pid, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
            rows = scanner.rows(html)
            pages += [(pid, i, *row) for i, row in enumerate(row_cells(html) if rows is None else rows)]
        columns = zip(*pages) if pages else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _account_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = {k: [] for k in ACCOUNT_CELL_SCHEMA.fieldNames()}
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            root = D.parse(html)
            for i, e in enumerate(x for x in root.elements() if ACCOUNT_MATCH(x)):
                out["page_id"].append(pid)
                out["row_no"].append(i)
                out["name"].append(e.get_text())
                out["id"].append(e.attrs.get("data-id", ""))
        yield pd.DataFrame(out)


def extract_transactions(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) → scraped records, one per matched row element.

    ``date`` stays text here (as scraped); ``normalize`` types it.
    """
    cells = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_cells, CELL_SCHEMA)
    desc = F.coalesce(F.col("description_text"), F.lit(""))
    return cells.select(
        "page_id", "row_no",
        F.coalesce(F.col("date_text"), F.lit("")).alias("date"),
        desc.alias("description"),
        parse_currency_text(F.col("amount_text")).alias("amount"),
        F.coalesce(F.col("category_text"), F.lit("")).alias("category"),
        F.lit("").alias("account"),
        desc.alias("merchant"),
        F.lit("").alias("notes"),
    )


def extract_accounts(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) → accounts (name, id, balance 0)."""
    cells = pages.select(F.col("page_id").cast("long"), "html").mapInPandas(
        _account_cells, ACCOUNT_CELL_SCHEMA)
    return cells.select("page_id", "row_no", "name", "id", F.lit(0.0).alias("balance"))


# ------------------------------------------------------------ page builders

def _esc(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _wrap(tag: str, attrs: str, body):
    return F.concat(F.lit(f"<{tag}{attrs}>"), body, F.lit(f"</{tag}>"))


ROWS_PER_PAGE = 50


def _chunk() -> "F.Column":
    """Page part of a row: runs of ROWS_PER_PAGE consecutive rows of a partition.

    Grouping on (key, part) bounds every page to ROWS_PER_PAGE rows, so a
    key holding a large share of all rows becomes many small pages instead
    of one unbounded group.
    """
    return F.floor(F.monotonically_increasing_id() / ROWS_PER_PAGE).cast("long")


def _by_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Hash-partition on ``keys`` into ``spark.sql.shuffle.partitions`` parts
    and sort within them, so a key's rows are consecutive. The explicit
    partition count keeps AQE from coalescing the (small, CPU-heavy) page
    frame below the core count; the later group-by on (keys, part) reuses
    this partitioning (no second shuffle)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def transaction_pages(txn: DataFrame) -> DataFrame:
    """Pages of an order's transactions (page_id = l_orderkey, block, page_part).

    The markup varies with page_id % 4 over the four row selectors and the
    class / data-attribute / positional cell forms. Rows of a page are
    ordered by line number; a page holds at most ROWS_PER_PAGE rows.
    """
    d = _esc(F.date_format("date", "yyyy-MM-dd"))
    desc, cat = _esc(F.col("description")), _esc(F.col("category"))
    amt = _esc(format_currency(F.col("amount")))
    v = F.col("l_orderkey") % 4
    td = lambda x: _wrap("td", "", x)
    row = (F.when(v == 0, _wrap("tr", ' class="transaction"',
                                F.concat(td(d), td(desc), td(amt), td(cat))))
            .when(v == 1, _wrap("div", ' class="transaction-row"', F.concat(
                _wrap("span", ' class="category"', cat), _wrap("span", ' class="date"', d),
                _wrap("span", ' class="merchant"', desc),
                _wrap("span", ' class="amount"', F.concat(F.lit("<b>"), amt, F.lit("</b>"))))))
            .when(v == 2, _wrap("li", ' class="transaction-item"', F.concat(
                _wrap("p", ' data-date=""', d), _wrap("p", ' data-description=""', desc),
                _wrap("p", ' data-amount=""', amt), _wrap("p", ' data-category=""', cat))))
            .otherwise(_wrap("div", ' data-transaction="1"', F.concat(
                _wrap("div", ' class="date"', F.concat(F.lit(" "), d, F.lit(" "))),
                _wrap("div", ' class="description"', desc),
                _wrap("div", ' data-amount="x"', amt),
                _wrap("div", ' class="category"', cat)))))
    # block of line numbers: an order with many lines spreads over several
    # partitions; ordinary orders (lines < ROWS_PER_PAGE) stay in block 0
    block = F.floor(F.col("l_linenumber") / ROWS_PER_PAGE).cast("long")
    # the markup is added behind the shuffle, which then carries the plain values
    keyed = _by_key(txn.select("l_orderkey", F.col("l_orderkey").alias("page_id"), block.alias("block"),
                               "l_linenumber", "date", "description", "amount", "category"),
                    ["page_id", "block"], "l_linenumber")
    rows = (keyed.select("page_id", "block", "l_linenumber", _chunk().alias("page_part"), row.alias("row"))
               .groupBy("page_id", "block", "page_part")
               .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "row"))).alias("rows")))
    body = F.array_join(F.transform("rows", lambda r: r.getField("row")), "")
    shell = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<table>"), body, F.lit("</table>"))) \
             .when(F.col("page_id") % 4 == 2, F.concat(F.lit("<ul>"), body, F.lit("</ul>"))) \
             .otherwise(F.concat(F.lit("<div>"), body, F.lit("</div>")))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Transactions</title></head><body>"
                          "<nav><a href=\"/\">Home</a></nav>"), shell, F.lit("</body></html>"))
    return rows.select("page_id", "block", "page_part", html.alias("html"))


ACCOUNTS_PER_PAGE = 50


def account_pages(customer: DataFrame) -> DataFrame:
    """Pages of account elements built from customers (page_id = custkey / 50,
    at most ROWS_PER_PAGE elements per page_part).

    Elements vary with the page number % 3 over the three account selectors.
    """
    page = F.floor(F.col("c_custkey") / ACCOUNTS_PER_PAGE).cast("long")
    v = page % 3
    name = _esc(F.col("c_name"))
    ident = F.col("c_custkey").cast("string")
    el = (F.when(v == 0, F.concat(F.lit('<div class="account-item" data-id="'), ident,
                                  F.lit('"><span>'), name, F.lit("</span></div>")))
           .when(v == 1, F.concat(F.lit('<li class="account-row" data-id="'), ident,
                                  F.lit('">'), name, F.lit("</li>")))
           .otherwise(F.concat(F.lit('<section data-account="a" data-id="'), ident,
                               F.lit('"><h3> '), name, F.lit(" </h3></section>"))))
    keyed = _by_key(customer.select(page.alias("page_id"), "c_custkey", el.alias("el")),
                    ["page_id"], "c_custkey")
    return (keyed.withColumn("page_part", _chunk())
                    .groupBy("page_id", "page_part")
                    .agg(F.sort_array(F.collect_list(F.struct("c_custkey", "el"))).alias("els"))
                    .select("page_id", "page_part", F.concat(
                        F.lit("<html><body><h1>Accounts</h1>"),
                        F.array_join(F.transform("els", lambda r: r.getField("el")), ""),
                        F.lit("</body></html>")).alias("html")))
