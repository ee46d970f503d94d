"""DOM helper and page extraction."""

import random
from decimal import Decimal

from tally.sources import htmldom as D
from tally.sources.html import (CELLS, ROW_MATCH, account_pages, extract_accounts,
                                extract_transactions, row_cells, transaction_pages)
from tally.sources.htmlrows import RowScanner
from tally.sources.fixtures import transactions
from tally.sources.tables import read_table


def test_first_match_in_document_order():
    root = D.parse('<div class="transaction-row"><span data-description="1">first</span>'
                   '<span class="description">second</span></div>')
    row = next(e for e in root.elements() if ROW_MATCH(e))
    assert row.first(CELLS["description"]).get_text() == "first"


def test_nth_child_and_get_text_strip():
    root = D.parse("<table><tr class='transaction'><td> 2024-01-02 </td><td>Shop <b> A </b></td>"
                   "<td>$1,000.50</td><td>Food</td></tr></table>")
    row = next(e for e in root.elements() if ROW_MATCH(e))
    assert [row.first(CELLS[k]).get_text() for k in ("date", "description", "amount", "category")] == \
        ["2024-01-02", "ShopA", "$1,000.50", "Food"]


def test_rows_without_cells_get_defaults(spark):
    pages = spark.createDataFrame([(1, '<div data-transaction="x"><i>nothing</i></div>'
                                       '<li class="transaction-item"><span class="amount">oops</span></li>')],
                                  "page_id long, html string")
    rows = extract_transactions(pages).orderBy("row_no").collect()
    assert [(r.date, r.description, r.amount, r.category, r.account, r.merchant, r.notes) for r in rows] == \
        [("", "", Decimal("0.00"), "", "", "", "")] * 2


def test_nested_rows_are_both_matched(spark):
    html = ('<div class="transaction-row"><span class="date">2024-01-01</span>'
            '<div class="transaction-item"><span class="date">2024-02-02</span></div></div>')
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    assert [r.date for r in extract_transactions(pages).orderBy("row_no").collect()] == \
        ["2024-01-01", "2024-02-02"]


def test_page_round_trip(spark, sf_dir):
    txn = transactions(spark, sf_dir)
    got = extract_transactions(transaction_pages(txn))
    assert got.count() == txn.count()
    a = sorted((r.description, r.amount, r.category) for r in
               got.select("description", "amount", "category").collect())
    b = sorted((r.description, r.amount, r.category) for r in
               txn.select("description", "amount", "category").collect())
    assert a == b


def test_account_pages(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    acc = extract_accounts(account_pages(cust))
    assert sorted((r.name, r.id) for r in acc.collect()) == \
        sorted((r.c_name, str(r.c_custkey)) for r in cust.collect())
    assert {r.balance for r in acc.collect()} == {0.0}


def test_plain_pages_give_the_cells_of_their_tree():
    rng = random.Random(11)
    tags = ["div", "span", "td", "tr", "li", "p", "br", "img", "b", "title", "script", "DIV", "textarea"]
    attrs = ["", "", ' class="transaction-row"', ' class="transaction"', ' class="date amount"', ' class="merchant"', ' data-date=""', ' data-amount="x>y"',
             ' data-transaction="1"', ' class="category" class="date"', " data-date", ' class="a&amp;b"', ' data-category="a"', " class='date'"]
    texts = ["", "", " ", "x", " a b ", "&amp;", "&lt;b", "&", "\n", "é", "a > b", "\xa0", "&#65;", "<!-- c -->", "<", "</"]
    weight = lambda items, rare: [1 if i in rare else 12 for i in items]
    plain = 0
    scanner = RowScanner(ROW_MATCH, CELLS)
    for _ in range(6000):
        parts = [rng.choice(["", "<!DOCTYPE html>", "<html><head><title>T &gt;</title></head>", "<head><title>T</title></head>"])]
        for _ in range(rng.randint(0, 14)):
            tag = rng.choices(tags, weight(tags, tags[-4:]))[0]
            parts.append(f"</{tag}>" if rng.random() < 0.4 else f"<{tag}{rng.choices(attrs, weight(attrs, attrs[7:8] + attrs[10:12] + attrs[13:]))[0]}>")
            parts.append(rng.choices(texts, weight(texts, texts[-3:]))[0])
        html = "".join(parts)
        rows = scanner.rows(html)
        if rows is not None:
            plain += len(rows)
            assert rows == row_cells(html), html
    assert plain > 200


def test_written_pages_are_plain(spark, sf_dir):
    scanner = RowScanner(ROW_MATCH, CELLS)
    for r in transaction_pages(transactions(spark, sf_dir)).limit(500).collect():
        assert scanner.rows(r["html"]) == row_cells(r["html"]) != []
