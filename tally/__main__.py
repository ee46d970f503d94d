"""Command-line report job (run with ``python -m tally`` or ``spark-submit``).

    python -m tally report --input DIR --format csv|json|parquet \\
        --report cash_flow --grouping weekly --last-days 90 --out DIR [--text]

Flags map one-to-one onto ``ReportSpec`` fields and are validated by it.
Each frame of the report (header and lists) is written as its own folder
below ``--out`` (JSON lines, or CSV with ``--csv``), as a distributed
write; ``--text`` also prints the report's text layout, and ``--show`` prints the
first rows of each frame. ``--document`` writes the report's JSON document below
``--out`` under its timestamped name instead.

    python -m tally accounts|categories|summary|transactions --input DIR ...

list the accounts or categories, summarize, or export the transactions of an
acquisition window (``--start-date``, ``--end-date`` or ``--days``; this year so
far by default), of one account (``--account-id``) and passing the list filters
(``--min-amount`` to ``--description``); ``--limit`` keeps the newest rows.
"""

from __future__ import annotations

import argparse
import sys

from tally.plans.spec import REPORT_TYPES, ReportSpec


def _list(v: str | None):
    return [x for x in v.split(",")] if v else None


def _add_input(r: argparse.ArgumentParser) -> None:
    r.add_argument("--input", required=True)
    r.add_argument("--format", default="parquet", choices=["csv", "json", "parquet"])
    r.add_argument("--date-format", action="append", dest="date_formats")
    r.add_argument("--out")
    r.add_argument("--csv", action="store_true")
    r.add_argument("--show", type=int, default=0)


def _add_rows(r: argparse.ArgumentParser) -> None:
    for name in ("--start-date", "--end-date", "--as-of", "--account-id", "--category", "--merchant", "--description"):
        r.add_argument(name)
    r.add_argument("--days", type=int)
    r.add_argument("--limit", type=int)
    r.add_argument("--min-amount", type=float)
    r.add_argument("--max-amount", type=float)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tally")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("accounts", "list accounts"), ("categories", "list categories"),
                       ("summary", "summary statistics"), ("transactions", "export transactions")):
        action = sub.add_parser(name, help=text)
        _add_input(action)
        _add_rows(action)
    r = sub.add_parser("report", help="run one report")
    _add_input(r)
    r.add_argument("--report", required=True, choices=REPORT_TYPES)
    r.add_argument("--start-date")
    r.add_argument("--end-date")
    r.add_argument("--last-days", type=int)
    r.add_argument("--as-of")
    r.add_argument("--min-amount", type=float)
    r.add_argument("--max-amount", type=float)
    r.add_argument("--categories")
    r.add_argument("--exclude-categories")
    r.add_argument("--merchants")
    r.add_argument("--exclude-merchants")
    r.add_argument("--accounts")
    r.add_argument("--description-contains")
    r.add_argument("--notes-contains")
    r.add_argument("--grouping", default="monthly")
    r.add_argument("--top-n", type=int)
    r.add_argument("--sort-field")
    r.add_argument("--sort-order", default="desc")
    r.add_argument("--group-by")
    r.add_argument("--text", action="store_true")
    r.add_argument("--document", action="store_true")
    return p


def spec_from_args(a) -> ReportSpec:
    return ReportSpec(
        report_type=a.report, start_date=a.start_date, end_date=a.end_date,
        last_days=a.last_days, as_of=a.as_of, min_amount=a.min_amount, max_amount=a.max_amount,
        categories=_list(a.categories), exclude_categories=_list(a.exclude_categories),
        merchants=_list(a.merchants), exclude_merchants=_list(a.exclude_merchants),
        accounts=_list(a.accounts), description_contains=a.description_contains,
        notes_contains=a.notes_contains, grouping=a.grouping, top_n=a.top_n,
        sort_field=a.sort_field, sort_order=a.sort_order, group_by=a.group_by)


def selected_rows(txns, a):
    """Transactions of the window, account and list filters of the arguments."""
    from pyspark.sql import functions as F
    from tally.operators.filters import TxnFilter
    from tally.sources.acquire import acquire
    from tally.sources.store import row_columns
    rows = acquire(txns, a.start_date, a.end_date, a.account_id, a.days, a.as_of)
    rows = TxnFilter(a.min_amount, a.max_amount, a.category, a.merchant, a.description).apply(rows)
    rows = rows.select(*row_columns(rows))
    if a.limit is not None:
        rest = [F.col(c).asc_nulls_last() for c in rows.columns if c != "date"]
        rows = rows.orderBy(F.col("date").desc_nulls_last(), *rest).limit(a.limit)
    return rows


def action_frames(txns, a) -> dict:
    """Named frames of the actions that are no reports."""
    from tally.operators.summary import summary_statistics
    from tally.sources.acquire import list_accounts, list_categories
    if a.command == "accounts":
        return {"accounts": list_accounts(selected_rows(txns, a))}
    if a.command == "categories":
        return {"categories": list_categories(selected_rows(txns, a))}
    if a.command == "summary":
        return summary_statistics(selected_rows(txns, a)).frames()
    return {"transactions": selected_rows(txns, a)}


def write_frame(frame, path: str, csv: bool) -> None:
    from tally.operators.export import export_csv, export_json
    (export_csv if csv else export_json)(frame, path, "overwrite")


def main(argv=None) -> int:
    a = build_parser().parse_args(argv)
    report = a.command == "report"
    spec = spec_from_args(a) if report else None  # validates before any Spark work
    from tally.session import get_session
    from tally.sources.ingest import DEFAULT_DATE_FORMATS, read_transactions
    spark = get_session()
    txns = read_transactions(spark, a.input, a.format,
                             date_formats=tuple(a.date_formats or DEFAULT_DATE_FORMATS))
    rep = spec.run(txns, materialize=True) if report else None
    out = a.out.rstrip("/") if a.out else None
    if report and a.document and out:
        from tally.operators.document_parts import write_document
        from tally.operators.export import report_path
        write_document(rep, report_path(out, rep.kind))
    for name, frame in (rep.frames() if report else action_frames(txns, a)).items():
        if out and not (report and a.document):
            write_frame(frame, f"{out}/{name}", a.csv)
        if a.show:
            print(f"-- {name}")
            frame.show(a.show, truncate=False)
    if report and a.text and rep.kind != "custom":
        from tally.operators.render import report_text
        print("\n".join(report_text(rep)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
