"""Sinks: CSV / JSON-lines export, report documents and preview.

Exports are distributed writes (one file per task) to a folder; dates are
written as ``yyyy-MM-dd HH:mm:ss`` text and amounts as exact decimals, so
``read_transactions`` reads them back unchanged. An empty frame writes no
data files. Report documents (``to_json`` of header + details) are built
only for reports whose detail rows are bounded (periods, top-N) or counted
first (categories), never for per-account or per-row lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.schema import DATE_FIELDS, RAW_TXN_SCHEMA

EXPORT_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Standard quoting: quotes are doubled, blanks at the ends belong to the value,
# a null is an empty unquoted field and an empty text a quoted one. The reader
# takes no text for null: its null marker is a noncharacter.
CSV_QUOTING = {"header": True, "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CSV_WRITE = CSV_QUOTING | {"nullValue": "", "emptyValue": '""'}
CSV_READ = CSV_QUOTING | {"nullValue": "\uffff", "emptyValue": "", "multiLine": True, "enforceSchema": False}
READ_BACK_FORMATS = (EXPORT_TS_FORMAT, "yyyy-MM-dd")


def _as_text_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, EXPORT_TS_FORMAT)
                           for c in DATE_FIELDS if c in df.columns})


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    _as_text_dates(df).write.mode(mode).options(**CSV_WRITE).csv(path)
    return path


def read_exported_csv(spark, path: str) -> DataFrame:
    """Read CSV files with a header, all columns as text, no inference pass.

    Quoted fields may hold line breaks, so a file is one task. The headers of
    all files must be the first one's; a different one fails the read."""
    return spark.read.options(**CSV_READ).csv(path)


def export_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """JSON lines (one object per row, null fields included)."""
    _as_text_dates(df).write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def text_schema(columns) -> T.StructType:
    """All-text read schema for exported transaction files (no inference pass)."""
    known = {f.name for f in RAW_TXN_SCHEMA.fields}
    return T.StructType([T.StructField(c, T.StringType()) for c in columns if c not in known]
                        + list(RAW_TXN_SCHEMA.fields))


def report_document(details: DataFrame, header_cols, details_name: str = "details",
                    sort_key: str | None = None, hidden: tuple[str, ...] = ()) -> DataFrame:
    """One row with a JSON ``document``: header fields and the detail list.

    Both come from a single global aggregate over the (bounded) detail rows:
    ``header_cols`` are aggregate expressions over them, and the rows are
    gathered sorted by ``sort_key``, without the ``hidden`` columns that only
    the header uses. Only for bounded detail lists.
    """
    key = sort_key or details.columns[0]
    rows = F.sort_array(F.collect_list(F.struct(F.col(key).alias("_k"), F.struct(*[c for c in details.columns if c not in hidden]).alias("r"))))
    doc = details.agg(*header_cols, F.transform(rows, lambda x: x.getField("r")).alias(details_name))
    return doc.select(F.to_json(F.struct("*")).alias("document"))


def cash_flow_document(df: DataFrame, flt=None, grouping: str = "monthly") -> DataFrame:
    """The cash flow report as one JSON document (periods ≤ one per label)."""
    from tally.functions.money import to_double
    from tally.operators.cash_flow import cash_flow_details, cash_flow_periods, dated
    from tally.operators.filters import apply_filters
    from pyspark.sql import Window
    per = dated(cash_flow_periods(apply_filters(df, flt), grouping))
    # exact DECIMAL totals of the periods (one row per label) ride along with the rows
    all_periods = Window.partitionBy()
    i, o = F.sum("inflow").over(all_periods), F.sum("outflow").over(all_periods)
    totals = per.withColumns({"_inflow": to_double(i), "_outflow": to_double(o), "_net": to_double(i - o)})
    d = cash_flow_details(totals, "_inflow", "_outflow", "_net")
    header = [F.lit("Cash Flow").alias("report_type"), F.lit(grouping).alias("grouping"),
              F.coalesce(F.concat(F.min("period"), F.lit(" to "), F.max("period")), F.lit("")).alias("period"),
              F.coalesce(F.max("_inflow"), F.lit(0.0)).alias("total_inflow"),
              F.coalesce(F.max("_outflow"), F.lit(0.0)).alias("total_outflow"),
              F.coalesce(F.max("_net"), F.lit(0.0)).alias("net_cash_flow")]
    return report_document(d, header, "periods", "period", hidden=("_inflow", "_outflow", "_net"))


def report_path(base_dir: str, kind: str, now=None, ext: str = "") -> str:
    """Timestamped output location ``<base>/reports/<kind>_<YYYYmmdd_HHMMSS><ext>``."""
    from datetime import datetime
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{base_dir.rstrip('/')}/reports/{kind}_{stamp}{ext}"


# Report kinds that have a document, its list names and titles.
# Account lists and custom row lists grow with the data and are exported as
# JSON lines instead.
BOUNDED_SECTIONS = {
    "profit_and_loss": ("income_by_category", "expenses_by_category"),
    "cash_flow": ("details",),
    "category_analysis": ("details",),
    "merchant_analysis": ("details",),
    "trend_analysis": ("details",),
}
SECTION_NAMES = {("cash_flow", "details"): "periods", ("trend_analysis", "details"): "periods",
                 ("category_analysis", "details"): "categories",
                 ("merchant_analysis", "details"): "merchants"}
REPORT_TITLES = {"profit_and_loss": "Profit & Loss", "cash_flow": "Cash Flow",
                 "category_analysis": "Category Analysis", "merchant_analysis": "Merchant Analysis",
                 "trend_analysis": "Trend Analysis"}


# Rows that a document may hold of lists whose size the data decide.
MAX_DOCUMENT_ROWS = 100_000


class LongList(ValueError):
    """A list that is too long for a document in one row."""


def report_json(report) -> DataFrame:
    """Any report with short lists as one JSON document row.

    Periods and top-N lists are short by construction; the lists of all
    merchants and of all categories are counted first, and a longer one than
    ``MAX_DOCUMENT_ROWS`` is refused: ``document_parts.write_report_json`` writes
    it in parts.

    The header row and one row per list (``collect_list`` of its rows, in
    report order) are stacked by a union padded with nulls and folded by a
    single global ``max`` per column — no join. Lists keep report order via
    a position key taken from a window over the (bounded) list rows.
    """
    from pyspark.sql import Window
    if report.kind not in BOUNDED_SECTIONS:
        raise LongList(f"{report.kind}: unbounded lists, write them with write_report_json or export_json")
    frames = report.frames()
    for sec in BOUNDED_SECTIONS[report.kind]:
        if report.kind not in ("cash_flow", "trend_analysis") and not report.top_n and \
                frames[sec].limit(MAX_DOCUMENT_ROWS + 1).count() > MAX_DOCUMENT_ROWS:
            raise LongList(f"{sec} has more than {MAX_DOCUMENT_ROWS} rows, write it with write_report_json or export_json")
    parts = {"header": report.header.withColumn("report_type", F.lit(REPORT_TITLES[report.kind]))}
    for sec in BOUNDED_SECTIONS[report.kind]:
        d = frames[sec]
        name = SECTION_NAMES.get((report.kind, sec), sec)
        pos = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
        rows = d.select(pos.alias("_p"), F.struct(*d.columns).alias("_r"))
        parts[name] = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_r"))),
                                           lambda x: x.getField("_r")).alias(name))
    types = {}
    for df in parts.values():
        types.update(dict(df.dtypes))
    cols = list(types)
    union = None
    for df in parts.values():
        padded = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c)
                             for c in cols])
        union = padded if union is None else union.unionByName(padded)
    doc = union.agg(*[F.max(c).alias(c) for c in cols])
    return doc.select(F.to_json(F.struct("report_type", *[c for c in cols if c != "report_type"]))
                      .alias("document"))


def preview(df: DataFrame, n: int = 5, order=None) -> DataFrame:
    """First ``n`` rows in a total order (default: by date, nulls last, then all columns)."""
    order = order or ([F.col("date").asc_nulls_last()] if "date" in df.columns else []) + \
        [F.col(c).asc_nulls_last() for c in df.columns if c != "date"]
    return df.orderBy(*order).limit(n)
