"""Report documents with lists of any length, written in parts.

``write_report_json`` writes one JSON document as the lines of a text folder: the
header and the brackets of the lists have lines of their own, each list row is a
line.  Tasks write ranges of lines, so no task and no driver holds a list; the
part files, put together by their numbers, are the document.

The rows are written to the scratch folder with their places first: places come
from the report's own order, are read twice (which row of a list has no comma in
front, then the sort into parts), and must not change when a lost task runs again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators.export import BOUNDED_SECTIONS, REPORT_TITLES, SECTION_NAMES, LongList, report_json
from tally.session import scratch_dir

# Title and list name of the document of account lists.
TITLES = REPORT_TITLES | {"account_summary": "Account Summary"}
SECTIONS = BOUNDED_SECTIONS | {"account_summary": ("details",)}
NAMES = SECTION_NAMES | {("account_summary", "details"): "accounts"}


def write_report_json(report, path: str, mode: str = "errorifexists") -> str:
    """Write a report's document in parts; the fields are those of ``report_json``."""
    if report.kind not in SECTIONS:
        raise ValueError(f"{report.kind}: no document, export the rows with export_json")
    spark, frames = report.header.sparkSession, report.frames()
    sections = SECTIONS[report.kind]
    rows = reduce(DataFrame.unionByName, [
        frames[sec].select(F.lit(n).alias("section"), F.monotonically_increasing_id().alias("place"),
                           F.to_json(F.struct(*frames[sec].columns)).alias("line"))
        for n, sec in enumerate(sections)])
    scratch = scratch_dir(spark, "document-rows")
    rows.write.parquet(scratch)
    rows = spark.read.schema(rows.schema).parquet(scratch)
    # a row per list
    first = {r["section"]: r["place"] for r in rows.groupBy("section").agg(F.min("place").alias("place")).collect()}
    head = reduce(lambda c, s: c | ((F.col("section") == s) & (F.col("place") == first[s])), first, F.lit(False))
    body = rows.withColumn("line", F.concat(F.when(head, "").otherwise(","), "line"))

    header = F.to_json(F.struct(F.lit(TITLES[report.kind]).alias("report_type"), *report.header.columns))
    opening = [f',"{NAMES.get((report.kind, sec), sec)}":[' for sec in sections]
    marks = [(n, -1, ("]" if n else "") + text) for n, text in enumerate(opening)] + [(len(sections), -1, "]}")]
    frame = spark.createDataFrame(marks, "section int, place long, line string") \
        .unionByName(_header_line(report.header, header))
    body.unionByName(frame).orderBy("section", "place").select("line").write.mode(mode).text(path)
    return path


def _header_line(header: DataFrame, document) -> DataFrame:
    """The header's object without its last brace, in front of everything."""
    doc = header.select(document.alias("doc"))
    return doc.select(F.lit(0).alias("section"), F.lit(-2).cast("long").alias("place"),
                      F.substring("doc", F.lit(1), F.length("doc") - 1).alias("line"))


def write_document(report, path: str) -> str:
    """The document of a report: one line if its lists are short, else in parts."""
    try:
        report_json(report).write.text(path)
    except LongList:
        write_report_json(report, path)
    return path


def list_rows(lines: DataFrame, schema) -> DataFrame:
    """Rows of a document with one list, from the lines of its parts (``value``)."""
    text = F.ltrim(F.col("value"), F.lit(","))
    return lines.where(F.endswith("value", F.lit("}")) & (F.length("value") > 2)) \
        .select(F.from_json(text, schema).alias("r")).select("r.*")
