"""Records → typed table: schema normalization and value coercion.

Rules (see README "Semantics"):
- dates: text is parsed with explicit formats (first that parses wins);
  anything else becomes null. No lenient casts: ``'2025'`` is not a date.
- amounts: text must look like a plain number (optional sign, decimals,
  exponent, surrounding blanks); ``'$3'`` and ``'1,000'`` become null.
  Values are rounded half-up to ``scale`` decimals; NaN becomes null.
- missing columns are added as typed nulls after the caller had the chance
  to see which columns the source really has (filters on absent columns
  are skipped, see ``tally.operators.filters``).
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.schema import DATE_FIELDS, TEXT_FIELDS, TXN_SCHEMA
from tally.session import scratch_dir
from tally.sources.json_ranges import array_lines

# Column metadata key marking a field that normalize() added because the
# source lacked it; filters on such a field are skipped, as for a missing column.
SYNTHESIZED = "tally.synthesized"

# Fixed value: the plain-number shape accepted for amount text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# ISO forms: a date, a date with time (fractions allowed), and the T form,
# also with a zone (then converted to the session's, UTC).
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]",
                        "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][XXX]")


def coerce_date(c: Column, dtype: T.DataType, formats=DEFAULT_DATE_FORMATS) -> Column:
    """Any date-ish column → TIMESTAMP_NTZ, unparseable → null."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast(T.TimestampNTZType())
    txt = c.cast("string")
    parsed = [F.try_to_timestamp(txt, F.lit(fmt)) for fmt in formats]
    ts = parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)
    return ts.cast(T.TimestampNTZType())


def coerce_amount(c: Column, dtype: T.DataType, scale: int = 2) -> Column:
    """Any amount column → DECIMAL(18, scale), bad/NaN → null."""
    target = T.DecimalType(18, scale)
    if isinstance(dtype, T.DecimalType):
        return c.cast(target)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.try_cast(target))
    if isinstance(dtype, T.NumericType):
        return c.try_cast(target)
    txt = c.cast("string")
    return F.when(txt.rlike(NUMBER_PATTERN), F.trim(txt).try_cast(target))


def parse_currency_text(c: Column, scale: int = 2) -> Column:
    """Scraped currency text → amount; ``$`` and ``,`` dropped, failure → 0.

    Unlike ``coerce_amount`` a failure is 0, not null (scraper behaviour).
    """
    target = T.DecimalType(18, scale)
    cleaned = F.trim(F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit("")))
    val = F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast(target))
    return F.coalesce(val, F.lit(0).cast(target))


def coerce_dates(df: DataFrame, formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.withColumns({c: coerce_date(F.col(c), types[c], formats)
                           for c in DATE_FIELDS if c in types})


def coerce_amounts(df: DataFrame, scale: int = 2) -> DataFrame:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if "amount" not in types:
        return df
    return df.withColumn("amount", coerce_amount(F.col("amount"), types["amount"], scale))


def normalize(df: DataFrame, scale: int = 2, date_formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """Typed transaction table with all seven fields present.

    Extra columns of the source are kept after the seven fields.
    """
    df = coerce_amounts(coerce_dates(df, date_formats), scale)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    target = {f.name: f.dataType for f in TXN_SCHEMA.fields}
    target["amount"] = T.DecimalType(18, scale)
    cols = []
    for name, dt in target.items():
        if name in types:
            c = F.col(name)
            cols.append((c if name in ("date", "amount") else c.cast(dt)).alias(name))
        else:
            cols.append(F.lit(None).cast(dt).alias(name, metadata={SYNTHESIZED: True}))
    extra = [c for c in df.columns if c not in target]
    return df.select(*extra, *cols)


def source_columns(df: DataFrame) -> list[str]:
    """Columns the source really has (normalize's synthesized nulls excluded)."""
    return [f.name for f in df.schema.fields if not (f.metadata or {}).get(SYNTHESIZED)]

# Fixed value: so many files are listed without a job.
_FEW_FILES = 32


def _json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of JSON lines and files that are an array document, by the first
    visible character of each; files without one are in neither list. The text
    comes in rows up to a ``}``, fewer than its lines."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.substring(F.ltrim(F.col("value"), F.lit(" \t\r\n\ufeff")), 1, 1).alias("v")).where("v != ''")
    place = F.struct("block", "line")
    found = lines.withColumn("line", F.monotonically_increasing_id()) \
        .groupBy("file").agg(F.min_by("v", place).alias("v")).orderBy("file").collect()
    return [r["file"] for r in found if r["v"] != "["], [r["file"] for r in found if r["v"] == "["]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or files that are one array document each, also side by side.

    The first visible character of a file tells which it is. Array documents are
    cut into lines first, in byte ranges (``json_ranges``). One pass over the
    files finds the fields that are really there, so extra ones are kept and
    filters on absent ones can be skipped; values are read as text. Malformed
    input fails the read instead of becoming null rows."""
    lines, documents = _json_files(spark, path)
    several = bool(lines and documents)

    def quoted(files: list[str]) -> list[str]:  # file names are URIs, and reader paths are patterns
        return [re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(f)) for f in files]

    def reader() -> DataFrameReader:
        folder = several and not re.search(r"[*?{}\[\]]", path)
        return spark.read.option("basePath", path) if folder else spark.read

    sources = [(reader, quoted(lines) if several else path)] if lines or not documents else []
    if documents:
        cut = array_lines(spark, reader, quoted(documents) if several else path, scratch_dir(spark, "json-lines"))
        if cut:  # few files are named in order, so that the order of their rows does not hang on the folder's listing
            files = spark.read.text(cut).inputFiles()
            sources.append((lambda: spark.read.option("basePath", cut), sorted(quoted(files)) if len(files) <= _FEW_FILES else cut))

    types: dict[str, T.DataType] = {}
    for read, files in sources:
        found = read().option("primitivesAsString", True).json(files).schema
        if "_corrupt_record" in found.names:
            raise ValueError(f"{path} has malformed JSON records")
        for f in found.fields:  # a field of two shapes is text, as within one file
            types[f.name] = f.dataType if types.get(f.name, f.dataType) == f.dataType else T.StringType()
    schema = T.StructType([T.StructField(name, kind) for name, kind in types.items()])
    frames = [read().schema(schema).option("mode", "FAILFAST").json(files) for read, files in sources]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      scale: int = 2, date_formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """Read a transaction file set and normalize it.

    CSV is read by header names as text; JSON as ``read_json`` describes.
    Coercion then applies the rules above.
    """
    if fmt == "csv":
        from tally.operators.export import read_exported_csv
        raw = read_exported_csv(spark, path)
    elif fmt == "json":
        raw = read_json(spark, path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return normalize(raw, scale, date_formats)


__all__ = ["NUMBER_PATTERN", "coerce_date", "coerce_amount", "coerce_dates",
           "coerce_amounts", "normalize", "parse_currency_text", "read_transactions",
           "TEXT_FIELDS"]
