"""Cash flow maintained incrementally over arriving transaction files.

The same operator as ``tally.operators.cash_flow`` (inflow, outflow and
count per period), run as a Structured Streaming query:

  readStream (parquet/JSON/CSV files, explicit schema)
    → drop rows without a date, turn the NTZ date into the TIMESTAMP whose
      UTC wall clock it is (watermarks need an instant type; day windows are
      aligned to UTC days, so this keeps them on the record's calendar day
      whatever the session time zone)
    → withWatermark(date, delay) → groupBy(window(date, "1 day"))
    → exact DECIMAL sums and row count per window, kept in the state store
    → update mode, foreachBatch: each micro-batch appends the windows it
      changed, tagged with its batch id, to a parquet table in a shared folder.

The sink is append-only, so a batch that is re-run after a failure simply
re-appends the same rows with the same batch id; the reader keeps, per
window, the row of the highest batch id (``max_by``), which is the final
value. Rows later than the watermark are not counted (streaming semantics);
pick the delay to cover how late files can arrive. The running balance is
not a streaming aggregate; ``read_cash_flow`` computes it from the sink
rows (one per day, bounded) with a window.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tally.functions.money import dsum, is_expense, is_income, to_double
from tally.functions.periods import period_label

# The state holds one row per day inside the watermark and the input is
# partially aggregated before the state shuffle, so a few state partitions
# suffice. The count is fixed in the checkpoint at the first start.
DEFAULT_STATE_PARTITIONS = 8


def _zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")


def wall_to_instant(ntz, zone: str):
    """NTZ wall clock → TIMESTAMP at that wall clock in UTC."""
    return F.from_utc_timestamp(ntz.cast(T.TimestampType()), zone)


def instant_to_wall(ts, zone: str):
    """Inverse of ``wall_to_instant``."""
    return F.to_utc_timestamp(ts, zone).cast(T.TimestampNTZType())


def daily_flows(events: DataFrame, watermark: str) -> DataFrame:
    amt = F.col("amount")
    zone = _zone(events)
    return (events.where(F.col("date").isNotNull())
                  .withColumn("ts", wall_to_instant(F.col("date"), zone))
                  .withWatermark("ts", watermark)
                  .groupBy(F.window("ts", "1 day").alias("w"))
                  .agg(dsum(F.when(is_income(), amt)).alias("inflow"),
                       F.abs(dsum(F.when(is_expense(), amt))).alias("outflow"),
                       F.count(F.lit(1)).alias("transaction_count"))
                  .select(instant_to_wall(F.col("w.start"), zone).alias("day"),
                          "inflow", "outflow", "transaction_count"))


def start_cash_flow_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                           checkpoint_dir: str, schema: T.StructType, watermark: str,
                           fmt: str = "parquet",
                           max_files_per_trigger: int | None = None,
                           max_batches: int | None = None,
                           available_now: bool = True,
                           state_partitions: int = DEFAULT_STATE_PARTITIONS) -> StreamingQuery:
    """Start the query. ``watermark`` says how late rows may come and still be
    counted; ``dropped_rows`` of the query tells how many came later.

    ``max_batches`` bounds the micro-batches that a backlog takes: where there are
    more files, each micro-batch takes more of them, never fewer than
    ``max_files_per_trigger``. What a micro-batch costs beside its rows (plan, state
    and checkpoint files) then does not grow with the backlog."""
    # a session of its own, so that its state partition count touches no other query
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    reader = own.readStream.schema(schema).format(fmt)
    if max_batches:
        n_files = len(own.read.schema(schema).format(fmt).load(source_dir).inputFiles())
        max_files_per_trigger = max(max_files_per_trigger or 1, ceil(n_files / max_batches))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    flows = daily_flows(reader.load(source_dir), watermark)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_dir)

    w = flows.writeStream.outputMode("update").foreachBatch(upsert) \
        .option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows (after partial aggregation) that came after the watermark, over the
    progress reports that the query still keeps."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def read_cash_flow(spark: SparkSession, sink_dir: str, grouping: str = "daily") -> DataFrame:
    """Final daily windows from the sink, rolled up to ``grouping`` with the
    running balance (same columns as ``cash_flow(...).details``)."""
    latest = (spark.read.parquet(sink_dir).groupBy("day")
                   .agg(F.max_by(F.struct("inflow", "outflow", "transaction_count"), "batch_id").alias("v"))
                   .select("day", "v.*"))
    per = (latest.groupBy(period_label(F.col("day"), grouping).alias("period"))
                 .agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"),
                      F.sum("transaction_count").alias("transaction_count")))
    run = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.col("inflow") - F.col("outflow")
    return per.select("period", to_double(F.col("inflow")).alias("inflow"),
                      to_double(F.col("outflow")).alias("outflow"), to_double(net).alias("net_flow"),
                      to_double(F.sum(net).over(run)).alias("running_balance"),
                      "transaction_count").orderBy("period")
