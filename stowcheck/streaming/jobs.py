"""Streams: event ingest, alarms, metric windows, staleness and pending restores.

Event time is the record's own time with a watermark of one hour; duplicates go by event id.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stowcheck import schemas
from stowcheck.constants import (
    ALARM_SEVERITY,
    BACKUP_AGE_RED_HOURS,
    BACKUP_AGE_YELLOW_HOURS,
    METRIC_WINDOW_MINUTES,
    SUCCESS_STATUSES,
)
from stowcheck.functions.times import event_month
from stowcheck.sources.events import TIME_FORMAT

WATERMARK = "1 hour"
RESTORE_WAIT = "7 days"


def file_stream(spark: SparkSession, folder: str, name: str, time: str = "ts") -> DataFrame:
    """Stream of one table's Parquet files; the schema is that of the stored table."""
    schema: StructType = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # one file, or a folder of any number of files; a path without a pattern would have to be a folder
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def run_to_end(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    file_format: str = "parquet",
    partition: str | None = None,
    timeout_seconds: int | None = None,
) -> StreamingQuery:
    """Process everything available into a file sink and stop, however long it takes.

    State lives in RocksDB (see ``SQL_SETTINGS``). With ``timeout_seconds`` a longer run is stopped and raises.
    """
    writer = (
        stream.writeStream.format(file_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("timestampFormat", TIME_FORMAT)
        .trigger(availableNow=True)
    )
    if partition:
        writer = writer.partitionBy(partition)
    query = writer.start(path)
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout_seconds} s")
    return query


def deduplicated_events(events: DataFrame, time: str = "ts") -> DataFrame:
    """Events by month for a partitioned sink, each id once."""
    return (
        events.withWatermark(time, WATERMARK)
        .dropDuplicatesWithinWatermark(["event_id"])
        .withColumn("month", event_month(F.col(time)))
    )


def parsed_alarms(messages: DataFrame) -> DataFrame:
    """Alarm fields of every message; NULL name for non-JSON messages and those without a name."""
    parsed = F.from_json("message", schemas.ALARM, {"mode": "PERMISSIVE"})
    return messages.withColumn("_alarm", parsed).withColumn("name", F.col("_alarm.AlarmName"))


def delivered_alarms(messages: DataFrame) -> DataFrame:
    """Messages to deliver with title and severity. Works on a table and on a stream."""
    severity = F.create_map(*[F.lit(v) for pair in ALARM_SEVERITY.items() for v in pair])
    state = F.coalesce("_alarm.NewStateValue", F.lit("(unknown)"))
    return (
        parsed_alarms(messages)
        .where(F.col("name").isNotNull())
        .select(
            "event_id",
            "ts",
            "name",
            state.alias("state"),
            F.coalesce(F.try_element_at(severity, state), F.lit("blue")).alias("severity"),
            F.concat("name", F.lit(" → "), state).alias("title"),
            F.left(F.coalesce("_alarm.NewStateReason", F.lit("")), F.lit(1024)).alias("reason"),
        )
    )


def alarm_counts(messages: DataFrame) -> DataFrame:
    return parsed_alarms(messages).agg(
        F.count_if(F.col("name").isNotNull()).alias("delivered"),
        F.count_if(F.col("name").isNull()).alias("skipped"),
    )


def metric_windows(
    points: DataFrame,
    by: str,
    minutes: int = METRIC_WINDOW_MINUTES,
    slide: str = "30 minutes",
    time: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Sliding trailing sums over tumbling 60 s bins; later than the watermark is dropped.

    Points are summed into bins first, so a sliding window adds bins, not points.
    """
    bins = (
        points.withWatermark(time, WATERMARK)
        .groupBy(by, F.window(time, "60 seconds").alias("bin"))
        .agg(F.sum(value).alias("bin_total"))
    )
    return (
        bins.groupBy(by, F.window(F.window_time("bin"), f"{minutes} minutes", slide).alias("span"))
        .agg(
            F.sum("bin_total").alias("total"),
            F.max(F.when(F.col("bin_total") > 0, F.col("bin.start"))).alias("last_nonzero_at"),
        )
        .select(by, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "total", "last_nonzero_at")
    )


def staleness(runs: DataFrame, by: str, time: str = "ts") -> DataFrame:
    """A row when a source has had no successful run for the yellow and for the red limit.

    A session of successes ends one limit after its last one, which is when the source turns
    stale. Sessions are merged in each task before the shuffle, so a busy source stays cheap.
    """
    succeeded = runs.where(F.col("status").isin(*SUCCESS_STATUSES)).withWatermark(time, WATERMARK)

    def lane(level: str, hours: float) -> DataFrame:
        return (
            succeeded.groupBy(by, F.session_window(time, f"{hours:.0f} hours").alias("session"))
            .agg(F.count("*").alias("successes"))
            .select(
                by,
                F.lit(level).alias("level"),
                F.col("session.start").alias("first_success_at"),
                F.col("session.end").alias("stale_at"),
                "successes",
            )
        )

    return lane("yellow", BACKUP_AGE_YELLOW_HOURS).unionByName(lane("red", BACKUP_AGE_RED_HOURS))


def silent_sources(events: DataFrame, by: str, time: str = "ts") -> DataFrame:
    """A row when a registered source has been without success for the yellow and for the red limit.

    ``events``: ``by``, ``time``, ``registered`` and ``succeeded`` of every event of the log. All of them move
    the watermark, as heartbeats, so a source that falls silent is reported while any other writes; union
    rows without flags where none may. A registration opens the wait as a success does: a source that never
    succeeds is reported one limit after it, with no successes. Events of an unregistered source that
    succeeded count too. NULL flags are false; events later than the watermark are dropped.
    """
    watched = events.withWatermark(time, WATERMARK)
    registered, succeeded = (F.coalesce(name, F.lit(False)) for name in ("registered", "succeeded"))

    def lane(level: str, hours: float) -> DataFrame:
        # windows without length are dropped, but only above the watermark, which has seen their rows
        gap = F.when(registered | succeeded, f"{hours:.0f} hours").otherwise("0 seconds")
        done = F.when(succeeded, F.col(time))
        return (
            watched.groupBy(by, F.session_window(time, gap).alias("session"))
            .agg(F.count(done).alias("successes"), F.min(done).alias("first_success_at"), F.max(done).alias("last_success_at"))
            .select(
                by,
                F.lit(level).alias("level"),
                F.col("session.start").alias("waiting_since"),
                "first_success_at",
                "last_success_at",
                F.col("session.end").alias("stale_at"),
                "successes",
            )
        )

    return lane("yellow", BACKUP_AGE_YELLOW_HOURS).unionByName(lane("red", BACKUP_AGE_RED_HOURS))


def completed_restores(entries: DataFrame, statuses: DataFrame, wait: str = RESTORE_WAIT) -> DataFrame:
    """Two events per restored table, once, when it is reported ACTIVE within ``wait`` of its submission.

    ``entries``: table_name, restore_arn, source, submitted_at. ``statuses``: table_name, table_status,
    reported_at. Either may arrive first, and clocks may differ by the watermark. Reports are repeated until
    a watcher stops, so the first ACTIVE one of a table is kept for ``wait``. State of both sides expires with
    the watermarks; a table that isn't ACTIVE within ``wait`` emits nothing.
    """
    submitted = entries.withWatermark("submitted_at", WATERMARK).dropDuplicatesWithinWatermark(["restore_arn"])
    active = (
        statuses.where(F.col("table_status") == "ACTIVE")
        .select(F.col("table_name").alias("_table"), "reported_at")
        .withWatermark("reported_at", wait)
        .dropDuplicatesWithinWatermark(["_table"])
    )
    in_time = F.col("reported_at").between(
        F.expr(f"submitted_at - INTERVAL {WATERMARK}"), F.expr(f"submitted_at + INTERVAL {wait}")
    )
    kinds = F.array(*map(F.lit, ("restore_completed", "pitr_reenabled")))
    return submitted.join(active, (F.col("table_name") == F.col("_table")) & in_time).select(
        "table_name", "restore_arn", "source", F.explode(kinds).alias("event_type")
    )
