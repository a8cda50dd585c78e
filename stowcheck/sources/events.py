"""Event log: JSON lines partitioned by month."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowcheck import schemas
from stowcheck.functions.times import event_month

# keeps microseconds; the writer's default stops at milliseconds
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_event_log(events: DataFrame, root: str) -> None:
    """Append to the month of each event. Nothing is read back, so writers do not collide."""
    (
        events.withColumn("month", event_month(F.col("timestamp")))
        .write.mode("append")
        .option("timestampFormat", TIME_FORMAT)
        .partitionBy("month")
        .json(root)
    )


def read_event_log(spark: SparkSession, root: str) -> DataFrame:
    """All events under ``root``. Blank and malformed lines are skipped; filter ``month`` to prune."""
    schema = schemas.EVENT.simpleString().removeprefix("struct<").removesuffix(">")
    columns = ", ".join(field.replace(":", " ", 1) for field in schema.split(","))
    return (
        spark.read.schema(f"{columns}, month string")
        .option("mode", "DROPMALFORMED")
        .json(root)
    )


def month_range(since: Column, now: Column) -> Column:
    """Months from ``since`` to ``now`` as ``yyyy-MM``."""
    months = F.sequence(F.trunc(since, "month"), F.trunc(now, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))


def in_months(events: DataFrame, now: Column, since: Column | None = None) -> DataFrame:
    """Events of the previous and the current month, or of all months from ``since`` on.

    The bounds are constants, so partitions are pruned; an absent month contributes nothing.
    """
    first = F.add_months(now, -1) if since is None else since
    months = F.col("month").between(F.date_format(first, "yyyy-MM"), F.date_format(now, "yyyy-MM"))
    chosen = events.where(months)
    return chosen if since is None else chosen.where(F.col("timestamp") >= since)


def union_months(logs: list[DataFrame]) -> DataFrame:
    """Union of month files whose columns may differ."""
    whole = logs[0]
    for log in logs[1:]:
        whole = whole.unionByName(log, allowMissingColumns=True)
    return whole
