"""Schemas of the tables the operators read and write. Timestamps are UTC."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text, _long, _flag, _time = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()

# one table for all sources, partitioned by the last three columns
INVENTORY = _struct(
    bucket=_text,
    label=_text,
    key=_text,
    version_id=_text,
    is_latest=_flag,
    is_delete_marker=_flag,
    size=_long,
    last_modified_date=_time,
    e_tag=_text,
    storage_class=_text,
    checksum_algorithm=_text,
    dt=_text,
    source_alias=_text,
    side=_text,
)
INVENTORY_PARTITIONS = ["dt", "source_alias", "side"]

LISTING = _struct(
    source_alias=_text, label=_text, bucket=_text, key=_text, size=_long, e_tag=_text,
    last_modified=_time, storage_class=_text,
)

# details stays raw JSON: its fields depend on the event type
EVENT = _struct(
    event_id=_long, event_type=_text, source=_text, timestamp=_time, details=_text, actor=_text
)

# every field that some event type has in its details
EVENT_DETAILS = _struct(
    bucket=_text, table=_text, dest_table=_text, table_arn=_text, status=_text, mode=_text, result=_text,
    objects_copied=_long, objects_in_manifest=_long, bytes_transferred=_long, batch_job_id=_text, export_arn=_text,
    restore_point=_time, triggered_by=_text, success=_flag, s3_buckets=_long, dynamodb_tables=_long,
    errors=T.ArrayType(_text),
)

RUN_STATE = _struct(
    bucket=_text,
    source_bucket=_text,
    checked_at=_time,
    status=_text,
    objects_copied=_long,
    bytes_transferred=_long,
    batch_job_id=_text,
    objects_in_manifest=_long,
)

MANIFEST = _struct(bucket=_text, key=_text)

# lines of a finished copy job's report
JOB_REPORT = _struct(
    bucket=_text, key=_text, version_id=_text, task_status=_text, error_code=_text,
    http_status=_text, message=_text,
)

SOURCE = T.StructType(
    [
        T.StructField("source_alias", _text),
        T.StructField("display_name", _text),
        T.StructField("source_account_id", _text),
        T.StructField("inventory_enabled", _flag),
        T.StructField("s3_buckets", T.ArrayType(_struct(arn=_text, label=_text))),
        T.StructField("tables", T.ArrayType(_text)),
    ]
)

ALARM = "AlarmName string, NewStateValue string, NewStateReason string, Region string, " \
    "StateChangeTime string"
