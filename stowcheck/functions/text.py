"""Text extraction from event details, job descriptions and messages."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def failure_reason(message: Column, longest: int = 120) -> Column:
    """Text after the last "because", or the whole message."""
    reason = F.when(
        F.contains(message, F.lit("because")),
        F.btrim(F.substring_index(message, "because", -1)),
    ).otherwise(message)
    return F.left(reason, F.lit(longest))


def truncate_text(text: Column, longest: int, keep: int | None = None) -> Column:
    """Texts over ``longest`` keep their first ``keep`` (default ``longest - 1``) characters."""
    kept = longest - 1 if keep is None else keep
    return F.when(
        F.length(text) > longest, F.concat(F.left(text, F.lit(kept)), F.lit("…"))
    ).otherwise(text)


def description_target(description: Column) -> Column:
    """Text after the last arrow; empty without one."""
    return F.when(
        F.contains(description, F.lit("→")),
        F.btrim(F.substring_index(description, "→", -1)),
    ).otherwise(F.lit(""))


def job_kind(description: Column) -> Column:
    return F.when(description.startswith("restore:"), "restore").otherwise("backup")


def details_field(details: Column, name: str) -> Column:
    return F.get_json_object(details, f"$.{name}")


def event_target(event_type: Column, details: Column) -> Column:
    """The bucket or table an event is about, by event type."""

    def or_unknown(*fields: str) -> Column:
        return F.coalesce(*[details_field(details, f) for f in fields], F.lit("?"))

    table_arn = or_unknown("table_arn")
    return (
        F.when(event_type == "backup_run", or_unknown("bucket", "table"))
        .when(event_type == "test_restore", or_unknown("bucket"))
        .when(event_type.isin("restore_submitted", "restore_completed"), or_unknown("dest_table"))
        .when(event_type == "pitr_reenabled", F.substring_index(table_arn, "/", -1))
    )


def event_extent(details: Column) -> Column:
    """Objects copied, else objects in the manifest, else the export id."""
    copied = details_field(details, "objects_copied")
    listed = details_field(details, "objects_in_manifest")
    export = F.substring_index(details_field(details, "export_arn"), "/", -1)
    return F.coalesce(
        F.concat(copied, F.lit(" objects")),
        F.concat(listed, F.lit(" objects in manifest")),
        export,
    )
