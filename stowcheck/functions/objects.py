"""Predicates over inventory and listing rows.

Three different "changed" rules exist on purpose: ``needs_copy_smart`` for snapshot manifests,
``needs_copy_strict`` for live listings, and the checksum cascade in ``operators.integrity``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowcheck.constants import ARCHIVED_CLASSES, CHECKSUM_ALGORITHMS


def is_current(is_latest: Column, is_delete_marker: Column) -> Column:
    """Current, not deleted. Unversioned buckets carry NULL flags and count as current."""
    return F.coalesce(is_latest, F.lit(True)) & ~F.coalesce(is_delete_marker, F.lit(False))


def is_archived(storage_class: Column) -> Column:
    return F.coalesce(storage_class.isin(*ARCHIVED_CLASSES), F.lit(False))


def is_multipart(e_tag: Column) -> Column:
    """Multipart uploads carry a ``-N`` suffix; such tags do not depend on content alone."""
    return F.instr(e_tag, "-") > 0


def normalize_etag(e_tag: Column) -> Column:
    return F.btrim(e_tag, F.lit('"'))


def quote_etag(e_tag: Column) -> Column:
    return F.concat(F.lit('"'), normalize_etag(e_tag), F.lit('"'))


def _true(condition: Column) -> Column:
    # a NULL size or tag on either side counts as "not different"
    return F.coalesce(condition, F.lit(False))


def etag_differs_smart(src_tag: Column, dst_tag: Column) -> Column:
    """Compare tags only where both are single-part."""
    return _true(~is_multipart(src_tag) & ~is_multipart(dst_tag) & (src_tag != dst_tag))


def needs_copy_smart(
    missing: Column, src_size: Column, dst_size: Column, src_tag: Column, dst_tag: Column
) -> Column:
    return missing | _true(src_size != dst_size) | etag_differs_smart(src_tag, dst_tag)


def needs_copy_strict(
    missing: Column,
    src_size: Column,
    dst_size: Column,
    src_tag: Column,
    dst_tag: Column,
    full_sync: bool = False,
) -> Column:
    """Tag and size compared NULL-safely: a NULL against a value is a difference."""
    if full_sync:
        return F.lit(True)
    return missing | ~src_tag.eqNullSafe(dst_tag) | ~src_size.eqNullSafe(dst_size)


def pick_checksum(columns: list[str], prefix: str = "") -> Column:
    """``struct<algorithm, value>`` of the first non-empty checksum in priority order, or NULL."""
    choices = [
        F.when(
            F.col(prefix + column) != "",
            F.struct(F.lit(name).alias("algorithm"), F.col(prefix + column).alias("value")),
        )
        for name, column in CHECKSUM_ALGORITHMS
        if column in columns
    ]
    return F.coalesce(*choices)
