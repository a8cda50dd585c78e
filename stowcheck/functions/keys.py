"""Object keys, names and paths."""

from functools import reduce
from operator import or_
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowcheck.constants import (
    MAX_BUCKET_NAME,
    MAX_TABLE_NAME,
    OPERATIONAL_PREFIXES,
    REGION,
    RESTORE_SUFFIX,
)


def is_operational(key: Column) -> Column:
    """Key lies under a reserved prefix. A prefix test, not LIKE: ``_`` is no wildcard here.

    The start all prefixes share is tested first: nearly every key stops there.
    """
    shared = commonprefix(OPERATIONAL_PREFIXES)
    return key.startswith(shared) & reduce(or_, (key.startswith(p) for p in OPERATIONAL_PREFIXES))


def encode_key(key: Column) -> Column:
    """Percent-encode UTF-8, keeping ``/`` and the unreserved characters."""
    encoded = F.url_encode(key)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def sanitize_identifier(value: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_]", "_"), "_+", "_")
    cleaned = F.lower(F.btrim(squeezed, F.lit("_")))
    return F.when(cleaned == "", "x").otherwise(cleaned)


_URI = r"(?s)^s3://([^/]+)/(.+)$"


def uri_is_valid(uri: Column) -> Column:
    return F.coalesce(uri.rlike(_URI), F.lit(False))


def uri_bucket(uri: Column) -> Column:
    return F.when(uri_is_valid(uri), F.regexp_extract(uri, _URI, 1))


def uri_key(uri: Column) -> Column:
    return F.when(uri_is_valid(uri), F.regexp_extract(uri, _URI, 2))


_SYMLINK = r"^(.*)/hive/dt=([^/]+)/symlink\.txt$"


def symlink_dt(path: Column) -> Column:
    return F.when(path.rlike(_SYMLINK), F.regexp_extract(path, _SYMLINK, 2))


def symlink_root(path: Column) -> Column:
    """Everything up to and including ``/hive/``."""
    return F.when(
        path.rlike(_SYMLINK), F.concat(F.regexp_extract(path, _SYMLINK, 1), F.lit("/hive/"))
    )


# inventory/<alias>/<side>/<bucket>/<bucket>/<id>/hive/dt=<dt>/symlink.txt
_DELIVERY = r"(?:^|/)inventory/([^/]+)/(source|backup)/([^/]+)/.*/hive/dt=([^/]+)/symlink\.txt$"


def delivery_fields(path: Column) -> Column:
    """(source_alias, side, bucket, dt) that the path of a delivered snapshot names; NULL for other paths."""
    names = ("source_alias", "side", "bucket", "dt")
    fields = [F.regexp_extract(path, _DELIVERY, i + 1).alias(name) for i, name in enumerate(names)]
    return F.when(path.rlike(_DELIVERY), F.struct(*fields))


def arn_bucket(arn: Column) -> Column:
    return F.substring_index(arn, ":::", -1)


def arn_table(arn: Column) -> Column:
    return F.substring_index(arn, "/", -1)


def arn_account(arn: Column) -> Column:
    return F.try_element_at(F.split(arn, ":"), F.lit(5))


def backup_bucket_name(
    alias: Column, label: Column, account: Column, region: str = REGION
) -> Column:
    return F.concat_ws(
        "-", F.lit("bb"), alias, F.lit("s3"), label, F.lit(region), account
    )


def export_bucket_name(alias: Column, account: Column, region: str = REGION) -> Column:
    return F.concat_ws("-", F.lit("bb"), alias, F.lit("dynamo"), F.lit(region), account)


def _restore_name(base: Column, longest: int) -> Column:
    return F.concat(F.left(base, F.lit(longest - len(RESTORE_SUFFIX))), F.lit(RESTORE_SUFFIX))


def restore_bucket_name(bucket: Column) -> Column:
    return _restore_name(bucket, MAX_BUCKET_NAME)


def restore_table_name(table_arn: Column) -> Column:
    return _restore_name(arn_table(table_arn), MAX_TABLE_NAME)
