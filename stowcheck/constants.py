"""Fixed values and default parameters."""

# --- fixed values: reserved key prefixes, checksum priority, storage classes ---
OPERATIONAL_PREFIXES = ("_state/", "_manifests/", "_batch-reports/", "_events/")

# (name in reports, column) in priority order
CHECKSUM_ALGORITHMS = (
    ("ChecksumCRC64NVME", "crc64nvme"),
    ("ChecksumCRC32", "crc32"),
    ("ChecksumCRC32C", "crc32c"),
    ("ChecksumSHA256", "sha256"),
    ("ChecksumSHA1", "sha1"),
)

ARCHIVED_CLASSES = ("DEEP_ARCHIVE", "GLACIER", "GLACIER_IR")

SUCCESS_STATUSES = ("completed", "skipped", "submitted")

# hours east of UTC per accepted zone abbreviation
ZONE_HOURS = {"UTC": 0, "NZST": 12, "NZDT": 13, "AEST": 10, "AEDT": 11}

REPORT_ZONE = "Pacific/Auckland"
RESTORE_SUFFIX = "-restore"
MAX_BUCKET_NAME = 63
MAX_TABLE_NAME = 255
REGION = "ap-southeast-2"

ALARM_SEVERITY = {"ALARM": "red", "OK": "green", "INSUFFICIENT_DATA": "blue"}

# --- default parameters ---
FRESHNESS_HOURS = 30.0
BACKUP_AGE_RED_HOURS = 36.0
BACKUP_AGE_YELLOW_HOURS = 12.0
BATCH_FAILURE_RED = 0.10
RESTORE_SAMPLE_SIZE = 10
MISSING_SAMPLE_SIZE = 10
RECENT_JOBS = 3
RECENT_EXPORTS = 5
PURGE_BATCH_SIZE = 1000
EVENT_LIMIT = 50
METRIC_WINDOW_MINUTES = 120
HOT_DAYS = 30
VERSION_RETENTION_DAYS = 365

# --- rates (NZD per GB and month unless said otherwise) ---
BYTES_PER_GB = 1024**3
STORAGE_RATES = {"STANDARD": 0.036, "GLACIER_IR": 0.007}
RETRIEVAL_RATE = 0.079
AUTO_APPROVE_NZD = 100.0
DUAL_APPROVAL_NZD = 500.0
EXPORT_RATE = 0.16
# USD
JOB_FEE = 0.25
OBJECT_FEE_PER_MILLION = 1.00
MONITORING_PER_THOUSAND = 0.0025
TIERED_FREQUENT_RATE = 0.025
TIERED_ARCHIVE_RATE = 0.004
TIERED_FLOOR_BYTES = 128 * 1024
