"""SQL twins of the registered queries, for DuckDB over the driver tables."""

from stowcheck.plans.fixture_sql import with_views

TODAY = "'2024-01-30-01-00'"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
RUN_AT = "TIMESTAMP '2024-01-30 06:00:00'"
IN_WINDOW = "BETWEEN TIMESTAMP '1998-01-01 00:00:00' AND TIMESTAMP '1998-12-31 23:59:59'"
WINDOW_START = "TIMESTAMP '1998-01-01 00:00:00'"
STATE_AT = "TIMESTAMP '1999-06-30 00:00:00'"
EXPIRY_AT = "TIMESTAMP '2001-08-02 00:00:00'"
TIER_DAY = "DATE '2001-11-10'"
GB = "1073741824.0"
ALIAS = "CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'bravo' WHEN 2 THEN 'charlie' ELSE 'delta' END"

_NOT_RESERVED = (
    "NOT (starts_with({0},'_state/') OR starts_with({0},'_manifests/') "
    "OR starts_with({0},'_batch-reports/') OR starts_with({0},'_events/'))"
)
NOT_RESERVED = _NOT_RESERVED.format("key")
ENCODED = "replace(url_encode({0}), '%2F', '/')"
ON_KEY = "s.source_alias = b.source_alias AND s.label = b.label AND s.key = b.key"
SMART = (
    "b.key IS NULL OR s.size <> b.size "
    "OR (instr(s.e_tag,'-') = 0 AND instr(b.e_tag,'-') = 0 AND s.e_tag <> b.e_tag)"
)
STRICT = "b.key IS NULL OR s.e_tag IS DISTINCT FROM b.e_tag OR s.size IS DISTINCT FROM b.size"
PAIR = (
    "s.source_alias, s.label, s.key, b.key IS NULL AS missing, s.size, b.size AS backup_size, "
    "s.e_tag, b.e_tag AS backup_e_tag"
)
MANIFEST = (
    f"SELECT s.source_alias, s.bucket, {ENCODED.format('s.key')} AS key "
    f"FROM fx_s s LEFT JOIN fx_b b ON {ON_KEY} WHERE {SMART}"
)
NEWEST_MANIFEST = MANIFEST.replace("fx_s ", "fx_ns ").replace("fx_b ", "fx_nb ")
B_CURRENT = f"(SELECT * FROM fx_cur WHERE side = 'backup' AND dt = {TODAY})"
MISSING = f"(SELECT s.source_alias, s.label, s.key FROM fx_s s ANTI JOIN fx_b b ON {ON_KEY})"
NEWEST_MISSING = MISSING.replace("fx_s ", "fx_ns ").replace("fx_b ", "fx_nb ")
RESTORABLE = (
    "(SELECT * FROM fx_b WHERE storage_class IS NULL OR storage_class NOT IN "
    "('GLACIER','DEEP_ARCHIVE','GLACIER_IR'))"
)
SAMPLE = (
    "(SELECT source_alias, label, key, e_tag, size FROM (SELECT *, row_number() OVER "
    "(PARTITION BY source_alias, label ORDER BY md5(concat('0', key)), key) AS rn FROM {0}) WHERE rn <= {1})"
).format(RESTORABLE, "{0}")
# first checksum in priority order of the two the fixture has
ALGO = "CASE WHEN {0}crc64nvme <> '' THEN 'ChecksumCRC64NVME' WHEN {0}sha256 <> '' THEN 'ChecksumSHA256' END"
CVAL = "CASE WHEN {0}crc64nvme <> '' THEN {0}crc64nvme WHEN {0}sha256 <> '' THEN {0}sha256 END"
CK = (
    f"(SELECT side, source_alias, label, key, {ALGO.format('')} AS algo, {CVAL.format('')} AS val FROM fx_checksum)"
)

INTEGRITY = f"""
(SELECT s.source_alias, s.label, s.key, s.e_tag AS source_etag, b.e_tag AS backup_etag,
  CASE WHEN b.key IS NULL THEN 'missing_in_backup'
       WHEN cs.algo = cb.algo AND cs.val = cb.val THEN 'verified'
       WHEN instr(s.e_tag,'-') > 0 OR instr(b.e_tag,'-') > 0 THEN 'verified'
       ELSE 'etag_mismatch' END AS issue,
  b.key IS NOT NULL AND coalesce(cs.algo = cb.algo AND cs.val <> cb.val, false) AS checksum_conflict
FROM (SELECT * FROM fx_src_listing WHERE {NOT_RESERVED}) s
LEFT JOIN (SELECT * FROM fx_live WHERE {NOT_RESERVED}) b ON {ON_KEY}
LEFT JOIN {CK} cs ON cs.side = 'source' AND cs.source_alias = s.source_alias AND cs.label = s.label AND cs.key = s.key
LEFT JOIN {CK} cb ON cb.side = 'backup' AND cb.source_alias = s.source_alias AND cb.label = s.label AND cb.key = s.key
WHERE b.key IS NULL OR s.e_tag <> b.e_tag)
"""

VERIFIED = f"""
(SELECT s.source_alias, s.label, s.key,
  CASE WHEN t.key IS NULL THEN 'copy_error'
       WHEN o.algo = c.algo THEN CASE WHEN o.val = c.val THEN 'verified' ELSE 'mismatch' END
       WHEN t.e_tag = s.e_tag THEN 'verified' ELSE 'mismatch' END AS outcome,
  CASE WHEN t.key IS NULL THEN 'object not found in restore target'
       WHEN o.algo = c.algo AND o.val <> c.val THEN concat(o.algo, ' mismatch: ', o.val, ' != ', c.val)
       WHEN o.algo IS DISTINCT FROM c.algo AND t.e_tag <> s.e_tag THEN concat('ETag mismatch: ', t.e_tag, ' != ', s.e_tag)
  END AS detail
FROM {{sample}} s
LEFT JOIN fx_src_listing t ON t.source_alias = s.source_alias AND t.label = s.label AND t.key = s.key
LEFT JOIN {CK} o ON o.side = 'backup' AND o.source_alias = s.source_alias AND o.label = s.label AND o.key = s.key
LEFT JOIN {CK} c ON c.side = 'source' AND c.source_alias = s.source_alias AND c.label = s.label AND c.key = s.key)
"""


def _bucket_results(sample: str, pairs: str = "fx_pair") -> str:
    return f"""
(SELECT r.source_alias, r.label, r.source_bucket, r.backup_bucket, coalesce(n, 0) AS sample_count,
  coalesce(ce, '') AS errors, coalesce(mm, '') AS mismatches,
  CASE WHEN coalesce(n, 0) = 0 THEN 'skipped' WHEN ce <> '' OR mm <> '' THEN 'failed' ELSE 'passed' END AS result
FROM {pairs} r LEFT JOIN (SELECT source_alias, label, count(*) AS n,
  string_agg(concat(key, ': ', detail), '; ' ORDER BY key) FILTER (outcome = 'copy_error') AS ce,
  string_agg(concat(key, ': ', detail), '; ' ORDER BY key) FILTER (outcome = 'mismatch') AS mm
  FROM {VERIFIED.format(sample=sample)} GROUP BY 1, 2) v ON v.source_alias = r.source_alias AND v.label = r.label)
"""


def _restore_overall(results: str) -> str:
    return f"""
(SELECT source_alias, CASE WHEN bool_or(result = 'failed') THEN 'failed' WHEN bool_and(result = 'skipped') THEN 'skipped' ELSE 'passed' END AS result
FROM {results} GROUP BY 1)
"""


STATES = (
    "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY checked_at DESC, "
    "event_id DESC) AS rn FROM fx_run_state) WHERE rn = 1)"
)
GOOD = "status IN ('completed','skipped','submitted')"
LATEST_EXPORT = """
(SELECT t.source_alias, t.table_name, e.export_arn, e.status, e.export_time,
  CASE e.status WHEN 'COMPLETED' THEN 'completed' WHEN 'IN_PROGRESS' THEN 'in_progress' WHEN 'FAILED' THEN 'failed' ELSE 'no_recent' END AS lane
FROM fx_table t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_alias, table_name ORDER BY export_time DESC, export_arn) AS rn FROM fx_export) e
  ON e.source_alias = t.source_alias AND e.table_name = t.table_name AND e.rn = 1)
"""
LAST_BACKUP = f"""
(SELECT source_alias, max(t) AS last_backup_at, (epoch_us({NOW}) - epoch_us(max(t))) / 3.6e9 AS last_backup_age_hours
FROM (SELECT source_alias, checked_at AS t FROM {STATES} WHERE {GOOD}
  UNION ALL SELECT source_alias, export_time FROM {LATEST_EXPORT} WHERE lane = 'completed') GROUP BY source_alias)
"""
EXPORT_SUMMARY = f"""
(SELECT source_alias, count(*) FILTER (lane = 'completed') AS completed, count(*) FILTER (lane = 'in_progress') AS in_progress,
  count(*) FILTER (lane = 'failed') AS failed, count(*) FILTER (lane = 'no_recent') AS no_recent, CAST(0 AS BIGINT) AS errored
FROM {LATEST_EXPORT} GROUP BY source_alias)
"""
FAILURES = """
(SELECT bucket, job_id, status, total_tasks, tasks_failed,
  CASE WHEN total_tasks = 0 THEN 0.0 ELSE tasks_failed / total_tasks::DOUBLE END AS failure_pct,
  CASE WHEN total_tasks = 0 THEN false ELSE tasks_failed / total_tasks::DOUBLE > 0.1 END AS alarming
FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY creation_time DESC, job_id) AS rn FROM fx_job) WHERE rn = 1)
"""
FRESHNESS = f"""
(SELECT *, coalesce(age_hours > 30, false) AS stale FROM (SELECT source_alias, source_latest, backup_latest, effective_data_ts,
  (epoch_us({NOW}) - epoch_us(effective_data_ts)) / 3.6e9 AS age_hours
FROM (SELECT *, CASE WHEN source_latest IS NOT NULL AND backup_latest IS NOT NULL THEN least(source_latest, backup_latest) END AS effective_data_ts
  FROM (SELECT source_alias, max(last_modified) FILTER (side = 'source' AND size > 0) AS source_latest,
    max(last_modified) FILTER (side = 'backup' AND size > 0) AS backup_latest FROM fx_delivery GROUP BY 1))))
"""
COUNTS = "(SELECT source_alias, side, dt, count(*) AS objects FROM fx_cur GROUP BY ALL)"
GROWTH = f"""
(SELECT source_alias, side, dt, objects, lag(dt) OVER w AS previous_dt, lag(objects) OVER w AS previous_objects,
  objects - lag(objects) OVER w AS delta,
  CASE WHEN lag(objects) OVER w <> 0 THEN (objects - lag(objects) OVER w) / (lag(objects) OVER w)::DOUBLE * 100 END AS delta_pct
FROM {COUNTS} WHERE side = 'source' WINDOW w AS (PARTITION BY source_alias, side ORDER BY dt))
"""
BUCKET_COUNTS = """
(SELECT source_alias, label, side, dt, count(*) FILTER ((is_latest OR is_latest IS NULL) AND (NOT is_delete_marker OR is_delete_marker IS NULL)) AS objects
FROM fx_inventory GROUP BY ALL)
"""
DELTA = f"""
(SELECT source_alias, label, dt AS today_dt, objects AS today_count, previous_dt AS yesterday_dt, previous_objects AS yesterday_count,
  objects - previous_objects AS delta, CASE WHEN previous_objects <> 0 THEN (objects - previous_objects) / previous_objects::DOUBLE * 100 END AS delta_pct,
  previous_dt IS NOT NULL AS available
FROM (SELECT *, lag(dt) OVER w AS previous_dt, lag(objects) OVER w AS previous_objects, row_number() OVER (PARTITION BY source_alias, label ORDER BY dt DESC) AS rn
  FROM {BUCKET_COUNTS} WHERE side = 'source' WINDOW w AS (PARTITION BY source_alias, label ORDER BY dt)) WHERE rn = 1)
"""
SOURCE_DELTA = f"""
(SELECT source_alias, CAST(n - b AS BIGINT) AS delta, CASE WHEN b <> 0 THEN (n - b) / b::DOUBLE * 100 END AS delta_pct
FROM (SELECT source_alias, sum(today_count) FILTER (available) AS n, sum(yesterday_count) AS b FROM {DELTA} GROUP BY 1))
"""
DIVERGENCE = f"""
(SELECT n.source_alias, n.label, source_dt, backup_dt, CASE WHEN source_dt IS NOT NULL AND backup_dt IS NOT NULL THEN coalesce(m, 0) END AS source_minus_backup,
  CASE WHEN source_dt IS NOT NULL AND backup_dt IS NOT NULL THEN coalesce(o, 0) END AS backup_minus_source, source_dt IS NOT NULL AND backup_dt IS NOT NULL AS available
FROM (SELECT source_alias, label, max(dt) FILTER (side = 'source') AS source_dt, max(dt) FILTER (side = 'backup') AS backup_dt FROM fx_newest GROUP BY 1, 2) n
LEFT JOIN (SELECT coalesce(s.source_alias, b.source_alias) AS source_alias, coalesce(s.label, b.label) AS label,
    count(*) FILTER (b.key IS NULL) AS m, count(*) FILTER (s.key IS NULL) AS o
  FROM fx_ns s FULL OUTER JOIN fx_nb b ON {ON_KEY} GROUP BY 1, 2) d ON d.source_alias = n.source_alias AND d.label = n.label)
"""
SOURCE_DIVERGENCE = f"""
(SELECT p.source_alias, CAST(sum(source_minus_backup) AS BIGINT) AS source_minus_backup, CAST(sum(backup_minus_source) AS BIGINT) AS backup_minus_source,
  count(*) FILTER (NOT coalesce(available, false)) AS buckets_unavailable
FROM fx_pair p LEFT JOIN {DIVERGENCE} d ON d.source_alias = p.source_alias AND d.label = p.label GROUP BY 1)
"""
MISSING_SAMPLE = f"(SELECT source_alias, label, key FROM (SELECT *, row_number() OVER (PARTITION BY source_alias, label ORDER BY key) AS rn FROM {MISSING}) WHERE rn <= 10)"
NEWEST_MISSING_SAMPLE = MISSING_SAMPLE.replace("fx_s ", "fx_ns ").replace("fx_b ", "fx_nb ")
HEAD = f"""
(SELECT *, CASE WHEN still_missing = sample_size THEN format(' (still missing live, sampled {{}})', sample_size)
  WHEN auto_healed = sample_size THEN format(' (auto-healed since snapshot, sampled {{}})', sample_size)
  ELSE format(' ({{}} still missing, {{}} auto-healed, sampled {{}})', still_missing, auto_healed, sample_size) END AS tag
FROM (SELECT m.source_alias, count(*) AS sample_size, count(*) FILTER (l.key IS NULL) AS still_missing, count(*) FILTER (l.key IS NOT NULL) AS auto_healed
  FROM {MISSING_SAMPLE} m LEFT JOIN (SELECT DISTINCT source_alias, label, key FROM fx_live) l ON l.source_alias = m.source_alias AND l.label = m.label AND l.key = m.key GROUP BY 1))
"""
NEWEST_HEAD = HEAD.replace("fx_s ", "fx_ns ").replace("fx_b ", "fx_nb ")
PITR = "(SELECT source_alias, bool_and(coalesce(pitr_status = 'ENABLED', false)) AS pitr_enabled FROM fx_table GROUP BY 1)"
OWNED_FAILURES = f"(SELECT f.*, b.source_alias FROM {FAILURES} f JOIN fx_bucket b ON b.bucket = f.bucket)"
PROCESS = f"""
(SELECT r.source_alias, a.last_backup_at, a.last_backup_age_hours, w.worst_failure_pct, coalesce(w.alarming_buckets, 0) AS alarming_buckets,
  coalesce(e.completed, 0) AS exports_completed, coalesce(e.in_progress, 0) AS exports_in_progress, coalesce(e.failed, 0) AS exports_failed,
  coalesce(e.no_recent, 0) AS exports_no_recent, coalesce(e.errored, 0) AS exports_errored
FROM fx_registry r LEFT JOIN {LAST_BACKUP} a ON a.source_alias = r.source_alias
LEFT JOIN (SELECT source_alias, max(failure_pct) AS worst_failure_pct, count(*) FILTER (alarming) AS alarming_buckets FROM {OWNED_FAILURES} GROUP BY 1) w ON w.source_alias = r.source_alias
LEFT JOIN {EXPORT_SUMMARY} e ON e.source_alias = r.source_alias)
"""
DUE = "(SELECT * FROM fx_pair WHERE source_alias IN ('alpha', 'charlie'))"
DUE_SAMPLE = f"(SELECT * FROM {SAMPLE.format(10).replace('fx_b ', 'fx_nb ')} WHERE source_alias IN ('alpha', 'charlie'))"

THREE_COLORS = """
CASE WHEN restore_result = 'failed' OR NOT pitr_enabled OR (inventory_enabled AND inventory_age_hours IS NULL)
    OR (inventory_enabled AND missing > 0) OR backup_age_hours > 36 OR failure_pct > 0.1 OR exports_failed > 0 THEN 'red'
  WHEN (inventory_enabled AND inventory_age_hours > 30) OR backup_age_hours > 12 THEN 'yellow' ELSE 'green' END
"""
FOUR_COLORS = """
CASE WHEN restore_result = 'failed' OR NOT pitr_enabled OR (inventory_enabled AND inventory_age_hours IS NULL)
    OR (inventory_enabled AND missing > 0 AND still_missing > 0) THEN 'red'
  WHEN inventory_enabled AND ((missing > 0 AND still_missing = 0) OR inventory_age_hours > 30 OR orphans > 0 OR delta <> 0) THEN 'amber'
  WHEN coalesce(restore_result, 'passed') = 'passed' AND (NOT inventory_enabled OR (delta = 0 AND orphans = orphans_before AND inventory_age_hours <= 30)) THEN 'blue'
  ELSE 'green' END
"""

BATCH_LINES = f"""
(SELECT source_alias,
  list(CASE WHEN total_tasks > 0 AND failure_pct > 0.1 THEN format('S3 batch {{}}: {{:,}}/{{:,}} failed ({{:.0f}}%, > 10% red threshold)', bucket, tasks_failed, total_tasks, round_even(failure_pct * 100, 0)) END ORDER BY bucket) AS warns,
  list(CASE WHEN NOT (total_tasks > 0 AND failure_pct > 0.1) AND tasks_failed > 0 THEN format('S3 batch {{}}: {{:,}}/{{:,}} failed ({{:.1f}}%)', bucket, tasks_failed, total_tasks, round_even(failure_pct * 100, 1)) END ORDER BY bucket) AS infos
FROM {OWNED_FAILURES} GROUP BY 1)
"""
REPORT = f"""
(SELECT *, {THREE_COLORS} AS overall,
  list_filter(list_concat([CASE WHEN inventory_enabled AND inventory_age_hours IS NULL THEN 'no inventory data available' END,
    CASE WHEN inventory_enabled AND missing > 0 THEN format('backup is missing {{:,}} source keys{{}}', missing, coalesce(tag, '')) END,
    CASE WHEN backup_age_hours IS NULL THEN 'no recent backup run on record (never run? config drift?)'
      WHEN backup_age_hours > 36 THEN format('last backup {{:.1f}}h ago (> 36h red threshold)', round_even(backup_age_hours, 1))
      WHEN backup_age_hours > 12 THEN format('last backup {{:.1f}}h ago (> 12h yellow threshold)', round_even(backup_age_hours, 1)) END],
    coalesce(warns, []),
    [CASE WHEN exports_failed > 0 THEN format('DynamoDB exports: {{}} table(s) FAILED on last run', exports_failed) END]), lambda x: x IS NOT NULL) AS note_list,
  list_filter(list_concat([CASE WHEN inventory_enabled AND delta <> 0 THEN format('source {{}} by {{:,}} objects vs yesterday{{}}',
      CASE WHEN delta > 0 THEN 'grew' ELSE 'dropped' END, abs(delta), CASE WHEN delta_pct IS NULL THEN '' ELSE format(' ({{:+.1f}}%)', round_even(delta_pct, 1)) END) END,
    CASE WHEN inventory_enabled AND orphans > 0 THEN format('backup has {{:,}} orphans (source-side deletions retained)', orphans) END,
    CASE WHEN backup_age_hours <= 12 THEN format('last backup {{:.1f}}h ago', round_even(backup_age_hours, 1)) END],
    coalesce(infos, []),
    [CASE WHEN exports_no_recent > 0 AND (exports_completed > 0 OR exports_in_progress > 0) THEN format('DynamoDB exports: {{}} table(s) with no recent export', exports_no_recent) END]), lambda x: x IS NOT NULL) AS info_list
FROM (SELECT r.source_alias, r.inventory_enabled,
  CASE WHEN r.inventory_enabled THEN f.age_hours END AS inventory_age_hours, coalesce(r.inventory_enabled AND f.stale, false) AS inventory_stale,
  CASE WHEN r.inventory_enabled THEN d.delta END AS delta, CASE WHEN r.inventory_enabled THEN d.delta_pct END AS delta_pct,
  CASE WHEN r.inventory_enabled THEN v.source_minus_backup END AS missing, CASE WHEN r.inventory_enabled THEN v.backup_minus_source END AS orphans,
  CASE WHEN r.inventory_enabled THEN v.buckets_unavailable END AS buckets_unavailable,
  CASE WHEN r.inventory_enabled THEN h.still_missing END AS still_missing, CASE WHEN r.inventory_enabled THEN h.auto_healed END AS auto_healed,
  CASE WHEN r.inventory_enabled THEN h.tag END AS tag, t.result AS restore_result, i.pitr_enabled,
  p.last_backup_at, p.last_backup_age_hours AS backup_age_hours, p.worst_failure_pct AS failure_pct, p.alarming_buckets,
  p.exports_completed, p.exports_in_progress, p.exports_failed, p.exports_no_recent, p.exports_errored, l.warns, l.infos
FROM fx_registry r
LEFT JOIN {FRESHNESS} f ON f.source_alias = r.source_alias LEFT JOIN {SOURCE_DELTA} d ON d.source_alias = r.source_alias
LEFT JOIN {SOURCE_DIVERGENCE} v ON v.source_alias = r.source_alias LEFT JOIN {NEWEST_HEAD} h ON h.source_alias = r.source_alias
LEFT JOIN {_restore_overall(_bucket_results(DUE_SAMPLE, DUE))} t ON t.source_alias = r.source_alias LEFT JOIN {PITR} i ON i.source_alias = r.source_alias
LEFT JOIN {PROCESS} p ON p.source_alias = r.source_alias LEFT JOIN {BATCH_LINES} l ON l.source_alias = r.source_alias))
"""

SYNCED = f"""
(SELECT coalesce(s.source_alias, b.source_alias) AS source_alias, coalesce(s.label, b.label) AS label, coalesce(s.key, b.key) AS key,
  s.key IS NOT NULL AND ({STRICT}) AS copied, b.key IS NOT NULL AS had, concat('bb-', s.source_alias, CASE s.label WHEN 'main' THEN '' ELSE concat('-', s.label) END) AS new_bucket, s.size AS s_size, s.e_tag AS s_tag,
  b.bucket AS b_bucket, b.size AS b_size, b.e_tag AS b_tag, b.last_modified_date AS b_time
FROM fx_s s FULL OUTER JOIN {B_CURRENT} b ON {ON_KEY})
"""

TIERED = f"""
(SELECT source_alias, key, size, CASE WHEN datediff('day', last_modified_date, {TIER_DAY}) < 30 THEN 'STANDARD' ELSE 'GLACIER_IR' END AS tier
FROM fx_bkp WHERE dt = {TODAY} AND NOT is_delete_marker)
"""
COST = f"""
(SELECT source_alias, tier, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes,
  sum(size) / {GB} * CASE tier WHEN 'STANDARD' THEN 0.036::DOUBLE ELSE 0.007::DOUBLE END AS monthly_nzd FROM {TIERED} GROUP BY 1, 2)
"""
SUPERSEDED = "(SELECT *, lead(last_modified) OVER (PARTITION BY key ORDER BY last_modified, version_id) AS superseded_at FROM fx_version)"
AS_OF = f"""
SELECT key, version_id, last_modified, e_tag, size, is_delete_marker FROM (SELECT *, row_number() OVER
  (PARTITION BY key ORDER BY last_modified DESC, version_id DESC) AS rn FROM fx_version WHERE last_modified <= {STATE_AT}) WHERE rn = 1 AND NOT is_delete_marker
"""
RESTORE_ROWS = f"(SELECT source_alias, label, key, size, e_tag FROM fx_live WHERE {NOT_RESERVED})"
RESTORE_DIFF = (
    f"(SELECT b.* FROM {RESTORE_ROWS} b ANTI JOIN fx_src_listing s ON {ON_KEY} AND s.e_tag = b.e_tag)"
)
RESTORED_TABLES = """
(SELECT p.*, string_split(restore_arn, '/')[-1] AS table_name, t.table_status, r.source_alias IS NOT NULL AS known
FROM fx_pending p LEFT JOIN fx_table_status t ON t.table_name = string_split(restore_arn, '/')[-1]
LEFT JOIN fx_registry r ON r.source_alias = p.source)
"""
RUN_RESULTS = """
(SELECT source_alias AS source, 'bucket' AS kind, bucket AS target, checked_at AS ts, status, objects_copied AS objects FROM fx_run_state
 UNION ALL SELECT source_alias, 'table', table_name, export_time, status, NULL FROM fx_export)
"""
ALARM = """
(SELECT event_id, ts, CASE WHEN json_valid(message) THEN json_extract_string(message, '$.AlarmName') END AS name,
  CASE WHEN json_valid(message) THEN json_extract_string(message, '$.NewStateValue') END AS state FROM fx_alarm)
"""
BINS = "(SELECT event_type, time_bucket(INTERVAL 1 minute, ts) AS bin, sum(value) AS total FROM events GROUP BY 1, 2)"


def _sessions(level: str, hours: int) -> str:
    return f"""
SELECT bucket, '{level}' AS level, min(ts) AS first_success_at, max(ts) + INTERVAL {hours} HOUR AS stale_at, count(*) AS successes
FROM (SELECT bucket, ts, sum(starts) OVER (PARTITION BY bucket ORDER BY ts, event_id) AS session
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY bucket ORDER BY ts, event_id) < INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS starts
    FROM fx_event_log WHERE event_type = 'backup_run' AND {GOOD}))
GROUP BY bucket, session
HAVING max(ts) + INTERVAL {hours} HOUR <= (SELECT max(ts) FROM fx_event_log WHERE event_type = 'backup_run' AND {GOOD}) - INTERVAL 1 HOUR
"""


def _silences(level: str, hours: int) -> str:
    return f"""
SELECT user_id, '{level}' AS level, min(ts) AS waiting_since, min(ts) FILTER (good) AS first_success_at, max(ts) FILTER (good) AS last_success_at,
  max(ts) + INTERVAL {hours} HOUR AS stale_at, count(*) FILTER (good) AS successes
FROM (SELECT user_id, ts, good, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
  FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {hours} HOUR THEN 0 ELSE 1 END AS starts
    FROM (SELECT *, event_type = 'view' AND user_id % 10 <> 0 AS good FROM events) WHERE good OR event_type = 'signup'))
GROUP BY user_id, session
HAVING max(ts) + INTERVAL {hours} HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
"""


RESULTS = """
(SELECT *, CASE WHEN failed THEN concat(target, ': ', why) END AS error FROM (
 SELECT strftime(ts, '%Y-%m-%d') AS run_id, source, 'bucket' AS kind, bucket AS target, ts,
  CASE WHEN event_id % 2 = 0 THEN status WHEN event_id % 900 > 0 THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN event_id % 2 = 0 THEN 'batch' ELSE 'incremental' END AS mode,
  CASE WHEN event_id % 2 = 1 THEN event_id % 900 END AS objects_copied, CASE WHEN event_id % 2 = 1 THEN event_id % 900 * 4096 END AS bytes_transferred,
  CASE WHEN event_id % 2 = 0 THEN concat('job-', event_id) END AS batch_job_id, CASE WHEN event_id % 2 = 0 THEN event_id % 900 END AS objects_in_manifest,
  NULL AS export_id, status = 'failed' AS failed, concat('no "list" permission, request ', event_id) AS why
 FROM fx_event_log WHERE event_type = 'backup_run'
 UNION ALL
 SELECT strftime(export_time, '%Y-%m-%d'), source_alias, 'table', table_name, export_time, lower(status), 'export', NULL, NULL, NULL, NULL,
  export_arn, status = 'FAILED', concat('export ', export_arn) FROM fx_export))
"""
RUNS = f"""
(SELECT source, max(ts) AS ts, bool_and(error IS NULL) AS success, count(DISTINCT target) FILTER (kind = 'bucket') AS s3_buckets,
  count(DISTINCT target) FILTER (kind = 'table') AS dynamodb_tables, count(error) AS error_count,
  coalesce(list(error ORDER BY error) FILTER (error IS NOT NULL), []) AS errors FROM {RESULTS} GROUP BY source, run_id)
"""

_SQL = {
    # scans, sources, sinks
    "scan_inventory": f"SELECT * FROM fx_src WHERE dt = {TODAY} AND source_alias = 'bravo'",
    "read_delivered": """SELECT dt, source_alias, side, bucket, label, key, is_latest, is_delete_marker, size, last_modified_date, e_tag, storage_class
        FROM fx_inventory JOIN fx_newest USING (source_alias, label, side, dt)""",
    "kept_counts": f"SELECT source_alias, label, side, dt, strptime(dt, '%Y-%m-%d-%H-%M') AS delivered_at, objects FROM {BUCKET_COUNTS}",
    "latest_partition": "SELECT source_alias, label, side, max(dt) AS dt FROM fx_inventory GROUP BY 1, 2, 3",
    "two_latest_partitions": """SELECT * FROM (SELECT source_alias, label, side, dt, row_number() OVER (PARTITION BY source_alias, label, side ORDER BY dt DESC) AS newest
        FROM (SELECT DISTINCT source_alias, label, side, dt FROM fx_inventory)) WHERE newest <= 2""",
    "scan_listing": "SELECT * FROM fx_live WHERE starts_with(key, 'models/')",
    "read_event_log": """SELECT event_id, event_type, source, ts AS timestamp, details, strftime(ts, '%Y-%m') AS month
        FROM fx_event_log WHERE event_id % 10 > 1 AND ts >= TIMESTAMP '2023-12-01' AND ts < TIMESTAMP '2024-02-01'""",
    "append_event_log": "SELECT event_id, event_type, source, ts AS timestamp, strftime(ts, '%Y-%m') AS month FROM fx_event_log",
    "current_run_state": f"SELECT * FROM {STATES}",
    "scan_batch_jobs": "SELECT * FROM fx_job WHERE contains(description, 'src → bb-7')",
    "scan_exports": "SELECT * FROM fx_export",
    "manifest_sink": MANIFEST,
    "manifest_parts": f"""SELECT source_alias, count(*) AS rows, CAST(sum(octet_length(encode(concat(bucket, ',', key))) + 1) AS BIGINT) AS bytes
        FROM ({MANIFEST}) GROUP BY 1""",
    "overwrite_stage": "SELECT source_alias, key, CASE WHEN source_alias = 'bravo' THEN 0 ELSE size END AS size FROM fx_s",
    "export_table_snapshot": """SELECT 'customer' AS table_name, 'customer/2024/01/31' AS export_prefix, 'COMPLETED' AS status, count(*) AS rows FROM customer
        UNION ALL SELECT 'orders', 'orders/2024/01/31', 'COMPLETED', count(*) FROM orders""",
    "source_registry": """SELECT source_alias, 'bucket' AS kind, replace(bucket, 'bb-', 'src-') AS name, replace(bucket, 'bb-', 'b') AS label,
        concat('bb-', source_alias, '-s3-', replace(bucket, 'bb-', 'b'), '-ap-southeast-2-111111111111') AS backup_bucket FROM fx_bucket
        UNION ALL SELECT source_alias, 'table', table_name, NULL, NULL FROM fx_table""",
    # projections, filters, predicates
    "filter_current_version": "SELECT dt, source_alias, side, key FROM fx_cur",
    "filter_operational": f"SELECT dt, source_alias, key FROM fx_bkp WHERE {NOT_RESERVED}",
    "filter_partition": """SELECT i.dt, source_alias, label, side, key, size FROM fx_inventory i JOIN fx_newest n USING (source_alias, label, side) WHERE i.dt = n.dt""",
    "filter_restorable_class": """SELECT source_alias, side, dt,
        count(*) FILTER (storage_class IS NULL OR storage_class NOT IN ('GLACIER','DEEP_ARCHIVE','GLACIER_IR')) AS restorable,
        count(*) FILTER (storage_class IN ('GLACIER','DEEP_ARCHIVE','GLACIER_IR')) AS archived FROM fx_inventory GROUP BY 1, 2, 3""",
    "filter_prefix": "SELECT dt, source_alias, side, key FROM fx_inventory WHERE starts_with(key, 'folder/file 1+')",
    "filter_nonempty": "SELECT source_alias, side, dt, max(last_modified_date) AS latest, count(*) AS objects FROM fx_inventory WHERE size > 0 GROUP BY 1, 2, 3",
    "diff_predicate_smart": f"SELECT {PAIR} FROM fx_s s LEFT JOIN fx_b b ON {ON_KEY} WHERE {SMART}",
    "diff_predicate_strict": f"SELECT {PAIR} FROM fx_s s LEFT JOIN fx_b b ON {ON_KEY} WHERE {STRICT}",
    "project_manifest": f"SELECT source_alias, bucket, {ENCODED.format('key')} AS key FROM fx_s",
    "filter_events": "SELECT event_id, ts, event_type, bucket FROM fx_event_log WHERE source = 'bravo' AND ts >= TIMESTAMP '2024-01-15'",
    "select_restore_targets": "SELECT dt, side, bucket, key FROM fx_inventory WHERE source_alias IN ('alpha', 'delta') AND label = 'main'",
    "filter_job_kind": """SELECT bucket, job_id, description, creation_time, status FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY creation_time DESC, job_id) AS rn
        FROM fx_job WHERE starts_with(description, 'restore:')) WHERE rn <= 3""",
    # joins
    "inventory_diff": NEWEST_MANIFEST,
    "inventory_full_manifest": f"SELECT source_alias, bucket, {ENCODED.format('key')} AS key FROM fx_s",
    "divergence_counts": f"SELECT * FROM {DIVERGENCE}",
    "missing_keys": f"SELECT * FROM {NEWEST_MISSING}",
    "orphan_keys": f"SELECT b.source_alias, b.label, b.key FROM fx_nb b ANTI JOIN fx_ns s ON {ON_KEY}",
    "listing_diff": f"""SELECT s.source_alias, s.bucket, {ENCODED.format('s.key')} AS key, s.size,
        CASE WHEN b.key IS NULL THEN 'missing' WHEN s.e_tag IS DISTINCT FROM b.e_tag THEN 'etag' ELSE 'size' END AS reason
        FROM fx_src_listing s LEFT JOIN fx_live b ON {ON_KEY} WHERE {STRICT}""",
    "integrity_diffs": f"SELECT * FROM {INTEGRITY} WHERE issue <> 'verified'",
    "restore_diff": f"SELECT * FROM {RESTORE_DIFF}",
    "restore_diff_summary": f"""SELECT t.source_alias, coalesce(n, 0) AS objects_copied, total - coalesce(n, 0) AS objects_skipped, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes_transferred
        FROM (SELECT source_alias, count(*) AS total FROM {RESTORE_ROWS} GROUP BY 1) t
        LEFT JOIN (SELECT source_alias, count(*) AS n, sum(size) AS bytes FROM {RESTORE_DIFF} GROUP BY 1) d ON d.source_alias = t.source_alias""",
    "mutation_run_match": """SELECT v.source_alias, v.key, v.version_id, v.last_modified, r.run_id, r.started_at AS run_started_at
        FROM fx_source_version v ASOF LEFT JOIN (SELECT source_alias, started_at, max(run_id) AS run_id FROM fx_run GROUP BY 1, 2) r
        ON r.source_alias = v.source_alias AND r.started_at <= v.last_modified""",
    "head_check": f"SELECT * FROM {HEAD}",
    "restore_verify": f"SELECT * FROM {VERIFIED.format(sample=SAMPLE.format(200))}",
    "restore_verify_all": f"SELECT * FROM {VERIFIED.format(sample=RESTORABLE)}",
    "set_reconcile": """SELECT endpoint, u.action, CASE WHEN u.action = 'to_remove' THEN arn END AS arn
        FROM (SELECT endpoint, arn, unnest(list_filter([CASE WHEN w AND NOT c AND NOT p THEN 'to_add' END, CASE WHEN NOT w AND c THEN 'to_remove' END,
          CASE WHEN w AND p THEN 'pending' END, CASE WHEN w AND c THEN 'kept' END], lambda x: x IS NOT NULL)) AS action
          FROM (SELECT coalesce(d.e, s.e) AS endpoint, d.e IS NOT NULL AS w, coalesce(s.c, false) AS c, coalesce(s.p, false) AS p, s.arn
            FROM (SELECT DISTINCT lower(trim(endpoint)) AS e FROM fx_desired) d
            FULL OUTER JOIN (SELECT lower(trim(endpoint)) AS e, bool_or(arn <> 'PendingConfirmation') AS c, bool_or(arn = 'PendingConfirmation') AS p,
              max(arn) FILTER (arn <> 'PendingConfirmation') AS arn FROM fx_subscribed GROUP BY 1) s ON s.e = d.e)) u""",
    "source_status": f"""SELECT r.source_alias, last_runs, source_latest, backup_latest, recent_jobs, recent_exports FROM fx_registry r
        LEFT JOIN (SELECT source_alias, string_agg(concat(bucket, '=', status), ',' ORDER BY bucket) AS last_runs FROM {STATES} GROUP BY 1) s ON s.source_alias = r.source_alias
        LEFT JOIN {FRESHNESS} f ON f.source_alias = r.source_alias
        LEFT JOIN (SELECT b.source_alias, string_agg(job_id, ',' ORDER BY j.bucket, creation_time, job_id) AS recent_jobs
          FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY creation_time DESC, job_id) AS rn FROM fx_job) j JOIN fx_bucket b ON b.bucket = j.bucket WHERE j.rn <= 3 GROUP BY 1) j ON j.source_alias = r.source_alias
        LEFT JOIN (SELECT source_alias, string_agg(export_arn, ',' ORDER BY table_name, export_time, export_arn) AS recent_exports
          FROM (SELECT *, row_number() OVER (PARTITION BY source_alias, table_name ORDER BY export_time DESC, export_arn) AS rn FROM fx_export) WHERE rn <= 5 GROUP BY 1) e ON e.source_alias = r.source_alias""",
    "restore_test_targets": "SELECT source_alias, count(*) AS objects FROM fx_b WHERE source_alias IN ('alpha', 'charlie') GROUP BY 1",
    # aggregations
    "manifest_count": f"SELECT s.source_alias, count(*) AS objects FROM fx_s s LEFT JOIN fx_b b ON {ON_KEY} WHERE {SMART} GROUP BY 1",
    "snapshot_count": f"SELECT * FROM {COUNTS}",
    "count_delta": f"SELECT * REPLACE (round(delta_pct, 6) AS delta_pct) FROM {DELTA}",
    "sync_summary": f"""SELECT s.source_alias, count(*) FILTER ({STRICT}) AS objects_copied, count(*) FILTER (NOT ({STRICT})) AS objects_skipped,
        CAST(coalesce(sum(s.size) FILTER ({STRICT}), 0) AS BIGINT) AS bytes_transferred FROM fx_src_listing s LEFT JOIN fx_live b ON {ON_KEY} GROUP BY 1""",
    "integrity_summary": f"""SELECT s.source_alias, source_object_count, backup_object_count, coalesce(m, 0) AS missing_count, coalesce(x, 0) AS mismatch_count,
        coalesce(v, 0) AS checksum_verified, coalesce(m, 0) = 0 AND coalesce(x, 0) = 0 AS clean
        FROM (SELECT source_alias, count(*) AS source_object_count FROM fx_src_listing WHERE {NOT_RESERVED} GROUP BY 1) s
        JOIN (SELECT source_alias, count(*) AS backup_object_count FROM fx_live WHERE {NOT_RESERVED} GROUP BY 1) b ON b.source_alias = s.source_alias
        LEFT JOIN (SELECT source_alias, count(*) FILTER (issue = 'missing_in_backup') AS m, count(*) FILTER (issue = 'etag_mismatch') AS x,
          count(*) FILTER (issue = 'verified') AS v FROM {INTEGRITY} GROUP BY 1) i ON i.source_alias = s.source_alias""",
    "inventory_freshness": f"SELECT * REPLACE (round(age_hours, 6) AS age_hours) FROM {FRESHNESS}",
    "last_backup_age": f"SELECT * REPLACE (round(last_backup_age_hours, 6) AS last_backup_age_hours) FROM {LAST_BACKUP}",
    "export_summary": f"SELECT * FROM {EXPORT_SUMMARY}",
    "job_progress": """SELECT job_id, status, total_tasks, succeeded, tasks_failed, succeeded + tasks_failed AS done,
        CASE WHEN total_tasks = 0 THEN 0.0 ELSE round_even((succeeded + tasks_failed) / total_tasks::DOUBLE * 100, 1) END AS percent_complete
        FROM (SELECT *, CASE WHEN status = 'Complete' AND tasks_failed = 0 AND total_tasks > 0 THEN total_tasks ELSE tasks_succeeded END AS succeeded FROM fx_job)""",
    "job_failure_rate": f"SELECT * REPLACE (round(failure_pct, 6) AS failure_pct) FROM {FAILURES}",
    "report_overall": f"""SELECT CASE WHEN bool_or(o = 'red') THEN 'red' WHEN bool_or(o = 'yellow') THEN 'yellow' ELSE 'green' END AS overall,
        count(*) FILTER (o = 'green') AS healthy, count(*) AS total FROM (SELECT {THREE_COLORS} AS o FROM fx_signal)""",
    "restore_test_overall": """SELECT source AS source_alias, bucket, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'skipped') THEN 'skipped' ELSE 'passed' END AS overall,
        count(*) AS buckets FROM fx_event_log WHERE event_type = 'test_restore' GROUP BY 1, 2""",
    "restore_test_results": f"SELECT * FROM {_bucket_results(SAMPLE.format(200))}",
    "latest_restore_point": f"SELECT source_alias, min(checked_at) AS restore_point, count(*) AS buckets FROM {STATES} WHERE status <> 'failed' GROUP BY 1",
    "latest_restore_point_strict": f"SELECT source_alias, min(checked_at) AS restore_point, count(*) AS buckets FROM {STATES} WHERE {GOOD} GROUP BY 1",
    "metric_window": f"""SELECT event_type, round(sum(total), 2) AS total, max(bin) FILTER (total > 0) AS last_nonzero_at
        FROM (SELECT event_type, time_bucket(INTERVAL 1 minute, ts) AS bin, sum(value) AS total FROM events WHERE ts >= {NOW} - INTERVAL 120 MINUTE AND ts < {NOW} GROUP BY 1, 2) GROUP BY 1""",
    "activity_report": f"""SELECT CAST(ts AS DATE) AS day, source, event_type, status, count(*) AS events FROM fx_event_log
        WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4""",
    "cost_breakdown": f"""SELECT source_alias, tier, CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(monthly_nzd), 6) AS monthly_nzd,
        CAST(grouping(source_alias, tier) AS BIGINT) AS level FROM {COST} GROUP BY ROLLUP (source_alias, tier)""",
    "pending_by_source": """SELECT p.source, count(*) AS pending, min(submitted_at) AS oldest_submitted_at, bool_or(r.source_alias IS NOT NULL) AS registered
        FROM fx_pending p LEFT JOIN fx_registry r ON r.source_alias = p.source GROUP BY 1""",
    "compliance_summary": f"""SELECT r.source_alias, coalesce(m, 0) AS missing_count, coalesce(x, 0) AS mismatch_count, coalesce(m, 0) = 0 AND coalesce(x, 0) = 0 AS clean,
        last_backup_at, t.result AS restore_test, pitr_enabled FROM fx_registry r
        LEFT JOIN (SELECT source_alias, count(*) FILTER (issue = 'missing_in_backup') AS m, count(*) FILTER (issue = 'etag_mismatch') AS x FROM {INTEGRITY} GROUP BY 1) i ON i.source_alias = r.source_alias
        LEFT JOIN {LAST_BACKUP} a ON a.source_alias = r.source_alias LEFT JOIN {_restore_overall(_bucket_results(SAMPLE.format(200)))} t ON t.source_alias = r.source_alias
        LEFT JOIN {PITR} p ON p.source_alias = r.source_alias""",
    # windows, top-k, sampling
    "recent_jobs": """SELECT bucket, job_id, creation_time, status FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY creation_time DESC, job_id) AS rn FROM fx_job) WHERE rn <= 3""",
    "recent_exports": """SELECT export_arn, table_name, source_alias, status, export_time FROM (SELECT *, row_number() OVER (PARTITION BY source_alias, table_name ORDER BY export_time DESC, export_arn) AS rn FROM fx_export) WHERE rn <= 5""",
    "version_changes": """SELECT key, version_id, last_modified, e_tag, previous_e_tag,
        CASE WHEN previous_e_tag IS NULL THEN 'first' WHEN previous_e_tag = e_tag THEN 'recopy' ELSE 'mutation' END AS kind
        FROM (SELECT *, lag(e_tag) OVER (PARTITION BY key ORDER BY last_modified, version_id) AS previous_e_tag FROM fx_version)""",
    "mutated_in_window": f"""SELECT * FROM (SELECT key, version_id, last_modified, superseded_at, last_modified {IN_WINDOW} AS written,
        coalesce(superseded_at {IN_WINDOW}, false) AS superseded FROM {SUPERSEDED}) WHERE written OR superseded""",
    "last_good_version": f"""SELECT key, version_id, last_modified, e_tag, size, is_delete_marker FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY last_modified DESC, version_id DESC) AS rn
        FROM fx_version WHERE last_modified < {WINDOW_START}) WHERE rn = 1 AND key IN (SELECT key FROM fx_version WHERE last_modified {IN_WINDOW})""",
    "purge_batches": f"""SELECT source_alias, label, key, n // 1000 AS batch, n % 1000 AS position FROM (SELECT b.source_alias, b.label, b.key,
        row_number() OVER (PARTITION BY b.source_alias, b.label ORDER BY left(md5(b.key), 3), b.key) - 1 AS n FROM fx_b b ANTI JOIN fx_s s ON {ON_KEY})""",
    "daily_growth": f"SELECT source_alias, dt, objects, previous_dt, previous_objects, delta, round(delta_pct, 6) AS delta_pct FROM {GROWTH}",
    "sample_restore_hash": f"SELECT * FROM {SAMPLE.format(10)}",
    "missing_sample": f"SELECT * FROM {MISSING_SAMPLE}",
    "events_latest": "SELECT event_id, ts, source, event_type, status FROM fx_event_log ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50",
    "latest_completed_export": """SELECT t.source_alias, t.table_name, coalesce(n, 0) AS completed, export_arn, export_time, coalesce(n, 0) = 0 AS failed FROM fx_table t
        LEFT JOIN (SELECT source_alias, table_name, count(*) AS n, arg_max(export_arn, (export_time, export_arn)) AS export_arn, max(export_time) AS export_time
          FROM fx_export WHERE status = 'COMPLETED' GROUP BY 1, 2) e ON e.source_alias = t.source_alias AND e.table_name = t.table_name""",
    # set operations
    "event_months_union": """SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS events, CAST(0 AS BIGINT) AS with_actor FROM fx_event_log GROUP BY 1, 2""",
    "key_except": """SELECT source_alias, label, key, 'source_only' AS found_in FROM (SELECT source_alias, label, key FROM fx_s EXCEPT SELECT source_alias, label, key FROM fx_b)
        UNION ALL SELECT source_alias, label, key, 'backup_only' FROM (SELECT source_alias, label, key FROM fx_b EXCEPT SELECT source_alias, label, key FROM fx_s)""",
    "key_intersect": "SELECT source_alias, label, key FROM fx_s INTERSECT SELECT source_alias, label, key FROM fx_b",
    # scalar functions
    "encode_key": f"SELECT key, {ENCODED.format('key')} AS encoded FROM fx_obj",
    "is_multipart_etag": f"SELECT side, key, instr(e_tag, '-') > 0 AS multipart FROM fx_inventory WHERE dt = {TODAY}",
    "normalize_etag": "SELECT key, e_tag AS plain, concat('\"', e_tag, '\"') AS quoted FROM fx_live",
    "pick_checksum": "SELECT side, key, algo AS algorithm, val AS value FROM " + CK,
    "sanitize_identifier": r"""SELECT key, lower(trim(regexp_replace(regexp_replace(concat('inv_', source_alias, '_', key), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS identifier FROM fx_obj""",
    "parse_uri": """SELECT key, h % 7 > 1 AS valid, CASE WHEN h % 7 > 1 THEN concat('bb-', source_alias) END AS uri_bucket, CASE WHEN h % 7 > 1 THEN key END AS uri_key FROM fx_obj""",
    "parse_symlink_dt": """SELECT key, regexp_extract(key, 'dt=([^/]+)/', 1) AS dt, concat(split_part(key, '/hive/', 1), '/hive/') AS hive_root FROM fx_delivery""",
    "arn_parts": """SELECT restore_arn, split_part(restore_arn, '/', 2) AS table_name, '111111111111' AS account, source AS bucket FROM fx_pending""",
    "backup_names": """SELECT source_alias, bucket, concat('bb-', source_alias, '-s3-', bucket, '-ap-southeast-2-111111111111') AS backup_bucket,
        concat('bb-', source_alias, '-dynamo-ap-southeast-2-111111111111') AS export_bucket FROM fx_bucket""",
    "restore_names": """SELECT key, concat(left(concat(key, key), 55), '-restore') AS bucket_name, concat(left(repeat(source_alias, 60), 247), '-restore') AS table_name FROM fx_obj""",
    "event_month_key": "SELECT event_id, concat('_events/', strftime(ts, '%Y-%m'), '/events.jsonl') AS path FROM fx_event_log",
    "parse_event_time": """SELECT event_id, CASE event_id % 9 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) - INTERVAL 13 HOUR
        WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('minute', ts) - INTERVAL 13 HOUR WHEN 5 THEN date_trunc('minute', ts) - INTERVAL 10 HOUR
        WHEN 6 THEN TIMESTAMP '2000-01-01' + (date_trunc('minute', ts) - date_trunc('day', ts)) END AS parsed FROM fx_event_log""",
    "event_time_rejects": """SELECT event_id, CASE event_id % 9 WHEN 7 THEN strftime(ts, '%Y-%m-%d %H:%M CET') ELSE strftime(ts, '2024-13-%d') END AS text,
        CASE event_id % 9 WHEN 7 THEN 'unknown zone' ELSE 'no such date or time' END AS reason FROM fx_event_log WHERE event_id % 9 IN (7, 8)""",
    "local_report_date": "SELECT event_id, strftime(ts + INTERVAL 13 HOUR, '%Y-%m-%d') AS report_date FROM fx_event_log",
    "age_hours": f"SELECT event_id, round((epoch_us({NOW}) - epoch_us(ts)) / 3.6e9, 6) AS hours FROM fx_event_log",
    "event_summary_fields": """SELECT event_id, event_type, CASE WHEN event_type IN ('backup_run', 'test_restore') THEN json_extract_string(details, '$.bucket')
        WHEN event_type = 'restore_submitted' THEN '?' END AS target, '?' AS status, 'batch' AS mode,
        concat(json_extract_string(details, '$.objects_copied'), ' objects') AS extent FROM fx_event_log""",
    "failure_reason": """SELECT event_id, left(CASE WHEN event_type = 'backup_run' THEN repeat(details, 3) ELSE concat('export stopped: ', details) END, 120) AS reason FROM fx_event_log""",
    "truncate_text": """SELECT key, CASE WHEN length(b) > 100 THEN concat(left(b, 99), '…') ELSE b END AS subject,
        md5(CASE WHEN length(l) > 1024 THEN concat(left(l, 1020), '…') ELSE l END) AS field_md5
        FROM (SELECT key, concat(key, ' ', repeat(source_alias, 18)) AS b, repeat(key, 40) AS l FROM fx_obj)""",
    "description_target": "SELECT job_id, split_part(description, ':', 1) AS kind, bucket AS target FROM fx_job",
    # health
    "process_signals": f"SELECT * REPLACE (round(last_backup_age_hours, 6) AS last_backup_age_hours, round(worst_failure_pct, 6) AS worst_failure_pct) FROM {PROCESS}",
    "pitr_status": "SELECT source_alias, table_name, coalesce(pitr_status = 'ENABLED', false) AS enabled, latest_restorable FROM fx_table",
    "classify_source": f"SELECT source_alias, {THREE_COLORS} AS overall FROM fx_signal",
    "classify_four_color": f"SELECT source_alias, {FOUR_COLORS} AS overall FROM fx_signal",
    "health_notes": f"""SELECT source_alias, 'warning' AS kind, unnest(note_list) AS line FROM {REPORT}
        UNION ALL SELECT source_alias, 'info', unnest(info_list) FROM {REPORT}""",
    "health_report": f"""SELECT * EXCLUDE (warns, infos, note_list, info_list) REPLACE (round(inventory_age_hours, 6) AS inventory_age_hours, round(delta_pct, 6) AS delta_pct,
        round(backup_age_hours, 6) AS backup_age_hours, round(failure_pct, 6) AS failure_pct), array_to_string(note_list, '; ') AS notes, array_to_string(info_list, '; ') AS info_notes FROM {REPORT}""",
    "report_headline": f"""SELECT format('backup health 2024-01-31 — {{}} ({{}}/{{}})', upper(CASE WHEN bool_or(overall = 'red') THEN 'red' WHEN bool_or(overall = 'yellow') THEN 'yellow' ELSE 'green' END),
        count(*) FILTER (overall = 'green'), count(*)) AS headline FROM {REPORT}""",
    "source_check": f"""WITH f AS (SELECT r.*, source_latest, backup_latest, effective_data_ts, age_hours FROM fx_registry r LEFT JOIN {FRESHNESS} q ON q.source_alias = r.source_alias)
        SELECT source_alias, concat('Inventory snapshot ', source_bucket) AS "check", CASE WHEN source_latest IS NULL THEN 'WARN' ELSE 'PASS' END AS outcome, coalesce(strftime(source_latest, '%Y-%m-%d %H:%M UTC'), 'no artifacts yet') AS detail FROM f
        UNION ALL SELECT source_alias, concat('Inventory snapshot ', backup_bucket), CASE WHEN backup_latest IS NULL THEN 'WARN' ELSE 'PASS' END, coalesce(strftime(backup_latest, '%Y-%m-%d %H:%M UTC'), 'no artifacts yet') FROM f
        UNION ALL SELECT source_alias, 'Inventory effective data time', CASE WHEN effective_data_ts IS NULL THEN 'WARN' ELSE 'PASS' END, coalesce(strftime(effective_data_ts, '%Y-%m-%d %H:%M UTC'), 'not yet available') FROM f
        UNION ALL SELECT source_alias, 'Inventory freshness', CASE WHEN age_hours <= 30 THEN 'PASS' ELSE 'WARN' END, coalesce(format('{{:.1f}}h', round_even(age_hours, 1)), 'not yet available') FROM f
        UNION ALL SELECT source_alias, concat('PITR ', table_name), CASE WHEN pitr_status IS NULL THEN 'FAIL' WHEN pitr_status = 'ENABLED' THEN 'PASS' ELSE 'WARN' END,
          CASE WHEN pitr_status IS NULL THEN 'status not readable' WHEN pitr_status = 'ENABLED' THEN '' ELSE concat('status=', pitr_status, ' — enable PITR before backup') END FROM fx_table""",
    # table maintenance
    "apply_sync": f"""SELECT source_alias, label, key, CASE WHEN copied THEN coalesce(b_bucket, new_bucket) ELSE b_bucket END AS bucket, CASE WHEN copied THEN s_size ELSE b_size END AS size,
        CASE WHEN copied THEN s_tag ELSE b_tag END AS e_tag, CASE WHEN copied THEN {RUN_AT} ELSE b_time END AS last_modified_date, copied FROM {SYNCED}""",
    "publish_sync": f"""SELECT source_alias, label, key, CASE WHEN copied THEN coalesce(b_bucket, new_bucket) ELSE b_bucket END AS bucket, CASE WHEN copied THEN s_size ELSE b_size END AS size,
        CASE WHEN copied THEN s_tag ELSE b_tag END AS e_tag, CASE WHEN copied THEN {RUN_AT} ELSE b_time END AS last_modified_date, {TODAY} AS dt FROM {SYNCED}""",
    "apply_sync_versions": f"""SELECT source_alias, label, key, b_bucket AS bucket, b_size AS size, b_tag AS e_tag, b_time AS last_modified_date, NOT copied AS is_latest FROM {SYNCED} WHERE had
        UNION ALL SELECT source_alias, label, key, coalesce(b_bucket, new_bucket), s_size, s_tag, {RUN_AT}, true FROM {SYNCED} WHERE copied""",
    "restore_manifest": f"SELECT source_alias, bucket, {ENCODED.format('key')} AS key FROM fx_live WHERE {NOT_RESERVED}",
    "restore_as_of": AS_OF,
    "restore_to_new_table": AS_OF,
    "pending_restore_step": f"""WITH r AS (SELECT *, known AND coalesce(table_status = 'ACTIVE', false) AS done FROM {RESTORED_TABLES})
        SELECT restore_arn, source, 'remaining' AS record, NULL AS details FROM r WHERE NOT done
        UNION ALL SELECT restore_arn, source, 'completed', NULL FROM r WHERE done
        UNION ALL SELECT restore_arn, source, 'restore_completed', concat('{{"dest_table":"', table_name, '","restore_arn":"', restore_arn, '","source_table_arn":"', source_table_arn, '","restore_point":"', strftime(restore_point, '%Y-%m-%dT%H:%M:%S+00:00'), '"}}') FROM r WHERE done
        UNION ALL SELECT restore_arn, source, 'pitr_reenabled', concat('{{"table_arn":"', restore_arn, '"}}') FROM r WHERE done""",
    "run_events": f"""SELECT 'backup_run' AS event_type, source, ts, CASE kind WHEN 'bucket' THEN concat('{{"bucket":"', target, '","status":"', lower(status), '","objects_copied":', CAST(objects AS VARCHAR), '}}')
          ELSE concat('{{"table":"', target, '","status":"', lower(status), '"}}') END AS details FROM {RUN_RESULTS}
        UNION ALL SELECT 'backup_run_complete', source, max(ts), concat('{{"success":', CASE WHEN count(*) FILTER (lower(status) = 'failed') = 0 THEN 'true' ELSE 'false' END,
          ',"s3_buckets":', count(DISTINCT target) FILTER (kind = 'bucket'), ',"dynamodb_tables":', count(DISTINCT target) FILTER (kind = 'table'), ',"errors":', count(*) FILTER (lower(status) = 'failed'), '}}')
        FROM {RUN_RESULTS} GROUP BY source""",
    "run_log": f"""SELECT 'backup_run' AS event_type, source, ts, concat('{{', CASE kind WHEN 'bucket' THEN '"bucket":"' ELSE '"table":"' END, target, '","status":"', status, '","mode":"', mode, '"',
          CASE WHEN objects_copied IS NOT NULL THEN concat(',"objects_copied":', objects_copied, ',"bytes_transferred":', bytes_transferred) END,
          CASE WHEN batch_job_id IS NOT NULL THEN concat(',"batch_job_id":"', batch_job_id, '","objects_in_manifest":', objects_in_manifest) END,
          CASE WHEN export_id IS NOT NULL THEN concat(',"export_arn":"arn/export/', export_id, '"') END, '}}') AS details, 'scheduler' AS actor FROM {RESULTS} WHERE error IS NULL
        UNION ALL SELECT 'backup_run_complete', source, ts, concat('{{"success":', success, ',"s3_buckets":', s3_buckets, ',"dynamodb_tables":', dynamodb_tables, ',"errors":', CAST(to_json(errors) AS VARCHAR), '}}'), 'scheduler' FROM {RUNS}""",
    "event_fields": f"""SELECT 'backup_run' AS event_type, source, ts, 'scheduler' AS actor, target, status, mode, objects_copied, objects_in_manifest, bytes_transferred, batch_job_id, export_id,
          CAST(NULL AS TIMESTAMP) AS restore_point, NULL AS triggered_by, CAST(NULL AS BOOLEAN) AS success, CAST(NULL AS BIGINT) AS s3_buckets, CAST(NULL AS BIGINT) AS dynamodb_tables, CAST(NULL AS BIGINT) AS error_count, NULL AS errors, NULL AS result FROM {RESULTS} WHERE error IS NULL
        UNION ALL SELECT 'backup_run_complete', source, ts, 'scheduler', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, success, s3_buckets, dynamodb_tables, error_count, array_to_string(errors, '; '), NULL FROM {RUNS}
        UNION ALL SELECT event_type, source, ts, 'operator', CASE WHEN event_id % 11 = 0 THEN '?' WHEN event_type = 'test_restore' THEN bucket ELSE concat('restored-', event_id) END, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          CASE WHEN event_type = 'restore_submitted' AND event_id % 11 > 0 THEN date_trunc('hour', ts) END, CASE WHEN event_type = 'restore_submitted' AND event_id % 11 > 0 THEN CASE event_id % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'person' END END,
          NULL, NULL, NULL, NULL, NULL, CASE WHEN event_type = 'test_restore' AND event_id % 11 > 0 THEN CASE event_id % 2 WHEN 0 THEN 'pass' ELSE 'fail' END END
        FROM fx_event_log WHERE event_type IN ('restore_submitted', 'test_restore')""",
    # lifecycle and cost
    "lifecycle_tier": f"SELECT * FROM {TIERED}",
    "storage_cost": f"SELECT * REPLACE (round(monthly_nzd, 6) AS monthly_nzd) FROM {COST}",
    "noncurrent_expiry": f"""SELECT key, version_id, size, superseded_at, superseded_at + INTERVAL 365 DAY AS expired_at FROM {SUPERSEDED} WHERE superseded_at + INTERVAL 365 DAY <= {EXPIRY_AT}""",
    "retrieval_cost": f"""SELECT *, CASE WHEN retrieval_nzd <= 100 THEN 'none' WHEN retrieval_nzd <= 500 THEN 'single' ELSE 'dual' END AS approval
        FROM (SELECT source_alias, CAST(sum(CASE WHEN tier = 'GLACIER_IR' THEN size ELSE 0 END) AS BIGINT) AS cold_bytes,
          round(sum(CASE WHEN tier = 'GLACIER_IR' THEN size ELSE 0 END) / {GB} * 0.079::DOUBLE, 6) AS retrieval_nzd FROM {TIERED} GROUP BY 1)""",
    "batch_fee": f"""SELECT source_alias, objects, round(0.25::DOUBLE + objects / 1e6, 6) AS fee_usd FROM (SELECT s.source_alias, count(*) AS objects FROM fx_s s LEFT JOIN fx_b b ON {ON_KEY} WHERE {SMART} GROUP BY 1)""",
    "intelligent_tiering_delta": f"""SELECT source_alias, objects, bytes, billed_bytes, round(std, 6) AS standard_usd, round(tier, 6) AS tiered_usd, round(std - tier, 6) AS saving_usd
        FROM (SELECT *, bytes / {GB} * 0.025::DOUBLE AS std, bytes / {GB} * (0.01::DOUBLE * 0.025::DOUBLE) + billed_bytes / {GB} * (0.99::DOUBLE * 0.004::DOUBLE) + objects / 1000.0::DOUBLE * 0.0025::DOUBLE AS tier
          FROM (SELECT source_alias, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(greatest(size, 131072)) AS BIGINT) AS billed_bytes FROM fx_s GROUP BY 1))""",
    "export_cost": f"""SELECT e.table_name, month, exports, bytes, round(exports * (bytes / {GB}) * 0.16::DOUBLE, 6) AS fee_nzd
        FROM (SELECT table_name, strftime(export_time, '%Y-%m') AS month, count(*) AS exports FROM fx_export WHERE status = 'COMPLETED' GROUP BY 1, 2) e
        LEFT JOIN (SELECT concat('table-', CAST(user_id % 12 AS VARCHAR)) AS table_name, count(*) * 1048576 AS bytes FROM events GROUP BY 1) z ON z.table_name = e.table_name""",
    # streaming
    "stream_event_log": "SELECT event_id, ts, source, event_type, strftime(ts, '%Y-%m') AS month FROM fx_event_log",
    "stream_alarms": f"""SELECT event_id, ts, name, state, CASE state WHEN 'ALARM' THEN 'red' WHEN 'OK' THEN 'green' ELSE 'blue' END AS severity,
        concat(name, ' → ', state) AS title, '' AS reason FROM {ALARM} WHERE name IS NOT NULL""",
    "alarm_counts": f"SELECT count(*) FILTER (name IS NOT NULL) AS delivered, count(*) FILTER (name IS NULL) AS skipped FROM {ALARM}",
    "stream_metric_window": f"""WITH b AS (SELECT * FROM {BINS} WHERE bin + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
        w AS (SELECT b.*, time_bucket(INTERVAL 30 MINUTE, bin) - n * INTERVAL 30 MINUTE AS start FROM b, (SELECT unnest([0, 1, 2, 3]) AS n))
        SELECT event_type, start, start + INTERVAL 120 MINUTE AS "end", round(sum(total), 2) AS total, max(bin) FILTER (total > 0) AS last_nonzero_at
        FROM w WHERE start + INTERVAL 120 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
    "stream_pending_restores": """SELECT string_split(restore_arn, '/')[-1] AS table_name, restore_arn, source, e.event_type
        FROM fx_pending p JOIN fx_table_status t ON t.table_name = string_split(restore_arn, '/')[-1] AND t.table_status = 'ACTIVE'
        CROSS JOIN (SELECT unnest(['restore_completed', 'pitr_reenabled']) AS event_type) e WHERE source <> 'retired'""",
    "stream_silent_sources": f"{_silences('yellow', 12)} UNION ALL {_silences('red', 36)}",
    "stream_staleness": f"{_sessions('yellow', 12)} UNION ALL {_sessions('red', 36)}",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _SQL.items()}
