"""SQL text of the derived views, for the oracle. Independent of the DataFrame definitions."""

VIEWS = {}

VIEWS["fx_obj"] = """
SELECT source_alias, label, CASE label WHEN 'main' THEN h ELSE (h + 25) % 1000 END AS h, key, size, last_modified_date FROM (
SELECT CASE l_orderkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'bravo' WHEN 2 THEN 'charlie' ELSE 'delta' END AS source_alias,
  (l_orderkey*31 + l_linenumber*7 + l_partkey*13 + l_suppkey*3) % 1000 AS h,
  concat(CASE (l_orderkey + l_partkey) % 8 WHEN 0 THEN 'run=1000/part=A(0.15)/' WHEN 1 THEN 'folder/file 1+' WHEN 2 THEN 'a&b,c%/' WHEN 3 THEN 'é~*/' ELSE 'models/' END,
    CAST(l_orderkey AS VARCHAR(20)),'-',CAST(l_linenumber AS VARCHAR(20)),'-',CAST(l_partkey AS VARCHAR(20)),'-',CAST(l_suppkey AS VARCHAR(20)),'.h5') AS key,
  CAST(l_quantity AS BIGINT) * 4096 AS size, l_shipdate AS last_modified_date
FROM lineitem) CROSS JOIN (SELECT unnest(['main', 'extra', 'old', 'late']) AS label)
WHERE label = 'main' OR (label = 'extra' AND source_alias = 'bravo' AND h % 3 = 0) OR (label = 'old' AND source_alias = 'alpha' AND h % 10 = 3)
  OR (label = 'late' AND source_alias = 'charlie' AND h % 10 = 3)
"""

VIEWS["fx_src"] = """
SELECT dt, source_alias, 'source' AS side, concat('src-', source_alias, CASE label WHEN 'main' THEN '' ELSE concat('-', label) END) AS bucket, label, key,
  CASE WHEN source_alias = 'charlie' THEN NULL ELSE h % 200 <> 199 END AS is_latest,
  CASE WHEN source_alias = 'charlie' THEN NULL ELSE h % 200 = 198 END AS is_delete_marker,
  size, last_modified_date, concat(md5(key), CASE WHEN h % 11 = 0 THEN '-2' ELSE '' END) AS e_tag, 'STANDARD' AS storage_class
FROM fx_obj CROSS JOIN (SELECT '2024-01-29-01-00' AS dt UNION ALL SELECT '2024-01-30-01-00') d
WHERE h >= 30 AND (dt = '2024-01-29-01-00' AND h < 990 OR dt = '2024-01-30-01-00' AND label <> 'old')
"""

VIEWS["fx_bkp"] = """
SELECT dt, source_alias, 'backup' AS side, concat('bb-', source_alias, CASE label WHEN 'main' THEN '' ELSE concat('-', label) END) AS bucket, label, key,
  h % 200 <> 199 AS is_latest, h % 200 = 198 AS is_delete_marker,
  CASE WHEN h BETWEEN 100 AND 109 THEN size + 1 ELSE size END AS size, last_modified_date,
  CASE WHEN h BETWEEN 80 AND 99 THEN md5(concat(key,'#')) WHEN h BETWEEN 110 AND 139 THEN concat(md5(concat(key,'#')),'-2')
    ELSE concat(md5(key), CASE WHEN h % 11 = 0 THEN '-2' ELSE '' END) END AS e_tag,
  CASE h % 4 WHEN 0 THEN 'GLACIER_IR' WHEN 1 THEN NULL ELSE 'STANDARD' END AS storage_class
FROM fx_obj CROSS JOIN (SELECT '2024-01-29-01-00' AS dt UNION ALL SELECT '2024-01-30-01-00') d
WHERE NOT (h BETWEEN 30 AND 79) AND (dt = '2024-01-29-01-00' OR label NOT IN ('old', 'late'))
UNION ALL
SELECT '2024-01-30-01-00', a.source_alias, 'backup', concat('bb-', a.source_alias, CASE a.label WHEN 'main' THEN '' ELSE concat('-', a.label) END), a.label, p.key, true, false, CAST(10 AS BIGINT),
  TIMESTAMP '2024-01-30 00:00:00', md5(p.key), 'STANDARD'
FROM (SELECT DISTINCT source_alias, label FROM fx_obj WHERE label NOT IN ('old', 'late')) a
CROSS JOIN (SELECT '_state/last-run.json' AS key UNION ALL SELECT '_manifests/m.csv' UNION ALL SELECT '_batch-reports/r.csv'
  UNION ALL SELECT '_events/2024-01/events.jsonl' UNION ALL SELECT 'xstate/kept.bin') p
"""

VIEWS["fx_inventory"] = "SELECT * FROM fx_src UNION ALL SELECT * FROM fx_bkp"

VIEWS["fx_live"] = """
SELECT source_alias, bucket, label, key, size, e_tag FROM fx_bkp WHERE dt = '2024-01-30-01-00'
UNION ALL
SELECT source_alias, concat('bb-', source_alias, CASE label WHEN 'main' THEN '' ELSE concat('-', label) END), label, key, size, md5(key) FROM fx_obj WHERE h BETWEEN 30 AND 54
"""

VIEWS["fx_checksum"] = """
SELECT 'source' AS side, source_alias, label, key, CASE WHEN h % 3 = 0 THEN NULL ELSE md5(key) END AS crc64nvme, CASE WHEN h % 2 = 0 THEN md5(concat('s',key)) ELSE NULL END AS sha256 FROM fx_obj
UNION ALL
SELECT 'backup', source_alias, label, key, CASE WHEN h % 5 = 0 THEN md5(concat(key,'!')) ELSE md5(key) END, md5(concat('s',key)) FROM fx_obj
"""

VIEWS["fx_event_log"] = """
SELECT event_id, ts, CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'bravo' WHEN 2 THEN 'charlie' ELSE 'delta' END AS source,
  concat('bb-', CAST(user_id % 20 AS VARCHAR(20))) AS bucket,
  CASE event_type WHEN 'error' THEN 'test_restore' WHEN 'signup' THEN 'restore_submitted' WHEN 'purchase' THEN 'backup_run_complete' ELSE 'backup_run' END AS event_type,
  CASE event_id % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'prepared' WHEN 2 THEN 'submitted' WHEN 3 THEN 'skipped' WHEN 4 THEN 'completed' ELSE 'failed' END AS status,
  concat('{"bucket":"bb-', CAST(user_id % 20 AS VARCHAR(20)), '","mode":"batch","objects_copied":', CAST(event_id % 900 AS VARCHAR(20)), '}') AS details
FROM events
"""

VIEWS["fx_job"] = """
SELECT concat('job-', CAST(event_id AS VARCHAR(20))) AS job_id, concat('bb-', CAST(user_id % 20 AS VARCHAR(20))) AS bucket,
  concat(CASE WHEN event_id % 5 = 0 THEN 'restore: src → bb-' ELSE 'backup: src → bb-' END, CAST(user_id % 20 AS VARCHAR(20))) AS description,
  ts AS creation_time, CASE event_id % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'Failed' ELSE 'Complete' END AS status,
  CASE WHEN event_id % 50 = 0 THEN CAST(0 AS BIGINT) ELSE 1000 + event_id % 500 END AS total_tasks,
  CASE WHEN event_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE (event_id * 7) % 180 END AS tasks_failed, CAST(event_id % 700 AS BIGINT) AS tasks_succeeded
FROM events
"""

VIEWS["fx_export"] = """
SELECT concat('exp-', CAST(event_id AS VARCHAR(20))) AS export_arn, concat('table-', CAST(user_id % 12 AS VARCHAR(20))) AS table_name,
  CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'bravo' WHEN 2 THEN 'charlie' ELSE 'delta' END AS source_alias,
  CASE event_id % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'OTHER' ELSE 'COMPLETED' END AS status, ts AS export_time
FROM events WHERE event_type = 'purchase'
"""

VIEWS["fx_alarm"] = """
SELECT event_id, ts, CASE event_id % 10 WHEN 0 THEN 'not json' WHEN 1 THEN '{"other":1}'
  ELSE concat('{"AlarmName":"alarm-', CAST(user_id % 9 AS VARCHAR(20)), '","NewStateValue":"', CASE event_id % 3 WHEN 0 THEN 'ALARM' WHEN 1 THEN 'OK' ELSE 'INSUFFICIENT_DATA' END, '"}') END AS message
FROM events
"""

VIEWS["fx_version"] = """
SELECT concat('k/', CAST(o_custkey AS VARCHAR(20))) AS key, o_orderkey AS version_id, o_orderdate AS last_modified,
  md5(CAST(CAST(floor(o_totalprice) AS BIGINT) % 50 AS VARCHAR(20))) AS e_tag, CAST(floor(o_totalprice) AS BIGINT) AS size,
  o_orderstatus = 'F' AS is_delete_marker
FROM orders
"""

VIEWS["fx_registry"] = """
SELECT * FROM (VALUES ('alpha','src-alpha','bb-alpha','main','111111111111',true), ('bravo','src-bravo','bb-bravo','main','111111111111',true),
  ('charlie','src-charlie','bb-charlie','main','222222222222',true), ('delta','src-delta','bb-delta','main','222222222222',false))
  AS t(source_alias, source_bucket, backup_bucket, label, account_id, inventory_enabled)
"""

VIEWS["fx_pair"] = """
SELECT source_alias, label, source_bucket, backup_bucket FROM fx_registry
UNION ALL SELECT * FROM (VALUES ('bravo','extra','src-bravo-extra','bb-bravo-extra'), ('alpha','old','src-alpha-old','bb-alpha-old'),
  ('charlie','late','src-charlie-late','bb-charlie-late')) AS t(source_alias, label, source_bucket, backup_bucket)
"""

# --- views of this repository -----------------------------------------------------------------

_ALIAS = "CASE {0} % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'bravo' WHEN 2 THEN 'charlie' ELSE 'delta' END"

VIEWS["fx_src_listing"] = """
SELECT source_alias, bucket, label, key, size, e_tag FROM fx_src
WHERE dt = '2024-01-30-01-00' AND (is_latest OR is_latest IS NULL) AND (NOT is_delete_marker OR is_delete_marker IS NULL)
"""

VIEWS["fx_cur"] = """
SELECT * FROM fx_inventory
WHERE (is_latest OR is_latest IS NULL) AND (NOT is_delete_marker OR is_delete_marker IS NULL)
"""

# today's current rows: source side, and backup side without reserved prefixes
VIEWS["fx_s"] = "SELECT * FROM fx_cur WHERE side = 'source' AND dt = '2024-01-30-01-00'"
VIEWS["fx_b"] = r"""
SELECT * FROM fx_cur WHERE side = 'backup' AND dt = '2024-01-30-01-00'
  AND NOT (starts_with(key,'_state/') OR starts_with(key,'_manifests/') OR starts_with(key,'_batch-reports/') OR starts_with(key,'_events/'))
"""

# current rows of each bucket's and side's newest snapshot
VIEWS["fx_newest"] = "SELECT source_alias, label, side, max(dt) AS dt FROM fx_inventory WHERE dt <= '2024-01-30-01-00' GROUP BY ALL"
VIEWS["fx_ns"] = "SELECT c.* FROM fx_cur c JOIN fx_newest n USING (source_alias, label, side, dt) WHERE side = 'source'"
VIEWS["fx_nb"] = """
SELECT c.* FROM fx_cur c JOIN fx_newest n USING (source_alias, label, side, dt) WHERE side = 'backup'
  AND NOT (starts_with(key,'_state/') OR starts_with(key,'_manifests/') OR starts_with(key,'_batch-reports/') OR starts_with(key,'_events/'))
"""

VIEWS["fx_delivery"] = """
SELECT source_alias, side,
  concat('inventory/', source_alias, '/', side, '/', bucket, '/', bucket, '/daily/hive/dt=', dt, '/symlink.txt') AS key,
  CAST(count(*) * 130 AS BIGINT) AS size, strptime(dt, '%Y-%m-%d-%H-%M') AS last_modified
FROM fx_inventory GROUP BY dt, source_alias, side, bucket
"""

VIEWS["fx_run_state"] = """
SELECT source AS source_alias, bucket, ts AS checked_at, status, CAST(event_id % 900 AS BIGINT) AS objects_copied, event_id
FROM fx_event_log WHERE event_type = 'backup_run'
"""

VIEWS["fx_bucket"] = "SELECT DISTINCT source AS source_alias, bucket FROM fx_event_log"

VIEWS["fx_table"] = f"""
SELECT source_alias, table_name,
  CASE WHEN table_name = 'table-5' THEN 'DISABLED' WHEN table_name = 'table-6' THEN NULL ELSE 'ENABLED' END AS pitr_status,
  latest_restorable
FROM (SELECT {_ALIAS.format('user_id')} AS source_alias, concat('table-', CAST(user_id % 12 AS VARCHAR)) AS table_name,
  max(ts) AS latest_restorable FROM events GROUP BY 1, 2)
"""

VIEWS["fx_pending"] = f"""
SELECT concat('arn:aws:dynamodb:ap-southeast-2:111111111111:table/table-', CAST(user_id % 12 AS VARCHAR), '-restore-', CAST(event_id AS VARCHAR)) AS restore_arn,
  CASE WHEN user_id % 12 = 11 THEN 'retired' ELSE {_ALIAS.format('user_id')} END AS source,
  concat('arn:aws:dynamodb:ap-southeast-2:111111111111:table/table-', CAST(user_id % 12 AS VARCHAR)) AS source_table_arn,
  date_trunc('day', ts) AS restore_point, ts AS submitted_at
FROM events WHERE event_type = 'signup'
"""

VIEWS["fx_table_status"] = """
SELECT concat('table-', CAST(user_id % 12 AS VARCHAR), '-restore-', CAST(event_id AS VARCHAR)) AS table_name,
  CASE WHEN value < 20 THEN 'CREATING' ELSE 'ACTIVE' END AS table_status
FROM events WHERE event_type = 'signup' AND value >= 5
"""

VIEWS["fx_run"] = f"""
SELECT o_orderkey AS run_id, {_ALIAS.format('o_custkey')} AS source_alias, o_orderdate AS started_at
FROM orders WHERE o_orderstatus = 'P'
"""

VIEWS["fx_source_version"] = f"""
SELECT *, {_ALIAS.format("CAST(replace(key, 'k/', '') AS BIGINT)")} AS source_alias FROM fx_version
"""

VIEWS["fx_signal"] = """
SELECT concat('s-', CAST(o_orderkey AS VARCHAR)) AS source_alias, o_orderpriority <> '5-LOW' AS inventory_enabled,
  CASE WHEN c % 17 <> 0 THEN CAST(c % 40 AS DOUBLE) END AS inventory_age_hours,
  CASE WHEN c % 13 <> 0 THEN CASE WHEN c % 9 = 0 THEN c % 100 ELSE 0 END END AS missing,
  CASE WHEN c % 13 <> 0 THEN CASE WHEN c % 9 = 0 THEN c % 3 ELSE 0 END END AS still_missing,
  CASE WHEN c % 13 <> 0 THEN CASE WHEN c % 4 = 0 THEN c % 7 ELSE 0 END END AS orphans,
  CASE WHEN c % 13 <> 0 THEN CASE WHEN c % 6 = 0 THEN c % 7 ELSE 0 END END AS orphans_before,
  CASE WHEN c % 11 <> 0 THEN CASE WHEN c % 3 = 0 THEN 0 ELSE c % 5 - 2 END END AS delta,
  CASE WHEN c % 10 = 1 THEN 'failed' WHEN c % 10 < 6 THEN 'passed' WHEN c % 10 = 6 THEN 'skipped' END AS restore_result,
  CASE WHEN o_orderstatus <> 'P' THEN c % 19 <> 0 END AS pitr_enabled,
  CASE WHEN c % 23 <> 0 THEN CAST(o_custkey % 45 AS DOUBLE) END AS backup_age_hours,
  CASE WHEN c % 29 <> 0 THEN (c % 12) / 100.0 END AS failure_pct,
  CAST(CASE WHEN c % 31 = 0 THEN 1 ELSE 0 END AS BIGINT) AS exports_failed
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders)
"""

VIEWS["fx_desired"] = "SELECT concat(' ', upper(c_name), ' ') AS endpoint FROM customer WHERE c_acctbal > 0"
VIEWS["fx_subscribed"] = """
SELECT c_name AS endpoint, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PendingConfirmation' ELSE concat('arn:sub/', CAST(c_custkey AS VARCHAR)) END AS arn
FROM customer WHERE c_mktsegment <> 'BUILDING'
"""


def with_views(sql: str) -> str:
    """Prepend the views a query uses, directly or through other views, as CTEs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and _mentions(text, name):
                needed.add(name)
                visit(body)

    visit(sql)
    # materialised, so that a row limit around the query isn't planned into its joins
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    ctes.append(f"_out AS MATERIALIZED ({sql.strip().rstrip(';')})")
    return f"WITH {', '.join(ctes)} SELECT * FROM _out"


def _mentions(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b{name}\b", text) is not None
