"""Reference SQL for DuckDB, one text per registered query.

Written from the rules, not from the Spark plans: own joins, own JSON access.
"""

from __future__ import annotations

from checks.landed_sql import AS_OF_MS, LANDED, landed_cte

# Named steps; each may use the landed inputs and the steps before it.
CLUSTERS = """
clusters AS (
  SELECT payload->>'$.cluster_id' AS cluster_id,
    payload->>'$.spark_version' AS spark_version,
    nullif(payload->>'$.data_security_mode', '') AS access_mode,
    payload->>'$.policy_id' AS policy_id
  FROM fx_clusters WHERE json_valid(payload))"""

POLICIES = """
cluster_policies AS (
  SELECT policy_id, name AS policy_name,
    CASE WHEN json_valid(definition) THEN definition->>'$.spark_version.value' END
      AS policy_spark_version
  FROM fx_cluster_policies)"""

JOBS = """
job_records AS (
  SELECT CAST(payload->>'$.job_id' AS BIGINT) AS job_id,
    payload->>'$.settings.name' AS job_name,
    payload->>'$.creator_user_name' AS creator,
    coalesce(list_filter(payload->>'$.settings.job_clusters[*].new_cluster.spark_version',
      lambda v: v IS NOT NULL AND v <> ''), []) AS versions,
    from_json(payload->'$.settings.tasks',
      '[{"task_key":"VARCHAR","existing_cluster_id":"VARCHAR","job_cluster_key":"VARCHAR"}]') AS tasks
  FROM fx_jobs WHERE json_valid(payload)),
jobs AS (
  SELECT job_id, job_name, creator,
    list_filter(versions, lambda v, i: list_position(versions, v) = i) AS dbr_versions,
    coalesce(CAST(to_json(tasks) AS VARCHAR), '[]') AS task_clusters, tasks
  FROM job_records)"""

PIPELINES = """
pipelines AS (
  SELECT payload->>'$.pipeline_id' AS pipeline_id,
    coalesce(payload->>'$.spec.name', payload->>'$.name') AS name,
    payload->>'$.creator_user_name' AS creator_user_name,
    payload->>'$.spec.target' AS target,
    payload->>'$.spec.catalog' AS catalog,
    coalesce(CAST(to_json(from_json(payload->'$.spec.clusters',
      '[{"label":"VARCHAR","node_type_id":"VARCHAR","custom_tags":"JSON"}]')) AS VARCHAR), '[]')
      AS clusters
  FROM fx_pipelines)"""

RUNS = f"""
submit_runs AS (
  SELECT CAST(payload->>'$.run_id' AS BIGINT) AS run_id,
    payload->>'$.run_name' AS run_name,
    payload->>'$.creator_user_name' AS creator_user_name,
    CAST(payload->>'$.start_time' AS BIGINT) AS start_time,
    payload->>'$.state.life_cycle_state' AS state_life_cycle_state,
    payload->>'$.state.result_state' AS state_result_state
  FROM (SELECT * FROM fx_submit_runs WHERE json_valid(payload))
  WHERE payload->>'$.run_type' = 'SUBMIT_RUN'
    AND CAST(payload->>'$.start_time' AS BIGINT) >= {AS_OF_MS} - 30 * 24 * 3600 * 1000::BIGINT)"""

EXTERNAL_LOCATIONS = """
external_locations AS (
  SELECT payload->>'$.name' AS name, payload->>'$.url' AS url,
    payload->>'$.credential_name' AS credential_name, payload->>'$.owner' AS owner,
    coalesce(CAST(payload->>'$.read_only' AS BOOLEAN), false) AS read_only
  FROM fx_external_locations)"""

INIT_SCRIPTS = """
global_init_scripts AS (
  SELECT payload->>'$.script_id' AS script_id, payload->>'$.name' AS script_name,
    payload->>'$.created_by' AS created_by,
    coalesce(CAST(payload->>'$.enabled' AS BOOLEAN), false) AS enabled
  FROM fx_global_init_scripts)"""

GRANTS = """
grants AS (
  SELECT database_name AS database, object_type, database_name AS object_name,
    CASE WHEN len(payload->>'$.Principal') > 0 THEN payload->>'$.Principal'
      ELSE payload->>'$.principal' END AS principal,
    CASE WHEN len(payload->>'$.ActionType') > 0 THEN payload->>'$.ActionType'
      ELSE payload->>'$.action_type' END AS action_type
  FROM fx_grants
  WHERE object_type = 'SCHEMA' AND split_part(database_name, '.', 1) <> 'system')"""

MOUNTS = """
mounts AS (SELECT mount_point AS "mountPoint", source FROM fx_mounts)"""

UDFS = """
udf_rows AS (
  SELECT schema_name AS schema, function_name, ordinal, trim(info_value) AS value,
    CASE
      WHEN lower(trim(info_name)) LIKE '%deterministic%' THEN 'deterministic'
      WHEN lower(trim(info_name)) LIKE '%body%' OR lower(trim(info_name)) LIKE '%expression%' THEN 'body'
      WHEN lower(trim(info_name)) LIKE '%return type%' OR lower(trim(info_name)) LIKE '%returns%' THEN 'return_type'
      WHEN lower(trim(info_name)) LIKE '%arguments%' OR lower(trim(info_name)) LIKE '%signature%' THEN 'input_types'
    END AS field
  FROM fx_udf_info WHERE schema_name NOT LIKE 'system.%'),
udf_last AS (
  SELECT schema, function_name, field, max_by(value, ordinal) AS value
  FROM udf_rows GROUP BY ALL),
udf_said AS (
  SELECT schema, function_name,
    max(CASE WHEN field = 'input_types' THEN value END) AS input_types,
    max(CASE WHEN field = 'return_type' THEN value END) AS return_type,
    max(CASE WHEN field = 'deterministic' THEN value END) AS deterministic,
    max(CASE WHEN field = 'body' THEN value END) AS body
  FROM udf_last GROUP BY schema, function_name),
udf_denied AS (SELECT schema_name, function_name, max(error) AS error FROM fx_udf_info
  WHERE error IS NOT NULL GROUP BY schema_name, function_name),
udfs AS (
  SELECT l.schema_name AS schema, l.function_name,
    CASE WHEN e.error IS NULL THEN input_types END AS input_types,
    CASE WHEN e.error IS NULL THEN return_type END AS return_type,
    CASE WHEN e.error IS NULL THEN deterministic END AS deterministic,
    CASE WHEN e.error IS NULL THEN body END AS body, e.error
  FROM (SELECT DISTINCT * FROM fx_udf_list WHERE schema_name NOT LIKE 'system.%') l
  LEFT JOIN udf_said s ON s.schema = l.schema_name AND s.function_name = l.function_name
  LEFT JOIN udf_denied e ON e.schema_name = l.schema_name AND e.function_name = l.function_name)"""

TABLES = """
tables AS (
  SELECT l.catalog_schema, l.table_name AS "table",
    coalesce(t.table_type, 'UNKNOWN') AS table_type,
    CASE WHEN t.table_type = 'VIEW' THEN NULL ELSE d.format END AS format,
    CASE WHEN t.table_type = 'VIEW' THEN NULL ELSE d.location END AS location,
    CASE WHEN t.table_type = 'VIEW' OR d.table_name IS NULL OR d.error IS NOT NULL THEN 0
      ELSE d.size_in_bytes END AS size,
    CASE WHEN t.table_type = 'VIEW' THEN false ELSE coalesce(d.format = 'delta', false) END AS is_delta,
    CASE WHEN t.table_type = 'VIEW' OR d.table_name IS NULL THEN '[]' ELSE d.partition_columns END
      AS partition_columns,
    CASE WHEN t.table_type = 'VIEW' THEN NULL ELSE d.error END AS error
  FROM fx_table_list l
  LEFT JOIN fx_table_types t
    ON t.table_catalog || '.' || t.table_schema = l.catalog_schema AND t.table_name = l.table_name
  LEFT JOIN fx_table_details d
    ON d.catalog_schema = l.catalog_schema AND d.table_name = l.table_name
  WHERE split_part(l.catalog_schema, '.', 1) <> 'system')"""

# A version as one number: exact while minor versions stay below 100000.
OLD = (
    "CAST(regexp_extract(trim({v}), '^([0-9]+)[.]([0-9]+)', 1) AS BIGINT) * 100000"
    " + CAST(regexp_extract(trim({v}), '^([0-9]+)[.]([0-9]+)', 2) AS BIGINT) < 11 * 100000 + 3"
)
HAS_VERSION = "regexp_matches(trim({v}), '^[0-9]+[.][0-9]+')"


def _version_finding(v: str) -> str:
    return (
        f"CASE WHEN {HAS_VERSION.format(v=v)} THEN CASE WHEN {OLD.format(v=v)}"
        f" THEN 'not supported DBR: ' || {v} END END"
    )


MODE_FINDING = """CASE access_mode
      WHEN 'NO_ISOLATION' THEN 'No isolation shared clusters not supported in UC'
      WHEN 'LEGACY_SINGLE_USER' THEN 'cluster type not supported : LEGACY_SINGLE_USER' END"""

CLUSTERS_ASSESSED = f"""
clusters_assessed AS (
  SELECT *, list_filter([{_version_finding("spark_version")}, {MODE_FINDING}],
    lambda f: f IS NOT NULL) AS findings
  FROM clusters)"""

TABLES_ASSESSED = """
tables_assessed AS (
  SELECT *, CASE WHEN upper(table_type) = 'VIEW' THEN [] ELSE list_filter([
      CASE WHEN format <> '' AND lower(format) <> 'delta' THEN 'Non-DELTA format: ' || upper(format) END,
      CASE WHEN location LIKE 'dbfs:/mnt/%' OR location LIKE '/mnt/%' THEN 'Data is in DBFS Mount'
        WHEN location LIKE 'dbfs:/%' THEN 'Data is in DBFS Root' END], lambda f: f IS NOT NULL)
    END AS findings
  FROM tables)"""

JOBS_ASSESSED = f"""
job_findings AS (
  SELECT job_id, 0 AS source, i AS at1, 0 AS at2, {_version_finding("v")} AS finding
  FROM (SELECT job_id, unnest(dbr_versions) AS v, generate_subscripts(dbr_versions, 1) AS i FROM jobs)
  UNION ALL
  SELECT t.job_id, 1, t.i, c.i, c.finding
  FROM (SELECT job_id, unnest(tasks).existing_cluster_id AS id, generate_subscripts(tasks, 1) AS i FROM jobs) t
  JOIN (SELECT cluster_id, unnest(findings) AS finding, generate_subscripts(findings, 1) AS i
        FROM clusters_assessed) c ON c.cluster_id = t.id),
job_first AS (
  SELECT job_id, finding, min((source, at1, at2)) AS place
  FROM job_findings WHERE finding IS NOT NULL GROUP BY job_id, finding),
job_lists AS (
  SELECT job_id, list(finding ORDER BY place) AS findings FROM job_first GROUP BY job_id),
jobs_assessed AS (
  SELECT j.job_id, job_name, creator, dbr_versions, task_clusters, coalesce(f.findings, []) AS findings
  FROM jobs j LEFT JOIN job_lists f ON f.job_id = j.job_id)"""

STORAGE = """
storage AS (
  SELECT catalog_schema, "table", location, CASE
      WHEN location IS NULL OR location = '' THEN 'UNSUPPORTED'
      WHEN regexp_matches(location, '^(s3|s3a|abfss|wasbs|gs|adl)://') THEN 'EXTERNAL'
      WHEN regexp_matches(location, '^(dbfs:)?/mnt/') THEN 'DBFS_MOUNT'
      WHEN regexp_matches(location, '^(dbfs:/|file:/dbfs/)') THEN
        CASE WHEN EXISTS (SELECT 1 FROM mounts m WHERE contains(location, m."mountPoint"))
          THEN 'DBFS_MOUNT' ELSE 'DBFS_ROOT' END
      ELSE 'UNSUPPORTED' END AS storage_type
  FROM tables)"""

GRANT_COUNTS = """
grant_counts AS (
  SELECT database, count(principal) AS total_grants, count(DISTINCT principal) AS granted_principals
  FROM grants WHERE database IS NOT NULL GROUP BY database)"""

DATABASE_SUMMARY = """
database_summary AS (
  SELECT s.*, g.total_grants, g.granted_principals
  FROM (SELECT catalog_schema AS database, count("table") AS tables,
      count(*) FILTER (upper(table_type) = 'VIEW') AS views,
      count(*) FILTER (len(findings) > 0) AS unsupported,
      count(*) FILTER (location LIKE 'dbfs:/%' AND location NOT LIKE 'dbfs:/mnt/%') AS dbfs_root,
      count(*) FILTER (is_delta) AS delta_tables
    FROM tables_assessed WHERE catalog_schema IS NOT NULL GROUP BY catalog_schema) s
  LEFT JOIN grant_counts g ON g.database = s.database)"""

ALL_FINDINGS = """
all_findings AS (
  SELECT 'clusters' AS object_type, findings FROM clusters_assessed
  UNION ALL SELECT 'jobs', findings FROM jobs_assessed
  UNION ALL SELECT 'tables', findings FROM tables_assessed),
assessment_summary AS (
  SELECT finding, count(*) AS "count" FROM (SELECT unnest(findings) AS finding FROM all_findings) GROUP BY finding)"""

OVERVIEW = """
overview AS (
  SELECT 'Total Databases' AS metric, (SELECT count(DISTINCT catalog_schema) FROM tables) AS value
  UNION ALL SELECT 'Total Tables', (SELECT count(*) FROM tables WHERE table_type <> 'VIEW')
  UNION ALL SELECT 'Total Views', (SELECT count(*) FROM tables WHERE table_type = 'VIEW')
  UNION ALL SELECT 'Total Storage Locations',
    (SELECT count(*) FROM external_locations) + (SELECT count(*) FROM mounts)
  UNION ALL SELECT 'Total Jobs', (SELECT count(*) FROM jobs)
  UNION ALL SELECT 'Total Clusters', (SELECT count(*) FROM clusters)
  UNION ALL SELECT 'Total Pipelines', (SELECT count(*) FROM pipelines)
  UNION ALL SELECT 'Total UDFs', (SELECT count(*) FROM udfs))"""

TABLE_INPUTS = ("table_list", "table_types", "table_details")
RULE_INPUTS = ("clusters", "jobs", *TABLE_INPUTS)
RULE_STEPS = (CLUSTERS, CLUSTERS_ASSESSED, JOBS, JOBS_ASSESSED, TABLES, TABLES_ASSESSED)
INVENTORY_STEPS = (
    CLUSTERS, POLICIES, JOBS, PIPELINES, RUNS, TABLES, UDFS, GRANTS, MOUNTS,
    EXTERNAL_LOCATIONS, INIT_SCRIPTS,
)


def _sql(inputs: tuple[str, ...], steps: tuple[str, ...], select: str) -> str:
    return "WITH " + landed_cte(*inputs) + "," + ",".join(steps) + "\n" + select


READINESS = """
readiness_summary AS (
  SELECT object_type, ((2000 * ok + total) // nullif(2 * total, 0)) / 10 AS readiness FROM (
    SELECT object_type, count(*) AS total, count(*) FILTER (len(findings) = 0) AS ok
    FROM all_findings GROUP BY object_type))"""

STORAGE_SUMMARY = """
storage_summary AS (
  SELECT storage_type, count(*) AS table_count FROM storage GROUP BY storage_type)"""

# Report tables in order, as they are written: lists become JSON text.
REPORT = (
    ("Assessment Overview", "SELECT * FROM overview"),
    ("Readiness Summary", "SELECT * FROM readiness_summary"),
    ("Assessment Summary", "SELECT * FROM assessment_summary"),
    ("Database Summary", "SELECT * FROM database_summary"),
    ("Tables", "SELECT * REPLACE (CAST(to_json(findings) AS VARCHAR) AS findings) FROM tables_assessed"),
    ("UDFs", "SELECT * FROM udfs"),
    ("Storage Summary", "SELECT * FROM storage_summary"),
    ("External Locations", "SELECT * FROM external_locations"),
    ("Mount Points", "SELECT * FROM mounts"),
    ("Clusters", "SELECT * REPLACE (CAST(to_json(findings) AS VARCHAR) AS findings) FROM clusters_assessed"),
    ("Cluster Policies", "SELECT * FROM cluster_policies"),
    ("Jobs", "SELECT * REPLACE (CAST(to_json(dbr_versions) AS VARCHAR) AS dbr_versions,"
             " CAST(to_json(findings) AS VARCHAR) AS findings) FROM jobs_assessed"),
    ("Submit Runs", "SELECT * FROM submit_runs"),
    ("Pipelines", "SELECT * FROM pipelines"),
    ("Global Init Scripts", "SELECT * FROM global_init_scripts"),
    ("Grants", "SELECT * FROM grants"),
)


def _report() -> str:
    """Rows of each report table, and the sum of a number taken from the hash of each row."""
    digest = "('0x' || substr(md5(CAST(to_json(t) AS VARCHAR)), 1, 8))::BIGINT"
    return "\nUNION ALL ".join(
        f"SELECT {place} AS place, '{title}' AS title, count(*) AS row_count,"
        f" CAST(coalesce(sum({digest}), 0) AS BIGINT) AS row_hash_sum"
        f" FROM ({select}) t"
        for place, (title, select) in enumerate(REPORT, start=1)
    )


_UDFS = _sql(("udf_list", "udf_info"), (UDFS,), "SELECT * FROM udfs")
_CLUSTERS = _sql(("clusters",), (CLUSTERS,), "SELECT * FROM clusters")
_TABLES = _sql(TABLE_INPUTS, (TABLES,), "SELECT * FROM tables")

ORACLE_SQL: dict[str, str] = {
    "snapshot_write": _CLUSTERS,
    "snapshot_read": _UDFS,
    "materialize_or_read": _TABLES,
    "report_tables": _sql(
        tuple(LANDED),
        (
            *INVENTORY_STEPS, CLUSTERS_ASSESSED, JOBS_ASSESSED, TABLES_ASSESSED, STORAGE,
            STORAGE_SUMMARY, GRANT_COUNTS, DATABASE_SUMMARY, ALL_FINDINGS, READINESS, OVERVIEW,
        ),
        _report(),
    ),
    "clusters_inventory": _CLUSTERS,
    "cluster_policies_inventory": _sql(
        ("cluster_policies",), (POLICIES,), "SELECT * FROM cluster_policies"
    ),
    "jobs_inventory": _sql(
        ("jobs",),
        (JOBS,),
        "SELECT job_id, job_name, creator, array_to_string(dbr_versions, '; ') AS dbr_versions, task_clusters FROM jobs",
    ),
    "pipelines_inventory": _sql(("pipelines",), (PIPELINES,), "SELECT * FROM pipelines"),
    "submit_runs_inventory": _sql(("submit_runs",), (RUNS,), "SELECT * FROM submit_runs"),
    "unreadable_records": _sql(
        ("clusters", "jobs", "submit_runs"),
        ("one AS (SELECT 1)",),
        " UNION ALL ".join(
            f"SELECT '{n}' AS kind, payload AS text FROM fx_{n} WHERE NOT json_valid(payload)"
            for n in ("clusters", "jobs", "submit_runs")
        ),
    ),
    "landed_files": _sql(
        ("clusters", "mounts", "jobs"),
        (CLUSTERS, MOUNTS, JOBS),
        """SELECT 'clusters' AS kind, cluster_id AS name, spark_version AS detail FROM clusters
        UNION ALL SELECT 'mounts', "mountPoint", source FROM mounts
        UNION ALL SELECT 'jobs', CAST(job_id AS VARCHAR), job_name FROM jobs""",
    ),
    "external_locations_inventory": _sql(
        ("external_locations",), (EXTERNAL_LOCATIONS,), "SELECT * FROM external_locations"
    ),
    "init_scripts_inventory": _sql(
        ("global_init_scripts",), (INIT_SCRIPTS,), "SELECT * FROM global_init_scripts"
    ),
    "grants_inventory": _sql(("grants",), (GRANTS,), "SELECT * FROM grants"),
    "mounts_inventory": _sql(("mounts",), (MOUNTS,), "SELECT * FROM mounts"),
    "udfs_inventory": _UDFS,
    "tables_inventory": _TABLES,
    "stored_table_parts": _TABLES,
    "combined_exports": _sql(
        ("mounts", "old_mounts"), (MOUNTS,),
        'SELECT * FROM mounts UNION ALL SELECT mount_point AS "mountPoint", CAST(NULL AS VARCHAR) AS source FROM fx_old_mounts',
    ),
    "partial_readiness": _sql(
        TABLE_INPUTS,
        (TABLES, TABLES_ASSESSED),
        """, counted AS (SELECT 'tables' AS object_type, count(*) AS objects, count(*) FILTER (len(findings) = 0) AS ok FROM tables_assessed
  UNION ALL VALUES ('clusters', 0, 0), ('jobs', 0, 0))
SELECT object_type, 'objects' AS metric, CAST(objects AS DOUBLE) AS value FROM counted
UNION ALL SELECT object_type, 'readiness', ((2000 * ok + objects) // nullif(2 * objects, 0)) / 10 FROM counted""",
    ),
    "accessible_schemas": _sql(
        ("schemas",),
        ("one AS (SELECT 1)",),
        "SELECT DISTINCT table_catalog || '.' || table_schema AS catalog_schema FROM fx_schemas"
        " WHERE table_catalog NOT IN ('system') AND len(table_schema) > 0",
    ),
    "unsupported_versions": _sql(
        ("clusters",),
        (CLUSTERS,),
        f"SELECT * FROM (SELECT cluster_id, spark_version, {_version_finding('spark_version')}"
        " AS finding FROM clusters) WHERE finding IS NOT NULL",
    ),
    "disallowed_access_modes": _sql(
        ("clusters",),
        (CLUSTERS,),
        f"SELECT * FROM (SELECT cluster_id, access_mode, {MODE_FINDING} AS finding FROM clusters)"
        " WHERE finding IS NOT NULL",
    ),
    "clusters_assessed": _sql(
        ("clusters",),
        (CLUSTERS, CLUSTERS_ASSESSED),
        "SELECT * REPLACE (array_to_string(findings, '; ') AS findings) FROM clusters_assessed",
    ),
    "tables_assessed": _sql(
        TABLE_INPUTS,
        (TABLES, TABLES_ASSESSED),
        "SELECT * REPLACE (array_to_string(findings, '; ') AS findings) FROM tables_assessed",
    ),
    "jobs_assessed": _sql(
        ("clusters", "jobs"),
        (CLUSTERS, CLUSTERS_ASSESSED, JOBS, JOBS_ASSESSED),
        "SELECT * REPLACE (array_to_string(findings, '; ') AS findings,"
        " array_to_string(dbr_versions, '; ') AS dbr_versions) FROM jobs_assessed",
    ),
    "storage_classes": _sql(
        (*TABLE_INPUTS, "mounts"), (TABLES, MOUNTS, STORAGE), "SELECT * FROM storage"
    ),
    "storage_summary": _sql(
        (*TABLE_INPUTS, "mounts"),
        (TABLES, MOUNTS, STORAGE, STORAGE_SUMMARY),
        "SELECT * FROM storage_summary",
    ),
    "grants_by_database": _sql(
        ("grants",), (GRANTS, GRANT_COUNTS), "SELECT * FROM grant_counts"
    ),
    "database_summary": _sql(
        (*TABLE_INPUTS, "grants"),
        (TABLES, TABLES_ASSESSED, GRANTS, GRANT_COUNTS, DATABASE_SUMMARY),
        "SELECT * FROM database_summary",
    ),
    "readiness_summary": _sql(
        RULE_INPUTS, (*RULE_STEPS, ALL_FINDINGS, READINESS), "SELECT * FROM readiness_summary"
    ),
    "assessment_summary": _sql(
        RULE_INPUTS, (*RULE_STEPS, ALL_FINDINGS), "SELECT * FROM assessment_summary"
    ),
    "overview": _sql(
        tuple(n for n in LANDED if n not in ("cluster_policies", "submit_runs", "grants", "global_init_scripts")),
        (CLUSTERS, JOBS, PIPELINES, TABLES, UDFS, MOUNTS, EXTERNAL_LOCATIONS, OVERVIEW),
        "SELECT * FROM overview",
    ),
}
