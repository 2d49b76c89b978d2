"""Landed inputs derived from the driver's tables.

Each text is SQL that gives the same rows in Spark and in DuckDB. ``$name`` stands
for a table: Spark reads its Parquet file, DuckDB its registered view. All of them
come from tables that grow with the scale factor.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

CLUSTERS = """
SELECT '{"cluster_id":"c-' || CAST(s_suppkey AS STRING) || '"'
  || CASE s_suppkey % 8
       WHEN 0 THEN ''
       WHEN 1 THEN ',"spark_version":"11.3.x-scala2.12"'
       WHEN 2 THEN ',"spark_version":"10.4.x-scala2.12"'
       WHEN 3 THEN ',"spark_version":"9.1.x-scala2.12"'
       WHEN 4 THEN ',"spark_version":" 13.3.x-photon-scala2.12"'
       WHEN 5 THEN ',"spark_version":"custom:snapshot__10.4.x"'
       WHEN 6 THEN ',"spark_version":"11.2.x-scala2.12"'
       ELSE ',"spark_version":"14.3.x-scala2.12"' END
  || CASE s_suppkey % 5
       WHEN 0 THEN ',"data_security_mode":"NO_ISOLATION"'
       WHEN 1 THEN ',"data_security_mode":"LEGACY_SINGLE_USER"'
       WHEN 2 THEN ',"data_security_mode":"USER_ISOLATION"'
       WHEN 3 THEN ',"data_security_mode":"SINGLE_USER"'
       ELSE '' END
  || CASE WHEN s_suppkey % 3 = 0 THEN ',"policy_id":"p-' || CAST(s_nationkey AS STRING) || '"' ELSE '' END
  || CASE WHEN s_suppkey % 17 = 5 THEN ',"cut' ELSE '}' END AS payload
FROM $supplier
"""

JOBS = """
SELECT '{"job_id":' || CAST(o_orderkey AS STRING)
  || ',"creator_user_name":"u-' || CAST(o_custkey AS STRING) || '"'
  || CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE
     ',"settings":{"name":"job ' || o_orderpriority || '"'
     || CASE o_orderkey % 5
          WHEN 0 THEN ''
          WHEN 1 THEN ',"job_clusters":[{"job_cluster_key":"a","new_cluster":{"spark_version":"10.4.x-scala2.12"}}]'
          WHEN 2 THEN ',"job_clusters":[{"job_cluster_key":"a","new_cluster":{"spark_version":"10.4.x-scala2.12"}},{"job_cluster_key":"b","new_cluster":{"spark_version":"10.4.x-scala2.12"}},{"job_cluster_key":"c","new_cluster":{"spark_version":"9.1.x-scala2.12"}}]'
          WHEN 3 THEN ',"job_clusters":[{"job_cluster_key":"a","new_cluster":{}},{"job_cluster_key":"b","new_cluster":{"spark_version":"14.3.x-scala2.12"}}]'
          ELSE ',"job_clusters":[]' END
     || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE
        ',"tasks":[{"task_key":"t1","existing_cluster_id":"c-' || CAST(o_custkey % 1200 AS STRING)
        || '"},{"task_key":"t2","existing_cluster_id":"c-' || CAST(o_orderkey % 7 AS STRING)
        || '"},{"task_key":"t3","job_cluster_key":"a"}]' END
     || '}' END
  || CASE WHEN o_orderkey % 43 = 7 THEN '' ELSE '}' END AS payload
FROM $orders
"""

POLICIES = """
SELECT 'p-' || CAST(c_custkey AS STRING) AS policy_id, c_name AS name,
  CASE c_custkey % 10
    WHEN 8 THEN '{"spark_version":{"value":"10.1.x"}} trailing'
    WHEN 9 THEN '{"spark_version":{"value":"10.2.x"}'
    WHEN 0 THEN '{"spark_version":{"type":"fixed","value":"11.3.x-scala2.12"}}'
    WHEN 1 THEN '{"spark_version":{"type":"unlimited"}}'
    WHEN 2 THEN '{"node_type_id":{"value":"n1"}}'
    WHEN 3 THEN '{"spark_version":"10.4.x"}'
    WHEN 4 THEN 'not json'
    WHEN 5 THEN '[{"spark_version":{"value":"9.1.x"}}]'
    WHEN 6 THEN '{"spark_version":{"value":"9.' || CAST(c_custkey % 3 AS STRING) || '.x"}}'
    ELSE NULL END AS definition
FROM $customer
"""

PIPELINES = """
SELECT '{"pipeline_id":"pl-' || CAST(c_custkey AS STRING) || '","name":"outer ' || c_name || '"'
  || ',"creator_user_name":"u-' || CAST(c_nationkey AS STRING) || '"'
  || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE
     ',"spec":{' || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '"name":"' || c_name || '",' END
     || '"target":"tgt_' || lower(c_mktsegment) || '","catalog":"main","channel":"CURRENT"'
     || CASE WHEN c_custkey % 3 = 0 THEN ',"serverless":true' ELSE '' END
     || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',"clusters":[{"label":"default","node_type_id":"n1","custom_tags":{"team":"t1"}},{"label":"maintenance"}]' END
     || '}' END
  || '}' AS payload
FROM $customer
"""

RUNS = """
SELECT '{"run_id":' || CAST(event_id AS STRING)
  || ',"run_name":"' || event_type || '","creator_user_name":"u-' || CAST(user_id AS STRING) || '"'
  || ',"run_type":"' || CASE event_id % 3 WHEN 0 THEN 'SUBMIT_RUN' WHEN 1 THEN 'JOB_RUN' ELSE 'WORKFLOW_RUN' END || '"'
  || ',"start_time":' || CAST(1704067200000 + event_id * 60000 AS STRING)
  || CASE event_id % 4
       WHEN 0 THEN ''
       WHEN 1 THEN ',"state":{"life_cycle_state":"RUNNING"}'
       WHEN 2 THEN ',"state":{"life_cycle_state":"TERMINATED","result_state":"SUCCESS"}'
       ELSE ',"state":{"life_cycle_state":"INTERNAL_ERROR","result_state":"FAILED"}' END
  || CASE WHEN event_id % 47 = 3 THEN ',"state' ELSE '}' END AS payload
FROM $events
"""

TABLE_LIST = """
SELECT CASE WHEN p_partkey % 19 = 0 THEN 'system' ELSE 'main' END || '.' || lower(replace(p_brand, '#', '_')) AS catalog_schema,
  't_' || CAST(p_partkey AS STRING) AS table_name
FROM $part
"""

TABLE_TYPES = """
SELECT CASE WHEN p_partkey % 19 = 0 THEN 'system' ELSE 'main' END AS table_catalog,
  lower(replace(p_brand, '#', '_')) AS table_schema,
  't_' || CAST(p_partkey AS STRING) AS table_name,
  CASE p_partkey % 5 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'EXTERNAL' ELSE 'MANAGED' END AS table_type
FROM $part WHERE p_partkey % 13 <> 0
"""

TABLE_DETAILS = """
SELECT CASE WHEN p_partkey % 19 = 0 THEN 'system' ELSE 'main' END || '.' || lower(replace(p_brand, '#', '_')) AS catalog_schema,
  't_' || CAST(p_partkey AS STRING) AS table_name,
  CASE WHEN p_partkey % 23 = 0 OR p_size % 6 = 3 THEN NULL WHEN p_size % 6 = 0 THEN 'parquet' WHEN p_size % 6 = 1 THEN 'csv' WHEN p_size % 6 = 2 THEN 'DELTA' ELSE 'delta' END AS format,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CASE p_partkey % 14
    WHEN 0 THEN 's3://b/t' WHEN 1 THEN 's3a://b/t' WHEN 2 THEN 'abfss://c@a/t' WHEN 3 THEN 'wasbs://c@a/t'
    WHEN 4 THEN 'gs://b/t' WHEN 5 THEN 'adl://a/t' WHEN 6 THEN 'dbfs:/mnt/raw/t' WHEN 7 THEN '/mnt/raw/t'
    WHEN 8 THEN 'dbfs:/user/hive/t' || CAST(p_partkey AS STRING)
    WHEN 9 THEN CASE WHEN p_partkey % 3 = 0 THEN 'file:/dbfs/tmp/t' ELSE 'file:/dbfs/mnt/n' || CAST(p_partkey % 2000 AS STRING) || '/t' END
    WHEN 10 THEN 'dbfs:/vol/n' || CAST(p_partkey % 2000 AS STRING) || '/t'
    WHEN 11 THEN 'dbfs:/mnt' WHEN 12 THEN 's3n://b/t' ELSE NULL END END AS location,
  CAST(CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_size * 1024 END AS BIGINT) AS size_in_bytes,
  CASE WHEN p_partkey % 4 = 0 AND p_partkey % 23 <> 0 THEN '["ds"]' ELSE '[]' END AS partition_columns,
  CASE WHEN p_partkey % 23 = 0 THEN 'permission denied' ELSE NULL END AS error
FROM $part WHERE p_partkey % 17 <> 0
"""

GRANTS = """
SELECT CASE WHEN o_orderkey % 37 = 0 THEN 'system' ELSE 'main' END || '.brand_' || CAST(2 + o_custkey % 38 AS STRING) AS database_name,
  CASE WHEN o_orderkey % 41 = 0 THEN 'TABLE' ELSE 'SCHEMA' END AS object_type,
  CASE o_orderkey % 5
    WHEN 0 THEN '{"Principal":"u-' || CAST(o_custkey % 97 AS STRING) || '","ActionType":"SELECT"}'
    WHEN 1 THEN '{"principal":"u-' || CAST(o_custkey % 97 AS STRING) || '","action_type":"USAGE"}'
    WHEN 2 THEN '{"Principal":"","principal":"g-' || CAST(o_custkey % 11 AS STRING) || '","ActionType":"MODIFY"}'
    WHEN 3 THEN '{"ActionType":"OWN"}'
    ELSE '{"Principal":"g-' || CAST(o_custkey % 11 AS STRING) || '","action_type":"SELECT"}' END AS payload
FROM $orders
"""

UDF_LIST = """
SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'system' ELSE 'main' END || '.brand_' || CAST(o_orderkey % 40 AS STRING) AS schema_name,
  'f_' || CAST(o_orderkey AS STRING) AS function_name
FROM $orders
"""

UDF_INFO = """
SELECT CASE WHEN l_orderkey % 31 = 0 THEN 'system' ELSE 'main' END || '.brand_' || CAST(l_orderkey % 40 AS STRING) AS schema_name,
  'f_' || CAST(l_orderkey AS STRING) AS function_name,
  l_linenumber AS ordinal,
  CASE l_linenumber WHEN 1 THEN ' Signature ' WHEN 2 THEN 'Return Type' WHEN 3 THEN 'Deterministic'
    WHEN 4 THEN 'Body' WHEN 5 THEN 'Expression' WHEN 6 THEN 'Owner' ELSE 'deterministic body' END AS info_name,
  ' v' || CAST(l_orderkey * 10 + l_linenumber AS STRING) || ' ' AS info_value,
  CASE WHEN l_orderkey % 23 = 0 AND l_linenumber = 1 THEN 'permission denied' ELSE NULL END AS error
FROM $lineitem WHERE l_orderkey % 9 <> 0
"""

SCHEMAS = """
SELECT CASE p_partkey % 19 WHEN 0 THEN 'system' WHEN 1 THEN NULL ELSE 'main' END AS table_catalog,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE lower(replace(p_brand, '#', '_')) || CAST(p_partkey % 7 AS STRING) END AS table_schema
FROM $part
"""

OLD_MOUNTS = """
SELECT '/mnt/old' || CAST(c_custkey AS STRING) AS mount_point FROM $customer
"""

MOUNTS = """
SELECT CASE WHEN s_suppkey % 3 = 0 THEN '/vol/n' ELSE '/mnt/n' END || CAST(s_suppkey AS STRING) AS mount_point,
  'abfss://c@' || lower(s_name) || '/' AS source
FROM $supplier
"""

EXTERNAL_LOCATIONS = """
SELECT '{"name":"loc-' || CAST(s_suppkey AS STRING) || '","url":"abfss://c@a' || CAST(s_suppkey AS STRING) || '/","credential_name":"cred","owner":"u-' || CAST(s_nationkey AS STRING) || '"'
  || CASE s_suppkey % 3 WHEN 0 THEN ',"read_only":true' WHEN 1 THEN ',"read_only":false' ELSE '' END || '}' AS payload
FROM $supplier
"""

INIT_SCRIPTS = """
SELECT '{"script_id":"s-' || CAST(c_custkey AS STRING) || '","name":"' || c_name || '","created_by":"admin"'
  || CASE WHEN c_custkey % 2 = 0 THEN ',"enabled":true' ELSE '' END || '}' AS payload
FROM $customer
"""

LANDED = {
    "clusters": CLUSTERS,
    "jobs": JOBS,
    "cluster_policies": POLICIES,
    "pipelines": PIPELINES,
    "submit_runs": RUNS,
    "table_list": TABLE_LIST,
    "table_types": TABLE_TYPES,
    "table_details": TABLE_DETAILS,
    "grants": GRANTS,
    "udf_list": UDF_LIST,
    "udf_info": UDF_INFO,
    "mounts": MOUNTS,
    "external_locations": EXTERNAL_LOCATIONS,
    "global_init_scripts": INIT_SCRIPTS,
}

# Inputs of single operators, not of the assessment.
OTHERS = {"schemas": SCHEMAS, "old_mounts": OLD_MOUNTS}

# The columns the landed inputs use, declared so that no file is opened to infer them.
TABLES = {
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "events": "event_id bigint, user_id bigint, event_type string",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "lineitem": "l_orderkey bigint, l_linenumber int",
}

# Submitted runs are taken as of this time; 30 days before it lies between the first
# and the last run at every scale factor, so the window always cuts.
AS_OF_MS = 1704067200000 + 60000 * 43700


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One landed input, read from the Parquet files under ``sf_dir``."""
    text = Template({**LANDED, **OTHERS}[name])
    for table in text.get_identifiers():
        df = spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")
        df.createOrReplaceTempView(f"landed_{table}")
    return spark.sql(text.substitute({t: f"landed_{t}" for t in TABLES}))


def landed_cte(*names: str) -> str:
    """``WITH`` list of landed inputs, each named ``fx_<name>``."""
    views = {t: t for t in TABLES}
    return ",\n".join(f"fx_{n} AS ({Template({**LANDED, **OTHERS}[n]).substitute(views).strip()})" for n in names)
