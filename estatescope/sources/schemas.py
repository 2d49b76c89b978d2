"""Declared schemas: what is landed, and what each inventory holds."""

from __future__ import annotations


def fields_of(ddl: str) -> dict[str, str]:
    """Name and type of each field of a declared schema, in order."""
    fields, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(ddl[at:i].split(maxsplit=1))
            at = i + 1
    return dict(fields)


# Field names and types of the landed records.
RECORDS = {
    "clusters": (
        "cluster_id string, spark_version string, data_security_mode string, policy_id string"
    ),
    "cluster_policies": "policy_id string, name string, definition string",
    "jobs": (
        "job_id bigint, creator_user_name string, "
        "settings struct<name: string, "
        "job_clusters: array<struct<new_cluster: struct<spark_version: string>>>, "
        "tasks: array<struct<task_key: string, existing_cluster_id: string, "
        "job_cluster_key: string>>>"
    ),
    "pipelines": (
        "pipeline_id string, name string, creator_user_name string, "
        "spec struct<name: string, target: string, catalog: string, "
        "clusters: array<struct<label: string, node_type_id: string, "
        "custom_tags: map<string, string>>>>"
    ),
    "submit_runs": (
        "run_id bigint, run_name string, creator_user_name string, run_type string, "
        "start_time bigint, state struct<life_cycle_state: string, result_state: string>"
    ),
    "external_locations": (
        "name string, url string, credential_name string, owner string, read_only boolean"
    ),
    "global_init_scripts": "script_id string, name string, created_by string, enabled boolean",
}

# Field names and types of the landed metadata row sets.
METADATA = {
    "table_list": "catalog_schema string, table_name string",
    "table_types": (
        "table_catalog string, table_schema string, table_name string, table_type string"
    ),
    "table_details": (
        "catalog_schema string, table_name string, format string, location string, "
        "size_in_bytes bigint, partition_columns string, error string"
    ),
    "udf_list": "schema_name string, function_name string",
    "udf_info": (
        "schema_name string, function_name string, ordinal int, "
        "info_name string, info_value string, error string"
    ),
    "grants": "database_name string, object_type string, payload string",
    "mounts": "mount_point string, source string",
}

# Field names and types of the inventory tables.
INVENTORIES = {
    "clusters": "cluster_id string, spark_version string, access_mode string, policy_id string",
    "cluster_policies": "policy_id string, policy_name string, policy_spark_version string",
    "jobs": (
        "job_id bigint, job_name string, creator string, "
        "dbr_versions array<string>, task_clusters string"
    ),
    "pipelines": (
        "pipeline_id string, name string, creator_user_name string, "
        "target string, catalog string, clusters string"
    ),
    "submit_runs": (
        "run_id bigint, run_name string, creator_user_name string, start_time bigint, "
        "state_life_cycle_state string, state_result_state string"
    ),
    "tables": (
        "catalog_schema string, table string, table_type string, format string, "
        "location string, size bigint, is_delta boolean, partition_columns string, error string"
    ),
    "udfs": (
        "schema string, function_name string, input_types string, return_type string, "
        "deterministic string, body string, error string"
    ),
    "grants": (
        "database string, object_type string, object_name string, "
        "principal string, action_type string"
    ),
    "mounts": "mountPoint string, source string",
    "external_locations": (
        "name string, url string, credential_name string, owner string, read_only boolean"
    ),
    "global_init_scripts": (
        "script_id string, script_name string, created_by string, enabled boolean"
    ),
}
