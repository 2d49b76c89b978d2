"""Inventories of objects that land as JSON records: one flat row per object.

Every operator is a narrow projection: one parse per record, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatescope.functions.text import as_json, is_json
from estatescope.settings import SUBMIT_RUN_LOOKBACK_DAYS
from estatescope.sources.landed import parsed

# The kind of run that is inventoried; milliseconds of a day.
SUBMIT_RUN = "SUBMIT_RUN"
DAY_MS = 86_400_000

# The column of a kept list of a job's clusters, for rules that read a stored inventory.
TASK_CLUSTER_IDS = "task_cluster_ids"


def _records(raw: DataFrame, kind: str) -> DataFrame:
    """Landed records as one struct column ``r``: typed columns, or a JSON ``payload``.

    A payload that cannot be read is no object and gives no row.
    """
    typed = parsed(raw, kind) if "payload" in raw.columns else raw
    return typed.select(F.struct("*").alias("r"))


def _distinct_texts(values: Column) -> Column:
    """Non-empty texts of a list, each once, in order of first appearance."""
    unwanted = F.array(F.lit(None).cast("string"), F.lit(""))
    return F.coalesce(F.array_except(values, unwanted), F.array().cast("array<string>"))


def clusters_inventory(raw: DataFrame) -> DataFrame:
    return _records(raw, "clusters").select(
        "r.cluster_id",
        "r.spark_version",
        F.nullif(F.col("r.data_security_mode"), F.lit("")).alias("access_mode"),
        "r.policy_id",
    )


def cluster_policies_inventory(raw: DataFrame) -> DataFrame:
    """The pinned version is null for a bad definition or one without that key."""
    definition = F.col("r.definition")
    pinned = F.when(is_json(definition), F.get_json_object(definition, "$.spark_version.value"))
    return _records(raw, "cluster_policies").select(
        "r.policy_id",
        F.col("r.name").alias("policy_name"),
        pinned.alias("policy_spark_version"),
    )


def jobs_inventory(raw: DataFrame, keep_tasks: bool = False) -> DataFrame:
    """Versions keep their first appearance; the task list becomes JSON text.

    With ``keep_tasks`` the typed list stays too, as ``tasks``: rules that follow in
    the same plan then need not parse the text again.
    """
    tasks = F.col("r.settings.tasks")
    jobs = _records(raw, "jobs").select(
        "r.job_id",
        F.col("r.settings.name").alias("job_name"),
        F.col("r.creator_user_name").alias("creator"),
        _distinct_texts(F.col("r.settings.job_clusters.new_cluster.spark_version")).alias(
            "dbr_versions"
        ),
        F.coalesce(as_json(tasks), F.lit("[]")).alias("task_clusters"),
        tasks.alias("tasks"),
    )
    return jobs if keep_tasks else jobs.drop("tasks")


def task_cluster_ids(tasks: Column) -> Column:
    """Existing clusters of a list of tasks, each once in task order; empty if there are none."""
    ids = F.array_except(tasks["existing_cluster_id"], F.array(F.lit(None).cast("string")))
    return F.coalesce(ids, F.array().cast("array<string>"))


def jobs_with_task_clusters(raw: DataFrame) -> DataFrame:
    """The inventory of jobs with the clusters of each, for a store: rules that read them there
    need not parse the task list's text again."""
    jobs = jobs_inventory(raw, keep_tasks=True)
    return jobs.withColumn(TASK_CLUSTER_IDS, task_cluster_ids(F.col("tasks"))).drop("tasks")


def pipelines_inventory(raw: DataFrame) -> DataFrame:
    return _records(raw, "pipelines").select(
        "r.pipeline_id",
        F.coalesce("r.spec.name", "r.name").alias("name"),
        "r.creator_user_name",
        "r.spec.target",
        "r.spec.catalog",
        F.coalesce(as_json(F.col("r.spec.clusters")), F.lit("[]")).alias("clusters"),
    )


def possible_submit_runs(raw: DataFrame) -> DataFrame:
    """Payloads whose text can be of that run type: it holds the name, or an escape that can
    stand for a letter of it. The others need no parser."""
    text = F.col("payload")
    return raw.where(text.contains(SUBMIT_RUN) | text.contains("\\u"))


def submit_runs_inventory(
    raw: DataFrame, as_of_ms: int, lookback_days: int = SUBMIT_RUN_LOOKBACK_DAYS
) -> DataFrame:
    """Submitted runs that started in the ``lookback_days`` before ``as_of_ms``."""
    earliest = as_of_ms - lookback_days * DAY_MS
    if "payload" in raw.columns:
        raw = possible_submit_runs(raw)
    runs = _records(raw, "submit_runs").select("r.*")
    return runs.where((F.col("run_type") == SUBMIT_RUN) & (F.col("start_time") >= earliest)).select(
        "run_id",
        "run_name",
        "creator_user_name",
        "start_time",
        F.col("state.life_cycle_state").alias("state_life_cycle_state"),
        F.col("state.result_state").alias("state_result_state"),
    )


def external_locations_inventory(raw: DataFrame) -> DataFrame:
    return _records(raw, "external_locations").select(
        "r.name",
        "r.url",
        "r.credential_name",
        "r.owner",
        F.coalesce("r.read_only", F.lit(False)).alias("read_only"),
    )


def init_scripts_inventory(raw: DataFrame) -> DataFrame:
    return _records(raw, "global_init_scripts").select(
        "r.script_id",
        F.col("r.name").alias("script_name"),
        "r.created_by",
        F.coalesce("r.enabled", F.lit(False)).alias("enabled"),
    )
