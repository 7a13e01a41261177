"""Types of the tables and of run events."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TAG = _struct(key=_S, value=_S, source=_S)
_FIELD = _struct(name=_S, type=_S, description=_S, fields=_S)  # deeper fields stay JSON
_TRANSFORMATION = _struct(type=_S, subtype=_S, masking=T.BooleanType())
_INPUT_FIELD = _struct(namespace=_S, name=_S, field=_S, transformations=T.ArrayType(_TRANSFORMATION))
_COLUMN_LINEAGE = _struct(
    fields=T.MapType(_S, _struct(inputFields=T.ArrayType(_INPUT_FIELD), transformationType=_S)),
    dataset=T.ArrayType(_INPUT_FIELD),
)
_STATISTICS = _struct(rowCount=T.DecimalType(20, 0), size=T.DecimalType(20, 0), fileCount=T.DecimalType(20, 0))
_DATASET_FACETS = _struct(
    schema=_struct(fields=T.ArrayType(_FIELD)),
    symlinks=_struct(identifiers=T.ArrayType(_struct(namespace=_S, name=_S, type=_S))),
    lifecycleStateChange=_struct(lifecycleStateChange=_S),
    tags=_struct(tags=T.ArrayType(_TAG)),
    columnLineage=_COLUMN_LINEAGE,
)
_DATASET = _struct(
    namespace=_S,
    name=_S,
    facets=_DATASET_FACETS,
    inputFacets=_struct(inputStatistics=_STATISTICS),
    outputFacets=_struct(outputStatistics=_STATISTICS),
)
_JOB_ID, _RUN_ID = _struct(namespace=_S, name=_S), _struct(runId=_S)

_DAG = _struct(dag_id=_S, owner=_S, tags=T.ArrayType(_S))
_DAG_RUN = _struct(run_id=_S, run_type=_S, data_interval_start=_TS)


def run_event(custom_prefix: str = "custom") -> T.StructType:
    """The type of one run event; fields that no operator reads are left out, and so ignored by the parser.

    Producers without an integration of their own may describe runs and operations in two facets named
    ``<custom_prefix>_run`` and ``<custom_prefix>_operation``.
    """
    return _struct(
        eventTime=_TS,
        eventType=_S,
        job=_struct(
            namespace=_S,
            name=_S,
            facets=_struct(
                jobType=_struct(processingType=_S, integration=_S, jobType=_S),
                sql=_struct(query=_S),
                tags=_struct(tags=T.ArrayType(_TAG)),
            ),
        ),
        run=_struct(
            runId=_S,
            facets=_struct(
                parent=_struct(job=_JOB_ID, run=_RUN_ID, root=_struct(job=_JOB_ID, run=_RUN_ID)),
                processing_engine=_struct(name=_S, version=_S, openlineageAdapterVersion=_S),
                nominalTime=_struct(nominalStartTime=_TS, nominalEndTime=_TS),
                tags=_struct(tags=T.ArrayType(_TAG)),
                spark_applicationDetails=_struct(applicationId=_S, userName=_S, uiWebUrl=_S, proxyUrl=_S, historyUrl=_S),
                spark_jobDetails=_struct(jobId=_I, jobDescription=_S, jobGroup=_S),
                airflow=_struct(
                    dag=_DAG,
                    dagRun=_DAG_RUN,
                    task=_struct(task_id=_S, operator_class=_S, task_group=_struct(group_id=_S)),
                    taskInstance=_struct(try_number=_I, map_index=_I, log_url=_S),
                ),
                airflowDagRun=_struct(dag=_DAG, dagRun=_DAG_RUN),
                dbt_run=_struct(invocation_id=_S),
                flink_job=_struct(jobId=_S),
                hive_query=_struct(queryId=_S, operationName=_S),
                hive_session=_struct(username=_S, clientIp=_S, sessionId=_S, creationTime=_TS),
                **{
                    f"{custom_prefix}_run": _struct(external_id=_S, attempt=_S, persistent_log_url=_S, running_log_url=_S, start_reason=_S, started_by_user=_S),
                    f"{custom_prefix}_operation": _struct(name=_S, description=_S, group=_S, position=_I),
                },
            ),
        ),
        inputs=T.ArrayType(_DATASET),
        outputs=T.ArrayType(_DATASET),
    )


LOCATION = "id bigint, type string, name string, external_id string"
DATASET = "id bigint, location_id bigint, name string"
JOB = "id bigint, location_id bigint, name string, type string"
RUN = "id {id}, created_at timestamp, job_id bigint, parent_run_id {id}, status int, external_id string, started_at timestamp, started_by_user_id bigint, start_reason string, ended_at timestamp"
OPERATION = "id {id}, created_at timestamp, run_id {id}, name string, status int, type string, position int, started_at timestamp, ended_at timestamp"
INPUT = "created_at timestamp, operation_id {id}, run_id {id}, job_id bigint, dataset_id bigint, schema_id bigint, num_bytes bigint, num_rows bigint, num_files bigint"
OUTPUT = INPUT + ", type int"
COLUMN_LINEAGE = "created_at timestamp, operation_id {id}, run_id {id}, job_id bigint, source_dataset_id bigint, target_dataset_id bigint, fingerprint string"
COLUMN_RELATION = "fingerprint string, source_column string, target_column string, type int"
