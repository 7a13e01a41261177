"""Run events to rows of entities: jobs, runs, operations, reads, writes, symlinks, column lineage and tags.

Every rule is a column expression over parsed events (``schema.run_event``), so a batch is one scan per entity and
Catalyst prunes what an entity does not read. Which integration sent an event decides the rules, by the first match.
Rows carry natural keys (location type and name, entity name); surrogate ids are given when they are stored. ``register``
adds the rules of further producers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import cut
from ..functions import flags, ids, text

SPARK, AIRFLOW_DAG, AIRFLOW_TASK, HIVE, FLINK, DBT, OTHER = "SPARK", "AIRFLOW_DAG", "AIRFLOW_TASK", "HIVE", "FLINK", "DBT", "OTHER"
#: Owners that stand for nobody.
NO_OWNER, NO_HIVE_USER = ("airflow", "***"), ("anonymous", "hive")
#: What a transformation's subtype says, without and with masking.
SUBTYPES = {k: flags.RELATION_TYPES[k] for k in ("IDENTITY", "TRANSFORMATION", "AGGREGATION", "FILTER", "JOIN", "GROUP_BY", "SORT", "WINDOW", "CONDITIONAL")}
MASKED = {"MASKED": 8, "TRANSFORMATION": 8, "AGGREGATION": 32}
ENDS = ("COMPLETE", "FAIL", "ABORT")


def run_facet(path: str) -> Column:
    return F.col(f"run.facets.{path}")


def job_facet(path: str) -> Column:
    return F.col(f"job.facets.{path}")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _is(*kinds: str) -> Column:
    return F.col("integration").isin(*kinds)


@dataclass(frozen=True)
class Integration:
    """The rules of a producer that a user adds. Every rule makes a column over an event; rules that are not given give null.

    ``match`` tells the producer's events, ``operation`` which of them tell of an operation, ``parental`` whether an operation
    belongs to the parent run that its event names. ``runs`` and ``operations`` make columns of those tables
    (external_id, user, attempt, persistent_log_url, running_log_url, start_reason; name, position, group,
    description); ``output_type`` makes the bit of what a write did (by the lifecycle and query rules where not given).
    """

    name: str
    match: Callable[[], Column]
    operation: Callable[[], Column] = field(default=lambda: F.lit(True))
    parental: bool = False
    runs: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    operations: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    output_type: Callable[[Column], Column] | None = None


_ADDED: dict[str, Integration] = {}
_RUNS = ("external_id", "user", "attempt", "persistent_log_url", "running_log_url", "start_reason")
_OPERATIONS = ("name", "position", "group", "description")


def register(rules: Integration) -> None:
    """Adds a producer, or replaces the one of that name. Those that were added are matched first, in the order of adding."""
    if rules.name in (SPARK, AIRFLOW_DAG, AIRFLOW_TASK, HIVE, FLINK, DBT, OTHER):
        raise ValueError(f"{rules.name} has its own rules")
    if unknown := {*rules.runs} - {*_RUNS} | {*rules.operations} - {*_OPERATIONS}:
        raise ValueError(f"no columns {sorted(unknown)}")
    _ADDED[rules.name] = rules


def unregister(name: str) -> None:
    _ADDED.pop(name, None)


def _by_added(value: Column, rule: Callable[[Integration], Column | None]) -> Column:
    """``value``, or what the rules of the event's added producer give; where these say nothing, null (or ``value`` for a rule of None)."""
    made = [(name, rule(r)) for name, r in _ADDED.items()]
    return reduce(lambda rest, x: rest if x[1] is None else F.when(_is(x[0]), x[1]).otherwise(rest), made, value)


def _ruled(value: Column, table: str, column: str) -> Column:
    return _by_added(value, lambda r: rules[column]() if column in (rules := getattr(r, table)) else F.lit(None))


def integration() -> Column:
    """Which rules an event follows."""
    return reduce(lambda rest, r: F.when(F.coalesce(r.match(), F.lit(False)), r.name).otherwise(rest), reversed(_ADDED.values()), _built_in())


def _built_in() -> Column:
    name, kind = job_facet("jobType.integration"), job_facet("jobType.jobType")
    return (
        F.when(name == "SPARK", SPARK)
        .when((name == "AIRFLOW") & (kind == "DAG"), AIRFLOW_DAG)
        .when((name == "AIRFLOW") & (kind == "TASK"), AIRFLOW_TASK)
        .when(F.col("job.namespace").startswith("hive://") | (name == "HIVE"), HIVE)
        .when(name == "FLINK", FLINK)
        .when(name == "DBT", DBT)
        .otherwise(OTHER)
    )


def is_operation() -> Column:
    """Whether an event tells of an operation inside a run, beside the run itself."""
    kind = F.coalesce(job_facet("jobType.jobType"), F.lit(""))
    touches = (F.coalesce(F.size("inputs"), F.lit(0)) > 0) | (F.coalesce(F.size("outputs"), F.lit(0)) > 0)
    return _by_added(
        F.when(_is(SPARK), kind != "APPLICATION")
        .when(_is(AIRFLOW_DAG), False)
        .when(_is(AIRFLOW_TASK, HIVE), True)
        .when(_is(FLINK), kind == "JOB")
        .when(_is(DBT), kind != "JOB")
        .otherwise(run_facet("custom_operation").isNotNull() | touches),
        lambda r: F.coalesce(r.operation(), F.lit(False)),
    )


def in_parent() -> Column:
    """Whether the operation of an event belongs to the parent run that it names."""
    custom = run_facet("parent").isNotNull() & run_facet("custom_operation").isNotNull() & run_facet("custom_run").isNull()
    return F.col("is_operation") & (_is(SPARK, DBT, *(name for name, r in _ADDED.items() if r.parental)) | (_is(OTHER) & custom))


def _hive_run_id() -> Column:
    return ids.incremental_uuid(run_facet("hive_session.creationTime"), run_facet("hive_session.sessionId"))


def classified(events: DataFrame) -> DataFrame:
    """Events with ``integration``, ``is_operation``, ``run_id`` (of the run that an operation belongs to) and ``own_id``.

    Events that have them stay as they are. Pass events that are stored: Spark would parse the JSON again for every
    field that an expression names.
    """
    if "own_id" in events.columns:
        return events
    out = events.withColumn("integration", integration()).withColumn("is_operation", is_operation())
    own = F.lower("run.runId")
    run = F.when(_is(HIVE), _hive_run_id()).when(in_parent(), F.lower(run_facet("parent.run.runId"))).otherwise(own)
    return out.withColumn("own_id", own).withColumn("run_id", run)


# jobs, runs, operations


def _job(namespace: Column, name: Column, kind: Column) -> Column:
    return text.let(text.job_location(namespace), lambda where: F.struct(where["type"].alias("location_type"), where["name"].alias("location_name"), where["addresses"].alias("addresses"), name.alias("name"), kind.alias("type")))


def own_job() -> Column:
    """The job of an event; a Hive query stands for the session that it ran in."""
    kind = text.job_type(job_facet("jobType.integration"), job_facet("jobType.jobType"))
    generated = F.col("job.name").startswith(F.concat(F.lower(run_facet("hive_query.operationName")), F.lit(".")))
    session = F.concat(run_facet("hive_session.username"), F.lit("@"), run_facet("hive_session.clientIp"))
    name = F.when(_is(HIVE) & F.coalesce(generated, F.lit(False)), session).otherwise(F.col("job.name"))
    return _job(F.col("job.namespace"), name, F.when(_is(HIVE), F.lit("HIVE_SESSION")).otherwise(kind))


def parent_job() -> Column:
    return _job(run_facet("parent.job.namespace"), run_facet("parent.job.name"), F.lit(None).cast("string"))


def _first(urls: Column) -> Column:
    return F.when(urls != "", F.split(urls, ",")[0])


def _version_at_least(version: Column, least: str) -> Column:
    """Compares dotted versions by their numbers."""
    parts = F.transform(F.split(F.regexp_extract(version, r"^(\d+(?:\.\d+)*)", 1), r"\."), lambda p: p.cast("int"))
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(0), 3)), 1, 3)
    return F.coalesce(padded >= F.array(*(F.lit(int(x)) for x in least.split("."))), F.lit(False))


def _quoted(value: Column) -> Column:
    """Percent-encoding that keeps slashes and writes spaces as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def _iso(instant: Column) -> Column:
    micros = F.unix_micros(instant) % 1_000_000
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def airflow_log_url() -> Column:
    """Where a DAG run or task attempt has its log, by the version of the scheduler; null unless the namespace is a web address."""
    base, version = F.col("job.namespace"), run_facet("processing_engine.version")
    dag, task = run_facet("airflowDagRun"), run_facet("airflow")

    def date(facet: Column) -> Column:
        return _quoted(_iso(facet["dagRun"]["data_interval_start"]))

    dag_url = (
        F.when(_version_at_least(version, "3.0.0"), F.concat(base, F.lit("/dags/"), dag["dag"]["dag_id"], F.lit("/runs/"), dag["dagRun"]["run_id"]))
        .when(_version_at_least(version, "2.3.0"), F.concat(base, F.lit("/dags/"), dag["dag"]["dag_id"], F.lit("/grid?dag_run_id="), _quoted(dag["dagRun"]["run_id"])))
        .otherwise(F.concat(base, F.lit("/graph?dag_id="), _quoted(dag["dag"]["dag_id"]), F.lit("&execution_date="), date(dag)))
    )
    index, attempt = task["taskInstance"]["map_index"], task["taskInstance"]["try_number"]
    mapped = F.when(index.isNotNull(), F.concat(F.lit("/mapped/"), index.cast("string"))).otherwise("")
    tried = F.when(attempt > 0, F.concat(F.lit("?try_number="), attempt.cast("string"))).otherwise("")
    dag_id, task_id, run_id = task["dag"]["dag_id"], task["task"]["task_id"], task["dagRun"]["run_id"]
    grid = F.concat(base, F.lit("/dags/"), dag_id, F.lit("/grid?tab=logs&dag_run_id="), _quoted(run_id), F.lit("&task_id="), _quoted(task_id), F.lit("&map_index="), F.coalesce(index, F.lit(-1)).cast("string"))
    task_url = (
        F.when(_version_at_least(version, "3.0.0"), F.concat(base, F.lit("/dags/"), dag_id, F.lit("/runs/"), run_id, F.lit("/tasks/"), task_id, mapped, tried))
        .when(_version_at_least(version, "2.9.1"), grid)
        .otherwise(F.concat(base, F.lit("/log?&dag_id="), _quoted(dag_id), F.lit("&task_id="), _quoted(task_id), F.lit("&execution_date="), date(task)))
    )
    web = base.startswith("http")
    given = task["taskInstance"]["log_url"]
    return F.when(_is(AIRFLOW_TASK) & (given != ""), given).when(web & _is(AIRFLOW_TASK) & task.isNotNull(), task_url).when(web & _is(AIRFLOW_DAG) & dag.isNotNull(), dag_url)


def _of_event(value: Column, own: Column) -> Column:
    return F.when(own, value)


def runs(events: DataFrame) -> DataFrame:
    """A row for each run that an event tells of: its own or its parent, and the parents of own runs (ids and jobs only)."""
    e = classified(events)
    kind, at = F.col("eventType"), F.col("eventTime")
    parental, hive = in_parent(), _is(HIVE)
    own = ~parental
    app, custom = run_facet("spark_applicationDetails"), run_facet("custom_run")
    dag = F.when(_is(AIRFLOW_TASK), run_facet("airflow.dagRun.run_type")).when(_is(AIRFLOW_DAG), run_facet("airflowDagRun.dagRun.run_type"))
    owner = F.when(_is(AIRFLOW_TASK), run_facet("airflow.dag.owner")).when(_is(AIRFLOW_DAG), run_facet("airflowDagRun.dag.owner"))
    flink = F.when(F.col("job.namespace").startswith("http"), F.regexp_replace("job.namespace", "/+$", ""))
    external = (
        F.when(_is(SPARK), app["applicationId"])
        .when(_is(AIRFLOW_DAG), run_facet("airflowDagRun.dagRun.run_id"))
        .when(_is(AIRFLOW_TASK), run_facet("airflow.dagRun.run_id"))
        .when(hive, run_facet("hive_session.sessionId"))
        .when(_is(FLINK), run_facet("flink_job.jobId"))
        .when(_is(DBT) & own, run_facet("dbt_run.invocation_id"))
        .when(_is(OTHER) & own, custom["external_id"])
    )
    user = (
        F.when(_is(SPARK), app["userName"])
        .when(_is(AIRFLOW_DAG, AIRFLOW_TASK) & ~owner.isin(*NO_OWNER), owner)
        .when(hive & ~run_facet("hive_session.username").isin(*NO_HIVE_USER), run_facet("hive_session.username"))
        .when(_is(OTHER) & own, custom["started_by_user"])
    )
    persistent = (
        F.when(_is(SPARK), _first(app["historyUrl"]))
        .when(_is(AIRFLOW_DAG, AIRFLOW_TASK), airflow_log_url())
        .when(_is(FLINK), F.concat(flink, F.lit("/#/job/completed/"), run_facet("flink_job.jobId")))
        .when(_is(OTHER) & own, custom["persistent_log_url"])
    )
    running = (
        F.when(_is(SPARK), F.coalesce(_first(app["proxyUrl"]), _first(app["uiWebUrl"])))
        .when(_is(FLINK), F.concat(flink, F.lit("/#/job/running/"), run_facet("flink_job.jobId")))
        .when(_is(OTHER) & own, custom["running_log_url"])
    )
    reason = F.when(dag == "manual", F.lit("MANUAL")).when(_is(AIRFLOW_DAG, AIRFLOW_TASK) & dag.isNotNull(), F.lit("AUTOMATIC")).when(_is(OTHER) & own, custom["start_reason"])
    planned, until = run_facet("nominalTime.nominalStartTime"), run_facet("nominalTime.nominalEndTime")
    plain = own & ~hive
    told = e.select(
        F.col("run_id").alias("id"),
        F.when(parental, parent_job()).otherwise(own_job()).alias("job"),
        F.when(own, F.lower(run_facet("parent.run.runId"))).alias("parent_run_id"),
        F.when(hive, 0).when(plain, flags.status_of_event(kind)).otherwise(-1).alias("status"),
        F.when(hive, run_facet("hive_session.creationTime")).when(plain & (kind == "START"), at).alias("started_at"),
        F.when(plain & kind.isin(*ENDS), at).alias("ended_at"),
        _ruled(external, "runs", "external_id").alias("external_id"),
        _ruled(F.when(_is(AIRFLOW_TASK), run_facet("airflow.taskInstance.try_number").cast("string")).when(_is(OTHER) & own, custom["attempt"]), "runs", "attempt").alias("attempt"),
        _ruled(persistent, "runs", "persistent_log_url").alias("persistent_log_url"),
        _ruled(running, "runs", "running_log_url").alias("running_log_url"),
        _ruled(reason, "runs", "start_reason").alias("start_reason"),
        _ruled(user, "runs", "user").alias("user"),
        F.when(plain, planned).alias("expected_start_at"),
        F.when(plain & ~planned.eqNullSafe(until), until).alias("expected_end_at"),
        at.alias("told_at"),
    )
    parents = e.where(own & run_facet("parent.run.runId").isNotNull()).select(F.lower(run_facet("parent.run.runId")).alias("id"), parent_job().alias("job"), F.lit(-1).alias("status"), at.alias("told_at"))
    return told.unionByName(parents, allowMissingColumns=True).where("id is not null")


def operation_name() -> Column:
    """What an operation is called. A Spark job name loses line breaks and the application's name before it."""
    lines = F.array_join(F.transform(F.split("job.name", r"\r\n|\r|\n"), lambda x: F.trim(x)), " ")
    prefix = F.concat(run_facet("parent.job.name"), F.lit("."))
    spark = F.when(F.trim(lines).startswith(prefix), F.substring(F.trim(lines), F.length(prefix) + 1, F.length(lines))).otherwise(F.trim(lines))
    return (
        F.when(_is(SPARK), spark)
        .when(_is(AIRFLOW_TASK), run_facet("airflow.task.task_id"))
        .when(_is(HIVE), run_facet("hive_query.queryId"))
        .otherwise(F.coalesce(run_facet("custom_operation.name"), F.col("job.name")))
    )


def sql_text() -> Column:
    """The query of an event without its common indentation and the white space around it; control characters are escaped."""
    query = job_facet("sql.query")
    lines = F.transform(F.split(query, "\n"), lambda x: F.when(x.rlike(r"^[ \t]*$"), F.lit("")).otherwise(x))
    indents = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.regexp_extract(x, r"^([ \t]*)", 1))
    least = F.coalesce(F.array_min(F.transform(indents, F.length)), F.lit(0))
    # the margin is what all indents share, not only as many characters
    margin = F.aggregate(indents, indents[0], lambda m, x: F.when(x.startswith(m), m).otherwise(F.lit("")))
    width = F.when(F.length(margin) <= least, F.length(margin)).otherwise(F.lit(0))
    plain = F.trim(F.array_join(F.transform(lines, lambda x: F.substring(x, width + 1, F.length(x))), "\n"), F.lit(" \n\t\r"))
    names = {chr(i): {9: "\\t", 13: "\\r"}.get(i, f"\\x{i:02x}") for i in (*range(10), *range(11, 32), 127)}
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), names.items(), plain)


def operations(events: DataFrame) -> DataFrame:
    """A row for each event of an operation."""
    e = classified(events).where("is_operation")
    kind, at, jobs = F.col("eventType"), F.col("eventTime"), run_facet("spark_jobDetails")
    custom = run_facet("custom_operation")
    return e.select(
        F.col("own_id").alias("id"),
        "run_id",
        ids.uuid_instant(F.col("own_id")).alias("created_at"),
        _by_added(operation_name(), lambda r: r.operations["name"]() if "name" in r.operations else None).alias("name"),
        F.coalesce(job_facet("jobType.processingType"), F.lit("BATCH")).alias("type"),
        flags.status_of_event(kind).alias("status"),
        F.when(kind == "START", at).alias("started_at"),
        F.when(kind.isin(*ENDS), at).alias("ended_at"),
        _ruled(F.when(_is(SPARK), jobs["jobId"]).when(_is(AIRFLOW_TASK), run_facet("airflow.taskInstance.map_index")).otherwise(custom["position"]), "operations", "position").alias("position"),
        _ruled(F.when(_is(SPARK), jobs["jobGroup"]).when(_is(AIRFLOW_TASK), run_facet("airflow.task.task_group.group_id")).when(_is(DBT), job_facet("jobType.jobType")).otherwise(custom["group"]), "operations", "group").alias("group"),
        _ruled(F.when(_is(SPARK), jobs["jobDescription"]).when(_is(AIRFLOW_TASK), run_facet("airflow.task.operator_class")).when(_is(HIVE), run_facet("hive_query.operationName")).otherwise(custom["description"]), "operations", "description").alias("description"),
        sql_text().alias("sql_query"),
        ids.static_uuid(sql_text()).alias("sql_fingerprint"),
        at.alias("told_at"),
    )


# datasets


def _name(name: Column) -> Column:
    return F.when(_is(SPARK), text.strip_partitions(name)).when(_is(DBT), F.replace(name, F.lit("None."), F.lit(""))).otherwise(name)


def _ref(namespace: Column, name: Column) -> Column:
    own = _name(name)
    return text.let(text.dataset_location(namespace), lambda where: F.struct(where["type"].alias("location_type"), where["name"].alias("location_name"), where["addresses"].alias("addresses"), own.alias("name")))


def _identifiers(d: Column) -> Column:
    """The symlinks of a dataset; those that a Flink job makes up for Kafka topics are left out."""
    links = F.coalesce(d["facets"]["symlinks"]["identifiers"], F.array().cast("array<struct<namespace:string,name:string,type:string>>"))
    return F.when(_is(FLINK), F.filter(links, lambda x: ~(x["namespace"].startswith("kafka://") & (x["type"] == "TABLE")))).otherwise(links)


def _table(d: Column) -> Column:
    """The table that stands for a path which Spark reads or writes: its first TABLE symlink."""
    return F.when(_is(SPARK), F.get(F.filter(_identifiers(d), lambda x: x["type"] == "TABLE"), F.lit(0)))


def dataset_of(d: Column) -> Column:
    """The dataset that stands for an input or output, as struct(location_type, location_name, addresses, name)."""
    own = F.struct(d["namespace"].alias("namespace"), d["name"].alias("name"), F.lit(None).cast("string").alias("type"))
    return text.let(F.coalesce(_table(d), own), lambda x: _ref(x["namespace"], x["name"]))


#: Levels of nested fields that are cleaned; what lies deeper stays as it was told.
NESTED = 6


def schema_of(d: Column) -> Column:
    """The fields of a dataset as JSON with sorted keys, empty types and descriptions left out, nested ones too; null without fields."""
    fields = d["facets"]["schema"]["fields"]

    def nested(raw: Column, levels: int) -> Column:
        """Fields that are kept as JSON text, cleaned; as they are where they are no list of fields."""
        inner = F.from_json(raw, "array<struct<name: string, type: string, description: string, fields: string>>")
        return F.coalesce(F.when(F.size(inner) > 0, listed(inner, levels)), raw)

    def listed(fs: Column, levels: int) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(fs, lambda f: one(f, levels)), ", "), F.lit("]"))

    def one(f: Column, levels: int) -> Column:
        described = F.trim(F.coalesce(f["description"], F.lit("")))
        parts = F.array(
            F.when(described != "", F.concat(F.lit('"description": '), F.to_json(F.array(described)))),
            F.when(f["fields"].isNotNull() & ~f["fields"].isin("[]", ""), F.concat(F.lit('"fields": '), nested(f["fields"], levels - 1) if levels else f["fields"])),
            F.concat(F.lit('"name": '), F.to_json(F.array(f["name"]))),
            F.when(f["type"] != "", F.concat(F.lit('"type": '), F.to_json(F.array(f["type"])))),
        )
        # to_json takes arrays only; the brackets about the one value go again
        bare = F.transform(F.array_compact(parts), lambda p: F.when(p.startswith('"fields"'), p).otherwise(F.regexp_replace(p, r'^("\w+": )\[(.*)\]$', "$1$2")))
        return F.concat(F.lit("{"), F.array_join(bare, ", "), F.lit("}"))

    return F.when(F.size(fields) > 0, listed(fields, NESTED))


def output_type(d: Column) -> Column:
    """What an operation did to an output: the lifecycle facet, else the query; Hive goes by the kind of query."""
    told = _lookup(flags.OUTPUT_TYPES, d["facets"]["lifecycleStateChange"]["lifecycleStateChange"])
    by_query = F.coalesce(told, text.output_type_of_sql(sql_text()))
    hive, kinds = run_facet("hive_query.operationName"), ("CREATE", "ALTER", "DROP", "TRUNCATE")
    of_hive = reduce(lambda rest, k: F.when(hive.startswith(k), flags.OUTPUT_TYPES[k]).otherwise(rest), reversed(kinds), F.lit(flags.OUTPUT_TYPES["APPEND"]))
    known = F.when(_is(HIVE), F.when(hive.isNull(), 0).otherwise(of_hive)).when(_is(FLINK, DBT), F.coalesce(by_query, F.lit(flags.OUTPUT_TYPES["APPEND"]))).otherwise(F.coalesce(by_query, F.lit(0)))
    return _by_added(known, lambda r: r.output_type(d) if r.output_type else None)


def _tick() -> Column:
    """The hour of the operation's run time in which the event fell. Ids without a time in them are anchored at the event."""
    return text.hourly_tick(F.col("eventTime"), F.coalesce(ids.uuid_instant(F.col("own_id")), F.col("eventTime")))


def io(events: DataFrame, side: str) -> DataFrame:
    """A row for each dataset (``side`` is inputs or outputs) that an operation's event names."""
    e = classified(events).where("is_operation")
    d = F.col("d")
    facet = d["inputFacets"]["inputStatistics"] if side == "inputs" else d["outputFacets"]["outputStatistics"]
    counter = (lambda c: flags.count_or_null(facet[c])) if side == "inputs" else (lambda c: facet[c].cast("long"))
    typed = [output_type(d).alias("type")] if side == "outputs" else []
    schema = schema_of(d)
    return e.withColumn("d", F.explode(side)).select(
        _tick().alias("created_at"),
        F.col("own_id").alias("operation_id"),
        "run_id",
        F.col("eventTime").alias("told_at"),
        dataset_of(d).alias("dataset"),
        schema.alias("schema"),
        ids.static_uuid(schema).alias("schema_digest"),
        counter("size").alias("num_bytes"),
        counter("rowCount").alias("num_rows"),
        counter("fileCount").alias("num_files"),
        *typed,
    )


def _all_datasets(events: DataFrame) -> DataFrame:
    e = classified(events).where("is_operation")
    sides = e.select("integration", F.explode(F.array("inputs", "outputs")).alias("xs")).select("integration", F.explode("xs").alias("x"))
    return sides.select("integration", F.struct("x.namespace", "x.name", "x.facets").alias("d"))


def mentions(events: DataFrame) -> DataFrame:
    """Datasets as operations' events name them (``integration``, ``d``), each way of naming once: the rules for names are long, and datasets far fewer than their reads and writes."""
    d = F.col("d")
    links = F.struct(F.struct(d["facets"]["symlinks"]["identifiers"].alias("identifiers")).alias("symlinks"))
    return _all_datasets(events).select("integration", F.struct("d.namespace", "d.name", links.alias("facets")).alias("d")).distinct()


def symlinks(events: DataFrame) -> DataFrame:
    """Two rows for each symlink, one in either direction: METASTORE towards a table, WAREHOUSE towards a path."""
    return _links(mentions(events))


def _links(named: DataFrame) -> DataFrame:
    d = F.col("d")
    table = _table(d)
    from_path = F.struct(_ref(d["namespace"], d["name"]).alias("a"), _ref(table["namespace"], table["name"]).alias("b"), F.lit(True).alias("table"))
    each = F.transform(_identifiers(d), lambda x: F.struct(_ref(d["namespace"], d["name"]).alias("a"), _ref(x["namespace"], x["name"]).alias("b"), (x["type"] == "TABLE").alias("table")))
    # of a plain explode Spark makes a filter on its size, and puts that with all its rules below the fold of mentions
    pairs = named.select(F.when(table.isNotNull(), F.array(from_path)).otherwise(each).alias("ps")).select(F.explode_outer("ps").alias("p")).where("p is not null").select("p.*").distinct()
    forth = pairs.select(F.col("a").alias("from_dataset"), F.col("b").alias("to_dataset"), F.when(F.col("table"), "METASTORE").otherwise("WAREHOUSE").alias("type"))
    back = pairs.select(F.col("b").alias("from_dataset"), F.col("a").alias("to_dataset"), F.when(F.col("table"), "WAREHOUSE").otherwise("METASTORE").alias("type"))
    return forth.unionByName(back).distinct()


def dataset_tags(events: DataFrame) -> DataFrame:
    """(dataset, tag, value): tags that events put on datasets."""
    d = F.col("d")
    tagged = _all_datasets(events).select(dataset_of(d).alias("dataset"), d["facets"]["tags"]["tags"].alias("ts")).select("dataset", F.explode("ts").alias("t"))
    return tagged.select("dataset", F.col("t.key").alias("tag"), F.col("t.value").alias("value")).distinct()


def job_tags(events: DataFrame) -> DataFrame:
    """(job, tag, value): versions of engine, adapter and client, tags of the run and tags of the job; all go to the job of the run."""
    e = classified(events)
    kv = "struct<key:string,value:string>"
    none = F.array().cast(f"array<{kv}>")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value")).cast(kv)
    engine = run_facet("processing_engine")
    versions = F.array(
        F.when(engine.isNotNull(), pair(F.concat(F.lower(engine["name"]), F.lit(".version")), engine["version"])),
        F.when(engine["openlineageAdapterVersion"] != "", pair(F.lit("openlineage_adapter.version"), engine["openlineageAdapterVersion"])),
    )

    def split(t: Column) -> Column:
        parsed = text.tag_of(t)
        return pair(parsed["key"], parsed["value"])

    def of_run(t: Column) -> Column:
        client = t["key"] == "openlineage_client_version"
        return F.when(client, pair(F.lit("openlineage_client.version"), t["value"])).when(_is(DBT) & (t["value"] == "true") & t["key"].contains(":"), split(t["key"])).otherwise(pair(t["key"], t["value"]))

    def of_job(t: Column) -> Column:
        same = _is(AIRFLOW_DAG, AIRFLOW_TASK) & (t["key"] == t["value"])
        return F.when(~same, pair(t["key"], t["value"])).when(t["key"].contains(":"), split(t["key"]))

    run_tags = F.coalesce(F.transform(run_facet("tags.tags"), of_run), none)
    raw = F.when(run_facet("tags").isNull(), F.when(_is(AIRFLOW_DAG), run_facet("airflowDagRun.dag.tags")).when(_is(AIRFLOW_TASK), run_facet("airflow.dag.tags")))
    dag_tags = F.coalesce(F.transform(F.filter(raw, lambda t: t.contains(":")), split), none)
    tags_of_job = F.coalesce(F.transform(job_facet("tags.tags"), of_job), none)
    found = F.when(in_parent() & _is(DBT), none).otherwise(F.concat(versions, run_tags, dag_tags, tags_of_job))
    job = F.when(in_parent(), parent_job()).otherwise(own_job()).dropFields("type", "addresses")
    tagged = e.select(job.alias("job"), F.array_compact(found).alias("ts")).select("job", F.explode("ts").alias("t")).where("t.key is not null")
    return tagged.select("job", F.col("t.key").alias("tag"), F.col("t.value").alias("value")).distinct()


# column lineage


def relation_type(transformation: Column) -> Column:
    """The bit of a transformation; unknown subtypes give UNKNOWN."""
    masked = F.coalesce(transformation["masking"], F.lit(False))
    return F.coalesce(F.when(masked, _lookup(MASKED, transformation["subtype"])).otherwise(_lookup(SUBTYPES, transformation["subtype"])), F.lit(1))


def column_relations(events: DataFrame) -> DataFrame:
    """(created_at, operation_id, run_id, source, target, source_column, target_column, type): one row per relation, types combined.

    A transformation that is not DIRECT concerns the whole target. References to a path of the same event that a
    table stands for are to the table.
    """
    e = classified(events).where("is_operation")
    stand_in = F.map_from_entries(
        F.array_distinct(
            F.filter(
                F.transform(F.concat(*(F.transform(F.coalesce(F.col(c), F.array()), lambda d: F.struct(F.concat_ws("\n", d["namespace"], d["name"]).alias("k"), _table(d).alias("t"))) for c in ("inputs", "outputs"))), lambda x: x),
                lambda x: x["t"].isNotNull(),
            )
        )
    )
    e = e.withColumn("stand_in", stand_in).withColumn("d", F.explode("outputs")).where("d.facets.columnLineage is not null")
    base = e.select("stand_in", "integration", _tick().alias("created_at"), F.col("own_id").alias("operation_id"), "run_id", dataset_of(F.col("d")).alias("target"), F.col("d.facets.columnLineage").alias("c"))
    kinds = "array<struct<type:string,subtype:string,masking:boolean>>"

    by_column = base.select("*", F.explode("c.fields").alias("column", "f")).select("*", F.explode("f.inputFields").alias("i"))
    old = F.coalesce(F.col("f.transformationType"), F.lit(""))
    legacy = F.array(F.struct(F.when(old == "INDIRECT", "INDIRECT").otherwise("DIRECT").alias("type"), old.alias("subtype"), F.lower(old).contains("mask").alias("masking"))).cast(kinds)
    whole = base.select("*", F.lit(None).cast("string").alias("column"), F.explode("c.dataset").alias("i"))
    indirect = F.array(F.struct(F.lit("INDIRECT").alias("type"), F.lit(None).cast("string").alias("subtype"), F.lit(False).alias("masking"))).cast(kinds)

    def rows(df: DataFrame, default: Column, direct: bool) -> DataFrame:
        known = F.when(F.size("i.transformations") > 0, F.col("i.transformations").cast(kinds)).otherwise(default)
        out = df.withColumn("ts", known).select("*", F.explode("ts").alias("t"))
        table = F.element_at("stand_in", F.concat_ws("\n", "i.namespace", "i.name"))
        source = F.when(table.isNotNull(), _ref(table["namespace"], table["name"])).otherwise(_ref(F.col("i.namespace"), F.col("i.name")))
        target = F.when(F.col("t.type") == "DIRECT", F.col("column")) if direct else F.lit(None).cast("string")
        return out.select("created_at", "operation_id", "run_id", source.alias("source"), "target", F.col("i.field").alias("source_column"), target.alias("target_column"), relation_type(F.col("t")).alias("type"))

    both = rows(by_column, legacy, True).unionByName(rows(whole, indirect, False))
    return both.groupBy("created_at", "operation_id", "run_id", "source", "target", "source_column", "target_column").agg(F.bit_or("type").alias("type"))


def fingerprinted(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(column lineage by operation and dataset pair with a fingerprint of its relations, distinct relations by fingerprint).

    The fingerprint is the name-based UUID of the sorted relations, so operations that do the same share one set.
    """
    item = F.struct("source_column", F.coalesce("target_column", F.lit("")).alias("target_column"), "type")
    sets = relations.groupBy("created_at", "operation_id", "run_id", "source", "target").agg(F.sort_array(F.collect_set(item)).alias("items"))
    words = F.transform("items", lambda x: F.concat_ws(".", x["source_column"], x["target_column"], x["type"].cast("string")))
    sets = sets.withColumn("fingerprint", ids.static_uuid(F.array_join(words, ",")))
    distinct = sets.select("fingerprint", F.explode("items").alias("x")).distinct()
    return sets.drop("items"), distinct.select("fingerprint", "x.source_column", F.nullif("x.target_column", F.lit("")).alias("target_column"), "x.type")


# merged entities of a batch


def _latest(column: str) -> Column:
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("told_at"))).alias(column)


def merged_runs(events: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per run: the largest status, every other field as it was last told. ``rows`` are those of ``runs`` where they are stored."""
    rows = runs(events) if rows is None else rows
    job = F.max_by("job", F.struct(F.col("job.name") != "unknown", F.col("job.type").isNotNull(), "told_at")).alias("job")  # "unknown" gives way to any name
    rest = [c for c in rows.columns if c not in ("id", "job", "status", "told_at")]
    return rows.groupBy("id").agg(job, F.max("status").alias("status"), *map(_latest, rest)).withColumn("created_at", ids.uuid_instant(F.col("id")))


def merged_operations(events: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per operation, like ``merged_runs``; a position of 0 does not replace another."""
    rows = operations(events) if rows is None else rows
    rest = [c for c in rows.columns if c not in ("id", "run_id", "created_at", "status", "position", "told_at")]
    place = F.coalesce(F.max_by(F.when(F.col("position") != 0, F.col("position")), F.when(F.coalesce("position", F.lit(0)) != 0, F.col("told_at"))), F.max("position")).alias("position")
    return rows.groupBy("id", "run_id", "created_at").agg(F.max("status").alias("status"), place, *map(_latest, rest))


def merged_io(events: DataFrame, side: str) -> DataFrame:
    """One row per operation, dataset and hour: largest counters but 0, types combined, the schema that was told first.

    Of schemas told at one time the least digest stays, so the order of arrival doesn't matter.
    """
    return merged_rows(io(events, side), side)


def merged_rows(rows: DataFrame, side: str) -> DataFrame:
    keys = ["created_at", "operation_id", "run_id", "dataset"]
    typed = [F.bit_or("type").alias("type")] if side == "outputs" else []
    schema = F.min_by("schema_digest", F.when(F.col("schema_digest").isNotNull(), F.struct("told_at", "schema_digest"))).alias("schema_digest")
    return rows.groupBy(*keys).agg(schema, *(F.max(F.when(F.col(c) != 0, F.col(c))).alias(c) for c in ("num_bytes", "num_rows", "num_files")), *typed)


KEY = ("location_type", "location_name")


def dataset_refs(ins: DataFrame, outs: DataFrame, links: DataFrame) -> DataFrame:
    """Every mention of a dataset in reads, writes and symlinks."""
    return reduce(DataFrame.unionByName, (df.select(f"{c}.*") for df, c in ((ins, "dataset"), (outs, "dataset"), (links, "from_dataset"), (links, "to_dataset"))))


def datasets(ins: DataFrame, outs: DataFrame, links: DataFrame) -> DataFrame:
    """One row per dataset; names differ by more than case."""
    return _by_name(dataset_refs(ins, outs, links))


def _by_name(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY, F.lower("name").alias("_key")).agg(F.min("name").alias("name")).drop("_key")


def named_datasets(events: DataFrame) -> DataFrame:
    """``datasets`` of events whose reads and writes are not asked for: the rules run over ``mentions`` alone."""
    named = cut(mentions(events))
    links = _links(named)
    refs = (named.select(dataset_of(F.col("d")).alias("x")), links.select(F.col("from_dataset").alias("x")), links.select(F.col("to_dataset").alias("x")))
    return _by_name(reduce(DataFrame.union, refs).select("x.*"))


def jobs(all_runs: DataFrame) -> DataFrame:
    """One row per job of the runs; a known type wins over none."""
    return all_runs.select("job.*").groupBy(*KEY, F.lower("name").alias("_key")).agg(F.min("name").alias("name"), F.max("type").alias("type")).drop("_key")


def entities(events: DataFrame) -> dict[str, DataFrame]:
    """All tables of a batch of events, in the order in which they refer to each other.

    The rules are long expressions, so the rows that they make of a batch are stored once, side by side; what is merged
    from them has short plans.
    """
    events = cut(classified(events))
    rules = (runs, operations, lambda e: io(e, "inputs"), lambda e: io(e, "outputs"), symlinks, column_relations, job_tags, dataset_tags)
    with ThreadPoolExecutor(len(rules)) as pool:
        told = pool.map(inheritable_thread_target(events.sparkSession)(lambda rule: cut(rule(events))), rules)
        run_rows, operation_rows, in_rows, out_rows, links, column_rows, tags_of_jobs, tags_of_datasets = told
    all_runs, ins, outs = cut(merged_runs(events, run_rows)), cut(merged_rows(in_rows, "inputs")), cut(merged_rows(out_rows, "outputs"))
    places = dataset_refs(ins, outs, links).select(*KEY, "addresses").unionByName(all_runs.select("job.*").select(*KEY, "addresses")).where("location_name is not null")
    lineage, relations = fingerprinted(column_rows)
    schemas = in_rows.select("schema_digest", "schema").union(out_rows.select("schema_digest", "schema")).where("schema is not null").distinct()
    ops = merged_operations(events, operation_rows)
    return {
        "location": places.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_set("addresses"))).alias("addresses")),
        "dataset": datasets(ins, outs, links),
        "dataset_symlink": links,
        "job": jobs(all_runs),
        "user": all_runs.where("user is not null").groupBy(F.lower("user").alias("_key")).agg(F.min("user").alias("name")).drop("_key"),
        "sql_query": ops.where("sql_query is not null").select(F.col("sql_fingerprint").alias("fingerprint"), F.col("sql_query").alias("query")).distinct(),
        "schema": schemas,
        "run": all_runs,
        "operation": ops.drop("sql_query"),
        "input": ins,
        "output": outs,
        "dataset_column_relation": relations,
        "column_lineage": lineage,
        "job_tag_value": tags_of_jobs,
        "dataset_tag_value": tags_of_datasets,
    }
