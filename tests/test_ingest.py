"""Run events of every integration, in order and reversed, through extraction, stream and store."""

import datetime as dt
import json
import uuid

import pytest

from spoorline.operators import extract
from spoorline.streaming import ingest
from spoorline.streaming.store import Store



def made_id(n, at="2024-03-11T14:20:31.250"):
    """A UUIDv7 of an instant with ``n`` in its last bits."""
    millis = int(dt.datetime.fromisoformat(at + "+00:00").timestamp() * 1000)
    return str(uuid.UUID(int=millis << 80 | 7 << 76 | 2 << 62 | n))


APP, SQL, DAG, TASK, FLINK, DBT, MODEL, HIVE, OTHER, INNER = map(made_id, range(101, 111))


def event(kind, run, name, namespace="local://host", at="2024-03-11T14:21:07.125Z", job=None, facets=None, inputs=(), outputs=()):
    return {"eventTime": at, "eventType": kind, "job": {"namespace": namespace, "name": name, "facets": job or {}}, "run": {"runId": run, "facets": facets or {}}, "inputs": list(inputs), "outputs": list(outputs), "producer": "x"}


def job_type(integration, kind, processing="BATCH", **more):
    return {"jobType": {"processingType": processing, "integration": integration, "jobType": kind}, **more}


def parent(run, name, namespace="local://host"):
    return {"parent": {"run": {"runId": run}, "job": {"namespace": namespace, "name": name}}}


def events():
    path = {
        "namespace": "hdfs://nn:9820",
        "name": "/data/src/day=1",
        "facets": {"schema": {"fields": [{"name": "id", "type": "int", "description": " "}, {"name": "s", "type": ""}]}, "symlinks": {"identifiers": [{"namespace": "hive://meta:9083", "name": "db.src", "type": "TABLE"}]}},
        "inputFacets": {"inputStatistics": {"rowCount": 9223372036854775807, "size": 10}},
    }
    lineage = {
        "fields": {
            "a": {"inputFields": [{"namespace": "hdfs://nn:9820", "name": "/data/src/day=1", "field": "id", "transformations": [{"type": "DIRECT", "subtype": "IDENTITY"}, {"type": "INDIRECT", "subtype": "JOIN"}]}]},
            "b": {"inputFields": [{"namespace": "hdfs://nn:9820", "name": "/data/src/day=1", "field": "s"}], "transformationType": "MASKED"},
        },
        "dataset": [{"namespace": "hdfs://nn:9820", "name": "/data/src/day=1", "field": "id", "transformations": [{"type": "INDIRECT", "subtype": "FILTER"}]}],
    }
    click = {"namespace": "clickhouse://ch:8123", "name": "db.out", "facets": {"columnLineage": lineage, "lifecycleStateChange": {"lifecycleStateChange": "OVERWRITE"}}}
    spark = {"processing_engine": {"name": "Spark", "version": "3.5.1", "openlineageAdapterVersion": "1.19"}}
    app = {**spark, "spark_applicationDetails": {"applicationId": "app_1", "userName": "me", "uiWebUrl": "http://ui:4040", "historyUrl": "http://h/1,http://h/2"}}
    dag = {"dag": {"dag_id": "my dag", "owner": "airflow", "tags": ["env:prod", "plain"]}, "dagRun": {"run_id": "manual__1+0", "run_type": "manual", "data_interval_start": "2024-03-11T14:04:12Z"}}
    task = {**dag, "task": {"task_id": "t1", "operator_class": "Op", "task_group": {"group_id": "g"}}, "taskInstance": {"try_number": 2}}
    return [
        event("START", APP, "app", job=job_type("SPARK", "APPLICATION", "NONE"), facets=app),
        event("START", SQL, "app.insert\n  x", at="2024-03-11T14:21:09Z", job=job_type("SPARK", "SQL_JOB"), facets={**spark, **parent(APP, "app")}, inputs=[path], outputs=[click]),
        event("COMPLETE", SQL, "app.insert\n  x", at="2024-03-11T15:55:00Z", job=job_type("SPARK", "SQL_JOB"), facets={**spark, **parent(APP, "app"), "spark_jobDetails": {"jobId": 3, "jobDescription": "what"}}, inputs=[path], outputs=[{**click, "outputFacets": {"outputStatistics": {"rowCount": 7, "size": 0}}}]),
        event("COMPLETE", APP, "app", at="2024-03-11T16:10:00Z", job=job_type("SPARK", "APPLICATION", "NONE")),
        event("START", DAG, "my dag", "http://air:8081", job=job_type("AIRFLOW", "DAG"), facets={"airflowDagRun": dag, "processing_engine": {"name": "Airflow", "version": "2.10.5"}, "nominalTime": {"nominalStartTime": "2024-03-11T14:00:00Z", "nominalEndTime": "2024-03-11T14:00:00Z"}}),
        event("START", TASK, "my dag.t1", "http://air:8081", job=job_type("AIRFLOW", "TASK"), facets={"airflow": task, **parent(DAG, "my dag", "http://air:8081"), "processing_engine": {"name": "Airflow", "version": "3.0.1"}}),
        event("FAIL", TASK, "my dag.t1", "http://air:8081", at="2024-03-11T17:00:00Z", job=job_type("AIRFLOW", "TASK"), facets=parent(DAG, "my dag", "http://air:8081")),
        event("RUNNING", FLINK, "kafka job", "http://flink:8081/", job=job_type("FLINK", "JOB", "STREAMING"), facets={"flink_job": {"jobId": "f1"}}, inputs=[{"namespace": "kafka://k1:9092,k2:9092", "name": "in", "facets": {"symlinks": {"identifiers": [{"namespace": "kafka://k1:9092", "name": "fake", "type": "TABLE"}]}}}], outputs=[{"namespace": "kafka://k1:9092", "name": "out"}]),
        event("START", DBT, "dbt-run", job=job_type("DBT", "JOB"), facets={"dbt_run": {"invocation_id": "inv"}, "tags": {"tags": [{"key": "team:data", "value": "true"}, {"key": "openlineage_client_version", "value": "1.2"}]}}),
        event("COMPLETE", MODEL, "schema.model", job=job_type("DBT", "MODEL", sql={"query": "  select 1\n  from x"}), facets={"dbt_run": {"invocation_id": "inv"}, **parent(DBT, "dbt-run")}, outputs=[{"namespace": "spark://th:10000", "name": "None.schema.model"}]),
        event("COMPLETE", HIVE, "createtable_as_select.db.t", "hive://hs:10000", job=job_type("HIVE", "QUERY", sql={"query": "create table t as select 1"}), facets={"hive_query": {"queryId": "q1", "operationName": "CREATETABLE_AS_SELECT"}, "hive_session": {"username": "me", "clientIp": "1.2.3.4", "sessionId": "s1", "creationTime": "2024-03-11T14:00:00.5Z"}}, outputs=[{"namespace": "hive://meta:9083", "name": "db.t"}]),
        event("OTHER", OTHER, "thing", job={}, facets={"mine_run": {"external_id": "e1", "started_by_user": "You"}}),
        event("START", INNER, "thing.step", job={}, facets={**parent(OTHER, "thing"), "mine_operation": {"name": "step", "position": 4}}),
    ]


def parsed(spark, rows):
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return ingest.parse_events(raw, custom_prefix="mine")


@pytest.fixture(scope="module", params=[False, True], ids=["in order", "reversed"])
def tables(spark, request):
    rows = events()[::-1] if request.param else events()
    valid, malformed = parsed(spark, rows)
    assert malformed.count() == 0 and valid.count() == len(rows)
    return {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in extract.entities(valid).items()}


def test_runs(tables):
    runs = {r["id"]: r for r in tables["run"]}
    assert len(runs) == 7
    app = runs[APP]
    assert (app["external_id"], app["user"], app["status"], app["persistent_log_url"], app["running_log_url"]) == ("app_1", "me", 1, "http://h/1", "http://ui:4040")
    assert app["job"]["type"] == "SPARK_APPLICATION" and str(app["started_at"])[:19] == "2024-03-11 14:21:07"
    assert runs[DAG]["persistent_log_url"] == "http://air:8081/dags/my dag/grid?dag_run_id=manual__1%2B0"
    assert runs[DAG]["start_reason"] == "MANUAL" and runs[DAG]["user"] is None and runs[DAG]["expected_start_at"] is not None and runs[DAG]["expected_end_at"] is None
    task = runs[TASK]
    assert (task["status"], task["attempt"], task["parent_run_id"]) == (2, "2", DAG) and task["persistent_log_url"].endswith("/dags/my dag/runs/manual__1+0/tasks/t1?try_number=2")
    assert runs[FLINK]["running_log_url"] == "http://flink:8081/#/job/running/f1" and runs[DBT]["external_id"] == "inv"
    hive = next(r for r in tables["run"] if r["job"]["type"] == "HIVE_SESSION")
    assert hive["job"]["name"] == "me@1.2.3.4" and hive["external_id"] == "s1" and hive["status"] == 0
    assert runs[OTHER]["external_id"] == "e1" and runs[OTHER]["user"] == "You" and runs[OTHER]["status"] == -1


def test_operations(tables):
    ops = {r["id"]: r for r in tables["operation"]}
    assert set(ops) == {SQL, TASK, FLINK, MODEL, HIVE, INNER}
    assert (ops[SQL]["name"], ops[SQL]["run_id"], ops[SQL]["position"], ops[SQL]["description"], ops[SQL]["status"]) == ("insert x", APP, 3, "what", 1)
    assert (ops[TASK]["name"], ops[TASK]["group"], ops[TASK]["status"], ops[TASK]["run_id"]) == ("t1", "g", 2, TASK)
    assert ops[FLINK]["type"] == "STREAMING" and ops[MODEL]["group"] == "MODEL" and ops[MODEL]["run_id"] == DBT
    assert (ops[HIVE]["name"], ops[HIVE]["description"]) == ("q1", "CREATETABLE_AS_SELECT")
    assert (ops[INNER]["name"], ops[INNER]["position"], ops[INNER]["run_id"]) == ("step", 4, OTHER)
    assert {q["query"] for q in tables["sql_query"]} == {"select 1\nfrom x", "create table t as select 1"}


def test_reads_and_writes(tables):
    ins = {(r["operation_id"], str(r["created_at"])[11:16]): r for r in tables["input"]}
    first = ins[SQL, "14:20"]
    assert first["dataset"]["name"] == "db.src" and first["num_rows"] is None and first["num_bytes"] == 10 and first["schema_digest"]
    assert (SQL, "15:20") in ins  # the hour of the last event
    outs = {r["dataset"]["name"]: r for r in tables["output"] if r["num_rows"] or r["dataset"]["name"] != "db.out"}
    assert outs["db.out"]["type"] == 16 and outs["db.out"]["num_rows"] == 7 and outs["db.out"]["num_bytes"] is None
    assert outs["out"]["type"] == 1 and outs["schema.model"]["type"] == 1 and outs["db.t"]["type"] == 2
    assert [s["schema"] for s in tables["schema"]] == ['[{"name": "id", "type": "int"}, {"name": "s"}]']


def test_datasets_and_symlinks(tables):
    names = {(d["location_type"], d["location_name"], d["name"]) for d in tables["dataset"]}
    assert ("hdfs", "nn:9820", "/data/src") in names and ("hive", "meta:9083", "db.src") in names and ("kafka", "k1:9092", "in") in names and len(names) == 7
    links = {(s["from_dataset"]["name"], s["to_dataset"]["name"], s["type"]) for s in tables["dataset_symlink"]}
    assert links == {("/data/src", "db.src", "METASTORE"), ("db.src", "/data/src", "WAREHOUSE")}
    kafka = next(x for x in tables["location"] if x["location_name"] == "k1:9092")
    assert set(kafka["addresses"]) == {"kafka://k1:9092", "kafka://k2:9092"}


def test_column_lineage(tables):
    got = {(r["source_column"], r["target_column"], r["type"]) for r in tables["dataset_column_relation"]}
    assert got == {("id", "a", 2), ("id", None, 128 | 64), ("s", "b", 8)}
    assert {(r["source"]["name"], r["target"]["name"]) for r in tables["column_lineage"]} == {("db.src", "db.out")}
    assert len({r["fingerprint"] for r in tables["column_lineage"]}) == 1


def test_tags(tables):
    got = {(t["job"]["name"], t["tag"], t["value"]) for t in tables["job_tag_value"]}
    assert {("app", "spark.version", "3.5.1"), ("app", "openlineage_adapter.version", "1.19"), ("my dag", "env", "prod"), ("dbt-run", "team", "data"), ("dbt-run", "openlineage_client.version", "1.2")} <= got
    assert not any(t[1] == "plain" for t in got)


def test_malformed_events_are_kept(spark):
    bad = ['{"not": "valid event"}', "{broken", None, json.dumps({**events()[0], "run": {"runId": "no uuid"}}), json.dumps({**events()[0], "eventType": "LATER"})]
    raw = spark.createDataFrame([(b, "k") for b in [*bad, json.dumps(events()[0])]], "value string, key string")
    valid, malformed = ingest.parse_events(raw)
    assert valid.count() == 1 and sorted(map(str, (r.value for r in malformed.collect()))) == sorted(map(str, bad))


def test_stream_into_the_store_twice(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    half = len(events()) // 2
    (source / "a.jsonl").write_text("\n".join(json.dumps(e) for e in events()[half:]) + "\n{broken\n")
    (source / "b.jsonl").write_text("\n".join(json.dumps(e) for e in events()[:half]))
    store = Store(spark, f"{tmp_path}/store")
    stream = ingest.read_stream(spark, str(source), max_files=1)
    query = ingest.start(stream, store.save, f"{tmp_path}/checkpoint", dead_letters=f"{tmp_path}/dead", available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    assert [bytes(r.value).decode() for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == ["{broken"]
    snapshot = {}
    for name in ("run", "operation", "input", "output", "job", "dataset", "dataset_symlink", "column_lineage", "dataset_column_relation"):
        snapshot[name] = store.read(name).count()
    assert snapshot["run"] == 8 and snapshot["job"] == 8 and snapshot["dataset_symlink"] == 2
    run = store.read("run").where(f"id = '{APP}'").head()
    assert run.status == 1 and run.external_id == "app_1" and run.started_at is not None and run.ended_at is not None
    valid, _ = ingest.parse_events(spark.createDataFrame([(json.dumps(e),) for e in events()], "value string"))
    store.save(valid)  # a batch that comes again changes nothing
    assert {name: store.read(name).count() for name in snapshot} == snapshot


def test_schema_of_a_read_is_the_one_told_first(spark):
    first, then = ({"namespace": "hdfs://nn:9820", "name": "/x", "facets": {"schema": {"fields": [{"name": n, "type": "int"}]}}} for n in ("a", "b"))
    rows = [event("RUNNING", SQL, "app.x", at=f"2024-03-11T14:3{i}:00Z", job=job_type("SPARK", "SQL_JOB"), facets=parent(APP, "app"), inputs=[d]) for i, d in enumerate((first, then))]
    for some in (rows, rows[::-1]):
        got = extract.merged_io(parsed(spark, some)[0], "inputs").collect()
        digest = extract.io(parsed(spark, rows[:1])[0], "inputs").head().schema_digest
        assert [r.schema_digest for r in got] == [digest]


def test_another_schema_is_a_row_of_its_own_in_the_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", buckets=4)
    for i, (name, rows) in enumerate((("a", 5), ("b", 3), ("a", 9))):
        d = {"namespace": "hdfs://nn:9820", "name": "/x", "facets": {"schema": {"fields": [{"name": name, "type": "int"}]}}, "inputFacets": {"inputStatistics": {"rowCount": rows}}}
        store.save(parsed(spark, [event("RUNNING", SQL, "app.x", at=f"2024-03-11T14:3{i}:00Z", job=job_type("SPARK", "SQL_JOB"), facets=parent(APP, "app"), inputs=[d])])[0])
    assert sorted(r.num_rows for r in store.read("input").collect()) == [3, 9]
    assert store.read("schema").count() == 2 and store.read("dataset").count() == 1 and store.read("nothing") is None
    assert sorted(store.read("schema").columns) == ["schema", "schema_digest"]


def test_unknown_job_names_give_way(spark):
    rows = [event("START", APP, "unknown", at="2024-03-11T14:30:00Z", job=job_type("SPARK", "APPLICATION", "NONE")), event("RUNNING", APP, "real", at="2024-03-11T14:31:00Z", job=job_type("SPARK", "APPLICATION", "NONE")), event("COMPLETE", APP, "unknown", at="2024-03-11T14:32:00Z", job=job_type("SPARK", "APPLICATION", "NONE"))]
    assert [r.job.name for r in extract.merged_runs(parsed(spark, rows)[0]).collect()] == ["real"]


def test_nested_fields_are_cleaned(spark):
    inner = [{"name": "y", "type": "int", "description": "  "}, {"name": "z", "type": "", "fields": [{"name": "w", "type": "", "description": " deep "}]}]
    d = {"namespace": "hdfs://nn:9820", "name": "/x", "facets": {"schema": {"fields": [{"name": "x", "type": "struct", "fields": inner}, {"name": "q", "type": "int", "fields": []}]}}}
    e = event("RUNNING", SQL, "app.x", job=job_type("SPARK", "SQL_JOB"), facets=parent(APP, "app"), inputs=[d])
    got = json.loads(extract.io(parsed(spark, [e])[0], "inputs").head().schema)
    assert got == [{"name": "x", "type": "struct", "fields": [{"name": "y", "type": "int"}, {"name": "z", "fields": [{"name": "w", "description": "deep"}]}]}, {"name": "q", "type": "int"}]


def test_partition_key_takes_the_root_then_the_parent(spark):
    root = {"parent": {**parent(APP, "app")["parent"], "root": {"job": {"namespace": "n", "name": "top"}, "run": {"runId": APP}}}}
    rows = [event("START", SQL, "a.b", facets=root), event("START", SQL, "a.b", facets=parent(APP, "app")), event("START", APP, "app")]
    got = {r[0] for r in parsed(spark, rows)[0].select(ingest.partition_key()).collect()}
    assert got == {"run:n/top", "run:local://host/app"}


def test_made_events_are_parsed_once(spark, monkeypatch):
    """What is stored of the events is parsed by one projection; no filter below it parses again."""
    from spoorline.plans import queries

    plans, store = [], queries.cut

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(queries, "cut", watched)
    events = queries._made_events(spark, "/root/testdata/sf0.001")
    parsing = [line for p in plans for line in p.splitlines() if "from_json" in line]
    assert len(parsing) == 1 and "Filter" not in parsing[0]
    assert events.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_datasets_are_named_by_their_distinct_mentions(spark):
    """The rules for names run above the fold of equal mentions, and give what reads, writes and symlinks give."""
    from spoorline.frames import cut

    e = cut(extract.classified(parsed(spark, events() * 3)[0]))
    named = extract.mentions(e)
    assert 0 < named.count() == named.distinct().count() <= extract._all_datasets(e).count() / 3
    want = extract.datasets(extract.io(e, "inputs"), extract.io(e, "outputs"), extract.symlinks(e))
    assert sorted(map(tuple, extract.named_datasets(e).collect())) == sorted(map(tuple, want.collect())) and want.count() == 7
    below = extract.symlinks(e)._jdf.queryExecution().sparkPlan().toString().split("Aggregate(keys=[integration")[1:]
    assert len(below) == 4 and "transform(" not in "".join(below)
