"""Column functions against plain Python."""

import datetime as dt
import hashlib
import textwrap
import uuid

import pytest
from pyspark.sql import functions as F

from spoorline.functions import flags, ids, search, text
from spoorline.operators import extract
from spoorline.sources import partitions


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").coalesce(1).select(column(F.col("x"))).collect()]


def test_static_uuid(spark):
    names = ["", "abc", "häß\n", "x" * 500]
    assert values(spark, ids.static_uuid, names) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert values(spark, ids.static_uuid, [None]) == [None]


def test_incremental_uuid(spark):
    rows = [(dt.datetime(2024, 7, 5, 9, 4, 12, m, tzinfo=dt.UTC), d) for m in (0, 162000, 999999) for d in ("a", "b.c.1")]
    df = spark.createDataFrame(rows, "t timestamp, d string").coalesce(1)
    got = [r[0] for r in df.select(ids.incremental_uuid(F.col("t"), F.col("d"))).collect()]
    for (t, d), g in zip(rows, got, strict=True):
        node = int(hashlib.sha1((t.isoformat() + d).encode()).hexdigest(), 16) >> 84
        want = (int(t.timestamp() * 1000) << 80) | node
        want = want & ~(0xF000 << 64) | 7 << 76
        want = want & ~(0xC000 << 48) | 0x8000 << 48
        assert g == str(uuid.UUID(int=want))
        assert ids.instant_of(g).replace(microsecond=0) == t.replace(microsecond=0)
    back = [r[0] for r in df.select(F.unix_millis(ids.uuid_instant(ids.incremental_uuid(F.col("t"), F.col("d"))))).collect()]
    assert back == [int(t.timestamp() * 1000) for t, _ in rows]


def test_id_bounds(spark):
    with pytest.raises(ValueError):
        ids.instant_of(str(uuid.uuid4()))
    assert values(spark, ids.uuid_instant, [str(uuid.uuid4())]) == [None]


def test_locations(spark):
    rows = ["hdfs://Host1:9820,host2:9820", "file", "s3://bucket/path", "local://", "postgres://pg:5432", "no_scheme", "kafka://a:1/x?y"]
    got = values(spark, text.dataset_location, rows)
    assert [(g.type, g.name) for g in got] == [("hdfs", "host1:9820"), ("file", "unknown"), ("s3", "bucket"), ("local", "unknown"), ("postgres", "pg:5432"), ("unknown", "no_scheme"), ("kafka", "a:1")]
    assert got[0].addresses == ["hdfs://host1:9820", "hdfs://host2:9820"]
    assert values(spark, text.job_location, ["http://Airflow:8081"])[0].name == "airflow:8081"


def test_statements(spark):
    rows = ["ALTER TABLE a DROP COLUMN b", "drop table x", "select 1", "  insert\ninto a", "with a as (select 1)\nMERGE INTO b", "update_x set", None, "COPY a FROM b; DROP TABLE c"]
    assert values(spark, text.output_type_of_sql, rows) == [4, 32, None, 1, 512, None, None, 1]


def test_paths_and_tags(spark):
    assert values(spark, text.strip_partitions, ["/a/b/day=1/hour=2", "/a/b", "day=1", "/x=1"]) == ["/a/b", "/a/b", "day=1", "/x=1"]
    got = values(spark, text.tag_of, ["a:b", "a:b:c", "plain"])
    assert [(g.key, g.value, g.source) if g else None for g in got] == [("a", "b", None), ("a", "b", "c"), None]


def test_flags(spark):
    assert values(spark, lambda c: flags.decode_flags(c, flags.OUTPUT_TYPES), [0, 1, 513, None], "int") == [[], ["APPEND"], ["APPEND", "MERGE"], None]
    assert values(spark, flags.status_of_event, ["START", "running", "COMPLETE", "FAIL", "ABORT", "OTHER", None]) == [0, 0, 1, 2, 3, -1, -1]
    assert values(spark, flags.count_or_null, ["9223372036854775807", "5", None, "18446744073709551615"]) == [None, 5, None, None]


def test_query_words():
    assert search.query_words("some word 12345")[0] == ["some", "word", "12345"]
    assert search.query_words("with_underscore_123") == (["with_underscore_123"], ["with", "underscore", "123"])
    assert search.query_words("/file/path") == (["/file/path"], ["file", "path"])
    assert search.query_words("!@#$%^&*()_+~-=[]{}|;':,./<>?a_lot_of_punctuation")[1] == ["a", "lot", "of", "punctuation"]


def test_search_matches(spark):
    found = lambda name, q: values(spark, lambda c: search.matches(search.tokens(c), q), [name])[0]
    assert found("/data/some.table", "some table") and found("/data/some.table", "/data/some") and found("my_schema.my_table", "my_schema")
    assert not found("/data/some.table", "other") and found("Host.Name", "host")
    ranks = [values(spark, lambda c: search.rank(search.tokens(c), "orders"), [n])[0] for n in ("orders", "orders_daily", "a/b/orders/c")]
    assert ranks[0] > ranks[1] and ranks[0] > ranks[2] > 0


def test_sql_text(spark):
    rows = ["  select\n    1\n  from x  ", "a\n b", "\n\n   x\n\n   y\n", "tab\there\x00\x7f", "\tq\n\tr", "x"]
    job = F.struct(F.struct(F.struct(F.col("x").alias("query")).alias("sql")).alias("facets"))
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").coalesce(1).select(job.alias("job")).select(extract.sql_text()).collect()]

    def plain(q):
        out = textwrap.dedent(q).strip()
        return "".join(c.encode("unicode-escape").decode() if (ord(c) < 32 and c != "\n") or ord(c) == 127 else c for c in out)

    assert got == [plain(q) for q in rows]


def test_ticks(spark):
    rows = [(dt.datetime(2024, 1, 1, 10, 30), dt.datetime(2024, 1, 1, 9, 45)), (dt.datetime(2024, 1, 1, 11, 45), dt.datetime(2024, 1, 1, 9, 45)), (dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 9, 45))]
    got = [r[0] for r in spark.createDataFrame(rows, "t timestamp, a timestamp").coalesce(1).select(text.hourly_tick(F.col("t"), F.col("a")).cast("string")).collect()]
    assert got == ["2024-01-01 09:45:00", "2024-01-01 11:45:00", "2024-01-01 09:45:00"]


def test_partitions(spark, tmp_path):
    got = partitions.partition_ranges(spark, dt.date(2024, 1, 31), dt.date(2024, 3, 1), "month").collect()
    assert [(r.name, str(r.begin), str(r.end)) for r in got] == [("y2024_m01", "2024-01-01", "2024-02-01"), ("y2024_m02", "2024-02-01", "2024-03-01"), ("y2024_m03", "2024-03-01", "2024-04-01")]
    names = spark.createDataFrame([("y2023",), ("y2024_m02",), ("y2024_m02_d10",), ("default",)], "name string")
    assert {r.name for r in partitions.partitions_before(names, dt.date(2024, 2, 5)).collect()} == {"y2023", "y2024_m02"}
    facts = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "id long, created_at timestamp")
    partitions.write_fact(facts, f"{tmp_path}/f")
    partitions.write_fact(facts.where("id = 2").withColumn("id", F.lit(5).cast("long")), f"{tmp_path}/f")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/f").collect()) == [1, 5]
    dated = facts.union(spark.createDataFrame([(3, dt.datetime(2024, 2, 29, 23)), (4, None)], facts.schema))
    for granularity, names in (("year", ["y2024", "y2025"]), ("month", ["y2024_m01", "y2024_m02", "y2024_m03"]), ("day", 61)):
        got = [r.name for r in partitions.partitions_of([facts, dated], granularity=granularity, ahead=1).collect()]
        assert got == names if isinstance(names, list) else len(got) == names and got[-1] == "y2024_m03_d01"
    assert partitions.partitions_of([facts.where("id is null")]).count() == 0


def test_days_are_created_once_and_read_as_empty(spark, tmp_path):
    path, days = f"file://{tmp_path}", [dt.date(2024, 1, d) for d in (1, 2, 3)]
    facts = spark.createDataFrame([(1, dt.datetime(2024, 1, 2))], "id long, created_at timestamp")
    partitions.write_fact(facts, f"{path}/f")
    assert partitions.create_days(path, ["f", "g"], days[0], days[2]) == [("f", days[0]), ("f", days[2]), *(("g", d) for d in days)]
    assert partitions.create_days(path, ["f", "g"], days[0], days[2]) == []
    assert [r.id for r in spark.read.parquet(f"{path}/f").collect()] == [1]
    partitions.write_fact(facts.withColumn("created_at", F.lit(dt.datetime(2024, 1, 3, 5))), f"{path}/f")
    assert spark.read.parquet(f"{path}/f").count() == 2
    assert partitions.clean_up(path, ["f", "g"], days[1], partitions.DROP) == [("f", days[0]), ("g", days[0])]
    with pytest.raises(ValueError, match="before end"):
        partitions.create_days(path, ["f"], days[1], days[0])
