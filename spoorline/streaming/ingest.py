"""Run events from a stream or a batch of JSON texts: parsing, dead letters, and writing in micro-batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import run_event

#: Event types of a run.
EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "ABORT", "FAIL", "OTHER")
_UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


def is_valid(event: str = "event") -> Column:
    """Whether a parsed event has what every run event needs. Unparsable texts have none of it."""
    e = lambda path: F.col(f"{event}.{path}")
    needed = e("eventTime").isNotNull() & e("job.namespace").isNotNull() & e("job.name").isNotNull()
    return F.coalesce(needed & e("eventType").isin(*EVENT_TYPES) & e("run.runId").rlike(_UUID), F.lit(False))


def why_malformed(event: str = "event") -> Column:
    """What a parsed event lacks, the first of it; null for a valid one."""
    e = lambda path: F.col(f"{event}.{path}")
    nothing = reduce(lambda a, b: a & b, (e(c).isNull() for c in ("eventTime", "eventType", "job", "run")))
    missing = F.when(nothing, "not a run event").when(e("eventTime").isNull(), "no event time")
    missing = missing.when(e("job.namespace").isNull() | e("job.name").isNull(), "no job").when(e("eventType").isNull(), "no event type")
    missing = missing.when(~e("eventType").isin(*EVENT_TYPES), F.concat(F.lit("unknown event type "), e("eventType")))
    return missing.when(e("run.runId").isNull(), "no run id").when(~e("run.runId").rlike(_UUID), "run id is no UUID")


#: A message as brokers take it. ``reply_to`` names the message that is answered, ``correlation_id`` the batch it came with.
MESSAGE = "key binary, value binary, headers array<struct<key: string, value: binary>>, timestamp timestamp, correlation_id string, reply_to string, reason string"


def as_messages(malformed: DataFrame, correlation_id: str, column: str = "value") -> DataFrame:
    """Malformed rows as messages to be told again, with all that they came with (``MESSAGE``).

    Key, headers and time are those of the row where it has such columns, else null. ``reply_to`` is topic, partition
    and offset of the message where they are known. Headers keep their order, and a header that is told twice stays twice.
    """
    has, kinds = malformed.columns, {f.name: f.dataType for f in T.StructType.fromDDL(MESSAGE)}
    own = lambda c: (F.col(c) if c in has else F.lit(None)).cast(kinds[c]).alias(c)
    place = F.concat_ws("/", *(F.col(c).cast("string") for c in ("topic", "partition", "offset"))) if {"topic", "partition", "offset"} <= set(has) else F.lit(None).cast("string")
    return malformed.select(own("key"), F.col(column).cast("binary").alias("value"), own("headers"), own("timestamp"), F.lit(correlation_id).alias("correlation_id"), place.alias("reply_to"), own("reason"))


def to_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Publishes ``as_messages`` rows to a topic; correlation id, reply and reason become headers. Needs Spark's Kafka package."""
    more = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("binary").alias("value")) for c in ("correlation_id", "reply_to", "reason")))
    told = F.concat(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), F.filter(more, lambda h: h["value"].isNotNull()))
    messages.select("key", "value", told.alias("headers")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").option("topic", topic).save()


def parse_events(raw: DataFrame, column: str = "value", custom_prefix: str = "custom") -> tuple[DataFrame, DataFrame]:
    """(valid, malformed): valid rows have the event's fields as columns; malformed ones stay as they came, with the ``reason``.

    The two facets of producers without an integration keep the names ``custom_run`` and ``custom_operation``.
    """
    events = raw.withColumn("event", parsed(column, custom_prefix))
    return valid_events(events, custom_prefix), events.where(~is_valid()).withColumn("reason", why_malformed()).drop("event")


def parsed(column: str = "value", custom_prefix: str = "custom") -> Column:
    """The event in a text, null fields where it has none. Store it before it is filtered: Spark puts a filter below the parsing, and then parses for both."""
    return F.from_json(F.col(column).cast("string"), run_event(custom_prefix), {"mode": "PERMISSIVE"})


def valid_events(events: DataFrame, custom_prefix: str = "custom") -> DataFrame:
    """The fields of the valid ones of parsed events (column ``event``) as columns."""
    valid = events.where(is_valid()).select("event.*")
    if custom_prefix != "custom":
        facets = F.col("run.facets").withField("custom_run", F.col(f"run.facets.{custom_prefix}_run")).withField("custom_operation", F.col(f"run.facets.{custom_prefix}_operation"))
        valid = valid.withColumn("run", F.col("run").withField("facets", facets))
    return valid


def read_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of JSON lines from the files of a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def read_kafka(spark: SparkSession, servers: str, topics: str, by_pattern: bool = False, max_records: int | None = None, offsets: str = "latest", **options: str) -> DataFrame:
    """A stream of messages of Kafka topics (a list, or a pattern). Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", offsets)
    reader = reader.option("subscribePattern" if by_pattern else "subscribe", topics)
    if max_records:
        reader = reader.option("maxOffsetsPerTrigger", max_records)
    for k, v in options.items():
        reader = reader.option(k.replace("_", "."), v)
    return reader.load()


def partition_key() -> Column:
    """``run:namespace/name`` of the root, else the parent, else the event's own job: events of one application go together."""
    of = lambda job: F.concat(F.lit("run:"), F.col(f"{job}.namespace"), F.lit("/"), F.col(f"{job}.name"))
    return F.coalesce(of("run.facets.parent.root.job"), of("run.facets.parent.job"), of("job"))


def by_application(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Valid events with those of one application together, in the order of their times: what a batch of theirs is merged from lies in one task."""
    key = partition_key().alias("_key")
    dealt = events.repartition(partitions, key) if partitions else events.repartition(key)
    return dealt.sortWithinPartitions(partition_key(), "eventTime")


def start(stream: DataFrame, save, checkpoint: str, dead_letters: str | None = None, column: str = "value", available_now: bool = False, name: str | None = None, publish=None):
    """Starts the query that gives the valid events of each micro-batch to ``save`` and appends malformed ones to ``dead_letters``.

    A batch may come again after a failure. With a ``name`` the call is ``save(events, batch=(name, number))``, so that
    a store can tell; without one ``save`` has to merge by key. Dead letters are ``as_messages`` rows; those of a batch
    replace that batch's earlier ones. ``publish`` gets them too, to send them on.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            valid, malformed = parse_events(df, column)
            save(valid, batch=(name, number)) if name else save(valid)
            letters = as_messages(malformed, f"{name or 'stream'}-{number}", column)
            if dead_letters:
                letters.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
            if publish:
                publish(letters)
        finally:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
