"""The lineage tables: stored ones, and a mapping of order tables onto them for tests and benchmarks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Line items that go to a task where facts are joined and folded; tables of up to ``WHOLE_ROWS`` are left to Spark.
TASK_ROWS, WHOLE_ROWS = 125_000, 2_000_000


def tasks_of(rows: int) -> int | None:
    """How many tasks a table's rows are dealt to, so that a task's share stays the same however many there are; None: as Spark likes."""
    return None if rows <= WHOLE_ROWS else -(-rows // TASK_ROWS)


@dataclass
class Tables:
    """Tables by name, read from ``path`` as Parquet (facts may be partitioned by ``created_date``)."""

    spark: SparkSession
    path: str
    #: Tasks that joins by many ids are dealt to; None: as Spark likes.
    tasks: int | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)


class OrderTables:
    """Lineage tables over order tables: orders are runs, line items are reads and writes of supplier datasets.

    Each table is a projection of the Parquet files, so filters and column pruning reach the scans.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int | None:
        """Tasks that line items, and what comes of them, are dealt to."""
        return tasks_of(self.source("lineitem").count())  # from the footers

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` dealt out by ``key`` to as many tasks as line items ask for. Left alone, small stored sizes make few tasks, and their memory grows with the table."""
        return df if self.tasks is None else df.repartition(self.tasks, key)

    @cached_property
    def location(self) -> DataFrame:
        region = self.source("region").select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("type"))
        nation = self.source("nation").join(region, "n_regionkey")
        return nation.select(F.col("n_nationkey").cast("long").alias("id"), "type", F.lower("n_name").alias("name"), F.lit(None).cast("string").alias("external_id"))

    @cached_property
    def address(self) -> DataFrame:
        n = self.source("nation").select(F.col("n_nationkey").cast("long").alias("location_id"))
        return n.select("location_id", F.concat(F.lit("jdbc://h"), F.col("location_id").cast("string"), F.lit(".example:9000")).alias("url"))

    @cached_property
    def dataset(self) -> DataFrame:
        return self.source("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("location_id"), F.col("s_name").alias("name"))

    @cached_property
    def job(self) -> DataFrame:
        return self.source("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("location_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))

    @cached_property
    def run(self) -> DataFrame:
        o = self.source("orders")
        status = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
        parent = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1)
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_custkey").alias("job_id"),
            parent.alias("parent_run_id"),
            status.alias("status"),
            F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("external_id"),
            F.col("o_orderdate").alias("started_at"),
            F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("ended_at"),
            (F.col("o_custkey") % 150).alias("started_by_user_id"),
            F.col("o_orderpriority").alias("start_reason"),
        )

    @cached_property
    def user(self) -> DataFrame:
        users = self.source("events").select(F.col("user_id").cast("long").alias("id")).distinct()
        return users.select("id", F.concat(F.lit("user"), F.col("id").cast("string")).alias("name"))

    @cached_property
    def _facts(self) -> DataFrame:
        runs = self.source("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job_id"))
        return (
            self.dealt(self.source("lineitem"), "l_orderkey")
            .join(self.dealt(runs, "l_orderkey"), "l_orderkey")
            .select(
                F.col("l_shipdate").alias("created_at"),
                (F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).alias("operation_id"),
                F.col("l_orderkey").alias("run_id"),
                "job_id",
                F.col("l_suppkey").alias("dataset_id"),
                F.when(F.col("l_tax") != 0, F.col("l_partkey")).alias("schema_id"),
                F.round(F.col("l_extendedprice") * 100).cast("long").alias("num_bytes"),
                F.col("l_quantity").cast("long").alias("num_rows"),
                F.col("l_linenumber").cast("long").alias("num_files"),
                F.expr("shiftleft(1, l_linenumber)").alias("type"),
                "l_returnflag",
            )
        )

    @cached_property
    def input(self) -> DataFrame:
        return self._facts.where("l_returnflag = 'R'").drop("type", "l_returnflag")

    @cached_property
    def output(self) -> DataFrame:
        return self._facts.where("l_returnflag <> 'R'").drop("l_returnflag")

    @cached_property
    def operation(self) -> DataFrame:
        item = self.dealt(self.source("lineitem"), "l_orderkey").select((F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).alias("id"), F.col("l_orderkey").alias("run_id"), "l_shipdate")
        return item.groupBy("id", "run_id").agg(F.min("l_shipdate").alias("created_at")).withColumn("name", F.concat(F.lit("op-"), F.col("id").cast("string")))

    @cached_property
    def dataset_symlink(self) -> DataFrame:
        s = self.dataset.where("id % 10 = 0").select("id", (F.col("id") + 1).alias("next")).join(self.dataset.select(F.col("id").alias("next")), "next")
        forth = s.select(F.col("id").alias("from_dataset_id"), F.col("next").alias("to_dataset_id"), F.lit("METASTORE").alias("type"))
        back = s.select(F.col("next").alias("from_dataset_id"), F.col("id").alias("to_dataset_id"), F.lit("WAREHOUSE").alias("type"))
        return forth.unionByName(back)

    @cached_property
    def column_lineage(self) -> DataFrame:
        """One row for each input, output pair of an operation; the input's part is the fingerprint."""
        reads = self.source("lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).alias("operation_id"), F.col("l_suppkey").alias("source_dataset_id"), F.col("l_partkey").cast("string").alias("fingerprint"))
        writes = self.output.select("created_at", "operation_id", "run_id", "job_id", F.col("dataset_id").alias("target_dataset_id"))
        return self.dealt(writes, "operation_id").join(self.dealt(reads, "operation_id"), "operation_id")

    @cached_property
    def dataset_column_relation(self) -> DataFrame:
        p = self.source("part")
        target = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
        return p.select(F.col("p_partkey").cast("string").alias("fingerprint"), F.col("p_brand").alias("source_column"), target.alias("target_column"), F.expr("shiftleft(1, p_size % 12)").alias("type"))

    @cached_property
    def job_tag_value(self) -> DataFrame:
        return self.source("orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("tag_value")).distinct()
