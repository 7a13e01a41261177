"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The mapping of order tables onto lineage tables, in SQL.
MAPPED = """
location AS (SELECT CAST(n_nationkey AS BIGINT) AS id, lower(r_name) AS type, lower(n_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey),
address AS (SELECT CAST(n_nationkey AS BIGINT) AS location_id, 'jdbc://h' || n_nationkey || '.example:9000' AS url FROM nation),
dataset AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS location_id, s_name AS name FROM supplier),
job AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS location_id, c_name AS name, c_mktsegment AS type FROM customer),
run AS (SELECT o_orderkey AS id, o_orderdate AS created_at, o_custkey AS job_id,
               CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 END AS parent_run_id,
               CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS status,
               'run-' || o_orderkey AS external_id, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2 DAY END AS ended_at, o_custkey % 150 AS started_by_user_id, o_orderpriority AS start_reason
        FROM orders),
users AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id, 'user' || user_id AS name FROM events),
facts AS (SELECT l_shipdate AS created_at, l_orderkey * 2 + l_linenumber % 2 AS operation_id, l_orderkey AS run_id, o_custkey AS job_id, l_suppkey AS dataset_id,
                 CASE WHEN l_tax <> 0 THEN l_partkey END AS schema_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS num_bytes,
                 CAST(l_quantity AS BIGINT) AS num_rows, CAST(l_linenumber AS BIGINT) AS num_files, 1 << l_linenumber AS type, l_returnflag, l_partkey
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
inputs AS (SELECT * FROM facts WHERE l_returnflag = 'R'),
outputs AS (SELECT * FROM facts WHERE l_returnflag <> 'R'),
operation AS (SELECT l_orderkey * 2 + l_linenumber % 2 AS id, l_orderkey AS run_id, min(l_shipdate) AS created_at, 'op-' || (l_orderkey * 2 + l_linenumber % 2) AS name FROM lineitem GROUP BY 1, 2, 4),
dataset_symlink AS (SELECT a.id AS from_dataset_id, b.id AS to_dataset_id, 'METASTORE' AS type FROM dataset a JOIN dataset b ON b.id = a.id + 1 WHERE a.id % 10 = 0
                    UNION ALL SELECT b.id, a.id, 'WAREHOUSE' FROM dataset a JOIN dataset b ON b.id = a.id + 1 WHERE a.id % 10 = 0),
column_lineage AS (SELECT o.created_at, o.operation_id, o.run_id, o.job_id, o.dataset_id AS target_dataset_id, i.dataset_id AS source_dataset_id, CAST(i.l_partkey AS VARCHAR) AS fingerprint
                   FROM outputs o JOIN inputs i ON o.operation_id = i.operation_id),
column_relation AS (SELECT CAST(p_partkey AS VARCHAR) AS fingerprint, p_brand AS source_column, CASE WHEN p_size % 3 <> 0 THEN p_type END AS target_column, 1 << (p_size % 12) AS type FROM part),
job_tag_value AS (SELECT DISTINCT o_custkey AS job_id, o_orderpriority AS tag_value FROM orders),
dedup_out AS (SELECT job_id, run_id, operation_id, dataset_id, max(created_at) AS seen_at, max(num_bytes) AS num_bytes, max(num_rows) AS num_rows, max(num_files) AS num_files,
                     first(schema_id ORDER BY created_at, schema_id NULLS LAST) AS oldest, last(schema_id ORDER BY created_at, schema_id NULLS LAST) AS newest, bit_or(type) AS types
              FROM outputs GROUP BY ALL),
dedup_in AS (SELECT job_id, run_id, operation_id, dataset_id, max(created_at) AS seen_at, max(num_bytes) AS num_bytes, max(num_rows) AS num_rows, max(num_files) AS num_files,
                    first(schema_id ORDER BY created_at, schema_id NULLS LAST) AS oldest, last(schema_id ORDER BY created_at, schema_id NULLS LAST) AS newest
             FROM inputs GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, mapped: bool = True, recursive: bool = False):
    """Registers a query. ``sql`` may use the mapped tables by name; ``{recursive}`` CTEs come after them."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            if not mapped:
                SQL[name] = body
            elif body[:5].upper() == "WITH ":
                SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{MAPPED.strip()},\n{body[5:]}"
            else:
                SQL[name] = f"WITH {MAPPED.strip()}\n{body}"
        return f

    return register
