"""Stored lineage tables to which micro-batches of run events are added.

A batch adds a delta to each table: its own rows, by natural key, and nothing else is written, however large the table
is. Reading merges base and deltas by key, in the order of the ledger; days (of facts) and keys (of other tables) that no
delta touches come from the base as they are. ``compact`` folds deltas into the base: only days, or buckets of keys,
that deltas touch are written again. Rules are such that deltas may be merged with each other first: a batch that comes
again, and one cut in two, give the same tables.

What belongs to a table is told by the ledger alone (``ledger``), so a batch is seen whole or not at all, any number of
writers may add batches at once, and a stream's batch that comes again is added once.

Locations are the same where they have one type and share a name or an address, also by way of others. The table
``location_alias`` tells which name stands for which; it is decided with each batch against the last state, again if
another writer came first. Reading puts the name that stands for a location everywhere.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import query_words
from ..operators import extract, merge, search_index
from .ledger import Ledger

#: Keys of each table; ``_low`` stands for the name without regard to case.
KEYS = {
    "location": ["location_type", "location_name"],
    "location_alias": ["location_type", "location_name"],
    "location_external_id": ["location_type", "location_name"],
    "dataset": ["location_type", "location_name", "_low"],
    "dataset_symlink": ["from_dataset", "to_dataset", "type"],
    "job": ["location_type", "location_name", "_low"],
    "user": ["_low"],
    "sql_query": ["fingerprint"],
    "schema": ["schema_digest"],
    "dataset_column_relation": ["fingerprint", "source_column", "_target"],
    "job_tag_value": ["job"],
    "dataset_tag_value": ["dataset", "tag", "value"],
    "posting": ["token", "kind", "branch", "id", "vector"],
}
FACTS = {
    "run": ["id"],
    "operation": ["id"],
    "input": ["created_at", "operation_id", "dataset", "schema_digest"],
    "output": ["created_at", "operation_id", "dataset", "schema_digest"],
    "column_lineage": ["created_at", "operation_id", "source", "target", "fingerprint"],
}
#: Where a table names a location: the columns themselves, or structs that hold them.
PLACES = {"dataset": [""], "job": [""], "dataset_symlink": ["from_dataset", "to_dataset"], "run": ["job"], "input": ["dataset"], "output": ["dataset"], "column_lineage": ["source", "target"], "job_tag_value": ["job"], "dataset_tag_value": ["dataset"]}
_GREATEST = ("status", "num_bytes", "num_rows", "num_files")
_DAY = "created_date"
#: Tables that a batch writes at a time.
WRITERS = 5


class Store:
    """Tables under ``path``; ``save`` adds a batch of parsed events. ``buckets`` is fixed with the first batch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.ledger = Ledger(spark, f"{self.path}/_ledger")

    # reading

    def version(self) -> int:
        return self.ledger.state()[0]

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as it stands, or stood at a version that is kept; None before its first row."""
        return self._read(name, self.ledger.state(version)[1])

    def _read(self, name: str, state: dict) -> DataFrame | None:
        found = self._merged(name, state)
        if found is None:
            return None
        found = found.drop("_bucket", "_low", "_target")
        alias = self._merged("location_alias", state) if name in PLACES or name == "location" else None
        if alias is None:
            return found
        alias = F.broadcast(alias) if self._rows("location_alias", state) <= 100_000 else alias
        if name == "location":
            shown = self._pointed(found, "", alias)
            return shown.groupBy("location_type", "location_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("addresses")))).alias("addresses"))
        again = reduce(lambda df, place: self._pointed(df, place, alias), PLACES[name], found.withColumn("_moved", F.lit(False)))
        if name == "run":  # known by its id alone
            return again.drop("_moved")
        # rows that now have the key of others are merged with them; the rest stays as it is
        keyed, keys = self._keyed(name, again), [*(FACTS.get(name) or KEYS[name])]
        moved = keyed.where("_moved").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).distinct()
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
        met = keyed.join(moved, same, "left_semi").select(*found.columns, F.lit(0).alias("_order"))
        return self._fold(name, met, found.columns).unionByName(keyed.join(moved, same, "left_anti").select(*found.columns))

    @staticmethod
    def _pointed(df: DataFrame, place: str, alias: DataFrame) -> DataFrame:
        """``df`` with the name that stands for its location in place of another; ``_moved`` tells where."""
        at = f"{place}." if place else ""
        to = alias.select(F.col("location_type").alias("_type"), F.col("location_name").alias("_name"), F.col("stands_for").alias("_to"))
        out = df.join(to, (F.col(f"{at}location_type") == F.col("_type")) & (F.col(f"{at}location_name") == F.col("_name")), "left")
        if "_moved" in df.columns:
            out = out.withColumn("_moved", F.col("_moved") | F.col("_to").isNotNull())
        if place:
            moved = F.when(F.col("_to").isNotNull(), F.col(place).withField("location_name", F.col("_to"))).otherwise(F.col(place))
            return out.withColumn(place, moved).select(*df.columns)
        return out.withColumn("location_name", F.coalesce("_to", "location_name")).select(*df.columns)

    @staticmethod
    def _rows(name: str, state: dict) -> int:
        table = state.get("tables", {}).get(name, {})
        return table.get("rows", 0) + sum(d["rows"] for d in table.get("deltas", []))

    def _base(self, name: str, table: dict, parts: set | None = None) -> DataFrame | None:
        """The folded rows, or those of some days or buckets."""
        kept = {p: v for p, v in table.get("base", {}).items() if parts is None or p in parts}
        if not kept:
            return None
        top = f"{self.path}/{name}/base"
        column = _DAY if name in FACTS else "_bucket"
        folders = [f"{top}/version={v}/{column}={p}" for p, v in kept.items()]
        return self.spark.read.schema(self._schema(table)).option("basePath", top).parquet(*folders).drop("version")

    def _deltas(self, name: str, deltas: list[dict], table: dict) -> DataFrame:
        """The rows of deltas with ``_order``, their place in the ledger."""
        top = f"{self.path}/{name}/delta"
        order = F.create_map(*(F.lit(x) for d in deltas for x in (d["id"], d["number"])))
        rows = self.spark.read.schema(self._schema(table, "batch string")).option("basePath", top).parquet(*(f"{top}/batch={d['id']}" for d in deltas))
        return rows.withColumn("_order", F.element_at(order, F.col("batch"))).drop("batch")

    @staticmethod
    def _schema(table: dict, also: str = ""):
        """The columns as they were first written: no file has to be opened for them."""
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(table["schema"])
        return StructType([*kind.fields, *(StructType.fromDDL(also).fields if also else [])])

    def _merged(self, name: str, state: dict, where: Column | None = None) -> DataFrame | None:
        """A table's rows for which ``where`` holds, a condition on its key."""
        where = F.lit(True) if where is None else where
        table = state.get("tables", {}).get(name)
        if table is None:
            return None
        deltas, base = table.get("deltas", []), table.get("base", {})
        if not deltas:
            return self._base(name, table).where(where)
        new = self._deltas(name, deltas, table).where(where)
        if not base:
            return self._fold(name, new, [c for c in new.columns if c != "_order"])
        columns = [c for c in new.columns if c != "_order"]
        if name in FACTS:
            touched = {day for d in deltas for day in d["parts"]}
            rest, old = (df if df is None else df.where(where) for df in (self._base(name, table, set(base) - touched), self._base(name, table, touched)))
        else:
            keys = self._keyed(name, new).select(*KEYS[name]).distinct()
            whole = self._keyed(name, self._base(name, table).where(where))
            same = reduce(lambda a, b: a & b, (whole[k].eqNullSafe(keys[k]) for k in KEYS[name]))
            rest, old = whole.join(keys, same, "left_anti").select(*columns), whole.join(keys, same, "left_semi").select(*columns)
        both = new if old is None else new.unionByName(old.withColumn("_order", F.lit(0).cast("long")))
        folded = self._fold(name, both, columns)
        return folded if rest is None else folded.unionByName(rest.select(*columns))

    # merging

    def _keyed(self, name: str, rows: DataFrame) -> DataFrame:
        if "_low" in KEYS.get(name, ()):
            rows = rows.withColumn("_low", F.lower("name"))
        return rows.withColumn("_target", F.coalesce("target_column", F.lit(""))) if "_target" in KEYS.get(name, ()) else rows

    def _fold(self, name: str, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Rows with ``_order`` merged by key. Merging neighbours first and the rest then gives the same."""
        rows = self._keyed(name, rows)
        order = F.col("_order")
        part = _DAY if name in FACTS else "_bucket"
        if name == "job_tag_value":  # a job has the tags that were told last
            last = rows.groupBy("job").agg(F.max("_order").alias("_last")).withColumnRenamed("job", "_job")
            return rows.join(last, (F.col("job") == F.col("_job")) & (order == F.col("_last")), "left_semi").select(*columns).distinct()
        keys = [*(FACTS.get(name) or KEYS[name]), *([part] if part in columns else [])]
        rest = [c for c in columns if c not in keys]
        if not rest:
            return rows.select(*columns).distinct()
        return rows.groupBy(*keys).agg(*(self._value(name, c, order) for c in rest)).select(*columns)

    @staticmethod
    def _value(name: str, column: str, order: Column) -> Column:
        """Addresses add up, types combine, statuses and counters are the greatest; everything else keeps what was told last."""
        if column == "addresses":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column)))).alias(column)
        if column == "name" and name not in FACTS:  # the spelling that was met first
            return F.min_by(column, F.struct(order, F.col(column))).alias(column)
        if column == "type" and name != "operation":
            return (F.bit_or(column) if name == "output" else F.max(column)).alias(column)
        return (F.max(column) if column in _GREATEST else merge.latest_known(column, order)).alias(column)

    # writing

    def save(self, events: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds the entities of a batch to all tables at once; the version that holds them.

        ``batch`` is a stream's name and the number of its batch: one that was added before is not added again.
        """
        if batch and self._known(self.ledger.state()[1], batch):
            return self.version()
        return self.add(extract.entities(events), batch)

    def add(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> int:
        """Adds rows to tables, as ``extract.entities`` gives them, all at once, with what searches need of them; the version that holds them."""
        if batch and self._known(self.ledger.state()[1], batch):
            return self.version()
        if "posting" not in tables and (postings := self._postings(tables)) is not None:
            tables = tables | {"posting": postings}
        with ThreadPoolExecutor(WRITERS) as pool:  # jobs of small tables side by side
            written = pool.map(inheritable_thread_target(self.spark)(lambda t: self._write_delta(*t)), tables.items())
            added = {name: d for name, d in zip(tables, written, strict=True) if d}

        def decide(state: dict) -> dict | None:
            if batch and self._known(state, batch):
                return None
            alias = None
            if "location" in added:
                alias = self._write_delta("location_alias", self._aliases(self._deltas("location", [added["location"] | {"number": 0}], added["location"]), state))
            return self._with(state, added | ({"location_alias": alias} if alias else {}), batch)

        return self.ledger.change(decide) if added or batch else self.version()

    @staticmethod
    def _postings(tables: dict[str, DataFrame]) -> DataFrame | None:
        """The postings of a batch's locations, datasets and jobs, by natural key."""
        parts = []
        for kind in ("location", "dataset", "job"):
            if kind not in tables:
                continue
            df = tables[kind].withColumn("ref", F.struct("location_type", "location_name", (F.lit("") if kind == "location" else F.col("name")).alias("name")))
            parts.append(search_index.vectors(df, kind, "location", "ref", ["location_type", "location_name"]))
            if kind == "location":
                parts.append(search_index.vectors(df.withColumn("url", F.explode("addresses")), kind, "address", "ref", ["url"]))
            else:
                parts.append(search_index.vectors(df, kind, "name", "ref", ["name"]))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def search(self, kind: str, text: str) -> DataFrame | None:
        """(location_type, location_name, name, search_rank): the locations, datasets or jobs that match; None where nothing is stored.

        Reads the postings of the query's words only: their buckets, and in those their ranges of tokens.
        """
        state = self.ledger.state()[1]
        words = sorted({w for some in query_words(text) for w in some})
        near = F.col("_bucket").isin(sorted({ord(w[0]) % self.buckets for w in words})) & (F.col("kind") == kind) & search_index.in_ranges(F.col("token"), words)
        postings = self._merged("posting", state, near)
        if postings is None:
            return None
        found = search_index.search(postings, kind, text).select("id.*", "search_rank")
        alias = self._merged("location_alias", state)
        if alias is not None:
            found = self._pointed(found, "", alias)
        return found.groupBy("location_type", "location_name", "name").agg(F.max("search_rank").alias("search_rank"))

    @staticmethod
    def _known(state: dict, batch: tuple[str, int]) -> bool:
        return state.get("streams", {}).get(batch[0], -1) >= batch[1]

    def _write_delta(self, name: str, rows: DataFrame) -> dict | None:
        """Writes a batch's rows of a table into a folder that no table has yet; None without rows."""
        if name in FACTS:
            rows = rows.withColumn(_DAY, F.to_date("created_at"))
        else:
            keyed = self._keyed(name, rows)
            place = F.ascii("token") if name == "posting" else F.xxhash64(*KEYS[name])  # a beginning of a word tells its bucket
            rows = keyed.withColumn("_bucket", F.pmod(place, F.lit(self.buckets)).cast("int")).select(*rows.columns, "_bucket")
            rows = rows.sortWithinPartitions("token") if name == "posting" else rows
        id = uuid.uuid4().hex
        folder = f"{self.path}/{name}/delta/batch={id}"
        rows.write.mode("errorifexists").parquet(folder)
        rows = self.spark.read.schema(rows.schema).parquet(folder)
        part = _DAY if name in FACTS else "_bucket"
        told = rows.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("part")).count().collect()  # as many as days or buckets
        if not told:
            return None
        return {"id": id, "rows": sum(r["count"] for r in told), "parts": sorted(r["part"] for r in told), "schema": rows.schema.jsonValue()}

    @staticmethod
    def _with(state: dict, added: dict[str, dict], batch: tuple[str, int] | None) -> dict:
        number = state.get("number", 0) + 1
        tables = state.setdefault("tables", {})
        for name, d in added.items():
            table = tables.setdefault(name, {"schema": d["schema"], "base": {}, "deltas": [], "rows": 0})
            table["deltas"].append({"id": d["id"], "rows": d["rows"], "parts": d["parts"], "number": number})
        if batch:
            state.setdefault("streams", {})[batch[0]] = batch[1]
        return state | {"number": number}

    def _aliases(self, batch: DataFrame, state: dict) -> DataFrame:
        """(location_type, location_name, stands_for): names that, with this batch, another one stands for.

        Only the batch's locations and those that share an address or a name with them are looked at.
        """
        key = ["location_type", "location_name"]
        new = batch.select(*key, "addresses")
        stored, alias = self._merged("location", state), self._merged("location_alias", state)
        if stored is None:
            groups = merge.location_groups(new.withColumn("stored", F.lit(False)))
            return groups.where("location_name <> stands_for")
        stored = stored.select(*key, "addresses")
        near = stored.select("*", F.explode_outer("addresses").alias("url")).join(new.select("location_type", F.explode("addresses").alias("url")).distinct(), ["location_type", "url"], "left_semi").select(*key)
        near = near.union(new.join(stored, key, "left_semi").select(*key)).distinct()
        if alias is None:
            known = near.join(stored, key)
        else:  # those that stand for them, and all that these stand for
            heads = near.join(alias, key, "left").select("location_type", F.coalesce("stands_for", "location_name").alias("stands_for")).distinct()
            family = alias.join(heads, ["location_type", "stands_for"], "left_semi").select(*key).union(heads.select("location_type", F.col("stands_for").alias("location_name"))).distinct()
            known = family.join(stored, key)
        known = known.withColumn("stored", F.lit(True))
        links = None
        if alias is not None:
            links = alias.join(known.select(*key), key, "left_semi")
            known = known.join(alias.select(*key, F.lit(True).alias("_led")), key, "left").withColumn("stored", F.col("_led").isNull()).drop("_led")  # only one that stands for itself can go on doing so
        groups = merge.location_groups(known.unionByName(new.withColumn("stored", F.lit(False))), links)
        groups = groups.where("location_name <> stands_for")
        return groups if alias is None else groups.join(alias, [*key, "stands_for"], "left_anti")

    # folding

    def compact(self, names: list[str] | None = None, least: int = 1) -> int:
        """Folds the deltas of tables that have at least ``least`` into their bases; the version after it.

        Batches that are added meanwhile stay deltas; where another compaction came first, that table is left to it.
        """
        _, state = self.ledger.state()
        done = {}
        for name, table in state.get("tables", {}).items():
            deltas = table["deltas"]
            if (names is None or name in names) and len(deltas) >= max(1, least):
                done[name] = table
        with ThreadPoolExecutor(WRITERS) as pool:
            done = dict(zip(done, pool.map(inheritable_thread_target(self.spark)(lambda t: self._folded(*t)), done.items()), strict=True))

        def decide(now: dict) -> dict | None:
            changed = False
            for name, (ids, base, was) in done.items():
                table = now["tables"][name]
                if table["base"] == was and [d["id"] for d in table["deltas"]][: len(ids)] == ids:
                    table["rows"] += sum(d["rows"] for d in table["deltas"][: len(ids)])
                    table["base"], table["deltas"] = was | base, table["deltas"][len(ids) :]
                    changed = True
            return now | {"number": now["number"] + 1} if changed else None

        return self.ledger.change(decide) if done else self.version()

    def _folded(self, name: str, table: dict) -> tuple[list[str], dict, dict]:
        """Writes the touched days or buckets anew. Returns (the deltas that went in, part and version of what was written, the base before)."""
        deltas, part = table["deltas"], _DAY if name in FACTS else "_bucket"
        touched = {p for d in deltas for p in d["parts"]}
        new, old = self._deltas(name, deltas, table), self._base(name, table, touched)
        both = new if old is None else new.unionByName(old.withColumn("_order", F.lit(0).cast("long")))
        version = uuid.uuid4().hex
        rows = self._fold(name, both, [c for c in new.columns if c != "_order"])
        rows = rows.repartitionByRange("_bucket", "token").sortWithinPartitions("_bucket", "token") if name == "posting" else rows
        rows.write.mode("errorifexists").partitionBy(part).parquet(f"{self.path}/{name}/base/version={version}")
        return [d["id"] for d in deltas], dict.fromkeys(sorted(touched), version), table["base"]

    def vacuum(self, keep: int = 2, older_than: float = 86400.0) -> int:
        """Removes folders that none of the last ``keep`` versions has and that were last changed ``older_than`` seconds ago; how many.

        A writer has to add its record within that time of its first file.
        """
        number, _ = self.ledger.state()
        self.ledger.prune(keep)
        live = set()
        for n in range(max(1, number - keep + 1), number + 1):
            for name, table in self.ledger.state(n)[1].get("tables", {}).items():
                live |= {f"{name}/base/version={v}" for v in table["base"].values()} | {f"{name}/delta/batch={d['id']}" for d in table["deltas"]}
        fs, path, gone = self.ledger.fs, self.ledger._path, 0
        for name in (*KEYS, *FACTS):
            for kind in ("base", "delta"):
                top = path(f"{self.path}/{name}/{kind}")
                for s in fs.listStatus(top) if fs.exists(top) else ():
                    if f"{name}/{kind}/{s.getPath().getName()}" not in live and s.getModificationTime() / 1000 <= time.time() - older_than:
                        gone += bool(fs.delete(s.getPath(), True))
        return gone

    def set_external_id(self, location_type: str, location_name: str, external_id: str | None) -> int:
        """Changes the external id of a stored location; KeyError where it is not there. An empty one takes it away."""
        stored = self.read("location")
        if stored is None or stored.where((F.col("location_type") == location_type) & (F.col("location_name") == location_name)).isEmpty():
            raise KeyError(f"no location {location_type}://{location_name}")
        row = self.spark.createDataFrame([(location_type, location_name, external_id or "")], "location_type string, location_name string, external_id string")
        d = self._write_delta("location_external_id", row)
        return self.ledger.change(lambda state: self._with(state, {"location_external_id": d}, None))

    def external_ids(self) -> DataFrame | None:
        """(location_type, location_name, external_id) of the locations that have one."""
        found = self.read("location_external_id")
        return None if found is None else found.where("external_id <> ''")

