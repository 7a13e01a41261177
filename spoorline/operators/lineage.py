"""Bounded lineage walks over inputs and outputs, as frontier joins.

A walk alternates between datasets and jobs, runs or operations. Each level reads the facts once, semi-joined to the
frontier, and its result is written to the shared folder, so plans stay short and nothing is recomputed. Only edges of
very many entities are not: they are as large as the facts, so they are made of the facts and the stored frontier where
they are asked for, with the sums that are asked for. So are the entities that no further level starts from. What was
visited is skipped as a frontier only: edges to it still appear. Facts are never older than the run or operation they
belong to, so wherever a frontier's ids have a time in them, the earliest is a lower bound for the facts that are read at
that level, and runs and operations are looked up in the days that their ids tell.

Downstream from a dataset means its readers, upstream its writers; from a job, run or operation downstream means what
it writes, upstream what it reads. After the first step a branch keeps its direction. Of the two branches of BOTH,
walks from datasets go downstream first, the others upstream first; the second skips what the first visited.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import Later, among, among_many, are_many, cut, first_per, ids_frame, made, without
from ..functions.ids import bounds_of, near_ids
from . import columns
from .io_stats import DATASET, JOB, KEYS, OPERATION, RUN, dataset_relations, dedup_io, in_period, roll_up_sets, roll_up_steps

DOWNSTREAM, UPSTREAM, BOTH = "DOWNSTREAM", "UPSTREAM", "BOTH"
MAX_DEPTH = 10
#: The column of a fact that holds the entity of a granularity.
ENTITY = {OPERATION: "operation_id", RUN: "run_id", JOB: "job_id", DATASET: "dataset_id"}
#: Tasks' shares of facts whose edges one task sorts: of one share, what tasks send to each other would be blocks of some hundred bytes.
SHARES = 4
#: Granularities whose sums go with each.
WITH_SUMS = {OPERATION: (OPERATION, RUN, JOB), RUN: (RUN, JOB), JOB: (JOB,)}


def validate(direction: str, depth: int, since: dt.datetime | None = None, until: dt.datetime | None = None) -> None:
    """Raises ValueError for arguments that no walk takes."""
    if direction not in (DOWNSTREAM, UPSTREAM, BOTH):
        raise ValueError(f"unknown direction {direction}")
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth is from 1 to {MAX_DEPTH}")
    if since is not None and until is not None and since >= until:
        raise ValueError("since has to be before until")


@dataclass
class Lineage:
    """What a walk found. Edge frames have one row per dataset, job, run, operation (and types); ids of coarser rows are null."""

    inputs: list[DataFrame] = field(default_factory=list)
    outputs: list[DataFrame] = field(default_factory=list)
    ids: dict[str, list[DataFrame | Later]] = field(default_factory=lambda: {DATASET: [], JOB: [], RUN: [], OPERATION: []})
    symlinks: list[DataFrame | Later] = field(default_factory=list)
    #: The datasets of the edges.
    ends: dict[str, list[DataFrame | Later]] = field(default_factory=lambda: {"inputs": [], "outputs": []})
    relations: list[DataFrame] = field(default_factory=list)
    #: What the walk was asked for: the granularity whose entities column lineage is looked up by, and the period.
    by: str | None = None
    since: dt.datetime | None = None
    until: dt.datetime | None = None
    #: Tasks that edges of very many entities are sorted in; None: as Spark likes.
    tasks: int | None = None
    #: Without sums there are the nodes and the pairs of entity and dataset, but no edges to show.
    sums: bool = True

    def merged(self, kind: str) -> DataFrame | None:
        """Edges of all levels (``inputs`` or ``outputs``); of equal ones that of the later level stays."""
        parts = getattr(self, kind)
        if not self.sums:
            raise ValueError("the walk was asked for no sums")
        if not parts:
            return None
        if len(parts) == 1:  # a roll-up has one row per key as it is
            return parts[0]
        rows = reduce(DataFrame.unionByName, (p.withColumn("_level", F.lit(i)) for i, p in enumerate(parts)))
        keys = KEYS[OPERATION] + (["types"] if "types" in rows.columns else [])
        return first_per(rows, keys, F.desc("_level")).drop("_level")

    def datasets(self, kind: str) -> DataFrame | None:
        """The distinct ids of the datasets that are shown as read (``inputs``) or written (``outputs``)."""
        return reduce(DataFrame.union, map(made, self.ends[kind])).distinct() if self.ends[kind] else None

    def nodes(self, kind: str) -> DataFrame | None:
        """The distinct ids of a kind of entity."""
        return reduce(DataFrame.union, map(made, self.ids[kind])).distinct() if self.ids[kind] else None

    def all_symlinks(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, map(made, self.symlinks)).distinct() if self.symlinks else None

    def all_relations(self) -> DataFrame | None:
        """Dataset relations of all levels, one per pair."""
        if not self.relations:
            return None
        rows = reduce(DataFrame.unionByName, (p.withColumn("_level", F.lit(i)) for i, p in enumerate(self.relations)))
        return first_per(rows, ["in_dataset_id", "out_dataset_id"], F.desc("_level")).drop("_level")


class Walker:
    """Walks over the tables ``input``, ``output``, ``dataset``, ``job``, ``run``, ``operation`` and ``dataset_symlink``."""

    def __init__(self, tables, since=None, until=None, sums: bool = True):
        self.t, self.since, self.until, self.sums = tables, since, until, sums
        self.spark, self.tasks = tables.spark, getattr(tables, "tasks", None)
        self.seen: dict[str, DataFrame] = {}

    # visited ids

    def _skip(self, kind: str, ids: DataFrame) -> DataFrame:
        return without(ids, self.seen[kind]) if kind in self.seen else ids

    def _visit(self, kind: str, ids: DataFrame) -> None:
        self.seen[kind] = self.seen[kind].union(ids) if kind in self.seen else ids  # each part is stored

    # steps

    def closure(self, ids: DataFrame, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(ids with those one symlink away but in ``skip``, the symlinks). Both directions, one step."""
        links = self.t.dataset_symlink
        touching = among(links, ids, "from_dataset_id").unionByName(among(links, ids, "to_dataset_id")).distinct()
        ends = touching.select(F.col("from_dataset_id").alias("id")).union(touching.select(F.col("to_dataset_id").alias("id"))).distinct()
        new = without(ends, ids)
        return cut(ids.union(new if skip is None else without(new, skip)).distinct()), touching

    def _edges(self, out: Lineage, kind: str, ids: DataFrame, column: str, granularities, dated: bool = True, floor: dt.datetime | None = None) -> DataFrame:
        """Adds the edges of entities; what they are between, from which the next level starts."""
        io = self.t.input if kind == "inputs" else self.t.output
        io = in_period(io, self.since, self.until) if dated else io
        found = among_many(in_period(io, floor), ids, column, self.tasks)
        if not self.sums:
            edges = pairs = cut(found.select(ENTITY[granularities[0]], "dataset_id").distinct())
        elif not are_many(ids):
            edges = pairs = cut(roll_up_sets(dedup_io(found), granularities))
        else:
            edges, pairs = roll_up_steps(dedup_io(found), granularities, self.tasks), found
            out.tasks = self.tasks and -(-self.tasks // SHARES)
        ends = pairs.select(F.col("dataset_id").alias("id"))
        getattr(out, kind).append(edges)
        out.ends[kind].append(ends if pairs is edges else Later(lambda: cut(ends.distinct())))
        return pairs

    def from_datasets(self, out: Lineage, ids: DataFrame, direction: str, granularity: str, depth: int) -> None:
        if ids.isEmpty():
            return
        ids, links = self.closure(ids, self.seen.get(DATASET))
        out.ids[DATASET].append(ids)
        out.symlinks.append(links)
        column = ENTITY[granularity]
        nexts = []
        for way, kind in ((DOWNSTREAM, "inputs"), (UPSTREAM, "outputs")):
            if direction in (way, BOTH):
                edges = self._edges(out, kind, ids, "dataset_id", WITH_SUMS[granularity])
                nexts.append((way, edges.select(F.col(column).alias("id")).where("id is not null").distinct()))
        self._visit(DATASET, ids)
        for way, entities in nexts:
            if depth > 1:
                self.from_entities(out, cut(self._skip(granularity, entities)), way, granularity, depth - 1)
            else:
                self._include(out, Later(lambda entities=entities: cut(entities)), granularity)

    def from_entities(self, out: Lineage, ids: DataFrame, direction: str, granularity: str, depth: int, dated: bool = True, finest: str | None = None, floor: dt.datetime | None = None) -> None:
        """From jobs, runs or operations. ``finest`` is the granularity of the edges where it is finer than the entities; no fact of theirs is before ``floor``."""
        if ids.isEmpty():
            return
        column, finest = ENTITY[granularity], finest or granularity
        floor = bounds_of(ids)[0] if floor is None and granularity != JOB else floor
        nexts = []
        for way, kind in ((UPSTREAM, "inputs"), (DOWNSTREAM, "outputs")):
            if direction in (way, BOTH):
                edges = self._edges(out, kind, ids, column, WITH_SUMS[finest], dated, floor)
                nexts.append((way, out.ends[kind][-1]))
                if finest != granularity:
                    finer = edges.select(F.col(ENTITY[finest]).alias("id")).where("id is not null").distinct()
                    self._include(out, Later(lambda finer=finer: cut(finer)), finest)
        self._include(out, ids, granularity)
        self._visit(granularity, ids)
        for way, ends in nexts:
            if depth > 1:
                self.from_datasets(out, cut(self._skip(DATASET, made(ends).distinct())), way, finest, depth - 1)
            else:
                seen = self.seen.get(DATASET)
                last = Later(lambda ends=ends, seen=seen: self.closure(cut(made(ends).distinct() if seen is None else without(made(ends).distinct(), seen)), seen))
                out.ids[DATASET].append(Later(lambda last=last: last.made[0]))
                out.symlinks.append(Later(lambda last=last: last.made[1]))

    def _include(self, out: Lineage, ids: DataFrame | Later, granularity: str) -> None:
        """Adds entities with the coarser ones that hold them."""

        def holders(table: str, ids: DataFrame, column: str) -> DataFrame:
            return among_many(near_ids(getattr(self.t, table), ids), ids, "id", self.tasks).select(F.col(column).alias("id")).distinct()

        out.ids[granularity].append(ids)
        if granularity == OPERATION:
            out.ids[RUN].append(Later(lambda: cut(holders("operation", made(ids), "run_id"))))
        if granularity in (OPERATION, RUN):
            runs = out.ids[RUN][-1]
            out.ids[JOB].append(Later(lambda: holders("run", made(runs), "job_id")))

    def over_datasets(self, out: Lineage, ids: DataFrame, direction: str, depth: int) -> None:
        """Dataset granularity: breadth first over dataset relations, both directions level by level.

        A level reads the near side of its frontier's facts, then the far side of the operations found there.
        """
        start, links = self.closure(ids, self.seen.get(DATASET))
        out.ids[DATASET].append(start)
        out.symlinks.append(links)
        known, frontier = start, {way: start for way in (DOWNSTREAM, UPSTREAM) if direction in (way, BOTH)}
        for _ in range(depth):
            new = []
            for way, far in ((DOWNSTREAM, "out_dataset_id"), (UPSTREAM, "in_dataset_id")):
                if way in frontier and not frontier[way].isEmpty():
                    found = cut(self._relations(frontier[way], way))
                    out.relations.append(found)
                    frontier[way], links = self.closure(cut(without(found.select(F.col(far).alias("id")).distinct(), known)))
                    out.symlinks.append(links)
                    new.append(frontier[way])
            if not new:
                break
            known = cut(reduce(DataFrame.union, new, known).distinct())
        out.ids[DATASET].append(known)

    def _relations(self, ids: DataFrame, way: str) -> DataFrame:
        """Dataset relations from (downstream) or to (upstream) the given datasets."""
        near, far = (self.t.input, self.t.output) if way == DOWNSTREAM else (self.t.output, self.t.input)
        near = cut(among(in_period(near, self.since, self.until), ids, "dataset_id"))
        operations = near.select(F.col("operation_id").alias("id")).distinct()
        far = among(in_period(in_period(far, self.since, self.until), bounds_of(operations)[0]), operations, "operation_id")
        return dataset_relations(near, far) if way == DOWNSTREAM else dataset_relations(far, near)


def _start(table: DataFrame, ids: Collection | DataFrame) -> tuple[DataFrame, dt.datetime | None]:
    """(the rows' ids that exist, stored; the earliest instant that the given ids tell): the table is read in the days of the ids only."""
    low, high = bounds_of(ids)
    kind = dict(table.dtypes)["id"]
    if low is not None:
        table = in_period(table, low, high + dt.timedelta(microseconds=999))
    wanted = ids if isinstance(ids, DataFrame) else ids_frame(table.sparkSession, ids, kind)
    return cut(among(table, wanted, "id").select("id")), low


def by_datasets(tables, ids: Collection, direction: str = DOWNSTREAM, granularity: str = RUN, since=None, until=None, depth: int = 1) -> Lineage:
    """Lineage that starts from datasets (and their symlinks)."""
    validate(direction, depth, since, until)
    out, walker = Lineage(by=granularity, since=since, until=until), Walker(tables, since, until)
    start = among(tables.dataset, ids_frame(tables.spark, ids), "id").select("id")
    if granularity == DATASET:
        walker.over_datasets(out, cut(start), direction, depth)
    else:
        walker.from_datasets(out, cut(start), direction, granularity, depth)
    return out


def by_jobs(tables, ids: Collection, direction: str = DOWNSTREAM, granularity: str = JOB, since=None, until=None, depth: int = 1, sums: bool = True) -> Lineage:
    """Lineage that starts from jobs, with edges by job or run."""
    validate(direction, depth, since, until)
    out, walker = Lineage(by=JOB, since=since, until=until, sums=sums), Walker(tables, since, until, sums)
    start = among(tables.job, ids_frame(tables.spark, ids), "id").select("id")
    walker.from_entities(out, cut(start), direction, JOB, depth, finest=granularity)
    return out


def by_runs(tables, ids: Collection | DataFrame, direction: str = DOWNSTREAM, granularity: str = RUN, since=None, until=None, depth: int = 1, sums: bool = True) -> Lineage:
    """Lineage that starts from runs (a frame names them in ``id``), with edges by run or operation; the sums by job go with them."""
    validate(direction, depth, since, until)
    out, walker = Lineage(by=RUN, since=since, until=until, sums=sums), Walker(tables, since, until, sums)
    start, floor = _start(tables.run, ids)
    walker.from_entities(out, start, direction, RUN, depth, finest=granularity, floor=floor)
    return out


def by_operations(tables, ids: Collection | DataFrame, direction: str = DOWNSTREAM, since=None, until=None, depth: int = 1, sums: bool = True) -> Lineage:
    """Lineage that starts from operations (a frame names them in ``id``), without ``sums`` for what needs nodes only, as from jobs and runs. The period holds for the levels after the first only."""
    validate(direction, depth, since, until)
    out, walker = Lineage(by=OPERATION, since=since, until=until, sums=sums), Walker(tables, since, until, sums)
    start, floor = _start(tables.operation, ids)
    walker.from_entities(out, start, direction, OPERATION, depth, dated=False, floor=floor)
    return out


def parent_relations(out: Lineage, tables) -> DataFrame:
    """(from_kind, from_id, to_kind, to_id): job to run and run to operation, among the entities that are included."""
    tasks = getattr(tables, "tasks", None)
    parts, held = [], {kind: cut(out.nodes(kind)) for kind in (JOB, RUN, OPERATION) if out.ids[kind]}
    if RUN in held:
        runs = among_many(tables.run, held[RUN], "id", tasks)
        runs = among(runs, held[JOB], "job_id")
        parts.append(runs.select(F.lit(JOB).alias("from_kind"), F.col("job_id").cast("string").alias("from_id"), F.lit(RUN).alias("to_kind"), F.col("id").cast("string").alias("to_id")))
    if OPERATION in held:
        ops = among_many(among_many(tables.operation, held[OPERATION], "id", tasks), held[RUN], "run_id", tasks)
        parts.append(ops.select(F.lit(RUN).alias("from_kind"), F.col("run_id").cast("string").alias("from_id"), F.lit(OPERATION).alias("to_kind"), F.col("id").cast("string").alias("to_id")))
    if not parts:
        return tables.spark.createDataFrame([], "from_kind string, from_id string, to_kind string, to_id string")
    rows, order = reduce(DataFrame.unionByName, parts), ("from_kind", "from_id", "to_id")
    return rows.orderBy(*order) if tasks is None else rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)


#: What a relation goes between, as (kind, from_kind, to_kind): inputs and outputs by the finest id that an edge has, and relations of datasets.
_PLACES = (*(("INPUT", DATASET, g) for g in (OPERATION, RUN, JOB)), *(("OUTPUT", g, DATASET) for g in (OPERATION, RUN, JOB)), ("INPUT", DATASET, DATASET))


def relation_rows(out: Lineage) -> DataFrame | None:
    """Edges as (kind, from_kind, from_id, to_kind, to_id) with their sums, sorted by these: an input goes from the dataset, an output to it.

    A relation of two datasets is an input that goes from one to the other, without sums. What is shuffled for the sort
    are ids as they are and a number in place of the kinds; names and texts are made of them where the rows arrive.
    """
    sides, relations = [(start, rows) for start, kind in ((0, "inputs"), (3, "outputs")) if (rows := out.merged(kind)) is not None], out.all_relations()
    ids = {k for _, rows in sides for c, k in rows.dtypes if c in KEYS[OPERATION]} | {k for c, k in (relations.dtypes if relations is not None else ()) if c.endswith("dataset_id")}
    raw = lambda *cs: F.coalesce(*(F.col(c) if len(ids) == 1 else F.col(c).cast("string") for c in cs))
    sums = ["last_interaction_at", "num_bytes", "num_rows", "num_files"]
    parts = []
    for start, rows in sides:
        place = F.when(F.col("operation_id").isNotNull(), start).when(F.col("run_id").isNotNull(), start + 1).otherwise(start + 2)
        ends = [raw("dataset_id"), raw("operation_id", "run_id", "job_id")]
        types = F.col("types") if "types" in rows.columns else F.lit(None).cast("int")
        parts.append(rows.select(place.alias("place"), *(c.alias(n) for c, n in zip(ends if start == 0 else ends[::-1], ("a", "b"), strict=True)), *sums, types.alias("types")))
    if relations is not None:
        none = [*(F.lit(None).cast("long").alias(c) for c in sums[1:]), F.lit(None).cast("int").alias("types")]
        parts.append(relations.select(F.lit(len(_PLACES) - 1).alias("place"), raw("in_dataset_id").alias("a"), raw("out_dataset_id").alias("b"), "last_interaction_at", *none))
    if not parts:
        return None
    kind, from_kind, to_kind = (F.get(F.array(*(F.lit(p[i]) for p in _PLACES)), F.col("place")) for i in range(3))
    order = {"kind": kind, "from_kind": from_kind, "from_id": F.col("a").cast("string"), "to_kind": to_kind, "to_id": F.col("b").cast("string")}
    rows = reduce(DataFrame.unionByName, parts).repartitionByRange(*([out.tasks] if out.tasks else []), *order.values())
    return rows.select(*(c.alias(n) for n, c in order.items()), *sums, "types").sortWithinPartitions(*order)


def symlink_rows(out: Lineage) -> DataFrame | None:
    """Symlinks as (type, from_kind, from_id, to_kind, to_id), sorted by their ends."""
    rows = out.all_symlinks()
    if rows is None:
        return None
    end = lambda c: F.col(c).cast("string")
    return rows.select("type", F.lit(DATASET).alias("from_kind"), end("from_dataset_id").alias("from_id"), F.lit(DATASET).alias("to_kind"), end("to_dataset_id").alias("to_id")).orderBy("from_id", "to_id", "type")


def column_lineage(out: Lineage, tables, tasks: int | None = None) -> DataFrame | None:
    """Which columns depend on which, for what a walk has shown; None where it shows no reads or no writes.

    Looked up by the jobs, runs or operations that the walk holds, between datasets that it shows as read and as
    written, in its period (by operations: from the earliest of their ids on); a walk over datasets takes the pairs
    that it has found. Rows as of ``columns.combined``, which ``tasks`` is for.
    """
    if out.by == DATASET:
        pairs = out.all_relations()
        if pairs is None:
            return None
        pairs = pairs.select(F.col("in_dataset_id").alias("source_dataset_id"), F.col("out_dataset_id").alias("target_dataset_id"))
        return columns.of_pairs(tables.column_lineage, tables.dataset_column_relation, pairs, out.since, out.until, tasks)
    sources, targets = out.datasets("inputs"), out.datasets("outputs")
    if sources is None or targets is None:
        return None
    nodes = cut(out.nodes(out.by))
    facts = tables.column_lineage
    since, until = (out.since, out.until) if out.by != OPERATION else (None, None)
    if out.by != JOB:
        facts = in_period(facts, bounds_of(nodes)[0])
    return columns.of_entities(facts, tables.dataset_column_relation, ENTITY[out.by], nodes, sources, targets, since, until, tasks)


def shown_schemas(out: Lineage) -> DataFrame | None:
    """(dataset_id, schema_id, relevance) of the datasets that a walk shows, from its edges; the latest write that has a schema counts, else the latest read."""
    sides = []
    for kind in ("outputs", "inputs"):
        rows = out.merged(kind)
        if rows is not None:
            known = rows.where("newest_schema_id is not null")
            sides.append(known.groupBy("dataset_id").agg(F.max_by("newest_schema_id", F.struct("last_interaction_at", "newest_schema_id")).alias("new"), F.min("oldest_schema_id").alias("old"), F.max("newest_schema_id").alias("top")).withColumn("side", F.lit(len(sides))))
    if not sides:
        return None
    first = first_per(reduce(DataFrame.unionByName, sides), ["dataset_id"], F.asc("side"))
    return first.select("dataset_id", F.col("new").alias("schema_id"), F.when((F.col("old") == F.col("new")) & (F.col("top") == F.col("new")), "EXACT_MATCH").otherwise("LATEST_KNOWN").alias("relevance"))


@dataclass
class Shown:
    """A walk's whole result: edges, symlinks, what holds what, columns by target column and by target, schemas by dataset. None where there is nothing of a kind."""

    relations: DataFrame | None
    symlinks: DataFrame | None
    parents: DataFrame
    direct: DataFrame | None = None
    indirect: DataFrame | None = None
    schemas: DataFrame | None = None


def shown(out: Lineage, tables, with_columns: bool = False) -> Shown:
    """All that a walk has to tell, with column lineage where it is asked for."""
    found = column_lineage(out, tables) if with_columns else None
    found = None if found is None else cut(found)
    sides = (None, None) if found is None else (columns.direct(found), columns.indirect(found))
    return Shown(relation_rows(out), symlink_rows(out), parent_relations(out, tables), *sides, shown_schemas(out))


def dataset_schemas(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(dataset_id, schema_id, relevance): the schema of the latest write that has one, else of the latest read.

    EXACT_MATCH where the earliest and latest of that side are the same schema.
    """

    def side(io: DataFrame, name: str) -> DataFrame:
        known = io.where("schema_id is not null")
        by = F.struct("created_at", "schema_id")
        return known.groupBy("dataset_id").agg(F.max_by("schema_id", by).alias(f"{name}_new"), F.min_by("schema_id", by).alias(f"{name}_old"))

    both = side(outputs, "out").join(side(inputs, "in"), "dataset_id", "full")
    schema, oldest = F.coalesce("out_new", "in_new"), F.coalesce("out_old", "in_old")
    return both.select("dataset_id", schema.alias("schema_id"), F.when(schema == oldest, "EXACT_MATCH").otherwise("LATEST_KNOWN").alias("relevance"))
