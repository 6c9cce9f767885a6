"""Versioned keyed tables: range-clustered Parquet files under a log of versions.

A write stages its outcome as Parquet and commits it as a delta on the version it read; a read lays the deltas over
the base files that can hold its keys. Folding and compaction turn deltas into base files again.
"""

from __future__ import annotations

import bisect
import logging
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bounds import Key, KeyRange
from .errors import ClosedError, ConflictError, DuplicateKeyError, FinishedError, KeyedTableError, KeyTooLongError, MaintenanceError, NullKeyError, SchemaError
from .operators import writes
from .operators.checks import key_report
from .operators.reads import ReadView, narrowed
from .sources.files import Files
from .sources.manifest import DataFile, Manifest, Version

log = logging.getLogger("rangeloom")
#: Keys of deltas with up to so many rows and bytes, as the manifest has them, are broadcast when laid over the base.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: So few keys of a batch are read and looked up among the files' spans.
FEW_KEYS = 1000
Values = Mapping[str, Column]


@dataclass(frozen=True)
class Options:
    """``retries``: of single writes that meet another commit. ``fold_after``: deltas after which a commit folds them (0:
    never). ``file_rows``: rows of a file at most. ``ranges``: key ranges that a load, fold or compaction deals rows into
    (0: the session's shuffle partitions). ``max_key_bytes``: of string and binary keys (0: no limit). ``fold_bytes``: base
    files up to this size are folded by the write that finds enough deltas, larger ones behind it. ``lease_seconds``: how
    long a snapshot, transaction or unfinished write keeps its files from being vacuumed; longer than any of them lasts.
    ``retain_seconds``: age under which a compaction keeps all files, for reads that go on without a snapshot."""

    retries: int = 10
    fold_after: int = 16
    file_rows: int = 5_000_000
    ranges: int = 0
    max_key_bytes: int = 0
    fold_bytes: int = 256 << 20
    lease_seconds: float = 7 * 86_400
    retain_seconds: float = 0
    default_is_unbounded: bool = False
    on_warning: Callable[[str], None] | None = None
    on_compaction_started: Callable[[], None] | None = None
    on_compaction_completed: Callable[[CompactionResult], None] | None = None

    def validate(self) -> None:
        if min(self.retries, self.fold_after, self.max_key_bytes, self.ranges, self.fold_bytes, self.lease_seconds, self.retain_seconds) < 0:
            raise ValueError("numbers of options can't be negative")
        if self.file_rows < 1:
            raise ValueError("file_rows must be 1 or more")


@dataclass(frozen=True)
class CompactionResult:
    bytes_saved: int
    files_removed: int
    seconds: float
    version: int


@dataclass(frozen=True)
class Statistics:
    version: int
    rows: int
    base_files: int
    delta_files: int
    delta_rows: int
    bytes: int
    versions: int
    open_transactions: int
    open_snapshots: int


@dataclass(frozen=True)
class ValidationResult:
    errors: tuple[str, ...]

    @property
    def is_valid(self) -> bool:
        return not self.errors

    @property
    def error(self) -> str | None:
        return self.errors[0] if self.errors else None


@dataclass(frozen=True)
class WriteResult:
    """``outcome``: a row for each key of the batch (see operators.writes); the counts are of its rows."""

    version: int
    outcome: DataFrame
    inserted: int
    updated: int
    deleted: int
    unchanged: int


@dataclass(frozen=True)
class Staged:
    files: tuple[DataFile, ...]
    outcome: DataFrame
    inserted: int
    updated: int
    deleted: int
    unchanged: int


class Store:
    """Files of one table: reading versions as DataFrames and staging what is written."""

    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.options = spark, options
        self.files = Files(spark, path)
        self.manifest = Manifest(self.files)
        self.schema: T.StructType
        self.key: list[str]

    def load(self) -> None:
        meta = self.manifest.meta()
        self.schema, self.key = T.StructType.fromJson(meta["schema"]), meta["key"]

    @property
    def values(self) -> list[str]:
        return [c for c in self.schema.names if c not in self.key]

    def _read(self, files: Sequence[DataFile], columns: T.StructType | None = None) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], columns or self.schema)
        return self.spark.read.schema(columns or self.schema).parquet(*[f"{self.files.root}/{f.path}" for f in files])

    def rows(self, version: Version, wanted: KeyRange = KeyRange()) -> DataFrame:
        """The version's rows; of files whose keys all lie outside ``wanted``, none are read."""
        near = lambda df: df if wanted == KeyRange() else df.where(wanted.condition(self.key))
        base = near(self._read([f for f in version.base if f.meets(wanted)]))
        parts, n, size = [], 0, 0
        for order, delta in enumerate(version.deltas):
            for op in (writes.PUT, writes.DEL):
                held = [f for f in delta if f.op == op and f.meets(wanted)]
                n += sum(f.rows for f in held)
                size += sum(f.size for f in held)
                if held:
                    parts.append(near(self._read(held)).select(*self.key, F.struct(F.lit(op).alias("op"), *self.values).alias("__d"), F.lit(order).alias("__o")))
        if not parts:
            return base
        over = parts[0]
        for p in parts[1:]:
            over = over.unionByName(p)
        if len(version.deltas) > 1:
            over = over.groupBy(*self.key).agg(F.max_by("__d", "__o").alias("__d"))
        keys = over.select(*self.key)
        kept = base.join(F.broadcast(keys) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else keys, self.key, "left_anti")
        put = over.where(F.col("__d.op") == writes.PUT).select(*self.key, *[F.col(f"__d.{c}").alias(c) for c in self.values])
        return kept.unionByName(put.select(*self.schema.names))

    def ends(self, version: Version, n: int, *, greatest: bool, wanted: KeyRange = KeyRange()) -> DataFrame:
        """Rows among which the ``n`` at one end of a range are: base files from that end that outnumber them and all deltas."""
        need, taken = n + version.delta_rows, []
        for f in reversed(version.base) if greatest else version.base:
            if f.meets(wanted):
                taken.append(f)
                need -= f.rows if wanted.covers(f.least, f.greatest) else 0
            if need <= 0:
                break
        return self.rows(self._only(version, taken), wanted)

    @staticmethod
    def _only(version: Version, base: Sequence[DataFile], deltas: Sequence[tuple[DataFile, ...]] | None = None) -> Version:
        return Version(version.number, version.rows, tuple(sorted(base, key=lambda f: f.least)), version.deltas if deltas is None else tuple(d for d in deltas if d))

    def near(self, version: Version, keys: DataFrame) -> DataFrame:
        """Rows that ``keys`` can meet: of a few keys, which are read here, files whose spans hold one of them."""
        found = keys.limit(FEW_KEYS + 1).collect()
        if len(found) > FEW_KEYS:
            ends = keys.agg(F.min(F.struct(*self.key)).alias("lo"), F.max(F.struct(*self.key)).alias("hi")).first()
            if ends["lo"] is None or any(x is None for x in ends["lo"]):
                return self.rows(version)
            return narrowed(self.rows(version, KeyRange(self._extreme(ends["lo"]), self._extreme(ends["hi"]))), keys, self.key)
        if any(x is None for r in found for x in r):
            return self.rows(version)
        given = sorted({self._extreme(r) for r in found})

        def held(f: DataFile) -> bool:
            at = bisect.bisect_left(given, f.least)
            return at < len(given) and given[at] <= f.greatest

        kept = self._only(version, [f for f in version.base if held(f)], [tuple(f for f in d if held(f)) for d in version.deltas])
        types = T.StructType([self.schema[c] for c in self.key])
        return self.rows(kept).join(F.broadcast(self.spark.createDataFrame(given, types)), self.key, "left_semi")

    def count_range(self, version: Version, wanted: KeyRange) -> int:
        """Counts whole files by the manifest where no delta lies, and reads keys of the others only."""
        if wanted.empty:
            return 0
        if any(f.meets(wanted) for d in version.deltas for f in d):
            return self.rows(version, wanted).select(*self.key).count()
        held = [f for f in version.base if f.meets(wanted)]
        whole = [f for f in held if wanted.covers(f.least, f.greatest)]
        part = [f for f in held if f not in whole]
        n = sum(f.rows for f in whole)
        return n + (self._read(part).where(wanted.condition(self.key)).select(*self.key).count() if part else 0)

    def conform(self, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
        missing = [c for c in columns if c not in batch.columns]
        if missing:
            raise SchemaError(f"columns missing: {', '.join(missing)}")
        types = {f.name: f.dataType for f in self.schema}
        for c in columns:
            given = batch.schema[c].dataType
            if c in types and given != types[c] and not isinstance(given, T.NullType) and not (isinstance(given, T.NumericType) and isinstance(types[c], T.NumericType)):
                raise SchemaError(f"column {c} is {given.simpleString()}, the table's is {types[c].simpleString()}")
        return batch.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in columns])

    def stats(self, folder: str, op: str | None = None) -> list[tuple[str, Row]]:
        """For each Parquet file below a folder: its name and what its keys span."""
        kinds = T.StructType([*self.schema.fields, T.StructField(writes.EXISTED, T.BooleanType())])
        found = self.spark.read.schema(kinds if op is None else self.schema).option("recursiveFileLookup", "true").parquet(f"{self.files.root}/{folder}")
        nulls = F.lit(False)
        size = F.lit(0)
        for c in self.key:
            nulls = nulls | F.col(c).isNull()
            if isinstance(self.schema[c].dataType, (T.StringType, T.BinaryType)):
                size = size + F.octet_length(c)
        existed = F.sum(F.col(writes.EXISTED).cast("int")) if op is None else F.lit(0)
        whole = F.struct(*self.key)
        rows = (
            found.groupBy("_metadata.file_path", "_metadata.file_size")
            .agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.count("*").alias("n"), F.sum(nulls.cast("int")).alias("nulls"), F.max(size).alias("longest"), existed.alias("existed"))
            .collect()
        )
        mark = f"/{folder}/"
        return [(f"{folder}/{r['file_path'].split(mark, 1)[1]}", r) for r in rows]

    def stage(self, outcome: DataFrame) -> Staged:
        """Write an outcome by key order, puts, deletes and rows without effect apart; check its keys."""
        folder = f"data/{uuid.uuid4().hex}"
        self.manifest.begin(folder)
        ordered = outcome.repartitionByRange(*self.key).sortWithinPartitions(writes.OP, *self.key)
        ordered.write.option("maxRecordsPerFile", self.options.file_rows).partitionBy(writes.OP).parquet(f"{self.files.root}/{folder}")
        files, tally = [], {"inserted": 0, "updated": 0, "deleted": 0, "unchanged": 0}
        for path, r in self.stats(folder):
            if r["nulls"]:
                raise NullKeyError("a key of the batch is null")
            if self.options.max_key_bytes and r["longest"] > self.options.max_key_bytes:
                raise KeyTooLongError(r["longest"], self.options.max_key_bytes)
            op = path.split("op=", 1)[1].split("/", 1)[0]
            if op == writes.NONE:
                tally["unchanged"] += r["n"]
                continue
            files.append(DataFile(path, op, r["n"], r["file_size"], self._extreme(r["lo"]), self._extreme(r["hi"])))
            if op == writes.PUT:
                tally["inserted"] += r["n"] - r["existed"]
                tally["updated"] += r["existed"]
            else:
                tally["deleted"] += r["n"]
        written = self.spark.read.schema(T.StructType([f for f in outcome.schema if f.name != writes.OP] + [T.StructField(writes.OP, T.StringType())])).parquet(f"{self.files.root}/{folder}")
        return Staged(tuple(sorted(files, key=lambda f: f.least)), written.select(*outcome.columns), **tally)

    @staticmethod
    def _extreme(key: Row) -> Key:
        return tuple(bytes(x) if isinstance(x, bytearray) else x for x in key)

    def write_base(self, rows: DataFrame, apart: Sequence[Key] = ()) -> list[DataFile]:
        """Base files with disjoint key ranges, sorted inside; none holds keys from both sides of one of ``apart``."""
        folder = f"data/{uuid.uuid4().hex}"
        self.manifest.begin(folder)
        part = F.lit(0)
        for key in apart:
            part = part + F.when(KeyRange(key).condition(self.key), 1).otherwise(0)
        order = ["__part", *self.key] if apart else self.key
        rows = rows.withColumn("__part", part) if apart else rows
        dealt = rows.repartitionByRange(self.options.ranges, *order) if self.options.ranges else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.option("maxRecordsPerFile", self.options.file_rows).partitionBy(*(["__part"] if apart else [])).parquet(f"{self.files.root}/{folder}")
        return [DataFile(p, "base", r["n"], r["file_size"], self._extreme(r["lo"]), self._extreme(r["hi"])) for p, r in self.stats(folder, "base") if r["n"]]


class TableView(ReadView):
    """Reads of one version; knows the files' keys, so ends and counts touch few of them."""

    def __init__(self, store: Store, version: Version):
        super().__init__(lambda wanted: store.rows(version, wanted), store.key, default_is_unbounded=store.options.default_is_unbounded)
        self.store, self.version = store, version

    def page(self, size: int, *, after: Any = None, before: Any = None, reverse: bool = False) -> DataFrame:
        wanted = self._range(after, before, start_included=False, end_included=False)
        order = self._descending() if reverse else self._ascending()
        return self._end_of(size, reverse, wanted).where(wanted.condition(self.key)).orderBy(*order).limit(size)

    def top(self, n: int) -> DataFrame:
        return self.page(n)

    def latest(self, n: int) -> DataFrame:
        return self.page(n, reverse=True)

    def _end_of(self, n: int, greatest: bool, wanted: KeyRange) -> DataFrame:
        return self.store.ends(self.version, n, greatest=greatest, wanted=wanted)

    def _met_by(self, probes: DataFrame) -> DataFrame:
        return self.store.near(self.version, probes.select(*self.key).distinct())

    def count(self) -> int:
        return self.version.rows

    def count_range(self, start: Any = None, end: Any = None, **more: bool) -> int:
        return self.store.count_range(self.version, self._range(start, end, **more))

    def __iter__(self):
        """Rows by ascending key, base file by base file where no delta lies over them: no sort of the whole table."""
        if self.version.deltas:
            yield from super().__iter__()
            return
        for f in self.version.base:
            yield from self.store._read([f]).orderBy(*self._ascending()).toLocalIterator()


class Writer:
    """The write operations; what ``_run`` does with an outcome differs between a table and a transaction."""

    _store: Store

    def _run(self, what: str, build: Callable[[DataFrame], DataFrame], touching: DataFrame | KeyRange, batch: tuple[str, int] | None = None) -> WriteResult:
        """``touching``: the keys, or the range of keys, that the write looks at."""
        raise NotImplementedError

    def _met(self, version: Version, touching: DataFrame | KeyRange) -> DataFrame:
        """The version's rows that a write looks at (maybe more): few files, and few rows of them for a small batch."""
        if isinstance(touching, KeyRange):
            return self._store.rows(version, touching)
        return self._store.near(version, touching.select(*self._store.key))

    def _once(self, batch: DataFrame, *, first: bool = False) -> DataFrame:
        """One row for each key: the last in input order, or the first.

        That is the order of a sequence, or of a DataFrame's partitions; where it isn't one of rows, keys shouldn't repeat
        (``writes.last_wins`` picks by a column).
        """
        at = F.monotonically_increasing_id()
        order = F.col("__at") if not first else -F.col("__at")
        return writes.last_wins(batch.withColumn("__at", at), self._store.key, order).drop("__at")

    def _unique(self, batch: DataFrame) -> DataFrame:
        if not batch.groupBy(*self._store.key).count().where("count > 1").isEmpty():
            raise DuplicateKeyError("a key stands on more than one row of the batch")
        return batch

    def _rows(self, batch: DataFrame | Sequence[Any] | Mapping[Any, Any], columns: Sequence[str] | None = None) -> DataFrame:
        """A batch as a DataFrame: also a sequence of rows or, for a single key and value column, a mapping."""
        s = self._store
        columns = list(columns or s.schema.names)
        if isinstance(batch, Mapping):
            batch = list(batch.items())
        if not isinstance(batch, DataFrame):
            rows = [x if isinstance(x, (tuple, list, dict, Row)) else (x,) for x in batch]
            fields = [next((f for f in s.schema if f.name == c), None) for c in columns]
            batch = s.spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))
        return s.conform(batch, columns)

    def put_range(self, batch: DataFrame | Sequence[Any] | Mapping[Any, Any], *, batch_id: tuple[str, int] | None = None) -> WriteResult:
        """Upsert all rows at once; of rows with one key the last in input order stays."""
        rows = self._once(self._rows(batch))
        return self._run("put", lambda base: writes.put(base, rows, self._store.key), rows, batch_id)

    def put(self, *row: Any) -> bool:
        """Upsert one row; True if its key was new."""
        return self.put_range([row]).inserted == 1

    def try_insert(self, batch: DataFrame | Sequence[Any]) -> WriteResult:
        """Insert rows with absent keys; of rows with one key the first in input order counts."""
        rows = self._once(self._rows(batch), first=True)
        return self._run("insert", lambda base: writes.try_insert(base, rows, self._store.key), rows)

    get_or_add = try_insert

    def try_update(self, batch: DataFrame | Sequence[Any]) -> WriteResult:
        rows = self._once(self._rows(batch))
        return self._run("update", lambda base: writes.try_update(base, rows, self._store.key), rows)

    def update_with(self, keys: DataFrame | Sequence[Any], change: Callable[[Values], Values]) -> WriteResult:
        rows = self._unique(self._rows(keys, self._store.key))
        return self._run("update", lambda base: writes.update_with(base, rows, self._store.key, change), rows)

    def add_or_update(self, batch: DataFrame | Sequence[Any], change: Callable[[Values, Values], Values]) -> WriteResult:
        rows = self._unique(self._rows(batch))
        return self._run("add or update", lambda base: writes.add_or_update(base, rows, self._store.key, change), rows)

    def delete(self, keys: DataFrame | Sequence[Any]) -> WriteResult:
        """Remove keys; the outcome's ``old`` holds the removed values."""
        rows = self._rows(keys, self._store.key).distinct()
        return self._run("delete", lambda base: writes.delete(base, rows, self._store.key), rows)

    pop = delete

    def compare_and_swap(self, batch: DataFrame, *, expected: Mapping[str, str], equal: Callable[[Values, Values], Column] | None = None) -> WriteResult:
        rows = self._unique(self._rows(batch, [*self._store.schema.names, *[c for c in expected.values() if c not in self._store.schema.names]]))
        return self._run("swap", lambda base: writes.compare_and_swap(base, rows, self._store.key, expected=expected, equal=equal), rows)

    def delete_range(self, start: Any, end: Any) -> int:
        """Remove all rows from ``start`` to ``end``, both included; how many. An inverted range removes none."""
        wanted = KeyRange.of(start, end, width=len(self._store.key))
        if wanted.empty:
            return 0
        return self._run("delete range", lambda base: writes.delete(base, base.where(wanted.condition(self._store.key)).select(*self._store.key), self._store.key), wanted).deleted


class KeyedTable(Writer):
    """A versioned table with unique keys."""

    def __init__(self, store: Store):
        self._store = store
        self._closed = False
        self._transactions: set[Transaction] = set()
        self._snapshots: set[Snapshot] = set()
        self._pool = ThreadPoolExecutor(1, thread_name_prefix="rangeloom-commit")
        self._compacting = threading.Lock()
        self._folding: Future | None = None

    # lifecycle
    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType | str, key: str | Sequence[str], options: Options | None = None) -> KeyedTable:
        options = options or Options()
        options.validate()
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        key = [key] if isinstance(key, str) else list(key)
        if not key or any(k not in schema.names for k in key):
            raise SchemaError(f"key columns {key} aren't all in {schema.names}")
        if any(isinstance(schema[k].dataType, (T.MapType, T.ArrayType, T.StructType, T.DoubleType, T.FloatType)) for k in key):
            raise SchemaError("key columns must be atomic and not floating point")
        if any(c.startswith("__") or c in (writes.OP, writes.EXISTED, writes.OLD) for c in schema.names):
            raise SchemaError(f"column names op, existed, old and those starting with __ are taken: {schema.names}")
        store = Store(spark, path, options)
        store.manifest.create({"schema": T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]).jsonValue(), "key": key})
        return KeyedTable.open(spark, path, options)

    @staticmethod
    def open(spark: SparkSession, path: str, options: Options | None = None) -> KeyedTable:
        """Opens the newest complete version; what an unfinished write left is ignored."""
        options = options or Options()
        options.validate()
        store = Store(spark, path, options)
        store.load()
        return KeyedTable(store)

    def close(self) -> None:
        """Idempotent; operations afterwards raise ClosedError. Commits are durable when they return: nothing to flush."""
        if not self._closed:
            self._closed = True
            self._pool.shutdown(wait=True)

    def __enter__(self) -> KeyedTable:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def _open(self) -> Store:
        if self._closed:
            raise ClosedError("the table is closed")
        return self._store

    def flush(self) -> None:
        """Commits are durable when they return."""
        self._open()

    @property
    def schema(self) -> T.StructType:
        return self._store.schema

    @property
    def key(self) -> list[str]:
        return self._store.key

    # reads
    def view(self, version: int | None = None) -> TableView:
        store = self._open()
        return TableView(store, store.manifest.latest() if version is None else store.manifest.at(version))

    def __getattr__(self, name: str) -> Any:
        """Reads go to a view of the newest version, which stays as it is while the DataFrame lives."""
        if name.startswith("_") or not hasattr(TableView, name):
            raise AttributeError(name)
        return getattr(self.view(), name)

    def __getitem__(self, key: Any) -> Row:
        return self.view()[key]

    def __contains__(self, key: Any) -> bool:
        return self.view().contains(key)

    def __len__(self) -> int:
        return self.view().count()

    def __iter__(self):
        return iter(self.view())

    # writes
    def _run(self, what: str, build: Callable[[DataFrame], DataFrame], touching: DataFrame | KeyRange, batch: tuple[str, int] | None = None) -> WriteResult:
        store = self._open()
        for attempt in range(store.options.retries + 1):
            version = store.manifest.latest()
            if batch and version.batches.get(batch[0], -1) >= batch[1]:
                return WriteResult(version.number, store.spark.createDataFrame([], store.schema), 0, 0, 0, 0)
            with store.manifest.held(version.number):
                staged = store.stage(build(self._met(version, touching)))
            done = WriteResult(version.number, staged.outcome, staged.inserted, staged.updated, staged.deleted, staged.unchanged)
            if not staged.files and not batch:
                return done
            try:
                new = store.manifest.commit(version, what=what, rows=version.rows + staged.inserted - staged.deleted, deltas=[staged.files], batches=dict([batch]) if batch else None)
            except ConflictError:
                if attempt == store.options.retries:
                    raise
                continue
            if store.options.fold_after and len(new.deltas) >= store.options.fold_after:
                if sum(f.size for f in self._under(new)) <= store.options.fold_bytes:
                    self._fold()
                elif not self._folding or self._folding.done():
                    self._folding = self._pool.submit(self._fold)
            return WriteResult(new.number, done.outcome, done.inserted, done.updated, done.deleted, done.unchanged)
        raise AssertionError

    def load(self, rows: DataFrame, *, unique: bool = False) -> int:
        """Fill an empty table with base files straight away: how many rows. Of rows with one key the last in input order
        stays; ``unique`` says that there are none, which saves a shuffle (``validate`` finds out if that is wrong)."""
        store = self._open()
        version = store.manifest.latest()
        if version.rows or version.files:
            raise KeyedTableError("the table holds rows; use put_range")
        rows = store.conform(rows, store.schema.names)
        base = store.write_base(rows if unique else self._once(rows))
        if any(x is None for f in base for x in f.least):
            raise NullKeyError("a key of the batch is null")
        return store.manifest.commit(version, what="load", rows=sum(f.rows for f in base), base=base).rows

    def _warn(self, text: str) -> None:
        log.warning(text)
        if self._store.options.on_warning:
            self._store.options.on_warning(text)

    # snapshots and transactions
    def snapshot(self, version: int | None = None) -> Snapshot:
        store = self._open()
        return Snapshot(self, store.manifest.latest() if version is None else store.manifest.at(version))

    def transaction(self, *, serializable: bool = False) -> Transaction:
        return Transaction(self, self._open().manifest.latest(), serializable)

    def scope(self) -> Scope:
        return Scope(self.transaction())

    def diff(self, before: int, after: int) -> DataFrame:
        """What changed between two versions."""
        store = self._open()
        return writes.version_diff(store.rows(store.manifest.at(before)), store.rows(store.manifest.at(after)), store.key)

    # maintenance
    @staticmethod
    def _under(version: Version) -> list[DataFile]:
        """Base files that hold keys between the least and greatest of some delta file."""
        return [f for f in version.base if any(f.meets(KeyRange(d.least, d.greatest)) for delta in version.deltas for d in delta)]

    def _fold(self) -> None:
        try:
            self.checkpoint()
        except ConflictError:
            self._warn("the deltas were folded by another writer at the same time")

    def checkpoint(self) -> int:
        """Fold the deltas into the base files whose keys they meet; other base files stay, and so do deltas that are
        committed meanwhile. The version afterwards."""
        store = self._open()
        version = store.manifest.latest()
        changed = [f for d in version.deltas for f in d]
        if not changed:
            return version.number
        met = self._under(version)
        folded = {f.path for f in met}
        # new files don't reach over ones that stay
        stay = [f.path not in folded for f in version.base]
        apart = [f.least for f, here, before in zip(version.base, stay, [False, *stay], strict=False) if here and not before]
        with store.manifest.held(version.number):
            base = store.write_base(store.rows(store._only(version, met)), apart)
        return store.manifest.commit(version, what="fold", rows=version.rows, base=base, remove=[f.path for f in (*met, *changed)], rebase=True).number

    def compact(self) -> CompactionResult:
        """Rewrite all rows as base files in key order, then drop files that nothing needs. Writes may go on meanwhile."""
        store = self._open()
        if not self._compacting.acquire(blocking=False):
            raise MaintenanceError("a compaction is running")
        try:
            began, version = time.time(), store.manifest.latest()
            with store.manifest.held(version.number):
                if store.options.on_compaction_started:
                    store.options.on_compaction_started()
                base = store.write_base(store.rows(version))
            new = store.manifest.commit(version, what="compact", rows=sum(f.rows for f in base), base=base, remove=[f.path for f in version.files], rebase=True)
            removed, saved = self.vacuum(older_than_seconds=store.options.retain_seconds)
            result = CompactionResult(saved, removed, time.time() - began, new.number)
            if store.options.on_compaction_completed:
                store.options.on_compaction_completed(result)
            return result
        finally:
            self._compacting.release()

    def vacuum(self, *, keep_versions: int = 1, older_than_seconds: float = 0) -> tuple[int, int]:
        """Delete data files that neither the last versions nor leased ones nor unfinished writes need: (files, bytes)."""
        store = self._open()
        # in this order: what is committed in between was marked before, and is named in the log by now
        there = store.files.walk("data")
        staged = store.manifest.staged(store.options.lease_seconds)
        numbers = store.manifest.numbers()[-keep_versions:]
        needed = {f.path for n in {*numbers, *store.manifest.leased(store.options.lease_seconds)} for f in store.manifest.at(n).files}
        limit = (time.time() - older_than_seconds) * 1000
        gone = [(p, n) for p, n, at in there if p not in needed and p.endswith(".parquet") and at <= limit and "/".join(p.split("/")[:2]) not in staged]
        for p, _ in gone:
            store.files.delete(p)
        return len(gone), sum(n for _, n in gone)

    def statistics(self) -> Statistics:
        store = self._open()
        v = store.manifest.latest()
        return Statistics(v.number, v.rows, len(v.base), sum(map(len, v.deltas)), v.delta_rows, sum(f.size for f in v.files), len(store.manifest.numbers()), len(self._transactions), len(self._snapshots))

    def history(self) -> list[dict]:
        return self._open().manifest.history()

    def validate(self) -> ValidationResult:
        """Keys unique and not null, counts and spans as the manifest has them, base files disjoint and sorted."""
        store = self._open()
        version = store.manifest.latest()
        errors = []
        for a, b in zip(version.base, version.base[1:], strict=False):
            if not a.greatest < b.least:
                errors.append(f"base files overlap: {a.path} ends at {a.greatest}, {b.path} starts at {b.least}")
        report = key_report(store.rows(version), store.key).first()
        if report["n_repeated"]:
            errors.append(f"{report['n_repeated']} rows repeat a key")
        if report["n_null"]:
            errors.append(f"{report['n_null']} rows have a null key")
        if report["n_rows"] != version.rows:
            errors.append(f"{report['n_rows']} rows are there, the manifest has {version.rows}")
        if version.base:
            whole = F.struct(*store.key)
            found = store._read(version.base).groupBy("_metadata.file_path").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.count("*").alias("n")).collect()
            spans = {r["file_path"].split("/data/", 1)[1]: r for r in found}
            for f in version.base:
                r = spans.get(f.path.removeprefix("data/"))
                if r is None or r["n"] != f.rows or store._extreme(r["lo"]) != f.least or store._extreme(r["hi"]) != f.greatest:
                    errors.append(f"{f.path} isn't what the manifest has")
        return ValidationResult(tuple(errors))


class Snapshot(TableView):
    """Reads of one version that stay possible, whatever is written or compacted, until it is closed."""

    def __init__(self, table: KeyedTable, version: Version):
        super().__init__(table._store, version)
        self._table, self._lease = table, uuid.uuid4().hex
        self.store.manifest.lease(version.number, self._lease)
        table._snapshots.add(self)

    def close(self) -> None:
        if self._lease:
            self.store.manifest.release(self._lease)
            self._lease = ""
            self._table._snapshots.discard(self)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def _within(self, wanted: KeyRange) -> DataFrame:
        if not self._lease:
            raise ClosedError("the snapshot is closed")
        return super()._within(wanted)

    def _end_of(self, n: int, greatest: bool, wanted: KeyRange) -> DataFrame:
        if not self._lease:
            raise ClosedError("the snapshot is closed")
        return super()._end_of(n, greatest, wanted)


class Transaction(Writer):
    """Several operations that commit together, or not at all.

    Reads see the version at its start and its own writes. Commit raises ConflictError if any commit came in between
    and it has writes; with ``serializable`` also if it only read and such a commit touched a range that it read.
    """

    def __init__(self, table: KeyedTable, version: Version, serializable: bool):
        self._table, self._store, self._start, self._serializable = table, table._store, version, serializable
        self._staged: list[Staged] = []
        self._read: list[KeyRange] = []
        self._finished = False
        self._lease = uuid.uuid4().hex
        self._store.manifest.lease(version.number, self._lease)
        table._transactions.add(self)

    def _staged_files(self) -> list[DataFile]:
        return [f for s in self._staged for f in s.files]

    def _now(self) -> Version:
        if self._finished:
            raise FinishedError("the transaction is over")
        grown = sum(s.inserted - s.deleted for s in self._staged)
        return Version(self._start.number, self._start.rows + grown, self._start.base, self._start.deltas).with_deltas([s.files for s in self._staged])

    def view(self) -> TableView:
        version, store = self._now(), self._store
        seen = TableView(store, version)

        def source(wanted: KeyRange) -> DataFrame:
            self._read.append(wanted)
            return store.rows(version, wanted)

        seen._source = source
        whole = KeyRange()
        for name in ("page", "count", "_met_by"):
            inner = getattr(seen, name)
            setattr(seen, name, lambda *a, f=inner, **b: (self._read.append(whole), f(*a, **b))[1])
        inner_count = seen.count_range
        seen.count_range = lambda start=None, end=None, **b: (self._read.append(seen._range(start, end, **b)), inner_count(start, end, **b))[1]
        return seen

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_") or not hasattr(TableView, name):
            raise AttributeError(name)
        return getattr(self.view(), name)

    def __getitem__(self, key: Any) -> Row:
        return self.view()[key]

    def __len__(self) -> int:
        return self.view().count()

    def _run(self, what: str, build: Callable[[DataFrame], DataFrame], touching: DataFrame | KeyRange, batch: Any = None) -> WriteResult:
        staged = self._store.stage(build(self._met(self._now(), touching)))
        self._staged.append(staged)
        return WriteResult(self._start.number, staged.outcome, staged.inserted, staged.updated, staged.deleted, staged.unchanged)

    insert = Writer.put
    insert_range = Writer.put_range
    try_delete = Writer.delete

    def commit(self) -> int:
        """The version committed (the one read, if nothing was written)."""
        now = self._now()
        manifest = self._store.manifest
        try:
            deltas = [s.files for s in self._staged if s.files]
            if deltas:
                return manifest.commit(self._start, what="transaction", rows=now.rows, deltas=deltas).number
            if self._serializable:
                latest = manifest.latest()
                seen = {f.path for f in self._start.files}
                if any(f.meets(r) for f in latest.files if f.path not in seen for r in self._read):
                    raise ConflictError(self._start.number, latest.number, "what the transaction read")
            return self._start.number
        finally:
            self._end()

    def commit_async(self) -> Future:
        return self._table._pool.submit(self.commit)

    def rollback(self) -> None:
        """Drop what was written; idempotent."""
        if not self._finished:
            for folder in {"/".join(f.path.split("/")[:2]) for f in self._staged_files()}:
                self._store.files.delete(folder)
            self._store.manifest.settle(self._staged_files())
            self._end()

    def _end(self) -> None:
        self._finished = True
        self._store.manifest.release(self._lease)
        self._table._transactions.discard(self)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *_: Any) -> None:
        self.rollback()


class Scope:
    """A transaction that commits at the end of its ``with`` block if ``complete`` was called, else rolls back."""

    def __init__(self, transaction: Transaction):
        self._transaction, self._complete = transaction, False

    def complete(self) -> None:
        self._complete = True

    def __getattr__(self, name: str) -> Any:
        if name in ("commit", "commit_async", "rollback"):
            raise AttributeError(f"a scope has no {name}; call complete()")
        return getattr(self._transaction, name)

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if self._complete and kind is None:
            self._transaction.commit()
        else:
            self._transaction.rollback()


def describe(result: Any) -> dict:
    """A result dataclass as a dict, DataFrames left out."""
    return {k: v for k, v in asdict(result).items() if not isinstance(v, DataFrame)}
