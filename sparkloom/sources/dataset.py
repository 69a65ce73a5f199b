"""Versioned datasets: a log of commits over Parquet files.

A version is a set of immutable objects (files).  Commits are files of the log written
only if their number is free, so writers need no lock: whoever loses re-reads the log,
re-applies what it meant and tries the next number.  Columns are stored under their field's
number, so renames and additions touch no file and old rows read new columns as null.

Rows lie in the order of their object's key, then of the file.  What the driver holds is the
list of objects with their summaries, never rows.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CommitConflictError, IntegrityError, QueryError, SchemaError, SourceOffsetConflictError
from ..functions.predicates import FLOATS, Fields, Predicate, Sym
from ..operators.scan import FILE, ROW, Scan, among
from ..schema import holds
from .shared import shared_folder
from .store import Store, bare

LOG, DATA, MARKS = "_log", "data", "marks"
#: Versions from one whole list of objects to the next, commits tried, text kept in summaries.
CHECKPOINT, ATTEMPTS, TEXT = 16, 20, 64
#: Marked rows up to which Spark may send them to all tasks, and rows in a task where they are joined by shuffle instead.
MARKS_SENT, MARKS_TASK = 1 << 17, 1 << 18
#: Rows that a task sorts, about: more of them are more tasks, and objects.
SORTED = 1 << 20
SUMMARIZED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, *FLOATS, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)
#: Spark's name of a null partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
APPLIED, ALREADY_THERE, ABANDONED = "Applied", "AlreadyThere", "Abandoned"


@dataclass(frozen=True)
class Layout:
    """How objects are cut and sorted: partition is a column or (column, unit or bucket width); sort_key names columns, nulls last."""

    partition: str | tuple | None = None
    sort_key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Object:
    """A file of the dataset: its name below the root, rows, bytes, summaries by field number."""

    key: str
    rows: int
    bytes: int
    level: int = 0
    partition: str | None = None
    summaries: dict = field(default_factory=dict)
    names: dict | None = None  # of an imported file: field number -> its own column name
    marks: str | None = None  # rows deleted by mark, and how many
    marked: int = 0


@dataclass
class State:
    version: int
    fields: list[dict]
    retired: list[str]
    layout: Layout
    sources: dict[str, int]
    objects: dict[str, Object]
    last_data_change: int

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField.fromJson(f["field"]) for f in self.fields])


@dataclass(frozen=True)
class Commit:
    outcome: str
    version: int
    rows: int = 0
    objects_in: int = 0
    objects_out: int = 0
    marked: int = 0


@dataclass(frozen=True)
class SourceRange:
    """Entries of a source that a commit consumed: after `start`, up to `stop`."""

    source: str
    start: int
    stop: int


def told(value):
    """A summary value as JSON."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if abs(value) < float("inf") else None
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def read_back(value, kind: T.DataType):
    if value is None or isinstance(kind, (T.StringType, T.BooleanType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, *FLOATS)):
        return value
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    return dt.date.fromisoformat(value) if isinstance(kind, T.DateType) else dt.datetime.fromisoformat(value)


class Dataset:
    def __init__(self, spark: SparkSession, store: Store, state: State) -> None:
        self.spark, self.store, self._state = spark, store, state

    # -- opening ---------------------------------------------------------------------------

    @staticmethod
    def create(spark: SparkSession, root: str, schema: T.StructType, layout: Layout | None = None) -> Dataset:
        store = Store(spark, root)
        fields = [{"id": i, "field": f.jsonValue()} for i, f in enumerate(schema)]
        state = State(1, fields, [], layout or Layout(), {}, {}, 1)
        dataset = Dataset(spark, store, state)
        names = schema.fieldNames()
        for c in (*state.layout.sort_key, *([dataset._partition_column()] if state.layout.partition else [])):
            if c not in names:
                raise SchemaError(f"the layout names no column: {c!r}")
        if not store.put_if_absent(_name(1), dataset._text(state, "create", [], [])):
            raise CommitConflictError(f"{root} holds a dataset already")
        return dataset

    @staticmethod
    def open(spark: SparkSession, root: str, version: int | None = None) -> Dataset:
        store = Store(spark, root)
        return Dataset(spark, store, _load(store, version))

    def refresh(self) -> int:
        self._state = _load(self.store, None)
        return self.version

    # -- what it is ------------------------------------------------------------------------

    @property
    def version(self) -> int:
        return self._state.version

    @property
    def schema(self) -> T.StructType:
        return self._state.schema()

    @property
    def layout(self) -> Layout:
        return self._state.layout

    @property
    def row_count(self) -> int:
        return sum(o.rows - o.marked for o in self._state.objects.values())

    @property
    def object_count(self) -> int:
        return len(self._state.objects)

    @property
    def last_data_change(self) -> int:
        """The version of the last commit that changed rows; compactions change none."""
        return self._state.last_data_change

    def objects(self) -> list[Object]:
        return [self._state.objects[k] for k in sorted(self._state.objects)]

    def object_table(self) -> DataFrame:
        first, rows = 0, []
        for o in self.objects():
            rows.append((o.key, o.level, o.partition, first, o.rows, o.bytes, o.marked))
            first += o.rows
        return self.spark.createDataFrame(rows, "key string, level int, partition string, first_row long, rows long, bytes long, marked long")

    def source_offset(self, source: str) -> int:
        """Up to where a source's entries are counted, in the version the handle holds."""
        return self._state.sources.get(source, 0)

    # -- reading ---------------------------------------------------------------------------

    def scan(self, columns: Iterable[str] = (), where=None, pruned: bool = True) -> Scan:
        """The version's rows.  A filter given here is also held against the objects' summaries, unless pruned is off: the answer is the same."""
        predicate = self._asked(where) if where is not None else None
        objects = [o for o in self.objects() if predicate is None or not pruned or predicate.outcomes(self._summaries(o))[0]]
        scan = Scan(self._read(objects), (FILE, ROW), lean=None if any(o.marks for o in objects) else self._read(objects, places=False))
        scan = scan.where(predicate) if predicate is not None else scan
        return scan._narrow(None, columns)

    def may_match(self, where) -> bool:
        """Whether a row may match, by summaries alone: nothing is read."""
        p = self._asked(where)
        return any(p.outcomes(self._summaries(o))[0] for o in self.objects())

    def _asked(self, where) -> Predicate:
        if isinstance(where, str):
            from ..plans.grammar import parse

            return parse(where, self.schema)
        return where(Fields(self.schema)) if callable(where) and not isinstance(where, Predicate) else where

    def _summaries(self, o: Object) -> dict:
        out = {}
        for f in self._state.fields:
            kind = T.StructField.fromJson(f["field"]).dataType
            name = f["field"]["name"]
            if str(f["id"]) in o.summaries:
                least, most, nulls = o.summaries[str(f["id"])]
                out[name] = read_back(least, kind), read_back(most, kind), nulls, o.rows
            elif not isinstance(kind, SUMMARIZED):
                continue
            elif o.summaries or not o.rows:
                out[name] = None, None, o.rows, o.rows  # the field came after the object: all null
        return out

    def _read(self, objects: list[Object], places: bool = True) -> DataFrame:
        """The objects' rows, with the places where they lie."""
        fields = [(f["id"], T.StructField.fromJson(f["field"])) for f in self._state.fields]
        if not objects:
            empty = T.StructType([*(T.StructField(f.name, f.dataType, True, f.metadata) for _, f in fields), *([T.StructField(FILE, T.StringType()), T.StructField(ROW, T.LongType())] if places else [])])
            return self.spark.createDataFrame([], empty)
        where = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)] if places else []
        kinds: dict[str, list[Object]] = {}
        for o in objects:
            kinds.setdefault(json.dumps(o.names, sort_keys=True), []).append(o)
        parts = []
        for names, own in kinds.items():
            named = json.loads(names)
            stored = [(named.get(str(i)) if named is not None else f"f{i}", f) for i, f in fields]
            physical = T.StructType([T.StructField(n, f.dataType) for n, f in stored if n])
            df = self.spark.read.schema(physical).parquet(*(self.store.path(o.key) for o in own))
            df = df.select(*((F.col(f"`{n}`") if n else F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata) for n, f in stored), *where)
            parts.append(df)
        df = parts[0]
        for more in parts[1:]:
            df = df.unionByName(more)
        marked = [o for o in objects if o.marks]
        if marked:
            marks = self.spark.read.parquet(*sorted({self.store.path(o.marks) for o in marked}))
            marks = marks.where(F.col("file").isin([o.key for o in marked])) if len(marked) <= 1000 else marks
            marks = marks.select(F.col("file").alias("__mf"), F.col("row").alias("__mr"))
            df = df.withColumn("__mk", self._key_of(FILE))
            if sum(o.marked for o in marked) > MARKS_SENT:  # few bytes in their file are many on the driver
                n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(o.rows for o in objects) // MARKS_TASK))
                df, marks = df.repartition(n, "__mk", ROW), marks.repartition(n, "__mf", "__mr").hint("merge")
            df = df.join(marks, (F.col("__mk") == F.col("__mf")) & (F.col(ROW) == F.col("__mr")), "left_anti").drop("__mk")
        return df

    def _key_of(self, path: str) -> Column:
        """The object's key of a file path as Spark tells it."""
        return F.substring(F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), len(self.store.bare_root) + 2, 1 << 20)

    # -- committing ------------------------------------------------------------------------

    def _text(self, s: State, what: str, added: list[Object], removed: list[str]) -> str:
        head = {"version": s.version, "operation": what, "at": int(time.time() * 1000), "fields": s.fields, "retired": s.retired, "layout": asdict(s.layout), "sources": s.sources, "last_data_change": s.last_data_change}
        return json.dumps(head | {"add": [asdict(o) for o in added], "remove": removed})

    def _commit(self, what: str, change: Callable[[State], tuple[list[Object], list[str], dict] | Commit], sources: Iterable[SourceRange] = (), data: bool = True) -> Commit:
        """Decides and writes the next version; change is asked again for each version it meets."""
        sources = list(sources)
        for _ in range(ATTEMPTS):
            state = self._state
            if sources:
                recorded = [(r, state.sources.get(r.source, 0)) for r in sources]
                if all(at >= r.stop for r, at in recorded):
                    return Commit(ALREADY_THERE, state.version)
                for r, at in recorded:
                    if at != r.start or r.stop < r.start:
                        raise SourceOffsetConflictError(r.source, at, state.version)
            decided = change(state)
            if isinstance(decided, Commit):
                return decided
            added, removed, head = decided
            version = state.version + 1
            objects = {k: o for k, o in state.objects.items() if k not in set(removed)} | {o.key: o for o in added}
            offsets = head.pop("sources", state.sources) | {r.source: r.stop for r in sources}
            new = replace(state, version=version, objects=objects, sources=offsets, last_data_change=version if data else state.last_data_change, **head)
            if self.store.put_if_absent(_name(version), self._text(new, what, added, removed)):
                if version % CHECKPOINT == 0:
                    self.store.put(f"{LOG}/checkpoint-{version:020d}.json", json.dumps([asdict(o) for o in objects.values()]))
                self._state = new
                return Commit(APPLIED, version, sum(o.rows for o in added), len(removed), len(added))
            self.refresh()
        raise CommitConflictError(f"{what}: {ATTEMPTS} commits lost their race")

    # -- writing ---------------------------------------------------------------------------

    def _partition_column(self) -> str:
        p = self.layout.partition
        return p if isinstance(p, str) else p[0]

    def _partition(self, schema: T.StructType) -> Sym | None:
        p = self.layout.partition
        if p is None:
            return None
        s = Fields(schema)[self._partition_column()]
        if isinstance(p, str):
            return s
        how = p[1]
        return s.truncate(how) if isinstance(how, str) and how in ("minute", "hour", "day", "week", "month", "quarter", "year") else s.bucket(how)

    def _write(self, df: DataFrame, level: int = 0, files: int | None = None, options: dict | None = None, rows: int | None = None) -> list[Object]:
        """Objects of the rows (their number is counted where it is not told): cut by partition, sorted by the sort key, summarized."""
        fields = self._state.fields
        physical = [F.col(f"`{f['field']['name']}`").alias(f"f{f['id']}") for f in fields]
        ids = {f["field"]["name"]: f"f{f['id']}" for f in fields}
        part = self._partition(self.schema)
        out = df.select(*physical, *([part.column.cast("string").alias("__p")] if part is not None else []))
        sort = [F.col(ids[c]).asc_nulls_last() for c in self.layout.sort_key]
        cut = [F.col("__p")] if part is not None else []
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if cut or sort:  # by range, so that a partition with most of the rows is cut by its sort key
            n = max(n, -(-(out.count() if rows is None else rows) // SORTED))
            out = out.repartitionByRange(n, *cut, *sort).sortWithinPartitions(*cut, *sort)
        elif files:
            out = out.coalesce(files)
        folder = f"{DATA}/{self.version + 1:020d}-{uuid.uuid4().hex}"
        writer = out.write.options(**(options or {}))
        (writer.partitionBy("__p") if cut else writer).parquet(self.store.path(folder))
        written = self.spark.read.schema(T.StructType([T.StructField(f"f{f['id']}", T.StructField.fromJson(f["field"]).dataType) for f in fields])).parquet(self.store.path(folder))
        return self._summarized(written, {str(f["id"]): f"f{f['id']}" for f in fields}, level, None, part is not None)

    def _summary(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """One row a file: rows, size, and nulls, least and greatest of each column.  No row is sorted or sent: a task holds its files' rows of these.

        A least text by itself would have Spark sort all rows by their file; beside an aggregate of objects (here of nothing) it stays in a map."""
        asked = [F.count("*").alias("rows"), F.max("__size").alias("size"), F.collect_set(F.lit(None).cast("int")).alias("nothing")]
        for i, n in names.items():
            c, kind = F.col(f"`{n}`"), df.schema[n].dataType
            asked.append(F.count_if(c.isNull()).alias(f"n{i}"))
            if isinstance(kind, SUMMARIZED):
                x = F.when(~F.isnan(c), c) if isinstance(kind, FLOATS) else c
                asked += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"m{i}")]
        known = df.withColumns({"__f": F.col("_metadata.file_path"), "__size": F.col("_metadata.file_size")})
        return known.groupBy("__f").agg(*asked).withColumn("key", self._key_of("__f"))

    def _summarized(self, df: DataFrame, names: dict[str, str], level: int, imported: dict | None, parted: bool = False) -> list[Object]:
        kinds = {i: df.schema[n].dataType for i, n in names.items()}
        out = []
        for r in self._summary(df, names).collect():  # one row a file
            summaries = {}
            for i, kind in kinds.items():
                if not isinstance(kind, SUMMARIZED):
                    continue
                least, most = r[f"l{i}"], r[f"m{i}"]
                if isinstance(kind, T.StringType) and (len(least or "") > TEXT or len(most or "") > TEXT):
                    least = most = None
                if isinstance(kind, T.TimestampType) and least is not None:
                    least, most = (x.astimezone(dt.UTC) for x in (least, most))
                summaries[i] = [told(least), told(most), r[f"n{i}"]]
            partition = unquote(r.key.split("/__p=")[1].split("/")[0]) if parted and "/__p=" in r.key else None
            partition = None if partition == NO_VALUE else partition
            out.append(Object(r.key, r.rows, r["size"], level, partition, summaries, imported))
        return sorted(out, key=lambda o: o.key)

    def _fits(self, df: DataFrame) -> DataFrame:
        have = {f.name: f for f in df.schema}
        columns = []
        for f in self.schema:
            if f.name not in have:
                if not f.nullable:
                    raise SchemaError(f"{f.name} is missing")
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
                continue
            if not holds(f.dataType, have[f.name].dataType):
                raise SchemaError(f"{f.name}: {have[f.name].dataType.simpleString()} does not fit {f.dataType.simpleString()}")
            columns.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        if extra := set(have) - {f.name for f in self.schema}:
            raise SchemaError(f"columns the dataset lacks: {sorted(extra)}")
        return df.select(*columns)

    def append(self, df: DataFrame | None, sources: Iterable[SourceRange] = ()) -> Commit:
        """Adds rows in one commit; with sources, each entry of a source counts once however many writers there are."""
        sources = list(sources)
        if sources and all(self._state.sources.get(r.source, 0) >= r.stop for r in sources):
            return Commit(ALREADY_THERE, self.version)
        made = self._write(self._fits(df)) if df is not None else []
        fields = [f["id"] for f in self._state.fields]

        def change(state: State):
            if not set(fields) <= {f["id"] for f in state.fields}:
                raise CommitConflictError("a column was dropped meanwhile")
            return made, [], {}

        return self._commit("append", change, sources)

    def import_file(self, path: str) -> Commit:
        """Adds an existing Parquet file as it is; its columns are found by name."""
        key = f"imports/{uuid.uuid4().hex}-{path.rstrip('/').rsplit('/', 1)[-1]}"
        found = self.spark.read.parquet(path)
        names = {}
        for f in self._state.fields:
            own = T.StructField.fromJson(f["field"])
            if own.name in found.columns:
                if found.schema[own.name].dataType != own.dataType:
                    raise SchemaError(f"{own.name}: {found.schema[own.name].dataType.simpleString()} is not {own.dataType.simpleString()}")
                names[str(f["id"])] = own.name
        self.store.move_in(path, key)
        made = self._summarized(self.spark.read.parquet(self.store.path(key)), names, 0, names)
        return self._commit("import", lambda _: (made, [], {}))

    def replace_objects(self, keys: Iterable[str], df: DataFrame | None) -> Commit:
        """Objects for rows: all of them are there and go, or none is and nothing happens."""
        keys = list(keys)
        made = self._write(self._fits(df)) if df is not None else []

        def change(state: State):
            there = [k for k in keys if k in state.objects]
            if not there:
                return Commit(ALREADY_THERE, state.version)
            return (made, keys, {}) if len(there) == len(keys) else Commit(ABANDONED, state.version)

        return self._commit("replace", change)

    def remove_objects(self, keys: Iterable[str]) -> Commit:
        return self.replace_objects(keys, None)

    # -- changing rows ---------------------------------------------------------------------

    def _rewrite(self, what: str, where, build: Callable[[DataFrame, Predicate], DataFrame] | None, sources: Iterable[SourceRange], mark: bool = False, values: tuple[DataFrame, Column] | None = None) -> Commit:
        """Deletes (no build) or rebuilds the rows where it is true, object by touched object; asked anew for each version met.

        values: deletes the rows that a semi-join with them finds; where says no more than which objects may hold some."""
        predicate = self._asked(where)
        sources = list(sources)
        kept = F.coalesce(predicate.column, F.lit(False))

        def hit(df: DataFrame) -> DataFrame:
            return df.where(kept) if values is None else df.join(*values, "left_semi")

        def missed(df: DataFrame) -> DataFrame:
            return df.where(~kept) if values is None else df.join(*values, "left_anti")

        for _ in range(ATTEMPTS):
            base = self._state
            may = [o for o in self.objects() if predicate.outcomes(self._summaries(o))[0]]
            hits = {r["key"]: r["n"] for r in hit(self._read(may)).groupBy(self._key_of(FILE).alias("key")).agg(F.count("*").alias("n")).collect()} if may else {}
            touched = [o for o in may if hits.get(o.key)]
            rows = sum(hits.values())
            made: list[Object] = []
            gone = [o.key for o in touched]
            marked = 0
            if touched and mark and build is None:
                name = f"{MARKS}/{self.version + 1:020d}-{uuid.uuid4().hex}"
                own = hit(self._read(touched)).select(self._key_of(FILE).alias("file"), F.col(ROW).alias("row"))
                before = sorted({o.marks for o in touched if o.marks})
                if before:
                    own = own.unionByName(self.spark.read.parquet(*map(self.store.path, before)).where(F.col("file").isin([o.key for o in touched])))
                own.write.parquet(self.store.path(name))
                made = [replace(o, marks=name, marked=o.marked + hits[o.key]) for o in touched]
                gone, marked = [], len(made)
            elif touched:
                whole = [o for o in touched if build is None and hits[o.key] == o.rows - o.marked]
                part = [o for o in touched if o not in whole]
                if part:
                    read = self._read(part)
                    changed = build(read, predicate) if build else missed(read)
                    made = self._write(changed, max(o.level for o in part), files=max(1, len(part)), rows=sum(o.rows for o in part))

            def change(state: State, base=base, made=made, gone=gone):
                if state.version != base.version:
                    return Commit("again", state.version)
                return made, gone, {}

            done = self._commit(what, change, sources)
            if done.outcome != "again":
                return replace(done, rows=rows if done.outcome == APPLIED else 0, marked=marked)
        raise CommitConflictError(f"{what}: {ATTEMPTS} commits lost their race")

    def delete(self, where, sources: Iterable[SourceRange] = (), mark: bool = False) -> Commit:
        """Deletes the rows where it is true: touched files are written anew, or (mark) the rows are listed as deleted."""
        return self._rewrite("delete", where, None, sources, mark)

    def delete_in(self, columns, other: Scan | DataFrame, sources: Iterable[SourceRange] = (), mark: bool = False) -> Commit:
        """Deletes the rows whose column (or tuple of up to four) is among the rows of another question, of any number; nulls match nothing.

        The question is asked once, into the shared folder: what is counted is then what is deleted, and the driver sees no value."""
        fields = Fields(self.schema)
        symbols = [fields[c] for c in (columns if isinstance(columns, (list, tuple)) else [columns])]
        values, on = among(symbols, other.df if isinstance(other, Scan) else other)
        path = shared_folder(self.spark)
        values.write.parquet(path)
        values = self.spark.read.schema(values.schema).parquet(path)
        told_apart = [(s, n) for s, n in zip(symbols, values.columns, strict=True) if isinstance(s.kind, SUMMARIZED) and not isinstance(s.kind, (T.BooleanType, T.TimestampType))]
        ends = values.agg(F.count("*").alias("n"), *(F.min(n).alias(f"least{n}") for _, n in told_apart), *(F.max(n).alias(f"most{n}") for _, n in told_apart)).first()
        reached = Predicate.all() if ends["n"] else Predicate.none()
        for s, n in told_apart if ends["n"] else []:
            reached = reached & s.between(ends[f"least{n}"], ends[f"most{n}"])
        return self._rewrite("delete", reached, None, sources, mark, (values, on))

    def update(self, where, changes: dict[str, Callable | Column], sources: Iterable[SourceRange] = ()) -> Commit:
        """Sets columns of the rows where it is true; a change is a Column, or a function from column-by-name to one."""
        schema = self.schema
        for c in changes:
            if c not in schema.fieldNames():
                raise SchemaError(f"no column {c!r}")

        def build(df: DataFrame, p: Predicate) -> DataFrame:
            new = {c: v(lambda n: F.col(f"`{n}`")) if callable(v) and not isinstance(v, Column) else v for c, v in changes.items()}
            return df.select(*(F.when(F.coalesce(p.column, F.lit(False)), new[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in new else F.col(f"`{f.name}`") for f in schema))

        return self._rewrite("update", where, build, sources)

    def evolve(self, schema: T.StructType, renames: dict[str, str] | None = None) -> int:
        """Declares the columns anew; renames gives a new name's old one.  Old rows read new columns as null; a name that went never comes back."""
        renames = renames or {}

        def change(state: State):
            old = {f["field"]["name"]: f for f in state.fields}
            for new_name, old_name in renames.items():
                if old_name not in old or new_name not in schema.fieldNames():
                    raise SchemaError(f"no rename of {old_name!r} to {new_name!r}")
            kept, number = [], 1 + max([f["id"] for f in state.fields] + [int(r.split(":")[1]) for r in state.retired], default=-1)
            retired = {r.split(":")[0] for r in state.retired}
            for f in schema:
                before = old.get(renames.get(f.name, f.name if f.name not in renames.values() else ""))
                if before is not None:
                    if T.StructField.fromJson(before["field"]).dataType != f.dataType:
                        raise SchemaError(f"{f.name}: a column keeps its type")
                    kept.append({"id": before["id"], "field": f.jsonValue()})
                    continue
                if f.name in retired or f.name in old:
                    raise SchemaError(f"{f.name!r} is the name of a column that went")
                if not f.nullable:
                    raise SchemaError(f"{f.name}: old rows read a new column as null")
                kept.append({"id": number, "field": f.jsonValue()})
                number += 1
            ids = {f["id"] for f in kept}
            names = {f["field"]["name"] for f in kept}
            gone = [f"{f['field']['name']}:{f['id']}" for f in state.fields if f["id"] not in ids or f["field"]["name"] not in names]
            for c in (*state.layout.sort_key, *([self._partition_column()] if state.layout.partition else [])):
                if renames and c in renames.values() or c not in names:
                    raise SchemaError(f"the layout needs {c!r}")
            return [], [], {"fields": kept, "retired": sorted({*state.retired, *gone})}

        return self._commit("evolve", change).version

    def expire(self, where) -> Commit:
        """Drops the objects whose every row is proven to match by summaries alone; nothing is read, and text proves nothing."""
        predicate = self._asked(where)

        def change(state: State):
            gone = []
            for o in state.objects.values():
                summaries = {n: s for n, s in self._summaries(o).items() if not isinstance(s[0], str) and not isinstance(s[1], str)}
                true, false, unknown = predicate.outcomes(summaries)
                if true and not false and not unknown and o.rows:
                    gone.append(o.key)
            return ([], sorted(gone), {}) if gone else Commit(ALREADY_THERE, state.version)

        return self._commit("expire", change)

    def forget_sources(self, *sources: str) -> Commit:
        return self._commit("forget", lambda s: ([], [], {"sources": {k: v for k, v in s.sources.items() if k not in sources}}), data=False)

    # -- in parts --------------------------------------------------------------------------

    def ask_by_values(self, ask: Callable[[Scan], object], newest_first: bool = True) -> Iterator[tuple[str | None, object, float]]:
        """The question over each partition value, the newest first: value, exact answer, share of rows covered so far."""
        by: dict[str | None, list[Object]] = {}
        for o in self.objects():
            by.setdefault(o.partition, []).append(o)
        total, seen = max(1, self.row_count), 0
        for value in sorted(by, key=lambda v: v or "", reverse=newest_first):
            answer = ask(Scan(self._read(by[value]), (FILE, ROW)))
            seen += sum(o.rows - o.marked for o in by[value])
            yield value, answer, seen / total


def _name(version: int) -> str:
    return f"{LOG}/{version:020d}.json"


def _load(store: Store, version: int | None) -> State:
    names = [n.rsplit("/", 1)[-1] for n, _, _ in store.list(LOG)]
    commits = sorted(int(n[:20]) for n in names if n[:20].isdigit() and len(n) == 25)
    if not commits:
        raise IntegrityError(f"{store.root} holds no dataset")
    last = commits[-1] if version is None else version
    if last not in commits:
        raise IntegrityError(f"{store.root} has no version {last}")
    start = max((int(n[11:31]) for n in names if n.startswith("checkpoint-") and int(n[11:31]) <= last), default=0)
    objects = {o["key"]: Object(**o) for o in json.loads(store.get(f"{LOG}/checkpoint-{start:020d}.json"))} if start else {}
    head: dict = {}
    for v in range(max(start, 1), last + 1):
        if v not in commits:
            raise IntegrityError(f"{store.root} lacks the commit of version {v}")
        head = json.loads(store.get(_name(v)))
        if v > start:
            for k in head["remove"]:
                objects.pop(k, None)
            objects |= {o["key"]: Object(**o) for o in head["add"]}
    layout = head["layout"]
    p = layout["partition"]
    return State(last, head["fields"], head["retired"], Layout(tuple(p) if isinstance(p, list) else p, tuple(layout["sort_key"])), head["sources"], objects, head["last_data_change"])


class DatasetSet:
    """Several datasets of one schema read as one, their rows one after another."""

    def __init__(self, *datasets: Dataset) -> None:
        if len({d.schema.simpleString() for d in datasets}) != 1:
            raise SchemaError("datasets of different schemas cannot be one")
        self.datasets = datasets

    def scan(self, columns: Iterable[str] = ()) -> Scan:
        return Scan.union(*(d.scan(columns) for d in self.datasets))

    def refresh(self) -> list[int]:
        return [d.refresh() for d in self.datasets]

    @property
    def row_count(self) -> int:
        return sum(d.row_count for d in self.datasets)


__all__ = ["ABANDONED", "ALREADY_THERE", "APPLIED", "Commit", "Dataset", "DatasetSet", "Layout", "Object", "SourceRange", "bare", "QueryError"]
