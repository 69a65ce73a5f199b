"""Scans: filter, project, group, order, window, semi-join, count; all of it one lazy DataFrame plan.

A scan of files knows the order of its rows (file, then row); a scan of a DataFrame knows
the order that it is told.  Scans may be used again: each step gives a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as schemas
from ..errors import QueryError, SchemaError, TooManyValuesError
from ..functions.predicates import FLOATS, Fields, Predicate, Sym, quoted
from .aggregates import Chosen, Group, Plan, Result, bounds, grid, histogram

FILE, ROW = "__file", "__row"


class Scan:
    def __init__(self, df: DataFrame, order: Iterable[str] = (), filtered: tuple[Predicate, ...] = (), how: str = "", lean: DataFrame | None = None) -> None:
        self._df, self._order, self._filtered, self._how = df, tuple(order), filtered, how
        #: The same rows without the columns that order them, for answers that ask for no order: files need not tell their rows' places
        self._lean = df if lean is None else lean

    # -- sources -------------------------------------------------------------------------

    @staticmethod
    def parquet(spark: SparkSession, *paths: str, record: T.StructType | None = None, columns: Iterable[str] = ()) -> Scan:
        """Parquet files; record binds their columns by name, columns names some (none: all) in file order."""
        read = spark.read.parquet(*paths)
        df = read.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        return Scan(df, (FILE, ROW), lean=read)._narrow(record, columns)

    @staticmethod
    def of(df: DataFrame, order: Iterable[str] = (), record: T.StructType | None = None, columns: Iterable[str] = ()) -> Scan:
        """Any DataFrame; order names columns that put its rows in order."""
        order = tuple(order)
        return Scan(df.withColumns({f"__o{i}": F.col(c) for i, c in enumerate(order)}), [f"__o{i}" for i in range(len(order))])._narrow(record, columns)

    @staticmethod
    def union(*scans: Scan) -> Scan:
        """Several scans of one schema as one, their rows one after another."""
        kinds = {tuple((f.name, f.dataType) for f in s.schema) for s in scans}
        if len(kinds) != 1:
            raise SchemaError("scans of different columns cannot be one")
        ordered = all(s._order and len(s._order) == len(scans[0]._order) for s in scans)
        parts = []
        for i, s in enumerate(scans):
            own = [F.col(o).alias(f"__o{k + 1}") for k, o in enumerate(s._order)] if ordered else []
            parts.append(s._df.select(*(F.col(f"`{c}`") for c in s.columns), F.lit(i).alias("__o0"), *own))
        df = reduce(DataFrame.unionByName, parts)
        lean = reduce(DataFrame.unionByName, (s.df for s in scans))
        return Scan(df, [f"__o{k}" for k in range(len(scans[0]._order) + 1)] if ordered else (), lean=lean)

    def _narrow(self, record: T.StructType | None, columns: Iterable[str]) -> Scan:
        hidden = [F.col(o) for o in self._order]
        if record is not None:
            bound = schemas.bind(self._df, T.StructType([*record]), trust_nullable=True)
            names = {f.name: f for f in bound.schema}
            picked = [F.col(f"`{schemas.resolve(self._df.schema, f.name)}`").cast(f.dataType).alias(f.name, metadata=names[f.name].metadata) for f in record]
            return Scan(self._df.select(*picked, *hidden), self._order, self._filtered, lean=self._lean.select(*picked))
        wanted = list(columns)
        if not wanted:
            return self
        for c in wanted:
            schemas.field_at(self.schema, c)
        places = {name: i for i, name in enumerate(self.columns)}
        wanted.sort(key=lambda c: places.get(c, places.get(c.split(".")[0], 0)))
        picked = [quoted(c).alias(c) if c not in places else F.col(f"`{c}`") for c in wanted]
        return Scan(self._df.select(*picked, *hidden), self._order, self._filtered, lean=self._lean.select(*picked))

    # -- shape ---------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self._df.schema if not f.name.startswith("__")])

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def fields(self) -> Fields:
        return Fields(self.schema)

    @property
    def df(self) -> DataFrame:
        """The rows as a DataFrame."""
        return self._lean.select(*(F.col(f"`{c}`") for c in self.columns))

    def _with(self, df: DataFrame, lean: DataFrame | None = None, more: tuple = (), how: str | None = None) -> Scan:
        return Scan(df, self._order, self._filtered + more, self._how if how is None else how, lean)

    def _row_order(self, back: bool = False) -> list[Column]:
        if not self._order:
            raise QueryError("the rows have no order: scan files, or name one")
        return [F.col(o).desc() if back else F.col(o) for o in self._order]

    # -- rows ----------------------------------------------------------------------------

    def _predicate(self, question, parameters: tuple = ()) -> Predicate:
        if isinstance(question, str):
            from ..plans.grammar import parse

            return parse(question, self.schema, parameters)
        found = question(self.fields) if callable(question) and not isinstance(question, Predicate) else question
        if not isinstance(found, Predicate):
            raise SchemaError(f"{found!r} is no predicate")
        for c in found.columns:
            if c.startswith("__a") or c.startswith("__k"):
                raise QueryError("a filter of rows cannot name an aggregate; filter the groups")
        return found

    def where(self, question, *parameters) -> Scan:
        """Rows where it is true: a function of the fields, a predicate, or text with ?N for parameters."""
        p = self._predicate(question, parameters)
        return self._with(self._df.where(p.column), self._lean.where(p.column), more=(p,))

    def rows(self, start: int, stop: int) -> Scan:
        """Rows from start to before stop, in row order, clipped to what there is."""
        return self._numbered(lambda n: (n >= start) & (n < stop), "rows")

    def rows_at(self, *numbers: int) -> Scan:
        """The rows of these numbers, sorted, each once."""
        wanted = sorted(set(numbers))
        if any(n < 0 for n in wanted):
            raise QueryError("rows are numbered from 0")
        if len(wanted) <= 10_000:
            return self._numbered(lambda n: n.isin(wanted), "rows_at")
        scan = self._numbered(None, "rows_at")
        listed = self.spark.createDataFrame([(n,) for n in wanted], "__n long")
        return self._with(scan._df.join(listed, "__n", "left_semi").drop("__n"), how="rows_at")

    def _numbered(self, keep: Callable | None, how: str) -> Scan:
        if self._how in ("rows", "rows_at"):
            raise QueryError("rows are chosen by range or by number, once")
        if self._how == "ordered":
            raise QueryError("an order and a choice of rows do not go together")
        if self._filtered:
            raise QueryError("choose rows before filtering them")
        if self._order == (FILE, ROW):
            files = self._df.groupBy(FILE).agg(F.max(ROW).alias("__last"))
            if files.limit(2).count() < 2:
                df = self._df.withColumn("__n", F.col(ROW))
            else:  # one row a file
                before = F.coalesce(F.sum(F.col("__last") + 1).over(Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                df = self._df.join(files.select(FILE, before.alias("__before")), FILE).withColumn("__n", F.col("__before") + F.col(ROW)).drop("__before")
        else:
            df = numbered(self._df, self._row_order())
        return self._with(df.where(keep(F.col("__n"))).drop("__n") if keep else df, how=how)

    def order_by(self, column, descending: bool = False) -> Scan:
        """Rows by one column, nulls last either way; ties in row order, reversed when descending."""
        s = self._symbol(column)
        if self._how in ("rows", "rows_at"):
            raise QueryError("an order and a choice of rows do not go together")
        if s.name not in self.columns and "." not in s.name:
            raise QueryError("a function of a column has no order of rows")
        key = s.column.desc_nulls_last() if descending else s.column.asc_nulls_last()
        tie = self._row_order(descending) if self._order else []
        return self._with(self._df.orderBy(key, *tie), how="ordered")

    def in_order(self, *columns, descending: bool = False) -> Scan:
        """Rows by several columns, such as the leading ones of a dataset's sort key; nulls last either way."""
        if self._how in ("rows", "rows_at"):
            raise QueryError("an order and a choice of rows do not go together")
        keys = [s.column.desc_nulls_last() if descending else s.column.asc_nulls_last() for s in map(self._symbol, columns)]
        return self._with(self._df.orderBy(*keys, *(self._row_order(descending) if self._order else [])), how="ordered")

    def take(self, n: int) -> Scan:
        df = self._df if self._how == "ordered" or not self._order else self._df.orderBy(*self._row_order())
        return self._with(df.limit(n), how="ordered")

    def skip(self, n: int) -> Scan:
        df = self._df if self._how == "ordered" or not self._order else self._df.orderBy(*self._row_order())
        return self._with(df.offset(n), how="ordered")

    def _symbol(self, column) -> Sym:
        found = column(self.fields) if callable(column) and not isinstance(column, Sym) else column
        return found if isinstance(found, Sym) else self.fields[found]

    # -- projections ---------------------------------------------------------------------

    def select(self, *columns, **named) -> Scan:
        """Columns, or functions of them, as a new scan in the same row order."""
        picked = [(s.name, s) for s in map(self._symbol, columns)] + [(n, self._symbol(c)) for n, c in named.items()]
        columns = [s.column.alias(n) for n, s in picked]
        return self._with(self._df.select(*columns, *(F.col(o) for o in self._order)), self._lean.select(*columns))

    def distinct(self) -> Scan:
        """Distinct rows: NaNs are one value, and both zeros."""
        keys = [F.when(F.col(f"`{f.name}`") == 0, F.lit(0.0).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, FLOATS) else F.col(f"`{f.name}`") for f in self.schema]
        return Scan(self.df.select(*keys).distinct())

    # -- semi-joins ----------------------------------------------------------------------

    def where_in(self, columns, other: Scan | DataFrame, most: int | None = None, negated: bool = False) -> Scan:
        """Rows whose column (or tuple of up to four) is among the rows of another question.

        Nulls match nothing; a null here is unknown, so negation keeps it out too.  There may be any
        number of values, as no machine holds them all, unless `most` is given: more distinct ones
        are refused then.  Small sets are broadcast by their size."""
        symbols = [self._symbol(c) for c in (columns if isinstance(columns, (list, tuple)) else [columns])]
        values, on = among(symbols, other.df if isinstance(other, Scan) else other)
        if most is not None and values.limit(most + 1).count() > most:
            raise TooManyValuesError(f"more than {most} values")
        if negated:
            known = reduce(lambda a, b: a & b, (s.column.isNotNull() for s in symbols))
            return self._with(self._df.where(known).join(values, on, "left_anti"), self._lean.where(known).join(values, on, "left_anti"))
        return self._with(self._df.join(values, on, "left_semi"), self._lean.join(values, on, "left_semi"))

    # -- answers -------------------------------------------------------------------------

    def count(self) -> int:
        return self._lean.count()

    def any(self) -> bool:
        return not self._lean.isEmpty()

    def _one(self, ask: Callable[[Group], Result]):
        return self.aggregate(lambda g: {"x": ask(g)}).first()["x"]

    def min(self, column):
        return self._one(lambda g: g.min(self._symbol(column)))

    def max(self, column):
        return self._one(lambda g: g.max(self._symbol(column)))

    def sum(self, column, exact: bool = False):
        return self._one(lambda g: g.sum(self._symbol(column), exact))

    def average(self, column):
        return self._one(lambda g: g.average(self._symbol(column)))

    def count_distinct(self, column) -> int:
        return self._one(lambda g: g.count_distinct(self._symbol(column)))

    def to_list(self) -> list:
        rows = (self._df if self._how == "ordered" or not self._order else self._df.orderBy(*self._row_order())).select(*(F.col(f"`{c}`") for c in self.columns)).collect()
        return [r[0] for r in rows] if len(self.columns) == 1 else rows

    def records(self) -> Iterator:
        """Rows one by one, a partition at a time."""
        return self.df.toLocalIterator()

    def batches(self, rows: int | None = None, ahead: bool = False) -> Iterator:
        """Arrow batches of up to so many rows, a partition of the result at a time; ahead: the next partition is made while one is read.

        In row order where an order was asked for; no more than a partition (two, ahead) is on this machine."""
        import pyarrow as pa

        def sent(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as writer:
                        writer.write_batch(batch.slice(at, rows or batch.num_rows))
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

        df = self._df.select(*(F.col(f"`{c}`") for c in self.columns)) if self._how == "ordered" else self.df
        for r in df.mapInArrow(sent, "batch binary").toLocalIterator(prefetchPartitions=ahead):
            yield pa.ipc.open_stream(bytes(r.batch)).read_next_batch()

    def aggregate(self, ask: Callable[[Group], dict[str, Result]]) -> DataFrame:
        """Several answers over all rows in one pass: a row of the named results."""
        return GroupedScan(self, []).select(ask)

    def distribution(self, column, error: float = 0.01) -> DataFrame:
        """The histogram of a column: lower, upper (excluded) and n of every bucket that holds values."""
        s = self._symbol(column)
        x = F.when(~F.isnan(s.column), s.column) if isinstance(s.kind, FLOATS) else s.column
        parts = grid(error)
        low, high = bounds(F.col("bucket"), parts)
        return histogram(self._lean, [], x.cast("double"), parts).select(low.alias("lower"), high.alias("upper"), "n")

    def paths(self, column: str) -> DataFrame:
        from ..functions.variant import paths

        return paths(self.df, column)

    def keys(self, column):
        from .cursor import KeyCursor

        return KeyCursor(self, self._symbol(column))

    # -- groups --------------------------------------------------------------------------

    def group_by(self, *keys, **named) -> GroupedScan:
        """Groups by columns or functions of them; a null is a group of its own."""
        found = [(s.name, s) for s in map(self._symbol, keys)] + [(n, self._symbol(k)) for n, k in named.items()]
        for name, s in found:
            if isinstance(s.kind, (T.VariantType, T.MapType)):
                raise SchemaError(f"{name}: {s.kind.simpleString()} is no key; read a path of it")
        return GroupedScan(self, found)

    # -- plans ---------------------------------------------------------------------------

    @property
    def logical(self) -> str:
        """The question in words."""
        said = f"rows, reading {', '.join(self.columns)}"
        return said + (", where " + " and ".join(p.text if len(self._filtered) == 1 else f"({p.text})" for p in self._filtered) if self._filtered else "")

    def explain(self) -> str:
        return explained(self.df)

    def cost(self) -> float:
        """Seconds to read what the plan reads, cold from an object store: 1.25 GB/s."""
        return planned_bytes(self.df) / 1.25e9

    def observed(self, name: str = "scan"):
        """The rows with an observation beside them: rows counted as the sink runs."""
        from pyspark.sql import Observation

        seen = Observation(name)
        return self.df.observe(seen, F.count("*").alias("rows")), seen


def among(symbols: list[Sym], values: DataFrame) -> tuple[DataFrame, Column]:
    """What a semi-join compares columns with: the distinct values that can match, as __v0 and on, and the condition."""
    if not 1 <= len(symbols) <= 4 or len(values.columns) != len(symbols):
        raise SchemaError("a semi-join compares one to four columns with as many")
    names = [f"__v{i}" for i in range(len(symbols))]
    for s, f in zip(symbols, values.schema, strict=True):
        if s.kind != f.dataType:
            raise SchemaError(f"{s.name} is {s.kind.simpleString()}, {f.name} is {f.dataType.simpleString()}")
    values = values.toDF(*names).dropna()
    for n, s in zip(names, symbols, strict=True):
        if isinstance(s.kind, FLOATS):
            values = values.where(~F.isnan(n))
    return values.distinct(), reduce(lambda a, b: a & b, (s.column == F.col(n) for s, n in zip(symbols, names, strict=True)))


@contextmanager
def cancellable(spark: SparkSession, name: str):
    """Jobs started inside belong to a group; the function given cancels them, from any thread."""
    context = spark.sparkContext
    context.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(name)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def explained(df: DataFrame) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def planned_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def numbered(df: DataFrame, order: list[Column], name: str = "__n") -> DataFrame:
    """Rows numbered from 0 in an order, without one task that sees them all: dealt by range, counted, then numbered within.

    The dealt rows are a table in the shared folder: ranges drawn a second time would be others."""
    from ..sources.shared import shared_folder

    spark = df.sparkSession
    keys = {f"__r{i}": c for i, c in enumerate(order)}
    dealt = df.withColumns(keys).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__part", F.spark_partition_id())
    path = shared_folder(spark)
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("__part", before.alias("__before"))  # one row a partition
    own = Window.partitionBy("__part").orderBy(*keys)
    return dealt.withColumn("__i", F.row_number().over(own) - 1).join(F.broadcast(first), "__part").withColumn(name, F.col("__before") + F.col("__i")).drop("__part", "__i", "__before", *keys)


class Keys:
    """The key of a group, by name: g.key.city; a single key stands for itself."""

    def __init__(self, names: list[str], symbols: list[Sym]) -> None:
        self._names, self._symbols = names, symbols

    def __getattr__(self, name: str) -> Sym:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return self._symbols[self._names.index(name)]

    def __getitem__(self, name) -> Sym:
        return self._symbols[name] if isinstance(name, int) else getattr(self, name)


class GroupedScan:
    """Groups, then operators on them in the order written: where, order_by, then_by, skip, take; then select."""

    def __init__(self, scan: Scan, keys: list[tuple[str, Sym]], steps: tuple = ()) -> None:
        self._scan, self._keys, self._steps = scan, keys, steps

    def _step(self, *step) -> GroupedScan:
        return GroupedScan(self._scan, self._keys, (*self._steps, step))

    def where(self, question: Callable[[Group], Predicate]) -> GroupedScan:
        return self._step("where", question)

    def order_by(self, by: Callable[[Group], Sym], descending: bool = False) -> GroupedScan:
        return self._step("order", by, descending)

    def then_by(self, by: Callable[[Group], Sym], descending: bool = False) -> GroupedScan:
        if not self._steps or self._steps[-1][0] not in ("order", "then"):
            raise QueryError("then_by follows an order")
        return self._step("then", by, descending)

    def skip(self, n: int) -> GroupedScan:
        return self._step("skip", n)

    def take(self, n: int) -> GroupedScan:
        return self._step("take", n)

    def _group(self) -> Group:
        scan = self._scan
        plan = Plan(scan._lean, [s.column for _, s in self._keys], [F.col(o) for o in scan._order], scan._df)
        symbols = []
        for i, (_, s) in enumerate(self._keys):
            key = Sym(f"__k{i}", s.kind, F.col(f"__k{i}"), columns=frozenset({f"__k{i}"}))
            symbols.append(key)
        key = symbols[0] if len(symbols) == 1 else Keys([n for n, _ in self._keys], symbols)
        if len(symbols) == 1:
            setattr(key, self._keys[0][0] if self._keys[0][0].isidentifier() else "value", key)
        return Group(plan, scan.schema, key)

    def select(self, ask: Callable[[Group], dict[str, Sym]] | None = None, **named) -> DataFrame:
        """A DataFrame of the named results; no results gives the keys."""
        group = self._group()
        wanted = dict(ask(group)) if ask else {}
        wanted |= {n: f(group) for n, f in named.items()}
        if not wanted:
            wanted = {n: Sym(f"__k{i}", s.kind, F.col(f"__k{i}")) for i, (n, s) in enumerate(self._keys)}
        steps = [(kind, what(group) if callable(what) else what, *rest) for kind, what, *rest in self._steps]
        for name, s in wanted.items():
            if isinstance(s, Chosen) or not isinstance(s, Sym):
                raise QueryError(f"{name}: name a result, or a column of a chosen row")
        df = group._plan.run()
        for k, (kind, what, *rest) in enumerate(steps):
            if kind == "where":
                df = df.where(what.column)
            elif kind == "order":
                chain = [(what, rest[0])]
                for later in steps[k + 1 :]:
                    if later[0] != "then":
                        break
                    chain.append((later[1], later[2]))
                df = df.orderBy(*(c for s, down in chain for c in ordering(s, down)))
            elif kind == "skip":
                df = df.offset(what)
            elif kind == "take":
                df = df.limit(what)
        return df.select(*(s.column.alias(n) for n, s in wanted.items()))

    def text(self, *aggregates: str) -> DataFrame:
        """Aggregates given as text; each column is named by its text."""
        if len(set(aggregates)) != len(aggregates):
            raise QueryError("the same aggregate twice")
        group = self._group()
        wanted = {n: Sym(f"__k{i}", s.kind, F.col(f"__k{i}")) for i, (n, s) in enumerate(self._keys)}
        from ..plans.grammar import aggregate

        for text in aggregates:
            name, column = aggregate(text)
            wanted[text] = {"count": lambda _: group.count(), "count_distinct": group.count_distinct, "sum": group.sum, "min": group.min, "max": group.max, "avg": group.average}[name](column)
        df = group._plan.run()
        return df.select(*(s.column.alias(n) for n, s in wanted.items()))


def ordering(s: Sym, descending: bool) -> list[Column]:
    """Nulls last either way; NaN above +inf, both zeros equal, text by bytes."""
    if isinstance(s.kind, (T.ArrayType, T.MapType, T.VariantType)):
        raise SchemaError(f"{s.kind.simpleString()} has no order")
    return [s.column.desc_nulls_last() if descending else s.column.asc_nulls_last()]
