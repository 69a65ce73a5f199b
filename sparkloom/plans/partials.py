"""A grouped question in parts: states that other processes compute and that merge in any order or tree.

A part holds no answers but states: counts, exact sums, counts of values, least and greatest,
buckets of quantiles, sketches of distinct counts.  Filters, orders and windows of groups apply
after the merge.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IntegrityError, UnsupportedError
from ..functions.predicates import FLOATS, INTS, Sym
from ..operators.aggregates import bucket_of, grid
from ..operators.scan import FILE, Scan

#: Aggregates whose states answer them whole.
MERGED = ("count", "sum", "min", "max", "average", "quantile", "approximate_count_distinct")
SKETCH = 14


@dataclass(frozen=True)
class Measure:
    """What is asked: an aggregate of a column under a name."""

    name: str
    how: str
    column: str | None = None
    q: float = 0.5
    error: float = 0.01


class Question:
    """Keys and measures over any scan of the same columns; every process builds the same one."""

    def __init__(self, keys: dict[str, object], *measures: Measure) -> None:
        for m in measures:
            if m.how not in MERGED:
                raise UnsupportedError(f"{m.how} takes no parts")
        self.keys, self.measures = keys, measures

    @property
    def text(self) -> str:
        return json.dumps([sorted(self.keys), [m.__dict__ for m in self.measures]])

    # -- states ------------------------------------------------------------------------

    def _symbols(self, scan: Scan) -> dict[str, Sym]:
        return {m.name: scan._symbol(m.column) for m in self.measures if m.column}

    def states(self, scan: Scan) -> tuple[DataFrame, DataFrame | None]:
        """One row of states a group, and the buckets of its quantiles."""
        symbols = self._symbols(scan)
        keyed = scan._lean.withColumns({n: scan._symbol(k).column for n, k in self.keys.items()})
        columns: list[Column] = [F.count("*").alias("__n")]
        buckets = []
        for m in self.measures:
            if m.how == "count":
                continue
            s = symbols[m.name]
            if isinstance(s.kind, T.DecimalType) and m.how in ("sum", "average"):
                raise UnsupportedError(f"{m.name}: a decimal sum takes no parts")
            x = F.when(~F.isnan(s.column), s.column) if isinstance(s.kind, FLOATS) else s.column
            if m.how in ("sum", "average"):
                columns += [F.sum(x.cast("decimal(38,0)") if isinstance(s.kind, INTS) else x.cast("double")).alias(f"{m.name}:s"), F.count(x).alias(f"{m.name}:c")]
            elif m.how in ("min", "max"):
                columns.append((F.min if m.how == "min" else F.max)(x).alias(f"{m.name}:x"))
            elif m.how == "approximate_count_distinct":
                columns.append(F.hll_sketch_agg(x if isinstance(s.kind, (T.LongType, T.IntegerType, T.StringType, T.BinaryType)) else x.cast("string"), SKETCH).alias(f"{m.name}:h"))
            else:
                buckets.append(keyed.select(*self.keys, F.lit(m.name).alias("__m"), x.cast("double").alias("__x")).where("__x is not null").groupBy(*self.keys, "__m", bucket_of(F.col("__x"), grid(m.error)).alias("bucket")).agg(F.count("*").alias("n")))
        return keyed.groupBy(*self.keys).agg(*columns), reduce(DataFrame.unionByName, buckets) if buckets else None

    def _merged(self, states: DataFrame) -> DataFrame:
        columns = [F.sum("__n").alias("__n")]
        for m in self.measures:
            if m.how in ("sum", "average"):
                columns += [F.sum(f"`{m.name}:s`").cast(states.schema[f"{m.name}:s"].dataType).alias(f"{m.name}:s"), F.sum(f"`{m.name}:c`").alias(f"{m.name}:c")]
            elif m.how in ("min", "max"):
                columns.append((F.min if m.how == "min" else F.max)(f"`{m.name}:x`").alias(f"{m.name}:x"))
            elif m.how == "approximate_count_distinct":
                columns.append(F.hll_union_agg(f"`{m.name}:h`").alias(f"{m.name}:h"))
        return states.groupBy(*self.keys).agg(*columns)

    def _answers(self, states: DataFrame, buckets: DataFrame | None, kinds: dict[str, T.DataType]) -> DataFrame:
        from ..operators.aggregates import quantiles

        out = states
        for m in self.measures:
            if m.how == "quantile":
                counts = buckets.where(F.col("__m") == m.name).groupBy(*self.keys, "bucket").agg(F.sum("n").alias("n"))
                side = quantiles(counts, list(self.keys), {m.name: m.q}, grid(m.error)).withColumnsRenamed({k: f"__j{k}" for k in self.keys})
                on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__j{k}")) for k in self.keys), F.lit(True))
                out = out.join(side, on, "left")
        picked = []
        for m in self.measures:
            if m.how == "count":
                picked.append(F.col("__n").alias(m.name))
            elif m.how == "sum":
                zero = F.lit(0)
                picked.append((F.coalesce(F.col(f"`{m.name}:s`"), zero).cast("long") if isinstance(kinds[m.name], INTS) else F.coalesce(F.col(f"`{m.name}:s`"), F.lit(0.0))).alias(m.name))
            elif m.how == "average":
                picked.append(F.when(F.col(f"`{m.name}:c`") > 0, F.col(f"`{m.name}:s`").cast("double") / F.col(f"`{m.name}:c`")).alias(m.name))
            elif m.how == "approximate_count_distinct":
                picked.append(F.coalesce(F.hll_sketch_estimate(f"`{m.name}:h`"), F.lit(0).cast("long")).alias(m.name))
            else:
                picked.append(F.col(f"`{m.name}:x`" if m.how in ("min", "max") else m.name).alias(m.name))
        return out.select(*self.keys, *picked)

    # -- asking ------------------------------------------------------------------------

    def ask(self, scan: Scan) -> DataFrame:
        """The whole answer at once."""
        states, buckets = self.states(scan)
        return self._answers(states, buckets, {n: s.kind for n, s in self._symbols(scan).items()})

    def parts(self, scan: Scan, n: int) -> list[Scan]:
        """About n scans of whole files, of much the same rows each; together they are the scan."""
        sizes = sorted(scan._df.groupBy(FILE).count().collect(), key=lambda r: (-r["count"], r[FILE]))  # one row a file
        bins: list[tuple[int, list[str]]] = [(0, []) for _ in range(max(1, min(n, len(sizes))))]
        for r in sizes:
            rows, own = min(bins, key=lambda b: b[0])
            bins.remove((rows, own))
            bins.append((rows + r["count"], [*own, r[FILE]]))
        return [Scan(scan._df.where(F.col(FILE).isin(own)), scan._order, scan._filtered) for _, own in bins]  # by file: these need the places

    def partial(self, scan: Scan) -> Partial:
        states, buckets = self.states(scan)
        kinds = {n: s.kind.json() for n, s in self._symbols(scan).items()}
        return Partial(self.text, kinds, states, buckets)

    def merge(self, partials: Iterable[Partial]) -> DataFrame:
        whole = self.merged(partials)
        kinds = {n: T._parse_datatype_json_string(k) for n, k in whole.kinds.items()}
        return self._answers(whole.states, whole.buckets, kinds)

    def merged(self, partials: Iterable[Partial]) -> Partial:
        """Partials as one partial, to be merged again or sent on."""
        own = list(partials)
        if not own or any(p.question != self.text for p in own):
            raise IntegrityError("a partial of another question")
        states = self._merged(reduce(DataFrame.unionByName, (p.states for p in own)))
        some = [p.buckets for p in own if p.buckets is not None]
        buckets = reduce(DataFrame.unionByName, some).groupBy(*self.keys, "__m", "bucket").agg(F.sum("n").alias("n")) if some else None
        return Partial(self.text, own[0].kinds, states, buckets)


@dataclass
class Partial:
    question: str
    kinds: dict[str, str]
    states: DataFrame
    buckets: DataFrame | None

    def to_bytes(self) -> bytes:
        """The states as bytes, for a transport of one's own; grows with the groups, not the rows."""
        out = io.BytesIO()
        head = json.dumps([self.question, self.kinds, self.buckets is not None]).encode()
        out.write(len(head).to_bytes(8, "little") + head)
        for df in (self.states, self.buckets):
            if df is not None:
                body = io.BytesIO()
                table = df.toArrow()
                with pa.ipc.new_stream(body, table.schema) as writer:
                    writer.write_table(table)
                schema = df.schema.json().encode()
                for part in (schema, body.getvalue()):
                    out.write(len(part).to_bytes(8, "little") + part)
        return out.getvalue()

    @staticmethod
    def from_bytes(spark: SparkSession, data: bytes) -> Partial:
        source = io.BytesIO(data)

        def part() -> bytes:
            return source.read(int.from_bytes(source.read(8), "little"))

        question, kinds, more = json.loads(part())
        frames = []
        for _ in range(1 + more):
            schema = T.StructType.fromJson(json.loads(part()))
            frames.append(spark.createDataFrame(pa.ipc.open_stream(part()).read_all(), schema))
        return Partial(question, kinds, frames[0], frames[1] if more else None)

