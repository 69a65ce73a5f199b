"""The catalogue of aggregates, over a scan or per group.

Whoever asks gets a Group and names results of it; each result is a symbol, so groups can
be filtered and ordered by it.  Results that one pass of groupBy().agg() can give are
plain; quantiles, counter growth and exact float sums take frames of their own, joined by key.

Nulls and NaN are skipped; sums of nothing are 0; integer sums fail only when the total does
not fit; -0 is less than +0; a chosen row is one row for all its columns.
"""

from __future__ import annotations

import decimal
import fractions
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, SchemaError, UnsupportedError
from ..functions.predicates import FLOATS, INTS, Predicate, Sym

LONG, DOUBLE, BOOLEAN = T.LongType(), T.DoubleType(), T.BooleanType()


@dataclass
class Plan:
    """What a grouped question needs: keys, plain aggregates, and frames to be joined."""

    df: DataFrame
    keys: list[Column]
    order: list[Column]
    placed: DataFrame  # df with the columns that order its rows, taken when a result asks for them
    plain: dict[str, Column] = field(default_factory=dict)
    frames: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = field(default_factory=dict)
    spreads: dict[tuple, tuple[Column, int, dict[str, float]]] = field(default_factory=dict)  # quantiles that one histogram answers
    states: dict[str, tuple] = field(default_factory=dict)
    found: dict[str, Result] = field(default_factory=dict)

    def run(self) -> DataFrame:
        names = [f"__k{i}" for i in range(len(self.keys))]
        keyed = self.df.withColumns(dict(zip(names, self.keys, strict=True))) if names else self.df
        # a group key of -0 is one of +0, a NaN one of NaN: Spark's own grouping sees to both
        grouped = keyed.groupBy(*names)
        out = grouped.agg(*(c.alias(n) for n, c in self.plain.items()), F.count("*").alias("__rows"))
        sides = [(frame(keyed, names), [name]) for name, frame in self.frames.items()]
        sides += [(quantiles(histogram(keyed, names, x, parts), names, asked, parts), list(asked)) for x, parts, asked in self.spreads.values()]
        for frame, found in sides:
            side = frame.select(*(F.col(k).alias(f"__j{i}") for i, k in enumerate(names)), *found)
            on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(names)), F.lit(True))
            out = out.join(side, on, "left").drop(*(f"__j{i}" for i in range(len(names))))
        return out


class Result(Sym):
    """One result of a group: a symbol of the grouped frame."""

    def __init__(self, out: str, kind: T.DataType, spec: tuple) -> None:
        super().__init__(out, kind, F.col(out), columns=frozenset({out}))
        self.out, self.spec = out, spec


class Group:
    """The rows of a group (or of the whole scan), and everything that can be asked of them."""

    def __init__(self, plan: Plan, schema: T.StructType, key, kept: Predicate | None = None) -> None:
        self._plan, self._schema, self.key, self._kept = plan, schema, key, kept

    def __repr__(self) -> str:
        return f"Group({self._kept.text if self._kept is not None else 'all rows'})"

    # -- building ------------------------------------------------------------------------

    def _sym(self, column) -> Sym:
        from ..functions.predicates import Fields

        if isinstance(column, Result):
            raise QueryError("an aggregate cannot read another one's result; group the result again")
        return column if isinstance(column, Sym) else Fields(self._schema)[column]

    def _named(self, spec: tuple, kind: T.DataType, plain: Column | None = None, frame=None, spread=None) -> Result:
        spec = (*spec, self._kept.text if self._kept is not None else "")
        text = repr(spec)
        if text not in self._plan.found:
            out = f"__a{len(self._plan.found)}"
            if plain is not None:
                self._plan.plain[out] = plain
            elif spread is not None:
                x, parts, q = spread
                self._plan.spreads.setdefault((spec[1], parts, spec[-1]), (x, parts, {}))[2][out] = q
            else:
                self._plan.frames[out] = lambda df, keys: frame(df, keys, out)
            self._plan.found[text] = Result(out, kind, spec)
            self._plan.states[out] = spec
        return self._plan.found[text]

    def _when(self, value: Column) -> Column:
        return F.when(self._kept.column, value) if self._kept is not None else value

    def _values(self, s: Sym) -> Column:
        """The column with NaN as null, and null outside the filter."""
        return self._when(F.when(~F.isnan(s.column), s.column) if isinstance(s.kind, FLOATS) else s.column)

    def where(self, predicate) -> Group:
        """The rows where it is true, with every aggregate: SQL's FILTER.  Repeated, both hold."""
        p = predicate(self._fields()) if callable(predicate) else predicate
        return Group(self._plan, self._schema, self.key, self._kept & p if self._kept is not None else p)

    def _fields(self):
        from ..functions.predicates import Fields

        return Fields(self._schema)

    def _predicate(self, p) -> Predicate:
        return p(self._fields()) if callable(p) else p

    # -- rows ----------------------------------------------------------------------------

    def count(self, predicate=None) -> Result:
        if predicate is not None:
            return self.where(predicate).count()
        return self._named(("count",), LONG, F.count_if(self._kept.column) if self._kept is not None else F.count("*"))

    def any(self, predicate) -> Result:
        """Whether some row is true; false of no rows."""
        p = self._predicate(predicate)
        return self._named(("any", p.text), BOOLEAN, F.count_if(self._when(p.column)) > 0)

    def all(self, predicate) -> Result:
        """Whether no row is false or unknown; true of no rows."""
        p = self._predicate(predicate)
        return self._named(("all", p.text), BOOLEAN, F.count_if(self._when(~F.coalesce(p.column, F.lit(False)))) == 0)

    # -- numbers -------------------------------------------------------------------------

    def sum(self, column, exact: bool = False) -> Result:
        s = self._sym(column)
        x = self._values(s)
        spec = ("sum", s.name, exact)
        if isinstance(s.kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return self._named(spec, LONG, F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long")))
        if isinstance(s.kind, T.LongType):
            return self._named(spec, LONG, long_sum(x))
        if isinstance(s.kind, T.DecimalType):
            kind = T.DecimalType(38, s.kind.scale)
            return self._named(spec, kind, F.coalesce(F.sum(x).cast(kind), F.lit(decimal.Decimal(0)).cast(kind)))
        if isinstance(s.kind, FLOATS):
            if exact:
                return self._named(spec, DOUBLE, frame=lambda df, keys, out: exact_sums(df, keys, x.cast("double"), out))
            return self._named(spec, DOUBLE, F.coalesce(F.sum(x.cast("double")), F.lit(0.0)))
        raise SchemaError(f"{s.name}: {s.kind.simpleString()} has no sum")

    def _extreme(self, column, least: bool) -> Result:
        s = self._sym(column)
        x = self._values(s)
        found = F.min(x) if least else F.max(x)
        if isinstance(s.kind, FLOATS):  # Spark takes zeros as equal: -0 is the lesser
            negative = F.when(x == 0, x.cast("string").startswith("-"))
            # not two literals: the optimiser takes 0 and -0 for one
            found = F.when(found == 0, F.when(F.max(negative) if least else F.min(negative), -F.abs(found)).otherwise(F.abs(found))).otherwise(found)
        elif isinstance(s.kind, (T.ArrayType, T.MapType, T.VariantType)):
            raise SchemaError(f"{s.name}: {s.kind.simpleString()} has no order")
        return self._named(("min" if least else "max", s.name), s.kind, found)

    def min(self, column) -> Result:
        return self._extreme(column, True)

    def max(self, column) -> Result:
        return self._extreme(column, False)

    def average(self, column) -> Result:
        s = self._number(column)
        return self._named(("average", s.name), DOUBLE, F.avg(self._values(s).cast("double")))

    def variance(self, column) -> Result:
        s = self._number(column)
        x = self._values(s).cast("double")
        return self._named(("variance", s.name), DOUBLE, F.when(F.count(x) > 1, F.greatest(F.var_samp(x), F.lit(0.0))))

    def standard_deviation(self, column) -> Result:
        s = self._number(column)
        x = self._values(s).cast("double")
        return self._named(("standard_deviation", s.name), DOUBLE, F.when(F.count(x) > 1, F.sqrt(F.greatest(F.var_samp(x), F.lit(0.0)))))

    def _number(self, column) -> Sym:
        s = self._sym(column)
        if not isinstance(s.kind, (*INTS, *FLOATS, T.DecimalType)):
            raise SchemaError(f"{s.name} is {s.kind.simpleString()}, not a number")
        return s

    def count_distinct(self, column) -> Result:
        """Distinct non-null values; NaN is one, and so are both zeros."""
        s = self._sym(column)
        x = s.column
        if isinstance(s.kind, FLOATS):
            x = F.when(F.isnan(x), F.lit(float("nan")).cast(s.kind)).when(x == 0, F.lit(0.0).cast(s.kind)).otherwise(x)
        return self._named(("count_distinct", s.name), LONG, F.count_distinct(self._when(x)))

    def approximate_count_distinct(self, column, error: float = 0.008) -> Result:
        s = self._sym(column)
        x = F.when(s.column == 0, F.lit(0.0).cast(s.kind)).otherwise(s.column) if isinstance(s.kind, FLOATS) else s.column
        x = F.when(~F.isnan(s.column), x) if isinstance(s.kind, FLOATS) else x
        # a sketch of distinct hashes keeps them all while they are few, and then their number is exact
        size = min(26, max(6, math.ceil(2 * math.log2(1 / error))))
        x = F.when(x.isNotNull(), F.xxhash64(x)) if not isinstance(s.kind, (T.LongType, T.IntegerType, T.StringType)) else x
        return self._named(("approximate_count_distinct", s.name, error), LONG, F.coalesce(F.theta_sketch_estimate(F.theta_sketch_agg(self._when(x), F.lit(size))), F.lit(0)).cast("long"))

    # -- distributions -------------------------------------------------------------------

    def quantile(self, column, q: float, error: float = 0.01) -> Result:
        """The value at rank q(n-1), within a relative error: the middle of its bucket."""
        if not 0 <= q <= 1 or not 0 < error < 1:
            raise SchemaError("a quantile lies from 0 to 1, its error between them")
        s = self._number(column)
        x = self._values(s).cast("double")
        parts = grid(error)
        return self._named(("quantile", s.name, q, error), DOUBLE, spread=(x, parts, q))

    # -- chosen rows -----------------------------------------------------------------------

    def first(self) -> Chosen:
        """The first row in file order."""
        return Chosen(self, "first", None)

    def last(self) -> Chosen:
        return Chosen(self, "last", None)

    def min_by(self, column) -> Chosen:
        """The row of the least value, of equal ones the first in file order; never a null or NaN."""
        return Chosen(self, "min_by", self._sym(column))

    def max_by(self, column) -> Chosen:
        return Chosen(self, "max_by", self._sym(column))

    def ordered_by(self, column) -> Ordered:
        """The points in the order of a column, then of their values."""
        return Ordered(self, self._sym(column))

    # -- one's own -------------------------------------------------------------------------

    def custom(self, name: str, column, kind: T.DataType, build: Callable[[Column], Column]) -> Result:
        """An aggregate given as a function of the (filtered) column, such as a grouped pandas UDF."""
        s = self._sym(column)
        return self._named(("custom", name, s.name), kind, build(self._when(s.column)))


class Chosen:
    """One row of each group; its columns all come from that row."""

    def __init__(self, group: Group, how: str, by: Sym | None) -> None:
        self._group, self._how, self._by = group, how, by

    def __getattr__(self, name: str) -> Result:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name) -> Result:
        g, by = self._group, self._by
        s = g._sym(name)
        order = g._plan.order
        if not order:
            raise QueryError("a chosen row needs an order of rows: scan a file, or name the order")
        g._plan.df = g._plan.placed
        at = F.struct(*order)
        valid = g._kept.column if g._kept is not None else F.lit(True)
        if by is not None:
            valid = valid & by.column.isNotNull() & (~F.isnan(by.column) if isinstance(by.kind, FLOATS) else F.lit(True))
        # the value inside a struct: a null cell of the chosen row stays null
        cell = F.struct(s.column.alias("v"))
        if self._how in ("first", "min_by"):
            key = at if by is None else F.struct(_zeroless(by).alias("e"), at.alias("r"))
            found = F.min_by(cell, F.when(valid, key))
        elif self._how == "last":
            found = F.max_by(cell, F.when(valid, at))
        else:
            back = F.struct(*(backwards(o, k) for o, k in zip(order, _kinds(g._plan.df, order), strict=True)))
            found = F.max_by(cell, F.when(valid, F.struct(_zeroless(by).alias("e"), back.alias("r"))))
        return g._named((self._how, by.name if by is not None else "", s.name), s.kind, found["v"])


def _zeroless(s: Sym) -> Column:
    """Both zeros as one: equal values, the earlier row wins."""
    return F.when(s.column == 0, F.lit(0.0).cast(s.kind)).otherwise(s.column) if isinstance(s.kind, FLOATS) else s.column


def _kinds(df: DataFrame, order: list[Column]) -> list[T.DataType]:
    return [f.dataType for f in df.select(*order).schema]


def backwards(column: Column, kind: T.DataType) -> Column:
    """A value whose order is the reverse of the column's."""
    if isinstance(kind, (*INTS, *FLOATS, T.DecimalType)):
        return -column.cast("decimal(38,0)" if isinstance(kind, INTS) else kind)
    if isinstance(kind, T.StringType):  # the terminator makes the shorter of two with one beginning the greater
        return F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    if isinstance(kind, T.DateType):
        return -F.unix_date(column)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", column, F.lit("1970-01-01").cast("timestamp_ntz"))
    raise UnsupportedError(f"rows cannot be walked back by {kind.simpleString()}")


def long_sum(x: Column) -> Column:
    """The exact sum of longs: three sums of 22 bits each, none of which overflows before 2**41 rows; an error only when the total does not fit."""
    part = 1 << 22
    high, middle, low = F.sum(F.shiftright(x, 44)), F.sum(F.shiftright(x, 22).bitwiseAND(part - 1)), F.sum(x.bitwiseAND(part - 1))
    wide = "decimal(38,0)"
    total = high.cast(wide) * F.lit(decimal.Decimal(part * part)) + middle.cast(wide) * F.lit(decimal.Decimal(part)) + low.cast(wide)
    return F.coalesce(total.cast("long"), F.lit(0).cast("long"))


def exact_sums(df: DataFrame, keys: list[str], x: Column, out: str) -> DataFrame:
    """The sum of doubles rounded once, so the same bits in any order of rows.

    Every finite double is an integer times a power of two; the integers are summed by
    power in the shuffle's partial sums, and only those few totals are put together as fractions."""
    v, two = F.col("__x"), F.lit(2.0)
    exponent = F.when(v == 0, F.lit(-1074)).otherwise(F.greatest(F.floor(F.log2(F.abs(v))).cast("int") - 1, F.lit(-1074)))
    parts = df.select(*keys, x.alias("__x")).where("__x is not null").withColumn("__e", F.when(F.abs(v) < F.lit(float("inf")), exponent))
    up = F.lit(52) - F.col("__e")
    half = (up / 2).cast("int")
    whole = (F.col("__x") * F.pow(two, half) * F.pow(two, up - half)).cast("long").cast("decimal(20,0)")
    sums = parts.groupBy(*keys, "__e").agg(F.sum(F.when(F.col("__e").isNotNull(), whole)).cast("string").alias("__m"), F.sum(F.when(F.col("__e").isNull(), F.col("__x"))).alias("__inf"))

    @F.udf("double", useArrow=False)
    def rounded(entries, infinite) -> float:
        if infinite is not None:
            return infinite
        total = sum((fractions.Fraction(int(m)) * fractions.Fraction(2) ** (e - 52) for e, m in entries if m is not None), fractions.Fraction(0))
        try:
            return float(total)
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    entry = F.when(F.col("__e").isNotNull(), F.struct("__e", "__m"))
    gathered = sums.groupBy(*keys).agg(F.collect_list(entry).alias("__p"), F.sum("__inf").alias("__i"))  # 2100 entries a group at most
    return gathered.select(*keys, rounded("__p", "__i").alias(out))


# -- log-linear buckets ------------------------------------------------------------------------

REACH = 1100


def grid(error: float) -> int:
    """Buckets per power of two, so that a bucket's middle is within the error."""
    parts = 1
    while 1 / (2 * parts) > error:
        parts *= 2
    return parts


def bucket_of(x: Column, parts: int) -> Column:
    """The number of the value's bucket: 0 for zero, ascending with the value."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    ratio = size / F.pow(F.lit(2.0), guess)
    power = guess + F.when(ratio >= 2, 1).when(ratio < 1, -1).otherwise(0)
    share = F.floor((size / F.pow(F.lit(2.0), power) - 1) * parts)
    number = ((power + REACH) * parts + share + 1).cast("long")
    last = F.lit(2 * REACH * parts).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(size == float("inf"), F.when(x > 0, last).otherwise(-last)).when(x > 0, number).otherwise(-number)


def bounds(bucket: Column, parts: int) -> tuple[Column, Column]:
    """Lower and upper bound of a bucket by size: [low, high), mirrored below zero."""
    n = F.abs(bucket) - 1
    power = F.floor(n / parts) - REACH
    low = F.pow(F.lit(2.0), power) * (1 + F.pmod(n, F.lit(parts)) / parts)
    high = F.pow(F.lit(2.0), power) * (1 + (F.pmod(n, F.lit(parts)) + 1) / parts)
    inf = F.lit(float("inf"))
    end = F.abs(bucket) >= 2 * REACH * parts
    low, high = F.when(end, inf).otherwise(low), F.when(end, inf).otherwise(high)
    return F.when(bucket == 0, 0.0).when(bucket > 0, low).otherwise(-high), F.when(bucket == 0, 0.0).when(bucket > 0, high).otherwise(-low)


def histogram(df: DataFrame, keys: list[str], x: Column, parts: int) -> DataFrame:
    """Counts by bucket: keys, bucket, n."""
    return df.select(*keys, x.alias("__x")).where("__x is not null").groupBy(*keys, bucket_of(F.col("__x"), parts).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, keys: list[str], asked: dict[str, float], parts: int) -> DataFrame:
    """By name, the middle of the first bucket that reaches past rank q(n-1)."""
    own = Window.partitionBy(*keys)  # buckets of a group, not its rows
    ranked = counts.withColumn("__to", F.sum("n").over(own.orderBy("bucket"))).withColumn("__n", F.sum("n").over(own))
    hit = ranked.groupBy(*keys).agg(*(F.min(F.when(F.col("__to") > q * (F.col("__n") - 1), F.col("bucket"))).alias(name) for name, q in asked.items()))

    def middle(bucket: Column) -> Column:
        low, high = bounds(bucket, parts)
        return F.when(F.abs(low) == float("inf"), low).otherwise((low + high) / 2)

    return hit.select(*keys, *(middle(F.col(name)).alias(name) for name in asked))


# -- points in order ---------------------------------------------------------------------------


class Ordered:
    """A group's points in order: rows where both the column and the value hold one."""

    def __init__(self, group: Group, by: Sym) -> None:
        self._group, self._by = group, by
        if not isinstance(by.kind, (*INTS, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise SchemaError(f"{by.name}: points are ordered by an integer, an instant or a date")

    def _point(self, column) -> tuple[Sym, Column, Column]:
        s = self._group._number(column)
        v = s.column
        valid = self._by.column.isNotNull() & v.isNotNull()
        if isinstance(s.kind, FLOATS):
            valid = valid & ~F.isnan(v) & (F.abs(v) < float("inf"))
            v = F.when(v == 0, F.lit(0.0).cast(s.kind)).otherwise(v)
        if self._group._kept is not None:
            valid = valid & self._group._kept.column
        return s, v, valid

    def first(self, column) -> Result:
        s, v, valid = self._point(column)
        return self._group._named(("ordered_first", self._by.name, s.name), s.kind, F.min(F.when(valid, F.struct(self._by.column.alias("e"), v.alias("v"))))["v"])

    def last(self, column) -> Result:
        s, v, valid = self._point(column)
        return self._group._named(("ordered_last", self._by.name, s.name), s.kind, F.max(F.when(valid, F.struct(self._by.column.alias("e"), v.alias("v"))))["v"])

    def increase(self, column) -> Result:
        """Growth of a counter that starts from zero again where it falls; null of no point, 0 of one."""
        s, v, valid = self._point(column)
        return self._group._named(("increase", self._by.name, s.name), s.kind, frame=lambda df, keys, out: growth(df, keys, self._by.column, v, valid, s.kind, out))


def growth(df: DataFrame, keys: list[str], e: Column, v: Column, valid: Column, kind: T.DataType, out: str) -> DataFrame:
    """Growth by key.  Points are dealt by range of (key, e, v), so a group with most of the
    rows is cut among tasks; each cut folds its own points, and the few cuts of a group are joined end to end."""
    exact = "decimal(38,0)" if isinstance(kind, INTS) else f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double"
    points = df.where(valid).select(*keys, e.alias("__e"), v.alias("__v")).distinct()  # a repeated point grows by nothing
    dealt = points.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__e", "__v").withColumn("__cut", F.spark_partition_id())
    own = Window.partitionBy(*keys, "__cut").orderBy("__e", "__v")
    before = F.lag("__v").over(own)
    rise = F.when(before.isNull(), None).when(F.col("__v") >= before, F.col("__v").cast(exact) - before.cast(exact)).otherwise(F.col("__v").cast(exact))
    cuts = dealt.withColumn("__rise", rise).groupBy(*keys, "__cut").agg(F.sum("__rise").alias("__sum"), F.min(F.struct("__e", "__v")).alias("__first"), F.max(F.struct("__e", "__v")).alias("__last"))
    end = F.lag(F.col("__last")["__v"]).over(Window.partitionBy(*keys).orderBy("__first"))
    start = F.col("__first")["__v"]
    joint = F.when(end.isNull(), None).when(start >= end, start.cast(exact) - end.cast(exact)).otherwise(start.cast(exact))
    zero = F.lit(0).cast(exact)
    joined = cuts.withColumn("__joint", joint)
    return joined.groupBy(*keys).agg(F.when(F.count("*") > 0, (F.coalesce(F.sum("__sum"), zero) + F.coalesce(F.sum("__joint"), zero)).cast(kind)).alias(out))
