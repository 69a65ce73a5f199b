"""Symbols and predicates: a closed row language with SQL's three values and IEEE's NaN.

A Sym names one column (or a function of one); comparing it gives a Predicate.  Nulls
answer unknown; a float compared with NaN is false, and `!=` is the negation of `==`.
Arithmetic is refused: compute it on the DataFrame.

A comparison of a calendar or numeric function with a constant becomes the range of the
underlying column, so that files, row groups and partitions are pruned by it.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, SchemaError
from ..schema import ZONE, field_at

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


#: Of a file's column summaries, by name (least, greatest, nulls, rows): which of true, false and unknown some row may be.
Outcomes = tuple[bool, bool, bool]
ANY: Outcomes = (True, True, True)


class Predicate:
    """A boolean of the row language: a Column, what it says in the text grammar, and what summaries tell of it."""

    def __init__(self, column: Column, text: str, columns: frozenset[str] = frozenset(), joint: str = "", outcomes: Callable[[dict], Outcomes] | None = None) -> None:
        self.column, self.text, self.columns, self.joint = column, text, columns, joint
        self.outcomes = outcomes or (lambda _: ANY)

    def __and__(self, other: Predicate) -> Predicate:
        def outcomes(s: dict) -> Outcomes:
            a, b = self.outcomes(s), other.outcomes(s)
            return a[0] and b[0], a[1] or b[1], a[2] or b[2]

        return Predicate(self.column & other.column, f"{self._inside('and')} and {other._inside('and')}", self.columns | other.columns, "and", outcomes)

    def __or__(self, other: Predicate) -> Predicate:
        def outcomes(s: dict) -> Outcomes:
            a, b = self.outcomes(s), other.outcomes(s)
            return a[0] or b[0], a[1] and b[1], a[2] or b[2]

        return Predicate(self.column | other.column, f"{self._inside('or')} or {other._inside('or')}", self.columns | other.columns, "or", outcomes)

    def __invert__(self) -> Predicate:
        def outcomes(s: dict) -> Outcomes:
            t, f, u = self.outcomes(s)
            return f, t, u

        return Predicate(~self.column, f"not ({self.text})", self.columns, "", outcomes)

    def _inside(self, joint: str) -> str:
        return f"({self.text})" if self.joint and self.joint != joint else self.text

    def __bool__(self) -> bool:
        raise QueryError("a predicate is not true or false while it is built; combine with &, | and ~")

    @staticmethod
    def all() -> Predicate:
        return Predicate(F.lit(True), "true", outcomes=lambda _: (True, False, False))

    @staticmethod
    def none() -> Predicate:
        return Predicate(F.lit(False), "false", outcomes=lambda _: (False, True, False))


def literal_text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(" ") if isinstance(value, dt.datetime) else value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        value = bytes(value).hex()
    return "'" + str(value).replace("'", "''") + "'"


def literal(value, kind: T.DataType, name: str, parse: bool = False) -> Column | None:
    """A literal to compare a column of that type with, at the literal's own precision; None for one that is NaN.

    parse: text is read as the column's type, as the text grammar does."""
    if isinstance(value, str) and parse and not isinstance(kind, T.StringType):
        value = parsed(value, kind, name)
    if isinstance(value, bool) != isinstance(kind, T.BooleanType):
        raise SchemaError(f"{name}: {value!r} is no {kind.simpleString()}")
    if isinstance(kind, T.BooleanType):
        return F.lit(value)
    if isinstance(kind, INTS):
        if isinstance(value, int):
            return F.lit(value) if -(2**63) <= value < 2**63 else F.lit(decimal.Decimal(value))
        if isinstance(value, decimal.Decimal) or (parse and isinstance(value, float)):
            return F.lit(decimal.Decimal(str(value)))
    elif isinstance(kind, FLOATS):
        if isinstance(value, (int, float)):
            return None if math.isnan(value) else F.lit(float(value))
        if isinstance(value, decimal.Decimal):
            return F.lit(float(value))
    elif isinstance(kind, T.DecimalType):
        if isinstance(value, (int, decimal.Decimal)) or (parse and isinstance(value, float)):
            return F.lit(decimal.Decimal(str(value)))
    elif isinstance(kind, T.StringType):
        if isinstance(value, (str, uuid.UUID)):
            return F.lit(str(value))
    elif isinstance(kind, T.BinaryType):
        if isinstance(value, (bytes, bytearray)):
            return F.lit(bytes(value))
    elif isinstance(kind, T.DateType):
        if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            return F.lit(value)
    elif isinstance(kind, T.TimestampNTZType):
        if isinstance(value, dt.datetime) and value.tzinfo is None:
            return F.lit(value.isoformat(" ")).cast("timestamp_ntz")
    elif isinstance(kind, T.TimestampType):
        if isinstance(value, dt.datetime):
            aware = value if value.tzinfo else value.replace(tzinfo=dt.UTC)
            return F.timestamp_micros(F.lit((aware - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)))
    raise SchemaError(f"{name}: {value!r} is no {kind.simpleString()}")


def parsed(text: str, kind: T.DataType, name: str):
    try:
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(text)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            return dt.datetime.fromisoformat(text)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(text)
        if isinstance(kind, T.BinaryType):
            return bytes.fromhex(text)
    except (ValueError, decimal.InvalidOperation):
        pass
    raise SchemaError(f"{name}: {text!r} is no {kind.simpleString()}")


def _refuse(what: str) -> Callable:
    def refuse(self, *_):
        raise QueryError(f"{what} is not pushed down; compute it on the columns after the scan")

    return refuse


class Sym:
    """A column of the row language."""

    __hash__ = None
    __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __rtruediv__ = __mod__ = __rmod__ = __neg__ = __abs__ = __pow__ = _refuse("arithmetic")
    __len__ = _refuse("length")

    def __init__(self, name: str, kind: T.DataType, column: Column | None = None, zone: str | None = None, columns: frozenset[str] | None = None, ranges: Callable | None = None) -> None:
        self.name, self.kind, self.zone = name, kind, zone
        self._plain = column is None
        self.column = quoted(name) if column is None else column
        self.columns = columns if columns is not None else frozenset({name.split(".")[0]})
        #: op, value -> Predicate over the underlying column, for functions that can be inverted
        self.ranges = ranges

    # -- comparisons -----------------------------------------------------------------

    def _compare(self, op: str, other) -> Predicate:
        if other is None:
            if op in ("=", "!="):
                return self.is_null() if op == "=" else self.is_not_null()
            return Predicate(F.lit(None).cast("boolean"), f"{self.text} {op} null", self.columns)
        if isinstance(other, Sym):
            if other.kind != self.kind:
                raise SchemaError(f"{self.name} is {self.kind.simpleString()}, {other.name} is {other.kind.simpleString()}")
            right, text, columns = other.column, other.text, self.columns | other.columns
        else:
            if self.ranges and (found := self.ranges(op, other)) is not None:
                return Predicate(found.column, f"{self.text} {op} {literal_text(other)}", self.columns, outcomes=found.outcomes)
            right, text, columns = literal(other, self.kind, self.name, self._parses), literal_text(other), self.columns
        if right is None:  # NaN: nulls stay unknown
            return Predicate(F.when(self.column.isNotNull(), F.lit(op == "!=")), f"{self.text} {op} {text}", columns)
        left = self.column
        plain = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        if isinstance(self.kind, FLOATS):
            number = ~F.isnan(left)
            if isinstance(other, Sym):
                number = number & ~F.isnan(right)
            if op == "!=":
                plain = plain | F.isnan(left) if not isinstance(other, Sym) else plain | ~number
            elif op in (">", ">=") or isinstance(other, Sym):  # NaN is the greatest to Spark: it passes no '<', and equals no number
                plain = plain & number
            if isinstance(other, Sym):  # isnan(null) is false to Spark: keep unknown
                plain = F.when(left.isNotNull() & right.isNotNull(), plain)
        return Predicate(plain, f"{self.text} {op} {text}", columns, outcomes=None if isinstance(other, Sym) else self._told(op, [other]))

    _parses = False

    def _told(self, op: str, values: list) -> Callable[[dict], Outcomes] | None:
        """What a plain column's summary tells of a comparison with values of its type (op "in" takes several)."""
        if not self._plain:
            return None
        if self._parses and not isinstance(self.kind, T.StringType):
            values = [parsed(v, self.kind, self.name) if isinstance(v, str) else v for v in values]
        floating = isinstance(self.kind, FLOATS)

        def outcomes(summaries: dict) -> Outcomes:
            if self.name not in summaries:
                return ANY
            least, most, nulls, rows = summaries[self.name]
            if nulls == rows:
                return False, False, rows > 0
            if least is None or most is None:
                return ANY
            try:
                if op == "in":
                    true = any(least <= v <= most for v in values)
                    false = not (least == most and true)
                else:
                    v = values[0]
                    true, false = {
                        "=": (least <= v <= most, not least == most == v), "!=": (not least == most == v, least <= v <= most), "<": (least < v, most >= v),
                        "<=": (least <= v, most > v), ">": (most > v, least <= v), ">=": (most >= v, least < v),
                    }[op]
            except TypeError:
                return ANY
            if floating:  # summaries pass NaN over: it is false, and true to !=
                true, false = (True, false) if op == "!=" else (true, True)
            return true, false, nulls > 0

        return outcomes

    @property
    def text(self) -> str:
        return ".".join(p if re.fullmatch(r"[A-Za-z_]\w*", p) else '"' + p.replace('"', '""') + '"' for p in self.name.split("."))

    def __eq__(self, other) -> Predicate:  # type: ignore[override]
        return self._compare("=", other)

    def __ne__(self, other) -> Predicate:  # type: ignore[override]
        return self._compare("!=", other)

    def __lt__(self, other) -> Predicate:
        return self._compare("<", other)

    def __le__(self, other) -> Predicate:
        return self._compare("<=", other)

    def __gt__(self, other) -> Predicate:
        return self._compare(">", other)

    def __ge__(self, other) -> Predicate:
        return self._compare(">=", other)

    def is_in(self, values: Iterable) -> Predicate:
        """Membership in a set of any size; a null or NaN in the set matches nothing."""
        values = list(values)
        right = [x for v in values if v is not None and (x := literal(v, self.kind, self.name, self._parses)) is not None]
        text = f"{self.text} in ({', '.join(literal_text(v) for v in values)})"
        if not right:
            return Predicate(F.when(self.column.isNotNull(), F.lit(False)), text, self.columns)
        return Predicate(self.column.isin(right), text, self.columns, outcomes=self._told("in", [v for v in values if v is not None]))

    def between(self, low, high) -> Predicate:
        return (self >= low) & (self <= high)

    def is_null(self) -> Predicate:
        def outcomes(summaries: dict) -> Outcomes:
            if not self._plain or self.name not in summaries:
                return True, True, False
            _, _, nulls, rows = summaries[self.name]
            return nulls > 0, nulls < rows, False

        return Predicate(self.column.isNull(), f"{self.text} is null", self.columns, outcomes=outcomes)

    def is_not_null(self) -> Predicate:
        null = self.is_null()
        return Predicate(self.column.isNotNull(), f"{self.text} is not null", self.columns, outcomes=(~null).outcomes)

    def is_true(self) -> Predicate:
        return self == True  # noqa: E712

    def is_false(self) -> Predicate:
        return self == False  # noqa: E712

    # -- text ------------------------------------------------------------------------

    def _text(self) -> None:
        if not isinstance(self.kind, (T.StringType, T.BinaryType)):
            raise SchemaError(f"{self.name} is {self.kind.simpleString()}, not text")

    def starts_with(self, prefix: str) -> Predicate:
        self._text()
        return Predicate(self.column.startswith(F.lit(prefix)), f"{self.text} starts with {literal_text(prefix)}", self.columns)

    def contains(self, value) -> Predicate:
        """Text holds a text; a list holds a value (a null element matches nothing)."""
        if isinstance(self.kind, T.ArrayType):
            inner = literal(value, self.kind.elementType, self.name, self._parses) if value is not None else None
            text = f"{self.text} contains {literal_text(value)}"
            if value is None:
                return Predicate(F.lit(None).cast("boolean"), text, self.columns)
            found = F.lit(False) if inner is None else F.coalesce(F.array_contains(self.column, inner.cast(self.kind.elementType)), F.lit(False))
            return Predicate(F.when(self.column.isNotNull(), found), text, self.columns)
        self._text()
        return Predicate(self.column.contains(F.lit(value)), f"{self.text} contains {literal_text(value)}", self.columns)

    def like(self, pattern: str, escape: str = "\\") -> Predicate:
        self._text()
        if len(escape) != 1:
            raise SchemaError("an escape is one character")
        if re.search(rf"(?<!{re.escape(escape)})(?:{re.escape(escape * 2)})*{re.escape(escape)}$", pattern):
            raise SchemaError("a pattern cannot end with its escape")
        plain, i = "", 0  # with Spark's own escape, which stands only before what would mean something
        while i < len(pattern):
            c = pattern[i]
            if c == escape:
                i += 1
                c = pattern[i]
                plain += "\\" + c if c in "%_\\" else c
            else:
                plain += "\\\\" if c == "\\" else c
            i += 1
        text = f"{self.text} like {literal_text(pattern)}" + ("" if escape == "\\" else f" escape {literal_text(escape)}")
        return Predicate(F.like(self.column, F.lit(plain)), text, self.columns)

    def has_token(self, word: str) -> Predicate:
        """The text holds the word whole; words are runs of A-Z, a-z, 0-9 and what is not ASCII."""
        self._text()
        if not re.fullmatch(r"[A-Za-z0-9\u0080-\U0010ffff]+", word):
            raise SchemaError(f"{word!r} is not one word")
        edge = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
        return Predicate(self.column.contains(F.lit(word)) & self.column.rlike(f"(?<!{edge})\\Q{word}\\E(?!{edge})"), f"{self.text} has token {literal_text(word)}", self.columns)

    # -- functions of a column ---------------------------------------------------------

    def map(self, table: dict) -> Sym:
        """The table's text for the value; a value it lacks is null."""
        if not table:
            return Sym(f"map({self.name})", T.StringType(), F.lit(None).cast("string"), columns=self.columns)
        pairs = [x for k, v in table.items() for x in (literal(k, self.kind, self.name).cast(self.kind), F.lit(v))]
        return Sym(f"map({self.name})", T.StringType(), F.try_element_at(F.create_map(*pairs), self.column), columns=self.columns)

    def truncate(self, unit: str, zone: str | None = None) -> Sym:
        from . import calendar

        return calendar.truncated(self, unit, zone)

    def bucket(self, width) -> Sym:
        from . import calendar

        return calendar.bucketed(self, width)

    def as_int128(self) -> Sym:
        """Widened for sums that leave 64 bits."""
        return Sym(self.name, T.DecimalType(38, 0), self.column.cast("decimal(38,0)"), columns=self.columns)

    def __getitem__(self, step) -> object:
        from . import variant

        if not isinstance(self.kind, T.VariantType):
            raise SchemaError(f"{self.name} is {self.kind.simpleString()}, which has no paths")
        return variant.Path(self, (step,))


class Fields:
    """The columns of a schema as symbols: fields.day, fields["odd name"], fields.origin.country."""

    def __init__(self, schema: T.StructType, prefix: str = "", parses: bool = False) -> None:
        self._schema, self._prefix, self._parses = schema, prefix, parses

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str):
        path = self._prefix + name
        field = field_at(self._schema, path)
        if isinstance(field.dataType, T.StructType):
            return StructFields(self._schema, path, self._parses)
        sym = Sym(field.name if not self._prefix and "." not in name else path, field.dataType, zone=field.metadata.get(ZONE))
        sym._parses = self._parses
        return sym


class StructFields(Fields):
    """A nested record: its fields, and whether it is there."""

    def __init__(self, schema: T.StructType, path: str, parses: bool) -> None:
        super().__init__(schema, path + ".", parses)
        self._path = path

    def is_null(self) -> Predicate:
        return Predicate(quoted(self._path).isNull(), f"{self._path} is null", frozenset({self._path.split(".")[0]}))

    def is_not_null(self) -> Predicate:
        return ~self.is_null()


def tuple_in(symbols: list[Sym], tuples: Iterable[tuple]) -> Predicate:
    """Two to four columns are, together, one of the tuples.

    A tuple that holds a null or NaN matches nothing.  A row with a null is unknown where a
    tuple holds its other values, and false otherwise.  Each column's own set of values
    is a conjunct of its own, which files and row groups are pruned by."""
    if not 2 <= len(symbols) <= 4:
        raise SchemaError("a tuple takes two to four columns")
    rows = [t for t in map(tuple, tuples) if not any(v is None or (isinstance(v, float) and math.isnan(v)) for v in t)]
    if any(len(t) != len(symbols) for t in rows):
        raise SchemaError("a tuple has a value for each column")
    names = ", ".join(s.text for s in symbols)
    text = f"({names}) in ({', '.join('(' + ', '.join(map(literal_text, t)) + ')' for t in rows)})"
    columns = frozenset().union(*(s.columns for s in symbols))
    if not rows:
        return Predicate(F.lit(False), text, columns)
    by_first: dict = {}
    for t in rows:
        by_first.setdefault(t[:-1], []).append(t[-1])
    whole = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, [s == v for s, v in zip(symbols, head, strict=False)]) & symbols[-1].is_in(last) for head, last in by_first.items()))
    sets = reduce(lambda a, b: a & b, (s.is_in(dict.fromkeys(t[i] for t in rows)) for i, s in enumerate(symbols)))
    return Predicate(sets.column & whole.column, text, columns)
