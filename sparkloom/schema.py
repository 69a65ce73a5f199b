"""Declared schemas: binding, widening of types that Spark lacks, time zones of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

#: Declared type names that Spark has no type for, and what carries them.
WIDENED = {"u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "f16": T.FloatType(), "uuid": T.StringType()}
PLAIN = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(),
    "utf8": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "variant": T.VariantType(), "null": T.NullType(),
}
ZONE = "tz"


def declared(name: str, kind: str, nullable: bool = True, precision: int | None = None, scale: int = 0, tz: str | None = None) -> T.StructField:
    """A field of a declared type; 39 digits and more, which Spark cannot hold, are refused."""
    if kind == "decimal":
        if not precision or precision > 38:
            raise SchemaError(f"{name}: a decimal of {precision} digits cannot be held (38 at most)")
        return T.StructField(name, T.DecimalType(precision, scale), nullable)
    if kind == "timestamp" and tz:
        return T.StructField(name, T.TimestampType(), nullable, {ZONE: tz})
    found = WIDENED.get(kind) or PLAIN.get(kind)
    if found is None:
        raise SchemaError(f"{name}: unknown type {kind!r}")
    return T.StructField(name, found, nullable, {"declared": kind} if kind in WIDENED else {})


EXTENSION = "extension"
_EXTENSIONS: dict[str, tuple] = {}


def register_extension(name: str, storage: T.DataType, read, write) -> None:
    """A type of one's own over a storage type: read makes a value of a stored one, write a stored one of a value."""
    if _EXTENSIONS.get(name, (storage,))[0] != storage:
        raise SchemaError(f"extension {name!r} has another storage type")
    _EXTENSIONS[name] = storage, read, write


def extension(field_name: str, name: str, nullable: bool = True) -> T.StructField:
    """A field of a registered extension: its storage type, and the extension's name in the field's metadata."""
    if name not in _EXTENSIONS:
        raise SchemaError(f"no extension {name!r}")
    return T.StructField(field_name, _EXTENSIONS[name][0], nullable, {EXTENSION: name})


def read_value(field: T.StructField, value):
    """A stored value as its extension's, nulls and fields without one as they are."""
    name = field.metadata.get(EXTENSION)
    return value if value is None or name is None else _EXTENSIONS[name][1](value)


def write_value(field: T.StructField, value):
    name = field.metadata.get(EXTENSION)
    return value if value is None or name is None else _EXTENSIONS[name][2](value)


def resolve(schema: T.StructType, name: str) -> str:
    """The column of that name: exact case first, else the only one equal but for case."""
    names = schema.fieldNames()
    if name in names:
        return name
    like = [n for n in names if n.lower() == name.lower()]
    if len(like) != 1:
        raise SchemaError(f"no column {name!r} among {names}" if not like else f"{name!r} may be any of {like}")
    return like[0]


def field_at(schema: T.StructType, path: str) -> T.StructField:
    """The field at a dotted path; a whole name that holds dots comes first."""
    if path in schema.fieldNames():
        return schema[path]
    head, _, rest = path.partition(".")
    field = schema[resolve(schema, head)]
    if not rest:
        return field
    if not isinstance(field.dataType, T.StructType):
        raise SchemaError(f"{head!r} has no fields")
    inner = field_at(field.dataType, rest)
    return T.StructField(path, inner.dataType, field.nullable or inner.nullable, inner.metadata)


def holds(wide: T.DataType, narrow: T.DataType) -> bool:
    """Whether every value of narrow is a value of wide."""
    if wide == narrow:
        return True
    ints = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
    if wide in ints and narrow in ints:
        return ints.index(wide) >= ints.index(narrow)
    if isinstance(wide, T.DecimalType):
        if isinstance(narrow, T.DecimalType):
            return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
        digits = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}.get(narrow)
        return digits is not None and wide.precision - wide.scale >= digits
    return isinstance(wide, T.DoubleType) and (isinstance(narrow, T.FloatType) or narrow in ints[:3])


def bind(df: DataFrame, schema: T.StructType, trust_nullable: bool = False) -> DataFrame:
    """The declared columns in declared order, widened where that loses nothing.

    A nullable column does not fit a declared non-nullable one, unless trust_nullable says
    that the source merely cannot tell (files read back are all nullable)."""
    out = []
    for want in schema:
        have = df.schema[resolve(df.schema, want.name)]
        if not holds(want.dataType, have.dataType):
            raise SchemaError(f"{want.name}: {have.dataType.simpleString()} does not fit {want.dataType.simpleString()}")
        if have.nullable and not want.nullable and not trust_nullable:
            raise SchemaError(f"{want.name}: a nullable column read as one that is not")
        out.append(F.col(f"`{have.name}`").cast(want.dataType).alias(want.name, metadata={**have.metadata, **want.metadata}))
    return df.select(*out)
