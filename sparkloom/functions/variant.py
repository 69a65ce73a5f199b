"""Paths of variant columns.

A key is whole, dots included.  `as_...` reads take a value of their class alone and are
null otherwise; `to_...` reads convert.  Numbers with a fraction that come from JSON text
are decimals to Spark and count as doubles here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from .predicates import Predicate, Sym

#: Reads and the classes of value they take.
READS = {
    "AsInt64": (T.LongType(), "Integer"), "AsDouble": (T.DoubleType(), "Double"), "AsString": (T.StringType(), "String"), "AsBool": (T.BooleanType(), "Boolean"), "AsTimestamp": (T.TimestampType(), "Timestamp"),
    "ToInt64": (T.LongType(), None), "ToDouble": (T.DoubleType(), None),
}


#: Readers of values beyond the paths' own: no conversion, another class is null.
VALUES = {"decimal": ("DECIMAL", "decimal(38,18)"), "binary": ("BINARY", "binary"), "date": ("DATE", "date"), "local_timestamp": ("TIMESTAMP_NTZ", "timestamp_ntz"), "bool": ("BOOLEAN", "boolean")}


def from_json(text: Column) -> Column:
    """A variant of JSON text; null where the text is none."""
    return F.try_parse_json(text)


def to_json(value: Column) -> Column:
    return F.to_json(value)


def build(value: Column) -> Column:
    """A variant of a struct, map or list of columns; of anything else, of the value itself."""
    return F.to_variant_object(value)


def path_text(steps: tuple) -> str:
    out = "$"
    for s in steps:
        if isinstance(s, int) and not isinstance(s, bool):
            out += f"[{s}]"
        elif isinstance(s, str) and not ('"' in s and "'" in s):
            out += f"['{s}']" if '"' in s else f'["{s}"]'
        else:
            raise SchemaError(f"{s!r} is no step of a path")
    return out


def class_of(value: Column) -> Column:
    """The class of a variant: which read takes it; null for a missing value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(kind == "BIGINT", "Integer")
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "Double")
        .when(kind == "STRING", "String")
        .when(kind == "BOOLEAN", "Boolean")
        .when(kind == "TIMESTAMP", "Timestamp")
        .when(kind.startswith("OBJECT"), "Object")
        .when(kind.startswith("ARRAY"), "List")
        .when(kind == "VOID", "Null")
        .otherwise("Other")
    )


class Path:
    """A path of a variant column; read it to compare it."""

    def __init__(self, root: Sym, steps: tuple) -> None:
        self.root, self.steps = root, steps
        path_text(steps)

    def __getitem__(self, step) -> Path:
        return Path(self.root, (*self.steps, step))

    @property
    def text(self) -> str:
        return self.root.text + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "''") + "']" for s in self.steps)

    @property
    def value(self) -> Column:
        return F.try_variant_get(self.root.column, path_text(self.steps), "variant")

    def read(self, name: str) -> Sym:
        kind, only = READS[name]
        column = F.try_variant_get(self.root.column, path_text(self.steps), kind.simpleString())
        if only:
            column = F.when(class_of(self.value) == only, column)
        return _Read(f"{self.text}.{name}()", kind, column, columns=self.root.columns)

    def as_int64(self) -> Sym:
        return self.read("AsInt64")

    def as_double(self) -> Sym:
        return self.read("AsDouble")

    def as_string(self) -> Sym:
        return self.read("AsString")

    def as_bool(self) -> Sym:
        return self.read("AsBool")

    def as_timestamp(self) -> Sym:
        return self.read("AsTimestamp")

    def to_int64(self) -> Sym:
        return self.read("ToInt64")

    def to_double(self) -> Sym:
        return self.read("ToDouble")

    def value_as(self, name: str) -> Sym:
        """A value of a class without a read of its own: decimal, binary, date, local_timestamp, bool."""
        only, kind = VALUES[name]
        column = F.when(F.schema_of_variant(self.value).startswith(only), F.try_variant_get(self.root.column, path_text(self.steps), kind))
        return _Read(f"{self.text}.{name}", {"decimal": T.DecimalType(38, 18), "binary": T.BinaryType(), "date": T.DateType(), "local_timestamp": T.TimestampNTZType(), "bool": T.BooleanType()}[name], column, columns=self.root.columns)

    def exists(self) -> Predicate:
        """Never unknown; a JSON null exists."""
        return Predicate(F.coalesce(self.value.isNotNull(), F.lit(False)), f"{self.text} exists", self.root.columns)

    def has(self, key: str) -> Predicate:
        return self[key].exists()


class _Read(Sym):
    @property
    def text(self) -> str:
        return self.name


def paths(df: DataFrame, column: str) -> DataFrame:
    """Every path of a variant column with each class of value and the rows that hold it: path (keys), class, rows.

    The path without keys is the column's own values.  A list is a path, its elements are not.  Levels are
    taken one after another as long as there are objects; each is counted from the values of the one before, which are stored."""
    from ..sources.shared import shared_folder

    spark = df.sparkSession
    level = df.select(F.array().cast("array<string>").alias("path"), F.col(column).alias("value")).where("value is not null")
    out = None
    while True:
        found = level.groupBy("path", class_of(F.col("value")).alias("class")).agg(F.count("*").alias("rows"))
        out = found if out is None else out.unionByName(found)
        objects = level.where(F.schema_of_variant("value").startswith("OBJECT"))
        if objects.isEmpty():
            break
        inner = spark.tvf.variant_explode(F.col("value").outer()).select("key", F.col("value").alias("inner"))
        level = objects.lateralJoin(inner).select(F.concat("path", F.array("key")).alias("path"), F.col("inner").alias("value"))
        folder = shared_folder(spark)
        level.write.parquet(folder)
        level = spark.read.schema(level.schema).parquet(folder)
    return out


def side_columns(df: DataFrame, column: str, reads: dict[str, tuple[tuple, str]]) -> DataFrame:
    """The frame with hot paths as typed columns beside the variant: name -> (steps, read)."""
    root = Sym(column, T.VariantType())
    return df.withColumns({name: Path(root, steps).read(read).column for name, (steps, read) in reads.items()})
