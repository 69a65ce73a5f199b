"""Walks of one column's values in order: seeks, steps, ranks and counts.

Every move is a question of its own over the entries (value, row order), answered by a
filter that files are pruned by and a top-1, never by collecting the column.  Nulls are not visited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError, SchemaError
from ..functions.predicates import Sym, literal

EXACT, AT_OR_AFTER, AFTER, AT_OR_BEFORE, BEFORE = "exact", "at_or_after", "after", "at_or_before", "before"


class KeyCursor:
    def __init__(self, scan, by: Sym) -> None:
        if not scan._order:
            raise QueryError("a walk needs an order of rows")
        self._by = by
        places = [F.col(o).alias(f"p{i}") for i, o in enumerate(scan._order)]
        self._places = [f"p{i}" for i in range(len(places))]
        self._kinds = [f.dataType for f in scan._df.select(*places).schema]
        self._entries: DataFrame = scan._df.select(by.column.alias("key"), *places).where(F.col("key").isNotNull())
        self._at = None
        self._counted = None

    # -- where it stands -------------------------------------------------------------------

    @property
    def valid(self) -> bool:
        return self._at is not None

    @property
    def key(self):
        return self._entry()["key"]

    @property
    def row(self) -> tuple:
        return tuple(self._entry()[p] for p in self._places)

    def _entry(self):
        if self._at is None:
            raise QueryError("the cursor stands nowhere")
        return self._at

    def _value(self, key) -> Column:
        found = literal(key, self._by.kind, self._by.name)
        if found is None:
            raise SchemaError("NaN is no place")
        return found

    def _move(self, where: Column | None, back: bool) -> bool:
        entries = self._entries if where is None else self._entries.where(where)
        order = [F.col(c).desc() if back else F.col(c) for c in ("key", *self._places)]
        self._at = entries.orderBy(*order).limit(1).first()
        return self._at is not None

    # -- moves -----------------------------------------------------------------------------

    def seek(self, key, mode: str = EXACT) -> bool:
        """To the first entry at or after a key, or the last at or before it; exact: only the key's own first."""
        k, v = F.col("key"), self._value(key)
        if mode == EXACT:
            return self._move(k == v, False)
        if mode in (AT_OR_AFTER, AFTER):
            return self._move(k >= v if mode == AT_OR_AFTER else k > v, False)
        if mode in (AT_OR_BEFORE, BEFORE):
            return self._move(k <= v if mode == AT_OR_BEFORE else k < v, True)
        raise QueryError(f"no way to seek: {mode!r}")

    def first(self) -> bool:
        return self._move(None, False)

    def last(self) -> bool:
        return self._move(None, True)

    def _beyond(self, back: bool) -> Column:
        at = self._entry()
        key = self._value(at["key"])
        same = F.col("key") == key
        out = F.col("key") < key if back else F.col("key") > key
        for p, kind in zip(self._places, self._kinds, strict=True):
            place = literal(at[p], kind, p)
            out = out | (same & (F.col(p) < place if back else F.col(p) > place))
            same = same & (F.col(p) == place)
        return out

    def next(self) -> bool:
        return self._move(self._beyond(False), False)

    def previous(self) -> bool:
        return self._move(self._beyond(True), True)

    def next_key(self) -> bool:
        """To the first entry of the next greater key."""
        return self._move(F.col("key") > self._value(self._entry()["key"]), False)

    def previous_key(self) -> bool:
        """To the last entry of the next lesser key."""
        return self._move(F.col("key") < self._value(self._entry()["key"]), True)

    # -- counts ----------------------------------------------------------------------------

    def count(self) -> int:
        return self._entries.count()

    def rank(self, key) -> int:
        """Entries below a key."""
        return self._entries.where(F.col("key") < self._value(key)).count()

    def count_at(self, key=None) -> int:
        """Entries of a key, the present one unless named."""
        value = self._value(self._entry()["key"]) if key is None else self._value(key)
        return self._entries.where(F.col("key") == value).count()

    def seek_rank(self, rank: int) -> bool:
        """To the entry with so many before it."""
        self._at = None
        if rank < 0:
            return False
        place = F.struct("key", *self._places)
        for n, first, last in self._ranges():
            if rank < n:
                own = self._entries
                for at, low in ((first, True), (last, False)):
                    if at["key"] == at["key"]:  # a number's own bound is one that files are pruned by
                        own = own.where(F.col("key") >= self._value(at["key"]) if low else F.col("key") <= self._value(at["key"]))
                    key = self._value(at["key"]) if at["key"] == at["key"] else F.lit(at["key"])
                    end = F.struct(key.cast(self._by.kind).alias("key"), *(literal(at[p], k, p).cast(k).alias(p) for p, k in zip(self._places, self._kinds, strict=True)))
                    own = own.where(place >= end if low else place <= end)
                self._at = own.orderBy("key", *self._places).offset(rank).limit(1).first()
                break
            rank -= n
        return self._at is not None

    def _ranges(self) -> list[tuple]:
        """How many entries there are in each range of them, with its first and last; counted once."""
        if self._counted is None:
            place = F.struct("key", *self._places)
            dealt = self._entries.repartitionByRange("key", *self._places).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last"))
            self._counted = sorted((tuple(r[1:]) for r in dealt.collect()), key=lambda r: tuple(r[1]))  # one row a partition
        return self._counted
