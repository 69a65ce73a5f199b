"""Upkeep of datasets: compaction, consolidation, vacuum, verification, indexes, rollups, advice."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedError
from ..operators.scan import FILE, Scan
from . import dataset as datasets
from .dataset import ALREADY_THERE, DATA, LOG, MARKS, Commit, Dataset, Object, _load

#: Rows of an object that are held against one another at once when its order is verified.
BLOCK = 1 << 16


def compaction_plan(dataset: Dataset, target_rows: int, fan_in: int = 8) -> list[list[Object]]:
    """Tiers: within a partition, small objects (and those with marked rows) put together up to the target, or as many rows as a task sorts."""
    if dataset.layout.sort_key or dataset.layout.partition:
        target_rows = min(target_rows, datasets.SORTED)
    plan: list[list[Object]] = []
    by: dict[str | None, list[Object]] = {}
    for o in dataset.objects():
        if o.rows < target_rows or o.marked:
            by.setdefault(o.partition, []).append(o)
    for own in by.values():
        group: list[Object] = []
        rows = 0
        for o in sorted(own, key=lambda o: (o.level, o.rows, o.key)):
            if group and (rows + o.rows > target_rows or len(group) >= fan_in):
                plan.append(group)
                group, rows = [], 0
            group.append(o)
            rows += o.rows - o.marked
        plan.append(group)
    return [g for g in plan if len(g) > 1 or any(o.marked for o in g)]


def compact(dataset: Dataset, target_rows: int = 1 << 20, fan_in: int = 8) -> Commit:
    """Writes small objects together; a new version with the same rows.  Late rows are only ever merged, never dropped."""
    done = Commit(ALREADY_THERE, dataset.version)
    for group in compaction_plan(dataset, target_rows, fan_in):
        made = dataset._write(dataset._read(group).drop(FILE), max(o.level for o in group) + 1, files=1, rows=_rows(group))
        keys = [o.key for o in group]
        done = _swap(dataset, "compact", group, keys, made)
    return done


def level_plan(dataset: Dataset) -> list[list[Object]]:
    """Levels: within a partition, all objects of level 0 with those of level 1 whose keys they reach."""
    if not dataset.layout.sort_key:
        raise UnsupportedError("levels need a sort key")
    by: dict[str | None, list[Object]] = {}
    for o in dataset.objects():
        by.setdefault(o.partition, []).append(o)
    key = dataset.layout.sort_key[0]
    plan = []
    for _, own in sorted(by.items(), key=lambda x: str(x[0])):
        new = [o for o in own if o.level == 0]
        ranges = [dataset._summaries(o).get(key, (None, None))[:2] for o in new]
        unknown = any(least is None for least, _ in ranges)

        def reached(o: Object, ranges=ranges, unknown=unknown) -> bool:
            least, most = dataset._summaries(o).get(key, (None, None))[:2]
            return unknown or least is None or any(least <= b and a <= most for a, b in ranges)

        if new:
            plan.append(new + [o for o in own if o.level > 0 and reached(o)])
    return plan


def compact_levels(dataset: Dataset, target_rows: int = 1 << 20) -> Commit:
    """New objects and those of level 1 that they reach, as objects of level 1 that share no key; the rest is not touched.

    The target is the most rows that an object should have: above what a task sorts, it is that."""
    done = Commit(ALREADY_THERE, dataset.version)
    for group in level_plan(dataset):
        files = max(1, -(-_rows(group) // target_rows))
        made = dataset._write(dataset._read(group), 1, files=files, rows=_rows(group))
        done = _swap(dataset, "level", group, [o.key for o in group], made)
    return done


def consolidate(dataset: Dataset, partition: str | None, target_rows: int = 1 << 20) -> Commit:
    """A calm partition as objects that share no key: cut by range of the sort key."""
    own = [o for o in dataset.objects() if o.partition == partition]
    if not own:
        return Commit(ALREADY_THERE, dataset.version)
    files = max(1, -(-_rows(own) // target_rows))
    made = dataset._write(dataset._read(own), max(o.level for o in own) + 1, files=files, rows=_rows(own))
    return _swap(dataset, "consolidate", own, [o.key for o in own], made)


def _rows(objects: list[Object]) -> int:
    return sum(o.rows - o.marked for o in objects)


def _swap(dataset: Dataset, what: str, read: list[Object], keys: list[str], made: list[Object]) -> Commit:
    """Objects for objects of the same rows; abandoned when one of those read has changed since."""

    def change(state):
        if any(state.objects.get(o.key) != o for o in read):
            return Commit("Abandoned", state.version)
        return made, keys, {}

    return dataset._commit(what, change, data=False)


def run_compaction(dataset: Dataset, rounds: int, pause_s: float = 0.0, **options) -> list[Commit]:
    """A loop that one process runs: refresh, compact, wait."""
    out = []
    for i in range(rounds):
        dataset.refresh()
        out.append(compact(dataset, **options))
        if i < rounds - 1:
            time.sleep(pause_s)
    return out


def vacuum(dataset: Dataset, keep_versions: int = 10, older_than_s: float = 7 * 86400, dry_run: bool = False) -> list[str]:
    """Deletes files that none of the last versions names and that are older than the window; gives their names."""
    dataset.refresh()
    named: set[str] = set()
    for version in range(max(1, dataset.version - keep_versions + 1), dataset.version + 1):
        for o in _load(dataset.store, version).objects.values():
            named |= {o.key} | ({o.marks} if o.marks else set())
    limit = (time.time() - older_than_s) * 1000
    gone = [n for folder in (DATA, MARKS, "imports") for n, _, at in dataset.store.list(folder, deep=True) if at <= limit and not any(n == k or n.startswith(k + "/") for k in (n, *_parents(n)) if k in named)]
    if not dry_run:
        for n in gone:
            dataset.store.delete(n)
    return gone


def _parents(name: str) -> list[str]:
    parts = name.split("/")
    return ["/".join(parts[:i]) for i in range(1, len(parts))]


def erase(dataset: Dataset, where, older_than_s: float = 0.0) -> Commit:
    """Deletes rows for good: files that hold them are written anew, marks included, and old versions' files go once past the delay."""
    done = dataset.delete(where)
    marked = [o for o in dataset.objects() if o.marked]
    if marked:
        made = dataset._write(dataset._read(marked), max(o.level for o in marked), files=len(marked), rows=_rows(marked))
        _swap(dataset, "erase", marked, [o.key for o in marked], made)
    vacuum(dataset, keep_versions=1, older_than_s=older_than_s)
    return done


def verify(dataset: Dataset) -> DataFrame:
    """Findings: objects that are missing, of another size or row count, of several partition values, or unsorted."""
    spark = dataset.spark
    sizes = {n: size for folder in (DATA, "imports") for n, size, _ in dataset.store.list(folder, deep=True)}
    objects = dataset.objects()
    found = [(o.key, "missing") for o in objects if o.key not in sizes]
    found += [(o.key, f"{sizes[o.key]} bytes, {o.bytes} recorded") for o in objects if o.key in sizes and sizes[o.key] != o.bytes]
    there = [o for o in objects if o.key in sizes]
    kind = "key string, finding string"
    out = spark.createDataFrame(found, kind)
    if not there:
        return out
    rows = spark.createDataFrame([(o.key, o.rows - o.marked) for o in there], "key string, recorded long")
    df = dataset._read(there).withColumn("__object", dataset._key_of(FILE))  # a column may be named key
    part = dataset._partition(dataset.schema)
    counted = df.groupBy(F.col("__object").alias("key")).agg(F.count("*").alias("n"), F.count_distinct(part.column).alias("parts") if part is not None else F.lit(1).alias("parts"))
    checked = rows.join(counted, "key", "left")
    out = out.unionByName(checked.where(F.coalesce("n", F.lit(0)) != F.col("recorded")).select("key", F.format_string("%s rows, %s recorded", F.coalesce("n", F.lit(0)).cast("string"), F.col("recorded").cast("string")).alias("finding")))
    out = out.unionByName(checked.where("parts > 1").select("key", F.lit("several partition values").alias("finding")))
    sort = dataset.layout.sort_key
    imported = {o.key for o in there if o.names is not None}
    if sort and len(there) > len(imported):
        key = F.struct(*(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(f"s{i}") for i, c in enumerate(sort)))
        # a block of rows at a time, then the first and last rows of an object's blocks: no task holds an object
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * _rows(there) // datasets.SORTED))
        numbers = F.broadcast(spark.createDataFrame([(i, o.key) for i, o in enumerate(there) if o.key not in imported], "number int, key string"))  # rows carry no names
        cut = df.select("__object", "__row", F.expr(f"__row div {BLOCK}").alias("block"), key.alias("k")).join(numbers, F.col("__object") == F.col("key")).select("number", "__row", "block", "k").repartition(n, "number", "block")
        within, across = Window.partitionBy("number", "block").orderBy("__row"), Window.partitionBy("number").orderBy("__row")
        held = cut.select("number", "__row", "k", F.lag("k").over(within).alias("b"), F.lead("__row").over(within).alias("next"))
        ends = held.where("b is null or next is null").select("number", "k", F.lag("k").over(across).alias("b"))
        unsorted = held.select("number", "k", "b").unionByName(ends).where("b > k").select("number").distinct().join(numbers, "number")
        out = out.unionByName(unsorted.select("key", F.lit("not in the order of the sort key").alias("finding")))
    return out


def index(dataset: Dataset, *columns: str) -> Commit:
    """Writes all objects anew with Bloom filters on columns, which equality and membership then skip row groups by."""
    ids = {f["field"]["name"]: f"f{f['id']}" for f in dataset._state.fields}
    options = {f"parquet.bloom.filter.enabled#{ids[c]}": "true" for c in columns}
    own = dataset.objects()
    if not own:
        return Commit(ALREADY_THERE, dataset.version)
    made = dataset._write(dataset._read(own), max(o.level for o in own), files=len(own), options=options, rows=_rows(own))
    return _swap(dataset, "index", own, [o.key for o in own], made)


class Rollup:
    """Counts and sums per object and key, kept beside the dataset; questions on the keys are answered without its rows.

    States belong to objects, so an append adds states of its objects alone, and objects that went are passed over."""

    def __init__(self, dataset: Dataset, name: str, keys: Iterable[str], sums: Iterable[str]) -> None:
        self.dataset, self.keys, self.sums = dataset, list(keys), list(sums)
        self._folder = dataset.store.path(f"rollups/{name}")
        for c in self.sums:
            if not isinstance(dataset.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                raise UnsupportedError(f"{c}: only integers keep exact sums here")

    def _kept(self) -> DataFrame | None:
        return self.dataset.spark.read.parquet(self._folder) if self.dataset.store.exists(self._folder[len(self.dataset.store.root) + 1 :]) else None

    def update(self) -> int:
        """Adds the states of objects that have none; gives their number."""
        if any(o.marks for o in self.dataset.objects()):
            raise UnsupportedError("compact marked objects first")
        kept = self._kept()
        have = {r[0] for r in kept.select("object").distinct().collect()} if kept is not None else set()
        new = [o for o in self.dataset.objects() if o.key not in have]
        if new:
            df = self.dataset._read(new).withColumn("object", self.dataset._key_of(FILE))
            df.groupBy("object", *self.keys).agg(F.count("*").alias("__rows"), *(F.sum(c).alias(f"__sum_{c}") for c in self.sums)).write.mode("append").parquet(self._folder)
        return len(new)

    def ask(self, *keys: str, where: Callable[[Callable], Column] | None = None) -> DataFrame:
        """rows and sums by some of the keys."""
        self.update()
        live = self.dataset.spark.createDataFrame([(o.key,) for o in self.dataset.objects()], "object string")
        kept = self._kept()
        states = kept.join(live, "object", "left_semi")
        if where is not None:
            states = states.where(where(lambda n: F.col(n)))
        return states.groupBy(*keys).agg(F.sum("__rows").alias("rows"), *(F.coalesce(F.sum(f"__sum_{c}"), F.lit(0)).alias(c) for c in self.sums))


def advice(dataset: Dataset, questions: Iterable) -> list[tuple[str, int]]:
    """Columns that past filters name, by the bytes that a layout sorted by them could have passed over."""
    said: Counter = Counter()
    total = sum(o.bytes for o in dataset.objects())
    for q in questions:
        p = dataset._asked(q)
        live = sum(o.bytes for o in dataset.objects() if p.outcomes(dataset._summaries(o))[0])
        for c in p.columns:
            said[c] += live
    return [(c, n) for c, n in said.most_common() if n and total]


def history(dataset: Dataset) -> DataFrame:
    """The log: version, operation, milliseconds, objects added and removed."""
    import json

    rows = []
    for name, _, _ in dataset.store.list(LOG):
        if name.rsplit("/", 1)[-1][:20].isdigit():
            h = json.loads(dataset.store.get(name))
            rows.append((h["version"], h["operation"], h["at"], len(h["add"]), len(h["remove"])))
    return dataset.spark.createDataFrame(rows, "version long, operation string, at long, added int, removed int")


def scan_without(dataset: Dataset, keys: Iterable[str]) -> Scan:
    """The dataset's rows but for some objects'."""
    gone = set(keys)
    return Scan(dataset._read([o for o in dataset.objects() if o.key not in gone]), (FILE, "__row"))
