"""Aggregators of one's own: a seed, a step over blocks of values, a merge of states.

States are folded per partition and key on the executors, and merged by key: a key gets one
state from each partition, so a key with most of the rows costs no task more than that.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Scan


NAN = float("nan")


class Aggregator(Protocol):
    def seed(self) -> Any: ...

    def step(self, state: Any, values: np.ndarray) -> Any:
        """Folds a block of the column's values, nulls taken out."""

    def merge(self, state: Any, other: Any) -> Any: ...

    def finish(self, state: Any) -> Any: ...


def aggregate(scan: Scan, keys: dict[str, object], column, aggregator: Aggregator, kind: T.DataType, name: str = "value") -> DataFrame:
    """The aggregator's answer by key."""
    s = scan._symbol(column)
    picked = scan._lean.select(*(scan._symbol(k).column.alias(n) for n, k in keys.items()), s.column.alias("__x"))
    key_fields = list(picked.schema)[:-1]
    state_schema = T.StructType([*key_fields, T.StructField("__state", T.BinaryType())])
    n = len(key_fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        kinds = None
        for batch in batches:
            kinds = [f.type for f in batch.schema][:n]
            own = [_plain(batch.column(i)) for i in range(n)]
            valid = np.asarray(batch.column(n).is_valid())
            values = np.asarray(batch.column(n).to_numpy(zero_copy_only=False))
            for at in _places([batch.column(i) for i in range(n)], batch.num_rows):
                key = tuple(c[at[0]] for c in own)
                state = states.get(key)
                states[key] = aggregator.step(aggregator.seed() if state is None else state, values[at[valid[at]]])
        if states:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in states], kinds[i]) for i in range(n)), pa.array([pickle.dumps(x) for x in states.values()], pa.binary())], names=[*(f.name for f in key_fields), "__state"])

    folded = picked.mapInArrow(fold, state_schema)

    @F.udf(kind, useArrow=False)
    def merged(states: list[bytes]):
        out = None
        for raw in states:
            state = pickle.loads(raw)  # noqa: S301  written by the step above
            out = state if out is None else aggregator.merge(out, state)
        return aggregator.finish(out if out is not None else aggregator.seed())

    return folded.groupBy(*(f.name for f in key_fields)).agg(merged(F.collect_list("__state")).alias(name))


def _plain(column: pa.Array) -> list:
    """Values as dictionary keys; NaNs are one object, and both zeros one value."""
    if pa.types.is_floating(column.type):
        return [None if v is None else NAN if v != v else v + 0.0 for v in column.to_pylist()]
    return column.to_pylist()


def _places(columns: list[pa.Array], rows: int) -> list[np.ndarray]:
    """The rows of each key of a batch, in their order."""
    code = np.zeros(rows, np.int64)
    for column in columns:
        if pa.types.is_floating(column.type):  # as above
            column = pc.add(pc.if_else(pc.is_nan(column), pa.scalar(NAN, column.type), column), pa.scalar(0.0, column.type))
        own = pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return [at for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(at)]


class Welford:
    """Count, mean and sum of squared deviations, in one pass; finishes as the sample variance."""

    def seed(self):
        return 0, 0.0, 0.0

    def step(self, state, values: np.ndarray):
        values = values[~np.isnan(values)] if values.dtype.kind == "f" else values
        if not len(values):
            return state
        mean = float(values.mean())
        return self.merge(state, (len(values), mean, float(((values - mean) ** 2).sum())))

    def merge(self, a, b):
        n = a[0] + b[0]
        if not n:
            return a
        delta = b[1] - a[1]
        return n, a[1] + delta * b[0] / n, a[2] + b[2] + delta * delta * a[0] * b[0] / n

    def finish(self, state):
        return max(0.0, state[2] / (state[0] - 1)) if state[0] > 1 else None
