"""Parquet files: writing with options, metadata, verification, taking a torn append away."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError, SchemaError
from .store import Store

CODECS = ("uncompressed", "snappy", "gzip", "brotli", "zstd", "lz4", "lz4_raw")


@dataclass(frozen=True)
class WriteReport:
    path: str
    rows: int
    files: int
    bytes: int


def write(df: DataFrame, path: str, codec: str = "zstd", bloom: Iterable[str] = (), sort: Iterable[str] = (), row_group_bytes: int | None = None, page_bytes: int | None = None, page_version: int = 1, checksums: bool = True, dictionary: bool = True, files: int | None = None, append: bool = False) -> WriteReport:
    """Writes a scan or result as Parquet.  Sorting columns cut and order the files, so that their statistics prune."""
    if codec not in CODECS:
        raise SchemaError(f"no codec {codec!r}")
    if page_version not in (1, 2):
        raise SchemaError("data pages are of version 1 or 2")
    options = {"compression": codec, "parquet.writer.version": f"v{page_version}", "parquet.page.write-checksum.enabled": str(checksums).lower(), "parquet.enable.dictionary": str(dictionary).lower()}
    options |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    if page_bytes:
        options["parquet.page.size"] = str(page_bytes)
    sort = list(sort)
    if sort:
        order = [F.col(c).asc_nulls_last() for c in sort]
        df = (df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    elif files:
        df = df.coalesce(files)
    from pyspark.sql import Observation

    seen = Observation()
    store = Store(df.sparkSession, path)
    before = {n for n, _, _ in store.list("", deep=True)}
    df.observe(seen, F.count("*").alias("rows")).write.mode("append" if append else "errorifexists").options(**options).parquet(path)
    new = [(n, size) for n, size, _ in store.list("", deep=True) if n not in before and n.endswith(".parquet")]
    return WriteReport(path, seen.get["rows"], len(new), sum(size for _, size in new))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Row groups and chunks of files: file, row_group, rows, column, codec, bytes, values, nulls, least, greatest."""
    files = [Store(spark, path).path(n) if n else path for n, _, _ in Store(spark, path).list("", deep=True) if n.endswith(".parquet")] or [path]
    footers = spark.read.format("binaryFile").load(files)

    def work(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = pq.ParquetFile(io.BytesIO(content)).metadata
                for g in range(m.num_row_groups):
                    for c in range(m.num_columns):
                        chunk = m.row_group(g).column(c)
                        s = chunk.statistics
                        rows.append((name, g, m.row_group(g).num_rows, chunk.path_in_schema, chunk.compression, chunk.total_compressed_size, chunk.num_values, s.null_count if s and s.has_null_count else None, str(s.min) if s and s.has_min_max else None, str(s.max) if s and s.has_min_max else None))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("file", "row_group", "rows", "column", "codec", "bytes", "values", "nulls", "least", "greatest")
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names=list(names))

    return footers.select("path", "content").mapInArrow(work, "file string, row_group int, rows long, column string, codec string, bytes long, values long, nulls long, least string, greatest string")


def verify(spark: SparkSession, path: str) -> list[str]:
    """Reads every file whole and counts; gives what does not read or does not count as its footer says."""
    findings = []
    names = [n for n, _, _ in Store(spark, path).list("", deep=True) if n.endswith(".parquet")]
    for name in names:
        file = Store(spark, path).path(name)
        try:
            df = spark.read.parquet(file)
            rows = df.count()
            read = df.select(F.count("*").alias("n"), *(F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns)).first()["n"]
            if rows != read:
                findings.append(f"{name}: {read} rows read, {rows} told")
        except Exception as error:  # noqa: BLE001  a finding is what is asked for
            findings.append(f"{name}: {str(error).splitlines()[0][:200]}")
    return findings


def repair(spark: SparkSession, path: str) -> list[str]:
    """Removes files of a folder that a torn append left unreadable; gives their names."""
    store = Store(spark, path)
    gone = []
    for name, size, _ in store.list("", deep=True):
        if not name.endswith(".parquet"):
            continue
        try:
            if size < 12:
                raise QueryError("too short")
            spark.read.parquet(store.path(name)).schema  # noqa: B018  reads the footer
        except Exception:  # noqa: BLE001
            store.delete(name)
            gone.append(name)
    return gone
