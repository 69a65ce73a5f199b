"""What several corpus operators share: table access, the shared folder, flat views of text, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Bytes of text that a Python worker handles at once; one longer document is handled alone.
CHUNK = 2 << 20
#: Rows in an Arrow batch at most: texts can be long, and a batch is in memory as a whole.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; all others, whatever they are called, stay unread."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan dealt among all cores, where its files give fewer tasks than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def width(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def under(h: str, share: float) -> Column:
    """Whether a 64-bit hash is among the smallest of its range."""
    return F.col(h).cast("double") / 2.0**63 < 2.0 * min(share, 1.0) - 1 if share < 1 else F.lit(True)


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK, sizes: Callable[[pa.Array], np.ndarray] = lengths) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers are used again, and keep what they held


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column one after another, and where each row starts and ends (null: empty)."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the rolling hashes, and its inverse modulo 2**64.
RADIX = 0x9E3779B97F4A7C15
INVERSE = pow(RADIX, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of ranges of a sequence of 64-bit words, equal for equal content wherever it stands."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = powers(RADIX, n), powers(INVERSE, n)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def words_by_row(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words [^\\x20\\x09-\\x0D]+ of the texts, and the row of each."""
    words = [t.split() for t in texts]
    return word_names([w for own in words for w in own]), np.repeat(np.arange(len(texts)), [len(w) for w in words])
