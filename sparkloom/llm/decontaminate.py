"""Benchmark decontamination: Wu-Manber search for many word windows at once.

A window is 10 consecutive words of a benchmark item; an item of fewer words is one
window.  Windows of one length make one searcher: a shift table over blocks of two
words tells how far the text may be skipped, blocks with shift zero lead through a
bucket of the windows that end with that block, and a direct comparison of the words confirms.

The benchmark is read in blocks of ITEMS items or BYTES of text; the tables of a block are built when
its turn comes, broadcast for one pass over the documents, and dropped when the pass is stored, so what
the driver and the workers hold is bounded by the block, not by the benchmark.

Defined results: null or wordless texts have no words and no hits; items without
words have no window; repeated benchmark rows count once (by item_id), null item ids are
not reported as items but their windows still hit; repeated document rows are judged each; empty tables give no hits or no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE, BLOCK = 10, 2
#: Benchmark items searched in one pass, and bytes of their text.
ITEMS, BYTES = 20_000, 16 << 20
#: A-Z become a-z; ASCII bytes that are no word become a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def tables_of(windows: dict[tuple[bytes, ...], set]) -> tuple[int, int, dict, dict]:
    """Of windows of one length: that length, the words in a block, the shifts of blocks, the windows by last block."""
    m = len(next(iter(windows)))
    b = min(BLOCK, m)
    shift: dict = {}
    bucket: dict = {}
    for w, items in windows.items():
        for end in range(b, m + 1):
            block = w[end - b : end] if b > 1 else w[end - 1]
            shift[block] = min(shift.get(block, m), m - end)
        bucket.setdefault(w[m - b :] if b > 1 else w[-1], []).append((list(w), items))
    return m, b, shift, bucket


class Searcher:
    """Wu-Manber over sequences of words, all of one length."""

    def __init__(self, m: int, b: int, shift: dict, bucket: dict) -> None:
        self.m, self.b, self.shift, self.bucket = m, b, shift, bucket

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """Where a window starts, and its items, in order."""
        m, b, shift, bucket = self.m, self.b, self.shift, self.bucket
        far, i, n = m - b + 1, m, len(words)
        while i <= n:
            block = (words[i - 2], words[i - 1]) if b > 1 else words[i - 1]
            if step := shift.get(block, far):
                i += step
                continue
            for w, items in bucket[block]:
                if words[i - m : i] == w:
                    yield i - m, items
            i += 1


def tables(items: list[tuple], size: int = SIZE) -> list[tuple[int, int, dict, dict]]:
    """What the searchers of these items need, as plain values that can be broadcast."""
    by: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            by[n][tuple(words[i : i + n])].update(() if item is None else (item,))
    return [tables_of(w) for _, w in sorted(by.items())]


def searchers(given) -> list[Searcher]:
    return [Searcher(*t) for t in given]


def search(words: list[bytes], finders: list[Searcher]) -> tuple[list[tuple[int, int]], set]:
    """Merged ranges of hit words, and the items found."""
    spans, items = [], set()
    for f in finders:
        for at, found in f.find(words):
            spans.append((at, at + f.m))
            items |= found
    merged: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(e, merged[-1][1])
        else:
            merged.append((a, e))
    return merged, items


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "")
        if len(block) >= ITEMS or size >= BYTES:
            yield block
            block, size = [], 0
    yield block


def with_last(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether none comes after it."""
    before = next(blocks)
    for block in blocks:
        yield before, False
        before = block
    yield before, True


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_leaks(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Every row of documents with its columns doc_id, text and the hits: n_words, spans, items."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(F.coalesce("text", F.lit("")), 256)))
    kind = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>"
    passes: list[DataFrame] = []
    for block, last in with_last(item_blocks(benchmark)):
        given = documents.sparkSession.sparkContext.broadcast(tables(block, size))

        def work(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            finders = searchers(given.value)
            for batch in common.chunks(batches):
                out: list[list] = [[], [], [], []]
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    spans, items = search(words, finders)
                    for x, v in zip(out, (len(words), [a for a, _ in spans], [e for _, e in spans], list(items)), strict=True):
                        x.append(v)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True)), *([batch.column(2)] if batch.num_columns > 2 else [])], names=["doc_id", "n_words", "starts", "ends", "items", *(["row"] if batch.num_columns > 2 else [])])

        if last and not passes:
            return rows.mapInArrow(work, kind)
        passes.append(common.stored(keyed.mapInArrow(work, kind + ", row string")).withColumn("pass", F.lit(len(passes))))
        given.destroy()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    copies = every.groupBy("row", "pass").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("starts").alias("starts"), F.first("ends").alias("ends"), F.first("items").alias("items"), F.count("*").alias("n"))
    whole = copies.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("items")).alias("items"), F.max("n").alias("n"))
    return whole.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc_id", "n_words", "starts", "ends", "items")


def digests(found: DataFrame) -> DataFrame:
    """Counts and the digest of the items, from find_leaks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, count, digest = [], [], []
            for starts, ends, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                n = reach = 0
                for a, e in sorted(zip(starts, ends, strict=True)):
                    n += max(0, e - max(a, reach))
                    reach = max(reach, e)
                own = sorted({str(i) for i in items})
                hit.append(n)
                count.append(len(own))
                digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(work, RESULT)


def clean(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows without any hit, with all columns; each block of the benchmark is a filter of its own."""
    schema = documents.schema
    at = documents.columns.index("text")
    for block, last in with_last(item_blocks(benchmark)):
        given = documents.sparkSession.sparkContext.broadcast(tables(block, size))

        def work(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            finders = searchers(given.value)
            for batch in common.chunks(batches):
                yield batch.filter(pa.array([not search(words_of(t), finders)[0] for t in batch.column(at).to_pylist()], pa.bool_()))

        documents = documents.mapInArrow(work, schema)
        if not last:
            documents = common.stored(documents)
            given.destroy()
    return documents


def op6_decontaminate(spark, sf_dir):
    return digests(find_leaks(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
      FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT x.k, x.i, x.n, p.item_id FROM x JOIN p ON x.n = p.n AND x.s = p.s),
c AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) FROM h) GROUP BY k),
m AS (SELECT k, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN m USING (k)
"""
