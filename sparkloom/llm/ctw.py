"""LM scoring by context-tree weighting over bytes, each byte decomposed into eight binary decisions.

The text is scored as its token sequence: A-Z lower-cased, words joined by one space, one
end byte.  Each of the 255 nodes of a byte's binary tree has a context tree over the
preceding bytes, up to DEPTH of them.  Every node estimates by Krichevsky-Trofimov, and
a context's weighted probability mixes its own estimate with the product of its children's,
half and half, from the deepest contexts up.  KT counts do not depend on the order in which text was
read, so the tree is built from counts of (context, byte) grams: gathered by chunk,
merged by context in one shuffle.  Scoring then mixes the estimates along the path of
contexts, each with its posterior weight, and adds up log10 probabilities; divided by the
bytes, that is the code length per byte.

The grams and words of the corpus stay distributed: chunks of documents send their distinct
grams and words to the buckets that hold the counts, and get answers back.  Chunks are dealt
among salts, MERGED chunks each.  The distinct keys of each salt's part of a bucket are put together
first; the model answers these once, and the answered keys serve the salt's chunks, so that
no salt gets a copy of the model, only of what it asks.  Only the two shallowest depths (at most 257 x 255 nodes) are gathered and broadcast.

Beside it, the base score is the add-one unigram score of the same tokens.

Defined results: a null or blank text is its end alone; rows with a null doc_id are learned
from and not held out; repeated rows count each; without training rows every
estimate is the uniform prior; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .substring_dedup import packed, rolled, unpacked

DEPTH = 5
#: Text and documents in a chunk (a gram and a document's place fill 64 bits), and chunks whose counts one task merges at once.
TEXT, PLACE, MERGED = 6 << 20, 64 - 8 * (DEPTH + 1), 1024
#: Bytes of a chunk that are taken apart at once.
BLOCK = 1 << 20
FOLDS, HELD_OUT = 7, 2
END_WORD = np.uint64(0x5BD1E9955BD1E995)
WORDS, GRAMS = 0, 1
MODEL, REQUEST = "bucket int, salt int, kind int, total long, distinct long, blob binary", "bucket int, salt int, kind int, chunk long, blob binary"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, train) put together in chunks of canonical text."""
    ids: list = []
    train: list = []
    texts: list[bytes] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ids, train, texts, size
        if not ids:
            return
        gap = b"\n" * DEPTH
        raw = gap + gap.join(texts) + b"\n"
        blob = packed(np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "|u1"), np.array(train, "|u1"), np.array([len(t) for t in texts], "<i8"), np.frombuffer(raw, "|u1"))
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(os.urandom(8), "little") >> 1], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "docs"])
        ids, train, texts, size = [], [], [], 0

    for batch in common.chunks(batches):
        for i, t, learn in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            text = b" ".join((t or "").encode().lower().split())
            if size + len(text) > TEXT or len(ids) >> min(PLACE, 20):
                yield from flush()
            ids.append(i)
            train.append(learn)
            texts.append(text)
            size += len(text) + DEPTH
    yield from flush()


class Chunk:
    """The documents of a chunk, and their grams and words, a block of documents at a time."""

    def __init__(self, blob: bytes) -> None:
        self.ids, self.none, self.train, self.size, self.raw = unpacked(blob)
        self.start = DEPTH + np.append(0, np.cumsum(self.size + DEPTH)[:-1])

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of at most BLOCK bytes, or of one document."""
        ends = self.start + self.size
        lo = 0
        while lo < len(self.ids):
            hi = max(lo + 1, int(np.searchsorted(ends, self.start[lo] + BLOCK, side="right")))
            yield lo, hi
            lo = hi

    def grams(self, lo: int, hi: int) -> np.ndarray:
        """Sorted: the context, its most recent byte first, the byte, and PLACE bits of the document's place."""
        start, size = self.start[lo:hi] - self.start[lo], self.size[lo:hi]
        raw = self.raw[self.start[lo] - DEPTH : self.start[hi - 1] + size[-1] + 1]
        n = len(raw) - DEPTH
        code = np.zeros(n, np.uint64)
        for back in range(1, DEPTH + 1):
            code <<= np.uint64(8)
            code |= raw[DEPTH - back : DEPTH - back + n]
        code <<= np.uint64(8)
        code |= raw[DEPTH:]
        code <<= np.uint64(PLACE)
        step = np.zeros(n + 1, np.int8)  # +1 where a document starts, -1 after its end byte
        step[start] += 1
        step[start + size + 1] -= 1
        code = code[np.cumsum(step[:-1], dtype=np.int8) > 0]
        code |= np.repeat(np.arange(lo, hi, dtype=np.uint64), size + 1)
        code.sort()
        return code

    def words(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of all tokens, and the document's place of each."""
        raw = self.raw[self.start[lo] : self.start[hi - 1] + self.size[hi - 1] + 1]
        word = (raw != 32) & (raw != 10)
        start = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)) == 1)
        names = common.word_names(raw.tobytes().split())
        doc = np.searchsorted(self.start[lo:hi], start + self.start[lo], side="right") - 1 + lo
        return np.append(names, np.full(hi - lo, END_WORD)), np.append(doc, np.arange(lo, hi)).astype(np.int32)


def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with counts, put together."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return runs(keys[order], n[order])


def runs(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and how often each is there (or the sum of its weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys))) if weight is None else np.add.reduceat(weight, first, dtype=np.int64)


def bucket_of(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Grams go by the two most recent bytes of their context, so a bucket holds whole subtrees."""
    return (common.mix(keys >> np.uint64(8 * (DEPTH - 1)) if kind == GRAMS else keys) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, kind: int, buckets: int, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted keys, and what belongs to them, packed by bucket."""
    to = bucket_of(keys, kind, buckets)
    by = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edge)):
        at = by[edge[b] : edge[b + 1]]
        yield int(b), packed(rolled(keys[at]), *(m[at] for m in more))


def gathered(batches: Iterator[pa.RecordBatch], buckets: int, salts: int) -> Iterator[pa.RecordBatch]:
    """Of chunks: the distinct grams and words of all documents by bucket, with their counts in the training documents."""
    for chunk_id, blob in _rows(batches):
        chunk = Chunk(blob)
        words, grams = [], []
        for lo, hi in chunk.blocks():
            names, doc = chunk.words(lo, hi)
            order = np.argsort(names)
            words.append(runs(names[order], chunk.train[doc[order]]))
            codes = chunk.grams(lo, hi)
            learns = chunk.train[(codes & np.uint64((1 << PLACE) - 1)).astype(np.int32)]
            codes >>= np.uint64(PLACE)
            grams.append(runs(codes, learns))
        for kind, parts in ((WORDS, words), (GRAMS, grams)):
            keys, n = together(parts)
            yield from _emit([(b, chunk_id % salts, kind, chunk_id, x) for b, x in dealt(keys, kind, buckets, n)], REQUEST)


def merged(batches: Iterator[pa.RecordBatch], asked_too: bool = False) -> Iterator[pa.RecordBatch]:
    """Of (bucket, salt, kind) rows in order: one row for each, with the sums; asked_too keeps keys that no training document has."""
    at, keys, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal keys, n, held
        every = np.concatenate([keys, *(k for k, _ in held)])
        times = np.concatenate([n, *(c for _, c in held)])
        held = []
        order = np.argsort(every, kind="stable")
        every, times = every[order], times[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        keys, n = every[first], np.add.reduceat(times, first) if len(first) else times

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal keys, n
        if at is not None:
            fold()
            yield from _emit([(*at, int(n.sum()), int((n > 0).sum()), packed(rolled(keys), n))], MODEL)
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    for bucket, salt, kind, blob in _rows(batches):
        if (bucket, salt, kind) != at:
            yield from flush()
            at = bucket, salt, kind
        steps, times = unpacked(blob)
        own = np.cumsum(steps)
        used = times >= (0 if asked_too else 1)
        held.append((own[used], times[used]))
        if sum(len(k) for k, _ in held) > 1 << 20:
            fold()
    yield from flush()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _emit(rows: list[tuple], kind: str) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in kind.split(", ")), strict=True)
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=list(names))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 1/2, by Stirling's series after eight steps up."""
    below = np.ones_like(x)
    for i in range(8):
        below *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(below)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


def grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, *(np.bincount(inverse, v, len(found)) for v in values)


def nodes_at(codes: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context of depth bytes, place in the byte's tree: 1, then its bits) with their zeros and ones."""
    context = (codes >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8) if depth else np.zeros(len(codes), np.uint64)
    found, n = grouped(context | (codes & np.uint64(255)), n.astype(np.float64))
    byte = found & np.uint64(255) | np.uint64(256)
    keys = np.concatenate([(found & ~np.uint64(255)) | (byte >> np.uint64(8 - k)) for k in range(8)])
    ones = np.concatenate([np.where((byte >> np.uint64(7 - k)) & np.uint64(1), n, 0) for k in range(8)])
    return grouped(keys, np.tile(n, 8) - ones, ones)


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the posterior weight of their own estimate."""
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, children) - np.log(2.0)
    return both, np.exp(own - both - np.log(2.0))


def subtrees(codes: np.ndarray, n: np.ndarray, top: int = 2) -> tuple[dict, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By depth from top: sorted nodes with the probability of a one and the weight of it; and of the top nodes keys, zeros, ones, weighted logs."""
    levels: dict = {}
    below = None
    for depth in range(DEPTH, top - 1, -1):
        keys, zeros, ones = nodes_at(codes, n, depth)
        if below is None:
            log, own = log_kt(zeros, ones), np.ones(len(keys))
        else:
            parent = (below[0] >> np.uint64(16)) << np.uint64(8) | (below[0] & np.uint64(255))
            log, own = weigh(zeros, ones, np.bincount(np.searchsorted(keys, parent), below[1], len(keys)))
        levels[depth] = keys, (ones + 0.5) / (zeros + ones + 1.0), own
        below = keys, log
        last = keys, zeros, ones, log
    return levels, last


UPPER = "context int, node int, zeros double, ones double, log double"


def upper_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What depth one needs of the model's buckets: by most recent byte and node, zeros, ones and the sum of children's logs."""
    for *_, blob in _rows(batches):
        steps, n = unpacked(blob)
        if not len(steps):
            continue
        _, (keys, zeros, ones, log) = subtrees(np.cumsum(steps), n)
        found, zeros, ones, log = grouped((keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(255)), zeros, ones, log)
        yield pa.RecordBatch.from_arrays([pa.array((found >> np.uint64(8)).astype(np.int32)), pa.array((found & np.uint64(255)).astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(log)], names=["context", "node", "zeros", "ones", "log"])


def upper_mix(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Tables [most recent byte, node]: the share of depths zero and one in the probability of a one, and the weight left for deeper contexts."""
    zeros, ones, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for c, node, z, o, s in rows:
        zeros[c, node], ones[c, node], below[c, node] = z, o, s
    log, own1 = weigh(zeros, ones, below)
    _, own0 = weigh(zeros.sum(axis=0), ones.sum(axis=0), log.sum(axis=0))
    one1 = (ones + 0.5) / (zeros + ones + 1)
    one0 = (ones.sum(axis=0) + 0.5) / (zeros.sum(axis=0) + ones.sum(axis=0) + 1)
    return own0 * one0 + (1 - own0) * own1 * one1, (1 - own0) * (1 - own1)


def log10_bytes(codes: np.ndarray, levels: dict, mixed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log10 probability of each gram's byte in its context."""
    share, left = mixed
    out = np.zeros(len(codes))
    recent = (codes >> np.uint64(8 * DEPTH)).astype(np.int64)
    byte = codes & np.uint64(255) | np.uint64(256)
    for k in range(8):
        node = byte >> np.uint64(8 - k)
        one = np.full(len(codes), 0.5)
        for depth in sorted(levels, reverse=True):
            keys, estimate, own = levels[depth]
            if not len(keys):
                continue
            want = (codes >> np.uint64(8 * (DEPTH + 1 - depth))) << np.uint64(8) | node
            i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            one = np.where(keys[i] == want, own[i] * estimate[i] + (1 - own[i]) * one, 0.5)
        one = share[recent, node.astype(np.int64)] + left[recent, node.astype(np.int64)] * one
        out += np.log10(np.where((byte >> np.uint64(7 - k)) & np.uint64(1), one, 1 - one))
    return out


def answers(batches: Iterator[pa.RecordBatch], mixed) -> Iterator[pa.RecordBatch]:
    """Of rows in order of bucket, salt, kind, chunk, the counts (chunk -1) first: for each request its keys with their counts or logs."""

    def value(kind: int, every: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        if kind == GRAMS:
            return log10_bytes(every, subtrees(codes, n)[0] if len(codes) else {}, mixed.value).astype(np.float32)
        i = np.minimum(np.searchsorted(codes, every), max(len(codes) - 1, 0))
        return np.where(codes[i] == every, n[i], 0) if len(codes) else np.zeros(len(every), np.int64)

    yield from replied(batches, value, lambda keys, value: packed(rolled(keys), value))


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in that order, the answered keys (chunk -1) first: for each request what its keys were answered."""
    return replied(batches, lambda _, every, keys, value: value[np.searchsorted(keys, every)], lambda _, value: packed(value))


def replied(batches: Iterator[pa.RecordBatch], value, reply) -> Iterator[pa.RecordBatch]:
    """Requests of one (bucket, salt, kind) answered together, MERGED at once, by value(kind, keys, the two arrays of the first row)."""
    at, held = None, []
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = none

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if not held:
            return
        keys = [np.cumsum(unpacked(b)[0]) for _, b in held]  # their counts are the model's affair
        every = np.unique(np.concatenate(keys))
        found = value(at[2], every, *first)
        yield from _emit([(*at, chunk, reply(k, found[np.searchsorted(every, k)])) for (chunk, _), k in zip(held, keys, strict=True)], REQUEST)
        held = []

    for bucket, salt, kind, chunk, blob in _rows(batches):
        if (bucket, salt, kind) != at:
            yield from flush()
            at, first = (bucket, salt, kind), none
        if chunk < 0:
            steps, values = unpacked(blob)
            first = np.cumsum(steps), values
        else:
            held.append((chunk, blob))
            if len(held) >= MERGED:
                yield from flush()
    yield from flush()


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def finished(batches: Iterator[pa.RecordBatch], buckets: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Of chunks with their answers: a row for each document."""
    for _, blob, replies in _rows(batches):
        chunk = Chunk(blob)
        docs = len(chunk.ids)
        got = {(r["kind"], r["bucket"]): unpacked(r["blob"])[0] for r in replies}

        def answered(keys: np.ndarray, kind: int, got=got) -> np.ndarray:
            to = bucket_of(keys, kind, buckets)
            by = np.argsort(to, kind="stable")
            edge = np.searchsorted(to[by], np.arange(buckets + 1))
            out = np.zeros(len(keys))
            for b in np.flatnonzero(np.diff(edge)):
                out[by[edge[b] : edge[b + 1]]] = got[kind, int(b)]
            return out

        words = [chunk.words(lo, hi) for lo, hi in chunk.blocks()]
        own = np.unique(np.concatenate([np.unique(names) for names, _ in words]))
        count = answered(own, WORDS)
        tokens, known, base, score = (np.zeros(docs) for _ in range(4))
        for names, doc in words:
            n = count[np.searchsorted(own, names)]
            tokens += np.bincount(doc, minlength=docs)
            known += np.bincount(doc, n > 0, docs)
            base += np.bincount(doc, np.log10((n + 1) / (total + distinct + 1)), docs)
        grams = [chunk.grams(lo, hi) for lo, hi in chunk.blocks()]
        own = np.unique(np.concatenate([runs(g >> np.uint64(PLACE))[0] for g in grams]))
        logs = answered(own, GRAMS)
        for g in grams:
            keys, n = runs(g >> np.uint64(PLACE))
            score += np.bincount((g & np.uint64((1 << PLACE) - 1)).astype(np.int32), np.repeat(logs[np.searchsorted(own, keys)], n), docs)
        size = chunk.size + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.ids, mask=chunk.none.astype(bool)), pa.array(chunk.train == 0), *map(pa.array, (tokens.astype(np.int64), known.astype(np.int64))), pa.array(np.full(docs, total, np.int64)), *map(pa.array, (base, score, size.astype(np.int64), -score * np.log2(10) / size))],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )


def score_texts(documents: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Learns from the documents outside the held-out fold, and scores all."""
    spark = documents.sparkSession
    buckets = common.width(spark)
    train = F.coalesce(common.fold("doc_id", folds) != held_out, F.lit(True))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", train)
    store = common.stored(rows.mapInArrow(chunked, "chunk long, docs binary"))
    salts = -(-store.count() // MERGED) or 1
    asked = common.stored(store.mapInArrow(lambda b: gathered(b, buckets, salts), REQUEST))

    def sorted_by(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(buckets, "bucket", "salt").sortWithinPartitions(*keys)

    def summed(df: DataFrame, asked_too: bool = False) -> DataFrame:
        return common.stored(sorted_by(df.select("bucket", "salt", "kind", "blob"), "bucket", "salt", "kind").mapInArrow(lambda b: merged(b, asked_too), MODEL))

    def asking(df: DataFrame, chunk: Column) -> DataFrame:
        return df.select("bucket", F.lit(0).alias("salt"), "kind", chunk.cast("long").alias("chunk"), "blob")

    parts = summed(asked, True)
    model = summed(parts.withColumn("salt", F.lit(0)))
    words = model.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("distinct")).first()
    total, distinct = words[0] or 0, words[1] or 0
    upper = model.where(F.col("kind") == GRAMS).select("blob").mapInArrow(upper_sums, UPPER).groupBy("context", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("log"))
    mixed = spark.sparkContext.broadcast(upper_mix(upper.collect()))  # 256 x 255 rows at most
    each = asking(parts, F.col("salt")).unionByName(asking(model, F.lit(-1)))
    known = sorted_by(each, "bucket", "salt", "kind", "chunk").mapInArrow(lambda b: answers(b, mixed), REQUEST)
    known = known.select("bucket", F.col("chunk").cast("int").alias("salt"), "kind", F.lit(-1).cast("long").alias("chunk"), "blob")
    replies = sorted_by(asked.unionByName(known), "bucket", "salt", "kind", "chunk").mapInArrow(looked_up, REQUEST)
    replies = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "blob")).alias("replies"))
    return store.join(replies, "chunk").mapInArrow(lambda b: finished(b, buckets, total, distinct), RESULT)


def op5_ctw_score(spark, sf_dir):
    return score_texts(common.table(spark, sf_dir, "documents", "doc_id", "text"))
