"""Substring dedup by recompression: a word goes when a 13-word window that covers it also starts in an earlier document.

Two rounds of recompression name every document's words anew: runs of one word become a
symbol, then pairs (left, right) become symbols, twice.  A name is a fingerprint
of what it stands for, so all tasks give equal content equal names without asking each
other, and whether two neighbours pair depends on their names alone.  So equal windows
contain equal interior symbols: a symbol whose naming saw only runs that lie strictly
inside a window is the same in every occurrence of it.  Of those each window takes the
one with the smallest name as its anchor (a window without one, say inside a long run, takes
its own fingerprint).  Windows shared by documents thus share a high-level symbol,
which brings them to the same bucket in one shuffle; there equal windows are verified by
32 bits of the anchor and the 64-bit fingerprint of all their words (each word by a 64-bit hash), and the
smallest doc_id decides.  What goes comes back as ranges of a document's windows with the sum of their
fingerprints, and only where the document has these windows there.

Each map task first settles equal windows among its own documents and ships one
occurrence of each (one per text where several rows share the smallest doc_id, or have none), so a passage that fills a third of all documents costs one row per map
chunk, not per document.  Shipped windows are packed: one anchor for a run of windows,
fingerprints, and compressed positions.

Defined results: null or blank texts have no words; documents of fewer than 13 words lose nothing;
a null doc_id comes after all others and takes nothing from anyone; rows that share a doc_id
take nothing from each other; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import mix

WINDOW = 13
LAST = 2**63 - 1
#: Text that a map task settles at once, and buckets per shuffle partition.
SETTLED, BUCKETS = 6 << 20, 4


def windows(names: np.ndarray, row: np.ndarray, words_of: common.Rolling, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each window."""
    n = len(names) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, words_of.ranges(names, at, at + size)


def pair_round(names: np.ndarray, row: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs left-right neighbours: index of each new symbol's first part, and the new names."""
    right = (mix(names + np.uint64(salt)) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(names), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (row[:-1] == row[1:])
    first = np.ones(len(names), bool)
    first[1:] = ~joins[:-1]
    at = np.flatnonzero(first)
    out = names[at]
    two = joins[at]
    out[two] = mix(names[at[two]] * np.uint64(3) + mix(names[at[two] + 1] + np.uint64(salt + 1)))
    return at, out


def anchors(names: np.ndarray, row: np.ndarray, size: int) -> np.ndarray:
    """By first word of a window: the smallest name among its interior symbols, or the largest number."""
    n = len(names)
    best = np.full(n, np.uint64(2**64 - 1))
    if not n:
        return best
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    run_row = row[run]
    run_names = mix(names[run] + np.uint64(0x51ED27) * (end - run).astype(np.uint64))
    one, names1 = pair_round(run_names, run_row, 11)
    two, names2 = pair_round(names1, run_row[one], 23)
    u = one[two]  # first run of each symbol; its naming saw runs u-2 .. u+3
    ok = (u >= 2) & (u + 3 < len(run))
    u, name = u[ok], names2[ok]
    ok = (run_row[u - 2] == run_row[u]) & (run_row[u + 3] == run_row[u])
    u, name = u[ok], mix(name[ok])
    low, high = end[u + 3] - (size - 1), run[u - 2] - 1
    for back in range(size):
        i = high - back
        ok = (i >= low) & (i >= 0)
        if not ok.any():
            break
        best[i[ok]] = np.minimum(best[i[ok]], name[ok])
    return best


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths, compressed."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes()
    kinds = "".join(a.dtype.str[1:] for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at = 8 + 8 * n
    kinds = [raw[at + 2 * i : at + 2 * i + 2].decode() for i in range(n)]
    at += 2 * n
    out = []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += out[-1].nbytes
    return out


def spans_of(doc: np.ndarray, crc: np.ndarray, at: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of consecutive positions, by document, of positions in order, each with the sum of its marks."""
    if not len(at):
        return doc, crc, at.astype(np.int32), at.astype(np.int32), mark
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(at)) - 1
    return doc[first], crc[first], at[first].astype(np.int32), at[last].astype(np.int32) + 1, np.add.reduceat(mark, first, dtype=np.uint64)


def rolled(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


MAPPED, FLAGGED = "bucket int, kind int, blob binary", "doc long, crc long, blob binary"


def settled(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, crc, text): windows to be verified elsewhere (kind 0), and ranges already known to be repeats (kind 1)."""
    words_of = common.Rolling()
    held: list[tuple] = []
    held_bytes = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, held_bytes
        if not held:
            return
        doc, crc, pos, mark, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        held, held_bytes = [], 0
        order = np.lexsort((crc, doc, anchor, mark))
        m, a, d, c = mark[order], anchor[order], doc[order], crc[order]
        start = np.ones(len(m), bool)
        start[1:] = (m[1:] != m[:-1]) | (a[1:] != a[:-1])
        least = d[np.flatnonzero(start)][np.cumsum(start) - 1] if len(d) else d
        repeat = np.zeros(len(m), bool)
        repeat[order] = d > least
        # rows that tie on the least doc are no repeats of one another: each sends its first
        start[1:] |= (d[1:] != d[:-1]) | (c[1:] != c[:-1])
        once = np.zeros(len(m), bool)
        once[order] = start & (d == least)
        out: list[tuple[int, int, bytes]] = []
        at = np.flatnonzero(repeat)
        spans = spans_of(doc[at], crc[at], pos[at], mark[at])
        to = (mix(spans[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(to):
            out.append((int(b), 1, packed(*(x[to == b] for x in spans))))
        at = np.flatnonzero(once)
        doc, crc, pos, mark, anchor = doc[at], crc[at], pos[at], mark[at], anchor[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(cut)
        count = np.diff(np.append(first, len(at)))
        to = (mix(anchor[first]) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[by], np.arange(buckets + 1))
        for b in range(buckets):
            r = by[edge[b] : edge[b + 1]]
            if len(r):
                n = count[r]
                w = np.repeat(first[r] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                out.append((b, 0, packed(anchor[first[r]].astype(np.uint32), rolled(doc[first[r]]), crc[first[r]].astype(np.uint32), pos[first[r]].astype(np.int32), n.astype(np.int32), mark[w])))
        for i in range(0, len(out), 64):
            bs, ks, blobs = zip(*out[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array(ks, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])

    for batch in common.chunks(batches):
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        names, row = common.words_by_row(texts)
        at, mark = windows(names, row, words_of, size)
        anchor = anchors(names, row, size)[at]
        anchor = np.where(anchor == np.uint64(2**64 - 1), mark, anchor)
        of = row[at]
        doc, crc = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
        held.append((doc[of], crc[of], at - np.searchsorted(row, of), mark, anchor))
        held_bytes += sum(map(len, texts))
        if held_bytes >= SETTLED:
            yield from flush()
    yield from flush()


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed windows sorted by bucket: ranges that start in an earlier document too, one row per document and bucket."""
    bucket, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        anchor, doc, crc, pos, count, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        of = np.repeat(np.arange(len(anchor)), count)
        order = np.lexsort((doc[of], mark))
        m, a, d = mark[order], anchor[of[order]], doc[of[order]]
        start = np.ones(len(m), bool)
        start[1:] = (m[1:] != m[:-1]) | (a[1:] != a[:-1])
        least = d[np.flatnonzero(start)][np.cumsum(start) - 1]
        w = np.sort(order[d > least])
        place = pos[of[w]] + w - (np.cumsum(count) - count)[of[w]]
        yield from by_document(*spans_of(doc[of[w]], crc[of[w]], place, mark[w]))

    for batch in batches:
        for b, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kind:
                yield from by_document(*unpacked(blob))
                continue
            if b != bucket:
                yield from flush()
                bucket = b
            anchor, doc, crc, pos, count, mark = unpacked(blob)
            held.append((anchor, np.cumsum(doc), crc.astype(np.int64), pos.astype(np.int64), count.astype(np.int64), mark))
    yield from flush()


#: A range of windows that go, and the sum of their marks.
RANGE = np.dtype([("start", "<i4"), ("end", "<i4"), ("marks", "<u8")])


def by_document(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, end: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    order = np.lexsort((start, crc, doc))
    doc, crc, ranges = doc[order], crc[order], np.empty(len(order), RANGE)
    ranges["start"], ranges["end"], ranges["marks"] = start[order], end[order], marks[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])
    first = np.flatnonzero(cut)
    blobs = [x.tobytes() for x in np.split(ranges, first[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(crc[first]), pa.array(blobs, pa.binary())], names=["doc", "crc", "blob"])


def covered(names: np.ndarray, row: np.ndarray, blobs: list[list[bytes]], size: int, words_of: common.Rolling) -> np.ndarray:
    """Which words of the rows go, given the ranges of windows that do.  Equal windows of a row go together.

    A range whose marks are not this row's is that of another text with the same id and checksum."""
    at, mark = windows(names, row, words_of, size)
    goes = np.zeros(len(at) + 1, np.int64)
    sums = np.append(np.uint64(0), np.cumsum(mark))
    edge = np.searchsorted(row[at], np.arange(len(blobs) + 1))
    for i, parts in enumerate(blobs):
        ranges = np.frombuffer(b"".join(parts), RANGE)
        start, end = ranges["start"] + edge[i], ranges["end"] + edge[i]
        own = end <= edge[i + 1]
        own &= sums[np.where(own, end, 0)] - sums[np.where(own, start, 0)] == ranges["marks"]
        np.add.at(goes, start[own], 1)
        np.add.at(goes, end[own], -1)
    goes = np.cumsum(goes)[:-1] > 0
    key = mix(mark + mix(row[at].astype(np.uint64)))
    goes |= np.isin(key, key[goes])
    cover = np.zeros(len(names) + 1, np.int64)
    cover[at[goes]] += 1
    cover[at[goes] + size] -= 1
    return np.cumsum(cover)[:-1] > 0


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, crc, text, none): the text as compressed bytes, for a shuffle of half the size."""
    compressor = zstandard.ZstdCompressor(level=3)
    for batch in common.chunks(batches):
        small = [compressor.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(small, pa.binary())], names=["doc", "crc", "none", "words"])


def remove_repeats(documents: DataFrame, size: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that stay joined by one space (digest: their SHA-256 in hex as kept_sha256)."""
    spark = documents.sparkSession
    buckets = BUCKETS * common.width(spark)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), "text", F.col("doc_id").isNull().alias("none"))
    sent = rows.mapInArrow(squeezed, "doc long, crc long, none boolean, words binary")
    mapped = rows.select("doc", "crc", "text").mapInArrow(lambda b: settled(b, size, buckets), MAPPED)
    flags = mapped.repartition(common.width(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(verified, FLAGGED)
    flags = flags.groupBy("doc", "crc").agg(F.collect_list("blob").alias("blobs"))
    name = "kept_sha256" if digest else "kept"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = common.Rolling()
        expand = zstandard.ZstdDecompressor().decompress
        for batch in common.chunks(batches, "words", sizes=lambda c: np.array([zstandard.frame_content_size(t) for t in c.to_pylist()], np.int64)):
            blobs = batch.column(4).to_pylist()
            texts = [expand(t) for t in batch.column(3).to_pylist()]
            words = [t.split() for t in texts]
            kept = list(words)
            some = [i for i, b in enumerate(blobs) if b]
            if some:
                row = np.repeat(np.arange(len(some)), [len(words[i]) for i in some])
                stay = ~covered(common.word_names([w for i in some for w in words[i]]), row, [blobs[i] for i in some], size, words_of)
                edge = np.searchsorted(row, np.arange(len(some) + 1))
                for j, i in enumerate(some):
                    kept[i] = list(compress(words[i], stay[edge[j] : edge[j + 1]].tolist()))
            joined = [b" ".join(k) for k in kept]
            out = [hashlib.sha256(j).hexdigest() for j in joined] if digest else [j.decode() for j in joined]
            ids = [None if none else d for d, none in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return sent.join(flags, ["doc", "crc"], "left").select("doc", "crc", "none", "words", "blobs").mapInArrow(finish, f"doc_id long, n_words long, n_removed long, {name} string")


def op3_substring_dedup(spark, sf_dir):
    return remove_repeats(common.table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM x GROUP BY s),
g AS (SELECT DISTINCT x.k, unnest(range(x.i, x.i + 13)) AS i FROM x JOIN m USING (s) WHERE coalesce(x.doc_id, 9223372036854775807) > m.least),
t AS (SELECT k, i, w[i] AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c AS (SELECT t.k, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(t.word, ' ' ORDER BY t.i) FILTER (g.i IS NULL), '') AS kept
      FROM t LEFT JOIN g ON t.k = g.k AND t.i = g.i GROUP BY t.k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (k)
"""
