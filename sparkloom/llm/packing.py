"""Best-fit packing of tokenised documents into sequences, after Martello-Toth reduction.

Only documents longer than a sequence are cut; full pieces are sequences by themselves,
so what has to be packed is the histogram of the lengths below the limit: at most
limit - 1 numbers, whatever the size of the corpus.  On that histogram

1. reduction fixes for good sets that dominate every other set holding the same
   document: a document with nothing that fits beside it; two that fill a sequence
   exactly; a document beside which only one other fits, with the largest that fits;
   one beside which at most two fit, when some single is at least as large as any such pair;
2. best-fit decreasing packs what is left, a whole run of equal lengths at a time.

The plan (runs of equal sequences) is bounded by the limit, not by the corpus, and is
the only thing sent to the executors.  A piece finds its place by its rank among pieces
of its length; ranks are counted within (length, salt) groups, more of them the more pieces a
length has, so a length shared by a third of the rows is spread over many tasks.

Defined results: a null or empty text is the end token alone; repeated rows and
ties are pieces of their own, ranked by doc_id, piece and checksum; null ids are kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LIMIT, END = 2048, 0
#: Groups, at least, among which the pieces of one length are dealt for ranking, and about how many pieces one group holds at most.
SALTS, GROUP = 64, 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of a byte-level BPE: the fast encoder for ordinary text, the tokenizer file itself where special strings occur."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path, self.slow = json_path, None

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def public_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n tokens; all but the first are full."""
    first = n % limit or min(n, limit)
    return [(0, first), *((s, limit) for s in range(first, n, limit))]


def pieces(documents: DataFrame, limit: int = LIMIT, encoder=public_encoder) -> DataFrame:
    """One row per piece, tokenised once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in common.chunks(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), END).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), limit)):
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    rows.append((doc, i, start, n, crc))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(work, PIECES)


def dominating(lengths: list[int], size: int, limit: int, have: dict[int, int]) -> tuple[int, ...] | None:
    """The companions that some best packing gives one document of this size, if a rule proves them; lengths: those left beside it, ascending."""
    room = limit - size
    left = lambda s: have[s] - (s == size)
    least = [s for s in lengths[:3] for _ in range(min(3, left(s)))][:3]  # the smallest companions, each as often as it is there
    if not least or least[0] > room:
        return ()
    if room in have and left(room):
        return (room,)
    single = lengths[bisect.bisect_right(lengths, room) - 1]
    if len(least) < 2 or sum(least[:2]) > room:
        return (single,)
    if len(least) < 3 or sum(least) > room:
        best, hi = 0, len(lengths) - 1
        for lo, a in enumerate(lengths):
            while hi > lo and a + lengths[hi] > room:
                hi -= 1
            if hi <= lo:
                break
            best = max(best, a + lengths[hi])
        twice = [2 * a for a in lengths if left(a) > 1 and 2 * a <= room]
        if single >= max([best, *twice]):
            return (single,)
    return None


def reduce(have: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixed sets and how often each is taken; what they hold is taken out of have.

    What proves a set once proves it as long as all that it holds is left: fewer others only leave fewer to compare with."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(sizes: tuple[int, ...]) -> None:
        need = Counter(sizes)
        times = min(have[s] // n for s, n in need.items())
        for s, n in need.items():
            have[s] -= n * times
            if not have[s]:
                del have[s]
        fixed.append((sizes, times))

    for size in sorted(have, reverse=True):  # exact pairs, whatever else is left
        room = limit - size
        if have.get(size, 0) and have.get(room, 0) > (room == size):
            take((size, room))
    for size in sorted(have, reverse=True):
        while have.get(size, 0):
            left = sorted(s for s in have if s != size or have[s] > 1)
            if (best := dominating(left, size, limit, have)) is None:
                break
            take((size, *best))
    return fixed


def best_fit(have: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, a run of equal lengths at a time."""
    room: dict[int, list[list]] = defaultdict(list)  # room left: [sizes, sequences]
    for size in sorted(have, reverse=True):
        n = have[size]
        for r in sorted(r for r in room if r >= size):
            while n and room[r]:
                sizes, times = room[r].pop()
                each = min(r // size, n)
                full = min(times, n // each)
                room[r - each * size].append([sizes + (size,) * each, full])
                if times > full:
                    room[r].append([sizes, times - full])
                n -= full * each
            if not room[r]:
                del room[r]
            if not n:
                break
        each = limit // size
        if n >= each:
            room[limit - each * size].append([(size,) * each, n // each])
        if n % each:
            room[limit - n % each * size].append([(size,) * (n % each), 1])
    return [(sizes, times) for groups in room.values() for sizes, times in groups]


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths and how many sequences hold each."""
    have = {s: n for s, n in histogram.items() if n}
    full = [((limit,), have.pop(limit))] if limit in have else []
    fixed = reduce(have, limit)
    return [*full, *fixed, *best_fit(have, limit)]


def places(sets: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, first sequence, offset, for each run of equal sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    at = 0
    for sizes, times in sets:
        offset = 0
        for s in sizes:
            runs[s].append((ranks[s], at, offset))
            ranks[s] += times
            offset += s
        at += times
    return {s: np.array(r, np.int64) for s, r in runs.items()}


def pack(documents: DataFrame, limit: int = LIMIT, encoder=public_encoder) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    cut_up = common.stored(pieces(documents, limit, encoder))
    sizes = {r.length: r["count"] for r in cut_up.groupBy("length").count().collect()}  # limit rows at most
    many = {n: times // GROUP for n, times in sizes.items() if times // GROUP > SALTS}
    salts = F.lit(SALTS) if not many else F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[F.col("length").cast("int")], F.lit(SALTS))
    cut_up = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts.cast("long")).cast("int"))
    # limit x SALTS rows, and one for each GROUP of pieces
    counts = {(r.length, r.salt): r["count"] for r in cut_up.groupBy("length", "salt").count().collect()}
    histogram: dict[int, int] = defaultdict(int)
    first: dict[tuple[int, int], int] = {}
    for length, salt in sorted(counts):
        first[length, salt] = histogram[length]
        histogram[length] += counts[length, salt]
    given = spark.sparkContext.broadcast((first, places(plan(histogram, limit))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = given.value
        for batch in batches:
            length, salt, rank = (np.asarray(batch.column(i)).astype(np.int64) for i in (3, 5, 6))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = np.unique(salt[at])
                global_rank = np.array([before[int(n), int(s)] for s in own])[np.searchsorted(own, salt[at])] + rank[at] - 1
                run = runs[int(n)]
                k = np.searchsorted(run[:, 0], global_rank, side="right") - 1
                sequence[at] = run[k, 1] + global_rank - run[k, 0]
                offset[at] = run[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut_up.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"))
