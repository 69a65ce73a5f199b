"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Fingerprints that differ in at most two bits
share at least six of them, and so, taking the bytes in four groups of two, share two
whole groups.  The index therefore posts each distinct fingerprint under its six pairs of
groups (four positional bytes each); for two that meet in a posting list the shared
positional bytes are tallied, pairs with fewer than six are dropped, the rest verified
bit by bit.

Equal fingerprints are one node from the start, so exact copies never meet as pairs.  A
posting list longer than `longest`, found by a count, is not paired: its members are posted
again under more of their positional bytes, six of the eight (the four of the list and
each two of the others).  Whoever shares them has reached the guaranteed minimum, and no
such list holds over 65536 distinct fingerprints, as they differ in two bytes only.  In it
the partners within the distance are looked up bit by bit, and each member is linked
once, to the least that it reaches; so large groups of near copies cost no pairs.

Defined results: null or wordless texts have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows get equal results;
rows with a null id stay, and give no component its id (a component of only such rows
has a null id); empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
LONGEST = 64
GROUPS = [(0, 1), (2, 3), (4, 5), (6, 7)]
SIXES = list(combinations(range(8), 8 - DISTANCE))


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    at = [0, *accumulate([len(w) + 1 for w in words])]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(at, at[size:])), np.uint64, len(words) - size + 1)  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            fps = np.array([majority(shingle_hashes(t, size, seed)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fp long")


def posting(fp: str = "fp") -> list:
    """The six keys of a fingerprint: which groups, and their positional bytes."""
    keys = []
    for i, (a, b) in enumerate(combinations(range(len(GROUPS)), 2)):
        low, high = (F.shiftrightunsigned(fp, 16 * g).bitwiseAND(0xFFFF) for g in (a, b))
        keys.append(F.lit(i << 32).cast("long").bitwiseOR(F.shiftleft(high.cast("long"), 16)).bitwiseOR(low.cast("long")))
    return keys


def six_bytes(groups: tuple[int, int], fp: str = "fp") -> list:
    """The keys of a fingerprint by the positional bytes of two groups and each two others: which, and their values."""
    held = [p for g in groups for p in GROUPS[g]]
    keys = []
    for more in combinations([p for p in range(8) if p not in held], 8 - DISTANCE - len(held)):
        places = tuple(sorted([*held, *more]))
        keys.append(byte_key(SIXES.index(places), places, fp))
    return keys


def byte_key(which: int, places: tuple[int, ...], fp: str = "fp") -> Column:
    """One key of a fingerprint: which places (at most six), and their positional bytes."""
    key = F.lit(which << 48).cast("long")
    for k, p in enumerate(places):
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(0xFF).cast("long"), 8 * k))
    return key


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fp) rows sorted by key as arrays of whole posting lists; a list never ends a batch unseen."""
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in _and_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            rest.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)))
            if rest[0][0][0] == rest[-1][0][-1]:
                continue  # still in one list
        if not rest:
            continue
        key, fp = (np.concatenate(x) for x in zip(*rest, strict=True))
        whole = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        rest = [(key[whole:], fp[whole:])] if whole < len(key) else []
        yield key[:whole], fp[:whole]


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the posting lists of (key, fp) rows sorted by key."""
    least = 8 - DISTANCE
    for key, fp in lists(batches):
        found = []
        for step in range(1, len(key)):
            i = np.flatnonzero(key[step:] == key[:-step])
            if not len(i):
                break
            x = fp[i] ^ fp[i + step]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            i, x = i[shared >= least], x[shared >= least]
            i = i[np.bitwise_count(x) <= DISTANCE]
            found.append((fp[i].view(np.int64), fp[i + step].view(np.int64)))
        if found:
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def least_reached(fp: np.ndarray) -> np.ndarray:
    """Of the distinct, sorted fingerprints of one list: the place of the least that each reaches by steps within the distance.

    They differ in the bits of two bytes at most, so the partners of all are looked up for each change of one or two such bits."""
    varied = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [1 << i for i in range(64) if varied >> i & 1]
    pairs = []
    for change in [*bits, *(a | b for a, b in combinations(bits, 2))]:
        other = fp ^ np.uint64(change)
        at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
        i = np.flatnonzero((fp[at] == other) & (other > fp))
        pairs.append((i, at[i]))
    reached = np.arange(len(fp))
    if not pairs:
        return reached
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        low = np.minimum(reached[u], reached[v])
        after = reached.copy()
        for ends in (u, v, reached[u], reached[v]):
            np.minimum.at(after, ends, low)
        while (after[after] != after).any():
            after = after[after]
        if (after == reached).all():
            return reached
        reached = after


def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the posting lists of six bytes: (key, fp) rows sorted by both, no row twice."""
    for key, fp in lists(batches):
        edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            own = np.sort(fp[lo:hi])
            root = least_reached(own)
            u = np.flatnonzero(root != np.arange(len(own)))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(own[root[u]].view(np.int64)), pa.array(own[u].view(np.int64))], names=["u", "v"])


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def links(nodes: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Pairs u, v of distinct fingerprints (column fp) that connect all within the distance."""
    spark = nodes.sparkSession
    index = nodes.select(F.explode(F.array(*posting())).alias("key"), "fp")
    counted = common.stored(index.groupBy("key").count().where("count > 1"))
    hot = common.stored(counted.where(F.col("count") > longest).select("key"))
    met = index.join(counted.where(F.col("count") <= longest).select("key"), "key", "left_semi")
    direct = met.repartition(common.width(spark), "key").sortWithinPartitions("key").mapInArrow(paired, "u long, v long")
    if hot.isEmpty():
        return direct
    further = F.array(*[F.array(*six_bytes(two)) for two in combinations(range(len(GROUPS)), 2)])
    which = F.shiftrightunsigned("key", 32).cast("int") + 1
    longer = index.join(hot, "key", "left_semi").select(F.explode(F.element_at(further, which)).alias("key"), "fp").distinct()
    return direct.unionByName(longer.repartition(common.width(spark), "key").sortWithinPartitions("key").mapInArrow(spanned, "u long, v long"))


def nearest(batches: Iterator[pa.RecordBatch], least: int, within: int, longest: int) -> Iterator[pa.RecordBatch]:
    """For each member of the posting lists of (key, fp) rows, sorted by both: its least and its nearest partner in the list.

    Partners share at least `least` positional bytes and differ in at most `within` bits.  A member is compared
    with the `longest` that follow it."""
    for key, fp in lists(batches):
        found = []
        for step in range(1, min(len(key) - 1, longest) + 1):
            i = np.flatnonzero(key[step:] == key[:-step])
            if not len(i):
                break
            x = fp[i] ^ fp[i + step]
            shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            bits = np.bitwise_count(x)
            good = (shared >= least) & (bits <= within)
            found.append((i[good], i[good] + step, bits[good]))
        if not found:
            continue
        i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        own, other, bits = np.append(i, j), np.append(j, i), np.append(bits, bits).astype(np.int32)
        signed = fp.view(np.int64)
        for order in (np.lexsort((signed[other], own)), np.lexsort((signed[other], bits, own))):
            order = order[np.unique(own[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(signed[own[order]]), pa.array(signed[other[order]]), pa.array(bits[order])], names=["fp", "other", "bits"])


def partners(nodes: DataFrame, distance: int, within: int, longest: int) -> DataFrame:
    """Pairs u, v of distinct fingerprints (column fp) for an exact check to follow: of each one that has any, its least and its nearest partner.

    The index posts a fingerprint under each 8 - distance of its positional bytes, the least number that two at
    the distance share; those that meet there are partners if they differ in at most `within` bits."""
    least = 8 - distance

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from nearest(batches, least, within, longest)

    keys = [byte_key(i, places) for i, places in enumerate(combinations(range(8), least))]
    index = nodes.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition(common.width(nodes.sparkSession), "key")
    found = index.sortWithinPartitions("key", "fp").mapInArrow(work, "fp long, other long, bits int")
    chosen = found.groupBy("fp").agg(F.min("other").alias("least"), F.min(F.struct("bits", "other")).alias("nearest"))
    pairs = chosen.select("fp", F.explode(F.array("least", "nearest.other")).alias("other"))
    return pairs.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def groups(documents: DataFrame, size: int = SHINGLE, seed: int = SEED, longest: int = LONGEST) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = common.stored(fingerprints(documents, size, seed))
    nodes = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, longest))
    rooted = common.stored(nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root")))
    least = common.stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = common.stored(rooted.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id (a null id comes after all, told apart by its text).

    Rows of one doc_id are one document; one of them stays."""
    return first_of_each(documents, lambda keyed: groups(keyed, size, seed))


def first_of_each(documents: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """one_of_each by any grouping of (doc_id, text) rows into doc_id, component_id."""
    kept = documents.columns
    unnamed = F.lit(1 << 62).cast("long") + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = documents.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), unnamed))
    found = grouped(keyed.select(F.col("_key").alias("doc_id"), "text"))
    gone = found.groupBy(F.col("doc_id").alias("_key")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where(~F.col("first")).select("_key")
    # only rows of a repeated id are sorted for one of them, and few ids are gone: whole texts are too large to sort all
    gone = common.stored(gone)
    again = common.stored(keyed.groupBy("_key").count().where("count > 1").select("_key").join(gone, "_key", "left_anti"))
    single = keyed.join(gone.unionByName(again), "_key", "left_anti")
    return single.unionByName(keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"])).select(*kept)


def op9_simhash_groups(spark, sf_dir):
    found = groups(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
