"""Near copies for the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash, the operator of simhash.py: each set gets PRINTS of its fingerprints, of the hashes mixed in as many
ways, and these meet in its index of positional bytes; with its least and its nearest partner there each is compared
exactly, sketches first and then whole sets, and what that links is a component.  The index posts two of eight bytes, so all within DISTANCE bits
meet and most of those within WITHIN.

No number of bits holds all sets of similarity 0.8, so an exact set-similarity join links what the
fingerprints left apart; posting lists within one component are passed over.  All shingles stand in one order, those that a sample of
SAMPLE documents shows to be common last (the commonest at the very end), the rest by hash.
Two sets of similarity 0.8 share a shingle among the first n - ceil(0.8 n) + 1 of each, so every
pair meets in a posting list of these.  The sample only decides how long the lists get, never
what is found.  At the first shingle that two sets share, neither can share more than what it holds
from there on: pairs for which that is too little, by the sizes and places that a posting
carries, are none at that list.  Of lists with the same members the first in the order stands for all.

Lists are not paired in full.  Each member is first compared with its list's pivot, if that is in another component; the pivot has the
fewest shingles before this one and so is nearest to what the list has in common; what that links is one component.  Then, in
lists that still hold several components, all outside the largest are compared with every member
of another component, by blocks of members.  So each pair of a list is compared or already linked, and a large group
of near copies costs a few rows a member.  Counts of shingles by bits of their hashes, in about as
many places as a set has shingles, rule out most pairs (sets differ at least as much as their
counts do); of the others the whole sets, read again from the texts, must reach the share.

Equal sets are one node from the start.  Null and wordless texts are copies of one another;
texts of fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SHINGLE, SEED = 5, 42
#: The similarity from which two texts are near copies, as a fraction.
OVER, UNDER = 4, 5
#: Documents sampled for common shingles, how many of them make a shingle common, and how many are kept in mind.
SAMPLE, COMMON, MOST = 20_000, 3, 1 << 18
#: Fingerprints of a set.
PRINTS = 2
#: Bits in which fingerprints may differ that are sure to meet in the index, and that are compared if they meet.
DISTANCE, WITHIN = 6, 12
#: Members of a list of the index that one is compared with.
LONGEST = 1024
#: Members of a list that meet an outsider at once.
BLOCK = 1024
#: Keys from here on are those of common shingles.
LATE = 1 << 62


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE, SEED))


def node_of(hashes: np.ndarray) -> np.uint64:
    """A fingerprint of the whole set."""
    return common.mix(np.array([common.mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))[0]


def first_of(hashes: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The keys under which a set is posted, in the one order of all shingles; known: common ones, sorted, and their places among themselves."""
    keys = (hashes >> np.uint64(2)).astype(np.int64)
    if len(known) and len(hashes):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        late = known[at] == hashes
        keys[late] = LATE + place[at[late]]
    return np.sort(keys)[: posts(len(hashes))]


def posts(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1 if n else 0


def sketch_of(hashes: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    """The size of a set, and how many of its shingles fall in each place, compressed."""
    places = 1 << max(3, int(len(hashes)).bit_length())
    counts = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return compressor.compress(np.array([len(hashes)], "<u4").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets may share at most, by their sketches."""
    a, b = (int(s[:4].view("<u4")[0]) for s in (x, y))
    x, y = x[4:].astype(np.int64), y[4:].astype(np.int64)
    places = min(len(x), len(y))
    return (a + b - int(np.abs(x.reshape(-1, places).sum(axis=0) - y.reshape(-1, places).sum(axis=0)).sum())) // 2


def enough(both: int, a: int, b: int) -> bool:
    return UNDER * both >= OVER * (a + b - both)


def common_shingles(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of many sampled documents, sorted, and the place of each in the order from the least common on."""
    n = documents.count()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            found = np.concatenate([shingles(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["s"])

    sample = documents.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    counted = sample.mapInArrow(work, "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    most = np.array([r.s for r in counted.orderBy(F.desc("count"), "s").limit(MOST).collect()], np.int64).view(np.uint64)
    order = np.argsort(most)
    return most[order], len(most) - 1 - order


def prints_of(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of a set: the operator's, and those of its hashes mixed again."""
    out = []
    for _ in range(PRINTS):
        out.append(simhash.majority(hashes))
        hashes = common.mix(hashes)
    return np.array(out, np.uint64)


def posted(documents: DataFrame, known: np.ndarray, place: np.ndarray) -> DataFrame:
    """doc, node, the fingerprints, size, sketch and the keys to post of every row (doc, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in common.chunks(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            nodes = np.array([node_of(s) for s in sets], np.uint64)
            prints = [prints_of(s).view(np.int64) for s in sets]
            keys = [first_of(s, known, place) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.view(np.int64)), pa.array(prints, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch_of(s, compressor) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "node", "prints", "size", "sketch", "keys"])

    return documents.mapInArrow(work, "doc long, node long, prints array<long>, size int, sketch binary, keys array<long>")


def may(size: str, before: str, other_size: str, other_before: str) -> str:
    """SQL: whether two sets can reach the share, if the first shingle that both hold has so many before it in each."""
    return f"{UNDER + OVER} * least({size} - {before}, {other_size} - {other_before}) >= {OVER} * ({size} + {other_size})"


def joined(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Pairs u, v with the column of both."""
    one, two = (of.select(F.col("node").alias(n), F.col(column).alias(f"{n}_of")) for n in ("u", "v"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "u_of", "v_of")


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs but those whose counts by place differ too much for the share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            good = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (np.frombuffer(expand(z), np.uint8) for z in (s, t))
                good.append(enough(most_shared(x, y), *(int(z[:4].view("<u4")[0]) for z in (x, y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return joined(pairs, sketches, "sketch").mapInArrow(work, "u long, v long")


def alike(documents: DataFrame, nodes: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs u, v of nodes whose whole sets reach the share."""
    pairs = common.stored(possible(pairs, sketches))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                good.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    met = common.stored(nodes.join(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "node").select("node", F.col("first").alias("doc")))
    texts = documents.join(met.select("doc").distinct(), "doc", "left_semi").select("text")
    sets = common.stored(texts.mapInArrow(read, "node long, words binary").join(met.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    return joined(pairs, sets, "words").mapInArrow(compare, "u long, v long")


def candidates(mixed: DataFrame) -> DataFrame:
    """a, node: members of lists outside the main part, with members of other parts that they may be alike to.

    A list's members are put in 2 ** cut blocks by hash, of about BLOCK at most; a member meets blocks, and those it
    meets in several lists are put together before pairs are told apart."""
    block = F.expr("xxhash64(node) & (shiftleft(1L, cut) - 1)")
    blocks = mixed.groupBy("key", "cut", block.alias("block")).agg(F.collect_list(F.struct("node", "part", "size", "before")).alias("members"))
    outside = mixed.where("part <> main").select("key", F.col("node").alias("a"), F.col("part").alias("a_part"), F.col("size").alias("a_size"), F.col("before").alias("a_before"))
    fit = f"transform(filter(members, x -> x.part <> a_part AND {may('x.size', 'x.before', 'a_size', 'a_before')}), x -> x.node)"
    met = outside.join(blocks, "key").select("a", "cut", "block", F.expr(fit).alias("found")).where("size(found) > 0")
    return met.groupBy("a", "cut", "block").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).select("a", F.explode("found").alias("node"))


def by_fingerprint(own: DataFrame) -> DataFrame:
    """Pairs u, v of nodes with a fingerprint that is equal or a partner in the index of simhash.py; one node stands for each fingerprint."""
    out = None
    for k in range(PRINTS):
        prints = common.stored(own.select("node", F.col("prints")[k].alias("fp")).distinct())
        one = common.stored(prints.groupBy("fp").agg(F.min("node").alias("one")))
        equal = prints.join(one, "fp").where("node <> one").select(F.col("one").alias("u"), F.col("node").alias("v"))
        found = common.stored(simhash.partners(one.select("fp"), DISTANCE, WITHIN, LONGEST))
        u, v = (one.select(F.col("fp").alias(n), F.col("one").alias(f"{n}_one")) for n in ("u", "v"))
        met = found.join(u, "u").join(v, "v").select(F.least("u_one", "v_one").alias("u"), F.greatest("u_one", "v_one").alias("v"))
        met = met.unionByName(equal)
        out = out.unionByName(met) if out else met
    return common.stored(out.distinct())


def parted(members: DataFrame, near: DataFrame) -> DataFrame:
    """The members (node, ...) with their part: the component of the links that each is in."""
    roots = components(near).select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")


def left_apart(documents: DataFrame, nodes: DataFrame, sketches: DataFrame, own: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs u, v of nodes, all alike, that with the links in near connect all that are."""
    index = own.select(F.posexplode("keys").alias("before", "key"), "node", "size")
    shared = common.stored(index.groupBy("key").count().where("count > 1").select("key"))
    met = common.stored(parted(index.join(shared, "key", "left_semi"), near))
    lists = met.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min(F.struct("before", "size", "node", "part")).alias("pivot"), F.max("part").alias("last"), F.min("part").alias("part")).where("part <> last")
    lists = common.stored(lists.groupBy("n", "members").agg(F.min(F.struct("key", "pivot")).alias("first")).select("first.key", "first.pivot", F.ceil(F.greatest(F.lit(0.0), F.log2(F.col("n") / BLOCK))).cast("int").alias("cut")))
    met = common.stored(met.join(lists, "key"))
    star = met.where("part <> pivot.part AND " + may("size", "before", "pivot.size", "pivot.before"))
    star = common.stored(star.select(F.least("pivot.node", "node").alias("u"), F.greatest("pivot.node", "node").alias("v")).distinct())
    close = common.stored(alike(documents, nodes, sketches, star))
    placed = common.stored(parted(met.select("key", "node", "size", "before"), near.unionByName(close)))
    parts = placed.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", "count").alias("main"), F.count("*").alias("n"))
    mixed = common.stored(placed.join(parts.where("n > 1").select("key", "main"), "key").join(lists.select("key", "cut"), "key"))
    met_outside = candidates(mixed).select(F.least("a", "node").alias("u"), F.greatest("a", "node").alias("v")).distinct()
    pairs = common.stored(met_outside.join(star, ["u", "v"], "left_anti"))
    return close.unionByName(alike(documents, nodes, sketches, pairs))


def links(documents: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs u, v of nodes, all alike, that connect all that are: those by fingerprint, then those that these left apart."""
    own = rows.join(nodes.select("node", F.col("first").alias("doc")), ["node", "doc"], "left_semi")
    sketches = common.stored(own.select("node", "sketch").dropDuplicates(["node"]))
    near = common.stored(alike(documents, nodes, sketches, by_fingerprint(own)))
    return near.unionByName(left_apart(documents, nodes, sketches, own, near))


def groups(documents: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id linked to it, of every row (no doc_id null)."""
    documents = documents.select(F.col("doc_id").alias("doc"), "text")
    rows = common.stored(posted(documents, *common_shingles(documents)))
    nodes = common.stored(rows.groupBy("node").agg(F.min("doc").alias("first")))
    roots = components(links(documents, rows, nodes))
    rooted = common.stored(nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("node", "first", F.coalesce("v", "node").alias("root")))
    least = common.stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = common.stored(rooted.join(least, "root").select("node", "component_id"))
    return rows.select("doc", "node").join(named, "node").select(F.col("doc").alias("doc_id"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each group, with all columns, chosen as simhash.one_of_each does."""
    return simhash.first_of_each(documents, groups)
