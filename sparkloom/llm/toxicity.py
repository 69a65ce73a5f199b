"""Toxicity by weak supervision: a generative model of many voters, and a linear classifier trained on its posteriors.

1. Lexicon: words, and beginnings of words (4 to 8 bytes), whose presence speaks most for or against label 1 among a bounded sample of SAMPLE
   labelled training rows (those with the smallest hashed ids), with their document counts.
   Of rows with one id the least text teaches; of rows that share one of two minimum hashes of five words (of all, if they have fewer), as copies do, one teaches.
2. Voters: groups of lexicon words vote toxic; their joint absence, the ordinary-words group and
   patterns (several terms, their density, capitals and exclamation marks beside one) vote too; the
   given label is one voter among them, of fixed accuracy GIVEN.
3. Label model: expectation-maximisation over a latent class gives each voter's accuracy;
   the correlations of voters' errors under the posterior discount voters that repeat each other.
4. A logistic regression over lexicon words and pattern features is trained on
   the posteriors, and scores every whole text.

Labels of held-out rows are never read.  Defined results: null and empty texts score by the classifier's view
of no words; of several labels of a doc_id the largest counts; null labels and ids teach
nothing (a null doc_id is not held out); without labels of both classes every score is 0; repeated rows get
equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, LEXICON, VOTERS, SUPPORT = 12_000, 384, 16, 5
#: How often a given label is taken to be right.
GIVEN = 0.98
#: Lengths of beginnings of words.
STEMS = range(4, 9)
FOLDS, HELD_OUT = 5, 0
#: A-Z become a-z; all other ASCII but a-z becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
SHAPES = 5
#: All bytes but A-Z, and but the letters of ASCII.
NO_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
NO_LETTER = bytes(b for b in NO_CAPITAL if not 97 <= b <= 122)
WIDE = re.compile("[^\x00-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def terms(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked by a sign that no word holds."""
    return [word, *(b"^" + word[:n] for n in STEMS if n < len(word))]


def capitals(raw: str) -> float:
    """The share of capitals among the letters."""
    data = raw.encode()
    wide = "" if raw.isascii() else "".join(WIDE.findall(raw))
    upper = len(data.translate(None, NO_CAPITAL)) + sum(map(str.isupper, wide))
    return upper / ((len(data.translate(None, NO_LETTER)) + sum(map(str.isalpha, wide))) or 1)


def shape(text: str | None, words: list[bytes], hits: int) -> list[float]:
    """Pattern features of the whole text, all between 0 and 1 or so; the first is twice the share of capitals."""
    raw = text or ""
    letters = sum(map(len, words)) or 1
    return [min(1.0, 2 * capitals(raw)), min(1.0, 20 * raw.count("!") / letters), min(1.0, 20 * raw.count("?") / letters), np.log1p(hits) / 3, min(1.0, 50 * hits / (len(words) + 1))]


def features(texts: list[str | None], lexicon: dict[bytes, int], toxic: int) -> np.ndarray:
    """Presence of each lexicon term (the first `toxic` speak for label 1), then patterns."""
    out = np.zeros((len(texts), len(lexicon) + SHAPES), np.float32)
    gate = {t.lstrip(b"^")[:4] for t in lexicon}
    for i, t in enumerate(texts):
        words = words_of(t)
        hits = 0
        for w in words:
            if w[:4] in gate:
                found = [lexicon[x] for x in terms(w) if x in lexicon]
                out[i, found] = 1
                hits += any(f < toxic for f in found)
        out[i, len(lexicon) :] = shape(t, words, hits)
    return out


def lexicon_of(counted: list) -> tuple[list[bytes], int]:
    """Of rows (word, sure): words for label 1, most telling first, then words against it; and how many are the former."""

    def chosen(rows: list, most: int) -> list[bytes]:
        longest: dict[tuple, bytes] = {}  # of beginnings of one another that are equally telling, the longest
        for r in sorted(rows, key=lambda r: (-len(r.word), r.word)):
            longest.setdefault((r.sure, r.word.lstrip(b"^")[: STEMS[0]]), bytes(r.word))
        return [w for (_, _), w in sorted(longest.items(), key=lambda x: (-abs(x[0][0]), x[1]))][:most]

    up = chosen([r for r in counted if r.sure > 1.0], LEXICON // 4 * 3)
    return up + chosen([r for r in counted if r.sure < -0.5], LEXICON // 4), len(up)


def votes(x: np.ndarray, toxic: int) -> np.ndarray:
    """Rows x voters of 1 (toxic), -1 (not) and 0 (abstains)."""
    words = x[:, : x.shape[1] - SHAPES]
    shapes = x[:, x.shape[1] - SHAPES :]
    cast = [np.where(words[:, g:toxic:VOTERS].any(axis=1), 1, 0) for g in range(min(VOTERS, toxic))]
    hits = words[:, :toxic].sum(axis=1)
    cast.append(np.where(hits == 0, -1, 0))
    cast.append(np.where(hits >= 2, 1, 0))
    if words.shape[1] > toxic:
        cast.append(np.where(words[:, toxic:].sum(axis=1) > 2, -1, 0))
    cast.append(np.where((shapes[:, 1] > 0.5) & (shapes[:, 0] > 0.5) & (hits > 0), 1, 0))
    cast.append(np.where(shapes[:, 4] > 0.3, 1, 0))
    return np.array(cast).T


def label_model(cast: np.ndarray, gold: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1, each voter's accuracy, and the correlations of voters' errors.

    Given the class, a voter casts each of its three votes with its own rate; the
    evidence of voters whose errors go together is shared among them."""
    kinds = np.array([cast == v for v in (-1, 0, 1)], float)  # vote x row x voter
    given = np.where(gold, 1, -1) * np.log(GIVEN / (1 - GIVEN))
    post = np.where(gold, GIVEN, 1 - GIVEN)
    weight = np.ones(cast.shape[1])
    corr = np.eye(cast.shape[1])
    for r in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        yes = (kinds * post[None, :, None]).sum(axis=1) + 0.5
        no = (kinds * (1 - post)[None, :, None]).sum(axis=1) + 0.5
        ratio = np.log(yes / yes.sum(axis=0)) - np.log(no / no.sum(axis=0))
        evidence = (kinds * ratio[:, None, :]).sum(axis=0)
        if r % 10 == 0:
            expected = post[:, None] * (yes[2] - yes[0]) / yes.sum(axis=0) + (1 - post)[:, None] * (no[2] - no[0]) / no.sum(axis=0)
            error = cast - expected
            scale = np.sqrt((error**2).mean(axis=0)) + 1e-9
            corr = (error.T @ error) / len(error) / scale[:, None] / scale[None, :]
            weight = 1 / (1 + np.maximum(corr - np.eye(len(corr)), 0).sum(axis=0))
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + given + evidence @ weight, -30, 30)))
    says = np.abs(cast) > 0
    right = np.where(cast > 0, post[:, None], 1 - post[:, None])
    accuracy = (right * says).sum(axis=0) / np.maximum(says.sum(axis=0), 1)
    return post, accuracy, corr


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights, the last one the constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame) -> tuple[dict[bytes, int], int, np.ndarray]:
    """Lexicon, how many of its words speak for label 1, weights."""
    teaches = common.fold("doc_id", FOLDS) != HELD_OUT
    known = labels.where(F.col("toxic").isNotNull() & teaches).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    hashed = common.stored(known.withColumn("h", F.xxhash64("doc_id")))
    chosen = common.stored(hashed.where(common.under("h", (2 * SAMPLE + 100) / max(hashed.count(), 1))).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id", "toxic"))
    # SAMPLE ids at most, and of each one text; what they label is read once, and then from a table of its own
    rows = common.stored(documents.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in common.chunks(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            least = [[min(xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), seed) >> 1 for i in range(max(1, len(w) - 4))) for w in words] for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in least)], names=["doc_id", "one", "two"])

    own: set = set()
    seen: tuple[set, set] = set(), set()
    for r in sorted(rows.mapInArrow(sketched, "doc_id long, one long, two long").collect()):
        if r.one not in seen[0] and r.two not in seen[1]:
            own.add(r.doc_id)
        seen[0].add(r.one)
        seen[1].add(r.two)
    spark = documents.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(own)], "doc_id long")), "doc_id", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            tally: dict[bytes, list[int]] = {}
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for w in {x for w in set(words_of(text)) for x in terms(w)}:
                    tally.setdefault(w, [0, 0])[label > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array([v[1] for v in tally.values()], pa.int64()), pa.array([v[0] for v in tally.values()], pa.int64())], names=["word", "p", "n"])

    sizes = {r.y: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    positive, negative = sizes.get(True, 0), sizes.get(False, 0)
    if not positive or not negative:
        return {}, 0, np.zeros(0)
    tally = rows.mapInArrow(counted, "word binary, p long, n long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") + F.col("n") >= SUPPORT)
    odds = F.log((F.col("p") + 0.5) / (positive - F.col("p") + 0.5)) - F.log((F.col("n") + 0.5) / (negative - F.col("n") + 0.5))
    judged = tally.select("word", odds.alias("odds"), (2 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))).alias("spread"))
    judged = judged.select("word", F.when(F.col("odds") > 0, F.greatest(F.col("odds") - F.col("spread"), F.lit(0.0))).otherwise(F.least(F.col("odds") + F.col("spread"), F.lit(0.0))).alias("sure"))
    ends = judged.orderBy(F.desc("sure"), "word").limit(LEXICON).unionByName(judged.orderBy("sure", "word").limit(LEXICON)).distinct()
    words, toxic = lexicon_of(ends.collect())
    lexicon = {bytes(w): i for i, w in enumerate(words)}

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            x = features(batch.column(1).to_pylist(), lexicon, toxic)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([np.packbits(v[:-SHAPES] > 0).tobytes() + v[-SHAPES:].tobytes() for v in x], pa.binary())], names=["doc_id", "toxic", "x"])

    taught = sorted(rows.mapInArrow(vectorised, "doc_id long, toxic int, x binary").collect())
    cut = -4 * SHAPES
    x = np.array([np.append(np.unpackbits(np.frombuffer(r.x[:cut], np.uint8))[: len(lexicon)].astype(np.float32), np.frombuffer(r.x[cut:], np.float32)) for r in taught])
    gold = np.array([r.toxic for r in taught])
    post, _, _ = label_model(votes(x, toxic), gold > 0)
    return lexicon, toxic, logistic(x, post)


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = documents.sparkSession.sparkContext.broadcast(fit(rows, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, toxic, weights = given.value
        for batch in common.chunks(batches):
            if len(weights):
                score = 1 / (1 + np.exp(-np.clip(features(batch.column(1).to_pylist(), lexicon, toxic).astype(float) @ weights[:-1] + weights[-1], -30, 30)))
            else:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", F.coalesce(common.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))).mapInArrow(work, RESULT)


def op4_toxicity(spark, sf_dir):
    return score_texts(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
