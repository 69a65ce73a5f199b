"""Language ID: nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors.

A vector counts the byte n-grams (1 to 3) of a whole text, lower-cased and with each run of
characters that are no letters (of ASCII) made one space, in DIM hashed places, damped by log(1 + count), weighted by inverse document frequency over all training
documents, and scaled to length one.  Up to PER_LANGUAGE different training documents (id and text) of each
language (those with the smallest hashes; MOST in all, so that with more languages than that the MOST with the
most documents are learned) are clustered into CENTROIDS centroids by spherical k-means.  A text gets the language of its nearest centroid.  It is rejected when
its cosine falls below a cutoff of that language and its length (to a power of two): MARGIN times the
LOW quantile of the cosines that the POOL sample texts of the language next in length, or more, have
with centroids made without them (in PARTS parts); shorter texts never need more than longer ones.  Texts shorter than all of the language's sample are not rejected for their distance.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected;
without any training row everything is; equal cosines go to the language first
in order; a null doc_id is not held out; repeated rows get equal results; an
empty table gives an empty result; columns but doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

GRAMS, DIM = 3, 2048
PER_LANGUAGE, MOST, CENTROIDS = 400, 20_000, 4
LOW, MARGIN, POOL, PARTS = 0.01, 0.9, 30, 3
FOLDS, HELD_OUT = 3, 1
#: Texts whose dense vectors are in memory at once.
ROWS = 512

#: What is no letter of ASCII becomes a space.
LETTER = np.full(256, 32, np.uint8)
LETTER[65:91] = LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


def counts(texts: pa.Array) -> np.ndarray:
    """Rows x DIM counts of hashed n-grams; none spans two rows."""
    data, offsets = common.flat(pc.utf8_lower(texts))
    data = LETTER[data]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    if len(data):
        keep = np.append(True, (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1]))
        data, row = data[keep].astype(np.uint32), row[keep]
    out = np.zeros(len(texts) * DIM, np.int64)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, GRAMS + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        place = ((code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM.bit_length() + 1)
        same = row[: len(row) - n + 1] == row[n - 1 :]
        out += np.bincount((row[: len(row) - n + 1] * DIM + place)[same], minlength=len(out))
    return out.reshape(len(texts), DIM)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts(texts)) * idf)


def band(texts: pa.Array) -> np.ndarray:
    """Length in bytes, to a power of two."""
    return np.log2(1 + pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(float)).astype(int)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the row nearest the mean, then always the row farthest from those chosen."""
    chosen = [int(np.argmax(x @ unit(x.mean(axis=0))))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.array([unit(x[near == i].mean(axis=0)) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def cutoffs(x: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """By band of length, the cosine under which a text is none of the language with these samples."""
    out = np.zeros(64)
    if len(x) < 2:
        return out
    part = np.arange(len(x)) % PARTS
    score = np.empty(len(x))
    for p in range(min(PARTS, len(x))):
        score[part == p] = (x[part == p] @ cluster(x[part != p], CENTROIDS).T).max(axis=1)
    for b in range(bands.min(), 64):
        apart = np.abs(bands - b)
        near = apart <= np.sort(apart)[: POOL][-1]
        out[b] = MARGIN * np.quantile(score[near], LOW, method="lower")
    out[bands.min() :] = np.minimum.accumulate(out[bands.min() :][::-1])[::-1]
    return out


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and (t.isalpha() or any(map(str.isalpha, t))) for t in texts], bool)


class Model:
    def __init__(self, idf: np.ndarray, samples: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """samples: by language the vectors and the bands of length."""
        self.idf, self.languages = idf.astype(np.float32), sorted(samples)
        centres, of = [], []
        self.least = np.zeros((len(self.languages), 64))
        for i, lang in enumerate(self.languages):
            x, bands = samples[lang]
            own = cluster(x, CENTROIDS)
            centres.append(own)
            of += [i] * len(own)
            self.least[i] = cutoffs(x, bands)
        self.centres = np.concatenate(centres) if centres else np.zeros((0, DIM))
        self.of = np.array(of, int)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        letters = has_letter(texts.to_pylist())
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(texts, self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        lang = self.of[best]
        return [self.languages[i] if ok else "und" for i, ok in zip(lang, letters, strict=True)], np.where(letters, score, 0.0), ~letters | (score < self.least[lang, band(texts)])


def fit(documents: DataFrame, train) -> Model:
    """Inverse document frequencies of all training rows, centroids of a bounded sample of them."""
    rows = documents.where(train & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in slices(batches):
            total += (counts(batch.column(0)) > 0).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM, dtype=np.int32)), pa.array(np.append(n, total))], names=["place", "n"])

    df = np.zeros(DIM + 1)
    for place, n in rows.select("text").mapInArrow(frequencies, "place int, n long").groupBy("place").agg(F.sum("n")).collect():
        df[place + 1] = n
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    sizes = documents.sparkSession.createDataFrame(sizes.orderBy(F.desc("n"), "lang").limit(MOST).collect(), "lang string, n long")
    languages = sizes.count()
    if not languages:
        return Model(idf, {})
    each = max(1, min(PER_LANGUAGE, MOST // languages))
    # the smallest hashes of a language lie below a bound that few of its rows pass
    near = rows.join(F.broadcast(sizes), "lang").where(F.col("h").cast("double") / 2.0**63 < 2.0 * (4 * each + 40) / F.col("n") - 1)
    different = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    chosen = different.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= each)

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            v = vectors(batch.column(1), idf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(band(batch.column(1)).astype(np.int32))], names=["lang", "vector", "band"])

    samples: dict[str, list[tuple]] = defaultdict(list)
    for lang, v, size in sorted(chosen.select("lang", "text").mapInArrow(vectorised, "lang string, vector binary, band int").collect()):  # MOST rows at most
        samples[lang].append((np.frombuffer(v, np.float32).astype(np.float64), size))
    return Model(idf, {k: (np.array([x for x, _ in v]), np.array([b for _, b in v])) for k, v in samples.items()})


def training(folds: int = FOLDS, held_out: int = HELD_OUT):
    return F.coalesce(common.fold("doc_id", folds) != held_out, F.lit(True))


def predictions(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of every row, with lang_pred, score and rejected."""
    rows = documents.select("text", *(F.col(k).alias(f"_{i}") for i, k in enumerate(keep)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score, rejected = model.predict(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    return rows.mapInArrow(work, f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(rows, training())
    marked = rows.withColumn("held_out", ~training())
    return predictions(marked, model, ["doc_id", "held_out"])


def accepted(documents: DataFrame) -> DataFrame:
    """The rows that a model of their own languages does not reject, with all columns."""
    kept = documents.columns
    model = fit(documents, training())
    found = predictions(documents, model, kept)
    return found.where(~F.col("rejected")).select(*kept)


def op7_language_id(spark, sf_dir):
    return identify(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
