"""Document quality by nearest-neighbour voting in a latent semantic space.

A text becomes counts of hashed byte trigrams, weighted by log(1 + tf) * idf and
projected on the leading singular vectors of a labelled sample. Labelled vectors
are broadcast; each document gets its exact cosine with all of them, in blocks,
and the labels of its nearest neighbours vote with their similarity.

The sample is bounded: at most ``PER_CLASS`` labelled rows of each label outside
fold 0, chosen by a hash of the id. All documents are scored.

Edge cases: a null or empty text has no trigrams and scores the sample's share of
label 1; without labelled rows all score 0.5; repeated rows are scored each, and of
rows that share an id the least text is learnt from, with the highest of its labels;
neighbours of equal similarity at the last place count as the sort leaves them, always
alike for one sample; a very long text is counted whole, in memory of a few times its
size; an empty table gives no rows; lang and source are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, small_batches
from .textkit import lean, slices, utf8

DIMENSIONS = 2048
LATENT = 64
PER_CLASS = 1500
NEIGHBOURS = 25
#: Exponent of the similarity as weight of a vote.
SHARPNESS = 4
THRESHOLD = 0.3
#: Documents whose cosines are computed together.
BLOCK = 256


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte trigrams, one row per text; none spans two texts."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    if len(data) < 3:
        return out
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(21)
    end = np.cumsum(lengths)
    for i, (stop, n) in enumerate(zip(end.tolist(), lengths.tolist(), strict=True)):
        if n >= 3:
            out[i] = np.bincount(code[stop - n : stop - 2], minlength=DIMENSIONS)
    return out


@dataclass
class LatentVoter:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.maximum(norm, 1e-12)

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, seed: int = 5) -> LatentVoter:
        """Randomised truncated SVD with two power iterations."""
        n = len(counts)
        idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = cls.weigh(counts, idf).astype(np.float32)
        rank = min(LATENT, *x.shape)
        rng = np.random.default_rng(seed)
        q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(rank + 16, n))).astype(np.float32))[0]
        for _ in range(2):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
        basis = vt[:rank].T.astype(np.float32)
        vectors = x @ basis
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        return cls(idf, basis, vectors, labels.astype(np.float32), float(labels.mean()))

    def score(self, texts: list[bytes]) -> np.ndarray:
        counts = trigram_counts(texts)
        z = self.weigh(counts, self.idf).astype(np.float32) @ self.basis
        size = np.linalg.norm(z, axis=1, keepdims=True)
        cosine = (z / np.maximum(size, 1e-12)) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((size[:, 0] > 1e-9) & (total > 1e-9), np.clip(vote, 0, 1), self.prior).astype(np.float64)


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> LatentVoter | None:
    """Fit on a bounded sample of the labelled rows outside fold 0."""
    spark = documents.sparkSession
    lot = F.md5(F.concat(F.lit("quality|"), F.col("doc_id").cast("string")))
    usable = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = [usable.filter(F.col("quality") == q).orderBy(lot, "doc_id").limit(per_class) for q in (0, 1)]
    wanted = {r["doc_id"]: r["quality"] for part in chosen for r in part.collect()}  # at most 2 * per_class ids
    if not wanted:
        return None
    small_batches(spark)
    ids = spark.createDataFrame([(x,) for x in sorted(wanted)], documents.select("doc_id").schema)
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [trigram_counts([t])[0].astype("<f4").tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "counts"])

    rows = {r["doc_id"]: bytes(r["counts"]) for r in sample.mapInArrow(lean(count), sample.select("doc_id").schema.add("counts", "binary")).toLocalIterator()}
    if not rows:
        return None
    order = sorted(rows)
    counts = np.stack([np.frombuffer(rows[x], dtype="<f4") for x in order])
    return LatentVoter.fit(counts, np.array([wanted[x] for x in order]))


def score(documents: DataFrame, model: LatentVoter | None) -> DataFrame:
    """doc_id and score of every row."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's size
    schema = documents.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = shared.value
        for batch in batches:
            texts = utf8(batch.column(1))
            out = np.full(len(texts), 0.5)
            for a, b in slices(texts) if voter is not None else ():
                for i in range(a, b, BLOCK):
                    out[i : min(i + BLOCK, b)] = voter.score(texts[i : min(i + BLOCK, b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=schema.names)

    return documents.select("doc_id", "text").mapInArrow(lean(run), schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = score(documents, train(documents, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
