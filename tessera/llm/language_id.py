"""Language identification with a byte convolutional network in numpy.

Texts are cut into windows of ``WINDOW`` bytes. A byte embedding is convolved with
filters of several widths, each filter is max-pooled over the window, and a
softmax layer gives language probabilities. A document's probabilities are those
of its windows, weighted by their bytes; every window of the whole text counts.

Training fits a bounded sample: at most ``TRAIN_DOCS`` labelled documents of each
language and ``TRAIN_WINDOWS`` windows of each, chosen by a hash of the id.
For prediction, embedding and filters collapse into two tables over byte pairs,
so a position costs two lookups and an addition.

Edge cases: null text, or one without a letter: ``und`` with score 0; no labelled
rows at all: ``und`` for everything; repeated rows are predicted each, and of rows
that share an id and a language one, of the least text, can be learnt from; of
equally likely languages the first by name is taken; a very long text is cut into
windows and scored in one task, in memory of some 40 times its size; an empty table
gives no rows; other columns are never read by ``predict``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, small_batches, unused
from .textkit import lean, slices, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TRAIN_DOCS = 300
TRAIN_WINDOWS = 6
EPOCHS = 4
#: The pipeline rejects documents below this score.
MIN_SCORE = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zeros, document of each, bytes of each)."""
    n = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((first[-1], WINDOW), dtype=np.uint8)
    flat = out.reshape(-1)
    for text, at in zip(texts, first.tolist(), strict=False):
        flat[at * WINDOW : at * WINDOW + len(text)] = np.frombuffer(text, dtype=np.uint8)
    doc = np.repeat(np.arange(len(texts)), n)
    size = np.full(len(doc), WINDOW, dtype=np.int64)
    if len(doc):
        last = first[1:][n > 0] - 1
        size[last] = [len(t) - WINDOW * (k - 1) for t, k in zip(texts, n.tolist(), strict=True) if k]
    return out, doc, size


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"emb": normal(256, EMBEDDING, scale=0.5)}
        for w in WIDTHS:
            self.p[f"w{w}"] = normal(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5)
        self.p["bias"] = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.p["out"] = normal(len(WIDTHS) * FILTERS, len(labels), scale=0.1)
        self.p["out_bias"] = np.zeros(len(labels), dtype=np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on cross entropy; the max pool passes each filter's gradient to one position."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                grads = self._gradients(x[rows], y[rows])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        e = p["emb"][padded]
        pooled, where = [], []
        for w in WIDTHS:
            z = sum(e[:, k : k + WINDOW] @ p[f"w{w}"][k] for k in range(w))
            at = z.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
        z = np.concatenate(pooled, axis=1) + p["bias"]
        h = np.maximum(z, 0)
        score = h @ p["out"] + p["out_bias"]
        score -= score.max(axis=1, keepdims=True)
        prob = np.exp(score)
        prob /= prob.sum(axis=1, keepdims=True)
        prob[np.arange(n), y] -= 1
        d = prob / n
        dz = (d @ p["out"].T) * (z > 0)
        grads = {"out": h.T @ d, "out_bias": d.sum(axis=0), "bias": dz.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        row = np.arange(n)[:, None]
        for j, (w, at) in enumerate(zip(WIDTHS, where, strict=True)):
            g = dz[:, j * FILTERS : (j + 1) * FILTERS]
            kernel = np.zeros_like(p[f"w{w}"])
            for k in range(w):
                bytes_at = padded[row, at + k]
                kernel[k] = np.einsum("nfe,nf->ef", p["emb"][bytes_at], g)
                np.add.at(grads["emb"], bytes_at.reshape(-1), (g[:, :, None] * p[f"w{w}"][k].T[None]).reshape(-1, EMBEDDING))
            grads[f"w{w}"] = kernel
        return grads

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs as head[pair at i] + tail[pair at i + 2], over all byte pairs."""
        total = len(WIDTHS) * FILTERS
        single = np.zeros((4, 256, total), dtype=np.float32)
        for j, w in enumerate(WIDTHS):
            for k in range(w):
                single[k, :, j * FILTERS : (j + 1) * FILTERS] = self.p["emb"] @ self.p[f"w{w}"][k]
        pair = lambda a, b: (single[a][:, None] + single[b][None]).reshape(-1, total)
        return pair(0, 1), pair(2, 3)

    def probabilities(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], step: int = 64) -> np.ndarray:
        head, tail = tables
        out = np.empty((len(x), len(self.labels)), dtype=np.float32)
        total = head.shape[1]
        for i in range(0, len(x), step):
            part = np.pad(x[i : i + step], ((0, 0), (0, 3))).astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            z = head[pairs[:, :WINDOW]]
            z += tail[pairs[:, 2 : WINDOW + 2]]
            h = np.maximum(z.max(axis=1) + self.p["bias"], 0).reshape(-1, total)
            score = h @ self.p["out"] + self.p["out_bias"]
            score -= score.max(axis=1, keepdims=True)
            e = np.exp(score)
            out[i : i + step] = e / e.sum(axis=1, keepdims=True)
        return out


def train(documents: DataFrame, docs_per_language: int = TRAIN_DOCS) -> ByteCNN | None:
    """Fit on windows of a bounded sample of the labelled rows outside fold 0."""
    spark = documents.sparkSession
    lot = F.md5(F.concat(F.lit("lang|"), F.col("doc_id").cast("string")))
    labelled = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    order = Window.partitionBy("lang").orderBy("lot", "doc_id")
    ids = labelled.select("doc_id", "lang", lot.alias("lot")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= docs_per_language).select("doc_id").distinct()
    small_batches(spark)
    # at most docs_per_language ids of each language: the sample's bound is the broadcast's
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rows = [], []
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if has_letter(text):
                    x, _, _ = windows([text])
                    pick = np.unique(np.linspace(0, len(x) - 1, TRAIN_WINDOWS).astype(int))
                    rows += [x[i].tobytes() for i in pick]
                    langs += [lang] * len(pick)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(rows, pa.binary())], names=["lang", "window"])

    found = sorted((r[0], bytes(r[1])) for r in sample.mapInArrow(lean(cut), "lang string, window binary").collect())
    labels = sorted({lang for lang, _ in found})
    if not labels:
        return None
    model = ByteCNN(labels)
    code = {x: i for i, x in enumerate(labels)}
    model.fit(np.stack([np.frombuffer(w, dtype=np.uint8) for _, w in found]), np.array([code[lang] for lang, _ in found]))
    return model


def predict(documents: DataFrame, model: ByteCNN | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (default doc_id), predicted language and score of every row."""
    spark = documents.sparkSession
    keep = keep or ["doc_id"]
    small_batches(spark)
    at = keep.index("text") if "text" in keep else len(keep)
    shared = spark.sparkContext.broadcast(model)  # a few kB: the network's size is fixed
    schema = documents.select(*keep).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net is not None else None
        for batch in batches:
            texts = utf8(batch.column(at))
            labels, scores = ["und"] * len(texts), np.zeros(len(texts))
            for a, b in slices(texts) if net is not None else ():
                x, doc, size = windows(texts[a:b])
                prob = net.probabilities(x, tables) * size[:, None]
                total = np.zeros((b - a, len(net.labels)))
                np.add.at(total, doc, prob)
                best = total.argmax(axis=1)
                for i in range(b - a):
                    if has_letter(texts[a + i]):
                        labels[a + i], scores[a + i] = net.labels[best[i]], min(1.0, total[i, best[i]] / len(texts[a + i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores)], names=schema.names)

    return documents.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(lean(run), schema)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    out = predict(documents, train(documents))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def accepted(documents: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is known with ``min_score`` at least; columns unchanged."""
    columns = documents.columns
    lang, score = unused(documents, "lang_pred"), unused(documents, "score")
    scored = predict(documents, train(documents), keep=columns, names=(lang, score))
    return scored.filter((F.col(lang) != "und") & (F.col(score) >= min_score)).select(columns)
