"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features are hashed lower-case words and their first PREFIX bytes (which catch
inflected forms), as presence. Of the features in a bounded sample of labelled documents (SAMPLE_DOCS of each kind, by hash of the id) those
are kept that mark toxic documents beyond chance and by a wide ratio of odds.
Labels are ordered grades, 0 for clean, up to MAX_GRADE (higher ones count as that);
labels that only say toxic or not make two ordered grades with one threshold. The
model has one weight vector for all thresholds: P(grade > j) = sigmoid(w.x - theta_j)
with theta_0 < theta_1 < ..., fitted in numpy. The severity is the expected grade, the
sum of P(grade > j); toxic means P(grade > 0) >= 1/2.

Whole texts are read, in one pass. The model is a few thousand numbers.

Defined results: null and empty texts hold no feature and get the severity of a
text without any; without labels of both kinds no word marks anything and all
documents get severity 0; repeated labels of an id count once (the worst one), null and
negative ones not at all; repeated rows are scored alike; texts of any length are read
whole; other columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

SAMPLE_DOCS = 3000
MAX_GRADE = 9
MIN_DOCS = 5
#: The least root of the likelihood ratio (G squared) of a marking word: standard errors, about.
Z = 4.7
#: The least log odds ratio of a marking word.
MIN_ODDS = 3.5
PREFIX = 4
MAX_WORDS = 4096
STEPS, RATE, PENALTY = 400, 0.5, 1e-3
SEED = 5
_STRIP = b".,;:!?()[]{}\"'*%&$#|<>"


def words(text: bytes) -> np.ndarray:
    """Sorted hashes of the features of a text: distinct words, lower-cased, without punctuation around them, and their beginnings."""
    # str.lower() also lowers letters beyond ASCII
    found = {w.strip(_STRIP) for w in text.decode("utf-8", "replace").lower().encode().split()}
    found.discard(b"")
    found |= {b"^" + w[:PREFIX] for w in found if len(w) > PREFIX}
    return np.unique(np.fromiter(map(crc32, found), np.uint32, len(found)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """vocabulary: sorted word hashes; weights: one each; thresholds: ascending."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def score(self, hashes: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        if not len(self.vocabulary):
            return np.zeros(len(self.thresholds))
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        x = self.weights[at[self.vocabulary[at] == hashes]].sum()
        return _sigmoid(x - self.thresholds)


def _likelihood_ratio(t: np.ndarray, n_toxic: int, c: np.ndarray, n_clean: int) -> np.ndarray:
    """G squared of each word's two-by-two table."""
    n = n_toxic + n_clean
    total = np.zeros(len(t))
    for seen, group, held in ((t, n_toxic, t + c), (n_toxic - t, n_toxic, n - t - c), (c, n_clean, t + c), (n_clean - c, n_clean, n - t - c)):
        expected = held * (group / n)
        total += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)
    return np.maximum(total, 0)


def marking(clean: list[np.ndarray], toxic: list[np.ndarray]) -> np.ndarray:
    """Hashes of the words that mark toxic documents, at most MAX_WORDS."""
    if not clean or not toxic:
        return np.zeros(0, np.uint32)
    every, where = np.unique(np.concatenate(clean + toxic), return_inverse=True)
    n_clean = sum(map(len, clean))
    c = np.bincount(where[:n_clean], minlength=len(every))
    t = np.bincount(where[n_clean:], minlength=len(every))
    odds = lambda n, total: np.log((n + 0.5) / (total - n + 0.5))
    ratio = odds(t, len(toxic)) - odds(c, len(clean))
    z = np.sqrt(_likelihood_ratio(t, len(toxic), c, len(clean)))  # holds for words that no clean document has, too
    ok = np.flatnonzero((t >= MIN_DOCS) & (z >= Z) & (ratio >= MIN_ODDS))
    return np.sort(every[ok[np.argsort(-z[ok], kind="stable")[:MAX_WORDS]]])


def _loss(x: np.ndarray, above: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> float:
    """The weighted negative log-likelihood of the binary questions "above grade j?"."""
    z = np.where(above, 1, -1) * (x[:, None] - theta)
    return float((np.logaddexp(0, -z) * weight).sum())


def _slopes(x: np.ndarray, above: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the loss by each document's x and by each threshold."""
    error = (_sigmoid(x[:, None] - theta) - above) * weight
    return error.sum(axis=1), -error.sum(axis=0)


def fit(groups: list[list[np.ndarray]]) -> Model:
    """groups: features of documents by grade, from clean on; each grade weighs the same."""
    clean, toxic = groups[0] if groups else [], [x for g in groups[1:] for x in g]
    vocabulary, n_thresholds = marking(clean, toxic), max(1, len(groups) - 1)
    if not len(vocabulary):
        return Model(vocabulary, np.zeros(0), np.arange(n_thresholds, dtype=float))
    rows, columns = [], []
    for i, hashes in enumerate(clean + toxic):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = at[vocabulary[at] == hashes]
        rows.append(np.full(len(hit), i))
        columns.append(hit)
    row, column, n = np.concatenate(rows), np.concatenate(columns), len(clean) + len(toxic)
    grade = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    above = grade[:, None] > np.arange(n_thresholds)  # shared weights: one binary question for each threshold
    weight = np.where(grade > 0, 0.5 / max(1, len(toxic)), 0.5 / max(1, len(clean)))[:, None]
    w, first, gaps = np.zeros(len(vocabulary)), 1.0, np.zeros(n_thresholds - 1)
    moment = [np.zeros(len(vocabulary)), 0.0, np.zeros(n_thresholds - 1)]
    for _ in range(STEPS):
        x = np.bincount(row, w[column], minlength=n)
        theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))  # ascending by construction
        by_row, slope = _slopes(x, above, weight, theta)
        tail = np.cumsum(slope[::-1])[::-1]
        grads = [np.bincount(column, by_row[row], minlength=len(w)) + PENALTY * w, tail[0], tail[1:] * np.exp(gaps)]
        steps_now = []
        for k, g in enumerate(grads):
            moment[k] = moment[k] + g * g
            steps_now.append(RATE * g / (np.sqrt(moment[k]) + 1e-9))
        w, first, gaps = w - steps_now[0], first - steps_now[1], gaps - steps_now[2]
    theta = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return Model(vocabulary, w, theta)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, n: int, seed: int = SEED) -> list[list[np.ndarray]]:
    """By grade, word hashes of at most n labelled documents, on the driver: MAX_GRADE + 1 times n at most."""
    judged = labels.select(F.col(id_col).cast("bigint").alias("__tox_id"), F.least(F.lit(MAX_GRADE), F.col(label_col).cast("int")).alias("__tox_label")).dropna().filter("__tox_label >= 0")
    judged = judged.groupBy("__tox_id").agg(F.max("__tox_label").alias("__tox_label"))
    order = F.xxhash64(F.lit(seed), F.col("__tox_id"))
    grades = sorted({0} | {r[0] for r in judged.select("__tox_label").distinct().collect()})
    ids = [(r[0], i) for i, g in enumerate(grades) for r in judged.filter(F.col("__tox_label") == g).orderBy(order, "__tox_id").limit(n).collect()]
    if not ids:
        return [[]]
    listed = docs.sparkSession.createDataFrame(ids, "__tox_id bigint, __tox_label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [words(t).astype("<u4").tobytes() for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary())], ["id", "label", "words"])

    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__tox_id"), F.col(f"`{text_col}`").cast("string").alias("__tox_text")).join(F.broadcast(listed), "__tox_id").select("__tox_id", "__tox_label", "__tox_text")
    # repeated rows of an id would make the sample unbounded: one of each stays
    rows = picked.mapInArrow(run, "id bigint, label int, words binary").groupBy("id", "label").agg(F.min("words").alias("words")).orderBy("id").collect()
    return [[np.frombuffer(r[2], "<u4") for r in rows if r[1] == i] for i in range(len(grades))]


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, severity (expected grade), grade (most likely), p_toxic, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.array([model.score(words(t)) for t in as_bytes(batch.column(1))]).reshape(batch.num_rows, -1)
            edges = np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1)
            likely = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1).astype(np.int32)
            likely = np.where(above[:, 0] >= 0.5, np.maximum(likely, 1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(above.sum(axis=1)), pa.array(likely), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], ["id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, severity double, grade int, p_toxic double, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return grade(docs, fit(sample(docs, labels, id_col, text_col, label_col, sample_docs)), id_col, text_col)
