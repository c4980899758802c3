"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Two generative models are counted over hashed n-grams (of bytes, and pairs of
neighbouring words as equal or not, which byte n-grams can't see): one of the target (a
bounded sample of labelled good documents: TARGET_DOCS, by hash of the id), one of
the raw text (all documents). A document's importance is the mean log ratio of the
two over its n-grams, times SHARPNESS (an inverse temperature: so many n-grams count
as independent evidence); the mean keeps long documents from ruling, and PRIOR n-grams
without evidence keep very short ones near zero. Gumbel noise seeded by the document's
id is added and the k highest stay: a sample without replacement in proportion to
exp(importance). By default k is the share of good ones among all labelled documents, of
the documents with n-grams.

The k-th score is found by a radix search over counts, never by sorting all
documents in one place. Rows are scored in one pass over the text after one pass
that counts it.

Defined results: null and empty texts (no n-grams) have importance minus infinity
and are never selected; equal scores are told apart by id, then all rows equal in
both stay together; rows with a null id draw the noise of their text alone; an
empty table gives an empty result; without labels of both kinds all texts with
n-grams are selected; repeated labels of an id count once (the worst one); rows equal in
id and text get equal scores; texts of any length are read whole, in blocks; further
columns may have any name and are ignored, or returned by selected_rows().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, stored

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
#: Labelled documents used for the target's model.
TARGET_DOCS = 6000
SHARPNESS = 60.0
SEED = 11
SMOOTHING = 0.5
#: A pair of words counts as so many n-grams.
PAIR_WEIGHT = 4
PRIOR = 400
_BLOCK = 1 << 16


def grams(text: bytes) -> np.ndarray:
    """How often each bucket's n-grams occur, over the whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK + max(SIZES) - 1].astype(np.uint32)
        own = min(_BLOCK, len(data) - at)
        key = part.copy()
        for n in range(2, max(SIZES) + 1):
            key = key[: len(part) - n + 1] << np.uint32(8) | part[n - 1 :]
            if n in SIZES:
                mixed = (key[:own] + np.uint32(n * 0x632BE5AB & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                counts += np.bincount((mixed >> np.uint32(18)).astype(np.int64), minlength=BUCKETS)  # buckets 0 and 1 are shared with the pairs
    words = text.split()
    equal = sum(map(eq, words, words[1:]))
    counts[:2] += PAIR_WEIGHT * np.array([max(0, len(words) - 1) - equal, equal])
    return counts


def _count(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts over all rows: each task sums its own, and Spark sums by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total += grams(text)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return counts


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    a, b = target + SMOOTHING, raw + SMOOTHING
    return np.log(a / a.sum()) - np.log(b / b.sum())


def gumbel(key: bytes, seed: int = SEED) -> float:
    u = (xxhash.xxh64_intdigest(key, seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(min(u, 1 - 1e-16))))


def _score(docs: DataFrame, id_col: str, text_col: str, ratio: np.ndarray, sharpness: float, seed: int, name: str, carry: bool = False) -> DataFrame:
    """(id, importance, score), written; carry: and all columns of docs, as c0, c1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                weight, score = [], []
                for key, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                    counts = grams(text)
                    n = int(counts.sum())
                    mean = sharpness * float(counts @ ratio) / (n + PRIOR) if n else -np.inf
                    weight.append(mean)
                    score.append(mean + gumbel(text if key is None else str(key).encode(), seed))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weight, pa.float64()), pa.array(score, pa.float64()), *part.columns[1 if carry else 2 :]], names)

    # the text goes to Python once: where it is carried, it is read from its own column
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col] if carry else []
    picked = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text, *others)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("importance", T.DoubleType()), T.StructField("score", T.DoubleType()), *(picked.schema.fields[1:] if carry else [])])
    names = schema.names
    return stored(picked.mapInArrow(run, schema), name)


def kth_score(scored: DataFrame, k: int) -> tuple[float, int | None] | None:
    """The k-th highest (score, id) by a search over counts of 4096 equal ranges, narrowed each round. None: all are in."""
    if k <= 0:
        return np.inf, None
    low, high = scored.filter("score > double('-Infinity')").agg(F.min("score"), F.max("score")).first()
    if low is None:
        return None
    total = scored.filter("score > double('-Infinity')").count()
    if k >= total:
        return None
    rest, above = scored.filter(F.col("score").between(low, high)), 0
    while True:
        inside = rest.filter(F.col("score").between(low, high))
        width = (high - low) / 4096
        n = inside.count()
        if n <= 4096 or width <= 0 or low + width == low:
            break
        bucket = F.least(F.lit(4095), F.floor((F.col("score") - low) / width))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(bucket.alias("b")).agg(F.count("*"), F.min("score"), F.max("score")).collect()}
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                low, high = counts[b][1], counts[b][2]
                break
            above += counts[b][0]
    ordered = inside.groupBy("score", "id").count().orderBy(F.desc("score"), F.desc_nulls_last("id"))
    for row in ordered.toLocalIterator() if n > 4096 else ordered.collect():
        above += row[2]
        if above >= k:
            return row[0], row[1]
    return None


def _models(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, target_docs: int, seed: int) -> tuple[np.ndarray, float | None]:
    """The log ratio of the target's and the raw model, and the share of good labels (None without labels of both kinds)."""
    judged = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    n, n_good = judged.agg(F.count("*"), F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0))).first()
    raw = _count(docs, text_col)
    if not 0 < n_good < n:
        return log_ratio(raw, raw), None
    order = F.xxhash64(F.lit(seed), F.col("id"))
    listed = judged.filter("label = 1").orderBy(order, "id").limit(target_docs).select(F.col("id").alias("__quality_id"))
    target = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__quality_id"), F.col(f"`{text_col}`").alias(text_col)).join(F.broadcast(listed), "__quality_id", "left_semi")  # target_docs rows at most
    return log_ratio(_count(target, text_col), raw), n_good / n


def _chosen(scored: DataFrame, share: float | None, k: int | None) -> Column:
    """Whether a row of scored is among the k highest."""
    if k is None:
        some = scored.filter("importance > double('-Infinity')").count()
        k = some if share is None else min(some, math.ceil(some * share))
    found = kth_score(scored, k)
    some = F.col("score") > float("-inf")
    if found is None:
        return some
    score, last = found
    tie = F.lit(True) if last is None else F.coalesce(F.col("id") >= last, F.lit(False))
    return ((F.col("score") > score) | ((F.col("score") == score) & tie)) & some


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, target_docs: int = TARGET_DOCS, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """One row per document: id, importance, score (with Gumbel noise), selected."""
    ratio, share = _models(docs, labels, id_col, text_col, label_col, target_docs, seed)
    scored = _score(docs, id_col, text_col, ratio, sharpness, seed, "importance")
    return scored.withColumn("selected", _chosen(scored, share, k))


def selected_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, target_docs: int = TARGET_DOCS, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """The rows of docs that resample() selects, with all their columns; they are written with their scores, so texts aren't shuffled."""
    ratio, share = _models(docs, labels, id_col, text_col, label_col, target_docs, seed)
    scored = _score(docs, id_col, text_col, ratio, sharpness, seed, "importance-rows", carry=True)
    back = [F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return scored.filter(_chosen(scored, share, k)).select(*back)
