"""Translating zones: sentence by sentence, beam search over a pluggable decoder step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as T

BEAMS = 4
Step = Callable[[list[int], list[int]], np.ndarray]


def _log_softmax(logits: np.ndarray, pad: int) -> np.ndarray:
    x = np.asarray(logits, np.float32)
    x = x - x.max()
    x = x - np.float32(np.log(np.exp(x, dtype=np.float64).sum()))
    x[pad] = -np.inf
    return x


def _best(scores: np.ndarray, k: int) -> list[int]:
    return np.argsort(-scores, kind="stable")[:k].tolist()


def beam_search(source: list[int], step: Step, start: int, end: int, pad: int, beams: int = BEAMS, forced: int | None = None) -> list[int]:
    """Tokens without start and end marks. step(source, tokens) gives the logits after tokens; a forced first token counts with its probability."""
    live, done = [([start], 0.0)], []
    for turn in range(min(512, 3 * len(source) + 20)):
        found = []
        for tokens, score in live:
            scores = _log_softmax(step(source, tokens), pad)
            following = [forced] if forced is not None and turn == 0 else _best(scores, beams)
            found += [([*tokens, t], score + float(scores[t])) for t in following]
        found.sort(key=lambda h: -h[1])
        live = []
        for tokens, score in found:
            if tokens[-1] == end:
                done.append((tokens, score))
            elif len(live) < beams:
                live.append((tokens, score))
        if len(done) >= beams or not live:
            break
    tokens = max(done or live, key=lambda h: h[1] / len(h[0]))[0]
    return [t for t in tokens[1:] if t != end]


def translate(zones: DataFrame, engine: Callable[[], Callable[[list[str]], list[str | None]]], split: bool, calm: bool, only_missing: bool = False) -> DataFrame:
    """zones (page_id, zone_idx, text_src, text_dst) with text_dst translated.

    engine makes, once in each worker, a function from sentences to translations
    (null for failures). Zones with blank source keep their translation; a failed
    one overwrites it with null, unless only_missing leaves existing ones alone.
    """
    todo = ~T.is_blank(F.col("text_src"))
    if only_missing:
        todo = todo & F.col("text_dst").isNull()
    pieces = T.sentences(F.col("text_src")) if split else F.array("text_src")
    rows = zones.filter(todo).select("page_id", "zone_idx", F.posexplode(pieces).alias("part", "sentence"))
    rows = rows.withColumn("sentence", T.calmed(F.col("sentence")) if calm else F.col("sentence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = engine()
        for batch in batches:
            yield batch[["page_id", "zone_idx", "part"]].assign(out=made(batch["sentence"].tolist()))

    parts = rows.mapInPandas(run, "page_id bigint, zone_idx int, part int, out string")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "out"))), lambda s: s["out"])
    joined = parts.groupBy("page_id", "zone_idx").agg(T.joined(texts).alias("__new"))
    out = zones.join(joined.withColumn("__did", F.lit(True)), ["page_id", "zone_idx"], "left")
    return out.withColumn("text_dst", F.when(F.col("__did"), F.col("__new")).otherwise(F.col("text_dst"))).select(*zones.columns)
