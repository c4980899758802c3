"""Scores and hypotheses of a decoder as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_softmax(logits: Column, pad: int | None = None) -> Column:
    """Log-probabilities; the pad id gets minus infinity after normalising. One fold: the largest so far, and the sum of exponentials by it."""
    low = F.lit(float("-inf"))

    def step(acc: Column, x: Column) -> Column:
        most = F.greatest(acc["most"], x)
        total = F.when(x <= low, acc["total"]).when(x > acc["most"], acc["total"] * F.exp(acc["most"] - x) + 1).otherwise(acc["total"] + F.exp(x - acc["most"]))
        return F.struct(most.alias("most"), total.alias("total"))

    def finish(acc: Column) -> Column:
        log_p = lambda x: x - acc["most"] - F.log(acc["total"])
        if pad is None:
            return F.transform(logits, log_p)
        return F.transform(logits, lambda x, i: F.when(i == pad, low).otherwise(log_p(x)))

    return F.aggregate(logits, F.struct(low.alias("most"), F.lit(0.0).alias("total")), step, finish)


def top_k(scores: Column, k: int) -> Column:
    """The k best as struct<id,score>; ties keep the lower id."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("low"), i.alias("id"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s["id"].alias("id"), (-s["low"]).alias("score")))


def normalised_score(score: Column, tokens: Column) -> Column:
    """Score over length, the start token counted."""
    return score / F.size(tokens)


def length_cap(n_input: Column) -> Column:
    return F.least(F.lit(512), 3 * n_input + 20)


def stripped(tokens: Column, end: int) -> Column:
    """Without the start token and end marks."""
    return F.filter(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t: t != end)


def best(hypotheses: Column) -> Column:
    """Of struct<tokens,score>, the first with the highest score over length."""
    ranked = F.array_sort(F.transform(hypotheses, lambda h, i: F.struct((-normalised_score(h["score"], h["tokens"])).alias("low"), i.alias("i"), h.alias("h"))))
    return F.get(ranked, F.lit(0))["h"]


def reverse_vocabulary(vocabulary: Column) -> Column:
    """Array by id of a map<string,int>; gaps are empty."""
    flipped = F.map_from_entries(F.transform(F.map_entries(vocabulary), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    top = F.array_max(F.map_values(vocabulary))
    return F.transform(F.sequence(F.lit(0), top), lambda i: F.coalesce(F.try_element_at(flipped, i), F.lit("")))


def piece_ids(pieces: Column, vocabulary: Column, unknown: Column) -> Column:
    return F.transform(pieces, lambda p: F.coalesce(F.try_element_at(vocabulary, p), unknown))


def id_pieces(ids: Column, reverse: Column) -> Column:
    """Pieces of ids; ids out of range are dropped."""
    return F.transform(F.filter(ids, lambda i: (i >= 0) & (i < F.size(reverse))), lambda i: F.get(reverse, i))
