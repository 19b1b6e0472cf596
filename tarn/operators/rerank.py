"""Re-ranking by a model that scores pairs of a query and a text, in batches.

A worker loads the model once. Pairs are taken in the order of their length, in batches whose longest pair times their number stays
within a budget of tokens, so little of a batch is padding. A batch that fails is halved and tried again; a pair that fails
alone has no score but a reason. A query with a pair without a finite score keeps its order, as does one of fewer than two rows, and
``fallback`` says why, so a model that is out of order changes nothing and hides nothing.

``load()`` makes the model: a function from a list of (query, text) to as many numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.plans.batches import bound_batches

Scorer = Callable[[list[tuple[str, str]]], Sequence[float]]
#: Tokens of a batch (the longest pair times its pairs), and characters that count as one.
TOKENS, CHARS = 8192, 4
#: Times that a failed batch is halved before its pairs are given up one by one.
HALVINGS = 6


def batches_of(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Places in the order of their length, in batches of at most ``budget`` once padded; a pair longer than that is alone."""
    held: list[int] = []
    for i in np.argsort(lengths, kind="stable"):
        if held and (len(held) + 1) * max(1, lengths[i]) > budget:
            yield np.array(held)
            held = []
        held.append(int(i))
    if held:
        yield np.array(held)


def _tried(score: Scorer, pairs: list[tuple[str, str]], halvings: int) -> list[tuple[float | None, str]]:
    """A score or a reason for every pair."""
    try:
        found = [float(x) for x in score(pairs)]
        if len(found) != len(pairs):
            raise ValueError("as many scores as pairs are needed")
        return [(x, "") if math.isfinite(x) else (None, "nonfinite-score") for x in found]
    except Exception as e:  # whatever a model may raise is a reason to keep the order
        if len(pairs) == 1 or not halvings:
            return [(None, type(e).__name__)] * len(pairs)
        half = len(pairs) // 2
        return _tried(score, pairs[:half], halvings - 1) + _tried(score, pairs[half:], halvings - 1)


def scored(rows: DataFrame, load: Callable[[], Scorer], tokens: int = TOKENS, query: str = "query", text: str = "text") -> DataFrame:
    """``rows`` with ``rerank`` and ``reason``; null texts and queries are empty."""
    bound_batches(rows.sparkSession)
    names = rows.columns
    at, schema = (names.index(query), names.index(text)), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, reason = None, ""
        for batch in batches:
            if score is None and not reason:
                try:
                    score = load()
                except Exception as e:
                    reason = f"load-{type(e).__name__}"
            n = batch.num_rows
            values, reasons = np.full(n, np.nan), np.full(n, reason, object)
            if score is not None:
                pairs = [(q or "", t or "") for q, t in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
                lengths = np.array([-(-(len(q) + len(t)) // CHARS) for q, t in pairs], np.int64)
                for places in batches_of(lengths, tokens):
                    for place, (value, why) in zip(places, _tried(score, [pairs[i] for i in places], HALVINGS), strict=True):
                        values[place], reasons[place] = np.nan if value is None else value, why
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, mask=np.isnan(values)), pa.array(reasons.tolist(), pa.string())], [*names, "rerank", "reason"])

    return rows.mapInArrow(run, f"{schema}, rerank double, reason string")


def rerank(rows: DataFrame, load: Callable[[], Scorer], tokens: int = TOKENS, query: str = "query", text: str = "text") -> DataFrame:
    """``rows (qid, rank, query, text, ...)`` with ``pos`` by falling score, of equals the earlier first; ``fallback`` is null where the model's order stands."""
    over = W.partitionBy("qid")
    told = scored(rows, load, tokens, query, text)
    reason = F.max(F.nullif("reason", F.lit(""))).over(over)
    told = told.withColumn("fallback", F.when(F.count("*").over(over) < 2, "too-few").otherwise(reason))
    key = F.when(F.col("fallback").isNull(), -F.col("rerank"))
    return told.withColumn("pos", (F.row_number().over(over.orderBy(key.asc_nulls_last(), "rank")) - 1).cast("long")).drop("reason")


class LinearModel:
    """A few shares of words as features, weighed; ``fit`` solves the ridge's normal equations, which one pass over the pairs sums up."""

    def __init__(self, weights: Sequence[float]):
        self.weights = np.asarray(weights, float)

    @staticmethod
    def features(pairs: list[tuple[str, str]]) -> np.ndarray:
        out = np.empty((len(pairs), 5))
        for i, (query, text) in enumerate(pairs):
            q, t = query.lower().split(), text.lower().split()
            own, held = set(q), set(t)
            both = set(zip(q, q[1:], strict=False))
            out[i] = 1.0, len(own & held) / max(1, len(own)), len(both & set(zip(t, t[1:], strict=False))) / max(1, len(both)), math.log1p(len(t)) / 10, len(own & held) / math.sqrt(max(1, len(held)) * max(1, len(own)))
        return out

    def __call__(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        return (self.features(pairs) * self.weights).sum(1)  # a matrix product's last digit depends on the batch

    @classmethod
    def fit(cls, judged: DataFrame, ridge: float = 1e-3) -> LinearModel:
        """Learn from ``judged (query, text, label)``."""
        bound_batches(judged.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((5, 6))
            for batch in batches:
                q, t, y = (c.to_pylist() for c in batch.columns)
                x = cls.features([(a or "", b or "") for a, b in zip(q, t, strict=True)]) if q else np.zeros((0, 5))
                sums += np.concatenate([x.T @ x, (x.T @ np.array(y, float))[:, None]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(sums.ravel())], ["i", "v"])

        parts = judged.select("query", "text", F.col("label").cast("double").alias("label")).mapInArrow(run, "i long, v double")
        sums = np.array([r["v"] for r in parts.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()]).reshape(5, 6) if parts.take(1) else np.zeros((5, 6))
        return cls(np.linalg.solve(sums[:, :5] + ridge * np.eye(5), sums[:, 5]))
