"""Mixing documents to target weights by soft membership of domains.

A softmax classifier over hashed byte pairs, fitted on a labelled table, gives every document a posterior
over the domains. Document rates ``r >= 0`` then minimise

    (a(r) - target)' M (a(r) - target) / 2,    a_k(r) = sum_d w_d r_d p_dk,

with ``w_d`` the document's share of all tokens and ``M`` the inverse of the domains' Gram matrix ``sum_d w_d p_d p_d'``, by
projected gradient from ``r = 1``. In that metric a step of one is right however rare a domain is; it is taken along the Gram
matrix of the documents whose rates are not zero, as far as that lessens the squares. Rates stay near one where they can, as
steps only ever go along the posteriors. A document's rate follows from its posterior and the history of steps, ``K`` numbers each,
so no state of the documents is kept between passes. If targets are out of reach, the rates of the least squares are returned, and a
warning tells the largest miss.

Defined results: a null or empty text has no tokens and no features, its posterior is the prior's; repeated
rows are documents of their own; labelled rows without text or domain are ignored; with no labelled rows
posteriors are even; a domain that no document reaches leaves its target unmet; columns other than those
named are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, by_place, large_text, map_texts, named, slices
from tarn.plans.scratch import cut

FEATURES = 2048
#: Share of the Gram matrix's mean that is added to its diagonal, and share of that matrix that is added to the active documents' one.
RIDGE, SHIFT = 1e-9, 1e-3
#: Squared norm of a projected gradient that has vanished.
VANISHED = 1e-16


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte-pair shares of each text (lower-cased in A-Z), and its white-space words."""
    lowered = pc.ascii_lower(texts)
    n = len(lowered)
    offsets = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + n + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    x = np.zeros((n, FEATURES), np.float32)
    words = np.zeros(n, np.int64)
    if len(data):
        pair = (data[:-1] * 31 + data[1:] * 257) % FEATURES
        within = doc[1:] == doc[:-1]
        for lo in range(0, n, 512):
            a, b = np.searchsorted(doc[:-1], [lo, lo + 512])
            keep = within[a:b]
            rows = min(512, n - lo)
            counts = np.bincount((doc[:-1][a:b][keep] - lo).astype(np.int64) * FEATURES + pair[a:b][keep], minlength=rows * FEATURES).reshape(rows, FEATURES)
            x[lo : lo + rows] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        begins = ~space
        begins[1:] &= space[:-1] | ~within
        words = np.bincount(doc[begins], minlength=n)
    return x, words


@dataclass
class Classifier:
    """Softmax regression; ``domains`` in the order of the columns."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(x) @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_classifier(labelled: DataFrame, domains: list[str], sample: int = 2000, text_col: str = "text", domain_col: str = "domain", rounds: int = 120) -> Classifier:
    """Fit on the ``sample`` rows of ``labelled`` whose hashed texts come first."""
    rows = labelled.select(named(text_col).alias("text"), named(domain_col).alias("domain")).where("text is not null").where(F.col("domain").isin(domains))
    rows = rows.orderBy(F.xxhash64("text"), "domain").limit(sample)

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, _ = features(large_text(batch.column(0)))
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["domain", "x"])

        return work

    got = map_texts(rows, "text", [F.col("domain")], "domain string, x binary", setup).orderBy("x", "domain").toArrow()
    k = len(domains)
    model = Classifier(list(domains), np.zeros((FEATURES, k)), np.zeros(k))
    if not got.num_rows:
        return model
    x = np.sqrt(np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES))
    y = np.eye(k, dtype=np.float32)[[domains.index(d) for d in got.column("domain").to_pylist()]]
    theta = np.zeros((FEATURES + 1, k), np.float32)
    speed, spread = np.zeros_like(theta), np.zeros_like(theta)
    x1 = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    for i in range(1, rounds + 1):
        z = x1 @ theta
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x1.T @ (p - y) / len(x) + 1e-4 * theta
        speed, spread = 0.9 * speed + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        theta -= 0.2 * (speed / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8)
    model.weights, model.bias = theta[:-1].astype(np.float64), theta[-1].astype(np.float64)
    return model


@dataclass
class Rates:
    """What determines every document's rate: the history of projected-gradient steps, each a vector over the domains."""

    gradients: list[np.ndarray]
    residual: float = np.inf

    def __call__(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents with posteriors ``p``."""
        return self.last(p)[0]

    def last(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates, and how far the last step moved them."""
        r, before = np.ones(len(p)), np.ones(len(p))
        for gradient in self.gradients:
            r, before = np.maximum(0, r - p @ gradient), r
        return r, before - r


def fit_rates(members: DataFrame, target: list[float], tolerance: float = 1e-4, rounds: int = 80) -> Rates:
    """Fit rates of at least zero for ``members (n_tokens, p array<double>)`` so that expected token shares match ``target``.

    A round is one pass that sums, at the rates so far, what documents add to the domains and the Gram matrix of those whose rates
    are not zero. The step is scaled by that matrix; while it does not lessen the squares it is quartered, at last the plain step is
    taken, which always does.
    It ends where every share is within ``tolerance``, or the projected gradient vanishes; then a warning tells the largest miss,
    which ``residual`` holds too.
    """
    k = len(target)
    target = np.asarray(target, float) / sum(target)
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return Rates([], 0.0)
    rates, n = Rates([]), k + k * k + 1

    def run(batches):
        out = np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                w, p = batch.column(0).to_numpy() / total, batch.column(1).flatten().to_numpy().reshape(-1, k)
                r, step = rates.last(p)
                out += np.concatenate([(w * r) @ p, ((p * (w * (r > 0))[:, None]).T @ p).ravel(), [w @ (step * step)]])
        yield pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(out)], ["i", "v"])

    metric = best = before = None
    length, least = 1.0, np.inf
    for _ in range(rounds + 1):
        found = members.select("n_tokens", "p").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        sums = np.array([x["v"] for x in found])
        miss, active = sums[:k] - target, sums[k:-1].reshape(k, k)
        if metric is None:
            gram = active + RIDGE * np.trace(active) / k * np.eye(k)  # all rates are one
            metric = np.linalg.inv(gram)
        squares, residual = float(miss @ metric @ miss), float(np.abs(miss).max())
        if squares < least or residual < tolerance:
            best, least = Rates(list(rates.gradients), residual), squares
        if residual < tolerance:
            break
        if before and length and squares >= before[1]:  # too far: a quarter of the step, or at last the plain one
            length = length / 4 if length > SHIFT else 0.0
            rates.gradients[-1] = length * before[2] if length else metric @ before[0]
            continue
        if rates.gradients and sums[-1] < VANISHED:
            break
        length = min(1.0, 2 * length) if length else 4 * SHIFT
        before = miss, squares, np.linalg.solve(active + SHIFT * gram, miss)
        rates.gradients.append(length * before[2])
    if best.residual >= tolerance:
        warnings.warn(f"token shares miss their targets by up to {best.residual:.3g}", stacklevel=2)
    return best


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, p)`` of every row, as a scratch table."""

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, words = features(large_text(batch.column(0)))
            p = model.posteriors(x)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(words), rows], ["doc_id", "n_tokens", "p"])

        return work

    key = docs.schema[id_col].dataType.simpleString()
    return cut(map_texts(docs, text_col, [named(id_col).alias("doc_id")], f"doc_id {key}, n_tokens long, p array<double>", setup), "members")


def with_rates(members: DataFrame, rates: Rates, k: int) -> DataFrame:
    """``members`` with each row's ``rate``."""
    names = members.columns

    def run(batches):
        for batch in batches:
            p = batch.column(names.index("p")).flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p))], [*names, "rate"])

    return members.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema) + ", rate double")


def draw(docs: DataFrame, model: Classifier, rates: Rates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as its rate says: its whole part, and once more by the hash of its id with
    the odds of the rest. Columns stay as they are."""
    text_at, odds_at = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_at):
                rate = rates(model.posteriors(features(large_text(part.column(text_at)))[0]))
                copies = np.floor(rate) + (part.column(odds_at).to_numpy() < rate - np.floor(rate))
                some = pa.array(copies > 0)
                rows = part.select(range(odds_at)).filter(some)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(copies.astype(np.int64)).filter(some)], [*rows.schema.names, "copies"])

    bound_batches(docs.sparkSession)
    rows = by_place(docs)
    odds = F.pmod(F.xxhash64(rows.columns[docs.columns.index(id_col)], F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    drawn = rows.withColumn("odds", odds).mapInArrow(run, f"{schema}, copies long")
    # copies are made in the JVM one by one: a batch here never grows with the rates
    return _copied(drawn).toDF(*docs.columns)


def _copied(drawn: DataFrame) -> DataFrame:
    """Every row as often as its last column says, in runs of 2^16 copies."""
    run = 1 << 16
    full = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / run))).alias("run")
    parts = drawn.select("*", full).withColumn("here", F.least(F.lit(run), F.col("copies") - F.col("run") * run))
    again = F.explode(F.array_repeat(F.lit(0), F.col("here").cast("int"))).alias("again")
    return parts.select("*", again).drop("copies", "run", "here", "again")
