"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad. A line's potential comes from its own features and those of the lines before
and after it; neighbouring labels share a transition table. Forward-backward marginals, weighted by
the length of their lines, make up a document's score. Forward and backward messages are prefix and suffix
products of 2 x 2 matrices, taken by doubling over all lines of a batch at once: the matrix of a first
line has equal rows, which forgets whatever came before it, so documents need no separate loops and a text
of very many lines costs hardly more a line than a short one.

In training the labels of lines are latent. Only documents are labelled, and the fit maximises the likelihood of
their labels under the scores, so a document of mixed lines gets mixed marginals. It learns from ``sample`` labelled
documents, with all their lines. The model is a few dozen weights.

Defined results: a null or empty text is one empty line and gets a score like any other; repeated rows
are scored each; rows of labels without id or label are ignored; without labelled rows all scores are 0.5;
columns other than id and text are not read, whatever their names; very long texts are scored whole; an empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, by_place, large_text, map_texts, named, slices

#: Byte classes whose shares are features of a line.
CLASSES = [
    lambda b: (b >= 65) & (b <= 90),
    lambda b: (b >= 97) & (b <= 122),
    lambda b: (b >= 48) & (b <= 57),
    lambda b: np.isin(b, np.frombuffer(b".,;:?'\"-()", np.uint8)),
    lambda b: b == ord("!"),
    lambda b: b == ord("|"),
    lambda b: np.isin(b, np.frombuffer(b"*#$%&@~^_=+<>[]{}\\/`", np.uint8)),
    lambda b: b >= 128,
]
TABLES = [f(np.arange(256, dtype=np.uint8)).astype(np.uint8) for f in CLASSES]
OWN = len(CLASSES) + 6
WIDTH = 3 * OWN + 3
#: Lines that are worked on at a time in scoring.
BLOCK = 1 << 16
#: Potentials beyond this are cut off, so that products of matrices stay finite.
BOUND = 30.0


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines, and where each text's lines begin."""
    split = pc.split_pattern(texts, "\n")
    begins = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))].astype(np.int64)
    return split.flatten().combine_chunks() if isinstance(split, pa.ChunkedArray) else split.flatten(), begins


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, each line's length in characters, and where each text's lines begin."""
    lines, begins = _split(texts)
    own, chars = _own_features(lines)
    return _with_neighbours(own, 0, len(own), begins), chars, begins


def _own_features(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of lines by themselves, and their lengths in characters."""
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    own = np.zeros((n, OWN))
    at = offsets[:-1] - offsets[0]
    some = np.flatnonzero(size)
    if len(some):
        for i, table in enumerate(TABLES):
            own[some, i] = np.add.reduceat(table[data], at[some], dtype=np.int64) / size[some]
    words = pc.ascii_split_whitespace(lines)
    tokens = words.flatten()
    line = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    codes = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.bincount(line, minlength=n).astype(np.float64)
    same = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    distinct = np.bincount(np.unique(line * (len(codes) + 1) + codes) // (len(codes) + 1), minlength=n) if len(codes) else np.zeros(n)
    chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    k = len(CLASSES)
    full = np.maximum(count, 1)
    own[:, k] = np.bincount(line[1:][same], minlength=n) / full
    own[:, k + 1] = 1 - distinct / full
    own[:, k + 2] = np.log1p(chars) / 5
    own[:, k + 3] = np.log1p(count) / 5
    own[:, k + 4] = np.minimum(chars / full, 40) / 10
    own[:, k + 5] = size == 0
    return own, chars


def _with_neighbours(own: np.ndarray, lo: int, n: int, begins: np.ndarray) -> np.ndarray:
    """Features of lines ``lo`` to ``lo + len(own)`` of ``n`` beside those of their neighbours, which are zero beyond a text."""
    x = np.zeros((len(own), WIDTH))
    x[:, :OWN] = own
    marks = np.zeros((2, len(own)), bool)
    for mark, at in zip(marks, (begins[:-1], begins[1:] - 1), strict=True):
        mark[at[(at >= lo) & (at < lo + len(own))] - lo] = True
    first, last = marks
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[first, OWN : 2 * OWN] = 0
    x[last, 2 * OWN : 3 * OWN] = 0
    x[:, -3], x[:, -2], x[:, -1] = first, last, 1
    return x


def _products(m: np.ndarray, suffix: bool, longest: int) -> np.ndarray:
    """Products of each of the 2 x 2 matrices ``m[:, i, j]`` and ``longest`` or more before (after) it, scaled to a largest entry of one."""
    p, step = m.copy(), 1
    while step < min(len(p), longest):
        left, right = p[:-step], p[step:]
        new = np.empty_like(left)
        for i in (0, 1):
            for j in (0, 1):
                new[:, i, j] = left[:, i, 0] * right[:, 0, j] + left[:, i, 1] * right[:, 1, j]
        new /= new.max((1, 2), keepdims=True)
        p = np.concatenate([new, p[-step:]] if suffix else [p[:step], new])
        step *= 2
    return p


def _matrices(u: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each line does to the messages of bad and good, scaled to a largest entry of one."""
    u = np.clip(u, -BOUND, BOUND)
    node = np.stack([np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))], 1)  # of bad and good, at most one
    m = np.exp(trans)[None] * node[:, None, :]
    m[first] = node[first][:, None, :]
    return m / m.max((1, 2), keepdims=True)


def _ends(begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[begins[:-1]], last[begins[1:] - 1] = True, True
    return first, last


def marginals(u: np.ndarray, trans: np.ndarray, begins: np.ndarray):
    """P(good) of each line, and of each inner line the joint table with the label before it."""
    first, last = _ends(begins, len(u))
    m = _matrices(u, trans, first)
    longest = int(np.diff(begins).max(initial=1))
    ahead = _products(m, False, longest)[:, 0, :]
    after = np.ones((len(u), 2))
    after[:-1] = _products(m, True, longest)[1:].sum(2)
    after[last] = 1
    both = ahead * after
    good = both[:, 1] / both.sum(1)
    joint = np.zeros((len(u), 2, 2))
    joint[1:] = ahead[:-1, :, None] * m[1:] * after[1:, None, :]
    joint[first] = 0
    total = joint.sum((1, 2), keepdims=True)
    joint = np.divide(joint, total, out=joint, where=total > 0)
    return good, joint


def goodness(u: np.ndarray, trans: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """P(good) of each line, block by block: messages are carried from block to block, so a text may have any number of lines."""
    n = len(u)
    first, last = _ends(begins, n)
    longest = int(np.diff(begins).max(initial=1))
    ahead, out, carried = np.empty((n, 2)), np.empty(n), np.ones(2)
    blocks = [(lo, min(n, lo + BLOCK)) for lo in range(0, n, BLOCK)]
    for lo, hi in blocks:
        p = _products(_matrices(u[lo:hi], trans, first[lo:hi]), False, longest)
        ahead[lo:hi] = carried @ p
        ahead[lo:hi] /= ahead[lo:hi].max(1, keepdims=True)
        carried = ahead[hi - 1]
    carried = np.ones(2)
    for lo, hi in reversed(blocks):
        m = _matrices(u[lo:hi], trans, first[lo:hi])
        after = np.empty((hi - lo, 2))
        p = _products(m, True, longest)
        after[-1], after[:-1] = carried, (p[1:] @ carried)
        carried = p[0] @ carried
        carried /= carried.max()
        after[last[lo:hi]] = 1
        both = ahead[lo:hi] * after
        out[lo:hi] = both[:, 1] / both.sum(1)
    return out


class Model:
    """Weights of the field."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.trans, self.mean, self.scale = weights, trans, mean, scale

    def score(self, texts: pa.Array) -> np.ndarray:
        """Length-weighted mean of P(good) over each text's lines; a line weighs its characters and its end."""
        lines, begins = _split(texts)
        n = len(lines)
        u, chars = np.empty(n), np.empty(n, np.int64)
        for lo in range(0, n, BLOCK):
            start, stop = max(0, lo - 1), min(n, lo + BLOCK + 1)  # with a line of either side
            hi = min(n, lo + BLOCK)
            own, long = _own_features(lines.slice(start, stop - start))
            x = _with_neighbours(own, start, n, begins)[lo - start : hi - start]
            u[lo:hi], chars[lo:hi] = (x - self.mean) / self.scale @ self.weights, long[lo - start : hi - start]
        weight = chars + 1.0
        return np.add.reduceat(goodness(u, self.trans, begins) * weight, begins[:-1]) / np.add.reduceat(weight, begins[:-1])


#: Documents of so many lines or fewer are worked on together in training.
CLASSES_OF_LENGTH = (4, 16, 64, 256, 1024, 1 << 62)
TILT = 1e-3


def likelihood(theta: np.ndarray, z: np.ndarray, weight: np.ndarray, begins: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of documents' labels, and its gradient.

    A score is the mean of its lines' labels by ``weight``; how it changes with a weight of the field is the covariance of the two.
    Potentials tilted along ``weight`` either way give the covariances with all of them at once.
    """
    u, trans = z @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
    (up, up_pairs), (down, down_pairs) = (marginals(u + tilt * weight, trans, begins) for tilt in (TILT, -TILT))
    score = np.clip(np.add.reduceat((up + down) / 2 * weight, begins[:-1]), 1e-9, 1 - 1e-9)
    slope = np.repeat((label - score) / (score * (1 - score)), np.diff(begins)) / (2 * TILT)
    grad = np.r_[z.T @ (slope * (up - down)), np.tensordot(slope, up_pairs - down_pairs, 1).ravel()]
    return float((label * np.log(score) + (1 - label) * np.log(1 - score)).sum()), grad


def fit(x: np.ndarray, chars: np.ndarray, begins: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 0.3) -> Model:
    """Maximise the penalised likelihood of the documents' labels by Adam on the whole sample."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    mean[-1], scale[scale < 1e-9] = 0, 1
    z, sizes = (x - mean) / scale, np.diff(begins)
    weight = (chars + 1.0) / np.repeat(np.add.reduceat(chars + 1.0, begins[:-1]), sizes) if len(x) else chars
    parts, least = [], 0
    for most in CLASSES_OF_LENGTH:  # long documents need more doublings
        own = (sizes > least) & (sizes <= most)
        if own.any():
            rows = np.repeat(own, sizes)
            parts.append((z[rows], weight[rows], np.r_[0, np.cumsum(sizes[own])], label[own]))
        least = most
    theta, n = np.zeros(WIDTH + 4), max(1, len(label))
    speed, spread = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1 if len(x) else 1):
        grad = (sum(likelihood(theta, *part)[1] for part in parts) - ridge * theta) / n
        speed = 0.9 * speed + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        theta += 0.1 * (speed / (1 - 0.9**i)) / (np.sqrt(spread / (1 - 0.99**i)) + 1e-8)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), mean, scale)


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, lines: int = 300_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on the ``sample`` labelled rows whose hashed ids come first, as far as they hold ``lines`` lines together.

    Both bounds are of the labelled rows that are learned from, and so of what the driver holds (some 200 bytes a line); a document whose
    lines no longer fit is passed over. Of several rows of an id the one with the least features is learned from, and the greater label.
    """
    chosen = labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("label"))
    chosen = chosen.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    own = own.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    n_lines = F.lit(1) + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    sizes = own.groupBy("doc_id").agg(F.max(F.coalesce(n_lines, F.lit(1))).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    left, fitting = lines, []
    for r in sizes:  # at most ``sample`` rows
        if r["n"] <= left:
            left -= r["n"]
            fitting.append((r["doc_id"],))
    fits = docs.sparkSession.createDataFrame(fitting, "doc_id long")
    rows = own.join(F.broadcast(fits), "doc_id")

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, chars, begins = line_features(large_text(batch.column(0)))
            lines = np.concatenate([x, chars[:, None]], 1).astype(np.float32)
            out = [lines[lo:hi].tobytes() for lo, hi in zip(begins, begins[1:])]
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "label", "x"])

        return work

    got = map_texts(rows, "text", [F.col("doc_id"), F.col("label")], "doc_id long, label int, x binary", setup)
    found = got.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "x").alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow()
    parts = [np.frombuffer(b, np.float32).reshape(-1, WIDTH + 1) for b in found.column("x").to_pylist()]
    lines = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, WIDTH + 1))
    label = np.clip(found.column("label").to_numpy(), 0, 1).astype(np.float64)
    return fit(lines[:, :-1], lines[:, -1], np.cumsum([0, *map(len, parts)]), label)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""

    def setup():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.score(large_text(batch.column(0))))], ["doc_id", "score"])

        return work

    return map_texts(docs, text_col, [named(id_col).cast("long").alias("doc_id")], "doc_id long, score double", setup)


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, as they are."""
    text_at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_at):
                good = model.score(large_text(part.column(text_at))) >= least
                yield part.filter(pa.array(good))

    bound_batches(docs.sparkSession)
    rows = by_place(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def predicted(score: Column, least: float = 0.3) -> Column:
    return (score >= least).cast("int")
