"""Document quality by a linear-chain conditional random field over lines.

Every line (cut at 0x0A) is good or bad. A line's features describe its bytes and words, and those of the lines before and after it; the chain's
weights join neighbouring labels. Forward-backward gives each line's probability of being good, and a document's score is their
mean weighted by line length (plus one byte).

Training: lines take the label of their document. It uses a bounded sample, the ``sample`` labelled documents of smallest hash that the caller's
condition allows; features are computed by Spark, the weights are fitted on the driver by full-batch Adam on the exact log-likelihood.

Null text is empty; an empty text is one empty line and gets a score too; rows of any length are scored whole; repeated rows score alike; an empty
table gives no rows. If no labelled row exists every score is 0.5. Columns named score or predicted are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytetext import Slice, slices
from .common import documents, restored

#: Training documents with more lines than this are left out of the sample.
MOST_LINES = 2000
RESULTS = ("score", "predicted")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True


def line_features(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, line lengths in bytes, documents' bounds in lines) for a slice; a text of k newlines has k + 1 lines."""
    data = s.data
    nl = np.flatnonzero(data == 10)
    # A line starts at each document's start and after each newline.
    start = np.sort(np.concatenate([s.off[:-1], nl + 1]), kind="stable")
    doc_of_nl = np.searchsorted(s.off, nl, side="right") - 1
    lines = np.bincount(doc_of_nl, minlength=s.n) + 1
    at = np.r_[0, np.cumsum(lines)]
    # Within a document starts ascend; an empty document's start equals its successor's, which keeps the order.
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:]
    end[-1] = len(data)
    last = at[1:] - 1
    end[last] = s.off[1:]
    inner = np.ones(len(start), bool)
    inner[last] = False
    end[inner] -= 1
    size = np.maximum(end - start, 0)

    def count(flags: np.ndarray) -> np.ndarray:
        c = np.r_[0, np.cumsum(flags)]
        return (c[np.maximum(end, start)] - c[start]).astype(float)

    h, w_start, w_end, _, _ = s.word_hashes(True, 1)
    line_of = np.searchsorted(start, w_start, side="right") - 1
    words = np.bincount(line_of, minlength=len(start)).astype(float)
    order = np.lexsort((h, line_of))
    new = np.r_[np.ones(min(1, len(h)), bool), (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])]
    distinct = np.bincount(line_of[order][new], minlength=len(start))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    same_as_last = np.bincount(line_of[again], minlength=len(start))
    tail = data[w_end - 1] if len(w_end) else data[:0]
    odd_tail = np.bincount(line_of[~_LETTER[tail] & ~_DIGIT[tail]], minlength=len(start))
    single = np.bincount(line_of[(w_end - w_start == 1)], minlength=len(start))
    symbol = ~_LETTER[data] & ~_DIGIT[data] & (data > 32)
    letters, n, w = np.maximum(count(_LETTER[data]), 1), np.maximum(size, 1), np.maximum(words, 1)
    x = np.stack(
        [
            np.log1p(size), np.log1p(words), np.minimum(size / w, 40) / 10, count(_UPPER[data]) / letters, count(_DIGIT[data]) / n, count(symbol) / n,
            count(symbol & ~_END[data]) / n, distinct / w, same_as_last / w, odd_tail / w, single / w, (words == 0).astype(float),
            np.minimum(1, distinct / np.maximum(1.0, words**0.8)), count(_LETTER[data]) / n,
        ],
        1,
    )
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    edge_first, edge_last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    edge_first[at[:-1]] = True
    edge_last[last] = True
    before[edge_first], after[edge_last] = 0, 0
    # Across a blank line the neighbours' difference says nothing; what differs from the neighbours is a feature by itself.
    full = np.concatenate([x, x**2, before, after, edge_first[:, None], edge_last[:, None]], 1)
    return full, size, at


def _products(a: np.ndarray, at: np.ndarray, backward: bool) -> np.ndarray:
    """Running products of 2x2 matrices within segments (from the front, or from the back), each scaled to a largest entry of 1."""
    out = a.copy()
    n = len(a)
    bound = np.repeat(at[1:] if backward else at[:-1], np.diff(at))
    step, longest = 1, int(np.diff(at).max(initial=0))
    while step < longest:
        i = np.arange(n - step) if backward else np.arange(step, n)
        i = i[(i + step < bound[i]) if backward else (i - step >= bound[i])]
        new = out[i] @ out[i + step] if backward else out[i - step] @ out[i]
        out[i] = new / new.max((1, 2), keepdims=True)
        step *= 2
    return out


def marginals(unary: np.ndarray, trans: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) per line, P(label pair) per line and its predecessor in the same document) by forward-backward.

    unary: log-odds of good; trans: 2x2 log-weights.
    """
    u = np.stack([np.exp(-np.maximum(unary, 0)), np.exp(np.minimum(unary, 0))], 1)
    t = np.exp(trans - trans.max())
    a = t[None] * u[:, None, :]
    first = at[:-1][np.diff(at) > 0]
    a[first] = u[first][:, None, :]
    a /= a.max((1, 2), keepdims=True)
    alpha = _products(a, at, False)[:, 0, :]
    rest = _products(a, at, True)
    beta = np.ones_like(u)
    has_next = np.ones(len(u), bool)
    has_next[at[1:][np.diff(at) > 0] - 1] = False
    k = np.flatnonzero(has_next)
    beta[k] = rest[k + 1].sum(2)
    node = alpha * beta
    node /= node.sum(1, keepdims=True)
    pair = np.zeros((len(u), 2, 2))
    p = alpha[k][:, :, None] * t[None] * (u[k + 1] * beta[k + 1])[:, None, :]
    pair[k + 1] = p / p.sum((1, 2), keepdims=True)
    return node[:, 1], pair


def fit(x: np.ndarray, at: np.ndarray, label: np.ndarray, steps: int = 300) -> dict[str, np.ndarray]:
    """Weights of the chain; label: 0 or 1 per document. Each document counts alike, whatever its number of lines."""
    mean, std = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / std, np.ones(len(x))]
    lines = np.diff(at)
    y = np.repeat(label, lines).astype(float)
    weight = np.repeat(1 / lines, lines) / len(lines)
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    has_last = np.ones(len(x), bool)
    has_last[at[:-1]] = False
    seen = np.zeros((len(x), 2, 2))
    k = np.flatnonzero(has_last)
    seen[k, y[k].astype(int), y[k].astype(int)] = 1
    state = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, trans)]
    for step in range(1, steps + 1):
        good, pair = marginals(z @ w, trans, at)
        grads = [z.T @ (weight * (good - y)) + 1e-4 * np.r_[w[:-1], 0], ((pair - seen) * weight[:, None, None]).sum(0) + 1e-4 * trans]
        for v, g, (m, s) in zip((w, trans), grads, state, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return {"mean": mean, "std": std, "w": w, "trans": trans}


def train(docs: DataFrame, labels: DataFrame, sample: int = 4096) -> dict[str, np.ndarray] | None:
    """Fits on the ``sample`` rows of ``labels`` (doc_id, quality) with the smallest hashes; None if there are none."""
    chosen = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = b.column("quality").to_numpy()
            for s in slices(b.column("text")):
                x, _, at = line_features(s)
                for i in range(s.n):
                    if at[i + 1] - at[i] <= MOST_LINES:
                        yield pa.RecordBatch.from_pydict({"label": pa.array([int(q[s.first + i])], pa.int32()), "x": pa.array([x[at[i] : at[i + 1]].astype("<f4").tobytes()], pa.binary())})

    # At most ``sample`` pairs of numbers are broadcast.
    rows = documents(docs).drop("rest", "row_key").join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(run, "label int, x binary")
    got = sorted((r["label"], bytes(r["x"])) for r in rows.limit(2 * sample).collect())
    if not got:
        return None
    width = line_features(Slice(np.zeros(0, np.uint8), np.zeros(2, np.int64), 0))[0].shape[1]
    parts = [np.frombuffer(x, "<f4").reshape(-1, width) for _, x in got]
    return fit(np.concatenate(parts).astype(float), np.r_[0, np.cumsum([len(p) for p in parts])], np.array([y > 0 for y, _ in got]).astype(int))


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5)."""
    rows = documents(docs, RESULTS)
    schema = StructType([rows.schema[c] for c in ("doc_id", "text", "rest")]).add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for s in slices(b.column("text")):
                if m is None:
                    p = np.full(s.n, 0.5)
                else:
                    x, size, at = line_features(s)
                    good, _ = marginals(np.c_[(x - m["mean"]) / m["std"], np.ones(len(x))] @ m["w"], m["trans"], at)
                    p = np.clip(np.add.reduceat(good * (size + 1), at[:-1]) / np.add.reduceat(size + 1, at[:-1]), 0, 1)
                cols = [b.column(c).slice(s.first, s.n) for c in ("doc_id", "text", "rest")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "text", "rest", "score", "predicted"])

    return restored(rows.select("doc_id", "text", "rest").mapInArrow(run, schema), docs)
