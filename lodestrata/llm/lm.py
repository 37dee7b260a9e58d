"""A log-bilinear neural language model trained by noise-contrastive estimation, and a unigram base.

Tokens are words (A-Z as a-z) and one end per text. Counts of all training tokens are exact sums. The ``classes`` most frequent tokens are
the model's classes, with one more for all other words and one for what stands before a text. The representation predicted from the two
tokens before, R[w1] @ C1 + R[w2] @ C2, meets a token's output vector and bias in a dot product. Training: documents' classes (two bytes
a token) are dealt by hash to trainers of about POSITIONS tokens each, in an order by hash. Each runs minibatch AdaGrad against noise from the
unigram distribution, from a common start, and the weights are averaged by the tokens seen (partial sums in Spark). So the weights
depend on the rows alone, not on how they are partitioned, up to the order of sums. Scoring normalises exactly: as the context has two
tokens, batched matrix products give the log normaliser of every pair of classes once, on the driver, and texts look theirs up. A word outside
the classes gets its class's probability times its add-one share of that class's counts (unseen words are one event).

The learned part is kept only as far as it raises the exact likelihood of one in HELD training documents, which train no weights
(a factor of 0, 0.5 or 1). All positions of the other training documents train the weights.

Words among the HEAD most frequent are scored in place by a broadcast table of at most HEAD entries; all rarer ones are summed per document
and word and joined with the counts, so nothing that grows with the vocabulary is broadcast.

Null text is empty (one end token); a null doc_id counts as held in training; rows that share a doc_id are scored separately; repeated rows score
alike; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, slices
from .common import documents, materialise

CLASSES, HEAD = 1024, 200_000
DIM, NOISE, BATCH = 32, 96, 512
#: Positions that one trainer takes, and those that are shuffled among themselves (the most of one text that travel together).
POSITIONS, PIECE = 2_000_000, 1 << 17
#: One in HELD training documents, by hash, trains no weights (counts take it): the factor of the learned part is chosen on it.
HELD, FACTORS = 16, (0.0, 0.5, 1.0)
#: Word hashes are 64 bits; the end has one of its own.
END = np.uint64(0x0E0D0E0D0E0D0E0D)


def _tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with the end after each document, documents' bounds)."""
    h, _, _, _, at = s.word_hashes(True, 3)
    return np.insert(h, at[1:], END), at + np.arange(s.n + 1)


def count_tokens(rows: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text"), 8 << 20):
                h, c = np.unique(_tokens(s)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return rows.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Table:
    """The most frequent tokens: sorted hashes, counts, and class numbers (classes come first by count)."""

    def __init__(self, rows: list[tuple[int, int]], classes: int):
        h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        c = np.array([r[1] for r in rows], np.int64)
        rank = np.arange(len(h))
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.other = min(classes, len(h))
        self.cls = np.minimum(rank, self.other)[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of hashes."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def classes_of(self, h: np.ndarray) -> np.ndarray:
        at, hit = self.find(h)
        return np.where(hit, self.cls[at] if len(self.cls) else 0, self.other)


def _contexts(cls: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before each token; ``start`` before a text."""
    one, two = np.full_like(cls, start), np.full_like(cls, start)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    one[at[:-1]] = start
    two[at[:-1]] = start
    second = at[:-1] + 1
    two[second[second < at[1:]]] = start
    return one, two


def initial(freq: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights for ``len(freq)`` classes; freq: the classes' counts. The biases start as the unigram's logarithms."""
    rnd = np.random.default_rng(seed)
    k = len(freq)
    p = (freq + 0.5) / (freq + 0.5).sum()
    return {"r": rnd.normal(0, 0.1, (k + 1, DIM)).astype(np.float32), "q": rnd.normal(0, 0.1, (k, DIM)).astype(np.float32), "c": (np.stack([np.eye(DIM), np.eye(DIM)]) * 0.5).astype(np.float32), "b": np.log(p).astype(np.float32)}


def nce_epoch(m: dict[str, np.ndarray], hist: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, target: np.ndarray, noise_p: np.ndarray, rnd, rate: float = 0.1) -> None:
    """Minibatch AdaGrad on the contrast of targets with NOISE shared noise tokens a batch; changes m and hist."""
    log_kp = np.log(noise_p * NOISE).astype(np.float32)
    cum = np.cumsum(noise_p)
    for i in range(0, len(target), BATCH):
        a, b, w = one[i : i + BATCH], two[i : i + BATCH], target[i : i + BATCH]
        n = len(w)
        noise = np.minimum(np.searchsorted(cum, rnd.random(NOISE) * cum[-1]), len(noise_p) - 1)
        ra, rb = m["r"][a], m["r"][b]
        pred = ra @ m["c"][0] + rb @ m["c"][1]
        s_true = (pred * m["q"][w]).sum(1) + m["b"][w] - log_kp[w]
        s_noise = pred @ m["q"][noise].T + (m["b"][noise] - log_kp[noise])[None, :]
        g_true = (1 / (1 + np.exp(np.clip(s_true, -30, 30))) / n).astype(np.float32)
        g_noise = (-1 / (1 + np.exp(-np.clip(s_noise, -30, 30))) / n).astype(np.float32)
        g_pred = g_true[:, None] * m["q"][w] + g_noise @ m["q"][noise]
        grads = {k: np.zeros_like(v) for k, v in m.items()}
        np.add.at(grads["q"], w, g_true[:, None] * pred)
        np.add.at(grads["q"], noise, g_noise.T @ pred)
        np.add.at(grads["b"], w, g_true)
        np.add.at(grads["b"], noise, g_noise.sum(0))
        grads["c"][0], grads["c"][1] = ra.T @ g_pred, rb.T @ g_pred
        np.add.at(grads["r"], a, g_pred @ m["c"][0].T)
        np.add.at(grads["r"], b, g_pred @ m["c"][1].T)
        for k, g in grads.items():
            hist[k] += g * g
            m[k] += rate * g / np.sqrt(hist[k] + 1e-8)


def _flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in sorted(m)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def normalisers(m: dict[str, np.ndarray], factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores of a class by the token before, by the one before that, log normaliser of every pair of them); biases are in the first."""
    one = factor * (m["r"] @ m["c"][0]) @ m["q"].T + m["b"]
    two = factor * (m["r"] @ m["c"][1]) @ m["q"].T
    z = np.empty((len(one), len(two)), np.float32)
    e_two = np.exp(two - two.max(1, keepdims=True))
    top = two.max(1)
    for i in range(0, len(one), 256):
        x = one[i : i + 256]
        t = x.max(1, keepdims=True)
        # log sum exp(one + two) over classes, for a block of firsts and all seconds, as one matrix product.
        z[i : i + 256] = np.log(np.maximum(np.exp(x - t) @ e_two.T, 1e-38)) + t + top[None, :]
    return one.astype(np.float32), two.astype(np.float32), z


def train(rows: DataFrame, table: Table, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits the weights on ``rows`` and returns their normalisers."""
    spark = rows.sparkSession
    start = len(freq)
    noise_p = (freq + 0.5) / (freq + 0.5).sum()
    shared = spark.sparkContext.broadcast((table, noise_p))
    kind = np.uint16 if start < 1 << 16 else np.uint32

    def triples(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        t = shared.value[0]
        for s in slices(b.column("text"), 4 << 20):
            h, at = _tokens(s)
            cls = t.classes_of(h)
            one, two = _contexts(cls, at, start)
            yield one, two, cls

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value[0]
        for b in batches:
            for s in slices(b.column("text"), 4 << 20):
                h, at = _tokens(s)
                cls = t.classes_of(h)
                out, owner, no = [], [], []
                for j, (first, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    told = np.r_[start, start, cls[first:last]].astype(kind)
                    for i in range(0, last - first, PIECE):
                        out.append(told[i : i + PIECE + 2].tobytes())
                        owner.append(s.first + j)
                        no.append(i)
                cols = [b.column(k).take(pa.array(owner, pa.int64())) for k in ("doc_id", "row_key")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(no, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "row_key", "no", "x"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """The positions of successive pieces (two tokens before, one before, itself), PIECE of them or more at a time."""
        held, n = [], 0
        for b in batches:
            for x in b.column("x"):
                c = np.frombuffer(x.as_py(), kind).astype(np.int64)
                held.append((c[:-2], c[1:-1], c[2:]))
                n += len(c) - 2
                if n >= PIECE:
                    yield [np.concatenate(v) for v in zip(*held, strict=True)]
                    held, n = [], 0
        if held:
            yield [np.concatenate(v) for v in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[1]
        m = initial(freq)
        begin, hist = _flat(m), {k: np.full_like(v, 1e-6) for k, v in m.items()}
        seen = 0
        for two, one, cls in joined(batches):
            rnd = np.random.default_rng(seen)
            pick = rnd.permutation(len(cls))
            nce_epoch(m, hist, one[pick], two[pick], cls[pick], p, rnd)
            seen += len(pick)
        if seen:
            moved = (_flat(m) - begin).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(moved) + 1)), pa.array(np.r_[moved, seen])], names=["i", "x"])

    start_weights = initial(freq)
    held = F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(HELD)) == 0
    sums = np.zeros(len(_flat(start_weights)) + 1)
    # Trainers go by the corpus' tokens alone, and pieces go to them by hash (copies of a text apart), so the input's partitions don't matter.
    trainers = max(1, round(float(freq.sum()) / POSITIONS))
    pieces = rows.where(~held).select("doc_id", "row_key", "text").mapInArrow(code, "doc_id long, row_key int, no long, x binary").select(F.xxhash64("doc_id", "row_key", "no").alias("k"), "x")
    dealt = pieces.repartition(trainers, "k").sortWithinPartitions("k")
    # As many numbers as there are weights, whatever the corpus.
    moved = dealt.select("x").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    sums[moved.column("i").to_numpy()] = moved.column("x").to_numpy()
    if not sums[-1]:
        return normalisers(start_weights, 0.0)
    m = _shaped(_flat(start_weights) + sums[:-1] / sums[-1], start_weights)

    choices = [normalisers(m, factor) for factor in FACTORS]
    tables = spark.sparkContext.broadcast(choices)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.zeros(len(FACTORS))
        for b in batches:
            for a, c, w in triples(b):
                gain += [float((one[a, w].astype(float) + two[c, w] - z[a, c]).sum()) for one, two, z in tables.value]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(FACTORS))), pa.array(gain)], names=["k", "gain"])

    gains = {r["k"]: r["gain"] for r in rows.where(held).select("text").mapInArrow(likelihoods, "k long, gain double").groupBy("k").agg(F.sum("gain").alias("gain")).collect()}
    return choices[max(range(len(FACTORS)), key=lambda k: (gains.get(k, 0.0), -k))]


def score(docs: DataFrame, held_out: Column, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held_out: a condition on doc_id (null: false)."""
    spark = docs.sparkSession
    rows = documents(docs).drop("rest").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    training = rows.where(~F.col("held_out"))
    counts = materialise(count_tokens(training), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    # At most HEAD rows come to the driver.
    table = Table([(r["h"], r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(HEAD).collect()], classes)
    in_class = int(table.c[table.cls < table.other].sum())
    by_class = np.zeros(table.other + 1)
    np.add.at(by_class, table.cls[table.cls < table.other], table.c[table.cls < table.other])
    by_class[-1] = n - in_class
    rest_log = float(np.log10(max(1, n - in_class + v - table.other + 1)))
    one, two, z = train(training, table, by_class)
    shared = spark.sparkContext.broadcast((table, one, two, z))
    start, all_log = len(by_class), float(np.log10(n + v + 1))
    in_place = "doc_id long, row_key int, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<h:long,tf:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s1, s2, zz = shared.value
        log_c = np.log10(t.c + 1.0)
        for b in batches:
            for s in slices(b.column("text")):
                h, at = _tokens(s)
                place, hit = t.find(h)
                cls = np.where(hit, t.cls[place] if len(t.cls) else 0, t.other)
                a, c = _contexts(cls, at, start)
                model = (s1[a, cls].astype(float) + s2[c, cls] - zz[a, c]) / np.log(10)
                known = np.where(hit, log_c[place] if len(log_c) else 0, 0.0)
                other = cls == t.other
                base = known - all_log
                model += np.where(other, known - rest_log, 0)
                sums = [np.add.reduceat(x, at[:-1]) for x in (hit.astype(np.int64), base, model)]
                # The rarer tokens of each document, counted.
                doc = np.repeat(np.arange(s.n), np.diff(at))[~hit]
                rare = h[~hit]
                order = np.lexsort((rare, doc))
                rare, doc = rare[order], doc[order]
                new = np.flatnonzero(np.r_[np.ones(min(1, len(rare)), bool), (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1])])
                tf = np.diff(np.r_[new, len(rare)])
                ends = np.searchsorted(doc[new], np.arange(s.n + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(rare[new].view(np.int64)), pa.array(tf)], names=["h", "tf"]))
                cols = [b.column(k).slice(s.first, s.n) for k in ("doc_id", "row_key", "held_out")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(at)), *map(pa.array, sums), tail], names=["doc_id", "row_key", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    scored = materialise(rows.select("doc_id", "row_key", "held_out", "text").mapInArrow(run, in_place), "scored")
    # The rows of one document's tail are joined by its place in the written table, which no two rows share.
    keyed = scored.withColumn("row", F.xxhash64("doc_id", "row_key", "n_tokens", "base"))
    tail = keyed.select("row", F.explode("tail").alias("t")).select("row", F.col("t")["h"].alias("h"), F.col("t")["tf"].alias("tf"))
    log_sum = F.col("tf") * F.log10(F.col("c") + 1)
    copies = keyed.groupBy("row").agg(F.count("*").alias("copies"))
    met = tail.join(counts, "h").groupBy("row").agg(F.sum("tf").alias("known"), F.sum(log_sum).alias("logs"))
    met = met.join(copies, "row").select("row", (F.col("known") / F.col("copies")).cast("long").alias("known"), (F.col("logs") / F.col("copies")).alias("logs"))
    out = keyed.drop("tail").join(met, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    # Each rarer token takes the class of all other words, whose share was counted for unseen ones (log10(1) = 0) above.
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
