"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

Terms are runs of letters, digits and bytes over 127, A-Z in lower case, so that symbols stuck to a word don't hide it, and the runs' beginnings of
three to eight characters (written ``begin*``). Vectors live in a vocabulary chosen from the labelled examples: of the candidates, the terms with the largest
likelihood-ratio statistic, one after another is taken whose presence raises the chance most over what those before explain (score tests of a growing
logistic fit), which brings in one term of a group of copies, not all their words. A text's other words say nothing about the label, and in a long
text they would drown the few that do. Document frequencies are counted over all documents.

The examples' postings are cut into blocks with the largest weight of each term and block. A search adds up a query's bounds by block, scores
blocks from the highest bound down, and stops when no bound reaches the k-th similarity; examples as similar as the k-th all vote, so that neither
order nor doc_id decides. Votes weigh 1 / (0.1 + distance); leave-one-out votes of the examples, made monotone (pooled adjacent violators), turn a share of votes into a probability. Texts
without a chosen term get the share of toxic ones among such examples.

Bounds: the ``sample`` labelled doc_ids of smallest hash, ``candidates`` terms and ``vocabulary`` of them; they don't grow with the corpus, so the index
fits one broadcast. Null text is empty; empty texts get a score too; texts of any length are read whole; rows that share a doc_id and a text count as
one example, and every row is scored; without labelled rows every score is 0.5, and an empty table gives no rows. Columns named score, predicted,
evidence or terms are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytetext import LOWER, Slice, byte_table, mix, prefix_hash, slices, span_hash
from .common import documents, materialise, restored

RESULTS = ("score", "predicted", "evidence", "terms")
ADDED = "score double, predicted int, evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>, terms array<string>"
#: A term is chosen while its score statistic is at least this (one chance in a thousand).
LEAST = 10.8
#: Share of its Newton step that a chosen term moves: small, so that words which often come together can all be chosen.
RATE = 0.1
#: Characters of the beginnings that are terms.
BEGINS = (3, 4, 5, 6, 7, 8)
#: Texts with equal vectors are searched once as long as a task remembers no more of them.
REMEMBERED = 1 << 16

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_runs(s: Slice, begins: tuple[int, ...] = BEGINS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, document, characters or 0) of the terms of a slice: whole runs (0), and beginnings of longer ones."""
    inside, edge = _TERM[s.data], np.zeros(len(s.data) + 1, bool)
    edge[s.off] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    p, char = prefix_hash(byte_table(1, True)[s.data]), np.flatnonzero((s.data & 0xC0) != 0x80)
    first, size = np.searchsorted(char, start), np.searchsorted(char, end) - np.searchsorted(char, start)
    parts = [(start, end, np.zeros(len(start), np.int64))]
    for n in begins:
        longer = np.flatnonzero(size > n)
        parts.append((start[longer], char[first[longer] + n], np.full(len(longer), n)))
    lo, hi, kind = (np.concatenate([x[i] for x in parts]) for i in range(3))
    h = span_hash(p, lo, hi)
    return np.where(kind > 0, mix(h + np.uint64(1)), h), lo, hi, np.searchsorted(s.off, lo, side="right") - 1, kind


def choose(doc: np.ndarray, term: np.ndarray, toxic: np.ndarray, most: int) -> list[int]:
    """Up to ``most`` terms from (doc, term) rows: again and again that of the largest score statistic joins a logistic fit, which moves by its Newton step."""
    chosen: dict[int, None] = {}
    base = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    logit = np.full(len(toxic), np.log(base / (1 - base)))
    for _ in range(16 * most if len(term) else 0):
        p = 1 / (1 + np.exp(-logit))
        slope, curve = np.bincount(term, (toxic - p)[doc]), np.bincount(term, (p * (1 - p))[doc])
        stat = np.where(slope > 0, slope**2 / (curve + 0.1), 0)
        best = int(stat.argmax())
        if stat[best] < LEAST or (best not in chosen and len(chosen) == most):
            break
        chosen[best] = None
        logit[doc[term == best]] += RATE * np.clip(slope[best] / (curve[best] + 0.1), -3, 3)
    return list(chosen)


class BlockMax:
    """An inverted index of unit vectors, its postings in blocks of ``size`` examples with the largest weight of every term in a block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int = 64):
        # Examples with the same heaviest term stand together, which makes the bounds of most blocks small.
        lead = [(int(t[w.argmax()]), -float(w.max())) for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (lead[i], i)), np.int64)
        self.size, self.blocks = size, -(-len(vectors) // size)
        doc = np.concatenate([np.full(len(vectors[i][0]), p) for p, i in enumerate(self.order)] or [np.zeros(0, int)])
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, int)])
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        self.lists: dict[int, tuple[np.ndarray, ...]] = {}
        for t in np.unique(term):
            at = np.flatnonzero(term == t)
            block, first = np.unique(doc[at] // size, return_index=True)
            self.lists[int(t)] = doc[at], weight[at], block, np.maximum.reduceat(weight[at], first), np.r_[first, len(at)]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities), most similar first: the k most similar ones, and all as similar as the last; ``leave`` is left out."""
        bound = np.zeros(self.blocks)
        lists = [(q, self.lists[int(t)]) for t, q in zip(terms, weights, strict=True) if int(t) in self.lists]
        for q, (_, _, block, most, _) in lists:
            bound[block] += q * most
        docs, sims, enough = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < enough - 1e-9:
                break
            s = np.zeros(self.size)
            for q, (doc, weight, block, _, first) in lists:
                i = int(np.searchsorted(block, b))
                if i < len(block) and block[i] == b:
                    part = slice(first[i], first[i + 1])
                    s[doc[part] - b * self.size] += q * weight[part]
            hit = np.flatnonzero(s > 0)
            d = self.order[hit + b * self.size]
            docs, sims = np.r_[docs, d[d != leave]], np.r_[sims, s[hit][d != leave]]
            if len(sims) >= k:
                enough = float(np.partition(sims, len(sims) - k)[len(sims) - k])
                keep = sims >= enough - 1e-9
                docs, sims = docs[keep], sims[keep]
        rank = np.lexsort((docs, -np.round(sims, 9)))
        return docs[rank], sims[rank]


@dataclass
class Model:
    names: list[str]
    hashes: np.ndarray  # sorted, of the vocabulary
    idf: np.ndarray
    index: BlockMax
    ids: np.ndarray
    toxic: np.ndarray
    base: float
    without: float  # probability of a text without a chosen term
    shares: np.ndarray
    chances: np.ndarray
    k: int

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def vote(self, found: np.ndarray, sims: np.ndarray) -> float:
        w = 1 / (0.1 + np.maximum(0, 1 - np.round(sims, 9)))
        return float(((w * self.toxic[found]).sum() + self.base) / (w.sum() + 1))

    def chance(self, share: float) -> float:
        return float(np.clip(np.interp(share, self.shares, self.chances), 0, 1)) if len(self.shares) else share


def monotone(x: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ascending ``x`` with non-decreasing means of ``y``, each pool drawn to ``base`` by one example."""
    pools: list[list[float]] = []
    at, inverse, n_at = np.unique(x, return_inverse=True, return_counts=True)
    for v, s, n in zip(at, np.bincount(inverse, y, len(at)), n_at, strict=True):
        pools.append([v, v, float(s), float(n)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            lo, _, s0, n0 = pools.pop(-2)
            pools[-1] = [lo, pools[-1][1], s0 + pools[-1][2], n0 + pools[-1][3]]
    chance = np.maximum.accumulate([(s + base) / (n + 1) for _, _, s, n in pools]) if pools else np.zeros(0)
    return np.array([v for p in pools for v in p[:2]]), np.repeat(chance, 2)


def examples(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, row_key, toxic, text) of the labelled examples, written."""
    one = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return materialise(documents(docs).drop("rest").join(F.broadcast(one), "doc_id").dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", "toxic", "text"), "examples")


def example_terms(rows: DataFrame) -> DataFrame:
    """(doc_id, row_key, toxic, term): the distinct terms of each example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                h, start, end, doc, kind = term_runs(s)
                order = np.lexsort((h, doc))
                at = order[np.r_[np.ones(min(1, len(h)), bool), (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]]
                low = LOWER[s.data]
                words = [low[i:j].tobytes().decode("utf-8", "replace") + "*" * min(n, 1) for i, j, n in zip(start[at], end[at], kind[at].tolist(), strict=True)]
                cols = [b.column(c).take(pa.array(s.first + doc[at])) for c in ("doc_id", "row_key", "toxic")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.string())], names=["doc_id", "row_key", "toxic", "term"])

    return rows.mapInArrow(run, "doc_id long, row_key int, toxic boolean, term string")


def encoded(rows: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, row_key, toxic, term, tf): one row an example, its terms' places in ``names`` and their frequencies as arrays."""
    hashes, order = _hashes(names)
    begins = begins_in(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                doc, place, tf = found_terms(s, hashes, begins)
                off = pa.array(np.searchsorted(doc, np.arange(s.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(v.astype(np.int32))) for v in (order[place] if len(order) else place, tf)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s.first, s.n) for c in ("doc_id", "row_key", "toxic")), *lists], names=["doc_id", "row_key", "toxic", "term", "tf"])

    return rows.mapInArrow(run, "doc_id long, row_key int, toxic boolean, term array<int>, tf array<int>")


def counts(docs: DataFrame, names: list[str]) -> tuple[int, np.ndarray]:
    """(all documents, those with each of ``names``), over the whole table; one small row a batch and name."""
    hashes, order = _hashes(names)
    begins = begins_in(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(names) + 1, np.int64), 0
        for b in batches:
            for s in slices(b.column("text")):
                _, term, _ = found_terms(s, hashes, begins)
                df[:-1] += np.bincount(order[term], minlength=len(names))
            n += b.num_rows
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["i", "df"])

    got = {r["i"]: r["df"] for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).collect()}
    return got.get(len(names), 0), np.array([got.get(i, 0) for i in range(len(names))], float)


def _hashes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, positions in ``names``)."""
    whole = [np.frombuffer(n.removesuffix("*").encode(), np.uint8) for n in names]
    h = np.array([int(span_hash(prefix_hash(byte_table(1, True)[w]), np.array([0]), np.array([len(w)]))[0]) for w in whole], np.uint64)
    h = np.where([n.endswith("*") for n in names], mix(h + np.uint64(1)), h) if names else h
    order = np.argsort(h)
    return h[order], order


def begins_in(names: list[str]) -> tuple[int, ...]:
    return tuple(sorted({len(n) - 1 for n in names if n.endswith("*")}))


def found_terms(s: Slice, hashes: np.ndarray, begins: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in ``hashes``, frequency) of the vocabulary's terms in each document of a slice, in this order."""
    if not len(hashes) or not len(s.data):
        return (np.zeros(0, np.int64),) * 3
    h, _, _, doc, _ = term_runs(s, begins)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[at] == h
    key, tf = np.unique(doc[hit] * len(hashes) + at[hit], return_counts=True)
    return key // len(hashes), key % len(hashes), tf


def train(docs: DataFrame, labels: DataFrame, sample: int = 8192, candidates: int = 2048, vocabulary: int = 256, k: int = 15) -> Model | None:
    """The index and its calibration from ``labels`` (doc_id, toxic); None without labelled examples. Runs jobs: writes the examples, counts."""
    rows = examples(docs, labels, sample)
    size = rows.agg(F.count("*").alias("n"), F.count_if("toxic").alias("pos")).first()
    if not size["n"]:
        return None
    x = lambda seen, row, col: F.when(seen > 0, 2 * seen * F.log(seen * F.lit(float(size["n"])) / (row * F.lit(float(col))))).otherwise(0.0)
    n, a, pos, total = F.col("n"), F.col("a"), size["pos"], size["n"]
    stat = x(a, n, max(pos, 1)) + x(n - a, n, max(total - pos, 1)) + x(pos - a, total - n, max(pos, 1)) + x(total - pos - n + a, total - n, max(total - pos, 1))
    same = F.sum(F.xxhash64("doc_id", "row_key").cast("decimal(38,0)")).alias("same")
    by_term = example_terms(rows).groupBy("term").agg(F.count("*").alias("n"), F.count_if("toxic").alias("a"), same)
    # Of terms that the same examples hold (the beginnings of a rare word) the shortest stands for all.
    by_term = by_term.groupBy("n", "a", "same").agg(F.min(F.struct(F.length("term"), "term")).getField("term").alias("term"))
    best = by_term.select("term", stat.alias("g2")).orderBy(F.desc("g2"), "term").limit(candidates)
    names = [r["term"] for r in best.collect()]
    # Examples and candidates are both bounded: an array of places for each example.
    got = encoded(rows, names).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("row_key", "ascending")])
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy()
    doc = np.repeat(np.arange(len(got)), pc.list_value_length(got["term"]).to_numpy())
    term, tf = (pc.list_flatten(got[c]).to_numpy().astype(kind) for c, kind in (("term", np.int64), ("tf", float)))
    chosen = choose(doc, term, toxic.astype(float), vocabulary)
    own = [names[i] for i in chosen]
    hashes, order = _hashes(own)
    everything, df = counts(docs, own)
    idf = np.log((1 + everything) / (1 + df[order])) + 1
    base = float(toxic.mean())
    model = Model([own[j] for j in order], hashes, idf, BlockMax([]), np.zeros(0, np.int64), np.zeros(0), base, base, np.zeros(0), np.zeros(0), k)
    place = np.full(len(names) + 1, -1)
    place[[chosen[j] for j in order]] = np.arange(len(order))
    mine = place[term] >= 0
    doc, term, tf = doc[mine], place[term[mine]], tf[mine]
    kept, first = np.unique(doc, return_index=True)
    # Terms in ascending order, as in a search, so that equal vectors are equal to the last digit.
    vectors = [model.vector(term[i:j][o := np.argsort(term[i:j])], tf[i:j][o]) for i, j in zip(first, np.r_[first[1:], len(doc)][: len(first)], strict=True)]
    rest = np.setdiff1d(np.arange(len(toxic)), kept)
    model.without = float((toxic[rest].sum() + base) / (len(rest) + 1))
    model.index, model.ids, model.toxic = BlockMax(vectors), ids[kept], toxic[kept].astype(float)
    shares = np.array([model.vote(*model.index.search(*v, k, leave=i)) for i, v in enumerate(vectors)])
    model.shares, model.chances = monotone(shares, model.toxic, base)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with score, predicted (score >= 0.5), evidence (the five nearest examples) and terms (of the vocabulary in the text)."""
    rows = documents(docs, RESULTS)
    schema = StructType([*(rows.schema[c] for c in ("doc_id", "text", "rest")), *StructType.fromDDL(ADDED)])
    kinds = [pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())])), pa.list_(pa.string())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        begins = begins_in(m.names) if m is not None else ()
        known: dict[tuple, tuple] = {}

        def judged(terms: np.ndarray, tf: np.ndarray) -> tuple:
            key = (terms.tobytes(), tf.tobytes())
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                near, sims = m.index.search(*m.vector(terms, tf), m.k)
                said = [{"doc_id": int(m.ids[i]), "similarity": float(x), "toxic": int(m.toxic[i])} for i, x in zip(near[:5], sims[:5], strict=True)]
                known[key] = (m.chance(m.vote(near, sims)), said, [m.names[t] for t in terms])
            return known[key]

        for b in batches:
            for s in slices(b.column("text")):
                p, said, words = np.full(s.n, 0.5 if m is None else m.without), [[]] * s.n, [[]] * s.n
                if m is not None:
                    doc, term, tf = found_terms(s, m.hashes, begins)
                    first = np.flatnonzero(np.r_[np.ones(min(1, len(doc)), bool), doc[1:] != doc[:-1]])
                    for i, j in zip(first, np.r_[first[1:], len(doc)][: len(first)], strict=True):
                        p[doc[i]], said[doc[i]], words[doc[i]] = judged(term[i:j], tf[i:j])
                cols = [b.column(c).slice(s.first, s.n) for c in ("doc_id", "text", "rest")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(said, kinds[0]), pa.array(words, kinds[1])], names=["doc_id", "text", "rest", *RESULTS])

    return restored(rows.select("doc_id", "text", "rest").mapInArrow(run, schema), docs)
