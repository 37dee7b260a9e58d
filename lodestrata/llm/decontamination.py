"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Sets hold ``words``-word shingles (hashes; A-Z as a-z; a text of fewer words is one shingle). An item of n shingles lies in a document if at least
``percent`` of its shingles do; then any n - ceil(percent * n) + 1 of them include one of the document's. An item's sketch is
that many of its smallest hashes. Items are partitioned by size (powers of two): each size has its own bound, the largest hash that its
sketches hold, and of a document only the shingles below it count there, so long documents are searched by a fraction of
their shingles whatever their length; documents with fewer shingles than an item of that size needs are passed over. Documents that hit an
item's sketch are verified on the whole sets. No containment is missed.

Up to BROADCAST shingles of items are searched through one broadcast index, in one pass over the documents. Beyond that nothing is broadcast or
collected: the items' sketches and the documents' shingles meet in a join, and what they hit is verified by joins as well.

Items or documents without words contain nothing; null item_ids and doc_ids are carried as they are; repeated rows are reported once each; an
empty table on either side gives no rows. Only the id and text columns are read; ``clean`` passes all columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import raw_shingles, shingles, slices
from .common import documents, materialise, restored

#: Shingles of items (8 bytes each) up to which the index is broadcast.
BROADCAST = 400_000


def _item_sets(items: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                h, _, _, _, at = s.word_hashes(True)
                g, d = shingles(h, at, words)
                ends = np.searchsorted(d, np.arange(s.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("item_id").slice(s.first, s.n), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], names=["item_id", "hashes"])

    text = F.coalesce("text", F.lit(""))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).mapInArrow(run, "item_id long, hashes array<long>")
    return materialise(rows.where(F.size("hashes") > 0), "items")


class _Index:
    """The sketches of a block of items by size, as sorted arrays."""

    def __init__(self, sets: list[np.ndarray], ids: list, percent: int):
        self.sets, self.ids = sets, ids
        self.need = np.array([-(-percent * len(x) // 100) for x in sets], np.int64)
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(sets):
            by_size.setdefault(len(x).bit_length(), []).append(i)
        self.parts = []
        for members in by_size.values():
            sketch = [sets[i][: len(sets[i]) - int(self.need[i]) + 1] for i in members]
            v, owner = np.concatenate(sketch), np.repeat(members, [len(x) for x in sketch])
            order = np.argsort(v, kind="stable")
            v, owner = v[order], owner[order]
            self.parts.append((v, owner, v[-1], int(self.need[members].min())))

    def hits(self, g: np.ndarray, d: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(document, item) pairs, distinct, for shingles g of documents d that have at most ``size`` shingles."""
        found = []
        for v, owner, bound, least in self.parts:
            low = (g <= bound) & (size[d] >= least)
            gl, dl = g[low], d[low]
            i, j = np.searchsorted(v, gl, "left"), np.searchsorted(v, gl, "right")
            k = np.flatnonzero(j > i)
            n = (j - i)[k]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(i[k], n)
            found.append(np.unique(np.stack([np.repeat(dl[k], n), owner[at]], 1), axis=0))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


FOUND = "doc_id long, row_key int, item_id long, n_item long, n_shared long"


def contained(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, row_key, item_id, n_item, n_shared): every item of which a document holds ``percent`` of the shingles."""
    rows = documents(docs).drop("rest")
    sets = _item_sets(items, words)
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    return _by_broadcast(rows, sets, words, percent) if total <= broadcast else _by_join(rows, sets, words, percent)


def _by_broadcast(rows: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    found = sets.select("item_id", "hashes").collect()
    # Unsigned order, as the hashes were sorted.
    index = rows.sparkSession.sparkContext.broadcast(_Index([np.array(r["hashes"], np.int64).view(np.uint64) for r in found], [r["item_id"] for r in found], percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: _Index = index.value
        for b in batches:
            for s in slices(b.column("text")):
                h, _, _, _, at = s.word_hashes(True)
                g, d = raw_shingles(h, at, words)
                size = np.bincount(d, minlength=s.n)
                out = []
                own: dict[int, np.ndarray] = {}
                for doc, item in ix.hits(g, d, size).tolist():
                    if doc not in own:
                        own[doc] = np.unique(g[d == doc])
                    shared = int(np.isin(ix.sets[item], own[doc], assume_unique=True).sum())
                    if shared >= ix.need[item]:
                        out.append((doc, ix.ids[item], len(ix.sets[item]), shared))
                if out:
                    doc, item, n, shared = zip(*out, strict=True)
                    r = pa.array([s.first + x for x in doc])
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(r), b.column("row_key").take(r), pa.array(item, pa.int64()), pa.array(n), pa.array(shared)], names=["doc_id", "row_key", "item_id", "n_item", "n_shared"])

    return rows.select("doc_id", "row_key", "text").mapInArrow(run, FOUND)


def _by_join(rows: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                h, _, _, _, at = s.word_hashes(True)
                g, d = shingles(h, at, words)
                r = pa.array(s.first + d)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(r), b.column("row_key").take(r), pa.array(np.bincount(d, minlength=s.n)[d]), pa.array(g.view(np.int64))], names=["doc_id", "row_key", "size", "v"])

    # Equal rows have equal answers: one of them is searched, and each gets what it finds.
    copies = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
    one = rows.dropDuplicates(["doc_id", "row_key", "text"])
    in_docs = one.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key int, size long, v long")
    # Equal items are searched once too.
    n = F.size("hashes").cast("long")
    kinds = materialise(sets.select("hashes").distinct().select(F.xxhash64("hashes").alias("item"), "hashes", n.alias("n"), F.ceil(n * percent / 100).cast("long").alias("need")), "kinds")
    sketch = kinds.select("item", "need", F.explode(F.slice("hashes", F.lit(1), (F.col("n") - F.col("need") + 1).cast("int"))).alias("v"))
    hit = materialise(in_docs.join(sketch, "v").where("size >= need").select("doc_id", "row_key", "item").distinct(), "hits")
    full = hit.join(kinds.select("item", F.explode("hashes").alias("v")), "item")
    d, k = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.row_key") == F.col("r.row_key")
    shared = full.alias("l").join(in_docs.alias("r"), (F.col("l.v") == F.col("r.v")) & d & k).groupBy("l.doc_id", "l.row_key", "item").agg(F.count("*").alias("n_shared"))
    found = shared.join(kinds.select("item", "need", F.col("n").alias("n_item")), "item").where("n_shared >= need")
    found = found.join(sets.select(F.xxhash64("hashes").alias("item"), "item_id"), "item").select("doc_id", "row_key", "item_id", "n_item", "n_shared")
    times = copies.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), "copies")
    again = found.join(times, found["doc_id"].eqNullSafe(times["__d"]) & (found["row_key"] == times["__k"])).drop("__d", "__k")
    return again.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "row_key", "item_id", "n_item", "n_shared")


def clean(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` without those that contain an item."""
    rows = documents(docs)
    hit = contained(docs, items, words, percent, broadcast).select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k")).distinct()
    return restored(rows.join(hit, rows["doc_id"].eqNullSafe(hit["__d"]) & (rows["row_key"] == hit["__k"]), "left_anti"), docs)
