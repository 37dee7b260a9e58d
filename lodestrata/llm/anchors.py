"""Repeated windows found through content-chosen anchors.

Of every window (``width`` consecutive units: words or bytes) the place with the smallest hash of its ``gram`` consecutive units
is its anchor. Equal windows choose equal anchors, so no repeat is lost, and consecutive windows mostly share one: an
*instance* is a run of windows of one document with the same anchor. Only instances whose anchor occurs twice can hold a
repeated window. Instances with the same whole content form a class; classes alone in their anchor's group are settled
by their size, the others keep one member each (the first), whose windows are compared with the other classes'.

The hash of a class is 64 bits beside the anchor's 64; a wrong merge needs both to collide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import Slice, minimizers, mix, ranges, slices, span_hash
from .common import materialise, per_node

def extended(p: np.ndarray, w: np.ndarray, place: np.ndarray, short: int, long: int, width: int) -> np.ndarray:
    """For every window ``w`` the place of the ``long`` units in it that hold the ``short`` ones at ``place`` and have the smallest hash (leftmost)."""
    best, out = np.full(len(w), ~np.uint64(0)), place.copy()
    fit = np.zeros(len(w), bool)
    units = len(p) - 1
    for back in range(long - short, -1, -1):
        at = place - back
        ok = (at >= w) & (at + long <= w + width)
        s = np.clip(at, 0, max(0, units - long))
        h = span_hash(p, s, s + long)
        better = ok & (~fit | (h < best))
        best, out, fit = np.where(better, h, best), np.where(better, at, out), fit | ok
    return out


def runs(p: np.ndarray, at: np.ndarray, grams: tuple[int, ...], width: int) -> tuple[np.ndarray, ...]:
    """(hashes of the anchor at each length of ``grams``, content hash, first window, windows, place of the longest anchor in the first window,
    document) of each instance.

    ``p``: prefix hash over all units of a slice; ``at``: the documents' bounds in units. Windows are numbered in their documents.
    An anchor of the next length holds the one before.
    """
    units = len(p) - 1
    first = np.arange(max(0, units - grams[0] + 1))
    b = minimizers(span_hash(p, first, first + grams[0]), width - grams[0] + 1)
    w = np.flatnonzero(np.arange(len(b)) + width <= np.repeat(at[1:], np.diff(at))[: len(b)])
    places = [b[w]]
    for short, long in zip(grams, grams[1:], strict=False):
        places.append(extended(p, w, places[-1], short, long, width))
    moved = w[1:] != w[:-1] + 1
    for b in places:
        moved |= b[1:] != b[:-1]
    cut = np.flatnonzero(np.r_[np.ones(min(1, len(w)), bool), moved])
    lo, place = w[cut], places[-1][cut]
    last = w[np.r_[cut[1:], len(w)] - 1] if len(w) else lo
    c = span_hash(p, lo, last + width) ^ mix((place - lo).astype(np.uint64) + np.uint64(1))
    doc = np.searchsorted(at, lo, side="right") - 1
    return [span_hash(p, b[cut], b[cut] + n) for b, n in zip(places, grams, strict=True)], c, lo - at[doc], last - lo + 1, place - lo, doc


def instances(rows: DataFrame, of_slice: Callable[[Slice], tuple[np.ndarray, ...]], levels: int = 1) -> DataFrame:
    """(a, the anchor at the longest length, c, doc_id, row_key, lo, n, off, and the anchors of the ``levels - 1`` shorter lengths: a0, a1, ...) of
    ``rows`` (doc_id, text, row_key). of_slice: as runs."""
    names = ["a", "c", "doc_id", "row_key", "lo", "n", "off", *(f"a{i}" for i in range(levels - 1))]
    schema = "a long, c long, doc_id long, row_key int, lo long, n int, off int" + "".join(f", a{i} long" for i in range(levels - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                anchors, c, lo, n, off, doc = of_slice(s)
                if len(c):
                    row = pa.array(s.first + doc)
                    h = [pa.array(a.view(np.int64)) for a in anchors]
                    yield pa.RecordBatch.from_arrays([h[-1], pa.array(c.view(np.int64)), b.column("doc_id").take(row), b.column("row_key").take(row), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), *h[:-1]], names=names)

    return rows.select("doc_id", "text", "row_key").mapInArrow(run, schema)


def repeated(inst: DataFrame, anchor: str, name: str) -> DataFrame:
    """The instances whose ``anchor`` occurs twice."""
    # Written, so that the join reads both sides by plain exchanges and Spark can split a very common anchor's rows.
    twice = materialise(inst.groupBy(anchor).agg(F.count("*").alias("times")).where("times > 1").select(anchor), f"{name}-twice")
    return materialise(inst.join(twice, anchor, "left_semi"), name)


def classes(met: DataFrame, name: str) -> DataFrame:
    """``met``, instances whose anchor occurs twice, with: copies (of the class), first (doc_id, lo, row_key), kinds (classes of the anchor)."""
    by_class = met.groupBy("a", "c").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "lo", "row_key")).alias("first"))
    by_class = materialise(by_class, f"{name}-classes")
    kinds = per_node(by_class, "a", F.count("*").alias("kinds"))
    return met.join(by_class.join(kinds, "a"), ["a", "c"])


def windows_of(rows: DataFrame, of_slice: Callable[[Slice], np.ndarray], width: int) -> DataFrame:
    """(h1, h2, doc_id, row_key, lo, n = 1): a 128-bit hash of every window that ``rows``' spans name.

    of_slice: gives two prefix hashes over the slice's units and the documents' bounds in units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_span, lo, hi = list_column(b.column("spans"), "lo", "hi")
            for s in slices(b.column("text")):
                p1, p2, at = of_slice(s)
                i, j = at_span[s.first], at_span[s.first + s.n]
                doc = np.repeat(np.arange(s.n), np.diff(at_span[s.first : s.first + s.n + 1]))
                first, end = lo[i:j], hi[i:j] - width + 1
                w, doc = ranges(first, end), np.repeat(doc, np.maximum(end - first, 0))
                if len(w):
                    u, row = w + at[doc], pa.array(s.first + doc)
                    h = [pa.array(span_hash(p, u, u + width).view(np.int64)) for p in (p1, p2)]
                    yield pa.RecordBatch.from_arrays([*h, b.column("doc_id").take(row), b.column("row_key").take(row), pa.array(w), pa.array(np.ones(len(w), np.int32))], names=["h1", "h2", "doc_id", "row_key", "lo", "n"])

    return rows.select("doc_id", "row_key", "text", "spans").mapInArrow(run, "h1 long, h2 long, doc_id long, row_key int, lo long, n int")


def spans_by_document(found: DataFrame, width: int) -> DataFrame:
    """(doc_id, row_key, spans): for every document the unit ranges that its repeated windows (lo, n) cover.

    A document's distinct spans are at most as many as its units, so a set of them is no larger than the document; repeated rows give theirs once.
    """
    return found.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("lo", (F.col("lo") + F.col("n") - 1 + width).alias("hi"))).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with their documents' ``spans``, null where there are none."""
    s = spans.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), "spans")
    return rows.join(s, rows["doc_id"].eqNullSafe(s["__d"]) & (rows["row_key"] == s["__k"]), "left").drop("__d", "__k")


def list_column(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """(offsets, *flat fields) of a list-of-structs column; a null list is empty."""
    lens = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return (np.r_[0, np.cumsum(lens)], *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields))


def coverage(size: int, base: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of ``size`` units some [base + lo, base + hi) covers."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, base + lo, 1)
    np.add.at(d, base + hi, -1)
    return np.cumsum(d[:-1]) > 0
