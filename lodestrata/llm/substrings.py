"""Substring dedup by level-wise doubling over words.

The first level takes short windows (the length halved until LEAST words): of each full window the short window with the smallest hash. Only those that
occur twice survive and are extended to twice that length inside the full window (again the one with the smallest hash that holds
the survivor), and so on from level to level until no candidates survive or the full length is reached; of the full windows that are left those
that start earlier too are removed. Longer windows would add no word to those that these cover; ``longest_repeats`` goes on doubling, always from
survivors alone, until none are left.

A window is ``width`` consecutive words (maximal runs outside 0x20 and 0x09-0x0D) of one document. Every word covered by a window whose
words also start earlier goes (smaller doc_id, or the same document further left); windows are judged on the input.

Null text has no words; documents shorter than a window keep everything; a null doc_id comes before all others; rows that share a
doc_id are neither earlier nor later than each other, so repeated rows are treated alike; an empty table gives no rows. Columns
named like a result's (n_words, n_removed) are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import classes, coverage, instances, list_column, repeated, runs, spans_by_document, windows_of, with_spans
from .bytetext import Slice, prefix_hash, slices
from .common import documents, materialise, restored

RESULTS = ("n_words", "n_removed")
#: Words of the first level, at least: of 5-word windows over nine in ten repeat somewhere, so they part nothing.
LEAST = 8


def _prefixes(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (h1, _, _, _, at), (h2, *_) = s.word_hashes(False, 1), s.word_hashes(False, 2)
    return prefix_hash(h1), prefix_hash(h2), at


def _later(first: str) -> F.Column:
    """Whether a window (doc_id, lo) starts after the first one of its content."""
    return F.struct("doc_id", "lo") > F.struct(F.col(first)["doc_id"].alias("doc_id"), F.col(first)["lo"].alias("lo"))


def levels(width: int, least: int = LEAST) -> tuple[int, ...]:
    """The lengths below ``width``, each half of the next (rounded up), down to ``least``; one at any rate."""
    out = [(width + 1) // 2]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return tuple(out)


def repeated_spans(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, row_key, spans) of the words that go, for ``rows`` as made by common.documents."""
    lengths = levels(width)

    def of_slice(s: Slice):
        h, _, _, _, at = s.word_hashes(False, 1)
        return runs(prefix_hash(h), at, lengths, width)

    alive = instances(rows, of_slice, len(lengths))
    for k, length in enumerate(lengths):
        alive = repeated(alive, f"a{k}" if k < len(lengths) - 1 else "a", f"level-{length}")
        if alive.isEmpty():
            break
    met = materialise(classes(alive, "full").withColumn("gone", _later("first")).where("gone or kinds > 1").select("doc_id", "row_key", "lo", "n", "gone"), "candidates")
    # Last level: the full windows of the first member of each class, where an anchor has several classes.
    open_spans = spans_by_document(met.where("not gone"), width)
    full = windows_of(with_spans(rows, open_spans).where("spans is not null"), _prefixes, width)
    full = materialise(full, "windows")
    first = full.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "lo")).alias("first")).where("times > 1").drop("times")
    again = full.join(first, ["h1", "h2"]).where(_later("first")).select("doc_id", "row_key", "lo", "n")
    return spans_by_document(met.where("gone").select("doc_id", "row_key", "lo", "n").union(again), width)


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` (the rest joined by one space; unchanged where nothing goes),
    and n_words and n_removed. Null text stays null."""
    rows = documents(docs, RESULTS)
    spans = repeated_spans(rows, width)
    schema = StructType([rows.schema[c] for c in ("doc_id", "text", "rest")]).add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_span, lo, hi = list_column(b.column("spans"), "lo", "hi")
            for s in slices(b.column("text")):
                start, end, _, at = s.words()
                i, j = at_span[s.first], at_span[s.first + s.n]
                base = np.repeat(at[:-1], np.diff(at_span[s.first : s.first + s.n + 1]))
                gone = coverage(len(start), base, lo[i:j], hi[i:j])
                removed = np.diff(np.r_[0, np.cumsum(gone)][at])
                texts = b.column("text").slice(s.first, s.n)
                if removed.any():
                    raw, new = s.data.tobytes(), texts.to_pylist()
                    for d in np.flatnonzero(removed):
                        keep = np.arange(at[d], at[d + 1])[~gone[at[d] : at[d + 1]]]
                        new[d] = b" ".join([raw[x:y] for x, y in zip(start[keep].tolist(), end[keep].tolist(), strict=True)]).decode("utf-8", "replace")
                    texts = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.n), texts, b.column("rest").slice(s.first, s.n), pa.array(np.diff(at)), pa.array(removed)], names=["doc_id", "text", "rest", "n_words", "n_removed"])

    out = with_spans(rows, spans).select("doc_id", "text", "rest", "spans").mapInArrow(run, schema)
    return restored(out, docs)


def longest_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, longest): the longest level (width, 2 * width, ...) at which some window of the document occurs twice."""
    rows = documents(docs).drop("rest")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.size(F.split(F.trim("text"), "[ \\t-\\r]+")).cast("long").alias("hi")))
    spans = rows.select("doc_id", "row_key", everything.alias("spans"))
    found, level = None, width
    while True:
        full = materialise(windows_of(with_spans(rows, spans).where("spans is not null"), _prefixes, level), "level")
        twice = full.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").drop("times")
        alive = materialise(full.join(twice, ["h1", "h2"], "left_semi"), "alive")
        here = alive.groupBy("doc_id").agg(F.lit(level).alias("longest"))
        if alive.isEmpty():
            return (found or here).groupBy("doc_id").agg(F.max("longest").alias("longest"))
        found = here if found is None else found.union(here)
        # A window twice as long repeats only if both its halves do: they start where survivors start.
        other = alive.select("doc_id", "row_key", (F.col("lo") - level).alias("lo"))
        both = alive.join(other, (alive["doc_id"].eqNullSafe(other["doc_id"])) & (alive["row_key"] == other["row_key"]) & (alive["lo"] == other["lo"]), "left_semi")
        level *= 2
        spans = spans_by_document(both.select("doc_id", "row_key", "lo", F.lit(1).alias("n")).distinct(), level)
