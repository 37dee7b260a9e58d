"""Suffix-array dedup over bytes, suffixes ordered by deep-shallow sorting.

Every ``width``-byte window has an anchor (see anchors.py), and only windows whose anchor occurs twice can repeat. The suffixes that
start at the anchors of one group, and likewise the reversed prefixes that end there, are sorted: multikey quicksort
(ternary partitions by eight-byte characters) down to a shallow depth, then a blind trie orders each group that is still tied.
Neighbours' longest common prefixes to the right and to the left give, for any two members, the match around the anchor; a match of
at least ``width`` bytes repeats. Members with the same whole content are first collapsed to one with a count of two
or more, which settles all their windows, so a group holds one member per distinct content. A task sorts groups of at most ``most`` members.
Larger ones (a passage in very many different contexts) are first parted by prefix: windows that start within the same ``step`` bytes
before the anchor share all but ``step`` - 1 of their bytes, so members meet by a 128-bit hash of those, and each block is sorted by itself;
blocks that are still too large are parted again with smaller steps. At a step of one nothing is left to order: a block is one string.

Matches never cross documents; strings are judged on the input; every byte covered by a string that also starts anywhere else goes, all
copies alike. Null text is empty; a document shorter than ``width`` keeps everything; repeated rows repeat each other;
rows may share a doc_id or have none; an empty table gives no rows. Columns named like a result's are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import classes, coverage, instances, list_column, repeated, runs, spans_by_document, with_spans
from .bytetext import Slice, byte_table, mix, prefix_hash, ranges, slices, span_hash
from .common import documents, materialise, restored
from .lists import whole_groups

#: Bytes of an anchor; bytes to which multikey quicksort goes before blind tries take over.
GRAM, SHALLOW = 64, 64
RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")


class _Node:
    """An inner node of a blind trie: the depth at which its children part, and the children by their byte there (-1: ended)."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int):
        self.depth, self.children = depth, {}


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (diff.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their strings, by insertion into a trie that keeps only branching depths.

    An insertion runs down by the branching bytes alone, compares with the one leaf it meets, and then knows where to branch.
    """
    root: _Node | list[int] = [members[0]]
    for m in members[1:]:
        s = strings[m]
        node = root
        while isinstance(node, _Node):
            byte = s[node.depth] if node.depth < len(s) else -1
            node = node.children.get(byte) or next(iter(node.children.values()))
        other = strings[node[0]]
        k = common_prefix(s, other)
        if k == len(s) == len(other):
            node.append(m)
            continue
        parent, at, node = None, None, root
        while isinstance(node, _Node) and node.depth < k:
            parent, at = node, s[node.depth]
            node = node.children[at]
        mine = s[k] if k < len(s) else -1
        if isinstance(node, _Node) and node.depth == k:
            node.children[mine] = [m]
            continue
        branch = _Node(k)
        branch.children = {mine: [m], (other[k] if k < len(other) else -1): node}
        if parent is None:
            root = branch
        else:
            parent.children[at] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.children[b] for b in sorted(node.children, reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of ``strings`` (equal ones in any order)."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += blind_trie_order(strings, group)
        else:
            # Ternary partition by one eight-byte character; a shorter string sorts first (its length breaks the tie of padding).
            key = {m: (strings[m][depth : depth + 8].ljust(8, b"\0"), min(8, max(0, len(strings[m]) - depth))) for m in group}
            pivot = key[group[len(group) // 2]]
            less, same, more = ([m for m in group if key[m] < pivot], [m for m in group if key[m] == pivot], [m for m in group if key[m] > pivot])
            if more:
                stack.append((more, depth))
            stack.append((same, depth + 8 if pivot[1] == 8 else shallow))
            if less:
                stack.append((less, depth))
    return out


def _lcp_from(order: list[int], strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string, common prefix of each with the one before it in order)."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.array([0] + [common_prefix(strings[i], strings[j]) for i, j in zip(order, order[1:], strict=False)], np.int64)


def _to_all(r: int, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of the string of rank r with those of every rank (its own: unbounded)."""
    out = np.empty(len(lcp), np.int64)
    out[r] = 1 << 40
    out[r + 1 :] = np.minimum.accumulate(lcp[r + 1 :])
    out[:r] = np.minimum.accumulate(lcp[r:0:-1])[::-1]
    return out


def repeated_in_group(contexts: list[bytes], off: list[int], n: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For each member of an anchor's group the runs (first window, windows) of its windows that another member has too.

    ``contexts``: the bytes that a member's windows cover; ``off``: where the anchor stands in it; ``n``: its windows.
    """
    right, left = [c[o:] for c, o in zip(contexts, off, strict=True)], [c[:o][::-1] for c, o in zip(contexts, off, strict=True)]
    rank_r, lcp_r = _lcp_from(deep_shallow_order(right), right)
    rank_l, lcp_l = _lcp_from(deep_shallow_order(left), left)
    out = []
    for i in range(len(contexts)):
        to_right, to_left = _to_all(rank_r[i], lcp_r)[rank_r], _to_all(rank_l[i], lcp_l)[rank_l]
        ok = to_right + to_left >= width
        ok[i] = False
        # A window that starts o bytes before the anchor is shared if o <= left match and width - o <= right match.
        near, far = off[i] - np.minimum(to_left[ok], off[i]), off[i] - width + to_right[ok]
        seen = np.zeros(n[i] + 1, np.int64)
        near, far = np.maximum(near, 0), np.minimum(far, n[i] - 1)
        good = near <= far
        np.add.at(seen, near[good], 1)
        np.add.at(seen, far[good] + 1, -1)
        hit = np.r_[0, np.cumsum(seen[:-1]) > 0, 0]
        edge = np.diff(hit)
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist(), strict=True)))
    return out


def _byte_prefix(s: Slice, seed: int) -> np.ndarray:
    return prefix_hash(byte_table(seed, False)[s.data])


FOUND = "doc_id long, row_key int, lo long, n int"
MEMBER = "a long, b long, doc_id long, row_key int, lo long, n int, off int, context binary"


def repeated_spans(rows: DataFrame, width: int, most: int = 1024) -> DataFrame:
    """(doc_id, row_key, spans) of the bytes that go, for ``rows`` as made by common.documents."""
    gram = min(GRAM, max(1, width // 4))

    def of_slice(s: Slice):
        return runs(_byte_prefix(s, 7), s.off, (gram,), width)

    met = classes(repeated(instances(rows, of_slice), "a", "anchors"), "anchors").where("copies > 1 or kinds > 1")
    # One member of each class stands for it where its anchor has other classes.
    stands = F.struct("doc_id", "lo", "row_key") == F.col("first")
    met = materialise(met.select("a", "doc_id", "row_key", "lo", "n", "off", "kinds", (F.col("copies") > 1).alias("gone"), (stands & (F.col("kinds") > 1)).alias("open")).where("gone or open"), "met")
    found = met.where("gone").select("doc_id", "row_key", "lo", "n")
    contexts = with_spans(rows, _members(met.where("open"))).where("spans is not null").select("doc_id", "row_key", "text", "spans")
    members = materialise(contexts.mapInArrow(lambda batches: _contexts(batches, width), MEMBER + ", kinds long"), "members")

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "a"):
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            cut = np.r_[0, np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, len(a)]
            ctx, off, n, lo = (batch.column(c).to_pylist() for c in ("context", "off", "n", "lo"))
            row, first, size = [], [], []
            for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                for k, hits in enumerate(repeated_in_group(ctx[i:j], off[i:j], n[i:j], width), i):
                    for w, m in hits:
                        row.append(k)
                        first.append(lo[k] + w)
                        size.append(m)
            if row:
                r = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(r), batch.column("row_key").take(r), pa.array(first, pa.int64()), pa.array(size, pa.int32())], names=["doc_id", "row_key", "lo", "n"])

    step = width
    while True:
        few = members.where(F.col("kinds").between(2, most)).drop("kinds")
        found = found.union(few.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(sort_groups, FOUND))
        many = members.where(F.col("kinds") > most)
        if many.isEmpty():
            return spans_by_document(found, width)
        if step == 1:
            return spans_by_document(found.union(many.select("doc_id", "row_key", "lo", "n")), width)
        step = max(1, step // 8)
        # Written, so that the join reads both sides by plain exchanges and Spark can split a very large block's rows.
        parts = materialise(many.mapInArrow(lambda batches, step=step: _parted(batches, width, step), MEMBER), "parts")
        kinds = materialise(parts.groupBy("a", "b").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
        members = materialise(parts.join(kinds, ["a", "b"]), "members")


def _parted(batches: Iterator[pa.RecordBatch], width: int, step: int) -> Iterator[pa.RecordBatch]:
    """Members cut into those of their windows that start in the same ``step`` bytes before the anchor; (a, b): what all of these share."""
    core = width - step + 1
    for batch in batches:
        off, n, lo = (batch.column(c).to_numpy().astype(np.int64) for c in ("off", "n", "lo"))
        text = batch.column("context").cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)
        low = np.maximum(off - n + 1, 0)
        block = ranges(low // step, off // step + 1)
        m = np.repeat(np.arange(len(off)), off // step - low // step + 1)
        far, near = np.minimum(block * step + step - 1, off[m]), np.maximum(block * step, low[m])
        for i in range(0, len(m), 4096):
            k, hi, o0 = m[i : i + 4096], far[i : i + 4096], block[i : i + 4096] * step
            base = at[k[0]]
            piece = data[base : at[k[-1] + 1]]
            begin = at[k] - base + off[k] - o0
            key = [span_hash(prefix_hash(byte_table(seed, False)[piece]), begin, begin + core) ^ mix(o0.astype(np.uint64) + np.uint64(1)) for seed in (7, 8)]
            start, size = at[k] + off[k] - hi, hi - near[i : i + 4096] + 1
            raw = [data[x:y].tobytes() for x, y in zip(start.tolist(), (start + size - 1 + width).tolist(), strict=True)]
            row = pa.array(k)
            yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in key], batch.column("doc_id").take(row), batch.column("row_key").take(row), pa.array(lo[k] + off[k] - hi), pa.array(size.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(raw, pa.binary())], names=["a", "b", "doc_id", "row_key", "lo", "n", "off", "context"])


def _members(met: DataFrame) -> DataFrame:
    return met.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("a", "lo", "n", "off", "kinds")).alias("spans"))


def _contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, a, lo, n, off, kinds = list_column(b.column("spans"), "a", "lo", "n", "off", "kinds")
        for s in slices(b.column("text")):
            i, j = at[s.first], at[s.first + s.n]
            doc = np.repeat(np.arange(s.n), np.diff(at[s.first : s.first + s.n + 1]))
            start = s.off[doc] + lo[i:j]
            raw, row = s.data.tobytes(), pa.array(s.first + doc)
            ctx = [raw[x:y] for x, y in zip(start.tolist(), (start + n[i:j] - 1 + width).tolist(), strict=True)]
            for c in range(0, len(ctx), 4096):
                d = slice(i + c, min(j, i + c + 4096))
                yield pa.RecordBatch.from_arrays([pa.array(a[d]), pa.array(np.zeros(len(row[c : c + 4096]), np.int64)), b.column("doc_id").take(row[c : c + 4096]), b.column("row_key").take(row[c : c + 4096]), pa.array(lo[d]), pa.array(n[d]), pa.array(off[d]), pa.array(ctx[c : c + 4096], pa.binary()), pa.array(kinds[d])], names=["a", "b", "doc_id", "row_key", "lo", "n", "off", "context", "kinds"])


def remove_repeats(docs: DataFrame, width: int = 400, most: int = 1024) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes of text), n_bytes, n_removed and n_spans (maximal removed runs)."""
    rows = documents(docs, RESULTS)
    spans = repeated_spans(rows, width, most)
    schema = StructType([rows.schema[c] for c in ("doc_id", "text", "rest")]).add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_span, lo, hi = list_column(b.column("spans"), "lo", "hi")
            for s in slices(b.column("text")):
                i, j = at_span[s.first], at_span[s.first + s.n]
                base = np.repeat(s.off[:-1], np.diff(at_span[s.first : s.first + s.n + 1]))
                gone = coverage(len(s.data), base, lo[i:j], hi[i:j])
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                inner = s.off[:-1][s.off[:-1] < len(gone)]
                begin[inner] = gone[inner]
                count, spots = np.r_[0, np.cumsum(gone)][s.off], np.r_[0, np.cumsum(begin)][s.off]
                kept = s.data[~gone]
                ends = s.off - count
                blob = pa.Array.from_buffers(pa.binary(), s.n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
                cols = [b.column(c).slice(s.first, s.n) for c in ("doc_id", "text", "rest")]
                yield pa.RecordBatch.from_arrays([*cols, blob, pa.array(np.diff(s.off)), pa.array(np.diff(count)), pa.array(np.diff(spots))], names=["doc_id", "text", "rest", "kept", "n_bytes", "n_removed", "n_spans"])

    return restored(with_spans(rows, spans).select("doc_id", "text", "rest", "spans").mapInArrow(run, schema), docs)
