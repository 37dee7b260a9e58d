"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents' ids, one after another. Each window of ``width`` tokens is
one round: every queue with tokens left earns its quantum (its target share of the window), is served the
whole tokens of its credit, and carries the fraction, its deficit, to the next window. When a queue runs dry its
share goes to the others. Documents may be cut anywhere, so only the last window of all is not full.

Between two windows in which a queue runs dry the rounds repeat the same quanta, so a queue's position and
deficit before round i follow from i alone: whatever partition holds a document finds its windows without
seeing the others, which is how deficits carry across partitions. Queue positions come from prefix sums
over (task, queue) totals, so a source with a third of all rows needs no task of its own.

Null text counts as empty (its one id is the end id); a null source is a queue of its own; an empty table
gives no rows; repeated rows are packed once each. Only doc_id, text and source are read, so other columns don't clash.
The number of sources is assumed to fit the driver (their totals are collected, one row each).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import ranges, slices
from .common import materialise
from .subwords import encoder

#: Quanta are whole multiples of 2**-SHIFT tokens; the weights in a tree of small queues, of a TREE-th of a window.
SHIFT, TREE = 16, 1 << 30

ENCODED = "part int, queue string, local_start long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def encode_queues(docs: DataFrame, vocab: str, end_id: int = 0) -> DataFrame:
    """Each document's ids (little-endian uint32, the end id last) with its place in its task's part of its source's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, served = encoder(vocab, "byte"), TaskContext.get().partitionId(), {}
        for b in batches:
            for s in slices(b.column("text"), 4 << 20):
                ids, off = enc.slice_ids(s)
                queue = b.column("queue").slice(s.first, s.n)
                with_end = np.insert(ids, off[1:], end_id).astype("<u4")
                n = np.diff(off) + 1
                ends = np.r_[0, np.cumsum(n)] * 4
                local = np.empty(s.n, np.int64)
                for i, (q, k) in enumerate(zip(queue.to_pylist(), n.tolist(), strict=True)):
                    local[i] = served.get(q, 0)
                    served[q] = local[i] + k
                blob = pa.Array.from_buffers(pa.large_binary(), s.n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(with_end.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(s.n, part, np.int32)), queue, pa.array(local), b.column("doc_id").slice(s.first, s.n), pa.array(n), blob], names=["part", "queue", "local_start", "doc_id", "n", "ids"])

    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), queue.alias("queue"))
    return materialise(rows.mapInArrow(run, ENCODED), "encoded")


def _served(weight: dict[str, float], width: int) -> dict[str, tuple[tuple, tuple, tuple]]:
    """For each queue served: terms whose whole tokens after i rounds are added, are taken off, and come before it in a window.

    Queues of at least a token a round share the window by cumulative quanta (in 2**-SHIFT tokens). What these leave goes to all
    smaller ones and the largest by a binary tree over their weights: of a node's n tokens the left half of the weight has
    the whole part of its share and the right half the rest. So the windows are always full, whatever the number of queues, and
    each queue stays within a few tokens of its due.
    """
    total, full = sum(weight.values()), width << SHIFT
    names = sorted(weight, key=lambda q: (weight[q], q))
    last = names.pop()
    quantum = {q: int(full * weight[q] / total) for q in names}
    out, cum = {}, 0
    for q in names:
        if quantum[q] >= 1 << SHIFT:
            out[q] = ((cum + quantum[q],), (cum,), (cum,))
            cum += quantum[q]
    leaves = [q for q in names if quantum[q] < 1 << SHIFT]
    if not leaves:
        return out | {last: ((full,), (cum,), (cum,))}
    share = [max(1, round(weight[q] / total * TREE)) for q in leaves]
    leaves.append(last)
    at = [0, *accumulate([*share, max(1, round((full - cum) / full * TREE) - sum(share))])]
    todo = [(0, len(leaves), ())]
    while todo:
        i, j, path = todo.pop()
        if j - i == 1:
            out[leaves[i]] = (((False, full, cum, path),), (), (cum, (True, full, cum, path)))
        else:
            k = min(max(bisect_left(at, (at[i] + at[j]) // 2, i, j), i + 1), j - 1)
            left, both = at[k] - at[i], at[j] - at[i]
            todo += [(k, j, (*path, (left, both, True))), (i, k, (*path, (left, both, False)))]
    return out


def _term(i, q):
    """The whole tokens of one term after i rounds: of a quantum, or of a leaf of the tree (or of what is left of it there)."""
    if not isinstance(q, tuple):
        return i * q >> SHIFT
    ahead_of, full, cum, path = q
    n, ahead = (i * full >> SHIFT) - (i * cum >> SHIFT), 0 * i
    for a, d, right in path:
        # n * a // d without overflow.
        part = n // d * a + n % d * a // d
        n, ahead = (n - part, ahead + part) if right else (part, ahead)
    return ahead if ahead_of else n


def _whole(i, quanta: tuple):
    """The whole tokens that the terms come to after i rounds, each rounded down by itself."""
    return sum((_term(i, q) for q in quanta), 0 * i)


def _rate(plus: tuple, minus: tuple) -> tuple[float, float]:
    """(tokens a round on average, how far the whole tokens can be from them)."""
    if not isinstance(plus[0], tuple):
        return (sum(plus) - sum(minus)) / (1 << SHIFT), 1.0 + len(minus)
    _, full, cum, path = plus[0]
    rate, off = (full - cum) / (1 << SHIFT), 1.0
    for a, d, right in path:
        p = (d - a if right else a) / d
        rate, off = rate * p, off * p + 1
    return rate, off


def plan_windows(totals: dict[str, int], width: int, targets: dict[str, float] | None = None) -> dict[str, list[tuple]]:
    """For each queue its phases: (first window, rounds, first token, quanta as in _served).

    ``targets``: shares by queue, any scale; by default the queues' own sizes, so that all last to the end.
    """
    left = {q: n for q, n in sorted(totals.items()) if n > 0}
    done = dict.fromkeys(left, 0)
    phases: dict[str, list[tuple]] = {q: [] for q in left}
    window = 0
    while left:
        weight = {q: float((targets or totals).get(q, 0)) for q in left}
        # Queues without a share wait until all others are dry.
        weight = {q: w for q, w in weight.items() if w > 0} or dict.fromkeys(left, 1.0)
        served = _served(weight, width)
        # A queue lasts for at least `least` rounds; where it matters, the exact number is searched.
        rates = {q: _rate(plus, minus) for q, (plus, minus, _) in served.items()}
        least = {q: max(0, int((left[q] - off) / rate) - 1) for q, (rate, off) in rates.items()}
        rounds = None
        for q in sorted(served, key=least.__getitem__):
            if rounds is not None and least[q] > rounds:
                break
            plus, minus, _ = served[q]
            lo, hi = least[q], int((left[q] + rates[q][1]) / rates[q][0]) + 2
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _whole(mid, plus) - _whole(mid, minus) <= left[q] else (lo, mid)
            rounds = lo if rounds is None else min(rounds, lo)
        due = {}
        for q, (plus, minus, before) in served.items():
            n = _whole(rounds, plus) - _whole(rounds, minus)
            due[q] = _whole(rounds + 1, plus) - _whole(rounds + 1, minus) - n
            if n:
                phases[q].append((window, rounds, done[q], plus, minus, before))
                done[q] += n
                left[q] -= n
        window += rounds
        # One round in which a queue runs dry: it gives its rest, and its unused credit goes round the others.
        take, room = {q: min(left[q], n) for q, n in due.items()}, width
        room -= sum(take.values())
        for q in [*served, *left]:
            more = min(room, left[q] - take.get(q, 0))
            take[q] = take.get(q, 0) + more
            room -= more
        at = 0
        for q, n in take.items():
            if n:
                phases[q].append((window, 1, done[q], (at + n << SHIFT,), (at << SHIFT,), (at << SHIFT,)))
                at += n
                done[q] += n
                left[q] -= n
        window += 1
        left = {q: n for q, n in left.items() if n}
    return phases


def _pieces(x0: np.ndarray, x1: np.ndarray, phases: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first token, end token, window, place in it) of the parts of [x0, x1) of one queue."""
    for first, rounds, begin, plus, minus, before in phases:
        rate, off = _rate(plus, minus)

        def at(i, begin=begin, plus=plus, minus=minus):
            return begin + _whole(i, plus) - _whole(i, minus)

        def find(x, begin=begin, rounds=rounds, rate=rate, off=off, at=at):
            """The last round that begins at x or before it."""
            lo = np.clip(((x - begin - off) / rate).astype(np.int64) - 1, 0, rounds - 1)
            hi = np.clip(((x - begin + off) / rate).astype(np.int64) + 2, 1, rounds)
            while len(open_ := np.flatnonzero(hi - lo > 1)):
                mid = (lo[open_] + hi[open_]) // 2
                low = at(mid) <= x[open_]
                lo[open_[low]], hi[open_[~low]] = mid[low], mid[~low]
            return lo

        end = int(at(rounds))
        d = np.flatnonzero((x0 < end) & (x1 > begin))
        if len(d):
            lo, hi = np.maximum(x0[d], begin), np.minimum(x1[d], end)
            if rate < 1:
                # Most windows hold nothing of this queue: its tokens are gone through, not the windows.
                doc = np.repeat(d, hi - lo)
                w = find(ranges(lo, hi))
                new = np.r_[True, (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]
                w, doc = w[new], doc[new]
            else:
                a, b = find(lo), find(hi - 1) + 1
                w, doc = ranges(a, b), np.repeat(d, b - a)
            s, e = np.maximum(at(w), x0[doc]), np.minimum(at(w + 1), x1[doc])
            ok = s < e
            w, doc, s, e = w[ok], doc[ok], s[ok], e[ok]
            yield doc, s, e, first + w, _whole(w + 1, before) - _whole(w, before) + s - at(w)


def pack(docs: DataFrame, vocab: str, width: int = 1024, targets: dict[str, float] | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a window: PIECES, and with_ids the piece's ids (little-endian uint32).

    ``targets``: shares of a window by source; by default the sources' shares of all tokens.
    """
    encoded = encode_queues(docs, vocab, end_id)
    sums = encoded.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sums.select("part", "queue", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    totals = {r["queue"]: r["n"] for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    wanted = {f"={k}" if k is not None else "null": v for k, v in targets.items()} if targets else None
    phases = plan_windows(totals, width, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
            raw = memoryview(ids.buffers()[2])
            n = b.column("n").to_numpy()
            x0 = b.column("base").to_numpy() + b.column("local_start").to_numpy()
            queue = b.column("queue").dictionary_encode()
            code = queue.indices.to_numpy()
            for k, name in enumerate(queue.dictionary.to_pylist()):
                mine = np.flatnonzero(code == k)
                for doc, s, e, w, place in _pieces(x0[mine], x0[mine] + n[mine], phases[name]):
                    for c in range(0, len(doc), 200_000):
                        row = mine[doc[c : c + 200_000]]
                        start, size = s[c : c + 200_000] - x0[row], (e - s)[c : c + 200_000]
                        lo = off[row] + start * 4
                        hi = lo + size * 4
                        crc = np.fromiter((zlib.crc32(raw[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(lo))
                        cols = [b.column("doc_id").take(pa.array(row)), start, size, crc, n[row], w[c : c + 200_000], place[c : c + 200_000], pa.array([name] * len(row))]
                        if with_ids:
                            cols.append(pa.array([bytes(raw[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()))
                        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"] + ["ids"] * with_ids
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    return encoded.join(bases.drop("n"), ["part", "queue"]).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves: sequence_id, n_tokens and ids (uint32, little-endian) from pieces that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
