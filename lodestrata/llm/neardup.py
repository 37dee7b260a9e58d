"""Near duplicates by bottom-k sketches from one hash function.

A document's set holds its distinct ``words``-word shingles as 64-bit hashes (with fewer words the whole sequence is its one
shingle). Equal sets are one class. A class's sketch is its KEPT smallest hashes, of which the INDEXED rarest go into inverted lists.
Classes with equal sketches stand together in the lists, where two meet if their sizes allow the similarity; the sketch of their union (the
smallest KEPT of both) estimates it, and estimates far below the threshold (five standard deviations) are dropped. In a list two that links of the
same task connect already aren't compared again. Lists of any length are cut into blocks whose pairs meet in separate tasks; what leaves a
task are the edges of a spanning forest, never all pairs.

These edges are verified on full sets first. Where they don't connect a group by themselves, the parts that they leave are compared, members of
the largest part with all others and those among each other, in blocks, but never two of one part.

The estimate asks for at least 9 of 24 hashes in common (at 0.8), so of a sketch's 24 any 16 hold a common one.

Letters A-Z count as a-z. Documents without words link with nothing; a null doc_id never gives its name to a component (components without
any other have null); rows that share a doc_id count as separate documents; an empty table gives no rows. Columns
named like a result's are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import Slice, mix, shingles, slices
from .common import connected_components, documents, materialise, restored
from .lists import blocked, forest, grid, pairs, whole_groups

KEPT, INDEXED = 24, 16
#: Rows of a block of an inverted list, and of a group whose full sets are compared.
LIST_BLOCK, SET_BLOCK = 512, 256
#: Least similarity, in percent, for which the indexed values find nine links of ten or more; less is refused.
LEAST_PERCENT = 77
RESULTS = ("n_shingles", "component_id", "kept")
_NONE = np.iinfo(np.int64).max


def _sets(s: Slice, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit shingle hashes sorted within documents, documents' bounds)."""
    h, _, _, _, at = s.word_hashes(True)
    g, d = shingles(h, at, words)
    return (g >> np.uint64(1)).astype(np.int64), np.searchsorted(d, np.arange(s.n + 1))


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, set_id, n, sketch): a hash of the whole set, its size and its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                v, at = _sets(s, words)
                n = np.diff(at)
                with np.errstate(over="ignore"):
                    sums = np.r_[np.uint64(0), np.cumsum(mix(v.astype(np.uint64) + np.uint64(0x51ED270B)), dtype=np.uint64)]
                    set_id = mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
                size = np.minimum(n, KEPT)
                ends = np.r_[0, np.cumsum(size)]
                flat = v[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(at[:-1], size)]
                sketch = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(s.first, s.n), b.column("row_key").slice(s.first, s.n), pa.array(set_id.view(np.int64)), pa.array(n), sketch], names=["doc_id", "row_key", "set_id", "n", "sketch"])

    return rows.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key int, set_id long, n long, sketch array<long>")


def _likely(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the union sketch estimates at least ``least``, of padded sketches, row by row."""
    same = a[:, :, None] == b[:, None, :]
    common = same.any(2) & (a != _NONE)
    smaller = (b[:, None, :] < a[:, :, None]).sum(2)
    # The place of a common hash in the union: what is smaller in a, and in b, less what is in both.
    place = np.arange(a.shape[1])[None, :] + smaller - (np.cumsum(common, 1) - common)
    union = (a != _NONE).sum(1) + (b != _NONE).sum(1) - common.sum(1)
    k = np.minimum(union, a.shape[1])
    hits = (common & (place < k[:, None])).sum(1)
    return hits >= least * k


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) of set_ids that connect all classes whose sketches look alike."""
    least = max(0.0, threshold - 5 * float(np.sqrt(threshold * (1 - threshold) / KEPT)))
    alike = materialise(classes.groupBy("sketch").agg(F.min("set_id").alias("set_id"), F.min("n").alias("low"), F.max("n").alias("high")), "alike")
    same = classes.select("sketch", F.col("set_id").alias("a")).join(alike.select("sketch", F.col("set_id").alias("b")), "sketch").where("a != b").select("a", "b")
    values = alike.select("set_id", F.explode("sketch").alias("v"))
    size = materialise(values.groupBy("v").agg(F.count("*").alias("size")), "lists")
    rarest = Window.partitionBy("set_id").orderBy("size", "v")
    indexed = values.join(size, "v").withColumn("__rank", F.row_number().over(rarest)).where((F.col("__rank") <= INDEXED) & (F.col("size") > 1)).drop("__rank")
    lists = indexed.join(alike, "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            ids, low, high = (b.column(c).to_numpy() for c in ("set_id", "low", "high"))
            at = np.r_[0, np.cumsum(b.column("sketch").value_lengths().to_numpy())]
            table = np.full((len(ids), KEPT), _NONE)
            table[np.repeat(np.arange(len(ids)), np.diff(at)), np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))] = b.column("sketch").flatten().to_numpy()
            root = np.arange(len(ids))
            for i, j in pairs(b.column("group").to_numpy(), b.column("side").to_numpy(), 20_000):
                open_ = (root[i] != root[j]) & (high[i] >= threshold * low[j] - 1e-9) & (high[j] >= threshold * low[i] - 1e-9)
                i, j = i[open_], j[open_]
                ok = _likely(table[i], table[j], least)
                root = forest(len(ids), root[i[ok]], root[j[ok]])[root]
            k = np.flatnonzero(root != np.arange(len(ids)))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[root[k]])], names=["a", "b"])

    met = blocked(lists, "v", "set_id", "size", LIST_BLOCK).select("group", "side", "set_id", "low", "high", "sketch").mapInArrow(run, "a long, b long")
    return met.union(same)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by blocks of a 0/1 matrix."""
    m = len(sets)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    out = np.zeros((m, m))
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = max(64, (1 << 22) // m)
    for c in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        i, j = np.searchsorted(codes, [c, c + width])
        block = np.zeros((m, width), np.float32)
        block[owner[i:j], codes[i:j] - c] = 1
        out += block @ block.T
    return out.astype(np.int64)


def full_sets(rows: DataFrame, sets: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_id, hashes) of the set_ids in ``wanted`` (node), from one row of each."""
    chosen = sets.groupBy("set_id").agg(F.min(F.struct("doc_id", "row_key")).alias("one"))
    one = wanted.join(chosen, wanted["node"] == chosen["set_id"]).select("set_id", F.col("one")["doc_id"].alias("__d"), F.col("one")["row_key"].alias("__k"))
    texts = one.join(rows.select("doc_id", "row_key", "text"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row_key") == F.col("__k"))).select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column("text")):
                v, at = _sets(s, words)
                yield pa.RecordBatch.from_arrays([b.column("set_id").slice(s.first, s.n), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v))], names=["set_id", "hashes"])

    # Rows that share a doc_id and a text give the same set.
    return texts.mapInArrow(run, "set_id long, hashes array<long>").dropDuplicates(["set_id"])


def _linked(x: str, y: str, percent: int) -> F.Column:
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def part_edges(sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between members of different parts of a group. parts: (set_id, component, part) of groups with several parts."""
    part = parts.groupBy("component", "part").agg(F.count("*").alias("n"))
    counted = part.groupBy("component").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("all"))
    counted = counted.select("component", F.col("main")["part"].alias("main"), F.col("main")["n"].alias("n_main"), (F.col("all") - F.col("main")["n"]).alias("n_rest"))
    members = parts.join(counted, "component").join(sets, "set_id")
    main, rest = members.where("part = main"), members.where("part != main")
    met = grid(main, rest, "component", "set_id", "n_main", "n_rest", SET_BLOCK).unionByName(blocked(rest, "component", "set_id", "n_rest", SET_BLOCK, dealt=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            ids, group, side, part = (b.column(c).to_numpy() for c in ("set_id", "group", "side", "part"))
            at = np.r_[0, np.cumsum(b.column("hashes").value_lengths().to_numpy())]
            flat = b.column("hashes").flatten().to_numpy()
            a, c = [], []
            cut = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]
            for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                if j - i > 1:
                    inter = _common([flat[at[k] : at[k + 1]] for k in range(i, j)])
                    n = np.diag(inter)
                    linked = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
                    x, y = np.nonzero(np.triu(linked, 1))
                    ok = ((side[i] < 0) | (side[i + x] != side[i + y])) & (part[i + x] != part[i + y])
                    root = forest(j - i, x[ok], y[ok])
                    k = np.flatnonzero(root != np.arange(j - i))
                    a.append(ids[i + k])
                    c.append(ids[i + root[k]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])

    dealt = met.select("group", "side", "set_id", "part", "hashes").repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(run, "a long, b long")


def verified(rows: DataFrame, sets: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of exactly the set_ids joined by similarities of ``percent`` or more, for edges (a, b) that connect all likely ones."""
    groups = materialise(connected_components(candidates), "groups")
    hashes = materialise(full_sets(rows, sets, groups, words), "hashes")
    x, y = hashes.select(F.col("set_id").alias("a"), F.col("hashes").alias("x")), hashes.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    sure = materialise(candidates.join(x, "a").join(y, "b").where(_linked("x", "y", percent)).select("a", "b"), "sure")
    # Parts that the candidates' own links leave: a group of several is looked at again.
    found = connected_components(sure)
    parts = groups.join(found.withColumnRenamed("component", "part"), "node", "left").select(F.col("node").alias("set_id"), "component", F.coalesce("part", "node").alias("part"))
    several = parts.groupBy("component").agg((F.min("part") != F.max("part")).alias("open")).where("open").select("component")
    open_parts = materialise(parts.join(several, "component", "left_semi"), "parts")
    if open_parts.isEmpty():
        return found
    more = part_edges(hashes, open_parts, percent)
    return connected_components(sure.union(more))


def _groups(rows: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the sketches of all rows, and for each set_id with words: component, a set_id as well, and one, the first of its rows; null ids last)."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"INDEXED values of a sketch find links from {LEAST_PERCENT} % up, not from {percent} %")
    sets = materialise(sketches(rows, words), "sketches")
    classes = sets.where("n > 0").groupBy("set_id", "n").agg(F.first("sketch").alias("sketch"))
    candidates = candidate_edges(materialise(classes, "classes"), percent / 100)
    linked = verified(rows, sets, materialise(candidates.distinct(), "candidates"), words, percent)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")).alias("one")
    named = sets.where("n > 0").groupBy("set_id").agg(one)
    return sets, named.join(linked, named["set_id"] == linked["node"], "left").select("set_id", F.coalesce("component", "set_id").alias("component"), "one")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with n_shingles, component_id (the smallest doc_id that links reach) and kept (it is this row's).

    Of rows that share the smallest doc_id all are kept.
    """
    sets, named = _groups(documents(docs, RESULTS), words, percent)
    least = named.groupBy("component").agg(F.min("one")["doc_id"].alias("component_id"))
    names = named.join(least, "component").select("set_id", "component_id")
    found = sets.where("n > 0").select("doc_id", "row_key", "set_id", "n").join(names, "set_id").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "component_id")
    found = found.union(sets.where("n = 0").select("doc_id", "row_key", F.lit(0).cast("long"), F.col("doc_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id; all columns pass through.

    Among rows that share it, and in groups without ids, row_key chooses; of rows with one doc_id and text, a hash of their other columns.
    """
    rows = documents(docs)
    sets, named = _groups(rows, words, percent)
    chosen = named.groupBy("component").agg(F.min("one").alias("chosen"))
    keys = sets.where("n > 0").groupBy("set_id", "doc_id", "row_key").agg(F.count("*").alias("copies"))
    keys = keys.join(named.join(chosen, "component").select("set_id", "chosen"), "set_id")
    first = F.col("doc_id").eqNullSafe(F.col("chosen")["doc_id"]) & (F.col("row_key") == F.col("chosen")["row_key"])
    # Rows that go, and those (``again``) of which one comes back.
    out = materialise(keys.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), first.alias("again"), "copies").where("not again or copies > 1"), "gone")
    same = rows["doc_id"].eqNullSafe(out["__d"]) & (rows["row_key"] == out["__k"])
    left = rows.join(out, same, "left_anti")
    repeated = rows.join(out.where("again"), same, "left_semi").groupBy("doc_id", "row_key").agg(F.min_by(F.struct("text", "rest"), F.xxhash64(F.to_json("rest"))).alias("row"))
    return restored(left.unionByName(repeated.select("doc_id", "row_key", "row.text", "row.rest")), docs)
