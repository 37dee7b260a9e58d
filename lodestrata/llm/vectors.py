"""Embedding near-dedup through a pivot-permutation index.

Pivots are a bounded sample of the vectors (twice the root of their number, 32 to 4096 of them, those with the smallest hashes). A vector
is described by its DESCRIBED nearest pivots in order; the first LISTED of them are inverted lists that it goes into. Within a list two vectors
meet; the pivots that their descriptions share are counted, and those that share at least SHARED are verified by cosine
in double precision. Each pair counts once, in the list of the smallest pivot that both are listed under. Lists of any length are cut into
blocks whose pairs meet in separate tasks. What leaves a task are, per vector, how many links it has and a spanning forest.

Equal vectors are one class with a weight, so a very common vector is compared once. Every vector is indexed; the index is approximate (the
tests measure its recall, and no pair below the threshold is ever linked).

Vectors that are null, zero, or hold null or non-finite components link with nothing, equal ones included; so do vectors of another length than
the most common one's with those. A null vec_id never names a component. An empty table gives no rows. Only vec_id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise
from .lists import blocked, forest, whole_groups

DESCRIBED, LISTED, SHARED = 10, 6, 2
LIST_BLOCK = 1024
LEAST_PIVOTS, MOST_PIVOTS = 32, 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither tiny nor huge components lose the direction."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable() -> F.Column:
    """The vector as doubles (-0.0 as 0.0), or null if it can't link."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(fine, v)


def classes(vectors: DataFrame) -> DataFrame:
    """(class, vec, copies, dims): the distinct vectors that can link. class: a hash of the vector."""
    found = vectors.select(_usable().alias("vec")).where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"))
    return found.select(F.xxhash64("vec").alias("class"), "vec", "copies", F.size("vec").alias("dims"))


def describe(distinct: DataFrame) -> DataFrame:
    """``distinct`` with the numbers of each vector's nearest pivots in order, by dimension."""
    spark = distinct.sparkSession
    index = {}
    for r in distinct.groupBy("dims").count().collect():
        m = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * r["count"] ** 0.5)))
        chosen = distinct.where(F.col("dims") == r["dims"]).orderBy(F.xxhash64("class"), "class").limit(m).select("vec").collect()
        index[r["dims"]] = _unit(np.array([x["vec"] for x in chosen], np.float64))
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                pivots = shared.value[int(d)]
                cos = _unit(_matrix(part.column("vec"))) @ pivots.T
                k = min(DESCRIBED, len(pivots))
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cos, near, 1), axis=1, kind="stable"), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "near"])

    return distinct.mapInArrow(run, "class long, vec array<double>, copies long, dims int, near array<int>")


def _sharing(near: np.ndarray, pivot: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows ``x`` against rows ``y`` of the list of ``pivot``: whether they share at least SHARED pivots and are listed together under
    no smaller one. Shared pivots are counted as products of 0-1 matrices over the pivots that occur here."""
    names, at = np.unique(near, return_inverse=True)
    at = at.reshape(near.shape)
    held, listed = (np.zeros((len(near), len(names)), np.float32) for _ in range(2))
    np.put_along_axis(held, at, 1, 1)
    np.put_along_axis(listed, at[:, :LISTED], 1, 1)
    held, listed = held[:, names >= 0], listed[:, (names >= 0) & (names < pivot)]
    return (held[x] @ held[y].T >= SHARED) & (listed[x] @ listed[y].T == 0)


def _links(described: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): from each list, for class a, the class b that stands for its piece of the forest and the vectors it links to."""
    rows = described.withColumn("pivot", F.explode(F.slice("near", 1, LISTED))).withColumn("list", F.xxhash64("dims", "pivot"))
    rows = rows.join(rows.groupBy("list").agg(F.count("*").alias("size")).where("size > 1"), "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            ids, copies, pivot = (b.column(c).to_numpy() for c in ("class", "copies", "pivot"))
            group, side = b.column("group").to_numpy(), b.column("side").to_numpy()
            k = b.column("near").value_lengths().to_numpy()
            near = np.full((len(ids), DESCRIBED), -1, np.int32)
            near[np.arange(DESCRIBED)[None, :] < k[:, None]] = b.column("near").flatten().to_numpy()
            flat, ends = b.column("vec").flatten().to_numpy(), np.r_[0, np.cumsum(b.column("vec").value_lengths().to_numpy())]
            links = np.zeros(len(ids), np.int64)
            left, right = [], []
            cut = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(ids)]
            for s, e in zip(cut, cut[1:]):
                own = side[s] < 0
                x, y = (np.arange(e - s),) * 2 if own else (np.flatnonzero(side[s:e] == v) for v in (0, 1))
                ok = _sharing(near[s:e], pivot[s], x, y)
                if own:
                    ok = np.triu(ok, 1)
                if not ok.any():
                    continue
                unit = _unit(flat[ends[s] : ends[e]].reshape(e - s, -1))
                i, j = np.nonzero(ok & (unit[x] @ unit[y].T >= threshold))
                i, j = s + x[i], s + y[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                left.append(i)
                right.append(j)
            if left:
                root = forest(len(ids), np.concatenate(left), np.concatenate(right))
                r = np.flatnonzero(links)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(ids[root[r]]), pa.array(links[r])], names=["a", "b", "links"])

    return blocked(rows, "list", "class", "size", LIST_BLOCK).select("group", "side", "pivot", "class", "copies", "near", "vec").mapInArrow(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = materialise(classes(rows), "vectors")
    links = materialise(_links(describe(distinct), threshold), "links")
    count = links.groupBy("a").agg(F.sum("links").alias("others"))
    component = connected_components(links.select("a", "b"))
    info = distinct.select("class", "copies").join(count, F.col("class") == count["a"], "left").join(component, F.col("class") == component["node"], "left")
    info = info.select("class", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    own = rows.select("vec_id", _usable().alias("vec")).select("vec_id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("class"))
    named = own.join(info, "class", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
