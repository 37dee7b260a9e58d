"""Inverted lists as sorted partitions: a long list is cut into blocks whose pairs are separate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked(rows: DataFrame, key: str, member: str, size: str, block: int, dealt: bool = True) -> DataFrame:
    """``rows`` with ``group`` and ``side``, in partitions sorted by group (``dealt``; else as they come).

    A list (all rows of one ``key``; ``size`` of them) of at most ``block`` rows is one group. A longer one is dealt by a hash of ``member`` into blocks;
    each two blocks are a group (sides 0 and 1), and each block by itself one, so every two members meet exactly once
    and no task holds more than two blocks at a time.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(5)), F.col("__blocks")).cast("int")
    out = rows.withColumn("__blocks", blocks).withColumn("__own", own)
    out = out.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    x, y = F.least("__own", "__other"), F.greatest("__own", "__other")
    out = out.withColumn("group", F.xxhash64(key, x, y)).withColumn("side", F.when(x == y, F.lit(-1)).otherwise((F.col("__own") == y).cast("int")).cast("int"))
    out = out.drop("__blocks", "__own", "__other")
    return out.repartition("group").sortWithinPartitions("group") if dealt else out


def grid(left: DataFrame, right: DataFrame, key: str, member: str, n_left: str, n_right: str, block: int) -> DataFrame:
    """The rows of both with ``group`` and ``side`` (0 and 1): each block of a key's left rows meets each block of its right ones.

    A left row is copied once for every ``block`` right rows of its key, and the other way round.
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    own = lambda n: F.pmod(F.xxhash64(member, F.lit(5)), blocks(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    a = left.withColumn("__x", own(n_left)).withColumn("__y", all_(n_right)).withColumn("side", F.lit(0))
    b = right.withColumn("__y", own(n_right)).withColumn("__x", all_(n_left)).withColumn("side", F.lit(1))
    return a.unionByName(b).withColumn("group", F.xxhash64(F.lit("grid"), key, "__x", "__y")).drop("__x", "__y")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "group") -> Iterator[pa.RecordBatch]:
    """Record batches of rows sorted by ``key``, cut anew so that no key's rows are parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        start = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        same = bool(held) and held[-1].column(key)[0].as_py() == k[0]
        if held and (start or not same):
            cut = int(np.flatnonzero(k == k[0])[-1]) + 1 if same else 0
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
            if cut < start:
                yield b.slice(cut, start - cut)
        elif start:
            yield b.slice(0, start)
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pairs(group: np.ndarray, side: np.ndarray, most: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i < j, of every two rows that share a group and are to meet there, some ``most`` at a time."""
    n = len(group)
    if not n:
        return
    end = np.searchsorted(group, group, side="right") if (group[1:] >= group[:-1]).all() else None
    if end is None:
        raise ValueError("rows are not sorted by group")
    later = end - np.arange(n) - 1
    upto = np.cumsum(later)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, side="right")))
        a = np.repeat(np.arange(i, j), later[i:j])
        first = np.cumsum(later[i:j]) - later[i:j]
        b = np.arange(len(a)) - np.repeat(first, later[i:j]) + a + 1
        ok = (side[a] < 0) | (side[a] != side[b])
        yield a[ok], b[ok]
        i = j


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that links (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
