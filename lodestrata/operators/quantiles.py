"""Quantiles of sliding windows by counts over ranks: a day enters and leaves in logarithmic time, and no window is sorted again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of one task, besides the window before them.
CHUNK = 4096


class Ranked:
    """A multiset of known values as a binary indexed tree of counts by rank."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.top = 1 << max(len(self.values), 1).bit_length()
        self.tree = [0] * (self.top + 1)

    def add(self, rank: int, times: int) -> None:
        i = rank + 1
        while i <= self.top:
            self.tree[i] += times
            i += i & -i

    def smallest(self, k: int) -> float:
        """The (k + 1)-th smallest value."""
        at, step = 0, self.top
        while step:
            if at + step <= self.top and self.tree[at + step] <= k:
                at += step
                k -= self.tree[at]
            step >>= 1
        return float(self.values[at])


def sliding_quantiles(x: np.ndarray, history: int, probabilities: tuple[float, ...]) -> list[list[float] | None]:
    """For every place the linearly interpolated quantiles of the ``history`` values up to it; None if one of them is missing (NaN)."""
    held = Ranked(x[~np.isnan(x)])
    rank = np.searchsorted(held.values, x)
    gap, out = history, []
    for i, v in enumerate(x):
        if i >= history and not np.isnan(x[i - history]):
            held.add(int(rank[i - history]), -1)
        if np.isnan(v):
            gap = history + 1
        else:
            held.add(int(rank[i]), 1)
        gap -= 1
        if gap > 0:
            out.append(None)
            continue
        row = []
        for p in probabilities:
            place = p * (history - 1)
            lo, hi = int(np.floor(place)), int(np.ceil(place))
            a = held.smallest(lo)
            row.append(a if lo == hi else (hi - place) * a + (place - lo) * held.smallest(hi))
        out.append(row)
    return out


def rolling_quantiles(rows: DataFrame, by: str, order: str, value: str, history: int, probabilities: tuple[float, ...], chunk: int = CHUNK) -> DataFrame:
    """(by, order, q): for each row the quantiles of its last ``history`` values of ``value``; null if there are fewer or one is null.

    The rows of one ``by`` are dealt in chunks of days, each with the window before it, so that no task holds a whole history.
    """
    at = (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).alias("__at")
    place = rows.select(by, order, F.col(value).cast("double").alias("__x"), at)
    dealt = place.withColumn("__chunk", F.explode(F.sequence(F.floor(F.col("__at") / chunk), F.floor((F.col("__at") + history - 1) / chunk))))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (by, order))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        q = sliding_quantiles(pdf["__x"].to_numpy(float), history, probabilities)
        own = (pdf["__at"] // chunk == pdf["__chunk"]).to_numpy()
        return pd.DataFrame({by: pdf[by], order: pdf[order], "q": pd.Series(q, index=pdf.index, dtype=object)})[own]

    return dealt.groupBy(by, "__chunk").applyInPandas(run, f"{kinds}, q array<double>")
