"""What each filter of a chain removes, for every subset and every order of the filters.

Every document gets a mask of the filters that it fails. Documents are counted by part and mask; a subset-zeta transform over a part's counts
(for each filter, add the count without its bit) gives at every mask the documents that fail nothing outside it, and so the survivors of every
subset of filters. A step of an order is the difference between two neighbouring subsets: the filters before it, and those with it. Labelled
documents are transformed beside the others.

After the count a part has ``2 ** filters`` rows, however many documents it holds, and partial sums make even one huge part cheap. Nothing is
collected: the transform and the differences are array expressions of a part's row.

Null text is empty, a null part is the empty string; empty and very long texts are judged whole; rows that share a doc_id count each, and are good
(toxic) if any of the labels of their doc_id says so; a null doc_id has no label and is nobody's copy. An empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_node

#: Names of the text conditions below in their order.
LETTERS = "ABCDE"


def text_failures(text: Column, min_words: int = 50, least_distinct: int = 65, most_upper: int = 5, symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """Whether a text fails A: too few words, B: too few distinct words (percent), C: too many capitals (percent of code points), D: holds a symbol."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * F.size(words),
        "C": 100 * upper > most_upper * F.length(text),
        "D": text.rlike(symbols),
    }


def failures(docs: DataFrame, part: str, labels: DataFrame | None = None) -> DataFrame:
    """(part, A to E, good, toxic) of every row; E: its text is that of a smaller doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    # The words are cut once, in a projection below the conditions; texts are compared by 256 bits of SHA-2, which no two of any corpus share.
    rows = docs.select(id_, F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("same"), *[c.alias(k) for k, c in text_failures(text).items()])
    # Only texts of two rows or more are joined back; a text that a third of all rows share is a hot key of a join that Spark can split.
    first = per_node(rows.select("same", "doc_id"), "same", F.min("doc_id").alias("least"), F.count("*").alias("times")).where("times > 1")
    rows = rows.join(first.select("same", "least"), "same", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    if labels is None:
        return rows.select("part", *LETTERS, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    said = labels.where("doc_id is not null").groupBy(F.struct(F.col("doc_id").cast("long").alias("id")).alias("k")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    said = said.select(F.col("k.id").alias("doc_id"), "good", "toxic")
    rows = rows.select("doc_id", "part", *LETTERS).join(said, "doc_id", "left")
    return rows.select("part", *LETTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _zeta_step(counts: Column, bit: int) -> Column:
    """``counts`` (an array of structs n, good, toxic by mask) with those of the mask without ``bit`` added where the mask has it."""

    def added(x: Column, mask: Column) -> Column:
        without = F.element_at(counts, F.greatest(mask + 1 - (1 << bit), F.lit(1)))
        has = F.shiftright(mask, bit).bitwiseAND(F.lit(1)) == 1
        return F.struct(*[(x[k] + F.when(has, without[k]).otherwise(F.lit(0))).alias(k) for k in ("n", "good", "toxic")])

    return F.transform(counts, added)


def subset_survivors(rows: DataFrame, filters: str) -> DataFrame:
    """(part, masks, inside): a part's counts by mask (bit i: fails the i-th filter), and their zeta transform: ``inside[m]`` fail nothing outside m."""
    mask = sum((F.col(k).cast("int") * (1 << i) for i, k in enumerate(filters)), F.lit(0))
    by_mask = rows.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    found = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    none = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("n", "good", "toxic")])
    every = F.transform(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)), lambda m: F.coalesce(F.col("found")[m], none))
    out = by_mask.groupBy("part").agg(found.alias("found")).select("part", every.alias("masks")).withColumn("z0", F.col("masks"))
    for bit in range(len(filters)):  # one projection a step, so that no step's expression holds the ones before
        out = out.withColumn(f"z{bit + 1}", _zeta_step(F.col(f"z{bit}"), bit))
    return out.select("part", "masks", F.col(f"z{len(filters)}").alias("inside"))


def audit(rows: DataFrame, filters: str = LETTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from ``rows`` (part, one boolean column per filter, good, toxic)."""
    k, full = len(filters), (1 << len(filters)) - 1
    states = [(s, f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    # A filter's weight in a subset: the orders that have just that subset before it.
    weight = {s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) for s, _ in states}
    parts = subset_survivors(rows, filters)
    moves = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(weight[s]).cast("long").alias("orders")) for s, f in states])
    left = lambda s: F.element_at("inside", (F.lit(full + 1) - s).cast("int"))  # noqa: E731  fails nothing of s
    edge = parts.withColumn("move", F.explode(moves)).select("part", "masks", "inside", "move.*")
    edge = edge.withColumn("was", left(F.col("before"))).withColumn("now", left(F.col("before") + F.col("bit")))
    edge = edge.select(
        "part", "before", "filter", "orders", F.col("now.n").alias("kept"), (F.col("was.n") - F.col("now.n")).alias("removed"),
        (F.element_at("inside", full + 1)["n"] - F.element_at("inside", (full + 1 - F.col("bit")).cast("int"))["n"]).alias("failing"),
        F.element_at("masks", (F.col("bit") + 1).cast("int"))["n"].alias("unique_fails"),
        (F.col("was.good") - F.col("now.good")).alias("good_lost"), (F.col("was.toxic") - F.col("now.toxic")).alias("toxic_lost"),
    )
    by_filter = edge.groupBy("part", "filter").agg(F.collect_list(F.struct("before", "orders", "kept", "removed", "failing", "unique_fails", "good_lost", "toxic_lost")).alias("edges"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    edge = by_filter.select("part", "filter", "shapley", F.inline("edges"))
    orders = [("".join(filters[i] for i in p), step + 1, sum(1 << i for i in p[:step]), p[step]) for p in itertools.permutations(range(k)) for step in range(k)]
    table = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    # An equal join on (subset, filter) with a fixed table of filters * filters! rows.
    return edge.join(F.broadcast(table), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
