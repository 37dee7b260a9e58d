"""Two-pass external shuffle into shards.

Pass 1 scatters every record by seeded hashes of (doc_id, text): the shard by rendezvous over the shards (doc_id and the shard
count decide alone, and one more shard takes rows only into itself), then one of the shard's buckets, as many as make
a bucket about ``bucket_bytes``. Pass 2 shuffles each bucket in memory by Fisher-Yates with a seed of its own and writes it.
A record's slot is its place in its bucket plus the rows of the shard's buckets before it (prefix sums over bucket counts).

Null text counts as empty (size 1); null doc_ids hash like any other value; repeated rows each keep a slot of their own (equal
(doc_id, text) pairs share a bucket); an empty table gives no rows. Input columns named like a result's are kept out of the way:
only doc_id and text are read. Law: ``key``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_folder
from .lists import whole_groups

MOST_TASKS = 1 << 15


def rendezvous(key, shards: int, seed: int):
    """The shard with the largest seeded hash of (key, shard)."""
    best = F.array_max(F.array(*[F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]))
    return best["s"]


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A permutation of range(n): position i swaps with a uniform one of those not yet fixed."""
    out = np.arange(n)
    pick = np.random.default_rng(seed & (2**63 - 1)).integers(0, np.arange(n, 0, -1)) + np.arange(n) if n else out
    for i, j in enumerate(pick.tolist()):
        out[i], out[j] = out[j], out[i]
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 24 << 20, folder: str | None = None) -> DataFrame:
    """Writes the shuffled records under ``folder`` (shard=K/...) and returns them with shard, bucket and slot."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), rendezvous(F.col("doc_id"), shards, seed).alias("shard"), F.pmod(F.xxhash64("doc_id", text, F.lit(seed + 1)), F.lit(1 << 30)).alias("scatter"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))
    rows = rows.withColumn("bucket", (F.col("scatter") % buckets).cast("int")).drop("scatter")
    def shuffled(table: pa.Table) -> pa.Table:
        # The arrival order differs from run to run; a fixed order first makes the shuffle repeatable.
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending")])
        table = table.take(pa.array(fisher_yates(table.num_rows, seed * 1_000_003 + table["group"][0].as_py())))
        return table.drop_columns(["key", "group"]).append_column("place", pa.array(np.arange(table.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            g = batch.column("group").to_numpy()
            cut = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            for i, j in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                yield from shuffled(pa.Table.from_batches([batch.slice(i, j - i)])).to_batches()

    kind = rows.schema["doc_id"].dataType.simpleString()
    # One task for each bucket (for several beyond MOST_TASKS).
    tasks = min(shards * buckets, MOST_TASKS)
    keyed = rows.withColumn("key", F.xxhash64(text)).withColumn("group", (F.col("shard") * F.lit(buckets) + F.col("bucket")).cast("long"))
    dealt = keyed.repartitionById(tasks, (F.col("group") % F.lit(tasks)).cast("int")).sortWithinPartitions("group")
    written = dealt.mapInArrow(run, f"doc_id {kind}, text string, size long, shard int, bucket int, place long")
    out = folder or new_folder(spark, "shards")
    written.write.option("compression", "zstd").partitionBy("shard").parquet(out)
    stored = spark.read.schema(f"doc_id {kind}, text string, size long, bucket int, place long, shard int").parquet(out)
    counts = stored.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base")), "bases")
    return stored.join(bases, ["shard", "bucket"]).select("doc_id", "text", "size", "shard", "bucket", (F.col("base") + F.col("place")).alias("slot"))
