"""What several text operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, results: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (long), text (null: empty), row_key (tells apart rows which share a doc_id but not a text), and all other
    columns as one struct ``rest``, out of the way (with whether the text was null); those named as in ``results`` are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`") for c in df.columns if c not in ("doc_id", "text", *results)]
    rest = F.struct(F.col("text").isNull().alias("__null"), *others)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.crc32(text.cast("binary")) - 2**31).cast("int").alias("row_key"), rest.alias("rest"))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``rest`` back in their own names and in the order of ``like``, null texts null again; new ones after them."""
    kept = [c for c in df.schema["rest"].dataType.names if c != "__null"]
    own = [c for c in like.columns if c in kept or c in df.columns]
    text = F.when(~F.col("rest")["__null"], F.col("text")).alias("text")
    return df.select(*[F.col("rest")[c].alias(c) if c in kept else text if c == "text" else F.col(f"`{c}`") for c in own], *[c for c in df.columns if c not in (*own, "rest", "row_key")])


def per_node(df: DataFrame, key: str, *aggs) -> DataFrame:
    """``aggs`` by ``key``, grouped by a struct of it: a join by the key then deals both sides out anew, so that Spark can
    split the rows of a very common key over tasks."""
    return df.groupBy(F.struct(key).alias("__k")).agg(*aggs).withColumn(key, F.col("__k")[key]).drop("__k")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    Alternates large-star and small-star steps until nothing changes: every node hands its larger, then its smaller, neighbours
    to the smallest one, which converges in few rounds whatever the shape. Edges pass through written
    tables, never through the driver. Neighbours are counted with partial sums, and a hub's links can be split over tasks in the join back.
    """
    norm = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(norm, "edges")
    before = None
    while True:
        # Large star: of a node's neighbours the larger ones point to the smallest of all (itself included).
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = per_node(both, "a", F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller ones, and the node itself, point to the smallest.
        large = large.where("a != b").distinct()
        low = per_node(large, "a", F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = materialise(small.where("a != b").distinct(), "edges")
        left = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (left["n"], left["h"]) == before:
            break
        before = (left["n"], left["h"])
    member = now.groupBy("a").agg(F.min("b").alias("component"))
    root = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return member.select(F.col("a").alias("node"), "component").union(root)
