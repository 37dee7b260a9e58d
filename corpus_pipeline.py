"""The corpus pipeline: documents to packed training windows in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, neardup, packing, quality, substrings
from lodestrata.llm.common import materialise


#: Bytes of an Arrow batch between Spark and Python: a stage's tasks hold a few of them at once.
BATCH = "8m"


def lean(spark: SparkSession) -> None:
    """Keeps batches small in this session, whose texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def carried(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __row): all other columns in one struct, so that none can clash with an operator's results."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *others).alias("__row"))


def returned(out: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from ``carried`` rows, but ``new`` ones where given."""
    return out.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col("__row")[c].alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line chain, trained on labelled rows, takes for bad."""
    lean(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return returned(quality.score(carried(docs), model).where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near duplicates (five words, 0.8)."""
    lean(spark)
    return neardup.keep_one(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words covered by 20-word windows that start earlier too; documents left without a word go. n_chars follows the text."""
    lean(spark)
    out = substrings.remove_repeats(carried(docs), width=20).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("__row")["n_chars"])
    return returned(out, docs, n_chars=n_chars)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (five words, 0.8 of its shingles)."""
    lean(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens in which every source has its share: their pieces with the token ids (``packing.sequences`` joins them)."""
    lean(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), width=1024, with_ids=True)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: Tokenization, the trained classifier and components by iteration have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
