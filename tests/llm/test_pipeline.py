"""The stages in turn, each against the brute force of its operator on what the one before kept."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from lodestrata.llm.common import materialise
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_decontamination import brute as leaks
from .test_neardup import brute as near
from .test_repeats import SPACE, words_kept


def words_hash(text):
    return hashlib.sha256(b" ".join(SPACE.findall((text or "").encode()))).hexdigest()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    out = materialise(stage["quality"](spark, docs, sf_dir), "t")
    assert out.columns == columns
    kept = set(ids(out))
    assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)

    rows = [(r.doc_id, r.text) for r in out.collect()]
    out = materialise(stage["near_dedup"](spark, out, sf_dir), "t")
    assert out.columns == columns and ids(out) == sorted(d for d, _, _, k in near(rows, 5, 80) if k)

    rows = [(r.doc_id, r.text) for r in out.collect()]
    out = materialise(stage["substring_dedup"](spark, out, sf_dir), "t")
    want = {d: h for d, n, gone, h in words_kept(rows, 20) if gone == 0 or gone < n}
    assert out.columns == columns and {r.doc_id: words_hash(r.text) for r in out.collect()} == want
    assert all(r.n_chars == len(r.text) for r in out.collect())

    rows = [(r.doc_id, r.text) for r in out.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = materialise(stage["decontamination"](spark, out, sf_dir), "t")
    dirty = {d for d, *_ in leaks(rows, items)}
    assert out.columns == columns and ids(out) == sorted(d for d, _ in rows if d not in dirty)

    pieces = stage["packing"](spark, out, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(ids(out))
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, pieces.collect()), key=str)


def test_packing_gives_the_tokens(spark):
    rows = [(1, "a b c", "x"), (2, "some words " * 900, "y"), (3, None, None)]
    out = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id] = got.get(r.doc_id, b"") + r.ids
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {d: np.frombuffer(x, "<u4").tolist() for d, x in got.items()} == {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t, _ in rows}


def test_stages_take_nulls_clashing_names_long_texts_and_empty_tables(spark, sf_dir, tmp_path):
    """Each case has a row after the filters that let it through, all columns pass, and no stage fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(260_000))
    odd = [(None, None, None, None, None), (900_001, "", "en", "web", 0), (900_002, long_text, "en", None, len(long_text)), (None, "a few plain words", None, "web", 17), (900_003, "same row", "en", "web", 8), (900_003, "same row", "en", "web", 8)]
    extra = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(30).union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    extra = extra.withColumn("n_removed", F.lit("mine")).withColumn("kept", F.lit(True)).withColumn("predicted", F.lit("x")).withColumn("item_id", F.lit(3)).repartition(3)
    assert len(long_text) > 2 << 20
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, extra, sf_dir), name)
        if name != "packing":
            assert out.columns == extra.columns and out.select("n_removed").distinct().collect() == [("mine",)]
        if name in ("near_dedup", "substring_dedup", "decontamination"):
            texts = [r.text for r in out.collect()]
            assert None in texts and "" in texts and long_text in texts
            assert texts.count("same row") == (1 if name == "near_dedup" else 2)
    none = extra.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
