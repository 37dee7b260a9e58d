"""Scores against plain counting, exact normalisation, and held-out likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from lodestrata.llm import lm
from lodestrata.llm.bytetext import slices
from lodestrata.llm.lm import initial, nce_epoch, normalisers, score
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(docs):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(t for (_, x), h in zip(docs, held, strict=True) if not h for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t := tokens(x)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, x), h in zip(docs, held, strict=True)]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def test_base_score_matches_counting(spark, sf_dir, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(None, "the the"), (5000, None), (5001, ""), (5002, "A a ÀÀ"), (5002, "other"), (5003, "twice rare-x"), (5003, "twice rare-x"), (5004, "word " * 50_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int").repartition(3)
    monkeypatch.setattr(lm, "HEAD", 500)
    got = score(df, held_out(), classes=200).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(brute(docs), key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert score(df.limit(0), held_out()).count() == 0


def test_held_out_text_is_likelier_than_under_the_base(spark):
    got = score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), held_out()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_partitions_do_not_change_the_model(spark, sf_dir, monkeypatch):
    """One, four and 32 partitions learn the same, also with several trainers and a text of several pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("doc_id < 300")
    docs = docs.union(spark.createDataFrame([(9000, "very long text " * 60_000), (9001, None), (9002, "")], docs.schema))
    monkeypatch.setattr(lm, "POSITIONS", 60_000)
    got = [{r.doc_id: r.score for r in score(docs.repartition(n), held_out(), classes=300).collect()} for n in (1, 4, 32)]
    assert len(got[0]) == docs.count()
    for other in got[1:]:
        assert all(math.isclose(x, other[d], rel_tol=1e-4, abs_tol=1e-4) for d, x in got[0].items())


def test_probabilities_sum_to_one():
    m = initial(np.arange(1, 41.0))
    m["q"] += 1
    one, two, z = normalisers(m, 1.0)
    p = np.exp(one[:, None, :].astype(float) + two[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def test_noise_contrast_learns_a_bigram():
    rnd = np.random.default_rng(0)
    seq = np.arange(20_000) % 5
    m = initial(np.full(5, 4000.0))
    hist = {k: np.full_like(v, 1e-6) for k, v in m.items()}
    for _ in range(20):
        nce_epoch(m, hist, seq[1:-1], seq[:-2], seq[2:], np.full(5, 0.2), rnd)
    one, two, z = normalisers(m, 1.0)
    logp = one[seq[1:-1], seq[2:]] + two[seq[:-2], seq[2:]] - z[seq[1:-1], seq[:-2]]
    assert logp.mean() > -0.2


def test_every_position_trains_but_those_held_back(spark, monkeypatch):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(60)], "doc_id long, text string").repartition(2)
    rows = lm.documents(df)
    counts = [(r.h, r.c) for r in lm.count_tokens(rows).orderBy(F.desc("c"), "h").collect()]
    table, freq, seen = lm.Table(counts, len(counts)), np.r_[[float(c) for _, c in counts], 0.0], []
    plain = normalisers
    monkeypatch.setattr(lm, "normalisers", lambda m, factor: seen.append(m) or plain(m, factor))
    lm.train(rows, table, freq)
    moved = (seen[0]["r"] != initial(freq)["r"]).any(1)
    trained = [r.text for r in rows.where(F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(16)) != 0).collect()]
    # A word's row moves only where a position that has it as context trains: each word is followed by one or two.
    assert 0 < len(trained) < 60 and moved[:-1].sum() == 9 * len(trained)


def test_score_equals_a_second_computation(spark, sf_dir, monkeypatch):
    """With given weights: every token's class by a softmax over all classes, and rarer words by their share of the last one, one at a time."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + [(7000, None), (7001, "never seen before"), (7001, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    weights = {}

    def train(rows, table, freq):
        rnd = np.random.default_rng(9)
        weights["m"], weights["freq"] = initial(freq), freq
        for k in weights["m"]:
            weights["m"][k] = (weights["m"][k] + rnd.normal(0, 0.3, weights["m"][k].shape)).astype(np.float32)
        return normalisers(weights["m"], 1.0)

    monkeypatch.setattr(lm, "train", train)
    monkeypatch.setattr(lm, "HEAD", 150)
    got = sorted((r.doc_id, r.n_tokens, r.score) for r in score(df, held_out(), classes=40).collect())
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    c = Counter(t for (_, x), h in zip(docs, held, strict=True) if not h for t in tokens(x))
    def of(text):
        (s,) = slices(pa.array([text or ""]))
        return lm._tokens(s)[0].view(np.int64).tolist()

    # Classes go by count, ties by hash.
    name = {t: of(t)[0] if t is not None else of("")[0] for t in c}
    hashes = sorted(((name[t], n) for t, n in c.items()), key=lambda x: (-x[1], x[0]))
    place = {h: i for i, (h, _) in enumerate(hashes[:40])}

    m, k = weights["m"], 40
    rest = sum(n for _, n in hashes[40:])
    kinds = len(hashes) - 40
    count = dict(hashes)
    want = []
    for d, x in docs:
        total, h = 0.0, of(x)
        cls = [place.get(t, k) for t in h]
        for i, t in enumerate(h):
            one, two = (cls[i - 1] if i else k + 1), (cls[i - 2] if i > 1 else k + 1)
            logits = (m["r"][one].astype(float) @ m["c"][0] + m["r"][two].astype(float) @ m["c"][1]) @ m["q"].T.astype(float) + m["b"]
            p = math.log10(math.exp(logits[cls[i]] - logits.max()) / np.exp(logits - logits.max()).sum())
            total += p + (math.log10((count.get(t, 0) + 1) / (rest + kinds + 1)) if cls[i] == k else 0)
        want.append((d, len(h), total))
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4) for a, b in zip(got, sorted(want), strict=True))
