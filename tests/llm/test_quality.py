"""The chain against enumeration of all labellings, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
from lodestrata.llm.bytetext import slices
from lodestrata.llm.quality import line_features, marginals, score, train


def test_forward_backward_matches_enumeration():
    rnd = np.random.default_rng(0)
    at = np.array([0, 1, 5, 5, 8])
    unary, trans = rnd.normal(size=8) * 3, rnd.normal(size=(2, 2))
    good, pair = marginals(unary, trans, at)
    for i, j in itertools.pairwise(at):
        total, one, two = 0.0, np.zeros(j - i), np.zeros((j - i, 2, 2))
        for y in itertools.product((0, 1), repeat=int(j - i)):
            p = np.exp(sum(unary[i + k] * v for k, v in enumerate(y)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            total += p
            one += p * np.array(y)
            for k in range(1, len(y)):
                two[k, y[k - 1], y[k]] += p
        if j > i:
            assert np.allclose(good[i:j], one / total) and np.allclose(pair[i + 1 : j], two[1:] / total)


def test_lines_are_cut_at_newlines():
    texts = ["", "a b\n\nB c!", "\n", "x" * 50, "", "last\n"]
    sizes, counts = [], []
    for s in slices(pa.array(texts), 8):
        x, size, at = line_features(s)
        assert np.isfinite(x).all() and len(x) == at[-1]
        sizes += size.tolist()
        counts += np.diff(at).tolist()
    assert counts == [t.count("\n") + 1 for t in texts]
    assert sizes == [len(line) for t in texts for line in t.split("\n")]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    from lodestrata.llm.queries import op7_quality

    got = {r.doc_id: r for r in op7_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    held = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert np.mean([p == q for p, q in held]) > 0.95
    by = [np.mean([p == q for p, q in held if q == k]) for k in (0, 1)]
    assert min(by) > 0.9, by


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "\n" * 5000, "c"), (None, "text here", "d"), (4, "x " * 200_000, "e"), (4, "x " * 200_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    out = score(df, train(df, labels)).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in score(df, train(df, labels.limit(0))).collect()} == {0.5}
    assert score(df.limit(0), None).count() == 0
