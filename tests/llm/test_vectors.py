"""The pivot-permutation index against all pairs."""

import numpy as np
import pytest
from lodestrata.llm import vectors
from lodestrata.llm.vectors import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in unit.items()}
    for a in ok:
        for b in ok:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, links[i], c := least.get(find(i)), k == c) for i, (k, _) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_odd_vectors(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=8).tolist()
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6), (5, [float("nan")] * 8), (6, [float("inf")] + [0.0] * 7), (7, v), (8, v), (9, [x * 1e-30 for x in v]), (10, [-x for x in v]), (None, v), (12, v[:4]), (12, v[:4]), (13, [0.0, 1.0] + [0.0] * 6), (14, [-0.0, 1.0] + [0.0] * 6)]
    got = near_duplicates(spark.createDataFrame([(k, x, 0) for k, x in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_whole_table_matches_brute_force(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(vectors, "LIST_BLOCK", block)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_recall_near_the_threshold(spark):
    """2,000 pairs of cosine 0.9 to 0.95 among 5,000 vectors: links found against all, none false."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rnd.normal(size=(2000, 64))
    other -= (other * x[:2000]).sum(1)[:, None] * x[:2000]
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rnd.uniform(0.902, 0.95, 2000)[:, None]
    rows = np.vstack([x, cos * x[:2000] + np.sqrt(1 - cos**2) * other])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], SCHEMA)
    unit = rows.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    true = ((unit @ unit.T >= 0.9).sum(1) - 1).astype(int)
    got = {r.vec_id: r.n_links for r in near_duplicates(df).collect()}
    assert all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.95 * true.sum()
