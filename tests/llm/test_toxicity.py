"""The index against all similarities, scores against a plain second computation, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestrata.llm.bytetext import slices
from lodestrata.llm.toxicity import BlockMax, monotone, score, term_runs, train


def test_search_equals_all_similarities():
    rnd = np.random.default_rng(1)
    for size in (4, 64):
        vectors = []
        for _ in range(300):
            t = np.sort(rnd.choice(12, rnd.integers(1, 5), replace=False))
            w = rnd.integers(1, 4, len(t)).astype(float)
            vectors.append((t, w / np.sqrt((w * w).sum())))
        index, dense = BlockMax(vectors, size), np.zeros((300, 14))
        for i, (t, w) in enumerate(vectors):
            dense[i, t] = w
        for i, (t, w) in enumerate([*vectors[:60], (np.array([3, 13]), np.array([0.6, 0.8])), (np.array([13]), np.ones(1))]):
            q = np.zeros(14)
            q[t] = w
            sims = dense @ q
            if i < 60:
                sims[i] = 0
            found, got = index.search(t, w, 7, leave=i if i < 60 else -1)
            kth = np.sort(sims)[-7]
            want = set(np.flatnonzero((sims >= kth - 1e-9) & (sims > 0)))
            assert set(found) == want and np.allclose(got, sims[found]) and (np.diff(got) < 1e-9).all()


def terms_of(text):
    runs = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return Counter([*runs, *(w[:n] + "*" for w in runs for n in range(3, 9) if len(w) > n)])


def test_terms():
    for text in ["", "Idiot$$$ ÉtéÜber_x9\tab", "a" * 20 + " ééééé", " x"]:
        got = Counter()
        for s in slices(pa.array([text])):
            _, start, end, _, kind = term_runs(s)
            got.update(s.data[i:j].tobytes().decode() + "*" * min(1, int(k)) for i, j, k in zip(start, end, kind, strict=True))
        plain = Counter({re.sub("[A-Z]", lambda m: m[0].lower(), k): 0 for k in got})
        for k, v in got.items():
            plain[re.sub("[A-Z]", lambda m: m[0].lower(), k)] += v
        assert plain == terms_of(text)


def test_pools_ascend():
    x, y = np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0])
    at, chance = monotone(x, y, 0.4)
    assert (np.diff(at) >= 0).all() and (np.diff(chance) >= 0).all() and chance[0] == 0.4 / 2 and chance[-1] == 1.4 / 2
    assert len(monotone(x[:0], y[:0], 0.4)[0]) == 0


def corpus(n=400):
    rnd = np.random.default_rng(5)
    plain, bad = [f"word{i:02d}" for i in range(60)], ["zorgle", "fnordy", "blech"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = list(rnd.choice(plain, rnd.integers(3, 40)))
        for b in rnd.choice(bad, 2) if toxic else []:
            w.insert(rnd.integers(len(w) + 1), b + rnd.choice(["", "!!", "$$$"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores_equal_second_computation(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = train(docs, spark.createDataFrame(labels[:300], "doc_id long, toxic int"), k=5)
    names = set(model.names)
    assert any(n.rstrip("*") and "zorgle".startswith(n.rstrip("*")) for n in names)
    counts = {d: Counter({t: c for t, c in terms_of(x).items() if t in names}) for d, x in rows}
    idf = {t: math.log((1 + len(rows)) / (1 + sum(t in c for c in counts.values()))) + 1 for t in names}

    def vector(c):
        w = {t: (1 + math.log(f)) * idf[t] for t, f in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    examples = [(d, y, vector(counts[d])) for d, y in labels[:300] if counts[d]]
    base = sum(y for _, y in labels[:300]) / 300
    for r in score(docs, model).collect():
        assert set(r.terms) == set(counts[r.doc_id])
        if not counts[r.doc_id]:
            assert r.score == model.without and r.evidence == []
            continue
        v = vector(counts[r.doc_id])
        sims = [(sum(x * e.get(t, 0) for t, x in v.items()), y, d) for d, y, e in examples]
        kth = sorted(s for s, *_ in sims)[-5]
        votes = [(1 / (0.1 + 1 - min(1, s)), y) for s, y, _ in sims if s >= kth - 1e-9 and s > 0]
        share = (sum(w * y for w, y in votes) + base) / (sum(w for w, _ in votes) + 1)
        assert abs(model.chance(share) - r.score) < 1e-6 and r.predicted == (r.score >= 0.5)
        assert all(abs(e.similarity - next(s for s, _, d in sims if d == e.doc_id)) < 1e-6 for e in r.evidence)
    held = [(r.predicted, labels[r.doc_id][1]) for r in score(docs, model).collect() if r.doc_id >= 300]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_odd_rows(spark):
    rows, labels = corpus(100)
    odd = [(1000, None, 0.1), (1001, "", 0.2), (None, "zorgle", None), (1002, "word01 " * 300_000 + "zorgle", 0.3), (1003, "###", 0.4)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + rows[:5]] + odd, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (1000, 0), (1002, None), (77_777, 1)], "doc_id long, toxic int")
    model = train(docs, lab)
    out = score(docs, model).collect()
    assert len(out) == 110 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1000].score == by[1001].score == by[1003].score == model.without and by[1000].text is None
    assert by[1002].terms and by[1002].predicted == 1
    assert {r.score for r in score(docs, train(docs, lab.limit(0))).collect()} == {0.5}
    assert score(docs.limit(0), model).count() == 0 and train(docs.limit(0), lab) is None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    from lodestrata.llm.queries import op12_toxicity

    got = {r.doc_id: r for r in op12_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    held = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert np.mean([p for p, y in held if y]) > 0.85
    assert np.mean([p for p, y in held if not y]) < 0.02
