"""Containment of benchmark items against brute force."""

import random

import pytest
from lodestrata.llm.decontamination import clean, contained

from .test_neardup import key, shingle_set


def brute(docs, items, words=5, percent=80):
    out = []
    for d, t in docs:
        own = shingle_set(t, words)
        for i, u in items:
            s = shingle_set(u, words)
            if s and 100 * len(s & own) >= percent * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(out, key=key)


@pytest.mark.parametrize("broadcast", [400_000, 50])
def test_matches_brute_force(spark, broadcast):
    rnd = random.Random(4)
    word = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(n)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([1, 3, 5, 6, 9, 15, 20, 40, 60, 60])] + [(90, None), (91, ""), (None, "x y z"), (9, "x y z")]
    docs = [(i, t) for i, (_, t) in enumerate(items)] + [(100, "x  Y\nz"), (None, "X y z"), (101, " ".join(word(5000)) + " " + items[8][1] + " " + " ".join(word(10)))]
    for i in range(60):
        w = items[rnd.randrange(5, 10)][1].split()
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "other"
        docs.append((200 + i, " ".join(word(rnd.randrange(300)) + w + word(rnd.randrange(300)))))
    docs += [docs[-1], docs[-1]]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in contained(df, bench, broadcast=broadcast).collect()), key=key) == want
    left = clean(df, bench, broadcast=broadcast)
    assert left.columns == df.columns and left.count() == sum(not brute([d], items) for d in docs)
    assert contained(df, bench.limit(0)).count() == 0 and contained(df.limit(0), bench).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    from lodestrata.llm.queries import op9_decontamination

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in op9_decontamination(spark, sf_dir).collect()]
    assert sorted(got) == brute(docs, items) and got
