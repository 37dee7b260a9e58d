"""Near duplicates against brute force over full sets."""

import random
import re

import pytest
from lodestrata.llm import neardup
from lodestrata.llm.common import connected_components
from lodestrata.llm.neardup import keep_one, near_duplicates

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, words):
    w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(docs, words, percent):
    sets = [shingle_set(t, words) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * inter >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(docs)]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def texts():
    rnd = random.Random(3)
    word = lambda n: [rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randrange(60)) for _ in range(n)]
    base, line = word(150), " ".join(word(12))
    out = [None, "", " \n", "One", "one", "A b", "a  B", " ".join(base), " ".join(base).upper(), "w " * 500]
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(9)}"
        out.append(" ".join(w))
    out += [line + " " + " ".join(word(rnd.randrange(20, 60))) for _ in range(60)]
    chain = word(80)
    for i in range(20):
        out.append(" ".join(chain[2 * i : 2 * i + 40]))
    return out


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 7)])
def test_matches_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(neardup, "LIST_BLOCK", block)
    monkeypatch.setattr(neardup, "SET_BLOCK", block)
    docs = [*enumerate(texts()), (None, "one"), (None, "nothing like it"), (70, "a b"), (71, texts()[71]), (71, texts()[71])]
    df = spark.createDataFrame([(d, t, "s", True) for d, t in docs], "doc_id long, text string, source string, kept boolean").repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, words, percent).collect()]
    want = [(d, n, c, k) for d, n, c, k in brute(docs, words, percent)]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = keep_one(df, words, percent)
    # One row of each group, however often it is repeated; rows without words stay. (Null ids: their groups are told apart by what is in them.)
    assert kept.columns == df.columns and kept.count() == len({c for _, n, c, _ in want if n and c is not None}) + sum(n > 0 and c is None for _, n, c, _ in want) + sum(not n for _, n, *_ in want)


def test_query_matches_brute_force(spark, sf_dir):
    from lodestrata.llm.queries import op6_minhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op6_minhash(spark, sf_dir).collect()) == sorted(brute(docs, 3, 85))


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 240)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 200 for i in range(200, 240)}, 300: 300, 301: 300, 302: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_keep_one_leaves_one_row_of_each_group(spark):
    rnd = random.Random(11)
    text = [" ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(500)) for _ in range(60)) for _ in range(5)]
    near_ = [x + " tail" for x in text]
    rows = [(1, text[0], "x"), (1, text[0], "x"), (1, text[0], "y"), (1, near_[0], "x"), (2, text[0], "x"), (1, text[1], "x"), (7, text[1], "x")]
    rows += [(None, text[2], "x"), (None, text[2], "x"), (None, near_[2], "z"), (None, text[3], "x"), (9, text[3], "x"), (4, text[4], "x"), (5, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = keep_one(df, 5, 80)
    assert got.columns == df.columns
    got = got.collect()
    groups = sorted(next((i for i in range(5) if (r.text or "").startswith(text[i])), -1) for r in got)
    assert groups == [-1, -1, 0, 1, 2, 3, 4]
    assert {r.doc_id for r in got if r.text} == {1, None, 9, 4} and sum(r.doc_id is None for r in got if r.text) == 1


def test_a_similarity_beyond_the_index_is_refused(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for f in (near_duplicates, keep_one):
        with pytest.raises(ValueError, match="77"):
            f(df, 3, 76)
        assert f(df, 3, 77).count() == 1
