"""Repeated word windows and byte strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from lodestrata.llm import suffixes
from lodestrata.llm.substrings import longest_repeats, remove_repeats

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(5)
    word = lambda n: " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randrange(40)) for _ in range(n))
    passage, base = word(60), word(300)
    out = [None, "", "one", "w " * 200, "w " * 45, base, base, base.replace(" ", "\n")]
    for i in range(12):
        w = base.split()
        for _ in range(4):
            w[rnd.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    out += [word(rnd.randrange(80)) + " " + passage[: rnd.randrange(100, len(passage))] + " " + word(rnd.randrange(50)) for _ in range(30)]
    return out + [word(40) for _ in range(20)] + ["ß é " * 30 + word(20), word(3000) + " " + passage, " ".join(base.split()[k] for k in range(150, 300)) * 2]


def words_kept(docs, width):
    """docs: (doc_id, text); what stays, by the contract's words alone."""
    first, all_words = {}, [[w for w in SPACE.findall((t or "").encode())] for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    for i in order:
        w = all_words[i]
        for p in range(len(w) - width + 1):
            k, at = tuple(w[p : p + width]), ((docs[i][0] is not None, docs[i][0] or 0), p)
            first[k] = min(first.get(k, at), at)
    out = []
    for (d, _), w in zip(docs, all_words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < ((d is not None, d or 0), p):
                gone[p : p + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("width", [20, 7, 64])
def test_substrings_match_brute_force(spark, width):
    docs = list(enumerate(texts())) + [(None, texts()[5]), (9, texts()[9]), (9, texts()[9]), (3, texts()[30])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_removed int, `a.b` string").repartition(4)
    out = remove_repeats(df, width)
    assert {"a.b", "n_words"} <= set(out.columns)
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(b" ".join(SPACE.findall((r.text or "").encode()))).hexdigest()) for r in out.collect()]
    assert sorted(got, key=key) == sorted(words_kept(docs, width), key=key)


def test_query_matches_brute_force(spark, sf_dir):
    from lodestrata.llm.queries import op10_substrings

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in op10_substrings(spark, sf_dir).collect()]
    assert sorted(got) == sorted(words_kept(docs, 20))


def test_doubling_goes_on_until_none_survive(spark):
    w = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(w[:100])), (2, " ".join(w[:85] + ["x"] + w[90:100])), (3, " ".join(w[300:345])), (4, "z " + " ".join(w[300:345])), (5, " ".join(w[200:230]))]
    got = {r.doc_id: r.longest for r in longest_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 20).collect()}
    assert got == {1: 80, 2: 80, 3: 40, 4: 40}


def bytes_kept(docs, width):
    """docs: (doc_id, text); every byte of a string that starts anywhere else too goes."""
    raw = [(t or "").encode() for _, t in docs]
    times = Counter(b[p : p + width] for b in raw for p in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if times[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("width", "most"), [(400, 1024), (100, 1024), (100, 3), (400, 2), (100, 1)])
def test_suffixes_match_brute_force(spark, width, most):
    docs = list(enumerate(texts())) + [(None, texts()[5]), (9, texts()[9]), (9, texts()[9]), (3, texts()[30])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_removed int, `a.b` string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove_repeats(df, width, most).collect()]
    assert sorted(got, key=key) == sorted(bytes_kept(docs, width), key=key)


def test_suffix_query_matches_brute_force(spark, sf_dir):
    from lodestrata.llm.queries import op5_suffixes

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op5_suffixes(spark, sf_dir).collect()) == sorted(bytes_kept(docs, 400))


@pytest.mark.parametrize("shallow", [0, 8, 64])
def test_deep_shallow_order(shallow):
    rnd = random.Random(1)
    for _ in range(60):
        s = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(50))) * rnd.choice([1, 1, 3]) for _ in range(rnd.randrange(1, 40))]
        assert [s[i] for i in suffixes.deep_shallow_order(s, shallow)] == sorted(s)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(none).count() == 0 and remove_repeats(none).count() == 0 and longest_repeats(none).count() == 0
