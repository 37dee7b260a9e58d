"""Collocations against direct counting."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lodestrata.llm import phrases
from lodestrata.llm.phrases import collocations, exact_score
from lodestrata.llm.queries import ORACLE_SQL, op11_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, longest, least, covered, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        around = [b for (x, v), b in cand.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= covered * a for b in around):
            continue
        s, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))  # noqa: E741


@pytest.mark.parametrize(("longest", "batch"), [(2, 10_000), (3, 3), (4, 7)])
def test_equals_direct_counts(spark, longest, batch):
    rnd = random.Random(longest)
    words = ["the", "The", "of", "ab", "b\x01", "a", "Ünder", "x#", " y", "c\x00d"]
    rows = [(rnd.choice(["en", "de", None, ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rnd.randrange(0, 60)))) for _ in range(120)]
    rows += [("en", "new york city hall " * 30)] * 8 + [("en", None), (None, ""), ("fr", "..,\n"), ("de", "the of " * 20_000), ("xx", "once only")]
    df = spark.createDataFrame([(t, 1, lang, "n") for lang, t in rows], "text string, rank int, lang string, phrase string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = collocations(df, longest=longest, least=5, covered=50, top=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == expected(rows, longest, 5, 50, 40)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(df).collect() == []
    assert collocations(spark.createDataFrame([("en", None)], "lang string, text string")).collect() == []


def test_score_beyond_64_bits(spark):
    cases = [(3_000_000_007, 4_000_000_009, 5_000_000_029), (9 * 10**15, 9 * 10**15 + 1, 9 * 10**15 + 2), (10, 10, 10), (10, 10**12, 10**12)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    assert [r[0] for r in df.select(exact_score(df.a, df.l, df.r)).collect()] == [1_000_000 * a * a // (l * r) for a, l, r in cases]  # noqa: E741


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = op11_phrases(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLE_SQL['op11_phrases']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) != []


def test_suffixes_travel_by_first_word(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"the w{rnd.randrange(3000)}" if rnd.random() < 0.7 else f"of w{rnd.randrange(40)}" for _ in range(4000)) + ", the" for _ in range(3)]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    out = phrases.suffixes(df, 3).collect()
    found, want = Counter(), Counter()
    for r in out:
        words, counts = r.rest.split("\n"), memoryview(r.n).cast("i").tolist()
        assert len(words) == 2 * r["size"] + 1 and len(counts) == r["size"] <= phrases.ROW and sum(counts) == r.total
        for i, c in enumerate(counts):
            found[r.w1, words[2 * i], words[2 * i + 1]] += c
    for t in texts:
        for piece in t.split(","):
            w = piece.split()
            want.update(tuple((w[i : i + 3] + ["", ""])[:3]) for i in range(len(w)))
    assert found == want
    # A row for each suffix used to cross the shuffle and its sort.
    assert len(out) <= len({w for w, _, _ in want}) + len(want) // phrases.ROW + len(want) // phrases.BATCH + 2 < len(want) / 3


@pytest.mark.parametrize(("shares", "group"), [(1, 1 << 18), (4096, 300), (20, 1 << 18)])
def test_parts_of_common_first_words(spark, monkeypatch, shares, group):
    monkeypatch.setattr(phrases, "SHARES", shares)
    monkeypatch.setattr(phrases, "GROUP", group)
    rnd = random.Random(shares)
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice(["the", "the of", f"a{rnd.randrange(30)}", f"b{rnd.randrange(900)}"]) for _ in range(500))) for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(map(tuple, collocations(df, longest=3, least=5, top=60).collect())) == expected(rows, 3, 5, 50, 60)
