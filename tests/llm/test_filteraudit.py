"""Filter audits against applying every order."""

import itertools
import random
import re

import duckdb

from lodestrata.llm.filteraudit import audit, failures
from lodestrata.llm.queries import ORACLE_SQL, op13_filter_audit


def fails(text, doc_id, least):
    w = re.findall("[^ \t-\r]+", text)
    out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (doc_id is not None and least is not None and doc_id > least)


def expected(rows, labels):
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = [(s or "", d, fails(t or "", d, least.get(t or ""))) for d, t, s in rows]
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x for x in docs if x[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                total[f] += len(gone)
                redundant = sum(f in x[2] for x in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(x[2] == f for x in own), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_equals_every_order(spark):
    rnd = random.Random(3)
    base = ["", None, "One two", "A B C", "x " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"W{i}" for i in range(70)), "a#b", "ü " * 10 + "É", "word " * 100_000, "p\x0bq\x1fr |"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(base) if rnd.random() < 0.7 else "T" * rnd.randrange(3) + " u" * rnd.randrange(90), rnd.choice(["s", "t", "", None])) for _ in range(150)]
    rows += rows[:10]
    labels = [(i % 37, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(60)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, True, 1) for r in rows], "doc_id long, text string, source string, A boolean, part int")
    out = audit(failures(docs, "source", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(map(tuple, out.collect())) == expected(rows, labels)
    none = audit(failures(docs, "source")).groupBy().sum("good_lost", "toxic_lost").first()
    assert tuple(none) == (0, 0)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(failures(docs, "source")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = op13_filter_audit(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({ORACLE_SQL['op13_filter_audit']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) != []
