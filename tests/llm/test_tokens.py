"""Packing, token files and sharding against the tokenizers library and plain Python."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from lodestrata.llm.packing import _pieces, _whole, pack, plan_windows, sequences
from lodestrata.llm.sharding import fisher_yates, rendezvous, shard
from lodestrata.llm.subwords import Encoder
from lodestrata.llm.tokenfiles import read_token_files, write_token_files
from tokenizers import Tokenizer

ODD = ["", None, "  a  b ", "\n\nfoo\n bar\t\tbaz  \n", "don't x's  's", "a  b  c", "<|endoftext|> hi", " ", "é è\r\n\r\nx", "ab,cd.  e,", "é, x×, ÷. é×,", "a|b | c", "Ab AB aB", "long " * 30_000, "same", "same"]
SCHEMA = "doc_id long, text string, source string, start long, n long, shard int"


def rows():
    out = [(i, t, ["a", "b", None][i % 3], 0, 0, 0) for i, t in enumerate(ODD)]
    return [*out, (None, "no id", "a", 0, 0, 0), (3, "twice", "b", 0, 0, 0), (3, "twice", "b", 0, 0, 0)]


def ids_of(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture
def documents(spark, sf_dir):
    odd = spark.createDataFrame(rows(), SCHEMA)
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "source")
    return odd.unionByName(real, allowMissingColumns=True)


def test_units_give_the_ids_of_whole_texts():
    from lodestrata.llm.bytetext import slices
    import pyarrow as pa

    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        enc, got = Encoder(public_tokenizers.path(name), kind), []
        for s in slices(pa.array(ODD), 64):
            ids, off = enc.slice_ids(s)
            got += [ids[off[i] : off[i + 1]].tolist() for i in range(s.n)]
        assert got == ids_of(name, ODD)


def test_packing_is_gapless_and_full(spark, documents):
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    pieces = pack(documents, vocab, with_ids=True).cache()
    got = pieces.collect()
    docs = documents.collect()
    want = defaultdict(list)
    for d, ids in zip(docs, ids_of("byte_bpe_50k.json", [d.text for d in docs]), strict=True):
        want[d.doc_id].append([*ids, 0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length
    for k, ps in by_doc.items():
        assert sum(p.length for p in ps) == sum(map(len, want[k]))
        if len(want[k]) == 1:
            ps.sort(key=lambda p: p.start)
            assert [p.start for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
            assert np.frombuffer(b"".join(p.ids for p in ps), "<u4").tolist() == want[k][0]
            assert {p.doc_tokens for p in ps} == {len(want[k][0])}
    assert set(by_doc) == set(want)
    full = sorted(by_seq)
    assert full == list(range(len(full)))
    for k, ps in by_seq.items():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == np.cumsum([0] + [p.length for p in ps])[:-1].tolist()
        assert sum(p.length for p in ps) == 1024 or k == full[-1]
    whole = {r.sequence_id: r for r in sequences(pieces).collect()}
    assert all(len(whole[k].ids) == 4 * sum(p.length for p in ps) for k, ps in by_seq.items())


def test_windows_hold_the_target_shares():
    totals, targets = {"a": 100_000, "b": 50_000, "c": 7, "d": 0}, {"a": 1, "b": 1}
    phases = plan_windows(totals, 1024, targets)
    served = defaultdict(lambda: defaultdict(int))
    for q, ps in phases.items():
        for first, n, _, plus, minus, _ in ps:
            for i in range(n):
                got = _whole(i + 1, plus) - _whole(i + 1, minus) - _whole(i, plus) + _whole(i, minus)
                assert got >= 0
                served[first + i][q] += got
    assert {q: sum(w[q] for w in served.values()) for q in totals if totals[q]} == {k: v for k, v in totals.items() if v}
    assert all(sum(w.values()) == 1024 for k, w in served.items() if k != max(served))
    many = {f"s{i}": 1 + i**3 for i in range(60)}
    assert sum(n for q, ps in plan_windows(many, 1024).items() for n in [ps[-1][2]]) <= sum(many.values())
    # Until b is dry, a and b share each window evenly, and so do any first windows together (deficits are carried).
    for k in range(1, 90):
        assert abs(sum(served[i]["a"] for i in range(k)) - 512 * k) <= 2


def test_token_files_round_trip(spark, documents):
    folder, parts = write_token_files(documents, public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(read_token_files(spark, folder, parts).collect(), key=lambda r: r.start)
    docs = documents.collect()
    ids = [[*x, 1] for x in ids_of("word_bpe_49k.json", [d.text for d in docs])]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d.doc_id is not None, d.doc_id or 0, len(x), crc(x)) for d, x in zip(docs, ids, strict=True))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[0].doc_id is None


def test_shards_are_gapless_and_grow_consistently(spark, documents):
    out = shard(documents, shards=8, bucket_bytes=2000).withColumn("grown", rendezvous("doc_id", 9, 17)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in out) == sorted((d.doc_id is not None, d.doc_id or 0, d.text or "") for d in documents.collect())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown in (r.shard, 8) and r["size"] == len((r.text or "").encode()) + 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    again = {(r.doc_id, r.text, r.shard, r.slot) for r in shard(documents.repartition(5), shards=8, bucket_bytes=2000).collect()}
    assert again == {(r.doc_id, r.text, r.shard, r.slot) for r in out}


def test_fisher_yates_is_a_uniform_permutation():
    counts = defaultdict(int)
    for seed in range(3000):
        counts[tuple(fisher_yates(3, seed).tolist())] += 1
    assert len(counts) == 6 and min(counts.values()) > 400


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert read_token_files(spark, *write_token_files(none, public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert shard(none).count() == 0


@pytest.mark.parametrize("totals", [dict.fromkeys(map(str, range(3000)), 200), {"hot": 300_000} | dict.fromkeys(map(str, range(2000)), 300), {str(i): 1 + i % 500 for i in range(3000)}])
def test_any_number_of_sources_shares_the_windows(totals):
    phases, total = plan_windows(totals, 1024), sum(totals.values())
    n_windows = -(-total // 1024)
    served = np.zeros((len(totals), n_windows), np.int64)
    for k, q in enumerate(totals):
        x = np.arange(totals[q])
        got = [np.stack(p, 1) for p in _pieces(x, x + 1, phases[q])]
        got = np.concatenate(got)
        assert sorted(got[:, 1].tolist()) == x.tolist() and (got[:, 2] - got[:, 1] == 1).all()
        np.add.at(served[k], got[:, 3], 1)
    assert (served.sum(0)[:-1] == 1024).all()
    share = np.array(list(totals.values())) / total
    off = np.cumsum(served, 1) - share[:, None] * 1024 * np.arange(1, n_windows + 1)
    assert np.abs(off[:, : n_windows - 12]).max() < 5


def test_places_in_windows_of_many_sources_are_gapless():
    totals = {"hot": 9_000} | {f"s{i}": 5 + i % 7 for i in range(1500)}
    phases, at = plan_windows(totals, 1024), defaultdict(list)
    for q, n in totals.items():
        for p in _pieces(np.array([0]), np.array([n]), phases[q]):
            for _, s, e, w, place in zip(*map(np.ndarray.tolist, p), strict=True):
                at[w] += range(place, place + e - s)
    assert all(sorted(v) == list(range(1024 if w < max(at) else len(v))) for w, v in at.items())


def test_shards_and_slots_by_hand(spark):
    """Every record's shard, bucket and slot again, by the hashes' definition (XXH64, columns chained by seeds) and plain shuffles."""
    def chained(*values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q" if v > 2**31 or isinstance(v, Long) else "<i", v)
            h = xxhash.xxh64_intdigest(raw, h)
        return h - 2**64 if h >= 2**63 else h

    class Long(int):
        pass

    docs = [(Long(i * 7919), f"text {i % 90} " * (i % 40)) for i in range(700)]
    df = spark.createDataFrame([(int(d), t) for d, t in docs], "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.text): (r.shard, r.bucket, r.slot) for r in shard(df, shards=8, seed=17, bucket_bytes=3000).collect()}
    total = sum(len(t.encode()) + 1 for _, t in docs)
    buckets = max(1, -(-total // (3000 * 8)))
    groups = defaultdict(list)
    for d, t in docs:
        own = max((chained(d, s, 17), s) for s in range(8))[1]
        groups[own, chained(d, t, 18) % (1 << 30) % buckets].append((d, t))
    base, want = defaultdict(int), {}
    for (own, bucket), rows in sorted(groups.items()):
        rows.sort(key=lambda r: (r[0], chained(r[1])))
        for place, i in enumerate(fisher_yates(len(rows), 17 * 1_000_003 + own * buckets + bucket).tolist()):
            want[int(rows[i][0]), rows[i][1]] = (own, bucket, base[own] + place)
        base[own] += len(rows)
    assert buckets > 2 and got == want
