"""Collocations by suffix sorting.

Every word of a piece starts a suffix, cut to the longest phrase's words. Suffixes are summed within each task and travel by first word: one row holds up to
``ROW`` suffixes of a language and first word, as the words behind it, each ended by a line feed (which no word holds), and their counts as packed integers.
All rows of a first word meet in one task, which numbers the words, sorts a few whole groups' suffixes as integers and counts all prefixes in one pass a length.
The counts of a phrase's parts are joined afterwards.

A group holds at most 1/``SHARES`` of all summed suffixes and ``GROUP`` of them: a first word with more is dealt into parts by the second word, and a part that is still
four times as large by the rest; prefixes that lie in several parts have partial counts, which are summed. At most ``SHARES`` such words and parts, or one in ``GROUP`` suffixes, can
exist, so both lists are small enough to broadcast.

Null text is empty, a null language is ``und``; texts of any length are cut whole; repeated rows count again; text without words and empty tables give no
rows; columns other than the text and the language are ignored. Ties in the score go to the more frequent phrase, then to the smaller one in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bytetext import LOWER, Slice, byte_table, prefix_hash, slices, span_hash
from .common import materialise
from .lists import whole_groups

#: A first word is dealt into parts if it has more than this share of the suffixes, or more than GROUP of them.
SHARES, GROUP = 4096, 1 << 18
#: A task sums the suffixes of so many words (whole documents) before it hands them on.
BUFFER_WORDS = 1 << 20
#: Suffixes of one row, and of a batch that a task hands on or sorts at once (a larger group is sorted by itself).
ROW, BATCH = 1 << 12, 1 << 16

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def pieces(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of the words of a slice; a piece ends at a break and at its document's end."""
    gap, edge = _GAP[s.data], np.zeros(len(s.data) + 1, bool)
    edge[s.off] = True
    word = ~gap
    start = np.flatnonzero(word & (edge[:-1] | np.r_[True, gap[:-1]])) if len(word) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (edge[1:] | np.r_[gap[1:], True])) + 1 if len(word) else start
    broken = np.cumsum(_BREAK[s.data] | edge[:-1]) if len(word) else start
    return start, end, broken[start]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of each pair as a string array; gaps between the words are left out."""
    size = end - start
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, start, 1)
    np.add.at(keep, end, -1)
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data[np.cumsum(keep[:-1]) > 0])])


def _summed(words: pa.Array, piece: np.ndarray, longest: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(distinct words, ids of each distinct suffix's words or -1, counts)."""
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    n = len(ids)
    cols = [ids + 1]
    for k in range(1, longest):
        nxt = np.zeros(n, np.int64)
        if n > k:
            nxt[:-k] = np.where(piece[k:] == piece[:-k], ids[k:] + 1, 0)
        cols.append(nxt)
    # Ranks of the prefixes so far leave room for the next word's id, whatever their number.
    key, base = cols[0], len(coded.dictionary) + 1
    for c in cols[1:]:
        if int(key.max(initial=0)) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + c
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return coded.dictionary, [c[first] - 1 for c in cols], count


NESTED = "lang string, w1 string, rest string, n binary, size int, total long"


def _nested(data: pa.Array, count: np.ndarray, start: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(rest, n, size, total) of the rows that begin at ``start``, from one string and one count a suffix."""
    at = np.r_[start, len(data)]
    off = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    rest = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off[at]), data.buffers()[2]])
    n = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(count.astype(np.int32))])
    return rest, n, pa.array(np.diff(at).astype(np.int32)), pa.array(np.add.reduceat(count, start).astype(np.int64))


def _suffixes_of(rows: pa.RecordBatch, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends of the words behind the first one (suffixes x words), row, count) of each suffix in nested ``rows``."""
    rest, n = rows.column("rest").cast(pa.string()), rows.column("n").cast(pa.binary())
    off = np.frombuffer(rest.buffers()[1], np.int32)[rest.offset : rest.offset + len(rest) + 1]
    data = np.frombuffer(rest.buffers()[2], np.uint8)[off[0] : off[-1]]
    at = np.frombuffer(n.buffers()[1], np.int32)[n.offset : n.offset + len(n) + 1]
    count = np.frombuffer(n.buffers()[2], np.uint8)[at[0] : at[-1]].copy().view(np.int32).astype(np.int64)
    return data, (np.flatnonzero(data == 10) + 1).reshape(-1, longest - 1), np.repeat(np.arange(len(n)), np.diff(at) // 4), count


def suffixes(docs: DataFrame, longest: int, lang: str = "lang") -> DataFrame:
    """(lang, w1, rest, n, size, total): the suffixes that start at the words of each piece, cut to ``longest`` words and summed within tasks, by first word.

    rest: for each suffix its ``longest`` - 1 further words, each ended by a line feed (those beyond its end are empty); n: their counts, four bytes each
    (little-endian); size: how many; total: the sum of the counts.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def flush(of: str, held: list) -> Iterator[pa.RecordBatch]:
        step, piece = 0, []
        for _, p in held:
            piece.append(p + step)
            step = int(piece[-1][-1]) + 1
        dictionary, cols, count = _summed(pa.concat_arrays([w for w, _ in held]), np.concatenate(piece), longest)
        ended = pa.concat_arrays([pc.binary_join_element_wise(dictionary, "", "\n"), pa.array(["\n"])])
        for i in range(0, len(count), BATCH):
            first, *more = [c[i : i + BATCH] for c in cols]
            data = pc.binary_join_element_wise(*[ended.take(pa.array(np.where(c < 0, len(dictionary), c))) for c in more], "")
            start = np.flatnonzero(np.r_[True, first[1:] != first[:-1]] | (np.arange(len(first)) % ROW == 0))
            yield pa.RecordBatch.from_arrays([pa.repeat(of, len(start)), dictionary.take(pa.array(first[start])), *_nested(data, count[i : i + BATCH], start)], names=["lang", "w1", "rest", "n", "size", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            which = langs.indices.to_numpy()
            for i, of in enumerate(langs.dictionary.to_pylist()):
                for s in slices(b.column("text").take(pa.array(np.flatnonzero(which == i)))):
                    start, end, piece = pieces(s)
                    if len(start):
                        held.setdefault(of, []).append((_strings(LOWER[s.data], start, end), piece))
            # All languages share the buffer; the fullest one is handed on first.
            while sum(len(w) for part in held.values() for w, _ in part) >= BUFFER_WORDS:
                of = max(held, key=lambda k: sum(len(w) for w, _ in held[k]))
                yield from flush(of, held.pop(of))
        for of, part in held.items():
            yield from flush(of, part)

    return rows.mapInArrow(run, NESTED)


def dealt(rows: DataFrame, longest: int, whole: bool) -> DataFrame:
    """Nested ``rows`` with a number of ``parts``, each cut into rows whose suffixes have the same ``part``: by a hash of the second word, or of the ``whole`` rest."""
    kept = [c for c in rows.columns if c not in ("rest", "n", "size", "total", "parts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy()
            for b in _chunks(batch, np.arange(len(size)), size):
                data, ends, row, count = _suffixes_of(b, longest)
                start, end = np.r_[0, ends[:-1, -1]], ends[:, -1]
                h = span_hash(prefix_hash(byte_table(11 if whole else 12, False)[data]), start, end if whole else ends[:, 0])
                parts = b.column("parts").to_numpy()
                key = row * int(parts.max()) + (h % parts[row].astype(np.uint64)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                text = pa.Array.from_buffers(pa.string(), len(end), [None, pa.py_buffer(np.r_[0, end].astype(np.int32)), pa.py_buffer(data)])
                at = pa.array(row[first])
                part = pa.array((key[first] - row[first] * int(parts.max())).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in kept], *_nested(text.take(pa.array(order)), count[order], first), part], names=[*kept, "rest", "n", "size", "total", "dealt"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, rest string, n binary, size int, total long, dealt int")


def _chunks(batch: pa.RecordBatch, group: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of whole groups with about BATCH suffixes."""
    edge = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)]
    upto = np.r_[0, np.cumsum(size, dtype=np.int64)][edge]
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + BATCH, side="right")) - 1)
        yield batch.slice(int(edge[i]), int(edge[j] - edge[i]))
        i = j


def prefix_counts(rows: pa.RecordBatch, longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, f) of all prefixes of the suffixes in nested ``rows`` of whole groups.

    A count below ``least`` is dropped where it is complete: at level 0 always, at level 1 from two words on, at level 2 for the longest.
    """
    data, ends, row, n = _suffixes_of(rows, longest)
    # A word is taken with its line feed, so that the bytes need no copy; the one that is nothing else stands behind a suffix's end.
    coded = pa.Array.from_buffers(pa.string(), ends.size, [None, pa.py_buffer(np.r_[0, ends.ravel()].astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    dictionary, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64).reshape(ends.shape)
    missing = pc.index(dictionary, "\n").as_py()
    words, base = pc.utf8_rtrim(dictionary, "\n"), len(dictionary)
    langs, firsts = (rows.column(c).dictionary_encode() for c in ("lang", "w1"))
    prefix = [(langs.indices.to_numpy().astype(np.int64) * len(firsts.dictionary) + firsts.indices.to_numpy())[row]]
    for k in range(longest - 1):
        key = prefix[-1]
        if int(key.max()) * base >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        prefix.append(key * base + code[:, k])
    # Sorted by the whole suffix, the suffixes that share a prefix stand together at every length.
    order = np.argsort(prefix[-1])
    level, n = rows.column("level").to_numpy(), n[order]
    for k in range(longest):
        p = prefix[k][order]
        start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        f, at = np.add.reduceat(n, start), order[start]
        whole = (level[row[at]] == 0) | ((level[row[at]] == 1) & (k > 0)) | (k + 1 == longest)
        keep = (f >= least) | ~whole
        if k:
            keep &= code[at, k - 1] != missing if missing >= 0 else True
        if keep.any():
            at = at[keep]
            r = pa.array(row[at])
            phrase = pc.binary_join_element_wise(rows.column("w1").take(r), *[words.take(pa.array(code[at, i])) for i in range(k)], " ")
            yield pa.RecordBatch.from_arrays([rows.column("lang").take(r), phrase, pa.array(np.full(len(at), k + 1, np.int32)), pa.array(f[keep])], names=["lang", "phrase", "words", "f"])


def first_words(counted: DataFrame) -> DataFrame:
    """(lang, w1, rows, n): for each first word its suffixes in ``suffixes`` and its occurrences."""
    return counted.groupBy("lang", "w1").agg(F.sum("size").alias("rows"), F.sum("total").alias("n"))


def frequent(counted: DataFrame, first: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of up to ``longest`` words that occur ``least`` times, from written ``suffixes`` and ``first_words``."""
    total = first.agg(F.sum("rows")).first()[0] or 1
    most = max(1, min(total // SHARES, GROUP))
    parts = F.ceil(F.col("rows") / F.lit(most)).cast("int").alias("parts")
    # Fewer than total / most first words can have so many suffixes, so the broadcast table is bounded.
    hot = first.where(F.col("rows") > most).select("lang", "w1", parts)
    few = counted.join(F.broadcast(hot), ["lang", "w1"], "left_anti").withColumn("group", F.xxhash64("lang", "w1")).withColumn("level", F.lit(0))
    by_second = dealt(counted.join(F.broadcast(hot), ["lang", "w1"]), longest, False).withColumnRenamed("dealt", "part")
    by_second = materialise(by_second, "parts")
    # Of the parts fewer than a quarter as many can still be four times too large.
    large = by_second.groupBy("lang", "w1", "part").agg(F.sum("size").alias("rows")).where(F.col("rows") > 4 * most).select("lang", "w1", "part", parts)
    large = materialise(large, "large-parts")
    one = by_second.join(F.broadcast(large), ["lang", "w1", "part"], "left_anti").withColumn("group", F.xxhash64("lang", "w1", "part")).withColumn("level", F.lit(1))
    by_rest = dealt(by_second.join(F.broadcast(large), ["lang", "w1", "part"]), longest, True)
    two = by_rest.withColumn("group", F.xxhash64("lang", "w1", "part", "dealt")).withColumn("level", F.lit(2))
    columns = ["group", "lang", "w1", "rest", "n", "size", "level"]
    rows = few.select(columns).unionByName(one.select(columns)).unionByName(two.select(columns))
    # Sorted by one number only; the suffixes themselves are sorted by the task that counts them.
    rows = rows.repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            for b in _chunks(batch, batch.column("group").to_numpy(), batch.column("size").to_numpy()):
                yield from prefix_counts(b, longest, least)

    found = rows.mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def exact_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in integers of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(l) * wide(r))


def parts_of(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more in ``found``: those of its lowest-scoring cut, the earliest of equals."""
    many = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    count = lambda part, name: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cut = cut.join(count("left", "l"), ["lang", "left"]).join(count("right", "r"), ["lang", "right"])
    cut = cut.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r")))
    return cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def contained(found: DataFrame) -> DataFrame:
    """(lang, phrase, longer): for phrases of two words or more the count of the most frequent longer phrase around them."""
    words, m = F.split("phrase", " "), F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    return found.where("words > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def best_of(scored: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """The first ``top`` rows of each language with their rank: first those of each of ``parts`` parts, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scored.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top).drop("__part")
    return part.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000, lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words that occur ``least`` times, but those
    of which ``covered`` percent or more lie inside one longer such phrase. Writes three tables on the way."""
    counted = materialise(suffixes(docs, longest, lang), "suffixes")
    first = materialise(first_words(counted), "first-words")
    found = materialise(frequent(counted, first, longest, least), "phrases")
    scored = parts_of(found).join(contained(found), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    words = first.groupBy("lang").agg(F.sum("n").alias("n"))
    return best_of(scored, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
