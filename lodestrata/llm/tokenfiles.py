"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

Documents are range-partitioned and sorted by (doc_id, text checksum); each task encodes whole texts and writes
``part-N.bin`` (uint16 if the vocabulary allows it, else uint32, little-endian), ``part-N.idx`` (int64 offsets in
tokens within the part, one more than documents), ``part-N.doc`` (int64 doc_ids) and ``part-N.nul`` (uint8: doc_id is null).
Parts are written under another name first and then renamed, so a repeated task leaves whole files. A part's base,
the tokens of all parts before it, is a prefix sum over the parts' counts (one row per part).

Null text is empty (its one id is the end id); null doc_ids come first; repeated rows are written once each; an empty table
gives no parts and no rows. Only doc_id and text are read, so other columns don't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bytetext import slices
from .common import documents, new_folder
from .subwords import encoder

PARTS = "part int, docs long, tokens long, wide boolean"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, vocab: str, folder: str | None = None, end_id: int = 1) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """Writes the files; returns their folder and, in order, (part, base, documents, tokens, wide) of each part."""
    spark = docs.sparkSession
    out = folder or new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocab, "word"), TaskContext.get().partitionId()
        store, at = _store(out)
        store.create_dir(at, recursive=True)
        wide = max(enc.tok.get_vocab_size(), end_id + 1) > 1 << 16
        name, tag = f"{at}/part-{part:07d}", f".try-{TaskContext.get().taskAttemptId()}"
        files = {k: store.open_output_stream(f"{name}.{k}{tag}") for k in ("bin", "idx", "doc", "nul")}
        files["idx"].write(np.zeros(1, "<i8").tobytes())
        n_docs = n_tokens = 0
        for b in batches:
            for s in slices(b.column("text"), 4 << 20):
                ids, off = enc.slice_ids(s)
                files["bin"].write(np.insert(ids, off[1:], end_id).astype("<u4" if wide else "<u2").tobytes())
                files["idx"].write((n_tokens + off[1:] + np.arange(1, s.n + 1)).astype("<i8").tobytes())
                d = b.column("doc_id").slice(s.first, s.n)
                files["doc"].write(d.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                files["nul"].write(d.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                n_docs += s.n
                n_tokens += int(off[-1]) + s.n
        for k, f in files.items():
            f.close()
            if n_docs:
                store.move(f"{name}.{k}{tag}", f"{name}.{k}")
            else:
                store.delete_file(f"{name}.{k}{tag}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [n_docs], "tokens": [n_tokens], "wide": [wide]})

    rows = documents(docs).drop("rest")
    ordered = rows.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    parts, base = [], 0
    for r in sorted(ordered.mapInArrow(run, PARTS).collect()):
        parts.append((r["part"], base, r["docs"], r["tokens"], r["wide"]))
        base += r["tokens"]
    return out, parts


def read_token_files(spark, folder: str, parts: list[tuple[int, int, int, int, bool]]) -> DataFrame:
    """One row per document: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 (over uint32 ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        for b in batches:
            for part, base, docs, tokens, wide in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                name = f"{at}/part-{part:07d}"

                def array(kind, dtype, name=name):
                    if isinstance(store, pafs.LocalFileSystem):
                        return np.memmap(f"{name}.{kind}", dtype, "r")
                    with store.open_input_file(f"{name}.{kind}") as f:
                        return np.frombuffer(f.read(), dtype)

                ids, off, doc, nul = array("bin", "<u4" if wide else "<u2"), array("idx", "<i8"), array("doc", "<i8"), array("nul", np.uint8)
                if len(off) != docs + 1 or len(ids) != tokens:
                    raise OSError(f"{name} is not whole")
                for i in range(0, docs, 20_000):
                    j = min(docs, i + 20_000)
                    o = np.asarray(off[i : j + 1])
                    raw = memoryview(np.asarray(ids[o[0] : o[-1]]).astype("<u4").tobytes())
                    cut = ((o - o[0]) * 4).tolist()
                    crc = np.fromiter((zlib.crc32(raw[x:y]) for x, y in zip(cut, cut[1:], strict=False)), np.int64, j - i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(doc[i:j]), mask=np.asarray(nul[i:j]) > 0), pa.array(base + o[:-1]), pa.array(np.diff(o)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(parts, "part int, base long, docs long, tokens long, wide boolean")
    return table.repartition(max(1, len(parts)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
