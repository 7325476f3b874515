"""Token ids in binary files, in ascending document order, entropy-coded block by block.

Documents are range-partitioned and sorted by ``doc_id``; each task encodes its documents and
writes one file to the shared folder, as a run of chunks:

    magic "TWID" | version (u16), 0 (u16) | documents, ids, blocks (u64) | bytes of the tables (u64)
    zstd-compressed tables: has-id flags (u8), doc ids (i64), ids per document (u64), ids, bytes and
    CRC-32 of each block (u32)
    the blocks, as ``coder.encode`` gives them, of equal numbers of ids but for the last

A chunk can be read by a range read alone, and a block of it decoded alone. The manifest (a row per chunk: file,
place, numbers) is the result of the writing job; only files it names are read, so attempts
that were lost or repeated leave nothing but unread files. Readers check every block's CRC.

Edge cases: null and empty texts are the end id alone; null doc ids come first; rows that repeat
a doc id follow one another, by a hash of their texts; columns other than ``doc_id`` and ``text`` are ignored; an empty
table gives an empty manifest. Ids must be below 65535.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierweave.llm import coder
from tierweave.llm.common import cut, new_folder
from tierweave.llm.storage import attempt_name, system
from tierweave.llm.words import slices, table, vocabulary

HEAD = struct.Struct("<4sHHQQQQ")
MANIFEST = "part int, chunk int, path string, place long, n_bytes long, n_docs long, n_ids long"


def chunk_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int = coder.BLOCK) -> bytes:
    """One chunk: the documents' tables and their coded ids, ``block`` ids a block at most."""
    import zstandard

    each = -(-len(ids) // max(1, -(-len(ids) // block)))
    own = [ids[i : i + each] for i in range(0, len(ids), max(each, 1))]
    parts = list(map(coder.encode, own))
    crcs = [zlib.crc32(x.astype("<u4")) for x in own]
    tables = b"".join([
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        counts.astype("<u8").tobytes(), *(np.array(x, "<u4").tobytes() for x in (list(map(len, own)), list(map(len, parts)), crcs)),
    ])
    tables = zstandard.compress(tables, 3)
    return HEAD.pack(b"TWID", 2, 0, len(doc_ids), len(ids), len(parts), len(tables)) + tables + b"".join(parts)


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """``doc ids, ids per document, ids`` of a chunk. A block whose CRC differs raises an error."""
    import zstandard

    magic, version, _, n_docs, n_ids, n_blocks, size = HEAD.unpack_from(data)
    if magic != b"TWID" or version != 2:
        raise ValueError("not a chunk of token ids")
    tables = zstandard.decompress(data[HEAD.size : HEAD.size + size])
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        own = np.frombuffer(tables, kind, n, at)
        at += own.nbytes
        return own

    there, docs, counts, lens, sizes, crcs = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs), take("<u4", n_blocks), take("<u4", n_blocks), take("<u4", n_blocks)
    ids, done, place = np.empty(n_ids, np.int32), 0, HEAD.size + size
    for k, (n, own, crc) in enumerate(zip(lens.tolist(), sizes.tolist(), crcs.tolist(), strict=True)):
        try:
            ids[done : done + n] = coder.decode(data[place : place + own])
        except (ValueError, IndexError) as e:
            raise ValueError(f"block {k} is damaged") from e
        if zlib.crc32(ids[done : done + n].astype("<u4")) != crc:
            raise ValueError(f"block {k} is damaged")
        done, place = done + n, place + own
    return [d if t else None for d, t in zip(docs.tolist(), there.tolist(), strict=True)], counts.astype(np.int64), ids


def write_ids(docs: DataFrame, end_id: int = 2, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents' ids; returns the manifest."""
    path = path or vocabulary("word_bpe_49k.json")
    folder = folder or new_folder(docs.sparkSession, "token-ids")
    names = [f.split()[0] for f in MANIFEST.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = table(path), TaskContext.get().partitionId()
        filesystem, base = system(folder)
        filesystem.create_dir(base, recursive=True)
        name = attempt_name(base, part, ".twid")
        rows: list[tuple] = []
        out, place = None, 0
        for b in batches:
            for low, high in slices(b.column(1), 8 << 20):
                offsets, ids = own.encode(b.column(1).slice(low, high - low))
                ids = np.insert(ids, offsets[1:], end_id)
                counts = np.diff(offsets) + 1
                data = chunk_bytes(b.column(0).slice(low, high - low).to_pylist(), counts, ids)
                out = out or filesystem.open_output_stream(name)
                out.write(data)
                rows.append((part, len(rows), f"{folder}/{name.rsplit('/', 1)[1]}", place, len(data), high - low, len(ids)))
                place += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names).cast(pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in (f.split() for f in MANIFEST.split(", "))]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(work, MANIFEST), "token-ids-manifest")


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` of every document in the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    # Ids before a part (the driver adds up a row a file), then before a chunk within its part.
    sizes = sorted(manifest.groupBy("part").agg(F.sum("n_ids")).collect())
    before = accumulate((n for _, n in sizes), initial=0)
    parts = manifest.sparkSession.createDataFrame(list(zip((p for p, _ in sizes), before, strict=False)), "part int, before long")
    chunks = manifest.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids"))
    placed = chunks.join(F.broadcast(parts), "part").select("path", "place", "n_bytes", (F.col("before") + F.col("inside")).alias("first"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, place, n, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                filesystem, own = system(path)
                with filesystem.open_input_file(own) as f:
                    docs, counts, ids = read_chunk(f.read_at(n, place))
                ends = np.cumsum(counts)
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(first + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    # A chunk is a task's worth of decoding: they are dealt out one by one.
    return placed.repartition(max(1, min(placed.count(), 100_000))).mapInArrow(work, schema)
