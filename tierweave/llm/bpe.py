"""Byte-level BPE by a distinct-word table, and decoding through an id-to-piece table.

Texts are split into words (cuts that no merge crosses) in batches of about ``batch_bytes`` of text. Each batch gives its
different words, packed by a hash of the word into buckets. Shuffled by bucket, every different word of the corpus is encoded once, and its ids
go back to all batches that hold it, to a file per batch in the shared folder. A document's ids are then its words' ids, joined by
their position in the batch's table; its decoded text is its ids joined with the pieces, a table as long as the vocabulary.

What is shuffled is each different word of a batch, not each position: frequent words, which make up most of
a text, travel once a batch. So no word makes a task hot. There is a bucket for each ``BUCKET`` bytes of text, whatever the session's
settings, so a task holds the different words of that much text at a time; should they be over ``MOST_WORDS``, the table
starts anew, and a word that comes again is encoded again.

Texts are read twice, in the same order. A table in files gives that; anything else (``stored=False``: a plan with a shuffle
or a sample may give its rows in another order each time) is written to the shared folder first. A check sum of each batch's words makes the job fail rather than give wrong ids.

Edge cases: null and empty texts have no tokens; special strings inside texts become their
special id, as the library does by default; rows stay one for one, repeated and null ids
included; columns other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tierweave.llm.common import WRITTEN, cut, new_folder
from tierweave.llm.storage import system
from tierweave.llm.words import byte_alphabet, cuts, gather, slices, table, vocabulary

#: Bytes of text whose words share a table.
BATCH = 48 << 20
#: Bytes of text for each bucket of words, and the fewest buckets.
BUCKET, LEAST_BUCKETS = 64 << 20, 64
#: Words that a task's table of a bucket holds.
MOST_WORDS = 1 << 21


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``offsets, numbers, words``: the different words of a batch in the order they come, and text i's as numbers[offsets[i]:offsets[i + 1]]."""
    counts, parts = [0], [pa.array([], pa.large_string())]
    for low, high in slices(texts):  # words as Python texts are made for a part of the batch at a time
        own = [cuts(t) for t in texts.slice(low, high - low).to_pylist()]
        counts += map(len, own)
        parts.append(pa.array([w for ws in own for w in ws], pa.large_string()))
    coded = pa.chunked_array(parts).dictionary_encode().unify_dictionaries().chunks
    numbers = np.concatenate([np.empty(0, np.int32), *(x.indices.to_numpy() for x in coded)])
    return np.cumsum(counts), numbers, coded[-1].dictionary if coded else pa.array([], pa.large_string())


def _mark(words: pa.Array) -> str:
    """A check sum of a batch's words in their order."""
    crc = 0
    for own in words.buffers()[1:]:
        crc = zlib.crc32(own or b"", crc)
    return f"{len(words)}:{crc:08x}"


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The slices of a task with their numbers, the same whenever the table is read."""
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        for low, high in slices(b.column(1), size):
            yield number, b.slice(low, high - low)
            number += 1


def bucket_order(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``order, edges``: the batch's words sorted by bucket, bucket b's from edges[b] to edges[b + 1]."""
    own = (pd.util.hash_array(np.array(words.to_pylist(), object), categorize=False) % np.uint64(buckets)).astype(np.int64) if len(words) else np.empty(0, np.int64)
    return np.argsort(own, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(own, minlength=buckets))))


def _packed(lens: np.ndarray, data: bytes) -> bytes:
    return zstandard.compress(struct.pack("<I", len(lens)) + lens.astype("<u4").tobytes() + data, 3)


def _unpacked(packed: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.decompress(packed)
    (n,) = struct.unpack_from("<I", data)
    return np.frombuffer(data, "<u4", n, 4).astype(np.int64), data[4 + 4 * n :]


def distinct_words(docs: DataFrame, buckets: int, batch_bytes: int = BATCH) -> DataFrame:
    """``batch, bucket, data``: the different words of each batch of texts, packed by bucket; bucket -1 has the batch's check sum."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _batches(batches, batch_bytes):
            words = batch_words(b.column(1))[2]
            order, edges = bucket_order(words, buckets)
            some = np.flatnonzero(np.diff(edges))
            raw = words.take(pa.array(order)).cast(pa.binary() if words.nbytes < 1 << 31 else pa.large_binary())
            data = [_mark(words).encode()]
            for low, high in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True):
                own = raw.slice(low, high - low)
                data.append(_packed(pc.binary_length(own).to_numpy(), b"".join(own.to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), number)), pa.array(np.concatenate(([-1], some)), pa.int32()), pa.array(data, pa.binary())], ["batch", "bucket", "data"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, "batch long, bucket int, data binary")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``batch, bucket, data`` with the words' ids in their place: a bucket's rows lie together, so each different word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, known = table(path), None, {}
        for b in batches:
            out = []
            for bucket, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                    own.clear()
                if bucket < 0:
                    out.append(data)
                    continue
                lens, raw = _unpacked(data)
                ids = []
                at = 0
                for n in lens.tolist():
                    w = raw[at : at + n]
                    at += n
                    if (got := known.get(w)) is None:
                        if len(known) >= MOST_WORDS:
                            known.clear()
                            own.clear()
                        got = known[w] = np.array(own.ids(w.decode()), "<u4").tobytes()
                    ids.append(got)
                out.append(_packed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, b"".join(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["batch", "bucket", "data"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(encode, "batch long, bucket int, data binary")


def _place(folder: str, number: int) -> str:
    return f"{folder}/{number >> 32}/{number & 0xFFFFFFFF}"


def store_batches(encoded: DataFrame, folder: str) -> int:
    """Write each batch's ids to a file of its own in the shared folder; returns the number of batches.

    A file is moved to its name when it is whole, and holds the same bytes whichever attempt wrote it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = system(folder)
        parts: list[pa.RecordBatch] = []
        done = 0

        def flush() -> None:
            nonlocal done
            if not parts:
                return
            whole = pa.Table.from_batches(parts)
            number, data = whole["batch"][0].as_py(), whole["data"].to_pylist()
            path = _place(base, number)
            filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
            attempt = f"{path}-{uuid.uuid4().hex}"
            with filesystem.open_output_stream(attempt) as f:
                f.write(struct.pack("<I", len(data)) + np.array(list(map(len, data)), "<u4").tobytes() + b"".join(data))
            try:
                filesystem.move(attempt, path)
            except OSError:  # another attempt was faster, on file systems that do not replace
                if filesystem.get_file_info(path).type.name != "File":
                    raise
                filesystem.delete_file(attempt)
            parts.clear()
            done += 1

        for b in batches:
            number = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high == low:
                    continue
                if parts and parts[0].column(0)[0].as_py() != number[low]:
                    flush()
                parts.append(b.slice(low, high - low))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    return encoded.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_batch(folder: str, number: int, words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lens, starts, ids`` of a batch's words. Fails if the file is of other words."""
    filesystem, base = system(folder)
    with filesystem.open_input_file(_place(base, number)) as f:
        raw = f.read()
    (n,) = struct.unpack_from("<I", raw)
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)
    data = [raw[s:e] for s, e in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    if data[0] != _mark(words).encode():
        raise ValueError("the documents were not read twice in the same order: write them to a table first")
    parts = list(map(_unpacked, data[1:]))
    sorted_lens = np.concatenate([np.empty(0, np.int64), *(x for x, _ in parts)])
    order, _ = bucket_order(words, buckets)
    lens, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    lens[order], starts[order] = sorted_lens, np.cumsum(sorted_lens) - sorted_lens
    return lens, starts, np.frombuffer(b"".join(x for _, x in parts), "<u4").astype(np.int32)


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: all pieces' bytes back to back, and each id's start and length."""
    model, alphabet = json.load(open(path, encoding="utf-8")), byte_alphabet()
    by_id = {i: bytes(alphabet[c] for c in t) for t, i in model["model"]["vocab"].items()}
    by_id |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    lens = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lens) - lens, lens


def decode(ids: np.ndarray, path: str, block: int = 1 << 18) -> bytes:
    """The bytes of ``ids``, gathered from the pieces."""
    data, starts, lens = pieces(path)
    out = []
    for i in range(0, len(ids), block):
        n = lens[ids[i : i + block]]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(starts[ids[i : i + block]] - (ends - n), n)
        out.append(data[at].tobytes())
    return b"".join(out)


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = True, batch_bytes: int = BATCH, stored: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` for every row.

    ``stored`` says that ``docs`` is a table in files as it stands, which needs no copy to be read twice alike.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own if stored else cut(own, "bpe-texts")
    folder = new_folder(docs.sparkSession, "bpe-batches")
    WRITTEN.append(folder)
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    store_batches(encode_words(distinct_words(own, buckets, batch_bytes), path), folder)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in _batches(batches, batch_bytes):
            word_at, numbers, words = batch_words(b.column(1))
            stored = read_batch(folder, number, words, buckets)
            del words
            for low in range(0, b.num_rows, 1000):
                high = min(low + 1000, b.num_rows)
                offsets, ids = gather(word_at[low : high + 1] - word_at[low], numbers[word_at[low] : word_at[high]], *stored)
                lists = [ids[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                shas = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists]
                back = [hashlib.sha256(decode(x, path).decode("utf-8", "replace").encode()).hexdigest() for x in lists]
                cols = [b.column(0).slice(low, high - low), pa.array(np.diff(offsets)), pa.array(shas), pa.array(back)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return own.mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``text`` from its ``ids``; null ids give a null text."""
    path = path or vocabulary("byte_bpe_50k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            texts = [None if x is None else decode(np.array(x, np.int64), path).decode("utf-8", "replace") for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

    kept = encoded.drop("text")
    return kept.mapInArrow(work, StructType([*kept.schema.fields, StructField("text", StringType())]))
