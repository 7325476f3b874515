"""Importance resampling of documents towards a target, over a persisted sparse count matrix.

Features are runs of 1 to ``longest`` consecutive words (A-Z lower-cased; a word is a run of digits, letters a-z and
characters from U+0080 on), joined by a space; a feature's bucket is its CRC-32 modulo ``buckets``. The matrix of
documents by buckets is written to the shared folder as blocks of compressed sparse rows: the documents' ids and row
ends, then each stored bucket and its count. Both passes read the blocks, never the texts again:

- column sums: a task adds up its blocks' counts by bucket, Spark the tasks'. With those of the target table they
  give each bucket's gain (smoothed log ratio, in thousandths), one number a bucket;
- a sparse matrix-vector product of the blocks with the gains gives each document's weight, its mean gain.

Noise by the id's hash makes the highest scores a draw without replacement in proportion to the weights. Ranks come from a
range-partitioned sort: rows are numbered within their part, and the parts' sizes (a row a part) are added up.

Edge cases: a null or wordless text has no features and weight 0. Rows stay one for one; rows that repeat an id have equal noise,
and equal scores of theirs are ranked by weight and number of features. A row without an id hashes as ``null`` and follows equal scores. Other columns
are ignored. An empty table gives an empty result; an empty target is all smoothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.llm.common import cut
from tierweave.llm.words import slices

#: What parts words once A-Z are lower-cased, as bytes of UTF-8.
BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")
BLANKED = bytes(32 if BETWEEN.match(bytes([i])) else i for i in range(256))
LOWERED = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
TABLE = bytes(BLANKED[LOWERED[i]] for i in range(256))
#: Blocks of the matrix in a row group. Spark's reader decodes a row group at a time, for arrays some ten times as large as the file, so that the
#: writer's usual 128 MB would take a task more than its share of the heap; a reader's split may still hold any number of these groups.
GROUP = {"parquet.block.row.count.limit": 4}
CSR = "ids array<long>, ends array<int>, features array<int>, columns array<int>, counts array<int>"


def matrix(texts: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ends, features, columns, counts``: the rows' ends and numbers of features, then the stored entries, by row and column."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    size = pc.binary_length(raw).to_numpy().astype(np.int64)
    # A line feed is no word's character: it ends each text, and the words keep their text's number.
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), raw.cast(pa.binary())), b"\n")[0].as_py() + b"\n"
    blanked = joined.translate(TABLE)
    own = np.frombuffer(blanked, np.uint8)
    inside = own != 32
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    text_ends = np.cumsum(size + 1)
    row = np.searchsorted(text_ends, starts, "right")
    words = pa.array(blanked.split(), pa.large_binary()).dictionary_encode()
    number, different = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    features = np.zeros(len(raw), np.int64)
    crc = np.array([zlib.crc32(w) for w in different], np.int64) if different else np.empty(0, np.int64)
    keys = []
    for n in range(1, longest + 1):
        at = np.arange(max(len(number) - n + 1, 0))
        at = at[row[at] == row[at + n - 1]]
        if n == 1:
            bucket = (crc % buckets)[number] if len(number) else crc
        else:  # runs by their words' numbers; each different run is hashed once
            run = np.stack([number[at + i] for i in range(n)], 1)
            unique, back = np.unique(run, axis=0, return_inverse=True)
            bucket = np.array([zlib.crc32(b" ".join(different[i] for i in r)) % buckets for r in unique.tolist()], np.int64)[back.ravel()]
        np.add.at(features, row[at], 1)
        keys.append(row[at] * buckets + bucket)
    stored, counts = np.unique(np.concatenate(keys), return_counts=True)
    return np.cumsum(np.bincount(stored // buckets, minlength=len(raw))), features, stored % buckets, counts


def csr_blocks(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """The count matrix of ``docs(doc_id, text)``: a row a block of consecutive documents, as a table in the shared folder."""
    names = [f.split()[0] for f in CSR.split(", ")]
    kinds = [pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in slices(b.column(1)):
                ids, texts = b.column(0).slice(low, high - low), b.column(1).slice(low, high - low)
                parts = [ids, *(pa.array(x, pa.int32()) for x in matrix(texts, buckets, longest))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(k) for x, k in zip(parts, kinds, strict=True)], names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(own.mapInArrow(work, CSR), "csr", **GROUP)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """The matrix' column sums: the driver gets at most a row a bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            columns, counts = (b.column(i).flatten().to_numpy() for i in (0, 1))
            np.add.at(total, columns, counts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in blocks.select("columns", "counts").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's smoothed log ratio of the target's share to the source's, in whole thousandths."""
    buckets = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s_all + buckets) / ((source + 1.0) * (t_all + buckets)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight``: the product of the matrix with the gains over the rows' numbers of features, rounded down."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, ends, features, columns, counts = (c[i].values for c in b.columns)
                product = np.concatenate(([0], np.cumsum(gain[columns.to_numpy()] * counts.to_numpy())))
                ends, n = ends.to_numpy(), features.to_numpy().astype(np.int64)
                total = product[ends] - product[np.concatenate(([0], ends[:-1]))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_features", "weight"])

    return blocks.mapInArrow(work, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in whole thousandths, by the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def ranked(scored: DataFrame, order: list[Column | str]) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3... in ``order``: numbers within the parts of a range-partitioned sort, and the parts' sizes."""
    own = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    own = cut(own.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33).alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(own.groupBy(part).count().collect())  # a row a part
    starts = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    before = own.sparkSession.createDataFrame(list(starts.items()), "part long, before long")
    return own.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + place + 1).drop("_at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null for what is not drawn.

    ``percent`` of the documents with ``least`` words or more are drawn towards ``target(text)``.
    """
    blocks = csr_blocks(docs, buckets, longest)
    aim = csr_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    found = weights(blocks, gains(column_sums(blocks, buckets), column_sums(aim, buckets)))
    scored = cut(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    # A row has longest * words - longest * (longest - 1) / 2 features, if it has as many words as the longest run.
    words = F.col("n_features") if longest == 1 else F.ceil((F.col("n_features") + longest * (longest - 1) / 2) / longest)
    enough = words >= least
    drawn = scored.where(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features"]
    top = ranked(scored.where(enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
