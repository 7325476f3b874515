"""SimHash near-duplicates found by pigeonring filtering.

A text's words are the runs of characters other than space and U+0009..U+000D, with A-Z
lower-cased. Every three-word shingle (repeats count; a shorter text is one shingle) is hashed
with XXH64, seed 42; a fingerprint bit is set where it is set in over half of the hashes.

Fingerprints at ``max_diff`` = 2 or fewer differing bits link. The 64 bits are cut into ``SEGMENTS`` = 7
segments on a ring. By the pigeonring principle, linked fingerprints have a segment from which
every chain of ``l`` consecutive segments differs in at most ``floor(l * 2 / 7)`` bits: none in
the first three, one in the first six, two in all. Three equal segments (27 or 28 bits) are the join key,
so chance meetings stay rare up to some 2**27 fingerprints a bucket; each longer chain's budget prunes what
has met, and the full Hamming check comes last.

A key shared by more than ``bucket_cap`` different fingerprints makes no pairs. Its
fingerprints take an exact way that is linear in their number: each is listed under itself and its
64 one-bit neighbours. Two fingerprints under one key differ in at most two bits, and any two that
differ in at most two bits share a key, so a star per key (65 members at most) gives every link.

A fingerprint that a hundredth of all rows or more share (empty texts, boilerplate) is joined back by broadcast: there are
a hundred of them at most.

Edge cases: a null or wordless text has fingerprint 0 and links like any other; rows are kept
one for one, repeated ids included; a null id never becomes a component id unless its component
has no other id. Columns other than ``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.llm.common import components, cut

#: Place and width of each segment.
SEGMENTS = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (np.concatenate(([0], ends[:-1]))[:-2]).tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(line[s:e], 42) for s, e in zip(starts, (ends[2:] - 1).tolist(), strict=True)), np.uint64, len(starts))
    return _majority(hashes)


def _majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.fromiter((fingerprint(t.as_py()) for t in b.column(1).cast(pa.binary())), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def _fingerprints_and_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = np.fromiter((fingerprint(t.as_py()) for t in b.column(1).cast(pa.binary())), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.view(np.int64))], ["doc_id", "text", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _chain(i: int, length: int) -> int:
    """The bits of ``length`` consecutive segments from segment ``i`` on, as a signed long."""
    mask = 0
    for k in range(length):
        at, width = SEGMENTS[(i + k) % len(SEGMENTS)]
        mask |= ((1 << width) - 1) << at
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def links(fps: DataFrame, max_diff: int = 2, bucket_cap: int = 256) -> DataFrame:
    """``a, b`` edges between different values of ``fp``: pairs from small buckets that keep every chain's budget, stars from large ones."""
    if max_diff != 2:
        raise ValueError("the segments and the one-bit stars are built for 2 differing bits")
    m = len(SEGMENTS)
    budget = {n: n * max_diff // m for n in range(1, m + 1)}
    key = max(n for n in budget if not budget[n])
    rows = fps.select("fp", F.posexplode(F.array(*[_bits(F.col("fp"), _chain(i, key)) for i in range(m)])).alias("seg", "val"))
    hot = rows.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > bucket_cap).select("seg", "val")
    hot = cut(hot, "simhash-hot")
    cool = rows.join(hot, ["seg", "val"], "left_anti")
    x, y = cool.select("seg", "val", F.col("fp").alias("a")), cool.select("seg", "val", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pair = x.join(y, ["seg", "val"]).where("a < b")
    # Of chains with one budget the longest binds the shorter ones.
    for n in sorted({max(k for k in budget if budget[k] == v) for v in budget.values()} - {key}):
        chain = F.element_at(F.array(*[F.lit(_chain(i, n)).cast("long") for i in range(m)]), F.col("seg") + 1)
        pair = pair.where(F.bit_count(diff.bitwiseAND(chain)) <= budget[n])
    dense = rows.join(hot, ["seg", "val"], "left_semi").select("fp").distinct()
    keys = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = dense.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pair.select("a", "b").unionByName(stars)


def _named(base: DataFrame, max_diff: int, bucket_cap: int) -> DataFrame:
    """``base(doc_id, fp, ...)`` with its rows' ``component`` (a fingerprint) and ``component_id`` (null where no row of it has an id)."""
    firsts = cut(base.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "simhash-distinct")
    found = components(links(firsts.select("fp"), max_diff, bucket_cap), "simhash-cc")
    named = found.join(firsts, F.col("node") == F.col("fp")).select("fp", "component", "first_id")
    roots = named.groupBy("component").agg(F.min("first_id").alias("root_id"))
    merged = named.join(roots, "component").select("fp", "component", "root_id")
    per_fp = firsts.join(merged, "fp", "left")
    per_fp = cut(per_fp.select("fp", "n", F.coalesce("component", "fp").alias("component"), F.coalesce("root_id", "first_id").alias("component_id")), "simhash-named")
    total = per_fp.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(per_fp.where(F.col("n") * 100 > total).drop("n"))  # 100 rows at most
    rare = base.join(common, "fp", "left_anti").join(per_fp.drop("n"), "fp")
    return base.join(common, "fp").unionByName(rare)


def simhash_components(docs: DataFrame, max_diff: int = 2, bucket_cap: int = 256) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable) for every row of ``docs``."""
    named = _named(cut(fingerprints(docs), "simhash-fp"), max_diff, bucket_cap)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_diff: int = 2, bucket_cap: int = 256) -> DataFrame:
    """``docs`` with one row of each near-duplicate group.

    It is the row with the group's smallest id; of rows that repeat this id, the one with the smallest hash of its
    text, and of rows equal in both one. A row without an id stays only where its group has no id at all.
    """
    text_hash = F.xxhash64(F.col("text").cast("string"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(own.mapInArrow(_fingerprints_and_text, "doc_id long, text string, fp long").select("doc_id", "fp", F.xxhash64("text").alias("h")), "simhash-fp")
    named = _named(base, max_diff, bucket_cap)
    keep = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("_keep_id"), F.col("k.h").alias("_keep_h")).distinct()
    mark = "_text_hash"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, text_hash)
    same = marked["doc_id"].eqNullSafe(keep["_keep_id"]) & marked[mark].eqNullSafe(keep["_keep_h"])
    kept = marked.join(keep, same, "left_semi")
    # Whole rows are only shuffled a second time where some do repeat an id and a text.
    if not named.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", mark])
    return kept.drop(mark)
