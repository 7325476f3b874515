"""Organizations that a name finder reports: cutting long texts for it, and choosing among what it says.

The finder itself is not part of this library: ``entities(doc_id, kind, name, confidence, ordinal)`` are its findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.functions import fixed_values as V


def cut(text: str, whole: int = 4000, size: int = 3000, overlap: int = 500) -> list[str]:
    """Pieces of at most ``size`` bytes that end after a blank where there is one, each going back ``overlap`` bytes into the one before.

    A text of ``whole`` bytes or fewer is one piece. No character is cut.
    """
    data = text.encode()
    if len(data) <= whole:
        return [text]

    def back(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    out, start = [], 0
    while start < len(data):
        end = back(min(start + size, len(data)))
        if end <= start:  # a character longer than a piece
            end = start + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        if end < len(data):
            piece = data[start:end].decode()
            blank = max((i for i, c in enumerate(piece) if c.isspace()), default=-1)
            end = start + len(piece[: blank + 1].encode()) if blank >= 0 else end
        out.append(data[start:end].decode())
        if end >= len(data):
            break
        again = back(end - overlap) if end > start + overlap else end
        start = again if again > start else end
    return out


def chunks(texts: DataFrame, whole: int = 4000, size: int = 3000, overlap: int = 500) -> DataFrame:
    """``doc_id, ordinal, text``: the pieces of ``texts(doc_id, text)``; a null text has none, an empty one itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, i, p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None for i, p in enumerate(cut(t, whole, size, overlap))]
            own = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], pa.int32()), pa.array(own[2], pa.string())], ["doc_id", "ordinal", "text"])

    return texts.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, ordinal int, text string")


def best_organization(entities: DataFrame, least: float = 0.6) -> DataFrame:
    """``doc_id, organization, confidence``: the surest finding that is an organization; of equally sure ones the first."""
    own = entities.where(F.lower("kind").isin(*V.ORG_ENTITIES) & (F.col("confidence") >= least) & (F.trim("name") != ""))
    best = own.groupBy("doc_id").agg(F.min_by(F.struct(F.trim("name").alias("organization"), "confidence"), F.struct(-F.col("confidence"), "ordinal")).alias("r"))
    return best.select("doc_id", "r.*")


def all_organizations(entities: DataFrame, least: float = 0.6, shortest: int = 3) -> DataFrame:
    """``doc_id, organization, confidence, place``: different names, whatever their case, each as surest found, surest first."""
    own = entities.where(F.lower("kind").isin(*V.ORG_ENTITIES) & (F.col("confidence") >= least)).withColumn("name", F.trim("name")).where(F.octet_length("name") >= shortest)
    once = own.groupBy("doc_id", F.lower("name").alias("_k")).agg(F.min_by(F.struct("name", "confidence"), F.struct(-F.col("confidence"), "ordinal")).alias("r"))
    listed = once.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("r.confidence")).alias("q"), F.col("r.name").alias("name")))).alias("l"))
    rows = listed.select("doc_id", F.posexplode("l").alias("place", "x"))
    return rows.select("doc_id", F.col("x.name").alias("organization"), (-F.col("x.q")).alias("confidence"), "place")
