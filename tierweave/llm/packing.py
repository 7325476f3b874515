"""Best-fit packing of token sequences by a linear grouping scheme.

Documents are encoded, ended by ``end_id`` and, where longer than ``size``, cut into pieces of
``size`` tokens. Only the histogram of the pieces' lengths (``size`` rows at most) reaches the
driver, whatever the number of documents; the plan made of it is a list of bin types with numbers of
copies, so its length follows the number of different lengths as well:

1. Large lengths (over ``size / LARGE``) are sorted and put into ``groups`` groups of equal
   cardinality; each group is rounded up to its largest length. Pieces of ``size`` tokens fill a bin alone.
2. For these few sizes, configurations (the multisets of sizes that fit a bin) are optimised: the linear
   program over all of them is solved by column generation, an exact dynamic program naming
   the best configuration to enter. Its solution is rounded down; what that leaves over (a few pieces a group at most) goes on to step 4.
3. Actual documents take the places of the rounded ones, and leave their rounding as room.
4. All other lengths go, longest first, to the fullest bins that still hold them; new bins open last.

A piece finds its place by its length and its rank among the pieces of that length. The task that cuts the pieces
numbers them within each length; the ranks before a task come from counts per length and task.
So no length, however common, is ranked in one task, and no id decides where a row goes.

Edge cases: a null or empty text is the end id alone; repeated and null ids are packed like any
others; columns other than ``doc_id`` and ``text`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierweave.llm.common import cut
from tierweave.llm.words import slices, table, vocabulary

#: Lengths over this part of a sequence are large.
LARGE = 6


def pieces(docs: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``; with each piece's ``_task`` and its number there
    among the pieces of its length (``_nth``)."""
    path = path or vocabulary("word_bpe_49k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_nth", *["ids"] * with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = table(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            for low, high in slices(b.column(1)):
                offsets, ids = own.encode(b.column(1).slice(low, high - low))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                count = -(-np.diff(offsets) // size)
                doc = np.repeat(np.arange(high - low), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, np.diff(offsets)[doc] - start)
                at = offsets[doc] + start
                crc = [zlib.crc32(ids[a:e]) for a, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [b.column(0).slice(low, high - low).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                by = np.argsort(length, kind="stable")
                first = np.searchsorted(length[by], length[by])
                nth = np.empty(len(length), np.int64)
                nth[by] = np.arange(len(by)) - first + seen[length[by]]
                seen += np.bincount(length, minlength=size + 1)
                cols += [pa.array(np.full(len(nth), task), pa.int32()), pa.array(nth)]
                if with_ids:
                    cols.append(pa.array([ids[a:e].astype(np.int32) for a, e in zip(at, at + length, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _best(size: int, sizes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The configuration (how many of each size) that fits ``size`` and has the greatest worth."""
    levels, most = [np.zeros(size + 1)], size // int(sizes.min())
    chosen = []
    for _ in range(most):  # one more piece each time; a capacity's best with fewer pieces stands where no piece helps
        best, which = levels[-1].copy(), np.full(size + 1, -1)
        for i, (s, w) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
            own = levels[-1][: size + 1 - s] + w
            more = own > best[s:] + 1e-12
            best[s:][more], which[s:][more] = own[more], i
        levels.append(best)
        chosen.append(which)
    config, room = np.zeros(len(sizes)), size
    for which in reversed(chosen):
        if which[room] >= 0:
            config[which[room]] += 1
            room -= int(sizes[which[room]])
    return config


def configurations(sizes: np.ndarray, need: np.ndarray, size: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """``configs`` (a row each) and how many bins of each the linear program asks for."""
    k = len(sizes)
    basis = np.diag((size // sizes).astype(float))  # a column a configuration
    for _ in range(rounds):
        x, y = np.linalg.solve(basis, need.astype(float)), np.linalg.solve(basis.T, np.ones(k))
        enters = _best(size, sizes, np.maximum(y, 0))
        if enters @ y <= 1 + 1e-7:
            break
        u = np.linalg.solve(basis, enters)
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        basis[:, int(ratio.argmin())] = enters
    return basis.T, np.maximum(np.linalg.solve(basis, need.astype(float)), 0)


def _take(supply: list[list[int]], n: int) -> list[int]:
    """``n`` actual lengths from the supply's head, which gets shorter."""
    out = []
    while len(out) < n:
        supply[0][1] -= 1
        out.append(supply[0][0])
        if not supply[0][1]:
            supply.pop(0)
    return out


def _rounded(histogram: dict[int, int], size: int, groups: int) -> dict[int, list[list[int]]]:
    """Rounded size -> [actual length, count] of its group, longest first, for the large lengths under ``size``."""
    large = sorted((n for n in histogram if size // LARGE < n < size), reverse=True)
    each = max(1, -(-sum(histogram[n] for n in large) // groups))
    supply: dict[int, list[list[int]]] = {}
    room, top = 0, 0
    for n in large:
        left = histogram[n]
        while left:
            if not room:
                room, top = each, n
            k = min(left, room)
            supply.setdefault(top, []).append([n, k])
            room, left = room - k, left - k
    return supply


def plan(histogram: dict[int, int], size: int = 4096, groups: int = 16) -> list[tuple[tuple[int, ...], int]]:
    """Bin types (lengths in their order) and how many bins there are of each, for counts of lengths."""
    supply = _rounded(histogram, size, groups)
    bins: list[tuple[tuple[int, ...], int]] = [((size,), histogram[size])] if histogram.get(size) else []
    configs: list[tuple[list[tuple[int, int]], int]] = []
    if supply:
        sizes = np.array(sorted(supply))
        need = np.array([sum(k for _, k in supply[s]) for s in sizes.tolist()])
        left = need.copy()
        for config, copies in zip(*configurations(sizes, need, size), strict=True):
            config = config.astype(int)
            copies = int(min(np.floor(copies + 1e-6), *(left[config > 0] // config[config > 0])))
            left -= copies * config
            configs.append(([(int(s), int(c)) for s, c in zip(sizes, config, strict=True) if c], copies))
    for config, copies in configs:
        while copies:  # the actual lengths, in runs that are alike
            run = min(copies, *(supply[s][0][1] // c for s, c in config))
            if run:
                lengths = tuple(supply[s][0][0] for s, c in config for _ in range(c))
                for s, c in config:
                    supply[s][0][1] -= run * c
                    if not supply[s][0][1]:
                        supply[s].pop(0)
            else:  # a run's end within one bin
                run, lengths = 1, tuple(n for s, c in config for n in _take(supply[s], c))
            bins.append((lengths, run))
            copies -= run
    rest = {n: k for n, k in histogram.items() if n <= size // LARGE}
    for own in supply.values():
        for n, k in own:
            rest[n] = rest.get(n, 0) + k
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    some = np.zeros(size + 1, bool)
    for lengths, n in bins:
        by_room[size - sum(lengths)].append((lengths, n))
        some[size - sum(lengths)] = True
    for n in sorted(rest, reverse=True):
        count = rest[n]
        while count:
            room = n + int(np.argmax(some[n:])) if some[n:].any() else 0
            if room:
                lengths, copies = by_room[room].pop()
                k = min(count, copies)
                if copies > k:
                    by_room[room].append((lengths, copies - k))
                some[room] = bool(by_room[room])
            else:
                room, lengths, k = size, (), min(count, max(1, count // (size // n)))
            by_room[room - n].append((lengths + (n,), k))
            some[room - n] = True
            count -= k
    return [x for own in by_room for x in own]


def pack(docs: DataFrame, size: int = 4096, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with ``sequence_id`` and its ``offset`` there."""
    spark = docs.sparkSession
    got = cut(pieces(docs, size, end_id, path, with_ids), "packing-pieces")
    counts = {r["length"]: r["n"] for r in got.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    rows, base, rank = [], 0, dict.fromkeys(counts, 0)
    for lengths, copies in plan(counts, size):
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], rank[n] + copies, base, offset))
            rank[n] += copies
            offset += n
        base += copies
    rows.sort()
    length, low, _, first, offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
    # As many entries as the plan has places for lengths: it follows the different lengths, not the pieces.
    shared = spark.sparkContext.broadcast((length << 40 | low, low, first, offset))
    per_task = got.groupBy("length", "_task").agg(F.count("*").alias("n"))
    before = per_task.select("length", "_task", (F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")).alias("_before"))
    ranked = got.join(before, ["length", "_task"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = ranked.select(*columns, (F.col("_nth") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, low, first, offset = shared.value
        for b in batches:
            rank = b.column("_rank").to_numpy()
            at = np.searchsorted(keys, b.column("length").to_numpy() << 40 | rank, "right") - 1
            own = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[at] + rank - low[at]), pa.array(offset[at])], [*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    placed = ranked.mapInArrow(place, schema)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
