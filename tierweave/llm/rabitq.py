"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector is rotated by a random orthogonal matrix and kept as the signs of its coordinates
(its code) together with a correction factor, the inner product of the vector and its code's
unit vector. For codes x, y of vectors u, v with factor f of u, ``<x, R v> / f`` estimates ``<u, v>`` without
bias; for pairs at the threshold t or above its error is at most about ``sqrt((1 - f*f) (1 - t*t) / (f*f) / (dim - 1))``. The other side's ``R v`` is
stored in four bits a coordinate with a step and the length of what the rounding left out, which widens the bound. A pair whose
estimate plus ``sigmas`` errors is under the threshold is dropped; the others' cosines are computed again from the full vectors in double
precision, and decide alone.

Pairs are met in buckets. The stored form is turned again, some ``rounds`` times; of each turned vector the ``most`` largest signed
coordinates are taken, and every ``some`` of these make a key. Close vectors have most of these coordinates in common, so
few copies find nearly all pairs. The sums are of
integers, so whoever holds a vector's stored form finds the same keys. A pair at the threshold shares a
key with probability ``1 - miss`` at least: how often coordinates are shared at that angle is measured once, on random vectors, and
``settings`` takes the fewest copies whose buckets stay small. A pair met in several buckets counts in the first of them.
Vectors that are equal bit for bit are compared once and weighted by their number.

To the buckets go stored forms alone, some dim / 2 + 16 bytes. What comes back from a bucket are the vectors that have an open
pair there, and only these meet again with their full components.

A bucket of more than ``block`` vectors is cut into blocks, and each pair of blocks is its own
group, so no bucket is held by one task; pairs are never written as rows: a group gives each of its
vectors' numbers of links, and a forest of edges that connects what is linked (one edge a vector at
most). Vectors that meet no other in a bucket are not sent on.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and are kept; vectors of different lengths do not link; rows that repeat an id count as
vectors of their own, and share the id's component; null ids never name a component unless it has
no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.llm.common import components, cut


@lru_cache(maxsize=256)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def quantised(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``levels, step, left``: rotated vectors as odd numbers from -15 to 15 times a step, and the length of what that leaves out."""
    step = np.maximum(np.abs(turned).max(1), 1e-12) / 16
    levels = 2 * np.clip(np.floor(turned / (2 * step[:, None])), -8, 7) + 1
    return levels, step, np.sqrt(((turned - levels * step[:, None]) ** 2).sum(1))


def packed(levels: np.ndarray) -> np.ndarray:
    """Two levels a byte."""
    four = ((levels + 15) / 2).astype(np.uint8)
    if four.shape[1] % 2:
        four = np.concatenate((four, np.zeros((len(four), 1), np.uint8)), 1)
    return four[:, ::2] << 4 | four[:, 1::2]


def unpacked(codes_: list[bytes], dim: int) -> np.ndarray:
    two = np.frombuffer(b"".join(codes_), np.uint8).reshape(len(codes_), -1)
    return np.stack((two >> 4, two & 15), 2).reshape(len(two), -1)[:, :dim].astype(np.float64) * 2 - 15


def estimates(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors (rows) and rotated vectors (columns), and each row's error for pairs at ``threshold``."""
    dim = turned.shape[1]
    est = np.where(signs, np.float32(1 / math.sqrt(dim)), np.float32(-1 / math.sqrt(dim))) @ turned.T.astype(np.float32) / factor[:, None].astype(np.float32)
    apart = 1.0 if threshold is None else math.sqrt(max(1 - threshold**2, 0))
    return est, apart * np.sqrt(np.maximum(1 - factor**2, 0) / np.maximum(factor**2, 1e-12) / max(dim - 1, 1))


@lru_cache(maxsize=64)
def turns(dim: int, count: int) -> np.ndarray:
    """``count`` further rotations beside each other, in whole thousandths: sums of their products with levels are exact in doubles."""
    return np.concatenate([np.round(rotation(dim, 1000 + i) * 1000) for i in range(count)], 1)


class Scheme(NamedTuple):
    """A key of a table joins ``some`` of the ``most`` largest signed coordinates in each of ``joined`` rotations; there are ``tables`` tables."""

    most: int
    some: int
    joined: int
    tables: int

    @property
    def copies(self) -> int:
        """Keys of a vector."""
        return self.tables * math.comb(self.most, self.some) ** self.joined


def _largest(turned: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest signed coordinates (the negative ones numbered after the others) along the last axis, ascending; of equal ones the first."""
    both = np.concatenate((turned, -turned), -1)
    return np.sort(np.argsort(-both, -1, kind="stable")[..., :most], -1)


def largest(levels: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Per vector, table and rotation of the table its largest signed coordinates."""
    dim, count = levels.shape[1], scheme.tables * scheme.joined
    rows = max(1, 1_000_000 // (count * dim))
    parts = [_largest((levels[i : i + rows] @ turns(dim, count)).reshape(-1, count, dim), scheme.most) for i in range(0, len(levels), rows)]
    return np.concatenate(parts or [np.empty((0, count, scheme.most), int)]).reshape(len(levels), scheme.tables, scheme.joined, scheme.most)


def _number(coordinates: np.ndarray, dim: int) -> np.ndarray:
    """Signed coordinates (last axis) as one number."""
    out = np.zeros(coordinates.shape[:-1], np.int64)
    for i in range(coordinates.shape[-1]):
        out = out * (2 * dim) + coordinates[..., i]
    return out


def keys(levels: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Per vector and table its keys: the last axis has one for each choice of coordinates."""
    dim = levels.shape[1]
    each = list(combinations(range(scheme.most), scheme.some))
    choices = np.array([[i * scheme.most + x for i, one in enumerate(pick) for x in one] for pick in product(each, repeat=scheme.joined)])
    flat = largest(levels, scheme).reshape(len(levels), scheme.tables, -1)
    return _number(flat[:, :, choices], dim)


def first_met(mine: np.ndarray, other: np.ndarray, scheme: Scheme, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The first table in which pairs of ``largest`` rows share a key (-1: none), and the first key that they share there."""
    shared = (mine[..., :, None] == other[..., None, :]).any(-1)
    meets = (shared.sum(-1) >= scheme.some).all(-1)
    table = np.where(meets.any(1), meets.argmax(1), -1)
    at = np.arange(len(mine))
    first = np.sort(np.argsort(~shared[at, table], -1, kind="stable")[..., : scheme.some], -1)
    return table, _number(np.take_along_axis(mine[at, table], first, -1).reshape(len(mine), -1), dim)


#: By how much storing may turn two vectors apart, in radians.
TURNED = 0.04


@lru_cache(maxsize=64)
def _shared(dim: int, threshold: float) -> dict[tuple[int, int], float]:
    """By (most, some): how probably two vectors at ``threshold``, as stored, have ``some`` of their ``most`` largest coordinates in common; four errors below what is measured."""
    rng, n = np.random.default_rng((7, dim)), max(2000, 1_500_000 // dim)
    u, w = rng.standard_normal((2, n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    if dim > 1:
        w -= (w * u).sum(1)[:, None] * u
    angle = math.acos(threshold) + TURNED if dim > 1 else 0.0
    v = math.cos(angle) * u + math.sin(angle) * w / np.maximum(np.linalg.norm(w, axis=1)[:, None], 1e-300)
    out = {}
    for most in range(1, min(dim, 8) + 1):
        hit = (_largest(u, most)[:, :, None] == _largest(v, most)[:, None, :]).any(2).sum(1)
        for some in range(1, min(most, 4) + 1):
            p = float((hit >= some).mean())
            out[most, some] = max(0.0, min(p - 4 * math.sqrt(p * (1 - p) / n), 1 - 1e-3 if dim > 1 else 1.0))
    return out


def settings(n: int, dim: int, threshold: float, miss: float) -> Scheme:
    """The fewest copies with which ``n`` vectors spread evenly make buckets of two thousand or fewer; where no scheme does, that with the smallest buckets."""
    tries = []
    for (most, some), p in _shared(dim, threshold).items():
        for joined in range(1, 7):
            q, each = p**joined, math.comb(most, some) ** joined
            if q < 0.02 or each > 64 or joined * some * math.log2(2 * dim) > 62:
                continue
            tables = 1 if q >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-q))
            spread = (math.comb(dim, some) * 2**some) ** joined / each
            tries.append((max(1.0, n / 2048 / spread), tables * each, Scheme(most, some, joined, tables)))
    return min(tries)[2]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each vector's smallest companion in the links ``a, b``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Stored:
    """Vectors in their stored form."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.levels = unpacked(pdf["code"].tolist(), dim)
        self.factor, self.left = pdf["factor"].to_numpy(float), pdf["left"].to_numpy(float)
        self.turned = (self.levels * pdf["step"].to_numpy(float)[:, None]).astype(np.float32)


def open_pairs(v: Stored, left: np.ndarray, right: np.ndarray | None, threshold: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the vectors ``left`` and ``right`` (or within ``left``) that may link, as positions in ``v``."""
    other = left if right is None else right
    found = []
    for low in range(0, len(left), 1024):
        own = left[low : low + 1024]
        est, err = estimates(v.levels[own] > 0, v.factor[own], v.turned[other], threshold)
        rounding = v.left[other] / math.sqrt(v.levels.shape[1])
        least = threshold - sigmas * np.sqrt(err[:, None] ** 2 + (rounding[None] / v.factor[own][:, None]) ** 2)
        a, b = np.nonzero(est >= least)
        found.append((a + low, b))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    if right is None:
        a, b = a[a < b], b[a < b]
    return left[a], other[b]


def met_here(v: Stored, a: np.ndarray, b: np.ndarray, table: int, key: int, scheme: Scheme) -> np.ndarray:
    """Which pairs of positions meet first in the bucket ``key`` of ``table``."""
    if scheme.copies == 1 or not len(a):
        return np.ones(len(a), bool)
    used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    own, dim = largest(v.levels[used], scheme), v.levels.shape[1]
    ka, kb = at[: len(a)], at[len(a) :]
    out = []
    for i in range(0, len(a), 16_384):
        t, k = first_met(own[ka[i : i + 16_384]], own[kb[i : i + 16_384]], scheme, dim)
        out.append((t == table) & (k == key))
    return np.concatenate(out)


def groups(pdf: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(table, key, positions, positions or None) of each bucket, or pair of a bucket's blocks, of rows in the order of both."""
    own = pdf[["tab", "key", "i", "j"]].to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(1), [True])))
    blk = pdf["blk"].to_numpy()
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        tab, key, i, j = own[s].tolist()
        at = np.arange(s, e)
        yield (tab, key, at, None) if i == j else (tab, key, at[blk[s:e] == i], at[blk[s:e] == j])


def share_count(sizes: DataFrame, block: int, share: int) -> int:
    """How many shares the dealt rows of buckets of ``size`` vectors make: each vector is dealt once for every block of its bucket."""
    dealt = sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / block))).first()[0]
    return max(1, -(-int(dealt or 0) // share))


def near_duplicates(table: DataFrame, threshold: float = 0.9, miss: float = 1e-4, sigmas: float = 5.0, block: int = 2048, share: int = 16_384) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table(vec_id, embedding)``."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = F.coalesce((F.size("e") > 0) & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one value; equal vectors get one node.
    plain = F.when(good, F.transform("e", lambda v: v + F.lit(0.0)))
    own = cut(rows.select("vec_id", plain.alias("e")).withColumn("hash", F.sha2(F.concat_ws(",", F.transform("e", lambda v: v.cast("string"))), 256)).withColumn("hash", F.when(F.col("e").isNotNull(), F.col("hash"))), "rabitq-rows")
    distinct = own.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.first("e").alias("e"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 36  # numbers of their own, fixed once the table is written
        for b in batches:
            pdf = b.to_pandas()
            for dim, part in pdf.groupby(pdf["e"].map(len)):
                raw = np.stack(part["e"].to_numpy()).astype("<f8")
                top = np.abs(raw).max(1)
                odd = (top > 1e100) | (top < 1e-100)  # squares would overflow or vanish
                raw[odd] /= top[odd][:, None]
                turned = raw / np.sqrt((raw**2).sum(1))[:, None] @ rotation(int(dim), 0)
                levels, step, left = quantised(turned)
                factor = np.abs(turned).sum(1) / math.sqrt(dim)
                with np.errstate(over="ignore"):
                    short = raw.astype("<f4")
                stored = [x.tobytes() if (x == y).all() else y.tobytes() for x, y in zip(short, raw, strict=True)]
                cols = [
                    pa.array(part["hash"]), pa.array(part["n"], pa.int64()), pa.array(part["first_id"].astype("Int64"), pa.int64()), pa.array([int(dim)] * len(part), pa.int32()), pa.array(stored), pa.array([x.tobytes() for x in packed(levels)]),
                    pa.array(factor.astype(np.float32)), pa.array(step.astype(np.float32)), pa.array(left.astype(np.float32)), pa.array(np.arange(node, node + len(part))),
                ]
                node += len(part)
                yield pa.RecordBatch.from_arrays(cols, ["hash", "n", "first_id", "dim", "vec", "code", "factor", "step", "left", "node"])

    coded = cut(distinct.mapInArrow(code, "hash string, n long, first_id long, dim int, vec binary, code binary, factor float, step float, left float, node long"), "rabitq-codes")
    schemes = {dim: settings(n, dim, threshold, miss) for dim, n in coded.groupBy("dim").count().collect()}  # a row a length of vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in b.column(1).unique().to_pylist():
                part = b.filter(pc.equal(b.column(1), dim))
                own = keys(unpacked(part.column(2).to_pylist(), dim), schemes[dim])
                n, tables, each = own.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), tables * each)), pa.array(np.full(own.size, dim), pa.int32()), pa.array(np.tile(np.repeat(np.arange(tables), each), n), pa.int32()), pa.array(own.reshape(-1), pa.int64())], ["node", "dim", "tab", "key"])

    buckets = cut(coded.select("node", "dim", "code").mapInArrow(place, "node long, dim int, tab int, key long"), "rabitq-buckets")
    sizes = buckets.groupBy("dim", "tab", "key").agg(F.count("*").alias("size")).where("size > 1")
    placed = buckets.join(sizes, ["dim", "tab", "key"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    # A vector's block, and the block pairs (i <= j) that it takes part in.
    mine = placed.withColumn("blk", F.pmod(F.xxhash64("node", "tab"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("blk", o).alias("i"), F.greatest("blk", o).alias("j")))
    dealt = mine.select("node", "dim", "tab", "key", "blk", F.explode(pair).alias("p")).select("node", "dim", "tab", "key", "blk", "p.i", "p.j")
    # Small buckets share a call; a share holds about ``share`` dealt rows, a vector's copies for its block pairs included.
    shares = share_count(sizes, block, share)
    number = F.pmod(F.xxhash64("dim", "tab", "key", "i", "j"), F.lit(shares)).alias("share")
    forms = dealt.join(coded.select("node", "code", "factor", "step", "left"), "node").select("*", number)
    order = ["tab", "key", "i", "j", "node"]

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        """The vectors of a share's buckets that have an open pair there."""
        pdf = pdf.sort_values(order, ignore_index=True)
        dim = int(pdf["dim"].iat[0])
        v, some = Stored(pdf, dim), np.zeros(len(pdf), bool)
        for tab, key, left, right in groups(pdf):
            a, b = open_pairs(v, left, right, threshold, sigmas)
            here = met_here(v, a, b, tab, key, schemes[dim])
            some[a[here]] = some[b[here]] = True
        return pdf.loc[some, ["node", "dim", "tab", "key", "blk", "i", "j", "share"]]

    marked = cut(forms.groupBy("dim", "share").applyInPandas(mark, "node long, dim int, tab int, key long, blk int, i int, j int, share long"), "rabitq-open")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """The links of a share's buckets, by the full vectors of open pairs."""
        pdf = pdf.sort_values(order, ignore_index=True)
        dim = int(pdf["dim"].iat[0])
        v = Stored(pdf, dim)
        raw = np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8") for x in pdf["vec"]]).astype(float)
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        pairs = [(np.empty(0, int), np.empty(0, int))]
        for tab, key, left, right in groups(pdf):
            a, b = open_pairs(v, left, right, threshold, sigmas)
            here = met_here(v, a, b, tab, key, schemes[dim])
            a, b = a[here], b[here]
            exact = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) for p, q in ((a[i : i + 65536], b[i : i + 65536]) for i in range(0, len(a), 65536)))])
            pairs.append((a[exact >= threshold], b[exact >= threshold]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        node, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        a, b = at[a], at[b]
        count = np.zeros(len(node), np.int64)
        count[at] = pdf["n"].to_numpy()
        links = np.bincount(a, count[b], len(node)) + np.bincount(b, count[a], len(node))
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "to": node[_forest(len(node), a, b)][some]})

    full = marked.join(coded.select("node", "n", "vec", "code", "factor", "step", "left"), "node")
    found = cut(full.groupBy("dim", "share").applyInPandas(link, "node long, links long, to long"), "rabitq-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), "rabitq-cc")
    named = coded.select("hash", "node", "n", "first_id").join(whole, "node", "left").join(links, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    roots = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    per_node = cut(named.join(roots, "component").select("hash", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "rabitq-nodes")
    out = own.select("vec_id", "hash").join(per_node, "hash", "left")
    alone = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), alone.alias("component_id"), F.coalesce(F.col("vec_id") == alone, F.lit(True)).alias("kept"))
