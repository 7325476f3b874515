"""Language of a text by prediction by partial matching: the language whose frozen byte contexts code it shortest.

Each learned value of ``lang`` has a variable-order tree of byte contexts, up to ``ORDER`` bytes long. A text is
coded word by word: a word is a run of letters and marks in lower case, in UTF-8, and a space that ends it; contexts
begin with the space before the word, so each different word has one code length, worked out once a batch.

At a context, a byte seen there has probability n / (N + d), where N counts the bytes seen there and d the different
ones; d / (N + d) is the probability of escape to the context that is one byte shorter. Bytes of the longer context
are excluded from the shorter one (they would not have led to an escape): its N and d are those of the others. After
the empty context, all bytes left are equally likely. So the probabilities of the 256 bytes add up to 1 at every
context, and a code length is exact: the negative logarithm, in whole 2**-16 bits, so that sums depend on no order.

Spark counts the longest n-grams of all learned rows (added up in each task before the shuffle), sums them to all
orders, and joins each context with its parent for what stays after exclusion. A language's tree keeps the contexts
that hold at least ``languages / nodes`` of its bytes: at most ``nodes`` contexts an order over all languages, whatever
the corpus. The trees are a Parquet table in the shared folder, which each worker reads once.

Edge cases: a null text, a text without a letter, and every text where nothing was learned, are ``und`` with score 0.
Of equally short codes the first language by alphabet stands. Rows without an id are neither learned nor held out;
rows stay one for one, repeated ids included; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierweave.llm.common import WRITTEN, cut, new_folder
from tierweave.llm.quality import coded
from tierweave.llm.storage import system
from tierweave.llm.words import slices

ORDER = 4
#: An n-gram's bytes, the newest lowest, stand below its order.
SHIFT = 48
UNIT = 1 << 16
#: Different n-grams of a language that a counting task holds before it hands them on.
MOST_GRAMS = 1 << 21
#: Languages whose sizes are sent to every task; more of them are joined by a shuffle.
FEW_LANGS = 10_000
#: N-grams whose code lengths are worked out together.
CHUNK = 1 << 15


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Code point -> 2 for a letter, 1 for a mark, 0 otherwise."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``code, ends, letters``: the longest n-gram of each byte of the tokens' words, where each token's bytes end, its number of letters."""
    points = np.frombuffer(("\n".join(tokens) + "\n").lower().encode("utf-32-le"), np.uint32)
    kind, parts = classes()[points], np.flatnonzero(points == 10)
    plain = np.where(kind > 0, points, 32).astype("<u4")
    width = 1 + (plain >= 0x80) + (plain >= 0x800) + (plain >= 0x10000)
    raw = np.frombuffer(plain.tobytes().decode("utf-32-le").encode(), np.uint8)
    blank = raw == 32
    kept = ~(blank & np.concatenate(([True], blank[:-1])))  # one space a word, none before the first
    ends = np.cumsum(kept)[np.cumsum(width)[parts] - 1]
    own = np.concatenate((np.full(ORDER, 32, np.uint8), raw[kept])).astype(np.int64)
    at = np.arange(len(own))
    space = np.maximum.accumulate(np.where(own == 32, at, 0))
    order = np.minimum(at[ORDER:] - space[ORDER - 1 : -1], ORDER)
    code = order << SHIFT
    for k in range(ORDER + 1):
        code += np.where(order >= k, own[ORDER - k : len(own) - k] << 8 * k, 0)
    return code, ends, np.add.reduceat((kind == 2).astype(np.int64), np.concatenate(([0], parts[:-1])))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, code, n`` of the longest n-grams of ``docs(lang, text)``."""

    def rows(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang in b.column(0).unique().to_pylist():
                own = b.column(1).filter(pc.equal(b.column(0), lang))
                for low, high in slices(own):
                    _, numbers, tokens = coded(own.slice(low, high - low))
                    if not tokens:
                        continue
                    code, ends, _ = grams(tokens)
                    weight = np.repeat(np.bincount(numbers, minlength=len(tokens)), np.diff(ends, prepend=0))
                    old = sums.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    keys, at = np.unique(np.concatenate((old[0], code)), return_inverse=True)
                    sums[lang] = keys, np.bincount(at, np.concatenate((old[1], weight)), len(keys)).astype(np.int64)
                    if len(keys) > MOST_GRAMS:
                        yield rows(lang, *sums.pop(lang))
        for lang, own in sums.items():
            yield rows(lang, *own)

    own = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    return own.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _tail(c: Column, n_bytes: Column) -> Column:
    """The newest ``n_bytes`` bytes of an n-gram."""
    return c.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (8 * n_bytes).cast("int")) - 1)


def fit(docs: DataFrame, nodes: int = 1_000_000) -> str:
    """The folder of the trees learned from all rows of ``docs(lang, text)`` with a language.

    Its rows ``lang, k, gram, n, total, kinds, rest, rest_kinds``: ``gram`` is the context of ``k`` bytes and the byte after it, seen
    ``n`` times; the context is followed by ``total`` bytes, ``kinds`` different ones, and its parent by ``rest`` and ``rest_kinds`` others.
    """
    spark = docs.sparkSession
    longest = cut(gram_counts(docs), "ppm-longest")
    k = F.explode(F.sequence(F.lit(0), F.shiftright("code", SHIFT).cast("int"))).alias("k")
    every = longest.select("lang", "code", "n", k).select("lang", "k", _tail(F.col("code"), F.col("k") + 1).alias("gram"), "n")
    every = every.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).withColumn("context", F.shiftright("gram", 8))
    every = cut(every, "ppm-grams")
    contexts = every.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    size = cut(every.where("k = 0").groupBy("lang").agg(F.sum("n").alias("bytes")), "ppm-languages")
    n_langs = size.count()
    size = size.select("lang", (F.col("bytes") * (n_langs / nodes)).alias("least"))
    contexts = contexts.join(F.broadcast(size) if n_langs <= FEW_LANGS else size, "lang").where("k = 0 or total >= least").drop("least")
    kept = cut(every.join(contexts, ["lang", "k", "context"]), "ppm-kept")
    parent = kept.select("lang", (F.col("k") + 1).alias("k"), F.col("gram").alias("_tail"), F.col("n").alias("_n"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
    child = kept.where("k > 0").withColumn("_tail", _tail(F.col("gram"), F.col("k")))
    left = child.join(parent, ["lang", "k", "_tail"]).groupBy("lang", "k", "context").agg((F.max("_total") - F.sum("_n")).alias("rest"), (F.max("_kinds") - F.count("*")).alias("rest_kinds"))
    folder = new_folder(spark, "ppm-trees")
    WRITTEN.append(folder)
    kept.join(left, ["lang", "k", "context"], "left").drop("context").write.parquet(folder)
    return folder


class Trees:
    """All languages' trees in sorted arrays: a row for each context, and for each n-gram, that any language has."""

    def __init__(self, t: pa.Table):
        column = lambda name: t[name].to_numpy().astype(np.int64)
        langs = pc.unique(t["lang"]).sort().to_pylist() if t.num_rows else []
        self.langs = langs
        lang = pc.index_in(t["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int64) if langs else np.empty(0, np.int64)
        k, gram = column("k"), column("gram")
        self.grams, self.gram_at, order = self._index((k << SHIFT) | gram, lang)
        self.gram_lang, self.n = lang[order], np.log2(np.maximum(column("n"), 1))[order]
        _, first = np.unique(((k << SHIFT) | (gram >> 8)) * max(len(langs), 1) + lang, return_index=True)
        self.contexts, self.context_at, order = self._index(((k << SHIFT) | (gram >> 8))[first], lang[first])
        of = lambda name: (pc.fill_null(t[name], 0).to_numpy().astype(np.int64)[first][order]) if len(first) else np.empty(0, np.int64)
        total, kinds, rest, rest_kinds = map(of, ("total", "kinds", "rest", "rest_kinds"))
        log = lambda x: np.log2(np.maximum(x, 1))
        self.context_lang = lang[first][order]
        #: Of a context: the logarithms of its sum and of its escape, then those of its parent's sum and escape after exclusion.
        self.weights = np.stack((log(total + kinds), log(kinds), log(rest + rest_kinds), log(rest_kinds)))
        #: After the empty context: the bytes that it lacks.
        self.last = np.zeros(len(langs))
        if langs:
            root = slice(self.context_at[0], self.context_at[1])
            self.last[self.context_lang[root]] = np.log2(np.maximum(256 - kinds[root], 1))

    @staticmethod
    def _index(keys: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((lang, keys))
        different, starts = np.unique(keys[order], return_index=True)
        return different, np.append(starts, len(keys)), order

    @staticmethod
    def _find(keys: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row of wanted, row of the table`` for all languages' entries of the wanted keys."""
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = np.flatnonzero(keys[place] == wanted)
        place = place[found]
        n = at[place + 1] - at[place]
        return np.repeat(found, n), np.arange(n.sum()) + np.repeat(at[place] - (np.cumsum(n) - n), n)

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """The code length of each n-gram's newest byte in each language, in 2**-16 bits."""
        return np.concatenate([self._lengths(code[i : i + CHUNK]) for i in range(0, len(code), CHUNK)]) if len(code) and self.langs else np.zeros((len(code), len(self.langs)), np.int64)

    def _lengths(self, code: np.ndarray) -> np.ndarray:
        shape = len(code), len(self.langs)
        out, done, entered = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        total, escape = np.zeros(shape), np.zeros(shape)  # at the context entered by escape, after exclusion
        order = code >> SHIFT
        for k in range(ORDER, -1, -1):
            rows = np.flatnonzero(order >= k)
            gram = code[rows] & ((1 << 8 * (k + 1)) - 1)
            at, own = self._find(self.contexts, self.context_at, (k << SHIFT) | (gram >> 8))
            there, weights = np.zeros(shape, bool), np.zeros((4, *shape))
            there[rows[at], self.context_lang[own]] = True
            weights[:, rows[at], self.context_lang[own]] = self.weights[:, own]
            there &= ~done
            total, escape = (np.where(entered, old, new) for old, new in ((total, weights[0]), (escape, weights[1])))
            at, own = self._find(self.grams, self.gram_at, (k << SHIFT) | gram)
            known, n = np.zeros(shape, bool), np.zeros(shape)
            known[rows[at], self.gram_lang[own]] = True
            n[rows[at], self.gram_lang[own]] = self.n[own]
            out += np.where(there, total - np.where(known, n, escape), 0)
            done |= there & known
            total, escape = (np.where(there, new, old) for old, new in ((total, weights[2]), (escape, weights[3])))
            entered |= there
        return np.rint((out + np.where(done, 0, self.last)) * UNIT).astype(np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``lengths, letters``: each text's code length in each language, and its number of letters."""
        offsets, numbers, tokens = coded(texts)
        if not tokens:
            return np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        code, ends, letters = grams(tokens)
        different, at = np.unique(code, return_inverse=True)
        sums = np.concatenate((np.zeros((1, len(self.langs)), np.int64), np.cumsum(self.lengths(different)[at], axis=0)))
        each = np.diff(np.concatenate(([0], ends)))
        token = sums[ends] - sums[ends - each]
        some = np.diff(offsets) > 0
        pad = lambda x: np.concatenate((x[numbers], np.zeros((1, *x.shape[1:]), np.int64)))
        total, seen = (np.add.reduceat(pad(x), offsets[:-1]) for x in (token, letters))
        return np.where(some[:, None], total, 0), np.where(some, seen, 0)


@lru_cache(maxsize=2)
def trees(folder: str) -> Trees:
    filesystem, path = system(folder)
    return Trees(ds.dataset(path, filesystem=filesystem, format="parquet", schema=TREES).to_table())


TREES = pa.schema([("lang", pa.string()), ("k", pa.int32()), *((name, pa.int64()) for name in ("gram", "n", "total", "kinds", "rest", "rest_kinds"))])


def predict(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, lang_pred, score, bits`` for every row of ``docs(doc_id, text)``, by the trees in ``folder``.

    ``score`` is the language's share of the probabilities of all languages, each as likely before the text; ``bits`` is the code length.
    """
    names = ["doc_id", "lang_pred", "score", "bits"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees(folder)
        for b in batches:
            for low, high in slices(b.column(1)):
                rows = b.slice(low, high - low)
                lengths, letters = own.texts(rows.column(1))
                known = (letters > 0) & bool(own.langs)
                if own.langs:
                    best = lengths.argmin(axis=1)
                    least = lengths[np.arange(len(best)), best]
                    score = 1 / np.exp2(np.maximum((least[:, None] - lengths) / UNIT, -1000.0)).sum(axis=1)
                    pred = pa.array(own.langs, pa.string()).take(pa.array(best))
                else:
                    least, score, pred = np.zeros(len(letters), np.int64), np.zeros(len(letters)), pa.nulls(len(letters), pa.string())
                cols = [rows.column(0), pc.if_else(pa.array(known), pred, "und"), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, least / UNIT, 0.0))]
                yield pa.RecordBatch.from_arrays(cols, names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(work, "doc_id long, lang_pred string, score double, bits double")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept from learning: by its id's CRC-32."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, nodes: int = 1_000_000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits`` for every row of ``docs``; learned from the rows with an id and a language that are not held out."""
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = predict(docs, fit(learned, nodes))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
