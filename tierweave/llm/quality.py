"""Quality rules with an n-gram perplexity model per language.

The model is a modified Kneser-Ney model of order 4 over the characters of texts, word ends
included; contexts cross word ends. Spark counts the n-grams of every text: those within a word once for each different
word of a batch with its count as weight, those that reach into the word before from the pairs of neighbours, added up in each task before
the shuffle. Characters fold to 63 classes (letters without
case, digits, punctuation marks, the rest by code point), so a language has at most 64**4
n-grams whatever the corpus size: this bounds the model that is sent to every task. N-grams of
words would outgrow the corpus' own size here; see the README.

Each value of ``lang``, null too, has its own model: sorted arrays of 64-bit n-gram hashes (a bijective mix, so no
two n-grams meet) with log probabilities and back-off weights. A task for each language makes it from the counts and
writes it to the shared folder; a scoring task reads the models of the languages that it meets, and holds ``HELD`` of them at most.
Nothing of it passes the driver.

A document's score is the log probability of all its symbols, per letter or digit: marks that are frequent enough
to be known to the model still cost what parts them from prose. A language's bands stand around the median score
of its documents that pass the base rules (exact copies count once): ``upper`` times the distance between the quartiles towards
higher perplexity (text unlike the language), ``lower`` times towards lower (text too regular to be prose). Scores outside reject.

Base rules (words are runs of characters other than space and U+0009..U+000D): fewer than
``min_words`` words, or over half of them in repeated three-word windows, reject.

Edge cases: a null or empty text has no words and fails the base rules; its score is null. Rows
stay one for one, null and repeated ids included; other columns are ignored here and kept by
``keep_good``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierweave.llm.common import WRITTEN, cut, new_folder
from tierweave.llm.storage import system
from tierweave.llm.words import slices

ORDER, CLASSES, EDGE = 4, 64, 63
#: Models that a worker holds: 16 bytes for each n-gram of a language.
HELD = 8
#: Steps of a unit of the score, for its quartiles.
STEPS = 10_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=1)
def fold() -> np.ndarray:
    """Code point -> class 1..62, by rule; the line feed, which parts words, is the edge."""
    at = np.arange(0x110000)
    cls = (44 + at % 19).astype(np.uint8)
    for i in range(0x250):
        low = chr(i).lower()
        c = ord(low) if len(low) == 1 else i
        cls[i] = c - 96 if 97 <= c <= 122 else 27 if 48 <= c <= 57 else 28 + c % 16 if c < 128 else 44 + c % 19
    cls[10] = EDGE
    return cls


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point -> whether it is a letter, mark or digit."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)), bool, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (splitmix64's finish)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``code, order, length``: each symbol's longest n-gram (base-64 digits, first symbol highest) and each word's symbols.

    A word's symbols are its characters and its end; contexts begin at the word's beginning.
    """
    cps = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    s = fold()[cps].astype(np.int64)
    edge = np.flatnonzero(s == EDGE)
    back = np.arange(len(s)) - np.maximum.accumulate(np.where(s == EDGE, np.arange(len(s)), 0))
    order = np.minimum(np.concatenate(([1], back[:-1] + 2)), ORDER)[1:]
    code = s[1:].copy()
    for k in range(1, ORDER):
        shifted = np.concatenate((np.zeros(k, np.int64), s[:-k]))[1:] if k < len(s) else np.zeros(len(s) - 1, np.int64)
        code += np.where(order > k, shifted * CLASSES**k, 0)
    return code, order, np.diff(edge)


def readable(words: list[str]) -> np.ndarray:
    """Each word's letters, marks and digits."""
    cps = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    known = np.concatenate(([0], np.cumsum(letters()[cps])))
    return np.diff(known[np.flatnonzero(cps == 10)])


def crossing(words: list[str], offsets: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, at, one, two``: the words that begin a text, and the others with the n-grams of their first two symbols.

    Only these reach into the word before; a word's later symbols have contexts of its own, as in ``grams``.
    """
    cps = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
    s = fold()[cps].astype(np.int64)
    edge = np.flatnonzero(s == EDGE)
    second = np.minimum(edge[:-1] + 2, len(s) - 1)  # past the end only for the empty word, which no text has
    head, tail = s[edge[:-1] + 1] * CLASSES + s[second], s[edge[1:] - 2] * CLASSES + s[edge[1:] - 1]
    first = np.zeros(len(numbers), bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(~first)
    before, own = tail[numbers[at - 1]], head[numbers[at]]
    return first, at, (before * CLASSES + EDGE) * CLASSES + own // CLASSES, ((before % CLASSES) * CLASSES + EDGE) * CLASSES**2 + own


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``offsets, numbers, words``: the texts' words as numbers into the different ones."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    d = lists.flatten().dictionary_encode()
    words, numbers, offsets = d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if "" in words:  # blanks at either end of a text
        full = numbers != words.index("")
        offsets, numbers = np.concatenate(([0], np.cumsum(full)))[offsets], numbers[full]
    return offsets, numbers, words


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = b.column(0)
            for lang in langs.unique().to_pylist():
                own = b.column(1).filter(pc.is_null(langs) if lang is None else pc.equal(langs, lang))
                for low, high in slices(own):
                    offsets, numbers, words = coded(own.slice(low, high - low))
                    if not len(numbers):
                        continue
                    code, order, length = grams(words)
                    first, _, one, two = crossing(words, offsets, numbers)
                    begins = np.repeat(np.bincount(numbers[first], minlength=len(words)), length)
                    weight = np.where(order == ORDER, np.repeat(np.bincount(numbers, minlength=len(words)), length), begins)
                    across, n = np.unique(np.concatenate((one, two)), return_counts=True)
                    old = sums.get(lang, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    some = weight > 0
                    keys, at = np.unique(np.concatenate((old[0], code[some], across)), return_inverse=True)
                    sums[lang] = keys, np.bincount(at, np.concatenate((old[1], weight[some], n)), len(keys)).astype(np.int64)
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    own = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Modified Kneser-Ney probabilities of the n-grams in sorted hash arrays, one per order."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = 1 + sum((code >= CLASSES**k).astype(np.int64) for k in range(1, ORDER))
        keys, counts = [np.empty(0, np.int64)] * (ORDER + 1), [np.empty(0, np.int64)] * (ORDER + 1)
        keys[ORDER], counts[ORDER] = code[order == ORDER], n[order == ORDER]
        for k in range(ORDER - 1, 0, -1):  # how many different symbols precede; raw counts where a word begins
            own, raw = np.concatenate((keys[k + 1] % CLASSES**k, code[order == k])), np.concatenate((np.ones(len(keys[k + 1]), np.int64), n[order == k]))
            keys[k], at = np.unique(own, return_inverse=True)
            counts[k] = np.bincount(at, raw, len(keys[k])).astype(np.int64)
        self.levels = []
        p = np.empty(0)
        for k in range(1, ORDER + 1):
            c = counts[k]
            d = self._discounts(c)
            ctx, at = np.unique(keys[k] // CLASSES, return_inverse=True)
            total = np.bincount(at, c, len(ctx))
            free = np.bincount(at, d[np.minimum(c, 3)], len(ctx)) / np.maximum(total, 1)
            lower = np.full(len(c), 1.0 / CLASSES) if k == 1 else p[np.searchsorted(keys[k - 1], keys[k] % CLASSES ** (k - 1))]
            own = (c - d[np.minimum(c, 3)]) / total[at] + free[at] * lower
            if k > 1:
                self._back_off(k - 1, keys[k - 1], ctx, free)
            else:
                self.free = float(np.log(free[0] / CLASSES)) if len(free) and free[0] > 0 else float(-np.log(CLASSES) - 5)
            by = np.argsort(mix(keys[k]))
            self.levels.append([mix(keys[k])[by], np.log(np.maximum(own, 1e-12))[by].astype(np.float32), np.zeros(len(c), np.float32)])
            p = own

    @staticmethod
    def _discounts(c: np.ndarray) -> np.ndarray:
        n1, n2, n3, n4 = (int((c == i).sum()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [0.0, *(i - (i + 1) * y * (b / a) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
        return np.array([min(max(v, 0.1 * bool(i)), 0.95 * i) for i, v in enumerate(raw)])

    def _back_off(self, k: int, keys: np.ndarray, ctx: np.ndarray, free: np.ndarray) -> None:
        at = np.searchsorted(keys, ctx)
        there = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == ctx)
        hashes, _, weights = self.levels[k - 1]
        weights[np.searchsorted(hashes, mix(ctx[there]))] = np.log(np.maximum(free[there], 1e-12))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log probability and its number of symbols, for a word that begins a text."""
        code, order, length = grams(words)
        return np.add.reduceat(self.logs(code, order), np.cumsum(length) - length), length

    def occurrences(self, words: list[str], offsets: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The log probability of each word of the texts, after the word before it."""
        code, order, length = grams(words)
        own, start = self.logs(code, order), np.cumsum(length) - length
        first, at, *across = crossing(words, offsets, numbers)
        out = np.where(first, np.add.reduceat(own, start)[numbers], np.add.reduceat(np.where(order == ORDER, own, 0), start)[numbers])
        for codes in across:
            different, back = np.unique(codes, return_inverse=True)
            out[at] += self.logs(different, np.full(len(different), ORDER))[back]
        return out

    def logs(self, code: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The log probability of each n-gram's last symbol."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            now = left[order[left] >= k]
            rest = left[order[left] < k]
            hashes, logp, _ = self.levels[k - 1]
            found, at = self._find(hashes, code[now] % CLASSES**k)
            out[now[found]] += logp[at[found]]
            missed = now[~found]
            if k > 1 and len(missed):
                hashes, _, weights = self.levels[k - 2]
                known, at = self._find(hashes, (code[missed] % CLASSES**k) // CLASSES)
                out[missed[known]] += weights[at[known]]
            left = np.concatenate((rest, missed))
        out[left] += self.free
        return out

    @staticmethod
    def _find(hashes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hashes):
            return np.zeros(len(code), bool), np.zeros(len(code), np.int64)
        h = mix(code)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return hashes[at] == h, at


def _place(folder: str, lang: str | None) -> str:
    return f"{folder}/{'none' if lang is None else 'x' + hashlib.sha1(lang.encode()).hexdigest()}.npz"


def fit(docs: DataFrame) -> str:
    """The folder of the languages' models. A language has 64**4 n-grams at most, and one task makes its model of them."""
    folder = new_folder(docs.sparkSession, "quality-models")
    WRITTEN.append(folder)

    def make(part: pa.Table) -> pa.Table:
        lang = part["lang"][0].as_py()
        own = Model(part["gram"].to_numpy(), part["n"].to_numpy())
        out = io.BytesIO()
        np.savez(out, free=own.free, **{f"{name}{k}": x for k, level in enumerate(own.levels) for name, x in zip("hpw", level, strict=True)})
        filesystem, base = system(folder)
        filesystem.create_dir(base, recursive=True)
        attempt = f"{_place(base, lang)}-{uuid.uuid4().hex}"
        with filesystem.open_output_stream(attempt) as f:
            f.write(out.getvalue())
        try:
            filesystem.move(attempt, _place(base, lang))
        except OSError:  # another attempt was faster, on file systems that do not replace
            filesystem.delete_file(attempt)
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    gram_counts(docs).groupBy("lang").applyInArrow(make, "n long").agg(F.sum("n")).collect()
    return folder


@lru_cache(maxsize=HELD)
def model(folder: str, lang: str | None) -> Model:
    """A language's model from the folder."""
    filesystem, base = system(folder)
    with filesystem.open_input_file(_place(base, lang)) as f:
        stored = np.load(io.BytesIO(f.read()))
    own = Model.__new__(Model)
    own.free, own.levels = float(stored["free"]), [[stored[f"{name}{k}"] for name in "hpw"] for k in range(ORDER)]
    return own


def _repeated(numbers: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(numbers) < 4:
        return 0
    n = numbers.astype(np.int64)
    _, pair = np.unique((n[:-1] << 32) | n[1:], return_inverse=True)
    _, at, count = np.unique((pair[:-1].astype(np.int64) << 32) | n[2:], return_inverse=True, return_counts=True)
    again = count[at] > 1
    covered = np.zeros(len(n), bool)
    for k in range(3):
        covered[k : len(n) - 2 + k] |= again
    return int(covered.sum())


def _duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, logp`` for every row, by the models in ``folder``."""
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "logp"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1)
            for lang in langs.unique().to_pylist():
                part = b.filter(pc.is_null(langs) if lang is None else pc.equal(langs, lang))
                for low, high in slices(part.column(2)):
                    rows = part.slice(low, high - low)
                    texts = [t or "" for t in rows.column(2).to_pylist()]
                    offsets, numbers, words = coded(rows.column(2))
                    count = np.diff(offsets)
                    if len(numbers):
                        pad = np.append(model(folder, lang).occurrences(words, offsets, numbers), 0.0), np.append(readable(words)[numbers], 0)
                        total, plain = (np.where(count > 0, np.add.reduceat(x, offsets[:-1]), 0) for x in pad)
                        logp = [float(t / max(k, 1)) if n else None for t, k, n in zip(total, plain, count, strict=True)]
                    else:
                        logp = [None] * len(texts)
                    cols = [
                        rows.column(0), rows.column(1), pa.array(count, pa.int64()), pa.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], pa.int64()),
                        pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()), pa.array(list(map(_duplicate_lines, texts)), pa.int64()),
                        pa.array([_repeated(numbers[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()), pa.array(logp, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, logp double"
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(work, schema)


def quartiles(scores: DataFrame) -> DataFrame:
    """``lang, q``: the exact quartiles of ``scores(lang, logp)``, rounded to ``1 / STEPS``.

    Scores are counted by step, so a language has a row a step (some 16 times ``STEPS`` at most, whatever the corpus), and the counts are added up in order.
    """
    counted = scores.where("logp is not null").groupBy("lang", F.round(F.col("logp") * STEPS).cast("long").alias("step")).agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    placed = counted.withColumn("upto", up_to).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * share), F.col("step"))) / F.lit(float(STEPS)) for share in (0.25, 0.5, 0.75)]
    return placed.groupBy("lang").agg(F.array(*at).alias("q"))


def assess(docs: DataFrame, min_words: int = 50, upper: float = 6.0, lower: float = 5.0) -> DataFrame:
    """The measures, ``base_failed``, the language's bands and ``kept`` for every row of ``docs``."""
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = cut(measure(docs, fit(docs)).withColumn("base_failed", base_failed), "quality-measures")
    bands = quartiles(found.where("not base_failed").select("lang", "logp").distinct())
    width = F.col("q")[2] - F.col("q")[0]
    bands = bands.select(F.col("lang").alias("_lang"), (F.col("q")[1] - upper * width).alias("low"), (F.col("q")[1] + lower * width).alias("high"))
    both = found.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.coalesce(F.col("logp").between(F.col("low"), F.col("high")), F.lit(False))
    measures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    ppl = [F.exp(-F.col(c)).alias(a) for c, a in (("logp", "perplexity"), ("high", "lower_band"), ("low", "upper_band"))]
    return both.select(*measures, (~F.col("base_failed") & inside).alias("kept"), *ppl)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are rejected. Rows that share an id (null too) stay if any of them is kept."""
    good = assess(docs, **options).where("kept").select("doc_id").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["doc_id"]), "left_semi")
