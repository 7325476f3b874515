"""Exact token counts at every prefix of a text, by dynamic programming.

In byte-pair encoding, the tokens before the last one of a prefix are the encoding of a shorter
prefix. So ``count[i] = count[i - len(last)] + 1``, where ``last`` is the one vocabulary entry
ending at ``i`` that stays apart from the last token of that shorter prefix (the pair, encoded
together, gives the pair). The program runs over each different word once a task; a document's
counts are the counts at its words' ends plus those inside a word. From them follow the longest
prefix within a token budget, and the count of any cut, without encoding again.

A prefix that ends in blanks is special: its trailing blanks are one piece, although the whole
text may split them. So are a contraction and a special string that a prefix breaks: both are plain characters then.
Where the short patterns do not serve, the library's own splitter says which pieces a text has, once; what a blank is (U+0085 and
U+00A0 are, U+001C to U+001F are not) is asked of it as well. All work is linear in the text but for the length of the longest entry.

Edge cases: null and empty texts have the one count 0; rows stay one for one, null and repeated
ids included; columns other than ``doc_id`` and ``text`` are ignored. Prefixes are in code points. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.llm.words import BYTE_PIECE, PLAIN, byte_alphabet, cuts, library, slices, table, vocabulary

MOST_PAIRS = 400_000
#: Bytes up to which all ends of a piece are tried.
SHORT = 24
#: What the vocabulary's pattern splits off as a piece after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: All characters that Python or the vocabulary's splitter may take for a blank.
MAYBE_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


class PrefixCounts:
    """Counts at every prefix of words of a byte-level vocabulary."""

    def __init__(self, path: str):
        self.path, self.words = path, table(path)
        model, alphabet = json.load(open(path, encoding="utf-8")), byte_alphabet()
        if self.words.word_ends:
            raise ValueError("prefix counts need a byte-level vocabulary")
        self.vocab = {bytes(alphabet[c] for c in t): i for t, i in model["model"]["vocab"].items()}
        self.longest = max(map(len, self.vocab))
        # Lengths of the entries that end in each two bytes, the longest first.
        lengths: dict[bytes, set[int]] = {}
        for t in self.vocab:
            lengths.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {end: sorted(own, reverse=True) for end, own in lengths.items()}
        self.splitter = library(path).pre_tokenizer
        # Between letters, two blanks are two pieces; anything else stays together.
        self.blanks = "".join(c for c in MAYBE_BLANK if c == " " or len(self.splitter.pre_tokenize_str(f"x{c}{c}x")) == 4)
        self.specials = self.words.specials
        self.raw = {i: t for t, i in self.vocab.items()}
        self.apart: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.inner: dict[str, array] = {}
        self.state: tuple[bytes, list[int], list[int]] = (b"", [0], [-1])

    def piece(self, raw: bytes) -> list[int]:
        """``counts[i]``: the tokens of ``raw[:i]``, for a piece that no prefix splits otherwise.

        The states of the piece before are kept as far as both agree, so sorted pieces share their prefixes.
        """
        old, counts, last = self.state
        same = 0
        for x, y in zip(old, raw, strict=False):
            if x != y:
                break
            same += 1
        del counts[same + 1 :], last[same + 1 :]
        get, apart, longest, lengths = self.vocab.get, self.apart, self.longest, self.lengths
        for i in range(same + 1, len(raw) + 1):
            token = get(raw[:i]) if i <= longest else None
            if token is not None:  # the prefix is an entry: nothing is apart from it
                counts.append(1)
                last.append(token)
                continue
            # In a long piece only the lengths that entries with this end have are tried; in a short one that costs more than it spares.
            for j in range(1, i) if i <= SHORT else [i - n for n in lengths.get(raw[i - 2 : i], ()) if n < i] + [i - 1]:
                token = get(raw[j:i])
                if token is not None:
                    key = last[j] << 20 | token
                    got = apart.get(key)
                    if got is None:
                        if len(apart) > MOST_PAIRS:
                            apart.clear()
                        got = apart[key] = self.words.merge(self.raw[last[j]] + raw[j:i]) == [last[j], token]
                    if got:
                        counts.append(counts[j] + 1)
                        last.append(token)
                        break
        self.state = (raw, counts, last)
        return counts

    def fill(self, words: Iterable[str]) -> None:
        """Work out the words that are new, their pieces in sorted order."""
        gc.disable()  # what is made here stays, and holds no cycles
        try:
            self._fill(words)
        finally:
            gc.enable()

    def _fill(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.inner]
        plain = {w: BYTE_PIECE.findall(w) for w in new if PLAIN.fullmatch(w) and not any(s in w for s in self.specials)}
        for p in sorted({p for ps in plain.values() for p in ps if p not in self.pieces}):
            counts = self.piece(p.encode())
            if not p.isascii():
                counts = [counts[k] for k in accumulate((len(c.encode()) for c in p), initial=0)]
            self.pieces[p] = counts[1:]
        for w in new:
            if ps := plain.get(w):
                own = self.pieces[ps[0]] if len(ps) == 1 and w[-1] != " " and w[0] != "'" and not w.isspace() else self._split(ps)
            else:
                own = self._other(w)
            self.inner[w] = array("H" if max(own, default=0) < 1 << 16 else "i", own)

    def word(self, word: str) -> array:
        """Counts of ``word[:1]``, ``word[:2]``, ... (a word as ``cuts`` gives it)."""
        if word not in self.inner:
            self.fill([word])
        return self.inner[word]

    def _of(self, p: str) -> list[int]:
        if p not in self.pieces:
            counts = self.piece(p.encode())
            self.pieces[p] = [counts[k] for k in accumulate(len(c.encode()) for c in p)]
        return self.pieces[p]

    def _split(self, pieces: list[str]) -> list[int]:
        """Counts at every prefix of the pieces' text. Blanks that follow one another are one piece while nothing follows them."""
        out: list[int] = []
        before = run_before = 0
        run, blanks = "", self.blanks
        for p in pieces:
            own = self._of(p)
            bare = p.lstrip(blanks)
            if not bare or p[0] == " ":  # blanks, or a space that the next word takes: a prefix that ends here joins it to the run
                run_before, run = (run_before if run else before), run + p[: len(p) - len(bare)]
                out += [run_before + k for k in self._of(run)[len(run) - (len(p) - len(bare)) :]]
                own_rest = own[len(p) - len(bare) :]
            else:
                own_rest = [1, *[2] * (len(p) - 2), own[-1]] if p[0] == "'" and p[1:] in CONTRACTIONS else own
            if bare:
                run = ""
                out += [before + k for k in own_rest]
            before += own[-1]
        return out

    def _other(self, word: str) -> list[int]:
        """Counts of other scripts and of words that hold special strings: each special string is one token, and parts the word."""
        out: list[int] = []
        before = 0
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", word) if self.specials else [word]
        for i in range(0, len(parts), 2):
            part, special = parts[i], parts[i + 1] if i + 1 < len(parts) else ""
            own = self._plain(part + special[:-1])  # a special string that is not whole is text
            out += [before + k for k in own]
            if special:
                before += (own[len(part) - 1] if part else 0) + 1
                out.append(before)
        return out

    def _plain(self, text: str) -> list[int]:
        """By the pieces that the library's splitter gives."""
        return self._split([text[low:high] for _, (low, high) in self.splitter.pre_tokenize_str(text)])

    def text(self, text: str) -> np.ndarray:
        """``counts[i]``: the tokens of the first ``i`` code points of ``text``."""
        out, before, run_before, run = [np.zeros(1, np.int64)], 0, 0, ""
        for w in cuts(text):
            own = np.array(self.word(w), np.int64) + before
            total = int(own[-1])
            if run and w[0] == " ":  # cut after the space, the blanks before it and it are one piece
                own[0] = run_before + self._of(run + " ")[-1]
            kept = len(w.rstrip(self.blanks))
            run_before, run = int(own[kept - 1]) if kept else before, w[kept:]
            out.append(own)
            before = total
        return np.concatenate(out)

    def trim(self, most: int = 1_200_000) -> None:
        """Forget the words where there are too many; pieces are of use for the words of one slice only."""
        if len(self.inner) > most:
            self.inner.clear()
        self.pieces.clear()


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def fits(counts: np.ndarray, limit: int) -> int:
    """The most code points whose prefix has ``limit`` tokens or fewer."""
    return int(np.flatnonzero(counts <= limit)[-1])


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, counts`` for every row: ``counts[i]`` are the tokens of the text's first i code points."""
    path = path or vocabulary("byte_bpe_50k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            for low, high in slices(b.column(1), 1 << 20):
                own.fill({w for t in b.column(1).slice(low, high - low).to_pylist() for w in cuts(t)})
                rows = [own.text(t or "") for t in b.column(1).slice(low, high - low).to_pylist()]
                own.trim()
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), lists], ["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, counts array<int>")


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fits_chars`` for every row.

    ``fits_chars`` is the most code points whose prefix keeps the limit. The counts at the words'
    ends are added up by word number; only the word in which the limit is passed is looked into.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            for low, high in slices(b.column(1)):
                ids, texts = b.column(0).slice(low, high - low), b.column(1).slice(low, high - low)
                n_tokens, fit = [], []
                cut = [cuts(t) for t in texts.to_pylist()]
                coded = pa.array([w for ws in cut for w in ws], pa.large_string()).dictionary_encode()
                different = coded.dictionary.to_pylist()
                own.fill(different)
                tokens = np.array([own.inner[w][-1] for w in different], np.int64)[coded.indices.to_numpy()] if different else np.empty(0, np.int64)
                place = np.cumsum([0, *map(len, cut)]).tolist()
                for k, (t, words) in enumerate(zip(texts.to_pylist(), cut, strict=True)):
                    ends = np.cumsum(tokens[place[k] : place[k + 1]])
                    n_tokens.append(total := int(ends[-1]) if words else 0)
                    if total <= limit:
                        fit.append(len(t or ""))
                        continue
                    k = int(np.searchsorted(ends, limit, "right"))
                    # From a word earlier, for blanks that this word's first space joins, to a word later.
                    first = max(0, k - 1)
                    done, start = int(ends[first - 1]) if first else 0, sum(map(len, words[:first]))
                    near = own.text("".join(words[first : k + 2])) + done
                    fit.append(start + fits(near, limit))
                own.trim()
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, size, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fit, pa.int64())], names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
