"""Encoding by distinct words: each different word is encoded once a task, its ids are gathered by position.

Both vocabularies split a text into pieces that never cross certain blanks, so a text's ids are
the concatenation of its words' ids. ``WordTable`` numbers the words it meets and stores their
ids back to back; a text is then a vector of word numbers, and its ids one gather. The table is
emptied between batches once it holds ``MOST_WORDS`` words, which bounds a worker's memory. For the
vocabulary with word ends, a batch's different words are encoded in one call, and no table is kept.

Words of plain ASCII and Latin-1 letters are cut by the patterns below and merged by rank;
anything else (special tokens, other scripts, very long pieces) goes to the tokenizers library
as it stands, so that the results are the library's for every text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_WORDS = 200_000
LONG_PIECE = 300
#: Characters for which the short patterns below equal the vocabularies' own.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÿ]*")
PLAIN_WORD = "^[\x21-\x7eÀ-ÿ]*$"
LETTER, LOWER = "A-Za-zÀ-ÖØ-öø-ÿ", "a-zß-öø-ÿ"
BYTE_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
WORD_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^\s0-9{LOWER}]+")
#: Where a text can be cut for the byte-level vocabulary: before a space that a word follows.
CHUNK = re.compile(r"(?= \S)")


def cuts(text: str | None) -> list[str]:
    """The words of a text for the byte-level vocabulary; they join to the text."""
    return [w for w in CHUNK.split(text) if w] if text else []


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level notation: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def library(path: str):
    """The vocabulary in the tokenizers library, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _lines(words: pa.LargeStringArray, end: str) -> str:
    """The words in lower case, ``end`` after each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), end)[0].as_py().lower() + end if len(words) else ""


class WordTable:
    """Numbers of words and their ids. ``word_ends``: the vocabulary marks word ends and drops blanks."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        model = json.load(open(path, encoding="utf-8"))
        self.word_ends = bool(model["model"]["end_of_word_suffix"])
        self.specials = [t["content"] for t in model["added_tokens"]]
        alphabet, end = byte_alphabet(), model["model"]["end_of_word_suffix"] or "\0"
        raw = lambda t: bytes(alphabet[c] for c in t.removesuffix(end)) + (b"\0" if t.endswith(end) else b"")
        ranks = {raw(t): i for t, i in model["model"]["vocab"].items()}
        # Where word ends are marked, U+0000 after a piece stands for the mark. The patterns below take no text that holds it.
        core = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe
        self.merge, self.marked, self.line = core.encode_single_piece, core.encode_ordinary, ranks[b"\n"]
        self.pieces: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.starts, self.lens, self.flat = array("q"), array("i"), array("i")
        self.pieces.clear()

    def _piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            got = self.pieces[piece] = self.merge(piece.encode() + (b"\0" if self.word_ends else b""))
        return got

    def ids(self, word: str) -> list[int]:
        """The ids of one word (with its blanks, where the vocabulary keeps them)."""
        if self.word_ends and word.isascii() and word.isalpha() and len(word) < LONG_PIECE:
            return self._piece(word.lower())
        if PLAIN.fullmatch(word) and "<|" not in word and len(word) < LONG_PIECE:
            out: list[int] = []
            for p in WORD_PIECE.findall(word.lower()) if self.word_ends else BYTE_PIECE.findall(word):
                out += self._piece(p)
            return out
        return library(self.path).encode(word, add_special_tokens=False).ids

    def put(self, word: str, ids: list[int]) -> int:
        n = self.number[word] = len(self.lens)
        self.starts.append(len(self.flat))
        self.lens.append(len(ids))
        self.flat.extend(ids)
        return n

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``offsets, numbers``: text i's words have numbers[offsets[i]:offsets[i + 1]]. Nulls and empty texts have none."""
        cut = [cuts(t) for t in texts.to_pylist()]
        coded = pa.array([w for ws in cut for w in ws], pa.large_string()).dictionary_encode()
        number, put, ids = self.number, self.put, self.ids
        own = [number[w] if w in number else put(w, ids(w)) for w in coded.dictionary.to_pylist()]
        return np.cumsum([0, *map(len, cut)]), np.array(own, np.int64)[coded.indices.to_numpy()] if own else np.empty(0, np.int64)

    def marked_ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``lens, starts, flat``: the ids of words without blanks, back to back, for a vocabulary that marks word ends.

        Short words of plain characters go through one call: their pieces, marked, a line for each word.
        """
        plain = pc.and_(pc.less(pc.binary_length(words), LONG_PIECE), pc.and_not(pc.match_substring_regex(words, PLAIN_WORD), pc.match_substring(words, "<|")))
        alpha = pc.and_(plain, pc.match_substring_regex(words, "^[A-Za-z]+$"))
        text = _lines(words.filter(alpha), "\0\n") + WORD_PIECE.sub("\\g<0>\0", _lines(words.filter(pc.and_not(plain, alpha)), "\n"))
        ids = np.array(self.marked(text), np.int32)
        ends = np.flatnonzero(ids == self.line)
        other = [np.array(library(self.path).encode(w, add_special_tokens=False).ids, np.int32) for w in words.filter(pc.invert(plain)).to_pylist()]
        order = np.argsort(np.select([alpha.to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False)], [0, 1], 2), kind="stable")
        lens, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        lens[order] = np.concatenate((np.diff(ends, prepend=-1) - 1, [len(x) for x in other])).astype(np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        return lens, starts, np.concatenate((ids[ids != self.line], *other))

    def encode(self, texts: Iterable[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``offsets, ids``: text i has ids[offsets[i]:offsets[i + 1]]. A null text is empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if self.word_ends:
            lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
            coded = lists.flatten().dictionary_encode()
            return gather(lists.offsets.to_numpy() - lists.offsets[0].as_py(), coded.indices.to_numpy(), *self.marked_ids(coded.dictionary))
        out = gather(*self.numbers(texts), np.frombuffer(self.lens, np.int32), np.frombuffer(self.starts, np.int64), np.frombuffer(self.flat, np.int32))
        if len(self.lens) > MOST_WORDS:
            self.clear()
        return out


def gather(word_at: np.ndarray, number: np.ndarray, lens: np.ndarray, starts: np.ndarray, flat: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """``offsets, ids`` of texts whose words have ``number[word_at[i]:word_at[i + 1]]``; word k's ids are ``lens[k]`` of ``flat`` from ``starts[k]`` on."""
    if not len(number):
        return np.zeros(len(word_at), np.int64), np.empty(0, np.int32)
    ends = np.cumsum(lens[number], dtype=np.int64)
    ids = np.empty(int(ends[-1]), np.int32)
    for i in range(0, len(number), block):
        k, e = number[i : i + block], ends[i : i + block]
        n = lens[k]
        low = int(e[0]) - int(n[0])
        at = np.arange(low, int(e[-1]), dtype=np.int64)
        at += np.repeat(starts[k] - (e - n), n)
        ids[low : int(e[-1])] = flat[at]
    return np.concatenate(([0], ends))[word_at], ids


def slices(texts: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text, one row at least, so that work arrays stay small.

    What Arrow no longer uses goes back to the system after each of them.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        done = size[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(size, done + most_bytes, "right")))
        yield row, end
        pa.default_memory_pool().release_unused()
        row = end


@lru_cache(maxsize=2)
def table(path: str) -> WordTable:
    """One table for each worker and vocabulary; tasks that follow in the same worker find it filled."""
    return WordTable(path)


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; every operator also takes such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
