"""Secret scans: fixed formats, plus candidates accepted by a small character convolutional network.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a key word, then a value of
8+ characters), ``access`` (AKIA and so on, 16+ characters), ``hex`` (32+ lower-case hex digits). Matches
that fail their length are dropped. Base spans are always reported.

Candidates are the base spans (of an assignment its value) and every run of ``least`` = 12 or more value
characters. The network reads each of them with the text around it as characters: 24 before, 48 of the
candidate, 8 after; one convolution, the largest response inside the candidate and outside it and the mean
inside, one hidden layer, one output. Runs that it accepts become spans of kind ``token`` unless they
overlap a base span. Candidates longer than 48 characters are read in overlapping parts and take the
highest output, so no part of a candidate is ignored.

The network is written in numpy and trained here on labelled findings that are written out by a fixed
rule (``examples`` of them, a bounded number): random strings in the usual formats against words, names,
paths, numbers and identifiers. A sixth of them calibrates the output (Platt), another sixth sets the threshold: the highest
at which the share of true findings kept stays at ``recall`` or above, with a margin of 1.64
standard errors of that share. Such findings say nothing certain about other text.

Edge cases: null and empty texts have no spans; rows stay one for one, null and repeated ids
included; other columns are ignored. Positions are code points, ends exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierweave.llm.words import slices

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
KEY_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
CLASSES = 44
#: Characters between joined texts, more than a window reads outside its candidate.
GAP = 96


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, number of the kind, end, where the value starts) of the base kinds."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if KEY_WORD.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``codes, places``: the texts' characters (those past U+00FF as one class) with gaps between, and where each text begins."""
    gap = "\0" * GAP
    codes = np.frombuffer((gap + gap.join(texts) + gap).encode("latin-1", "replace"), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + GAP
    return codes, GAP + np.cumsum(size) - size


@lru_cache(maxsize=1)
def _value_characters() -> np.ndarray:
    return np.array([c < 128 and (chr(c).isalnum() or chr(c) in "+/_.=-") for c in range(256)])


def runs(codes: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs of ``least`` or more value characters."""
    edge = np.flatnonzero(np.diff(_value_characters()[codes].view(np.int8)))
    start, end = edge[::2] + 1, edge[1::2] + 1
    long = end - start >= least
    return start[long], end[long]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Character -> class: each digit group, letters by case and position, marks; 0 is padding."""
    own = np.full(256, 43, np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isascii() and c.isdigit():
            own[i] = 1 + i % 2
        elif c.isascii() and c.isalpha():
            vowel = c.lower() in "aeiou"
            own[i] = (3 if vowel else 5 + (ord(c.lower()) - 97) % 8) + (c.isupper() * 12 if not vowel else c.isupper())
        elif c in "+/_=-.:\"' \n,;()@#%&?":
            own[i] = 25 + "+/_=-.:\"' \n,;()@#%&?".index(c) % 18
    own[0] = 0
    return own


def windows(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network reads of the candidates, a row each 24 characters of a long one, and each row's candidate."""
    half = INSIDE // 2
    parts = np.maximum(1, -(-(end - start - half) // half))
    of = np.repeat(np.arange(len(start)), parts)
    first = start[of] + half * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    stop = np.minimum(end[of], first + INSIDE)
    inside = first[:, None] + np.arange(INSIDE)
    own = np.concatenate((
        codes[first[:, None] - BEFORE + np.arange(BEFORE)], np.where(inside < stop[:, None], codes[np.minimum(inside, len(codes) - 1)], 0),
        codes[stop[:, None] + np.arange(AFTER)],
    ), 1)
    return classes()[own], of


def findings(examples: int = 6000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings by rule: ``windows, labels``. True ones are random strings in the usual formats; false ones
    are words, slugs, paths, identifiers, addresses, versions, dates and numbers."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum, hexes = letters + letters.upper() + "0123456789", "0123456789abcdef"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "re", "an", "in", "st", "ou", "la", "de", "en", "ment", "tion", "que", "ar", "os")) for _ in range(rng.randint(1, 4)))
    long = lambda: "".join(rng.choice(("th", "er", "on", "re", "an", "in", "st", "ou", "la", "de", "en", "ment", "tion", "que", "ar", "os", "sch", "ung", "ble", "ly")) for _ in range(rng.randint(5, 9)))
    prose = lambda: " ".join(word() for _ in range(6))
    digits = lambda n: pick("0123456789", n)
    true = (
        lambda: "ghp_" + pick(alnum, 36), lambda: "ghp_" + pick(alnum, 3) * 12, lambda: "sk-" + pick(alnum, 40), lambda: "xoxb-" + digits(11) + "-" + pick(alnum, 24), lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: pick(alnum + "+/", 40), lambda: pick(alnum + "+/", 42) + "==", lambda: "eyJ" + pick(alnum, 17) + "." + pick(alnum, 30) + "." + pick(alnum + "_-", 43), lambda: "AKIA" + pick(letters.upper() + digits(3), 16),
        lambda: pick(alnum, rng.randint(18, 40)), lambda: pick(letters.upper() + "234567", rng.randint(20, 32)), lambda: pick(hexes, rng.randint(20, 64)), lambda: pick(hexes.upper(), rng.randint(20, 64)),
    )
    false = (
        lambda: "-".join(word() for _ in range(4)) + f"-{rng.randint(1, 2030)}", lambda: "/".join(word() for _ in range(4)) + f"/{rng.randint(1, 99)}", lambda: f"{word()}_{word()}_{word()}_{rng.randint(0, 999)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-00-00Z", lambda: f"{long()}{rng.randint(0, 99)}", lambda: f"{word().title()}{word().title()}{word().title()}V{rng.randint(1, 9)}Factory",
        lambda: f"ISBN-978-{rng.randint(0, 9)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}", lambda: rng.choice("=-._") * rng.randint(12, 40), lambda: f"{pick(hexes, 8)}-{pick(hexes, 4)}-4{pick(hexes, 3)}-a{pick(hexes, 3)}-{pick(hexes, 12)}",
        lambda: f"{word()}{rng.randint(1, 99)}_{word()}{rng.randint(1, 99)}_{word()}", lambda: pick(alnum, rng.randint(1, 2)) * rng.randint(8, 20), long, lambda: long().upper() + rng.choice(("", ".")), lambda: long().title() + rng.choice(("", ".", "-" + word())),
        lambda: digits(rng.randint(12, 19)), lambda: ".".join(digits(rng.randint(1, 3)) for _ in range(4)), lambda: f"{word()}.{word()}.example.com", lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", lambda: "0" * rng.randint(12, 40), lambda: f"{word()}...{word()}{word()}{word()}",
    )
    lead = ("", "key ", "use ", 'auth: "', "Authorization: Bearer ", "credentials ", "", 'token = "', "password: ", "secret=")
    other = ("", "see ", "file ", "https://example.org/", "version ", "", "id ", "page ", "order ", "token: ")
    texts, at, labels = [], [], []
    for i in range(examples):
        label = i % 2
        made = rng.choice(true if label else false)()
        before = f"{prose()} {rng.choice(lead if label else other)}"
        texts.append(f"{before}{made}{rng.choice((' ', '. ', chr(34)))}{prose()}")
        at.append((len(before), len(before) + len(made)))
        labels.append(label)
    codes, places = joined(texts)
    start, end = np.array(at).T + places
    rows, of = windows(codes, start, end)
    return rows[np.concatenate(([True], of[1:] != of[:-1]))], np.array(labels, float)


class Network:
    """Embedding by one-hot convolution, ReLU, maximum inside and outside the candidate, hidden layer, sigmoid."""

    KERNEL, FILTERS, HIDDEN = 5, 24, 16

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {
            "k": rng.normal(0, 0.2, (self.KERNEL, CLASSES, self.FILTERS)), "kb": np.zeros(self.FILTERS), "h": rng.normal(0, 0.2, (3 * self.FILTERS, self.HIDDEN)), "hb": np.zeros(self.HIDDEN),
            "o": rng.normal(0, 0.2, self.HIDDEN), "ob": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> dict:
        n = WIDTH - self.KERNEL + 1
        conv = self.w["kb"] + sum(self.w["k"][j][x[:, j : j + n]] for j in range(self.KERNEL))
        act = np.maximum(conv, 0)
        inside = np.zeros(n, bool)
        inside[BEFORE - 1 : BEFORE + INSIDE - self.KERNEL + 1] = True
        length = np.maximum((x[:, BEFORE : BEFORE + INSIDE] > 0).sum(1), 1)[:, None]
        first, second = np.where(inside[None, :, None], act, -1), np.where(inside[None, :, None], -1, act)
        i, j = first.argmax(1), second.argmax(1)
        mean = (act * inside[None, :, None]).sum(1) / length
        f = np.concatenate((np.take_along_axis(act, i[:, None], 1)[:, 0], np.take_along_axis(act, j[:, None], 1)[:, 0], mean), 1)
        hidden = np.maximum(f @ self.w["h"] + self.w["hb"], 0)
        return {"x": x, "act": act, "inside": inside, "length": length, "i": i, "j": j, "f": f, "hidden": hidden, "z": hidden @ self.w["o"] + self.w["ob"][0]}

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])["z"] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.004, recall: float = 0.97, seed: int = 7) -> Network:
        """Two thirds of the rows train, a sixth calibrates, a sixth sets the threshold."""
        rng, part = np.random.default_rng(seed), (np.arange(len(x)) // 2) % 6
        tx, ty = x[part < 4], y[part < 4]
        m, v, t = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(tx))
            for s in range(0, len(tx), 64):
                own = order[s : s + 64]
                g, t = self._gradient(tx[own], ty[own]), t + 1
                for k in self.w:  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, hy = self.raw(x[part == 4]), y[part == 4]
        target = np.where(hy > 0, (hy.sum() + 1) / (hy.sum() + 2), 1 / ((1 - hy).sum() + 2))
        for _ in range(400):  # Platt scaling
            d = target - 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
            self.scale, self.shift = self.scale + 0.05 * float((d * z).mean()), self.shift + 0.05 * float(d.mean())
        good = np.sort(self.probability(x[(part == 5) & (y > 0)]))
        lost = (1 - recall) * len(good) - 1.64 * math.sqrt(recall * (1 - recall) * len(good))
        self.threshold = float(good[max(0, int(lost))])
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        c = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(c["z"], -30, 30))) - y) / len(y)
        dh = np.outer(dz, self.w["o"]) * (c["hidden"] > 0)
        df = dh @ self.w["h"].T
        n = self.FILTERS
        da = c["inside"][None, :, None] * (df[:, None, 2 * n :] / c["length"][:, :, None])
        rows, cols = np.arange(len(x))[:, None], np.arange(n)[None]
        np.add.at(da, (rows, c["i"], cols), df[:, :n])
        np.add.at(da, (rows, c["j"], cols), df[:, n : 2 * n])
        da = da * (c["act"] > 0)
        dk = np.zeros_like(self.w["k"])
        size = da.shape[1]
        for j in range(self.KERNEL):
            np.add.at(dk[j], x[:, j : j + size].reshape(-1), da.reshape(-1, n))
        return {"k": dk, "kb": da.sum((0, 1)), "h": c["f"].T @ dh, "hb": dh.sum(0), "o": c["hidden"].T @ dz, "ob": np.array([dz.sum()])}


@lru_cache(maxsize=2)
def trained(examples: int = 6000, recall: float = 0.97) -> Network:
    return Network().fit(*findings(examples), recall=recall)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def judge(net: Network, codes: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 4096) -> np.ndarray:
    """Each candidate's probability, the highest of its parts'."""
    out = np.zeros(len(start))
    parts = np.cumsum(np.maximum(1, (end - start) // (INSIDE // 2)))
    at = 0
    while at < len(start):  # about ``block`` rows at a time, so that only a single candidate can make more
        stop = max(at + 1, int(np.searchsorted(parts, (parts[at - 1] if at else 0) + block, "right")))
        rows, of = windows(codes, start[at:stop], end[at:stop])
        np.maximum.at(out[at:stop], of, net.probability(rows))
        at = stop
    return out


def scan(docs: DataFrame, network: Network | None = None, least: int = 12) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_scored, scores`` for every row.

    ``n_scored`` counts the candidates the network has judged; ``scores`` gives its probability (three
    decimals) for each span of ``spans``, in their order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network or trained())
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "n_scored", "scores"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for low, high in slices(b.column(1)):
                texts = [t or "" for t in b.column(1).slice(low, high - low).to_pylist()]
                base = [base_spans(t) if t else [] for t in texts]
                codes, places = joined(texts)
                start, end = runs(codes, least)
                values = np.array([(places[i] + v, places[i] + e) for i, own in enumerate(base) for _, _, e, v in own], np.int64).reshape(-1, 2)
                score = judge(net, codes, np.concatenate((values[:, 0], start)), np.concatenate((values[:, 1], end)))
                base_score, score = score[: len(values)].tolist(), score[len(values) :]
                of = np.searchsorted(places, start, "right") - 1
                scored = np.bincount(of, minlength=len(texts)) + np.fromiter(map(len, base), np.int64, len(base))
                spans, taken = [], iter(base_score)
                for own in base:
                    spans.append([(s, k, e, next(taken)) for s, k, e, _ in own])
                # The base spans that begin before a run ends, and the farthest end of these: past the run's start, they overlap.
                begins = np.array([places[i] + s for i, own in enumerate(base) for s, _, _, _ in own], np.int64)
                farthest = np.maximum.accumulate(np.concatenate(([0], [places[i] + e for i, own in enumerate(base) for _, _, e, _ in own]))).astype(np.int64)
                good = (score >= net.threshold) & (farthest[np.searchsorted(begins, end)] <= start)
                for i, s, e, p in zip(of[good].tolist(), (start - places[of])[good].tolist(), (end - places[of])[good].tolist(), score[good].tolist(), strict=True):
                    spans[i].append((s, 3, e, p))
                count = [[sum(x[1] == j for x in own) for own in spans] for j in range(4)]
                spans = [sorted(own) for own in spans]
                digest = [hashlib.sha256(_joined([x[:3] for x in own]).encode()).hexdigest() for own in base]
                cols = [
                    *(pa.array(count[j], pa.int64()) for j in range(3)), pa.array(digest), pa.array([_joined([x[:3] for x in own]) for own in spans]), pa.array(count[3], pa.int64()),
                    pa.array(scored, pa.int64()), pa.array([",".join(f"{x[3]:.3f}" for x in own) for own in spans]),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), *cols], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long, n_scored long, scores string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
