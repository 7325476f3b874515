"""An adaptive context-mixing range coder for token ids.

A block of ids is coded and decoded alone: it starts from an empty model. Its ids lie in up to
``LANES`` lanes of consecutive ids, which advance together, one id of every lane at a time. All lanes of a block
share one model, so what one lane has shown the others predict as well, and each lane has
a range coder of its own.

The model mixes three real distributions over ids. Order 0 is how often each id was seen (every
id has a small share from the start). Order 1 and order 2 are the counts of the ids that followed
the last id, and the last two, of which the ``WAYS`` most frequent are kept. Their mixing weights are
learned online, for each class of how much the two contexts have seen: a weight is its order's share in the
predictions that came true (steps of expectation maximisation over the ids of all lanes).

An id that a context names is coded by its whole mixed probability; any other by order 0 in what
is left. All of it is one interval of 2**36, and so one range-coding step. Only sums, products
and quotients of doubles are used, no functions whose last digit differs between machines.

A block in bytes: ids (u32), largest id (u16), lanes (u16), each lane's words (u32), the lanes' words (u16).

Edge cases: no ids give a block that decodes to none; an empty table has no blocks (``idstore``). Ids are below 65535; a damaged block raises an
error or decodes to other ids, which its CRC-32 in the file tells.
"""

from __future__ import annotations

import struct

import numpy as np

#: The most lanes of a block, ids of a lane from which on a block has more than one, ids of a block.
LANES, STEPS, BLOCK = 8192, 256, 1 << 22
#: Followers kept after one id and after two.
WAYS = (2, 2)
BITS, BOT = 36, 1 << 44
#: Named ids have intervals of 2**30, shifted to 2**36; order 0 deals out 2**20 shares of the rest.
NAMED, FINE, SHARES = 30, BITS - 30, 20
U, I, N = np.uint64, np.int64, np.uint32
HEAD = struct.Struct("<IHH")
#: A follower is its id and, in the low 16 bits, its count. No follower: an id that no text has, and count 0.
EMPTY = N(0xFFFF0000)
MOST = 24_000
#: Classes of how often a context was seen.
SEEN = np.minimum(np.array([int(n).bit_length() for n in range(256)], I), 7)


class Mixer:
    """The model of a block whose lanes number ``lanes`` and whose ids end at ``top``."""

    def __init__(self, lanes: int, top: int):
        self.followers = [np.full((1 << 16) * w, EMPTY) for w in WAYS]
        self.n0, self.top = np.zeros(top + 1, I), top
        self.gained = np.full((3, 64), 0.5)
        self.gained[0] = 1.0
        self.p1, self.p2 = np.zeros(lanes, I), np.zeros(lanes, I)
        self.due, self.gap = 0, 1
        self.deal()
        self.weigh()

    def deal(self) -> None:
        """Deal out order 0's shares by the counts as of now, one at least to every id."""
        free = (1 << SHARES) - len(self.n0)
        own = 1 + self.n0 * free // max(int(self.n0.sum()), 1)
        own[int(self.n0.argmax())] += (1 << SHARES) - int(own.sum())
        self.cum = np.concatenate(([0], np.cumsum(own)))
        self.chance = own.astype(np.float32) * np.float32(2.0**-SHARES)
        self.share_of: np.ndarray | None = None

    def weigh(self) -> None:
        """Mixing weights in 2**30ths for each class, from what each order has gained there."""
        w = self.gained / self.gained.sum(0)
        self.weight = [(np.maximum(x, low) * ((1 << NAMED) / 1.01)).astype(np.float32) for x, low in zip(w, (1 / 128, 1 / 1024, 1 / 1024), strict=True)]

    def shrink(self, lanes: int) -> None:
        """Go on with the first ``lanes`` lanes alone."""
        self.p1, self.p2 = self.p1[:lanes], self.p2[:lanes]

    def predict(self) -> None:
        """Named ids with their intervals (``names``, ``widths``), and where the rest begins (``rest``)."""
        self.rows = (self.p1 * WAYS[0], (((self.p1 * 40503) ^ (self.p2 * 10007)) & 0xFFFF) * WAYS[1])
        self.ids, self.counts, seen = [], [], []
        for table, row, ways in zip(self.followers, self.rows, WAYS, strict=True):
            entries = [table[row + k if k else row] for k in range(ways)]
            self.ids.append([e >> N(16) for e in entries])
            self.counts.append([e & N(0xFFFF) for e in entries])
            seen.append(sum(self.counts[-1][1:], self.counts[-1][0]))
        self.kind = SEEN[np.minimum(seen[0], 255)] * 8 + SEEN[np.minimum(seen[1], 255)]
        self.masses = []
        for k, ways in enumerate(WAYS):
            each = self.weight[k + 1][self.kind]
            if ways == 1:
                self.masses.append([each * (seen[k] > 0)])
            else:
                each /= np.maximum(seen[k], 1).astype(np.float32)
                self.masses.append([each * c.astype(np.float32) for c in self.counts[k]])
        # An id that both orders name stands with order 2, with both masses.
        low, high, lower = list(self.masses[0]), list(self.masses[1]), []
        for i, a in enumerate(self.ids[0]):
            twice = None
            for j, b in enumerate(self.ids[1]):
                same = a == b
                high[j] = high[j] + low[i] * same
                twice = same if twice is None else twice | same
            low[i] = low[i] * ~twice
            lower.append(a | (twice * N(0x10000)))
        self.names = [*self.ids[1], *lower]
        self.widths = [m.astype(np.int32) for m in (*high, *low)]
        self.ends = [self.widths[0]]
        for own in self.widths[1:]:
            self.ends.append(self.ends[-1] + own)
        self.rest = self.ends[-1]

    def left(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where order 0's part of lanes ``i`` begins, and its width."""
        rest = self.rest[i].astype(I) << FINE
        return rest, (1 << BITS) - rest

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id."""
        start, width, own = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32), ids.astype(N)
        for k, (name, size) in enumerate(zip(self.names, self.widths, strict=True)):
            there = name == own
            width += size * there
            if k:
                start += self.ends[k - 1] * there
        i = np.flatnonzero(width == 0)
        start, width = start.astype(I) << FINE, width.astype(I) << FINE
        rest, room = self.left(i)
        x = ids[i]
        low = room * self.cum[x] >> SHARES
        start[i] = rest + low
        width[i] = (room * self.cum[x + 1] >> SHARES) - low
        return start, width

    def read(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals hold ``value``, with start and width."""
        if self.share_of is None:
            self.share_of = np.repeat(np.arange(len(self.n0), dtype=np.uint16), np.diff(self.cum))
        v = (value >> FINE).astype(np.int32)
        ids, start, width, before = np.zeros(len(v), N), np.zeros(len(v), np.int32), np.zeros(len(v), np.int32), None
        for k, (name, size, end) in enumerate(zip(self.names, self.widths, self.ends, strict=True)):
            under = v < end
            there = under if before is None else under & ~before
            ids += name * there
            width += size * there
            if k:
                start += self.ends[k - 1] * there
            before = under
        i = np.flatnonzero(~before)
        ids, start, width = ids.astype(I), start.astype(I) << FINE, width.astype(I) << FINE
        rest, room = self.left(i)
        x = self.share_of[(((value[i] - rest + 1) << SHARES) - 1) // room].astype(I)
        low = room * self.cum[x] >> SHARES
        ids[i], start[i], width[i] = x, rest + low, (room * self.cum[x + 1] >> SHARES) - low
        return ids, start, width

    def update(self, ids: np.ndarray, step: int) -> None:
        """Learn each lane's id."""
        own, learn = ids.astype(N), step < 16 or step % 8 == 0
        true = []
        for table, row, ways, names, counts, masses in zip(self.followers, self.rows, WAYS, self.ids, self.counts, self.masses, strict=True):
            known, share = None, None
            for k in range(ways):
                there = names[k] == own
                at = np.flatnonzero(there)
                np.add.at(table, row[at] + k, N(1))
                if learn:
                    share = masses[k] * there if share is None else share + masses[k] * there
                known = there if known is None else known | there
            new = np.flatnonzero(~known)
            place = row[new]
            if ways > 1:
                least, way = counts[0][new], np.zeros(len(new), I)
                for k in range(1, ways):
                    c = counts[k][new]
                    less = c < least
                    way = np.where(less, k, way)
                    least = np.minimum(c, least)
                place = place + way
            table[place] = (own[new] << N(16)) + N(1)
            true.append(share)
        if learn:
            zero = self.weight[0][self.kind] * self.chance[ids]
            whole = zero + true[0] + true[1]
            for k, share in enumerate((zero, *true)):
                self.gained[k] += np.bincount(self.kind, share / whole, 64)
            self.weigh()
        np.add.at(self.n0, ids, 1)
        if step >= self.due:
            self.due, self.gap = step + self.gap, min(16, 1 + self.gap + self.gap // 2)
            self.deal()
            for k, table in enumerate(self.followers):
                if int((table & N(0xFFFF)).max()) > MOST:
                    self.followers[k] = (table & EMPTY) | ((table & N(0xFFFF)) >> N(1))
        self.p2, self.p1 = self.p1, ids


def _unsettled(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes that must shift: their top 16 bits are settled, or their range is too small for a step."""
    return np.flatnonzero((((low ^ (low + (rng - U(1)))) >> U(48)) == 0) | (rng < U(BOT)))


def _shift(low: np.ndarray, rng: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Shift the lanes ``i`` by 16 bits; gives the words that leave."""
    l, r = low[i], rng[i]
    open_ = ((l ^ (l + (r - U(1)))) >> U(48)) != 0
    r = np.where(open_, U(BOT) - (l & U(BOT - 1)), r)
    low[i], rng[i] = l << U(16), r << U(16)
    return (l >> U(48)).astype(np.uint16)


def _lanes(n: int) -> tuple[int, int]:
    """A block's lanes, and the ids of each but the last."""
    lanes = min(LANES, max(1, n // STEPS))
    steps = -(-n // lanes) if n else 0
    return (-(-n // steps) if n else 0), steps


def encode(ids: np.ndarray) -> bytes:
    """One block of ``ids``, all of them under 65535."""
    if len(ids) and (ids.min() < 0 or ids.max() >= 0xFFFF):
        raise ValueError("ids must be in 0..65534")
    lanes, steps = _lanes(len(ids))
    last, top = len(ids) - (lanes - 1) * steps, int(ids.max()) if len(ids) else 0
    full = np.zeros(lanes * steps, I)
    full[: len(ids)] = ids
    grid = np.ascontiguousarray(full.reshape(lanes, steps).T) if lanes else full.reshape(0, 0)
    low, rng = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    words, at = np.zeros((lanes, 3 * steps + 8), np.uint16), np.zeros(lanes, I)
    m = Mixer(lanes, top)
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        if n < len(m.p1):
            if not n:
                break
            m.shrink(n)
        x = grid[t, :n]
        m.predict()
        start, width = m.find(x)
        l, r = low[:n], rng[:n]
        step = r >> U(BITS)
        l += step * start.view(U)
        r[:] = step * width.view(U)
        i = _unsettled(l, r)
        while len(i):
            words[i, at[i]] = _shift(l, r, i)
            at[i] += 1
            i = i[_unsettled(l[i], r[i])]
        m.update(x, t)
    for k in (48, 32, 16, 0):
        words[np.arange(lanes), at] = ((low >> U(k)) & U(0xFFFF)).astype(np.uint16)
        at += 1
    there = words != 0
    used = np.where(there.any(1), words.shape[1] - there[:, ::-1].argmax(1), 0)  # zeros at the end are implied
    parts = [words[i, :k] for i, k in enumerate(used.tolist())]
    return HEAD.pack(len(ids), top, lanes) + used.astype("<u4").tobytes() + (np.concatenate(parts).astype("<u2").tobytes() if parts else b"")


def decode(block: bytes) -> np.ndarray:
    """The ids of a block."""
    total, top, lanes = HEAD.unpack_from(block)
    _, steps = _lanes(total)
    last = total - (lanes - 1) * steps
    used = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(I)
    flat = np.frombuffer(block, "<u2", int(used.sum()), HEAD.size + 4 * lanes)
    words = np.zeros((lanes, int(used.max(initial=0)) + 8), np.uint16)
    words[np.repeat(np.arange(lanes), used), np.arange(len(flat)) - np.repeat(np.cumsum(used) - used, used)] = flat
    code = np.zeros(lanes, U)
    for k in range(4):
        code = (code << U(16)) | words[:, k]
    at = np.full(lanes, 4, I)
    low, rng = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
    grid = np.zeros((steps, lanes), np.int32)
    m = Mixer(lanes, top)
    for t in range(steps):
        n = lanes if t < last else lanes - 1
        if n < len(m.p1):
            if not n:
                break
            m.shrink(n)
        l, r, c = low[:n], rng[:n], code[:n]
        m.predict()
        step = r >> U(BITS)
        x, start, width = m.read(np.minimum((c - l) // step, U((1 << BITS) - 1)).view(I))
        l += step * start.view(U)
        r[:] = step * width.view(U)
        i = _unsettled(l, r)
        while len(i):
            _shift(l, r, i)
            c[i] = (c[i] << U(16)) | words[i, np.minimum(at[i], words.shape[1] - 1)]
            at[i] += 1
            i = i[_unsettled(l[i], r[i])]
        grid[t, :n] = x
        m.update(x, t)
    return grid.T.reshape(-1)[:total]
