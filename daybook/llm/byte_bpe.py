"""Byte-level BPE encoding and decoding over whole batches of texts.

Pre-tokenisation uses no regular expression.  Every code point has a class (letter, number, space, other, ...), each
class stands for a transition function on four scanner states, and one associative scan of these functions gives the
scanner's state before every code point; a boundary is then a rule on that state and two neighbouring classes.  The
slices between boundaries are made unique in numpy, merged pair by pair once each, and kept in a bounded cache.

Cases: null and empty texts have no ids; a text of any length is encoded whole; invalid input cannot occur, as Arrow
strings are UTF-8.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Character classes. SP and WX end a run of white space that another character follows; W is all other white space.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, W, SP, WX = range(8)
# Scanner states: nothing open that matters, inside other characters (or after their space), and a contraction of
# which one or two characters are still to come.
IDLE, OPEN, ONE_LEFT, TWO_LEFT = range(4)

# Code points of white space in the public pattern (Unicode White_Space).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions of the public pattern, by their length after the quote.
SHORT_CONTRACTIONS, LONG_CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")

BLOCK = 64
KEY_WORDS = 3
#: Pieces above this many bytes are merged by themselves and not kept.
LONG = 64
NONE = 1 << 30


def _pack(step: Callable[[int], int]) -> int:
    """A function on the four states as one byte, two bits for each state."""
    return sum(step(s) << 2 * s for s in range(4))


def _steps() -> np.ndarray:
    quote = lambda left: lambda s: OPEN if s == OPEN else left
    const = lambda to: lambda s: to
    letter = lambda s: ONE_LEFT if s == TWO_LEFT else IDLE
    by_class = [letter, const(IDLE), const(OPEN), quote(ONE_LEFT), quote(TWO_LEFT), const(IDLE), const(OPEN), const(IDLE)]
    fresh = [const(f(IDLE)) for f in by_class]
    return np.array([_pack(f) for f in by_class + fresh], np.uint8)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all code points, the packed step of each class (then of each class at a text's start), and the
    composition of any two packed steps."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            kinds[point] = LETTER
        elif major == "N":
            kinds[point] = NUMBER
    kinds[WHITE_SPACE] = W
    first, second = np.divmod(np.arange(65536), 256)
    both = np.zeros(65536, np.uint8)
    for s in range(4):
        both |= ((second >> 2 * ((first >> 2 * s) & 3)) & 3).astype(np.uint8) << 2 * s
    return kinds, _steps(), both


def scan(steps: np.ndarray) -> np.ndarray:
    """The state before each position, from IDLE: an associative scan in blocks over packed step functions."""
    _, _, both = _tables()
    n = len(steps)
    if not n:
        return np.zeros(0, np.uint8)
    identity = _pack(lambda s: s)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, identity, np.uint8)
    grid[:n] = steps
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):  # inclusive scan inside all blocks at once
        grid[j] = both[(grid[j - 1].astype(np.uint16) << 8) | grid[j]]
    before = np.zeros(rows, np.uint8)
    if rows > 1:
        state_after = scan(grid[-1]) if rows > 4 * BLOCK else None
        if state_after is not None:
            before = state_after
        else:
            state = IDLE
            for r, f in enumerate(grid[-1].tolist()):
                before[r] = state
                state = f >> 2 * state & 3
    after = (grid >> (before * 2)[None, :]) & 3
    out = np.empty(rows * BLOCK + 1, np.uint8)
    out[0] = IDLE
    out[1:] = after.T.reshape(-1)
    return out[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where a slice begins. points: code points of texts laid end to end; starts: where each non-empty text begins."""
    kinds, steps, _ = _tables()
    n = len(points)
    kind = kinds[points]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    if n:
        last[-1] = True
    space = kind == W
    ends = space.copy()
    ends[:-1] &= ~space[1:]
    ends &= ~last
    kind[ends] = np.where(points[ends] == 32, SP, WX)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        room = np.searchsorted(np.flatnonzero(last), quotes)
        room = np.flatnonzero(last)[room] - quotes
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = pad[quotes + 1], pad[quotes + 2]
        kind[quotes[(room >= 1) & np.isin(one, [ord(c) for c in SHORT_CONTRACTIONS])]] = QUOTE2
        for a, b in LONG_CONTRACTIONS:
            kind[quotes[(room >= 2) & (one == ord(a)) & (two == ord(b))]] = QUOTE3
    step = steps[kind]
    step[starts] = steps[kind[starts] + 8]
    state = scan(step)
    state[starts] = IDLE
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev_state = np.empty(n, np.uint8)
    prev_state[1:] = state[:-1]
    if n:
        prev[0], prev_state[0] = WX, IDLE
    letter = (state < ONE_LEFT) & np.where(prev == LETTER, prev_state == ONE_LEFT, prev != SP)
    # A table of rules by class: letters, numbers, others and quotes, white space inside a run, white space that ends one.
    cut = np.ones(n, bool)
    cut &= (kind != LETTER) | letter
    cut &= (kind != NUMBER) | ((prev != NUMBER) & (prev != SP))
    cut &= ((kind != OTHER) & (kind != QUOTE2) & (kind != QUOTE3)) | (state != OPEN)
    cut &= (kind != W) | (prev != W)
    cut &= ~((kind >= SP) & (state == TWO_LEFT))
    cut[starts] = True
    return cut


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merges the pair of lowest rank, the leftmost first, until none is left. Long pieces take a heap."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) < 100:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 40) for i in range(len(parts) - 1)]
        while pairs and (low := min(pairs)) < 1 << 40:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return tuple(ranks[p] for p in parts)
    n = len(piece)
    end, after, before, live = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not live[i] or end[i] != mid or mid >= n or not live[mid] or end[mid] != stop:
            continue
        live[mid], end[i], after[i] = False, stop, after[mid]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if live[i])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@dataclass
class Encoded:
    """ids of all texts end to end; text i has ids[bounds[i]:bounds[i + 1]]."""

    ids: np.ndarray
    bounds: np.ndarray


class PairTable:
    """All pairs of ids that merge into one id, as an open-addressing table that is looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                if (a := ranks.get(piece[:k])) is not None and (b := ranks.get(piece[k:])) is not None:
                    pairs[a << 32 | b] = rank
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 6))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several that want a slot, one gets it
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, NONE where it doesn't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], NONE)
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


class ByteBpe:
    """merge: how a slice that isn't in the cache is merged; all of a batch together, pair by pair, unless given.
    cache: most slices to keep."""

    def __init__(self, ranks: dict[bytes, int], merge: Callable[[bytes], Iterable[int]] | None = None, cache: int = 200_000):
        self.merge, self.most, self.known, self.ranks = merge, cache, {}, ranks
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        table = [b""] * size
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
            table[rank] = piece
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.single = np.array([ranks.get(bytes([k]), 0) for k in range(256)], np.int32)
        self.pairs = PairTable(ranks) if merge is None else None

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as bytes."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif self.merge is not None or len(piece) > LONG:
                out[k] = np.array((self.merge or (lambda x: merge_pairs(x, self.ranks)))(piece), "<u4").tobytes()
            else:
                short.append(k)
        if not short:
            return out
        ids = self.single[np.frombuffer(b"".join(pieces[k] for k in short), np.uint8)]
        owner = np.repeat(np.arange(len(short)), [len(pieces[k]) for k in short])
        done_ids, done_owner = [], []
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pairs.find(ids[inner], ids[inner + 1])
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(ids)))
            low = np.minimum.reduceat(rank, heads)
            finished = np.repeat(low == NONE, sizes)
            if finished.any():
                done_ids.append(ids[finished])
                done_owner.append(owner[finished])
                ids, owner, rank, sizes, low = ids[~finished], owner[~finished], rank[~finished], sizes[low != NONE], low[low != NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]  # the leftmost of each piece
            ids[hit] = rank[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where it stands once the right halves are gone
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[moved] = NONE
            for left in (moved, moved - 1):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self.pairs.find(ids[left], ids[left + 1])
        ids, owner = np.concatenate(done_ids).astype("<u4"), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(short))) * 4
        body = ids[order].tobytes()
        for k, a, b in zip(short, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[k] = body[a:b]
        return out

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, pieces))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            if len(self.known) + len(missing) > self.most:
                self.known.clear()
            new = self._merged([pieces[k] for k in missing])
            for k, ids in zip(missing, new, strict=True):
                found[k] = ids
                if len(pieces[k]) <= LONG:
                    self.known[pieces[k]] = ids
        return found

    def encode(self, data: bytes, bounds: np.ndarray) -> Encoded:
        """data: UTF-8 of texts laid end to end; bounds: byte offsets, one more than texts."""
        texts = len(bounds) - 1
        if not data:
            return Encoded(np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64))
        raw = np.frombuffer(data, np.uint8)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80) if len(points) != len(raw) else np.arange(len(raw))
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        begins = bounds[:-1][full]
        cut = boundaries(points, np.searchsorted(at, begins))
        start = at[cut]
        length = np.diff(np.append(start, len(raw)))
        uniques, inverse = self._unique(data, start, length)
        found = self._ids(uniques)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), "<u4")
        heads = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        count = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(heads[inverse] - total[:-1], count) + np.arange(total[-1])]
        first = np.searchsorted(start, bounds)
        return Encoded(ids, total[first])

    @staticmethod
    def _unique(data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """One slice of each kind, and which kind each slice is. Slices of up to 24 bytes are compared as three words."""
        wide = np.ndarray((len(data) + 8 * (KEY_WORDS - 1),), "<u8", data + bytes(8 * KEY_WORDS), strides=(1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        small = np.flatnonzero(length <= 8 * KEY_WORDS)
        s, n = start[small], length[small]
        words = [wide[s + 8 * k] & masks[np.clip(n - 8 * k, 0, 8)] for k in range(KEY_WORDS)]
        mixed = n.astype(np.uint64)
        for k, word in enumerate(words):
            mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed)
        ranked = mixed[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        head = order[new]
        group = np.cumsum(new) - 1
        inverse = np.empty(len(start), np.int64)
        inverse[small[order]] = group
        own = inverse[small]
        if not all((word == word[head][own]).all() for word in words) or not (n == n[head][own]).all():
            return ByteBpe._plain(data, start, length)  # two slices share a key
        uniques = [data[a:b] for a, b in zip(s[head].tolist(), (s[head] + n[head]).tolist(), strict=True)]
        big = np.flatnonzero(length > 8 * KEY_WORDS)
        place: dict[bytes, int] = {}
        for i in big.tolist():
            piece = data[start[i] : start[i] + length[i]]
            if (k := place.get(piece)) is None:
                k = place[piece] = len(uniques)
                uniques.append(piece)
            inverse[i] = k
        return uniques, inverse

    @staticmethod
    def _plain(data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        place: dict[bytes, int] = {}
        inverse = np.array([place.setdefault(data[a : a + n], len(place)) for a, n in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
        return list(place), inverse

    def spans(self, encoded: Encoded) -> np.ndarray:
        """Byte offsets of all ids in the texts laid end to end, one more than ids: where each id's slice begins."""
        return np.concatenate([[0], np.cumsum(self.lengths[encoded.ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.offsets[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()


def packed(column, most: int = 1 << 21) -> Iterable[tuple[int, int, bytes, np.ndarray]]:
    """Rows [i, j) of an Arrow string column as UTF-8 laid end to end with byte bounds, about `most` bytes at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        j = min(j, n)
        body = data[int(bounds[i]) : int(bounds[j])].to_pybytes() if data is not None else b""
        yield i, j, body, bounds[i : j + 1] - bounds[i]
        i = j
