"""Operator 4: hierarchical packing of documents into sequences of several lengths.

Documents become ids and an end id. Within a bounded unit of documents (never a whole table) what is longer than the
largest tier is cut into full windows; the rest of it, and each shorter document, is routed to the shortest tier that
holds it. Tiers are packed from long to short: a document opens a window of its tier, and the gap is filled with the
longest pieces of that or a shorter tier that fit, then with the head of one that is cut to fit. So all windows are full;
what is left of a unit goes on into the next, and the last of a partition becomes windows of shorter powers of two and at
most one padded sequence. The sequences of a unit are dealt to step groups of about `step_tokens` ids, tier by tier in
turn, so that groups hold equal shares of all tiers.

Added tokens of the tokenizer that stand in a text are one id each, as its library reads them.

Cases: a null or empty text is its end id alone; null ids and repeated rows are documents of their own; a document of any
length is packed whole; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from daybook.llm.byte_bpe import ByteBpe, Encoded, packed
from daybook.llm.common import id_and_text

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step long"
#: No window is shorter than this, but for the last one of a partition.
LEAST_TIER = 64


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """The ids of a byte-level tokenizer file, by bytes, and those of its added tokens, which are found in a text before
    anything else. The file writes byte b as one printable character: itself where it is a visible one of Latin-1, else the
    next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = {}, 256
    for b in range(256):
        letters[chr(b if b in visible else free)] = b
        free += b not in visible
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    added = {}
    for x in model.get("added_tokens") or []:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip"):
            raise ValueError(f"added token {x['content']!r} takes more than its own characters, which is not supported")
        added[x["content"].encode()] = x["id"]
    return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token.encode() not in added}, added


class Encoder:
    """Ids of whole texts as the tokenizer's library gives them."""

    def __init__(self, path: str):
        import tiktoken

        ranks, self.added = vocabulary(path)
        library = tiktoken.Encoding("packing", pat_str=r".", mergeable_ranks=ranks, special_tokens={})
        self.bpe = ByteBpe(ranks, library._core_bpe.encode_single_piece)
        by_length = sorted(self.added, key=lambda t: (-len(t), t))  # the longest of several at one place
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, by_length)) + b")") if by_length else None

    def encode(self, data: bytes, bounds: np.ndarray) -> Encoded:
        """Texts laid end to end. Where an added token stands, the text before and after it are encoded by themselves."""
        if not self.cut or not self.cut.search(data):
            return self.bpe.encode(data, bounds)
        edges = bounds.tolist()
        parts = [self.cut.split(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        texts = [x for own in parts for x in own[::2]]
        encoded = self.bpe.encode(b"".join(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
        out, sizes, at = [], [], 0
        for own in parts:
            size = 0
            for k, part in enumerate(own):
                if k % 2:
                    ids = np.array([self.added[part]], encoded.ids.dtype)
                else:
                    ids = encoded.ids[encoded.bounds[at] : encoded.bounds[at + 1]]
                    at += 1
                out.append(ids)
                size += len(ids)
            sizes.append(size)
        return Encoded(np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)]))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Piece:
    """ids[a:b] of one document; `at` is where they stand in it."""

    __slots__ = ("doc", "ids", "at", "total")

    def __init__(self, doc: int | None, ids: np.ndarray, at: int, total: int):
        self.doc, self.ids, self.at, self.total = doc, ids, at, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids[:n], self.at, self.total), Piece(self.doc, self.ids[n:], self.at + n, self.total)


def pack_unit(pieces: list[Piece], tiers: tuple[int, ...], last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows, and the pieces that are left for the next unit. If it is the last unit, nothing is left."""
    longest = tiers[-1]
    windows: list[list[Piece]] = []
    pool: list[tuple[int, int, Piece]] = []  # by length; the number keeps the order stable
    serial = 0
    for piece in pieces:
        while len(piece.ids) >= longest:
            head, piece = piece.cut(longest)
            windows.append([head])
        if len(piece.ids):
            pool.append((len(piece.ids), serial, piece))
            serial += 1
    pool.sort(key=lambda x: x[:2])
    total = sum(n for n, _, _ in pool)
    while pool:
        n, _, piece = pool[-1]
        room = next(t for t in tiers if t >= n)
        if total < room:  # the pool can't fill a window of this tier
            if not last:
                break
            room = 1 << (total.bit_length() - 1)
            if room < LEAST_TIER:
                windows.append([p for _, _, p in pool])
                return windows, []
        window = []
        while room and pool:
            k = bisect_right(pool, (room, 1 << 62)) - 1
            if k >= 0:
                n, _, piece = pool.pop(k)
            else:  # all are longer: the shortest is cut
                _, _, whole = pool.pop(0)
                piece, rest = whole.cut(room)
                n = room
                insort(pool, (len(rest.ids), serial, rest), key=lambda x: x[:2])
                serial += 1
            window.append(piece)
            room -= n
            total -= n
        windows.append(window)
    return windows, [p for _, _, p in pool]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), unit_tokens: int = 1 << 20, step_tokens: int = 1 << 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers, its tier (the length that its
    sequence is padded to) and its step group."""
    if list(tiers) != sorted(set(tiers)) or any(t < 2 or t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two in rising order")
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        head = TaskContext.get().partitionId() << 36
        counts = [0, 0]  # sequences, steps

        def out(windows: list[list[Piece]]) -> pa.RecordBatch:
            sizes = [sum(len(p.ids) for p in w) for w in windows]
            steps = max(1, round(sum(sizes) / step_tokens))
            dealt = {k: j % steps for j, k in enumerate(sorted(range(len(windows)), key=lambda k: -sizes[k]))}
            rows: list[list] = [[] for _ in names]
            for k, window in enumerate(windows):
                at = 0
                tier = sizes[k] if not sizes[k] & (sizes[k] - 1) else tiers[-1]
                for p in window:
                    for column, x in zip(rows, (p.doc, p.at, len(p.ids), p.ids.tobytes(), p.total, head + counts[0] + k, at, tier, head + counts[1] + dealt[k]), strict=True):
                        column.append(x)
                    at += len(p.ids)
            counts[0] += len(windows)
            counts[1] += steps
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names)

        held: list[Piece] = []
        size = 0
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for i, j, data, bounds in packed(batch.column("text"), 1 << 22):
                encoded = bpe.encode(data, bounds)
                ids = np.insert(encoded.ids, encoded.bounds[1:], end_id).astype("<u4")
                edges = (encoded.bounds + np.arange(len(encoded.bounds))).tolist()
                for k in range(i, j):
                    a, b = edges[k - i], edges[k - i + 1]
                    held.append(Piece(ids_of[k], ids[a:b], 0, b - a))
                    size += b - a
                    if size >= unit_tokens:
                        windows, held = pack_unit(held, tiers, False)
                        size = sum(len(p.ids) for p in held)
                        if windows:
                            yield out(windows)
        windows, _ = pack_unit(held, tiers, True)
        if windows:
            yield out(windows)

    return id_and_text(docs, doc_id, text).mapInArrow(run, PIECES)
