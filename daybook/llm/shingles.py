"""Word shingles of whole batches of texts as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset and hash of each word; A-Z count as a-z, words end at ASCII white space."""
    data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    word = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    wide = np.ndarray((len(raw) + 1,), "<u8", data + bytes(9), strides=(1,))
    out = length.astype(np.uint64)
    todo, k = np.arange(len(start)), 0
    while len(todo):
        rest = length[todo] - k
        part = wide[start[todo] + k] & _MASKS[np.minimum(rest, 8)]
        out[todo] = mix(out[todo] * np.uint64(0x9E3779B97F4A7C15) ^ part)
        todo, k = todo[rest > 8], k + 8
    return start, out


def split_at_texts(data: bytes, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a newline after each, so that no word reaches into the next."""
    edges = bounds.tolist()
    body = b"\n".join(data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)) + b"\n"
    return body, bounds + np.arange(len(bounds))


def shingle_hashes(data: bytes, bounds: np.ndarray, k: int, word_scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of all k-word shingles of texts laid end to end, where each text's begin (one more than texts), and for each
    shingle the sum of its words' scores, which stand under the upper bits of a word's hash. A text of 1 to k - 1 words has
    one shingle, all its words."""
    body, bounds = split_at_texts(data, bounds)
    start, word = word_hashes(body)
    first = np.searchsorted(start, bounds)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    heads = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - heads[:-1], count) + np.arange(heads[-1])
    size = np.repeat(np.minimum(n, k), count)
    out = size.astype(np.uint64)
    pad = np.concatenate([word, np.zeros(k, np.uint64)])
    sums = None
    if word_scores is not None:
        sums = np.zeros(len(out), np.float32)
        scores = np.concatenate([word_scores[cells(word, len(word_scores))], np.zeros(k, np.float32)])
    for j in range(k):
        out = np.where(j < size, mix(out * np.uint64(0x9E3779B97F4A7C15) + pad[at + j]), out)
        if sums is not None:
            sums += np.where(j < size, scores[at + j], np.float32(0))
    return out, heads, sums


def cells(hashes: np.ndarray, size: int) -> np.ndarray:
    """Which counter of `size` (a power of two) a hash falls on."""
    return (hashes >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
