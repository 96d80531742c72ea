"""Operator 10: quality rules from repeated passages of a text, found with a suffix array.

Texts are sequences of words. One suffix array holds the suffixes of a whole batch of texts (a word counts as equal only
within its text): ranks double in length while any are tied, and the ranks of all lengths give the longest common prefix
of neighbours. The longest prefix that a suffix shares with a neighbour is the longest maximal repeat that begins there.
The union of these spans, from `min_repeat` words on, must not cover more than `most_covered` of the words' bytes (UTF-8),
and none may be longer than `most_words`.

Beside this verdict stand the base counts: characters in words, symbols, repeated lines, and words in 5-word windows
that occur twice or more (the union of all maximal repeats of five words or more).

Cases: a null text counts as empty; a text without words fails the base rule; ids may be null or repeat, each row is
judged by itself; texts of any length are judged whole; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daybook.llm.byte_bpe import packed
from daybook.llm.common import id_and_text, small_batches

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20


@dataclass(frozen=True)
class Limits:
    """min_repeat: words from which a repeat counts; most_covered: share of bytes in words; most_words: longest repeat."""

    min_repeat: int = 8
    most_covered: float = 0.3
    most_words: int = 60


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest stretch from it that begins elsewhere too.

    symbols: equal only where equal words of one text are; ends: where the text of each position ends.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    heads = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = heads[np.cumsum(new) - 1]
    tied = order[np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n)))]
    open_ = tied
    levels, k = [rank.copy()], 1
    while len(open_):
        ahead = open_ + k
        inside = ahead < ends[open_]
        key = rank[open_] * (n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        group = rank[open_]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        sub = np.concatenate([[True], key[1:] != key[:-1]])
        index = np.arange(len(open_))
        head = np.maximum.accumulate(np.where(first, index, 0))
        own = np.maximum.accumulate(np.where(sub, index, 0))
        rank[open_] = group + own - head
        sizes = np.diff(np.append(np.flatnonzero(sub), len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        if len(open_):
            levels.append(rank.copy())
        k *= 2
    if not len(tied):
        return best
    suffixes = tied[np.argsort(rank[tied], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    length = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < ends[a]) & (y < ends[b])
        same = ok & (levels[level][np.where(ok, x, 0)] == levels[level][np.where(ok, y, 0)])
        length[same] += 1 << level
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a stretch of at least `least` that occurs twice."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + best[at], -1)
    return np.cumsum(change[:-1]) > 0


def judge(data: bytes, bounds: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """All columns for texts laid end to end."""
    texts = len(bounds) - 1
    edges = bounds.tolist()
    words_of: dict[bytes, int] = {}
    ids: list[int] = []
    sizes: list[int] = []
    n_words, word_chars, n_symbols, n_dup = (np.zeros(texts, np.int64) for _ in range(4))
    for k in range(texts):
        text = data[edges[k] : edges[k + 1]]
        words = text.split()
        n_words[k] = len(words)
        ids += [words_of.setdefault(w, len(words_of)) for w in words]
        sizes += map(len, words)
        bare = text.translate(None, SPACES)
        word_chars[k] = len(bare) if bare.isascii() else len(bare.decode())
        n_symbols[k] = len(bare) - len(bare.translate(None, SYMBOLS))
        lines = text.split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    n_dup[k] += bool(line.split())
                seen.add(line)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    doc = np.repeat(np.arange(texts), n_words)
    symbols = doc * (len(words_of) + 1) + np.array(ids, np.int64)
    best = longest_repeats(symbols, starts[1:][doc])
    size = np.array(sizes, np.int64)
    total = lambda x: np.bincount(doc, weights=x, minlength=texts).astype(np.int64)
    repeat_words = total(covered(best, WINDOW))
    repeat_bytes, all_bytes = total(covered(best, limits.min_repeat) * size), total(size)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, doc, best)
    failed = (n_words < LEAST_WORDS) | (100 * repeat_words > MOST_REPEATED * n_words)
    share = repeat_bytes / np.maximum(all_bytes, 1)
    kept = ~failed & (share <= limits.most_covered) & (longest <= limits.most_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": repeat_words, "covered": share, "longest_repeat": longest, "base_failed": failed, "kept": kept}


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered double, longest_repeat long, base_failed boolean, kept boolean"


def judge_quality(docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs; covered: share of bytes in words that lie in counted repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in packed(batch.column("text")):
                out = judge(data, bounds, limits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, out.values())], ["doc_id", *out])

    return id_and_text(docs, doc_id, text).mapInArrow(run, JUDGED)


def keep_sound(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns: each row is judged where it lies, nothing is shuffled."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in packed(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(judge(data, bounds, limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
