"""Operator 1: token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens and its sections are intervals of its text; an interval join (both
sides sorted, one binary search for each end of each token) finds the sections that a token lies in. A token inside one
section counts there. For a token that crosses boundaries an explicit rule decides:

- "majority": the section that holds most of its bytes, the earlier one on a tie
- "start": the section of its first byte
- "end": the section of its last byte

Sections are lines, each with its newline, or the spans of a column `spans` (array<struct<start:int,end:int>>, in
characters). Spans are taken in order of their start; a span that begins inside an earlier one begins where that ends.
Tokens that no span holds count in section -1.

Cases: a null or empty text, and a text without spans, gives one row, section 0 (or -1), with no (or all) tokens; null
ids and repeated rows stay rows of their own; texts of any length are encoded whole; an empty table gives an empty one;
other columns are left out, so that their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.bpe_codec import codec
from daybook.llm.byte_bpe import packed
from daybook.llm.common import id_and_text, small_batches

RULES = ("majority", "start", "end")
COUNTED = "doc_id long, section int, char_start int, char_end int, n_tokens long, n_crossing long"


def attribute(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary. starts: sorted; a section ends where the next begins."""
    first = np.searchsorted(starts, token_starts, "right") - 1
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    owner = first.copy()
    for t in np.flatnonzero(crossing).tolist():
        cuts = np.concatenate([[token_starts[t]], starts[first[t] + 1 : last[t] + 1], [token_ends[t]]])
        owner[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return owner, crossing


def _tiles(spans: list[dict] | None, char_bytes: np.ndarray) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """Byte starts of tiles that cover the text, each tile's section (-1: none), and the sections' spans in characters."""
    most = len(char_bytes) - 1
    kept, at = [], 0
    clean = [s for s in spans or () if s is not None and s["start"] is not None and s["end"] is not None]
    for s in sorted(clean, key=lambda s: (s["start"], s["end"])):
        a, b = max(at, min(s["start"], most)), min(s["end"], most)
        kept.append((a, max(a, b)))
        at = max(at, b)
    starts, owners, at = [], [], 0
    for k, (a, b) in enumerate(kept):
        if b > a:
            if a > at:
                starts.append(int(char_bytes[at]))
                owners.append(-1)
            starts.append(int(char_bytes[a]))
            owners.append(k)
            at = b
    if at < most or not starts:
        starts.append(int(char_bytes[at]))
        owners.append(-1)
    return starts, owners, kept


def count_tokens(docs: DataFrame, ranks_path: str, rule: str = "majority", spans: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each section of each document. spans: the column of spans; lines where none is named."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def lines(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for i, j, data, bounds in packed(batch.column("text")):
            out = bpe.encode(data, bounds)
            edges = bpe.spans(out)
            raw = np.frombuffer(data, np.uint8)
            chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            marks = np.concatenate([bounds[:-1][bounds[1:] > bounds[:-1]], np.flatnonzero(raw == 10) + 1])
            starts = np.unique(marks[marks < len(raw)])
            owner, crossing = attribute(edges[:-1], edges[1:], starts, rule)
            tokens, crossed = np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))
            doc = np.searchsorted(bounds, starts, "right") - 1
            empty = np.flatnonzero(bounds[1:] == bounds[:-1])
            head = np.searchsorted(starts, bounds[doc])
            ends = np.append(starts[1:], len(raw))
            base = chars[bounds[doc]]
            z = np.zeros(len(empty), np.int64)
            row = np.concatenate([doc, empty])
            columns = [np.concatenate(x) for x in ((np.arange(len(starts)) - head, z), (chars[starts] - base, z), (chars[ends] - base, z))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in columns), pa.array(np.concatenate([tokens, z])), pa.array(np.concatenate([crossed, z]))],
                names,
            )

    def given(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for i, j, data, bounds in packed(batch.column("text")):
            out = bpe.encode(data, bounds)
            edges = bpe.spans(out)
            rows = []
            for k, (doc, own) in enumerate(zip(batch.column("doc_id").slice(i, j - i).to_pylist(), batch.column("spans").slice(i, j - i).to_pylist(), strict=True)):
                raw = np.frombuffer(data, np.uint8)[bounds[k] : bounds[k + 1]]
                char_bytes = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                starts, owners, kept = _tiles(own, char_bytes)
                a, b = out.bounds[k], out.bounds[k + 1]
                tile, crossing = attribute(edges[a:b] - bounds[k], edges[a + 1 : b + 1] - bounds[k], np.array(starts), rule)
                section = np.array(owners)[tile]
                n, c = np.bincount(section + 1, minlength=len(kept) + 1), np.bincount(section[crossing] + 1, minlength=len(kept) + 1)
                rows += [(doc, q, *kept[q], int(n[q + 1]), int(c[q + 1])) for q in range(len(kept))]
                if n[0] or not kept:
                    rows.append((doc, -1, None, None, int(n[0]), int(c[0])))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = [x.split()[0] for x in COUNTED.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int32()) for x in names[1:4]), *((x, pa.int64()) for x in names[4:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (lines if spans is None else given)(batch)

    small_batches(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text) if spans is None else docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{spans}`").alias("spans"))
    return rows.mapInArrow(run, COUNTED)
