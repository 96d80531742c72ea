"""Operator 3: byte-level BPE encoding and decoding of whole documents.

`encode` gives each document's ids and the byte offset of each id in its text, both as little-endian unsigned 32-bit
integers; `decode` turns ids into bytes. The method is that of `byte_bpe`.

Cases: a null or empty text has no ids and decodes to no bytes; a null id stays a row; repeated rows are encoded each;
an empty table gives an empty one; other columns are left out, so that their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daybook.llm.byte_bpe import ByteBpe, packed, read_ranks
from daybook.llm.common import id_and_text

ENCODED = "doc_id long, ids binary, starts binary"


@lru_cache(2)
def codec(ranks_path: str) -> ByteBpe:
    return ByteBpe(read_ranks(ranks_path))


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, starts (byte offset of each id in the text), one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for batch in batches:
            for i, j, data, bounds in packed(batch.column("text")):
                out = bpe.encode(data, bounds)
                spans = bpe.spans(out)[:-1]
                ids, starts = [], []
                for k, (a, b) in enumerate(zip(out.bounds[:-1].tolist(), out.bounds[1:].tolist(), strict=True)):
                    ids.append(out.ids[a:b].astype("<u4").tobytes())
                    starts.append((spans[a:b] - bounds[k]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary()), pa.array(starts, pa.binary())], ["doc_id", "ids", "starts"])

    return id_and_text(docs, doc_id, text).mapInArrow(run, ENCODED)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """tokens: doc_id, ids as `encode` gives them. Returns doc_id, ids, decoded (bytes); null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for batch in batches:
            decoded = [None if x is None else bpe.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
