"""Documents as DataFrames: `parse_documents` gives one row for each document, the functions after it its parts.

A document is the unit of parallelism: parsing needs no shuffle, and the parts are explodes of a nested row, so filters and
column pruning on them stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.sources import grammar

PARAMS = "array<struct<name:string,values:array<string>>>"
COMPONENT = "comp_id:int,parent_id:int,root_id:int,depth:int,ordinal:int,name:string,name_uc:string"
PROPERTY = f"comp_id:int,ordinal:int,line_no:int,grp:string,name:string,name_uc:string,params:{PARAMS},value:string"
REPAIR = "seq:int,line:int,kind:string,detail:string,message:string"
ERROR = "line:int,kind:string,message:string"
PARSED = f"components array<struct<{COMPONENT}>>, properties array<struct<{PROPERTY}>>, repairs array<struct<{REPAIR}>>, error struct<{ERROR}>"

_STRING_LIST = pa.list_(pa.string())
_PARAMS = pa.list_(pa.struct([("name", pa.string()), ("values", _STRING_LIST)]))
_COMPONENTS = pa.list_(pa.struct([(n, pa.int32()) for n in ("comp_id", "parent_id", "root_id", "depth", "ordinal")] + [("name", pa.string()), ("name_uc", pa.string())]))
_PROPERTIES = pa.list_(pa.struct([("comp_id", pa.int32()), ("ordinal", pa.int32()), ("line_no", pa.int32()), ("grp", pa.string()), ("name", pa.string()), ("name_uc", pa.string()), ("params", _PARAMS), ("value", pa.string())]))
_REPAIRS = pa.list_(pa.struct([("seq", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("detail", pa.string()), ("message", pa.string())]))
_ERROR = pa.struct([("line", pa.int32()), ("kind", pa.string()), ("message", pa.string())])

#: Bytes of documents that are taken apart before their rows go out, and that a batch for Python holds at most.
PART_BYTES, BATCH_BYTES = 1 << 22, 1 << 24


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: 10,000 large documents at once would not fit a worker. Spark reads the bound when a plan
    runs, so it stays in the session; it changes no result, and a tighter one is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _lists(rows: list[list[tuple]], kind: pa.ListType) -> pa.Array:
    """Rows of tuples as an array of lists of structs, column by column."""
    fields = list(kind.value_type)
    flat = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(fields)
    parts = [pa.array(column, f.type) for column, f in zip(flat, fields, strict=True)]
    return pa.ListArray.from_arrays(_offsets([len(r) for r in rows]), pa.StructArray.from_arrays(parts, fields=fields))


def _properties(rows: list[list[tuple]]) -> pa.Array:
    fields = list(_PROPERTIES.value_type)
    columns = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(fields)
    params = columns[6]
    pairs = list(chain.from_iterable(params))
    values = pa.ListArray.from_arrays(_offsets([len(v) for _, v in pairs]), pa.array(list(chain.from_iterable(v for _, v in pairs)), pa.string()))
    held = pa.StructArray.from_arrays([pa.array([n for n, _ in pairs], pa.string()), values], fields=list(_PARAMS.value_type))
    parts = [pa.ListArray.from_arrays(_offsets([len(p) for p in params]), held) if k == 6 else pa.array(c, f.type) for k, (c, f) in enumerate(zip(columns, fields, strict=True))]
    return pa.ListArray.from_arrays(_offsets([len(r) for r in rows]), pa.StructArray.from_arrays(parts, fields=fields))


def arrays_of(flats: list[grammar.Flat]) -> list[pa.Array]:
    """The four columns of PARSED."""
    errors = [None if f.error is None else dict(zip(("line", "kind", "message"), f.error, strict=True)) for f in flats]
    return [_lists([f.components for f in flats], _COMPONENTS), _properties([f.properties for f in flats]), _lists([f.repairs for f in flats], _REPAIRS), pa.array(errors, _ERROR)]


def _cut(lists: pa.ListArray, flat: list) -> list[list]:
    """What an array's lists hold, of their items laid end to end."""
    heads = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64).tolist()
    return [flat[a:b] for a, b in zip(heads[:-1], heads[1:], strict=True)]


def _dicts(structs: pa.StructArray, given: dict[str, list]) -> list[dict]:
    names = [f.name for f in structs.type]
    return [dict(zip(names, row, strict=True)) for row in zip(*(given[n] if n in given else structs.field(k).to_pylist() for k, n in enumerate(names)), strict=True)]


def component_rows(column: pa.ListArray) -> list[list[dict]]:
    """Components of documents as dicts, column by column, which is several times as fast as row by row."""
    return _cut(column, _dicts(column.flatten(), {}))


def property_rows(column: pa.ListArray) -> list[list[dict]]:
    """Properties of documents as dicts, their parameters too."""
    flat = column.flatten()
    params = flat.field("params")
    pairs = params.flatten()
    values = pairs.field("values")
    held = _dicts(pairs, {"values": _cut(values, values.flatten().to_pylist())})
    return _cut(column, _dicts(flat, {"params": _cut(params, held)}))


def parse_with(docs: DataFrame, read: Callable[[object], grammar.Flat], content: str) -> DataFrame:
    """docs with the columns of PARSED in place of `content`; `read` raises ValueError for what it can't take."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != content), PARSED])

    def taken(body: object) -> grammar.Flat:
        try:
            return read(body) if body is not None else grammar.Flat()
        except ValueError as error:
            return grammar.Flat(error=(getattr(error, "line", None), getattr(error, "kind", type(error).__name__), str(error)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flats, size, bodies = 0, [], 0, batch.column(len(kept))
            for k in range(batch.num_rows):
                body = bodies[k].as_py()
                flats.append(taken(body))
                size += len(body or "")
                if size >= PART_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(flats)) for c in range(len(kept))), *arrays_of(flats)], [*kept, "components", "properties", "repairs", "error"])
                    at, flats, size = k + 1, [], 0

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{content}`")).mapInArrow(run, schema)


def parse_documents(docs: DataFrame, content: str = "content", strict: bool = False, max_depth: int = grammar.MAX_DEPTH, names: tuple[str, ...] | None = None) -> DataFrame:
    """Text or bytes in `content`. In strict mode a malformed document has no parts but an error. names: properties that are
    wanted, all if None; whole documents are checked either way, but only these leave the parser."""
    if not 0 < max_depth <= grammar.MAX_DEPTH:
        raise ValueError(f"max_depth must lie in 1..{grammar.MAX_DEPTH}")

    wanted = None if names is None else {n.upper() for n in names}

    def read(body: object) -> grammar.Flat:
        if isinstance(body, str):
            flat = grammar.parse_text(body.removeprefix("﻿"), strict, max_depth)
        else:
            flat = grammar.parse_bytes(bytes(body), strict, max_depth)
        if wanted is not None:
            flat.properties = [p for p in flat.properties if p[5] in wanted]
        return flat

    return parse_with(docs, read, content)


def read_files(spark: SparkSession, path: str, strict: bool = False, max_depth: int = grammar.MAX_DEPTH) -> DataFrame:
    """All files under path, one document each; doc_id is the file's place."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    return parse_documents(files, "content", strict, max_depth)


def _part(parsed: DataFrame, name: str) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("components", "properties", "repairs", "error")]
    return parsed.select(*rest, F.inline(name))


def components(parsed: DataFrame) -> DataFrame:
    return _part(parsed, "components")


def properties(parsed: DataFrame) -> DataFrame:
    return _part(parsed, "properties")


def repairs(parsed: DataFrame) -> DataFrame:
    return _part(parsed, "repairs")


def errors(parsed: DataFrame) -> DataFrame:
    rest = [c for c in parsed.columns if c not in ("components", "properties", "repairs", "error")]
    return parsed.where("error IS NOT NULL").select(*rest, "error.*")


def one_root(parsed: DataFrame) -> DataFrame:
    """parsed, but a job fails where a document hasn't exactly one root."""
    roots = F.size(F.filter("components", lambda c: c["depth"] == 0))
    return parsed.where(F.assert_true(roots == 1, F.concat(F.lit("expected exactly one component, got "), roots.cast("string"))).isNull())
