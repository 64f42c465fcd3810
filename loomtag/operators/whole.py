"""Operators on whole documents in Arrow batches.

Where events come straight from the parser, they go on in the worker that made them, without an exchange; other
relations are dealt by document and put in order first. A batch holds whole documents, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.parse import Whole

Batches = Iterator[tuple[pa.RecordBatch, np.ndarray]]


def kinds(df: DataFrame, *names: str) -> dict[str, str]:
    """The columns' types; without names, of all columns but ``doc_id``."""
    return {k: df.schema[k].dataType.simpleString() for k in names or [x for x in df.columns if x != "doc_id"]}


def _changes(ids: pa.Array) -> np.ndarray:
    """The first row of each document."""
    codes = ids.dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Batches:
    held: list[pa.RecordBatch] = []
    join = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        if not len(batch):
            continue
        firsts = _changes(batch.column(0))
        if held and held[-1].column(0)[-1].as_py() != batch.column(0)[0].as_py():
            whole = join(held)
            yield whole, _changes(whole.column(0))
            held = []
        if len(firsts) > 1:
            whole = join([*held, batch.slice(0, int(firsts[-1]))])
            yield whole, _changes(whole.column(0))
            held, batch = [], batch.slice(int(firsts[-1]))
        held.append(batch)
    if held:
        whole = join(held)
        yield whole, _changes(whole.column(0))


def source(rows: DataFrame, needs: Collection[str], order: str = "seq") -> Whole:
    """What ``rows`` come of; for relations from elsewhere, an arrangement by document."""
    known = rows.__dict__.get("_whole")
    if known is not None and set(needs) <= set(known.kept):
        return known
    columns = [k for k in rows.columns if k != "doc_id"]
    arranged = rows.select("doc_id", *columns).repartition("doc_id").sortWithinPartitions("doc_id", order)

    def make(batches: Iterator[pa.RecordBatch], wanted: Collection[str]) -> Batches:
        for batch, firsts in _regrouped(batches):
            names = ["doc_id", *[k for k in columns if k in wanted]]
            yield batch.select(names), firsts

    return Whole(arranged, make, tuple(columns), kinds(arranged, "doc_id", *columns))


def whole(rows: DataFrame, f: Callable, needs: Collection[str], made: dict[str, str], passed: Collection[str] = (), order: str = "seq", columns: Collection[str] | None = None, last: bool = False) -> DataFrame:
    """``f(batch, firsts)`` gives the same of its results. ``needs``: columns it reads; ``made``: those it adds;
    ``passed``: those of its input that it hands on. ``columns``: of both, what is wanted. With ``last`` the
    result isn't in order any more."""
    own = source(rows, needs, order)
    earlier = own.make
    types = {"doc_id": own.kinds["doc_id"]} | {k: own.kinds[k] for k in own.kept if k in passed} | made
    types = {k: v for k, v in types.items() if k == "doc_id" or columns is None or k in columns}

    def make(batches: Iterator[pa.RecordBatch], wanted: Collection[str]) -> Batches:
        names = ["doc_id", *[k for k in types if k in wanted]]
        for batch, firsts in earlier(batches, {*needs, *(k for k in passed if k in wanted)}):
            out, begin = f(batch, firsts)
            yield out.select([k for k in names if k in out.schema.names]), begin

    out = Whole(own.docs, make, tuple(k for k in types if k != "doc_id"), types).frame()
    if last:
        del out._whole
    return out


def documents_of(n: int, firsts: np.ndarray) -> np.ndarray:
    """Which document each of n rows belongs to."""
    return np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, n)))


def taken(batch: pa.RecordBatch, rows: np.ndarray, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Some rows, in order, and where documents begin among them."""
    begin = np.unique(np.searchsorted(rows, firsts))
    return batch.take(pa.array(rows)), begin[begin < len(rows)]


def with_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    kept = [k for k in batch.schema.names if k not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns.values()], [*kept, *columns])


def among(column: pa.Array, *values: str) -> np.ndarray:
    return pc.is_in(column, pa.array(values, pa.string())).to_numpy(zero_copy_only=False)


def numbers(column: pa.Array, null: int = -1) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False).astype(np.int64)


def as_list(column: pa.Array) -> list:
    """As ``to_pylist``, faster for plain columns, lists of these and lists of structs of these."""
    t = column.type
    if pa.types.is_string(t):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(t):
        out = pc.fill_null(column, 0).to_numpy().tolist()
        if column.null_count:
            for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
                out[i] = None
        return out
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_list(t):
        flat = column.flatten()
        if pa.types.is_struct(t.value_type):
            if flat.null_count:
                return column.to_pylist()
            names = [x.name for x in t.value_type]
            items = [dict(zip(names, v, strict=True)) for v in zip(*(as_list(flat.field(k)) for k in range(len(names))), strict=True)]
        else:
            items = as_list(flat)
        ends = np.cumsum(numbers(pc.list_value_length(column), 0)).tolist()
        missing = column.is_null().to_numpy(zero_copy_only=False).tolist()
        return [None if none else items[lo:hi] for none, lo, hi in zip(missing, [0, *ends[:-1]], ends, strict=True)]
    return column.to_pylist()


def as_rows(batch: pa.RecordBatch) -> list[dict]:
    names = batch.schema.names
    return [dict(zip(names, v, strict=True)) for v in zip(*map(as_list, batch.columns), strict=True)]
