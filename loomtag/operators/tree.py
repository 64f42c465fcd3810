"""The tree as rows: each element with the interval of its events, so that ancestry is a range and no
structure has to recurse."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tree import Halt, Handler, one
from ..sources.columnar import pieces
from .whole import among, as_list, documents_of, numbers, source, taken, whole, with_columns


def nodes(events: DataFrame, include_comments: bool = False, keep_space: bool = False, columns: Collection[str] | None = None) -> DataFrame:
    """(doc_id, node_id, parent_id, pre, post, depth, kind, name, local, prefix, ns_uri, attrs, content). Elements
    take up ``pre``..``post`` in the order of events; leaves have both equal. ``columns`` are those that are made."""
    leaves = ["characters", "cdata", "processing_instruction", *(["comment"] if include_comments else []), *(["space"] if keep_space else [])]
    given = events.columns

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        n, kind = len(batch), batch.column("event_type")
        own, seq, elem = documents_of(n, firsts), numbers(batch.column("seq")), numbers(batch.column("elem_id"))
        element = among(kind, "start_element")
        rows = np.flatnonzero(element | among(kind, *leaves) & (numbers(batch.column("depth"), 0) > 0))
        some, begin = taken(batch, rows, firsts)
        # the last end of each element; what is never closed ends with its document
        wide = int(elem.max(initial=0)) + 2
        ends = np.flatnonzero(among(kind, "end_element") & (elem >= 0))
        keys = own[ends] * wide + elem[ends]
        order = np.argsort(keys, kind="stable")
        mine = own[rows] * wide + elem[rows]
        at = np.searchsorted(keys[order], mine, "right") - 1
        found = (at >= 0) & (len(keys) > 0)
        found[found] = keys[order][at[found]] == mine[found]
        last = np.maximum.reduceat(seq, firsts)[own[rows]] if n else seq
        element, leaf_seq = element[rows], seq[rows]
        post = np.where(element, last, leaf_seq)
        closed = element & found
        post[closed] = seq[ends][order][at[closed]]
        is_element, depth = pa.array(element), some.column("depth")
        out = {
            "doc_id": some.column("doc_id"), "node_id": pc.if_else(is_element, some.column("elem_id"), some.column("seq")), "parent_id": pc.if_else(is_element, some.column("parent_id"), some.column("elem_id")),
            "pre": some.column("seq"), "post": pa.array(post, pa.int64()), "depth": pc.add(depth, pa.array(~element).cast(pa.int32())), "kind": pc.if_else(is_element, "element", some.column("event_type")),
        }
        for k in ("name", "attrs"):
            if k in some.schema.names:
                out[k] = some.column(k)
        for k in ("local", "prefix", "ns_uri", "content"):
            if k in some.schema.names:
                out[k] = pc.if_else(is_element if k != "content" else pa.array(~element), some.column(k), pa.scalar(None, pa.string()))
        return pa.RecordBatch.from_arrays(list(out.values()), list(out)), begin

    passed = [k for k in ("name", "local", "prefix", "ns_uri", "attrs", "content") if k in given]
    made = {"node_id": "long", "parent_id": "long", "pre": "long", "depth": "int", "kind": "string", "post": "long"}
    return whole(events, f, ("seq", "event_type", "elem_id", "parent_id", "depth"), made, passed, columns=columns)


def to_events(tree: DataFrame) -> DataFrame:
    """Nodes as events again, in document order."""

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        n, own = len(batch), documents_of(len(batch), firsts)
        element = among(batch.column("kind"), "element")
        pre, post = numbers(batch.column("pre")), numbers(batch.column("post"))
        ends = np.flatnonzero(element)
        at = np.append(np.arange(n), ends)
        is_end = np.append(np.zeros(n, bool), np.ones(len(ends), bool))
        seq = np.append(pre, post[ends])
        order = np.lexsort((np.where(is_end, -pre[at], 0), is_end, seq, own[at]))  # of those that end together the inner first
        at, is_end, seq = at[order], is_end[order], seq[order]
        both = batch.take(pa.array(at))
        inner = pa.array(element[at])
        kind = pc.if_else(pa.array(is_end), "end_element", pc.if_else(inner, "start_element", both.column("kind")))
        out = {
            "doc_id": both.column("doc_id"), "seq": pa.array(seq), "event_type": kind, "depth": pc.subtract(both.column("depth"), pa.array(~element[at]).cast(pa.int32())),
            "elem_id": pc.if_else(inner, both.column("node_id"), both.column("parent_id")), "parent_id": both.column("parent_id"),
        }
        out |= {k: both.column(k) for k in ("name", "content") if k in both.schema.names}
        if "attrs" in both.schema.names:
            attrs = both.column("attrs")
            out["attrs"] = attrs.take(pa.array(np.arange(len(at)), mask=is_end))
        doc = own[at]
        return pa.RecordBatch.from_arrays(list(out.values()), list(out)), np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else firsts

    made = {"seq": "long", "event_type": "string", "depth": "int", "elem_id": "long", "parent_id": "long"}
    return whole(tree, f, ("node_id", "parent_id", "pre", "post", "depth", "kind"), made, ("name", "attrs", "content"), order="pre")


def elements_by_tag_name(tree: DataFrame, local: str) -> DataFrame:
    return tree.where((F.col("kind") == "element") & (F.col("local") == local))


def element_by_id(tree: DataFrame, value: Column | str) -> DataFrame:
    """Each document's first element whose ``id`` has the value."""
    value = F.lit(value) if isinstance(value, str) else value
    hits = tree.where((F.col("kind") == "element") & F.exists("attrs", lambda a: (a["name"] == "id") & (a["value"] == value)))
    return hits.groupBy("doc_id").agg(F.min_by(F.struct("node_id", "name", "attrs", "pre", "post"), "pre").alias("n")).select("doc_id", "n.*")


def child_counts(tree: DataFrame) -> DataFrame:
    """How many child elements each element has."""

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        elements, begin = taken(batch, np.flatnonzero(among(batch.column("kind"), "element")), firsts)
        own, node, parent = documents_of(len(elements), begin), numbers(elements.column("node_id")), numbers(elements.column("parent_id"))
        wide = int(max(node.max(initial=0), parent.max(initial=0))) + 2
        keys = own * wide + node
        wanted = np.sort((own * wide + parent)[parent >= 0])
        counts = np.searchsorted(wanted, keys, "right") - np.searchsorted(wanted, keys, "left")
        return pa.RecordBatch.from_arrays([elements.column("doc_id"), elements.column("node_id"), elements.column("name"), pa.array(counts, pa.int64())], ["doc_id", "node_id", "name", "n"]), begin

    return whole(tree, f, ("node_id", "parent_id", "kind", "name"), {"n": "long"}, ("node_id", "name"), order="pre")


def descendants(tree: DataFrame, local: str) -> DataFrame:
    """Elements below elements of a name, a row for each pair: those below are the rows of the document in the
    interval. What is never closed ends with its document."""

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        elements, begin = taken(batch, np.flatnonzero(among(batch.column("kind"), "element")), firsts)
        own, pre, post, depth = documents_of(len(elements), begin), *(numbers(elements.column(k)) for k in ("pre", "post", "depth"))
        above = np.flatnonzero(among(elements.column("local"), local))
        wide = int(max(pre.max(initial=0), post.max(initial=0))) + 2
        keys = own * wide + pre
        lo, hi = (np.searchsorted(keys, own[above] * wide + x[above], "right") for x in (pre, post))
        count = np.maximum(hi - lo, 0)
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        over = np.repeat(above, count)
        deeper = depth[rows] > depth[over]
        out = elements.take(pa.array(rows[deeper]))
        return with_columns(out, above_id=elements.column("node_id").take(pa.array(over[deeper]))), begin

    return whole(tree, f, ("node_id", "pre", "post", "depth", "kind", "local"), {"above_id": "long"}, tree.columns, order="pre", last=True)


def text_content(events: DataFrame, name: str) -> DataFrame:
    """(doc_id, elem_id, text): all text below each closed element of a name, in order. Each text counts for every
    such element that is open around it."""

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        kind, own, elem = batch.column("event_type"), documents_of(len(batch), firsts), numbers(batch.column("elem_id"))
        named = among(batch.column("name"), name)
        starts, ends = (np.flatnonzero(among(kind, k) & named & (elem >= 0)) for k in ("start_element", "end_element"))
        wide = int(elem.max(initial=0)) + 2
        keys = own[ends] * wide + elem[ends]
        order = np.argsort(keys, kind="stable")
        mine = own[starts] * wide + elem[starts]
        at = np.minimum(np.searchsorted(keys[order], mine), max(len(keys) - 1, 0))
        found = keys[order][at] == mine if len(keys) else np.zeros(len(mine), bool)
        starts, closes = starts[found], ends[order][at[found]] if len(keys) else starts[found]
        texts = among(kind, "characters", "space", "cdata")
        parts = batch.column("content").filter(pa.array(texts)).fill_null("")
        held = parts.buffers()[2] or pa.py_buffer(b"")
        size = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
        before = np.append(0, np.cumsum(texts))
        lo, hi = size[before[starts]], size[before[closes]]
        if (lo[1:] >= hi[:-1]).all():
            out = pieces(held, lo, hi, pa.string())
        else:  # one within another
            out = pa.array([str(memoryview(held)[x:y], "utf-8") for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string())
        some, begin = taken(batch.select(["doc_id", "elem_id"]), starts, firsts)
        return with_columns(some, text=out), begin

    return whole(events, f, ("event_type", "name", "elem_id", "content"), {"text": "string"}, ("elem_id",), last=True)


def records(events: DataFrame, name: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each element of a name. A field is (``@attribute`` or child element, Spark type). The record an
    event belongs to is the last start of that name before it; of several values the greatest counts."""

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        n, kind, paths = len(batch), batch.column("event_type"), batch.column("path")
        flat, lengths = paths.flatten(), numbers(pc.list_value_length(paths), 0)
        ends = np.cumsum(lengths)
        hits = np.append(0, np.cumsum(among(flat, name)))
        inside = hits[ends] > hits[ends - lengths]
        begins = among(kind, "start_element") & among(batch.column("name"), name)
        first = np.repeat(firsts, np.diff(np.append(firsts, n)))
        record = np.maximum.accumulate(np.where(begins & inside, np.arange(n), -1)) if n else first
        record = np.where(record < first, -1 - first, record)  # what lies in such an element without its start is one record
        rows = np.flatnonzero(inside)
        keys, at = np.unique(record[rows], return_inverse=True)
        heads = np.full(len(keys), n)
        np.minimum.at(heads, at, rows)
        order = np.argsort(heads, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        text = among(kind, "characters", "cdata", "space") & (lengths > 0)
        owner = flat.take(pa.array(np.maximum(ends - 1, 0), mask=lengths == 0)) if len(flat) else pa.nulls(n, pa.string())
        out = {}
        for field, (where, _) in fields.items():
            if where.startswith("@"):
                own = np.flatnonzero(begins & inside)
                attrs = batch.column("attrs").take(pa.array(own))
                parents, items = pc.list_parent_indices(attrs).to_numpy(), attrs.flatten()
                mine = np.flatnonzero(among(items.field("name"), where[1:])) if len(items) else np.zeros(0, np.int64)
                _, once = np.unique(parents[mine], return_index=True)  # the first of the name
                source, values = own[parents[mine[once]]], items.field("value").take(pa.array(mine[once]))
            else:
                source = np.flatnonzero(inside & text & among(owner, where))
                values = batch.column("content").take(pa.array(source))
            target = place[at[np.searchsorted(rows, source)]]
            if len(np.unique(target)) < len(target):
                best = pa.table({"k": target, "v": values}).group_by("k").aggregate([("v", "max")])
                target, values = best.column("k").to_numpy(), best.column("v_max").combine_chunks()
            back = np.full(len(keys), -1)
            back[target] = np.arange(len(target))
            out[field] = values.take(pa.array(np.maximum(back, 0), mask=back < 0)) if len(values) else pa.nulls(len(keys), pa.string())
        some, begin = taken(batch.select(["doc_id"]), heads[order], firsts)
        return with_columns(some, **out), begin

    needs = ["event_type", "name", "path", "content", *(["attrs"] if any(w.startswith("@") for w, _ in fields.values()) else [])]
    rows = whole(events, f, needs, dict.fromkeys(fields, "string"), last=True)
    return rows.select("doc_id", *[F.col(k).try_cast(kind).alias(k) for k, (_, kind) in fields.items()])


#: The callback of each kind of event, and the columns that callbacks read.
_CALLS = {"start_document": "start_document", "end_document": "end_document", "start_element": "start_element", "end_element": "end_element", "characters": "characters", "cdata": "characters",
          "space": "ignorable_whitespace", "comment": "comment", "processing_instruction": "processing_instruction", "error": "error"}
_READ = {"start_element": ("ns_uri", "local", "name", "attrs"), "end_element": ("ns_uri", "local", "name"), "characters": ("content",), "cdata": ("content",), "space": ("content",), "comment": ("content",), "processing_instruction": ("name", "content"), "error": ("error",)}


def sax_fold(events: DataFrame, handler: Handler, start: Callable[[], object], finish: Callable[[object], list[dict]], schema: str) -> DataFrame:
    """Fold each document with a handler's callbacks; ``finish`` makes rows of the last state. Only events whose
    callback the handler has of its own become rows of Python, and none after it has stopped."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    inert = lambda call: call != "error" and getattr(getattr(handler, call), "__func__", None) is getattr(Handler, call)
    called = [k for k, call in _CALLS.items() if not inert(call)]
    reads = ["event_type", *dict.fromkeys(x for k in called for x in _READ.get(k, ()))]
    own = source(events, reads)
    full = f"doc_id {own.kinds['doc_id']}, {schema}"
    target = to_arrow_schema(_parse_datatype_string(full))
    make = own.make

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, firsts in make(batches, reads):
            rows = np.flatnonzero(among(batch.column("event_type"), *called))
            bounds = np.append(np.searchsorted(rows, firsts), len(rows)).tolist()
            some = batch.take(pa.array(rows))
            names, lists, out = some.schema.names, [as_list(x) for x in some.columns], []
            docs = as_list(batch.column("doc_id").take(pa.array(firsts)))
            for doc, lo, hi in zip(docs, bounds[:-1], bounds[1:], strict=True):
                state = start()
                try:
                    for i in range(lo, hi):
                        state = one({k: x[i] for k, x in zip(names, lists, strict=True)}, handler, state)
                except Halt as h:
                    state = h.state
                out += [{"doc_id": doc, **r} for r in finish(state)]
            if out:
                yield pa.RecordBatch.from_pylist(out, target)

    return own.docs.mapInArrow(run, full)
