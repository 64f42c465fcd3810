"""Events back to text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .whole import _changes, among, as_list, documents_of, numbers, taken, whole

#: White space as the JVM's patterns have it.
_LEADING = re.compile(r"\A[ \t\n\x0b\f\r]+")


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attrs(attrs: list[dict] | None) -> str:
    return "".join([f' {a["name"]}="{_escaped(a["value"]).replace(chr(34), "&quot;")}"' for a in attrs or () if a["name"] is not None and a["value"] is not None])


def _fragment(kind: str, name: str | None, attrs: list[dict] | None, content: str | None, empty: bool, after: bool) -> str | None:
    if kind == "start_element":
        return None if name is None else f"<{name}{_attrs(attrs)}{'/>' if empty else '>'}"
    if kind == "end_element":
        return "" if after else None if name is None else f"</{name}>"
    if kind == "processing_instruction":
        data = _LEADING.sub("", content or "")
        return None if name is None else f"<?{name}{' ' + data if data else ''}?>"
    if kind == "prolog":
        return f"<?xml{_attrs(attrs)}?>"
    if kind in ("characters", "space", "cdata", "comment", "dtd") and content is None:
        return None
    if kind in ("characters", "space"):
        return _escaped(content)
    if kind == "cdata":
        return "<![CDATA[" + content.replace("]]>", "]]]]><![CDATA[>") + "]]>"
    if kind == "comment":
        return f"<!--{content}-->"
    return f"<!{content}>" if kind == "dtd" else ""


def fragments(events: DataFrame, pretty: bool = False, indent: int | str = 2) -> DataFrame:
    """(doc_id, seq, fragment). An element that ends right where it starts closes itself; error rows and
    markers write nothing. A CDATA section that holds its own end is split in two."""
    pad = " " * indent if isinstance(indent, int) else indent

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        batch, firsts = taken(batch, np.flatnonzero(~among(batch.column("event_type"), "error", "start_document", "end_document")), firsts)
        kind, elem = batch.column("event_type"), numbers(batch.column("elem_id"))
        names = _codes(batch.column("name"))
        own = documents_of(len(batch), firsts)
        same = np.where((elem[1:] >= 0) & (elem[:-1] >= 0), elem[1:] == elem[:-1], (names[1:] == names[:-1]) & (names[1:] >= 0))
        pair = among(kind, "start_element")[:-1] & among(kind, "end_element")[1:] & same & (own[1:] == own[:-1])
        out = _fragments(batch, names, np.append(pair, False)[: len(batch)], np.append(False, pair)[: len(batch)])
        if pretty:
            levels = np.maximum(numbers(batch.column("depth"), 0) - among(kind, "start_element", "end_element"), 0)
            pads = pa.array([pad * d for d in range(int(levels.max(initial=0)) + 1)], pa.string()).take(pa.array(levels))
            lines = pc.if_else(pa.array(among(kind, "space")), "", pc.binary_join_element_wise(pads, out, "\n", ""))
            out = pc.if_else(pc.equal(out, ""), out, lines)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), out], ["doc_id", "seq", "fragment"]), firsts

    return whole(events, f, ("seq", "event_type", "name", "attrs", "content", "depth", "elem_id"), {"fragment": "string"}, ("seq",))


def _fragments(batch: pa.RecordBatch, codes: np.ndarray, empty: np.ndarray, after: np.ndarray) -> pa.Array:
    """Tags without attributes, written once for each name, and text by array operations; all else one by one."""
    kind, name, content = (batch.column(k) for k in ("event_type", "name", "content"))
    begins, ends, text = among(kind, "start_element"), among(kind, "end_element"), among(kind, "characters", "space")
    begins &= numbers(pc.list_value_length(batch.column("attrs")), 0) == 0
    rest = np.flatnonzero(~(begins | ends | text))
    known = name.dictionary_encode().dictionary.to_pylist()
    texts = content.filter(pa.array(text))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        if pc.any(pc.match_substring(texts, plain)).as_py():
            texts = pc.replace_substring(texts, plain, escaped)
    some = batch.take(pa.array(rest))
    slow = zip(*(as_list(some.column(k)) for k in ("event_type", "name", "attrs", "content")), empty[rest].tolist(), after[rest].tolist(), strict=True) if len(rest) else ()
    tags = ["", *[f"<{x}>" for x in known], *[f"<{x}/>" for x in known], *[f"</{x}>" for x in known]]
    at = 1 + codes + np.where(ends, 2 * len(known), np.where(empty, len(known), 0))
    none = (codes < 0) & (begins | ends & ~after)
    at[ends & after] = 0
    at[text] = len(tags) + np.arange(len(texts))
    at[rest] = len(tags) + len(texts) + np.arange(len(rest))
    return pa.concat_arrays([pa.array(tags, pa.string()), texts.cast(pa.string()), pa.array([_fragment(*x) for x in slow], pa.string())]).take(pa.array(at, mask=none))


def _codes(names: pa.Array) -> np.ndarray:
    return numbers(names.dictionary_encode().indices)


def to_text(events: DataFrame, pretty: bool = False, indent: int | str = 2) -> DataFrame:
    """(doc_id, xml): fragments joined where they are made."""

    def f(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        parts = batch.column("fragment").fill_null("")
        ends = pa.array(np.append(firsts, len(batch)), pa.int32())
        xml = pc.binary_join(pa.ListArray.from_arrays(ends, parts), "")
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(firsts)), xml], ["doc_id", "xml"]), np.arange(len(firsts))

    return whole(fragments(events, pretty, indent), f, ("fragment",), {"xml": "string"}, last=True)


def blocks(texts: DataFrame, size: int = 65536, text: str = "xml") -> DataFrame:
    """Each document's bytes in blocks of ``size`` (the last may be shorter): (doc_id, block, data)."""
    n = F.octet_length(text)
    rows = texts.select("doc_id", F.col(text).cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)))).alias("block"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), F.substring("b", F.col("block").cast("int") * size + 1, F.lit(size)).alias("data"))


def greedy_blocks(frags: DataFrame, size: int = 65536) -> DataFrame:
    """Fragments joined until a block reaches ``size`` bytes; each block ends with a whole fragment."""
    known = frags.__dict__.get("_whole")
    make = known.make if known else None
    rows = known.docs if known else frags.repartition("doc_id").sortWithinPartitions("doc_id", "seq").select("doc_id", "fragment")
    kind = frags.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, n, held, length, last = None, 0, [], 0, None  # the document that came last, and its block that is still open
        made = lambda ids, numbers_, data: pa.RecordBatch.from_arrays([ids, pa.array(numbers_, pa.int64()), data], ["doc_id", "block", "data"])
        for batch in (b for b, _ in make(batches, ("fragment",))) if make else batches:
            if not len(batch):
                continue
            ids, parts, m = batch.column(0), batch.column(1).fill_null("").cast(pa.binary()), len(batch)
            goes_on = last is not None and ids[0].as_py() == doc
            if not goes_on:
                if held:
                    yield made(last, [n], pa.array([b"".join(held)], pa.binary()))
                n, held, length = 0, [], 0
            firsts = _changes(ids)
            bounds = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + m + 1]
            size_of = bounds.astype(np.int64)
            doc_ends = np.repeat(np.append(firsts[1:], m), np.diff(np.append(firsts, m)))
            # where a block ends that begins with a fragment
            reach = np.append(size_of[0] - length, size_of[1:-1]) + size
            ends = np.maximum(np.minimum(np.searchsorted(size_of, reach), doc_ends), np.arange(m) + 1).tolist()
            begins, k = [], 0
            while k < m:
                begins.append(k)
                k = ends[k]
            begins = np.array(begins)
            own = np.searchsorted(firsts, begins, "right") - 1
            number = np.arange(len(begins)) - np.searchsorted(own, own) + np.where(own == 0, n, 0)
            edges = np.append(bounds[begins], bounds[-1]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), parts.buffers()[2] or pa.py_buffer(b"")])
            ids = ids.take(pa.array(begins))
            if held:
                data = pa.concat_arrays([pa.array([b"".join(held) + data[0].as_py()], pa.binary()), data.slice(1)])
            rest = data[-1].as_py()
            is_open = len(rest) < size
            doc, last, n = ids[-1].as_py(), ids.slice(len(ids) - 1), int(number[-1]) + (not is_open)
            held, length = ([rest], len(rest)) if is_open else ([], 0)
            whole_ = len(begins) - is_open
            if whole_:
                yield made(ids.slice(0, whole_), number[:whole_], data.slice(0, whole_))
        if held:
            yield made(last, [n], pa.array([b"".join(held)], pa.binary()))

    return rows.mapInArrow(run, f"doc_id {kind}, block long, data binary")
