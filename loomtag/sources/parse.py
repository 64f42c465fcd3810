"""Documents to the event relation: a row for each event, ordered by ``seq`` within ``doc_id``."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..functions.preprocess import preprocess
from ..functions.tokenizer import Event, events, expanded
from .columnar import Plain

ATTR = "struct<name:string,value:string,prefix:string,local:string,ns_uri:string>"
_KINDS = {
    "seq": "long", "event_type": "string", "name": "string", "prefix": "string", "local": "string", "ns_uri": "string", "attrs": f"array<{ATTR}>", "content": "string",
    "line": "int", "line_start": "long", "pos": "long", "depth": "int", "elem_id": "long", "parent_id": "long", "path": "array<string>", "ns_scope": "map<string,string>",
    "error": "struct<source:string,type:string,message:string>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in _KINDS.items())
_ATTR = pa.struct([(k, pa.string()) for k in ("name", "value", "prefix", "local", "ns_uri")])
_TYPES = {
    "seq": pa.int64(), "event_type": pa.string(), "name": pa.string(), "prefix": pa.string(), "local": pa.string(), "ns_uri": pa.string(),
    "attrs": pa.list_(_ATTR), "content": pa.string(), "line": pa.int32(), "line_start": pa.int64(), "pos": pa.int64(), "depth": pa.int32(), "elem_id": pa.int64(),
    "parent_id": pa.int64(), "path": pa.list_(pa.string()), "ns_scope": pa.map_(pa.string(), pa.string()), "error": pa.struct([("source", pa.string()), ("type", pa.string()), ("message", pa.string())]),
}


def _attrs(e: Event) -> list[dict] | None:
    if e.attrs is None:
        return None
    out = []
    for name, value in e.attrs:
        prefix, colon, local = name.partition(":")
        uri = None
        if e.ns is not None:
            found = e.ns.expand_attribute(name)
            uri = found[0] if found else None
        out.append({"name": name, "value": value, "prefix": prefix if colon else "", "local": local if colon else name, "ns_uri": uri})
    return out


def columns(b: bytes, config: ParserConfig, first: int = 0) -> dict[str, list]:
    """One document's events as columns."""
    out: dict[str, list] = {k: [] for k in _TYPES}
    breaks = None
    if config.positions != "none":
        breaks = np.flatnonzero(np.frombuffer(b, np.uint8) == 10).tolist() if b"\n" in b else []
    appends = [c.append for c in out.values()]
    for seq, e in enumerate(events(b, config), first):
        if e.kind in config.disable:
            continue
        line = start = pos = None
        if e.pos is not None and breaks is not None:
            k = bisect_left(breaks, e.pos)
            line, start, pos = k + 1, breaks[k - 1] + 1 if k else 0, e.pos
            if config.positions == "line_only":
                start = pos = None
        prefix, local, uri = expanded(e) if e.name is not None else (None, None, None)
        row = (seq, e.kind, e.name, prefix, local, uri, _attrs(e), e.content, line, start, pos, e.depth, e.elem, e.parent, list(e.path) if e.path is not None else None,
               list(e.ns.visible().items()) if config.scopes and e.kind == "start_element" else None, dict(zip(("source", "type", "message"), e.error, strict=True)) if e.error else None)
        for add, v in zip(appends, row, strict=True):
            add(v)
    return out


#: Bytes of documents that are made into events at once; a larger document stands alone.
AT_ONCE = 1 << 18


class Whole:
    """How a relation comes of documents without an exchange: ``make(batches, columns)`` gives (batch, first rows of
    its documents), each document whole and in order. Operators on whole documents go on from it in one worker."""

    def __init__(self, docs: DataFrame, make: Callable, kept: tuple[str, ...], kinds: dict[str, str]):
        self.docs, self.make, self.kept, self.kinds = docs, make, kept, kinds

    def frame(self) -> DataFrame:
        make, kept = self.make, self.kept
        out = self.docs.mapInArrow(lambda batches: (batch for batch, _ in make(batches, kept)), ", ".join(f"{k} {v}" for k, v in self.kinds.items()))
        out._whole = self
        return out


def parse(docs: DataFrame, text: str = "xml", doc_id: str = "doc_id", config: ParserConfig | None = None, prepared: bool = False, columns: Collection[str] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id and the events' columns; no shuffle, one task works on whole documents.

    ``text`` is a string or binary column. Null counts as empty. With
    ``prepared``, byte order marks, UTF-16 and line ends are dealt with first. ``columns`` are those that are
    made, as Catalyst can't push their pruning through Python; all by default.
    """
    config = config or ParserConfig()
    source = preprocess(F.col(text)) if prepared else F.col(text)
    pairs = docs.select(F.col(doc_id).alias("doc_id"), source.cast("binary").alias("xml"))
    if unknown := set(columns or ()) - set(_TYPES):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    kept = tuple(k for k in _TYPES if columns is None or k in columns)

    def make(batches: Iterator[pa.RecordBatch], wanted: Collection[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        names = [k for k in _TYPES if k in wanted]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy())
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                yield from _events_of(ids.slice(lo, hi - lo), texts.slice(lo, hi - lo), config, names)
                lo = hi

    return Whole(pairs, make, kept, {"doc_id": pairs.schema["doc_id"].dataType.simpleString()} | {k: v for k, v in _KINDS.items() if k in kept}).frame()


def _events_of(ids: pa.Array, texts: pa.Array, config: ParserConfig, names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    plain = Plain(texts, config)
    if len(plain.owners):
        yield _batch(ids.take(pa.array(plain.owners)), plain.events_of, plain.columns(names, _TYPES))
    if not len(plain.rest):
        return
    # of equal documents one is tokenized
    ids, texts = ids.take(pa.array(plain.rest)), texts.take(pa.array(plain.rest)).fill_null(b"")
    known = texts.dictionary_encode()
    codes, held, sizes = known.indices.to_numpy(), [], []
    for b in known.dictionary:
        own = columns(b.as_py(), config)
        sizes.append(len(own["seq"]))
        held.append([own[k] for k in names])
    made = {k: pa.array([x for own in held for x in own[i]], _TYPES[k]) for i, k in enumerate(names)}
    count = np.array(sizes, np.int64)
    most = max(20_000, int(count.max()))
    total = np.cumsum(count[codes])
    lo = 0
    while lo < len(codes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        own = codes[lo:hi]
        n = count[own]
        rows = np.repeat((np.cumsum(count) - count)[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield _batch(ids.slice(lo, hi - lo), n, {k: v.take(pa.array(rows)) for k, v in made.items()})
        lo = hi


def _batch(ids: pa.Array, sizes: np.ndarray, made: dict[str, pa.Array]) -> tuple[pa.RecordBatch, np.ndarray]:
    doc = ids.take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return pa.RecordBatch.from_arrays([doc, *made.values()], ["doc_id", *made]), firsts


def parse_files(spark: SparkSession, path: str, config: ParserConfig | None = None) -> DataFrame:
    """Every file under ``path`` as one document; ``doc_id`` is its path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("xml"))
    return parse(files, config=config, prepared=True)
