"""Filters, maps and folds over the event relation."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Problem
from .whole import as_rows, taken, whole, with_columns

MARKERS = ("start_document", "end_document")
#: A whitespace-only run of text.
BLANK = r"\A\s*\z"
_log = logging.getLogger("loomtag")


def is_(*kinds: str) -> Column:
    return F.col("event_type").isin(*kinds)


def in_order() -> Window:
    """The window of a document's events; operators that use it share one exchange."""
    return Window.partitionBy("doc_id").orderBy("seq")


def arranged(events: DataFrame) -> DataFrame:
    """Each document whole and in order within one partition; do it once, before several folds."""
    return events.repartition("doc_id").sortWithinPartitions("doc_id", "seq")


def filter_events(events: DataFrame, test: Column) -> DataFrame:
    """Rows that pass; document markers always do."""
    return events.where(test | is_(*MARKERS))


def transform_events(events: DataFrame, test: Column | None = None, event_mode: str = "pass", **changes: Column) -> DataFrame:
    """Keep rows that pass ``test`` (others are dropped) with columns changed. ``event_mode`` tells what happens
    to kinds of events that aren't of the vocabulary: ``pass``, ``discard`` or ``strict`` (an error instead)."""
    from ..config import EVENT_TYPES

    known = is_(*EVENT_TYPES)
    if event_mode == "discard":
        events = events.where(known)
    elif event_mode == "strict":
        wrong = F.struct(F.lit("validation").alias("source"), F.lit("unknown_event").alias("type"), F.concat(F.lit("unknown event "), "event_type").alias("message"))
        events = events.withColumn("error", F.when(known, F.col("error")).otherwise(wrong)).withColumn("event_type", F.when(known, F.col("event_type")).otherwise("error"))
    out = events if test is None else events.where(test)
    return out.withColumns(changes)


def drop_outside_root(events: DataFrame) -> DataFrame:
    """Whitespace outside the root goes, other text there becomes a validation error."""
    outside = is_("characters", "space") & (F.col("depth") == 0)
    blank = F.col("content").rlike(BLANK)
    wrong = F.struct(F.lit("validation").alias("source"), F.lit("text_outside_root").alias("type"), F.lit("text outside the root element").alias("message"))
    kept = events.where(~(outside & blank) | ~outside)
    return kept.withColumn("error", F.when(outside, wrong).otherwise(F.col("error"))).withColumn("event_type", F.when(outside, "error").otherwise(F.col("event_type")))


def tap(events: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, object]:
    """Pass all rows and observe aggregates on the way: (rows, Observation)."""
    from pyspark.sql import Observation

    seen = Observation(label)
    return events.observe(seen, *[v.alias(k) for k, v in (metrics or {"events": F.count(F.lit(1))}).items()]), seen


def filter_ws(events: DataFrame) -> DataFrame:
    return events.where(~(is_("space") | is_("characters") & F.col("content").rlike(BLANK)))


def filter_namespaces(events: DataFrame, names: Iterable[str], include: bool = True, by: str = "prefix") -> DataFrame:
    """Elements whose prefix (or with ``by='uri'`` namespace) is among ``names``, or isn't. Content goes with
    the element it stands in; what stands outside any element stays."""
    own = F.coalesce(F.col("prefix" if by == "prefix" else "ns_uri"), F.lit(""))
    tag = is_("start_element", "end_element")
    if by == "prefix":  # the path names the element that content stands in
        name = F.try_element_at("path", F.lit(-1))
        owner = F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise("")
        owned = events.withColumn("__owner", F.when(tag, own).otherwise(owner))
    else:
        start = F.max(F.when(is_("start_element"), own)).over(Window.partitionBy("doc_id", "elem_id"))
        owned = events.withColumn("__owner", F.when(tag, own).otherwise(start))
    hit = F.col("__owner").isin(*names) if include else ~F.col("__owner").isin(*names)
    free = is_(*MARKERS, "error") | (F.col("depth") == 0) & ~tag
    return owned.where(free | hit).drop("__owner")


def errors(events: DataFrame) -> DataFrame:
    """The error rows as (doc_id, seq, source, type, message, line, column)."""
    return events.where(is_("error")).select("doc_id", "seq", "error.source", "error.type", "error.message", "line", (F.col("pos") - F.col("line_start")).alias("column"))


def halt_on_error(events: DataFrame) -> DataFrame:
    """Each document up to its first error, that included."""
    first = F.min(F.when(is_("error"), F.col("seq"))).over(Window.partitionBy("doc_id"))
    return events.withColumn("__first", first).where(F.col("__first").isNull() | (F.col("seq") <= F.col("__first"))).drop("__first")


def check_errors(events: DataFrame) -> DataFrame:
    """Per document whether it is free of errors, and how many it has."""
    n = F.count_if(is_("error"))
    return events.groupBy("doc_id").agg((n == 0).alias("ok"), n.alias("n_errors"))


def log_on_error(events: DataFrame, level: int = logging.WARNING, prefix: str = "", most: int = 20) -> DataFrame:
    """Log a few of the errors and pass all rows."""
    for r in errors(events).limit(most).collect():
        _log.log(level, "%s%s: %s %s", prefix, r["doc_id"], r["type"], r["message"])
    return events


def raise_on_error(events: DataFrame) -> DataFrame:
    """Raise the first error found, if there is one."""
    for r in errors(events).limit(1).collect():
        raise Problem(r["type"], f"{r['doc_id']}: {r['message']}", r["line"], r["column"])
    return events


def _numbered(n: int, firsts: np.ndarray) -> np.ndarray:
    return np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))


def take(events: DataFrame, n: int) -> DataFrame:
    """The first n events of each document."""
    return whole(events, lambda batch, firsts: taken(batch, np.flatnonzero(_numbered(len(batch), firsts) < n), firsts), (), {}, passed=events.columns)


def chunk_every(events: DataFrame, n: int) -> DataFrame:
    """Number the events of each document in chunks of n."""
    return whole(events, lambda batch, firsts: (with_columns(batch, chunk=pa.array(_numbered(len(batch), firsts) // n)), firsts), (), {"chunk": "long"}, passed=events.columns)


def drop_while(events: DataFrame, test: Column) -> DataFrame:
    """Each document from the first event on that fails ``test``."""
    passed = F.max(F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1)).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("__on", passed).where("__on = 1").drop("__on")


def fold(events: DataFrame, start: Callable[[], object], step: Callable[[dict, object], tuple[object, list[dict]]], finish: Callable[[object], list[dict]], schema: str, is_arranged: bool = False) -> DataFrame:
    """A stateful pass over each document: ``step(event, state)`` gives the next state and rows, ``finish(state)``
    the last rows. Events straight from the parser are folded where they are made, others after one exchange by
    document; state is that of one document at a time, however many a partition holds."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = events.schema["doc_id"].dataType.simpleString()
    full = f"doc_id {kind}, {schema}"
    target = to_arrow_schema(_parse_datatype_string(full))
    own = events.__dict__.get("_whole")
    make, kept = (own.make, own.kept) if own else (None, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, state, began, out = None, None, False, []
        for batch in (b for b, _ in make(batches, kept)) if make else batches:
            for e in as_rows(batch):
                if not began or e["doc_id"] != doc:
                    if began:
                        out += [{"doc_id": doc, **r} for r in finish(state)]
                    doc, state, began = e["doc_id"], start(), True
                state, made = step(e, state)
                out += [{"doc_id": doc, **r} for r in made]
            if out:
                yield pa.RecordBatch.from_pylist(out, target)
                out = []
        if began and (last := [{"doc_id": doc, **r} for r in finish(state)]):
            yield pa.RecordBatch.from_pylist(last, target)

    rows = own.docs if own else events if is_arranged else arranged(events)
    return rows.mapInArrow(run, full)
