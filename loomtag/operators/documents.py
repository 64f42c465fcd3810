"""Functions of one whole document lifted to a column of documents, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import c14n, dtd, tree
from ..functions.preprocess import preprocess
from ..sources.shared import written


def per_document(docs: DataFrame, f: Callable[[bytes], list[dict]], schema: str, text: str = "xml") -> DataFrame:
    """``f(bytes)`` gives rows; each carries its document's ``doc_id``. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = docs.schema["doc_id"].dataType.simpleString()
    target = to_arrow_schema(_parse_datatype_string(f"doc_id {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"doc_id": d, **r} for r in f(b or b"")]
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, target)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, target)

    return docs.select("doc_id", F.col(text).cast("binary")).mapInArrow(run, f"doc_id {kind}, {schema}")


def canonicalize(docs: DataFrame, how: str = "c14n", inclusive: tuple[str, ...] = (), text: str = "xml") -> DataFrame:
    """(doc_id, canonical, error): a document that isn't well-formed has an error instead."""

    def one(b: bytes) -> list[dict]:
        try:
            return [{"canonical": c14n.canonicalize(b, how, inclusive), "error": None}]
        except ValueError as e:
            return [{"canonical": None, "error": str(e)}]

    return per_document(docs, one, "canonical string, error string", text)


def simple_form(docs: DataFrame, text: str = "xml", include_comments: bool = False) -> DataFrame:
    """(doc_id, form): each document as nested [tag, [[name, value], …], [child, …]] in JSON."""
    return per_document(docs, lambda b: [{"form": tree.to_json(tree.simple_form(b, include_comments))}], "form string", text)


def from_simple_form(forms: DataFrame, form: str = "form") -> DataFrame:
    """(doc_id, xml) of forms in JSON."""
    return per_document(forms, lambda b: [{"xml": tree.serialize(tree.from_json(b.decode()))}], "xml string", form)


DECLARATIONS = "kind string, name string, element string, value string, type string, default_type string, default_value string, system_id string, public_id string, notation string, error string"


_SYSTEM = r"(?:SYSTEM|PUBLIC\s+(?:\"[^\"]*\"|'[^']*'))\s+(?:\"([^\"]*)\"|'([^']*)')"


def _system_ids(text: str):
    """The distinct system identifiers that a text of declarations names."""
    found = [F.regexp_extract_all(F.col(text).cast("string"), F.lit(_SYSTEM), F.lit(k)) for k in (1, 2)]
    return F.filter(F.array_distinct(F.concat(*found)), lambda x: x != "")


def with_external(docs: DataFrame, external: DataFrame, text: str = "xml") -> DataFrame:
    """``docs`` with a column ``externals``: by system identifier, the texts that the document names and those
    that these name in turn, as JSON. ``external(system_id, content)`` is all that may be read, nothing else is
    fetched; identifiers are compared as they are written. Of rows that repeat an identifier the least content
    counts. Documents that name none of them have null.
    """
    known = external.where("system_id IS NOT NULL").groupBy("system_id").agg(F.min(F.col("content").cast("string")).alias("content"))
    known = written(known)
    # what each text reaches, a step further in each round until nothing is new
    reach = written(known.select("system_id", F.explode(F.concat(F.array("system_id"), _system_ids("content"))).alias("other")).distinct().join(known.select(F.col("system_id").alias("other")), "other"))
    size = -1
    while size != (size := reach.count()):
        further = reach.join(reach.select(F.col("system_id").alias("other"), F.col("other").alias("__next")), "other").select("system_id", F.col("__next").alias("other"))
        reach = written(further.distinct())
    texts = reach.join(known.select(F.col("system_id").alias("other"), "content"), "other").groupBy("system_id").agg(F.map_from_entries(F.collect_list(F.struct("other", "content"))).alias("texts"))
    named = docs.select("doc_id", F.explode(_system_ids(text)).alias("system_id")).distinct().join(texts, "system_id")
    own = named.select("doc_id", F.explode("texts")).distinct().groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("externals"))
    return docs.join(own, "doc_id", "left")


def _per_declared(docs: DataFrame, f: Callable, schema: str, text: str, external: DataFrame | None) -> DataFrame:
    """``f(bytes, external)`` for each document; with a table of outer texts they come along in one struct."""
    if external is None:
        return per_document(docs, lambda b: f(b, None), schema, text)

    def one(b: bytes) -> list[dict]:
        both = json.loads(b)
        texts = json.loads(both.get("externals") or "{}")
        return f(both.get("xml", "").encode(), lambda system_id, public_id: texts.get(system_id))

    joined = with_external(docs.select("doc_id", F.col(text).cast("string").alias("xml")), external)
    return per_document(joined.select("doc_id", F.to_json(F.struct("xml", "externals")).alias("both")), one, schema, "both")


def declarations(docs: DataFrame, text: str = "xml", edition: int = 5, external: DataFrame | None = None) -> DataFrame:
    """Each declaration of each document's internal subset as a row; kinds are element, attribute, internal,
    external, unparsed, parameter, notation, doctype and error. With ``external(system_id, content)``, those of
    the outer subset and of outer parameter entities too."""
    return _per_declared(docs, lambda b, outer: dtd.rows_of_document(b, edition, outer), DECLARATIONS, text, external)


def entity_values(docs: DataFrame, text: str = "xml", external: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, value, error): general entities with all they refer to expanded, within the limits."""

    def one(b: bytes, outer) -> list[dict]:
        model = dtd.model_of_document(b, outer)
        out = []
        for name in model.entities if model else ():
            try:
                out.append({"name": name, "value": model.expand(name), "error": None})
            except dtd.DTDError as e:
                out.append({"name": name, "value": None, "error": e.kind})
        return out

    return _per_declared(docs, one, "name string, value string, error string", text, external)


def resolved(docs: DataFrame, text: str = "xml", on_unknown: str = "keep", external: DataFrame | None = None) -> DataFrame:
    """(doc_id, xml): entities that each document declares replaced throughout, attributes normalised by type."""
    return _per_declared(docs, lambda b, outer: [{"xml": dtd.resolve_document(b, on_unknown, outer)}], "xml string", text, external)


def process(docs: DataFrame, text: str = "xml", on_unknown: str = "keep", external: DataFrame | None = None) -> DataFrame:
    """Documents to clean events in one go: byte order marks, UTF-16 and line ends dealt with; what
    ``validate.compliant`` finds in the documents as they came, as error events before what they speak of; and the
    events of the documents with their declared entities resolved, markup among them parsed, and names expanded.

    Null text counts as empty; a document that cannot be read has its errors and what could be read. Errors carry
    the ``seq`` of the document as it came, and those of the tokenizer come once.
    """
    from ..sources.parse import parse
    from . import resolve, validate

    clean = docs.select("doc_id", preprocess(F.col(text)).alias("xml"))
    errors = validate.compliant(parse(clean))
    events = parse(resolved(clean, on_unknown=on_unknown, external=external)).where("event_type <> 'error'")
    return validate.apply(resolve.entities(events, on_unknown=on_unknown), errors)
