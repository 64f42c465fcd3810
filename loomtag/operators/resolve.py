"""Entities and namespaces resolved, as expressions over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.namespaces import XMLNS
from .stream import is_

#: The five entities that need no declaration.
PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_REF = r"&(#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_:][A-Za-z0-9._:-]*);"


def _chr(code: Column) -> Column:
    """The character of a code point, by its UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def encode(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def encode_attr(text: Column) -> Column:
    return F.replace(encode(text), F.lit('"'), F.lit("&quot;"))


def resolve_text(text: Column, entities: Column | None = None, on_unknown: str = "keep") -> Column:
    """Every reference replaced once; what an entity holds isn't looked at again. ``entities`` is a map column.
    Unknown ones are kept or removed; ``null`` makes the whole text null, for callers that report them."""
    own = F.create_map(*[F.lit(x) for kv in PREDEFINED.items() for x in kv])
    refs = F.regexp_extract_all(text, F.lit(_REF), F.lit(1))
    rest = F.split(text, _REF)

    def one(r: Column) -> Column:
        code = F.when(r.startswith("#x"), F.conv(F.substring(r, 3, 20), 16, 10)).when(r.startswith("#"), F.substring(r, 2, 20)).cast("long")
        valid = code.isin(9, 10, 13) | code.between(32, 0xD7FF) | code.between(0xE000, 0xFFFD) | code.between(0x10000, 0x10FFFF)
        value = F.when(r.startswith("#"), F.when(valid, _chr(code))).otherwise(F.coalesce(F.try_element_at(own, r), F.try_element_at(entities, r) if entities is not None else F.lit(None).cast("string")))
        unknown = F.concat(F.lit("&"), r, F.lit(";")) if on_unknown == "keep" else F.lit("") if on_unknown == "remove" else F.lit(None).cast("string")
        return F.coalesce(value, unknown)

    # what stands before each reference, beside it; the last stretch has none
    parts = F.transform(F.arrays_zip(rest, refs), lambda z: F.concat(z["0"], F.when(z["1"].isNull(), F.lit("")).otherwise(one(z["1"]))))
    whole = F.get(F.transform(F.array(parts), lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, ""))), 0)
    return F.when(~text.contains("&"), text).otherwise(whole)


def resolve_attrs(entities: Column | None = None, on_unknown: str = "keep") -> Column:
    return F.transform("attrs", lambda a: a.withField("value", resolve_text(a["value"], entities, on_unknown)))


def entities(events: DataFrame, known: Column | None = None, on_unknown: str = "keep") -> DataFrame:
    """Text and attribute values with their references resolved. With ``on_unknown='emit'`` an event that holds
    an unknown reference, or an ampersand that opens none, becomes an error."""
    mode = "null" if on_unknown == "emit" else on_unknown
    text = F.when(is_("characters"), resolve_text(F.col("content"), known, mode)).otherwise(F.col("content"))
    out = events.withColumn("__text", text).withColumn("__attrs", F.when(is_("start_element"), resolve_attrs(known, mode)).otherwise(F.col("attrs")))
    bare = F.col("content").rlike(r"&(?!(?:#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_:][A-Za-z0-9._:-]*);)") & is_("characters")
    lost = F.col("__text").isNull() & F.col("content").isNotNull() | F.exists("__attrs", lambda a: a["value"].isNull())
    wrong = F.coalesce(bare | lost if on_unknown == "emit" else bare, F.lit(False))
    kind = F.when(bare, "bare_ampersand").otherwise("unknown_entity")
    error = F.struct(F.lit("entities").alias("source"), kind.alias("type"), F.col("content").alias("message"))
    out = out.withColumn("error", F.when(wrong, error).otherwise(F.col("error"))).withColumn("event_type", F.when(wrong, "error").otherwise(F.col("event_type")))
    return out.withColumn("content", F.col("__text")).withColumn("attrs", F.col("__attrs")).drop("__text", "__attrs")


def namespaces(events: DataFrame, strip_declarations: bool = False) -> DataFrame:
    """Expanded names: ``ns_uri`` and ``local`` stand beside ``name`` already; here declarations can be taken
    out, and a start whose prefix nothing declares becomes an error."""
    loose = lambda p, u: (p != "") & ~p.isin("xml", "xmlns") & u.isNull()
    wrong = F.coalesce(is_("start_element") & (loose(F.col("prefix"), F.col("ns_uri")) | F.exists("attrs", lambda a: loose(a["prefix"], a["ns_uri"]))), F.lit(False))
    error = F.struct(F.lit("namespaces").alias("source"), F.lit("undeclared_prefix").alias("type"), F.col("name").alias("message"))
    out = events.withColumn("__bad", wrong)
    out = out.withColumn("error", F.when(F.col("__bad"), error).otherwise(F.col("error"))).withColumn("event_type", F.when(F.col("__bad"), "error").otherwise(F.col("event_type"))).drop("__bad")
    return out.withColumn("attrs", F.filter("attrs", lambda a: ~F.coalesce(a["ns_uri"] == XMLNS, F.lit(False)))) if strip_declarations else out


def expanded_name() -> Column:
    """``{uri}local``, or ``local`` without a namespace."""
    return F.when(F.col("ns_uri").isNull(), F.col("local")).otherwise(F.concat(F.lit("{"), "ns_uri", F.lit("}"), "local"))


def track(events: DataFrame, only_changes: bool = False) -> DataFrame:
    """The start events with the namespaces in scope (parse with ``scopes=True``), or only those that declare
    some."""
    changed = F.exists("attrs", lambda a: F.coalesce(a["ns_uri"] == XMLNS, F.lit(False)))
    starts = events.where(is_("start_element") & changed if only_changes else is_("start_element"))
    return starts.select("doc_id", "seq", "name", "elem_id", "depth", "ns_scope")


def contexts(events: DataFrame) -> DataFrame:
    """(doc_id, ns_scope): the namespaces in scope at each document's first element (parse with ``scopes=True``)."""
    starts = events.where(is_("start_element"))
    return starts.groupBy("doc_id").agg(F.min_by("ns_scope", "seq").alias("ns_scope"))


def errors(events: DataFrame) -> DataFrame:
    """The error events that resolving names made."""
    return events.where(is_("error") & (F.col("error.source") == "namespaces"))
