"""What one event holds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EVENT_TYPES


def tag(name: Column) -> Column:
    """(local, prefix): split at the first colon; without one the prefix is empty."""
    has = F.instr(name, ":") > 0
    return F.struct(F.when(has, F.regexp_replace(name, "^[^:]*:", "")).otherwise(name).alias("local"), F.when(has, F.substring_index(name, ":", 1)).otherwise("").alias("prefix"))


def tag_name(local: Column, prefix: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", local).otherwise(F.concat_ws(":", prefix, local))


def tag_string() -> Column:
    return F.col("name")


def attributes() -> Column:
    return F.when(F.col("event_type").isin("start_element", "prolog"), F.col("attrs"))


def attribute(name: str) -> Column:
    """The value of the first attribute with this qualified name."""
    return F.get(F.filter("attrs", lambda a: a["name"] == name), 0)["value"]


def attribute_ns(uri: str | None, local: str) -> Column:
    """By namespace and local name; without a namespace any with the local name."""
    return F.get(F.filter("attrs", lambda a: (a["local"] == local) & (F.lit(True) if uri is None else a["ns_uri"] == uri)), 0)["value"]


def has_attribute(name: str) -> Column:
    return F.exists("attrs", lambda a: a["name"] == name)


def attribute_at(i: int) -> Column:
    return F.get("attrs", i)


def attribute_count() -> Column:
    return F.coalesce(F.size("attrs"), F.lit(0))


def attribute_map() -> Column:
    """Name to value; of several with one name the last counts."""
    last = F.filter("attrs", lambda a, i: ~F.exists(F.slice("attrs", i + 2, F.size("attrs")), lambda b: b["name"] == a["name"]))
    return F.map_from_arrays(F.transform(last, lambda a: a["name"]), F.transform(last, lambda a: a["value"]))


def set_attribute(name: str, value: Column) -> Column:
    """The attributes with one replaced, or appended."""
    one = F.struct(F.lit(name).alias("name"), value.alias("value"), tag(F.lit(name))["prefix"].alias("prefix"), tag(F.lit(name))["local"].alias("local"), F.lit(None).cast("string").alias("ns_uri"))
    return F.when(has_attribute(name), F.transform("attrs", lambda a: F.when(a["name"] == name, a.withField("value", value)).otherwise(a))).otherwise(F.concat("attrs", F.array(one)))


def remove_attribute(name: str) -> Column:
    """The attributes without the first of this name."""
    first = F.array_position(F.transform("attrs", lambda a: a["name"]), name)
    return F.filter("attrs", lambda a, i: i + 1 != first)


def content() -> Column:
    return F.col("content")


def position() -> Column:
    """(line, column); events without a place have 0, 0."""
    return F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce(F.col("pos") - F.col("line_start"), F.lit(0)).alias("column"))


def location() -> Column:
    return F.struct("line", "line_start", "pos")


def id_list() -> tuple[str, ...]:
    return EVENT_TYPES


#: The event numbers of the pull API (JSR 173), fixed values.
STAX_CODES = {
    "start_element": 1, "end_element": 2, "processing_instruction": 3, "characters": 4, "comment": 5, "space": 6, "start_document": 7,
    "end_document": 8, "entity_reference": 9, "attribute": 10, "dtd": 11, "cdata": 12, "namespace": 13, "notation_declaration": 14, "entity_declaration": 15,
}


def stax_code() -> Column:
    """The event's number; the XML declaration counts as the start of the document."""
    kind = F.when(F.col("event_type") == "prolog", "start_document").otherwise(F.col("event_type"))
    return F.element_at(F.create_map(*[F.lit(x) for kv in STAX_CODES.items() for x in kv]), kind)


def stax_kind(code: Column) -> Column:
    """The kind of an event's number; null for numbers that stand for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in STAX_CODES.items() for x in (v, k)]), code.cast("int"))
