"""Validators. Each gives error rows (doc_id, seq, source, type, detail); ``apply`` puts them into the events,
drops what they speak of, or raises.

The tokenizer keeps an element open when an end tag does not match it, so what an end tag closed is known per
row and most rules are plain expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Problem
from ..functions.chars import NCNAME_JAVA
from ..functions.namespaces import XML, XMLNS
from .stream import is_
from .whole import among, documents_of, numbers, whole, with_columns

_COLUMNS = ("doc_id", "seq", "source", "type", "detail")
PREDEFINED = ("amp", "lt", "gt", "quot", "apos")


_FOUND = "array<struct<source:string,type:string,detail:string>>"


def _none() -> Column:
    return F.array().cast(_FOUND)


def _where(source: str, test: Column, kind: str | Column, detail: Column | None = None) -> Column:
    """The finding of an event that passes ``test``, or none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    one = F.struct(F.lit(source).alias("source"), kind.alias("type"), (detail if detail is not None else F.col("name")).cast("string").alias("detail"))
    return F.coalesce(F.when(test, F.array(one)), _none())


def _each(source: str, found: Column, test: Column | None = None) -> Column:
    """``found``: an array of (type, detail) for each event."""
    out = F.transform(found, lambda x: F.struct(F.lit(source).alias("source"), x["type"].alias("type"), x["detail"].alias("detail")))
    return F.coalesce(out if test is None else F.when(test, out), _none())


def _root() -> Column:
    return is_("start_element") & (F.col("depth") == 1)


_DECLARED = "struct<names:array<string>,unparsed:array<string>,external:array<string>,open:boolean>"


def _declared() -> Column:
    """What entities the document's first declaration declares. ``open``: it refers to parameter entities or to
    an outer subset, where more may be declared."""
    text = F.regexp_replace("__dtd", r"(?s)<!--.*?-->|<\?.*?\?>", "")
    literal = r"(?:\"[^\"]*\"|'[^']*')"
    outer = rf"(?:SYSTEM\s+{literal}|PUBLIC\s+{literal}\s+{literal})"
    names = lambda rest: F.regexp_extract_all(text, F.lit(rf"<!ENTITY\s+([^\s%\"'<>&;]+)\s+{rest}"), F.lit(1))
    more = F.regexp_replace(text, literal, "").rlike(r"%[A-Za-z_:]") | text.rlike(r"\A[^\[]*\s(?:SYSTEM|PUBLIC)\s")
    own = F.struct(names("[\"'SP]").alias("names"), names(outer + r"\s+NDATA").alias("unparsed"), names(outer + r"\s*>").alias("external"), more.alias("open")).cast(_DECLARED)
    return F.when(F.col("__dtd").isNotNull(), own)


#: What rules read of a document's other events: whether the element of an event is closed (1) or not (0), how many
#: roots there are up to the event and in all, and the first document type declaration.
_NEIGHBOURS = {"__closed": "int", "__n": "long", "__all": "long", "__dtd": "string"}


def _marked(batch: pa.RecordBatch, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    n, kind, elem, depth = len(batch), batch.column("event_type"), numbers(batch.column("elem_id")), numbers(batch.column("depth"))
    own = documents_of(n, firsts)
    keys = own * (int(elem.max(initial=0)) + 2) + elem + 1
    closed = np.isin(keys, keys[among(kind, "end_element")])
    root = among(kind, "start_element") & (depth == 1)
    up_to = np.cumsum(root)
    before = (up_to - root)[firsts][own] if n else up_to
    all_ = np.bincount(own, weights=root, minlength=len(firsts)).astype(np.int64)[own]
    declared, first = np.flatnonzero(among(kind, "dtd")), np.full(len(firsts), -1)
    first[own[declared[::-1]]] = declared[::-1]
    dtd = batch.column("content").take(pa.array(first[own], mask=first[own] < 0))
    return with_columns(batch, __closed=pa.array(closed.astype(np.int32)), __n=pa.array(up_to - before), __all=pa.array(all_), __dtd=dtd), firsts


def rule(*neighbours: str):
    """Make a validator of a function that gives each event's findings as an array column: events -> error rows.
    Several of them share one pass over the events; what they need of other events is told where these are made."""

    def wrap(findings: Callable[..., Column]) -> Callable[..., DataFrame]:
        def validator(events: DataFrame) -> DataFrame:
            return _pass(events, [validator])

        validator.findings, validator.neighbours = findings, neighbours
        validator.__name__, validator.__doc__ = findings.__name__, findings.__doc__
        return validator

    return wrap


def _pass(events: DataFrame, validators: list) -> DataFrame:
    if needs := {n for v in validators for n in v.neighbours}:
        events = whole(events, _marked, ("event_type", "elem_id", "depth", "content"), _NEIGHBOURS, passed=events.columns)
        if "__declared" in needs:
            events = events.withColumn("__declared", _declared())
    found = F.concat(*[v.findings() for v in validators])
    return events.select("doc_id", "seq", F.inline(found)).select(*_COLUMNS)


@rule("__closed")
def well_formed() -> Column:
    """End tags that don't match or that nothing is open for, and elements never closed (at their start)."""
    stray = is_("end_element") & F.col("elem_id").isNull()
    kind = F.when(is_("start_element"), "unclosed_tag").when(F.col("depth") == 0, "unexpected_close").otherwise("tag_mismatch")
    return _where("structure", stray | is_("start_element") & (F.col("__closed") == 0), kind)


@rule()
def attributes() -> Column:
    names = F.transform("attrs", lambda a: a["name"])
    return _where("attributes", is_("start_element") & (F.size(names) > F.size(F.array_distinct(names))), "duplicate_attr")


@rule()
def attribute_values() -> Column:
    return _where("attribute_values", is_("start_element") & F.exists("attrs", lambda a: a["value"].contains("<")), "attr_lt")


@rule()
def namespaces() -> Column:
    """Prefixes of elements and attributes that nothing declares."""
    loose = lambda p, u: (p != "") & ~p.isin("xml", "xmlns") & u.isNull()
    own = F.when(loose(F.col("prefix"), F.col("ns_uri")), F.array(F.col("prefix"))).otherwise(F.array().cast("array<string>"))
    theirs = F.transform(F.filter("attrs", lambda a: loose(a["prefix"], a["ns_uri"])), lambda a: a["prefix"])
    found = F.transform(F.array_distinct(F.concat(own, theirs)), lambda p: F.struct(F.lit("undeclared_namespace").alias("type"), p.alias("detail")))
    return _each("namespaces", found, is_("start_element"))


@rule()
def comments() -> Column:
    return _where("comments", is_("comment") & (F.col("content").contains("--") | F.col("content").endswith("-")), "comment", F.col("content"))


@rule()
def processing_instructions() -> Column:
    return _where("processing_instructions", is_("processing_instruction") & ((F.lower("name") == "xml") | (F.col("name") == "")), "reserved_pi_target")


@rule("__n", "__all")
def root_boundary() -> Column:
    """Second roots, text or CDATA outside the root, and documents without one."""
    text = (is_("characters") & ~F.col("content").rlike(r"\A\s*\z") | is_("cdata")) & (F.col("depth") == 0)
    test = _root() & (F.col("__n") > 1) | text | is_("end_document") & (F.col("__all") == 0)
    kind = F.when(_root(), "multiple_roots").when(text, "text_outside_root").otherwise("no_root")
    return _where("root_boundary", test, kind)


@rule()
def parser_errors() -> Column:
    """The tokenizer's own errors."""
    own = F.struct("error.source", "error.type", F.col("error.message").alias("detail"))
    return F.coalesce(F.when(is_("error"), F.array(own)), _none())


def _references(known: Column, unparsed: Column, external: Column) -> Column:
    none = F.array().cast("array<string>")
    refs = lambda t: F.regexp_extract_all(t, F.lit("&([a-zA-Z_][a-zA-Z0-9._-]*);"), F.lit(1))
    inside = F.coalesce(F.when(is_("characters"), refs(F.col("content"))), none)
    values = F.coalesce(F.flatten(F.transform("attrs", lambda a: refs(a["value"]))), none)
    kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), x.alias("detail"))
    defined = F.concat(known, unparsed, external, F.array(*[F.lit(x) for x in PREDEFINED]))
    found = F.concat(
        F.transform(F.filter(F.concat(inside, values), lambda x: ~F.array_contains(defined, x)), kind("undefined_entity")),
        F.transform(F.filter(F.concat(inside, values), lambda x: F.array_contains(unparsed, x)), kind("unparsed_entity")),
        F.transform(F.filter(values, lambda x: F.array_contains(external, x)), kind("external_entity_in_attribute")),
    )
    return _each("entity_references", found)


def entity_references(events: DataFrame, known: Column | None = None, unparsed: Column | None = None, external: Column | None = None) -> DataFrame:
    """References to entities that aren't among ``known`` (an array column), that are unparsed, or that are
    external and stand in an attribute."""
    none = F.array().cast("array<string>")
    known, unparsed, external = (x if x is not None else none for x in (known, unparsed, external))
    return events.select("doc_id", "seq", F.inline(_references(known, unparsed, external))).select(*_COLUMNS)


@rule("__declared")
def own_entities() -> Column:
    """References held against what the document itself declares. Without a declaration, or where one refers to
    parameter entities or an outer subset, undefined ones aren't looked for."""
    d = F.col("__declared")
    found = F.coalesce(_references(d["names"], d["unparsed"], d["external"]), _none())
    return F.filter(found, lambda x: ~d["open"] | (x["type"] != "undefined_entity"))


def entity_references_declared(events: DataFrame, entities: DataFrame) -> DataFrame:
    """The same with each document's own declarations, ``entities(doc_id, name, kind)`` (internal, external or
    unparsed); documents without any aren't looked at."""
    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("name")))
    sets = entities.groupBy("doc_id").agg(of("internal").alias("__in"), of("unparsed").alias("__un"), of("external").alias("__ex"))
    return entity_references(events.join(sets, "doc_id"), F.col("__in"), F.col("__un"), F.col("__ex"))


@rule()
def xml_declaration() -> Column:
    names = F.transform("attrs", lambda a: a["name"])
    of = lambda n: F.get(F.filter("attrs", lambda a: a["name"] == n), 0)["value"]
    at = lambda n: F.array_position(names, n)
    rules = [
        (F.exists(names, lambda n: ~n.isin("version", "encoding", "standalone")), "unknown_attribute"),
        (F.size(names) > F.size(F.array_distinct(names)), "duplicate_attribute"),
        (at("version") == 0, "missing_version"),
        ((at("version") > 0) & (at("version") != 1), "version_not_first"),
        ((at("encoding") > 0) & (at("standalone") > 0) & (at("encoding") > at("standalone")), "wrong_order"),
        (~of("version").rlike(r"\A1\.[0-9]+\z"), "invalid_version"),
        (~of("encoding").rlike(r"\A[A-Za-z][A-Za-z0-9._-]*\z"), "invalid_encoding"),
        (~of("standalone").isin("yes", "no"), "invalid_standalone"),
    ]
    found = F.filter(F.array(*[F.when(t, F.lit(k)) for t, k in rules]), lambda x: x.isNotNull())
    return _each("xml_declaration", F.transform(found, lambda k: F.struct(k.alias("type"), F.lit(None).cast("string").alias("detail"))), is_("prolog"))


@rule()
def character_references() -> Column:
    """References that are empty, malformed, or name a character that may not occur."""
    none = F.array().cast("array<string>")
    refs = lambda t: F.regexp_extract_all(t, F.lit("&#([^;&<\\s]*;?)"), F.lit(1))
    all_ = F.concat(F.coalesce(F.when(is_("characters"), refs(F.col("content"))), none), F.coalesce(F.flatten(F.transform("attrs", lambda a: refs(a["value"]))), none))

    def wrong(r: Column) -> Column:
        body = F.regexp_replace(r, ";$", "")
        hex_, dec = body.rlike(r"\Ax[0-9a-fA-F]+\z"), body.rlike(r"\A[0-9]+\z")
        digits = F.regexp_replace(F.regexp_replace(body, "^x", ""), "^0+(?=.)", "")
        code = F.when(F.length(digits) > 8, F.lit(1 << 40)).otherwise(F.when(hex_, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        bad = (code < 9) | code.isin(11, 12) | code.between(14, 31) | code.between(0xD800, 0xDFFF) | code.isin(0xFFFE, 0xFFFF) | (code > 0x10FFFF)
        kind = F.when(body.isin("", "x"), "empty_char_ref").when(~hex_ & ~dec, "malformed_char_ref").when(~r.endswith(";"), "unterminated_char_ref").when(code == 0, "null_char_ref").when(bad, "invalid_char_ref")
        return F.struct(kind.alias("type"), body.alias("detail"))

    return _each("character_references", F.filter(F.transform(all_, wrong), lambda x: x["type"].isNotNull()))


@rule()
def namespace_rules() -> Column:
    """The rules of Namespaces in XML: names, prefixes, reserved bindings, attributes equal when expanded."""
    one = lambda k, d: F.struct(F.lit(k).alias("type"), d.cast("string").alias("detail"))
    none = F.array().cast("array<struct<type:string,detail:string>>")
    qname = rf"\A(?:{NCNAME_JAVA}:)?{NCNAME_JAVA}\z"
    start = is_("start_element")
    some = lambda test, x: F.when(test, F.array(x)).otherwise(none)
    name, prefix = F.col("name"), F.col("prefix")
    decl = F.filter("attrs", lambda a: (a["name"] == "xmlns") | (a["prefix"] == "xmlns"))
    plain = F.filter("attrs", lambda a: (a["name"] != "xmlns") & (a["prefix"] != "xmlns"))

    def binding(a: Column) -> Column:
        v, p = a["value"], F.when(a["prefix"] == "xmlns", a["local"]).otherwise("")
        return (
            F.when(p == "xmlns", one("reserved_prefix", p))
            .when((p == "xml") & (v != XML), one("reserved_prefix", p))
            .when((p == "") & (v == XML), one("xml_namespace_as_default", v))
            .when((p == "") & (v == XMLNS), one("xmlns_namespace_as_default", v))
            .when((p != "xml") & v.isin(XML, XMLNS), one("reserved_namespace", p))
            .when((p != "") & (v == ""), one("empty_prefix_binding", p))
        )

    full = F.transform(F.filter(plain, lambda a: a["ns_uri"].isNotNull()), lambda a: F.concat(F.lit("{"), a["ns_uri"], F.lit("}"), a["local"]))
    loose = lambda p, u: (p != "") & ~p.isin("xml", "xmlns") & u.isNull()
    found = F.concat(
        some(start & ~name.rlike(qname), one("invalid_qname", name)),
        some(start & (prefix == "xmlns"), one("xmlns_element", name)),
        some(start & loose(prefix, F.col("ns_uri")), one("undeclared_prefix", prefix)),
        F.coalesce(F.transform(F.filter("attrs", lambda a: ~a["name"].rlike(qname)), lambda a: one("invalid_qname", a["name"])), none),
        F.coalesce(F.transform(F.filter(plain, lambda a: loose(a["prefix"], a["ns_uri"])), lambda a: one("undeclared_prefix", a["prefix"])), none),
        F.coalesce(F.filter(F.transform(decl, binding), lambda x: x.isNotNull()), none),
        some(start & (F.size(full) > F.size(F.array_distinct(full))), one("duplicate_attribute", name)),
        some(is_("processing_instruction") & name.contains(":"), one("colon_in_pi_target", name)),
    )
    return _each("namespace_rules", found, is_("start_element", "processing_instruction"))


def all_of(events: DataFrame, *validators) -> DataFrame:
    """The errors of several validators; by default structure, attributes and namespaces. Those of this module
    share one pass."""
    validators = validators or (well_formed, attributes, namespaces)
    rules = [v for v in validators if hasattr(v, "findings")]
    out = _pass(events, rules) if rules else None
    for v in validators:
        if v not in rules:
            out = v(events) if out is None else out.unionByName(v(events))
    return out


def compliant(events: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """All that a conforming reader reports, the tokenizer's own errors among them, in one pass. References are
    held against what the document itself declares; with ``entities(doc_id, name, kind)``, against these."""
    rules = (xml_declaration, well_formed, root_boundary, attributes, comments, processing_instructions, namespaces, parser_errors)
    if entities is None:
        return all_of(events, *rules, own_entities)
    return all_of(events, *rules).unionByName(entity_references_declared(events, entities))


def apply(events: DataFrame, found: DataFrame, on_error: str = "emit") -> DataFrame:
    """``emit``: error rows join the events, right before what they speak of; ``skip``: what they speak of goes;
    ``raise``: the first one is raised."""
    if on_error == "raise":
        for r in found.limit(1).collect():
            raise Problem(r["type"], f"{r['doc_id']}: {r['detail']}")
        return events
    if on_error == "skip":
        # what comes out of Python has a guessed size, by which it must not be broadcast
        return events.join(found.select("doc_id", "seq").distinct().hint("merge"), ["doc_id", "seq"], "left_anti")
    if on_error != "emit":
        raise ValueError("on_error is emit, skip or raise")
    error = F.struct("source", "type", F.col("detail").alias("message")).alias("error")
    rows = found.select("doc_id", "seq", F.lit("error").alias("event_type"), error)
    return events.unionByName(rows, allowMissingColumns=True)
