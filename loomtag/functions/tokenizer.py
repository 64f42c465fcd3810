"""One document's bytes to its events, driven by compiled patterns.

All offsets are bytes. Errors are events; most end the document, while
``attr_lt``, ``attr_unique``, ``comment`` and ``text_cdata_end`` let it go on.
Attributes stay in source order; a start event points behind its ``<``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..config import ParserConfig
from .chars import INVALID, is_name
from .namespaces import Scope, split

_WS = rb"[ \t\r\n]"
_NAME = rb"[:A-Z_a-z\x80-\xff][:A-Z_a-z\x80-\xff\-.0-9]*"
_OPEN = re.compile(rb"<(" + _NAME + rb")")
_HTML_OPEN = re.compile(rb"<([A-Za-z][^\s/>\x00]*)")
_CLOSE = re.compile(rb"</(" + _NAME + rb")" + _WS + rb"*(>?)")
_PI = re.compile(rb"<\?(" + _NAME + rb")")
_SPACE = re.compile(_WS + rb"+")
_ATTR = re.compile(_WS + rb"+(" + _NAME + rb")" + _WS + rb"*=" + _WS + rb"*(?:\"([^\"]*)\"|'([^']*)')")
_TAG_END = re.compile(_WS + rb"*(/?>)")
_ATTR_NAME = re.compile(_NAME)
_HTML_ATTR = re.compile(rb"[^\s\"'<>/=\x00]+")
_EQ = re.compile(_WS + rb"*=" + _WS + rb"*")
_UNQUOTED = re.compile(rb"[^\t\n\f\r >]+")
_BAD_UNQUOTED = re.compile(rb"[\"'<=`]")
_DOCTYPE_STOP = re.compile(rb"[<>\"'\[\]]|<!--")
_HTML_DOCTYPE = re.compile(rb"DOCTYPE\s*[^\s>\"']*(?:\s+(?:PUBLIC|SYSTEM)\s*)?", re.I)


class Event:
    """A row of the event relation, before it becomes columns."""

    __slots__ = ("attrs", "content", "depth", "elem", "error", "kind", "name", "ns", "parent", "path", "pos", "scope")

    def __init__(self, kind, name=None, attrs=None, content=None, pos=None, error=None):
        self.kind, self.name, self.attrs, self.content, self.pos, self.error = kind, name, attrs, content, pos, error
        self.depth = self.elem = self.parent = self.path = self.ns = self.scope = None


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


class _Stop(Exception):
    def __init__(self, kind: str, message: str, pos: int):
        self.kind, self.message, self.pos = kind, message, pos


def _error(kind: str, message: str, pos: int, source: str = "parser") -> Event:
    return Event("error", pos=pos, error=(source, kind, message))


def _attributes(b: bytes, i: int, html: bool) -> tuple[list[tuple[str, str]], list[Event], int, bool]:
    """From behind a tag's name: attributes, recoverable errors, the end, whether it closes itself."""
    attrs: list[tuple[str, str]] = []
    errors: list[Event] = []
    seen: set[str] = set()
    while True:
        if m := _TAG_END.match(b, i):
            return attrs, errors, m.end(), len(m[1]) == 2
        if m := _ATTR.match(b, i):
            name, value, at = _text(m[1]), m[2] if m[2] is not None else m[3], m.start(1)
            i = m.end()
        else:
            gap = _SPACE.match(b, i)
            at = gap.end() if gap else i
            if at >= len(b):
                raise _Stop("eof_in_tag", "the document ends inside a tag", len(b))
            if html and b[at : at + 1] == b"/":
                i = at + 1
                continue
            m = (_HTML_ATTR if html else _ATTR_NAME).match(b, at)
            if not m:
                raise _Stop("expected_gt_or_attr", "expected '>', '/>' or an attribute", at)
            if not gap and attrs and not html:
                raise _Stop("missing_whitespace_before_attr", "white space is missing before an attribute", at)
            if not gap and not html:
                raise _Stop("expected_gt_or_attr", "expected '>', '/>' or an attribute", at)
            name, i = _text(m[0]), m.end()
            eq = _EQ.match(b, i)
            if not eq:
                if not html:
                    after = _SPACE.match(b, i)
                    if (after.end() if after else i) >= len(b):
                        raise _Stop("eof_in_tag", "the document ends inside a tag", len(b))
                    raise _Stop("expected_eq", f"expected '=' after {name}", i)
                value = b""
            else:
                i = eq.end()
                quote = b[i : i + 1]
                if quote in (b'"', b"'") and quote:
                    end = b.find(quote, i + 1)
                    if end < 0:
                        raise _Stop("eof_in_tag", "the document ends inside an attribute", len(b))
                    value, i = b[i + 1 : end], end + 1
                elif html and (u := _UNQUOTED.match(b, i)):
                    value, i = u[0], u.end()
                    if bad := _BAD_UNQUOTED.search(value):
                        errors.append(_error("invalid_unquoted_attr_char", f"{_text(bad[0])!r} in an unquoted value", u.start() + bad.start()))
                elif i >= len(b):
                    raise _Stop("eof_in_tag", "the document ends inside a tag", len(b))
                else:
                    raise _Stop("expected_quote", f"expected a quoted value for {name}", i)
        if name in seen:
            errors.append(_error("duplicate_attribute" if html else "attr_unique", f"attribute {name} occurs twice", at))
        seen.add(name)
        if not html and b"<" in value:
            errors.append(_error("attr_lt", f"'<' in the value of {name}", at))
        attrs.append((name, _text(value)))


def _doctype(b: bytes, i: int) -> int:
    """The place of the '>' that ends a declaration at i, minding quotes, brackets and comments; -1: none."""
    depth, at = 0, i + 2
    while m := _DOCTYPE_STOP.search(b, at):
        c, at = m[0], m.end()
        if b.startswith(b"<!--", m.start()):
            end = b.find(b"-->", at + 3)
            if end < 0:
                return -1
            at = end + 3
        elif c in (b'"', b"'"):
            at = b.find(c, at) + 1
            if not at:
                return -1
        elif c in (b"<", b"["):
            depth += 1
        elif c == b"]":
            depth -= 1
        elif depth > 0:
            depth -= 1
        else:
            return m.start()
    return -1


def _html_doctype(b: bytes, i: int) -> tuple[int, Event | None]:
    """Where an HTML doctype ends, and what is wrong in it: a string that '>' cuts off, or stray characters."""
    m = _HTML_DOCTYPE.match(b, i + 2)
    at = m.end() if m else i + 2
    end = b.find(b">", at)
    end = len(b) if end < 0 else end
    while True:
        gap = _SPACE.match(b, at)
        at = gap.end() if gap else at
        if at >= end:
            return end, None
        q = b[at : at + 1]
        if q not in (b'"', b"'"):
            word = re.compile(rb"[A-Za-z]+").match(b, at, end)
            if word and gap:
                at = word.end()
                continue
            return end, _error("unexpected_char_in_doctype", "unexpected character in a doctype", at)
        close = b.find(q, at + 1, end)
        if close < 0:
            return end, _error("unterminated_doctype_string", "a string in a doctype does not end", at)
        at = close + 1


def raw_events(b: bytes, config: ParserConfig) -> Iterator[Event]:
    """Events without structure: no depth, owner or namespace."""
    html, i, n = config.mode == "html", 0, len(b)
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        yield _error("utf16", "UTF-16 input; convert it first", 0)
        return
    try:
        text = b.decode("utf-8")
    except UnicodeDecodeError as e:
        text = None
        yield from _until(b[: e.start], config, html)
        yield _error("invalid_utf8", "these bytes are not UTF-8", e.start)
        return
    if not html and (bad := INVALID.search(text)):
        at = len(text[: bad.start()].encode())
        yield from _until(b[:at], config, html)
        yield _error("invalid_char", f"character U+{ord(bad[0]):04X} is not allowed", at)
        return
    try:
        while i < n:
            if b[i] != 60:
                j = b.find(b"<", i)
                j = n if j < 0 else j
                run = b[i:j]
                m = _SPACE.match(run)
                yield Event("space" if m and m.end() == len(run) else "characters", content=_text(run), pos=i)
                if not html and (k := run.find(b"]]>")) >= 0:
                    yield _error("text_cdata_end", "']]>' in text", i + k)
                i = j
                continue
            c = b[i + 1 : i + 2]
            if c == b"/":
                m = _CLOSE.match(b, i)
                if not m:
                    raise _Stop("invalid_end_tag" if i + 2 < n else "eof_in_tag", "not a valid end tag", i + 2)
                if not m[2]:
                    raise _Stop("expected_gt" if m.end() < n else "eof_in_tag", "expected '>'", m.end())
                yield Event("end_element", _text(m[1]), pos=i + 2)
                i = m.end()
            elif m := (_HTML_OPEN if html else _OPEN).match(b, i):
                name = _text(m[1])
                if not html and not m[1].isascii() and not is_name(name, config.edition):
                    raise _Stop("invalid_element", f"{name!r} is not a name", i + 1)
                attrs, errors, j, closed = _attributes(b, m.end(), html)
                yield from errors
                yield Event("start_element", name, attrs, pos=i + 1)
                if closed:
                    yield Event("end_element", name, pos=i + 1)
                elif html and name.lower() in config.raw_text:
                    end = re.compile(rb"</" + re.escape(m[1]) + rb"\s*>", re.I).search(b, j)
                    body = b[j : end.start() if end else n]
                    if body:
                        yield Event("characters", content=_text(body), pos=j)
                    if not end:
                        yield _error("eof_in_raw_text", f"the document ends inside {name}", n)
                        yield Event("end_element", name, pos=n)
                        return
                    yield Event("end_element", name, pos=end.start() + 2)
                    j = end.end()
                i = j
            elif b.startswith(b"<!--", i):
                j = b.find(b"-->", i + 4)
                body = b[i + 4 : j if j >= 0 else n]
                yield Event("comment", content=_text(body), pos=i + 4)
                if not html and (b"--" in body or body.endswith(b"-")):
                    yield _error("comment", "'--' in a comment", i + 4 + max(0, body.find(b"--")))
                if j < 0:
                    yield _error("eof_in_comment", "the document ends inside a comment", n)
                    return
                i = j + 3
            elif b.startswith(b"<![CDATA[", i):
                j = b.find(b"]]>", i + 9)
                yield Event("cdata", content=_text(b[i + 9 : j if j >= 0 else n]), pos=i + 9)
                if j < 0:
                    yield _error("eof_in_cdata", "the document ends inside a CDATA section", n)
                    return
                i = j + 3
            elif b[i : i + 9] == b"<!DOCTYPE" or html and b[i : i + 9].upper() == b"<!DOCTYPE":
                j, wrong = _html_doctype(b, i) if html else (_doctype(b, i), None)
                if j < 0:
                    raise _Stop("eof_in_doctype", "the document ends inside its doctype", n)
                yield Event("dtd", content=_text(b[i + 2 : j]), pos=i + 1)
                if wrong:
                    yield wrong
                i = j + 1
            elif c == b"?":
                i = yield from _instruction(b, i, n)
            else:
                raise _Stop("invalid_element" if i + 1 < n else "eof_in_tag", "'<' does not open markup", i + 1)
    except _Stop as e:
        yield _error(e.kind, e.message, e.pos)


def _until(b: bytes, config: ParserConfig, html: bool) -> Iterator[Event]:
    """The events before a character that ends the document, without what the cut itself causes."""
    for e in raw_events(b, config):
        if e.kind == "error" and e.error[1].startswith("eof_in"):
            return
        yield e


def _instruction(b: bytes, i: int, n: int) -> Iterator[Event]:
    m = _PI.match(b, i)
    if not m:
        raise _Stop("invalid_pi_target", "a processing instruction needs a target", i + 2)
    if m[1].lower() == b"xml":
        if m[1] != b"xml":
            raise _Stop("reserved_pi_target", "the target xml is reserved", i + 2)
        if i != 0:
            raise _Stop("misplaced_xml_decl", "an XML declaration stands at the start only", i)
        if not _SPACE.match(b, m.end()):
            raise _Stop("malformed_xml_decl", "white space is missing in the XML declaration", m.end())
        at, attrs = m.end(), []
        while a := _ATTR.match(b, at):
            attrs.append((_text(a[1]), _text(a[2] if a[2] is not None else a[3])))
            at = a.end()
        end = re.compile(_WS + rb"*\?>").match(b, at)
        if not end:
            raise _Stop("expected_pi_end_or_attr", "expected '?>' or an attribute", at)
        yield Event("prolog", "xml", attrs, pos=i + 1)
        return end.end()
    j = b.find(b"?>", m.end())
    yield Event("processing_instruction", _text(m[1]), content=_text(b[m.end() : j if j >= 0 else n]), pos=i + 2)
    if j < 0:
        raise _Stop("eof_in_pi", "the document ends inside a processing instruction", n)
    return j + 2


def events(b: bytes, config: ParserConfig) -> list[Event]:
    """All events of a document in order, with owner, depth, path and namespaces."""
    out: list[Event] = []
    html = config.mode == "html"
    stack: list[tuple[str, int, Scope]] = []  # name, elem id, scope
    path: tuple[str, ...] = ()
    scope, seq = Scope(), 0
    if config.markers:
        out.append(Event("start_document"))
        seq = 1
    for e in raw_events(b, config):
        e.elem = e.parent = stack[-1][1] if stack else None
        if e.kind == "prolog":
            scope = Scope(scope.bindings, dict(e.attrs).get("version", "1.0"))
        elif e.kind == "start_element":
            inner, _ = (stack[-1][2] if stack else scope).push(e.attrs)
            e.elem = seq
            stack.append((e.name, seq, inner))
            path = (*path, e.name)
            e.ns = inner
        elif e.kind == "end_element":
            k = len(stack) - 1
            while html and k >= 0 and stack[k][0] != e.name:
                k -= 1
            if k >= 0 and stack[k][0] == e.name:
                e.elem, e.parent = stack[k][1], stack[k - 1][1] if k else None
                e.ns, e.depth, e.path = stack[k][2], k + 1, path[: k + 1]
                del stack[k:]
                path = path[:k]
            else:  # what it closes isn't open, or not innermost: the element stays open
                e.elem, e.ns = None, stack[-1][2] if stack else scope
        if e.depth is None:
            e.depth, e.path = len(stack), path
        out.append(e)
        seq += 1
    if config.markers:
        out.append(Event("end_document"))
    return out


def expanded(e: Event) -> tuple[str | None, str | None, str | None]:
    """(prefix, local, uri) of a start or end event."""
    if e.ns is None:
        return (*split(e.name), None) if e.kind != "processing_instruction" and e.name else (None, e.name, None)
    prefix, local = split(e.name)
    return prefix, local, e.ns.resolve(prefix)
