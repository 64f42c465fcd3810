"""Trees of one document: elements, simple form, a fold with handlers, a cursor and a writer."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..config import ParserConfig
from .namespaces import split
from .tokenizer import Event, events

#: Node types of the document object model, fixed values.
ELEMENT, TEXT, CDATA, PI, COMMENT, DOCUMENT, FRAGMENT = 1, 3, 4, 7, 8, 9, 11


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


@dataclass
class Node:
    """A comment, CDATA section or processing instruction."""

    kind: str
    text: str
    target: str | None = None


@dataclass
class Element:
    tag: str
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list = field(default_factory=list)  #: Element, Node or text
    namespace_uri: str | None = None
    prefix: str | None = None

    @property
    def local(self) -> str:
        return split(self.tag)[1]

    def get_attribute(self, name: str, default: str | None = None) -> str | None:
        return next((v for n, v in self.attributes if n == name), default)

    def has_attribute(self, name: str) -> bool:
        return any(n == name for n, _ in self.attributes)

    def set_attribute(self, name: str, value: str) -> Element:
        new = [(n, value if n == name else v) for n, v in self.attributes] if self.has_attribute(name) else [*self.attributes, (name, value)]
        return Element(self.tag, new, self.children, self.namespace_uri, self.prefix)

    def remove_attribute(self, name: str) -> Element:
        at = next((k for k, (n, _) in enumerate(self.attributes) if n == name), None)
        new = self.attributes if at is None else self.attributes[:at] + self.attributes[at + 1 :]
        return Element(self.tag, list(new), self.children, self.namespace_uri, self.prefix)

    def append_child(self, child) -> Element:
        return Element(self.tag, self.attributes, [*self.children, child], self.namespace_uri, self.prefix)

    def prepend_child(self, child) -> Element:
        return Element(self.tag, self.attributes, [child, *self.children], self.namespace_uri, self.prefix)

    def walk(self) -> Iterator[Element]:
        """This element and all below it, in document order."""
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def get_elements_by_tag_name(self, local: str) -> list[Element]:
        return [e for e in self.walk() if e is not self and e.local == local]

    def text_content(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x, Element):
                todo += reversed(x.children)
            elif x.kind == "cdata":
                out.append(x.text)
        return "".join(out)

    def qualified_name(self) -> str:
        return self.tag


@dataclass
class Document:
    root: Element | None
    prolog: dict[str, str] = field(default_factory=dict)
    doctype: str | None = None

    version = property(lambda self: self.prolog.get("version", "1.0"))
    encoding = property(lambda self: self.prolog.get("encoding"))
    standalone = property(lambda self: self.prolog.get("standalone"))
    document_element = property(lambda self: self.root)

    def get_elements_by_tag_name(self, local: str) -> list[Element]:
        return [e for e in self.root.walk() if e.local == local] if self.root else []

    def get_element_by_id(self, value: str) -> Element | None:
        return next((e for e in self.root.walk() if e.get_attribute("id") == value), None) if self.root else None


def build(xml: bytes | str | list[Event], include_comments: bool = False, include_prolog: bool = True) -> Document:
    """The tree of a document. White space between elements, errors and instructions outside the root go."""
    stream = xml if isinstance(xml, list) else events(xml.encode() if isinstance(xml, str) else xml, ParserConfig(markers=False))
    doc, stack = Document(None), []
    for e in stream:
        if e.kind == "start_element":
            prefix, _ = split(e.name)
            el = Element(e.name, list(e.attrs), [], e.ns.resolve(prefix) if e.ns is not None else None, prefix or None)
            if stack:
                stack[-1].children.append(el)
            elif doc.root is None:
                doc.root = el
            stack.append(el)
        elif e.kind == "end_element" and stack:
            stack.pop()
        elif e.kind == "prolog" and include_prolog:
            doc.prolog = dict(e.attrs)
        elif e.kind == "dtd":
            doc.doctype = e.content
        elif stack:
            if e.kind == "characters":
                stack[-1].children.append(e.content)
            elif e.kind == "cdata" or e.kind == "comment" and include_comments:
                stack[-1].children.append(Node(e.kind, e.content))
            elif e.kind == "processing_instruction":
                stack[-1].children.append(Node(e.kind, (e.content or "").lstrip(), e.name))
    return doc


def to_events(root: Element) -> list[Event]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Event):
            out.append(x)
        elif isinstance(x, str):
            out.append(Event("characters", content=x))
        elif isinstance(x, Node):
            out.append(Event(x.kind, x.target, content=x.text))
        else:
            out.append(Event("start_element", x.tag, list(x.attributes)))
            todo.append(Event("end_element", x.tag))
            todo += reversed(x.children)
    return out


def write(stream: list[Event]) -> str:
    """Events as text; an element without content closes itself."""
    out: list[str] = []
    for k, e in enumerate(stream):
        if e.kind == "start_element":
            closed = k + 1 < len(stream) and stream[k + 1].kind == "end_element"
            attrs = "".join(f' {n}="{escape(v).replace(chr(34), "&quot;")}"' for n, v in e.attrs)
            out.append(f"<{e.name}{attrs}{'/' * closed}>")
        elif e.kind == "end_element":
            if not (k and stream[k - 1].kind == "start_element"):
                out.append(f"</{e.name}>")
        elif e.kind in ("characters", "space"):
            out.append(escape(e.content))
        elif e.kind == "cdata":
            out.append("<![CDATA[" + e.content.replace("]]>", "]]]]><![CDATA[>") + "]]>")
        elif e.kind == "comment":
            out.append(f"<!--{e.content}-->")
        elif e.kind == "processing_instruction":
            data = (e.content or "").lstrip()
            out.append(f"<?{e.name}{' ' * bool(data)}{data}?>")
        elif e.kind == "prolog":
            out.append("<?xml" + "".join(f' {n}="{v}"' for n, v in e.attrs) + "?>")
        elif e.kind == "dtd":
            out.append(f"<!{e.content}>")
        elif e.kind == "entity_ref":
            out.append(f"&{e.name};")
    return "".join(out)


# simple form: [tag, [[name, value], …], [child, …]], a child being a form, a text or {"comment": text}


def simple_form(xml: bytes | str, include_comments: bool = False):
    """The form of the root, or a list of forms if there are several roots."""
    roots: list = []
    stack: list[list] = []
    for e in events(xml.encode() if isinstance(xml, str) else xml, ParserConfig(markers=False)):
        if e.kind == "start_element":
            form = [e.name, [list(a) for a in e.attrs], []]
            (stack[-1][2] if stack else roots).append(form)
            stack.append(form)
        elif e.kind == "end_element" and stack:
            stack.pop()
        elif stack and e.kind in ("characters", "cdata"):
            stack[-1][2].append(e.content)
        elif stack and e.kind == "comment" and include_comments:
            stack[-1][2].append({"comment": e.content})
    return roots[0] if len(roots) == 1 else roots


def to_json(form) -> str:
    return json.dumps(form, ensure_ascii=False, separators=(",", ":"))


def from_json(text: str):
    return json.loads(text)


def to_dom(form) -> Element:
    tag, attrs, children = form
    return Element(tag, [tuple(a) for a in attrs], [Node("comment", c["comment"]) if isinstance(c, dict) else c if isinstance(c, str) else to_dom(c) for c in children])


def from_dom(e: Element):
    return [e.tag, [list(a) for a in e.attributes], [c if isinstance(c, str) else from_dom(c) if isinstance(c, Element) else {"comment": c.text} if c.kind == "comment" else c.text for c in e.children]]


def serialize(form) -> str:
    if form and isinstance(form[0], list):
        return "".join(map(serialize, form))
    return write(to_events(to_dom(form))) if form else ""


class Handler:
    """Callbacks of a fold over a document. Each takes and returns the state; raise ``Halt`` to stop."""

    def start_document(self, state):
        return state

    def end_document(self, state):
        return state

    def start_element(self, uri, local, qname, attrs, state):
        return state

    def end_element(self, uri, local, qname, state):
        return state

    def characters(self, text, state):
        return state

    def ignorable_whitespace(self, text, state):
        return state

    def comment(self, text, state):
        return state

    def processing_instruction(self, target, data, state):
        return state

    def error(self, kind, message, state):
        raise ValueError(f"{kind}: {message}")


class Halt(Exception):
    def __init__(self, state):
        self.state = state


def one(e: dict, handler: Handler, state):
    """The callback for one row of the event relation; CDATA counts as characters."""
    kind = e["event_type"]
    if kind in ("start_document", "end_document"):
        return getattr(handler, kind)(state)
    if kind == "start_element":
        return handler.start_element(e["ns_uri"], e["local"], e["name"], e["attrs"], state)
    if kind == "end_element":
        return handler.end_element(e["ns_uri"], e["local"], e["name"], state)
    if kind in ("characters", "cdata"):
        return handler.characters(e["content"], state)
    if kind == "space":
        return handler.ignorable_whitespace(e["content"], state)
    if kind == "comment":
        return handler.comment(e["content"], state)
    if kind == "processing_instruction":
        return handler.processing_instruction(e["name"], e["content"], state)
    return handler.error(e["error"]["type"], e["error"]["message"], state) if kind == "error" else state


def dispatch(rows, handler: Handler, state):
    """Fold rows in order; a handler stops it by raising ``Halt``."""
    try:
        for e in rows:
            state = one(e, handler, state)
    except Halt as h:
        return h.state
    return state


class Reader:
    """A pull cursor over rows of the event relation, such as ``toLocalIterator`` gives."""

    def __init__(self, rows):
        self._rows, self._ahead, self.current, self.prolog = iter(rows), [], None, {}

    def _fill(self) -> bool:
        if not self._ahead:
            try:
                r = next(self._rows)
                self._ahead.append(r.asDict(True) if hasattr(r, "asDict") else r)
            except StopIteration:
                return False
        return True

    def has_next(self) -> bool:
        return self._fill()

    def next(self) -> dict | None:
        self.current = self._ahead.pop() if self._fill() else None
        if self.current and self.current["event_type"] == "prolog":
            self.prolog = {a["name"]: a["value"] for a in self.current["attrs"]}
        return self.current

    def peek(self) -> dict | None:
        return self._ahead[0] if self._fill() else None

    def next_tag(self) -> dict | None:
        """The next start or end; text other than white space before it is an error."""
        while e := self.next():
            if e["event_type"] in ("start_element", "end_element"):
                return e
            if e["event_type"] in ("characters", "cdata") and e["content"].strip():
                raise ValueError("text before the next tag")
        return None

    def element_text(self) -> str:
        """All text up to the end of the current element."""
        out, depth = [], 1
        while depth and (e := self.next()):
            depth += (e["event_type"] == "start_element") - (e["event_type"] == "end_element")
            if e["event_type"] in ("characters", "cdata", "space"):
                out.append(e["content"])
        return "".join(out)

    def event_type(self) -> str | None:
        kind = self.current and self.current["event_type"]
        return "start_document" if kind == "prolog" else kind

    def attribute_count(self) -> int:
        return len(self.current["attrs"] or ())

    def attribute_name(self, i: int) -> str:
        return self.current["attrs"][i]["name"]

    def attribute_value(self, i, local: str | None = None) -> str | None:
        """By index, or by namespace and local name; a namespace of None fits any."""
        if isinstance(i, int):
            return self.current["attrs"][i]["value"]
        return next((a["value"] for a in self.current["attrs"] or () if a["local"] == local and i in (None, a["ns_uri"])), None)

    def location(self) -> tuple[int, int]:
        c = self.current
        return (c["line"] or 0, (c["pos"] or 0) - (c["line_start"] or 0))

    def is_whitespace(self) -> bool:
        return self.event_type() == "space" or self.event_type() == "characters" and not self.current["content"].strip()

    version = property(lambda self: self.prolog.get("version"))
    encoding = property(lambda self: self.prolog.get("encoding"))
    is_standalone = property(lambda self: self.prolog.get("standalone") == "yes")


class Writer:
    """Builds events call by call; attributes and declarations go to the element just started."""

    def __init__(self):
        self.stream: list[Event] = []
        self._open: list[str] = []

    def _add(self, *args, **kw) -> Writer:
        self.stream.append(Event(*args, **kw))
        return self

    def start_document(self, version: str = "1.0", **more: str) -> Writer:
        return self._add("prolog", "xml", [("version", version), *more.items()])

    def end_document(self) -> Writer:
        while self._open:
            self.end_element()
        return self

    def start_element(self, name: str, prefix: str | None = None, uri: str | None = None) -> Writer:
        full = f"{prefix}:{name}" if prefix else name
        self._open.append(full)
        self._add("start_element", full, [])
        if uri is not None:
            self.namespace(prefix, uri) if prefix else self.default_namespace(uri)
        return self

    def end_element(self) -> Writer:
        return self._add("end_element", self._open.pop())

    def empty_element(self, name: str) -> Writer:
        return self.start_element(name).end_element()

    def attribute(self, name: str, value: str, prefix: str | None = None) -> Writer:
        if not self.stream or self.stream[-1].kind != "start_element":
            raise ValueError("an attribute comes right after the start of its element")
        self.stream[-1].attrs.append((f"{prefix}:{name}" if prefix else name, value))
        return self

    def namespace(self, prefix: str, uri: str) -> Writer:
        return self.attribute(prefix, uri, "xmlns")

    def default_namespace(self, uri: str) -> Writer:
        return self.attribute("xmlns", uri)

    def characters(self, text: str) -> Writer:
        return self._add("characters", content=text)

    def cdata(self, text: str) -> Writer:
        return self._add("cdata", content=text)

    def comment(self, text: str) -> Writer:
        return self._add("comment", content=text)

    def processing_instruction(self, target: str, data: str = "") -> Writer:
        return self._add("processing_instruction", target, content=data)

    def dtd(self, content: str) -> Writer:
        return self._add("dtd", content=content)

    def entity_ref(self, name: str) -> Writer:
        return self._add("entity_ref", name)

    def to_text(self) -> str:
        return write(self.stream)
