"""Canonical XML 1.0 and Exclusive Canonicalization of one document, or of an element in it."""

from __future__ import annotations

import re

from ..config import ParserConfig
from .namespaces import XML, split
from .tokenizer import Event, events

#: The algorithms' names and identifiers.
URIS = {
    "c14n": "http://www.w3.org/TR/2001/REC-xml-c14n-20010315",
    "c14n_with_comments": "http://www.w3.org/TR/2001/REC-xml-c14n-20010315#WithComments",
    "exc_c14n": "http://www.w3.org/2001/10/xml-exc-c14n#",
    "exc_c14n_with_comments": "http://www.w3.org/2001/10/xml-exc-c14n#WithComments",
}
_REF = re.compile(r"&(#x[0-9a-fA-F]+|#[0-9]+|amp|lt|gt|quot|apos);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def algorithm(uri: str) -> str | None:
    return next((k for k, v in URIS.items() if v == uri), None)


def plain(text: str) -> str:
    """References to characters and predefined entities replaced."""
    return _REF.sub(lambda m: _NAMED.get(m[1]) or chr(int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:])), text)


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")


def escape_attr(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")


def _start(e: Event, done: dict[str, str], exclusive: bool, inclusive: set[str]) -> tuple[str, dict[str, str]]:
    """A start tag, and the declarations then in force in the output."""
    scope = e.ns.visible()
    attrs = [(n, plain(v)) for n, v in e.attrs if n != "xmlns" and not n.startswith("xmlns:")]
    used = {split(e.name)[0], *(split(n)[0] for n, _ in attrs if ":" in n)}
    wanted = {p for p in scope if not exclusive or p in used or p in inclusive} - {"xml"}
    out = dict(done)
    decls = []
    if "" not in scope and done.get("") and (not exclusive or "" in used):
        decls.append(("", ""))
        out.pop("")
    for p in wanted:
        if done.get(p) != scope[p]:
            decls.append((p, scope[p]))
            out[p] = scope[p]

    def key(item: tuple[str, str]) -> tuple[str, str]:
        prefix, local = split(item[0])
        return ((XML if prefix == "xml" else scope.get(prefix, "")) if prefix else "", local)

    text = "".join(f' xmlns{":" * bool(p)}{p}="{escape_attr(u)}"' for p, u in sorted(decls))
    text += "".join(f' {n}="{escape_attr(v)}"' for n, v in sorted(attrs, key=key))
    return f"<{e.name}{text}>", out


def canonical_events(stream: list[Event], how: str = "c14n", inclusive: tuple[str, ...] = ()) -> str:
    exclusive, comments = how.startswith("exc"), how.endswith("comments")
    out: list[str] = []
    done: list[dict[str, str]] = [{}]
    seen_root, wants = False, {"" if p == "#default" else p for p in inclusive}
    level = 0
    for e in stream:
        if e.kind == "start_element":
            text, now = _start(e, done[-1], exclusive, wants)
            out.append(text)
            done.append(now)
            level, seen_root = level + 1, True
        elif e.kind == "end_element":
            out.append(f"</{e.name}>")
            done.pop()
            level -= 1
        elif e.kind in ("characters", "space", "cdata"):
            if level:
                out.append(escape_text(e.content if e.kind == "cdata" else plain(e.content)))
        elif e.kind == "comment" and comments or e.kind == "processing_instruction":
            data = (e.content or "").lstrip()
            text = f"<!--{e.content}-->" if e.kind == "comment" else f"<?{e.name}{' ' * bool(data)}{data}?>"
            text = text.replace("\r", "&#xD;")
            out.append(text if level else f"\n{text}" if seen_root else f"{text}\n")
    return "".join(out)


def canonicalize(xml: bytes | str, how: str = "c14n", inclusive: tuple[str, ...] = ()) -> str:
    """``how`` is one of ``URIS``."""
    if how not in URIS:
        raise ValueError(f"no such algorithm: {how}")
    b = xml.encode() if isinstance(xml, str) else xml
    b = re.sub(rb"\r\n?", b"\n", b)
    stream = events(b, ParserConfig(markers=False))
    for e in stream:
        if e.kind == "error":
            raise ValueError(f"{e.error[1]}: {e.error[2]}")
    return canonical_events(stream, how, inclusive)


def subtree(stream: list[Event], first: int) -> list[Event]:
    """The events of the element that starts at place ``first``."""
    depth = 0
    for k in range(first, len(stream)):
        depth += (stream[k].kind == "start_element") - (stream[k].kind == "end_element")
        if depth == 0:
            return stream[first : k + 1]
    return stream[first:]
