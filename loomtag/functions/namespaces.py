"""Namespace scopes: prefix bindings, their algebra and the rules for declarations."""

from __future__ import annotations

XML = "http://www.w3.org/XML/1998/namespace"
XMLNS = "http://www.w3.org/2000/xmlns/"


def split(name: str) -> tuple[str, str]:
    """(prefix, local); the prefix is empty if there is none."""
    prefix, colon, local = name.partition(":")
    return (prefix, local) if colon else ("", name)


class Scope:
    """The bindings in force; ``""`` is the default. A scope is never changed, only pushed from."""

    __slots__ = ("bindings", "version")

    def __init__(self, bindings: dict[str, str | None] | None = None, version: str = "1.0"):
        self.bindings, self.version = bindings if bindings is not None else {}, version

    def push(self, attrs: list[tuple[str, str]]) -> tuple[Scope, list[tuple[str, str]]]:
        """The scope inside an element with ``attrs``, and the errors (reason, name) of its declarations."""
        found = [(n, v) for n, v in attrs if n == "xmlns" or n.startswith("xmlns:")]
        if not found:
            return self, []
        own, errors = dict(self.bindings), []
        for name, uri in found:
            prefix = name[6:]
            if prefix == "xmlns":
                errors.append(("reserved_prefix", "xmlns"))
            elif prefix == "xml":
                if uri != XML:
                    errors.append(("reserved_prefix", "xml"))
            elif uri == XML:
                errors.append(("xml_namespace_as_default" if not prefix else "reserved_namespace", name))
            elif uri == XMLNS:
                errors.append(("xmlns_namespace_as_default" if not prefix else "reserved_namespace", name))
            elif prefix and not uri and self.version == "1.0":
                errors.append(("empty_prefix_binding", prefix))
            else:
                own[prefix] = uri or None
        return Scope(own, self.version), errors

    def resolve(self, prefix: str) -> str | None:
        if prefix == "xml":
            return XML
        if prefix == "xmlns":
            return XMLNS
        return self.bindings.get(prefix)

    def in_scope(self, prefix: str) -> bool:
        return self.resolve(prefix) is not None

    def default_namespace(self) -> str | None:
        return self.bindings.get("")

    def expand_element(self, name: str) -> tuple[str | None, str] | None:
        """(uri, local), or None for a prefix that isn't bound."""
        prefix, local = split(name)
        uri = self.resolve(prefix)
        return None if prefix and uri is None else (uri, local)

    def expand_attribute(self, name: str) -> tuple[str | None, str] | None:
        """As for elements, but without a prefix there is no namespace; declarations keep their full name."""
        if name == "xmlns" or name.startswith("xmlns:"):
            return XMLNS, name
        prefix, local = split(name)
        if not prefix:
            return None, local
        uri = self.resolve(prefix)
        return None if uri is None else (uri, local)

    def all_prefixes(self) -> dict[str, str]:
        return {p: u for p, u in self.bindings.items() if p and u}

    def visible(self) -> dict[str, str]:
        return {p: u for p, u in self.bindings.items() if u}
