"""What a parser is told: edition, mode, which events and positions it makes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

EVENT_TYPES = (
    "start_document", "end_document", "prolog", "start_element", "end_element", "characters",
    "space", "comment", "cdata", "dtd", "processing_instruction", "error",
)


@dataclass(frozen=True)
class ParserConfig:
    """``disable`` drops events inside the tokenizer and ``positions`` (full, line_only, none) empties
    columns there, as Catalyst can't push filters or pruning through it."""

    edition: int = 5
    mode: str = "xml"
    disable: frozenset[str] = frozenset()
    positions: str = "full"
    raw_text: tuple[str, ...] = ("script", "style")
    markers: bool = True
    scopes: bool = False  #: carry the namespaces in scope on start events

    def __post_init__(self):
        object.__setattr__(self, "edition", self.edition if self.edition in (4, 5) else 5)
        object.__setattr__(self, "disable", frozenset(self.disable))
        if unknown := self.disable - set(EVENT_TYPES):
            raise ValueError(f"no such events: {sorted(unknown)}")
        if self.mode not in ("xml", "html") or self.positions not in ("full", "line_only", "none"):
            raise ValueError("mode is xml or html, positions full, line_only or none")

    def without(self, *events: str) -> ParserConfig:
        return replace(self, disable=self.disable | set(events))


@dataclass(frozen=True)
class Problem(Exception):
    """A structured error: type, message, line, column and context."""

    type: str
    message: str
    line: int | None = None
    column: int | None = None
    context: dict = field(default_factory=dict)

    def __str__(self) -> str:
        at = f" at line {self.line}, column {self.column}" if self.line is not None else ""
        return f"[{self.type}]{at}: {self.message}"

    def snippet(self, source: str, around: int = 2) -> str:
        """The lines of ``source`` about the error, with a pointer under its column."""
        if self.line is None:
            return ""
        lines, out = source.split("\n"), []
        for n in range(max(1, self.line - around), min(len(lines), self.line + around) + 1):
            out.append(f"{'>' if n == self.line else ' '} {n:4d} | {lines[n - 1]}")
            if n == self.line:
                out.append(" " * (9 + (self.column or 0)) + "^")
        return "\n".join(out)
