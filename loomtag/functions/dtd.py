"""Document type declarations: a model of one document's, entity expansion within limits, and attribute types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..config import ParserConfig
from .chars import is_name
from .tokenizer import Event, _doctype, events

MAX_DEPTH, MAX_BYTES, MAX_ROUNDS = 10, 1_000_000, 100
PREDEFINED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Attribute types whose values are tokens: trimmed, and white space within made one space.
TOKENS = ("ID", "IDREF", "IDREFS", "ENTITY", "ENTITIES", "NMTOKEN", "NMTOKENS", "NOTATION", "enumeration")

_NAME = r"[^\s<>\[\]()|,?*+&;%\"'=/#]+"
_LITERAL = r"\"[^\"]*\"|'[^']*'"
_PUBLIC = re.compile(r"[ \r\na-zA-Z0-9\-'()+,./:=?;!*#@$_%]*\Z")
_EXTERNAL = re.compile(rf"(?:SYSTEM\s+(?P<sys>{_LITERAL})|PUBLIC\s+(?P<pub>{_LITERAL})(?:\s+(?P<psys>{_LITERAL}))?)")
_ENTITY = re.compile(rf"<!ENTITY\s+(?P<pe>%\s+)?(?P<name>{_NAME})\s+(?:(?P<value>{_LITERAL})|{_EXTERNAL.pattern}(?P<ndata>\s+NDATA\s+(?P<notation>{_NAME}))?)\s*>")
_ELEMENT = re.compile(rf"<!ELEMENT\s+(?P<name>{_NAME})\s+(?P<model>EMPTY|ANY|\([^<>]*)\s*>")
_ATTLIST = re.compile(rf"<!ATTLIST\s+(?P<name>{_NAME})(?P<rest>(?:[^<>\"']|{_LITERAL})*)>")
_NOTATION = re.compile(rf"<!NOTATION\s+(?P<name>{_NAME})\s+(?:SYSTEM\s+(?P<sys>{_LITERAL})|PUBLIC\s+(?P<pub>{_LITERAL})(?:\s+(?P<psys>{_LITERAL}))?)\s*>")
_ATTDEF = re.compile(rf"\s+(?P<name>{_NAME})\s+(?P<type>CDATA|IDREFS|IDREF|ID|ENTITY|ENTITIES|NMTOKENS|NMTOKEN|NOTATION\s+\([^)]*\)|\([^)]*\))\s+(?:(?P<how>\#REQUIRED|\#IMPLIED)|(?P<fixed>\#FIXED\s+)?(?P<value>{_LITERAL}))")
_HEAD = re.compile(rf"DOCTYPE\s+(?P<root>{_NAME})\s*(?:{_EXTERNAL.pattern})?\s*(?P<open>\[)?", re.S)
_CHAR = re.compile(r"&#(x[0-9a-fA-F]+|[0-9]+);")
_REF = re.compile(r"&(#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z_:][\w.:\-]*);")
_BARE = re.compile(r"&(?!#x[0-9a-fA-F]+;|#[0-9]+;|[A-Za-z_:][\w.:\-]*;)")
_PERCENT = re.compile(r"%(?![A-Za-z_:][\w.:\-]*;)")
_NMTOKEN = re.compile(r"[\w.:\-\u00b7]+\Z")
_TEXT_DECLARATION = re.compile(r"\A<\?xml\s[^?]*\?>")
_PE = re.compile(r"%([A-Za-z_:][\w.:\-]*);")


class DTDError(ValueError):
    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}")
        self.kind, self.message = kind, message


def _bare(literal: str | None) -> str | None:
    return None if literal is None else literal[1:-1]


def valid_public_id(text: str) -> bool:
    return _PUBLIC.match(text) is not None


def character(ref: str) -> str | None:
    """Of ``x41`` or ``65`` the character; None if no document may hold it."""
    code = int(ref[1:], 16) if ref[0] == "x" else int(ref)
    fine = code in (9, 10, 13) or 32 <= code <= 0xD7FF or 0xE000 <= code <= 0xFFFD or 0x10000 <= code <= 0x10FFFF
    return chr(code) if fine else None


def expand_char_refs(text: str) -> str:
    """References to characters that no document may hold stay."""
    return _CHAR.sub(lambda m: m[0] if (c := character(m[1])) is None else c, text)


@dataclass
class Entity:
    kind: str  #: internal, external or unparsed
    value: str | None = None
    system_id: str | None = None
    public_id: str | None = None
    notation: str | None = None


@dataclass
class Attribute:
    name: str
    type: str
    values: list[str]
    default_type: str  #: REQUIRED, IMPLIED, FIXED or DEFAULT
    default: str | None


# Content models are nested lists: ["EMPTY"], ["ANY"], ["name", n, q], ["seq", [..], q], ["choice", [..], q],
# ["mixed", names]; q is "", "?", "*" or "+".


def parse_content_model(text: str):
    text = text.strip()
    if text in ("EMPTY", "ANY"):
        return [text]
    if m := re.fullmatch(rf"\(\s*#PCDATA\s*((?:\|\s*{_NAME}\s*)*)\)(\*?)", text):
        names = [x.strip() for x in m[1].split("|") if x.strip()]
        if names and not m[2]:
            raise DTDError("invalid_content_model", "mixed content needs '*'")
        if len(set(names)) < len(names):
            raise DTDError("invalid_content_model", "a name occurs twice in mixed content")
        return ["mixed", names]
    tokens = re.findall(rf"{_NAME}|[()|,?*+]|\s+|.", text)
    place = 0

    def peek() -> str:
        nonlocal place
        while place < len(tokens) and tokens[place].isspace():
            place += 1
        return tokens[place] if place < len(tokens) else ""

    def mark() -> str:
        nonlocal place
        if place < len(tokens) and tokens[place] in "?*+":
            place += 1
            return tokens[place - 1]
        return ""

    def particle():
        nonlocal place
        t = peek()
        if t == "(":
            place += 1
            items, sep = [particle()], ""
            while (s := peek()) in ("|", ","):
                if sep and s != sep:
                    raise DTDError("invalid_content_model", "',' and '|' in one group")
                sep, place = s, place + 1
                items.append(particle())
            if peek() != ")":
                raise DTDError("invalid_content_model", "')' is missing")
            place += 1
            return ["choice" if sep == "|" else "seq", items, mark()]
        if not t or not is_name(t):
            raise DTDError("invalid_content_model", f"unexpected {t!r}")
        place += 1
        return ["name", t, mark()]

    model = particle()
    if peek():
        raise DTDError("invalid_content_model", f"unexpected {peek()!r}")
    if model[0] == "name":
        raise DTDError("invalid_content_model", "a model stands in parentheses")
    return model


def model_pattern(model) -> str:
    """A regular expression over child names, each followed by a space."""
    kind = model[0]
    if kind == "EMPTY":
        return ""
    if kind in ("ANY", "mixed"):
        return r"(?:\S+ )*" if kind == "ANY" else f"(?:(?:{'|'.join(map(re.escape, model[1]))}) )*" if model[1] else ""
    if kind == "name":
        return f"(?:{re.escape(model[1])} ){model[2]}"
    return "(?:" + ("|" if kind == "choice" else "").join(map(model_pattern, model[1])) + f"){model[2]}"


@dataclass
class Model:
    root: str | None = None
    system_id: str | None = None
    public_id: str | None = None
    elements: dict = field(default_factory=dict)
    attributes: dict[str, list[Attribute]] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    parameters: dict[str, Entity] = field(default_factory=dict)
    notations: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)

    def merge(self, outer: Model) -> Model:
        """What another, external, subset declares in addition; what is here counts first."""
        for mine, theirs in ((self.elements, outer.elements), (self.entities, outer.entities), (self.parameters, outer.parameters), (self.notations, outer.notations)):
            for k, v in theirs.items():
                mine.setdefault(k, v)
        for k, v in outer.attributes.items():
            own = self.attributes.setdefault(k, [])
            own += [a for a in v if all(a.name != b.name for b in own)]
        return self

    def expand(self, name: str) -> str:
        """An internal entity's text with all references in it expanded."""
        size = 0

        def go(n: str, open_: tuple[str, ...]) -> str:
            nonlocal size
            if n in open_:
                raise DTDError("circular_entity", " -> ".join((*open_, n)))
            if len(open_) >= MAX_DEPTH:
                raise DTDError("max_depth_exceeded", n)
            e = self.entities.get(n)
            if e is None:
                if n in PREDEFINED:
                    return f"&{n};"
                raise DTDError("undefined_entity", n)
            if e.kind != "internal":
                raise DTDError(f"{e.kind}_entity", n)

            def one(m: re.Match) -> str:
                return m[0] if m[1][0] == "#" else go(m[1], (*open_, n))

            out = _REF.sub(one, e.value)
            size += len(out.encode())
            if size > MAX_BYTES:
                raise DTDError("max_expansion_exceeded", n)
            return out

        return go(name, ())

    def circular(self) -> list[str]:
        """Internal entities that reach themselves."""
        refs = {n: {m for m in _REF.findall(e.value) if m in self.entities} for n, e in self.entities.items() if e.kind == "internal"}
        out = []
        for n in refs:
            seen, todo = set(), list(refs[n])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += refs.get(x, ())
            if n in seen:
                out.append(n)
        return out

    def undefined(self) -> list[str]:
        """Entities that values or attribute defaults refer to and nothing declares."""
        texts = [e.value for e in self.entities.values() if e.kind == "internal"] + [a.default for v in self.attributes.values() for a in v if a.default]
        return sorted({r for t in texts for r in _REF.findall(t) if r[0] != "#" and r not in self.entities and r not in PREDEFINED})

    def token_attributes(self) -> dict[str, set[str]]:
        return {el: {a.name for a in attrs if a.type in TOKENS} for el, attrs in self.attributes.items()}


def _references(value: str, name: str) -> None:
    """Each ampersand of a literal opens a reference, and each character reference names a character."""
    if _BARE.search(value):
        raise DTDError("bare_ampersand", name)
    if any(character(r) is None for r in _CHAR.findall(value)):
        raise DTDError("invalid_char_ref", name)


def parse_entity(text: str) -> tuple[bool, str, Entity]:
    m = _ENTITY.fullmatch(text)
    if not m:
        raise DTDError("invalid_entity", text[:60])
    if ":" in m["name"]:
        raise DTDError("colon_in_entity_name", m["name"])
    if not is_name(m["name"]):
        raise DTDError("invalid_name", m["name"])
    if m["value"] is not None:
        value = _bare(m["value"])
        _references(value, m["name"])
        if _PERCENT.search(value):
            raise DTDError("bare_percent", m["name"])
        return bool(m["pe"]), m["name"], Entity("internal", value)
    public = _bare(m["pub"])
    if public is not None and not valid_public_id(public):
        raise DTDError("invalid_public_id", public)
    if public is not None and m["psys"] is None:
        raise DTDError("missing_system_id", m["name"])
    if m["pe"] and m["ndata"]:
        raise DTDError("ndata_on_parameter_entity", m["name"])
    if m["ndata"] and not is_name(m["notation"]):
        raise DTDError("invalid_name", m["notation"])
    return bool(m["pe"]), m["name"], Entity("unparsed" if m["ndata"] else "external", None, _bare(m["sys"] or m["psys"]), public, m["notation"])


def parse_attlist(text: str) -> tuple[str, list[Attribute]]:
    m = _ATTLIST.fullmatch(text)
    if not m:
        raise DTDError("invalid_attlist", text[:60])
    if not is_name(m["name"]):
        raise DTDError("invalid_name", m["name"])
    out, at, rest = [], 0, m["rest"]
    while a := _ATTDEF.match(rest, at):
        kind, values = a["type"], []
        if not is_name(a["name"]):
            raise DTDError("invalid_name", a["name"])
        if "(" in kind:
            values = [v.strip() for v in kind[kind.index("(") + 1 : -1].split("|")]
            kind = "NOTATION" if kind.startswith("NOTATION") else "enumeration"
            if not all(is_name(v) if kind == "NOTATION" else _NMTOKEN.match(v) for v in values):
                raise DTDError("invalid_enumeration", a["name"])
        how = a["how"][1:] if a["how"] else "FIXED" if a["fixed"] else "DEFAULT"
        default = _bare(a["value"])
        if default is not None:
            if "<" in default:
                raise DTDError("lt_in_default", a["name"])
            _references(default, a["name"])
        if all(x.name != a["name"] for x in out):
            out.append(Attribute(a["name"], kind, values, how, default))
        at = a.end()
    if rest[at:].strip():
        raise DTDError("invalid_attlist", rest[at:].strip()[:60])
    return m["name"], out


def expand_parameters(text: str, parameters: dict[str, Entity], resolve=None) -> str:
    for _ in range(MAX_ROUNDS):
        done = True

        def one(m: re.Match) -> str:
            nonlocal done
            e = parameters.get(m[1])
            if e is None:
                raise DTDError("undefined_parameter_entity", m[1])
            value = e.value if e.kind == "internal" else resolve(e.system_id, e.public_id) if resolve else None
            if value is None:
                return ""
            done = False
            return f" {value} "

        new = _PE.sub(one, text)
        if done:
            return new
        if len(new) > MAX_BYTES:
            raise DTDError("max_expansion_exceeded", "parameter entities")
        text = new
    raise DTDError("circular_parameter_entity", "too many rounds")


def _outer(e: Entity, resolve) -> str:
    """The text of an outer parameter entity, without a text declaration; empty if it isn't to be had."""
    return _TEXT_DECLARATION.sub("", (resolve(e.system_id, e.public_id) if resolve else None) or "")


def conditional_sections(text: str) -> str:
    """INCLUDE sections opened and IGNORE sections removed, from the innermost."""
    pattern = re.compile(r"<!\[\s*(INCLUDE|IGNORE)\s*\[((?:(?!<!\[|\]\]>).)*)\]\]>", re.S)
    while True:
        new = pattern.sub(lambda m: m[2] if m[1] == "INCLUDE" else "", text)
        if new == text:
            if "<![" in text:
                raise DTDError("unterminated_conditional_section", text[text.index("<![") :][:40])
            return text
        text = new


def parse(text: str, model: Model | None = None, external: bool = False, resolve=None) -> Model:
    """The declarations of a subset, in order; of entities and attributes the first counts."""
    model, at = model or Model(), 0
    step = re.compile(r"\s+|<!--(?:(?!--).)*-->|<\?.*?\?>", re.S)
    if external:
        text = conditional_sections(_collected(text, model, resolve))
    while at < len(text):
        if m := step.match(text, at):
            if re.match(r"<\?xml[\s?]", m[0], re.I) and not (external and m.start() == 0):  # a text declaration may begin it
                raise DTDError("reserved_pi_target", m[0][:40])
            at = m.end()
        elif m := _PE.match(text, at):
            e = model.parameters.get(m[1])
            if e is None:
                raise DTDError("undefined_parameter_entity", m[1])
            value = e.value if e.kind == "internal" else _outer(e, resolve)
            text, at = f"{expand_char_refs(value or '')}{text[m.end() :]}", 0
            if len(text) > MAX_BYTES:
                raise DTDError("max_expansion_exceeded", m[1])
        elif text.startswith("<!", at):
            end = _doctype(text[at:].encode(), 0)
            if end < 0:
                raise DTDError("unterminated_declaration", text[at : at + 40])
            decl = text[at:].encode()[: end + 1].decode()
            at += len(decl)
            # where a value holds one it is a reference too; other literals hold per cent signs
            if not external and _PE.search(decl if decl.startswith("<!ENTITY") and not re.search(r"\s(?:SYSTEM|PUBLIC)\s", re.sub(_LITERAL, "", decl)) else re.sub(_LITERAL, "", decl)):
                raise DTDError("pe_in_internal_declaration", decl[:60])
            _declare(decl, model)
        else:
            raise DTDError("invalid_declaration", text[at : at + 40])
    return model


def _collected(text: str, model: Model, resolve) -> str:
    """An external subset with its parameter entities expanded, as they may stand anywhere there; what an expansion
    declares is known to the next round."""
    found = dict(model.parameters)
    for _ in range(MAX_ROUNDS):
        kept: list[str] = []
        changed = False

        def hold(m: re.Match) -> str:
            if not m["pe"]:
                return m[0]
            own = Entity("external", None, _bare(m["sys"] or m["psys"])) if m["value"] is None else Entity("internal", expand_char_refs(_bare(m["value"])))
            found.setdefault(m["name"], own)
            kept.append(m[0])  # noqa: B023
            return f"\0{len(kept) - 1}\0"  # noqa: B023

        def one(m: re.Match) -> str:
            nonlocal changed
            e = found.get(m[1])
            if e is None:
                return m[0]
            changed = True
            return f" {e.value if e.kind == 'internal' else _outer(e, resolve)} "

        held = _PE.sub(one, _ENTITY.sub(hold, text))
        if not changed and (m := _PE.search(held)):
            raise DTDError("undefined_parameter_entity", m[1])
        text = re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], held)  # noqa: B023
        if not changed:
            return text
        if len(text) > MAX_BYTES:
            raise DTDError("max_expansion_exceeded", "parameter entities")
    raise DTDError("circular_parameter_entity", "too many rounds")


def _declare(decl: str, model: Model) -> None:
    if decl.startswith("<!ENTITY"):
        parameter, name, entity = parse_entity(decl)
        if entity.kind == "internal" and parameter:
            entity.value = expand_char_refs(entity.value)
        (model.parameters if parameter else model.entities).setdefault(name, entity)
    elif decl.startswith("<!ELEMENT"):
        m = _ELEMENT.fullmatch(decl)
        if not m or not is_name(m["name"]):
            raise DTDError("invalid_element", decl[:60])
        model.elements.setdefault(m["name"], parse_content_model(m["model"]))
    elif decl.startswith("<!ATTLIST"):
        name, attrs = parse_attlist(decl)
        own = model.attributes.setdefault(name, [])
        own += [a for a in attrs if all(a.name != b.name for b in own)]
    elif decl.startswith("<!NOTATION"):
        m = _NOTATION.fullmatch(decl)
        if not m:
            raise DTDError("invalid_notation", decl[:60])
        if ":" in m["name"]:
            raise DTDError("colon_in_notation_name", m["name"])
        if not is_name(m["name"]):
            raise DTDError("invalid_name", m["name"])
        if m["pub"] and not valid_public_id(_bare(m["pub"])):
            raise DTDError("invalid_public_id", _bare(m["pub"]))
        model.notations.setdefault(m["name"], (_bare(m["sys"] or m["psys"]), _bare(m["pub"])))
    else:
        raise DTDError("invalid_declaration", decl[:60])


def parse_doctype(content: str, external=None) -> Model:
    """``content``: what stands between ``<!`` and ``>``. ``external(system_id, public_id)`` gives texts of
    outer subsets and entities, if they are to be read at all."""
    m = _HEAD.match(content)
    if not m:
        raise DTDError("invalid_doctype", content[:60])
    if not is_name(m["root"]):
        raise DTDError("invalid_name", m["root"])
    if m["pub"] and not valid_public_id(_bare(m["pub"])):
        raise DTDError("invalid_public_id", _bare(m["pub"]))
    if m["pub"] and m["psys"] is None:
        raise DTDError("missing_system_id", m["root"])
    end = content.rfind("]") if m["open"] else m.end() - 1
    if end < m.end() - 1 or content[end + 1 :].strip():
        raise DTDError("invalid_doctype", content[max(end, 0) :][:60])
    model = Model(m["root"], _bare(m["sys"] or m["psys"]), _bare(m["pub"]))
    if m["open"]:
        parse(content[m.end() : end], model, resolve=external)
    if external and model.system_id is not None and (text := external(model.system_id, model.public_id)):
        model.merge(parse(text, Model(parameters=dict(model.parameters)), external=True, resolve=external))
    return model


def model_of_document(b: bytes, external=None) -> Model | None:
    """The model of the document's first doctype; None without one or if it is not valid."""
    for e in events(b, ParserConfig(markers=False)):
        if e.kind == "dtd":
            try:
                return parse_doctype(e.content, external)
            except DTDError:
                return None
        if e.kind == "start_element":
            return None
    return None


def rows_of_document(b: bytes, edition: int = 5, external=None) -> list[dict]:
    for e in events(b, ParserConfig(markers=False, edition=edition)):
        if e.kind == "start_element":
            return []
        if e.kind == "dtd":
            try:
                return _rows(parse_doctype(e.content, external))
            except DTDError as x:
                return [_row("error", error=x.kind, value=x.message)]
    return []


def _row(kind: str, **values) -> dict:
    names = ("name", "element", "value", "type", "default_type", "default_value", "system_id", "public_id", "notation", "error")
    return {"kind": kind, **{n: values.get(n) for n in names}}


def model_text(model) -> str:
    if model[0] in ("EMPTY", "ANY"):
        return model[0]
    if model[0] == "mixed":
        return "(" + "|".join(["#PCDATA", *model[1]]) + ")" + "*" * bool(model[1])
    if model[0] == "name":
        return model[1] + model[2]
    return "(" + ("|" if model[0] == "choice" else ",").join(map(model_text, model[1])) + ")" + model[2]


def _rows(m: Model) -> list[dict]:
    out = [_row("doctype", name=m.root, system_id=m.system_id, public_id=m.public_id)]
    out += [_row("element", name=n, value=model_text(x)) for n, x in m.elements.items()]
    out += [_row("attribute", element=el, name=a.name, type=a.type, value="|".join(a.values) or None, default_type=a.default_type, default_value=a.default) for el, attrs in m.attributes.items() for a in attrs]
    out += [_row(x.kind, name=n, value=x.value, system_id=x.system_id, public_id=x.public_id, notation=x.notation) for n, x in m.entities.items()]
    out += [_row("parameter", name=n, value=x.value, system_id=x.system_id, public_id=x.public_id) for n, x in m.parameters.items()]
    out += [_row("notation", name=n, system_id=s, public_id=p) for n, (s, p) in m.notations.items()]
    return out


def resolve_document(b: bytes, on_unknown: str = "keep", external=None) -> str:
    """The document with declared entities replaced in text and attributes, the markup an entity holds
    becoming markup, and tokenised attributes normalised."""
    from .tree import write

    model = model_of_document(b, external) or Model()
    tokens, known = model.token_attributes(), {}

    def value(name: str) -> str | None:
        if name not in known:
            try:
                known[name] = model.expand(name) if name in model.entities else None
            except DTDError:
                known[name] = None
        return known[name]

    def text(t: str) -> tuple[str, bool]:
        """Resolved text; or, if an entity brings markup, text to be parsed."""
        markup = False

        def one(m: re.Match) -> str:
            nonlocal markup
            r = m[1]
            if r[0] == "#":
                return m[0] if (c := character(r[1:])) is None else c
            if r in PREDEFINED and r not in model.entities:
                return PREDEFINED[r]
            v = value(r)
            if v is None:
                return m[0] if on_unknown == "keep" else ""
            markup |= "<" in v
            return v if "<" in v else _REF.sub(lambda k: PREDEFINED.get(k[1]) or (k[1][0] == "#" and character(k[1][1:])) or k[0], v)

        return _REF.sub(one, t), markup

    out: list[Event] = []
    for e in events(b, ParserConfig(markers=False)):
        if e.kind == "characters":
            new, markup = text(e.content)
            if markup:
                inner = events(f"<r>{new}</r>".encode(), ParserConfig(markers=False))
                out += [x for x in inner[1:-1] if x.kind != "error"]
                continue
            e.content = new
        elif e.kind == "start_element":
            local = e.name.rpartition(":")[2]
            e.attrs = [(n, " ".join(text(v)[0].split()) if n in tokens.get(local, ()) else text(v)[0]) for n, v in e.attrs]
        if e.kind != "error":
            out.append(e)
    return write(out)
