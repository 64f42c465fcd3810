"""Character classes of XML 1.0 as regular expressions (fixed values of the standard)."""

from __future__ import annotations

import re

#: NameStartChar and NameChar of the fifth edition.
START5 = ":A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
MORE5 = "\\-.0-9\u00b7\u0300-\u036f\u203f-\u2040"
NAME = {5: re.compile(f"[{START5}][{START5}{MORE5}]*\\Z")}
NCNAME_JAVA = "[A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�][-.0-9A-Z_a-z·À-ÖØ-öø-˿̀-ͯͰ-ͽͿ-῿‌-‍‿-⁀⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�]*"
#: What no document may hold.
INVALID = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _fourth() -> re.Pattern:
    """The fourth edition's names: letters, digits and marks of Unicode 2.0, by category below U+3200."""
    import unicodedata

    def ranges(ok) -> str:
        out, start = [], None
        for c in range(0x80, 0xD7A5):
            if ok(c) and start is None:
                start = c
            elif not ok(c) and start is not None:
                out.append(f"{chr(start)}-{chr(c - 1)}")
                start = None
        return "".join(out)

    old = unicodedata.ucd_3_2_0
    letter = lambda c: old.category(chr(c)) in ("Ll", "Lu", "Lo", "Lt", "Nl") and not 0xF900 <= c < 0xFFFE and not old.decomposition(chr(c)).startswith("<") and not 0x3400 <= c < 0x4E00
    more = lambda c: old.category(chr(c)) in ("Mn", "Mc", "Me", "Nd", "Lm") or c == 0xB7
    first, rest = ranges(letter), ranges(more)
    return re.compile(f"[:A-Z_a-z{first}][:A-Z_a-z{first}\\-.0-9{rest}]*\\Z")


def is_name(text: str, edition: int = 5) -> bool:
    if edition not in NAME:
        NAME[edition] = _fourth()
    return NAME[edition].match(text) is not None


def is_ncname(text: str, edition: int = 5) -> bool:
    return ":" not in text and is_name(text, edition)


def is_qname(text: str, edition: int = 5) -> bool:
    parts = text.split(":")
    return len(parts) <= 2 and all(is_ncname(p, edition) for p in parts)
