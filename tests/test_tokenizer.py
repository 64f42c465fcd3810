import pytest

from loomtag.config import ParserConfig, Problem
from loomtag.functions.chars import is_name, is_qname
from loomtag.functions.tokenizer import events


def seen(text, **config):
    return [(e.kind, e.name, e.content) for e in events(text.encode(), ParserConfig(markers=False, **config)) if e.kind != "error"]


def errors(text, **config):
    return [e.error[1] for e in events(text.encode() if isinstance(text, str) else text, ParserConfig(markers=False, **config)) if e.kind == "error"]


def attributes(text, **config):
    return next(e.attrs for e in events(text.encode(), ParserConfig(markers=False, **config)) if e.kind == "start_element")


def test_elements_and_attributes():
    assert seen("<a><b/>x</a>") == [("start_element", "a", None), ("start_element", "b", None), ("end_element", "b", None), ("characters", None, "x"), ("end_element", "a", None)]
    assert attributes("<a  y = '2'\n x=\"1\" />") == [("y", "2"), ("x", "1")]  # in source order


def test_content_kinds():
    assert seen("<?xml version='1.0'?>\n<!DOCTYPE a [<!ENTITY e '>'>]><a> <!-- c --><![CDATA[<&]]><?t  d?></a>") == [
        ("prolog", "xml", None), ("space", None, "\n"), ("dtd", None, "DOCTYPE a [<!ENTITY e '>'>]"), ("start_element", "a", None), ("space", None, " "),
        ("comment", None, " c "), ("cdata", None, "<&"), ("processing_instruction", "t", "  d"), ("end_element", "a", None),
    ]


@pytest.mark.parametrize(("text", "kind"), [
    ("<a><!-- x", "eof_in_comment"), ("<a><![CDATA[x", "eof_in_cdata"), ("<a><?t x", "eof_in_pi"), ("<a", "eof_in_tag"), ("<a b", "eof_in_tag"), ('<a b="c', "eof_in_tag"),
    ("<a b></a>", "expected_eq"), ("<a b=c/>", "expected_quote"), ('<a b="1"c="2"/>', "missing_whitespace_before_attr"), ('<a b="<"/>', "attr_lt"), ('<a b="1" b="2"/>', "attr_unique"),
    ("<a>]]></a>", "text_cdata_end"), ("<1/>", "invalid_element"), ("</1>", "invalid_end_tag"), ("</a b>", "expected_gt"), ("<? x?>", "invalid_pi_target"), ("<a/><?xml version='1.0'?>", "misplaced_xml_decl"),
    ("<?xmlversion='1.0'?>", None), ("<?xml?><a/>", "malformed_xml_decl"), ("<?XML x?>", "reserved_pi_target"), ("<a><!-- a--b --></a>", "comment"), ("<a>\x01</a>", "invalid_char"), (b"\xff\xfe<\x00", "utf16"), (b"<a>\xff</a>", "invalid_utf8"),
])
def test_errors(text, kind):
    assert errors(text) == ([kind] if kind else [])


def test_recoverable_errors_go_on():
    assert ("characters", None, "]]>") in seen("<a>]]></a>")
    assert seen("<a><!-- a--b --><b/></a>")[-1] == ("end_element", "a", None)


def test_positions_are_bytes():
    es = events("<é>ü\n<b/></é>".encode(), ParserConfig(markers=False))
    assert [e.pos for e in es] == [1, 4, 8, 8, 13]


def test_depth_owner_and_recovery():
    es = events(b"<a><b></a></b></a>", ParserConfig(markers=False))
    assert [(e.kind[:3], e.name, e.depth, e.elem) for e in es] == [("sta", "a", 1, 0), ("sta", "b", 2, 1), ("end", "a", 2, None), ("end", "b", 2, 1), ("end", "a", 1, 0)]


def test_html():
    html = {"mode": "html"}
    assert attributes("<input disabled x=1 y='2'>", **html) == [("disabled", ""), ("x", "1"), ("y", "2")]
    assert seen("<script>if (a < b) {}</SCRIPT>", **html) == [("start_element", "script", None), ("characters", None, "if (a < b) {}"), ("end_element", "script", None)]
    assert errors("<div class=foo<bar>", **html) == ["invalid_unquoted_attr_char"]
    assert errors("<style>p{}", **html) == ["eof_in_raw_text"]
    assert errors("<!DOCTYPE potato \"ddd>Hello", **html) == ["unterminated_doctype_string"]
    assert errors("<!DOCTYPE potato PUBLIC 'go'of'>Hello", **html) == ["unexpected_char_in_doctype"]
    assert errors("<a x=1 x=2>", **html) == ["duplicate_attribute"]


def test_names_by_edition():
    assert is_name("é-1") and not is_name("-a") and is_qname("a:b") and not is_qname("a:b:c") and not is_qname(":a")
    assert is_name("é", 4) and not is_name("\u2160\u3400", 4) and is_name("a\u203f", 5) and not is_name("a\u203f", 4)


def test_config():
    assert ParserConfig(edition=9).edition == 5
    with pytest.raises(ValueError):
        ParserConfig(disable={"nothing"})
    with pytest.raises(ValueError):
        ParserConfig(mode="sgml")
    p = Problem("attr_lt", "bad", 2, 3)
    assert str(p) == "[attr_lt] at line 2, column 3: bad" and p.snippet("a\nbcde\nf").splitlines()[2].endswith("^")
