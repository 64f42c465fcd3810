import pytest

from loomtag.functions import c14n, dtd, security, tree
from loomtag.functions.namespaces import XML, Scope


def test_c14n():
    assert c14n.canonicalize('<root c="3" a="1" b="2"/>') == '<root a="1" b="2" c="3"></root>'
    assert c14n.canonicalize("<?xml version='1.0'?><a><!-- x -->\r\n<b>&lt;&#65;</b></a>") == "<a>\n<b>&lt;A</b></a>"
    assert c14n.canonicalize("<a><!-- x --></a>", "c14n_with_comments") == "<a><!-- x --></a>"
    assert c14n.canonicalize('<a xmlns="u" xmlns:p="v" xmlns:q="w"><p:b/></a>', "exc_c14n") == '<a xmlns="u"><p:b xmlns:p="v"></p:b></a>'
    assert c14n.canonicalize('<a xmlns:q="w"><b/></a>', "exc_c14n", ("q",)) == '<a xmlns:q="w"><b></b></a>'
    assert c14n.canonicalize('<a xmlns="u"><b xmlns=""/></a>') == '<a xmlns="u"><b xmlns=""></b></a>'
    with pytest.raises(ValueError):
        c14n.canonicalize("<a")


def test_tree():
    d = tree.build('<?xml version="1.0"?><r xmlns:p="u"><p:a id="1">x<b/>y</p:a><![CDATA[z]]></r>')
    assert d.version == "1.0" and d.root.text_content() == "xyz"
    a = d.get_element_by_id("1")
    assert (a.tag, a.prefix, a.namespace_uri, a.local) == ("p:a", "p", "u", "a")
    assert [e.tag for e in d.get_elements_by_tag_name("b")] == ["b"] and d.root.get_elements_by_tag_name("r") == []
    assert a.set_attribute("id", "2").get_attribute("id") == "2" and not a.remove_attribute("id").has_attribute("id")
    assert tree.write(tree.to_events(a)) == '<p:a id="1">x<b/>y</p:a>'


def test_simple_form_round_trip():
    form = tree.simple_form('<r a="1">x<b/>&lt;</r>')
    assert form == ["r", [["a", "1"]], ["x", ["b", [], []], "&lt;"]]
    assert tree.from_dom(tree.to_dom(form)) == form and tree.from_json(tree.to_json(form)) == form


def test_reader_and_writer():
    rows = [{"event_type": "prolog", "attrs": [{"name": "version", "value": "1.0"}]}, {"event_type": "start_element", "name": "a", "attrs": [{"name": "p:x", "local": "x", "ns_uri": "u", "value": "1"}], "content": None}, {"event_type": "characters", "content": "t"}, {"event_type": "end_element", "name": "a", "content": None}]
    r = tree.Reader(rows)
    assert r.next_tag()["name"] == "a" and r.version == "1.0" and r.attribute_count() == 1 and r.attribute_value("u", "x") == "1" and r.attribute_value(0) == "1"
    assert r.peek()["content"] == "t" and r.element_text() == "t" and not r.has_next()
    w = tree.Writer().start_document().start_element("a").attribute("x", '"<').characters("<").comment("c").cdata("]]>").empty_element("b").end_document()
    assert w.to_text() == '<?xml version="1.0"?><a x="&quot;&lt;">&lt;<!--c--><![CDATA[]]]]><![CDATA[>]]><b/></a>'
    with pytest.raises(ValueError):
        tree.Writer().start_element("a").characters("x").attribute("b", "c")


def test_scopes():
    s, errors = Scope().push([("xmlns", "d"), ("xmlns:p", "u")])
    assert not errors and s.expand_element("a") == ("d", "a") and s.expand_attribute("a") == (None, "a") and s.expand_element("q:a") is None and s.resolve("xml") == XML
    assert s.push([("xmlns", "")])[0].default_namespace() is None
    assert [e[0] for e in Scope().push([("xmlns:p", ""), ("xmlns:xml", "x"), ("xmlns", XML), ("xmlns:xmlns", "x")])[1]] == ["empty_prefix_binding", "reserved_prefix", "xml_namespace_as_default", "reserved_prefix"]
    assert Scope(version="1.1").push([("xmlns:p", "")])[1] == []


def test_dtd_model():
    m = dtd.parse_doctype('DOCTYPE r SYSTEM "s" [<!ELEMENT r (a,(b|c)*,d?)><!ELEMENT a (#PCDATA|b)*><!ATTLIST r id ID #REQUIRED k (x|y) "x" f CDATA #FIXED "1"><!ENTITY e "v"><!ENTITY e "w"><!NOTATION n SYSTEM "t"><!ENTITY u SYSTEM "u" NDATA n>]')
    assert m.root == "r" and m.system_id == "s" and m.entities["e"].value == "v" and m.entities["u"].kind == "unparsed" and m.notations == {"n": ("t", None)}
    assert dtd.model_text(m.elements["r"]) == "(a,(b|c)*,d?)" and dtd.model_text(m.elements["a"]) == "(#PCDATA|b)*"
    assert [(a.name, a.type, a.default_type, a.default) for a in m.attributes["r"]] == [("id", "ID", "REQUIRED", None), ("k", "enumeration", "DEFAULT", "x"), ("f", "CDATA", "FIXED", "1")]
    import re

    p = re.compile(dtd.model_pattern(m.elements["r"]) + r"\Z")
    assert p.match("a b c d ") and p.match("a ") and not p.match("b ")


@pytest.mark.parametrize(("subset", "kind"), [
    ('<!ENTITY a:b "x">', "colon_in_entity_name"), ('<!NOTATION a:b SYSTEM "x">', "colon_in_notation_name"), ("<!ELEMENT a (b,c|d)>", "invalid_content_model"), ("<!ELEMENT a (#PCDATA|b)>", "invalid_content_model"),
    ('<!ENTITY e "a & b">', "bare_ampersand"), ('<!ENTITY e PUBLIC "p">', "missing_system_id"), ('<!ATTLIST a b CDATA "<">', "lt_in_default"), ("<!FOO a>", "invalid_declaration"), ("%nope;", "undefined_parameter_entity"),
])
def test_dtd_rejects(subset, kind):
    with pytest.raises(dtd.DTDError) as e:
        dtd.parse_doctype(f"DOCTYPE r [{subset}]")
    assert e.value.kind == kind


@pytest.mark.parametrize(("content", "kind"), [("DOCTYPE r junk", "invalid_doctype"), ("DOCTYPE r [] x", "invalid_doctype"), ("DOCTYPE r [", "invalid_doctype"), ('DOCTYPE r PUBLIC "p"', "missing_system_id"), ('DOCTYPE r PUBLIC "{" "s"', "invalid_public_id")])
def test_doctype_rejects(content, kind):
    with pytest.raises(dtd.DTDError) as e:
        dtd.parse_doctype(content)
    assert e.value.kind == kind


def test_declarations_hold_per_cent_signs_where_they_may():
    m = dtd.parse_doctype("DOCTYPE r [<!ENTITY % p '<!ATTLIST r k CDATA \"5%\">'.replace>]".replace(".replace", "").replace("5%", "5&#37;"))
    assert m.parameters["p"].value == '<!ATTLIST r k CDATA "5%">'
    m = dtd.parse_doctype('DOCTYPE r [<!ATTLIST r k CDATA "5%"><!ENTITY e SYSTEM "a%20b">]')
    assert m.attributes["r"][0].default == "5%" and m.entities["e"].system_id == "a%20b"


def test_entities_have_limits():
    chain = "".join(f'<!ENTITY e{i} "&e{i + 1};">' for i in range(15)) + '<!ENTITY e15 "x">'
    m = dtd.parse_doctype(f"DOCTYPE r [{chain}]")
    with pytest.raises(dtd.DTDError, match="max_depth"):
        m.expand("e0")
    laughs = '<!ENTITY l0 "lol">' + "".join(f'<!ENTITY l{i} "{"&l%d;" % (i - 1) * 10}">' for i in range(1, 9))
    with pytest.raises(dtd.DTDError, match="max_expansion"):
        dtd.parse_doctype(f"DOCTYPE r [{laughs}]").expand("l8")
    loop = dtd.parse_doctype('DOCTYPE r [<!ENTITY a "&b;"><!ENTITY b "&a;"><!ENTITY c "&zz;">]')
    assert sorted(loop.circular()) == ["a", "b"] and loop.undefined() == ["zz"]


def test_external_subset_and_conditional_sections():
    outer = '<!ENTITY % on "INCLUDE"><![%on;[<!ENTITY x "1">]]><![IGNORE[<!ENTITY y "2">]]><!ENTITY e "outer">'
    m = dtd.parse_doctype('DOCTYPE r SYSTEM "s" [<!ENTITY e "inner">]', lambda s, p: outer)
    assert {k: v.value for k, v in m.entities.items()} == {"e": "inner", "x": "1"}


def test_signatures():
    key, other = security.generate_rsa(1024), security.generate_rsa(1024)
    xml = '<r a="é"><b Id="x">héllo &amp; <c/></b></r>'
    signed = security.sign_document(xml, key)
    assert security.verify_document(signed, key.public) == (True, "valid")
    assert security.verify_document(signed.replace("llo", "lla"), key.public) == (False, "digest_mismatch")
    assert security.verify_document(signed, other.public) == (False, "signature_mismatch")
    assert security.verify_document(xml, key.public) == (False, "no_signature")
    part = security.sign_document(xml, key, uri="#x", kind="detached")
    assert security.verify_document(part, key.public, detached=xml)[0]
    assert security.verify_document(security.sign_document(xml, key, kind="enveloping", hash_="sha512", algorithm="rsa_sha384", how="c14n"), key.public)[0]
    assert security.missing_parts(signed) == [] and "SignatureValue" in security.missing_parts(xml)
    d, q = security.generate_ec()
    assert security.verify_document(security.sign_document(xml, d, "ecdsa_sha256"), q)[0]


def test_keys():
    key = security.generate_rsa(1024)
    assert security.decrypt_key(security.encrypt_key(b"k" * 32, key.public), key) == b"k" * 32
    assert security.parse_pem(security.to_pem(key.public)) == key.public
    with pytest.raises(ValueError):
        security.decrypt_key(b"\x01" * key.size, key)
    assert len(security.generate_key("aes256_gcm")) == 32 and len(security.generate_iv("aes128_cbc")) == 16
