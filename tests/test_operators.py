import pytest
from pyspark.sql import functions as F

from loomtag.config import ParserConfig, Problem
from loomtag.functions import xsd
from loomtag.operators import resolve, serialize, stream, validate
from loomtag.plans import lexer
from loomtag.sources.parse import parse


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, xml string")


def test_null_and_empty_documents(spark):
    rows = parse(docs(spark, None, "")).groupBy("doc_id").count().collect()
    assert {(r[0], r[1]) for r in rows} == {(0, 2), (1, 2)}
    assert parse(docs(spark)).count() == 0


def test_disabled_events_and_positions(spark):
    rows = parse(docs(spark, "<a>\n<b/></a>"), config=ParserConfig(markers=False, positions="line_only").without("space", "end_element")).orderBy("seq").collect()
    assert [(r.name, r.line, r.pos) for r in rows] == [("a", 1, None), ("b", 2, None)]


def test_lexer_agrees_with_the_tokenizer(spark):
    source = docs(spark, '<a x="1>2"><b/> t<!-- <c> --></a>', "<a><![CDATA[<x>]]><?p <q>?></a>", "<é/>", "<a")
    covered = [r[0] for r in lexer.tokenized(source).where(lexer.covered()).orderBy("doc_id").select("doc_id").collect()]
    assert 0 in covered and 1 in covered and 3 not in covered
    fast = {(r[0], r[1]) for r in lexer.tag_names(source).where("doc_id < 2").select("doc_id", "name").collect()}
    full = {(r[0], r[1]) for r in parse(source).where("event_type = 'start_element' AND doc_id < 2").select("doc_id", "name").collect()}
    assert fast == full


def test_tag_names_of_pages_that_the_lexer_does_not_cover(spark):
    source = docs(
        spark, '<a title="1<2" href="/x">t</a>', "<p title=it's>x</p>", '<div data-t="<b>x</b>"><i>y</i></div>', "<p>1 < 2<br></p>", "<script>if (a<b) '<i>'", "<script>'</style><b>'</script><u></u>",
        "<script-x><b></b></script-x><script></script>", "<b><style>a>b{}</style><i/></b>", None, "", "<!-- <b>",
    )
    got = sorted((r[0], r[1]) for r in lexer.tag_names(source, mode="html").select("doc_id", "name").collect())
    want = sorted((r[0], r[1]) for r in parse(source, config=ParserConfig(mode="html")).where("event_type = 'start_element'").select("doc_id", "name").collect())
    assert got == want and {(0, "a"), (1, "p"), (2, "div"), (2, "i")} <= set(got) and (2, "b") not in got


def test_serialised_text_parses_to_the_same(spark):
    texts = ['<?xml version="1.0"?><a b="&lt;&quot;">x<c/><!--y--><?t d?><![CDATA[z]]></a>', "<a>\n  <b>1</b>\n</a>"]
    out = {r[0]: r[1] for r in serialize.to_text(resolve.entities(parse(docs(spark, *texts)))).collect()}
    assert out == dict(enumerate(texts))


def test_errors_raise_skip_and_emit(spark):
    events = parse(docs(spark, '<a x="1" x="2"><b/></a>'))
    found = validate.attributes(events)
    with pytest.raises(Problem):
        validate.apply(events, found, "raise")
    assert validate.apply(events, found, "skip").where("name = 'a' AND event_type = 'start_element'").count() == 0
    assert validate.apply(events, found).where("event_type = 'error'").count() == 2  # the tokenizer's and the validator's
    with pytest.raises(Problem):
        stream.raise_on_error(events)
    left = stream.drop_while(events, F.coalesce(F.col("name") != "b", F.lit(True))).orderBy("seq").collect()
    assert [(r.event_type, r.name) for r in left] == [("start_element", "b"), ("end_element", "b"), ("end_element", "a"), ("end_document", None)]


def test_namespace_scope_closes_with_its_element(spark):
    # a sibling after an element without declarations still sees the root's prefixes
    assert validate.namespace_rules(parse(docs(spark, '<r xmlns:a="u"><b/><a:c/></r>'))).count() == 0
    assert [r.type for r in validate.namespace_rules(parse(docs(spark, '<r><b xmlns:a="u"/><a:c/></r>'))).collect()] == ["undeclared_prefix"]


def test_stateful_fold_over_batches(spark):
    many = docs(spark, *[f"<a>{'<b/>' * i}</a>" for i in range(60)])
    out = stream.fold(parse(many), lambda: 0, lambda e, s: (s + (e["event_type"] == "start_element"), []), lambda s: [{"n": s}], "n int")
    assert {r[0]: r[1] for r in out.collect()} == {i: i + 1 for i in range(60)}


@pytest.mark.parametrize(("value", "kind", "ok"), [
    ("128", "byte", False), ("-128", "byte", True), ("-129", "byte", False), ("+7", "byte", True), ("0", "negativeInteger", False), ("-0", "nonNegativeInteger", True), ("18446744073709551616", "unsignedLong", False),
    ("1.", "decimal", True), (".", "decimal", False), ("INF", "double", True), ("t", "boolean", False), ("2100-02-29", "date", False), ("2000-02-29", "date", True), ("24:00:00", "time", True), ("P", "duration", False),
    ("PT", "duration", False), ("P1DT2H", "dayTimeDuration", True), ("P1Y", "dayTimeDuration", False), ("--02-30", "gMonthDay", False), ("a b", "NMTOKENS", True), ("", "NMTOKENS", False), ("a:b", "QName", True), ("x y", "token", True), (" x", "token", False),
])
def test_schema_types(spark, value, kind, ok):
    assert spark.range(1).select(xsd.validate(F.lit(value), kind)).first()[0] is ok


def test_schema_facets_and_names(spark):
    check = lambda v, t, *f: spark.range(1).select(xsd.validate_facets(F.lit(v), t, list(f))).first()[0]
    assert check("abc123", "string", ("pattern", "[a-z]+[0-9]+")) and not check("P13M", "duration", ("maxInclusive", "P1Y")) and check("0fff", "hexBinary", ("length", 2))
    assert check("2024-01-15T00:00:00Z", "dateTime", ("minInclusive", "2024-01-01T00:00:00")) and not check("1.234", "decimal", ("fractionDigits", 2))
    assert xsd.normalize_type("xs:non_negative_integer") == "nonNegativeInteger" and xsd.normalize_type("q_name") == "QName" and xsd.chain("ID")[-1] == "anyType" and xsd.derived_from("byte", "decimal") and not xsd.is_numeric("string")


def test_chunks_are_assembled(spark, tmp_path):
    from loomtag.streaming.chunks import assembled

    rows = [("a", 1, b"<b/></a>", True), ("a", 0, b"<a>", False), ("b", 0, b"<c/>", True), ("d", 0, b"<x>", False)]
    spark.createDataFrame(rows, "doc_id string, chunk_no long, data binary, is_last boolean").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("doc_id string, chunk_no long, data binary, is_last boolean").parquet(str(tmp_path / "in"))
    q = assembled(arriving).writeStream.format("memory").queryName("whole").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    q.awaitTermination()
    assert {(r[0], bytes(r[1])) for r in spark.sql("SELECT * FROM whole").collect()} == {("a", b"<a><b/></a>"), ("b", b"<c/>")}


def test_files_as_documents(spark, tmp_path):
    from loomtag.sources.parse import parse_files

    (tmp_path / "x.xml").write_bytes(b"\xef\xbb\xbf<a>\r\n</a>")
    rows = parse_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.event_type, r.content) for r in rows] == [("start_document", None), ("start_element", None), ("space", "\n"), ("end_element", None), ("end_document", None)]


def test_external_texts_come_from_the_table_alone(spark):
    from loomtag.operators.documents import resolved

    docs = [("a", '<!DOCTYPE r SYSTEM "x"><r>&e;</r>'), ("b", '<!DOCTYPE r SYSTEM "none"><r>&e;</r>'), ("c", "<r>&e;</r>"), ("d", None), ("e", "<!DOCTYPE r [<!ENTITY % p SYSTEM 'x'>%p;]><r>&e;</r>")]
    outer = spark.createDataFrame([("x", '<!ENTITY % m SYSTEM "y">%m;'), ("y", '<?xml encoding="UTF-8"?><!ENTITY e "E"><!ENTITY % back SYSTEM "x">'), (None, "z"), ("y", "<?xml")], "system_id string, content string")
    out = dict(resolved(spark.createDataFrame(docs, "doc_id string, xml string"), external=outer.where("content <> '<?xml'")).collect())
    assert {k: v[-8:] for k, v in out.items() if k != "d"} == {"a": "<r>E</r>", "b": "p;e;</r>", "c": "p;e;</r>", "e": "<r>E</r>"} and out["d"] == ""


def test_references_are_held_against_own_declarations(spark):
    from loomtag.operators.validate import compliant
    from loomtag.sources.parse import parse

    texts = ["<!DOCTYPE r [<!ENTITY e 'x'><!-- <!ENTITY c 'x'> -->]><r>&e;&c;</r>", "<r>&c;</r>", '<!DOCTYPE r [<!ENTITY % p "">%p;]><r>&c;</r>', '<!DOCTYPE r SYSTEM "s"><r>&c;</r>',
             '<!DOCTYPE r [<!NOTATION n SYSTEM "n"><!ENTITY u SYSTEM "u" NDATA n><!ENTITY x SYSTEM "x">]><r a="&x;">&u;&x;&amp;</r>']
    found = compliant(parse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string"))).select("doc_id", "type", "detail").collect()
    assert sorted(map(tuple, found)) == [(0, "undefined_entity", "c"), (4, "external_entity_in_attribute", "x"), (4, "unparsed_entity", "u")]


def test_numbers_of_events_both_ways(spark):
    from loomtag.operators.accessors import STAX_CODES, stax_kind

    rows = spark.createDataFrame([(v,) for v in [*STAX_CODES.values(), 99]], "n int").select("n", stax_kind(F.col("n"))).collect()
    assert {k: v for k, v in rows} == {**{v: k for k, v in STAX_CODES.items()}, 99: None}
