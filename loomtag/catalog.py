"""One query for each operator, over documents made from the tables, with the SQL that says what must come out.

Names begin with the operator's id in the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synthetic as docs
from .config import ParserConfig
from .functions import preprocess, xsd
from .functions import security as crypto
from .operators import accessors as E
from .operators import documents, resolve, serialize, stream, validate
from .operators import security as sealed
from .operators import tree as nodes
from .operators.resolve import encode
from .plans import lexer
from .sources.parse import parse

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
c = F.col
HTML = ParserConfig(mode="html")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def start(name: str | None = None):
    test = c("event_type") == "start_element"
    return test if name is None else test & (c("name") == name)


def attr(name: str):
    return E.attribute(name)


# --- parsing

_TAGS = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(script|style)[^>]*>).*?</(script|style)>', '\1', 'gs') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '<([a-zA-Z][^\s/>]*)', 1)) AS name FROM p)
"""


@query("P20_tag_frequency", _TAGS + "SELECT name, count(*) AS n FROM t GROUP BY name")
def _(spark, d):
    return lexer.tag_names(docs.pages(spark, d), mode="html").groupBy("name").agg(F.count("*").alias("n"))


@query("P18_html_full_tokenizer", _TAGS + "SELECT page_id AS doc_id, count(*) AS n FROM t GROUP BY page_id")
def _(spark, d):
    events = parse(docs.pages(spark, d), config=HTML.without("characters", "space", "end_element", "comment"))
    return events.where(start()).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("P1_roundtrip_nation", "SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS VARCHAR) AS r, n_name AS name FROM nation")
def _(spark, d):
    events = parse(docs.nations(spark, d))
    return events.groupBy("doc_id").agg(F.max(attr("k")).alias("k"), F.max(attr("r")).alias("r"), F.max("content").alias("name")).drop("doc_id")


@query("P2_roundtrip_lineitem", "SELECT l_orderkey AS doc_id, l_linenumber AS no, l_returnflag AS flag, l_partkey AS part, CAST(l_quantity AS INT) AS qty FROM lineitem")
def _(spark, d):
    events = parse(docs.orders(spark, d), columns=("event_type", "name", "attrs", "content", "path"))
    return nodes.records(events, "line", {"no": ("@no", "int"), "flag": ("@flag", "string"), "part": ("part", "long"), "qty": ("qty", "int")})


@query("P3_process", "SELECT doc_id, length(text) AS n, source AS src FROM documents")
def _(spark, d):
    found = resolve.entities(parse(docs.texts(spark, d), prepared=True))
    return found.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(c("event_type").isin("characters", "space"), F.length("content"))), F.lit(0)).alias("n"), F.max(attr("src")).alias("src"))


@query("P3_process_whole", """
SELECT n_nationkey AS doc_id, 'error' AS event_type, 'undefined_entity' AS v FROM nation
UNION ALL SELECT n_nationkey, 'start_element', 'a ' || n_nationkey FROM nation
UNION ALL SELECT n_nationkey, 'characters', n_name || ' AB [v' || n_nationkey || ']&x; <' FROM nation""")
def _(spark, d):
    """Documents with an entity that nothing declares, from bytes to resolved events and errors."""
    source = docs.entities(spark, d).select("doc_id", F.encode(F.replace("xml", F.lit("&f;"), F.lit("&f;&x;")), "UTF-8").alias("xml"))
    found = documents.process(source).where(c("event_type").isin("error", "start_element", "characters"))
    return found.select(c("doc_id").cast("int").alias("doc_id"), "event_type", F.coalesce("error.type", attr("k"), "content").alias("v"))


@query("P4_event_counts", """
SELECT event_type, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT unnest(['start_document', 'end_document', 'start_element', 'end_element', 'comment', 'processing_instruction', 'cdata']) AS event_type, count(*) AS n FROM documents GROUP BY 1
) GROUP BY event_type""")
def _(spark, d):
    return parse(docs.mixed(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("P5_without_markers", "SELECT CAST(count(*) * 3 AS BIGINT) AS n FROM nation")
def _(spark, d):
    return parse(docs.nations(spark, d), config=ParserConfig(markers=False)).agg(F.count("*").alias("n"))


@query("P6_disabled_events", "SELECT 'start_element' AS event_type, count(*) * 2 + (SELECT count(*) * 3 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS n FROM orders")
def _(spark, d):
    config = ParserConfig(markers=False, positions="none").without("end_element", "characters", "space")
    return parse(docs.orders(spark, d), config=config, columns=("event_type",)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("P8_positions", "SELECT n_nationkey AS doc_id, 1 AS line, CAST(strlen('<n k=\"' || n_nationkey || '\" r=\"' || n_regionkey || '\">') AS BIGINT) AS text_pos, CAST(strlen('<n k=\"' || n_nationkey || '\" r=\"' || n_regionkey || '\">' || n_name || '</') AS BIGINT) AS end_pos FROM nation")
def _(spark, d):
    return parse(docs.nations(spark, d)).groupBy("doc_id").agg(F.max("line").alias("line"), F.max(F.when(c("event_type") == "characters", c("pos"))).alias("text_pos"), F.max(F.when(c("event_type") == "end_element", c("pos"))).alias("end_pos")).withColumn("doc_id", c("doc_id").cast("int"))


@query("P10_line_numbers", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line FROM documents")
def _(spark, d):
    return parse(docs.texts(spark, d)).where(c("event_type") == "end_element").select("doc_id", "line")


@query("P14_cdata_text", "SELECT doc_id, text AS cdata, CAST(doc_id AS VARCHAR) AS comment FROM documents")
def _(spark, d):
    pick = lambda k: F.max(F.when(c("event_type") == k, c("content"))).alias(k)
    return parse(docs.mixed(spark, d)).groupBy("doc_id").agg(pick("cdata"), pick("comment"))


@query("P16_instructions", "SELECT doc_id, 'lang' AS target, ' ' || lang AS data FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    return parse(docs.mixed(spark, d)).where(c("event_type") == "processing_instruction").select("doc_id", c("name").alias("target"), c("content").alias("data"))


@query("P17_prolog", "SELECT doc_id, '1.0' AS version, 'UTF-8' AS encoding FROM documents")
def _(spark, d):
    return parse(docs.texts(spark, d)).where(c("event_type") == "prolog").select("doc_id", attr("version").alias("version"), attr("encoding").alias("encoding"))


@query("P15_doctype", "SELECT page_id AS doc_id, 'DOCTYPE html' AS content FROM pages")
def _(spark, d):
    return parse(docs.pages(spark, d), config=HTML).where(c("event_type") == "dtd").select("doc_id", "content")


@query("P18_html_boolean_attributes", "SELECT c_custkey AS doc_id, '' AS disabled, '' AS checked, 'f' || c_custkey AS name FROM customer")
def _(spark, d):
    return parse(docs.html_attributes(spark, d), config=HTML).where(start("input")).select("doc_id", attr("disabled").alias("disabled"), attr("checked").alias("checked"), attr("name").alias("name"))


@query("P19_html_unquoted_attributes", "SELECT c_custkey AS doc_id, '/x?' || c_custkey AS href, lower(c_mktsegment) AS class FROM customer")
def _(spark, d):
    return parse(docs.html_attributes(spark, d), config=HTML).where(start("a")).select("doc_id", attr("href").alias("href"), attr("class").alias("class"))


@query("P20_html_raw_text", "SELECT c_custkey AS doc_id, 'if (a < ' || c_custkey || ' && b) { ''</p>'' }' AS body FROM customer")
def _(spark, d):
    events = parse(docs.html_attributes(spark, d), config=HTML)
    return events.where((c("event_type") == "characters") & (F.element_at("path", -1) == "script")).select("doc_id", c("content").alias("body"))


@query("P20_comments", "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<!--(.*?)-->', 1)) AS comment FROM pages")
def _(spark, d):
    return parse(docs.pages(spark, d), config=HTML).where(c("event_type") == "comment").select("doc_id", c("content").alias("comment"))


def _faults(*kinds: str) -> str:
    rows = ", ".join(f"({i}, '{k}')" for i, (_, k) in enumerate(docs.FAULTS) if k in kinds)
    return f"SELECT o_orderkey AS doc_id, v.type FROM orders JOIN (VALUES {rows}) v(i, type) ON o_orderkey % {len(docs.FAULTS)} = v.i"


_PARSER = ("attr_unique", "attr_lt", "comment", "text_cdata_end", "eof_in_tag", "eof_in_comment", "eof_in_cdata", "eof_in_pi", "expected_eq", "expected_quote", "reserved_pi_target", "misplaced_xml_decl")


@query("P21_parser_errors", _faults(*_PARSER))
def _(spark, d):
    return stream.errors(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("P22_native_lexer_positions", "SELECT n_nationkey AS doc_id, 0 AS place, 'start_element' AS kind, CAST(0 AS BIGINT) AS pos FROM nation UNION ALL SELECT n_nationkey, 1, 'characters', strlen('<n k=\"' || n_nationkey || '\" r=\"' || n_regionkey || '\">') FROM nation UNION ALL SELECT n_nationkey, 2, 'end_element', strlen('<n k=\"' || n_nationkey || '\" r=\"' || n_regionkey || '\">' || n_name) FROM nation")
def _(spark, d):
    return lexer.tokens(docs.nations(spark, d)).select(c("doc_id").cast("int").alias("doc_id"), "place", "kind", "pos")


# --- preprocessing


@query("R4_line_endings", "SELECT doc_id, replace(replace(text, ' the ', chr(10)), ' of ', chr(10)) AS text FROM documents")
def _(spark, d):
    text = F.replace(F.replace("text", F.lit(" the "), F.lit("\r\n")), F.lit(" of "), F.lit("\r"))
    return docs.table(spark, d, "documents").select("doc_id", preprocess.line_endings(text).alias("text"))


@query("R2_bom_utf8", "SELECT doc_id, text FROM documents")
def _(spark, d):
    b = F.concat(F.unhex(F.lit("EFBBBF")), c("text").cast("binary"))
    return docs.table(spark, d, "documents").select("doc_id", preprocess.to_utf8(b).alias("text"))


@query("R3_utf16", "SELECT doc_id, text AS le, text AS be, 'utf16_le' AS kind FROM documents")
def _(spark, d):
    le, be = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")), F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    return docs.table(spark, d, "documents").select("doc_id", preprocess.to_utf8(le).alias("le"), preprocess.to_utf8(be).alias("be"), preprocess.detect_encoding(le).alias("kind"))


@query("R1_preprocess", "SELECT doc_id, replace(text, ' ', chr(10)) AS text FROM documents")
def _(spark, d):
    b = F.concat(F.unhex(F.lit("FEFF")), F.encode(F.replace("text", F.lit(" "), F.lit("\r\n")), "UTF-16BE"))
    return docs.table(spark, d, "documents").select("doc_id", preprocess.preprocess(b).alias("text"))


# --- event operators


@query("T1_transform_path", "SELECT l_orderkey AS doc_id, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS qty FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = stream.transform_events(parse(docs.orders(spark, d), columns=("event_type", "content", "path")), (c("event_type") == "characters") & (F.array_join("path", "/") == "order/line/qty"), value=c("content").cast("int"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("value").alias("qty"))


@query("T1_stateful_fold", "SELECT o_orderkey AS doc_id, CAST(2 + 3 * coalesce(n, 0) AS BIGINT) AS elements, CAST(CASE WHEN n IS NULL THEN 2 ELSE 3 END AS BIGINT) AS deepest FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    def step(e: dict, state: tuple) -> tuple[tuple, list]:
        return ((state[0] + 1, max(state[1], e["depth"])) if e["event_type"] == "start_element" else state), []

    return stream.fold(parse(docs.orders(spark, d), columns=("event_type", "depth")), lambda: (0, 0), step, lambda s: [{"elements": s[0], "deepest": s[1]}], "elements long, deepest long")


@query("T2_event_mode", "SELECT n_nationkey AS doc_id, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    strange = parse(docs.nations(spark, d)).withColumn("event_type", F.when(c("event_type") == "characters", "custom").otherwise(c("event_type")))
    return stream.errors(stream.transform_events(strange, event_mode="strict")).groupBy(c("doc_id").cast("int").alias("doc_id")).agg(F.count("*").alias("n"))


@query("T3_outside_root", _faults("text_outside_root"))
def _(spark, d):
    events = parse(docs.faulty(spark, d))
    return stream.errors(stream.drop_outside_root(events)).where("source = 'validation'").select("doc_id", "type")


@query("T4_filter", "SELECT 'characters' AS event_type, count(*) AS n FROM lineitem UNION ALL SELECT unnest(['start_document', 'end_document']), count(*) FROM orders GROUP BY 1")
def _(spark, d):
    rows = stream.filter_events(parse(docs.orders(spark, d), columns=("event_type", "path")), (c("event_type") == "characters") & (F.element_at("path", -1) == "part"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("T5_tap", "SELECT n_nationkey AS doc_id FROM nation")
def _(spark, d):
    rows, _ = stream.tap(parse(docs.nations(spark, d)), "nations")
    return rows.where(start()).select(c("doc_id").cast("int").alias("doc_id"))


_SPACED = "SELECT o_orderkey AS doc_id, '<a> ' || chr(10) || '<b>' || o_orderstatus || '</b> </a>' AS xml FROM orders"


def _spaced(spark, d):
    return docs.table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), docs.cat("<a> \n<b>", c("o_orderstatus"), "</b> </a>").alias("xml"))


@query("F1_filter_ws", "SELECT o_orderkey AS doc_id, o_orderstatus AS content FROM orders")
def _(spark, d):
    return stream.filter_ws(parse(_spaced(spark, d), columns=("event_type", "content"))).where(c("event_type").isin("characters", "space")).select("doc_id", "content")


@query("F2_filter_namespaces_prefix", "SELECT c_custkey AS doc_id, unnest(['p:name', c_name]) AS x FROM customer")
def _(spark, d):
    rows = stream.filter_namespaces(parse(docs.customers(spark, d)), ["p"]).where(c("event_type").isin("start_element", "characters"))
    return rows.select("doc_id", F.coalesce("name", resolve.resolve_text(c("content"))).alias("x"))


@query("F2_filter_namespaces_uri", "SELECT c_custkey AS doc_id, unnest(['o', 'i']) AS name FROM customer")
def _(spark, d):
    return stream.filter_namespaces(parse(docs.customers(spark, d)), ["urn:o"], by="uri").where(start()).select("doc_id", "name")


@query("F2_mixed_content", "SELECT c_custkey AS doc_id, c_name || '|' || c_mktsegment AS x FROM customer")
def _(spark, d):
    """Text after a dropped child still belongs to the element that is open around it."""
    xml = docs.cat('<p:a xmlns:p="urn:p" xmlns:q="urn:q">', encode(c("c_name")), "<q:x>in</q:x>", F.lit("|"), encode(c("c_mktsegment")), "</p:a>")
    source = docs.table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), xml.alias("xml"))
    by_prefix = stream.filter_namespaces(parse(source), ["p"])
    both = stream.filter_namespaces(by_prefix, ["urn:p"], by="uri").where(c("event_type") == "characters")
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("t")).select("doc_id", F.array_join(F.transform("t", lambda t: t["content"]), "").alias("x"))


@query("M12_unclosed", "SELECT n_nationkey AS doc_id, unnest(['b', 'c']) AS local FROM nation")
def _(spark, d):
    source = docs.table(spark, d, "nation").select(c("n_nationkey").alias("doc_id"), docs.cat('<a k="', c("n_nationkey"), '"><b><c>').alias("xml"))
    return nodes.descendants(nodes.nodes(parse(source)), "a").select("doc_id", "local")


#: Events of each faulty document up to its first error, both counted, or up to its end; start_document is the first.
_UNTIL_ERROR = (6, 5, 2, 2, 4, 4, 6, 5, 5, 5, 4, 2, 4, 4, 4, 2, 2, 3, 4, 3, 5, 4, 4, 4, 4)


@query("F3_halt_on_error", f"SELECT o_orderkey AS doc_id, CAST(v.n AS BIGINT) AS n FROM orders JOIN (VALUES {', '.join(map(str, enumerate(_UNTIL_ERROR)))}) v(i, n) ON o_orderkey % {len(docs.FAULTS)} = v.i")
def _(spark, d):
    return stream.halt_on_error(parse(docs.faulty(spark, d))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("F5_check_errors", f"SELECT o_orderkey AS doc_id, o_orderkey % {len(docs.FAULTS)} NOT IN ({', '.join(str(i) for i, (_, k) in enumerate(docs.FAULTS) if k in _PARSER)}) AS ok FROM orders")
def _(spark, d):
    return stream.check_errors(parse(docs.faulty(spark, d))).select("doc_id", "ok")


@query("F6_take", "SELECT o_orderkey AS doc_id, CAST(3 AS BIGINT) AS n, 'status' AS last FROM orders")
def _(spark, d):
    rows = stream.take(parse(docs.orders(spark, d), columns=("seq", "name")), 3)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("name", "seq").alias("last"))


@query("F6_chunk_every", "SELECT o_orderkey AS doc_id, CAST(ceil((7 + 8 * coalesce(n, 0)) / 5.0) AS BIGINT) AS chunks FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    rows = stream.chunk_every(parse(docs.orders(spark, d), columns=("seq",)), 5)
    return rows.groupBy("doc_id").agg(F.count_distinct("chunk").alias("chunks"))


# --- accessors


@query("E1_tag_split", "SELECT c_custkey AS doc_id, 'p' AS prefix, 'name' AS local, 'p:name' AS joined FROM customer")
def _(spark, d):
    t = E.tag(c("name"))
    rows = parse(docs.customers(spark, d)).where(start("p:name"))
    return rows.select("doc_id", t["prefix"].alias("prefix"), t["local"].alias("local"), E.tag_name(t["local"], t["prefix"]).alias("joined"))


@query("E5_attribute_map", "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS no, l_returnflag AS flag, 2 AS n FROM lineitem")
def _(spark, d):
    rows = parse(docs.orders(spark, d), columns=("event_type", "name", "attrs")).where(start("line")).withColumn("m", E.attribute_map())
    return rows.select("doc_id", c("m")["no"].alias("no"), c("m")["flag"].alias("flag"), E.attribute_count().alias("n"))


@query("E7_position", "SELECT doc_id, CAST(1 AS INT) AS line, CAST(strlen('<?xml version=\"1.0\" encoding=\"UTF-8\"?>') + 1 AS BIGINT) AS col FROM documents")
def _(spark, d):
    p = E.position()
    return parse(docs.texts(spark, d)).where(start()).select("doc_id", p["line"].alias("line"), p["column"].alias("col"))


@query("M8_get_attribute_href", "SELECT page_id AS doc_id, count(*) AS n, max(len(h)) AS longest FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages) GROUP BY page_id")
def _(spark, d):
    rows = parse(docs.pages(spark, d), config=HTML).where(start("a") & E.has_attribute("href"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length(attr("href"))).cast("long").alias("longest"))


@query("M9_set_and_remove_attribute", "SELECT n_nationkey AS doc_id, 'r=' || n_regionkey || ',k=x,z=1' AS attrs FROM nation")
def _(spark, d):
    rows = parse(docs.nations(spark, d)).where(start())
    rows = rows.withColumn("attrs", E.remove_attribute("k")).withColumn("attrs", E.set_attribute("k", F.lit("x"))).withColumn("attrs", E.set_attribute("z", F.lit("1")))
    return rows.select(c("doc_id").cast("int").alias("doc_id"), F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ",").alias("attrs"))


# --- validators


def _check(name: str, kinds: tuple[str, ...], f) -> None:
    @query(name, _faults(*kinds))
    def _(spark, d):
        return f(parse(docs.faulty(spark, d))).select("doc_id", "type")


def _found(*rows: tuple[int, str]) -> str:
    return f"SELECT o_orderkey AS doc_id, v.type FROM orders JOIN (VALUES {', '.join(map(str, rows))}) v(i, type) ON o_orderkey % {len(docs.FAULTS)} = v.i"


#: What each validator finds in the faulty documents, all of it. 12, 13 and 14 end within an element; at 17 and 18 the
#: tokenizer stops before the end tag; 11, 15, 16 and 19 have no root that it could read.
_STRUCTURE = ((0, "tag_mismatch"), (0, "unclosed_tag"), *((i, "unclosed_tag") for i in (1, 12, 13, 14, 17, 18)), (19, "unexpected_close"))
_ROOTS = ((6, "multiple_roots"), (7, "text_outside_root"), *((i, "no_root") for i in (11, 15, 16, 19)))
_PREFIXES = ((4, "undeclared_namespace"), (23, "undeclared_namespace"))
_TWICE = ((2, "duplicate_attr"),)
_OWN = tuple((i, k) for i, (_, k) in enumerate(docs.FAULTS) if k in _PARSER)


@query("V1_well_formed", _found(*_STRUCTURE))
def _(spark, d):
    return validate.well_formed(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("V4_namespaces", _found(*_PREFIXES))
def _(spark, d):
    return validate.namespaces(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("V8_root_boundary", _found(*_ROOTS))
def _(spark, d):
    return validate.root_boundary(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("V14_namespace_rules", _found((4, "undeclared_prefix"), (21, "empty_prefix_binding"), (22, "duplicate_attribute"), (23, "invalid_qname"), (23, "undeclared_prefix")))
def _(spark, d):
    return validate.namespace_rules(parse(docs.faulty(spark, d))).select("doc_id", "type")


_check("V3_attribute_values", ("attr_lt",), validate.attribute_values)
_check("V6_comments", ("comment",), validate.comments)
_check("V9_entity_references", ("undefined_entity",), validate.entity_references)
_check("V11_xml_declaration", ("missing_version",), validate.xml_declaration)
_check("V13_character_references", ("malformed_char_ref",), validate.character_references)


@query("V2_duplicate_attributes", _faults("attr_unique").replace("v.type", "'duplicate_attr' AS type"))
def _(spark, d):
    return validate.attributes(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("V7_processing_instructions", "SELECT n_nationkey AS doc_id, 'reserved_pi_target' AS type FROM nation WHERE n_nationkey % 3 = 0")
def _(spark, d):
    events = parse(docs.nations(spark, d)).where(start()).withColumn("event_type", F.lit("processing_instruction")).withColumn("name", F.when(c("doc_id") % 3 == 0, "XmL").otherwise("ok"))
    return validate.processing_instructions(events).select(c("doc_id").cast("int").alias("doc_id"), "type")


@query("V5_all", _found(*_STRUCTURE, *_TWICE, *_PREFIXES))
def _(spark, d):
    return validate.all_of(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("V12_compliant", _found(*_STRUCTURE, *_ROOTS, *_TWICE, *_PREFIXES, (8, "missing_version"), (5, "comment"), *_OWN))
def _(spark, d):
    return validate.compliant(parse(docs.faulty(spark, d))).select("doc_id", "type")


@query("V10_declared_entities", "SELECT n_nationkey AS doc_id, 'undefined_entity' AS type, 'x' AS detail FROM nation")
def _(spark, d):
    source = docs.entities(spark, d).select("doc_id", F.replace("xml", F.lit("&f;"), F.lit("&f;&x;")).alias("xml"))
    found = documents.declarations(source).where(c("kind").isin("internal", "external", "unparsed"))
    return validate.entity_references_declared(parse(source), found).select(c("doc_id").cast("int").alias("doc_id"), "type", "detail")


@query("V15_dtd_names", "SELECT n_nationkey AS doc_id, 'colon_in_entity_name' AS error FROM nation")
def _(spark, d):
    source = docs.nations(spark, d).select("doc_id", docs.cat('<!DOCTYPE n [<!ENTITY a:b "x">]>', c("xml")).alias("xml"))
    return documents.declarations(source).where("kind = 'error'").select(c("doc_id").cast("int").alias("doc_id"), "error")


@query("V16_names", "SELECT doc_id, regexp_full_match(lang, '[A-Za-z_][A-Za-z0-9_.-]*') AS ok, false AS bad FROM documents WHERE lang IS NOT NULL")
def _(spark, d):
    return docs.table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", xsd.validate(c("lang"), "NCName").alias("ok"), xsd.validate(F.concat(F.lit("1"), "lang"), "NCName").alias("bad"))


@query("V1_apply_skip", f"SELECT CAST(count(*) FILTER (o_orderkey % {len(docs.FAULTS)} = 2) AS BIGINT) AS gone FROM orders")
def _(spark, d):
    events = parse(docs.faulty(spark, d), columns=("seq", "event_type", "name", "attrs"))
    kept = validate.apply(events, validate.attributes(events), "skip")
    return events.where(start()).join(kept.select("doc_id", "seq").hint("merge"), ["doc_id", "seq"], "left_anti").agg(F.count("*").alias("gone"))


# --- entities, namespaces, DTD


@query("X2_entities_predefined", "SELECT doc_id, text FROM documents")
def _(spark, d):
    return docs.table(spark, d, "documents").select("doc_id", resolve.resolve_text(resolve.encode(c("text"))).alias("text"))


@query("X1_entities_numeric_custom", "SELECT n_nationkey AS doc_id, n_name || 'AB' || n_regionkey || '&zz;' AS text FROM nation")
def _(spark, d):
    source = docs.table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("doc_id"), docs.cat("<n>", c("n_name"), "&#65;&#x42;&r;&zz;</n>").alias("xml"), c("n_regionkey").cast("string").alias("r"))
    events = parse(source).join(source.select("doc_id", "r"), "doc_id")
    out = resolve.entities(events, F.create_map(F.lit("r"), c("r")))
    return out.where(c("event_type") == "characters").select(c("doc_id").cast("int").alias("doc_id"), c("content").alias("text"))


@query("X3_entities_remove", "SELECT n_nationkey AS doc_id, n_name || '!' AS v FROM nation")
def _(spark, d):
    source = docs.table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("doc_id"), docs.cat('<n v="', c("n_name"), '&zz;&#33;"/>').alias("xml"))
    return resolve.entities(parse(source), on_unknown="remove").where(start()).select(c("doc_id").cast("int").alias("doc_id"), attr("v").alias("v"))


@query("X1_entities_emit", "SELECT n_nationkey AS doc_id, 'unknown_entity' AS type FROM nation")
def _(spark, d):
    source = docs.table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("doc_id"), docs.cat("<n>", c("n_name"), "&zz;</n>").alias("xml"))
    return stream.errors(resolve.entities(parse(source), on_unknown="emit")).select(c("doc_id").cast("int").alias("doc_id"), "type")


@query("X5_encode", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS a FROM documents")
def _(spark, d):
    return docs.table(spark, d, "documents").select("doc_id", resolve.encode(c("text")).alias("t"), resolve.encode_attr(c("text")).alias("a"))


@query("N1_resolve", "SELECT c_custkey AS doc_id, unnest(['{urn:d' || c_custkey % 7 || '}c', '{urn:p' || c_custkey % 5 || '}name', '{urn:d' || c_custkey % 7 || '}bal', '{urn:o}o', '{urn:o}i']) AS name FROM customer")
def _(spark, d):
    return resolve.namespaces(parse(docs.customers(spark, d)), strip_declarations=True).where(start()).select("doc_id", resolve.expanded_name().alias("name"))


@query("N1_attributes", "SELECT c_custkey AS doc_id, 'urn:p' || c_custkey % 5 AS uri, CAST(NULL AS VARCHAR) AS plain, CAST(c_custkey AS VARCHAR) AS k FROM customer")
def _(spark, d):
    a = lambda n: F.get(F.filter("attrs", lambda x: x["name"] == n), 0)
    return parse(docs.customers(spark, d)).where(start("p:name")).select("doc_id", a("p:k")["ns_uri"].alias("uri"), a("seg")["ns_uri"].alias("plain"), a("p:k")["value"].alias("k"))


@query("N2_track", "SELECT c_custkey AS doc_id, unnest(['c', 'o']) AS name, unnest(['urn:d' || c_custkey % 7, 'urn:o']) AS dflt, 'urn:p' || c_custkey % 5 AS p FROM customer")
def _(spark, d):
    rows = resolve.track(parse(docs.customers(spark, d), config=ParserConfig(scopes=True)), only_changes=True)
    return rows.select("doc_id", "name", c("ns_scope")[""].alias("dflt"), c("ns_scope")["p"].alias("p"))


@query("DT2_declarations", """
SELECT n_nationkey AS doc_id, unnest(['doctype', 'element', 'attribute', 'attribute', 'internal', 'internal', 'notation']) AS kind,
  unnest(['n', 'n', 'k', 'c', 'e' || n_nationkey, 'f', 'gif']) AS name,
  unnest([NULL, '(#PCDATA)', NULL, NULL, 'v' || n_nationkey, '[&e' || n_nationkey || ';]', NULL]) AS value FROM nation""")
def _(spark, d):
    return documents.declarations(docs.entities(spark, d)).select(c("doc_id").cast("int").alias("doc_id"), "kind", "name", "value")


@query("DT7_nested_expansion", "SELECT n_nationkey AS doc_id, unnest(['e' || n_nationkey, 'f']) AS name, unnest(['v' || n_nationkey, '[v' || n_nationkey || ']']) AS value FROM nation")
def _(spark, d):
    return documents.entity_values(docs.entities(spark, d)).select(c("doc_id").cast("int").alias("doc_id"), "name", "value")


@query("DT4_circular", "SELECT n_nationkey AS doc_id, unnest(['a', 'b']) AS name, 'circular_entity' AS error FROM nation")
def _(spark, d):
    source = docs.nations(spark, d).select("doc_id", docs.cat('<!DOCTYPE n [<!ENTITY a "&b;"><!ENTITY b "&a;">]>', c("xml")).alias("xml"))
    return documents.entity_values(source).select(c("doc_id").cast("int").alias("doc_id"), "name", "error")


@query("DT5_undefined_entities", "SELECT n_nationkey AS doc_id, unnest(['x' || n_nationkey, 'zz']) AS name FROM nation")
def _(spark, d):
    from .functions import dtd

    source = docs.nations(spark, d).select("doc_id", docs.cat('<!DOCTYPE n [<!ENTITY a "&x', c("doc_id"), ';&amp;&#65;"><!ATTLIST n k CDATA "&zz;&a;">]>', c("xml")).alias("xml"))
    found = documents.per_document(source, lambda b: [{"name": n} for n in dtd.model_of_document(b).undefined()], "name string")
    return found.select(c("doc_id").cast("int").alias("doc_id"), "name")


@query("DT9_parameter_entities", "SELECT n_nationkey AS doc_id, 'v' || n_regionkey AS value FROM nation")
def _(spark, d):
    source = docs.table(spark, d, "nation").select(c("n_nationkey").alias("doc_id"), docs.cat("<!DOCTYPE n [<!ENTITY % p '<!ENTITY e \"v", c("n_regionkey"), "\">'>%p;]><n>&e;</n>").alias("xml"))
    return documents.entity_values(source).where("name = 'e'").select("doc_id", "value")


@query("DT10_conditional_sections", "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'in' ELSE 'out' END AS value FROM nation")
def _(spark, d):
    from .functions import dtd

    def one(b: bytes) -> list[dict]:
        outer = f'<!ENTITY % even "{b.decode()}"><![%even;[<!ENTITY e "in">]]><!ENTITY e "out">'
        return [{"value": dtd.parse_doctype('DOCTYPE n SYSTEM "s"', lambda system, public: outer).expand("e")}]

    word = F.when(c("n_nationkey") % 2 == 0, "INCLUDE").otherwise("IGNORE")
    return documents.per_document(docs.table(spark, d, "nation").select(c("n_nationkey").alias("doc_id"), word.alias("xml")), one, "value string")


@query("DT6_resolve", "SELECT n_nationkey AS doc_id, 'a ' || n_nationkey AS k, n_name || ' AB [v' || n_nationkey || '] <' AS text FROM nation")
def _(spark, d):
    events = parse(documents.resolved(docs.entities(spark, d)))
    return events.groupBy(c("doc_id").cast("int").alias("doc_id")).agg(F.max(attr("k")).alias("k"), F.max(F.when(c("event_type") == "characters", resolve.resolve_text(c("content")))).alias("text"))


@query("P27_external_dtd", "SELECT n_nationkey AS doc_id, r_name || '-' || n_nationkey || '-both' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    """Outer subsets from a table, one for each region, which all name a further text."""
    own = docs.table(spark, d, "region").select(docs.cat("s", c("r_regionkey"), ".dtd").alias("system_id"), docs.cat('<?xml encoding="UTF-8"?><!ENTITY e "', c("r_name"), '"><!ENTITY % m SYSTEM \'more.mod\'>%m;').alias("content"))
    outer = own.union(spark.createDataFrame([("more.mod", '<!ENTITY f "both">')], own.schema))
    source = docs.table(spark, d, "nation").select(c("n_nationkey").alias("doc_id"), docs.cat('<!DOCTYPE n SYSTEM "s', c("n_regionkey"), '.dtd" [<!ENTITY i "', c("n_nationkey"), '">]><n>&e;-&i;-&f;</n>').alias("xml"))
    return parse(documents.resolved(source, external=outer)).where("event_type = 'characters'").select("doc_id", c("content").alias("text"))


#: Declarations that no document may hold, and what they are called.
REJECTED = [
    ('<!ENTITY e "50%">', "bare_percent"), ('<!ENTITY e "&#0;">', "invalid_char_ref"), ('<!ATTLIST a b CDATA "x & y">', "bare_ampersand"), ("<!ATTLIST 1a b CDATA #IMPLIED>", "invalid_name"), ("<!ATTLIST a 1b CDATA #IMPLIED>", "invalid_name"),
    ('<!ATTLIST a b (x,y) "x">', "invalid_enumeration"), ("<!ATTLIST a b NOTATION (1x) #IMPLIED>", "invalid_enumeration"), ('<!NOTATION 1n SYSTEM "s">', "invalid_name"), ('<!ENTITY e SYSTEM "s" NDATA 1n>', "invalid_name"), ("<?xml version='1.0'?>", "reserved_pi_target"),
    ('<!ENTITY % p "x"><!ENTITY e "%p;">', "pe_in_internal_declaration"), ('<!NOTATION n PUBLIC "{}">', "invalid_public_id"), ("<!ELEMENT a - - (b)>", "invalid_element"), ("<!ELEMENT a (b)) >", "invalid_content_model"), ("<!-- a -- b -->", "invalid_declaration"),
]


@query("DT8_rejections", f"SELECT n_nationkey AS doc_id, v.error FROM nation JOIN (VALUES {', '.join(str((i, k)) for i, (_, k) in enumerate(REJECTED))}) v(i, error) ON n_nationkey % {len(REJECTED)} = v.i")
def _(spark, d):
    pick = F.element_at(F.array(*[F.lit(x) for x, _ in REJECTED]), (c("n_nationkey") % len(REJECTED) + 1).cast("int"))
    source = docs.table(spark, d, "nation").select(c("n_nationkey").alias("doc_id"), docs.cat("<!DOCTYPE a [", pick, "]><a/>").alias("xml"))
    return documents.declarations(source).where("kind = 'error'").select("doc_id", "error")


# --- consumers


@query("K2_serialize_roundtrip", "SELECT n_nationkey AS doc_id, '<n k=\"' || n_nationkey || '\" r=\"' || n_regionkey || '\">' || n_name || '</n>' AS xml FROM nation")
def _(spark, d):
    return serialize.to_text(parse(docs.nations(spark, d))).select(c("doc_id").cast("int").alias("doc_id"), "xml")


@query("K1_serialize_pretty", "SELECT o_orderkey AS doc_id, '<a>' || chr(10) || '  <b>' || chr(10) || '    ' || o_orderstatus || chr(10) || '  </b>' || chr(10) || '</a>' || chr(10) AS xml FROM orders")
def _(spark, d):
    return serialize.to_text(parse(_spaced(spark, d)), pretty=True)


@query("K1_self_closing", "SELECT c_custkey AS doc_id, '<o xmlns=\"urn:o\"><i/></o>' AS xml FROM customer")
def _(spark, d):
    rows = parse(docs.customers(spark, d)).where(c("name").isin("o", "i"))
    return serialize.to_text(rows)


@query("K3_blocks", "SELECT doc_id, CAST(greatest(ceil(strlen(text) / 1000.0), 1) AS BIGINT) AS blocks, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def _(spark, d):
    rows = serialize.blocks(docs.table(spark, d, "documents"), 1000, "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("data")).alias("bytes"))


@query("K3_greedy_blocks", "SELECT o_orderkey AS doc_id, o_orderstatus AS s FROM orders")
def _(spark, d):
    rows = serialize.greedy_blocks(serialize.fragments(parse(_spaced(spark, d))), 8)
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", c("data").cast("string").alias("t")))).alias("b"))
    return whole.select("doc_id", F.regexp_extract(F.array_join(F.transform("b", lambda x: x["t"]), ""), "<b>(.*)</b>", 1).alias("s"))


@query("M11_text_content", "SELECT o_orderkey AS doc_id, o_orderstatus || coalesce(x, '') AS text FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey || '' || CAST(l_quantity AS INT), '' ORDER BY l_linenumber, l_returnflag, l_partkey || '</part><qty>' || CAST(l_quantity AS INT) || '<') AS x FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    return nodes.text_content(parse(docs.orders(spark, d), columns=("event_type", "name", "content", "elem_id")), "order").select("doc_id", "text")


@query("M5_elements_by_tag_name", "SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return nodes.elements_by_tag_name(nodes.nodes(parse(docs.orders(spark, d)), columns=("kind", "local")), "qty").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("M6_element_by_id", "SELECT o_orderkey AS doc_id, 'order' AS name FROM orders")
def _(spark, d):
    n = nodes.nodes(parse(docs.orders(spark, d)), columns=("node_id", "kind", "name", "attrs", "pre", "post"))
    return nodes.element_by_id(n, c("doc_id").cast("string")).select("doc_id", "name")


@query("M10_child_count", "SELECT o_orderkey AS doc_id, CAST(1 + coalesce(n, 0) AS BIGINT) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    return nodes.child_counts(nodes.nodes(parse(docs.orders(spark, d)), columns=("node_id", "parent_id", "pre", "kind", "name"))).where("name = 'order'").select("doc_id", "n")


@query("M12_descendants", "SELECT l_orderkey AS doc_id, count(*) * 3 AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    n = nodes.nodes(parse(docs.orders(spark, d)), columns=("node_id", "pre", "post", "depth", "kind", "name", "local"))
    below = nodes.descendants(n, "order").where("name <> 'status'")
    return below.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("M2_tree_roundtrip", "SELECT o_orderkey AS doc_id, '<a> ' || chr(10) || '<b>' || o_orderstatus || '</b> </a>' AS xml FROM orders")
def _(spark, d):
    return serialize.to_text(nodes.to_events(nodes.nodes(parse(_spaced(spark, d)), keep_space=True)))


@query("SF1_simple_form", "SELECT n_nationkey AS doc_id, '[\"n\",[[\"k\",\"' || n_nationkey || '\"],[\"r\",\"' || n_regionkey || '\"]],[\"' || n_name || '\"]]' AS form FROM nation")
def _(spark, d):
    return documents.simple_form(docs.nations(spark, d)).select(c("doc_id").cast("int").alias("doc_id"), "form")


@query("SF2_from_simple_form", "SELECT n_nationkey AS doc_id, '<n k=\"' || n_nationkey || '\" r=\"' || n_regionkey || '\">' || n_name || '</n>' AS xml FROM nation")
def _(spark, d):
    return documents.from_simple_form(documents.simple_form(docs.nations(spark, d))).select(c("doc_id").cast("int").alias("doc_id"), "xml")


@query("A1_sax_fold", "SELECT l_orderkey AS doc_id, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    from .functions.tree import Handler

    class Total(Handler):
        def start_element(self, uri, local, qname, attrs, state):
            return (local, state[1])

        def characters(self, text, state):
            return (state[0], (state[1] or 0) + int(text)) if state[0] == "qty" else state

    return nodes.sax_fold(parse(docs.orders(spark, d)), Total(), lambda: (None, None), lambda s: [{"total": s[1]}] if s[1] is not None else [], "total long")


@query("A1_sax_halt", "SELECT o_orderkey AS doc_id, o_orderstatus AS first FROM orders")
def _(spark, d):
    from .functions.tree import Halt, Handler

    class First(Handler):
        def characters(self, text, state):
            raise Halt(text)

    return nodes.sax_fold(parse(docs.orders(spark, d)), First(), lambda: None, lambda s: [{"first": s}], "first string")


@query("C2_stax_codes", "SELECT o_orderkey AS doc_id, CAST(7 + 8 + 4 + 2 * 3 + coalesce(n, 0) * (3 * 3 + 2 * 4) AS BIGINT) AS codes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    return parse(docs.orders(spark, d), columns=("event_type",)).groupBy("doc_id").agg(F.sum(E.stax_code()).cast("long").alias("codes"))


@query("C5_attribute_by_namespace", "SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS seg, 'p:k' AS first, 2 AS n FROM customer")
def _(spark, d):
    rows = parse(docs.customers(spark, d)).where(start("p:name"))
    return rows.select("doc_id", E.attribute_ns(None, "k").alias("k"), E.attribute_ns(None, "seg").alias("seg"), E.attribute_at(0)["name"].alias("first"), E.attribute_count().alias("n"))


@query("C4_element_text", "SELECT l_orderkey AS doc_id, CAST(sum(length(l_partkey || '' || CAST(l_quantity AS INT))) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return nodes.text_content(parse(docs.orders(spark, d), columns=("event_type", "name", "content", "elem_id")), "line").groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))


@query("W1_writer", "SELECT n_nationkey AS doc_id, '<?xml version=\"1.0\"?><n xmlns:p=\"urn:p\" p:k=\"' || n_nationkey || '\">' || n_name || '<e/></n>' AS xml FROM nation")
def _(spark, d):
    from .functions.tree import Writer

    def one(b: bytes) -> list[dict]:
        k, _, name = b.decode().partition(":")
        return [{"xml": Writer().start_document().start_element("n").namespace("p", "urn:p").attribute("k", k, "p").characters(name).empty_element("e").end_document().to_text()}]

    source = docs.table(spark, d, "nation").select(c("n_nationkey").alias("doc_id"), docs.cat(c("n_nationkey"), ":", c("n_name")).alias("xml"))
    return documents.per_document(source, one, "xml string")


@query("Z1_c14n", "SELECT o_orderkey AS doc_id, '<a a=\"' || o_orderstatus || '\" b=\"1\"><x></x> &amp; y</a>' AS canonical FROM orders")
def _(spark, d):
    source = docs.table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), docs.cat("<?xml version='1.0'?><a b='1'   a=\"", c("o_orderstatus"), '"><!-- c --><x/><![CDATA[ & y]]></a>').alias("xml"))
    return documents.canonicalize(source).select("doc_id", "canonical")


@query("Z1_c14n_with_comments", "SELECT o_orderkey AS doc_id, '<a><!-- ' || o_orderstatus || ' --></a>' AS canonical FROM orders")
def _(spark, d):
    source = docs.table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), docs.cat("<a><!-- ", c("o_orderstatus"), " --></a>").alias("xml"))
    return documents.canonicalize(source, "c14n_with_comments").select("doc_id", "canonical")


@query("Z1_exc_c14n", "SELECT c_custkey AS doc_id, '<c xmlns=\"urn:d' || c_custkey % 7 || '\"><p:name xmlns:p=\"urn:p' || c_custkey % 5 || '\" seg=\"' || c_mktsegment || '\" p:k=\"' || c_custkey || '\">' || c_name || '</p:name><bal>' || c_nationkey || '</bal><o xmlns=\"urn:o\"><i></i></o></c>' AS canonical FROM customer")
def _(spark, d):
    return documents.canonicalize(docs.customers(spark, d), "exc_c14n").select("doc_id", "canonical")


# --- XML Schema types

_TYPED = {
    "byte": ("CAST(o_orderkey % 400 - 200 AS VARCHAR)", "o_orderkey % 400 - 200 BETWEEN -128 AND 127"), "unsignedByte": ("CAST(o_orderkey % 400 - 50 AS VARCHAR)", "o_orderkey % 400 - 50 BETWEEN 0 AND 255"),
    "positiveInteger": ("CAST(o_orderkey % 3 AS VARCHAR)", "o_orderkey % 3 > 0"), "integer": ("CASE WHEN o_orderkey % 2 = 0 THEN ' +0' || CAST(o_orderkey AS VARCHAR) ELSE '1.0' END", "o_orderkey % 2 = 0"),
    "decimal": ("CASE o_orderkey % 3 WHEN 0 THEN '.5' WHEN 1 THEN '1e5' ELSE '-12.' END", "o_orderkey % 3 <> 1"), "double": ("CASE o_orderkey % 4 WHEN 0 THEN 'INF' WHEN 1 THEN '1e5' WHEN 2 THEN 'Infinity' ELSE 'NaN' END", "o_orderkey % 4 <> 2"),
    "boolean": ("CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '1' ELSE 'yes' END", "o_orderkey % 3 <> 2"), "date": ("CASE o_orderkey % 3 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' ELSE '2024-01-15Z' END", "o_orderkey % 3 <> 1"),
    "dateTime": ("CASE o_orderkey % 2 WHEN 0 THEN '2024-01-15T10:00:00.5+02:00' ELSE '2024-01-15 10:00:00' END", "o_orderkey % 2 = 0"), "duration": ("CASE o_orderkey % 4 WHEN 0 THEN 'P1Y2M' WHEN 1 THEN 'P' WHEN 2 THEN '-PT5.5S' ELSE 'P1S' END", "o_orderkey % 4 IN (0, 2)"),
    "NCName": ("CASE o_orderkey % 3 WHEN 0 THEN 'a-b' WHEN 1 THEN 'a:b' ELSE '-a' END", "o_orderkey % 3 = 0"), "hexBinary": ("CASE o_orderkey % 2 WHEN 0 THEN '0fA9' ELSE '0fA' END", "o_orderkey % 2 = 0"), "base64Binary": ("CASE o_orderkey % 2 WHEN 0 THEN 'aGVsbG8=' ELSE 'aGVsbG8' END", "o_orderkey % 2 = 0"),
    "gYearMonth": ("CASE o_orderkey % 2 WHEN 0 THEN '2024-12' ELSE '2024-13' END", "o_orderkey % 2 = 0"), "language": ("CASE o_orderkey % 2 WHEN 0 THEN 'en-GB' ELSE 'toolonglang' END", "o_orderkey % 2 = 0"), "token": ("CASE o_orderkey % 2 WHEN 0 THEN 'a b' ELSE 'a  b' END", "o_orderkey % 2 = 0"),
    "QName": ("CASE o_orderkey % 2 WHEN 0 THEN 'p:l' ELSE 'p:l:m' END", "o_orderkey % 2 = 0"), "NMTOKENS": ("CASE o_orderkey % 2 WHEN 0 THEN ' a 1b ' ELSE 'a !' END", "o_orderkey % 2 = 0"), "unsignedLong": ("CASE o_orderkey % 3 WHEN 0 THEN '18446744073709551615' WHEN 1 THEN '18446744073709551616' ELSE '-1' END", "o_orderkey % 3 = 0"),
}


def _typed(name: str, text: str, sql: str) -> None:
    @query(f"XS1_validate_{name}", f"SELECT o_orderkey, {sql} AS ok FROM orders")
    def _(spark, d):
        return docs.table(spark, d, "orders").select("o_orderkey", F.expr(text.replace("VARCHAR", "STRING")).alias("v")).select("o_orderkey", xsd.validate(c("v"), name).alias("ok"))


for _name, (_value, _ok) in _TYPED.items():
    _typed(_name, _value, _ok)


@query("XS2_parse", "SELECT o_orderkey, CAST(o_orderkey % 300 AS DECIMAL(38,0)) AS i, o_orderkey % 2 = 0 AS b, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,18)) AS n, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 100 AS BIGINT) AS months FROM orders")
def _(spark, d):
    k = c("o_orderkey")
    return docs.table(spark, d, "orders").select(
        k, xsd.parse(docs.cat(" ", k % 300, "\n"), "byte").alias("i"), xsd.parse(F.when(k % 2 == 0, "1").otherwise("false"), "boolean").alias("b"), xsd.parse(c("o_totalprice").cast("decimal(18,2)").cast("string"), "decimal").alias("n"),
        xsd.parse(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Z")), "date").alias("d"), xsd.parse(docs.cat("P1Y", k % 100, "MT5S"), "duration")["months"].alias("months"),
    )


@query("XS3_encode", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS b, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t, hex(o_orderstatus) AS h, to_base64(CAST(o_orderstatus AS BLOB)) AS s FROM orders")
def _(spark, d):
    k = c("o_orderkey")
    return docs.table(spark, d, "orders").select(k, xsd.encode(k % 2 == 0, "boolean").alias("b"), xsd.encode(c("o_orderdate"), "dateTime").alias("t"), xsd.encode(c("o_orderstatus").cast("binary"), "hexBinary").alias("h"), xsd.encode(c("o_orderstatus").cast("binary"), "base64Binary").alias("s"))


@query("XS4_infer_type", "SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name, unnest(['long', 'string', 'string', 'string', 'long']) AS type")
def _(spark, d):
    return spark.createDataFrame([(f.name, xsd.infer_type(f.dataType)) for f in docs.table(spark, d, "documents").schema], "name string, type string")


@query("XS5_whitespace", r"SELECT doc_id, trim(regexp_replace(replace(replace(text, chr(10), ' '), chr(9), ' '), ' +', ' ', 'g'), ' ') AS text FROM documents")
def _(spark, d):
    return docs.table(spark, d, "documents").select("doc_id", xsd.normalize_whitespace(c("text"), "collapse").alias("text"))


@query("XS6_facets", "SELECT o_orderkey, o_orderkey % 1000 BETWEEN 10 AND 500 AS range, length(CAST(o_orderkey AS VARCHAR)) <= 3 AS digits, o_orderstatus IN ('F', 'O') AS enum, regexp_full_match(o_orderpriority, '[0-9]-[A-Z ]+') AS pattern, length(o_orderpriority) = 6 AS len FROM orders")
def _(spark, d):
    k = c("o_orderkey")
    return docs.table(spark, d, "orders").select(
        k, xsd.validate_facets((k % 1000).cast("string"), "int", [("minInclusive", 10), ("maxExclusive", 501)]).alias("range"), xsd.validate_facets(k.cast("string"), "integer", [("totalDigits", 3)]).alias("digits"),
        xsd.validate_facets(c("o_orderstatus"), "string", [("enumeration", "F"), ("enumeration", "O")]).alias("enum"), xsd.validate_facets(c("o_orderpriority"), "string", [("pattern", "[0-9]-[A-Z ]+")]).alias("pattern"), xsd.validate_facets(c("o_orderpriority"), "string", [("length", 6)]).alias("len"),
    )


@query("XS9_hierarchy", "WITH RECURSIVE b(t, base) AS (VALUES ('byte', 'short'), ('short', 'int'), ('int', 'long'), ('long', 'integer'), ('integer', 'decimal'), ('decimal', 'anySimpleType'), ('anySimpleType', 'anyType')), r(t, base) AS (SELECT 'byte', 'byte' UNION ALL SELECT r.t, b.base FROM r JOIN b ON r.base = b.t) SELECT t AS type, base AS ancestor FROM r")
def _(spark, d):
    return spark.createDataFrame([("byte", x) for x in xsd.chain("xs:byte")], "type string, ancestor string")


@query("XS10_spark_types", "SELECT unnest(['byte', 'unsignedInt', 'decimal', 'date', 'hexBinary', 'NMTOKENS', 'anyURI']) AS type, unnest(['tinyint', 'bigint', 'decimal(38,18)', 'date', 'binary', 'array<string>', 'string']) AS spark")
def _(spark, d):
    names = ["byte", "unsignedInt", "decimal", "date", "hexBinary", "NMTOKENS", "anyURI"]
    return spark.createDataFrame([(n, xsd.to_spark_type(n).simpleString()) for n in names], "type string, spark string")


@query("XS11_gregorian", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders")
def _(spark, d):
    g = xsd.gregorian_parts(F.date_format("o_orderdate", "yyyy-MM"), "gYearMonth")
    return docs.table(spark, d, "orders").select("o_orderkey", g["year"].alias("y"), g["month"].alias("m"))


# --- security


@query("SE1_digest", "SELECT doc_id, sha256(text) AS d FROM documents")
def _(spark, d):
    return docs.table(spark, d, "documents").select("doc_id", F.lower(F.hex(crypto.digest(c("text"), "sha256"))).alias("d"))


@query("SE2_aes_roundtrip", "SELECT doc_id, text AS gcm, text AS cbc, CAST(strlen(text) + 28 AS INT) AS n FROM documents")
def _(spark, d):
    key = F.unhex(F.lit("00112233445566778899AABBCCDDEEFF"))
    b = c("text").cast("binary")
    rows = docs.table(spark, d, "documents").select("doc_id", crypto.encrypt(b, key, "aes128_gcm").alias("g"), crypto.encrypt(b, key, "aes128_cbc").alias("b"))
    return rows.select("doc_id", crypto.decrypt(c("g"), key, "aes128_gcm").cast("string").alias("gcm"), crypto.decrypt(c("b"), key, "aes128_cbc").cast("string").alias("cbc"), F.octet_length("g").alias("n"))


def _key() -> crypto.PrivateKey:
    """A fixed key pair for the queries: the primes next above two powers, so not for use."""
    p, q = 2**521 - 1, 2**607 - 1
    return crypto.PrivateKey(p * q, 65537, pow(65537, -1, (p - 1) * (q - 1)))


@query("SE6_sign_verify", "SELECT n_nationkey AS doc_id, n_nationkey % 2 = 0 AS valid, CASE WHEN n_nationkey % 2 = 0 THEN 'valid' ELSE 'digest_mismatch' END AS reason FROM nation")
def _(spark, d):
    signed = sealed.sign(docs.nations(spark, d), _key())
    spoilt = signed.select("doc_id", F.when(c("doc_id") % 2 == 0, c("xml")).otherwise(F.regexp_replace("xml", ' r="', ' r="9')).alias("xml"))
    return sealed.verify(spoilt, _key().public).select(c("doc_id").cast("int").alias("doc_id"), "valid", "reason")


@query("SE3_sign_bytes", "SELECT n_nationkey AS doc_id, true AS valid, false AS other FROM nation")
def _(spark, d):
    def one(b: bytes) -> list[dict]:
        signed = crypto.sign(b, _key(), "rsa_sha512")
        return [{"valid": crypto.verify(b, signed, _key().public, "rsa_sha512"), "other": crypto.verify(b + b"x", signed, _key().public, "rsa_sha512")}]

    return documents.per_document(docs.nations(spark, d), one, "valid boolean, other boolean").withColumn("doc_id", c("doc_id").cast("int"))


@query("SE8_signature_info", "SELECT n_nationkey AS doc_id, 'rsa_sha256' AS signature_algorithm, 'exc_c14n' AS c14n_algorithm, 'sha256' AS digest_algorithm, 0 AS missing FROM nation")
def _(spark, d):
    info = sealed.signature_info(sealed.sign(docs.nations(spark, d), _key()))
    return info.select(c("doc_id").cast("int").alias("doc_id"), "signature_algorithm", "c14n_algorithm", "digest_algorithm", F.size("missing").alias("missing"))


def _secret(spark, d):
    return docs.table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), docs.cat('<c><s Id="s1">', F.replace("c_name", F.lit("&"), F.lit("&amp;")), "</s><k>", c("c_custkey"), "</k></c>").alias("xml"))


@query("SE9_encrypt_decrypt", "SELECT c_custkey AS doc_id, '<c><s Id=\"s1\">' || replace(c_name, '&', '&amp;') || '</s><k>' || c_custkey || '</k></c>' AS xml FROM customer")
def _(spark, d):
    key = bytes(range(32))
    return sealed.decrypt(sealed.encrypt(_secret(spark, d), "#s1", key), key)


@query("SE10_key_transport", "SELECT c_custkey AS doc_id, c_name AS name FROM customer")
def _(spark, d):
    sent = sealed.encrypt(_secret(spark, d), "#s1", bytes(range(16)), "aes128_gcm", "content", _key().public)
    events = parse(sealed.decrypt(sent, private=_key()), columns=("event_type", "content", "path"))
    return events.where((c("event_type") == "characters") & (F.element_at("path", -1) == "s")).select("doc_id", resolve.resolve_text(c("content")).alias("name"))


@query("SE11_encrypted_data", "SELECT c_custkey AS doc_id, 'element' AS type, 'aes256_gcm' AS algorithm, CAST(strlen('<s Id=\"s1\">' || replace(c_name, '&', '&amp;') || '</s>') + 28 AS INT) AS n FROM customer")
def _(spark, d):
    return sealed.encrypted_parts(sealed.encrypt(_secret(spark, d), "#s1", bytes(range(32)))).select("doc_id", "type", "algorithm", F.octet_length("cipher").alias("n"))


# --- streaming


@query("ST1_stream_equals_batch", _TAGS + "SELECT name, count(*) AS n FROM t GROUP BY name")
def _(spark, d):
    import uuid

    from .sources.shared import shared_dir
    from .streaming.chunks import parse_stream

    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    arriving = spark.readStream.schema(schema).parquet(f"{d}/pages.parquet*").select(c("page_id").alias("doc_id"), c("html").alias("xml"))
    starts = parse_stream(arriving, config=HTML).where(start()).select("doc_id", "name")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writing = starts.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    writing.awaitTermination()
    return spark.read.schema("doc_id long, name string").parquet(f"{at}/out").groupBy("name").agg(F.count("*").alias("n"))


