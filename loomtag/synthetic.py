"""Documents made from the relational tables, so that what must come out of them is known in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.resolve import encode, encode_attr
from .sources.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c(name: str) -> Column:
    return F.col(name)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = cat('<n k="', c("n_nationkey"), '" r="', c("n_regionkey"), '">', c("n_name"), "</n>")
    return table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("doc_id"), xml.alias("xml"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces by id: a default one on the root, a prefixed child, an unprefixed one and one that overrides."""
    k = c("c_custkey")
    xml = cat('<c xmlns="urn:d', k % 7, '" xmlns:p="urn:p', k % 5, '"><p:name p:k="', k, '" seg="', encode_attr(c("c_mktsegment")), '">', encode(c("c_name")), '</p:name><bal>', c("c_nationkey"), '</bal><o xmlns="urn:o"><i/></o></c>')
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), xml.alias("xml"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each order with its lines. Lines are dealt as the few columns they are made of and become
    text behind that. The number of partitions is given, as AQE would put together what is small as columns and
    long to parse."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", c("l_quantity").cast("int").alias("qty"))
    line = F.struct("l_linenumber", cat('<line no="', c("l_linenumber"), '" flag="', c("l_returnflag"), '"><part>', c("l_partkey"), "</part><qty>", c("qty"), "</qty></line>").alias("x"))
    lines = raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = lines.select("l_orderkey", F.array_join("lines.x", "").alias("body"))
    both = table(spark, sf_dir, "orders").join(body, c("o_orderkey") == c("l_orderkey"), "left")
    xml = cat('<order id="', c("o_orderkey"), '"><status>', c("o_orderstatus"), "</status>", F.coalesce("body", F.lit("")), "</order>")
    return both.select(c("o_orderkey").alias("doc_id"), xml.alias("xml"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in CDATA, with a comment and an instruction."""
    xml = cat("<doc><![CDATA[", c("text"), "]]><!--", c("doc_id"), "--><?lang ", c("lang"), "?></doc>")
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped as character data, under an XML declaration."""
    xml = cat('<?xml version="1.0" encoding="UTF-8"?><t id="', c("doc_id"), '" src="', encode_attr(c("source")), '">', encode(c("text")), "</t>")
    return table(spark, sf_dir, "documents").select("doc_id", xml.alias("xml"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared entity, nested in another, character references and a tokenised attribute."""
    k, n = c("n_nationkey"), c("n_name")
    xml = cat("<!DOCTYPE n [<!ENTITY e", k, ' "v', k, '"><!ENTITY f "[&e', k, ';]"><!ELEMENT n (#PCDATA)><!ATTLIST n k NMTOKENS #IMPLIED c CDATA "d', k, '"><!NOTATION gif SYSTEM "g', k, '">]><n k="  a   ', k, '  ">', n, " &#65;&#x42; &f; &lt;</n>")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("doc_id"), xml.alias("xml"))


#: What is wrong in the documents of ``faulty``, by doc_id modulo their number, and what the tokenizer or a
#: validator calls it.
FAULTS = [
    ("<a><b></a></b>", "tag_mismatch"), ("<a><b/>", "unclosed_tag"), ('<a x="1" x="2"/>', "attr_unique"), ('<a x="<"/>', "attr_lt"), ("<p:a/>", "undeclared_namespace"),
    ("<a><!-- x -- y --></a>", "comment"), ("<a/><b/>", "multiple_roots"), ("<a/>text", "text_outside_root"), ('<?xml encoding="UTF-8"?><a/>', "missing_version"), ("<a>&#xZZ;</a>", "malformed_char_ref"),
    ("<a>x]]>y</a>", "text_cdata_end"), ("<a", "eof_in_tag"), ("<a><!-- x", "eof_in_comment"), ("<a><![CDATA[x", "eof_in_cdata"), ("<a><?t x", "eof_in_pi"), ("<a b></a>", "expected_eq"),
    ("<a b=c></a>", "expected_quote"), ("<a><?XML x?></a>", "reserved_pi_target"), ("<a> <?xml version='1.0'?></a>", "misplaced_xml_decl"), ("</a>", "unexpected_close"), ("<a>&nope;</a>", "undefined_entity"),
    ('<a xmlns:p=""/>', "empty_prefix_binding"), ('<a xmlns:p="u" xmlns:q="u" p:x="1" q:x="2"/>', "duplicate_attribute"), ("<a:b:c/>", "invalid_qname"), ("<a/>", "none"),
]


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x, _ in FAULTS]), (c("o_orderkey") % len(FAULTS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("doc_id"), pick.alias("xml"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), c("html").alias("xml"))


def html_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("c_custkey")
    xml = cat("<form><input disabled name=f", k, ' checked><a href="/x?', k, '" class=', F.lower(c("c_mktsegment")), ">", k, "</a><script>if (a < ", k, " && b) { '</p>' }</script></form>")
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), xml.alias("xml"))
