"""The tokenizer as one regular expression, wholly in the JVM, for documents that it covers without loss.

``covered`` tells which documents those are: their tokens add up to their bytes and none is of a kind only the
full tokenizer reads. ``tokens`` gives one row for each token of these, in order, with its byte position.
``tag_names`` takes any documents: those not covered go through the full tokenizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ParserConfig
from ..sources.parse import parse

_RAW = r"(?i:<(?:script|style)\b[^>]*+>)[\s\S]*?(?=(?i:</(?:script|style)\s*>))"
_TAG = r"<[A-Za-z_:](?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>"
XML = rf"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<!DOCTYPE[^\[>]*+>|<\?[\s\S]*?\?>|</[^<>]*+>|{_TAG}|[^<]++|<"
HTML = rf"<!--[\s\S]*?-->|<!(?i:doctype)[^>]*+>|{_RAW}|</[^<>]*+>|{_TAG}|[^<]++|<"


def tokenized(docs: DataFrame, text: str = "xml", mode: str = "xml") -> DataFrame:
    """``docs(doc_id, text)`` with an array of tokens."""
    return docs.select("doc_id", F.col(text).alias("source"), F.regexp_extract_all(F.col(text), F.lit(HTML if mode == "html" else XML), F.lit(0)).alias("tokens"))


def covered() -> Column:
    """Whether the tokens are the whole document, and a lone '<' is not among them."""
    return (F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t)) == F.octet_length("source")) & ~F.array_contains("tokens", "<")


def kind(token: Column) -> Column:
    return (
        F.when(~token.startswith("<"), F.when(token.rlike(r"\A[ \t\r\n]+\z"), "space").otherwise("characters"))
        .when(token.startswith("</"), "end_element")
        .when(token.startswith("<!--"), "comment")
        .when(token.startswith("<![CDATA["), "cdata")
        .when(token.startswith("<!"), "dtd")
        .when(token.rlike(r"\A<\?xml\s"), "prolog")
        .when(token.startswith("<?"), "processing_instruction")
        .when(token == "<", "error")
        .otherwise("start_element")
    )


def _raw_closed() -> Column:
    """Whether each script and style is a plain tag whose own end tag comes next."""

    def closed(t: Column, i: Column) -> Column:
        after = F.coalesce(F.get("tokens", i + 1), F.lit(""))
        same = [t.rlike(rf"(?i)\A<{n}[\s>]") & after.rlike(rf"(?i)\A</{n}\s*>") for n in ("script", "style")]
        return ~t.rlike(r"(?i)\A<(?:script|style)") | same[0] | same[1]

    return F.size(F.filter("tokens", lambda t, i: ~closed(t, i))) == 0


def tag_names(docs: DataFrame, text: str = "xml", mode: str = "xml") -> DataFrame:
    """(doc_id, place, name) of all start tags, ``place`` in order within the document: no exchange, and
    Python only for documents that aren't covered."""
    all_ = tokenized(docs, text, mode)
    plain = F.coalesce(covered() & _raw_closed() if mode == "html" else covered(), F.lit(False))
    rows = all_.where(plain).select("doc_id", F.posexplode("tokens").alias("place", "token"))
    rows = rows.where(kind(F.col("token")) == "start_element").select("doc_id", "place", F.regexp_extract("token", r"\A<([^\s/>]+)", 1).alias("name"))
    rest = parse(all_.where(~plain).select("doc_id", "source"), text="source", config=ParserConfig(mode=mode, positions="none"))
    return rows.unionByName(rest.where("event_type = 'start_element'").select("doc_id", F.col("seq").cast("int").alias("place"), "name"))


def tokens(docs: DataFrame, text: str = "xml", mode: str = "xml") -> DataFrame:
    """(doc_id, place, kind, token, pos): positions need one exchange by document."""
    rows = tokenized(docs, text, mode).select("doc_id", F.posexplode("tokens").alias("place", "token"))
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "place", kind(F.col("token")).alias("kind"), "token", F.coalesce(F.sum(F.octet_length("token")).over(w), F.lit(0)).alias("pos"))
